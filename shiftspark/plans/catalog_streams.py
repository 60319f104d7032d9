"""Catalogue queries that run a stream to the end of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark.functions.display import rounded
from shiftspark.operators.evaluate import CELLS, METRICS
from shiftspark.plans import oracle as o
from shiftspark.plans.catalog import query
from shiftspark.plans.fixtures import EVENT_SPEC, event_columns, event_obs
from shiftspark.sources.profile_store import Profile, read_profile, write_profile
from shiftspark.sources.writers import shared_folder
from shiftspark.spec import RATIO_POLICY
from shiftspark.streaming import checks

SPEC = EVENT_SPEC
# Files that one micro-batch takes up at most.
FILES_PER_BATCH = 256


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as a stream of files."""
    path = f"{sf}/events.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", FILES_PER_BATCH)
    if table.inputFiles()[0].endswith("/events.parquet"):
        # A single file cannot be watched itself, its folder can.
        return event_columns(reader.option("pathGlobFilter", "events.parquet").parquet(sf))
    return event_columns(reader.parquet(path))


def event_profile(spark: SparkSession, sf: str) -> Profile:
    path = shared_folder(spark)
    write_profile(event_obs(spark, sf), SPEC, path)
    return read_profile(spark, SPEC, path)


def checked(spark: SparkSession, sf: str) -> str:
    """Runs the per-batch check over all days after the baseline; the folder with its results."""
    out = shared_folder(spark)
    batches = event_stream(spark, sf).filter(F.col("scenario") != SPEC.baseline)
    checks.start_batch_check(
        batches, event_profile(spark, sf), SPEC, RATIO_POLICY, out, f"{out}/checkpoint"
    ).awaitTermination()
    return out


EVENT_DECIDED = (
    *o.EVENTS,
    o.KS,
    o.SHARES.format(declared="2e0"),
    o.EVAL,
    o.COMPARED,
    o.DECISION,
    o.EVENT_RATIO,
    o.PSI,
)
CHECK_SQL = f"""SELECT r.scenario, n_drifted, {o.rs('drift_share', 'f1_score', 'auc_roc', 'avg_psi')}, retrain, reasons
    FROM ratio_decided r LEFT JOIN avgpsi a ON a.scenario = r.scenario"""
CHECK_COLUMNS = ["scenario", "n_drifted", "drift_share", "f1_score", "auc_roc", "avg_psi", "retrain"]


def _results(spark: SparkSession, path: str) -> DataFrame:
    return rounded(spark.read.parquet(path).select(*CHECK_COLUMNS, F.concat_ws("; ", "reasons").alias("reasons")))


@query("stream_batch_check", *EVENT_DECIDED, CHECK_SQL)
def stream_batch_check(spark, sf):
    return _results(spark, f"{checked(spark, sf)}/checks")


@query("stream_alerts", *EVENT_DECIDED, CHECK_SQL + " WHERE retrain")
def stream_alerts(spark, sf):
    return _results(spark, f"{checked(spark, sf)}/alerts")


DAY_SQL = """
days AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM obs)
"""

# Scores at which the baseline's running count passes a multiple of 1 / 200 of its rows.
CUTS_SQL = """
base AS (SELECT Probability AS s, count(*) AS n FROM obs WHERE scenario = 'Baseline' AND Probability IS NOT NULL GROUP BY 1),
running AS (SELECT s, n, sum(n) OVER (ORDER BY s) AS upto, sum(n) OVER () AS total FROM base),
cuts AS (SELECT list(s ORDER BY s) AS c FROM running WHERE upto < total
  AND floor((upto - n) * 200 / CAST(total AS DOUBLE)) < floor(upto * 200 / CAST(total AS DOUBLE)))
"""


@query(
    "stream_daily_eval",
    *o.EVENTS,
    DAY_SQL,
    CUTS_SQL,
    """daily AS (SELECT day AS scenario, Class, Prediction,
      CASE WHEN Probability IS NOT NULL THEN len(list_filter(c, lambda x: x <= Probability)) END AS Probability
      FROM days CROSS JOIN cuts)""",
    o.EVAL.replace("FROM obs", "FROM daily"),
    """ties AS (SELECT scenario, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
      THEN sum(pos * neg * 5e-1) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS auc_error FROM ranked GROUP BY scenario)""",
    f"""SELECT m.scenario AS day, n_rows, tn, fp, fn, tp, {o.rs(*METRICS, 'auc_error')}
    FROM metrics m LEFT JOIN ties t ON t.scenario = m.scenario""",
)
def stream_daily_eval(spark, sf):
    """All days, the last ones included, whose windows are still open when the input ends."""
    out = shared_folder(spark)
    base = event_obs(spark, sf).filter(F.col("scenario") == SPEC.baseline)
    cells = checks.daily_cells(event_stream(spark, sf), SPEC, checks.score_cuts(base, SPEC))
    cells = checks.run_to_table(cells, ["day", "bin"], f"{out}/cells", f"{out}/checkpoint")
    daily = checks.daily_metrics(cells).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return rounded(daily.select("day", "n_rows", *CELLS, *METRICS, "auc_error"))


@query(
    "stream_psi",
    o.EVENT_SQL,
    DAY_SQL,
    """long AS (
      SELECT 'Baseline' AS scenario, 'value' AS feature, value FROM obs WHERE scenario = 'Baseline' AND value IS NOT NULL
      UNION ALL SELECT 'Baseline', 'k', k FROM obs WHERE scenario = 'Baseline' AND k IS NOT NULL
      UNION ALL SELECT day, 'value', value FROM days WHERE value IS NOT NULL
      UNION ALL SELECT day, 'k', k FROM days WHERE k IS NOT NULL)""",
    o.PSI,
    f"SELECT scenario, feature, {o.rs('psi')} FROM psis",
)
def stream_psi(spark, sf):
    out = shared_folder(spark)
    profile = event_profile(spark, sf)
    cells = checks.windowed_bins(event_stream(spark, sf), profile, SPEC)
    cells = checks.run_to_table(cells, ["day", "feature", "bin"], f"{out}/bins", f"{out}/checkpoint")
    return rounded(checks.windowed_psi(cells, profile, SPEC))
