"""Checks on a stream: per micro-batch, per day and on alert.

The per-batch check is exact, because a micro-batch is an ordinary table. The
windowed checks keep counts per bin as state, whose size is bounded by open
windows x bins x features: exact for PSI, binned for AUC, with the largest
possible error beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shiftspark.functions.stats import count_where, d, known
from shiftspark.operators.evaluate import CELLS, METRICS, with_prf
from shiftspark.operators.prefix import Running, running_sums, size_up, with_bucket
from shiftspark.operators.psi import bin_rows, fold_bins, psi_against_baseline
from shiftspark.plans.monitoring import profile_check
from shiftspark.sources.profile_store import Profile
from shiftspark.spec import ObsSpec, RatioPolicy

SCORE_BINS = 200


def score_cuts(base: DataFrame, spec: ObsSpec, bins: int = SCORE_BINS) -> list[float]:
    """Scores that cut the baseline into ``bins`` of about equal numbers of rows, for the state of a daily evaluation.

    A cut is a distinct score at which the running count passes a multiple of
    1 / bins of the rows; at most bins - 1 numbers reach the driver."""
    layout = size_up(base, spec.scenario, [spec.score])
    scores = base.select(F.lit("all").alias("all"), known(spec.score).alias("s")).filter("s IS NOT NULL")
    counts = scores.groupBy("all", "s").agg(F.count("*").alias("n"))
    rows = running_sums(with_bucket(counts, "s", {"s": layout.cuts[spec.score]}), "s", [Running("upto", "n", ("all",), total=True)])
    part = lambda c: F.floor(c * bins / F.col("upto_total"))
    passed = part(F.col("upto") - F.col("n")) < part(F.col("upto"))
    return sorted(r["s"] for r in rows.filter(passed & (F.col("upto") < F.col("upto_total"))).select("s").collect())


def start_batch_check(
    stream: DataFrame, profile: Profile, spec: ObsSpec, policy: RatioPolicy, out: str, checkpoint: str
) -> StreamingQuery:
    """Checks every micro-batch against the stored profile.

    Results go to ``out/checks`` and those that call for retraining to
    ``out/alerts``. Each micro-batch overwrites its own ``batch_id`` folder,
    so one that is run again after a failure leaves no double rows."""

    def check(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            result = f"{out}/checks/batch_id={batch_id}"
            profile_check(batch, profile, spec, policy).write.mode("overwrite").parquet(result)
            checked = batch.sparkSession.read.parquet(result)
            checked.filter("retrain").write.mode("overwrite").parquet(f"{out}/alerts/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(check)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def daily_cells(stream: DataFrame, spec: ObsSpec, cuts: list[float], late: str = "1 day") -> DataFrame:
    """Streaming aggregation: counts per day and score bin, the number of cuts up to the score.

    A row without a score counts in the matrix under bin -1."""
    y, p = F.col(spec.label), F.col(spec.prediction)
    placed = with_bucket(stream.withColumn("_score", known(spec.score)), "_score", {"_score": cuts})
    bin_ = F.when(F.col("_score").isNull(), F.lit(-1)).otherwise(F.col("_bucket").cast("int"))
    return (
        placed.withWatermark(spec.event_time, late)
        .groupBy(F.window(spec.event_time, "1 day"), bin_.alias("bin"))
        .agg(
            F.count("*").alias("rows"),
            count_where(y == 1).alias("pos"),
            count_where(y == 0).alias("neg"),
            count_where((y == 0) & (p == 0)).alias("tn"),
            count_where((y == 0) & (p == 1)).alias("fp"),
            count_where((y == 1) & (p == 0)).alias("fn"),
            count_where((y == 1) & (p == 1)).alias("tp"),
        )
        .select(F.col("window.start").alias("day"), "bin", "rows", "pos", "neg", *CELLS)
    )


def daily_metrics(cells: DataFrame) -> DataFrame:
    """Metric record per day from the cells; AUC counts a bin as a tie.

    Pairs of a positive and a negative in one bin count half, and only they
    can be wrong, by half a pair each: ``auc_error`` is the most by which the
    exact AUC differs. A day has at most as many rows here as there are bins,
    so its window is small."""
    upto = W.partitionBy("day").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    scored = F.col("bin") >= 0
    ranked = cells.withColumn("_p", F.when(scored, F.col("pos")).otherwise(0)).withColumn(
        "_n", F.when(scored, F.col("neg")).otherwise(0)
    )
    ranked = ranked.withColumn("_upto", F.sum("_n").over(upto))
    pairs = F.sum("_p").cast("double") * F.sum("_n").cast("double")
    wins = F.sum(F.col("_p").cast("double") * ((F.col("_upto") - F.col("_n")) + F.col("_n") * d(0.5)))
    tied = F.sum(F.col("_p").cast("double") * F.col("_n") * d(0.5))
    sums = ranked.groupBy("day").agg(
        F.sum("rows").alias("n_rows"),
        *[F.sum(c).alias(c) for c in CELLS],
        F.when(pairs > 0, wins / pairs).alias("auc_roc"),
        F.when(pairs > 0, tied / pairs).alias("auc_error"),
    )
    return with_prf(sums).select("day", "n_rows", *CELLS, *METRICS, "auc_error")


def windowed_bins(stream: DataFrame, profile: Profile, spec: ObsSpec, late: str = "1 day") -> DataFrame:
    """Streaming aggregation: counts per day, feature and baseline bin."""
    marked = stream.withWatermark(spec.event_time, late)
    rows = bin_rows(marked, profile.edges, {"ts": F.col(spec.event_time).alias("ts")})
    return (
        rows.groupBy(F.window("ts", "1 day"), "feature", "bin")
        .agg(F.count("*").alias("c"))
        .select(F.col("window.start").alias("day"), "feature", "bin", "c")
    )


def windowed_psi(cells: DataFrame, profile: Profile, spec: ObsSpec) -> DataFrame:
    """PSI per day and feature; one batch is one day here."""
    day = F.date_format("day", "yyyy-MM-dd").alias("scenario")
    daily = fold_bins(cells.select(day, "feature", "bin", "c"), ["scenario", "feature"])
    return psi_against_baseline(daily.unionByName(profile.bins), spec)


def run_to_table(counts: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """Runs a streaming aggregation to the end of its input; the last state of every key, open windows included.

    Each micro-batch writes the keys it changed, with their new counts, into a
    folder of its own, so one that is run again after a failure writes the same
    folder again. Of a key the row of its latest batch counts."""

    def upsert(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = (
        counts.writeStream.outputMode("update")
        .foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return latest(counts.sparkSession, counts.schema, keys, out)


def latest(spark: SparkSession, schema: T.StructType, keys: list[str], out: str) -> DataFrame:
    """The row of the latest batch for each key of such a table; none where no batch has run."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(out)
    values = [c for c in schema.names if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v")).select(*keys, "_v.*").select(schema.names)
