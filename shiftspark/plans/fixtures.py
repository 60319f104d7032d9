"""Observation views on the sample tables, as DataFrames and as SQL text.

The base tables carry the same distribution in every year, so all drift in
``obs`` comes from the changes written out here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark.functions.stats import d
from shiftspark.spec import ObsSpec

OBS_SPEC = ObsSpec(
    features=("qty", "price", "discount", "tax"),
    keys=("scenario", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    event_time="l_shipdate",
)
SCENARIOS = ["Drift 1", "Drift 2", "Drift 3", "Drift 4", "Drift 5"]


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by ship year: a baseline and five changed batches.

    One scan; the last year feeds two batches by exploding a list of names."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    year = F.year("l_shipdate")
    names = (
        F.when(year <= 1997, F.array(F.lit("Baseline")))
        .when(year == 1998, F.array(F.lit("Drift 1")))
        .when(year == 1999, F.array(F.lit("Drift 2")))
        .when(year == 2000, F.array(F.lit("Drift 3")))
        .when(year == 2001, F.array(F.lit("Drift 4"), F.lit("Drift 5")))
    )
    s, line = F.col("scenario"), F.col("l_linenumber")
    changed = (
        li.select("*", F.explode(names).alias("scenario"))
        .filter((s != "Drift 3") | (F.col("l_extendedprice") > d(20000)))
        .select(
            "scenario",
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            "l_shipdate",
            F.when(s == "Drift 2", F.col("l_quantity") * d(1.3)).otherwise(F.col("l_quantity")).alias("qty"),
            F.col("l_extendedprice").alias("price"),
            F.when(s == "Drift 4", d(0.05)).otherwise(F.col("l_discount")).alias("discount"),
            F.when((s == "Drift 5") | ((s == "Drift 4") & (line == 7)), F.lit(None).cast("double"))
            .otherwise(F.col("l_tax"))
            .alias("tax"),
            F.when(s == "Drift 5", 0)
            .when(F.col("l_quantity") + d(5) * line > d(60), 1)
            .otherwise(0)
            .alias("Class"),
        )
    )
    score = (F.col("qty") + d(3) * line + d(200) * F.col("discount")) / d(120)
    return changed.withColumn("Probability", score).withColumn(
        "Prediction", (F.col("Probability") > d(0.5)).cast("int")
    )


def obs_two_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``obs`` with the score and class of a second, better model."""
    second = (F.col("qty") + d(5) * F.col("l_linenumber")) / d(101)
    return (
        obs(spark, sf_dir)
        .withColumn("Probability2", second)
        .withColumn("Prediction2", (F.col("Probability2") > d(0.6)).cast("int"))
    )


EVENT_SPEC = ObsSpec(features=("value", "k"), event_time="ts")


def event_columns(events: DataFrame) -> DataFrame:
    """Observations from the event stream; the same columns in batch and streaming.

    The days up to the 10th of January 2024 are the baseline."""
    ts = F.col("ts").cast("timestamp")
    score = F.col("value") / (F.col("value") + d(100))
    return events.select(
        "event_id",
        ts.alias("ts"),
        F.when(ts < F.lit("2024-01-11").cast("timestamp"), F.lit("Baseline"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
        .alias("scenario"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        (F.col("event_type") == "error").cast("int").alias("Class"),
        score.alias("Probability"),
        (score > d(0.5)).cast("int").alias("Prediction"),
    )


def event_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_columns(spark.read.parquet(f"{sf_dir}/events.parquet"))


# As many features as the card-transaction schema has.
WIDE_FEATURES = tuple(f"e{i}" for i in range(30))
WIDE_SPEC = ObsSpec(features=WIDE_FEATURES)
# How many of the features are shifted in each batch.
WIDE_SHIFTED = {"Drift 1": 0, "Drift 2": 6, "Drift 3": 20}


def wide_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty vector components as features: a baseline and batches in which none, some and most of them are shifted."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    part = F.col("vec_id") % 5
    name = F.when(part < 2, F.lit("Baseline"))
    for i, batch in enumerate(WIDE_SHIFTED):
        name = name.when(part == i + 2, F.lit(batch))
    shifted = F.lit(0)
    for batch, n in WIDE_SHIFTED.items():
        shifted = F.when(F.col("scenario") == batch, F.lit(n)).otherwise(shifted)
    e = lambda i: F.col("embedding")[i].cast("double")
    features = [F.when(F.lit(i) < shifted, e(i) + d(0.25)).otherwise(e(i)).alias(f"e{i}") for i in range(len(WIDE_FEATURES))]
    y = (F.col("label") % 2).cast("int")
    score = y * d(0.5) + (e(30) + d(1)) / d(4)
    table = rows.withColumn("scenario", name).select("scenario", "vec_id", *features, y.alias("Class"), score.alias("Probability"))
    return table.withColumn("Prediction", (F.col("Probability") > d(0.5)).cast("int"))


def _wide_case() -> str:
    cases = " ".join(f"WHEN vec_id % 5 = {i + 2} THEN '{b}'" for i, b in enumerate(WIDE_SHIFTED))
    return f"CASE WHEN vec_id % 5 < 2 THEN 'Baseline' {cases} END"


_WIDE_SHIFT = "CASE scenario " + " ".join(f"WHEN '{b}' THEN {n}" for b, n in WIDE_SHIFTED.items()) + " ELSE 0 END"
WIDE_SQL = f"""
obs AS (
  SELECT *, CASE WHEN Probability > 5e-1 THEN 1 ELSE 0 END AS Prediction FROM (
    SELECT scenario, vec_id, embedding, label % 2 AS Class, (label % 2) * 5e-1 + (CAST(embedding[31] AS DOUBLE) + 1e0) / 4e0 AS Probability
    FROM (SELECT *, {_wide_case()} AS scenario FROM embeddings))),
long AS (
  SELECT scenario, 'e' || (i - 1) AS feature,
    CAST(embedding[i] AS DOUBLE) + CASE WHEN i - 1 < {_WIDE_SHIFT} THEN 2.5e-1 ELSE 0e0 END AS value
  FROM obs, range(1, {len(WIDE_FEATURES) + 1}) g(i) WHERE embedding[i] IS NOT NULL)
"""

ACCOUNT_SPEC = ObsSpec(features=("balance", "digits"), baseline="BUILDING")


def account_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by market segment: samples small enough for exact tests."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_mktsegment").alias("scenario"),
        F.col("c_acctbal").cast("double").alias("balance"),
        (F.col("c_custkey") % 7 + F.col("c_nationkey") % 5).cast("double").alias("digits"),
    )


ACCOUNT_SQL = """
obs AS (SELECT c_mktsegment AS scenario, CAST(c_acctbal AS DOUBLE) AS balance,
  CAST(c_custkey % 7 + c_nationkey % 5 AS DOUBLE) AS digits FROM customer),
long AS (
  SELECT scenario, 'balance' AS feature, balance AS value FROM obs WHERE balance IS NOT NULL
  UNION ALL SELECT scenario, 'digits', digits FROM obs WHERE digits IS NOT NULL)
"""

OBS_SQL = """
obs AS (
  SELECT *, CASE WHEN Probability > 5e-1 THEN 1 ELSE 0 END AS Prediction FROM (
    SELECT *, (qty + 3e0 * l_linenumber + 2e2 * discount) / 1.2e2 AS Probability FROM (
      SELECT scenario, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
        CASE WHEN scenario = 'Drift 2' THEN l_quantity * 1.3e0 ELSE l_quantity END AS qty,
        l_extendedprice AS price,
        CASE WHEN scenario = 'Drift 4' THEN 5e-2 ELSE l_discount END AS discount,
        CASE WHEN scenario = 'Drift 5' OR (scenario = 'Drift 4' AND l_linenumber = 7) THEN NULL
             ELSE l_tax END AS tax,
        CASE WHEN scenario = 'Drift 5' THEN 0
             WHEN l_quantity + 5e0 * l_linenumber > 6e1 THEN 1 ELSE 0 END AS Class
      FROM (
        SELECT l.*, CASE WHEN year(l_shipdate) <= 1997 THEN 'Baseline'
                         WHEN year(l_shipdate) = 1998 THEN 'Drift 1'
                         WHEN year(l_shipdate) = 1999 THEN 'Drift 2'
                         WHEN year(l_shipdate) = 2000 THEN 'Drift 3'
                         WHEN year(l_shipdate) = 2001 THEN 'Drift 4' END AS scenario
        FROM lineitem l
        UNION ALL
        SELECT l.*, 'Drift 5' AS scenario FROM lineitem l WHERE year(l_shipdate) = 2001)
      WHERE scenario IS NOT NULL AND (scenario <> 'Drift 3' OR l_extendedprice > 2e4))))
"""

# The long form: one row per scenario, feature and known value.
LONG_SQL = """
long AS (
  SELECT scenario, 'qty' AS feature, qty AS value FROM obs WHERE qty IS NOT NULL
  UNION ALL SELECT scenario, 'price', price FROM obs WHERE price IS NOT NULL
  UNION ALL SELECT scenario, 'discount', discount FROM obs WHERE discount IS NOT NULL
  UNION ALL SELECT scenario, 'tax', tax FROM obs WHERE tax IS NOT NULL)
"""

EVENT_SQL = """
obs AS (
  SELECT event_id, ts,
    CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'Baseline' ELSE strftime(ts, '%Y-%m-%d') END AS scenario,
    value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS Class,
    value / (value + 1e2) AS Probability,
    CASE WHEN value / (value + 1e2) > 5e-1 THEN 1 ELSE 0 END AS Prediction
  FROM events)
"""

EVENT_LONG_SQL = """
long AS (
  SELECT scenario, 'value' AS feature, value FROM obs WHERE value IS NOT NULL
  UNION ALL SELECT scenario, 'k', k FROM obs WHERE k IS NOT NULL)
"""
