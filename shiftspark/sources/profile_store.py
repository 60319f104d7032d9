"""The baseline profile: written once, grown by new baseline rows, reused for every later batch.

It holds everything the checks need of the baseline, so that a batch is
compared without reading the baseline again. All of it is mergeable: value
counts and outcome counts add up, moments merge pairwise, histogram counts add
up on the edges that the first baseline fixed. New baseline rows therefore
become a *segment* beside the old ones and no old row is read.

Value counts are laid out by slot, one slot for each feature and bucket, so
that a batch reads only the slots its values fall into; of the others the
totals are enough (``Profile.around``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark.functions.stats import d, known
from shiftspark.operators.evaluate import METRICS, metric_records, outcome_columns
from shiftspark.operators.prefix import SAMPLED_PER_BUCKET, Layout, find_cuts, with_bucket
from shiftspark.operators.psi import PSI_BINS, Edges, edges_of_ranges, fold_bins, psi_bin
from shiftspark.operators.select import common_features
from shiftspark.sources.writers import stored
from shiftspark.spec import ObsSpec

# Distinct values aimed at in a slot.
ROWS_PER_SLOT = 1 << 20
# Stands for score, label and prediction among the features.
OUTCOMES = "#outcomes"


@dataclass(frozen=True)
class Profile:
    """An opened profile; ``slots`` tells each feature's first slot."""

    counts: DataFrame
    totals: DataFrame
    moments: DataFrame
    bins: DataFrame
    layout: Layout
    edges: Edges
    metrics: dict[str, float | None]
    slots: dict[str, int]

    def around(self, counts: DataFrame) -> DataFrame:
        """What running sums at the values of ``counts`` need of the baseline: (scenario, feature, value, n).

        Slots that hold one of the values come with their value counts; only
        they are read. Any other slot is one row, at its largest value, with
        its total: no value lies inside it, so sums before and after it are
        right. The numbers of the slots met reach the driver: at most features x
        buckets, whose cuts it holds anyway."""
        met = [r["slot"] for r in with_slot(counts, self.layout.cuts, self.slots).select("slot").distinct().collect()]
        read = self.counts.filter(F.col("slot").isin(met)).groupBy("scenario", "feature", "value")
        rest = self.totals.filter(~F.col("slot").isin(met)).groupBy("scenario", "feature", "slot")
        rest = rest.agg(F.max("hi").alias("value"), F.sum("n").alias("n")).drop("slot")
        return read.agg(F.sum("n").alias("n")).unionByName(rest)


def with_slot(counts: DataFrame, cuts: dict[str, list[float]], slots: dict[str, int]) -> DataFrame:
    """Adds the slot of each (feature, value); features without slots are left out."""
    first = F.lit(None).cast("long")
    for name, at in slots.items():
        first = F.when(F.col("feature") == name, F.lit(at).cast("long")).otherwise(first)
    placed = with_bucket(counts, "value", cuts, by="feature").withColumn("slot", first + F.col("_bucket"))
    return placed.filter(F.col("slot").isNotNull()).drop("_bucket")


def write_profile(obs: DataFrame, spec: ObsSpec, path: str, rows_per_slot: int = ROWS_PER_SLOT) -> None:
    """Profiles the baseline rows of ``obs`` into tables below ``path``, in one scan of them."""
    spark = obs.sparkSession
    have = common_features(spec, obs)
    raw = _collapsed(obs, spec, path)
    values = raw.filter(F.col("feature") != OUTCOMES)
    found = values.groupBy("feature").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    found = {r["feature"]: r for r in found.collect()}
    scores = raw.filter(F.col("feature") == OUTCOMES).filter("value IS NOT NULL").select("feature", "value").distinct()
    wanted = {f: -(-r["n"] // rows_per_slot) for f, r in found.items()} | {OUTCOMES: -(-scores.count() // rows_per_slot)}
    distinct = values.select("feature", "value").unionByName(scores)
    cuts = find_cuts(distinct, wanted, min(1.0, SAMPLED_PER_BUCKET / rows_per_slot))
    edges = edges_of_ranges({f: (r["lo"], r["hi"]) for f, r in found.items()})
    limits, slot = [], 0
    for f in [*have, OUTCOMES]:
        limits.append((f, cuts.get(f, []), edges.get(f), slot))
        slot += len(cuts.get(f, [])) + 1
    schema = "feature string, cuts array<double>, edges array<double>, slot long"
    spark.createDataFrame(limits, schema).write.mode("overwrite").parquet(f"{path}/limits")
    _add_segment(raw, spec, path, 0)


def grow_profile(obs: DataFrame, spec: ObsSpec, path: str) -> None:
    """Adds the baseline rows of ``obs`` to a stored profile; cuts and edges stay.

    The new segment counts only once the version that names it is written."""
    spark = obs.sparkSession
    versions = spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()[0]
    _add_segment(_collapsed(obs, spec, path), spec, path, versions + 1)


def _collapsed(obs: DataFrame, spec: ObsSpec, path: str) -> DataFrame:
    """(feature, value, y, p, n): all distinct values and outcomes of the baseline, from one scan and one shuffle."""
    base = obs.filter(F.col(spec.scenario) == spec.baseline)
    have = common_features(spec, base)
    none = F.lit(None).cast("int")
    out = outcome_columns(base, spec)
    cells = [F.struct(F.lit(f).alias("feature"), known(f).alias("value"), none.alias("y"), none.alias("p")) for f in have]
    cells.append(F.struct(F.lit(OUTCOMES).alias("feature"), out["score"].alias("value"), out["y"], out["p"]))
    rows = base.select(F.inline(F.array(*cells))).filter((F.col("feature") == OUTCOMES) | F.col("value").isNotNull())
    return stored(rows.groupBy("feature", "value", "y", "p").agg(F.count("*").alias("n")), f"{path}/staged")


def _limits(spark: SparkSession, path: str) -> tuple[dict[str, list[float]], Edges, dict[str, int]]:
    rows = {r["feature"]: r for r in spark.read.parquet(f"{path}/limits").collect()}
    cuts = {f: list(r["cuts"]) for f, r in rows.items()}
    slots = {f: r["slot"] for f, r in rows.items() if f != OUTCOMES}
    return cuts, {f: list(r["edges"]) for f, r in rows.items() if r["edges"] is not None}, slots


def _add_segment(raw: DataFrame, spec: ObsSpec, path: str, segment: int) -> None:
    """Writes one segment's tables from its collapsed rows, then the version that names it."""
    spark = raw.sparkSession
    cuts, edges, slots = _limits(spark, path)
    values = raw.filter(F.col("feature") != OUTCOMES).select("feature", "value", "n")
    placed = with_slot(values, cuts, slots)
    # One file for each slot, ordered by value.
    placed.repartition("slot").sortWithinPartitions("slot", "value").write.mode("overwrite").partitionBy("slot").parquet(
        f"{path}/counts/segment={segment}"
    )
    counts = spark.read.schema("feature string, value double, n long, slot long").parquet(f"{path}/counts/segment={segment}")
    counts.groupBy("feature", "slot").agg(F.max("value").alias("hi"), F.sum("n").alias("n")).write.mode("overwrite").parquet(
        f"{path}/totals/segment={segment}"
    )
    _moments(counts).write.mode("overwrite").parquet(f"{path}/moments/segment={segment}")
    bin_ = F.lit(None).cast("int")
    for f, e in edges.items():
        bin_ = F.when(F.col("feature") == f, psi_bin(F.col("value"), e)).otherwise(bin_)
    binned = counts.withColumn("bin", bin_).groupBy("feature", "bin").agg(F.sum("n").alias("c")).filter("bin IS NOT NULL")
    fold_bins(binned, ["feature"]).write.mode("overwrite").parquet(f"{path}/bins/segment={segment}")
    outcomes = raw.filter(F.col("feature") == OUTCOMES).select(F.col("value").alias("score"), "y", "p", "n")
    outcomes.write.mode("overwrite").parquet(f"{path}/outcomes/segment={segment}")
    merged = spark.read.schema("score double, y int, p int, n long, segment int").parquet(f"{path}/outcomes")
    merged = merged.filter(F.col("segment") <= segment).groupBy("score", "y", "p").agg(F.sum("n").alias("n"))
    records = metric_records(merged.withColumn("scenario", F.lit(spec.baseline)), {"score": cuts.get(OUTCOMES, [])})
    version = records.withColumn("version", F.lit(segment)).coalesce(1)
    if records.isEmpty():
        version = spark.createDataFrame([(segment,)], "version int")
    version.write.mode("overwrite").parquet(f"{path}/versions/v={segment}")


def _moments(counts: DataFrame) -> DataFrame:
    """(feature, n, mean, m2, min, max); the means are one number for each feature."""
    sums = counts.groupBy("feature").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    near = F.lit(None).cast("double")
    for r in sums.select("feature", "mean").collect():
        near = F.when(F.col("feature") == r["feature"], d(r["mean"])).otherwise(near)
    off = F.col("value") - near
    return sums.join(counts.groupBy("feature").agg(F.sum(F.col("n") * off * off).alias("m2")), "feature")


def merged_moments(parts: DataFrame) -> DataFrame:
    """(feature, n, mean, std, min, max) of all segments together, merged pair by pair."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), d(0).alias("mean"), d(0).alias("m2"))

    def pair(a, b):
        n = a["n"] + b["n"]
        step = b["mean"] - a["mean"]
        share = b["n"] / n
        return F.struct(
            n.alias("n"),
            (a["mean"] + step * share).alias("mean"),
            (a["m2"] + b["m2"] + step * step * share * a["n"].cast("double")).alias("m2"),
        )

    own = F.struct("n", "mean", "m2")
    rows = parts.groupBy("feature").agg(
        F.aggregate(F.sort_array(F.collect_list(own)), zero, pair).alias("m"), F.min("min").alias("min"), F.max("max").alias("max")
    )
    std = F.when(F.col("m.n") > 1, F.sqrt(F.col("m.m2") / (F.col("m.n") - 1)))
    return rows.select("feature", F.col("m.n").alias("n"), F.col("m.mean").alias("mean"), std.alias("std"), "min", "max")


def read_profile(spark: SparkSession, spec: ObsSpec, path: str) -> Profile:
    """Opens the latest version; a row per feature and one of metrics reach the driver."""
    cuts, edges, slots = _limits(spark, path)
    record = spark.read.option("mergeSchema", True).parquet(f"{path}/versions").orderBy(F.desc("version")).first().asDict()
    table = lambda name, schema: (
        spark.read.schema(f"{schema}, segment int")
        .parquet(f"{path}/{name}")
        .filter(F.col("segment") <= record["version"])
        .withColumn("scenario", F.lit(spec.baseline))
    )
    bins = table("bins", "feature string, bins array<long>, n long").groupBy("scenario", "feature")
    summed = [F.sum(F.col("bins")[i]) for i in range(PSI_BINS)]
    moments = merged_moments(table("moments", "feature string, n long, mean double, m2 double, min double, max double"))
    return Profile(
        counts=table("counts", "feature string, value double, n long, slot long"),
        totals=table("totals", "feature string, slot long, hi double, n long"),
        moments=moments.withColumn("scenario", F.lit(spec.baseline)).select("scenario", *moments.columns),
        bins=bins.agg(F.array(*summed).alias("bins"), F.sum("n").alias("n")),
        layout=Layout(record.get("n_rows") or 0, {f: c for f, c in cuts.items() if f != OUTCOMES} | {spec.score: cuts.get(OUTCOMES, [])}),
        edges=edges,
        metrics={m: record.get(m) for m in METRICS},
        slots=slots,
    )
