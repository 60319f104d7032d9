"""Dataset and feature profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftspark.functions.bins import bin_edge, bin_of
from shiftspark.functions.stats import count_where, d, known
from shiftspark.operators.prefix import Layout, Running, picked_by_rank, running_sums, size_up, with_bucket
from shiftspark.operators.select import common_features, features_long
from shiftspark.operators.small import attach
from shiftspark.spec import ObsSpec


def overview(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: rows, columns, missing cells, column list and set of types.

    NULL and NaN both count as missing. One aggregation, no shuffle of rows."""
    cols = columns or df.columns
    kinds = dict(df.select(*cols).dtypes)
    missing = F.lit(0).cast("long")
    for c in cols:
        gone = F.col(c).isNull()
        if kinds[c] in ("double", "float"):
            gone = gone | F.isnan(c)
        missing = missing + count_where(gone)
    return df.agg(F.count("*").alias("n_rows"), missing.alias("n_missing")).select(
        "n_rows",
        F.lit(len(cols)).alias("n_columns"),
        "n_missing",
        F.lit(", ".join(cols)).alias("columns"),
        F.lit(", ".join(sorted(set(kinds.values())))).alias("types"),
    )


def class_balance(obs: DataFrame, spec: ObsSpec) -> DataFrame:
    """Per scenario: rows, positives, negatives and the positive rate."""
    y = F.col(spec.label)
    return obs.groupBy(spec.scenario_column()).agg(
        F.count("*").alias("n_rows"),
        count_where(y == 1).alias("n_positive"),
        count_where(y == 0).alias("n_negative"),
        F.avg(y.cast("double")).alias("positive_rate"),
    )


def feature_moments(obs: DataFrame, spec: ObsSpec, population: bool = False) -> DataFrame:
    """(scenario, feature, n, mean, std, min, max), missing values left out; a
    feature without any value in a scenario has no row.

    All features are aggregated side by side in one pass; only the one row
    per scenario is turned into rows per feature."""
    have = common_features(spec, obs)
    spread = F.stddev_pop if population else F.stddev_samp
    wide = obs.select(spec.scenario_column(), *[known(f).alias(f) for f in have])
    aggs = [
        F.struct(
            F.lit(f).alias("feature"),
            F.count(f).alias("n"),
            F.avg(f).alias("mean"),
            spread(f).alias("std"),
            F.min(f).alias("min"),
            F.max(f).alias("max"),
        ).alias(f"s_{i}")
        for i, f in enumerate(have)
    ]
    if not have:
        none = [F.lit(None).cast("double").alias(c) for c in ("mean", "std", "min", "max")]
        return wide.limit(0).select("scenario", F.lit("").alias("feature"), F.lit(0).cast("long").alias("n"), *none)
    per_scenario = wide.groupBy("scenario").agg(*aggs)
    tall = per_scenario.select("scenario", F.inline(F.array(*[f"s_{i}" for i in range(len(have))])))
    return tall.filter(F.col("n") > 0)


def exact_quantiles(
    obs: DataFrame, spec: ObsSpec, probs: dict[str, float], layout: Layout | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles per (scenario, feature), one column per entry.

    Ranks are located in running counts of the distinct values, so no task
    has to hold a whole feature, however many distinct values it has."""
    layout = layout or size_up(obs, spec.scenario, common_features(spec, obs))
    counts = features_long(obs, spec).groupBy("scenario", "feature", "value").agg(F.count("*").alias("n"))
    rows = running_sums(
        with_bucket(counts, "value", layout.cuts, by="feature"),
        "value",
        [Running("cum", "n", ("scenario", "feature"), total=True)],
    )
    total = F.col("cum_total")
    picks = []
    for name, q in probs.items():
        at = (total - 1) * d(q)
        picks += [
            picked_by_rank(F.floor(at), "cum", "n", "value").alias(f"{name}_lo"),
            picked_by_rank(F.ceil(at), "cum", "n", "value").alias(f"{name}_hi"),
        ]
    found = rows.groupBy("scenario", "feature").agg(F.max("cum_total").alias("n"), *picks)
    cols = []
    for name, q in probs.items():
        at = (F.col("n") - 1) * d(q)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return found.select("scenario", "feature", *cols)


def feature_stats(obs: DataFrame, spec: ObsSpec, layout: Layout | None = None) -> DataFrame:
    """Moments and the exact median per (scenario, feature)."""
    median = exact_quantiles(obs, spec, {"median": 0.5}, layout)
    return feature_moments(obs, spec).join(median, ["scenario", "feature"], "left")


def clip_bounds(
    obs: DataFrame, spec: ObsSpec, low: float = 0.01, high: float = 0.99, layout: Layout | None = None
) -> DataFrame:
    """(feature, lo, hi): outer quantiles of the baseline."""
    base = obs.filter(F.col(spec.scenario) == spec.baseline)
    return exact_quantiles(base, spec, {"lo": low, "hi": high}, layout).drop("scenario")


def density_histogram(
    obs: DataFrame, spec: ObsSpec, bins: int = 60, shared: bool = False, layout: Layout | None = None
) -> DataFrame:
    """Density histogram per (scenario, feature) of values clipped to the
    baseline's 1% and 99% quantiles; all bins are present.

    By default each side spans its own clipped range, so the edges of two
    scenarios may differ; ``shared`` uses the baseline's clip bounds for all.
    Distinct values with their counts are binned, not rows.
    """
    layout = layout or size_up(obs, spec.scenario, common_features(spec, obs))
    bounds = clip_bounds(obs, spec, layout=layout)
    ends = feature_moments(obs, spec).join(bounds, "feature")
    clip = lambda c: F.greatest(F.col("lo"), F.least(F.col("hi"), F.col(c)))
    lo, hi = (F.col("lo"), F.col("hi")) if shared else (clip("min"), clip("max"))
    # A single value gets a unit range around it.
    ranges = ends.select(
        "scenario",
        "feature",
        "lo",
        "hi",
        F.when(lo == hi, lo - d(0.5)).otherwise(lo).alias("start"),
        F.when(lo == hi, hi + d(0.5)).otherwise(hi).alias("stop"),
        "n",
    )
    counts = features_long(obs, spec).groupBy("scenario", "feature", "value").agg(F.count("*").alias("c"))
    rows = attach(counts, ranges, ["scenario", "feature"], layout.parts)
    v = F.greatest(F.col("lo"), F.least(F.col("hi"), F.col("value")))
    filled = _bin_counts(rows, v, ["scenario", "feature"], bins, ["n"])
    width = (F.col("stop") - F.col("start")) / d(bins)
    return filled.select(
        "scenario",
        "feature",
        "bin",
        bin_edge(F.col("start"), F.col("stop"), bins, F.col("bin")).alias("left_edge"),
        "count",
        (F.col("count") / (F.col("n") * width)).alias("density"),
    )


def _bin_counts(rows: DataFrame, v: Column, keys: list[str], bins: int, carry: list[str]) -> DataFrame:
    """Sums of c per (keys, bin) with all bins present; rows carry start and stop."""
    kept = ["start", "stop", *carry]
    counts = (
        rows.withColumn("bin", bin_of(v, F.col("start"), F.col("stop"), bins))
        .groupBy(*keys, "bin")
        .agg(F.sum("c").alias("c"), *[F.first(x).alias(x) for x in kept])
    )
    per_key = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("by_bin"),
        *[F.first(x).alias(x) for x in kept],
    )
    return (
        per_key.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .withColumn("count", F.coalesce(F.col("by_bin")[F.col("bin")], F.lit(0).cast("long")))
        .drop("by_bin")
    )


def score_histogram(obs: DataFrame, spec: ObsSpec, bins: int = 50) -> DataFrame:
    """Counts of the score per class and bin; each class spans its own range.

    Taken over the whole table; restrict it first for one scenario. Distinct
    scores with their counts are binned, not rows."""
    rows = obs.select(F.col(spec.label).alias("Class"), known(spec.score).alias("s")).filter(
        F.col("s").isNotNull() & F.col("Class").isNotNull()
    )
    counts = rows.groupBy("Class", "s").agg(F.count("*").alias("c"))
    ends = rows.groupBy("Class").agg(F.min("s").alias("start"), F.max("s").alias("stop"))
    parts = size_up(obs, spec.scenario, [spec.score]).parts
    filled = _bin_counts(attach(counts, ends, ["Class"], parts), F.col("s"), ["Class"], bins, [])
    return filled.select(
        "Class",
        "bin",
        bin_edge(F.col("start"), F.col("stop"), bins, F.col("bin")).alias("left_edge"),
        "count",
    )


# Cells of the kernel density in a bandwidth, and bandwidths from which the kernel is left out (less than 1e-13 of its peak).
KDE_CELLS = 64
KDE_REACH = 8


def kde_curve(obs: DataFrame, spec: ObsSpec, grid: int = 1000) -> DataFrame:
    """Gaussian kernel density per (scenario, feature), Scott bandwidth, on
    ``grid`` points that span the data range widened by half of it on each side.

    Value counts fall into cells of 1 / KDE_CELLS of the bandwidth, whatever
    the range of the data; a cell keeps its weight, mean and variance, which
    gives the kernel sum up to third order in the cell width, and exactly where
    a cell holds one value. Cells lie in regions of KDE_REACH bandwidths, and a
    grid point sums the cells of its own region and the two beside it: at most
    3 * KDE_REACH * KDE_CELLS, however many rows or cells there are.
    """
    keys = ["scenario", "feature"]
    ends = (
        feature_moments(obs, spec)
        .filter((F.col("n") > 1) & (F.col("std") > 0))
        .select(
            *keys,
            F.col("n").alias("rows"),
            F.col("min").alias("start"),
            F.col("max").alias("stop"),
            (F.col("std") * F.pow(F.col("n").cast("double"), d(-0.2))).alias("h"),
        )
    )
    width = F.col("h") / d(KDE_CELLS)
    counts = features_long(obs, spec).groupBy(*keys, "value").agg(F.count("*").alias("w"))
    cell = F.floor((F.col("value") - F.col("start")) / width)
    off = F.col("value") - F.col("start") - (F.col("cell") + d(0.5)) * width
    cells = (
        counts.join(ends, keys)
        .withColumn("cell", cell)
        .groupBy(*keys, "cell", "start", "h")
        .agg(F.sum("w").alias("w"), F.sum(F.col("w") * off).alias("s1"), F.sum(F.col("w") * off * off).alias("s2"))
    )
    mean = F.col("s1") / F.col("w")
    regions = (
        cells.select(
            *keys,
            F.floor(F.col("cell") / (KDE_CELLS * KDE_REACH)).alias("region"),
            F.struct(
                "w",
                (F.col("start") + (F.col("cell") + d(0.5)) * width + mean).alias("at"),
                ((F.col("s2") / F.col("w") - mean * mean) / F.pow(F.col("h"), d(2)) / d(2)).alias("bend"),
            ).alias("cell"),
        )
        .groupBy(*keys, "region")
        .agg(F.collect_list("cell").alias("cells"))
    )
    span = F.col("stop") - F.col("start")
    points = ends.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn(
        "x", F.col("start") - span * d(0.5) + F.col("point").cast("double") * (span * d(2) / d(grid - 1))
    )
    own = F.floor((F.col("x") - F.col("start")) / (F.col("h") * d(KDE_REACH)))
    around = points.select(*keys, "point", "x", "rows", "h", F.explode(F.sequence(own - 1, own + 1)).alias("region"))

    def term(total, c):
        u2 = F.pow((F.col("x") - c["at"]) / F.col("h"), d(2))
        return total + c["w"] * F.exp(d(-0.5) * u2) * (d(1) + (u2 - d(1)) * c["bend"])

    part = F.coalesce(F.aggregate("cells", d(0), term), d(0))
    norm = F.col("rows") * F.col("h") * F.sqrt(d(2) * F.pi())
    sums = around.join(regions, [*keys, "region"], "left").withColumn("part", part / norm)
    return sums.groupBy(*keys, "point", "x").agg(F.sum("part").alias("density"))
