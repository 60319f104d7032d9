"""Population stability index on equal-width bins of the baseline range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shiftspark.functions.stats import count_where, d, known, psi_term
from shiftspark.operators.select import common_features, melt
from shiftspark.spec import PSI_HIGH, PSI_MODERATE, ObsSpec

# Number of bins and how far the outer edges are pushed out.
PSI_BINS = 10
EDGE_MARGIN = 1e-6

OUTSIDE = -1


Edges = dict[str, list[float]]


def psi_edges(baseline: DataFrame, features: list[str]) -> Edges:
    """The 11 edges per feature, from one aggregation of the baseline.

    Only the two range ends per feature come to the driver, so the binning of
    the big tables compares with constants. A constant feature has no edges
    (empty list); one without values is left out."""
    if not features:
        return {}
    aggs = [g(known(f)).alias(f"{n}_{f}") for f in features for n, g in (("lo", F.min), ("hi", F.max))]
    row = baseline.agg(*aggs).first().asDict()
    return edges_of_ranges({f: (row[f"lo_{f}"], row[f"hi_{f}"]) for f in features if row[f"lo_{f}"] is not None})


def edges_of_ranges(ranges: dict[str, tuple[float, float]]) -> Edges:
    return {f: edges_of_range(lo, hi) for f, (lo, hi) in ranges.items()}


def edges_of_range(lo: float, hi: float) -> list[float]:
    if lo == hi:
        return []
    inner = [lo + i * ((hi - lo) / PSI_BINS) for i in range(1, PSI_BINS)]
    return [lo - EDGE_MARGIN, *inner, hi + EDGE_MARGIN]


def psi_bin(value: Column, edges: list[float], open_ends: bool = False) -> Column:
    """Bin 0..9 of a value, OUTSIDE beyond the outer edges, NULL when missing.

    The value is compared with the edges themselves: values that lie exactly
    on an edge must fall into the bin above it."""
    if not edges:
        return F.when(value.isNotNull(), F.lit(0))
    first = F.when(value < d(edges[1]), F.lit(0))
    if not open_ends:
        first = F.when((value < d(edges[0])) | (value > d(edges[PSI_BINS])), F.lit(OUTSIDE)).when(
            value < d(edges[1]), F.lit(0)
        )
    for i in range(1, PSI_BINS - 1):
        first = first.when(value < d(edges[i + 1]), F.lit(i))
    return first.when(value.isNotNull(), F.lit(PSI_BINS - 1))


def bin_rows(obs: DataFrame, edges: Edges, keys: dict[str, Column], open_ends: bool = False) -> DataFrame:
    """(keys.., feature, bin) for every known value; ``keys`` maps the name of
    each key column to its expression, which carries that name.

    Values become bin numbers while the table is still wide; only the small
    integers are turned long."""
    have = [f for f in edges if f in obs.columns]
    wide = obs.select(
        *keys.values(),
        *[known(f).alias(f) for f in have],
    ).select(*keys, *[psi_bin(F.col(f), edges[f], open_ends).alias(f) for f in have])
    return melt(wide, list(keys), have, "bin").filter(F.col("bin").isNotNull())


def bin_counts(obs: DataFrame, spec: ObsSpec, edges: Edges, open_ends: bool = False) -> DataFrame:
    """(scenario, feature, bins, n): ten counts and the number of values.

    At most eleven groups per (scenario, feature) leave a map task."""
    rows = bin_rows(obs, edges, {"scenario": spec.scenario_column()}, open_ends)
    counts = rows.groupBy("scenario", "feature", "bin").agg(F.count("*").alias("c"))
    return fold_bins(counts, ["scenario", "feature"])


def fold_bins(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Ten counts in one array, absent bins as 0; ``n`` includes what fell outside."""
    per_bin = [F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("c"))), F.lit(0)) for i in range(PSI_BINS)]
    return counts.groupBy(*keys).agg(F.array(*per_bin).alias("bins"), F.sum("c").alias("n"))


def psi_value(ref_bins: Column, ref_n: Column, bins: Column, n: Column) -> Column:
    """Sum over the ten bins; the shares are taken of *all* values, so mass
    outside the baseline range makes them add up to less than 1."""
    total = None
    for i in range(PSI_BINS):
        term = psi_term(ref_bins[i] / ref_n, bins[i] / n)
        total = term if total is None else total + term
    return total


def psi_table(
    obs: DataFrame, spec: ObsSpec, open_ends: bool = False, edges: Edges | None = None
) -> DataFrame:
    """(scenario, feature, psi) for the batches.

    A feature with one baseline value has index 0; a feature that the
    baseline or the batch lacks gives no row. ``open_ends`` counts values
    beyond the baseline range in the outer bins instead of nowhere. ``edges``
    from an earlier pass save the pass over the baseline."""
    if edges is None:
        base = obs.filter(F.col(spec.scenario) == spec.baseline)
        edges = psi_edges(base, common_features(spec, obs))
    return psi_against_baseline(bin_counts(obs, spec, edges, open_ends), spec)


def psi_against_baseline(counts: DataFrame, spec: ObsSpec) -> DataFrame:
    """(scenario, feature, psi) from bin counts of baseline and batches."""
    per_feature = W.partitionBy("feature")
    is_base = F.col("scenario") == spec.baseline
    paired = counts.select(
        "*",
        F.max(F.when(is_base, F.col("bins"))).over(per_feature).alias("ref_bins"),
        F.max(F.when(is_base, F.col("n"))).over(per_feature).alias("ref_n"),
    )
    return paired.filter(~is_base & F.col("ref_n").isNotNull()).select(
        "scenario",
        "feature",
        psi_value(F.col("ref_bins"), F.col("ref_n"), F.col("bins"), F.col("n")).alias("psi"),
    )


def psi_average(table: DataFrame) -> DataFrame:
    return table.groupBy("scenario").agg(F.avg("psi").alias("avg_psi"))


def psi_severity(psi: Column, moderate: float = PSI_MODERATE, high: float = PSI_HIGH) -> Column:
    return F.when(psi > d(high), "red").when(psi > d(moderate), "amber").otherwise("green")


def psi_rank(table: DataFrame) -> DataFrame:
    """Features by their mean index over the batches, largest first."""
    per_feature = table.groupBy("feature").agg(F.avg("psi").alias("mean_psi"))
    order = W.orderBy(F.desc("mean_psi"), F.asc("feature"))
    return per_feature.withColumn("rank", F.row_number().over(order))


def full_retrain_trigger(table: DataFrame, limit: float, share: float = 0.5) -> DataFrame:
    """Per scenario: share of features above the limit, and whether it is most of them."""
    over = F.avg((F.col("psi") > d(limit)).cast("double"))
    return (
        table.groupBy("scenario")
        .agg(over.alias("share_over"))
        .withColumn("full_retrain", F.col("share_over") > d(share))
    )


def psi_triggered(table: DataFrame, limit: float = PSI_HIGH) -> DataFrame:
    """Per scenario: number of features above the limit and whether there is any."""
    return (
        table.groupBy("scenario")
        .agg(count_where(F.col("psi") > d(limit)).alias("n_over"), F.max("psi").alias("max_psi"))
        .withColumn("triggered", F.col("n_over") > 0)
    )
