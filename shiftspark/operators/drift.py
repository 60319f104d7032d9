"""Two-sample drift statistics for all features and all batches at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shiftspark.functions.stats import cohens_d, count_where, d, ks_pvalue, ks_pvalue_exact
from shiftspark.operators.prefix import Layout, Running, running_sums, size_up, with_bucket
from shiftspark.operators.profile import feature_moments
from shiftspark.operators.select import common_features, features_long
from shiftspark.spec import KS_ALPHA, ObsSpec


def value_counts(obs: DataFrame, spec: ObsSpec) -> DataFrame:
    """(scenario, feature, value, n): the distinct values with their counts.

    Everything that depends on the order of the values is built on this
    table; repeated values collapse before the shuffle."""
    return features_long(obs, spec).groupBy("scenario", "feature", "value").agg(F.count("*").alias("n"))


def ks_from_counts(counts: DataFrame, spec: ObsSpec, layout: Layout) -> DataFrame:
    """KS distance and p-value per (scenario, feature) from value counts, for
    any number of batches.

    Between two values of a batch its distribution function is flat, so the
    largest gap is found at the batch's own values: just below one, where the
    baseline may lie above, or at one, where it may lie below. The baseline
    is therefore accumulated once per feature, whatever the number of batches.
    """
    marked = counts.withColumn(
        "base_n", F.when(F.col("scenario") == spec.baseline, F.col("n")).otherwise(F.lit(0).cast("long"))
    )
    rows = running_sums(
        with_bucket(marked, "value", layout.cuts, by="feature"),
        "value",
        [
            Running("base_cum", "base_n", ("feature",), total=True, peers=True),
            Running("own_cum", "n", ("scenario", "feature"), total=True),
        ],
    )
    base_total, own_total = F.col("base_cum_total").cast("double"), F.col("own_cum_total").cast("double")
    base_share = lambda c: F.try_divide(c, base_total)
    at = F.col("own_cum") / own_total - base_share(F.col("base_cum"))
    below = base_share(F.col("base_cum") - F.col("base_cum_here")) - (F.col("own_cum") - F.col("n")) / own_total
    gaps = (
        rows.filter((F.col("scenario") != spec.baseline) & (F.col("base_cum_total") > 0))
        .groupBy("scenario", "feature")
        .agg(
            F.max(F.greatest(at, below)).alias("ks_statistic"),
            F.max("base_cum_total").alias("n_baseline"),
            F.max("own_cum_total").alias("n_prod"),
        )
    )
    return _with_pvalue(gaps)


def _with_pvalue(gaps: DataFrame) -> DataFrame:
    p = ks_pvalue(F.col("ks_statistic"), F.col("n_baseline"), F.col("n_prod"))
    return gaps.withColumn("p_value", p)


def ks_test(
    obs: DataFrame, spec: ObsSpec, alpha: float = KS_ALPHA, layout: Layout | None = None, exact_rows: int = 0
) -> DataFrame:
    """(scenario, feature, ks_statistic, n_baseline, n_prod, p_value, drifted).

    Features that one side lacks, or where it has only missing values, give
    no row. A layout from an earlier sizing pass saves that pass. Where both
    samples have at most ``exact_rows`` values the p-value is exact."""
    layout = layout or size_up(obs, spec.scenario, common_features(spec, obs))
    tested = ks_from_counts(value_counts(obs, spec), spec, layout)
    if exact_rows:
        small = F.greatest("n_baseline", "n_prod") <= exact_rows
        exact = ks_pvalue_exact(F.col("ks_statistic"), F.col("n_baseline"), F.col("n_prod"))
        tested = tested.withColumn("p_value", F.when(small, exact).otherwise(F.col("p_value")))
    return tested.withColumn("drifted", F.col("p_value") < d(alpha))


def against_baseline(stats: DataFrame, spec: ObsSpec, cols: list[str]) -> DataFrame:
    """Rows of the batches with the baseline's value beside each column.

    ``stats`` has one row per (scenario, feature), so the window holds one
    small row per batch."""
    per_feature = W.partitionBy("feature")
    is_base = F.col("scenario") == spec.baseline
    base = [F.max(F.when(is_base, F.col(c))).over(per_feature).alias(f"base_{c}") for c in cols]
    return stats.select("*", *base).filter(~is_base)


def moment_shift(obs: DataFrame, spec: ObsSpec) -> DataFrame:
    """Effect size and differences per (scenario, feature).

    Two signs are in use and both are given: ``mean_diff`` and ``std_diff``
    are baseline minus batch, ``mean_shift`` is batch minus baseline."""
    return moment_columns(against_baseline(feature_moments(obs, spec), spec, ["n", "mean", "std"]))


def moment_columns(paired: DataFrame) -> DataFrame:
    both = paired.filter(F.col("base_n") > 0)
    return both.select(
        "scenario",
        "feature",
        F.col("base_mean").alias("mean_baseline"),
        F.col("mean").alias("mean_prod"),
        cohens_d(F.col("base_mean"), F.col("base_std"), F.col("mean"), F.col("std")).alias("cohens_d"),
        (F.col("base_mean") - F.col("mean")).alias("mean_diff"),
        (F.col("base_std") - F.col("std")).alias("std_diff"),
        (F.col("mean") - F.col("base_mean")).alias("mean_shift"),
    )


def drift_table(
    obs: DataFrame, spec: ObsSpec, alpha: float = KS_ALPHA, layout: Layout | None = None
) -> DataFrame:
    """Tests, effect sizes and means in one long table: the canonical drift result."""
    return ks_test(obs, spec, alpha, layout).join(moment_shift(obs, spec), ["scenario", "feature"])


def by_ks(table: DataFrame) -> DataFrame:
    """Largest distance first; ties by feature name."""
    return table.orderBy("scenario", F.desc("ks_statistic"), "feature")


def drift_share(table: DataFrame, spec: ObsSpec) -> DataFrame:
    """Per scenario: drifted and tested features, share over the declared and
    over the tested features."""
    declared = len(spec.features)
    return (
        table.groupBy("scenario")
        .agg(count_where(F.col("drifted")).alias("n_drifted"), F.count("*").alias("n_tested"))
        .withColumn("drift_share", F.col("n_drifted") / d(max(declared, 1)))
        .withColumn("tested_share", F.col("n_drifted") / F.col("n_tested"))
    )


def drift_summary(table: DataFrame, alpha: float = KS_ALPHA) -> DataFrame:
    """Per scenario: significant features and the largest absolute effect."""
    return table.groupBy("scenario").agg(
        count_where(F.col("p_value") < d(alpha)).alias("n_significant"),
        F.count("*").alias("n_tested"),
        F.max(F.abs("cohens_d")).alias("max_effect"),
    )


def top_features(table: DataFrame, k: int, by: Column, spec_key: str = "scenario") -> DataFrame:
    """The k largest features per scenario, with their rank; ties by name."""
    order = W.partitionBy(spec_key).orderBy(F.desc(by), F.asc("feature"))
    return table.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_feature(table: DataFrame) -> DataFrame:
    """Per scenario the largest KS distance and the feature that has it.

    Among equal distances the first name wins, so names are compared only
    within the rows that reach the maximum."""
    best = F.max("ks_statistic").over(W.partitionBy("scenario"))
    return (
        table.withColumn("max_ks", best)
        .filter(F.col("ks_statistic") == F.col("max_ks"))
        .groupBy("scenario")
        .agg(F.max("max_ks").alias("max_ks"), F.min("feature").alias("top_feature"))
    )


def feature_matrix(table: DataFrame, value: str, names: list[str], fill: float | None = None) -> DataFrame:
    """Features down, scenarios across; missing cells NULL or ``fill``."""
    m = table.groupBy("feature").pivot("scenario", names).agg(F.first(value))
    return m if fill is None else m.fillna(fill, subset=names)


def ks_matrix(table: DataFrame, names: list[str], fill: float | None = 0.0) -> DataFrame:
    """KS distances, features with the largest distance anywhere first."""
    m = feature_matrix(table, "ks_statistic", names, fill)
    cells = [F.col(f"`{n}`") for n in names]
    peak = F.greatest(*cells) if len(cells) > 1 else cells[0]
    return m.withColumn("max_ks", peak).orderBy(F.desc("max_ks"), "feature")


def scenario_matrix(table: DataFrame, value: str, features: list[str]) -> DataFrame:
    """Scenarios down, features across."""
    return table.groupBy("scenario").pivot("feature", features).agg(F.first(value))


def scenario_summary(table: DataFrame, balance: DataFrame, alpha: float = KS_ALPHA) -> DataFrame:
    """Per scenario: rows, positive rate in %, 'significant/tested', largest effect."""
    s = drift_summary(table, alpha)
    return balance.join(s, "scenario").select(
        "scenario",
        "n_rows",
        (F.col("positive_rate") * d(100)).alias("positive_pct"),
        F.concat_ws("/", F.col("n_significant").cast("string"), F.col("n_tested").cast("string")).alias(
            "significant"
        ),
        "max_effect",
    )
