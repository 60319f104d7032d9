"""Whole checks: all features and all batches against the baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.functions.display import out_of, shown
from shiftspark.functions.stats import d
from shiftspark.operators.drift import (
    against_baseline,
    drift_share,
    ks_from_counts,
    ks_test,
    moment_columns,
    value_counts,
)
from shiftspark.operators.evaluate import METRICS, evaluate
from shiftspark.operators.policy import decision_rows, health_label, ratio_policy
from shiftspark.operators.prefix import Layout, size_up
from shiftspark.operators.profile import feature_moments
from shiftspark.operators.psi import (
    Edges,
    bin_counts,
    edges_of_ranges,
    psi_against_baseline,
    psi_average,
    psi_table,
)
from shiftspark.operators.select import common_features
from shiftspark.sources.profile_store import Profile
from shiftspark.spec import ObsSpec, RatioPolicy


def survey(obs: DataFrame, spec: ObsSpec) -> Layout:
    """The one sizing pass that serves tests, metrics and PSI together."""
    cols = [*common_features(spec, obs), *[c for c in [spec.score] if c in obs.columns]]
    return size_up(obs, spec.scenario, cols, baseline=spec.baseline)


def feature_edges(layout: Layout, spec: ObsSpec) -> Edges:
    return edges_of_ranges({f: r for f, r in layout.ranges.items() if f in spec.features})


def batch_check(
    obs: DataFrame, spec: ObsSpec, policy: RatioPolicy, layout: Layout | None = None
) -> DataFrame:
    """Per batch: drift share, F1, AUC and whether to retrain, with reasons."""
    layout = layout or survey(obs, spec)
    shares = drift_share(ks_test(obs, spec, policy.alpha, layout), spec)
    rows = decision_rows(evaluate(obs, spec, layout), shares, spec)
    if policy.psi is not None:
        rows = rows.join(psi_average(psi_table(obs, spec, edges=feature_edges(layout, spec))), "scenario", "left")
    return ratio_policy(rows, spec, policy)


def model_health(obs: DataFrame, spec: ObsSpec, policy: RatioPolicy) -> DataFrame:
    """The overview of a monitoring run: drifted features, average PSI,
    metrics, decision and health colour per batch."""
    layout = survey(obs, spec)
    decided = batch_check(obs, spec, policy, layout)
    averages = psi_average(psi_table(obs, spec, edges=feature_edges(layout, spec)))
    return decided.join(averages, "scenario", "left").select(
        "scenario",
        "n_drifted",
        "drift_share",
        "avg_psi",
        "f1_score",
        "auc_roc",
        "retrain",
        health_label(F.col("drift_share"), F.col("retrain"), policy.share).alias("health"),
        F.concat_ws("; ", "reasons").alias("reasons"),
    )


def decision_input(obs: DataFrame, spec: ObsSpec, alpha: float) -> DataFrame:
    """One row per batch for any policy: metrics, baseline metrics and drift counts."""
    layout = survey(obs, spec)
    shares = drift_share(ks_test(obs, spec, alpha, layout), spec)
    return decision_rows(evaluate(obs, spec, layout), shares, spec)


def overview_page(obs: DataFrame, spec: ObsSpec, policy: RatioPolicy) -> DataFrame:
    """Per batch in display form: 'drifted/declared', drift %, F1, its delta,
    AUC and positive rate %; missing metrics stay missing."""
    rows = decision_input(obs, spec, policy.alpha)
    declared = len(spec.features)
    return rows.select(
        "scenario",
        out_of(F.col("n_drifted"), declared).alias("features_drifted"),
        shown(F.col("n_drifted") / d(max(declared, 1)) * d(100), 1).alias("drift_pct"),
        shown(F.col("f1_score"), 4).alias("f1_score"),
        shown(F.col("f1_score") - F.col("base_f1_score"), 4).alias("delta_f1"),
        shown(F.col("auc_roc"), 4).alias("auc_roc"),
        shown(F.col("positive_rate") * d(100), 3).alias("positive_pct"),
    )


def profile_check(batch: DataFrame, profile: Profile, spec: ObsSpec, policy: RatioPolicy) -> DataFrame:
    """``batch_check`` against a stored profile, with average PSI and mean shift.

    The baseline enters through its stored counts near the batch's values; its
    rows are not read. Rows of the batch under the baseline's name are left
    out: they would be added to the stored counts."""
    batch = batch.filter(F.col(spec.scenario) != spec.baseline)
    counts = value_counts(batch, spec)
    counts = counts.unionByName(profile.around(counts))
    tests = ks_from_counts(counts, spec, profile.layout).withColumn("drifted", F.col("p_value") < d(policy.alpha))
    shares = drift_share(tests, spec)
    bins = bin_counts(batch, spec, profile.edges).unionByName(profile.bins)
    averages = psi_average(psi_against_baseline(bins, spec))
    metrics = evaluate(batch, spec, profile.layout)
    base = [F.lit(profile.metrics[m]).cast("double").alias(f"base_{m}") for m in METRICS]
    rows = (
        metrics.select("*", *base)
        .join(shares.select("scenario", "n_drifted", "n_tested"), "scenario", "left")
        .fillna(0, subset=["n_drifted", "n_tested"])
        .join(averages, "scenario", "left")
    )
    decided = ratio_policy(rows, spec, policy)
    return decided.join(averages, "scenario", "left")


def profile_shift(batch: DataFrame, profile: Profile, spec: ObsSpec) -> DataFrame:
    """Effect sizes of a batch against the stored moments."""
    both = feature_moments(batch, spec).unionByName(profile.moments)
    return moment_columns(against_baseline(both, spec, ["n", "mean", "std"]))
