"""Decisions on one row per scenario: status, reasons and recommendations.

Input rows carry ``scenario, n_drifted, n_tested, f1_score, auc_roc,
base_f1_score, base_auc_roc`` and, where used, ``avg_psi``. A missing metric
leaves its rules silent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftspark.functions.stats import d
from shiftspark.operators.evaluate import METRICS, compare
from shiftspark.spec import (
    PROMOTION_F1_GAIN,
    CountPolicy,
    LevelLimits,
    ObsSpec,
    RatioPolicy,
)


def f1_drop() -> Column:
    return F.col("base_f1_score") - F.col("f1_score")


def auc_drop() -> Column:
    return F.col("base_auc_roc") - F.col("auc_roc")


def _notes(*notes: Column) -> Column:
    """Array of the texts that apply, in order."""
    return F.filter(F.array(*notes), lambda x: x.isNotNull())


def _level(limits: LevelLimits, note: str) -> Column:
    rules = []
    if limits.count is not None:
        text = F.concat(F.col("n_drifted").cast("string"), F.lit(f" features drifted{note}"))
        rules.append(F.when(F.col("n_drifted") >= limits.count, text))
    if limits.f1_drop is not None:
        rules.append(F.when(f1_drop() > d(limits.f1_drop), F.format_string("F1 dropped by %.4f", f1_drop())))
    if limits.auc_drop is not None:
        rules.append(
            F.when(auc_drop() > d(limits.auc_drop), F.format_string("AUC-ROC dropped by %.4f", auc_drop()))
        )
    return _notes(*rules)


def count_policy(rows: DataFrame, policy: CountPolicy) -> DataFrame:
    """Two levels on counts and drops; only the reached level's reasons are given.

    The drift ratio is taken over the tested features."""
    top, middle, calm = policy.labels
    staged = rows.withColumn("_hard", _level(policy.retrain, policy.count_note[0])).withColumn(
        "_soft", _level(policy.warn, policy.count_note[1])
    )
    hard, soft = F.size("_hard") > 0, F.size("_soft") > 0
    return staged.select(
        "scenario",
        F.when(hard, top).when(soft, middle).otherwise(calm).alias("status"),
        F.when(hard, "red").when(soft, "orange").otherwise("green").alias("color"),
        f1_drop().alias("f1_drop"),
        auc_drop().alias("auc_drop"),
        F.when(F.col("n_tested") > 0, F.col("n_drifted") / F.col("n_tested")).otherwise(d(0)).alias("drift_ratio"),
        F.when(hard, F.col("_hard")).when(soft, F.col("_soft")).otherwise(F.array(F.lit(policy.quiet))).alias(
            "reasons"
        ),
    )


# Wording of the recommendation per status.
RECOMMENDATIONS = {
    "RETRAIN": "Retraining is recommended for %s. The model shows meaningful degradation and/or drift beyond threshold.",
    "WARNING": "%s should be monitored closely. Retraining is not urgent yet, but warning thresholds were exceeded.",
    "OK": "%s is currently stable. No immediate retraining is required.",
}
INLINE_RECOMMENDATIONS = {
    "RETRAIN": "Retraining is recommended based on drift and/or performance degradation.",
    "WARNING": "Monitor closely. Performance is degrading but has not yet crossed retrain threshold.",
    "STABLE": "Model is stable. No action required.",
}


def with_recommendation(decided: DataFrame, texts: dict[str, str] = RECOMMENDATIONS) -> DataFrame:
    text = F.lit(None).cast("string")
    for status, form in texts.items():
        filled = F.format_string(form, F.col("scenario")) if "%s" in form else F.lit(form)
        text = F.when(F.col("status") == status, filled).otherwise(text)
    return decided.withColumn("recommendation", text)


def _short(x: float) -> str:
    return repr(float(x))


def ratio_policy(rows: DataFrame, spec: ObsSpec, policy: RatioPolicy) -> DataFrame:
    """One level on the share of the declared features and the drops, all strict.

    Without an F1 only the share counts; without an AUC its rule is silent.
    The average PSI is a trigger only if the policy sets a limit for it."""
    declared = max(len(spec.features), 1)
    share = F.col("n_drifted") / d(declared)
    pct = share * d(100)
    has_f1 = F.col("f1_score").isNotNull()
    hit_share = share > d(policy.share)
    hit_f1 = has_f1 & (f1_drop() > d(policy.f1_drop))
    hit_auc = has_f1 & (auc_drop() > d(policy.auc_drop))
    reasons = [
        F.when(
            hit_share,
            F.format_string(
                f"%d/{len(spec.features)} features drifted (%.1f%% > {policy.share * 100:.0f}%%)", F.col("n_drifted"), pct
            ),
        ),
        F.when(hit_f1, F.format_string(f"F1 dropped %.4f (threshold {_short(policy.f1_drop)})", f1_drop())),
        F.when(hit_auc, F.format_string(f"AUC-ROC dropped %.4f (threshold {_short(policy.auc_drop)})", auc_drop())),
    ]
    alerts = [
        F.when(hit_share, F.format_string("Warning: %.1f%% of features show significant drift", pct)),
        F.when(hit_f1, F.format_string("Warning: F1 degraded by %.4f", f1_drop())),
        F.when(hit_auc, F.format_string("Warning: AUC-ROC degraded by %.4f", auc_drop())),
    ]
    if policy.psi is not None:
        hit_psi = F.col("avg_psi") > d(policy.psi)
        reasons.append(
            F.when(hit_psi, F.format_string(f"Average PSI %.4f (threshold {_short(policy.psi)})", F.col("avg_psi")))
        )
        alerts.append(F.when(hit_psi, F.format_string("Warning: average PSI is %.4f", F.col("avg_psi"))))
    calm = "All metrics within acceptable range - no retraining needed."
    decided = rows.select(
        "*", share.alias("drift_share"), _notes(*reasons).alias("reasons"), _notes(*alerts).alias("_alerts")
    )
    retrain = F.size("reasons") > 0
    return decided.select(
        "scenario",
        "n_drifted",
        "drift_share",
        "f1_score",
        "auc_roc",
        retrain.alias("retrain"),
        "reasons",
        F.when(retrain, F.col("_alerts")).otherwise(F.array(F.lit(calm))).alias("alerts"),
    )


def health_label(share: Column, retrain: Column, limit: float) -> Column:
    """green without drift, yellow below the limit, else red. A share equal to
    the limit is red even when nothing else calls for retraining."""
    return (
        F.when(~retrain & (share == d(0)), "green")
        .when(~retrain & (share < d(limit)), "yellow")
        .otherwise("red")
    )


def threshold_rows(policy: RatioPolicy) -> list[tuple[str, str, str]]:
    """(metric, threshold, action) of a policy."""
    return [
        ("KS p-value", f"< {_short(policy.alpha)}", "Feature drifted"),
        ("PSI moderate", f"> {_short(policy.psi_moderate)}", "Watch closely"),
        ("PSI high", f"> {_short(policy.psi_high)}", "Trigger retrain"),
        ("% features drifted", f"> {policy.share * 100:.0f}%", "Trigger retrain"),
        ("F1 drop", f"> {_short(policy.f1_drop)}", "Trigger retrain"),
        ("AUC-ROC drop", f"> {_short(policy.auc_drop)}", "Trigger retrain"),
    ]


def threshold_table(spark, policy: RatioPolicy) -> DataFrame:
    return spark.createDataFrame(threshold_rows(policy), "metric string, threshold string, action string")


def threshold_usage(rows: DataFrame, tests: DataFrame, psi: DataFrame, spec: ObsSpec, policy: RatioPolicy) -> DataFrame:
    """The threshold table with the number of cases in which each limit is passed.

    Feature limits count (scenario, feature) cases, the others scenarios."""
    share = F.col("n_drifted") / d(max(len(spec.features), 1))
    hits = lambda cond: F.count(F.when(cond, F.lit(1)))
    per_rule = [
        (tests, F.col("p_value") < d(policy.alpha)),
        (psi, F.col("psi") > d(policy.psi_moderate)),
        (psi, F.col("psi") > d(policy.psi_high)),
        (rows, share > d(policy.share)),
        (rows, f1_drop() > d(policy.f1_drop)),
        (rows, auc_drop() > d(policy.auc_drop)),
    ]
    texts = threshold_rows(policy)
    out = None
    for source in (tests, psi, rows):
        mine = [(t, c) for t, (s, c) in zip(texts, per_rule) if s is source]
        counted = source.agg(*[hits(c).alias(f"h{i}") for i, (_, c) in enumerate(mine)])
        lines = [
            F.struct(
                F.lit(t[0]).alias("metric"),
                F.lit(t[1]).alias("threshold"),
                F.lit(t[2]).alias("action"),
                F.col(f"h{i}").alias("n_passed"),
            )
            for i, (t, _) in enumerate(mine)
        ]
        part = counted.select(F.inline(F.array(*lines)))
        out = part if out is None else out.unionByName(part)
    return out


def champion_challenger(records: DataFrame, gain: float = PROMOTION_F1_GAIN) -> DataFrame:
    """Promote where F1 gains at least ``gain`` and AUC does not fall.

    ``records`` has one row per scenario and model, 'champion' or 'challenger'."""
    of = lambda model, metric: F.max(F.when(F.col("model") == model, F.col(metric)))
    both = records.groupBy("scenario").agg(
        of("champion", "f1_score").alias("champion_f1"),
        of("champion", "auc_roc").alias("champion_auc"),
        of("challenger", "f1_score").alias("challenger_f1"),
        of("challenger", "auc_roc").alias("challenger_auc"),
    )
    f1_gain = F.col("challenger_f1") - F.col("champion_f1")
    auc_gain = F.col("challenger_auc") - F.col("champion_auc")
    promote = (f1_gain >= d(gain)) & (auc_gain >= d(0))
    return both.select(
        "*", f1_gain.alias("f1_gain"), auc_gain.alias("auc_gain"), F.coalesce(promote, F.lit(False)).alias("promote")
    )


def decision_rows(metrics: DataFrame, shares: DataFrame, spec: ObsSpec) -> DataFrame:
    """The input of the policies: metrics beside the baseline's, and drift counts.

    A batch without testable features counts 0 drifted features."""
    compared = compare(metrics, spec).filter(F.col("scenario") != spec.baseline)
    kept = ["scenario", "n_rows", "positive_rate", *METRICS, *[f"base_{m}" for m in METRICS]]
    return compared.select(*kept).join(shares.select("scenario", "n_drifted", "n_tested"), "scenario", "left").fillna(
        0, subset=["n_drifted", "n_tested"]
    )
