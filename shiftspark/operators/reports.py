"""Nested reports as one-row or one-row-per-scenario tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shiftspark.functions.display import shown, slug
from shiftspark.operators.evaluate import METRICS
from shiftspark.spec import ObsSpec, RatioPolicy


# Names of the two classes in the exported record.
CLASS_NAMES = ("legitimate", "fraud")


def baseline_report(metrics: DataFrame, spec: ObsSpec, dataset: str, model: str) -> DataFrame:
    """The record of a baseline run: one row, metrics and class counts nested."""
    row = metrics.filter(F.col("scenario") == spec.baseline)
    return row.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.lit(dataset).alias("dataset"),
        F.lit(model).alias("baseline_model"),
        F.col("n_rows").alias("test_set_size"),
        F.struct(*METRICS).alias("metrics"),
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"),
        F.struct(
            (F.col("tn") + F.col("fp")).alias(CLASS_NAMES[0]), (F.col("fn") + F.col("tp")).alias(CLASS_NAMES[1])
        ).alias("class_distribution"),
    )


def distribution_report(table: DataFrame) -> DataFrame:
    """One row per scenario: a map from feature to its five numbers."""
    numbers = F.struct(
        "ks_statistic", F.col("p_value").alias("ks_pvalue"), "cohens_d", "mean_diff", "std_diff"
    )
    return table.groupBy("scenario").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", numbers)))).alias("ks_tests")
    )


def impact_report(compared: DataFrame, spec: ObsSpec, model: str, places: int = 6) -> DataFrame:
    """One row: the baseline and the list of scenarios with metrics and deltas."""
    r = lambda c: shown(F.col(c), places)
    entry = F.struct(
        F.col("scenario"),
        F.col("n_rows").alias("n_samples"),
        F.col("positive_rate").alias("fraud_rate"),
        F.struct(*[r(m).alias(m) for m in METRICS]).alias("metrics"),
        F.struct(*[r(f"delta_{m}").alias(m) for m in METRICS]).alias("deltas"),
    )
    is_base = F.col("scenario") == spec.baseline
    return compared.agg(
        F.struct(
            F.lit(model).alias("model"),
            F.max(F.when(is_base, F.struct(*METRICS))).alias("metrics"),
        ).alias("baseline"),
        F.array_sort(F.collect_list(F.when(~is_base, entry))).alias("drift_scenarios"),
    )


def monitoring_report(decided: DataFrame, averages: DataFrame, policy: RatioPolicy) -> DataFrame:
    """One row per scenario with its file name and the report as JSON text;
    missing values are written as null."""
    body = F.struct(
        "scenario",
        shown(F.col("drift_share") * 100, 1).alias("drift_pct"),
        "n_drifted",
        shown(F.col("avg_psi"), 4).alias("avg_psi"),
        shown(F.col("f1_score"), 4).alias("f1"),
        shown(F.col("auc_roc"), 4).alias("auc_roc"),
        "retrain",
        "reasons",
        F.struct(
            F.lit(policy.alpha).alias("ks_alpha"),
            F.lit(policy.psi_moderate).alias("psi_moderate"),
            F.lit(policy.psi_high).alias("psi_high"),
            F.lit(policy.share).alias("drift_pct_trigger"),
            F.lit(policy.f1_drop).alias("f1_drop_trigger"),
            F.lit(policy.auc_drop).alias("roc_drop_trigger"),
        ).alias("thresholds"),
    )
    rows = decided.join(averages, "scenario", "left")
    return rows.select(
        "scenario",
        F.concat(F.lit("monitoring_"), slug(F.col("scenario")), F.lit(".json")).alias("file_name"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("report"),
    )


def preview(scored: DataFrame, order: list[str], rows: int = 100) -> DataFrame:
    """The first rows of a scored table in the given order, with their place and the number of all rows."""
    total = scored.agg(F.count("*").alias("n")).scalar()
    first = scored.orderBy(*order).limit(rows)
    # As many rows as are shown: one task numbers them.
    place = F.row_number().over(W.orderBy(*order))
    return first.select(place.alias("place"), "*").withColumn("n_total", total)
