"""Classifier metrics per scenario and their comparison with the baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shiftspark.functions.display import degraded, text_form
from shiftspark.functions.stats import count_where, d, grid_index, known, ratio
from shiftspark.operators.prefix import Layout, Running, running_sums, size_up, with_bucket, with_lower
from shiftspark.spec import DEFAULT_THRESHOLD, DEGRADED_MARGIN, ObsSpec

METRICS = ["f1_score", "auc_roc", "precision", "recall"]
CELLS = ["tn", "fp", "fn", "tp"]


def label_at(prob: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """1 from the threshold on (inclusive)."""
    return (prob >= d(threshold)).cast("int")


def default_label(prob: Column) -> Column:
    """The class of the larger probability; a tie goes to class 0."""
    return (prob > d(0.5)).cast("int")


def confusion(obs: DataFrame, spec: ObsSpec) -> DataFrame:
    """The four cells per scenario over rows with label and prediction."""
    y, p = F.col(spec.label), F.col(spec.prediction)
    cell = {"tn": (y == 0) & (p == 0), "fp": (y == 0) & (p == 1), "fn": (y == 1) & (p == 0), "tp": (y == 1) & (p == 1)}
    return obs.groupBy(spec.scenario_column()).agg(
        *[count_where(c).alias(n) for n, c in cell.items()]
    )


def with_prf(cells: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the positive class beside the cells.

    A zero denominator gives 0; no rated row at all gives NULL."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rated = tp + fp + fn + F.col("tn") > 0
    return cells.select(
        "*",
        F.when(rated, ratio(tp, tp + fp)).alias("precision"),
        F.when(rated, ratio(tp, tp + fn)).alias("recall"),
        F.when(rated, ratio(tp * 2, tp * 2 + fp + fn)).alias("f1_score"),
    )


def score_cuts(obs: DataFrame, spec: ObsSpec, layout: Layout | None) -> dict[str, list[float]]:
    """One list of cuts of the score, which serves all scenarios."""
    if spec.score not in obs.columns:
        return {}
    layout = layout or size_up(obs, spec.scenario, [spec.score])
    return {"score": layout.cuts[spec.score]}


def outcome_columns(obs: DataFrame, spec: ObsSpec) -> dict[str, Column]:
    """Score, label and prediction under short names; NULL where the table lacks one."""
    have = lambda c: F.col(c) if c in obs.columns else F.lit(None)
    return {
        "score": known(have(spec.score)).alias("score"),
        "y": have(spec.label).cast("int").alias("y"),
        "p": have(spec.prediction).cast("int").alias("p"),
    }


def outcome_counts(obs: DataFrame, spec: ObsSpec) -> DataFrame:
    """(scenario, score, y, p, n): rows collapsed to distinct outcomes.

    The matrix and the ranking metrics are both sums over this table, so they
    share its scan and its shuffle."""
    rows = obs.select(spec.scenario_column(), *outcome_columns(obs, spec).values())
    return rows.groupBy("scenario", "score", "y", "p").agg(F.count("*").alias("n"))


def ranked_outcomes(counts: DataFrame, cuts: dict[str, list[float]], by: str | None = None) -> DataFrame:
    """The counts with the running negatives up to each score; ``by`` is a
    further key, whose values have their own cuts."""
    ranked = F.col("score").isNotNull()
    zero = F.lit(0).cast("long")
    counts = counts.withColumns(
        {
            "pos": F.when(ranked & (F.col("y") == 1), F.col("n")).otherwise(zero),
            "neg": F.when(ranked & (F.col("y") == 0), F.col("n")).otherwise(zero),
        }
    )
    placed = with_bucket(counts, "score", cuts, by=by)
    keys = (by, "scenario") if by else ("scenario",)
    return running_sums(placed, "score", [Running("neg_upto", "neg", keys, peers=True)])


def auc_sum() -> Column:
    """Aggregate: area under the ROC curve from running negatives, ties half.

    NULL when a class is absent."""
    below = F.col("neg_upto") - F.col("neg_upto_here")
    wins = F.col("pos").cast("double") * (below + F.col("neg_upto_here") * d(0.5))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return F.when(pairs > 0, F.sum(wins) / pairs)


def auc(obs: DataFrame, spec: ObsSpec, layout: Layout | None = None) -> DataFrame:
    ranked = ranked_outcomes(outcome_counts(obs, spec), score_cuts(obs, spec, layout))
    return ranked.groupBy("scenario").agg(auc_sum().alias("auc_roc"))


def evaluate(obs: DataFrame, spec: ObsSpec, layout: Layout | None = None) -> DataFrame:
    """One metric record per scenario, all scenarios in one job.

    A scenario without labels or without predictions keeps its row, with
    NULL metrics; a table without such a column is treated alike."""
    return metric_records(outcome_counts(obs, spec), score_cuts(obs, spec, layout))


def evaluate_models(obs: DataFrame, spec: ObsSpec, models: dict[str, tuple[str, str]]) -> DataFrame:
    """One metric record per scenario and model, for any number of models over
    one pass; ``models`` names each one's score and prediction column.

    The outcomes of all models are turned long and counted in one shuffle."""
    scores = list(dict.fromkeys(score for score, _ in models.values()))
    cuts = size_up(obs, spec.scenario, scores).cuts
    cells = [
        F.struct(F.lit(m).alias("model"), known(s).alias("score"), F.col(p).cast("int").alias("p"))
        for m, (s, p) in models.items()
    ]
    rows = obs.select(spec.scenario_column(), F.col(spec.label).cast("int").alias("y"), F.inline(F.array(*cells)))
    counts = rows.groupBy("model", "scenario", "score", "y", "p").agg(F.count("*").alias("n"))
    return metric_records(counts, {m: cuts[s] for m, (s, _) in models.items()}, by="model")


def metric_records(counts: DataFrame, cuts: dict[str, list[float]], by: str | None = None) -> DataFrame:
    """The records from counted outcomes, for each value of ``by`` if there is one."""
    keys = [by, "scenario"] if by else ["scenario"]
    y, p, n = F.col("y"), F.col("p"), F.col("n")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0).cast("long"))
    labelled = F.sum(F.when(y.isNotNull(), n))
    sums = (
        ranked_outcomes(counts, cuts, by)
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n_rows"),
            (total(y == 1).cast("double") / labelled).alias("positive_rate"),
            total((y == 0) & (p == 0)).alias("tn"),
            total((y == 0) & (p == 1)).alias("fp"),
            total((y == 1) & (p == 0)).alias("fn"),
            total((y == 1) & (p == 1)).alias("tp"),
            auc_sum().alias("auc_roc"),
        )
    )
    return with_prf(sums).select(*keys, "n_rows", "positive_rate", *CELLS, *METRICS)


def roc_curve(obs: DataFrame, spec: ObsSpec, layout: Layout | None = None, thin: bool = True) -> DataFrame:
    """(scenario, threshold, fpr, tpr): the distinct scores as thresholds, and
    the starting point (0, 0) with no threshold.

    By default a threshold is left out where the curve goes straight on: where
    it and the next lower one add the same numbers of positives and negatives.
    The curve and its area stay the same."""
    share = lambda c, whole: F.when(F.col(whole) > 0, F.col(c) / F.col(whole))
    point = {"fpr": share("fp", "N"), "tpr": share("tp", "P")}
    straight = (F.col("pos") == F.col("pos_next")) & (F.col("neg") == F.col("neg_next"))
    return _curve(obs, spec, layout, point, {"fpr": d(0), "tpr": d(0)}, straight if thin else None)


def pr_curve(obs: DataFrame, spec: ObsSpec, layout: Layout | None = None, thin: bool = False) -> DataFrame:
    """(scenario, threshold, precision, recall), ended by (1, 0) with no threshold.

    Recall is 1 throughout where there is no positive. On request a threshold
    is left out where neither it nor the next lower one adds a positive: recall
    stands still there and precision only falls."""
    point = {
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(d(1)),
    }
    still = (F.col("pos") == 0) & (F.col("pos_next") == 0)
    return _curve(obs, spec, layout, point, {"precision": d(1), "recall": d(0)}, still if thin else None)


def _curve(
    obs: DataFrame,
    spec: ObsSpec,
    layout: Layout | None,
    point: dict[str, Column],
    end: dict[str, Column],
    droppable: Column | None,
) -> DataFrame:
    """Points for the distinct scores from the counts at or above them; the
    highest score of a scenario also yields the end point.

    ``droppable`` compares the counts at a score (pos, neg) with those at the
    next lower one (pos_next, neg_next); the highest and the lowest score stay."""
    rows = (
        obs.select(spec.scenario_column(), known(spec.score).alias("score"), F.col(spec.label).alias("y"))
        .filter(F.col("score").isNotNull() & F.col("y").isNotNull())
    )
    counts = rows.groupBy("scenario", "score").agg(
        count_where(F.col("y") == 1).alias("pos"), count_where(F.col("y") == 0).alias("neg")
    )
    placed = with_bucket(counts, "score", score_cuts(obs, spec, layout))
    if droppable is not None:
        placed = with_lower(placed, ["scenario"], "score", ["pos", "neg"])
    sums = [Running(f"{c}_upto", c, ("scenario",), total=True) for c in ("pos", "neg")]
    ranked = running_sums(placed, "score", sums)
    top = (F.col("pos_upto") == F.col("pos_upto_total")) & (F.col("neg_upto") == F.col("neg_upto_total"))
    if droppable is not None:
        ranked = ranked.filter(top | F.col("pos_next").isNull() | ~droppable)
    at_least = ranked.select(
        "scenario",
        "score",
        (F.col("pos_upto_total") - F.col("pos_upto") + F.col("pos")).alias("tp"),
        (F.col("neg_upto_total") - F.col("neg_upto") + F.col("neg")).alias("fp"),
        F.col("pos_upto_total").alias("P"),
        F.col("neg_upto_total").alias("N"),
        top.alias("top"),
    )
    own = F.struct(F.col("score").alias("threshold"), *[c.alias(n) for n, c in point.items()])
    last = F.struct(F.lit(None).cast("double").alias("threshold"), *[c.alias(n) for n, c in end.items()])
    return at_least.select("scenario", F.inline(F.when(F.col("top"), F.array(own, last)).otherwise(F.array(own))))


def threshold_sweep(
    obs: DataFrame, spec: ObsSpec, first: int = 5, last: int = 95, steps: int = 100
) -> DataFrame:
    """Cells and metrics for the thresholds first/steps .. last/steps.

    A score passes a threshold that is not above it, so one grid number per
    row says which thresholds it passes. One aggregation leaves at most
    last - first + 2 counts per scenario; the rest works on those."""
    y = F.col(spec.label)
    rows = obs.select(
        spec.scenario_column(),
        y.alias("y"),
        F.greatest(F.lit(first - 1), F.least(F.lit(last), grid_index(known(spec.score), steps))).alias("g"),
        known(spec.score).alias("s"),
    ).filter(F.col("s").isNotNull() & F.col("y").isNotNull())
    counts = rows.groupBy("scenario", "g").agg(
        count_where(F.col("y") == 1).alias("pos"), count_where(F.col("y") == 0).alias("neg")
    )
    per_scenario = counts.groupBy("scenario").agg(
        F.collect_list(F.struct("g", "pos", "neg")).alias("cells"),
        F.sum("pos").alias("P"),
        F.sum("neg").alias("N"),
    )
    passed = lambda field: F.aggregate(
        F.filter("cells", lambda c: c["g"] >= F.col("step")), F.lit(0).cast("long"), lambda a, c: a + c[field]
    )
    swept = per_scenario.withColumn("step", F.explode(F.sequence(F.lit(first), F.lit(last)))).select(
        "scenario",
        (F.col("step") / d(steps)).alias("threshold"),
        passed("pos").alias("tp"),
        passed("neg").alias("fp"),
        "P",
        "N",
    )
    cells = swept.select(
        "scenario", "threshold", (F.col("N") - F.col("fp")).alias("tn"), "fp", (F.col("P") - F.col("tp")).alias("fn"), "tp"
    )
    return with_prf(cells)


def compare(metrics: DataFrame, spec: ObsSpec) -> DataFrame:
    """Metrics of every scenario, the baseline's beside them, and the deltas.

    One row per scenario, so the window over all of them is small."""
    everything = W.partitionBy()
    is_base = F.col("scenario") == spec.baseline
    base = [F.max(F.when(is_base, F.col(m))).over(everything).alias(f"base_{m}") for m in METRICS]
    with_base = metrics.select("*", *base)
    return with_base.select("*", *[(F.col(m) - F.col(f"base_{m}")).alias(f"delta_{m}") for m in METRICS])


def impact_view(compared: DataFrame) -> DataFrame:
    """Metrics and deltas with 0 for what is absent, and F1 and AUC as text."""
    filled = [F.coalesce(c, d(0)).alias(c) for c in [*METRICS, *[f"delta_{m}" for m in METRICS]]]
    return compared.select(
        "scenario",
        *filled,
        text_form(F.col("f1_score"), 3).alias("f1_text"),
        text_form(F.col("auc_roc"), 2).alias("auc_text"),
    )


def compare_with(metrics: DataFrame, baseline: dict[str, float], name: str = "Baseline") -> DataFrame:
    """The same comparison against stored baseline metrics, with a baseline row on top."""
    stored = metrics.sparkSession.createDataFrame(
        [(name, *[float(baseline[m]) for m in METRICS])],
        "scenario string, " + ", ".join(f"{m} double" for m in METRICS),
    )
    rows = stored.unionByName(metrics.filter(F.col("scenario") != name), allowMissingColumns=True)
    return rows.select(
        "*",
        *[d(baseline[m]).alias(f"base_{m}") for m in METRICS],
        *[(F.col(m) - d(baseline[m])).alias(f"delta_{m}") for m in METRICS],
    )


def deltas(compared: DataFrame, spec: ObsSpec) -> DataFrame:
    """Scenario minus baseline, batches only."""
    return compared.filter(F.col("scenario") != spec.baseline).select(
        "scenario", *[f"delta_{m}" for m in METRICS]
    )


def worst_scenario(compared: DataFrame, spec: ObsSpec, order: Column | None = None) -> DataFrame:
    """The batch with the lowest F1; the first in ``order`` (by name) wins a tie."""
    ordinal = F.col("scenario") if order is None else order
    batches = compared.filter((F.col("scenario") != spec.baseline) & F.col("f1_score").isNotNull())
    return batches.agg(
        F.min_by("scenario", F.struct(F.col("f1_score"), ordinal)).alias("scenario"),
        F.min("f1_score").alias("f1_score"),
    )


def trend(compared: DataFrame, spec: ObsSpec, f1_drop: float, auc_drop: float) -> DataFrame:
    """F1 and AUC over the baseline and the batches, missing as 0, with the
    lines below which retraining is called for."""
    by_name = W.partitionBy().orderBy((F.col("scenario") != spec.baseline).cast("int"), "scenario")
    return compared.select(
        (F.row_number().over(by_name) - 1).alias("ordinal"),
        "scenario",
        F.coalesce("f1_score", d(0)).alias("f1_score"),
        F.coalesce("auc_roc", d(0)).alias("auc_roc"),
        (F.col("base_f1_score") - d(f1_drop)).alias("f1_line"),
        (F.col("base_auc_roc") - d(auc_drop)).alias("auc_line"),
    )


def metric_long(compared: DataFrame, margin: float = DEGRADED_MARGIN) -> DataFrame:
    """(scenario, metric, value, baseline, delta, degraded)."""
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"base_{m}").alias("baseline"))
            for m in METRICS
        ]
    )
    return compared.select("scenario", F.inline(cells)).select(
        "*",
        (F.col("value") - F.col("baseline")).alias("delta"),
        degraded(F.col("value"), F.col("baseline"), margin).alias("degraded"),
    )
