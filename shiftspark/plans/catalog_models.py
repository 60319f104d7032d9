"""Catalogue queries that train models.

What a fit comes to differs from engine to engine, so the results say what must
hold of any fit: how many rows were scored, that classes follow from the
scores, that the ranking is good, that the choice is the best one.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.functions.display import rounded
from shiftspark.functions.stats import d
from shiftspark.operators import evaluate, models, prepare, reports
from shiftspark.operators.prefix import size_up
from shiftspark.plans import oracle as o
from shiftspark.plans.catalog import KEYS, SPEC, SPLIT_CTES, query
from shiftspark.plans.fixtures import obs
from shiftspark.sources.writers import shared_folder, stored

INPUTS = ["scenario", *KEYS, *SPEC.features, "Class"]
# Area that any of the models exceeds where both classes are present.
GOOD_AUC = 0.7

COMPLETE = " AND ".join(f"{f} IS NOT NULL" for f in SPEC.features)
PARTS_SQL = (
    *o.OBS,
    SPLIT_CTES,
    f"""base_parts AS (SELECT p.*, CASE WHEN place <= train_c THEN 'train' WHEN place <= upto_val THEN 'val' ELSE 'test' END AS split
      FROM placed p JOIN quotas q ON q.Class = p.Class),
    scored AS (SELECT scenario, Class, {COMPLETE} AS complete FROM base_parts WHERE split = 'test'
      UNION ALL SELECT scenario, Class, {COMPLETE} FROM obs WHERE scenario <> 'Baseline')""",
)
FACTS_SQL = """SELECT scenario, count(*) AS n_rows, count(*) FILTER (WHERE Class = 1) AS n_positive,
  count(*) FILTER (WHERE complete) AS n_scored, CASE WHEN count(*) FILTER (WHERE complete) > 0 THEN true END AS classes_follow,
  CASE WHEN count(*) FILTER (WHERE complete) > 0 THEN true END AS within_0_1,
  CASE WHEN count(*) FILTER (WHERE complete AND Class = 1) > 0 AND count(*) FILTER (WHERE complete AND Class = 0) > 0
    THEN true END AS ranks_well FROM scored GROUP BY scenario"""


def parts(spark, sf) -> dict[str, DataFrame]:
    """Baseline rows split 60/20/20; all batches under their own name."""
    table = obs(spark, sf).select(*INPUTS)
    base = prepare.stratified_split(table.filter(F.col("scenario") == "Baseline"), "Class", KEYS)
    part = {n: base.filter(F.col("split") == n).drop("split") for n in ("train", "val", "test")}
    return part | {"batches": table.filter(F.col("scenario") != "Baseline")}


def facts(model: PipelineModel, p: dict[str, DataFrame]) -> DataFrame:
    """What holds of the scores of the held-out baseline rows and of every batch.

    The rows are scored once; all else is summed up from their counted outcomes."""
    scored = models.score(model, p["test"].unionByName(p["batches"]), SPEC)
    counts = stored(evaluate.outcome_counts(scored, SPEC))
    cuts = size_up(counts, "scenario", ["score"]).cuts
    n, s = F.col("n"), F.col("score")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0).cast("long"))
    return evaluate.ranked_outcomes(counts, cuts).groupBy("scenario").agg(
        F.sum("n").alias("n_rows"),
        total(F.col("y") == 1).alias("n_positive"),
        total(s.isNotNull()).alias("n_scored"),
        F.bool_and(F.col("p") == (s > d(0.5)).cast("int")).alias("classes_follow"),
        F.bool_and(s.between(0.0, 1.0)).alias("within_0_1"),
        (evaluate.auc_sum() > d(GOOD_AUC)).alias("ranks_well"),
    )


@query("fit_logistic", *PARTS_SQL, FACTS_SQL)
def fit_logistic(spark, sf):
    p = parts(spark, sf)
    return facts(models.fit(p["train"], SPEC, models.logistic(p["train"].count())), p)


@query("fit_forest", *PARTS_SQL, FACTS_SQL)
def fit_forest(spark, sf):
    p = parts(spark, sf)
    return facts(models.fit(p["train"], SPEC, models.forest()), p)


@query(
    "fit_boosted",
    *PARTS_SQL,
    """SELECT scenario, count(*) AS n, count(*) FILTER (WHERE complete) AS n_scored,
    CASE WHEN count(*) FILTER (WHERE complete) > 0 THEN true END AS labels_follow
    FROM scored WHERE scenario <> 'Baseline' GROUP BY scenario""",
)
def fit_boosted(spark, sf):
    """Batches scored by boosted trees and labelled at a threshold of 0.3."""
    p = parts(spark, sf)
    model = models.fit(p["train"], SPEC, models.boosted())
    scored = models.score_with_threshold(model, p["batches"], SPEC, 0.3)
    follows = F.col("prediction") == (F.col("probability") >= d(0.3)).cast("int")
    return scored.groupBy("scenario").agg(
        F.count("*").alias("n"), F.count("probability").alias("n_scored"), F.bool_and(follows).alias("labels_follow")
    )


@query(
    "feature_importance",
    *o.OBS,
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {'true' if f == 'qty' else 'false'} AS is_first, true AS within_0_1, true AS adds_up"
        for f in SPEC.features
    ),
)
def importance(spark, sf):
    """The shares of the features in a boosted fit; the quantity, which the label is made of, leads."""
    p = parts(spark, sf)
    shares = models.feature_importance(models.fit(p["train"], SPEC, models.boosted()), SPEC)
    total = shares.agg(F.sum("importance").alias("s")).scalar()
    return shares.select(
        "feature",
        (F.col("rank") == 1).alias("is_first"),
        F.col("importance").between(0.0, 1.0).alias("within_0_1"),
        (F.abs(total - d(1)) < d(1e-9)).alias("adds_up"),
    )


@query(
    "model_choice",
    *PARTS_SQL,
    """SELECT model, (SELECT count(*) FROM scored WHERE scenario = 'Baseline') AS n_rows, true AS agrees
    FROM (VALUES ('random forest'), ('logistic regression')) m(model)""",
)
def choice(spark, sf):
    """Both models on the test rows; a model is chosen if and only if its F1 is the best, the first one on a tie."""
    p = parts(spark, sf)
    fitted = {
        "random forest": models.fit(p["train"], SPEC, models.forest()),
        "logistic regression": models.fit(p["train"], SPEC, models.logistic(p["train"].count())),
    }
    rows = stored(models.choose(fitted, p["test"], SPEC))
    best = rows.agg(F.max("f1_score").alias("f")).scalar()
    first = rows.agg(F.max(F.when(F.col("model") == "random forest", F.col("f1_score"))).alias("f")).scalar()
    leads = (F.col("f1_score") == best) & ((F.col("model") == "random forest") | (first < best))
    return rows.select("model", "n_rows", (F.col("chosen") == leads).alias("agrees"))


@query(
    "model_roundtrip",
    *PARTS_SQL,
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE complete) AS n_equal FROM scored WHERE scenario = 'Baseline'""",
)
def roundtrip(spark, sf):
    """Scores before saving and after loading: all rows must agree."""
    p = parts(spark, sf)
    model = models.fit(p["train"], SPEC, models.logistic(p["train"].count()))
    path = shared_folder(spark)
    model.write().overwrite().save(path)
    before = models.score(model, p["test"], SPEC).withColumnRenamed("Probability", "p0")
    after = models.score(PipelineModel.load(path), before.drop("Prediction"), SPEC)
    return after.agg(
        F.count("*").alias("n_rows"), F.count(F.when(F.col("p0") == F.col("Probability"), 1)).alias("n_equal")
    )


@query(
    "scored_test_set",
    *PARTS_SQL,
    "fitted AS (SELECT "
    + ", ".join(f"avg({f}) AS m_{f}, coalesce(nullif(stddev_pop({f}), 0e0), 1e0) AS s_{f}" for f in SPEC.features)
    + f" FROM base_parts WHERE split = 'train' AND {COMPLETE})",
    "SELECT Class, count(*) AS n_rows, true AS classes_follow, "
    + ", ".join(f"{o.r(f, f'avg({f})')}, {o.r(f'{f}_z', f'avg(({f} - m_{f}) / s_{f})')}, {o.r(f'{f}_square', f'avg(pow(({f} - m_{f}) / s_{f}, 2))')}" for f in SPEC.features)
    + " FROM base_parts, fitted WHERE split = 'test' GROUP BY Class",
)
def scored_test(spark, sf):
    """The stored test set summed up by class: raw features, features scaled by the training rows, predicted classes."""
    p = parts(spark, sf)
    model = models.fit(p["train"], SPEC, models.logistic(p["train"].count()))
    rows = models.scored_test_set(model, p["test"], SPEC)
    z = lambda f: F.col(f"{f}_z")
    follows = F.col(SPEC.prediction) == (F.col(SPEC.score) > d(0.5)).cast("int")
    aggs = [a for f in SPEC.features for a in (F.avg(f).alias(f), F.avg(z(f)).alias(f"{f}_z"), F.avg(z(f) * z(f)).alias(f"{f}_square"))]
    return rounded(rows.groupBy("Class").agg(F.count("*").alias("n_rows"), F.bool_and(follows).alias("classes_follow"), *aggs))


SHOWN = ["scenario", *KEYS]


@query(
    "scored_preview",
    *o.OBS,
    f"""shown AS (SELECT CAST(row_number() OVER (ORDER BY {', '.join(SHOWN)}) AS INTEGER) AS place, *, {COMPLETE} AS complete,
      count(*) OVER () AS n_total FROM obs WHERE scenario <> 'Baseline')""",
    f"""SELECT place, {', '.join(SHOWN)}, {', '.join(o.r(f) for f in SPEC.features)}, Class, n_total,
      CASE WHEN complete THEN true END AS label_follows FROM shown WHERE place <= 100""",
)
def preview(spark, sf):
    """The first hundred scored rows by scenario and key, of how many."""
    p = parts(spark, sf)
    model = models.fit(p["train"], SPEC, models.logistic(p["train"].count()))
    rows = reports.preview(models.score_with_threshold(model, p["batches"], SPEC), SHOWN)
    follows = F.col("prediction") == (F.col("probability") >= d(0.5)).cast("int")
    return rounded(rows.select("place", *SHOWN, *SPEC.features, "Class", "n_total", follows.alias("label_follows")))
