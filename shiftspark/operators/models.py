"""Training, scoring and choice of classifiers with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.functions.stats import d, known
from shiftspark.operators.evaluate import default_label, evaluate, label_at
from shiftspark.operators.forest import Forest
from shiftspark.operators.prepare import fit_scaler, scaler_stage
from shiftspark.operators.select import demand
from shiftspark.spec import DEFAULT_THRESHOLD, ObsSpec


def logistic(n_rows: int) -> LogisticRegression:
    """L2 penalty of strength 1 on the summed loss; Spark averages the loss over the rows."""
    return LogisticRegression(
        maxIter=1000, regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0, standardization=False
    )


def forest(trees: int = 100, depth: int = 8, seed: int = 42) -> Forest:
    return Forest(numTrees=trees, maxDepth=depth, seed=seed)


def boosted(rounds: int = 20, depth: int = 5, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed)


def fit(train: DataFrame, spec: ObsSpec, estimator: Estimator) -> PipelineModel:
    """Scaler, vector and classifier as one fitted pipeline.

    Training rows with a missing feature or label are left out."""
    features = list(spec.features)
    complete = train.filter(F.col(spec.label).isNotNull())
    for f in features:
        complete = complete.filter(known(f).isNotNull())
    scaler = scaler_stage(fit_scaler(complete, features))
    vector = VectorAssembler(inputCols=[f"{f}_z" for f in features], outputCol="_x", handleInvalid="keep")
    estimator = estimator.copy(
        {estimator.getParam("featuresCol"): "_x", estimator.getParam("labelCol"): spec.label}
    )
    return Pipeline(stages=[scaler, vector, estimator]).fit(complete)


def score(model: PipelineModel, df: DataFrame, spec: ObsSpec, keep_scaled: bool = False) -> DataFrame:
    """Input columns with the positive-class probability and the default class.

    A row with a missing feature gets neither."""
    features = list(spec.features)
    demand(df, features, numeric=features)
    complete = F.lit(True)
    for f in features:
        complete = complete & known(f).isNotNull()
    out = model.transform(df)
    prob = F.when(complete, vector_to_array("probability").getItem(1))
    kept = [c for c in df.columns if c not in (spec.score, spec.prediction)]
    scaled = [f"{f}_z" for f in features] if keep_scaled else []
    return out.select(*kept, *scaled, prob.alias(spec.score)).withColumn(
        spec.prediction, default_label(F.col(spec.score))
    )


def score_with_threshold(
    model: PipelineModel, df: DataFrame, spec: ObsSpec, threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """Batch scoring of rows whose columns come in any order: input columns,
    ``probability`` and the label at the threshold."""
    scored = score(model, df, spec)
    return scored.select(*df.columns, F.col(spec.score).alias("probability")).withColumn(
        "prediction", label_at(F.col("probability"), threshold)
    )


def feature_importance(model: PipelineModel, spec: ObsSpec) -> DataFrame:
    """(feature, importance, rank): gain shares that add up to 1."""
    weights = [float(x) for x in model.stages[-1].featureImportances.toArray()]
    order = sorted(range(len(weights)), key=lambda i: (-weights[i], spec.features[i]))
    rows = [(spec.features[i], weights[i], r + 1) for r, i in enumerate(order)]
    from pyspark.sql import SparkSession

    return SparkSession.active().createDataFrame(rows, "feature string, importance double, rank int")


def choose(models: dict[str, PipelineModel], test: DataFrame, spec: ObsSpec) -> DataFrame:
    """Test metrics per model with the chosen one marked: the higher F1, and
    on a tie the one that stands first in ``models``."""
    scored = None
    for i, (name, m) in enumerate(models.items()):
        part = score(m, test, spec).withColumn("model", F.lit(name)).withColumn("preference", F.lit(i))
        scored = part if scored is None else scored.unionByName(part)
    rows = evaluate(scored.withColumn(spec.scenario, F.col("model")), spec).withColumnRenamed("scenario", "model")
    prefer = F.create_map(*[F.lit(x) for i, n in enumerate(models) for x in (n, i)])
    ranked = rows.withColumn("preference", prefer[F.col("model")])
    best = ranked.agg(F.max_by("model", F.struct(F.col("f1_score"), -F.col("preference")))).scalar()
    return ranked.withColumn("chosen", F.col("model") == best).drop("preference")


def scored_test_set(model: PipelineModel, test: DataFrame, spec: ObsSpec) -> DataFrame:
    """Raw and scaled features with label, class and probability, for later comparison."""
    scored = score(model, test, spec, keep_scaled=True)
    return scored.select(
        *spec.features, *[f"{f}_z" for f in spec.features], spec.label, spec.prediction, spec.score
    )
