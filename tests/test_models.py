"""Split, training, scoring and model choice."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from shiftspark.functions.stats import d
from shiftspark.operators import evaluate, models, prepare
from shiftspark.plans.fixtures import OBS_SPEC, obs
from shiftspark.spec import ObsSpec
from tests.conftest import SMALL

KEYS = ["id"]
SPEC = ObsSpec(features=("a", "b"))


@pytest.fixture(scope="module")
def table(spark):
    """Two features that separate the classes almost, in no order."""
    u = F.pmod(F.xxhash64("id"), F.lit(1000)) / d(1000)
    v = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / d(1000)
    return spark.range(2000).select(
        "id", u.alias("a"), (v * d(10)).alias("b"), F.lit("Baseline").alias("scenario"), (u + v > d(1.2)).cast("int").alias("Class")
    ).persist()


@pytest.fixture(scope="module")
def parts(table):
    s = prepare.stratified_split(table, "Class", KEYS)
    return {n: s.filter(F.col("split") == n).drop("split") for n in ("train", "val", "test")}


def test_quotas():
    assert prepare.split_quotas({0: 90, 1: 10}) == {0: (54, 18, 18), 1: (6, 2, 2)}
    got = prepare.split_quotas({0: 7, 1: 4})
    assert sum(sum(q) for q in got.values()) == 11 and sum(q[1] + q[2] for q in got.values()) == 5


def test_split_meets_the_quotas_and_parts_are_disjoint(table, parts):
    sizes = {r["Class"]: r["count"] for r in table.groupBy("Class").count().collect()}
    want = prepare.split_quotas(sizes)
    for i, n in enumerate(("train", "val", "test")):
        got = {r["Class"]: r["count"] for r in parts[n].groupBy("Class").count().collect()}
        assert got == {c: q[i] for c, q in want.items()}
    assert sum(p.count() for p in parts.values()) == table.count()


def test_copies_stay_on_one_side(spark):
    """A third of the rows share one key."""
    df = spark.range(900).select(F.when(F.col("id") < 300, F.lit(7)).otherwise(F.col("id")).alias("id"), (F.col("id") % 2).cast("int").alias("Class"))
    s = prepare.stratified_split(df, "Class", ["id"])
    hot = s.filter("id = 7").groupBy("Class").agg(F.count_distinct("split").alias("k")).collect()
    assert {r["k"] for r in hot} == {1}
    assert s.filter("split IS NULL").count() == 0


@pytest.mark.parametrize("spread", [1, 1 << 31, -(1 << 33)])
def test_split_is_exact_where_one_hash_holds_all_rows(spark, spread):
    """Keys that agree modulo 2^31 share a hash: all rows lie in one range, which only the keys can cut."""
    df = spark.range(9000).select((F.col("id") * spread).alias("id"), (F.col("id") % 10 == 0).cast("int").alias("Class"))
    if spread != 1:
        assert df.select(prepare.row_hash(["id"])).distinct().count() == 1
    s = prepare.stratified_split(df, "Class", ["id"])
    got = {(r["Class"], r["split"]): r["count"] for r in s.groupBy("Class", "split").count().collect()}
    want = prepare.split_quotas({0: 8100, 1: 900})
    assert got == {(y, n): q for y, qs in want.items() for n, q in zip(("train", "val", "test"), qs)}


def test_ranks_are_found_in_any_order_columns(spark):
    rng = np.random.default_rng(6)
    rows = [(int(g), int(a), int(b)) for g, a, b in zip(rng.integers(0, 2, 3000), rng.integers(-3, 3, 3000), rng.integers(-(1 << 62), 1 << 62, 3000))]
    rows += [(0, 2, 5)] * 700
    df = spark.createDataFrame(rows, "g int, a long, b long")
    wanted = {(g, r): r for g in (0, 1) for r in (1, 17, 700, 1400)}
    got = prepare.cut_rows(df, "g", ["a", "b"], wanted, (-10, 10))
    for (g, r), row in got.items():
        assert row == sorted(x[1:] for x in rows if x[0] == g)[r - 1]
    assert set(got) == set(wanted)


def test_hash_split_is_about_right(table):
    n = {r["split"]: r["count"] for r in prepare.hash_split(table, KEYS).groupBy("split").count().collect()}
    assert abs(n["train"] / 2000 - 0.6) < 0.05


@pytest.mark.parametrize("make", [lambda: models.logistic(1200), lambda: models.forest(trees=20), lambda: models.boosted(rounds=5)])
def test_separable_classes_are_found(parts, make):
    model = models.fit(parts["train"], SPEC, make())
    row = evaluate.evaluate(models.score(model, parts["test"], SPEC), SPEC).first()
    assert row["auc_roc"] > 0.9 and row["n_rows"] == parts["test"].count()


def test_missing_feature_gives_no_score(parts):
    model = models.fit(parts["train"], SPEC, models.logistic(1200))
    holes = parts["test"].withColumn("a", F.when(F.col("id") % 2 == 0, F.col("a")))
    scored = models.score(model, holes, SPEC)
    assert scored.filter("a IS NULL AND Probability IS NOT NULL").count() == 0
    assert scored.filter("a IS NOT NULL AND Prediction IS NULL").count() == 0
    with pytest.raises(ValueError, match="b"):
        models.score(model, holes.drop("b"), SPEC)


def test_choice_prefers_the_first_on_a_tie(parts):
    m = models.fit(parts["train"], SPEC, models.logistic(1200))
    rows = {r["model"]: r["chosen"] for r in models.choose({"z first": m, "a second": m}, parts["test"], SPEC).collect()}
    assert rows == {"z first": True, "a second": False}


def test_saved_model_scores_alike(parts, tmp_path):
    m = models.fit(parts["train"], SPEC, models.forest(trees=5))
    m.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a = {r["id"]: r["Probability"] for r in models.score(m, parts["test"], SPEC).collect()}
    b = {r["id"]: r["Probability"] for r in models.score(again, parts["test"], SPEC).collect()}
    assert a == b


def test_threshold_and_test_set(parts):
    m = models.fit(parts["train"], SPEC, models.boosted(rounds=3))
    s = models.score_with_threshold(m, parts["test"].select("b", "Class", "a"), SPEC, 0.3)
    assert s.columns == ["b", "Class", "a", "probability", "prediction"]
    assert s.filter("(probability >= 0.3) <> (prediction = 1)").count() == 0
    kept = models.scored_test_set(m, parts["test"], SPEC)
    assert kept.columns == ["a", "b", "a_z", "b_z", "Class", "Prediction", "Probability"]
    weights = [r["importance"] for r in models.feature_importance(m, SPEC).orderBy("rank").collect()]
    assert weights == sorted(weights, reverse=True) and sum(weights) == pytest.approx(1.0)


def test_retraining_set_is_recent_plus_sample(spark):
    rows = prepare.retraining_set(obs(spark, SMALL), OBS_SPEC, 30, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    n = {r["origin"]: r["count"] for r in rows.groupBy("origin").count().collect()}
    base = obs(spark, SMALL).filter("scenario = 'Baseline'").count()
    assert abs(n["original"] / base - 0.3) < 0.05 and n["recent"] > 0
