"""The forest over counted rows, and the facts of a fitted model."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from shiftspark.operators import forest
from shiftspark.plans import catalog_models
from tests.conftest import SMALL


def frame(spark, x, y):
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"x{i}" for i in range(x.shape[1])]).assign(y=y.astype(np.int64)))
    return VectorAssembler(inputCols=[c for c in df.columns if c != "y"], outputCol="features").transform(df)


def learner(**kw):
    f = forest.Forest(**kw)
    return f.copy({f.getParam("featuresCol"): "features", f.getParam("labelCol"): "y"})


def test_rows_that_agree_are_counted_and_none_is_left_out(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 4, (20000, 2)).astype(float), rng.integers(0, 2, 20000)
    seen = []
    grow = forest.grow
    monkeypatch.setattr(forest, "grow", lambda cells, *a: seen.append(cells.collect()) or grow(cells, *a))
    learner(numTrees=2, maxDepth=2).fit(frame(spark, x, y))
    counts = np.concatenate([np.frombuffer(r["n"], np.int64) for r in seen[0]])
    assert len(counts) == 32 and counts.sum() == 20000


def test_leaves_are_the_shares_of_each_trees_own_sample(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    seen = []
    grow = forest.grow

    def kept(cells, *a):
        seen.append((cells.collect(), grow(cells, *a)))
        return seen[0][1]

    monkeypatch.setattr(forest, "grow", kept)
    model = learner(numTrees=5, maxDepth=4, seed=9).fit(frame(spark, x, y))
    blocks, (feature, cut, leaves, gains) = seen[0]
    zeros, ones = np.zeros((5, 16)), np.zeros((5, 16))
    for b in blocks:
        bins, label, n = np.frombuffer(b["cell"], np.uint8).reshape(-1, 3).T.copy(), np.frombuffer(b["y"], np.uint8), np.frombuffer(b["n"], np.int64)
        drawn = np.random.default_rng([9, zlib.crc32(b["cell"]), zlib.crc32(b["y"])])
        for t in range(5):
            w, at = drawn.poisson(n), forest.walk(bins, feature[t], cut[t], 4) - 15
            np.add.at(zeros[t], at, w * (label == 0))
            np.add.at(ones[t], at, w * (label == 1))
    met = zeros + ones > 0
    assert np.allclose(leaves[met], (ones / np.maximum(zeros + ones, 1))[met])
    assert gains.sum() == pytest.approx(1) and gains[2] < min(gains[:2])
    rows = model.transform(frame(spark, x, y)).select("probability", "y").collect()
    assert np.mean([(r["probability"][1] > 0.5) == r["y"] for r in rows]) > 0.9


def test_best_split_is_the_best_of_all():
    rng = np.random.default_rng(3)
    table = rng.integers(0, 5, (6, 2, 4, 2))
    table[5, :, 1:] = 0
    found = forest.best_splits(table, np.tile([3, 1], (6, 1)))
    impurity = lambda c: c.sum() * (1 - ((c / max(1, c.sum())) ** 2).sum())
    for i, node in enumerate(table):
        best = max((impurity(f.sum(0)) - impurity(f[: k + 1].sum(0)) - impurity(f[k + 1 :].sum(0))) / max(1, f.sum()) for f in node for k in range(3))
        assert found["gain"][i] == pytest.approx(max(0, best))
        f = node[[3, 1].index(found["feature"][i])]
        assert found["left0"][i] == f[: found["cut"][i] + 1, 0].sum() and found["right1"][i] == f[found["cut"][i] + 1 :, 1].sum()


def test_few_values_get_a_bin_each_and_many_share_them():
    few = forest.cuts_of(np.repeat([1.0, 2.0, 5.0], 300), 32)
    assert few.tolist() == [1.5, 3.5]
    many = forest.cuts_of(np.arange(1001.0), 32)
    assert len(many) == 31 and np.abs(np.diff(many) - 31.25).max() < 1


def test_one_class_and_one_value(spark):
    x = np.ones((50, 2))
    assert {r["probability"][1] for r in learner(numTrees=3, maxDepth=2).fit(frame(spark, x, np.ones(50))).transform(frame(spark, x, np.ones(50))).collect()} == {1.0}
    with pytest.raises(ValueError, match="0 or 1"):
        learner(numTrees=1).fit(frame(spark, x, np.full(50, 2)))


def test_facts_score_each_row_once(spark):
    p, scored = catalog_models.parts(spark, SMALL), spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<double>")
    def share(qty: pd.Series) -> pd.Series:
        scored.add(len(qty))
        return pd.Series([[1 - q / 100, q / 100] for q in qty])

    class Counting:
        def transform(self, df):
            return df.withColumn("probability", array_to_vector(share("qty")))

    got = catalog_models.facts(Counting(), p).collect()
    n = sum(r["n_rows"] for r in got)
    assert n == p["test"].unionByName(p["batches"]).count() and scored.value == n
