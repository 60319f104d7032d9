"""Bucketed running sums against brute force; skewed and random inputs."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shiftspark.operators import drift, evaluate, prefix, profile
from shiftspark.operators.small import attach
from shiftspark.plans.fixtures import OBS_SPEC, obs
from shiftspark.spec import ObsSpec
from tests.conftest import SMALL

X = ObsSpec(features=("x",))
SAMPLES = st.lists(st.integers(-6, 6), min_size=1, max_size=40)


def brute_ks(a, b):
    a, b = np.sort(a), np.sort(b)
    at = np.concatenate([a, b])
    return np.max(np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(base=SAMPLES, prod=SAMPLES, other=SAMPLES)
def test_ks_equals_brute_force(spark, two_samples, base, prod, other):
    df = two_samples(base, prod, Q=other).persist()
    want = {"P": brute_ks(base, prod), "Q": brute_ks(base, other)}
    for n in (1, 8):
        layout = prefix.size_up(df, "scenario", ["x"], n_buckets=n)
        got = {r["scenario"]: r["ks_statistic"] for r in drift.ks_test(df, X, layout=layout).collect()}
        assert got == pytest.approx(want, abs=1e-12)
    df.unpersist()


@pytest.mark.parametrize("n", [1, 2, 64, 4096])
def test_quantiles_equal_numpy(spark, two_samples, n):
    rng = np.random.default_rng(1)
    # A third of the rows share one value.
    values = np.where(rng.random(3000) < 0.34, 7.0, rng.normal(size=3000).round(3))
    df = two_samples(values, [1.0])
    layout = prefix.size_up(df, "scenario", ["x"], n_buckets=n)
    row = profile.exact_quantiles(df, X, {"a": 0.01, "b": 0.5, "c": 0.99}, layout).filter("scenario = 'Baseline'").first()
    assert (row["a"], row["b"], row["c"]) == pytest.approx(tuple(np.quantile(values, [0.01, 0.5, 0.99])), abs=1e-12)


@pytest.mark.parametrize("n", [1, 2, 64, 4096])
def test_auc_equals_pair_count_and_mirrors(spark, n):
    rng = np.random.default_rng(2)
    y = (rng.random(800) < 0.2).astype(int)
    s = np.where(rng.random(800) < 0.4, 0.5, rng.random(800).round(2))
    rows = [("Baseline", int(a), float(b), 0) for a, b in zip(y, s)] + [("M", int(a), -float(b), 0) for a, b in zip(y, s)]
    df = spark.createDataFrame(rows, "scenario string, Class int, Probability double, Prediction int")
    layout = prefix.size_up(df, "scenario", ["Probability"], n_buckets=n)
    got = {r["scenario"]: r["auc_roc"] for r in evaluate.auc(df, ObsSpec(features=()), layout).collect()}
    gaps = s[y == 1][:, None] - s[y == 0][None, :]
    assert got["Baseline"] == pytest.approx(((gaps > 0) + 0.5 * (gaps == 0)).mean(), abs=1e-12)
    assert got["Baseline"] + got["M"] == pytest.approx(1.0, abs=1e-12)


def test_bucket_number_never_changes_a_table(spark):
    df = obs(spark, SMALL)
    tables = {
        "ks": lambda l: drift.ks_test(df, OBS_SPEC, layout=l),
        "quantiles": lambda l: profile.exact_quantiles(df, OBS_SPEC, {"a": 0.01, "b": 0.37}, l),
        "roc": lambda l: evaluate.roc_curve(df, OBS_SPEC, l),
        "thin pr": lambda l: evaluate.pr_curve(df, OBS_SPEC, l, thin=True),
        "pr": lambda l: evaluate.pr_curve(df, OBS_SPEC, l),
        "evaluate": lambda l: evaluate.evaluate(df, OBS_SPEC, l),
        "histogram": lambda l: profile.density_histogram(df, OBS_SPEC, layout=l),
    }
    seen = {name: set() for name in tables}
    for n in (1, 2, 64, 4096):
        layout = prefix.size_up(df, "scenario", [*OBS_SPEC.features, OBS_SPEC.score], n_buckets=n)
        assert n < 4096 or len(layout.cuts["price"]) > 1500
        for name, table in tables.items():
            seen[name].add(tuple(sorted(map(str, table(layout).collect()))))
    assert {name: len(s) for name, s in seen.items()} == dict.fromkeys(tables, 1)


def test_ks_is_symmetric(spark, two_samples):
    a, b = [1, 2, 2, 5, 9], [2, 3, 5, 5]
    one = drift.ks_test(two_samples(a, b), X).first()["ks_statistic"]
    two = drift.ks_test(two_samples(b, a), X).first()["ks_statistic"]
    assert one == two


def test_buckets_split_a_hot_feature(spark, two_samples):
    df = two_samples(range(1000), range(500, 1500))
    layout = prefix.size_up(df, "scenario", ["x"], n_buckets=8)
    counts = drift.value_counts(df, X)
    sizes = [r["count"] for r in prefix.with_bucket(counts, "value", layout.cuts, by="feature").groupBy("_bucket").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


def test_refined_cuts_leave_no_bucket_overfull(spark):
    """Most rows in a narrow peak, a third in one value, the rest far out: two passes, and no bucket far over its share."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1e-6, 20_000), np.full(15_000, 0.5), 10 ** rng.uniform(-200, 200, 10_000)])
    long = spark.createDataFrame(pd.DataFrame({"value": x})).withColumn("feature", F.lit("x"))
    cuts = prefix.find_cuts(long, {"x": 3000}, 1.0)
    placed = prefix.with_bucket(long.distinct(), "value", cuts, by="feature")
    sizes = [r["count"] for r in placed.groupBy("_bucket").count().collect()]
    assert len(sizes) > 1500 and max(sizes) < 8 * 45_000 / 3000
    one = spark.createDataFrame([("x", 7.0)] * 50, "feature string, value double")
    assert len(set(prefix.find_cuts(one, {"x": 4000}, 1.0)["x"])) < 2


@pytest.mark.parametrize("small", [True, False])
def test_search_counts_the_cuts_up_to_a_value(spark, monkeypatch, small):
    """Trees of one, two and three levels, broadcast or met by key."""
    monkeypatch.setattr(prefix, "FANOUT", 4)
    if not small:
        monkeypatch.setattr(prefix, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(5)
    cuts = {"a": sorted(rng.normal(size=50).tolist()), "b": [0.0], "c": [], "d": sorted(rng.normal(size=15).tolist())}
    values = [*rng.normal(size=40).tolist(), *cuts["a"][::7], *cuts["d"][-3:], float("inf"), float("-inf"), 0.0]
    df = spark.createDataFrame([(k, v) for k in [*cuts, "e"] for v in values], "k string, v double")
    for r in prefix.with_bucket(df, "v", cuts, by="k").collect():
        assert r["_bucket"] == sum(c <= r["v"] for c in cuts.get(r["k"], []))
    for r in prefix.with_bucket(df, "v", {"a": cuts["a"]}).collect():
        assert r["_bucket"] == sum(c <= r["v"] for c in cuts["a"])


def test_rows_ask_for_their_buckets(spark, monkeypatch):
    monkeypatch.setattr(prefix, "ROWS_PER_BUCKET", 100)
    df = spark.range(2000).select(F.lit("Baseline").alias("scenario"), F.col("id").cast("double").alias("x"), F.when(F.col("id") < 90, 1.0).alias("y"))
    layout = prefix.size_up(df, "scenario", ["x", "y"], baseline="Baseline")
    assert (layout.rows, len(layout.cuts["x"]), layout.cuts["y"], layout.parts) == (2000, 19, [], 20)
    assert layout.ranges == {"x": (0.0, 1999.0), "y": (1.0, 1.0)}


def test_a_hot_key_meets_its_row_in_all_parts(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("b").alias("k"), "id")
    small = spark.createDataFrame([("hot", 1), ("b", 2), ("c", 3)], "k string, v int")
    joined = attach(big, small, ["k"], 8)
    assert joined.columns == ["k", "id", "v"] and joined.groupBy("v").count().orderBy("v").collect() == [(1, 900), (2, 100)]


@pytest.mark.parametrize("n", [1, 3, 64])
def test_thinned_curve_has_the_same_area_and_no_straight_points(spark, n):
    """Runs of single positives, of single negatives and of pairs make long straight pieces, across many buckets."""
    rng = np.random.default_rng(7)
    y, s = [], []
    for i, run in enumerate(rng.integers(1, 30, 60)):
        kind = i % 3
        for _ in range(run):
            at = float(len(set(s)))
            y += [[1], [0], [0, 1]][kind]
            s += [at] * len([[1], [0], [0, 1]][kind])
    df = spark.createDataFrame([("Baseline", a, b, 0) for a, b in zip(y, s)], "scenario string, Class int, Probability double, Prediction int")
    spec = ObsSpec(features=())
    layout = prefix.size_up(df, "scenario", ["Probability"], n_buckets=n)

    def points(curve, x, y):
        return sorted((r[x], r[y]) for r in curve.collect())

    area = lambda p: sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(p, p[1:]))
    full, thin = (points(evaluate.roc_curve(df, spec, layout, thin=t), "fpr", "tpr") for t in (False, True))
    assert set(thin) < set(full) and len(thin) < 70 and area(thin) == pytest.approx(area(full), abs=1e-12)
    # every full point lies on the thinned curve
    P, N = sum(y), len(y) - sum(y)
    for x, t in full:
        a = max(p for p in thin if p <= (x, t))
        b = min(p for p in thin if p >= (x, t))
        assert abs((b[0] - a[0]) * N * (t - a[1]) * P - (x - a[0]) * N * (b[1] - a[1]) * P) < 1e-6
    recalls = lambda t: {r["recall"] for r in evaluate.pr_curve(df, spec, layout, thin=t).collect()}
    assert recalls(True) == recalls(False)
