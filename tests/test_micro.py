"""Hand-computed tables for the edges of every definition."""

import itertools
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from shiftspark.functions import stats
from shiftspark.functions.bins import bin_of
from shiftspark.functions.stats import d, grid_index
from shiftspark.operators import drift, evaluate, policy, prepare, profile, psi
from shiftspark.operators.select import strict_select, winsorize
from shiftspark.spec import COUNT_POLICY, INLINE_POLICY, RATIO_POLICY, ObsSpec, RatioPolicy

X = ObsSpec(features=("x",))


def ks_of(df):
    row = drift.ks_test(df, X).filter("scenario = 'P'").first()
    return (row["ks_statistic"], row["p_value"])


def test_ks_same(two_samples):
    assert ks_of(two_samples(range(1, 6), range(1, 6))) == (0.0, 1.0)


def test_ks_disjoint(two_samples):
    assert ks_of(two_samples(range(1, 6), range(11, 16)))[0] == 1.0


def test_ks_ties(two_samples):
    assert ks_of(two_samples([1, 1, 2, 3], [1, 2, 2, 3]))[0] == 0.25


def test_ks_ignores_missing_and_skips_empty(two_samples):
    df = two_samples([1, 2, None, float("nan")], [1, 2, float("nan")])
    assert ks_of(df)[0] == 0.0
    assert drift.ks_test(two_samples([1, 2], [None, float("nan")]), X).count() == 0
    assert drift.ks_test(two_samples([None], [1.0]), X).count() == 0


def psi_of(df, **kw):
    row = psi.psi_table(df, X, **kw).first()
    return row and row["psi"]


def test_psi_constant_baseline(two_samples):
    assert psi_of(two_samples([4, 4, 4], [1, 9])) == 0.0


def test_psi_empty_batch(two_samples):
    assert psi_of(two_samples([1, 2, 3], [None])) is None


def test_psi_mass_outside_is_in_no_bin(two_samples):
    df = two_samples(range(0, 11), [0, 1, 2, 3, 4, 50, 50, 50, 50, 50])
    edges = psi.psi_edges(df.filter("scenario = 'Baseline'"), ["x"])
    row = psi.bin_counts(df, X, edges).filter("scenario = 'P'").first()
    assert sum(row["bins"]) / row["n"] == 0.5
    ref = [1 / 11] * 9 + [2 / 11]
    got = [0.1] * 5 + [1e-6] * 5
    assert psi_of(df) == pytest.approx(sum((q - p) * math.log(q / p) for p, q in zip(ref, got)))
    assert psi_of(df, open_ends=True) != psi_of(df)


def test_psi_value_on_edge_goes_up(two_samples):
    df = two_samples([0, 10], [1.0])
    edges = psi.psi_edges(df.filter("scenario = 'Baseline'"), ["x"])
    assert psi.bin_counts(df, X, edges).filter("scenario = 'P'").first()["bins"][1] == 1


def test_cohens_d_of_constants_is_zero(two_samples):
    assert drift.moment_shift(two_samples([2, 2], [5, 5]), X).first()["cohens_d"] == 0.0


def test_mean_signs(two_samples):
    row = drift.moment_shift(two_samples([1, 3], [4, 8]), X).first()
    assert (row["mean_diff"], row["mean_shift"]) == (-4.0, 4.0)


SCORED = ObsSpec(features=())


def scored(spark, rows):
    return spark.createDataFrame(
        [("Baseline", y, s, int(s > 0.5)) for y, s in rows], "scenario string, Class int, Probability double, Prediction int"
    )


def test_auc_ties(spark):
    df = scored(spark, [(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8)])
    assert evaluate.auc(df, SCORED).first()["auc_roc"] == 0.875


def test_single_class(spark):
    row = evaluate.evaluate(scored(spark, [(0, 0.1), (0, 0.7)]), SCORED).first()
    assert row["auc_roc"] is None
    assert (row["precision"], row["recall"], row["f1_score"]) == (0.0, 0.0, 0.0)


def test_no_label_gives_null_record(spark):
    df = scored(spark, [(0, 0.1), (1, 0.7)])
    for without in (df.drop("Class"), df.withColumn("Class", F.lit(None).cast("int")), df.drop("Prediction")):
        row = evaluate.evaluate(without, SCORED).first()
        assert row["n_rows"] == 2 and row["f1_score"] is None and row["precision"] is None


def test_curves_end_points(spark):
    df = scored(spark, [(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8)])
    roc = {(r["fpr"], r["tpr"]) for r in evaluate.roc_curve(df, SCORED).collect()}
    assert roc == {(0.0, 0.0), (0.0, 0.5), (0.5, 1.0), (1.0, 1.0)}
    pr = {(r["precision"], r["recall"]) for r in evaluate.pr_curve(df, SCORED).collect()}
    assert (1.0, 0.0) in pr and (0.5, 1.0) in pr


def test_threshold_tie(spark):
    row = spark.range(1).select(
        evaluate.label_at(d(0.5)).alias("at"), evaluate.default_label(d(0.5)).alias("argmax")
    ).first()
    assert (row["at"], row["argmax"]) == (1, 0)


def test_sweep_on_exact_grid_points(spark):
    df = scored(spark, [(1, i / 100) for i in range(0, 101)])
    rows = {round(r["threshold"], 2): r["tp"] for r in evaluate.threshold_sweep(df, SCORED).collect()}
    assert rows == {i / 100: 101 - i for i in range(5, 96)}


def test_grid_index_is_exact(spark):
    df = spark.range(0, 1001).select((F.col("id") / d(1000)).alias("x"), "id")
    assert df.filter(grid_index(F.col("x"), 1000) != F.col("id")).count() == 0


def test_bins_are_exact(spark):
    df = spark.range(0, 61).select((d(0.1) + F.col("id") * ((d(0.7) - d(0.1)) / d(60))).alias("v"), "id")
    got = bin_of(F.col("v"), d(0.1), d(0.7), 60)
    assert df.filter(got != F.least("id", F.lit(59))).count() == 0


def test_scaler_keeps_shift_of_constant_feature(spark):
    train = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    scaler = prepare.fit_scaler(train, ["x"])
    later = spark.createDataFrame([(5.0,)], "x double")
    assert prepare.standardize(later, scaler).first()["x"] == 2.0
    assert prepare.scaler_stage(scaler).transform(later).first()["x_z"] == 2.0


def test_winsorize_keeps_missing(spark):
    long = spark.createDataFrame([("s", "x", None), ("s", "x", 99.0)], "scenario string, feature string, value double")
    bounds = spark.createDataFrame([("x", 0.0, 1.0)], "feature string, lo double, hi double")
    assert {r["value"] for r in winsorize(long, bounds).collect()} == {None, 1.0}


def test_a_table_that_does_not_fit_is_told_all_its_faults(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "id long, b string, c double")
    with pytest.raises(ValueError, match="b holds string and no numbers; d is absent"):
        strict_select(df, ["id", "b", "c", "d"], numeric=["id", "b", "c", "d"])
    assert strict_select(df, ["c", "id"], numeric=["c", "id"]).columns == ["c", "id"]


def test_strict_select_names_missing(spark):
    with pytest.raises(ValueError, match="b is absent; c is absent"):
        strict_select(spark.range(1), ["id", "b", "c"])


def rows_of(spark, *rows):
    cols = "scenario string, n_drifted long, n_tested long, f1_score double, auc_roc double, base_f1_score double, base_auc_roc double, avg_psi double"
    return spark.createDataFrame(rows, cols)


def test_count_policy_levels(spark):
    df = rows_of(
        spark,
        ("a", 8, 30, 0.9, 0.9, 0.9, 0.9, 0.0),
        ("b", 4, 30, 0.9, 0.9, 0.9, 0.9, 0.0),
        ("c", 3, 30, 0.9, 0.87, 0.9, 0.9, 0.0),
        ("d", 3, 30, 0.9, 0.9, 0.9, 0.9, 0.0),
        ("e", 0, 0, None, None, 0.9, 0.9, None),
    )
    full = {r["scenario"]: r for r in policy.count_policy(df, COUNT_POLICY).collect()}
    assert [full[k]["status"] for k in "abcde"] == ["RETRAIN", "WARNING", "WARNING", "OK", "OK"]
    assert full["a"]["reasons"] == ["8 features drifted"]
    assert full["e"]["drift_ratio"] == 0.0
    inline = {r["scenario"]: r["status"] for r in policy.count_policy(df, INLINE_POLICY).collect()}
    assert [inline[k] for k in "abcde"] == ["RETRAIN", "WARNING", "STABLE", "STABLE", "STABLE"]


def test_ratio_policy_rules(spark):
    spec = ObsSpec(features=tuple("abcdefghij"))
    df = rows_of(
        spark,
        ("at", 3, 10, 0.9, 0.9, 0.9, 0.9, 0.0),
        ("over", 4, 10, None, None, 0.9, 0.9, 0.0),
        ("nan_auc", 0, 10, 0.8, None, 0.9, 0.9, 0.0),
        ("calm", 0, 10, 0.9, 0.9, 0.9, 0.9, 0.9),
    )
    got = {r["scenario"]: r for r in policy.ratio_policy(df, spec, RATIO_POLICY).collect()}
    assert [got[k]["retrain"] for k in ("at", "over", "nan_auc", "calm")] == [False, True, True, False]
    assert got["over"]["reasons"] == ["4/10 features drifted (40.0% > 30%)"]
    assert got["nan_auc"]["reasons"] == ["F1 dropped 0.1000 (threshold 0.05)"]
    assert got["calm"]["alerts"] == ["All metrics within acceptable range - no retraining needed."]
    with_psi = policy.ratio_policy(df, spec, RatioPolicy(psi=0.2)).filter("scenario = 'calm'").first()
    assert with_psi["retrain"]


def test_health_edge(spark):
    row = spark.range(1).select(
        policy.health_label(d(0.3), F.lit(False), 0.3).alias("edge"),
        policy.health_label(d(0.0), F.lit(False), 0.3).alias("calm"),
        policy.health_label(d(0.1), F.lit(False), 0.3).alias("some"),
        policy.health_label(d(0.0), F.lit(True), 0.3).alias("forced"),
    ).first()
    assert tuple(row) == ("red", "green", "yellow", "red")


def test_overview_counts_nan_and_null(two_samples):
    row = profile.overview(two_samples([1, None], [float("nan")])).first()
    assert (row["n_rows"], row["n_columns"], row["n_missing"]) == (3, 2, 2)


def test_threshold_table_is_the_policy(spark):
    rows = [tuple(r) for r in policy.threshold_table(spark, RATIO_POLICY).collect()]
    assert ("% features drifted", "> 30%", "Trigger retrain") in rows and len(rows) == 6


def test_matrix_fill_and_order(spark):
    t = spark.createDataFrame(
        [("A", "x", 0.1), ("A", "y", 0.3), ("B", "x", 0.9)], "scenario string, feature string, ks_statistic double"
    )
    rows = drift.ks_matrix(t, ["A", "B"]).collect()
    assert [r["feature"] for r in rows] == ["x", "y"] and rows[1]["B"] == 0.0


def test_no_common_feature_gives_empty_tables(two_samples):
    df, other = two_samples([1, 2, 3], [2, 3, 4]), ObsSpec(features=("absent",))
    for table in (drift.ks_test, drift.drift_table, psi.psi_table, profile.feature_moments):
        empty = table(df, other)
        assert empty.count() == 0 and empty.dtypes == table(df, X).dtypes


def test_kernel_density_of_heavy_tails(spark):
    values = [math.exp(2.5 * (((i * 7919) % 2003) / 1001.5 - 1) * 1.7) for i in range(2003)] + [0.5] * 40
    df = spark.createDataFrame([("Baseline", v) for v in values], "scenario string, x double")
    rows = profile.kde_curve(df, X).filter("point % 37 = 0 or point between 245 and 275").collect()
    mean = sum(values) / len(values)
    h = math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1)) * len(values) ** -0.2
    assert len(rows) > 40
    for r in rows:
        want = sum(math.exp(-0.5 * ((r["x"] - v) / h) ** 2) for v in values) / (len(values) * h * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(want, rel=1e-6, abs=1e-12)


def paths_p(n1, n2, w):
    """Share of all orders of n1 + n2 values whose largest |i n2 - j n1| is at least w, in whole numbers."""
    hit = total = 0
    for ones in itertools.combinations(range(n1 + n2), n1):
        i = j = 0
        worst = 0
        for s in range(n1 + n2):
            i, j = (i + 1, j) if s in ones else (i, j + 1)
            worst = max(worst, abs(i * n2 - j * n1))
        hit, total = hit + (worst >= w), total + 1
    return float(Fraction(hit, total))


def test_exact_p_value_equals_all_orders_of_small_samples(spark):
    rows = [(n1, n2, w) for n1, n2 in ((1, 1), (2, 3), (4, 4), (5, 3), (6, 4), (7, 1)) for w in range(0, n1 * n2 + 1)]
    df = spark.createDataFrame([(w / (a * b), a, b, w) for a, b, w in rows], "d double, a long, b long, w int")
    for r in df.withColumn("p", stats.ks_pvalue_exact(F.col("d"), F.col("a"), F.col("b"))).collect():
        assert r["p"] == pytest.approx(paths_p(r["a"], r["b"], r["w"]), abs=1e-14), r


def test_exact_p_value_of_equal_samples_equals_the_reflection_sum(spark):
    """P(D >= h / n) = 2 sum (-1)^(k-1) C(2n, n + kh) / C(2n, n), from tiny to certain."""
    cases = [(n, h) for n, hs in ((50, (1, 9, 20, 45)), (400, (20, 60, 150, 399))) for h in hs]
    df = spark.createDataFrame([(h / n, n, h) for n, h in cases], "d double, n long, h int")
    for r in df.withColumn("p", stats.ks_pvalue_exact(F.col("d"), F.col("n"), F.col("n"))).collect():
        n, h = r["n"], r["h"]
        want = sum((-1) ** (k - 1) * math.comb(2 * n, n + k * h) for k in range(1, n // h + 1))
        assert r["p"] == pytest.approx(min(1.0, float(Fraction(2 * want, math.comb(2 * n, n)))), rel=1e-9)
