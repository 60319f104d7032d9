"""Shape of the executed plans: one scan, no products, only the needed columns."""

import re
from dataclasses import replace

import pytest

from shiftspark.operators import drift, evaluate, policy, prefix, profile, psi
from shiftspark.plans.fixtures import OBS_SPEC, obs, obs_two_scores
from tests.conftest import SMALL


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.fixture(scope="module")
def layout(spark):
    cols = [*OBS_SPEC.features, OBS_SPEC.score]
    return prefix.size_up(obs(spark, SMALL), "scenario", cols, n_buckets=8)


CASES = {
    "ks": lambda o, l: drift.ks_test(o, OBS_SPEC, layout=l),
    "quantiles": lambda o, l: profile.exact_quantiles(o, OBS_SPEC, {"m": 0.5}, l),
    "evaluate": lambda o, l: evaluate.evaluate(o, OBS_SPEC, l),
    "roc": lambda o, l: evaluate.roc_curve(o, OBS_SPEC, l),
    "psi": lambda o, l: psi.psi_table(o, OBS_SPEC),
    "moments": lambda o, l: profile.feature_moments(o, OBS_SPEC),
}


@pytest.mark.parametrize("name", list(CASES))
def test_one_scan_and_no_product(spark, layout, name):
    plan = executed(CASES[name](obs(spark, SMALL), layout))
    assert plan.count("FileScan") == 1
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "SinglePartition" not in plan
    assert "Python" not in plan


def test_models_are_evaluated_over_one_scan_and_one_count(spark):
    models = {"one": ("Probability", "Prediction"), "two": ("Probability2", "Prediction2"), "again": ("Probability", "Prediction2")}
    rows = obs_two_scores(spark, SMALL)
    records = evaluate.evaluate_models(rows, OBS_SPEC, models)
    plan = executed(policy.champion_challenger(records))
    assert plan.count("FileScan") == 1 and "NestedLoopJoin" not in plan
    for name, (score, prediction) in models.items():
        alone = evaluate.evaluate(rows, replace(OBS_SPEC, score=score, prediction=prediction))
        own = records.filter(records.model == name).drop("model")
        assert sorted(map(str, own.collect())) == sorted(map(str, alone.select(own.columns).collect()))


def test_only_needed_columns_are_read(spark):
    plan = executed(evaluate.confusion(obs(spark, SMALL), OBS_SPEC))
    columns = re.search(r"ReadSchema: struct<(.*?)>", plan)
    scanned = re.search(r"FileScan parquet \[(.*?)\]", plan).group(1)
    assert "l_tax" not in scanned and "l_partkey" not in scanned, columns


def test_windows_never_hold_a_whole_feature(spark, layout):
    plan = executed(drift.ks_test(obs(spark, SMALL), OBS_SPEC, layout=layout))
    for spec in re.findall(r"windowspecdefinition\((.*?)value#", plan):
        assert "_bucket" in spec
