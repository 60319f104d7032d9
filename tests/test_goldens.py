"""Published results: confusion counts, metrics, deltas and decisions."""

import pytest
from pyspark.sql import functions as F

from shiftspark.operators import evaluate, policy, reports
from shiftspark.sources.readers import read_metrics
from shiftspark.sources.writers import write_json
from shiftspark.spec import CARD_FEATURES, COUNT_POLICY, RATIO_POLICY, ObsSpec

SPEC = ObsSpec(features=CARD_FEATURES)

# The published baseline record and the five batches.
BASELINE = {"f1_score": 0.8913043478260869, "auc_roc": 0.9480448932992767, "precision": 0.9647058823529412, "recall": 0.8282828282828283}
BATCHES = [
    ("Drift 1", 0.0, 0.418344, 0.0, 0.0),
    ("Drift 2", 0.0, 0.524605, 0.0, 0.0),
    ("Drift 3", 0.955556, 1.0, 1.0, 0.914894),
    ("Drift 4", 0.0, 0.554391, 0.0, 0.0),
    ("Drift 5", 0.636364, 0.873244, 1.0, 0.466667),
]
CELLS = [("Baseline", 56860, 3, 17, 82), ("Drift 3", 17906, 0, 8, 86), ("Drift 5", 14700, 0, 160, 140)]


def test_features_are_thirty():
    assert len(CARD_FEATURES) == 30 and CARD_FEATURES[1] == "V1" and CARD_FEATURES[-1] == "Amount"


def test_metrics_follow_from_the_cells(spark):
    cells = spark.createDataFrame(CELLS, "scenario string, tn long, fp long, fn long, tp long")
    got = {r["scenario"]: r for r in evaluate.with_prf(cells).collect()}
    assert got["Baseline"]["f1_score"] == pytest.approx(BASELINE["f1_score"], abs=1e-12)
    assert got["Baseline"]["precision"] == pytest.approx(BASELINE["precision"], abs=1e-12)
    assert got["Baseline"]["recall"] == pytest.approx(BASELINE["recall"], abs=1e-12)
    for name, f1, _, p, r in BATCHES:
        if name in got:
            assert (got[name]["f1_score"], got[name]["precision"], got[name]["recall"]) == pytest.approx((f1, p, r), abs=1e-6)


@pytest.fixture(scope="module")
def compared(spark):
    rows = spark.createDataFrame(BATCHES, "scenario string, f1_score double, auc_roc double, precision double, recall double")
    return evaluate.compare_with(rows, BASELINE)


def test_deltas(compared):
    for r in evaluate.deltas(compared, SPEC).collect():
        want = next(b for b in BATCHES if b[0] == r["scenario"])
        assert r["delta_f1_score"] == pytest.approx(want[1] - BASELINE["f1_score"], abs=1e-6)
        assert r["delta_auc_roc"] == pytest.approx(want[2] - BASELINE["auc_roc"], abs=1e-6)


def test_worst_is_the_first_of_the_tied(compared):
    assert evaluate.worst_scenario(compared, SPEC).first()["scenario"] == "Drift 1"


def test_decisions_without_drifted_features(compared):
    rows = compared.filter("scenario <> 'Baseline'").withColumns(
        {"n_drifted": F.lit(0).cast("long"), "n_tested": F.lit(30).cast("long"), "avg_psi": F.lit(0.0)}
    )
    status = {r["scenario"]: r["status"] for r in policy.count_policy(rows, COUNT_POLICY).collect()}
    assert status == {f"Drift {i}": ("OK" if i == 3 else "RETRAIN") for i in range(1, 6)}
    ratio = {r["scenario"]: r["retrain"] for r in policy.ratio_policy(rows, SPEC, RATIO_POLICY).collect()}
    assert ratio == {f"Drift {i}": i != 3 for i in range(1, 6)}


def test_baseline_record_is_read_nested_and_flat(spark, tmp_path):
    nested = tmp_path / "nested.json"
    flat = tmp_path / "flat.json"
    import json

    nested.write_text(json.dumps({"baseline_model": "GBT", "test_set_size": 5, "metrics": BASELINE}, indent=2))
    flat.write_text(json.dumps(BASELINE))
    a, b = read_metrics(spark, str(nested)).first(), read_metrics(spark, str(flat)).first()
    assert (a["baseline_model"], b["baseline_model"]) == ("GBT", "Random Forest")
    assert a["f1_score"] == b["f1_score"] == BASELINE["f1_score"]


def test_impact_report_shape(spark, compared, tmp_path):
    rows = compared.withColumns({"n_rows": F.lit(15000).cast("long"), "positive_rate": F.lit(0.002)})
    path = str(tmp_path / "impact")
    write_json(reports.impact_report(rows, SPEC, "Random Forest"), path)
    back = spark.read.json(path).first()
    assert back["baseline"]["metrics"]["recall"] == BASELINE["recall"]
    assert [s["scenario"] for s in back["drift_scenarios"]] == [b[0] for b in BATCHES]
    assert back["drift_scenarios"][2]["deltas"]["f1_score"] == pytest.approx(0.064252, abs=1e-6)
