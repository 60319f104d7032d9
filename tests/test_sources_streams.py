"""Readers, the stored profile and the streaming checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftspark.functions.display import rounded
from shiftspark.operators import drift, evaluate, psi
from shiftspark.operators import profile as profile_ops
from shiftspark.plans import monitoring
from shiftspark.plans.catalog_streams import event_profile
from shiftspark.plans.fixtures import EVENT_SPEC, OBS_SPEC, event_columns, event_obs, obs
from shiftspark.sources import readers
from shiftspark.sources.profile_store import grow_profile, read_profile, write_profile
from shiftspark.sources.writers import shared_folder, stored, write_csv
from shiftspark.spec import RATIO_POLICY, ObsSpec
from shiftspark.streaming import checks
from tests.conftest import SMALL

AB = ObsSpec(features=("a", "b"))


def test_csv_columns_in_any_order_and_missing(spark, tmp_path):
    (tmp_path / "one.csv").write_text("Class,b,a\n1,2.5,\n0,,7\n")
    (tmp_path / "two.csv").write_text("a,Class\n4,1\n")
    t = readers.read_batches(spark, {"one": str(tmp_path / "one.csv"), "two": str(tmp_path / "two.csv")}, AB)
    got = {(r["scenario"], r["a"], r["b"], r["Class"]) for r in t.collect()}
    assert got == {("one", None, 2.5, 1), ("one", 7.0, None, 0), ("two", 4.0, None, 1)}
    with pytest.raises(ValueError, match="b"):
        readers.read_labelled(spark, str(tmp_path / "two.csv"), AB)


@pytest.mark.parametrize("small", [True, False])
def test_two_hundred_files_of_changing_columns_in_one_scan(spark, tmp_path, monkeypatch, small):
    """Columns in any order, quoted names, absent columns, further columns whose text names a feature, a file without any."""
    monkeypatch.setattr(readers, "BROADCAST_BYTES", (1 << 20) if small else 0)
    rng, want = np.random.default_rng(8), set()
    for i in range(200):
        cols = [c for c in ("a", "b", "Class", "note") if rng.random() < 0.7 or c == "Class"]
        rng.shuffle(cols)
        rows = [{"a": i + 0.5, "b": -float(j), "Class": j % 2, "note": "a"} for j in range(2)]
        head = ",".join(f'"{c}"' if i % 3 == 0 else c for c in cols)
        lines = [",".join("" if c == "b" and i % 50 == 0 else str(r[c]) for c in cols) for r in rows]
        (tmp_path / f"batch {i}.csv").write_text("\n".join([head, *lines]) + "\n")
        for r in rows:
            get = lambda c: r[c] if c in cols and not (c == "b" and i % 50 == 0) else None
            want.add((f"batch {i}", get("a"), get("b"), r["Class"], get("note")))
    (tmp_path / "other.csv").write_text("x,y\n1,2\n")
    t = readers.read_files(spark, f"{tmp_path}/*.csv", AB, ("note",))
    got = [(r["scenario"], r["a"], r["b"], r["Class"], r["note"]) for r in t.collect()]
    assert len(got) == 400 and set(got) == want
    assert t._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan") == 1


def test_folder_scan_names_batches_by_file(spark, tmp_path):
    for name, v in (("drift 1", 1), ("drift_2", 2)):
        (tmp_path / f"{name}.csv").write_text(f"a,b\n{v},0\n")
    t = readers.read_folder(spark, str(tmp_path), "a double, b double", AB)
    assert {(r["scenario"], r["a"]) for r in t.collect()} == {("drift 1", 1.0), ("drift_2", 2.0)}


def test_shared_folder_follows_the_session():
    """The setting is fixed once a session runs, so a stand-in session carries it."""
    session = type("Session", (), {"conf": {"spark.checkpoint.dir": "/shared/place/"}})
    one, two = shared_folder(session), shared_folder(session)
    assert one.startswith("/shared/place/") and one != two


def test_stored_table_reads_back(spark, tmp_path):
    assert stored(spark.range(5), str(tmp_path / "t")).count() == 5


def test_profile_check_equals_direct_check(spark, tmp_path):
    table = obs(spark, SMALL)
    write_profile(table, OBS_SPEC, str(tmp_path / "p"))
    profile = read_profile(spark, OBS_SPEC, str(tmp_path / "p"))
    batches = table.filter("scenario <> 'Baseline'")
    cols = ["scenario", "n_drifted", "drift_share", "f1_score", "auc_roc", "retrain"]
    one = rounded(monitoring.batch_check(table, OBS_SPEC, RATIO_POLICY)).select(*cols)
    two = rounded(monitoring.profile_check(batches, profile, OBS_SPEC, RATIO_POLICY)).select(*cols)
    assert sorted(one.collect()) == sorted(two.collect())
    direct = rounded(drift.moment_shift(table, OBS_SPEC)).collect()
    assert sorted(direct) == sorted(rounded(monitoring.profile_shift(batches, profile, OBS_SPEC)).collect())


def days(spark, tmp_path, n_files):
    """Event days after the baseline as a folder of files, one stream batch each."""
    later = event_obs(spark, SMALL).filter("scenario <> 'Baseline'")
    path = str(tmp_path / "in")
    later.repartitionByRange(n_files, "scenario").write.parquet(path)
    return spark.readStream.schema(later.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_in_several_batches_equals_batch(spark, tmp_path):
    profile = event_profile(spark, SMALL)
    out = str(tmp_path / "out")
    checks.start_batch_check(days(spark, tmp_path, 3), profile, EVENT_SPEC, RATIO_POLICY, out, out + "/c").awaitTermination()
    got = spark.read.parquet(out + "/checks")
    assert got.select("batch_id").distinct().count() == 3
    want = rounded(monitoring.batch_check(event_obs(spark, SMALL), EVENT_SPEC, RATIO_POLICY)).select("scenario", "n_drifted", "f1_score", "retrain")
    assert sorted(rounded(got.select(*want.columns)).collect()) == sorted(want.collect())
    alerts = spark.read.parquet(out + "/alerts")
    assert alerts.count() == got.filter("retrain").count() and alerts.filter("NOT retrain").count() == 0


def test_windowed_psi_has_all_days_and_equals_batch(spark, tmp_path):
    """The windows of the last days are open when the input ends; a day's rows come in several batches."""
    profile = event_profile(spark, SMALL)
    mixed = event_obs(spark, SMALL).filter("scenario <> 'Baseline'")
    mixed.repartition(3, "event_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(mixed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cells = checks.windowed_bins(stream, profile, EVENT_SPEC, late="40 days")
    cells = checks.run_to_table(cells, ["day", "feature", "bin"], str(tmp_path / "b"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "b")).select("batch_id").distinct().count() == 3
    got = {(r["scenario"], r["feature"]): r["psi"] for r in checks.windowed_psi(cells, profile, EVENT_SPEC).collect()}
    want = {(r["scenario"], r["feature"]): r["psi"] for r in psi.psi_table(event_obs(spark, SMALL), EVENT_SPEC).collect()}
    assert len(got) == 2 * mixed.select("scenario").distinct().count() and got == pytest.approx(want)


def test_a_batch_run_again_leaves_no_double_counts(spark, tmp_path):
    schema = spark.createDataFrame([], "day string, bin int, n long").schema
    out = str(tmp_path / "t")
    assert checks.latest(spark, schema, ["day", "bin"], out).count() == 0
    for batch_id, rows in ((0, [("a", 1, 5), ("a", 2, 1)]), (1, [("a", 1, 9), ("b", 1, 2)]), (1, [("a", 1, 8), ("b", 1, 2)])):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    assert sorted(map(tuple, checks.latest(spark, schema, ["day", "bin"], out).collect())) == [("a", 1, 8), ("a", 2, 1), ("b", 1, 2)]


@pytest.mark.parametrize("bins", [5, 200])
def test_daily_auc_is_as_near_as_it_says(spark, tmp_path, bins):
    table = event_obs(spark, SMALL)
    cuts = checks.score_cuts(table.filter("scenario = 'Baseline'"), EVENT_SPEC, bins)
    assert len(cuts) <= bins and cuts == sorted(set(cuts))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    cells = checks.run_to_table(checks.daily_cells(stream, EVENT_SPEC, cuts), ["day", "bin"], str(tmp_path / "o"), str(tmp_path / "c"))
    daily = table.withColumn("scenario", F.date_format("ts", "yyyy-MM-dd"))
    exact = {r["scenario"]: r for r in evaluate.evaluate(daily, EVENT_SPEC).collect()}
    found = checks.daily_metrics(cells).withColumn("day", F.date_format("day", "yyyy-MM-dd")).collect()
    assert {r["day"] for r in found} == set(exact)
    off = []
    for r in found:
        e = exact[r["day"]]
        assert (r["n_rows"], r["tp"], r["f1_score"]) == (e["n_rows"], e["tp"], pytest.approx(e["f1_score"]))
        if e["auc_roc"] is not None:
            assert abs(r["auc_roc"] - e["auc_roc"]) <= r["auc_error"] + 1e-12
            off.append(r["auc_error"])
    assert off and max(off) < (0.5 if bins == 5 else 0.05)


def test_a_small_batch_reads_few_slots_and_gets_exact_distances(spark, tmp_path):
    base = spark.range(4000).select(F.lit("Baseline").alias("scenario"), F.sqrt("id").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    batch = spark.createDataFrame([("P", 7.0, 1.0), ("P", 7.01, 1.0), ("P", 41.5, 9.0)], "scenario string, a double, b double")
    more = lambda df: df.withColumns({"Class": F.lit(0), "Probability": F.lit(0.2), "Prediction": F.lit(0)})
    write_profile(more(base), AB, str(tmp_path / "p"), rows_per_slot=100)
    profile = read_profile(spark, AB, str(tmp_path / "p"))
    assert len(profile.layout.cuts["a"]) == 39
    counts = drift.value_counts(batch, AB)
    near = profile.around(counts)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(segment" in plan and "slot" in plan.split("PartitionFilters")[1][:300]
    assert near.filter("feature = 'a'").count() < 2 * 101 + 40
    cols = ["feature", "ks_statistic", "n_baseline", "n_prod"]
    got = drift.ks_from_counts(counts.unionByName(near), AB, profile.layout).select(cols).collect()
    want = drift.ks_test(base.unionByName(batch), AB).select(cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_grown_profile_equals_the_profile_of_all_rows(spark, tmp_path):
    table = obs(spark, SMALL)
    base = table.filter("scenario = 'Baseline'")
    third = F.pmod("l_orderkey", F.lit(3))
    ends = base.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in OBS_SPEC.features for f in (F.min, F.max)]).first()
    # the first part holds the ends of every range, so the edges are those of all rows
    first = (third == 0) | F.lit(False)
    for c in OBS_SPEC.features:
        first = first | F.col(c).isin(ends[f"min_{c}"], ends[f"max_{c}"])
    first = F.coalesce(first, F.lit(False))
    write_profile(base, OBS_SPEC, str(tmp_path / "all"), rows_per_slot=50)
    grown = str(tmp_path / "grown")
    write_profile(base.filter(first), OBS_SPEC, grown, rows_per_slot=50)
    grow_profile(base.filter(~first & (third == 1)), OBS_SPEC, grown)
    grow_profile(base.filter(~first & (third != 1)), OBS_SPEC, grown)
    one, two = read_profile(spark, OBS_SPEC, str(tmp_path / "all")), read_profile(spark, OBS_SPEC, grown)
    assert one.edges == two.edges and one.metrics == pytest.approx(two.metrics)
    assert sorted(one.bins.collect()) == sorted(two.bins.collect())
    assert sorted(rounded(one.moments).collect()) == sorted(rounded(two.moments).collect())
    direct = profile_ops.feature_moments(base, OBS_SPEC).select(one.moments.columns)
    assert sorted(rounded(direct).collect()) == sorted(rounded(two.moments).collect())
    batches = table.filter("scenario <> 'Baseline'")
    checked = [rounded(monitoring.profile_check(batches, p, OBS_SPEC, RATIO_POLICY)).collect() for p in (one, two)]
    assert sorted(map(str, checked[0])) == sorted(map(str, checked[1]))


def test_an_unfinished_segment_is_not_seen(spark, tmp_path):
    table = obs(spark, SMALL)
    write_profile(table, OBS_SPEC, str(tmp_path / "p"))
    before = sorted(read_profile(spark, OBS_SPEC, str(tmp_path / "p")).bins.collect())
    for name in ("counts", "totals", "moments", "bins"):
        rows = spark.read.parquet(str(tmp_path / "p" / name / "segment=0"))
        rows.write.partitionBy(*["slot"] * (name == "counts")).parquet(str(tmp_path / "p" / name / "segment=1"))
    assert sorted(read_profile(spark, OBS_SPEC, str(tmp_path / "p")).bins.collect()) == before


def test_event_columns_are_the_same_in_batch_and_stream(spark):
    assert "ts" in event_columns(spark.read.parquet(f"{SMALL}/events.parquet")).columns
    assert dict(event_obs(spark, SMALL).dtypes)["ts"] == "timestamp"
    assert event_obs(spark, SMALL).filter(F.col("k").isNull()).count() == 0
