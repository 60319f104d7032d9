"""Queries whose result has a row for every row or value of the input, none left out or summed up."""

import datetime

import pytest

import __spark_entry__ as entry

COLUMNS = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate date"


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Baseline rows whose scores rise by equal steps, each with one negative; two batch rows."""
    at = lambda year: datetime.date(year, 3, 1)
    rows = [(i, 1, 1, 1, float(i), 100.0 * i, 0.0, 0.5, at(1996)) for i in range(1, 41)]
    rows += [(90, 1, 1, 2, 60.0, 50.0, 0.0, 0.5, at(1998)), (91, 1, 1, 2, 10.0, 50.0, 0.0, None, at(1998))]
    folder = tmp_path_factory.mktemp("lines")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_roc_curve_has_every_distinct_score(spark, lines):
    points = [r for r in entry.queries()["roc_curve"](spark, lines).collect() if r["scenario"] == "Baseline"]
    got = sorted((r["threshold"], r["fpr"]) for r in points if r["threshold"] is not None)
    assert got == [(pytest.approx((i + 3) / 120, abs=2e-6), pytest.approx((41 - i) / 40)) for i in range(1, 41)]
    assert sum(r["threshold"] is None for r in points) == 1


def test_standardize_has_every_row(spark, lines):
    got = {r["l_orderkey"]: r for r in entry.queries()["standardize"](spark, lines).collect()}
    assert sorted(got) == [*range(1, 41), 90, 91]
    mean, deviation = 20.5, (sum((i - 20.5) ** 2 for i in range(1, 41)) / 40) ** 0.5
    for i in (1, 7, 40, 90, 91):
        qty = {90: 60.0, 91: 10.0}.get(i, float(i))
        assert got[i]["qty"] == pytest.approx((qty - mean) / deviation, abs=2e-6)
    assert got[90]["scenario"] == "Drift 1" and got[90]["tax"] == 0.0 and got[91]["tax"] is None
