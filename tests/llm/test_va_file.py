"""Clustering by a VA-file against plain Lloyd's rounds in whole numbers."""

import collections
import hashlib

import numpy as np
import pytest

from shiftspark.llm import va_file
from shiftspark.llm.va_file import Grid, cluster, exact

COLUMNS = "vec_id long, embedding array<double>, label int, key long, v string, cluster int"


def brute(rows, k, dims, scale, rounds, seed=3):
    fine = [(i, [int(np.floor(scale * x)) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    name = lambda r: hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centroids = [v for _, v in sorted(fine, key=lambda r: (name(r), r[1]))[:k]]
    square = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for at in range(rounds + 1):
        near = [min((square(v, c), j) for j, c in enumerate(centroids)) for _, v in fine]
        for j in range(len(centroids)) if at < rounds else ():
            own = [v for (_, v), (_, c) in zip(fine, near) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    by = collections.Counter()
    for d, j in near:
        by[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return collections.Counter((i, j, d, by[j], sum(by.values()), sha[j]) for (i, _), (d, j) in zip(fine, near))


def found(df):
    return collections.Counter(tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_clusters_equal_plain_rounds_on_hostile_rows(spark, bits):
    rng = np.random.default_rng(bits)
    middles = rng.normal(size=(5, 6))
    rows = [(i, (middles[i % 5] + 0.4 * rng.normal(size=6)).tolist()) for i in range(160)]
    rows += [(1000 + i, [0.25] * 6) for i in range(60)] + [(7, [0.25] * 6)] * 3  # ties, repeated rows
    rows += [(None, [1.0] * 6), (None, [-1.0] * 6), (2001, None), (2002, []), (2003, [1.0] * 5), (2004, [1.0] * 5 + [None]), (2005, [float("nan")] * 6), (2006, [float("inf")] * 6)]
    df = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], COLUMNS).repartition(4)
    assert found(cluster(df, 4, 6, 1024, 3, bits=bits)) == brute(rows, 4, 6, 1024, 3)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [0.5, -0.5]), (2, [0.5, -0.5]), (3, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(cluster(df, 8, 2, 16, 2)) == brute(rows, 8, 2, 16, 2)
    assert cluster(df.limit(0), 8, 2).count() == 0 and cluster(df, 8, 64).count() == 0


def test_a_component_without_exact_distances_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="would not fit"):
        cluster(df, 2, 2)


def test_candidates_always_hold_the_nearest_and_leave_few_open():
    rng = np.random.default_rng(0)
    centroids = rng.integers(-800, 800, (7, 16))
    v = centroids[rng.integers(0, 7, 3000)] + rng.integers(-120, 121, (3000, 16))
    share = []
    for bits in (1, 4, 6):
        grid = Grid(v[:500], v.min(0), v.max(0), bits)
        cells = grid.unpacked(grid.packed(v))
        assert (cells == grid.cells(v)).all()
        assert (np.take_along_axis(grid.low.T, cells, 0) <= v).all() and (v <= np.take_along_axis(grid.high.T, cells, 0)).all()
        lead, open_ = grid.candidates(cells, *grid.tables(centroids))
        nearest = ((v[:, None] - centroids[None]) ** 2).sum(2).argmin(1)
        assert open_[np.arange(len(v)), nearest].all() and open_[np.arange(len(v)), lead].all()
        assert (exact(v, open_, centroids)[0] == nearest).all()
        share.append((open_.sum(1) > 1).mean())
    assert share[0] > share[1] >= share[2] and share[2] < 0.02


def test_only_open_or_moved_vectors_are_fetched(spark, monkeypatch):
    """Well apart clusters: after the first round, which places all vectors, next to none are read in full."""
    rng = np.random.default_rng(3)
    rows = [(i, ([4.0 * (i % 3)] * 8 + rng.normal(size=8) * 0.1).tolist()) for i in range(600)]
    rows = rows[:3] + [r for r in rows if r[0] >= 3]
    fetched = []
    plain = va_file.kept

    def seen(df, path=None):
        out = plain(df, path)
        if "fetch" in out.columns:
            fetched.append(out.filter("fetch").count())
        return out

    monkeypatch.setattr(va_file, "kept", seen)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(cluster(df, 3, 8, 1024, 4)) == brute(rows, 3, 8, 1024, 4)
    assert fetched[0] == 600 and fetched[-1] < 300
