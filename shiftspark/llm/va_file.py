"""K-means over vectors of whole numbers by a VA-file: assignments are made from few-bit approximations where these decide.

Every dimension is cut into 2^bits cells; a vector's approximation is its cell numbers, packed. For a round's centroids a table gives, for
each dimension and cell, the least that the dimension can add to the distance of a centroid over that of another one. A vector's
leading centroid (nearest to the cells' middles) is compared so with all others: sums of table entries bound how much nearer any other
can be. Those whose bounds allow it are candidates. The part of both distances that is the same for all centroids cancels, so
these intervals are much narrower than those of the distances themselves. Only a vector with candidates, or one that changes its
cluster and so its sums, is fetched in full, by a join with the bucketed table of vectors; among the candidates the exact distance decides.

Sums and counts of the clusters are carried on by what fetched vectors add and take away, so they are exact in every round. The driver holds centroids,
sums and one table of cells: clusters x dimensions x cells numbers, whatever the rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftspark.llm.common import discard, kept, raw, scratch

#: Bits of a cell number; sampled vectors that place the cells' borders (all vectors are approximated).
BITS, SAMPLE_ROWS = 6, 65_536
#: Largest component, in whole steps: squared distances of thousands of dimensions stay exact in a long.
LARGEST = 1 << 25


class Grid:
    """Cells of every dimension: cell j of dimension d holds the whole numbers from low[d, j] to high[d, j]."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int):
        self.bits, cells = bits, 1 << bits
        cuts = [np.quantile(sample[:, d], np.arange(1, cells) / cells, method="lower") for d in range(sample.shape[1])]
        self.cuts = np.clip(np.array(cuts, np.int64).reshape(-1, cells - 1), least[:, None], most[:, None])
        self.low = np.concatenate([least[:, None], self.cuts], 1)
        self.high = np.maximum(np.concatenate([self.cuts - 1, most[:, None]], 1), self.low)

    def cells(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.cuts[d], v[:, d], side="right") for d in range(v.shape[1])], 1).astype(np.uint8)

    def packed(self, v: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(self.cells(v)[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return np.packbits(bits.reshape(len(v), -1), axis=1)

    def unpacked(self, packed: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(packed, axis=1)[:, : len(self.cuts) * self.bits].reshape(len(packed), -1, self.bits)
        return bits @ (1 << np.arange(self.bits)[::-1]).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[d, cell, k]: squared distance from centroid k to the cell's middle; [b, d, cell, k]: the least that dimension d of a vector
        in the cell can add to its distance to k less that to b."""
        middle = (self.low + self.high)[:, :, None] / 2
        near = (middle - centroids.T[:, None, :]) ** 2
        step = centroids[None, :, :] - centroids[:, None, :]
        # (x - k)^2 - (x - b)^2 = k^2 - b^2 - 2 x (k - b), which is linear in x: its least lies at an end of the cell
        square = centroids[None, :, :] ** 2 - centroids[:, None, :] ** 2
        step, square = step.transpose(0, 2, 1)[:, :, None, :], square.transpose(0, 2, 1)[:, :, None, :]
        ends = [square - 2 * end[None, :, :, None] * step for end in (self.low, self.high)]
        return near, np.minimum(*ends)

    def candidates(self, cells: np.ndarray, near: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading centroid of each vector, and which centroids may be as near as it, itself included."""
        dims = range(cells.shape[1])
        lead = np.argmin(sum(near[d][cells[:, d]] for d in dims), 1) if len(cells) else np.zeros(0, np.int64)
        open_ = np.zeros((len(cells), near.shape[2]), bool)
        for b in np.unique(lead):
            of = np.flatnonzero(lead == b)
            open_[of] = sum(least[b, d][cells[of, d]] for d in dims) <= 0
        return lead, open_


def exact(v: np.ndarray, open_: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid among the candidates, the smaller number in ties, and its squared distance."""
    distance = np.full(open_.shape, np.iinfo(np.int64).max)
    for k in range(len(centroids)):
        of = np.flatnonzero(open_[:, k])
        distance[of, k] = ((v[of] - centroids[k]) ** 2).sum(1)
    nearest = distance.argmin(1)
    return nearest, distance[np.arange(len(v)), nearest]


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """A column of lists of equal length as rows."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def byte_rows(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def byte_matrix(col: pa.Array) -> np.ndarray:
    return raw(col.cast(pa.large_binary()))[0].reshape(len(col), -1)


def whole(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors of `dims` components, none null or not finite, as floor(scale * x)."""
    fine = (F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    steps = lambda x: F.floor(x.cast("double") * scale)
    large = F.raise_error(F.lit(f"a component is beyond {LARGEST} steps of 1/{scale}: squared distances would not fit")).cast("int")
    held = lambda x: F.when(F.abs(x.cast("double") * scale) < float(LARGEST), steps(x).cast("int")).otherwise(large)
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", held).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k smallest hashes of their ids; null ids hash like empty ones, repeated ids go by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in rows.select("v", order.alias("h")).orderBy("h", "v").limit(k).collect()], np.int64)


def cluster(vectors: DataFrame, k: int = 8, dims: int = 64, scale: int = 1024, rounds: int = 10, seed: int = 3, bits: int = BITS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept row of vectors (vec_id, embedding).

    Kept are vectors with exactly `dims` components, none null, NaN or infinite, as floor(scale * x); one beyond LARGEST steps is an
    error, as its distances would not fit. Lloyd's rounds start from the k vectors of smallest hash (all, if fewer), assign to the nearest
    centroid, ties to the smaller number, and replace non-empty centroids by floored means; then all are assigned once more. Null ids
    and repeated rows are vectors like any others; other columns are left aside. Without kept rows the result is empty.
    """
    spark = vectors.sparkSession
    kind = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = whole(vectors, dims, scale)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], kind)
    k = len(centroids)
    name, path = f"vectors_{uuid.uuid4().hex}", scratch(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = rows.withColumn("key", F.monotonically_increasing_id()).repartition(buckets, "key")
    stored.write.bucketBy(buckets, "key").option("path", path).saveAsTable(name)
    rows = spark.table(name)
    ends = rows.agg(*(f(F.col("v")[d]).alias(f"{f.__name__}{d}") for f in (F.min, F.max) for d in range(dims))).first()
    sample = matrix(rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS).select("v").toArrow()["v"].combine_chunks(), dims)
    grid = Grid(sample, np.array(ends[:dims], np.int64), np.array(ends[dims:], np.int64), bits)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            cells = byte_rows(grid.packed(matrix(batch.column("v"), dims)))
            yield pa.record_batch([batch.column("key"), cells, pa.array(np.full(batch.num_rows, -1, np.int32))], ["key", "cells", "old"])

    state = rows.select("key", "v").mapInArrow(approximate, "key long, cells binary, old int")
    sums, counts, folders = np.zeros((k, dims), object), np.zeros(k, object), []
    for at in range(rounds + 1):
        last = at == rounds
        looked = scratch(spark)
        bounded = kept(state.mapInArrow(bounds_of(grid, centroids), "key long, cells binary, old int, lead int, open binary, fetch boolean"), looked)
        need = bounded if last else bounded.filter("fetch")
        met = need.join(rows.select("key", "v", "vec_id"), "key").select("key", "vec_id", "cells", "old", "open", "v")
        fetched = scratch(spark)
        found = kept(met.mapInArrow(assigned_by(centroids, dims, last), FOUND), fetched)
        folders += [looked, fetched]
        if last:
            break
        change = found.filter("n is not null").groupBy("cluster")
        for r in change.agg(F.sum("n"), *(F.sum(F.col("sums")[d]) for d in range(dims))).collect():
            counts[r[0]] += r[1]
            sums[r[0]] += np.array(r[2:], object)
        centroids = np.array([[s // n for s in sums[c]] if n else centroids[c] for c, n in enumerate(counts)], np.int64)
        settled = bounded.filter("not fetch").select("key", "cells", F.col("lead").alias("old"))
        state = settled.union(found.filter("n is null").select("key", "cells", F.col("cluster").alias("old")))
        for old in folders[:-2]:
            discard(spark, old)
        folders = folders[-2:]
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    named = [(c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(inertia)]
    table = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    spark.sql(f"DROP TABLE {name}")
    for old in (path, looked):
        discard(spark, old)
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def bounds_of(grid: Grid, centroids: np.ndarray):
    """Arrow function: leading centroid and candidates of each vector from its cells, and whether the full vector is needed."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, least = grid.tables(centroids)
        for batch in filter(len, batches):
            lead, open_ = grid.candidates(grid.unpacked(byte_matrix(batch.column("cells"))), near, least)
            fetch = (open_.sum(1) > 1) | (lead != batch.column("old").to_numpy())
            more = [pa.array(lead.astype(np.int32)), byte_rows(np.packbits(open_, axis=1)), pa.array(fetch)]
            yield pa.record_batch([*(batch.column(c) for c in ("key", "cells", "old")), *more], ["key", "cells", "old", "lead", "open", "fetch"])

    return look


#: Fetched vectors with their cluster; in rounds, also rows without key that add up what a task's vectors changed: n and sums of a cluster.
FOUND = "key long, vec_id long, cells binary, cluster int, distance long, sums array<long>, n long"


def assigned_by(centroids: np.ndarray, dims: int, last: bool):
    """Arrow function: exact clusters of fetched vectors, then a row for each cluster with the change of its sums."""
    schema = pa.schema([("key", pa.int64()), ("vec_id", pa.int64()), ("cells", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64()), ("sums", pa.list_(pa.int64())), ("n", pa.int64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in filter(len, batches):
            n, v = batch.num_rows, matrix(batch.column("v"), dims)
            open_ = np.unpackbits(byte_matrix(batch.column("open")), axis=1)[:, :k].astype(bool)
            nearest, distance = exact(v, open_, centroids)
            old = batch.column("old").to_numpy()
            for c in range(k) if not last else ():
                came, went = (nearest == c) & (old != c), (old == c) & (nearest != c)
                sums[c] += v[came].sum(0) - v[went].sum(0)
                counts[c] += came.sum() - went.sum()
            cols = [batch.column("key"), batch.column("vec_id"), batch.column("cells"), pa.array(nearest.astype(np.int32)), pa.array(distance)]
            yield pa.record_batch([*cols, pa.nulls(n, schema.field("sums").type), pa.nulls(n, pa.int64())], schema=schema)
        if not last and (counts.any() or sums.any()):
            cols = [pa.nulls(k, schema.field(c).type) for c in ("key", "vec_id", "cells")]
            cols += [pa.array(np.arange(k, dtype=np.int32)), pa.nulls(k, pa.int64()), pa.array(sums.tolist(), pa.list_(pa.int64())), pa.array(counts)]
            yield pa.record_batch(cols, schema=schema)

    return assign
