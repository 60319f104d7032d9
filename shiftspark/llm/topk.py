"""Exact top-k inner products by a KD-tree for each shard.

Vectors are dealt to cells by median splits of a bounded sample, and cells with too many rows are split further by a hash, so every
shard has a bounded number of rows; all rows are indexed. In each shard a task builds a tree: median splits on the widest dimension,
with the tight bounding box of every node. A query walks a tree best node first. A box bounds the inner product of a query with all it
holds, and nothing is opened whose bound is below the k-th best score so far.

The k-th score is passed on: a query first searches the shard that holds it, and enters all others with the k-th score found there.
Queries meet shards as blocks of bounded size; each pair of block and shard is one task's group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from shiftspark.llm.common import kept

#: Rows of a shard, about; rows of a leaf; queries in a block; sampled rows that the cells are cut by, and least of them in a cell.
SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES, SAMPLE_ROWS, CELL_SAMPLE = 4096, 64, 8192, 8192, 16

#: Largest component when scaled.
LARGEST = 1 << 61


class Tree:
    """Boxes of all nodes and rows in leaf order; node i has children 2i + 1 and 2i + 2 if it is split."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order, self.split, self.spans = np.argsort(ids, kind="stable"), {}, {}
        lo, hi, todo = {}, {}, [(0, 0, len(ids))]
        while todo:
            node, a, b = todo.pop()
            own = rows[order[a:b]]
            lo[node], hi[node], self.spans[node] = own.min(0), own.max(0), (a, b)
            wide = int(np.argmax(hi[node] - lo[node])) if own.shape[1] else 0
            if b - a > LEAF_ROWS and own.shape[1] and hi[node][wide] > lo[node][wide]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, wide], mid)]
                self.split[node] = a + mid
                todo += [(2 * node + 1, a, a + mid), (2 * node + 2, a + mid, b)]
        self.nodes = sorted(lo)
        self.lo, self.hi = np.array([lo[n] for n in self.nodes], float), np.array([hi[n] for n in self.nodes], float)
        self.at = {n: i for i, n in enumerate(self.nodes)}
        self.ids, self.rows = ids[order], rows[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, what no inner product in the node's box exceeds."""
        q = queries.astype(float)
        up = np.maximum(q, 0) @ self.hi.T + np.minimum(q, 0) @ self.lo.T
        # rounding grows with the terms, which may cancel each other
        return up + np.abs(q) @ np.maximum(np.abs(self.lo), np.abs(self.hi)).T * 1e-9 + 1e-6

    def search(self, query: np.ndarray, own_id: int, bound: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
        """The up to k best (score, -id) of other ids that reach `least`, the k-th score so far; an id has its best score only."""
        best: list[tuple[int, int]] = []
        held: dict[int, int] = {}
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= least:
            node = heapq.heappop(heap)[1]
            if node in self.split:
                for child in (2 * node + 1, 2 * node + 2):
                    if bound[self.at[child]] >= least:
                        heapq.heappush(heap, (-bound[self.at[child]], child))
                continue
            a, b = self.spans[node]
            scores = self.rows[a:b] @ query
            for i in np.flatnonzero(scores >= least):
                if self.ids[a + i] != own_id:
                    entry = (int(scores[i]), -int(self.ids[a + i]))
                    if entry[1] in held:
                        if entry[0] > held[entry[1]]:
                            best[best.index((held[entry[1]], entry[1]))] = entry
                            heapq.heapify(best)
                            held[entry[1]] = entry[0]
                    elif len(best) < k:
                        heapq.heappush(best, entry)
                        held[entry[1]] = entry[0]
                    elif entry > best[0]:
                        del held[heapq.heapreplace(best, entry)[1]]
                        held[entry[1]] = entry[0]
            if len(best) == k:
                least = max(least, best[0][0])
        return best


def int_rows(vectors: list) -> np.ndarray:
    return np.array(vectors, np.int64).reshape(len(vectors), -1)


def exact_pair(block: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which all their inner products are exact: doubles, 64-bit integers, or Python integers."""
    most = [max((abs(int(f())) for f in (x.max, x.min)), default=0) if x.size else 0 for x in (block, rows)]
    largest = most[0] * most[1] * max(1, rows.shape[1])
    kind = float if largest < 1 << 52 else np.int64 if largest < 1 << 62 else object
    return block.astype(kind), rows.astype(kind)


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v, dim): each component x as floor(scale * x). Rows with a null id, a null or empty vector or a component that is null or not
    finite take no part; equal rows count once. A component beyond LARGEST is an error, as is a score that is no long."""
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    large = F.raise_error(F.lit(f"a component is beyond {LARGEST} steps of 1/{scale}: its scores would not fit")).cast("long")
    whole = lambda x: F.floor(x.cast("double") * scale).cast("long")
    v = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double") * scale) < float(LARGEST), whole(x)).otherwise(large))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size("embedding").alias("dim")).distinct()


def cell_cuts(sample: np.ndarray, cells: int) -> list[tuple[int, int, int]]:
    """Median splits (node, dimension, value) of the sample, widest dimension first, until there are `cells` or few rows a cell."""
    out, todo = [], [(0, sample, cells)]
    while todo:
        node, rows, n = todo.pop()
        if n < 2 or len(rows) < 2 * CELL_SAMPLE:
            continue
        wide = int(np.argmax(rows.max(0) - rows.min(0)))
        value = int(np.median(rows[:, wide]))
        low = rows[:, wide] < value
        if low.all() or not low.any():
            continue
        out.append((node, wide, value))
        todo += [(2 * node + 1, rows[low], n // 2), (2 * node + 2, rows[~low], n - n // 2)]
    return out


def sharded(rows: DataFrame) -> DataFrame:
    """The rows with their dim and shard."""
    cuts: dict[int, dict[int, tuple[int, int]]] = {}
    for r in rows.groupBy("dim").agg(F.count("*").alias("n")).toLocalIterator():
        sample = rows.filter(F.col("dim") == r["dim"]).orderBy(F.xxhash64("vec_id")).limit(SAMPLE_ROWS).select("v").toArrow()["v"].to_pylist()
        cuts[r["dim"]] = {node: (wide, value) for node, wide, value in cell_cuts(np.array(sample, np.int64), -(-r["n"] // SHARD_ROWS))}

    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vs, dims in batches:
            cells = []
            for v, dim in zip(vs, dims):
                node, tree = 0, cuts.get(dim, {})
                while node in tree:
                    wide, value = tree[node]
                    node = 2 * node + (1 if v[wide] < value else 2)
                cells.append(node)
            yield pd.Series(cells, dtype="int64")

    rows = kept(rows.withColumn("cell", F.pandas_udf(place, "long")("v", "dim")))
    full = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / (2 * SHARD_ROWS)).alias("parts"))
    return rows.join(full, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) that is_query (of vec_id) picks, its k largest integer
    inner products with rows of other ids, all if there are fewer; ties to the smaller vec_id.

    Rows that take no part: see whole_vectors. Vectors of another length are no candidates. An id with several different vectors counts
    each of them as a candidate, and searches with each; a query's row of an id appears once with its best score. Other columns are
    left aside. An empty table gives an empty result.
    """
    rows = kept(sharded(whole_vectors(vectors)).select("vec_id", "v", F.concat_ws("/", "dim", "cell", "part").alias("shard"), "dim"))
    queries = rows.filter(is_query)
    kind = "query_id long, vec_id long, score long"

    def run(key: tuple, asked: pa.Table, shard: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if asked.num_rows and shard.num_rows:
            tree = Tree(shard.column("vec_id").to_numpy(), int_rows(shard.column("v").to_pylist()))
            block = int_rows(asked.column("asked").to_pylist())
            bound = tree.bounds(block)
            least = [float("-inf") if x is None else x for x in asked.column("least").to_pylist()]
            block, tree.rows = exact_pair(block, tree.rows)
            for i, q in enumerate(asked.column("query_id").to_pylist()):
                if bound[i, 0] >= least[i]:
                    found += [(q, -vec, score) for score, vec in tree.search(block[i], q, bound[i], k, least[i])]
        q, vec, score = zip(*found) if found else ((), (), ())
        return pa.table([pa.array(q, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])

    def searched(asked: DataFrame, against: DataFrame, on: list[str]) -> DataFrame:
        left = asked.select(*(F.col(c).alias(f"q_{c}") for c in on), "query_id", F.col("v").alias("asked"), "least")
        return left.groupBy(*(f"q_{c}" for c in on)).cogroup(against.groupBy(*on)).applyInArrow(run, kind)

    asked = queries.select(F.col("vec_id").alias("query_id"), "v", "dim", F.col("shard").alias("shard"), F.lit(None).cast("long").alias("least"))
    home = kept(searched(asked, rows, ["shard"]))
    best = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = lambda df: df.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    kth = once(home).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))

    shards = kept(rows.groupBy("dim", "shard").agg(F.count("*").alias("n")))
    blocks = F.greatest(F.lit(1), F.ceil(F.lit(queries.count() / BLOCK_QUERIES))).cast("long")
    asked = asked.select("query_id", "v", "dim", F.col("shard").alias("own")).join(kth, "query_id", "left")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), blocks)).withColumnRenamed("kth", "least")
    away = asked.join(shards.select("dim", "shard"), "dim").filter("shard <> own")
    many = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    others = searched(away, many, ["shard", "block"])
    return once(home.union(others)).select("query_id", "rank", "vec_id", "score")
