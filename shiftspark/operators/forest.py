"""A random forest whose trees grow level by level over counted rows.

Features are cut into at most ``maxBins`` bins, as Spark ML's forest does, and
rows that agree in all bins and in the label become one row with a count. A
row's number in a bootstrap sample is a Poisson(1) number, so the count of n
such rows is a Poisson(n) number: each tree sees what it would see over the
rows. For each level, tasks add up the classes by tree, node, feature and bin
in one pass; the tables of a tree meet in one task, which picks the splits.
Where no two rows agree, the counted rows are the rows, and only that many.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasProbabilityCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.sources.writers import stored

# Quantiles looked at: where they show no more values than bins, each value gets its own bin.
QUANTILES = 1000
SPLITS = "tree int, node int, feature int, cut int, gain double, left0 long, left1 long, right0 long, right1 long"


def find_cuts(rows: DataFrame, d: int, bins: int) -> list[np.ndarray]:
    """Rising upper ends of all bins but the last, for each feature of (x, y)."""
    probs = [i / QUANTILES for i in range(QUANTILES + 1)]
    quantiles = (F.percentile_approx(F.col("x")[i], probs, 10 * QUANTILES).alias(f"q{i}") for i in range(d))
    found = rows.agg(F.count_if(~F.col("y").isin(0, 1)).alias("other"), *quantiles).first()
    if found["other"]:
        raise ValueError("labels must be 0 or 1")
    return [cuts_of(np.array(found[f"q{i}"]), bins) for i in range(d)]


def cuts_of(quantiles: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(quantiles)
    if len(values) > bins:
        values = np.unique(quantiles[np.arange(1, bins) * (len(quantiles) - 1) // bins])
        return values[values < quantiles[-1]]
    return (values[:-1] + values[1:]) / 2


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """(feature, row): how many cuts lie below."""
    return np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)]).astype(np.uint8)


def matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), d)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted rows in blocks, which stay as they are: a block's draws hang on the block."""
    for b in batches:
        if b.num_rows:
            cols = b"".join(b.column("cell").to_pylist()), b.column("y").to_numpy().astype(np.uint8).tobytes(), b.column("n").to_numpy().tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cols], ["cell", "y", "n"])


def walk(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Each row's node at the depth of one tree; nodes are numbered from the root, level by level. Below a leaf all go left."""
    flat, row, place = bins.reshape(-1), np.arange(bins.shape[1]), feature * bins.shape[1]
    node = np.zeros(bins.shape[1], np.int64)
    for _ in range(depth):
        at = place[node]
        at += row
        right = flat[at] > cut[node]
        node += node
        node += right
        node += 1
    return node


def subset(seed: int, tree: int, level: int, d: int, m: int) -> np.ndarray:
    """(node of the level, m): the features that a node may be split by."""
    rng = np.random.default_rng([seed, tree, level])
    return np.argsort(rng.random((1 << level, d)), axis=1)[:, :m]


def gini(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.maximum(a + b, 1)
    return 1 - (a / n) ** 2 - (b / n) ** 2


def best_splits(table: np.ndarray, sub: np.ndarray) -> dict[str, np.ndarray]:
    """The split with the greatest gain for each node of (node, feature of its subset, bin, class), and the counts on both sides."""
    left = np.cumsum(table, axis=2)
    whole = left[:, :, -1:]
    left = left[:, :, :-1]
    right = whole - left
    n_left, n_right, n = left.sum(3), right.sum(3), np.maximum(whole.sum(3), 1)
    gain = gini(whole[..., 0], whole[..., 1]) - (n_left * gini(left[..., 0], left[..., 1]) + n_right * gini(right[..., 0], right[..., 1])) / n
    gain = np.where((n_left > 0) & (n_right > 0), gain, 0.0)
    at = gain.reshape(len(gain), -1).argmax(1)
    k, cut = np.unravel_index(at, gain.shape[1:])
    node = np.arange(len(gain))
    lo, hi = left[node, k, cut], right[node, k, cut]
    return {"feature": sub[node, k], "cut": cut, "gain": gain[node, k, cut], "left0": lo[:, 0], "left1": lo[:, 1], "right0": hi[:, 0], "right1": hi[:, 1]}


def grow(cells: DataFrame, d: int, n_bins: int, trees: int, depth: int, seed: int) -> tuple[np.ndarray, ...]:
    """Feature, cut and share of class 1 for each node of each tree, and the features' shares of the gain, from blocks of counted rows."""
    m = int(np.ceil(np.sqrt(d)))
    size = (1 << depth) - 1
    feature, cut = np.zeros((trees, size), np.int64), np.full((trees, size), 255, np.uint8)
    share, gains = np.zeros((trees, 2 * size + 1)), np.zeros((trees, d))
    grows = np.zeros((trees, 2 * size + 1), bool)
    grows[:, 0] = True

    for level in range(depth):
        first, nodes = (1 << level) - 1, 1 << level
        state = cells.sparkSession.sparkContext.broadcast((feature, cut))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f, c = state.value
            tables = np.zeros((trees, nodes * m * n_bins * 2), np.int64)
            for cell, y, n in ((x.as_py() for x in row) for b in batches for row in zip(*b.columns)):
                bins = np.ascontiguousarray(np.frombuffer(cell, np.uint8).reshape(-1, d).T)
                # The same draws at every level.
                drawn = np.random.default_rng([seed, zlib.crc32(cell), zlib.crc32(y)])
                y, n = np.frombuffer(y, np.uint8), np.frombuffer(n, np.int64)
                flat, row = bins.reshape(-1), np.arange(len(y))
                for t in range(trees):
                    w = drawn.poisson(n)
                    at = walk(bins, f[t], c[t], level) - first
                    sub = subset(seed, t, level, d, m)
                    for j in range(m):
                        key = ((at * m + j) * n_bins + flat[sub[at, j] * len(y) + row]) * 2 + y
                        tables[t] += np.bincount(key, w, tables.shape[1]).astype(np.int64)
            packed = [zlib.compress(x.tobytes(), 1) for x in tables]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(trees, dtype=np.int32)), pa.array(packed, pa.binary())], ["tree", "data"])

        def split(pdf: pd.DataFrame) -> pd.DataFrame:
            t = int(pdf["tree"].iloc[0])
            table = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["data"]).reshape(nodes, m, n_bins, 2)
            found = best_splits(table, subset(seed, t, level, d, m))
            return pd.DataFrame({"tree": t, "node": np.arange(nodes) + first} | found)

        parts = cells.mapInArrow(count, "tree int, data binary")
        r = parts.groupBy("tree").applyInPandas(split, SPLITS).toPandas()
        t, node = r["tree"].to_numpy(), r["node"].to_numpy()
        sides = r[["left0", "left1", "right0", "right1"]].to_numpy(float)
        if level == 0:
            share[t, node] = (sides[:, 1] + sides[:, 3]) / np.maximum(sides.sum(1), 1)
        gain = r["gain"].to_numpy()
        some = grows[t, node] & (gain > 0)
        # A leaf hands its share down to the left, where its rows go.
        share[t, 2 * node + 1] = share[t, node]
        t, node, sides, gain = t[some], node[some], sides[some], gain[some]
        feature[t, node], cut[t, node] = r["feature"][some], r["cut"][some]
        for side in (0, 1):
            zeros, ones = sides[:, 2 * side], sides[:, 2 * side + 1]
            share[t, 2 * node + 1 + side] = ones / (zeros + ones)
            grows[t, 2 * node + 1 + side] = (zeros > 0) & (ones > 0)
        np.add.at(gains, (t, feature[t, node]), gain * sides.sum(1))
        state.unpersist()
    each = gains / np.maximum(gains.sum(1, keepdims=True), 1e-300)
    total = each.sum()
    return feature, cut, share[:, size:], each.sum(0) / (total if total > 0 else 1)


class Forest(Estimator, HasFeaturesCol, HasLabelCol, HasProbabilityCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Bootstrap samples, the square root of the features at each node, Gini impurity; for the labels 0 and 1."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree, 1 or more", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, 2 to 255", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, numTrees: int = 100, maxDepth: int = 8, maxBins: int = 32, seed: int = 42):
        super().__init__()
        self._setDefault(probabilityCol="probability", numTrees=100, maxDepth=8, maxBins=32, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ForestModel:
        x, y = vector_to_array(self.getFeaturesCol()), F.col(self.getLabelCol())
        n_bins, d = self.getOrDefault("maxBins"), dataset.select(F.size(x)).first()
        if d is None:
            raise ValueError("no rows to learn from")
        d = d[0]
        rows = dataset.select(x.alias("x"), y.alias("y"))
        cuts = find_cuts(rows, d, n_bins)

        def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    bins = np.ascontiguousarray(binned(matrix(b.column("x"), d), cuts).T)
                    ends = pa.py_buffer((np.arange(b.num_rows + 1) * d).astype(np.int32))
                    cell = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, ends, pa.py_buffer(bins)])
                    yield pa.RecordBatch.from_arrays([cell, b.column("y")], ["cell", "y"])

        rows = rows.select("x", F.col("y").cast("int").alias("y"))
        counts = rows.mapInArrow(to_cells, "cell binary, y int").groupBy("cell", "y").agg(F.count("*").alias("n"))
        dealt = counts.repartition(dataset.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions("cell", "y")
        cells = stored(dealt.mapInArrow(blocks, "cell binary, y binary, n binary"))
        names = ("numTrees", "maxDepth", "seed")
        feature, cut, leaves, gains = grow(cells, d, n_bins, *(self.getOrDefault(p) for p in names))
        trees = base64.b64encode(zlib.compress(feature.astype("<i4").tobytes() + cut.tobytes() + leaves.astype("<f8").tobytes())).decode()
        model = ForestModel()._set(trees=trees, shape=[len(feature), self.getOrDefault("maxDepth")], importances=gains.tolist())
        model._set(cuts=json.dumps([c.tolist() for c in cuts]), featuresCol=self.getFeaturesCol(), probabilityCol=self.getProbabilityCol())
        return model


class ForestModel(Model, HasFeaturesCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable):
    """The mean over the trees of the share of class 1 in a row's leaf."""

    trees = Param(Params._dummy(), "trees", "features, cuts and leaves, packed", TypeConverters.toString)
    shape = Param(Params._dummy(), "shape", "number of trees, depth", TypeConverters.toListInt)
    cuts = Param(Params._dummy(), "cuts", "ends of the bins", TypeConverters.toString)
    importances = Param(Params._dummy(), "importances", "shares of the gain", TypeConverters.toListFloat)

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.getOrDefault("importances"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        n_trees, depth = self.getOrDefault("shape")
        cuts = [np.array(c) for c in json.loads(self.getOrDefault("cuts"))]
        size, d, data = n_trees * ((1 << depth) - 1), len(cuts), zlib.decompress(base64.b64decode(self.getOrDefault("trees")))
        feature = np.frombuffer(data, "<i4", size).reshape(n_trees, -1).astype(np.int64)
        cut = np.frombuffer(data, np.uint8, size, 4 * size).reshape(n_trees, -1)
        leaves = np.frombuffer(data, "<f8", offset=5 * size).reshape(n_trees, -1)

        @F.arrow_udf("array<double>")
        def probability(x: pa.Array) -> pa.Array:
            bins = binned(matrix(x, d), cuts)
            p = sum(v[walk(bins, f, c, depth) - len(f)] for f, c, v in zip(feature, cut, leaves)) / n_trees
            ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * 2)
            return pa.ListArray.from_arrays(ends, pa.array(np.column_stack([1 - p, p]).reshape(-1)))

        x = F.coalesce(vector_to_array(self.getFeaturesCol()), F.array_repeat(F.lit(float("nan")), d))
        return dataset.withColumn(self.getProbabilityCol(), array_to_vector(probability(x)))
