"""Helpers shared by the corpus operators: tables, the shared scratch folder, and words of Arrow text columns as numpy arrays."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a task works on at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Spans longer than this are hashed one by one.
LONG_SPAN = 256

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
_MUL_A, _MUL_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh path below the session's shared checkpoint folder; a local one only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def shared_folder(spark) -> str:
    """A fresh folder of the file system that driver and executors share, for files that tasks write and read."""
    path = scratch(spark)
    if "://" in path or path.startswith("file:"):
        scheme, _, path = path.partition(":")
        if scheme != "file":
            raise ValueError("tasks share files here: spark.checkpoint.dir must be a mounted folder")
        path = "/" + path.lstrip("/")
    os.makedirs(path, exist_ok=True)
    return path


def kept(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows, written to the shared folder and read again: one evaluation, and no lineage behind it."""
    spark, path = df.sparkSession, path or scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about `limit` bytes of text, at least one row each; nulls become empty texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
        batch = batch.set_column(batch.schema.get_field_index(text), text, col)
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string column and the offset of each text, with the end of the last."""
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of True that stays within a text."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = off[(off > 0) & (off < n)]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word: a run without blanks of ASCII."""
    return spans(~_WHITE[data], off)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MUL_A
    return h ^ (h >> np.uint64(29))


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at8 = np.ndarray(len(padded) - 7, np.dtype("<u8"), padded, strides=(1,))
    length = ends - starts
    h = mix(length.astype(np.uint64) * _MUL_B)
    todo = np.flatnonzero(length <= LONG_SPAN)
    k = 0
    while len(todo):
        left = length[todo] - k
        h[todo] = mix((h[todo] ^ (at8[starts[todo] + k] & _MASKS[np.minimum(left, 8)])) * _MUL_B)
        todo, k = todo[left > 8], k + 8
    for i in np.flatnonzero(length > LONG_SPAN):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


def windows(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the `size` words from each word on, and whether they lie in one text."""
    n = len(h)
    out, whole = np.full(n, np.uint64(size)), np.zeros(n, bool)
    if n >= size:
        whole[: n - size + 1] = doc[: n - size + 1] == doc[size - 1 :]
    for j in range(size):
        nxt = np.zeros(n, np.uint64)
        if j < n:
            same = doc[: n - j] == doc[j:]
            nxt[: n - j] = np.where(same, h[j:] | np.uint64(1), np.uint64(0))
        out = mix((out ^ nxt) * _MUL_B)
    return out, whole


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


class Bits:
    """A set of 64-bit hashes as a bit table of fixed size on every worker: says yes for all members and, by chance, for others."""

    def __init__(self, df: DataFrame, column: str, log2: int = 24):
        """The table is gathered as at most 2^log2 / 64 words, whatever the number of rows."""
        index = F.shiftrightunsigned(F.col(column), 64 - log2)
        word = df.select(F.shiftright(index, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), index.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
        rows = word.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        table = np.zeros(1 << log2 - 6, np.uint64)
        table[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
        self.log2, self.table = log2, df.sparkSession.sparkContext.broadcast(table)

    def has(self, h: np.ndarray) -> np.ndarray:
        index = h >> np.uint64(64 - self.log2)
        return (self.table.value[index >> np.uint64(6)] >> (index & np.uint64(63)) & np.uint64(1)).astype(bool)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), longs: root is one node of its connected component.

    Each round sends every node to the smallest of itself and its neighbours and keeps the links between the images, until none
    is left. Nodes are hashes, so the graph shrinks by a factor in each round. Links to oneself and repeated links are harmless.
    """
    edges = kept(edges.select("a", "b").filter("a <> b").distinct())
    found = kept(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = kept(both.groupBy(F.col("a").alias("u")).agg(F.least(F.col("u"), F.min("b")).alias("m")))
        found = kept(found.join(least, F.col("root") == F.col("u"), "left").select("node", F.coalesce("m", "root").alias("root")))
        left = edges.join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").filter("a <> b")
        right = left.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b")).filter("a <> b")
        edges = kept(right.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return found


def discard(spark: SparkSession, path: str) -> None:
    """Removes an intermediate folder that no result reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
