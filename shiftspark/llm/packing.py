"""Bounded-space online packing of token sequences.

Each task keeps at most OPEN open windows of `size` tokens. A text goes to the window where it fits best; if none fits, a new window
opens, and at OPEN of them the fullest is emitted first. Texts longer than a window fill windows of their own and only their rest is
placed. What is open at a task's end is written too, and those windows are merged afterwards, best fit by size, in groups of bounded
size whose number grows with their number.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.llm.common import kept, raw, slices
from shiftspark.llm.words import WordTable

#: Open windows of a task; open windows merged in one group; words that a task's table holds.
OPEN, MERGED, HELD = 64, 8192, 1 << 19
END_ID = 1


def best_fit(lengths: list[int], size: int, limit: int) -> tuple[list[tuple[int, int]], list[int]]:
    """(window, offset) of each item and the windows still open, with no more than `limit` open at once."""
    packer = Windows(size, limit)
    return [packer.place(n) for n in lengths], packer.left()


class Windows:
    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.next = size, limit, 0
        self.free: list[tuple[int, int]] = []  # (free, window), ascending

    def place(self, n: int) -> tuple[int, int]:
        """The window and offset of an item of n tokens, at most the window's size."""
        i = bisect_left(self.free, (n, -1))
        if i < len(self.free):
            free, window = self.free.pop(i)
        else:
            if len(self.free) >= self.limit:
                self.free.pop(0)
            free, window = self.size, self.next
            self.next += 1
        if free > n:
            insort(self.free, (free - n, window))
        return window, self.size - free

    def whole(self) -> int:
        """A window that is filled at once."""
        self.next += 1
        return self.next - 1

    def left(self) -> list[int]:
        return [w for _, w in self.free]


def placed(docs: DataFrame, path: str, size: int, with_ids: bool) -> DataFrame:
    """The pieces of all texts with their window in their task; `open` marks windows that are left at its end."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "win", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, windows, part = WordTable(path, HELD), Windows(size, OPEN), TaskContext.get().partitionId()
        for b in slices(batches):
            out, (flat, counts) = [], table.encode(*raw(b.column("text")))
            ends = np.cumsum(counts)
            for doc_id, end, n in zip(b.column("doc_id").to_pylist(), ends.tolist(), counts.tolist()):
                ids = np.append(flat[end - n : end], np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    win, offset = (windows.whole(), 0) if len(piece) == size else windows.place(len(piece))
                    out.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, win, offset, piece.view(np.int32) if with_ids else None))
            kinds = [pa.int64()] * 8 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        left = windows.left()
        if left:
            cols = [pa.nulls(len(left), pa.int64()) for _ in range(8)]
            cols[5], cols[6] = pa.array([part] * len(left), pa.int64()), pa.array(left, pa.int64())
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(left), pa.list_(pa.int32()))], names)

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names[:-1]) + ", ids array<int>")


def pack(docs: DataFrame, path: str, size: int = 2048, with_ids: bool = False) -> DataFrame:
    """The pieces of docs (doc_id, text) in sequences of at most `size` tokens: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and ids if asked for.

    A text's tokens are its ids and END_ID. A null or empty text has END_ID alone. Texts up to `size` tokens stay whole; longer ones are
    cut at multiples of `size`. Repeated rows are packed one by one; other columns are left aside. An empty table gives an empty result.
    sequence_id is unique, not gapless.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = kept(placed(docs, path, size, with_ids))
    left = rows.filter("length is null").select("part", "win")
    pieces = rows.filter("length is not null")
    fill = kept(pieces.join(left, ["part", "win"]).groupBy("part", "win").agg(F.sum("length").alias("fill")))
    groups = -(-max(1, fill.count()) // MERGED)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "part", "win"], ascending=[False, True, True])
        where, _ = best_fit(pdf["fill"].tolist(), size, len(pdf))
        window, offset = zip(*where)
        return pdf.assign(seq=(1 << 62) + pdf["g"].astype(np.int64) * (1 << 32) + np.array(window), base=np.array(offset, np.int64))[["part", "win", "seq", "base"]]

    merged = fill.withColumn("g", F.pmod(F.xxhash64("part", "win"), F.lit(groups))).groupBy("g").applyInPandas(merge, "part long, win long, seq long, base long")
    out = pieces.join(merged, ["part", "win"], "left")
    own = F.col("part") * F.lit(1 << 32) + F.col("win")
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", F.coalesce("seq", own).alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")]
    return out.select(*cols, *(["ids"] if with_ids else []))
