"""Shards of near equal bytes by sampled splitters.

Rows are ordered by a hash of their text, then of their id and, among repeated rows, of their place in the stored table. A size-weighted sample of that key is drawn; its quantiles cut the order
into many ranges. The exact bytes of every range are counted, and overfull ranges are cut again by a sample of their own: between
texts where possible, within a group of equal texts only if the group alone overfills a range. Consecutive ranges then make up the
shards, by exact running bytes. Slots are a range's first slot plus the place within the range, so no task sorts a whole shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from shiftspark.llm.common import kept

#: Ranges aimed at, and sampled keys for each: what the driver gathers is bounded by their product.
RANGES, PER_RANGE = 4096, 16
#: Bits of the second key that tell repeated rows apart.
REPEATED_BITS = 20
#: A range is overfull from this many times its fair share.
OVERFULL = 2


def sampled(rows: DataFrame, total: int, wanted: int) -> np.ndarray:
    """About `wanted` keys (key, sub), sorted; a row is drawn in proportion to its size, large rows several times."""
    draw = F.pmod(F.xxhash64("sub", "key", F.lit(7)), F.lit(1 << 30)) / (1 << 30)
    times = F.floor(F.col("size") * F.lit(wanted / max(1, total)) + draw).cast("int")
    found = rows.select("key", "sub", times.alias("times")).filter("times > 0").toArrow().to_pandas()
    found = found.loc[found.index.repeat(found["times"]), ["key", "sub"]].sort_values(["key", "sub"])
    return found.to_numpy(np.int64).reshape(-1, 2)


def cuts(sample: np.ndarray, ranges: int, within: bool) -> np.ndarray:
    """At most `ranges` - 1 lower bounds of ranges. Bounds lie between keys, but `within` a key that covers several quantiles."""
    if not len(sample):
        return sample
    at = sample[np.arange(1, ranges) * len(sample) // ranges]
    if within:
        keys, n = np.unique(at[:, 0], return_counts=True)
        alone = np.isin(at[:, 0], keys[n < 2])
        at = np.where(np.stack([np.zeros_like(alone), alone], 1), np.iinfo(np.int64).min, at)
        first = np.stack([keys[n >= 2], np.full((n >= 2).sum(), np.iinfo(np.int64).min)], 1)
        after = np.stack([keys[(n >= 2) & (keys < np.iinfo(np.int64).max)] + 1, np.full(((n >= 2) & (keys < np.iinfo(np.int64).max)).sum(), np.iinfo(np.int64).min)], 1)
        at = np.concatenate([at, first, after])
    else:
        at = at.copy()
        at[:, 1] = np.iinfo(np.int64).min
    return np.unique(at, axis=0)


def with_range(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """The rows with the number of the range that (key, sub) lies in."""
    keys = np.ascontiguousarray(bounds[:, 0])
    low, high = np.searchsorted(keys, keys, "left"), np.searchsorted(keys, keys, "right")
    subs = bounds[:, 1]

    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for key, sub in batches:
            key, sub = key.to_numpy(), sub.to_numpy()
            at = np.searchsorted(keys, key, "left")
            for i in np.flatnonzero(np.isin(key, keys)):
                at[i] += np.searchsorted(subs[low[at[i]] : high[at[i]]], sub[i], "right")
            yield pd.Series(at.astype(np.int32))

    return rows.withColumn("range", F.pandas_udf(place, "int")("key", "sub"))


def byte_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of docs (doc_id, text): shards 0 to shards - 1 of near equal sizes.

    size: UTF-8 bytes of the text and 1; a null text has no bytes and checksum 0. slot: 0, 1, ... within each shard. Equal texts lie
    together but where a group overfills a range or a shard's end falls into it. Null ids are keys like any other, repeated rows are
    placed one by one and may lie in several shards, other columns are left aside. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    own, repeat = F.xxhash64(F.col("doc_id").cast("long")), F.xxhash64(F.monotonically_increasing_id())
    mask = (1 << REPEATED_BITS) - 1
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        own.bitwiseAND(F.lit(~mask)).bitwiseOR(repeat.bitwiseAND(F.lit(mask))).alias("sub"),
    )
    rows = kept(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    bounds = cuts(sampled(rows, total, RANGES * PER_RANGE), RANGES, within=False)
    ranged = with_range(rows, bounds)
    full = ranged.groupBy("range").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > OVERFULL * max(1, total // RANGES))
    full = {r["range"]: r["bytes"] for r in full.toLocalIterator()}
    if full:
        inside = ranged.filter(F.col("range").isin(list(full)))
        more = -(-sum(full.values()) * RANGES // max(1, total))
        bounds = np.unique(np.concatenate([bounds, cuts(sampled(inside, sum(full.values()), more * PER_RANGE), more, within=True)]), axis=0)
    ranged = kept(with_range(rows, bounds))
    ranges = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toArrow().to_pandas().sort_values("range")
    upto = ranges["bytes"].cumsum()
    ranges["shard"] = ((upto - ranges["bytes"] / 2) * shards // max(1, total)).clip(0, shards - 1).astype("int32")
    ranges["first"] = ranges.groupby("shard")["rows"].cumsum() - ranges["rows"]
    table = docs.sparkSession.createDataFrame(ranges[["range", "shard", "first"]].astype({"range": "int32", "first": "int64"}), "range int, shard int, first long")
    place = F.row_number().over(W.Window.partitionBy("range").orderBy("key", "sub", "doc_id", "size", "text_crc32"))
    out = ranged.withColumn("place", place).join(F.broadcast(table), "range")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place") - 1).alias("slot"))
