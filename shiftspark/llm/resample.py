"""Importance resampling towards a target distribution: documents whose words are likelier in the target come first.

Texts are read a slice at a time: the slice's texts are joined with a separator that no word can hold, one regular expression pass cuts
the whole slice into words and gaps, a running sum of their lengths gives every word's place, and a search among the texts' offsets its
document. Runs of n words come from the words beside each other; a run whose first and last word lie in two documents is masked. Each
run's checksum picks one of a fixed number of buckets, and what leaves a task are counts of buckets only.

The draw is the Gumbel trick: log-weight plus noise from a hash of the document's id, largest first. Scores are whole numbers, so a count
for each score (a bounded number, whatever the rows) tells where the draw ends; only the drawn rows are ordered, in ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.llm.common import kept, raw, slices

#: Bytes of words; everything else separates them, the sentinel included.
WORD = re.compile(rb"([0-9a-z\x80-\xff]+)")
SENTINEL = b"\x00"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Rows of one range when the drawn documents are put in order, about.
RANGE_ROWS = 1 << 18


def bucket_runs(data: bytes, off: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and bucket of every run of 1 to n words of the texts, and each document's number of words.

    The texts lie in `data` one after the other; text i begins at off[i], and off has the end of the last as well.
    """
    joined = SENTINEL.join(data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())).translate(LOWER)
    parts = WORD.split(joined)
    words = parts[1::2]
    starts = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))[:-1:2]
    first = off[:-1] + np.arange(len(off) - 1)
    doc = np.searchsorted(first, starts, side="right") - 1
    checks = list(map(crc32, words))
    docs, found = [doc], [np.array(checks, np.int64)]
    for k in range(2, n + 1):
        checks = [crc32(w, crc32(b" ", c)) for c, w in zip(checks, words[k - 1 :])]
        whole = doc[: len(checks)] == doc[k - 1 :]
        docs.append(doc[: len(checks)][whole])
        found.append(np.array(checks, np.int64)[whole])
    return np.concatenate(docs), np.concatenate(found) % buckets, np.bincount(doc, minlength=len(off) - 1)


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, n): how often each bucket that occurs is hit by the runs of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            data, off = raw(batch.column("text"))
            total += np.bincount(bucket_runs(data.tobytes(), off, n, buckets)[1], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.record_batch([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], ["bucket", "n"])

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, n: int, buckets: int) -> np.ndarray:
    """For each bucket floor(1000 ln of its smoothed share in the target over that in docs); `buckets` numbers in all."""
    spark = docs.sparkSession
    s, t = (kept(bucket_counts(df, n, buckets)) for df in (docs, target))
    all_s, all_t = (df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).first()[0] for df in (s, t))
    both = spark.range(buckets).withColumnRenamed("id", "bucket")
    both = both.join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left")
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    rows = both.select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain")).toArrow()
    gains = np.zeros(buckets, np.int64)
    gains[rows["bucket"].to_numpy()] = rows["gain"].to_numpy()
    return gains


def weighted(docs: DataFrame, gains: np.ndarray, n: int) -> DataFrame:
    """(doc_id, n_features, n_words, weight): the floored mean gain of each document's runs, 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.astype(np.float64)
        for batch in slices(batches):
            data, off = raw(batch.column("text"))
            doc, bucket, n_words = bucket_runs(data.tobytes(), off, n, len(gain))
            features = np.bincount(doc, minlength=batch.num_rows)
            # whole numbers far below 2^53: sums of doubles are exact
            total = np.bincount(doc, weights=gain[bucket], minlength=batch.num_rows).astype(np.int64)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            cols = [batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (features, n_words, weight))]
            yield pa.record_batch(cols, ["doc_id", "n_features", "n_words", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_features long, n_words long, weight long")


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """The rows, stored ones with eligible, score and doc_id, with the rank of the `drawn` eligible ones of highest score; ties to smaller
    doc_id, then in stored order.

    How many scores there are is bounded by the scores' own range, not by the rows, so their counts are gathered; rows from the last
    drawn score on are dealt to ranges of (score, doc_id), and a row's rank is its place in its range after the rows of earlier ranges.
    """
    counts = scored.filter("eligible").groupBy("score").agg(F.count("*").alias("n")).toArrow()
    score, n = counts["score"].to_numpy(), counts["n"].to_numpy()
    order = np.argsort(-score)
    upto = np.cumsum(n[order])
    if not drawn:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    last = int(np.searchsorted(upto, drawn))
    least = int(score[order][last])
    inside = F.col("eligible") & (F.col("score") >= least)
    keys = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_at")]
    top = scored.withColumn("_at", F.monotonically_increasing_id()).filter(inside)
    top = top.repartitionByRange(max(1, -(-int(upto[last]) // RANGE_ROWS)), *keys).sortWithinPartitions(*keys).drop("_at")
    place = F.monotonically_increasing_id()
    top = kept(top.withColumn("_range", F.shiftright(place, 33)).withColumn("_place", place.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = top.groupBy("_range").agg(F.count("*").alias("n")).toArrow().to_pandas().sort_values("_range")
    sizes["first"] = sizes["n"].cumsum() - sizes["n"]
    table = scored.sparkSession.createDataFrame(sizes[["_range", "first"]].astype("int64"), "_range long, first long")
    rank = F.col("first") + F.col("_place") + 1
    top = top.join(F.broadcast(table), "_range").withColumn("rank", F.when(rank <= drawn, rank)).drop("_range", "_place", "first")
    return top.unionByName(scored.filter(~inside).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs (doc_id, text); target has texts alone.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z in lower case; features are runs of 1 to n
    words, joined by a space. rank counts the drawn documents from 1: of those with `least_words` words or more the given percentage,
    rounded down, by highest score, ties to smaller doc_id. Null texts have no words; a null id takes the noise of an empty one and is
    last in ties; repeated rows are drawn one by one. Other columns are left aside. Without rows the result is empty; without target
    texts all gains follow from the smoothing alone.
    """
    scored = weighted(docs, bucket_gains(docs, target, n, buckets), n)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")
    scored = scored.withColumn("score", F.col("weight") + noise).withColumn("eligible", F.col("n_words") >= least_words)
    scored = kept(scored)
    drawn = percent * scored.filter("eligible").count() // 100
    return ranked(scored, drawn).select("doc_id", "n_features", "weight", "score", "rank")
