"""Quality classifier: hashed word and character n-gram vectors, averaged per document, under a softmax.

It is trained by stochastic gradient descent in numpy on a bounded, documented sample of the labelled texts. For scoring, the learned
vectors and the softmax fold into one number a bucket, so a whole text costs one look-up for each of its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.llm.common import hashed, raw, slices, words

#: Buckets that n-grams are hashed to (a power of two), and the lengths of character n-grams, in bytes.
LOG_BUCKETS, LENGTHS = 18, (3, 4)
#: Labelled texts of each class that the model learns from at most: the bound of the sample.
SAMPLE = 1500
DIMENSIONS, EPOCHS, RATE, SEED = 16, 3, 30.0, 17
#: Bucket of a word that repeats the word before it.
AGAIN = 0


def features(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram the buckets, and for each text the number of the first; a last number closes it."""
    data, off = raw(batch.column("text"))
    start, end, doc = words(data, off)
    h = hashed(data, start, end)
    bucket = (h >> np.uint64(64 - LOG_BUCKETS)).astype(np.int32)
    yield bucket, np.searchsorted(doc, np.arange(batch.num_rows + 1))
    again = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    yield np.full(len(again), AGAIN, np.int32), np.searchsorted(doc[again], np.arange(batch.num_rows + 1))
    # each word with a blank on either side, one after the other
    size = end - start + 2
    first = np.cumsum(size) - size
    text = np.full(int(size.sum()), 32, np.uint32)
    inside = np.ones(len(text), bool)
    inside[first] = inside[first + size - 1] = False
    text[inside] = data[within(start, end, len(data))]
    ends = np.concatenate([first, [len(text)]])[np.searchsorted(doc, np.arange(batch.num_rows + 1))]
    for n in LENGTHS:
        key = np.zeros(max(0, len(text) - n + 1), np.uint32)
        for j in range(n):
            key = key << np.uint32(8) | text[j : j + len(key)]
        key = (key * np.uint32(2654435761) ^ np.uint32(n)) * np.uint32(2246822519)
        bucket = (key >> np.uint32(32 - LOG_BUCKETS)).astype(np.int32)
        blank = ~inside
        two = blank[:-1] & blank[1:] if len(blank) else blank
        seam = np.zeros(len(key) + 1, np.int32)
        for j in range(n - 1):  # n-grams that span two words
            seam[: len(key)] += two[j : j + len(key)]
        fine = seam[: len(key)] == 0
        yield bucket[fine], np.concatenate([[0], np.cumsum(fine)])[np.minimum(ends, len(key))]


def within(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Whether each byte is in a word."""
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)


def counted(docs: DataFrame) -> DataFrame:
    """(label, buckets, shares): the distinct buckets of each text with their share of all its n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            kinds = list(features(b))
            buckets, shares = [], []
            for i in range(b.num_rows):
                own, n = np.unique(np.concatenate([f[at[i] : at[i + 1]] for f, at in kinds]), return_counts=True)
                buckets.append(own.astype(np.int32))
                shares.append((n / max(1, n.sum())).astype(np.float32))
            arrays = [b.column("label"), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["label", "buckets", "shares"])

    return docs.mapInArrow(run, "label int, buckets array<int>, shares array<float>")


def trained(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Each bucket's part in the difference of the two classes' logits, and the constant difference."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << LOG_BUCKETS, DIMENSIONS)).astype(np.float32)
    top, base = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    steps = EPOCHS * len(rows)
    for step, i in enumerate(j for _ in range(EPOCHS) for j in rng.permutation(len(rows))):
        label, buckets, shares = rows[i]
        rate = RATE * (1 - step / steps)
        mean = shares @ vectors[buckets]
        logit = mean @ top + base
        p = np.exp(logit - logit.max())
        error = p / p.sum()
        error[label] -= 1
        back = top @ error
        top -= 0.1 * rate * np.outer(mean, error)
        base -= 0.001 * rate * error
        vectors[buckets] -= rate * np.outer(shares, back)
    return (vectors @ (top[:, 1] - top[:, 0])).astype(np.float32), float(base[1] - base[0])


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, text) of at most SAMPLE labelled texts of each class, chosen by a hash of the id; an id with two labels has the lower."""
    one = labels.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    order = F.xxhash64("doc_id", F.lit(SEED))
    some = [one.filter(F.col("label") == v).orderBy(order, "doc_id").limit(SAMPLE) for v in (0, 1)]
    return docs.join(F.broadcast(some[0].union(some[1])), "doc_id").select("label", "text")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) for each row of docs (doc_id, text): probability of label 1, learned from labels (doc_id, label) and their texts.

    Whole texts count. Null and empty texts get the score of no n-grams at all, which is the learned constant; without any labelled
    text all scores are 0.5. Rows with equal ids are scored one by one; an empty table gives an empty result; other columns are
    left aside. Labels that are null or not 0 or 1 teach nothing.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = counted(sample(docs, labels)).toArrow()
    rows = [(y, np.array(b, np.int32), np.array(s, np.float32)) for y, b, s in zip(*(c.to_pylist() for c in found.columns))]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    weight, base = trained(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            total, n = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for buckets, at in features(b):
                upto = np.concatenate([[0.0], np.cumsum(weight[buckets], dtype=np.float64)])
                total += upto[at[1:]] - upto[at[:-1]]
                n += np.diff(at)
            score = 1 / (1 + np.exp(-(total / np.maximum(n, 1) + base)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")
