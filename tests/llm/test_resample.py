"""Importance resampling against a document-by-document calculation."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from shiftspark.llm import resample as m
from shiftspark.llm.catalog import QUERIES
from tests.conftest import SMALL
from tests.llm.test_operators import COLUMNS, LOWER, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n=1, buckets=10_000, percent=10, least=20, seed=2024):
    """The task's formulas, one document at a time; rows with a null id last in ties."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    cut = [(i, *runs(t, n)) for i, t in docs]
    s = collections.Counter(bucket(g) for _, _, gs in cut for g in gs)
    t = collections.Counter(bucket(g) for text in target for g in runs(text, n)[1])
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, words, gs in cut:
        weight = sum(gain[bucket(g)] for g in gs) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return collections.Counter(tuple(r[:5]) for r in rows)


def found(df):
    return collections.Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect())


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = brute(docs, target)
    assert found(QUERIES["op12_importance_resampling"](spark, SMALL)) == want
    assert sum(k[4] is not None for k in want) > 10


@pytest.mark.parametrize("n, buckets, percent", [(1, 97, 40), (3, 1000, 100)])
def test_hostile_rows_and_longer_runs_equal_brute_force(spark, monkeypatch, n, buckets, percent):
    monkeypatch.setattr(m, "RANGE_ROWS", 7)
    rows = odd_rows() + [(500 + i, f"wörter und Words {i} " * 8, None, None, *odd_rows()[0][4:]) for i in range(60)]
    target = ["the House of words", None, "", "x2y don't und words"]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = found(m.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), n, buckets, percent))
    assert got == brute([r[:2] for r in rows], target, n, buckets, percent)


def test_repeated_rows_ties_and_empty_tables(spark):
    docs = spark.range(40).select(F.when(F.col("id") < 30, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same text " * 15).alias("text"))
    none = spark.createDataFrame([], "doc_id long, text string")
    got = m.resample(docs, none, percent=50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 21))
    order = sorted(got, key=lambda r: (-r.score, r.doc_id))
    assert [r.score for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == [r.score for r in order[:20]]
    assert m.resample(none, docs).count() == 0
    assert m.resample(docs.limit(3), docs, percent=10).filter("rank is not null").count() == 0


def test_words_of_a_slice_keep_to_their_documents():
    texts = [b"", b"one two", b"two", b"", b"\xc3\xa9a-B", b" "]
    off, at = [0], 0
    for t in texts:
        at += len(t)
        off.append(at)
    doc, bucket, n_words = m.bucket_runs(b"".join(texts), m.np.array(off), 2, 1 << 32)
    assert n_words.tolist() == [0, 2, 1, 0, 2, 0]
    want = [(1, b"one"), (1, b"two"), (2, b"two"), (4, b"\xc3\xa9a"), (4, b"b"), (1, b"one two"), (4, b"\xc3\xa9a b")]
    assert list(zip(doc.tolist(), bucket.tolist())) == [(d, zlib.crc32(w)) for d, w in want]
