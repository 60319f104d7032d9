"""Exact duplicates against brute force: filters, batches against snapshots, digests that clash, hostile rows."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftspark.llm.exact_dedup import Store, exact_duplicates
from shiftspark.llm.fuse_filter import FuseFilter
from tests.llm.test_operators import COLUMNS, odd_rows


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 5000, 60_000])
def test_filters_hold_their_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
    f = FuseFilter.read(*FuseFilter.of(np.repeat(keys, 2)).row())
    assert f.has(keys).all()
    others = np.setdiff1d(rng.integers(0, 1 << 63, 100_000).astype(np.uint64), keys)
    assert f.has(others).mean() < 1.3 / 256
    assert n < 50_000 or len(f.table) < 1.25 * n


def brute(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    want = collections.Counter()
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            stays, kept = i == top and not kept, kept or i == top
            want[i, hashlib.sha256(text.encode()).hexdigest(), top, len(ids), stays] += 1
    return want


def found(df):
    return collections.Counter((r.doc_id, bytes(r.digest).hex(), r.keep_id, r.group_size, r.kept) for r in df.collect())


@pytest.mark.parametrize("batches", [1, 4])
def test_verdicts_equal_brute_force_on_hostile_rows(spark, batches):
    rows = odd_rows()
    rows += [(100 + i, "hot", None, None, *rows[0][4:]) for i in range(300)] + [rows[9]] * 2 + [(7, "", *rows[0][2:])] * 3
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert found(exact_duplicates(docs, batches)) == brute([r[:2] for r in rows])
    assert exact_duplicates(docs.limit(0), batches).count() == 0


def test_bytes_decide_where_a_digest_stands_for_several_texts(spark):
    """The digest is the first letter only."""
    batches = [
        [(1, "aa"), (2, "ab"), (3, "ab"), (4, "ba"), (5, "c"), (None, "d")],
        [(9, "bb"), (6, "ba"), (8, "c"), (8, "c"), (10, "e")],
        [(12, "e"), (11, "ab"), (13, None), (14, ""), (15, "aa")],
    ]
    store = Store(spark, lambda text: F.substring(text, 1, 1).cast("binary"))
    known = [{bytes(r.digest).decode(): r.known for r in store.add(spark.createDataFrame(b, "doc_id long, text string")).collect()} for b in batches]
    assert known[1] == {"b": True, "c": True, "e": False} and known[2]["e"] and not known[2][""]
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in store.verdicts().collect())
    want = collections.Counter()
    for (doc_id, _, top, size, stays), n in brute([r for b in batches for r in b]).items():
        want[doc_id, top, size, stays] += n
    assert got == want
    store.close()


def test_only_suspects_reach_the_exact_buckets(spark):
    """Of texts never seen before, the filters pass about one in 256, and all of those that were seen."""
    store = Store(spark)
    store.add(spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("old "), "id").alias("text")))
    batch = spark.range(3000, 9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("old "), "id").alias("text"))
    digests = batch.select(F.unhex(F.sha2("text", 256)).alias("digest"))
    passed = store._screened(digests, store.snapshots[0]).count()
    assert 1000 <= passed < 1000 + 5000 / 256 * 2.5
    assert store.add(batch).filter("known").count() == 1000
    plan = store._compared(spark.table(store.snapshots[1].table), digests.limit(1), store.snapshots[0])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Bucketed: true") == 2
    store.close()
