"""Exact duplicates of arriving batches against immutable snapshots.

Every batch becomes a snapshot: one row for each different text, with the text's digest, in a table bucketed by digest, and static
binary fuse filters over the digests, one for each shard of them. The next batch is grouped by digest on its own first, so that a text
with any number of copies is one row. Its digests then meet the filters; what they pass is new for certain. Only the others are joined
with the exact buckets, where the bytes of the texts are compared. Both sides of that join are bucketed alike, so no text is shuffled again.

A digest that turns out to stand for several texts (seen by unequal bytes within a batch, or against a snapshot) is resolved apart, by
digest and text together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark.llm.common import discard, kept, scratch
from shiftspark.llm.fuse_filter import SCHEMA, FuseFilter

#: Digests of a filter, about, and of a batch that meet one filter in a task, about.
FILTER_KEYS = 1 << 14
#: Groups with more than this share of all rows are joined by broadcast: there are fewer of them than its inverse.
HEAVY = 1 / 4096
#: Most copies of one row that are written out from one array.
COPIES = 1 << 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass(frozen=True)
class Snapshot:
    docs: DataFrame
    rows: DataFrame
    table: str
    path: str
    filters: DataFrame
    shards: int


class Store:
    """Batches of (doc_id, text), in the order in which they arrive, and what is known about their copies."""

    def __init__(self, spark: SparkSession, digest: Callable[[Column], Column] = sha256):
        self.spark, self.digest = spark, digest
        self.snapshots: list[Snapshot] = []
        self.mixed: list[DataFrame] = []

    def add(self, docs: DataFrame) -> DataFrame:
        """Takes in a batch; the result tells of each of its digests whether an earlier snapshot holds it: (digest, known). Of a digest with
        several texts in the batch, that is said of the least text.

        Null texts count as empty ones, null ids are ids like any other; other columns are left aside.
        """
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        keyed = docs.withColumn("digest", self.digest(F.col("text")))
        rows = kept(keyed.select("digest", "doc_id"))
        # equal texts of a digest: its least and its greatest are the same bytes
        groups = keyed.groupBy("digest").agg(
            F.min("text").alias("text"), (F.min("text") != F.max("text")).alias("mixed"), F.count("*").alias("n"), F.max("doc_id").alias("top")
        )
        table, path = f"snapshot_{uuid.uuid4().hex}", scratch(self.spark)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        groups.write.bucketBy(buckets, "digest").sortBy("digest").option("path", path).saveAsTable(table)
        batch = self.spark.table(table)
        self.mixed.append(batch.filter("mixed").select("digest"))

        left = batch.select("digest")
        found = []
        for old in self.snapshots:
            same = kept(self._compared(batch, self._screened(left, old), old))
            self.mixed.append(same.filter("not same").select("digest"))
            found.append(same.filter("same").select("digest"))
            left = left.join(found[-1], "digest", "left_anti")
        new = kept(left)
        self.snapshots.append(Snapshot(docs, rows, table, path, *self._filters(new)))
        known = new.select("digest", F.lit(False).alias("known"))
        for df in found:
            known = known.union(df.select("digest", F.lit(True)))
        return known

    def _filters(self, digests: DataFrame) -> tuple[DataFrame, int]:
        """One filter for each shard of the digests, and the number of shards."""
        shards = max(1, -(-digests.count() // FILTER_KEYS))
        keys = digests.select(F.xxhash64("digest").alias("key")).withColumn("shard", F.pmod("key", F.lit(shards)))

        def solved(key: tuple, table: pa.Table) -> pa.Table:
            made = FuseFilter.of(table.column("key").to_numpy().view(np.uint64)).row()
            return pa.table([pa.array([key[0].as_py()], pa.int64()), *(pa.array([x]) for x in made)], schema)

        schema = pa.schema([("shard", pa.int64()), ("seed", pa.int64()), ("segments", pa.int32()), ("width", pa.int32()), ("table", pa.binary())])
        return kept(keys.groupBy("shard").applyInArrow(solved, f"shard long, {SCHEMA}")), shards

    def _screened(self, digests: DataFrame, old: Snapshot) -> DataFrame:
        """The digests that the snapshot's filters let through: all that it holds, and one in 256 of the others."""
        asked = digests.withColumn("key", F.xxhash64("digest")).withColumn("shard", F.pmod("key", F.lit(old.shards)))
        # a batch much larger than the snapshot meets several copies of each small filter
        parts = max(1, -(-digests.count() // (old.shards * FILTER_KEYS)))
        asked = asked.withColumn("part", F.pmod(F.shiftright("key", 20), F.lit(parts)))
        filters = old.filters.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

        def screen(key: tuple, asked: pa.Table, filters: pa.Table) -> pa.Table:
            passed = np.zeros(asked.num_rows, bool)
            for f in filters.select(["seed", "segments", "width", "table"]).to_pylist():
                passed |= FuseFilter.read(**f).has(asked.column("key").to_numpy().view(np.uint64))
            return asked.select(["digest"]).filter(pa.array(passed))

        return asked.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInArrow(screen, "digest binary")

    def _compared(self, batch: DataFrame, suspects: DataFrame, old: Snapshot) -> DataFrame:
        """(digest, same) for each suspect that the snapshot's exact buckets hold: whether the texts are the same bytes."""
        stored = self.spark.table(old.table).select("digest", F.col("text").alias("stored"))
        # by their buckets, whatever sizes are expected
        return batch.join(suspects, "digest").join(stored.hint("merge"), "digest").select("digest", (F.col("text") == F.col("stored")).alias("same"))

    def verdicts(self) -> DataFrame:
        """(doc_id, digest, keep_id, group_size, kept) for each row of all batches.

        Of equal texts the row with the largest doc_id stays, of repeated rows one; null ids stay only where a group has no other. No
        batch, or empty ones, give an empty result.
        """
        rows = self._all([s.rows for s in self.snapshots], "digest binary, doc_id long")
        totals = self._all([self.spark.table(s.table).select("digest", "n", "top") for s in self.snapshots], "digest binary, n long, top long")
        mixed = kept(self._all(self.mixed, "digest binary").distinct())
        clash = not mixed.isEmpty()
        if clash:
            docs = self._all([s.docs for s in self.snapshots], "doc_id long, text string").withColumn("digest", self.digest(F.col("text")))
            docs = kept(docs.join(mixed, "digest", "left_semi"))
            rows, totals = (df.join(mixed, "digest", "left_anti") for df in (rows, totals))
        totals = kept(totals.groupBy("digest").agg(F.sum("n").alias("group_size"), F.max("top").alias("keep_id")))
        out = judged(rows, totals, ["digest"])
        if clash:
            apart = kept(docs.groupBy("digest", "text").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")))
            out = out.union(judged(docs, apart, ["digest", "text"]))
        return out

    def _all(self, parts: list[DataFrame], schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        for df in parts:
            out = out.union(df.select(out.columns))
        return out

    def close(self) -> None:
        """Removes the snapshots' texts; verdicts given before stay readable."""
        for s in self.snapshots:
            self.spark.sql(f"DROP TABLE IF EXISTS {s.table}")
            discard(self.spark, s.path)


def judged(rows: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """The verdict on each row from the totals of its group."""
    all_rows = totals.agg(F.sum("group_size")).first()[0] or 0
    large = F.col("group_size") > all_rows * HEAVY
    rows = rows.groupBy(*by, "doc_id").agg(F.count("*").alias("copies"))
    met = rows.join(F.broadcast(totals.filter(large)), by, "left")
    few = met.filter("group_size is null").drop("group_size", "keep_id").join(totals.filter(~large), by)
    met = met.filter("group_size is not null").unionByName(few)
    # repeated rows are written out one by one, from arrays of bounded length
    met = met.withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), "copies", F.lit(COPIES).cast("long"))))
    met = met.withColumn("copy", F.explode(F.sequence("from", F.least("copies", F.col("from") + COPIES - 1))))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return met.select("doc_id", "digest", "keep_id", "group_size", stays.alias("kept"))


def exact_duplicates(docs: DataFrame, batches: int = 3) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) for each row of docs (doc_id, text), taken in as `batches` batches by rising doc_id.

    The batches' bounds are approximate quantiles of doc_id and change no verdict. For nulls, repeated rows, other columns and empty
    tables see Store.
    """
    store = Store(docs.sparkSession)
    share = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), share, 1000)).first()[0] or []
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + F.coalesce((F.col("doc_id") > cut).cast("int"), F.lit(0))
    for i in range(batches):
        store.add(docs.filter(batch == i))
    found = kept(store.verdicts())
    store.close()
    return found
