"""Exact n-gram Jaccard join: fragments of the global n-gram order, partial overlaps, sums per pair.

Every text becomes the set of its distinct word n-grams, as 64-bit hashes. All texts with one set form a class; classes are the
nodes, and only links between different classes are looked for.

* Global order: n-grams that occur in many texts of one task's slice come last, and hashes decide otherwise. Any fixed order gives
  the same links; this one keeps passages that many texts share out of the prefixes.
* Candidates: two sets that are similar enough share an n-gram of their prefixes (prefix, length and position filters).
* Verification: each class has a parity bitmap, a few bits for each of its n-grams. The bits in which two bitmaps differ are at most as
  many as the n-grams that only one of the two sets has, so pairs that differ in too many bits drop out, and no other. For those left the
  order is cut into FRAGMENTS ranges: a row for each pair and range counts the common n-grams of that range, and these are summed per pair.
* Only components are asked for. First each row of a prefix list is verified with the NEIGHBOURS rows before it and the
  list's first HUBS; then, in longer lists
  that hold more than one component, all pairs between different components whose signatures, bitmaps folded to LEAST_BITS, don't rule them out.
  Pairs within a component need no test, so that a group of k near copies costs about k pairs instead of k * k / 2. No candidate is dropped otherwise:
  no cap on lists or partners.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from shiftspark.llm.common import Bits, components, hashed, kept, lowered, mix, raw, slices, windows, words

#: Ranges of the n-gram order.
FRAGMENTS = 4
#: Text bytes whose n-grams a task works on at once.
SET_BYTES = 2 << 20
#: Bits of a bitmap for each n-gram of its set, at least, and of any bitmap; powers of two.
GRAM_BITS, LEAST_BITS = 2, 256
#: An n-gram counts towards the frequent ones if it is in so many texts of a slice; it is frequent from so many in all.
LOCAL, FREQUENT = 3, 16
#: Parts into which the list of a frequent n-gram is split when neighbours are linked, other parts for each n-gram, how many neighbours a row is tested with, and
#: how many of the list's first.
SALTS, NEIGHBOURS, HUBS = 16, 3, 2


def doc_sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text, sorted within the text; the offset of each text; the class of each text."""
    data, off = raw(batch.column("text"))
    data = lowered(data)
    start, end, doc = words(data, off)
    grams, whole = windows(hashed(data, start, end), doc, size)
    n_words = np.bincount(doc, minlength=batch.num_rows)
    first = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    whole[first[(n_words > 0) & (n_words < size)]] = True
    grams, doc = grams[whole], doc[whole]
    cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
    sets = [np.unique(grams[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    lengths = np.array([len(s) for s in sets], np.int64)
    grams = np.concatenate(sets) if sets else grams[:0]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams), dtype=np.uint64)])
    other = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    cls = mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ mix(other[bounds[1:]] - other[bounds[:-1]]) ^ mix(lengths.astype(np.uint64)))
    return grams, bounds, cls


def bitmap(grams: np.ndarray) -> bytes:
    """Bits that say which values of the n-grams' low bits occur an odd number of times."""
    size = max(LEAST_BITS, 1 << (GRAM_BITS * len(grams) - 1).bit_length())
    value, n = np.unique(grams & np.uint64(size - 1), return_counts=True)
    odd = np.zeros(size, bool)
    odd[value[n % 2 == 1].astype(np.int64)] = True
    return np.packbits(odd).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """The bits in which two bitmaps differ, the larger one folded to the size of the smaller."""
    x, y = (np.frombuffer(v, np.uint64) for v in (x, y))
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), 0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def signature(bits: bytes) -> np.ndarray:
    """A bitmap folded to LEAST_BITS, as uint64: two of them differ in no more bits than the bitmaps."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, LEAST_BITS // 64), 0)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """Of each text its id, set size, class, bitmap and its signature; besides, n-grams that are in LOCAL or more texts of a slice, with their
    number there."""
    names = ["doc_id", "n", "cls", "gram", "bits", "sig"]
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SET_BYTES):
            grams, bounds, cls = doc_sets(b, size)
            bits = [bitmap(grams[i:j]) if j > i else None for i, j in zip(bounds[:-1], bounds[1:])]
            sig = pa.array([signature(x).view(np.int64) if x else None for x in bits], kind)
            cols = [b.column("doc_id"), pa.array(np.diff(bounds)), signed(cls), pa.nulls(len(cls), pa.int64()), pa.array(bits, pa.binary()), sig]
            yield pa.RecordBatch.from_arrays(cols, names)
            _, one = np.unique(cls, return_index=True)
            take = np.zeros(len(cls), bool)
            take[one] = True
            found, n = np.unique(grams[np.repeat(take, np.diff(bounds))], return_counts=True)
            found, n = found[n >= LOCAL], n[n >= LOCAL]
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(n), none, signed(found), pa.nulls(len(n), pa.binary()), pa.nulls(len(n), kind)], names)

    return docs.mapInArrow(run, "doc_id long, n long, cls long, gram long, bits binary, sig array<long>")


def prefixes(docs: DataFrame, size: int, frequent: Bits, percent: int) -> DataFrame:
    """(gram, cls, n, pos, salt): the first n-grams of each class in the global order, once for each task at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches, limit=SET_BYTES):
            grams, bounds, cls = doc_sets(b, size)
            lengths = np.diff(bounds)
            new = np.zeros(len(cls), bool)
            for i, c in enumerate(cls.tolist()):
                if lengths[i] and c not in seen:
                    new[i] = True
                    seen.add(c)
            if len(seen) > 1 << 20:
                seen.clear()
            often = frequent.has(grams)
            doc = np.repeat(np.arange(len(cls)), lengths)
            order = np.argsort(doc * 2 + often, kind="stable")
            pos = np.arange(len(grams)) - bounds[:-1][doc]
            length = lengths - -(-percent * lengths // 100) + 1
            take = (pos < length[doc]) & new[doc]
            at, doc, pos = order[take], doc[take], pos[take]
            salt = np.where(often[at], mix(cls[doc] ^ grams[at]) % np.uint64(SALTS) + np.uint64(1), np.uint64(0)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [signed(grams[at]), signed(cls[doc]), pa.array(lengths[doc].astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(salt)],
                ["gram", "cls", "n", "pos", "salt"],
            )

    return docs.mapInArrow(run, "gram long, cls long, n int, pos int, salt int")


def segments(docs: DataFrame, size: int, wanted: Bits) -> DataFrame:
    """(cls, fragment, n, grams) of the classes in `wanted`: a row for each range of the order that holds n-grams of the class."""
    shift = np.uint64(64 - (FRAGMENTS - 1).bit_length())
    kind = T.StructType.fromDDL("cls long, fragment int, n int, grams array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches, limit=SET_BYTES):
            grams, bounds, cls = doc_sets(b, size)
            out = []
            for i in np.flatnonzero(wanted.has(cls) & (np.diff(bounds) > 0)):
                if (c := int(cls[i])) in seen:
                    continue
                seen.add(c)
                own = grams[bounds[i] : bounds[i + 1]]
                cut = np.searchsorted(own >> shift, np.arange(FRAGMENTS + 1))
                out += [(c, f, len(own), own[x:y].view(np.int64)) for f, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]
            if len(seen) > 1 << 20:
                seen.clear()
            if out:
                c, f, n, own = zip(*out)
                cols = [signed(np.array(c, np.uint64)), pa.array(f, pa.int32()), pa.array(n, pa.int32()), pa.array(list(own), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, kind.names)

    return docs.mapInArrow(run, kind).dropDuplicates(["cls", "fragment"])


def both_ends(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) with the other columns of both classes, which end in _a and _b."""
    a, b = (classes.select(F.col("cls").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in classes.columns if c != "cls")) for x in "ab")
    return pairs.join(a, "a").join(b, "b")


def plausible(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes but those whose bitmaps (cls, n, bits) differ too much for similar sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            away = np.fromiter(map(differing, batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist()), np.int64, len(n))
            # 2 * i <= n - away, and (100 + percent) * i >= percent * n
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * ((n - away) // 2) >= percent * n))

    return both_ends(pairs, bitmaps).select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, bitmaps: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough: partial overlaps are counted fragment by fragment and summed per pair."""
    pairs = kept(plausible(pairs, bitmaps, percent))
    wanted = Bits(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")), "cls")
    parts = segments(docs, size, wanted)
    end = lambda c: parts.select(F.col("cls").alias(c), "fragment", F.col("n").alias(f"n_{c}"), F.col("grams").alias(f"grams_{c}"))
    asked = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    met = asked.join(end("a"), ["a", "fragment"]).join(end("b"), ["b", "fragment"])
    partial = met.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("overlap"))
    total = partial.groupBy("a", "b").agg(F.sum("overlap").alias("i"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    # 100 * i >= percent * (n_a + n_b - i)
    return total.filter((100 + percent) * F.col("i") >= percent * (F.col("n_a") + F.col("n_b")).cast("long")).select("a", "b")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class, component_id) for each row of docs (doc_id, text), other columns aside.

    Two texts link when 100 * intersection >= percent * union of their sets of `size`-word shingles (A-Z lowered); component_id is the
    smallest doc_id that links reach. A text of fewer words has its whole sequence as its one shingle. Texts that are null, empty or
    without words have an empty set, link with nothing and are their own component; so their class is null. Rows with a null doc_id
    link others but never name a component. Repeated ids give one row each; a row of an empty set has its own id. An empty table
    gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = kept(profiles(docs, size))
    frequent = Bits(own.filter("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT), "gram")
    bitmaps = own.filter("n > 0 and gram is null").select("cls", "n", "bits").dropDuplicates(["cls"])
    signatures = own.filter("n > 0 and gram is null").select("cls", "sig").dropDuplicates(["cls"])
    own = own.filter("gram is null").select("doc_id", "n", "cls")

    most = lambda a, n_a, b, n_b: 1 + F.least(n_a - a - 1, n_b - b - 1)
    fits = lambda a, n_a, b, n_b: (100 + percent) * most(a, n_a, b, n_b).cast("long") >= percent * (n_a + n_b).cast("long")
    # texts with little of their own come first: in a group of near copies most others are near to them
    by_pos = W.Window.partitionBy("gram", "salt").orderBy("pos", F.xxhash64("gram", "cls"))
    # dealt out before the columns that only the windows need are added
    near = prefixes(docs, size, frequent, percent).repartition("gram", "salt").withColumn("own", F.struct("cls", "n", "pos"))
    lags = [F.lag("own", k).over(by_pos) for k in range(1, NEIGHBOURS + 1)]
    before = F.array(*lags, *(F.nth_value("own", k).over(by_pos) for k in range(1, HUBS + 1)))
    near = near.withColumns({"before": before, "list": F.count("*").over(by_pos.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing))})
    # copies of one class that several tasks have sent stand side by side: one row of them is enough
    near = near.filter((F.col("before")[0]["cls"] != F.col("cls")) | (F.col("before")[0].isNull() & ((F.col("salt") > 0) | (F.col("list") > NEIGHBOURS + 1))))
    tested = F.filter("before", lambda x: (x["cls"] != F.col("cls")) & fits(F.col("pos"), F.col("n"), x["pos"], x["n"]))
    near = near.withColumn("before", F.array_distinct(F.transform(tested, lambda x: x["cls"]))).withColumn("long", (F.col("salt") > 0) | (F.col("list") > NEIGHBOURS + 1))
    near = kept(near.filter("long or size(before) > 0").select("gram", "cls", "n", "pos", "before", "long"))
    chain = near.select("cls", F.explode("before").alias("x")).select(F.least("cls", "x").alias("a"), F.greatest("cls", "x").alias("b"))
    chain = kept(chain.distinct())
    links = kept(verified(chain, docs, bitmaps, size, percent))

    so_far = components(links)
    # all pairs of the shorter lists are tested by now
    near = near.filter("long").select("gram", "cls", "n", "pos").join(so_far.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = near.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("gram")
    near = kept(near.join(mixed, "gram").join(signatures, "cls"))
    # components of a list of which not even the best rows fit are left out
    groups = near.groupBy("gram", "root").agg(F.max(F.col("n") - F.col("pos")).alias("rest"), F.min("n").alias("least"))
    group = lambda r: groups.select("gram", F.col("root").alias(r), F.col("rest").alias(f"rest_{r}"), F.col("least").alias(f"least_{r}"))
    able = (100 + percent) * F.least("rest_x", "rest_y").cast("long") >= percent * (F.col("least_x") + F.col("least_y")).cast("long")
    x = group("x").join(group("y"), "gram").filter((F.col("x") < F.col("y")) & able).select("gram", "x", "y")
    side = lambda r, c: near.select("gram", F.col("root").alias(r), F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("pos").alias(f"pos_{c}"), F.col("sig").alias(f"sig_{c}"))
    # the same bound as that of whole bitmaps, as a condition of the join: what it rules out never becomes a row
    away = reduce(lambda v, w: v + w, (F.bit_count(F.col("sig_p")[i].bitwiseXOR(F.col("sig_q")[i])) for i in range(LEAST_BITS // 64)))
    n_both = F.col("n_p") + F.col("n_q")
    alike = (100 + percent) * F.floor((n_both - away) / 2) >= percent * n_both.cast("long")
    cross = x.join(side("x", "p"), ["gram", "x"]).join(side("y", "q"), ["gram", "y"]).filter(fits(*map(F.col, ("pos_p", "n_p", "pos_q", "n_q"))) & alike)
    cross = cross.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).filter("a <> b").distinct().join(chain, ["a", "b"], "left_anti")
    more = kept(verified(kept(cross), docs, bitmaps, size, percent))

    final = components(links.union(more))
    own = own.withColumn("class", F.when(F.col("n") > 0, F.col("cls"))).join(final.withColumnRenamed("node", "class"), "class", "left")
    own = kept(own.select("doc_id", F.col("n").alias("n_shingles"), "class", F.coalesce("root", "class").alias("root")))
    least = own.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return own.join(least, "root", "left").select("doc_id", "n_shingles", "class", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
