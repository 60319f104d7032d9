"""Stratified split, standardisation and training-set assembly."""

from __future__ import annotations

import math

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftspark.functions.stats import d, key_hash, known
from shiftspark.spec import ORIGINAL_SAMPLE_SHARE, ObsSpec

HASH_RANGE = 4294967296
COARSE = 4096


def row_hash(keys: list[str]) -> Column:
    """Hash of several integer key columns, each folded into the one before."""
    h = key_hash(keys[0])
    for k in keys[1:]:
        h = key_hash(h + F.col(k).cast("long"))
    return h


def split_quotas(class_sizes: dict[int, int], held_out: float = 0.4, halved: float = 0.5) -> dict[int, tuple[int, int, int]]:
    """Rows per class for train, validation and test.

    First ``held_out`` of all rows leave the training part, then ``halved`` of
    those make the test part; both sizes are rounded up, and classes share a
    size by largest remainder."""
    n = sum(class_sizes.values())
    out = _shared(class_sizes, math.ceil(held_out * n))
    test = _shared(out, math.ceil(halved * sum(out.values())))
    return {c: (class_sizes[c] - out[c], out[c] - test[c], test[c]) for c in class_sizes}


def _shared(sizes: dict[int, int], total: int) -> dict[int, int]:
    n = sum(sizes.values())
    exact = {c: total * s / n for c, s in sizes.items()}
    got = {c: math.floor(x) for c, x in exact.items()}
    left = total - sum(got.values())
    for c in sorted(sizes, key=lambda c: (got[c] - exact[c], c))[:left]:
        got[c] += 1
    return got


def stratified_split(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Adds ``split`` (train / val / test) with exact quotas per class.

    Rows are ordered by the hash of their keys, then by the keys. Only the
    places where an order is *cut* are looked up: counts per range tell in
    which range a quota ends, that range is counted in finer ranges, and so on
    until it holds one key. The rows themselves are then labelled by
    comparison, without a shuffle or a sort. Rows that agree in all keys stay
    on one side; with unique keys the quotas are exact.
    """
    h = row_hash(keys)
    order = ["_h", *keys]
    hashed = df.filter(F.col(label).isNotNull()).select(
        F.col(label).cast("int").alias("_y"), h.alias("_h"), *[F.col(k).cast("long").alias(k) for k in keys]
    )
    sizes = {r["_y"]: r["count"] for r in hashed.groupBy("_y").count().collect()}
    quotas = split_quotas(sizes)
    wanted = {(y, cut): sum(quotas[y][: cut + 1]) for y in sizes for cut in (0, 1)}
    cuts = cut_rows(hashed, "_y", order, {c: rank for c, rank in wanted.items() if rank > 0}, (0, HASH_RANGE - 1))
    return df.withColumn("split", _split_label(label, keys, h, cuts, quotas))


def cut_rows(
    rows: DataFrame, group: str, order: list[str], wanted: dict[tuple, int], span: tuple[int, int]
) -> dict[tuple, tuple]:
    """For each (group value, name) the values of the ``order`` columns, longs, of the row with the wanted 1-based rank.

    Histogram selection: each pass counts, for all ranks still open at once,
    the rows in at most COARSE + 2 ranges of the first order column that is
    not yet fixed, and keeps the range that holds the rank. The first pass
    counts all rows between the ends of ``span``; later ones, over what is
    left, also take the least and the greatest row of each range. These agree
    in the columns that are fixed by now; if they agree in all, the row is
    found. A pass is one map-side aggregation, so a range may hold any number
    of rows.
    """
    whole = lambda value: (value, *[0] * (len(order) - 1))
    open_ = {c: (rank, 0, whole(span[0]), whole(span[1])) for c, rank in wanted.items()}
    found: dict[tuple, tuple] = {}
    ends = []
    while open_:
        names, cells = sorted(open_), []
        for i, c in enumerate(names):
            _, at, least, most = open_[c]
            inside = (F.col(group) == c[0]) & F.col(order[at]).between(least[at], most[at])
            for k in range(at):
                inside = inside & (F.col(order[k]) == least[k])
            width = (most[at] - least[at]) // COARSE + 1
            part = F.expr(f"`{order[at]}` div {width}L")
            cells.append(F.when(inside, F.struct(F.lit(i).alias("i"), part.alias("part"))))
        hit = F.filter(F.array(*cells), lambda x: x.isNotNull())
        counts = rows.select(F.struct(*order).alias("row"), F.inline(hit)).groupBy("i", "part")
        counts = counts.agg(F.count("*").alias("n"), *ends).collect()
        for i, c in enumerate(names):
            rank, at, least, most = open_[c]
            for r in sorted((r for r in counts if r["i"] == i), key=lambda r: r["part"]):
                if rank <= r["n"]:
                    break
                rank -= r["n"]
            if not ends:
                width = (most[at] - least[at]) // COARSE + 1
                open_[c] = (rank, at, whole(r["part"] * width), whole(r["part"] * width + width - 1))
                continue
            least, most = tuple(r["least"]), tuple(r["most"])
            at = next((k for k in range(len(order)) if least[k] != most[k]), None)
            if at is None:
                found[c] = least
                del open_[c]
            else:
                open_[c] = (rank, at, least, most)
        ends = [F.min("row").alias("least"), F.max("row").alias("most")]
    return found


def _split_label(label: str, keys: list[str], h: Column, cuts: dict, quotas: dict) -> Column:
    place = F.struct(h.alias("h"), *[F.col(k).cast("long").alias(k) for k in keys])
    out = F.lit(None).cast("string")
    for y in quotas:
        mine = F.lit("test")
        for cut, name in ((1, "val"), (0, "train")):
            if (y, cut) in cuts:
                limit = F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(["h", *keys], cuts[(y, cut)])])
                mine = F.when(place <= limit, name).otherwise(mine)
        out = F.when(F.col(label) == y, mine).otherwise(out)
    return out


def hash_split(df: DataFrame, keys: list[str], shares: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """The cheap split: one expression, shares met on average, no pass over the data."""
    u = row_hash(keys) / d(HASH_RANGE)
    return df.withColumn("split", F.when(u < d(shares[0]), "train").when(u < d(shares[1]), "val").otherwise("test"))


Scaler = dict[str, tuple[float, float]]


def fit_scaler(train: DataFrame, features: list[str]) -> Scaler:
    """Mean and population standard deviation per feature; a constant has scale 1."""
    aggs = []
    for f in features:
        aggs += [F.avg(known(f)).alias(f"m_{f}"), F.stddev_pop(known(f)).alias(f"s_{f}")]
    row = train.agg(*aggs).first()
    return {f: (row[f"m_{f}"] or 0.0, row[f"s_{f}"] or 1.0) for f in features}


def standardize(df: DataFrame, scaler: Scaler, suffix: str = "") -> DataFrame:
    """(x - mean) / scale; in place, or as extra columns with a suffix."""
    return df.withColumns({f + suffix: (known(f) - d(m)) / d(s) for f, (m, s) in scaler.items()})


def scaler_stage(scaler: Scaler, suffix: str = "_z") -> SQLTransformer:
    """The scaler as a pipeline stage that is saved with the model."""
    cols = ", ".join(
        f"(CASE WHEN NOT isnan(CAST(`{f}` AS DOUBLE)) THEN CAST(`{f}` AS DOUBLE) END - {m!r}D) / {s!r}D AS `{f}{suffix}`"
        for f, (m, s) in scaler.items()
    )
    return SQLTransformer(statement=f"SELECT *, {cols} FROM __THIS__")


def retraining_set(
    df: DataFrame,
    spec: ObsSpec,
    days: int,
    keys: list[str],
    share: float = ORIGINAL_SAMPLE_SHARE,
) -> DataFrame:
    """The last ``days`` of production with a fixed share of the baseline.

    The sample is taken by key hash, so it is the same in every run."""
    is_base = F.col(spec.scenario) == spec.baseline
    newest = df.filter(~is_base).agg(F.max(spec.event_time).alias("t"))
    recent = df.filter(~is_base & (F.col(spec.event_time) > newest.scalar() - F.make_dt_interval(F.lit(days))))
    kept = df.filter(is_base & (row_hash(keys) < F.lit(int(share * HASH_RANGE)).cast("long")))
    return recent.withColumn("origin", F.lit("recent")).unionByName(kept.withColumn("origin", F.lit("original")))
