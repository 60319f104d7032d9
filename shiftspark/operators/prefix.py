"""Distributed running sums over pre-aggregated, ordered values.

KS distances, AUC, curves and exact quantiles are all cumulative counts over
sorted values. A window partitioned by feature alone would sort a whole
feature in one task, so the value axis is cut into buckets: a window runs
inside each (key, bucket) and the totals of the earlier buckets, a table of
keys x buckets, are added. The cuts only balance the tasks; they never change
a result.

There is one path for every size. A column gets as many buckets as its rows
ask for, from quantiles of a sample: first coarse ones, then finer ones inside
each bucket that is still too full, until none is. A bucket that holds a
single value needs no cut, as equal values are one row by then.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shiftspark.functions.stats import known
from shiftspark.operators.select import melt

# Rows aimed at in a bucket, and sampled rows that a bucket's end is found by.
ROWS_PER_BUCKET = 1 << 22
SAMPLED_PER_BUCKET = 256
# Parts that one pass cuts a bucket into, and cuts + 1 that one step of the search looks through; a power of two.
FANOUT = 1024
# Cuts up to this many bytes go to every executor; more of them meet the rows by key.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Layout:
    """What one sizing pass found: rows, bucket cuts per column and, where a
    baseline was named, its smallest and largest value per column."""

    rows: int
    cuts: dict[str, list[float]]
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)

    @property
    def parts(self) -> int:
        """Tasks that the rows of one key are dealt to."""
        return max(1, -(-self.rows // ROWS_PER_BUCKET))


@dataclass(frozen=True)
class Running:
    """Sum of ``value`` over rows with the same ``keys`` and an order value <= this row's.

    ``out`` is the inclusive sum; on request ``out + '_total'`` is the sum over
    the whole key. ``peers`` says that an order value may occur more than once
    in a key; then ``out + '_here'`` is the sum at this very value.
    """

    out: str
    value: str
    keys: tuple[str, ...]
    total: bool = False
    peers: bool = False


def size_up(
    df: DataFrame,
    scenario: str,
    cols: list[str],
    n_buckets: int | None = None,
    baseline: str | None = None,
) -> Layout:
    """Counts rows and known values and finds baseline ranges in one map-side
    pass; then, for columns with more than one bucket's worth of values, cuts."""
    values = df.select(F.col(scenario).alias("_s"), *[known(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    aggs = [F.count("*").alias("n")]
    for i in range(len(cols)):
        aggs.append(F.count(f"_c{i}").alias(f"_n{i}"))
        if baseline is not None:
            own = F.when(F.col("_s") == baseline, F.col(f"_c{i}"))
            aggs += [F.min(own).alias(f"_lo{i}"), F.max(own).alias(f"_hi{i}")]
    found = values.agg(*aggs).first().asDict()
    wanted = {c: n_buckets or -(-found[f"_n{i}"] // ROWS_PER_BUCKET) for i, c in enumerate(cols)}
    share = 1.0 if n_buckets else SAMPLED_PER_BUCKET / ROWS_PER_BUCKET
    long = melt(df.select(*[known(c).alias(c) for c in cols]), [], cols, "value").filter("value IS NOT NULL")
    cuts = find_cuts(long, wanted, share)
    ranges = {c: (found[f"_lo{i}"], found[f"_hi{i}"]) for i, c in enumerate(cols) if found.get(f"_lo{i}") is not None}
    return Layout(found["n"], cuts, ranges)


def find_cuts(long: DataFrame, wanted: dict[str, int], share: float) -> dict[str, list[float]]:
    """Values that cut each feature of (feature, value) into about ``wanted`` buckets of equal rows.

    Each pass cuts every bucket that is still too full into up to FANOUT parts,
    by approximate quantiles of the sampled rows in it; n buckets take
    log(n) / log(FANOUT) passes, and one bucket takes none. At most ``wanted``
    numbers a feature reach the driver."""
    cuts: dict[str, list[float]] = {c: [] for c in wanted}
    parts = {(c, 0): n for c, n in wanted.items() if n > 1}
    # As SQL text: a thousand literals are parsed at once.
    probs = ", ".join(f"{i / FANOUT!r}D" for i in range(1, FANOUT))
    quantiles = F.expr(f"percentile_approx(value, array({probs}), {16 * FANOUT})")
    while parts:
        open_ = sorted({c for c, _ in parts})
        rows = long.filter(F.col("feature").isin(open_))
        if share < 1:
            rows = rows.filter(F.rand(42) < F.lit(share))
        cells = with_bucket(rows, "value", {c: cuts[c] for c in open_}, by="feature").groupBy("feature", "_bucket")
        left = {}
        for r in cells.agg(quantiles.alias("q")).toLocalIterator():
            c, cell = r["feature"], r["_bucket"]
            n = parts.get((c, cell), 1)
            k = min(n, FANOUT)
            at = [r["q"][i * FANOUT // k - 1] for i in range(1, k)]
            lower = cuts[c][cell - 1] if cell else float("-inf")
            left[c, cell] = (sorted({x for x in at if x > lower}), -(-n // k))
        parts = {}
        for c in open_:
            mine = {cell: v for (name, cell), v in left.items() if name == c}
            merged = sorted({*cuts[c], *(x for new, _ in mine.values() for x in new)})
            for cell, (new, more) in mine.items():
                if more > 1 and new:
                    first = bisect.bisect_right(merged, cuts[c][cell - 1]) if cell else 0
                    parts |= {(c, first + i): more for i in range(len(new) + 1)}
            cuts[c] = merged
    return cuts


def with_bucket(df: DataFrame, order: str, cuts: dict[str, list[float]], by: str | None = None) -> DataFrame:
    """Adds ``_bucket``: how many cuts are <= the order value.

    ``by`` names the column whose value picks the list of cuts; without it the
    single list holds for all rows. Long lists are laid out as a tree with
    FANOUT - 1 cuts in a node. On each level the rows meet their node by key
    and a binary search, written as one projection per halving, so it stays in
    generated code, finds the child. The lists' size is known here, so they
    are broadcast up to BROADCAST_BYTES and joined by key beyond.
    """
    lists = {k: v for k, v in cuts.items() if v}
    out = df.withColumn("_bucket", F.lit(0).cast("long"))
    if not lists:
        return out
    depth = 1
    while FANOUT**depth <= max(map(len, lists.values())):
        depth += 1
    small = 8 * sum(map(len, lists.values())) <= BROADCAST_BYTES
    for level in reversed(range(depth)):
        span = FANOUT**level
        nodes = [
            (k, at, v[at : at + FANOUT * span][span - 1 :: span][: FANOUT - 1])
            for k, v in lists.items()
            for at in range(0, len(v) + 1, FANOUT * span)
        ]
        if by is None and level == depth - 1:
            # One root for all rows; as SQL text, a thousand literals are parsed at once.
            ((_, _, root),) = nodes
            out = out.withColumn("_cuts", F.expr("array(" + ", ".join(f"CAST('{x!r}' AS DOUBLE)" for x in root) + ")"))
        else:
            table = df.sparkSession.createDataFrame(nodes, f"`{by or '_by'}` string, _bucket long, _cuts array<double>")
            table = table if by else table.drop("_by")
            out = out.join(F.broadcast(table) if small else table, [by, "_bucket"] if by else "_bucket", "left")
        out = out.withColumn("_child", F.lit(0))
        step = FANOUT // 2
        while step >= 1:
            # Beyond the end of a list there is NULL, which is not <= any value.
            here = F.get("_cuts", F.col("_child") + F.lit(step - 1))
            out = out.withColumn("_child", F.col("_child") + F.when(here <= F.col(order), F.lit(step)).otherwise(F.lit(0)))
            step //= 2
        out = out.withColumn("_bucket", F.col("_bucket") + F.col("_child").cast("long") * F.lit(span).cast("long")).drop("_cuts", "_child")
    return out


def running_sums(df: DataFrame, order: str, sums: list[Running]) -> DataFrame:
    """Adds the running sums; ``df`` carries ``_bucket``, which is dropped.

    What lies before a bucket enters as one *carry row* per (key, bucket)
    whose order value is NULL and so sorts first: the window adds it up with
    the rest and no join is needed. All windows are nested by key, so
    one exchange on the coarsest key and the bucket serves them all.
    """
    rows = df.withColumn("_carry", F.lit(False))
    for keys in sorted({s.keys for s in sums}):
        rows = rows.unionByName(_carry_rows(df, keys, sums), allowMissingColumns=True)
    for s in sorted(sums, key=lambda s: len(s.keys)):
        near = W.partitionBy(*s.keys, "_bucket")
        ordered = near.orderBy(order)
        frame = ordered.rangeBetween if s.peers else ordered.rowsBetween
        upto = frame(W.unboundedPreceding, W.currentRow)
        rows = rows.withColumn(s.out, F.sum(s.value).over(upto))
        if s.total:
            total = f"{s.out}_total"
            rows = rows.withColumn(total, F.max(total).over(upto))
        if s.peers:
            here = F.sum(s.value).over(ordered.rangeBetween(W.currentRow, W.currentRow))
            rows = rows.withColumn(f"{s.out}_here", here)
    return rows.filter(~F.col("_carry")).drop("_carry", "_bucket")


def with_lower(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Adds ``value + '_next'``: each value at the next lower order value of the
    key, NULL at the lowest. ``df`` carries ``_bucket`` and has an order value once in a key.

    Inside a bucket a window looks back one row. For a bucket's first row the
    greatest row of the nearest earlier bucket is meant; these rows, one for
    each key and bucket, enter as carry rows that sort first."""
    per_key = W.partitionBy(*keys).orderBy("_bucket")
    heads = df.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(*values), order).alias("_head"))
    before = F.lag("_head").over(per_key)
    carry = heads.select(*keys, "_bucket", F.lit(True).alias("_carry"), before.alias("_before"))
    carry = carry.select(*keys, "_bucket", "_carry", *[F.col(f"_before.{v}").alias(v) for v in values])
    rows = df.withColumn("_carry", F.lit(False)).unionByName(carry, allowMissingColumns=True)
    near = W.partitionBy(*keys, "_bucket").orderBy(order)
    rows = rows.withColumns({f"{v}_next": F.lag(v).over(near) for v in values})
    return rows.filter(~F.col("_carry")).drop("_carry")


def _carry_rows(df: DataFrame, keys: tuple[str, ...], sums: list[Running]) -> DataFrame:
    """One row per (key, bucket) with what lies before the bucket, for all sums of a key."""
    per_key = W.partitionBy(*keys)
    upto = per_key.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    mine = [s for s in sums if s.keys == keys]
    others = sorted({s.value for s in sums} - {s.value for s in mine})
    inside = df.groupBy(*keys, "_bucket").agg(*[F.sum(s.value).alias(f"_in_{s.out}") for s in mine])
    return inside.select(
        *keys,
        "_bucket",
        F.lit(True).alias("_carry"),
        *[(F.sum(f"_in_{s.out}").over(upto) - F.col(f"_in_{s.out}")).alias(s.value) for s in mine],
        *[F.sum(f"_in_{s.out}").over(per_key).alias(f"{s.out}_total") for s in mine if s.total],
        *[F.lit(0).cast("long").alias(v) for v in others],
    )


def picked_by_rank(rank: Column, cum: str, n: str, value: str) -> Column:
    """Aggregate: the value that holds a 0-based rank, given inclusive sums."""
    return F.max(F.when((F.col(cum) - F.col(n) <= rank) & (rank < F.col(cum)), F.col(value)))
