"""Statistical column expressions used by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KS_SERIES_TERMS = 100
KS_SMALL_LAMBDA = 0.2
# Fixed value: larger sample up to which the two-sample p-value is exact by default.
KS_EXACT_ROWS = 10_000
ZERO_SHARE = 1e-6


def d(x: float) -> Column:
    """A DOUBLE literal (a bare 0.5 in SQL text would be DECIMAL)."""
    return F.lit(float(x))


def known(col: str | Column) -> Column:
    """The value as DOUBLE with NaN turned into NULL: both mean 'missing'."""
    c = F.col(col) if isinstance(col, str) else col
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def ratio(num: Column, den: Column) -> Column:
    """num / den, and 0 where the denominator is 0; NULL stays NULL."""
    return F.when(den.isNull() | num.isNull(), F.lit(None).cast("double")).otherwise(
        F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(d(0))
    )


def ks_lambda(stat: Column, n1: Column, n2: Column) -> Column:
    """Scaled KS distance with the published small-sample correction."""
    en = (n1.cast("double") * n2.cast("double")) / (n1 + n2).cast("double")
    root = F.sqrt(en)
    plain = stat * root
    return plain + d(1) / (root * d(6)) + (plain - d(1)) / (en * d(4))


def ks_pvalue(stat: Column, n1: Column, n2: Column) -> Column:
    """Two-sided two-sample KS p-value: the limiting series at the corrected
    distance, clamped to [0, 1]. For use on result-sized tables."""
    lam = ks_lambda(stat, n1, n2)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_SERIES_TERMS)),
        d(0),
        lambda acc, j: acc
        + F.when(j % 2 == 1, d(1)).otherwise(d(-1))
        * F.exp(d(-2) * j.cast("double") * j.cast("double") * lam * lam),
    )
    p = F.greatest(d(0), F.least(d(1), series * d(2)))
    return F.when(lam < d(KS_SMALL_LAMBDA), d(1)).otherwise(p)


def ks_pvalue_exact(stat: Column, n1: Column, n2: Column) -> Column:
    """Exact two-sided two-sample KS p-value: the share of all orders of the
    pooled sample whose distance is at least ``stat``.

    An order is a lattice path from (0, 0) to (n1, n2), which leaves the band
    |i / n1 - j / n2| < stat or does not. Drawing the pooled values one by one,
    the state is the probability of each i with the band not left so far; it
    is as long as the band is wide. What steps out of it is added up, so small
    p-values keep their digits. For use on result-sized tables."""
    n1, n2 = n1.cast("long"), n2.cast("long")
    whole = n1 + n2
    # i / n1 - j / n2 in steps of 1 / (n1 n2)
    width = F.round(stat * n1 * n2).cast("long")
    start = F.struct(F.array(d(1)).alias("inside"), F.lit(0).cast("long").alias("first"), d(0).alias("outside"))

    def draw(state: Column, s: Column) -> Column:
        inside, first, size = state["inside"], state["first"], F.size(state["inside"])
        left = (whole - s).cast("double")

        def at(k: Column) -> Column:
            i = first + k
            from_2 = F.coalesce(F.get(inside, k), d(0)) * (n2 - s + i) / left
            from_1 = F.coalesce(F.get(inside, k - 1), d(0)) * (n1 - i + 1) / left
            return from_2 + from_1

        reached = F.transform(F.sequence(F.lit(0), size), at)
        middle = (s + 1) * n1
        low = F.greatest(first, F.floor((middle - width) / whole) + 1)
        high = F.least(first + size, F.ceil((middle + width) / whole) - 1)

        def settled(row: Column) -> Column:
            below = F.when(low > first, F.get(row, F.lit(0))).otherwise(d(0))
            above = F.when(high < first + size, F.get(row, size)).otherwise(d(0))
            kept = F.slice(row, (low - first + 1).cast("int"), F.greatest(high - low + 1, F.lit(0)).cast("int"))
            return F.struct(kept.alias("inside"), low.alias("first"), (state["outside"] + below + above).alias("outside"))

        # The list is named by a transform of one element, so it is computed once.
        return F.get(F.transform(F.array(reached), settled), F.lit(0))

    end = F.aggregate(F.sequence(F.lit(0).cast("long"), whole - 1), start, draw)
    return F.when(width <= 0, d(1)).otherwise(F.least(d(1), end["outside"]))


def cohens_d(mean_a: Column, std_a: Column, mean_b: Column, std_b: Column) -> Column:
    """(mean_a - mean_b) over the root mean of both variances; 0 when that is not > 0."""
    pooled = F.sqrt((std_a * std_a + std_b * std_b) / d(2))
    return F.when(pooled > d(0), (mean_a - mean_b) / pooled).otherwise(d(0))


def psi_term(ref_share: Column, share: Column) -> Column:
    """One bin's contribution, with empty bins lifted to a small share."""
    p = F.when(ref_share == d(0), d(ZERO_SHARE)).otherwise(ref_share)
    q = F.when(share == d(0), d(ZERO_SHARE)).otherwise(share)
    return (q - p) * F.log(q / p)


def key_hash(key: str | Column) -> Column:
    """Deterministic spread of an integer key over [0, 2**32): a multiplicative
    hash with the 32-bit golden-ratio factor. The same integers come out of any
    SQL engine, so samples and splits can be reproduced elsewhere."""
    c = F.col(key) if isinstance(key, str) else key
    folded = F.pmod(c.cast("long"), F.lit(2147483648).cast("long"))
    return F.pmod(folded * F.lit(2654435761).cast("long"), F.lit(4294967296).cast("long"))


def grid_index(x: Column, steps: int) -> Column:
    """Index i of the last point i/steps that is <= x.

    The product x*steps may land one off next to a point, so the guess is
    checked against the exact points on both sides."""
    s = d(steps)
    guess = F.floor(x * s).cast("int")
    return (
        F.when(x < guess.cast("double") / s, guess - 1)
        .when(x >= (guess + 1).cast("double") / s, guess + 1)
        .otherwise(guess)
    )


def count_where(cond: Column) -> Column:
    """COUNT of rows where the condition holds, never NULL."""
    return F.count(F.when(cond, F.lit(1)))
