"""Carrying result tables to the rows of a big one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(big: DataFrame, small: DataFrame, on: list[str], parts: int) -> DataFrame:
    """Inner join of many rows with an aggregated table of unique keys.

    A key may hold most rows of the big side, so each key is dealt to
    ``parts`` tasks by a hash of the row, and the small side is repeated for
    each of them. Neither side is collected or hinted, whatever its size.
    """
    dealt = big.withColumn("_part", F.pmod(F.xxhash64(*big.columns), F.lit(parts)))
    copies = small.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return dealt.join(copies, [*on, "_part"]).drop("_part")
