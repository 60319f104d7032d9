"""Display forms: rounding, labels of deltas and small text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shown(col: Column, places: int) -> Column:
    """Rounded, with -0.0 shown as 0.0."""
    return F.round(col, places) + F.lit(0.0)


def text_form(col: Column, places: int) -> Column:
    """The number as text with a fixed number of decimal places; missing as 0."""
    return F.format_string(f"%.{places}f", F.coalesce(col, F.lit(0.0)))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Every DOUBLE column rounded; other columns untouched."""
    cols = [
        shown(F.col(f"`{f.name}`"), places).alias(f.name)
        if isinstance(f.dataType, T.DoubleType)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*cols)


def out_of(n: Column, total: Column | int) -> Column:
    """'n/m' text."""
    t = total if isinstance(total, Column) else F.lit(total)
    return F.concat_ws("/", n.cast("string"), t.cast("string"))


def sign_label(delta: Column) -> Column:
    """'good' for a delta >= 0, 'bad' below, blank when missing."""
    return F.when(delta.isNull(), "").when(delta >= 0, "good").otherwise("bad")


def direction(delta: Column) -> Column:
    """'down' for a negative delta, else 'up'; to be shown beside abs(delta)."""
    return F.when(delta < 0, "down").when(delta.isNotNull(), "up")


def degraded(value: Column, base: Column, margin: float) -> Column:
    """True where a metric lies more than the margin below its baseline."""
    return value < base - F.lit(float(margin))


def slug(col: Column) -> Column:
    """Lower case with blanks as underscores, for file names."""
    return F.lower(F.regexp_replace(col, " ", "_"))
