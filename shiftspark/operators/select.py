"""Column selection, filters and clipping."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.functions.stats import known
from shiftspark.spec import ObsSpec


def split_label(df: DataFrame, spec: ObsSpec) -> tuple[DataFrame, DataFrame]:
    """The table without the label, and the label alone."""
    return df.drop(spec.label), df.select(spec.label)


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def schema_faults(df: DataFrame, columns: list[str], numeric: Collection[str] = ()) -> list[str]:
    """What keeps a table from having these columns, some of them as numbers; one text for each fault."""
    kinds = dict(df.dtypes)
    faults = []
    for c in columns:
        if c not in kinds:
            faults.append(f"{c} is absent")
        elif c in numeric and not kinds[c].startswith(NUMBERS):
            faults.append(f"{c} holds {kinds[c]} and no numbers")
    return faults


def demand(df: DataFrame, columns: list[str], numeric: Collection[str] = ()) -> DataFrame:
    """The table itself, or an error that names all faults at once."""
    faults = schema_faults(df, columns, numeric)
    if faults:
        raise ValueError("the table does not fit: " + "; ".join(faults))
    return df


def strict_select(df: DataFrame, columns: list[str], numeric: Collection[str] = ()) -> DataFrame:
    """Exactly these columns in this order."""
    return demand(df, columns, numeric).select(*columns)


def common_features(spec: ObsSpec, *frames: DataFrame) -> list[str]:
    """Declared features that every table has, in declared order."""
    return [f for f in spec.features if all(f in df.columns for df in frames)]


def features_long(df: DataFrame, spec: ObsSpec) -> DataFrame:
    """(scenario, feature, value) without missing values.

    Values are cleaned while the table is still wide, so the scan reads only
    the scenario and the features."""
    have = common_features(spec, df)
    wide = df.select(spec.scenario_column(), *[known(f).alias(f) for f in have])
    return melt(wide, ["scenario"], have, "value").filter(F.col("value").isNotNull())


def melt(df: DataFrame, keys: list[str], cols: list[str], value: str) -> DataFrame:
    """One row per key and column: (keys.., feature, value).

    Written with a generator and not with ``unpivot``: where the result is
    used twice, Spark renames the copied columns, and only the generator's
    two copies are still recognised as the same work and share one shuffle.
    The filter on ``feature`` is there for the same reason: joins would add it
    to one of the copies.
    """
    if not cols:
        empty = df.limit(0).select(*keys, F.lit("").alias("feature"), F.lit(None).cast("double").alias(value))
        return empty
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias(value)) for c in cols])
    return df.select(*keys, F.inline(cells)).filter(F.col("feature").isNotNull())


def scenario_filter(df: DataFrame, spec: ObsSpec, *names: str) -> DataFrame:
    """Rows of the named scenarios; without names, of all but the baseline."""
    s = F.col(spec.scenario)
    return df.filter(s.isin(*names)) if names else df.filter(s != spec.baseline)


def winsorize(long: DataFrame, bounds: DataFrame) -> DataFrame:
    """Clips ``value`` to the (feature, lo, hi) bounds; missing stays missing.

    Bounds are as many as there are features, so they are always broadcast."""
    clipped = F.greatest(F.col("lo"), F.least(F.col("hi"), F.col("value")))
    return (
        long.join(F.broadcast(bounds.select("feature", "lo", "hi")), "feature")
        .withColumn("value", F.when(F.col("value").isNotNull(), clipped))
        .drop("lo", "hi")
    )
