"""Observation tables, batches and metric records from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark.operators.select import demand
from shiftspark.spec import ObsSpec


def read_csv(spark: SparkSession, path: str, spec: ObsSpec, lenient: bool = True) -> DataFrame:
    """CSV with a header, columns in any order, features as DOUBLE.

    Only the header line is read ahead; types come from the declaration, not
    from a second pass. In strict mode every feature and the label must exist.
    """
    raw = spark.read.option("header", True).csv(path)
    if not lenient:
        demand(raw, [*spec.features, spec.label])
    typed = {f: F.col(f"`{f}`").cast("double") for f in spec.features if f in raw.columns}
    if spec.label in raw.columns:
        typed[spec.label] = F.col(f"`{spec.label}`").cast("double").cast("int")
    return raw.withColumns(typed)


def read_batches(spark: SparkSession, paths: dict[str, str], spec: ObsSpec) -> DataFrame:
    """Named batches in one table; columns that a batch lacks are NULL in its rows."""
    out = None
    for name, path in paths.items():
        part = read_csv(spark, path, spec).withColumn(spec.scenario, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_folder(spark: SparkSession, pattern: str, schema, spec: ObsSpec, fmt: str = "csv") -> DataFrame:
    """Many files of one layout in a single scan; the file name without its
    ending is the scenario."""
    reader = spark.read.schema(schema)
    rows = reader.option("header", True).csv(pattern) if fmt == "csv" else reader.format(fmt).load(pattern)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.[^.]*$", 1)
    return rows.select("*", F.url_decode(name).alias(spec.scenario))


# File headers up to this many bytes go to every executor; more of them meet the rows by key.
BROADCAST_BYTES = 64 << 20


def read_files(
    spark: SparkSession, pattern: str, spec: ObsSpec, more: tuple[str, ...] = (), name: Column | None = None
) -> DataFrame:
    """CSV files with differing columns in a single scan: the declared features
    as DOUBLE, the label as INT, the columns ``more`` as text, and the scenario.

    A first job finds the header line of every file; a file's header says
    where each column stands in its rows, and a column it lacks is NULL there.
    A header is the first line of a file, quoted or not, that holds a declared
    name; a file without one gives no rows. ``name`` gives the scenario from the ``_metadata`` column;
    by default it is the file's name without its ending. As many headers as
    files reach the driver, which lists the files anyway.
    """
    wanted = [*spec.features, spec.label, *more]
    names = F.array(*[F.lit(c) for c in wanted])
    name = F.regexp_extract(F.url_decode("_metadata.file_name"), r"^(.*?)\.[^.]*$", 1) if name is None else name
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
    cells = F.transform(F.split("value", ","), lambda c: F.trim(F.regexp_replace(c, r'^[\s\uFEFF]*"|"\s*$', "")))
    found = lines.filter("_at = 0").select("_file", cells.alias("cells"), F.monotonically_increasing_id().alias("place"))
    # A file's start is read by one task, in order.
    first = found.filter(F.arrays_overlap("cells", names)).groupBy("_file").agg(F.min_by("cells", "place").alias("cells"))
    headers = {r["_file"]: r["cells"] for r in first.collect()}
    width = max(map(len, headers.values()), default=1)
    places = [(f, [h.index(c) if c in h else None for c in wanted]) for f, h in headers.items()]
    table = spark.createDataFrame(places, "_file string, _places array<int>")
    if sum(len(f) + 4 * len(wanted) for f in headers) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    schema = ", ".join(f"c{i} string" for i in range(width))
    rows = spark.read.schema(schema).csv(pattern)
    row = F.array(*[F.col(f"c{i}") for i in range(width)])
    rows = rows.select(row.alias("_row"), F.col("_metadata.file_path").alias("_file"), name.alias("_name")).join(table, "_file")
    # The header line itself: every declared column holds its own name.
    at = {c: F.get("_row", F.get("_places", F.lit(i))) for i, c in enumerate(wanted)}
    own = [at[c].eqNullSafe(F.lit(c)) | F.get("_places", F.lit(i)).isNull() for i, c in enumerate(wanted)]
    is_header = own[0]
    for o in own[1:]:
        is_header = is_header & o
    typed = [at[f].cast("double").alias(f) for f in spec.features]
    typed.append(at[spec.label].cast("double").cast("int").alias(spec.label))
    return rows.filter(~is_header).select(*typed, *[at[c].alias(c) for c in more], F.col("_name").alias(spec.scenario))


def read_metrics(spark: SparkSession, path: str, default_model: str = "Random Forest") -> DataFrame:
    """One baseline record from JSON, nested under ``metrics`` or flat."""
    four = "f1_score double, auc_roc double, precision double, recall double"
    schema = f"baseline_model string, test_set_size long, metrics struct<{four.replace(' double', ': double')}>, {four}"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    names = ["f1_score", "auc_roc", "precision", "recall"]
    return rows.select(
        F.coalesce("baseline_model", F.lit(default_model)).alias("baseline_model"),
        "test_set_size",
        *[F.coalesce(F.col(f"metrics.{m}"), F.col(m)).alias(m) for m in names],
    )


def read_labelled(spark: SparkSession, path: str, spec: ObsSpec) -> DataFrame:
    """A validation CSV; an error names what is missing, the label included."""
    return read_csv(spark, path, spec, lenient=False)
