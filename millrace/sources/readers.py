"""Typed sources and sinks.

Text becomes typed at the edge, with an explicit schema; range reads are by a declared
key. Retrying is Spark's: a failed task runs again, and its output counts once.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(kind: str):
    """Registers a reader: (spark, origin, **options) -> DataFrame."""

    def add(fn):
        READERS[kind] = fn
        return fn

    return add


def require(names: Sequence[str], options: Mapping[str, object]) -> None:
    missing = [n for n in names if options.get(n) is None]
    if missing:
        raise ValueError(f"missing options: {', '.join(missing)}")


def parse_options(text: str) -> dict[str, object]:
    """"name=value;name=value"; values that are literals become such, others stay text."""
    out: dict[str, object] = {}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        name, sep, value = part.partition("=")
        if not sep:
            raise ValueError(f"not name=value: {part}")
        try:
            out[name.strip()] = ast.literal_eval(value.strip())
        except (ValueError, SyntaxError):
            out[name.strip()] = value.strip()
    return out


def open_source(spark: SparkSession, origin: str, kind: str | None = None, **options) -> DataFrame:
    """Reads by kind, or by what the origin looks like: .csv, .tsv, .txt, .json, .orc, a catalog table, else Parquet."""
    if kind is None:
        tail = origin.rstrip("/").rsplit(".", 1)[-1].lower()
        kind = tail if tail in ("csv", "tsv", "txt", "json", "orc", "libfm") else "table" if "/" not in origin and spark.catalog.tableExists(origin) else "parquet"
    if kind not in READERS:
        raise ValueError(f"unknown kind of source: {kind}")
    return READERS[kind](spark, origin, **options)


@reader("csv")
def read_csv(spark: SparkSession, origin: str, schema: StructType | str | None = None, sep: str = ",", header: bool = False, **options) -> DataFrame:
    require(["schema"], {"schema": schema})
    return spark.read.csv(origin, schema=schema, sep=sep, header=header, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, **options)


@reader("tsv")
def read_tsv(spark: SparkSession, origin: str, schema: StructType | str | None = None, **options) -> DataFrame:
    return read_csv(spark, origin, schema, sep="\t", **options)


@reader("txt")
def read_lines(spark: SparkSession, origin: str) -> DataFrame:
    return spark.read.text(origin)


@reader("parquet")
def read_parquet(spark: SparkSession, origin: str, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    df = spark.read.parquet(origin)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


@reader("json")
def read_json(spark: SparkSession, origin: str, schema: StructType | str | None = None) -> DataFrame:
    require(["schema"], {"schema": schema})
    return spark.read.json(origin, schema=schema)


@reader("orc")
def read_orc(spark: SparkSession, origin: str) -> DataFrame:
    return spark.read.orc(origin)


@reader("table")
def read_table(spark: SparkSession, origin: str, columns: Sequence[str] | None = None, partition: Mapping[str, object] | None = None) -> DataFrame:
    df = spark.table(origin)
    for name, value in (partition or {}).items():
        df = df.where(F.col(name) == value)
    return df.select(*columns) if columns else df


@reader("images")
def read_images(spark: SparkSession, origin: str, glob: str = "*") -> DataFrame:
    """path, content, class (the name of the folder)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(origin)
    return df.select("path", "content", F.element_at(F.split("path", "/"), -2).alias("class"))


@reader("click_log")
def read_click_log(spark: SparkSession, origin: str, integers: int = 13, texts: int = 26) -> DataFrame:
    """label, I1.., C1..: tab-separated; blank integers are 0, blank texts ""."""
    names = ["label", *[f"I{k + 1}" for k in range(integers)], *[f"C{k + 1}" for k in range(texts)]]
    kinds = ["bigint"] * (1 + integers) + ["string"] * texts
    df = read_tsv(spark, origin, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return df.select(*[F.coalesce(n, F.lit(0) if k == "bigint" else F.lit("")).alias(n) for n, k in zip(names, kinds, strict=True)])


@reader("libfm")
def read_libfm(spark: SparkSession, origin: str, length: int | None = None) -> DataFrame:
    """label (1 if positive), features (array of text), line; see `encode_libfm` for ids."""
    parts = F.split(F.trim("value"), "\\s+")
    df = spark.read.text(origin).where(F.trim("value") != "").select((parts[0].cast("double") > 0).cast("bigint").alias("label"), F.slice(parts, 2, F.size(parts)).alias("features"), F.col("value").alias("line"))
    return df


def encode_libfm(df: DataFrame, order: str, length: int) -> DataFrame:
    """Ids by first appearance (from 1) in the given order, left-padded with 0: order, label, ids."""
    from millrace.functions.transforms import pad_left
    from millrace.operators.sharding import row_numbers

    each = df.select(order, "label", F.posexplode("features").alias("pos", "term"))
    first = each.groupBy("term").agg(F.min(F.struct(order, "pos")).alias("at"))
    ids = row_numbers(first.select("term", F.col(f"at.{order}").alias("_a"), F.col("at.pos").alias("_b")), ["_a", "_b"], "id").select("term", (F.col("id") + 1).alias("id"))
    joined = each.join(ids, "term").groupBy(order, "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("ids"))
    return joined.select(order, "label", pad_left(F.col("ids").cast("array<bigint>"), length).alias("ids"))


def label_codes(c: Column, codes: Mapping[str, int]) -> Column:
    """The code of a class name, NULL for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), c)


def features_and_label(df: DataFrame, features: Sequence[str], label: str | None = None, predicting: bool = False) -> DataFrame:
    """features array<float>, label; a missing label column is an error unless predicting."""
    array = F.array(*[F.col(f).cast("float") for f in features]).alias("features")
    if label is not None and label in df.columns:
        return df.select(array, F.col(label).alias("label"))
    if not predicting:
        raise ValueError(f"no label column: {label}")
    return df.select(array)


def census_rows(df: DataFrame, label: str = "label", drop: Sequence[str] = ()) -> DataFrame:
    """Rows without a missing value; the label is 0 for <=50K, else 1."""
    kept = df.drop(*drop).na.drop()
    return kept.withColumn(label, F.when(F.regexp_replace(label, "[.\\s]", "") == "<=50K", 0).otherwise(1).cast("bigint"))


def ordered_split(df: DataFrame, order: Sequence[str], share: float = 0.75) -> DataFrame:
    """`training`: whether a row is among the first share of all rows in the order."""
    from millrace.operators.sharding import row_numbers

    numbered = row_numbers(df, order, "_row")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return numbered.join(F.broadcast(total)).withColumn("training", F.col("_row") < F.floor(F.col("_n") * share)).drop("_row", "_n")


def row_range(df: DataFrame, order: Sequence[str], start: int, end: int) -> DataFrame:
    """Rows start..end-1 in the order of a declared key."""
    from millrace.operators.sharding import row_numbers

    return row_numbers(df, order, "_row").where((F.col("_row") >= start) & (F.col("_row") < end)).drop("_row")


def typed_record(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Columns cast to int, float or bytes for writing; empty values are 0, 0.0 or empty."""
    made = {"int": lambda c: F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")).cast("bigint"), F.lit(0)), "float": lambda c: F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")).cast("float"), F.lit(0.0).cast("float")), "bytes": lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")).cast("binary")}
    unknown = set(kinds.values()) - set(made)
    if unknown:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    return df.select(*[made[k](F.col(n)).alias(n) for n, k in kinds.items()])


def flatten_images(df: DataFrame, image: str, levels: int = 2) -> DataFrame:
    """`image`, nested arrays of numbers of so many levels, as one array<float>."""
    out = F.col(image)
    for _ in range(levels - 1):
        out = F.flatten(out)
    return df.withColumn(image, out.cast("array<float>"))


def first_share(df: DataFrame, order: Sequence[str], fraction: float) -> DataFrame:
    """The first floor(fraction * rows) rows in the order."""
    from millrace.operators.sharding import row_numbers

    total = df.agg(F.floor(F.count(F.lit(1)) * fraction).alias("_n"))
    return row_numbers(df, order, "_row").join(F.broadcast(total)).where(F.col("_row") < F.col("_n")).drop("_row", "_n")


def tuples(spark: SparkSession, make: Callable[[int], Iterable[tuple]], parts: int, schema: StructType | str) -> DataFrame:
    """Rows of a typed generator: make(part) yields the tuples of each of `parts` parts, in the tasks."""

    def run(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                rows = list(make(part))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names, arrow = kind.names, to_arrow_schema(kind)
    return spark.range(parts).repartition(parts, "id").mapInArrow(run, kind)


def write_shards(df: DataFrame, path: str, records_per_file: int) -> None:
    df.write.option("maxRecordsPerFile", records_per_file).mode("error").parquet(path)


def write_table(df: DataFrame, name: str, worker: Column | None = None) -> None:
    """Appends to a table, made if missing, in partitions worker=<i> if a worker column is given."""
    if worker is None:
        df.write.mode("append").saveAsTable(name)
    else:
        df.withColumn("worker", worker).write.mode("append").partitionBy("worker").saveAsTable(name)


def nonempty(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
