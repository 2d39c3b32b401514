"""Feature transforms: Column -> Column, built from built-in functions only.

A transform of a scalar is lifted to an array with ``over``. Missing values are NULL;
sentinels ("" and -1) become NULL, or are dropped from arrays, at the edge.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashing import hash_bucket

Transform = Callable[[Column], Column]


def over(transform: Transform) -> Transform:
    """The transform applied to each element of an array column."""
    return lambda c: F.transform(c, transform)


def over_sparse(transform: Transform) -> Transform:
    """The transform applied to the values of an array<struct<pos, value>>."""
    return lambda c: F.transform(c, lambda s: F.struct(s["pos"].alias("pos"), transform(s["value"]).alias("value")))


def normalizer(subtractor: float, divisor: float) -> Transform:
    """(x - subtractor) / divisor in 32-bit floats."""
    if divisor == 0:
        raise ValueError("the divisor must not be 0")
    return lambda x: ((x.cast("float") - F.lit(subtractor).cast("float")) / F.lit(divisor).cast("float")).cast("float")


def min_max(low: Column, high: Column) -> Transform:
    """(x - low) / (high - low), NULL where all values are the same."""
    return lambda x: (x.cast("double") - low) / F.nullif(high - low, F.lit(0.0))


def standardize(mean: Column, deviation: Column) -> Transform:
    return lambda x: (x.cast("double") - mean) / F.nullif(deviation, F.lit(0.0))


def bucketize(boundaries: Sequence[float]) -> Transform:
    """The number of boundaries b with b <= x; NaN comes last, NULL stays NULL."""
    borders = sorted(float(b) for b in boundaries)
    return lambda x: F.when(x.isNotNull(), sum((F.when(F.lit(b) <= x, 1).otherwise(0) for b in borders), F.lit(0))).cast("bigint")


def _in_range(value: Column, size: int, default: int) -> Column:
    """The comparison is made on the double, since a cast of a huge value would fail."""
    return F.when((value >= 0) & (value < size), value.cast("bigint")).otherwise(F.lit(default).cast("bigint"))


def log_round(num_bins: int, default: int = 0, base: float | None = None) -> Transform:
    """round_half_even(log_base(x)); the default if outside [0, num_bins)."""
    scale = math.log(base) if base else 1.0

    def apply(x: Column) -> Column:
        value = F.rint(F.ln(F.when(x > 0, x.cast("double"))) / F.lit(scale))
        return F.when(x.isNotNull(), F.coalesce(_in_range(value, num_bins, default), F.lit(default).cast("bigint")))

    return apply


def round_identity(num_buckets: int, default: int = 0) -> Transform:
    """round_half_even(x); the default if outside [0, num_buckets)."""
    return lambda x: F.when(x.isNotNull(), _in_range(F.rint(x.cast("double")), num_buckets, default))


def index_lookup(vocabulary: Sequence[str], num_oov: int = 1) -> Transform:
    """The index in a short vocabulary; beyond its end one of num_oov indices for terms that are not in it.

    With several, fingerprint64 of the term modulo num_oov tells them apart.
    """
    terms = list(vocabulary)
    if len(set(terms)) != len(terms):
        raise ValueError("the vocabulary repeats a term")
    if num_oov < 1:
        raise ValueError("num_oov must be positive")
    array = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    other = hash_bucket(num_oov) if num_oov > 1 else lambda x: F.lit(0)
    return lambda x: F.when(x.isNotNull(), F.coalesce(F.nullif(F.array_position(array, x), F.lit(0)) - 1, F.lit(len(terms)) + other(x))).cast("bigint")


def lookup_in(df: DataFrame, column: str, vocabulary: DataFrame, name: str = "id", num_oov: int = 1) -> DataFrame:
    """df with the index of a column in a vocabulary table (value, id from 0), of any size; others as in `index_lookup`."""
    terms = vocabulary.select(F.col("value").alias("_value"), F.col("id").cast("bigint").alias("_id"))
    size = vocabulary.agg(F.count(F.lit(1)).alias("_size"))
    other = hash_bucket(num_oov)(F.col(column)) if num_oov > 1 else F.lit(0)
    joined = df.join(terms, F.col(column) == F.col("_value"), "left").crossJoin(F.broadcast(size))  # one row
    found = F.when(F.col(column).isNotNull(), F.coalesce("_id", F.col("_size") + other)).cast("bigint")
    return joined.withColumn(name, found).drop("_value", "_id", "_size")


def terms_of(spark: SparkSession, path: str, most: int = 10_000) -> list[str]:
    """A vocabulary file: one term a line, white space around it left out; a repeated term raises.

    One of more than `most` terms raises too: read it as a table, for `lookup_in`.
    """
    terms = [r.value.strip() for r in spark.read.text(path).limit(most + 1).collect()]
    if len(terms) > most:
        raise ValueError(f"more than {most} terms; keep the vocabulary as a table")
    if len(set(terms)) != len(terms):
        raise ValueError("the vocabulary repeats a term")
    return terms


def to_number(kind: str, default: float | int, lenient: bool = False) -> Transform:
    """Text to a number, "" as the default; bad text raises unless lenient (then NULL)."""
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        raise ValueError(f"not a number type: {kind}")

    def apply(x: Column) -> Column:
        number = x.try_cast(kind) if lenient else x.cast(kind)
        return F.when(x == "", F.lit(default).cast(kind)).otherwise(number)

    return apply


def to_ragged(sep: str | None = None, sentinel: str | int | None = "") -> Transform:
    """An array without its sentinels; with sep, a text is split first."""

    def apply(x: Column) -> Column:
        array = F.split(x, "\\Q" + sep + "\\E") if sep else x
        return F.filter(array, lambda v: v.isNotNull() & (v != F.lit(sentinel)))

    return apply


def to_sparse(sentinel: str | int = "") -> Transform:
    """An array as array<struct<pos, value>> without the sentinels."""
    return lambda x: F.filter(F.transform(x, lambda v, i: F.struct(i.alias("pos"), v.alias("value"))), lambda s: s["value"] != F.lit(sentinel))


def concat_with_offsets(columns: Sequence[Column], offsets: Sequence[int] | None = None, kind: str = "array<bigint>") -> Column:
    """The arrays one after the other, the i-th with offsets[i] added; NULL arrays count as empty."""
    if offsets is not None and len(offsets) != len(columns):
        raise ValueError("as many offsets as columns are needed")

    def shifted_by(c: Column, o: int) -> Column:
        return F.transform(c, lambda v: v + F.lit(o))

    shifted = list(map(shifted_by, columns, offsets)) if offsets else columns
    return F.concat(*[F.coalesce(c.cast(kind), F.array().cast(kind)) for c in shifted])


def id_offsets(sizes: Sequence[int]) -> list[int]:
    """Where each feature's ids begin in the concatenated range."""
    out, total = [], 0
    for size in sizes:
        out.append(total)
        total += size
    return out


def concatenated(parts: Mapping[str, tuple[Column, int]]) -> tuple[str, Column, int]:
    """(name, ids, size) of id columns laid end to end: {name: (ids, how many ids)}.

    Offsets follow the order given; the name joins the sorted names with _C_. No parts, a
    size below 1 or a name that is no text raise.
    """
    if not parts:
        raise ValueError("no columns to concatenate")
    for name, (_, size) in parts.items():
        if not isinstance(name, str) or isinstance(size, bool) or not isinstance(size, int):
            raise TypeError(f"a name and a whole number of ids are needed: {name!r}, {size!r}")
        if size < 1:
            raise ValueError(f"{name} has no ids")
    sizes = [size for _, size in parts.values()]
    return "_C_".join(sorted(parts)), concat_with_offsets([ids for ids, _ in parts.values()], id_offsets(sizes)), sum(sizes)


def cross(columns: Sequence[Column], sep: str = "_X_") -> Column:
    """Array of the joined values of the Cartesian product of array columns."""

    def joined(made: Column, c: Column) -> Column:
        return F.flatten(F.transform(made, lambda a: F.transform(c, lambda b: F.concat_ws(sep, a, b.cast("string")))))

    return reduce(joined, columns[1:], F.transform(columns[0], lambda v: v.cast("string")))


def multi_hot(ids: Column, size: int) -> Column:
    """How often each of 0..size-1 is among the ids, as array<float>."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(ids, lambda v: v == k)).cast("float"))


def pad_left(array: Column, length: int, fill: int = 0) -> Column:
    """Left-padded to the length; longer arrays keep their last elements."""
    padded = F.concat(F.array_repeat(F.lit(fill).cast("bigint"), F.greatest(F.lit(0), F.lit(length) - F.size(array))), array)
    return F.slice(padded, F.greatest(F.lit(1), F.size(padded) - length + 1), length)
