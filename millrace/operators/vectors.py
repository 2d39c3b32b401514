"""Keyed vector tables: lookup, combination, deduplication, partitioning, upsert.

A vector table has the columns id (bigint) and vec (array of float or double).

Rows of ids have a key of their own each. Where the vectors of all ids that the rows name are few
(HELD bytes), every task holds those and makes the result row by row, so no vector is shuffled;
otherwise ids and vectors are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from millrace.workspace import stored

COMBINERS = ("sum", "mean", "sqrtn")
#: Bytes of vectors, as doubles, that a task may hold, and ids whose vectors are fetched at a time.
HELD, SLICE = 32 << 20, 1 << 14


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def initial(kind: str, dim: int, seed: int = 0, value: float = 0.0, low: float = -0.05, high: float = 0.05, mean: float = 0.0, deviation: float = 0.05) -> Column:
    """The vector of an id that the table lacks, fixed by the id, the position and the seed.

    uniform: low..high; normal by Box-Muller; truncated normal: folded to two deviations.
    """
    unit = lambda k, salt: (F.pmod(F.xxhash64("id", k, F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = lambda k: F.sqrt(-2 * F.ln(unit(k, 1))) * F.cos(2 * F.pi() * unit(k, 2))
    made = {
        "zero": lambda k: F.lit(0.0),
        "constant": lambda k: F.lit(float(value)),
        "uniform": lambda k: F.lit(low) + unit(k, 0) * F.lit(high - low),
        "normal": lambda k: F.lit(mean) + F.lit(deviation) * normal(k),
        "truncated_normal": lambda k: F.lit(mean) + F.lit(deviation) * (F.pmod(normal(k) + 2, F.lit(4.0)) - 2),
    }
    if kind not in made:
        raise ValueError(f"not an initializer: {kind}")
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), made[kind])


def _flat(ids: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The row of every element of a column of arrays, and the elements; a null array has none."""
    return np.repeat(np.arange(len(ids)), ids.value_lengths().fill_null(0).to_numpy()), ids.flatten()


def _lists(flat: np.ndarray, size: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, flat.size + 1, size, dtype=np.int32), flat.reshape(-1))


@dataclass
class Held:
    """Vectors that a task holds: ids in ascending order and their vectors."""

    ids: np.ndarray
    vecs: np.ndarray

    def find(self, ids: pa.Array, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ids are held and not below the least, and the places of those."""
        wanted = ids.fill_null(0).to_numpy(zero_copy_only=False)
        if not len(self.ids):
            return np.zeros(len(wanted), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.ids, wanted), len(self.ids) - 1)
        hit = (self.ids[at] == wanted) & ids.is_valid().to_numpy(zero_copy_only=False)
        if least is not None:
            hit &= wanted >= least
        return hit, at[hit]

    def sums(self, n: int, row: np.ndarray, at: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """The sum of each of n rows' vectors; rows ascend."""
        out = np.zeros((n, self.vecs.shape[1]))
        for i in range(0, len(at), SLICE):
            r, part = row[i : i + SLICE], self.vecs[at[i : i + SLICE]]
            first = np.flatnonzero(np.diff(r, prepend=-1))
            out[r[first]] += np.add.reduceat(part if weight is None else part * weight[i : i + SLICE, None], first, axis=0)
        return out


def _named(rows: DataFrame, ids: str, dim: int, most_bytes: int, least: int | None = None) -> tuple[DataFrame, int] | None:
    """The distinct ids of the rows and their number, if their vectors are few."""
    each = rows.select(F.explode(ids).alias("id")).where("id IS NOT NULL" if least is None else F.col("id") >= least)
    found = stored(each.distinct(), "named_ids")
    n = found.count()
    return (found, n) if replicated(n, dim, 8, most_bytes) else None


def _held(vectors: DataFrame, n: int, dim: int) -> Held | None:
    """The vectors of at most n ids; none where an id comes twice or a vector has not dim numbers."""
    got = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec")).limit(n + 1).toArrow().combine_chunks()
    ids, vecs = (got[c].combine_chunks() if isinstance(got[c], pa.ChunkedArray) else got[c] for c in ("id", "vec"))
    flat = vecs.flatten()
    if vecs.null_count or flat.null_count or len(flat) != len(ids) * dim or (vecs.value_lengths().to_numpy() != dim).any():
        return None
    order = np.argsort(ids.to_numpy())
    known = ids.to_numpy()[order]
    if (np.diff(known) == 0).any():
        return None
    return Held(known, flat.to_numpy().reshape(-1, dim)[order])


def _wanted(rows: DataFrame, table: DataFrame, ids: str, dim: int, most_bytes: int, least: int) -> Held | None:
    """What the table has of the rows' ids, if that is little."""
    named = _named(rows, ids, dim, most_bytes, least)
    return named and _held(table.select("id", "vec").join(F.broadcast(named[0]), "id", "left_semi"), named[1], dim)


def _by_rows(rows: DataFrame, key: str, fields: list[StructField], make: Callable[[pa.RecordBatch], list], held: list[Held]) -> DataFrame:
    """key and what make(batch, *held) yields for each batch of rows."""
    sent = rows.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, *[f.name for f in fields]]
        for batch in batches:
            for made in make(batch, *sent.value):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made], names)

    return rows.mapInArrow(run, StructType([rows.schema[key], *fields]))


_VECTOR = ArrayType(DoubleType())


def lookup(rows: DataFrame, table: DataFrame, dim: int, ids: str = "ids", key: str = "key", missing: Column | None = None, most_bytes: int = HELD) -> DataFrame:
    """key, vecs: the vectors of the ids in their order. Each distinct id is fetched once; rows without ids are left out."""

    def fetch(named: DataFrame, table: DataFrame) -> DataFrame:
        wanted = named.join(table.select("id", "vec"), "id", "left")
        return wanted.select("id", F.coalesce("vec", missing if missing is not None else zeros(dim)).alias("vec"))

    rows = stored(rows.select(key, F.col(ids).cast("array<bigint>").alias(ids)), "rows_of_ids")
    named = _named(rows, ids, dim, most_bytes)
    held = named and _held(fetch(named[0], table.join(F.broadcast(named[0]), "id", "left_semi")), named[1], dim)
    if held:

        def make(batch: pa.RecordBatch, known: Held) -> Iterator[list]:
            ends = np.cumsum(batch.column(ids).value_lengths().fill_null(0).to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist(), len(ends)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                row, flat = _flat(part.column(ids))
                hit, at = known.find(flat)
                lengths = np.bincount(row[hit], minlength=b - a)
                some = pa.array(np.flatnonzero(lengths))
                offsets = np.concatenate([[0], np.cumsum(lengths[lengths > 0])]).astype(np.int32)
                yield [part.column(key).take(some), pa.ListArray.from_arrays(offsets, _lists(known.vecs[at], dim))]

        return _by_rows(rows, key, [StructField("vecs", ArrayType(_VECTOR))], make, [held])
    each = rows.select(key, F.posexplode(ids).alias("pos", "id"))
    wanted = fetch(each.select("id").distinct(), table)
    found = each.join(wanted, "id").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "vec"))).alias("_all"))
    return found.select(key, F.transform("_all", lambda s: s["vec"]).alias("vecs"))


def sum_vectors(vec: str, dim: int, weight: Column | None = None) -> list[Column]:
    """One sum for each dimension: combined on the map side before the shuffle."""
    w = weight if weight is not None else F.lit(1.0)
    return [F.sum(F.col(vec)[k] * w).alias(f"_s{k}") for k in range(dim)]


def combine(rows: DataFrame, table: DataFrame, dim: int, how: str = "mean", ids: str = "ids", weights: str | None = None, key: str = "key", zero_is_missing: bool = False, most_bytes: int = HELD) -> DataFrame:
    """key, vec: the ids' vectors combined; negative ids, ids not in the table and ids without a weight do not count, rows without ids are zeros.

    sum: sum w e; mean: sum w e / sum w; sqrtn: sum w e / sqrt(sum w w); w is 1 without weights.
    """
    if how not in COMBINERS:
        raise ValueError(f"not a combiner: {how}")
    pairs = F.arrays_zip(F.col(ids).cast("array<bigint>").alias("id"), F.col(weights).cast("array<double>").alias("w")) if weights else None
    columns = [F.transform(pairs, lambda p: p["id"]).alias("_ids"), F.transform(pairs, lambda p: p["w"]).alias("_ws")] if weights else [F.col(ids).cast("array<bigint>").alias("_ids")]
    rows = stored(rows.select(key, *columns), "rows_of_ids")
    least = 1 if zero_is_missing else 0
    scale = {"sum": F.lit(1.0), "mean": F.col("_w"), "sqrtn": F.sqrt("_ww")}[how]
    if held := _wanted(rows, table, "_ids", dim, most_bytes, least):

        def make(batch: pa.RecordBatch, known: Held) -> Iterator[list]:
            n = batch.num_rows
            row, flat = _flat(batch.column("_ids"))
            hit, at = known.find(flat, least)
            w = None
            if weights:
                given = batch.column("_ws").flatten().filter(pa.array(hit))
                there = given.is_valid().to_numpy(zero_copy_only=False)
                hit[np.flatnonzero(hit)[~there]] = False
                at, w = at[there], given.drop_null().to_numpy(zero_copy_only=False)
            row = row[hit]
            total, squares = (np.bincount(row, x, n).astype(float) for x in (w, None if w is None else w * w))
            yield [batch.column(key), _lists(known.sums(n, row, at, w), dim), np.bincount(row, minlength=n), total, squares]

        fields = [StructField("_s", _VECTOR), StructField("_n", LongType()), StructField("_w", DoubleType()), StructField("_ww", DoubleType())]
        sums = _by_rows(rows, key, fields, make, [held])
        return sums.select(key, (F.col("_s") if how == "sum" else F.when(F.col("_n") > 0, F.transform("_s", lambda x: x / scale)).otherwise(F.col("_s"))).alias("vec"))
    pairs = F.arrays_zip(F.col("_ids").alias("id"), F.col("_ws").alias("w")) if weights else F.transform("_ids", lambda i: F.struct(i.alias("id"), F.lit(1.0).alias("w")))
    each = rows.select(key, F.explode(pairs).alias("_p")).select(key, "_p.id", "_p.w").where((F.col("id") >= least) & F.col("w").isNotNull())
    joined = each.join(table.select("id", "vec"), "id")
    sums = joined.groupBy(key).agg(*sum_vectors("vec", dim, F.col("w")), F.sum("w").alias("_w"), F.sum(F.col("w") * F.col("w")).alias("_ww"))
    vec = F.array(*[F.col(f"_s{k}") / scale for k in range(dim)])
    out = rows.select(key).join(sums.select(key, vec.alias("vec")), key, "left")
    return out.select(key, F.coalesce("vec", zeros(dim)).alias("vec"))


def mask(ids: Column) -> Column:
    """For each id whether it counts: 0 is padding."""
    return F.transform(ids, lambda i: i != 0)


def pooled(rows: DataFrame, tables: Mapping[str, DataFrame], dim: int, how: str = "sum", key: str = "key", most_bytes: int = HELD) -> DataFrame:
    """key and a vector for each group: {name of an id array column of rows: its table}. All groups in one pass or join."""
    rows = stored(rows.select(key, *[F.col(g).cast("array<bigint>").alias(g) for g in tables]), "rows_of_ids")
    held: list[Held] = []
    for g, t in tables.items():
        if not (one := _wanted(rows, t, g, dim, most_bytes // len(tables), 0)):
            break
        held.append(one)
    if len(held) == len(tables):

        names = list(tables)

        def make(batch: pa.RecordBatch, *known: Held) -> Iterator[list]:
            out, n = [batch.column(key)], batch.num_rows
            for g, one in zip(names, known, strict=True):
                row, flat = _flat(batch.column(g))
                hit, at = one.find(flat, 0)
                counts = np.maximum(np.bincount(row[hit], minlength=n), 1)[:, None]
                out.append(_lists(one.sums(n, row[hit], at) / {"sum": 1.0, "mean": counts, "sqrtn": np.sqrt(counts)}[how], dim))
            yield out

        return _by_rows(rows, key, [StructField(g, _VECTOR) for g in names], make, held)

    def tagged(group: str) -> Column:
        return F.transform(F.coalesce(F.col(group), F.array().cast("array<bigint>")), lambda i: F.struct(F.lit(group).alias("group"), i.alias("id")))

    each = [tagged(g) for g in tables]
    pairs = rows.select(key, F.explode(F.concat(*each)).alias("p")).select(key, "p.group", "p.id").where("id >= 0")
    whole = [t.select(F.lit(g).alias("group"), "id", "vec") for g, t in tables.items()]
    joined = pairs.join(reduce(DataFrame.unionByName, whole), ["group", "id"])
    sums = joined.groupBy(key, "group").agg(*sum_vectors("vec", dim), F.count(F.lit(1)).alias("_n"))
    scale = {"sum": F.lit(1.0), "mean": F.col("_n"), "sqrtn": F.sqrt("_n")}[how]
    made = sums.select(key, "group", F.array(*[F.col(f"_s{k}") / scale for k in range(dim)]).alias("vec"))
    wide = made.groupBy(key).agg(*[F.first(F.when(F.col("group") == g, F.col("vec")), ignorenulls=True).alias(g) for g in tables])
    return rows.select(key).join(wide, key, "left").select(key, *[F.coalesce(g, zeros(dim)).alias(g) for g in tables])


def check_ids(rows: DataFrame, dim: int, ids: str = "ids") -> DataFrame:
    """rows, failing at run time on an id of dim or more."""
    bad = F.exists(ids, lambda i: i >= dim)
    return rows.where(F.when(bad, F.raise_error(F.lit(f"an id is not below {dim}")).isNull()).otherwise(True))


def merge(*tables: DataFrame) -> DataFrame:
    """All (id, vec) rows of tables of the same schema; ids may repeat."""
    out = tables[0]
    for t in tables[1:]:
        if t.schema["vec"].dataType != out.schema["vec"].dataType:
            raise ValueError("the vectors differ in type")
        out = out.unionByName(t)
    return out


def deduplicate(table: DataFrame, dim: int) -> DataFrame:
    """One row an id, the sum of its vectors."""
    return table.groupBy("id").agg(*sum_vectors("vec", dim)).select("id", F.array(*[F.col(f"_s{k}") for k in range(dim)]).alias("vec"))


def scatter(table: DataFrame, n: int) -> DataFrame:
    """`bucket` = id modulo n, and the rows placed by it."""
    return table.withColumn("bucket", F.pmod("id", F.lit(n))).repartition(n, "bucket")


def upsert(table: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """The table with the changes' vectors; of several changes of an id the last in `order` counts."""
    if order:
        changes = changes.groupBy("id").agg(F.max_by("vec", order).alias("vec"))
    joined = table.select("id", F.col("vec").alias("_old")).join(changes.select("id", F.col("vec").alias("_new")), "id", "full")
    return joined.select("id", F.coalesce("_new", "_old").alias("vec"))


def dense(table: DataFrame, n: int, dim: int) -> DataFrame:
    """Rows 0..n-1, zeros where the table has none."""
    spark = table.sparkSession
    return spark.range(n).join(table, "id", "left").select("id", F.coalesce("vec", zeros(dim)).alias("vec"))


def fm_second_order(rows: DataFrame, table: DataFrame, dim: int, ids: str = "ids", key: str = "key", most_bytes: int = HELD) -> DataFrame:
    """key, value: half the sum over dimensions of (sum v)^2 - sum v^2; id 0 is padding, rows without ids in the table are left out."""
    rows = stored(rows.select(key, F.col(ids).cast("array<bigint>").alias(ids)), "rows_of_ids")
    if held := _wanted(rows, table, ids, dim, most_bytes, 1):

        def make(batch: pa.RecordBatch, known: Held) -> Iterator[list]:
            n = batch.num_rows
            row, flat = _flat(batch.column(ids))
            hit, at = known.find(flat, 1)
            row, norms = row[hit], np.square(known.vecs).sum(axis=1)
            some = np.flatnonzero(np.bincount(row, minlength=n))
            value = (np.square(known.sums(n, row, at)).sum(axis=1) - np.bincount(row, norms[at], n)) / 2
            yield [batch.column(key).take(pa.array(some)), value[some]]

        return _by_rows(rows, key, [StructField("value", DoubleType())], make, [held])
    each = rows.select(key, F.explode(ids).alias("id")).where("id > 0").join(table.select("id", "vec"), "id")
    parts = each.groupBy(key).agg(*sum_vectors("vec", dim), *[F.sum(F.col("vec")[k] * F.col("vec")[k]).alias(f"_q{k}") for k in range(dim)])
    total = sum((F.col(f"_s{k}") * F.col(f"_s{k}") - F.col(f"_q{k}") for k in range(dim)), F.lit(0.0))
    return parts.select(key, (total / 2).alias("value"))


def replicated(input_dim: int, output_dim: int, bytes_a_value: int = 4, most_bytes: int = 2 << 20) -> bool:
    """Whether a table is small enough to be held whole by everyone."""
    return input_dim * output_dim * bytes_a_value <= most_bytes
