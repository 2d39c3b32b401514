"""Shards, task manifests, epochs and splits as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.workspace import stored


def cut(sizes: DataFrame, records: int, name: str = "name", start: str = "start", count: str = "count") -> DataFrame:
    """name, start, end: each range [start, start + count) cut into pieces of `records`, the last one shorter."""
    if records <= 0:
        raise ValueError("records must be positive")
    pieces = sizes.where(F.col(count) > 0).withColumn("_at", F.explode(F.sequence(F.col(start), F.col(start) + F.col(count) - 1, F.lit(records).cast("bigint"))))
    return pieces.select(F.col(name).alias("name"), F.col("_at").alias("start"), F.least(F.col("_at") + records, F.col(start) + F.col(count)).alias("end"))


def epochs(manifest: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """The manifest n times with an `epoch`; with a seed also a `place` in a shuffled order of each epoch."""
    out = manifest.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else manifest.withColumn("epoch", F.lit(0)).limit(0)
    if seed is None:
        return out
    return out.withColumn("place", F.xxhash64(F.lit(seed), "epoch", *manifest.columns))


def shuffled(df: DataFrame, epochs: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """The rows once for each epoch, with `epoch` and `place`: a seeded place by which to sort the epoch's rows.

    Places are hashes of the keys, the epoch and the seed, so that a run can be repeated.
    """
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return each.withColumn("place", F.xxhash64(F.lit(seed), "epoch", *keys))


def manifest(records: int, batch: int, batches_a_task: int, spark) -> DataFrame:
    """The tasks of a data set of so many records, by the parameters that a job is given."""
    if records <= 0 or batch <= 0 or batches_a_task <= 0:
        raise ValueError("the number of records and the sizes must be positive")
    return cut(spark.range(1).select(F.lit("data").alias("name"), F.lit(0).cast("bigint").alias("start"), F.lit(records).cast("bigint").alias("count")), batch * batches_a_task)


def until_step(manifest: DataFrame, batch: int, most_steps: int, order: Sequence[str]) -> DataFrame:
    """The tasks before which not more than most_steps steps (records // batch) are complete."""
    steps = manifest.withColumn("_steps", F.floor((F.col("end") - F.col("start")) / batch))
    return running_sums(steps, order, {"_before": "_steps"}).where(F.col("_before") <= most_steps).drop("_before", "_steps")


def ranges_of_files(files: DataFrame, start: int, end: int, order: str = "name") -> DataFrame:
    """The part [start, end) of files laid end to end: name, local_start, count. files: name, count."""
    placed = running_sums(files, [order], {"_from": "count"}).withColumn("_to", F.col("_from") + F.col("count"))
    hit = placed.where((F.col("_from") < end) & (F.col("_to") > start))
    low, high = F.greatest(F.col("_from"), F.lit(start)), F.least(F.col("_to"), F.lit(end))
    return hit.select("name", (low - F.col("_from")).alias("local_start"), (high - low).alias("count"))


def running_sums(df: DataFrame, order: Sequence[str], sums: Mapping[str, str | None]) -> DataFrame:
    """df with, for each name in sums, the sum of a column over all rows before (None: the number of rows).

    No task holds all rows: the table is range-partitioned by the order and written once, so
    that the sums inside a partition and those of whole partitions (a row each) are taken
    from the same partitions. Rows that are equal in the order come in an arbitrary fixed one.
    """
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_part", F.shiftright("_place", 33))  # the upper bits of such an id are the partition
    value = lambda c: F.lit(1) if c is None else F.col(c)
    earlier = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumns({f"_in_{n}": F.coalesce(F.sum(value(c)).over(earlier), F.lit(0)) for n, c in sums.items()})
    parts = placed.groupBy("_part").agg(*[F.sum(value(c)).alias(f"_sum_{n}") for n, c in sums.items()])
    parts_before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_sum_{n}").over(parts_before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    both = inside.join(F.broadcast(parts), "_part")  # a row for each partition
    return both.select(*df.columns, *[(F.col(f"_before_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums])


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "row") -> DataFrame:
    """0, 1, 2 ... in the given order."""
    return running_sums(df, order, {name: None})


def systematic_split(df: DataFrame, order: Sequence[str], every: int = 20) -> DataFrame:
    """`evaluation`: whether the row's number in the order is a multiple of `every`."""
    return row_numbers(df, order, "_row").withColumn("evaluation", F.col("_row") % every == 0).drop("_row")


def batches_an_epoch(records: int, batch: int) -> int:
    return records // batch
