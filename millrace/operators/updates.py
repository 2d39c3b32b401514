"""Versioned keyed state: gradient accumulation, optimizer steps, checkpoints."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.vectors import deduplicate, zeros


@dataclass(frozen=True)
class Optimizer:
    """kind: sgd, momentum, adam or adagrad; slots are array columns beside vec."""

    kind: str
    lr: float = 0.1
    momentum: float = 0.9
    nesterov: bool = False
    beta_1: float = 0.9
    beta_2: float = 0.999
    epsilon: float = 1e-8
    amsgrad: bool = False
    initial_accumulator: float = 0.1

    @property
    def slots(self) -> list[str]:
        names = {"sgd": [], "momentum": ["velocity"], "adam": ["m", "v", *["max_v"] * self.amsgrad], "adagrad": ["accumulator"]}
        if self.kind not in names:
            raise ValueError(f"not an optimizer: {self.kind}")
        return names[self.kind]

    @classmethod
    def from_text(cls, kind: str, text: str) -> Optimizer:
        """Parameters as "name=value;name=value"; unknown names raise, nothing is evaluated."""
        out: dict[str, object] = {}
        for part in filter(None, text.split(";")):
            name, _, value = part.partition("=")
            if name not in cls.__dataclass_fields__ or name == "kind":
                raise ValueError(f"not a parameter: {name}")
            out[name] = value.lower() == "true" if isinstance(getattr(cls, name), bool) else float(value)
        return cls(kind, **out)


def _each(*columns: Column, fn) -> Column:
    """fn over the elements of arrays of the same length."""
    zipped = F.arrays_zip(*[c.alias(f"c{k}") for k, c in enumerate(columns)])
    return F.transform(zipped, lambda z: fn(*[z[f"c{k}"] for k in range(len(columns))]))


def step(table: DataFrame, gradients: DataFrame, optimizer: Optimizer, dim: int, at: int = 1, lr: Column | None = None) -> DataFrame:
    """The table after one update. gradients: id, vec; those of one id are summed first.

    at: the number of the step, for Adam. Rows without a gradient stay as they are; ids
    that the table lacks are left out. lr overrides the optimizer's, for stale gradients.
    """
    rate = lr if lr is not None else F.lit(optimizer.lr)
    g = deduplicate(gradients, dim).select("id", F.col("vec").alias("_g"))
    rows = table.join(g, "id", "left")
    for s in optimizer.slots:
        if s not in table.columns:
            start = optimizer.initial_accumulator if s == "accumulator" else 0.0
            rows = rows.withColumn(s, F.array_repeat(F.lit(start), dim) if start else zeros(dim))
    p, grad = F.col("vec"), F.col("_g")
    if optimizer.kind == "sgd":
        new = {"vec": _each(p, grad, fn=lambda p, g: p - rate * g)}
    elif optimizer.kind == "momentum":
        rows = rows.withColumn("_v", _each(F.col("velocity"), grad, fn=lambda v, g: optimizer.momentum * v + g))
        if optimizer.nesterov:
            new = {"velocity": F.col("_v"), "vec": _each(p, grad, F.col("_v"), fn=lambda p, g, v: p - rate * (g + optimizer.momentum * v))}
        else:
            new = {"velocity": F.col("_v"), "vec": _each(p, F.col("_v"), fn=lambda p, v: p - rate * v)}
    elif optimizer.kind == "adagrad":
        rows = rows.withColumn("_a", _each(F.col("accumulator"), grad, fn=lambda a, g: a + g * g))
        new = {"accumulator": F.col("_a"), "vec": _each(p, grad, F.col("_a"), fn=lambda p, g, a: p - rate * g / (F.sqrt(a) + optimizer.epsilon))}
    else:
        b1, b2 = optimizer.beta_1, optimizer.beta_2
        scaled = rate * F.lit((1 - b2**at) ** 0.5 / (1 - b1**at))
        rows = rows.withColumn("_m", _each(F.col("m"), grad, fn=lambda m, g: b1 * m + (1 - b1) * g))
        rows = rows.withColumn("_v", _each(F.col("v"), grad, fn=lambda v, g: b2 * v + (1 - b2) * g * g))
        new = {"m": F.col("_m"), "v": F.col("_v")}
        top = F.col("_v")
        if optimizer.amsgrad:
            rows = rows.withColumn("_x", _each(F.col("max_v"), F.col("_v"), fn=lambda a, b: F.greatest(a, b)))
            new["max_v"] = top = F.col("_x")
        new["vec"] = _each(p, F.col("_m"), top, fn=lambda p, m, v: p - scaled * m / (F.sqrt(v) + optimizer.epsilon))
    kept = [c for c in table.columns if c not in new]
    return rows.select(*kept, *[F.when(grad.isNull(), F.col(c)).otherwise(x).alias(c) for c, x in new.items()])


def accepted(gradients: DataFrame, current: int, tolerance: int = 0) -> DataFrame:
    """The gradients whose version is not older than current - tolerance."""
    return gradients.where(F.col("version") >= current - tolerance)


def newer(table: DataFrame, than: int, inclusive: bool = False) -> DataFrame:
    """The rows of a versioned table that a reader who has version `than` still needs."""
    return table.where(F.col("version") >= than if inclusive else F.col("version") > than)


def gradient_fault(widths: Mapping[str, int]) -> Column:
    """What is wrong with a gradient (name, vec): an unknown name, no vector or one of another width; NULL if nothing."""
    known = F.create_map(*[F.lit(x) for item in widths.items() for x in item])
    width = F.try_element_at(known, F.col("name"))
    return F.when(width.isNull(), "name").when(F.col("vec").isNull() | (F.size("vec") != width), "width")


def checked(gradients: DataFrame, widths: Mapping[str, int]) -> DataFrame:
    """The gradients, failing at run time on one that is wrong."""
    fault = gradient_fault(widths)
    return gradients.where(F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("a gradient is wrong in its "), fault)).isNull()).otherwise(True))


def accumulate(gradients: DataFrame, dim: int, waited: int) -> tuple[DataFrame, DataFrame]:
    """(dense, sparse): dense gradients (name, vec) are averaged over `waited` reports, sparse (name, id, vec) summed."""
    sums = [F.sum(F.col("vec")[k]).alias(f"_s{k}") for k in range(dim)]
    array = F.array(*[F.col(f"_s{k}") for k in range(dim)])
    dense = gradients.where("id IS NULL").groupBy("name").agg(*sums).select("name", F.transform(array, lambda x: x / waited).alias("vec"))
    sparse = gradients.where("id IS NOT NULL").groupBy("name", "id").agg(*sums).select("name", "id", array.alias("vec"))
    return dense, sparse


def stale_rate(lr: float, current: Column, version: Column) -> Column:
    return F.lit(lr) / F.greatest(F.lit(1), current - version)


def save(table: DataFrame, path: str, version: int, shards: int = 1, keep: int | None = None) -> str:
    """Writes version=<n> with `shard` = id modulo shards; a version counts once _SUCCESS is there. Older ones beyond `keep` go."""
    target = f"{path}/version={version}"
    table.withColumn("shard", F.pmod("id", F.lit(shards))).repartition(shards, "shard").write.mode("overwrite").parquet(target)
    if keep:
        for old in versions(table.sparkSession, path)[:-keep]:
            _files(table.sparkSession, path).delete(table.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}"), True)
    return target


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions, ascending."""
    hadoop, files = spark._jvm.org.apache.hadoop.fs, _files(spark, path)
    found = files.globStatus(hadoop.Path(f"{path}/version=*")) or []
    return sorted(int(m[1]) for s in found if (m := re.search(r"version=(\d+)$", s.getPath().toString())) and files.exists(hadoop.Path(s.getPath(), "_SUCCESS")))


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def restore(spark: SparkSession, path: str, shards: int, version: int | None = None) -> DataFrame:
    """A version (the latest) dealt into another number of shards."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError("no such complete version")
    table = spark.read.parquet(f"{path}/version={known[-1] if version is None else version}")
    return table.withColumn("shard", F.pmod("id", F.lit(shards))).repartition(shards, "shard")
