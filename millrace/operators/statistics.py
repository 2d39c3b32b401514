"""Column analysis: one aggregation for all numbers, one job for each vocabulary."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.sharding import running_sums
from millrace.workspace import stored


@dataclass
class FeatureStats:
    """What an analysis found for a column; kept as JSON beside a fitted feature plan."""

    minimum: float | None = None
    maximum: float | None = None
    mean: float | None = None
    deviation: float | None = None
    distinct: int | None = None
    boundaries: list[float] = field(default_factory=list)
    vocabulary: list[str] = field(default_factory=list)
    #: A text file of terms, one a line, instead of the list.
    vocabulary_path: str | None = None

    @classmethod
    def from_environment(cls, name: str, values: Mapping[str, str], default: FeatureStats | None = None) -> FeatureStats:
        """Values named _<name>_min, _max, _avg, _stddev, _boundaries, _distinct_count, _vocab override the default's."""
        out = cls(**asdict(default)) if default else cls()
        for key, attribute, kind in (("min", "minimum", float), ("max", "maximum", float), ("avg", "mean", float), ("stddev", "deviation", float), ("distinct_count", "distinct", int)):
            if (text := values.get(f"_{name}_{key}")) is not None:
                setattr(out, attribute, kind(text))
        if (text := values.get(f"_{name}_boundaries")) is not None:
            out.boundaries = sorted({float(x) for x in text.split(",")})
        out.vocabulary_path = values.get(f"_{name}_vocab", out.vocabulary_path)
        return out


def numeric_aggregates(column: str) -> list[Column]:
    """min, max, mean and population standard deviation, in one pass."""
    c = F.col(column).cast("double")
    return [F.min(c).alias("minimum"), F.max(c).alias("maximum"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("deviation")]


def percentiles(df: DataFrame, column: str, buckets: int, approximate: bool = False) -> list[float]:
    """Boundaries at k / buckets of the values that are not NULL, interpolated between neighbours; [] if there are none.

    Exact unless asked: values are counted, brought in order by ranges, and the rows at the
    wanted places are picked; only those come to the driver.
    """
    if approximate:
        at = [k / buckets for k in range(1, buckets)]
        return df.agg(F.percentile_approx(F.col(column).cast("double"), at)).first()[0] or []
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    placed = stored(running_sums(counts, ["x"], {"before": "n"}), "percentiles")
    total = placed.agg(F.sum("n")).first()[0]
    if not total:
        return []
    wanted = [divmod(k * (total - 1), buckets) for k in range(1, buckets)]
    places = F.array(*[F.lit(p).cast("bigint") for p in sorted({p + d for p, rest in wanted for d in (0, 1 if rest else 0)})])
    picked = placed.select("x", F.explode(F.filter(places, lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("n")))).alias("at"))
    value = {r["at"]: r.x for r in picked.collect()}
    return [value[p] + (value[p + 1] - value[p]) * (rest / buckets) if rest else value[p] for p, rest in wanted]


def analyse(df: DataFrame, numeric: Sequence[str] = (), buckets: int = 0, approximate: bool = False, distinct: Sequence[str] = ()) -> dict[str, FeatureStats]:
    """The statistics of several columns from one aggregation; boundaries from a job for each column."""
    wanted = [F.struct(*numeric_aggregates(n)).alias(f"stats {n}") for n in numeric]
    wanted += [(F.approx_count_distinct(d) if approximate else F.count_distinct(d)).alias(f"distinct {d}") for d in distinct]
    row = df.agg(*wanted).first().asDict(recursive=True) if wanted else {}
    out = {n: FeatureStats(**row[f"stats {n}"], boundaries=sorted(set(percentiles(df, n, buckets, approximate))) if buckets else []) for n in numeric}
    for d in distinct:
        out.setdefault(d, FeatureStats()).distinct = row[f"distinct {d}"]
    return out


def vocabulary(df: DataFrame, column: str, least: int = 1) -> DataFrame:
    """value, count of the values seen `least` times or more (NULL left out)."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def ordered_vocabulary(df: DataFrame, column: str, least: int = 1, most: int = 1_000_000) -> list[str]:
    """The vocabulary by falling count, then value; refuses one of more than `most` terms."""
    rows = vocabulary(df, column, least).orderBy(F.desc("n"), "value").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms; keep the vocabulary as a table")
    return [r.value for r in rows]


def hash_bucket_size(distinct: int, factor: int = 3) -> int:
    return distinct * factor


def save(stats: Mapping[str, FeatureStats]) -> str:
    return json.dumps({k: asdict(v) for k, v in stats.items()}, sort_keys=True)


def load(text: str) -> dict[str, FeatureStats]:
    return {k: FeatureStats(**v) for k, v in json.loads(text).items()}
