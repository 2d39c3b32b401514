"""Model evaluation as aggregates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.sharding import running_sums


def accuracy(prediction: Column, label: Column, threshold: float = 0.5) -> Column:
    return F.avg(((prediction > threshold).cast("int") == label.cast("int")).cast("double"))


def argmax(scores: Column) -> Column:
    """The first position of the largest score, from 0."""
    return F.array_position(scores, F.array_max(scores)) - 1


def argmax_accuracy(scores: Column, label: Column) -> Column:
    return F.avg((argmax(scores) == label).cast("double"))


def sigmoid_cross_entropy(logit: Column, label: Column) -> Column:
    return F.avg(F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit))))


def softmax_cross_entropy(scores: Column, label: Column) -> Column:
    """Mean of logsumexp(scores) - scores[label]."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, z: a + F.exp(z - top))
    return F.avg(F.ln(total) + top - F.element_at(scores, label.cast("int") + 1))


def evaluate(df: DataFrame, metrics: Mapping[str, Column], by: list[str] | None = None) -> DataFrame:
    """All metrics in one aggregation, by group if asked (an output, a model version)."""
    if not metrics:
        raise ValueError("no metrics")
    return df.groupBy(*(by or [])).agg(*[m.alias(name) for name, m in metrics.items()])


def nested(df: DataFrame, metrics: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """One row, a struct of metrics for each output: {output: {metric: column}}."""
    return df.agg(*[F.struct(*[m.alias(n) for n, m in each.items()]).alias(output) for output, each in metrics.items()])


def auc(df: DataFrame, prediction: str, label: str, thresholds: int = 200) -> DataFrame:
    """One row, auc: the area by trapezoids over `thresholds` evenly spaced thresholds of predictions in 0..1.

    A histogram of thresholds - 1 bins is all that is brought together.
    """
    bins = thresholds - 1
    place = F.least(F.greatest(F.floor(F.col(prediction) * bins), F.lit(0)), F.lit(bins - 1))
    counts = df.groupBy(place.alias("bin")).agg(F.sum(F.col(label).cast("double")).alias("p"), F.sum(1 - F.col(label).cast("double")).alias("n"))
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    curve = counts.select("p", "n", F.sum("p").over(above).alias("tp"))
    return curve.agg((F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))


def exact_auc(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """One row, auc, by ranks: the counts of distinct predictions are brought in order by ranges."""
    counts = df.groupBy(F.col(prediction).alias("x")).agg(F.sum(F.col(label).cast("double")).alias("p"), F.sum(1 - F.col(label).cast("double")).alias("n"))
    placed = running_sums(counts, ["x"], {"b": "n"})
    return placed.agg((F.sum(F.col("p") * (F.col("b") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))


def due(versions: Column, steps: int, last: int) -> Column:
    """Whether a version asks for an evaluation."""
    return (versions % steps == 0) & (versions > last)
