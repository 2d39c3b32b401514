"""Plug-ins by name, and scoring with them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> name -> what was registered. Kinds are free: loss, metric, predictor, sink ...
PLUGINS: dict[str, dict[str, Callable]] = {}


def plugin(kind: str, name: str | None = None):
    """Registers a function or class under its own or another name; a name that is taken raises."""

    def add(made):
        names = PLUGINS.setdefault(kind, {})
        if (name or made.__name__) in names:
            raise ValueError(f"{kind} {name or made.__name__} is registered already")
        names[name or made.__name__] = made
        return made

    return add


def find(kind: str, name: str) -> Callable:
    try:
        return PLUGINS[kind][name]
    except KeyError:
        raise ValueError(f"no {kind} named {name}") from None


def score(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], inputs: Sequence[str], name: str = "score") -> DataFrame:
    """df with a double from a model: `load` runs once in each task and gives a function of a batch of the inputs."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        predict = load()
        for batch in batches:
            yield predict(batch)

    return df.withColumn(name, run(F.struct(*inputs)))


def deliver(df: DataFrame, sink: Callable[[int, Iterator], None]) -> None:
    """Hands the rows of each partition, with its number, to a sink; a partition that runs again is handed over again."""

    def each(rows: Iterator) -> None:
        from pyspark import TaskContext

        sink(TaskContext.get().partitionId(), rows)

    df.foreachPartition(each)


@plugin("predictor")
def linear(weights: Sequence[float], bias: float = 0.0) -> Callable[[], Callable[[pd.DataFrame], pd.Series]]:
    """A loader of a linear model, for `score`."""
    return lambda: lambda batch: sum((batch.iloc[:, k].astype("float64") * w for k, w in enumerate(weights)), pd.Series(float(bias), index=batch.index))


def average(fn: Column) -> Column:
    """A metric from a function of label and prediction: its mean over all rows."""
    return F.avg(fn.cast("double"))
