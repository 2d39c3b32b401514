"""Declarative feature plans: named steps, parameters from an analysis, one select.

A plan is a list of steps. Fitting runs one aggregation for all numbers and one job for
each vocabulary, derives id sizes and offsets along the steps, and keeps all parameters
as JSON; applying a fitted plan is a single ``select`` that Catalyst optimises.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import hashing, transforms
from millrace.operators import statistics

NUMERIC = ("normalize", "standardize", "bucketize")
#: More bins than these are never derived.
MOST_BINS = 1_000_000
SIZED = ("bucketize", "lookup", "hash", "log_round", "round_identity")


@dataclass
class Step:
    """name: of the result; kind; inputs: column or step names; parameters: fixed or, after fitting, derived.

    Kinds: numeric, normalize, standardize, bucketize (buckets or boundaries), lookup
    (vocabulary or least), hash (bins, or derived from the distinct count; native), log_round
    and round_identity (bins), cross (bins), group (concatenates id steps with offsets), embed
    (dim; the ids that are looked up; on a text column a hash step is put before it).
    """

    name: str
    kind: str
    inputs: list[str]
    parameters: dict = field(default_factory=dict)

    @property
    def size(self) -> int:
        """The number of ids of an id step."""
        p = self.parameters
        if self.kind == "bucketize":
            return len(p["boundaries"]) + 1
        if self.kind == "lookup":
            return len(p["vocabulary"]) + p.get("oov", 1)
        if self.kind == "group":
            return sum(p["sizes"])
        return p["bins"]


@dataclass
class FeaturePlan:
    steps: list[Step]

    def order(self) -> list[Step]:
        """The steps, each after those that it uses; a cycle or a repeated name raises."""
        by = {s.name: s for s in self.steps}
        if len(by) != len(self.steps):
            raise ValueError("a step's name is repeated")
        done: dict[str, Step] = {}

        def visit(step: Step, path: tuple[str, ...]) -> None:
            if step.name in path:
                raise ValueError(f"a cycle: {' -> '.join((*path, step.name))}")
            for i in step.inputs:
                if i in by and i not in done:
                    visit(by[i], (*path, step.name))
            done.setdefault(step.name, step)

        for s in self.steps:
            visit(s, ())
        return list(done.values())

    def expanded(self, df: DataFrame) -> FeaturePlan:
        """The plan in which a hash step stands between a text column and a step that embeds it."""
        texts = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
        named, steps = {s.name for s in self.steps}, []
        for s in self.steps:
            if s.kind == "embed" and s.inputs[0] in texts and s.inputs[0] not in named:
                hashed = f"{s.name}_hash"
                bins = {"bins": s.parameters["bins"]} if "bins" in s.parameters else {}
                steps.append(Step(hashed, "hash", list(s.inputs), bins))
                s = Step(s.name, s.kind, [hashed], dict(s.parameters))
            steps.append(s)
        return FeaturePlan(steps)

    def known(self, columns: Sequence[str]) -> tuple[FeaturePlan, list[str]]:
        """The plan without the steps that need a column which is not there, and the names of those left out.

        A group keeps the members that are left.
        """
        there, out, gone = set(columns), [], []
        for s in self.order():
            inputs = [i for i in s.inputs if i in there]
            if len(inputs) == len(s.inputs) or s.kind == "group" and inputs:
                out.append(Step(s.name, s.kind, inputs, dict(s.parameters)))
                there.add(s.name)
            else:
                gone.append(s.name)
        return FeaturePlan(out), gone

    def fit(self, df: DataFrame) -> FeaturePlan:
        """A plan with all parameters; given ones are kept. Steps that need an analysis read columns of df."""
        steps = [Step(s.name, s.kind, list(s.inputs), dict(s.parameters)) for s in self.expanded(df).order()]
        numeric = sorted({s.inputs[0] for s in steps if s.kind in ("normalize", "standardize") and not s.parameters})
        buckets = {s.inputs[0]: s.parameters["buckets"] for s in steps if s.kind == "bucketize" and "boundaries" not in s.parameters}
        distinct = sorted({s.inputs[0] for s in steps if s.kind == "hash" and "bins" not in s.parameters})
        wanted: list[Column] = [F.struct(*statistics.numeric_aggregates(n)).alias(f"n {n}") for n in numeric]
        wanted += [F.count_distinct(d).alias(f"d {d}") for d in distinct]
        found = df.agg(*wanted).first().asDict(recursive=True) if wanted else {}
        by = {s.name: s for s in steps}
        for s in steps:
            p, source = s.parameters, s.inputs[0]
            if s.kind == "normalize" and not p:
                p |= {"low": found[f"n {source}"]["minimum"], "high": found[f"n {source}"]["maximum"]}
            elif s.kind == "standardize" and not p:
                p |= {"mean": found[f"n {source}"]["mean"], "deviation": found[f"n {source}"]["deviation"]}
            elif s.kind == "bucketize" and "boundaries" not in p:
                p["boundaries"] = sorted(set(statistics.percentiles(df, source, buckets[source])))
            elif s.kind == "lookup" and "vocabulary" not in p:
                p["vocabulary"] = statistics.ordered_vocabulary(df, source, p.get("least", 1), 10_000)
            elif s.kind == "hash" and "bins" not in p:
                p["bins"] = min(MOST_BINS, max(1, statistics.hash_bucket_size(found[f"d {source}"])))
            elif s.kind == "group":
                p["sizes"] = [by[i].size for i in s.inputs]
                p["offsets"] = transforms.id_offsets(p["sizes"])
        return FeaturePlan(steps)

    def columns(self) -> dict[str, Column]:
        """The result of each step as an expression of the source columns."""
        made: dict[str, Column] = {}
        for s in self.order():
            inputs = [made[i] if i in made else F.col(i) for i in s.inputs]
            made[s.name] = self._column(s, inputs)
        return made

    @staticmethod
    def _column(s: Step, inputs: list[Column]) -> Column:
        p, x = s.parameters, inputs[0]
        if s.kind == "numeric":
            return x.cast("double")
        if s.kind == "normalize":
            return transforms.min_max(F.lit(p["low"]), F.lit(p["high"]))(x)
        if s.kind == "standardize":
            return transforms.standardize(F.lit(p["mean"]), F.lit(p["deviation"]))(x)
        if s.kind == "bucketize":
            return transforms.bucketize(p["boundaries"])(x.cast("double"))
        if s.kind == "lookup":
            return transforms.index_lookup(p["vocabulary"], p.get("oov", 1))(x)
        if s.kind == "embed":
            return x.cast("bigint")
        if s.kind == "hash":
            return (hashing.native_hash_bucket if p.get("native") else hashing.hash_bucket)(p["bins"])(x)
        if s.kind == "log_round":
            return transforms.log_round(p["bins"], p.get("default", 0), p.get("base"))(x)
        if s.kind == "round_identity":
            return transforms.round_identity(p["bins"], p.get("default", 0))(x)
        if s.kind == "cross":
            joined = F.concat_ws("_X_", *[i.cast("string") for i in inputs])
            return hashing.string_partition(joined, p["bins"])
        if s.kind == "group":
            return F.filter(F.array(*[i + F.lit(o).cast("bigint") for i, o in zip(inputs, p["offsets"], strict=True)]), lambda v: v.isNotNull())
        raise ValueError(f"not a kind of step: {s.kind}")

    def apply(self, df: DataFrame, outputs: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
        made = self.columns()
        return df.select(*keep, *[made[o].alias(o) for o in outputs])

    def to_json(self) -> str:
        return json.dumps([asdict(s) for s in self.steps], sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> FeaturePlan:
        return cls([Step(**s) for s in json.loads(text)])
