"""Key-value text columns to wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(kv: Column, between: str = ",", inside: str = ":") -> Column:
    """map<string, string> of the pairs; names and values are trimmed, of a repeated name the last pair counts."""
    quoted = lambda s: "\\Q" + s + "\\E"
    pairs = F.filter(F.transform(F.split(kv, quoted(between)), lambda p: F.split(p, quoted(inside), 2)), lambda p: F.size(p) == 2)
    pairs = F.transform(pairs, lambda p: F.struct(F.trim(p[0]).alias("key"), F.trim(p[1]).alias("value")))
    is_last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["key"] == p["key"]))
    # The pairs are bound to a name, so that they are made once and not again for each of them.
    return F.transform(F.array(pairs), lambda ps: F.map_from_entries(is_last(ps)))[0]


def flatten(df: DataFrame, kv_col: str, names: Sequence[str], between: str = ",", inside: str = ":", append: Sequence[str] = ()) -> DataFrame:
    """One column for each name, NULL where it is missing; the columns in `append` pass through."""
    made = df.select(*append, parse(F.col(kv_col), between, inside).alias("_kv"))
    return made.select(*append, *[F.try_element_at("_kv", F.lit(n.strip())).alias(n.strip()) for n in names])


def infer_names(df: DataFrame, kv_col: str, order: Sequence[str], n: int = 100, between: str = ",", inside: str = ":") -> list[str]:
    """The names in the first n rows in the given order, sorted."""
    keys = df.orderBy(*order).limit(n).select(F.explode(F.map_keys(parse(F.col(kv_col), between, inside))).alias("k")).distinct()
    return sorted(r.k for r in keys.collect())


def flatten_sql(table: str, kv_col: str, names: Sequence[str], target: str, between: str = ",", inside: str = ":") -> str:
    """A CREATE TABLE AS statement that flattens with built-in functions (repeated names are an error there)."""
    each = ", ".join(f"try_element_at(str_to_map({kv_col}, '{between}', '{inside}'), '{n}') AS {n}" for n in names)
    return f"CREATE TABLE {target} AS SELECT {each} FROM {table}"


@F.udtf
class KeyValues:
    """Table-valued form of `flatten`: key_values(kv, names, between, inside) has one row, a text column for each name.

    names: a constant, comma-separated. Register it with `spark.udtf.register`.
    """

    @staticmethod
    def analyze(kv, names, between, inside):
        from pyspark.sql.types import StringType, StructType
        from pyspark.sql.udtf import AnalyzeResult

        schema = StructType()
        for name in names.value.split(","):
            schema = schema.add(name.strip(), StringType())
        return AnalyzeResult(schema)

    def eval(self, kv, names, between, inside):
        found = {}
        for pair in (kv or "").split(between):
            name, sep, value = pair.partition(inside)
            if sep:
                found[name.strip(" ")] = value.strip(" ")
        yield tuple(found.get(name.strip()) for name in names.split(","))
