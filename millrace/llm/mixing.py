"""Mixing sources to target weights: temperature mixing realised as block permutations.

The token shares p of the sources are raised to an exponent a and normalised. The
exponent is bisected until the weights meet a target entropy or the largest repetition
of a source meets a limit. The budget is such that the least repeated source is read
just once, so that no document is left out; a source's weight then says how often it is
read. Each source's documents are dealt into blocks by a hash, the blocks and the
documents in them are permuted by further hashes, and the budget is spent along that
permutation: whole passes, then one pass that ends where the budget does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.workspace import stored, told_apart

#: For a target entropy the sources' shares, a number each, are brought to the driver up to this number.
MOST_SOURCES = 100_000
#: A source has so many blocks at most, and about so many documents in each until then.
MOST_BLOCKS, BLOCK = 4096, 256
NO_SOURCE = "(none)"


def tokens(text: Column) -> Column:
    """Runs of characters other than space, tab and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\r\\n]+")), F.lit(0)).cast("bigint")


def weights(shares: list[float], exponent: float) -> list[float]:
    powers = [p**exponent if p > 0 else 0.0 for p in shares]
    total = sum(powers)
    return [x / total if total else 0.0 for x in powers]


def entropy(values: list[float]) -> float:
    return -sum(w * math.log(w) for w in values if w > 0)


def largest_repetition(shares: list[float], exponent: float) -> float:
    """How often the most repeated source is read while the least repeated is read once."""
    ratio = [w / p for w, p in zip(weights(shares, exponent), shares, strict=True) if p > 0]
    return max(ratio) / min(ratio) if ratio else 1.0


def find_exponent(shares: list[float], target_entropy: float | None = None, most_repeats: float | None = None) -> float:
    """The exponent in [0, 1] that meets the target; bisected, to 6 decimals.

    Entropy grows and repetition grows as the exponent falls from 1 (the shares as they
    are) to 0 (all sources alike). For a target entropy the exponent is rounded; one that
    no exponent meets gives 0. For a repetition limit it is rounded up, so that the limit
    holds; a limit that all exponents meet gives 0.
    """
    if (target_entropy is None) == (most_repeats is None):
        raise ValueError("give either target_entropy or most_repeats")

    def beyond(exponent: float) -> bool:
        """Whether a smaller exponent is asked for."""
        if target_entropy is not None:
            return entropy(weights(shares, exponent)) < target_entropy
        return largest_repetition(shares, exponent) <= most_repeats

    low, high = 0.0, 1.0
    if target_entropy is not None and not beyond(1.0):
        return 1.0
    if beyond(0.0):
        return 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if beyond(middle) else (middle, high)
    return round(high, 6) if target_entropy is not None else math.ceil(round(high * 1e6, 3)) / 1e6


def _shares(sizes: DataFrame) -> list[float]:
    totals = [r.all_tokens for r in sizes.select("all_tokens").limit(MOST_SOURCES + 1).collect()]
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return [t / sum(totals) for t in totals]


def plan(docs: DataFrame, most_repeats: float | None = 2.0, target_entropy: float | None = None, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: id, source, tokens, weight, block, copies, mix_position, mix_step, and row_col if given.

    copies: how often the document is read (1 at least, and never so often that a source is
    read more than most_repeats times). mix_position in [0, 1]: where its first reading
    stands, the next ones mix_step further each, so that ordering by it interleaves the
    sources evenly. A null source is the source "(none)"; a null text has 0 tokens; a source
    without tokens is read once. Rows that repeat an id in a source are separate documents
    with the same place. row_col: a column that tells rows apart, carried for joining back.
    An empty table gives no rows.
    """
    if target_entropy is not None:
        most_repeats = None
    source = F.coalesce(F.col(f"`{source_col}`"), F.lit(NO_SOURCE))
    own = F.col(f"`{row_col}`") if row_col else F.lit(0)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), source.alias("source"), tokens(F.col(f"`{text_col}`")).alias("tokens"), own.alias("_own")).withColumn("place", F.md5(F.concat_ws("|", F.lit(str(seed)), "source", F.coalesce(F.col("id").cast("string"), F.lit("")))))
    sizes = stored(rows.groupBy("source").agg(F.sum("tokens").alias("all_tokens"), F.count(F.lit(1)).alias("n")), "mixing-sources")
    ends = sizes.agg(F.max("all_tokens").alias("largest"), F.min(F.when(F.col("all_tokens") > 0, F.col("all_tokens"))).alias("smallest")).first()
    exponent = 0.0
    if ends.smallest and target_entropy is not None:
        exponent = find_exponent(_shares(sizes), target_entropy)
    elif ends.smallest:  # the repetition depends on the largest and the smallest source alone
        both = ends.largest + ends.smallest
        exponent = find_exponent([ends.largest / both, ends.smallest / both], None, most_repeats)
    t = F.col("all_tokens")
    budget = F.floor(F.pow(F.lit(float(ends.largest or 1)) / t, F.lit(1 - exponent)) * t + 0.5)
    if most_repeats is not None:
        budget = F.least(budget, F.floor(t * float(most_repeats)))
    budgets = sizes.withColumn("budget", F.when(t > 0, budget).otherwise(0).cast("bigint"))
    spent = budgets.agg(F.sum("budget")).first()[0] or 1
    targets = budgets.select(
        "source",
        "all_tokens",
        "budget",
        F.round(F.col("budget") / spent, 6).alias("weight"),
        F.when(t > 0, F.floor(F.col("budget") / t)).otherwise(1).alias("passes"),
        F.when(t > 0, F.col("budget") % t).otherwise(0).alias("rest"),
        F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("n") / BLOCK)).alias("blocks"),
    )
    dealt = rows.join(targets, "source").withColumn("block", F.conv(F.substring("place", 1, 8), 16, 10).cast("bigint") % F.col("blocks"))
    earlier = Window.partitionBy("source", "block").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("inside", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
    sums = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    order = Window.partitionBy("source").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("block"), "source", F.col("block").cast("string"))), "block")
    sums = sums.select("source", "block", F.coalesce(F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = inside.join(sums, ["source", "block"]).withColumn("at", F.col("before") + F.col("inside"))
    spread = lambda x: F.when(F.col("budget") > 0, F.col(x) / F.col("budget")).otherwise(0.0)
    out = placed.select(
        F.col("id").alias(id_col),
        "source",
        "tokens",
        "weight",
        "block",
        (F.col("passes") + F.when(F.col("at") < F.col("rest"), 1).otherwise(0)).cast("bigint").alias("copies"),
        spread("at").alias("mix_position"),
        spread("all_tokens").alias("mix_step"),
        F.col("_own"),
    )
    return out.withColumnRenamed("_own", row_col) if row_col else out.drop("_own")


def mixed(docs: DataFrame, most_repeats: float = 2.0, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with each row as often as the plan says, all columns as they were.

    Each partition has a part of the documents, dealt by a hash, in mixed order; so has each
    file of a table that is written from it. The texts are shuffled once.
    """
    rows = told_apart(docs, "mixing-rows")
    light = rows.select("_row", *[F.col("_doc").getField(c).alias(a) for c, a in ((id_col, "id"), (source_col, "source"), (text_col, "text"))])
    placed = plan(light, most_repeats, None, seed, "id", "source", "text", "_row").select("_row", "copies", "mix_position", "mix_step")
    each = rows.join(placed, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    each = each.withColumn("_position", F.col("mix_position") + F.col("_copy") * F.col("mix_step"))
    return each.sortWithinPartitions("_position", "_row").select("_doc.*")
