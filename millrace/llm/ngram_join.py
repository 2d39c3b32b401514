"""Similarity join of documents by the Jaccard coefficient of their word n-grams.

1. Documents with the same set of n-grams are one class; the join is among classes.
2. MinHash signatures are cut into bands; classes that share a band are candidates.
   With 32 bands of 4 a pair at 0.8 is missed with probability 5e-8.
3. Candidates are compared MinHash by MinHash; a pair is dropped as soon as the
   posterior probability that its similarity reaches the threshold falls below a
   tolerance. What survives links classes to small groups.
4. In each group the pairs are pruned likewise and the rest verified exactly on the sets.

Buckets and groups of any size are split into blocks, and pairs of blocks are the unit
of work, so that no task holds an unbounded group and no pair becomes a row: a task
returns a count and a label for each member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import runs, slices, texts_of, whole_groups
from millrace.llm.components import connected_components
from millrace.workspace import stored, told_apart

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
#: Members of a block in a bucket, and in a group that is verified.
BUCKET_BLOCK, GROUP_BLOCK = 512, 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), 95]] = True
_WORD[128:] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x5851F42D4C957F2D
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def shingles(texts: list[str], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of words of each text, and where each text's begin (one more at the end).

    Words are runs of letters, digits and underscores of the lower-cased text (all beyond
    ASCII counts as letters). A text of 1 to n-1 words has one n-gram, of all its words.
    Repeated n-grams are repeated here.
    """
    coded = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    lengths = np.array([len(c) + 1 for c in coded], np.int64)
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    letter = _WORD[data]
    edges = np.flatnonzero(np.diff(letter.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(1 << max(20, int(len(data)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    words = _mix((sums[ends] - sums[starts]) * down[starts])
    first = np.searchsorted(starts, bounds)
    counts = np.diff(first)
    grams = np.maximum(counts - n + 1, np.minimum(counts, 1))
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(grams)])
    at = np.repeat(first[:-1] - offsets[:-1], grams) + np.arange(offsets[-1])
    width = np.repeat(np.minimum(counts, n), grams)
    total = width.astype(np.uint64)
    for k in range(n):
        inside = k < width
        total[inside] = _mix(total[inside] * _ODD + words[at[inside] + k])
    return total, offsets


def signatures(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 MinHash values (32 bits) of each text that has n-grams."""
    some = np.flatnonzero(np.diff(offsets))
    out = np.empty((len(some), HASHES), np.uint32)
    if len(some):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat((grams * _SEEDS[k]) >> np.uint64(32), offsets[some])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    key = np.zeros((len(signature), BANDS), np.uint64)
    for r in range(ROWS):
        key = _mix(key * _ODD + signature[:, r::ROWS].astype(np.uint64) + np.uint64(1))
    return key.view(np.int64)


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """After each step of 16 compared values: the least matches that keep a pair.

    With a uniform prior, m matches in n leave P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def surviving(signature: np.ndarray, i: np.ndarray, j: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no step drops."""
    matches = np.zeros(len(i), np.int32)
    for step, m in enumerate(least):
        part = slice(step * STEP, (step + 1) * STEP)
        matches += (signature[i, part] == signature[j, part]).sum(1)
        keep = matches >= m
        if not keep.all():
            i, j, matches = i[keep], j[keep], matches[keep]
        if not len(i):
            break
    return i, j


def _labels(n: int, i: np.ndarray, j: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """labels after joining the pairs i, j: the smallest row number that is connected."""
    while len(i):
        low = np.minimum(labels[i], labels[j])
        before = labels.copy()
        np.minimum.at(labels, labels[i], low)
        np.minimum.at(labels, labels[j], low)
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels = further
        if np.array_equal(before, labels):
            break
        open_ = labels[i] != labels[j]
        i, j = i[open_], j[open_]
    return labels


def link_buckets(group: np.ndarray, block: np.ndarray, crossing: np.ndarray, signature: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Labels (row numbers) that join the surviving pairs of each group of consecutive rows.

    crossing: rows of a pair of different blocks, of which only pairs between the blocks count.
    Pairs that are connected already are not compared again.
    """
    n = len(group)
    labels = np.arange(n)
    _, ends = runs(group)
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)
    i = np.flatnonzero(left > 1)
    d = 1
    while len(i):
        j = i + d
        ask = (labels[i] != labels[j]) & (~crossing[i] | (block[i] != block[j]))
        if ask.any():
            a, b = surviving(signature, i[ask], j[ask], least)
            labels = _labels(n, a, b, labels)
        d += 1
        i = i[left[i] > d]
    return labels


def verify_group(sets: list[np.ndarray], signature: np.ndarray, cross: np.ndarray | None, threshold: float, least: tuple[int, ...]) -> np.ndarray:
    """links[i, j] for the members of a group: pruned by the signatures, then exact. cross: which pairs count."""
    n = len(sets)
    alive = ~np.eye(n, dtype=bool) if cross is None else cross.copy()
    matches = np.zeros((n, n), np.int16)
    for step, m in enumerate(least):
        for k in range(step * STEP, (step + 1) * STEP):
            matches += signature[:, k, None] == signature[None, :, k]
        alive &= matches >= m
        if not alive.any():
            return alive
    sizes = np.array([len(s) for s in sets])
    if n <= 8:
        common = np.zeros((n, n))
        for i, j in zip(*np.nonzero(np.triu(alive | alive.T)), strict=True):
            common[i, j] = common[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        every, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        starts, ends = runs(every)
        shared = ends - starts > 1
        column = np.repeat(np.cumsum(shared) - 1, ends - starts)
        keep = np.repeat(shared, ends - starts)
        owner, column = owner[keep], column[keep]
        common = np.zeros((n, n), np.float32)
        for at in range(0, int(shared.sum()), 8192):
            a, b = np.searchsorted(column, [at, at + 8192])
            dense = np.zeros((n, 8192), np.float32)
            dense[owner[a:b], column[a:b] - at] = 1
            common += dense @ dense.T
    union = sizes[:, None] + sizes[None, :] - common
    return alive & (common >= threshold * union - 1e-9)


def _split(members: DataFrame, keys: list[str], size: str, most: int) -> DataFrame:
    """members once for each pair of blocks (bi, bj) of their group; `size` has the rows of the group."""
    k = F.ceil(F.col(size) / F.lit(most)).cast("int")
    cut = members.withColumn("_k", k).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("_k")).cast("int"))
    others = cut.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return others.withColumn("bi", F.least("block", "_o")).withColumn("bj", F.greatest("block", "_o")).drop("_k", "_o")


def _sorted(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, "cls")


def similar(docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id, n_links, n_ngrams.

    n_links: how many other rows have a Jaccard coefficient of `threshold` or more, copies
    counted one by one. class_id: the smallest id that is reached over such links, null only
    if all of the class are null. A text without words (null, empty) has no n-grams, no links
    and its own id as class. Rows that repeat an id count as separate rows. Other columns
    are ignored. An empty table gives no rows.
    """
    found = _linked(_source(told_apart(docs, "ngram-rows"), id_col, text_col), threshold, n, tolerance)
    return found.select(F.col("id").alias(id_col), F.col("class.id").alias("class_id"), "n_links", "n_ngrams")


def _source(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col("_row").alias("row"), F.col("_doc").getField(id_col).alias("id"), F.col("_doc").getField(text_col).alias("text"))


def _linked(source: DataFrame, threshold: float, n: int, tolerance: float) -> DataFrame:
    """row, id, class, n_links, n_ngrams of a table of row (which tells rows apart), id, text.

    class: the row (struct of missing, id, row) that stands for the class, the one with the
    smallest id; null ids come after all others, equal ids in the order of row.
    """
    kind, row_kind = (source.schema[c].dataType.simpleString() for c in ("id", "row"))
    own = F.struct(F.col("id").isNull().alias("missing"), "id", "row")
    least = least_matches(threshold, tolerance)

    def sets_of(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        grams, offsets = shingles(texts, n)
        sets = [np.unique(grams[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        prints = np.array([np.frombuffer(xxhash.xxh3_128_digest(s), "<i8") for s in sets]).reshape(-1, 2)
        return sets, prints, signatures(grams, offsets)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, 400_000):
                sets, prints, signed = sets_of(texts[a:b])
                counts = np.array([len(s) for s in sets], np.int64)
                bands, coded = iter(band_keys(signed)), iter(short(signed))
                keys = pa.array([next(bands) if c else None for c in counts], pa.list_(pa.int64()))
                coded = pa.array([next(coded).tobytes() if c else None for c in counts], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), pa.array(counts), keys, coded],
                    ["row", "id", "f1", "f2", "n_ngrams", "bands", "signature"],
                )

    signed = stored(source.select("row", "id", "text").mapInArrow(sign, f"row {row_kind}, id {kind}, f1 bigint, f2 bigint, n_ngrams bigint, bands array<bigint>, signature binary"), "ngram-signed")
    classes = signed.where("n_ngrams > 0").groupBy("f1", "f2").agg(F.min(own).alias("least"), F.count(F.lit(1)).alias("size"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "ngram-classes")

    banded = classes.select("cls", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    members = banded.join(buckets, ["band", "key"]).join(classes.select("cls", "signature"), "cls")
    members = _split(members, ["band", "key"], "rows", BUCKET_BLOCK)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ["band", "key", "bi", "bj"]):
            columns = [part.column(c).to_numpy() for c in ("band", "key", "bi", "bj")]
            starts, ends = runs(*columns)
            group = np.repeat(np.arange(len(starts)), ends - starts)
            cls = part.column("cls").to_numpy()
            labels = link_buckets(group, part.column("block").to_numpy(), columns[2] != columns[3], _matrix(part.column("signature")), least)
            edges = np.unique(np.stack([cls, cls[labels]], 1)[labels != np.arange(len(cls))], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], ["a", "b"])

    keys = ["band", "key", "bi", "bj"]
    edges = _sorted(members.select(*keys, "block", "cls", "signature"), keys).mapInArrow(link, "a bigint, b bigint")
    near = connected_components(edges).withColumnsRenamed({"node": "cls", "component": "near"})
    near = stored(near.join(near.groupBy("near").agg(F.count(F.lit(1)).alias("rows")), "near"), "ngram-near")
    wanted = near.join(classes.drop("bands", "signature"), "cls").select("cls", "near", "rows", "size", F.col("least.row").alias("row"))
    texts = wanted.join(source.select("row", "text"), "row").select("cls", "near", "rows", "size", "text")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, 400_000):
                part = batch.slice(a, b - a)
                sets, _, signed = sets_of(texts[a:b])  # all of them have n-grams
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("cls", "near", "rows", "size")), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in short(signed)], pa.binary())],
                    ["cls", "near", "rows", "size", "ngrams", "signature"],
                )

    verified = texts.mapInArrow(expand, "cls bigint, near bigint, rows bigint, size bigint, ngrams binary, signature binary")
    keys = ["near", "bi", "bj"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ["near", "bi", "bj"]):
            near, bi, bj = (part.column(c).to_numpy() for c in ("near", "bi", "bj"))
            cls, block, size = (part.column(c).to_numpy() for c in ("cls", "block", "size"))
            signature = _matrix(part.column("signature"))
            ngrams = part.column("ngrams")
            out = []
            for a, b in zip(*runs(near, bi, bj), strict=True):
                at = np.arange(a, b)
                sets = [np.frombuffer(ngrams[int(k)].as_buffer(), np.uint64) for k in at]
                cross = block[at][:, None] != block[at][None, :] if bi[a] != bj[a] else None
                linked = verify_group(sets, signature[at], cross, threshold, least)
                i, j = np.nonzero(linked)
                labels = _labels(len(at), i, j, np.arange(len(at)))
                out.append(np.stack([cls[at], cls[at][labels], linked @ size[at]], 1))
            rows = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, k].copy()) for k in range(3)], ["cls", "label", "links"])

    split = _split(verified, ["near"], "rows", GROUP_BLOCK).select(*keys, "block", "cls", "size", "ngrams", "signature")
    pairs = stored(_sorted(split, keys).mapInArrow(verify, "cls bigint, label bigint, links bigint"), "ngram-links")
    joined = connected_components(pairs, "cls", "label").withColumnsRenamed({"node": "cls"})
    smallest = joined.join(classes, "cls").groupBy("component").agg(F.min("least").alias("class"))
    found = pairs.groupBy("cls").agg(F.sum("links").alias("links")).join(joined.join(smallest, "component"), "cls", "left")
    per_class = classes.select("cls", "f1", "f2", "size", "least").join(found, "cls", "left")
    per_class = per_class.select("f1", "f2", F.coalesce("class", "least").alias("class"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = signed.select("row", "id", "f1", "f2", "n_ngrams").join(stored(per_class, "ngram-result"), ["f1", "f2"], "left")
    return out.select("row", "id", F.coalesce("class", own).alias("class"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "n_ngrams")


def short(signature: np.ndarray) -> np.ndarray:
    """The low 16 bits of each value, which are what is compared."""
    return (signature & np.uint32(0xFFFF)).astype("<u2")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def one_of_each(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, all columns: the one with the smallest id; null ids come after all others,
    and of rows that repeat an id in a class one stays. Rows are told apart by their place, never by id."""
    rows = told_apart(docs, "ngram-rows")
    source = _source(rows, id_col, text_col)
    gone = _linked(source, threshold, 5, 1e-7).where("row <> class.row").select(F.col("row").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select("_doc.*")
