"""Substring dedup by sliding sentence spans.

From every sentence on, the shortest run of several consecutive sentences with enough
words is hashed (128 bits); equal runs meet in one aggregation, summed before the
shuffle, that keeps the first place of each; and all sentences covered by a run that also
stands at an earlier place are removed.

A passage is often pasted into the middle of a sentence, and then its first and last
sentences differ from holder to holder. Sentences are therefore cut at commas, colons
and semicolons too, so that what is lost at the rims is short; and a run has to have
`words` words, since short sentences repeat by chance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import texts_of
from millrace.workspace import stored

#: A sentence with the end marks and white space that follow it; the pieces make up the text.
SENTENCE = re.compile(r"[^.!?,;:\n]*(?:[.!?,;:]+|\n|\Z)[ \t\r\n]*")
SPACE = re.compile(r"[ \t\r\n]+")


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.findall(text) if s]


def run_ends(counts: list[int], k: int, words: int) -> list[int]:
    """For each sentence from which a run begins, the first ones in order, where it ends (exclusive).

    counts: the words of each sentence. A run is the shortest with k sentences and `words` words at least.
    """
    out, end, total = [], 0, 0
    for start, own in enumerate(counts):
        while end < len(counts) and (end - start < k or total < words):
            total += counts[end]
            end += 1
        if end - start < k or total < words:
            break
        out.append(end)
        total -= own
    return out


def runs_of(text: str, k: int, words: int) -> tuple[list[int], list[str], list[str]]:
    """(ends of runs, sentences, sentences as they are compared: white space counts as one space, and not at the ends)."""
    parts = sentences(text)
    plain = [SPACE.sub(" ", s).strip(" ") for s in parts]
    return run_ends([p.count(" ") + 1 if p else 0 for p in plain], k, words), parts, plain


def run_hashes(text: str, k: int, words: int) -> bytes:
    """16 bytes for each run."""
    ends, _, plain = runs_of(text, k, words)
    each = [xxhash.xxh3_128_digest(s) for s in plain]
    return b"".join([xxhash.xxh3_128_digest(b"".join(each[start:end])) for start, end in enumerate(ends)])


def deduplicate(docs: DataFrame, k: int = 2, words: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_sentences, n_removed, n_shared, text (what is left).

    A sentence goes if a run (k sentences and `words` words at least, the shortest from its
    first sentence on) that covers it stands at an earlier place too. n_removed counts the
    sentences that go, n_shared those of them that a run covers whose first place is in
    another row: what a text repeats of itself is removed, but shared with nobody.
    Places are ordered by id (null first), rows that repeat an id by an arbitrary fixed
    order, then by position. Texts too short for a run stay as they are; a null text gives
    0 sentences and an empty text. Other columns are ignored. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "sentence-rows")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [run_hashes(t, k, words) for t in texts_of(batch)]
            counts = np.array([len(c) // 16 for c in coded], np.int64)
            hashes = np.frombuffer(b"".join(coded), "<i8").reshape(-1, 2)
            owner = np.repeat(np.arange(len(coded)), counts)
            position = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            for a in range(0, len(owner), 50_000):
                b = a + 50_000
                take = pa.array(owner[a:b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[a:b, 0].copy()), pa.array(hashes[a:b, 1].copy()), batch.column("id").take(take), batch.column("row").take(take), pa.array(position[a:b].astype(np.int32))],
                    ["h1", "h2", "id", "row", "at"],
                )

    found = rows.mapInArrow(spans, f"h1 bigint, h2 bigint, id {kind}, row bigint, at int")
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("id", "row", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("h1", "h2", F.col("first.row").alias("first_row"), F.col("first.at").alias("first_at"))
    later = found.select("h1", "h2", "row", "at").join(stored(first, "sentence-first"), ["h1", "h2"]).where("row <> first_row OR at <> first_at")
    place = F.struct("at", (F.col("row") != F.col("first_row")).alias("shared"))
    gone = later.groupBy("row").agg(F.collect_list(place).alias("gone"))  # bounded by the length of a text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, shared, left = [], [], [], []
            for text, at in zip(texts_of(batch), batch.column("gone").to_pylist(), strict=True):
                ends, parts, _ = runs_of(text, k, words)
                drop = {i for g in at or () for i in range(g["at"], ends[g["at"]])}
                totals.append(len(parts))
                removed.append(len(drop))
                shared.append(len({i for g in at or () if g["shared"] for i in range(g["at"], ends[g["at"]])}))
                left.append("".join([s for i, s in enumerate(parts) if i not in drop]) if drop else text)
            counts = [pa.array(c, pa.int64()) for c in (totals, removed, shared)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *counts, pa.array(left, pa.string())], ["id", "n_sentences", "n_removed", "n_shared", "text"])

    out = rows.join(gone, "row", "left").select("id", "text", "gone").mapInArrow(cut, f"id {kind}, n_sentences bigint, n_removed bigint, n_shared bigint, text string")
    return out.withColumnRenamed("id", id_col)
