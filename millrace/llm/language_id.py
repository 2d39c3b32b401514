"""Language identification of whole, possibly mixed texts.

The script of a word narrows the languages it can be in; each word gets a score for
each of these from counts of letter trigrams; and Viterbi over the words of a text,
with a penalty for each change of language, labels spans. The text's language is the
one with the most letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from millrace.llm.batches import slices, texts_of

#: First code points of ranges and the script of each range.
SCRIPT_RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
)
SCRIPTS = tuple(dict.fromkeys(s for _, s in SCRIPT_RANGES))
BUCKETS = 1 << 16
#: A language is a candidate for a script in which it has this share of its letters.
LEAST_SHARE = 0.01
#: Nats that a change of language costs.
SWITCH = 8.0
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower case (one code point), or 0 if it is no letter; and its script."""
    lower = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            lower[c] = ord(low[0])
    starts = np.array([s for s, _ in SCRIPT_RANGES])
    kinds = np.array([SCRIPTS.index(k) for _, k in SCRIPT_RANGES], np.uint8)
    return lower, kinds[np.searchsorted(starts, np.arange(0x110000), side="right") - 1]


@dataclass
class Words:
    """The words (runs of letters) of several texts: bounds in code points of the texts put together."""

    starts: np.ndarray
    ends: np.ndarray
    script: np.ndarray
    #: Bucket of the trigram around each letter, and where each word's begin.
    grams: np.ndarray
    first: np.ndarray
    #: How many words each text has.
    counts: np.ndarray
    offsets: np.ndarray


def words_of(texts: list[str]) -> Words:
    lower, scripts = _tables()
    lengths = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths + 1)])
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = lower[points]
    letter = folded != 0
    edges = np.flatnonzero(np.diff(letter.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    around = np.concatenate([np.zeros(1, np.uint32), folded, np.zeros(1, np.uint32)])
    mixed = around[:-2] * np.uint32(0x9E3779B1) + around[1:-1] * np.uint32(0x85EBCA77) + around[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    grams = (mixed >> np.uint32(16))[letter].astype(np.int64)
    sizes = ends - starts
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(starts, ends, scripts[points[starts]], grams, first, counts, offsets)


@dataclass
class Model:
    languages: list[str]
    #: Log probabilities: bucket, language.
    scores: np.ndarray
    #: Whether a language is a candidate: script, language.
    allowed: np.ndarray

    def word_scores(self, w: Words) -> np.ndarray:
        """Per word and language; 0 for all where the script has no candidate."""
        if not len(w.starts):
            return np.zeros((0, len(self.languages)), np.float32)
        out = np.add.reduceat(self.scores[w.grams], w.first, axis=0)
        fits = self.allowed[w.script]
        some = fits.any(1)
        out[some] = np.where(fits[some], out[some], -1e6)
        out[~some] = 0
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text (start, end, language, letters, known letters) of its spans, by Viterbi.

        Known letters are those of words in whose script some language was learned. The texts advance together, one word a step, the longest first.
        """
        w = words_of(texts)
        scores = self.word_scores(w)
        order = np.argsort(-w.counts, kind="stable")
        base = np.concatenate([np.zeros(1, np.int64), np.cumsum(w.counts)])[:-1][order]
        counts = w.counts[order]
        path = np.zeros(len(w.starts), np.int16)
        most = int(counts[0]) if len(counts) else 0
        active = np.searchsorted(-counts, -np.arange(most), side="left")
        switched = np.zeros(scores.shape, bool)
        source = np.zeros(len(scores), np.int16)
        value = np.zeros((len(texts), len(self.languages)), np.float32)
        for t in range(most):
            k = active[t]
            at = base[:k] + t
            now = value[:k]
            if t:
                best = now.argmax(1)
                top = now[np.arange(k), best][:, None] - np.float32(SWITCH)
                switched[at] = now < top
                source[at] = best
                now = np.maximum(now, top)
                now -= now.max(1, keepdims=True)
            value[:k] = now + scores[at]
        state = value.argmax(1).astype(np.int16)
        for t in range(most - 1, -1, -1):
            k = active[t]
            at = base[:k] + t
            here = state[:k]
            path[at] = here
            if t:
                state[:k] = np.where(switched[at, here], source[at], here)
        return self._spans(w, path)

    def _spans(self, w: Words, path: np.ndarray) -> list[list[tuple[int, int, int, int, int]]]:
        out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in w.counts]
        if not len(path):
            return out
        text = np.repeat(np.arange(len(w.counts)), w.counts)
        new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (path[1:] != path[:-1])])
        letters = np.add.reduceat(w.ends - w.starts, new)
        known = np.add.reduceat((w.ends - w.starts) * self.allowed.any(1)[w.script], new)
        last = np.r_[new[1:], len(path)] - 1
        owner = text[new]
        columns = (owner, w.starts[new] - w.offsets[owner], w.ends[last] - w.offsets[owner], path[new], letters, known)
        for d, *span in zip(*(c.tolist() for c in columns), strict=True):
            out[d].append(tuple(span))
        return out

    def label(self, spans: list[tuple[int, int, int, int, int]]) -> tuple[str, float]:
        if not spans or not self.languages:
            return UNDETERMINED, 0.0
        letters, total = [0] * len(self.languages), 0
        for _, _, label, n, known in spans:
            letters[label] += known
            total += n
        best = max(range(len(letters)), key=letters.__getitem__)
        return self.languages[best], letters[best] / total


def fit(labelled: DataFrame, most_rows: int = 8000, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from rows with a language; the caller leaves out what is held out.

    most_rows bounds the sample: about so many rows of each language, those with the
    smallest hashes of their ids (all rows of a language that has fewer), of which whole
    texts are counted. The counts, languages times 65,536 numbers, come to the driver.
    """
    rows = labelled.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    sizes = rows.groupBy(F.col(f"`{lang_col}`").alias("lang")).count().orderBy("lang").limit(1001).collect()
    if len(sizes) > 1000:
        raise ValueError("more than 1000 languages")
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    share = {r["lang"]: min(1.0, most_rows / r["count"]) for r in sizes}
    number = {name: i for i, name in enumerate(languages)}
    keep = F.coalesce(*[F.when(F.col("lang") == name, F.lit(s)) for name, s in share.items()])
    hashed = F.crc32(F.concat(F.lit("fit"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))) / F.lit(float(1 << 32))
    sample = rows.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), hashed.alias("h")).where(F.col("h") < keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(languages), BUCKETS), np.int64)
        letters = np.zeros((len(languages), len(SCRIPTS)), np.int64)
        for batch in batches:
            labels = np.array([number[x] for x in batch.column(0).to_pylist()])
            texts = texts_of(batch)
            for a, b in slices(texts, 1_000_000):
                w = words_of(texts[a:b])
                owner = np.repeat(labels[a:b], w.counts)
                sizes = w.ends - w.starts
                np.add.at(letters, (owner, w.script), sizes)
                grams += np.bincount(np.repeat(owner, sizes) * BUCKETS + w.grams, minlength=grams.size).reshape(grams.shape)
        for kind, counts in ((0, grams), (1, letters)):
            lang, bucket = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lang), kind)), pa.array(lang), pa.array(bucket), pa.array(counts[lang, bucket])], ["kind", "lang", "bucket", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "kind bigint, lang bigint, bucket bigint, n bigint").groupBy("kind", "lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    grams, letters = np.zeros((BUCKETS, len(languages))), np.zeros((len(SCRIPTS), len(languages)))
    for kind, to in ((0, grams), (1, letters)):
        part = counts[counts["kind"] == kind]
        to[part["bucket"], part["lang"]] = part["n"]
    scores = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    allowed = letters >= LEAST_SHARE * np.maximum(1, letters.sum(0))
    return Model(languages, scores, allowed)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score, spans array<struct<start, end, lang>>.

    score is the share of the letters that are labelled with lang_pred; letters of a script
    in which nothing was learned count as labelled with none, so that a text of only such
    letters has score 0. A text that is null or has no letter is "und" with score 0 and no spans. Span bounds are code points,
    the end exclusive, from a span's first word to its last. Ties go to the language that
    comes first in order of name. Null and repeated ids are carried as they are; other
    columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = texts_of(batch)
            labels: list[tuple[str, float]] = []
            spans: list[list[dict]] = []
            for a, b in slices(texts, 2_000_000):
                found = m.spans(texts[a:b]) if m.languages else [[] for _ in range(b - a)]
                labels += map(m.label, found)
                spans += [[{"start": s, "end": e, "lang": m.languages[k]} for s, e, k, *_ in x] for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in labels], pa.string()), pa.array([x for _, x in labels], pa.float64()), pa.array(spans, span)], ["id", "lang_pred", "score", "spans"]
            )

    out = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>")
    return out.withColumnRenamed("id", id_col)


def labelled(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """_doc (all columns of docs as they are), _lang, _score for each row, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [d if d is not None else "" for d in batch.column(0).field(text_col).to_pylist()]
            found: list[tuple[str, float]] = []
            for a, b in slices(texts, 2_000_000):
                found += map(m.label, m.spans(texts[a:b]) if m.languages else [[] for _ in range(b - a)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["_doc", "_lang", "_score"])

    schema = StructType([StructField("_doc", docs.schema), StructField("_lang", StringType()), StructField("_score", DoubleType())])
    return docs.select(F.struct("*").alias("_doc")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """One document in five, by its id: never learned from. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % 5 == 0
