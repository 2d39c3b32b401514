"""Token-ID output in directly addressable codes.

A segment holds the ids of consecutive documents. Ids are split into chunks of 8 bits;
level 0 has the low chunk of every id, level 1 the next chunk of those that go on, and
so forth. A bitmap of each level tells which ids go on, and a directory has the number
of set bits before each block of 512, so that the place of any id in the next level is
one directory entry and a few popcounts away: any token is read without decoding others.

Layout of a segment (little-endian): magic, counts and sizes in a header of 64-bit
integers; the start of each document; then for each level its chunks, bitmap and
directory.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.batches import slices, texts_of
from millrace.workspace import new_path

MAGIC = int.from_bytes(b"DACSEG01", "little")
BLOCK = 512
#: Ids in a segment; a longer document has a segment of its own.
SEGMENT = 1 << 16
MOST_WORDS = 320_000
#: Ranges of ids; their borders, so many numbers at most, come to the driver.
MOST_BUCKETS = 100_000


def pack(ids: np.ndarray, doc_starts: np.ndarray) -> bytes:
    """A segment of these ids; doc_starts: where each document begins, then the number of ids."""
    values = ids.astype(np.uint32)
    levels = []
    while len(values) or not levels:
        more = values > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.pad(bitmap, (0, -len(bitmap) % (BLOCK // 8)))
        counts = np.bitwise_count(bitmap.reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint32)
        directory = np.concatenate([np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32)])
        levels.append(((values & 0xFF).astype(np.uint8), bitmap, directory))
        values = values[more] >> 8
    head = [MAGIC, len(ids), len(doc_starts), len(levels), *(len(part) for level in levels for part in level)]
    body = [part.astype(part.dtype.newbyteorder("<")).tobytes() for level in levels for part in level]
    return b"".join([np.array(head, "<i8").tobytes(), np.asarray(doc_starts, "<i8").tobytes(), *body])


class Segment:
    """Reads a segment in place."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data, "<i8", 4)
        if head[0] != MAGIC:
            raise ValueError("not a segment")
        self.n = int(head[1])
        sizes = np.frombuffer(data, "<i8", 3 * int(head[3]), 32)
        at = 32 + 24 * int(head[3])
        self.doc_starts = np.frombuffer(data, "<i8", int(head[2]), at)
        at += 8 * int(head[2])
        self.levels = []
        for chunk, bitmap, directory in sizes.reshape(-1, 3).tolist():
            parts = []
            for kind, count in (("u1", chunk), ("u1", bitmap), ("<u4", directory)):
                parts.append(np.frombuffer(data, kind, count, at))
                at += parts[-1].nbytes
            self.levels.append(tuple(parts))

    def token(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, directory in self.levels:
            value |= int(chunks[i]) << shift
            byte, bit = i >> 3, i & 7
            if not bitmap[byte] >> bit & 1:
                return value
            first = i // BLOCK * (BLOCK // 8)
            i = int(directory[i // BLOCK]) + int(np.bitwise_count(bitmap[first:byte]).sum()) + int(bitmap[byte] & (1 << bit) - 1).bit_count()
            shift += 8
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level from the last."""
        out = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            values = chunks.astype(np.uint32)
            if len(out):
                values[np.unpackbits(bitmap, count=len(chunks), bitorder="little").view(bool)] |= out << 8
            out = values
        return out


class WordEncoder(dict):
    """Encodes with the tokenizers library, each distinct word once; word -> its ids as bytes.

    The vocabulary drops white space and splits at it, so a text's ids are those of its
    words one after the other; it also folds case and splits letters from a comma or
    full stop after them. Characters on which Python and the library differ as to white
    space send the whole text through the library, and so does the string of an added token
    of the tokenizer's file, such as <|endoftext|>, which is an id of its own. Words are held in two generations, so
    that frequent words stay while memory is bounded.
    """

    ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
    #: A comma or full stop between a letter and white space is a piece of its own. The mark
    #: is sought first, and what stands before it is looked at then.
    MARK = re.compile(r"([.,])(?=\s|\Z)(?<=[a-z\xdf-\xf6\xf8-\xff].)")

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        #: Strings that the library finds in a text before it splits words; whatever the case and place.
        added = sorted({t.content.lower() for t in self.library.get_added_tokens_decoder().values()} - {""})
        self.added = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        self.kind = kind
        self.older: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab(True)
        #: Whether an id ends a word.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def learn(self, cores: list[str]) -> None:
        """Encodes words of letters many at a time; the last token of a word is known by its mark."""
        if not cores:
            return
        lines = [" ".join(cores[i : i + 50]) for i in range(0, len(cores), 50)]
        ids = [i for e in self.library.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids]
        ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
        if len(ends) != len(cores):  # some word does not end with one marked token
            self.update((w, self.whole(w)) for w in cores)
            return
        data, size = np.array(ids, self.kind).tobytes(), np.dtype(self.kind).itemsize
        self.update(zip(cores, [data[a * size : b * size] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))

    def words(self, text: str) -> list[str] | None:
        """Pieces that are encoded one by one; None for a text that must be encoded whole."""
        if any(c in text for c in self.ODD) or self.added is not None and self.added.search(text):
            return None
        if not text.isascii():
            try:
                text.encode("latin-1")  # up to there, case is folded alike and no marks are composed
            except UnicodeEncodeError:
                return text.split()
        return self.MARK.sub(r" \1", text.lower()).split()

    def add(self, words: set[str]) -> None:
        """Brings in words that this generation lacks."""
        new = set()
        for w in words:
            ids = self.older.get(w)
            if ids is None:
                new.add(w)
            else:
                self[w] = ids
        letters = [w for w in new if w.isalpha() and max(w) <= "\xff"]
        self.learn(letters)
        for w in new.difference(letters):
            self[w] = self.whole(w)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > MOST_WORDS:
            self.older = dict(self)
            self.clear()
        split = [self.words(t) for t in texts]
        found = [None if words is None else list(map(self.get, words)) for words in split]
        gaps = [[] if ids is None else _places(ids, None) for ids in found]
        self.add({words[i] for words, places in zip(split, gaps, strict=True) for i in places})
        for words, ids, places in zip(split, found, gaps, strict=True):
            for i in places:
                ids[i] = self[words[i]]
        return [self.whole(t) if ids is None else b"".join(ids) for t, ids in zip(texts, found, strict=True)]


def _places(items: list, wanted) -> list[int]:
    out, at = [], -1
    try:
        while True:
            at = items.index(wanted, at + 1)
            out.append(at)
    except ValueError:
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str, kind: str) -> WordEncoder:
    return WordEncoder(path, kind)


def width(path: str, end_id: int) -> str:
    """The unsigned integer in which all ids fit, for the shuffle."""
    return "<u2" if max(end_id, *word_encoder(path, "<u4").library.get_vocab(True).values()) < 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, tokenizer: str, out: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", docs_a_bucket: int = 5_000) -> DataFrame:
    """Encodes every whole text, ends each with end_id, and writes segments in ascending order of ids under `out`.

    The files are Parquet with one segment a row: bucket, segment, doc_ids, n_tokens,
    data. Order: buckets, then segments, then documents in a segment. Buckets are
    ranges of ids with about docs_a_bucket documents, from quantiles of the id column alone
    (with more than MOST_BUCKETS times as many documents the ranges grow; a range is sorted by
    Spark, which spills, and only one segment is held at a time); rows of one id stay together. A null or empty text is the end id alone; rows with a
    null id come first; rows with equal ids are ordered by their encoded ids; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = width(tokenizer, end_id)
    size_of = np.dtype(kind).itemsize
    ids = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"))
    rows = ids.count()
    n = max(1, min(MOST_BUCKETS, rows // docs_a_bucket))
    borders = sorted({b for (b,) in ids.select(F.explode(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], max(10_000, 4 * n)))).collect()}) if rows else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer, kind).encode
        end = np.array([end_id], kind).tobytes()
        wide = np.array(borders, np.int64)
        for batch in batches:
            keys = batch.column(0)
            bucket = np.searchsorted(wide, keys.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="left")
            bucket = np.where(keys.is_null().to_numpy(zero_copy_only=False), 0, bucket)
            texts = texts_of(batch)
            for a, b in slices(texts, 2_000_000):
                coded = [c + end for c in encode(texts[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[a:b].astype(np.int32)), keys.slice(a, b - a), pa.array(coded, pa.binary())], ["bucket", "id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number, last = [], 0, 0, None

        def segment() -> pa.RecordBatch:
            lengths = np.array([len(x) // size_of for _, x in held], np.int64)
            starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
            data = pack(np.frombuffer(b"".join(x for _, x in held), kind), starts)
            return pa.RecordBatch.from_arrays(
                [pa.array([last], pa.int32()), pa.array([number], pa.int32()), pa.array([[i for i, _ in held]], pa.list_(pa.int64())), pa.array([int(starts[-1])], pa.int64()), pa.array([data], pa.binary())],
                ["bucket", "segment", "doc_ids", "n_tokens", "data"],
            )

        for batch in batches:
            for bucket, key, coded in zip(*(batch.column(c).to_pylist() for c in ("bucket", "id", "ids")), strict=True):
                if held and (bucket != last or size + len(coded) > size_of * SEGMENT):
                    yield segment()
                    held, size, number = [], 0, number + 1 if bucket == last else 0
                last = bucket
                held.append((key, coded))
                size += len(coded)
        if held:
            yield segment()

    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    coded = source.mapInArrow(run, "bucket int, id bigint, ids binary")
    files = coded.repartition(F.col("bucket")).sortWithinPartitions("bucket", F.col("id").asc_nulls_first(), "ids")
    files.mapInArrow(write, "bucket int, segment int, doc_ids array<bigint>, n_tokens bigint, data binary").write.mode("error").parquet(out)
    return spark.read.schema("bucket int, segment int, doc_ids array<bigint>, n_tokens bigint, data binary").parquet(out)


def segment_starts(files: DataFrame) -> DataFrame:
    """bucket, segment, start: the number of ids in all segments before. Two levels of running sums:
    segments inside their bucket, and buckets (10,000 at most) among themselves."""
    sizes = files.select("bucket", "segment", "n_tokens")
    buckets = sizes.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    buckets = buckets.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("bucket").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select("bucket", "segment", inside.alias("inside")).join(buckets, "bucket").select("bucket", "segment", (F.col("before") + F.col("inside")).alias("start"))


def read_tokens(files: DataFrame) -> DataFrame:
    """From the written segments, one row per document: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, segment, ids, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "segment", "doc_ids", "data")), strict=True):
                read = Segment(data)
                raw = memoryview(read.all().astype("<u4").tobytes())
                starts = read.doc_starts
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket] * len(ids), pa.int32()), pa.array([segment] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(sums, pa.int64())],
                    ["bucket", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    docs = files.select("bucket", "segment", "doc_ids", "data").mapInArrow(run, "bucket int, segment int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(segment_starts(files), ["bucket", "segment"]).select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_folder(docs: DataFrame) -> str:
    return new_path(docs.sparkSession, "tokens")

