"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Encoding. The transducer reads the bytes of one pattern match and emits token ids as
soon as no later byte can change them. Its states are made when first reached: a state
is what is still pending, that is the bytes since the last settled token border and, for
each of their prefixes, the last token of that prefix's encoding. BPE has the property
that a prefix which ends at a token border is encoded as in the whole; so a border is
settled once it lies on the chain of last tokens of every prefix from which some
vocabulary entry can still reach over the present end. Such entries have a bounded
length, which bounds the lookahead.

Decoding. An incremental UTF-8 state machine, one step an id, cuts the byte stream at
whole characters, so that a stream can be decoded id by id.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from millrace.llm.batches import texts_of

#: Distinct pieces of a generation, and transducer states, that a worker holds before it drops them.
MOST_PIECES = 300_000
MOST_STATES = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class _State:
    __slots__ = ("pending", "last", "borders", "live", "next")

    def __init__(self, pending: bytes, last: bytes, borders: tuple[int, ...], live: bytes):
        self.pending = pending
        #: For each prefix of pending that is not empty: the length of the last token of its encoding.
        self.last = last
        #: For each prefix, the empty one first: the borders of its encoding, as bits.
        self.borders = borders
        #: Where a token can begin that reaches over the end of pending.
        self.live = live
        #: byte -> (state, ids emitted)
        self.next: dict[int, tuple[_State, tuple[int, ...]]] = {}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.restart()

    def restart(self) -> None:
        self.states: dict[bytes, _State] = {}
        self.start = _State(b"", b"", (1,), b"\0")

    def merged(self, piece: bytes) -> list[bytes]:
        """The merges in the order of their ranks; asked only of single tokens and of pairs of tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get, none = self.ranks.get, len(self.ranks)
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (rank := min(pairs)) < none:
            at = pairs.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], none)
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], none)
        return parts

    def _fits(self, before: bytes, token: bytes) -> bool:
        """Whether the two stay side by side when their bytes are encoded together."""
        known = self.fits.get((before, token))
        if known is None:
            if len(self.fits) > MOST_STATES:
                self.fits.clear()
            known = self.fits[before, token] = self.merged(before + token) == ([before, token] if before else [token])
        return known

    def _step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        pending = state.pending + bytes((byte,))
        for begin in state.live:  # the longest token first; just one of them fits
            token = pending[begin:]
            if token in self.ranks and self._fits(pending[begin - state.last[begin - 1] : begin] if begin else b"", token):
                break
        n = len(pending)
        last = state.last + bytes((n - begin,))
        borders = (*state.borders, state.borders[begin] | 1 << n)
        live = bytes([i for i in state.live if pending[i:] in self.prefixes] + [n])
        common = borders[-1]
        for i in live:
            common &= borders[i]
        settled = common.bit_length() - 1
        out: tuple[int, ...] = ()
        if settled:
            out = self._ids(pending, last, settled)
            pending, last = pending[settled:], last[settled:]
            borders, live = tuple([b >> settled for b in borders[settled:]]), bytes([i - settled for i in live])
        if (known := self.states.get(pending)) is None:
            known = self.states[pending] = _State(pending, last, borders, live) if pending else self.start
        state.next[byte] = (known, out)
        return known, out

    def _ids(self, pending: bytes, last: bytes, end: int) -> tuple[int, ...]:
        out = []
        while end:
            begin = end - last[end - 1]
            out.append(self.ranks[pending[begin:end]])
            end = begin
        return tuple(reversed(out))

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pattern match."""
        if len(self.states) > MOST_STATES:
            self.restart()
        state, ids = self.start, []
        for b in piece:
            step = state.next.get(b)
            state, out = step if step is not None else self._step(state, b)
            if out:
                ids += out
        ids += self._ids(state.pending, state.last, len(state.pending))
        return ids


class Encoder(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers, in two generations."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.transducer = Transducer(ranks)
        self.find = regex.compile(pattern).findall
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) > MOST_PIECES:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", self.transducer.encode(piece.encode())).tobytes()
        self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))


def _utf8_table() -> list[list[int]]:
    """table[state][byte]: state 0 is between characters, 1 to 3 wait for so many plain
    continuation bytes, 4 to 7 for a first continuation byte of a narrower range, 8 is an error."""
    narrow = {0xE0: (4, 0xA0, 0xBF), 0xED: (5, 0x80, 0x9F), 0xF0: (6, 0x90, 0xBF), 0xF4: (7, 0x80, 0x8F)}
    after = {1: 0, 2: 1, 3: 2, 4: 1, 5: 1, 6: 2, 7: 2}
    table = [[8] * 256 for _ in range(9)]
    for b in range(256):
        if b < 0x80:
            table[0][b] = 0
        elif b in narrow:
            table[0][b] = narrow[b][0]
        elif 0xC2 <= b < 0xF5:
            table[0][b] = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
    for state in range(1, 4):
        for b in range(0x80, 0xC0):
            table[state][b] = after[state]
    for state, low, high in narrow.values():
        for b in range(low, high + 1):
            table[state][b] = after[state]
    return table


UTF8 = _utf8_table()


class Decoder:
    """Ids to bytes, whole characters at a time: the UTF-8 machine, one step a token.

    The step of a token is compiled from those of its bytes, for each state in which it can
    begin: the state after it, and how many of its bytes belong to characters that are
    complete. Bytes that are no UTF-8 count as complete as soon as they are known to be bad.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.after = [bytearray(len(self.tokens)) for _ in range(8)]
        self.complete = [array("H", bytes(2 * len(self.tokens))) for _ in range(8)]
        for start in range(8):
            for i, token in enumerate(self.tokens):
                self.after[start][i], self.complete[start][i] = self._step(start, token)

    @staticmethod
    def _step(state: int, token: bytes) -> tuple[int, int]:
        done = 0
        for k, b in enumerate(token):
            state = UTF8[state][b]
            if state == 8:  # the bad bytes end before b, which may begin a character
                done = k
                state = UTF8[0][b] % 8
            if not state:
                done = k + 1
        return state, done

    def pieces(self, ids: Iterable[int]) -> Iterator[bytes]:
        """The bytes in pieces that end at the end of a character; what is incomplete is held back, and comes last."""
        tokens, after, complete = self.tokens, self.after, self.complete
        state, held = 0, b""
        for i in ids:
            token, next_ = tokens[i], after[state][i]
            if not state and not next_:
                yield token
                continue
            done = complete[state][i]
            if done:
                yield held + token[:done]
                held = token[done:]
            else:
                held += token
            state = next_
        if held:
            yield held

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.pieces(np.frombuffer(ids, "<u4").tolist()))

    def text(self, ids: Iterable[int]) -> Iterator[str]:
        """Pieces of text, each of whole characters; bytes that are no UTF-8 become U+FFFD."""
        for piece in self.pieces(ids):
            yield piece.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    ranks = read_ranks(path)
    return Encoder(ranks, pattern), Decoder(ranks)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text, in one pass without a shuffle: id, ids binary (little-endian unsigned 32-bit).

    path: a rank file that every executor can open. One row per input row; a null text is
    empty and has no ids; null or repeated ids are carried as they are; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = coder(path, pattern)[0].encode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(t) for t in texts_of(batch)], pa.binary())], ["id", "ids"])

    out = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, ids binary")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """The inverse of encode: id, ids, bytes binary. A null `ids` is empty."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = coder(path, pattern)[1].decode
        for batch in batches:
            ids = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([back(x) for x in ids], pa.binary())], ["id", "ids", "bytes"])

    out = encoded.selectExpr(f"`{id_col}` AS id", "ids").mapInArrow(run, f"id {kind}, ids binary, bytes binary")
    return out.withColumnRenamed("id", id_col)


def token_arrays(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """As encode and decode together: id, the columns in keep, n_tokens, ids array<int>, decoded_sha256."""
    kept = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coder(path, pattern)
        for batch in batches:
            coded = [encoder.encode(t) for t in texts_of(batch, "_text")]
            digests = [hashlib.sha256(decoder.decode(c)).hexdigest() for c in coded]
            counts = np.array([len(c) // 4 for c in coded], np.int64)
            offsets = pa.array(np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts), ids, pa.array(digests, pa.string())], schema.names)

    made = [StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("decoded_sha256", StringType())]
    schema = StructType([docs.schema[id_col], *kept, *made])
    return docs.select(F.col(f"`{id_col}`"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, schema)
