"""Media columns of MPEG audio (MPEG-1 Layer III): writing, resynchronising, reading.

`wrap` puts bytes into a valid stream: an ID3v2 tag, a Xing frame with the counts of
frames and bytes and the seek table, then frames of variable bitrate whose main data are
silent and whose ancillary data carry 192 bytes each, with checksums. `read` takes any
stream: it skips tags, searches for frame headers and believes one only if the next
header stands where it says, parses the Xing or VBRI table, verifies the checksums of
Layers I and III (those of Layer II, whose extent its allocation tables decide, are
counted as unverified), and gives exact durations and the offset of every frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.batches import texts_of

UNIT = 192
#: Fixed values of the format: kbit/s and Hz by their index in the header.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
#: 48 kHz, mono, with checksum; 80 kbit/s makes frames of 240 bytes, 96 kbit/s of 288. The
#: larger frames carry what is not plain ASCII.
_HEADER, _LARGER = bytes([0xFF, 0xFA, 0x64, 0xC4]), bytes([0xFF, 0xFA, 0x74, 0xC4])
_SIDE = bytes(17)


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    checked: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int
    #: Subbands whose channels are allocated apart (Layer I; all 32 unless joint stereo).
    bound: int = 32

    @property
    def guarded(self) -> int:
        """Bytes after the checksum that it covers (Layer I: the bit allocation, 4 bits a subband and channel)."""
        if self.layer == 1:
            return 16 if self.mono else (self.bound + 32) // 2
        return self.side

    @property
    def side(self) -> int:
        """Bytes of side information (Layer III)."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


_known: dict[bytes, Header | None] = {}


def header(four: bytes) -> Header | None:
    """The frame header in these four bytes, if they are one (free format is not taken)."""
    if four in _known:
        return _known[four]
    found = _parse_header(four)
    if len(_known) < 65_536:
        _known[four] = found
    return found


def _parse_header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(four[1] >> 3 & 3)
    layer = 4 - (four[1] >> 1 & 3)
    bitrate, rate = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or bitrate in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    kbps = BITRATES[1 if version == 1 else 2, layer][bitrate]
    hz = RATES[rate] // {1: 1, 2: 2, 2.5: 4}[version]
    padding = four[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    size = (12 * kbps * 1000 // hz + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + padding
    bound = 4 * ((four[3] >> 4 & 3) + 1) if four[3] >> 6 == 1 else 32
    return Header(version, layer, not four[1] & 1, kbps, hz, four[3] >> 6 == 3, size, samples, bound)


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()
_checksums: dict[bytes, int] = {}


def checksum(data: bytes) -> int:
    """CRC-16 of the format, over the last two header bytes and what else it covers."""
    known = _checksums.get(data)
    if known is None:
        known = 0xFFFF
        for b in data:
            known = (known << 8 & 0xFFFF) ^ _CRC[known >> 8 ^ b]
        if len(_checksums) < 65_536:
            _checksums[data] = known
    return known


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def wrap(payload: bytes) -> bytes:
    """A stream that carries the payload; its length must be a positive multiple of 192."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload's length must be a positive multiple of 192")
    parts = [payload[i : i + UNIT] for i in range(0, len(payload), UNIT)]
    frames = [_SMALL[0] + p + _SMALL[1] if p.isascii() else _LARGE[0] + p + _LARGE[1] for p in parts]
    text = b"\x03" + str(len(payload)).encode()
    tag = b"TLEN" + _synchsafe(len(text)) + b"\0\0" + text
    tag = b"ID3\x04\0\0" + _synchsafe(len(tag)) + tag
    size = header(_HEADER).size
    ends = list(accumulate(map(len, frames), initial=size))  # ends[k]: where frame k begins, from the Xing frame on
    toc = bytes(min(255, ends[len(frames) * i // 100] * 256 // ends[-1]) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(frames), ends[-1]) + toc
    xing = _SMALL[0] + table
    return b"".join([tag, xing, bytes(size - len(xing)), *frames])


def _around(four: bytes) -> tuple[bytes, bytes]:
    """What stands before and after the carried bytes in a frame with this header."""
    lead = four + checksum(four[2:] + _SIDE).to_bytes(2, "big") + _SIDE
    return lead, bytes(header(four).size - len(lead) - UNIT)


_SMALL, _LARGE = _around(_HEADER), _around(_LARGER)


@dataclass
class Stream:
    frames: int = 0
    samples: int = 0
    rate: int = 0
    bad_checksums: int = 0
    #: Frames of Layer II that have a checksum, which is not verified.
    unverified: int = 0
    skipped: int = 0
    tags: list[str] = field(default_factory=list)
    #: Counts of frames and bytes by the variable-bitrate table, and its kind.
    table: tuple[str, int, int] | None = None
    #: The seek table: for Xing and Info the place of each percent of the duration in 256ths of
    #: the bytes, for VBRI the bytes of each run of seek_frames frames. Empty if absent or cut short.
    seek: list[int] = field(default_factory=list)
    seek_frames: int = 0
    #: Byte offset of each frame; frame k begins at sample k * samples a frame.
    offsets: list[int] = field(default_factory=list)
    ancillary: list[bytes] = field(default_factory=list)
    kbps: dict[int, int] = field(default_factory=dict)

    @property
    def seconds(self) -> tuple[int, int]:
        """The exact duration as a fraction."""
        return self.samples, self.rate or 1


def read(data: bytes, with_data: bool = True) -> Stream:
    """Parses a stream of any kind; bytes that belong to no frame and no tag are counted and skipped.

    A header is believed if the frame's end is the end of the data, a tag, or another
    header of the same version, layer and rate. The first frame is not counted if it
    holds a variable-bitrate table.
    """
    out, at, end = Stream(), 0, len(data)
    while at < end:
        h = header(data[at : at + 4])
        if h is None or not _goes_on(data, at + h.size, h):
            size = _tag(data, at, out)
            at += size or 1
            out.skipped += not size
            continue
        start, body = at, at + 4
        if h.checked:
            body += 2
            if h.layer != 2 and checksum(data[at + 2 : at + 4] + data[body : body + h.guarded]) != int.from_bytes(data[at + 4 : at + 6], "big"):
                out.bad_checksums += 1
            out.unverified += h.layer == 2
        body += h.side if h.layer == 3 else 0
        at += h.size
        if not out.frames and out.table is None and (table := _table(data, start, body)):
            out.table = table
            out.seek, out.seek_frames = _seek(data, start, body, at)
            continue
        out.frames += 1
        out.samples += h.samples
        out.rate = out.rate or h.rate
        out.kbps[h.kbps] = out.kbps.get(h.kbps, 0) + 1
        out.offsets.append(start)
        if with_data:
            out.ancillary.append(data[body:at])
    return out


def _goes_on(data: bytes, at: int, h: Header) -> bool:
    if at >= len(data):
        return at == len(data)
    n = header(data[at : at + 4])
    return n is not None and (n.version, n.layer, n.rate) == (h.version, h.layer, h.rate) or n is None and data[at : at + 3] in (b"TAG", b"ID3")


def _tag(data: bytes, at: int, out: Stream) -> int:
    if data[at : at + 3] == b"ID3" and len(data) - at >= 10 and all(b < 128 for b in data[at + 6 : at + 10]):
        size = 0
        for b in data[at + 6 : at + 10]:
            size = size << 7 | b
        size += 20 if data[at + 5] & 0x10 else 10
        if at + size <= len(data):
            out.tags.append(f"ID3v2.{data[at + 3]}")
            return size
    if data[at : at + 3] == b"TAG" and len(data) - at == 128:
        out.tags.append("ID3v1")
        return 128
    return 0


def _table(data: bytes, start: int, body: int) -> tuple[str, int, int] | None:
    kind = data[body : body + 4]
    if kind in (b"Xing", b"Info") and len(data) >= body + 16:
        flags, at, counts = int.from_bytes(data[body + 4 : body + 8], "big"), body + 8, []
        for bit in (1, 2):
            counts.append(int.from_bytes(data[at : at + 4], "big") if flags & bit else 0)
            at += 4 if flags & bit else 0
        return kind.decode(), counts[0], counts[1]
    if data[start + 36 : start + 40] == b"VBRI" and len(data) >= start + 54:
        return "VBRI", int.from_bytes(data[start + 50 : start + 54], "big"), int.from_bytes(data[start + 46 : start + 50], "big")
    return None


def _seek(data: bytes, start: int, body: int, end: int) -> tuple[list[int], int]:
    """The seek table of the frame from start to end, which holds a table, and the frames of an entry (VBRI)."""
    if data[body : body + 4] in (b"Xing", b"Info"):
        flags = int.from_bytes(data[body + 4 : body + 8], "big")
        at = body + 8 + 4 * (flags & 1) + 4 * (flags >> 1 & 1)
        return (list(data[at : at + 100]), 0) if flags & 4 and at + 100 <= end else ([], 0)
    entries, scale, size, frames = (int.from_bytes(data[start + k : start + k + 2], "big") for k in (54, 56, 58, 60))
    at = start + 62
    if not size or at + entries * size > end:
        return [], 0
    return [int.from_bytes(data[a : a + size], "big") * scale for a in range(at, at + entries * size, size)], frames


def payload_of(stream: Stream) -> bytes:
    """What `wrap` has stored."""
    return b"".join([a[:UNIT] for a in stream.ancillary])


def padded(data: bytes) -> bytes:
    return data + b" " * (UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text, padded with spaces, as a stream: id, n_bytes, media binary.

    One row per input row, without a shuffle. A null text is empty and becomes one frame
    of spaces; null or repeated ids are carried as they are; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [t.encode() for t in texts_of(batch)]
            media = [wrap(padded(d)) for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    out = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, n_bytes bigint, media binary")
    return out.withColumnRenamed("id", id_col)


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored streams hold: one row per row of `media` (a null stream counts as empty bytes).

    duration_samples / sample_rate is the exact duration; frame_offsets has the byte offset of
    every frame, in order. seek_table is the Xing or VBRI table's as in `Stream.seek`, with
    seek_frames frames an entry for VBRI (else 0). bad_checksums counts frames of Layers I and III;
    unverified_checksums are the frames of Layer II that have one.
    """
    kind = media.schema[id_col].dataType.simpleString()
    out_schema = (
        f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, "
        "feature string, duration_samples bigint, sample_rate bigint, bad_checksums bigint, skipped_bytes bigint, "
        "unverified_checksums bigint, frame_offsets array<bigint>, seek_table array<bigint>, seek_frames bigint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("media").to_pylist():
                data = data or b""
                s = read(data)
                payload = payload_of(s)
                feature = (
                    f"tags={'+'.join(s.tags) or '-'};table={':'.join(map(str, s.table)) if s.table else '-'};frames={s.frames};"
                    f"kbps={','.join(f'{k}x{n}' for k, n in sorted(s.kbps.items()))};duration={s.samples}/{s.rate};"
                    f"first={s.offsets[0] if s.offsets else -1};last={s.offsets[-1] if s.offsets else -1};"
                    f"offsets={zlib.crc32(struct.pack(f'<{len(s.offsets)}Q', *s.offsets))};bad={s.bad_checksums};skipped={s.skipped}"
                )
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, s.samples, s.rate, s.bad_checksums, s.skipped, s.unverified, s.offsets, s.seek, s.seek_frames))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *columns], names=[f.split()[0] for f in out_schema.split(", ")])

    return media.selectExpr(f"`{id_col}` AS id", "n_bytes", "media").mapInArrow(run, out_schema).withColumnRenamed("id", id_col)
