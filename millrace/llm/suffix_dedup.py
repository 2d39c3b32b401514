"""Suffix-array dedup: bytes covered by a string of `length` bytes that starts anywhere else too.

1. Suffixes that cannot have a partner are discarded: a string of `length` bytes reaches
   an anchor chosen by its content alone, and around that anchor it holds a core of bytes;
   where a core stands nowhere else, no string with it does. Places whose whole
   surroundings are the same are one class, of which one member goes on for all. What goes
   on is split by the distance from the anchor: the strings at STEP distances hold a core
   that lacks STEP - 1 bytes of `length` only, and by these the same is done again.
2. What is left, strips of texts, is parsed into phrases that overlap by a trigger and of
   which none is a prefix of another, so that the order of phrases gives the order of
   suffixes. The phrases are sorted and numbered by their bytes.
3. `suffix_ranks` sorts the suffixes of the phrase sequences by a difference cover modulo
   3: the triples at places 1 and 2 modulo 3 are sorted and named, the names are sorted by
   recursion, and the suffixes at places 0 modulo 3 are merged with the others.
4. The remaining suffixes, those inside phrases, are merged by the rest of their phrase and
   the rank of the next one. Neighbours in the order of all suffixes compare the first
   `length` bytes of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from millrace.llm.anchors import Prints, combine, minimizers, window
from millrace.operators.sharding import running_sums
from millrace.workspace import stored

#: Bytes that are fingerprinted at once: what is made of them fits a core's cache.
SLICE = 100_000
#: Rows in a batch that is made of many strips.
TOGETHER = 20_000
#: Distances from an anchor that are told apart as one, after the first discard.
STEP = 16
#: A phrase begins where a fingerprint of 8 bytes is smaller than those at the next 31 places. So
#: 39 bytes, the trigger, decide it, few phrases begin close together, and none where a text repeats itself at once.
SHORT, AHEAD = 8, 31
TRIGGER = SHORT + AHEAD


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes of the texts one after the other, their bounds)."""
    column = batch.column("text").cast(pa.binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + SLICE, side="right")) - 1)
        yield start, end, data[bounds[start] : bounds[end]], bounds[start : end + 1] - bounds[start]
        start = end


def _together(parts: Iterable[tuple], rows: Callable[[list], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch for each TOGETHER rows or so of many small parts; the first of a part's columns tells how many it has."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= TOGETHER:
            yield rows(held)
            held, n = [], 0
    if held:
        yield rows(held)


def _prints(prints: Prints, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the core that the strings from lo..hi on share, and of all that they cover."""
    return prints.of(a, a + length - window(length) + 1).view(np.int64), combine(prints.of(lo, hi + length), (a - lo).astype(np.uint64)).view(np.int64)


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """key, a, lo, hi, core, u: the sampled positions of each text, with the starts lo..hi that reach
    them, and prints of what these share (core) and cover (u)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for start, end, data, bounds in _parts(batch):
                prints = Prints(data)
                a, lo, hi = minimizers(prints, bounds, length)
                owner = np.searchsorted(bounds, lo, side="right") - 1
                base = bounds[owner]
                core, u = _prints(prints, a, lo, hi, length)
                for x in range(0, len(a), 50_000):
                    s = slice(x, x + 50_000)
                    columns = [keys[start:end][owner[s]], *((v[s] - base[s]).astype(np.int32) for v in (a, lo, hi)), core[s], u[s]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "a", "lo", "hi", "core", "u"])

    return docs.mapInArrow(run, "key bigint, a int, lo int, hi int, core bigint, u bigint")


def _cores(docs: DataFrame, length: int) -> DataFrame:
    """core: of all sampled positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in _parts(batch):
                prints = Prints(data)
                a = minimizers(prints, bounds, length)[0]
                core = prints.of(a, a + length - window(length) + 1).view(np.int64)
                for x in range(0, len(a), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(core[x : x + 50_000])], ["core"])

    return docs.mapInArrow(run, "core bigint")


def _steps(texts: DataFrame, length: int) -> DataFrame:
    """t, l, h, sure, ext, v: the entries of each text by STEP distances from their anchors, with prints
    of what the strings from l..h on share (ext) and cover (v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = batch.column("entries")
            sizes = entries.value_lengths().to_numpy()
            first = np.append(0, np.cumsum(sizes))
            flat = entries.flatten()
            a, lo, hi, sure = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("a", "lo", "hi", "sure"))
            t = np.repeat(batch.column("t").to_numpy(), sizes)
            for start, end, data, bounds in _parts(batch):
                s = slice(first[start], first[end])
                if s.start == s.stop:
                    continue
                prints = Prints(data)
                base = np.repeat(bounds[:-1], sizes[start:end])
                at, begin, last = a[s] + base, lo[s] + base, hi[s] + base
                low, high = (at - last) // STEP, (at - begin) // STEP
                n = high - low + 1
                e = np.repeat(np.arange(len(at)), n)
                k = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n) + low[e]
                near, far = at[e] - k * STEP, at[e] - (k * STEP + STEP - 1)
                x, y = np.maximum(begin[e], far), np.minimum(last[e], near)
                ext = combine(prints.of(near, far + length), k.astype(np.uint64)).view(np.int64)
                v = combine(prints.of(x, y + length), (at[e] - x).astype(np.uint64)).view(np.int64)
                columns = [t[s][e], (x - base[e]).astype(np.int32), (y - base[e]).astype(np.int32), sure[s][e], ext, v]
                for z in range(0, len(e), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[z : z + 50_000]) for c in columns], ["t", "l", "h", "sure", "ext", "v"])

    return texts.mapInArrow(run, "t bigint, l int, h int, sure boolean, ext bigint, v bigint")


def suffix_ranks(symbols: DataFrame, depth: int) -> DataFrame:
    """s, i, rank: how many suffixes of all sequences are smaller than the one of sequence s from place i on.

    symbols: s, i (from 0, without gaps), sym (positive). The order is that of the first
    `depth` symbols at least, in which the end of a sequence is smaller than any symbol;
    suffixes that agree in these may have the same rank.
    """
    if depth <= 1:
        sizes = symbols.groupBy("sym").agg(F.count(F.lit(1)).alias("n"))
        return symbols.join(running_sums(sizes, ["sym"], {"rank": "n"}).select("sym", "rank"), "sym").select("s", "i", "rank")
    ahead = Window.partitionBy("s").orderBy("i")
    after = lambda c, k: F.coalesce(F.lead(c, k).over(ahead), F.lit(0).cast("bigint"))
    triples = stored(symbols.select("s", "i", F.col("sym").alias("t0"), after("sym", 1).alias("t1"), after("sym", 2).alias("t2")), "suffix-triples")
    keys, place = ["t0", "t1", "t2"], F.col("i") % 3
    sampled = triples.where(place != 0)
    names = running_sums(sampled.select(keys).distinct(), keys, {"name": None})
    reduced = sampled.join(names, keys).select((F.col("s") * 2 + place - 1).alias("s"), F.floor(F.col("i") / 3).cast("int").alias("i"), (F.col("name") + 1).alias("sym"))
    ranks = suffix_ranks(reduced, -(-depth // 3))
    ranks = ranks.select(F.shiftright("s", 1).alias("s"), (F.col("i") * 3 + 1 + F.col("s") % 2).cast("int").alias("i"), "rank")
    both = triples.join(ranks, ["s", "i"], "left").withColumn("up", F.col("rank") + 1)
    known = stored(both.select("s", "i", "t0", "t1", "rank", after("up", 1).alias("r1"), after("up", 2).alias("r2")), "suffix-known")
    # A suffix at place 0 compares with one at place 1 by a symbol and the rank after it, with one at place 2 by two symbols and the rank after them.
    sums = lambda k: [F.count_if(place == m).cast("bigint").alias(f"n{m}") for m in (0, k)]
    one = running_sums(known.where(place != 2).groupBy("t0", "r1").agg(*sums(1)), ["t0", "r1"], {"a0": "n0", "a1": "n1"}).drop("n0", "n1")
    two = running_sums(known.where(place != 1).groupBy("t0", "t1", "r2").agg(*sums(2)), ["t0", "t1", "r2"], {"b0": "n0", "b2": "n2"}).drop("n0", "n2")
    zero = known.where(place == 0).join(one, ["t0", "r1"]).join(two, ["t0", "t1", "r2"]).select("s", "i", (F.col("a0") + F.col("a1") + F.col("b2")).alias("rank"))
    first = known.where(place == 1).join(one, ["t0", "r1"]).select("s", "i", (F.col("rank") + F.col("a0")).alias("rank"))
    second = known.where(place == 2).join(two, ["t0", "t1", "r2"]).select("s", "i", (F.col("rank") + F.col("b0")).alias("rank"))
    return zero.unionByName(first).unionByName(second)


def phrase_starts(data: np.ndarray) -> np.ndarray:
    """Where the phrases of a strip begin: at its begin, and at every trigger."""
    n = len(data) - TRIGGER + 1
    if n <= 0:
        return np.zeros(1, np.int64)
    at = np.arange(n + AHEAD)
    own = Prints(data).of(at, at + SHORT)
    least, size = own[1:], 1
    while size < AHEAD:  # the least of the places after each one, of as many as `size`
        step = min(size, AHEAD - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    found = np.flatnonzero(own[:n] < least[:n])
    return np.concatenate([[0], found[found > 0]]).astype(np.int64)


def phrases(data: bytes, starts: np.ndarray) -> list[bytes]:
    """Each phrase with the trigger that ends it."""
    ends = np.append(starts[1:] + TRIGGER, len(data)).tolist()
    return [data[b:e] for b, e in zip(starts.tolist(), ends, strict=True)]


def repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The input as (key, key2, id, text) and, for the texts that lose bytes, (key, key2, n_removed, spans, kept).

    spans are [start, end) in bytes, kept is what is left; `deduplicated` puts both together.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in
    this text or another; matches do not cross texts, overlaps count, and all is judged on
    the input. Texts shorter than `length` (null and empty ones too) stay as they are.
    Rows with the same id and text are each other's copies. Null ids are carried as they are.
    Other columns are ignored. An empty table gives no rows. length must be 256 at least.
    """
    if length < 256:
        raise ValueError("length must be 256 at least")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    source = source.select(F.xxhash64("id", "text").alias("key"), F.xxhash64(F.lit(length), "text", "id").alias("key2"), "id", "text")
    keyed = source.where(F.octet_length("text") >= length).select("key", "key2", F.col("text").cast("binary").alias("text"))
    again = stored(_cores(keyed.select("text"), length).groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"), "suffix-again")
    kept = stored(_anchors(keyed.select("key", "text"), length).join(again, "core"), "suffix-sampled")
    one = F.struct("key", "a")
    classes = stored(kept.groupBy("core", "u").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("one")), "suffix-classes")
    # Written, so that the classes of a frequent core meet its row in a plain join, which Spark splits.
    several = stored(classes.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core", F.lit(True).alias("several")), "suffix-several")
    placed = kept.join(classes.join(several, "core", "left"), ["core", "u"])
    # Copies of a row (same id and text) have one key: they agree in all, and are two members of a class.
    on = F.col("several").isNotNull() & (F.col("one.key") == F.col("key")) & (F.col("one.a") == F.col("a"))
    placed = placed.select("key", "a", "lo", "hi", "core", "u", (F.col("n") > 1).alias("sure"), on.alias("on")).where("sure OR on")
    # Keys that two different rows have: of 64 bits, so next to none.
    shared = keyed.groupBy("key").agg((F.min("key2") != F.max("key2")).alias("shared")).where("shared")
    placed = placed.join(F.broadcast(shared), "key", "left")
    placed = placed.withColumn("prints", F.when(F.col("shared"), F.struct("core", "u")))
    placed = placed.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("lo", "hi", "a", "sure", "on", "prints"))).alias("sampled"))  # bounded by the text
    texts = keyed.join(placed, "key").dropDuplicates(["key", "key2"])  # by the key in both steps: one shuffle

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is sure of each text, and the entries that go on."""
        entry = pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("a", pa.int32()), ("sure", pa.bool_())])
        for batch in batches:
            sampled = batch.column("sampled")
            first = np.append(0, np.cumsum(sampled.value_lengths().to_numpy()))
            flat = sampled.flatten()
            lo, hi, a, sure, on = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "a", "sure", "on"))
            checked = flat.field("prints").is_valid().to_numpy(zero_copy_only=False)
            holds = np.ones(len(flat), bool)
            for i in np.flatnonzero(np.add.reduceat(checked, first[:-1])) if len(batch) else ():
                s = slice(first[i], first[i + 1])
                holds[s] = _own(batch.column("text")[i].as_py(), flat[s].to_pylist(), length)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
            spans = []
            for i in range(batch.num_rows):
                s = slice(first[i], first[i + 1])
                known = sure[s] & holds[s]
                spans.append([x for span in merged(list(zip(lo[s][known].tolist(), (hi[s][known] + length).tolist(), strict=True))) for x in span])
            go = on & holds
            offsets = np.append(0, np.cumsum(np.bincount(owner[go], minlength=batch.num_rows))).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array(v[go]) for v in (lo, hi, a, sure)], fields=list(entry))
            unsure = np.bincount(owner[go & ~sure], minlength=batch.num_rows) > 0
            columns = [*(batch.column(c) for c in ("key", "key2", "text")), pa.array(spans, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(offsets), entries), pa.array(unsure)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "key2", "text", "spans", "entries", "unsure"])

    kind = "key bigint, key2 bigint, text binary, spans array<int>, entries array<struct<lo:int,hi:int,a:int,sure:boolean>>, unsure boolean"
    texts = texts.select("key", "key2", "text", "sampled").mapInArrow(decided, kind)
    texts = stored(texts.where("size(entries) > 0 OR size(spans) > 0").withColumn("t", F.monotonically_increasing_id()), "suffix-texts")
    # Every class stands here once, so that strings which agree in all of a step are two places.
    steps = _steps(texts.where("size(entries) > 0").select("t", "text", "entries"), length)
    shares = steps.groupBy("ext").agg(F.count(F.lit(1)).alias("n"), (F.min("v") != F.max("v")).alias("mixed")).where("n > 1").select("ext", "mixed")
    repeated = stored(steps.join(shares, "ext").where("mixed OR NOT sure"), "suffix-steps")
    place = F.struct("t", "l", "h")
    mixed = repeated.where("mixed")
    agreeing = stored(mixed.groupBy("ext", "v").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one")), "suffix-agreeing")
    known = repeated.where("NOT mixed").select("t", "l", "h").unionByName(mixed.where("NOT sure").join(agreeing.where("n > 1").select("ext", "v"), ["ext", "v"]).select("t", "l", "h"))
    chosen = agreeing.groupBy("one.t").agg(F.sort_array(F.collect_set(F.struct("one.l", "one.h"))).alias("chosen"))  # bounded by the text

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of a text in which strings stand that go on; most: phrases begun in `length` bytes."""
        for batch in batches:
            rows = []
            for t, data, chosen in zip(*(batch.column(c).to_pylist() for c in ("t", "text", "chosen")), strict=True):
                for b, e in merged([(x["l"], x["h"] + length) for x in chosen]):
                    begin = phrase_starts(np.frombuffer(data, np.uint8, e - b, b))
                    most = int((np.searchsorted(begin, begin + length) - np.arange(len(begin))).max()) + 1
                    rows.append((t, b, data[b:e], most, begin.tolist(), [{"lo": x["l"] - b, "hi": x["h"] - b} for x in chosen if b <= x["l"] < e]))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], ["t", "at", "data", "most", "begin", "classes"])

    strips = texts.where("size(entries) > 0").select("t", "text").join(chosen, "t").mapInArrow(strip, "t bigint, at int, data binary, most int, begin array<int>, classes array<struct<lo:int,hi:int>>")
    strips = stored(strips.withColumn("s", F.monotonically_increasing_id()), "suffix-strips")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list) -> pa.RecordBatch:
            s, i, found = ([x for h in held for x in h[k]] for k in range(3))
            return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(i, pa.int32()), pa.array(found, pa.binary())], ["s", "i", "phrase"])

        def parts(batch: pa.RecordBatch) -> Iterator[tuple]:
            for s, data, begin in zip(*(batch.column(c).to_pylist() for c in ("s", "data", "begin")), strict=True):
                found = phrases(data, np.array(begin, np.int64))
                yield [s] * len(found), range(len(found)), found

        for batch in batches:
            yield from _together(parts(batch), rows)

    parsed = strips.select("s", "data", "begin").mapInArrow(parse, "s bigint, i int, phrase binary")
    depth = strips.agg(F.max("most")).first()[0] or 1
    numbers = running_sums(parsed.select("phrase").distinct(), ["phrase"], {"name": None})
    symbols = stored(parsed.join(numbers, "phrase").select("s", "i", (F.col("name") + 1).alias("sym")), "suffix-symbols")
    ranks = suffix_ranks(symbols, depth).groupBy("s").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "rank"))), lambda x: x["rank"]).alias("ranks"))
    ranked = stored(strips.join(ranks, "s"), "suffix-ranked")

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each place at which a string of a class begins: what is left of its phrase (of `length` bytes), and the rank after it (0: none)."""
        def rows(held: list) -> pa.RecordBatch:
            rest = [x for h in held for x in h[0]]
            rank, s, p = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            return pa.RecordBatch.from_arrays([pa.array(rest, pa.binary()), pa.array(rank), pa.array(s), pa.array(p)], ["rest", "rank", "s", "p"])

        def parts(batch: pa.RecordBatch) -> Iterator[tuple]:
            for s, data, begin, classes, ranks in zip(*(batch.column(c).to_pylist() for c in ("s", "data", "begin", "classes", "ranks")), strict=True):
                begin = np.array(begin, np.int64)
                end = np.append(begin[1:] + TRIGGER, len(data))
                after = np.append(np.array(ranks[1:], np.int64) + 1, 0)
                p = np.concatenate([np.arange(c["lo"], c["hi"] + 1) for c in classes])
                k = np.searchsorted(begin, p, side="right") - 1
                for x in range(0, len(p), TOGETHER):
                    q, kq = p[x : x + TOGETHER], k[x : x + TOGETHER]
                    whole = end[kq] <= q + length
                    rest = [data[b:e] for b, e in zip(q.tolist(), np.minimum(end[kq], q + length).tolist(), strict=True)]
                    yield rest, np.where(whole, after[kq], 0), np.full(len(q), s), q.astype(np.int32)

        for batch in batches:
            yield from _together(parts(batch), rows)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of neighbours that agree in the rest of their phrase.

        The first and the last row of a partition, too, with its number, as pairs of one.
        """
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None

        def rows(pairs: list, edge: int | None = None) -> pa.RecordBatch:
            columns = list(zip(*pairs, strict=True)) if pairs else [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array([edge] * len(pairs), pa.int64())], ["s", "p", "s2", "p2", "edge"])

        for batch in batches:
            pairs = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("rest", "s", "p")), strict=True):
                if last is None:
                    yield rows([(row[1], row[2], row[1], row[2])], 2 * part)
                elif row[0] == last[0]:
                    pairs.append((last[1], last[2], row[1], row[2]))
                last = row
            yield rows(pairs)
        if last is not None:
            yield rows([(last[1], last[2], last[1], last[2])], 2 * part + 1)

    order = ["rest", "rank"]
    sorted_ = ranked.select("s", "data", "begin", "classes", "ranks").mapInArrow(starts, "rest binary, rank bigint, s bigint, p int").repartitionByRange(*order).sortWithinPartitions(*order)
    beside = stored(sorted_.mapInArrow(neighbours, "s bigint, p int, s2 bigint, p2 int, edge bigint"), "suffix-pairs")
    edges = beside.where("edge IS NOT NULL").withColumn("before", F.lag(F.struct("edge", "s", "p")).over(Window.orderBy("edge")))  # two rows a partition
    across = edges.where("edge % 2 = 0 AND before IS NOT NULL").select(F.col("before.s").alias("s"), F.col("before.p").alias("p"), F.col("s").alias("s2"), F.col("p").alias("p2"))
    pairs = beside.where("edge IS NULL").drop("edge").unionByName(across)
    pairs = pairs.groupBy("s", "s2", (F.col("p2") - F.col("p")).alias("shift")).agg(F.sort_array(F.collect_set("p")).alias("ps"))  # bounded by the strip
    pairs = stored(pairs.withColumn("g", F.monotonically_increasing_id()), "suffix-compared")
    low, high = F.col("ps")[0], F.array_max("ps") + length
    left = pairs.select("s", "g", F.lit(0).alias("side"), low.alias("lo"), high.alias("hi"), "ps", "shift")
    right = pairs.select(F.col("s2").alias("s"), "g", F.lit(1).alias("side"), (low + F.col("shift")).alias("lo"), (high + F.col("shift")).alias("hi"), F.lit(None).cast("array<int>").alias("ps"), "shift")
    asked = left.unionByName(right).groupBy("s").agg(F.collect_list(F.struct("g", "side", "lo", "hi", "ps", "shift")).alias("asked"))  # bounded by the strip

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {"g": pa.int64(), "side": pa.int32(), "s": pa.int64(), "bytes": pa.binary(), "ps": pa.list_(pa.int32()), "shift": pa.int32()}
        for batch in batches:
            held, size = [], 0
            for s, data, asked in zip(*(batch.column(c).to_pylist() for c in ("s", "data", "asked")), strict=True):
                held += [x | {"s": s, "bytes": data[x["lo"] : x["hi"]]} for x in asked]
                size += sum(x["hi"] - x["lo"] for x in asked)
                if size > SLICE * 10:
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], k) for n, k in names.items()], list(names))
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], k) for n, k in names.items()], list(names))

    parts = strips.select("s", "data").join(asked, "s").mapInArrow(cut_out, "g bigint, side int, s bigint, bytes binary, ps array<int>, shift int")
    faced = parts.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("side", "s", "bytes", "ps", "shift"))).alias("two"))  # two rows

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """s, p of both of each pair whose first `length` bytes are the same."""
        for batch in batches:
            s, p = [], []
            for a, b in batch.column("two").to_pylist():
                at = np.array(a["ps"], np.int64)
                x, y = (np.frombuffer(v["bytes"], np.uint8) for v in (a, b))
                n = min(len(x), len(y))
                differ = np.append(np.flatnonzero(x[:n] != y[:n]), n)
                begin = at - at[0]
                same = at[differ[np.searchsorted(differ, begin)] - begin >= length]
                s += [a["s"]] * len(same) + [b["s"]] * len(same)
                p += [*same.tolist(), *(same + a["shift"]).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(p, pa.int32())], ["s", "p"])

    equal = faced.select("two").mapInArrow(compare, "s bigint, p int").join(strips.select("s", "t", "at"), "s")
    equal = equal.select("t", (F.col("p") + F.col("at")).alias("l"), (F.col("p") + F.col("at")).alias("h"))
    found = known.unionByName(equal).groupBy("t").agg(F.sort_array(F.collect_set(F.struct("l", "h"))).alias("found"))  # bounded by the text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, key2, data, spans, found in zip(*(batch.column(c).to_pylist() for c in ("key", "key2", "text", "spans", "found")), strict=True):
                covers = [(x["l"], x["h"] + length) for x in found or ()]
                spans = merged(sorted([*zip(spans[::2], spans[1::2], strict=True), *merged(covers)]))
                rows.append((key, key2, sum(e - b for b, e in spans), [[b, e] for b, e in spans], without(data, spans)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "key2", "n_removed", "spans", "kept"])

    columns = ["key", "key2", "text", "spans", "found"]
    known_texts = texts.where("NOT unsure").withColumn("found", F.lit(None).cast("array<struct<l:int,h:int>>"))
    asked = texts.where("unsure").join(found, "t", "left").select(columns).unionByName(known_texts.select(columns))
    return source, asked.mapInArrow(cut, "key bigint, key2 bigint, n_removed bigint, spans array<array<bigint>>, kept binary").where("n_removed > 0")


def _own(data: bytes, sampled: list[dict], length: int) -> np.ndarray:
    """Which entries hold in this text: two texts whose 64-bit keys agree have each other's beside their own."""
    a, lo, hi = np.array([(e["a"], e["lo"], e["hi"]) for e in sampled], np.int64).T
    holds = hi + length <= len(data)
    core, u = _prints(Prints(np.frombuffer(data, np.uint8)), a[holds], lo[holds], hi[holds], length)
    theirs = np.array([(e["prints"]["core"], e["prints"]["u"]) for e in sampled], np.int64)[holds]
    holds[holds] = (core == theirs[:, 0]) & (u == theirs[:, 1])
    return holds


def merged(covers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in covers:
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for b, e in spans:
        parts.append(data[at:b])
        at = e
    return b"".join([*parts, data[at:]])


def deduplicated(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_removed, spans, kept (binary), as `repeats` defines them."""
    source, cut = repeats(docs, length, id_col, text_col)
    out = source.join(cut, ["key", "key2"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("spans", F.array().cast("array<array<bigint>>")).alias("spans"), F.coalesce("kept", F.col("text").cast("binary")).alias("kept"))


def digests(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256. Texts that lose nothing are not shuffled."""
    source, cut = repeats(docs, length, id_col, text_col)
    whole = source.select("key", "key2", F.col("id").alias(id_col), F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    less = cut.select("key", "key2", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha"))
    zero = F.lit(0).cast("bigint")
    return whole.join(less, ["key", "key2"], "left").select(id_col, "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))
