"""Secret scans: all rules in one deterministic automaton, one pass over the bytes.

The rule regexes are parsed, turned into one nondeterministic automaton over
bytes, determinised by subset construction, minimised, and laid out as a flat
transition array. A scan reads each byte of a text once and finds which rules match
at all. Only the few texts in which some do are read again: from the end, by the same
automaton reversed, which gives every place where a match begins, and then along each
match to its end. All of this takes time in proportion to the text's length.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.batches import texts_of


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    any_case: bool = False
    #: The match counts if this group has so many characters at least.
    group: int = 0
    least: int = 0


#: Fixed values. The base kinds, in the order in which they are listed. `hex` and
#: `access` ask for their least length inside the pattern: their matches are whole runs
#: of one class of characters, so this selects just the runs that are long enough.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Fixed values. Further kinds.
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"Bearer\x20+([A-Za-z0-9._~+/-]+)", group=1, least=20),
)
RULES = BASE_RULES + EXTRA_RULES


class _Nfa:
    """Thompson automaton over bytes. Edges: (set of bytes or None, target)."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int] | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def edge(self, source: int, symbols: frozenset[int] | None, target: int) -> None:
        self.edges[source].append((symbols, target))

    def reversed(self) -> _Nfa:
        """The same states, all edges turned round."""
        out = _Nfa()
        out.edges = [[] for _ in self.edges]
        for source, edges in enumerate(self.edges):
            for symbols, target in edges:
                out.edge(target, symbols, source)
        return out

    def add(self, items, at: int, any_case: bool) -> int:
        for op, value in items:
            at = self._add(op, value, at, any_case)
        return at

    def _add(self, op, value, at: int, any_case: bool) -> int:
        if op is sre.SUBPATTERN:
            return self.add(value[3], at, any_case)
        if op is sre.BRANCH:
            end = self.state()
            for branch in value[1]:
                self.edge(self.add(branch, at, any_case), None, end)
            return end
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, items = value
            for _ in range(low):
                at = self.add(items, at, any_case)
            if high == sre.MAXREPEAT:
                loop = self.state()
                self.edge(at, None, loop)
                self.edge(self.add(items, loop, any_case), None, loop)
                return loop
            end = self.state()
            self.edge(at, None, end)
            for _ in range(high - low):
                at = self.add(items, at, any_case)
                self.edge(at, None, end)
            return end
        symbols = _bytes_of(op, value)
        if any_case:
            symbols |= {ord(chr(b).swapcase()) for b in symbols if chr(b).isascii() and chr(b).isalpha()}
        end = self.state()
        self.edge(at, frozenset(symbols), end)
        return end


def _bytes_of(op, value) -> set[int]:
    if op is sre.LITERAL:
        if value > 127:
            raise ValueError("rules are over ASCII characters")
        return {value}
    if op is sre.IN:
        found: set[int] = set()
        negated = False
        for inner, v in value:
            if inner is sre.NEGATE:
                negated = True
            elif inner is sre.RANGE:
                found |= set(range(v[0], v[1] + 1))
            else:
                found |= _bytes_of(inner, v)
        return set(range(256)) - found if negated else found
    if op is sre.ANY:
        return set(range(256)) - {10}
    raise ValueError(f"not supported in a rule: {op}")


@dataclass
class Dfa:
    """table[state * 256 + byte] is the next state times 256; accepts[state] is a bit mask of rules."""

    table: list[int]
    accepts: list[int]
    start: int
    #: Accepting states come last: a state value (times 256) from here on accepts.
    border: int
    dead: int | None = None


def compile_rules(rules: tuple[Rule, ...], anchored: bool = False, backwards: bool = False) -> Dfa:
    """anchored: matches begin at the first byte read. backwards: for a text read from its end."""
    nfa = _Nfa()
    root = nfa.state()
    begins, ends = {}, {}
    for k, rule in enumerate(rules):
        begin = nfa.state()
        begins[begin] = k
        ends[nfa.add(sre_parser.parse(rule.pattern), begin, rule.any_case)] = k
    if backwards:
        nfa = nfa.reversed()
        begins, ends = ends, begins
    for begin in begins:
        nfa.edge(root, None, begin)

    def closure(state: int) -> int:
        """The states that are reached without a byte, as a bit mask."""
        seen, todo = {state}, [state]
        while todo:
            for symbols, target in nfa.edges[todo.pop()]:
                if symbols is None and target not in seen:
                    seen.add(target)
                    todo.append(target)
        return sum(1 << s for s in seen)

    classes, columns = _classes(nfa)
    moves: list[list[tuple[int, int]]] = []
    for edges in nfa.edges:
        reached = [0] * len(columns)
        for symbols, target in edges:
            if symbols is not None:
                mask = closure(target)
                for c, b in enumerate(columns):
                    if b in symbols:
                        reached[c] |= mask
        moves.append([(c, mask) for c, mask in enumerate(reached) if mask])
    first = closure(root)
    restart = 0 if anchored else first
    number, order, rows = {first: 0}, [first], []
    for states in order:  # grows while it is walked
        row = [restart] * len(columns)
        while states:
            low = states & -states
            for c, mask in moves[low.bit_length() - 1]:
                row[c] |= mask
            states ^= low
        for mask in row:
            if mask not in number:
                number[mask] = len(order)
                order.append(mask)
        rows.append([number[mask] for mask in row])
    accepts = [sum(1 << k for s, k in ends.items() if states >> s & 1) for states in order]
    return _minimised(rows, accepts, classes)


def _classes(nfa: _Nfa) -> tuple[list[int], list[int]]:
    """The class of each byte (bytes that no rule tells apart share one), and a byte of each class."""
    sets = list(dict.fromkeys(symbols for edges in nfa.edges for symbols, _ in edges if symbols is not None))
    known: dict[tuple, int] = {}
    classes = [known.setdefault(tuple(b in s for s in sets), len(known)) for b in range(256)]
    return classes, [classes.index(c) for c in range(len(known))]


def _minimised(rows: list[list[int]], accepts: list[int], classes: list[int]) -> Dfa:
    """Moore's partition refinement, then states laid out with the accepting ones last."""
    block = list(accepts)
    count = len(set(block))
    while True:
        signatures: dict[tuple, int] = {}
        block = [signatures.setdefault((block[i], *[block[t] for t in row]), len(signatures)) for i, row in enumerate(rows)]
        if len(signatures) == count:
            break
        count = len(signatures)
    member = {b: i for i, b in reversed(list(enumerate(block)))}
    layout = sorted(member, key=lambda b: (accepts[member[b]] != 0, b))
    place = {b: k for k, b in enumerate(layout)}
    table = [place[block[rows[member[b]][c]]] * 256 for b in layout for c in classes]
    final = [accepts[member[b]] for b in layout]
    border = sum(not a for a in final) * 256
    dead = next((k * 256 for k in range(len(layout)) if not final[k] and set(table[k * 256 : k * 256 + 256]) == {k * 256}), None)
    return Dfa(table, final, place[block[0]] * 256, border, dead)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.dfa = compile_rules(rules)
        self.back = compile_rules(rules, backwards=True)
        self.single = [compile_rules((rule,), anchored=True) for rule in rules]
        self.parts = [re.compile(r.pattern.encode(), re.IGNORECASE if r.any_case else 0) for r in rules]

    def matching(self, data: bytes) -> int:
        """The rules that match somewhere, as bits: one pass over the bytes."""
        table, border, state, found = self.dfa.table, self.dfa.border, self.dfa.start, set()
        for b in data:
            state = table[state + b]
            if state >= border:
                found.add(state)
        mask = 0
        for state in found:
            mask |= self.dfa.accepts[state >> 8]
        return mask

    def starts(self, data: bytes) -> list[list[int]]:
        """For each rule the places where a match can begin, ascending: one pass from the end."""
        table, border, state = self.back.table, self.back.border, self.back.start
        hits = []
        for at in range(len(data) - 1, -1, -1):
            state = table[state + data[at]]
            if state >= border:
                hits.append((at, state))
        found: list[list[int]] = [[] for _ in self.rules]
        rules_of = {state: [k for k in range(len(self.rules)) if self.back.accepts[state >> 8] >> k & 1] for state in {s for _, s in hits}}
        for at, state in reversed(hits):
            for k in rules_of[state]:
                found[k].append(at)
        return found

    def longest(self, data: bytes, start: int, k: int) -> int:
        """Where the longest match of rule k from start ends."""
        dfa = self.single[k]
        table, border, dead, state, stop = dfa.table, dfa.border, dfa.dead, dfa.start, start
        for at in range(start, len(data)):
            state = table[state + data[at]]
            if state >= border:
                stop = at + 1
            elif state == dead:
                break
        return stop

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes: leftmost, longest, non-overlapping for each rule."""
        if not self.matching(data):
            return []
        found = []
        for k, (rule, starts) in enumerate(zip(self.rules, self.starts(data), strict=True)):
            at = 0
            for start in starts:
                if start < at:
                    continue
                at = self.longest(data, start, k)
                if not rule.least or len(self.parts[k].match(data, start, at)[rule.group]) >= rule.least:
                    found.append((start, at, k))
        return sorted(found, key=lambda x: (x[0], x[2]))

    def spans_of_text(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points."""
        data = text.encode()
        spans = self.spans(data)
        if spans and len(data) != len(text):
            points = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)]).tolist()
            spans = [(points[s], points[e], k) for s, e, k in spans]
        return [(self.rules[k].kind, s, e) for s, e, k in spans]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every secret of every whole text: id, spans array<struct<kind, start, end>>.

    One row per input row, in one pass without a shuffle. A null text is empty and
    has no spans; null or repeated ids are carried as they are; other columns are ignored.
    Positions are code points, the end exclusive. Kinds may overlap each other. Very long
    texts and values take time in proportion to their length.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(scanner(rules))  # bounded by the rules
    schema = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.spans_of_text
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, schema)], ["id", "spans"])

    out = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(
        scan, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    )
    return out.withColumnRenamed("id", id_col)
