"""Secrets in texts by one deterministic automaton for all rules.

The rules' regular expressions are compiled here: to states of a nondeterministic
automaton, by subset construction to one deterministic automaton that follows the
leftmost match of every rule at once, and by minimisation to arrays of
transitions over classes of bytes.  Texts are read byte by byte, once for all
rules.  Many stretches of a batch are read side by side: a stretch begins behind
a byte that ends every match and begins none, so its first state is known.
Where a match ends, the rule's reversed expression, compiled the same way, walks
back to its start.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

#: Stretches that are read side by side, at most; a stretch this many times longer than the usual is read on its own.
LANES, LONG_LANE = 4096, 8
#: A byte that no UTF-8 text holds: what stands between texts.
BREAK = 0xFF


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and non-overlapping, count if ``group`` has at least ``least`` characters.

    ``whole`` may name an expression for matches that can count, where the
    match is always a whole run of its bytes: the automaton then reports only
    those, so that short runs, which are many, cost nothing.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    whole: str | None = None


#: The base rules of the contract.
BASE_RULES = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{8,}"),
)
#: Published shapes of keys and tokens.
MORE_RULES = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
RULES = BASE_RULES + MORE_RULES


# ---------------------------------------------------------------------------
# Expressions: literals, \xHH, classes, groups, |, ?, *, +, {m,} and {m,n}.
# ---------------------------------------------------------------------------


def parsed(pattern: str):
    """The expression as nested tuples: ("bytes", set), ("seq", parts), ("any", parts) and ("times", part, least, most or None)."""
    at = 0

    def alternatives():
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("any", parts)

    def sequence():
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(repeated(atom()))
        return ("seq", parts)

    def one_byte() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "\\":
            c = pattern[at]
            at += 1
            if c == "x":
                at += 2
                return int(pattern[at - 2 : at], 16)
            if c.isalnum():
                raise ValueError(f"\\{c} is not understood in {pattern!r}")
        if ord(c) > 127:
            raise ValueError(f"only ASCII may stand in a rule: {pattern!r}")
        return ord(c)

    def atom():
        nonlocal at
        c = pattern[at]
        if c == "(":
            at += 1
            inner = alternatives()
            if at >= len(pattern) or pattern[at] != ")":
                raise ValueError(f"a group is not closed in {pattern!r}")
            at += 1
            return inner
        if c == "[":
            at += 1
            found = set()
            while pattern[at] != "]":
                low = one_byte()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    found.update(range(low, one_byte() + 1))
                else:
                    found.add(low)
            at += 1
            return ("bytes", frozenset(found))
        if c in "*+?{^$.":
            raise ValueError(f"{c!r} is not understood at {at} of {pattern!r}")
        return ("bytes", frozenset([one_byte()]))

    def repeated(part):
        nonlocal at
        while at < len(pattern) and pattern[at] in "*+?{":
            c = pattern[at]
            at += 1
            if c == "{":
                end = pattern.index("}", at)
                low, _, high = pattern[at:end].partition(",")
                exact = "," not in pattern[at:end]
                at = end + 1
                part = ("times", part, int(low), int(low) if exact else int(high) if high else None)
            else:
                part = ("times", part, *{"*": (0, None), "+": (1, None), "?": (0, 1)}[c])
        return part

    tree = alternatives()
    if at < len(pattern):
        raise ValueError(f"{pattern[at]!r} is not understood at {at} of {pattern!r}")
    return tree


def reversed_tree(tree):
    kind, *rest = tree
    if kind == "seq":
        return ("seq", [reversed_tree(p) for p in reversed(rest[0])])
    if kind == "any":
        return ("any", [reversed_tree(p) for p in rest[0]])
    return tree if kind == "bytes" else ("times", reversed_tree(rest[0]), *rest[1:])


class Positions:
    """The nondeterministic automaton of an expression: one state for each place of a byte, and which may follow which."""

    def __init__(self, tree):
        self.bytes: list[frozenset[int]] = []
        self.follow: dict[int, set[int]] = defaultdict(set)
        empty, first, last = self._add(tree)
        if empty:
            raise ValueError("a rule must not match the empty text")
        self.first, self.last = frozenset(first), frozenset(last)

    def _add(self, tree):
        """Whether it matches nothing, the places it can begin with and those it can end with."""
        kind, *rest = tree
        if kind == "bytes":
            self.bytes.append(rest[0])
            return False, {len(self.bytes) - 1}, {len(self.bytes) - 1}
        if kind == "any":
            made = [self._add(p) for p in rest[0]]
            return any(m[0] for m in made), set().union(*(m[1] for m in made)), set().union(*(m[2] for m in made))
        if kind == "seq":
            return self._chain([self._add(p) for p in rest[0]])
        part, least, most = rest
        if most is None:
            made = [self._add(part) for _ in range(max(least, 1))]
            for end in made[-1][2]:
                self.follow[end] |= made[-1][1]
            if not least:
                made = [(True, *made[0][1:])]
            return self._chain(made)
        return self._chain([m if i < least else (True, *m[1:]) for i, m in enumerate([self._add(part) for _ in range(most)])])

    def _chain(self, made):
        empty, first, last = True, set(), set()
        for e, f, l in made:
            for end in last:
                self.follow[end] |= f
            if empty:
                first |= f
            last = last | l if e else set(l)
            empty = empty and e
        return empty, first, last

    def step(self, places: frozenset[int], byte: int) -> frozenset[int]:
        return frozenset(q for p in places for q in self.follow[p] if byte in self.bytes[q])

    def begin(self, byte: int) -> frozenset[int]:
        return frozenset(q for q in self.first if byte in self.bytes[q])


def byte_classes(automata: list[Positions]) -> tuple[np.ndarray, list[int]]:
    """The class of each byte, and one byte of each class: bytes that no place tells apart are one class."""
    sets = sorted({tuple(sorted(b)) for a in automata for b in a.bytes})
    seen: dict[tuple, int] = {}
    classes = np.zeros(256, np.uint8)
    for byte in [BREAK, *range(255)]:  # class 0 is that of the break
        classes[byte] = seen.setdefault(tuple(byte in s for s in map(set, sets)), len(seen))
    return classes, [int(np.flatnonzero(classes == c)[-1]) for c in range(len(seen))]


def minimal(table: np.ndarray, output: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest automaton with the same outputs: states are parted by output, then by where their bytes lead, until nothing changes."""
    part = np.unique(output, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    one = np.zeros(part.max() + 1, np.int64)
    one[part[::-1]] = np.arange(len(part))[::-1]  # the first state of each part
    return part[table[one]], part


class RuleAutomaton:
    """All rules as arrays: ``table`` (state, class of byte) -> state, with the rules whose match has just ended behind each state.

    A state holds, for every rule, the sets of places reached from each start
    that is still open, oldest start first.  A place that an older start has
    reached is dropped from younger ones.  Once the oldest start has a match,
    younger ones are closed and no new ones open; the match ends where no place
    is left.  Two things that rules of this kind do not do are refused: a match
    that can go on to text that is no match, and a younger start that has a
    match while an older one is open.
    """

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        taken = [Positions(parsed(r.pattern)) for r in rules]
        whole = [Positions(parsed(r.whole)) if r.whole else None for r in rules]
        self.back = [_Backwards(r.pattern) for r in rules]
        self.classes, bytes_ = byte_classes([*taken, *(w for w in whole if w)])

        @lru_cache(None)
        def moved(rule: int, config: tuple, byte: int):
            """The rule's next open starts, and whether a match ended before this byte."""
            a, w = taken[rule], whole[rule]
            matched = bool(config) and bool(config[0][0] & a.last)
            ended, kept, seen = 0, [], (set(), set())
            for places, full in config:
                now, now_full = a.step(places, byte) - seen[0], w.step(full, byte) - seen[1] if w else frozenset()
                if now:
                    kept.append((now, now_full))
                    seen[0].update(now)
                    seen[1].update(now_full)
            if matched:
                if not kept:
                    ended = int(w is None or bool(config[0][1] & w.last))
                elif not kept[0][0] & a.last:
                    raise ValueError(f"{rules[rule].kind}: a match can go on to text that is none")
                else:
                    return tuple(kept), 0
            start, start_full = a.begin(byte) - seen[0], w.begin(byte) - seen[1] if w else frozenset()
            if start:
                kept.append((start, start_full))
            for i, (places, _) in enumerate(kept):
                if places & a.last:
                    if i:
                        raise ValueError(f"{rules[rule].kind}: a start within an open one has a match")
                    kept = kept[:1]
                    break
            return tuple(kept), ended

        nothing = (tuple(() for _ in rules), 0)
        number, order, rows = {nothing: 0}, [nothing], []
        for state in order:
            row = []
            for byte in bytes_:
                each = [moved(r, c, byte) for r, c in enumerate(state[0])]
                target = (tuple(c for c, _ in each), sum(e << r for r, (_, e) in enumerate(each)))
                if target not in number:
                    number[target] = len(order)
                    order.append(target)
                row.append(number[target])
            rows.append(row)
        self.subsets = len(order)
        table, part = minimal(np.array(rows), np.array([ended for _, ended in order]))
        output = np.zeros(len(table), np.int64)
        output[part] = [ended for _, ended in order]
        # states are numbered so that those with a match behind them come last, and the first state is 0
        rank = np.lexsort((np.arange(len(table)) != part[0], output > 0))
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        self.table, self.output = place[table[rank]], output[rank]
        self.quiet = int((self.output == 0).sum())
        self.width = len(bytes_)
        #: The same transitions in one array; states are multiplied by the number of classes.
        self.flat = (self.table * self.width).astype(np.int32).ravel()
        self.listed: list[int] = []
        #: After these bytes every state goes on like the first one.
        same = (self.table[self.table] == self.table[0]).all(2).all(0)
        self.closing = same[self.classes]
        if not self.closing[BREAK]:
            raise ValueError("a rule spans the end of a text")

    def ends(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """(end, rules as bits) of all matches in a run of bytes whose last is BREAK, in no order."""
        n = len(data)
        if not n:
            return
        coded = self.classes[data]
        closing = np.flatnonzero(self.closing[data])
        cuts = np.arange(0, n, max(256, -(-n // LANES)))
        # each stretch ends behind the next closing byte
        bounds = np.unique(np.concatenate([[0], closing[np.searchsorted(closing, cuts[1:])] + 1, [n]]))
        starts, sizes = bounds[:-1], np.diff(bounds)
        usual = LONG_LANE * max(256, -(-n // LANES))
        for i in np.flatnonzero(sizes > usual):
            yield from self._alone(coded[starts[i] : bounds[i + 1]].tolist(), int(starts[i]))
        side = sizes <= usual
        if side.any():
            yield from self._abreast(coded, starts[side], sizes[side])

    def _alone(self, coded: list[int], start: int) -> Iterator[tuple[int, int]]:
        self.listed = self.listed or self.flat.tolist()
        flat, state, loud = self.listed, 0, self.quiet * self.width
        for i, c in enumerate(coded):
            state = flat[state + c]
            if state >= loud:
                yield start + i, int(self.output[state // self.width])

    def _abreast(self, coded: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        steps = np.arange(sizes[0])
        live = np.searchsorted(-sizes, -steps, "left")  # stretches longer than each step
        state, loud = np.zeros(len(starts), np.int32), self.quiet * self.width
        padded = np.concatenate([coded, np.zeros(int(sizes[0]), np.uint8)])
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, int(sizes[0]))[starts].T)
        for t in range(int(sizes[0])):
            n = live[t]
            state = self.flat[state[:n] + rows[t, :n]]
            if state.max(initial=0) >= loud:
                for lane in np.flatnonzero(state >= loud):
                    yield int(starts[lane]) + t, int(self.output[state[lane] // self.width])

    def spans(self, data: np.ndarray, first: int, text_end: int, ends: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, end, rule) of the matches that count within one text, from its ends in order."""
        out, last = [], [first] * len(self.rules)
        for end, bits in ends:
            for r, rule in enumerate(self.rules):
                if bits >> r & 1:
                    start = self.back[r].start(data, last[r], end)
                    last[r] = end
                    found = regex.fullmatch(rule.pattern, data[start:end].tobytes().decode("ascii"))
                    if len(found.group(rule.group)) >= rule.least:
                        out.append((start - first, end - first, r))
        return sorted(out, key=lambda s: (s[0], s[2]))


class _Backwards:
    """The deterministic automaton of a reversed expression, for the longest match that ends at a place."""

    def __init__(self, pattern: str):
        places = Positions(reversed_tree(parsed(pattern)))
        self.classes, bytes_ = byte_classes([places])
        number, order, rows = {None: 0}, [None], []
        for state in order:
            row = []
            for byte in bytes_:
                target = places.begin(byte) if state is None else places.step(state, byte)
                if target not in number:
                    number[target] = len(order)
                    order.append(target)
                row.append(number[target])
            rows.append(row)
        table, part = minimal(np.array(rows), np.array([0 if s is None else 1 if not s else 2 + bool(s & places.last) for s in order]))
        self.table, self.begin = table.tolist(), int(part[0])
        self.dead = {int(part[i]) for i, s in enumerate(order) if s is not None and not s}
        self.good = {int(part[i]) for i, s in enumerate(order) if s and s & places.last}

    def start(self, data: np.ndarray, least: int, end: int) -> int:
        state, found, at = self.begin, end, end
        while at > least:
            at -= 1
            state = self.table[state][self.classes[data[at]]]
            if state in self.dead:
                break
            if state in self.good:
                found = at
        return found


@lru_cache(4)
def automaton(rules: tuple[Rule, ...]) -> RuleAutomaton:
    """Compiled once, on the driver."""
    return RuleAutomaton(rules)


def batch_spans(column: pa.Array, machine: RuleAutomaton) -> Iterator[list[tuple[int, int, int]]]:
    """For each text its spans as (start, end, rule) in code points, by start and then rule."""
    for _, data, offsets in text_chunks(column):
        n = len(offsets) - 1
        broken = np.full(len(data) + n, BREAK, np.uint8)
        first = offsets[:-1] + np.arange(n)
        inside = np.ones(len(broken), bool)
        inside[offsets[1:] + np.arange(n)] = False
        broken[inside] = data
        by_row: dict[int, list] = defaultdict(list)
        for end, bits in machine.ends(broken):
            by_row[int(np.searchsorted(first, end, "right")) - 1].append((end, bits))
        for row in range(n):
            if row not in by_row:
                yield []
                continue
            begin, stop = int(first[row]), int(offsets[row + 1]) + row
            spans = machine.spans(broken, begin, stop, sorted(by_row[row]))
            points = np.concatenate([[0], np.cumsum((broken[begin:stop] & 0xC0) != 0x80)])  # code points before each byte
            yield [(int(points[s]), int(points[e]), r) for s, e, r in spans]


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", out_col: str = "secret_spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end) for each text, by start and then in the order of the rules.

    Places count code points, ends are exclusive.  Each rule takes its matches
    from left to right without overlap, as a regular-expression engine does;
    matches of different rules may overlap.  Whole texts are read; null, empty
    and blank ones have no spans.  Repeated rows come back each, all other
    columns stay as they are, a column named like ``out_col`` is replaced; no
    rows give no rows.
    """
    kinds = [r.kind for r in rules]
    shared = docs.sparkSession.sparkContext.broadcast(automaton(rules))  # a few MB, whatever the input

    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        sizes, kind, start, end = [0], [], [], []
        for spans in batch_spans(texts, shared.value):
            for s, e, r in spans:
                kind.append(kinds[r])
                start.append(s)
                end.append(e)
            sizes.append(len(kind))
        parts = pa.StructArray.from_arrays([pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["kind", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), parts)

    return docs.withColumn(out_col, found(F.col(text_col)))


def masked(text: F.Column, spans: F.Column) -> F.Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first counts, and what others have beyond it goes too."""
    text = F.coalesce(text, F.lit(""))
    start = F.struct(F.lit("").alias("made"), F.lit(0).cast("long").alias("upto"))

    def add(acc, s):
        fresh = F.concat(acc["made"], F.substr(text, (acc["upto"] + 1).cast("int"), (s["start"] - acc["upto"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(s["start"] < acc["upto"], acc["made"]).otherwise(fresh).alias("made"), F.greatest(acc["upto"], s["end"]).alias("upto"))

    return F.aggregate(spans, start, add, lambda acc: F.concat(acc["made"], F.substr(text, (acc["upto"] + 1).cast("int"))))
