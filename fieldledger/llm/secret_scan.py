"""Secret scanning with one combined deterministic automaton.

All rules' regular expressions are read into one nondeterministic automaton, made deterministic
by subset construction, minimised by partition refinement, and laid out as a transition array
over byte classes. Every text is passed once, byte by byte, for all rules together. While the
automaton is in its start state, no match is under way; the bytes between two visits to it are a
stretch that holds its matches whole, and the accepting states met in it say whose. A stretch
that is as long as the shortest secret of a rule that fired in it gives up its spans: each such
rule's own automaton, compiled the same way without the leading search, begins at one byte after
the other and notes the last accepting state, so a span is the leftmost and longest one.

Rules have no counted repetitions: counting out the lengths of several rules at once would
multiply the states (259,000 against 743). Lengths are checked after the match, as a match that is
too short uses up its text all the same. In these rules the longest match is the greedy one.

Defined results: a null text is the empty text and has no spans; repeated rows give repeated
results; where two rules meet the same text, both report it, in the order of start and rule; an
empty table gives no rows; other columns, whatever their names, are ignored. Texts may be of any
length: the automaton holds three numbers between bytes, and a rule reads a stretch once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from re import IGNORECASE, _parser
from re import _constants as C

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of


@dataclass(frozen=True)
class Rule:
    """kind, the expression without counts, the fewest bytes of a secret, and what a match must pass beside that."""

    kind: str
    pattern: str
    least: int
    keep: Callable[[bytes], bool] = bool


def assigned_value(match: bytes) -> bytes:
    """What the assignment assigns: neither the name nor the blanks around it hold a sign."""
    value = match[min(at for at in (match.find(b":"), match.find(b"=")) if at >= 0) + 1 :].lstrip(b" ")
    return value[1:] if value[:1] in (b'"', b"'") else value


#: The base rules first, then those that this operator adds.
RULES = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", 12, lambda m: len(assigned_value(m)) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("stripe", r"sk_live_[A-Za-z0-9]+", 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
)
BASE = 3


class _Nfa:
    """Thompson's construction over byte sets, from the syntax tree of the standard library."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def join(self, a: int, b: int) -> None:
        self.empty[a].append(b)

    def consume(self, begin: int, allowed: set[int], fold: bool) -> int:
        if fold:
            allowed = allowed | {ord(chr(c).swapcase()) for c in allowed if c < 128 and chr(c).isalpha()}
        end = self.state()
        self.moves[begin].append((frozenset(allowed), end))
        return end

    def sequence(self, tree, begin: int, fold: bool) -> int:
        for op, value in tree:
            begin = self.item(op, value, begin, fold)
        return begin

    def item(self, op, value, begin: int, fold: bool) -> int:
        if op is C.LITERAL:
            return self.consume(begin, {value}, fold)
        if op is C.IN:
            allowed: set[int] = set()
            for kind, x in value:
                if kind is C.LITERAL:
                    allowed.add(x)
                elif kind is C.RANGE:
                    allowed |= set(range(x[0], x[1] + 1))
                else:
                    raise ValueError(f"not supported in a class: {kind}")
            return self.consume(begin, allowed, fold)
        if op is C.SUBPATTERN:
            _, on, _, inner = value
            return self.sequence(inner, begin, fold or bool(on & IGNORECASE))
        if op is C.BRANCH:
            end = self.state()
            for branch in value[1]:
                first = self.state()
                self.join(begin, first)
                self.join(self.sequence(branch, first, fold), end)
            return end
        if op is C.MAX_REPEAT:
            least, most, inner = value
            for _ in range(least):
                begin = self.sequence(inner, begin, fold)
            if most is C.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.join(begin, loop)
                self.join(loop, end)
                self.join(self.sequence(inner, loop, fold), loop)
                return end
            end = self.state()
            self.join(begin, end)
            for _ in range(most - least):
                begin = self.sequence(inner, begin, fold)
                self.join(begin, end)
            return end
        raise ValueError(f"not supported: {op}")


@dataclass(frozen=True)
class Automaton:
    """next[state + class] is a state; 0 is the start, and states from ``accepting`` on have matched the rules in ``rules``."""

    classes: bytes
    next: list[int]
    accepting: int
    rules: dict[int, int]
    states: int
    dead: int

    def stretches(self, data: bytes, least: dict[int, int]) -> list[tuple[int, int, int]]:
        """(begin, end, fired) of what lies between visits to the start state, if it is as long as
        ``least`` says for the rules that fired in it (bit r for rule r)."""
        step, accepting, rules = self.next, self.accepting, self.rules
        state = fired = begin = 0
        found = []
        for i, c in enumerate(data.translate(self.classes)):
            state = step[state + c]
            if not state:
                if fired:
                    if i - begin >= least[fired]:
                        found.append((begin, i, fired))
                    fired = 0
                begin = i + 1
            elif state >= accepting:
                fired |= rules[state]
        if fired and len(data) - begin >= least[fired]:
            found.append((begin, len(data), fired))
        return found

    def spans(self, data: bytes) -> Iterator[tuple[int, int]]:
        """Leftmost, longest, not overlapping matches, for an automaton of one rule without the leading search."""
        step, accepting, dead = self.next, self.accepting, self.dead
        code = data.translate(self.classes)
        at, n = 0, len(code)
        while at < n:
            state, i, end = 0, at, 0
            while i < n:
                state = step[state + code[i]]
                if state == dead:
                    break
                i += 1
                if state >= accepting:
                    end = i
            if end:
                yield at, end
            at = end or at + 1


def _classes(nfa: _Nfa) -> tuple[bytes, list[int]]:
    """Bytes that no move tells apart share a class; also one byte of each class."""
    sets = list(dict.fromkeys(s for moves in nfa.moves for s, _ in moves))
    seen: dict[tuple[bool, ...], int] = {}
    table = bytearray(256)
    for b in range(256):
        table[b] = seen.setdefault(tuple(b in s for s in sets), len(seen))
    return bytes(table), [table.index(k) for k in range(len(seen))]


def compile_rules(patterns: tuple[str, ...], search: bool = True) -> Automaton:
    """The minimal automaton of all patterns; with search, a match may begin anywhere."""
    nfa = _Nfa()
    root = nfa.state()
    accepts: dict[int, int] = {}
    for r, pattern in enumerate(patterns):
        first = nfa.state()
        nfa.join(root, first)
        accepts[nfa.sequence(_parser.parse(pattern), first, False)] = 1 << r
    table, samples = _classes(nfa)

    def closure(states: set[int]) -> frozenset[int]:
        todo, found = list(states), set(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return frozenset(found)

    # subset construction; in a search the root stays in every subset
    start, always = closure({root}), {root} if search else set()
    number, rows, marks = {start: 0}, [], []
    todo = deque([start])
    while todo:
        subset = todo.popleft()
        mark = 0
        for s in subset:
            mark |= accepts.get(s, 0)
        marks.append(mark)
        row = []
        for b in samples:
            after = closure(always | {t for s in subset for allowed, t in nfa.moves[s] if b in allowed})
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        rows.append(row)

    # minimisation: split blocks by where their states lead until nothing splits
    # the start stays by itself, as the only state in which nothing is under way
    block = {m: i for i, m in enumerate(dict.fromkeys(marks), 1)}
    of = [0, *[block[m] for m in marks[1:]]]
    while True:
        seen: dict[tuple, int] = {}
        now = [seen.setdefault((of[s], *(of[t] for t in rows[s])), len(seen)) for s in range(len(rows))]
        if len(seen) == len(set(of)):
            break
        of = now
    blocks = {b: s for s, b in reversed(list(enumerate(of)))}
    order = sorted(blocks, key=lambda b: (marks[blocks[b]] != 0, b != of[0], b))  # the start first, accepting ones last
    width = len(samples)
    place = {b: i * width for i, b in enumerate(order)}
    flat = [place[of[t]] for b in order for t in rows[blocks[b]]]
    rules = {place[b]: marks[blocks[b]] for b in order if marks[blocks[b]]}
    nothing = frozenset()
    dead = place[of[number[nothing]]] if nothing in number else -1
    return Automaton(table, flat, min(rules, default=len(flat)), rules, len(order), dead)


class Scanner:
    """The combined automaton, each rule's own, and the least length for every set of rules that may fire."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.combined = compile_rules(tuple(r.pattern for r in rules))
        self.single = [compile_rules((r.pattern,), search=False) for r in rules]
        self.least = {bits: min(r.least for i, r in enumerate(rules) if bits >> i & 1) for bits in range(1, 1 << len(rules))}

    def __call__(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and then by rule."""
        found = []
        for begin, end, fired in self.combined.stretches(data, self.least):
            stretch = data[begin:end]
            for r, rule in enumerate(self.rules):
                if fired >> r & 1 and len(stretch) >= rule.least:
                    found += [(begin + a, r, begin + b) for a, b in self.single[r].spans(stretch) if b - a >= rule.least and rule.keep(stretch[a:b])]
        return sorted(found)


_MADE: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    if rules not in _MADE:
        _MADE[rules] = Scanner(rules)
    return _MADE[rules]


def spans_of(data: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, rule, end) of the secrets in UTF-8 data, in code points, by start and then by rule."""
    found = scanner(rules)(data)
    if not found or data.isascii():
        return found
    before = np.r_[0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)]
    return [(int(before[a]), r, int(before[b])) for a, r, b in found]


def _scan(rules: tuple[Rule, ...], base: int):
    names = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = ([0] * base, sha256(b"").hexdigest(), "")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                for data in part["text"].cast(pa.binary()).to_pylist():
                    spans = spans_of(data, rules)
                    if not spans:
                        rows.append(nothing)
                        continue
                    said = [f"{names[r]}:{a}:{b}" for a, r, b in spans]
                    sealed = ",".join(s for s, (_, r, _) in zip(said, spans, strict=True) if r < base)
                    rows.append(([sum(x[1] == r for x in spans) for r in range(base)], sha256(sealed.encode()).hexdigest(), ",".join(said)))
                counts = [pa.array([row[0][r] for row in rows], pa.int64()) for r in range(base)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *counts, pa.array([row[1] for row in rows], pa.string()), pa.array([row[2] for row in rows], pa.string())], ["doc_id", *[f"n_{n}" for n in names[:base]], "base_sha256", "spans"])

    return run


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = BASE) -> DataFrame:
    """doc_id, a count for each of the first ``base`` rules, base_sha256 and spans."""
    counts = ", ".join(f"n_{r.kind} long" for r in rules[:base])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.mapInArrow(_scan(rules, base), f"doc_id long, {counts}, base_sha256 string, spans string")


def redact(text: str, mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> str:
    """The text with every span, overlapping ones merged, replaced by mask."""
    out, at = [], 0
    for start, _, end in spans_of(text.encode("utf-8", "surrogatepass"), rules):
        if end > at:
            if start >= at:
                out += [text[at:start], mask]
            at = end
    return "".join([*out, text[at:]])
