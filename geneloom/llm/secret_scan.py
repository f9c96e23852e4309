"""Secret scan: the regular expressions of all rules in one deterministic automaton that reads each text once, byte by byte.

Rules are parsed into position automata, combined by subset construction over classes of bytes, minimised, and laid out as one
flat transition array. Within a rule, matches are leftmost, greedy and do not overlap; rules do not hide one another. The forward
pass tells where a match of a rule ends; the rule's reversed automaton, run back from there, tells where it begins, and the rule's
expression is then held against exactly that span for its minimum length.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import bounded


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # literals, \xHH, classes, groups with |, and ? * + {n,}
    any_case: tuple[str, ...] = ()  # words in the pattern whose letters may be in either case
    group: int = 0  # the group that the minimum length is about
    least: int = 0

    @property
    def expression(self) -> str:
        out = self.pattern
        for word in self.any_case:
            out = out.replace(word, "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word))
        return out


# fixed values of the contract
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("password", "passwd", "secret", "token", "api", "key"), 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", least=18),
    Rule("hex", "[0-9a-f]{16,}", least=16),
)
# further rules of this scan
FURTHER = (
    Rule("pem", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("google", "AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=60),
)
RULES = BASE + FURTHER


class Positions:
    """The position automaton of an expression: which bytes each position takes, what may come first, last, and after what."""

    def __init__(self, expression: str):
        self.takes: list[frozenset[int]] = []
        self.follow: list[set[int]] = []
        self.tokens = re.findall(r"\\x[0-9A-Fa-f]{2}|\\.|\[[^\]]*\]|\{\d+,\}|.", expression, re.S)
        self.at = 0
        _, self.first, self.last = self._choice()

    def _peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def _choice(self):
        out = self._sequence()
        while self._peek() == "|":
            self.at += 1
            other = self._sequence()
            out = (out[0] or other[0], out[1] | other[1], out[2] | other[2])
        return out

    def _sequence(self):
        out = (True, set(), set())
        while self._peek() not in ("", "|", ")"):
            out = self._join(out, self._repeated())
        return out

    def _join(self, a, b):
        for p in a[2]:
            self.follow[p] |= b[1]
        return a[0] and b[0], a[1] | b[1] if a[0] else a[1], a[2] | b[2] if b[0] else b[2]

    def _loop(self, a):
        for p in a[2]:
            self.follow[p] |= a[1]

    def _repeated(self):
        begin = self.at
        out = self._atom()
        end, mark = self.at, self._peek()
        if mark in ("?", "*", "+") or re.fullmatch(r"\{\d+,\}", mark):
            for _ in range(int(mark[1:-2]) - 1 if mark[0] == "{" else 0):
                self.at = begin
                last = self._atom()
                out = self._join(out, last)
            if mark[0] == "{":
                self._loop(last)
            elif mark != "?":
                self._loop(out)
            self.at = end + 1
            return (out[0] or mark in "?*", *out[1:])
        return out

    def _atom(self):
        token = self._peek()
        self.at += 1
        if token == "(":
            out = self._choice()
            self.at += 1
            return out
        if token[0] == "[":
            taken = {b for lo, hi in re.findall(r"(.)(?:-(.))?", token[1:-1]) for b in range(ord(lo), ord(hi or lo) + 1)}
        else:
            taken = {int(token[2:], 16) if token.startswith("\\x") else ord(token[-1])}
        self.takes.append(frozenset(taken))
        self.follow.append(set())
        p = len(self.takes) - 1
        return False, {p}, {p}


@dataclass(frozen=True)
class Automaton:
    """``table[state | byte]``: states are multiples of 256. From state ``watch`` on a rule is in a match; ``rules[ended[state | byte]]`` are those whose match ends before that byte."""

    table: list[int]
    watch: int
    ended: bytes
    rules: tuple[tuple[int, ...], ...]  # the first is empty
    back: tuple[tuple[dict[tuple[int, int], int], frozenset[int]], ...]  # per rule: reversed transitions, accepting states


def _byte_classes(automata: list[Positions]) -> tuple[list[int], list[int]]:
    """For each byte its class, and one byte of each class."""
    sets = {s for a in automata for s in a.takes}
    seen: dict[tuple[bool, ...], int] = {}
    of = [seen.setdefault(tuple(b in s for s in sorted(sets, key=sorted)), len(seen)) for b in range(256)]
    return of, [of.index(c) for c in range(len(seen))]


def _reversed(a: Positions) -> tuple[dict[tuple[int, int], int], frozenset[int]]:
    """Subset construction of the reversed rule, anchored at the end of a match."""
    before: list[set[int]] = [set() for _ in a.takes]
    for p, after in enumerate(a.follow):
        for q in after:
            before[q].add(p)
    names: dict[frozenset, int] = {frozenset(["end"]): 0}
    moves, todo, accepting = {}, [frozenset(["end"])], set()
    while todo:
        state = todo.pop()
        reach = set(a.last) if "end" in state else set().union(*(before[p] for p in state))
        for b in range(256):
            to = frozenset(p for p in reach if b in a.takes[p])
            if to:
                if to not in names:
                    names[to] = len(names)
                    todo.append(to)
                    if to & a.first:
                        accepting.add(names[to])
                moves[names[state], b] = names[to]
    return moves, frozenset(accepting)


@functools.lru_cache(maxsize=4)
def compile_rules(rules: tuple[Rule, ...] = RULES) -> Automaton:
    parts = [Positions(r.expression) for r in rules]
    of, sample = _byte_classes(parts)

    def step(a: Positions, state: frozenset, byte: int) -> tuple[frozenset, bool]:
        """The next state of one rule, and whether its match ends here. A rule in a match starts no other."""
        on = {q for p in state for q in a.follow[p] if byte in a.takes[q]}
        inside = bool(state & a.last)
        if inside and on:
            return frozenset(on), False
        on |= {p for p in a.first if byte in a.takes[p]}
        done = on & a.last
        return frozenset(done or on), inside

    start = tuple(frozenset() for _ in parts)
    names, todo, rows = {start: 0}, [start], []
    for state in todo:
        row = []
        for b in sample:
            moved = [step(a, s, b) for a, s in zip(parts, state)]
            to = tuple(m[0] for m in moved)
            if to not in names:
                names[to] = len(names)
                todo.append(to)
            row.append((names[to], tuple(k for k, m in enumerate(moved) if m[1])))
        rows.append(row)
    target = np.array([[x[0] for x in row] for row in rows])
    outputs: dict[tuple, int] = {(): 0}
    output = np.array([[outputs.setdefault(x[1], len(outputs)) for x in row] for row in rows])
    inside = np.array([any(s & a.last for a, s in zip(parts, state)) for state in todo])
    # minimisation: split blocks of states until all members of a block agree on outputs and on the blocks they lead to
    block = np.unique(np.column_stack([inside, output]), axis=0, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[target]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    order = np.lexsort((first, inside[first]))  # states inside a match last
    number = np.empty(len(first), int)
    number[order] = np.arange(len(first))
    begin = number[block[0]]
    number = np.where(number == begin, 0, np.where(number < begin, number + 1, number))  # the start state is 0
    table, ended = [0] * (256 * len(first)), bytearray(256 * len(first))
    for b, state in zip(block[first], first):
        base = 256 * int(number[b])
        for byte in range(256):
            table[base | byte] = 256 * int(number[block[target[state, of[byte]]]])
            ended[base | byte] = output[state, of[byte]]
    return Automaton(table, 256 * int((~inside[first]).sum()), bytes(ended), tuple(outputs), tuple(_reversed(a) for a in parts))


def find(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, end, rule number) by start, then rule, in code points."""
    auto = compile_rules(rules)
    data = text.encode("utf-8", "surrogatepass")
    table, watch, ended, state, ends = auto.table, auto.watch, auto.ended, 0, []
    for i, byte in enumerate(data + b"\0"):  # no rule takes the last byte, so every match ends
        if state >= watch and ended[state | byte]:
            ends += [(i, k) for k in auto.rules[ended[state | byte]]]
        state = table[state | byte]
    floor, found = [0] * len(rules), []
    for end, k in ends:
        moves, accepting = auto.back[k]
        state, at, begin = 0, end, None
        while at > floor[k] and (state := moves.get((state, data[at - 1]))) is not None:
            at -= 1
            begin = at if state in accepting else begin
        floor[k] = end
        m = re.compile(rules[k].expression.encode()).fullmatch(data, begin, end)
        if len(m[rules[k].group]) >= rules[k].least:
            found.append((begin, end, k))
    found.sort(key=lambda f: (f[0], f[2]))
    if len(data) == len(text):
        return found
    at = {0: 0}
    last = 0
    for p in sorted({p for f in found for p in f[:2]}):
        at[p] = at[last] + len(data[last:p].decode("utf-8", "surrogatepass"))
        last = p
    return [(at[a], at[b], k) for a, b, k in found]


SPANS = "array<struct<start: bigint, end: bigint, kind: string>>"


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text, spans) for each row; ``spans`` by start, then rule, in code points with exclusive ends.

    A missing or empty text has no spans; its text comes back as it is. Repeated rows are scanned each for itself, texts of any
    length to their end, an empty table gives an empty table.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            spans = [[{"start": a, "end": b, "kind": rules[k].kind} for a, b, k in find(t or "", rules)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=["doc_id", "text", "spans"])

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(scan, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string, spans {SPANS}")


def redact(found: DataFrame, mask: str = "[secret]") -> DataFrame:
    """(doc_id, text) with every span of ``scan_secrets`` replaced by ``mask``; overlapping spans become one."""
    acc = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def add(a, s):
        plain = F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], plain, F.lit(mask))).otherwise(a["out"]).alias("out"))

    rest = lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text")))
    return found.select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(F.aggregate("spans", acc, add, rest)).alias("text"))
