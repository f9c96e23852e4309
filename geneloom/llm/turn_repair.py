"""Repair of damaged conversations: generalised LR parsing of their role sequence with weighted edits.

The LR(0) automaton of the role grammar is built from its productions. A repair keeps, reroles or deletes each row and may insert rows
before it; every choice grows another parse stack. Stacks share what lies below their tops, and equal ones merge by the least
(cost, audit), the audit being the edits' initials. Inserts belong to the row they precede, so at any row no audit is a prefix of
another of the same cost and the merge is exact. What a row does depends only on the stacks' relative costs and ranks, so the steps are
remembered and a row costs one lookup.

Rows are range-partitioned by conversation and turn. A conversation inside one range is repaired there. One that crosses ranges leaves,
for each range, a small table (stack before, stack after, cost, rank); these tables compose, so a conversation with a third of all rows
is parsed in as many tasks as its rows fill. Only its audit and its digest, which are single values by nature, are put together in one
task, from a stream of pieces.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup
from .text import materialize, shuffle_partitions

# fixed values of the contract: the roles' grammar, the costs of edits, the kinds of damage
GRAMMAR = (("S", ()), ("S", ("P",)), ("S", ("s", "P")), ("P", ("u", "a")), ("P", ("P", "u", "a")))
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
LEGAL = frozenset(["su", "ua", "au"])
DROPPED, EMPTIED, CUT, REPEATED, USER = range(5)
FINE, BLANK, COPY, CUT_SHORT = range(4)  # what is wrong with a row
PREFIX = 200  # characters of a text that place its row among rows of one turn; the rest of the order is made within a task
PART = 4096  # rows of a conversation's piece in one record

Row = tuple[str, str, int, int]  # role, text, fault, times


# --- the automaton ------------------------------------------------------------------------------------------------------------------


def _closure(items: frozenset) -> frozenset:
    """Items (production, dot); the grammar's start is S."""
    out, todo = set(items), list(items)
    while todo:
        rule, dot = todo.pop()
        right = GRAMMAR[rule][1]
        if dot < len(right):
            new = {(i, 0) for i, (left, _) in enumerate(GRAMMAR) if left == right[dot]} - out
            out |= new
            todo += new
    return frozenset(out)


@lru_cache(None)
def _goto(state: frozenset, symbol: str) -> frozenset:
    moved = {(rule, dot + 1) for rule, dot in state if GRAMMAR[rule][1][dot:dot + 1] == (symbol,)}
    return _closure(frozenset(moved))


START = (_closure(frozenset((i, 0) for i, (left, _) in enumerate(GRAMMAR) if left == "S")), None)  # a stack: (top state, what lies below)


@lru_cache(None)
def shifted(stack: tuple, symbol: str) -> tuple | None:
    """The stack after a shift of ``symbol`` and the reductions that it completes; None where the grammar doesn't allow it."""
    state = _goto(stack[0], symbol)
    if not state:
        return None
    stack = (state, stack)
    done = [rule for rule, dot in state if GRAMMAR[rule][0] != "S" and dot == len(GRAMMAR[rule][1])]
    if not done:
        return stack
    left, right = GRAMMAR[done[0]]
    for _ in right:
        stack = stack[1]
    return shifted(stack, left)


@lru_cache(None)
def accepts(stack: tuple) -> bool:
    return any(GRAMMAR[rule][0] == "S" and dot == len(GRAMMAR[rule][1]) for rule, dot in stack[0])


@lru_cache(None)
def inserted(stack: tuple) -> tuple[tuple[str, tuple], ...]:
    """(plan, stack) after no insert, one, two and three. More never help: a further pair only repeats one that is there."""
    out = [("", stack)]
    for n in range(1, 4):
        for plan, at in [x for x in out if len(x[0]) == n - 1]:
            out += [(plan + r, to) for r in ROLES if (to := shifted(at, r))]
    return tuple(out)


# A plan says more than an audit: K keeps, D deletes, U and A rerole to user and assistant, u and a insert them.
_INITIAL = str.maketrans("UAua", "RRII")
Front = tuple[tuple[tuple, int, int], ...]  # (stack, cost above the least, rank of its audit), by rank


def _ranked(found: dict) -> tuple[int, Front, tuple]:
    """Of ``found``: stack -> (cost, rank before, audit, index before, plan), the least cost, the front, and for each member its origin."""
    least = min(x[0] for x in found.values())
    order = sorted(found.items(), key=lambda x: x[1][1:3])
    return least, tuple((stack, x[0] - least, i) for i, (stack, x) in enumerate(order)), tuple(x[3:] for _, x in order)


@lru_cache(1 << 16)
def step(front: Front, initial: str, fault: int) -> tuple[int, Front, tuple[tuple[int, str], ...]]:
    """One row: the least cost added, the new front, and (index in the old front, plan) for each of its members."""
    found: dict = {}
    extra = CUT_OFF if fault == CUT_SHORT else 0
    for i, (stack, cost, rank) in enumerate(front):
        for before, at in inserted(stack):
            ways = [("D", at, DELETE)]
            if fault in (FINE, CUT_SHORT):
                ways += [("K", shifted(at, initial), KEEP + extra)] + [(r.upper(), shifted(at, r), REROLE + extra) for r in ROLES]
            for op, to, price in ways:
                if to is not None:
                    plan = before + op
                    new = (cost + INSERT * len(before) + price, rank, plan.translate(_INITIAL), i, plan)
                    if to not in found or new < found[to]:
                        found[to] = new
    return _ranked(found)


def finish(front: Front) -> tuple[int, int, str] | None:
    """The best end: (cost, index in the front, inserts after the last row)."""
    ends = [(cost + INSERT * len(plan), rank, plan.translate(_INITIAL), i, plan)
            for i, (stack, cost, rank) in enumerate(front) for plan, at in inserted(stack) if accepts(at)]
    best = min(ends)
    return best[0], best[3], best[4]


def parse(rows: list[Row], stack: tuple = START) -> tuple[int, Front, list]:
    """The least cost, the front after all rows, and the moves that lead there. Of a row that stands ``times`` times, all but the first are
    copies; where none of them may be kept, inserts among them are never better than after them."""
    front, cost, moves = ((stack, 0, 0),), 0, []
    for role, _, fault, times in rows:
        more, front, origin = step(front, role[:1], fault)
        cost += more + DELETE * (times - 1)
        moves.append((origin, times - 1))
    return cost, front, moves


def plan_of(moves: list, index: int) -> list[str]:
    """For each row what is done before it, to it and to its copies."""
    out = []
    for origin, copies in reversed(moves):
        index, plan = origin[index]
        out.append(plan + "D" * copies)
    return out[::-1]


def repaired(rows: list[Row], plans: list[str], last: str = "") -> Iterator[tuple[str, str]]:
    """(role, text) of each row of the repaired conversation."""
    for (role, text, _, _), plan in itertools.zip_longest(rows, [*plans, last][:len(rows) + bool(last)], fillvalue=("", "", 0, 0)):
        for op in plan:
            if op in "ua":
                yield ROLES[op], ""
            elif op in "UA":
                yield ROLES[op.lower()], text
            elif op == "K":
                yield role, text


# --- damage and faults, on built-in functions ---------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): each row after its damage; a dropped one has ``times`` 0. A missing role or text is one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(kind == EMPTIED, F.lit("")).when(kind == CUT, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    return conversations.select("conv_id", "turn", F.when(kind == USER, F.lit("user")).otherwise(shown("role")).alias("role"), text.alias("text"),
                                F.when(kind == DROPPED, 0).when(kind == REPEATED, 2).otherwise(1).cast("bigint").alias("times"))


def _ink(c: str) -> Column:
    return F.rtrim(F.col(c), F.lit("\t\n\x0b\x0c\r "))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with equal ones as one row (``times`` added up), a key of the conversation that is never null, and the row's first fault."""
    key = [F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("missing")]
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    one = materialize(one.select(*key, "turn", "role", "text", "times", F.xxhash64("role", "text").alias("h"), F.xxhash64("text", "role", F.lit(1)).alias("h2")), "turns")
    keys = ["conv", "missing", "h", "h2"]
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # nulls first
    seen = one.where("times > 0").groupBy(*keys).agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    out = lookup(one, seen.select(*keys, "first"), keys, "left", seen, "_rows", ["turn"])
    ink = _ink("text")
    again = F.col("first").isNotNull() & (turn > F.col("first"))
    fault = F.when(ink == "", BLANK).when(again, COPY).when(~F.substring(ink, -1, 1).isin(".", "!", "?"), CUT_SHORT).otherwise(FINE)
    return out.select("conv", "missing", "turn", "role", "text", "times", fault.alias("fault"))


# --- one piece of a conversation ----------------------------------------------------------------------------------------------------


class Tally:
    """What is counted over a conversation's rows in order; pieces of it add up."""

    def __init__(self, *given):
        self.blank = self.copies = self.cut = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None  # turns, and initials of the first and the last row
        if given:
            self.blank, self.copies, self.cut, self.illegal, self.turns, self.low, self.high, self.first, self.last = given

    def row(self, turn: int | None, role: str, fault: int, times: int) -> None:
        self.blank += times if fault == BLANK else 0
        self.copies += times if fault == COPY else times - 1 if fault != BLANK else 0
        self.cut += fault == CUT_SHORT
        initial = role[:1]
        self.illegal += (self.last is not None and self.last + initial not in LEGAL) + times - 1
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def add(self, o: Tally) -> None:
        """The piece ``o`` comes next."""
        self.blank, self.copies, self.cut = self.blank + o.blank, self.copies + o.copies, self.cut + o.cut
        self.illegal += o.illegal + (None not in (self.last, o.first) and self.last + o.first not in LEGAL)
        self.turns += o.turns - (o.low is not None and o.low == self.high)
        self.low, self.high = o.low if self.low is None else self.low, self.high if o.high is None else o.high
        self.first, self.last = o.first if self.first is None else self.first, self.last if o.last is None else o.last

    @property
    def state(self) -> list:
        return [self.blank, self.copies, self.cut, self.illegal, self.turns, self.low, self.high, self.first, self.last]

    @property
    def gaps(self) -> int:
        return min(self.high - self.low + 1 - self.turns, (1 << 63) - 1) if self.turns else 0

    @property
    def counts(self) -> list[int]:
        return [self.gaps, self.blank, self.copies, self.cut, self.illegal]


@lru_cache(None)
def stacks() -> tuple[tuple, ...]:
    """All stacks that can stand between two rows, in a fixed order."""
    found, todo = [START], [START]
    while todo:
        at = todo.pop(0)
        new = [to for s in "sua" if (to := shifted(at, s)) and to not in found]
        found += new
        todo += new
    return tuple(found)


def transfer(rows: list[Row]) -> list[list[int]]:
    """[stack before, stack after, cost, rank], stacks by their number: what the rows do to every stack."""
    number = {s: i for i, s in enumerate(stacks())}
    out = []
    for i, stack in enumerate(stacks()):
        cost, front, _ = parse(rows, stack)
        out += [[i, number[to], cost + c, rank] for to, c, rank in front]
    return out


def joined_path(tables: list[list[list[int]]]) -> tuple[int, list[int], list[int], str]:
    """The best way through the pieces: cost, the stack before each piece, the stack after it, and the inserts at the end."""
    live, back = {0: (0, (0,))}, []
    for table in tables:
        found: dict = {}
        for p, q, cost, rank in table:
            if p in live:
                new = (live[p][0] + cost, (live[p][1][0], rank), p)
                if q not in found or new < found[q]:
                    found[q] = new
        order = {r: i for i, r in enumerate(sorted({x[1] for x in found.values()}))}
        live = {q: (x[0], (order[x[1]],)) for q, x in found.items()}
        back.append({q: x[2] for q, x in found.items()})
    members = sorted(live, key=lambda q: live[q][1])
    cost, index, last = finish(tuple((stacks()[q], live[q][0], i) for i, q in enumerate(members)))
    after = [members[index]]
    for origin in reversed(back):
        after.append(origin[after[-1]])
    after.reverse()
    return cost, after[:-1], after[1:], last


# --- the Spark plan -----------------------------------------------------------------------------------------------------------------

_COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
_PIECE = ("conv bigint, missing boolean, " + _COUNTS + ", cost bigint, audit string, roles array<string>, texts array<string>, piece int, part int, "
          "tally array<string>, moves array<array<bigint>>, faults array<int>, times array<bigint>")


def _batch(rows: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string()),
             "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<array<bigint>>": pa.list_(pa.list_(pa.int64()))}
    fields = [pa.field(*(x.split()[0], kinds[x.split()[1]])) for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Neighbouring rows with the same first ``keys`` columns."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for key, members in itertools.groupby(rows, key=lambda r: r[:keys]):
        yield key, list(members)


def _flushed(records: Iterator[list], schema: str, size: int = 2048, weight: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The records in batches of bounded count and text."""
    out, heavy = [], 0
    for r in records:
        out.append(r)
        heavy += sum(len(x) for x in r if isinstance(x, str)) + sum(len(t) + 16 for x in r if isinstance(x, list) for t in x if isinstance(t, str))
        if len(out) >= size or heavy >= weight:
            yield _batch(out, schema)
            out, heavy = [], 0
    yield _batch(out, schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range: results for the conversations within, pieces for the first and the last one, which may go on outside."""
    piece = TaskContext.get().partitionId()

    def records() -> Iterator[list]:
        waiting, first = None, True
        for key, members in _groups(batches, 2):
            if waiting:
                yield from (edge if first else whole)(*waiting)
                first = False
            waiting = (key, members)
        if waiting:
            yield from edge(*waiting)

    def read(members: list[tuple]) -> tuple[list[Row], Tally]:
        rows, tally = [], Tally()
        for _, _, turn, role, text, times, fault in members:
            if times:
                rows.append((role, text, fault, times))
                tally.row(turn, role, fault, times)
        return rows, tally

    def whole(key: tuple, members: list[tuple]) -> Iterator[list]:
        rows, tally = read(members)
        cost, front, moves = parse(rows)
        more, index, last = finish(front)
        plans = plan_of(moves, index)
        turns = list(repaired(rows, plans, last))
        audit = ("".join(plans) + last).translate(_INITIAL)
        yield [*key, *tally.counts, cost + more, audit, [r for r, _ in turns], [t for _, t in turns], None, None, None, None, None, None]

    def edge(key: tuple, members: list[tuple]) -> Iterator[list]:
        rows, tally = read(members)
        state = [None if x is None else str(x) for x in tally.state]
        for part in range(max(1, -(-len(rows) // PART))):
            some = rows[part * PART:(part + 1) * PART]
            yield [*key, None, None, None, None, None, None, None, [r[0] for r in some], [r[1] for r in some], piece, part, None if part else state,
                   None if part else transfer(rows), [r[2] for r in some], [r[3] for r in some]]

    yield from _flushed(records(), _PIECE)


_CHOICE = "conv bigint, missing boolean, piece int, p int, q int, last string, n_pieces int, " + _COUNTS + ", cost bigint"


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the pieces' tables, sorted: the stacks before and after each piece on the best way through its conversation."""

    def records() -> Iterator[list]:
        for key, members in _groups(batches, 2):
            total = Tally()
            for m in members:
                s = m[3]
                total.add(Tally(*[None if x is None else int(x) for x in s[:7]], *s[7:]))
            cost, before, after, last = joined_path([m[4] for m in members])
            for i, m in enumerate(members):
                end = i == len(members) - 1
                yield [*key, m[2], before[i], after[i], last if end else "", len(members), *total.counts, cost]

    yield from _flushed(records(), _CHOICE)


_PART = "conv bigint, missing boolean, piece int, pieces int, " + _COUNTS + ", cost bigint, audit string, roles array<string>, texts array<string>"


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their choice, sorted: the audit and the repaired rows of each piece."""

    def records() -> Iterator[list]:
        for key, members in _groups(batches, 3):
            p, q, last, counts = members[0][4], members[0][5], members[0][6], members[0][7:14]
            rows = [r for m in members for r in zip(m[14], m[15], m[16], m[17])]
            _, front, moves = parse(rows, stacks()[p])
            plans = plan_of(moves, next(i for i, x in enumerate(front) if x[0] == stacks()[q]))
            turns = list(repaired(rows, plans, last))
            yield [*key, *counts, ("".join(plans) + last).translate(_INITIAL), [r for r, _ in turns], [t for _, t in turns]]

    yield from _flushed(records(), _PART)


def repair_pieces(conversations: DataFrame, times: str | None = None) -> DataFrame:
    """The repaired conversations of a table (conv_id, turn, role, text) as (conv_id, piece, pieces, gaps, blank, duplicate, truncated, illegal,
    cost, audit, roles, texts). Most conversations have one piece; one that crosses ranges has several, in the order of ``piece``, whose
    audits, roles and texts follow each other and whose counts are those of the whole conversation.

    Rows go by turn, missing turns first, then by role and text. A missing conv_id is a conversation of its own, a missing role or text one
    space. Repeated rows are rows. A role without an initial, or with one that the grammar lacks, can't be kept. The column named ``times``
    says how often a row stands (0: the conversation remains, the row is gone); without it each stands once. An empty table gives an empty one.
    """
    rows = conversations.select("conv_id", "turn", "role", "text", (F.col(times) if times else F.lit(1)).cast("bigint").alias("times"))
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")})
    rows = rows.withColumns({c: F.col(c).cast("bigint") for c in ("conv_id", "turn")})
    n = shuffle_partitions(rows.sparkSession)
    order = ["conv", "missing", F.col("turn").asc_nulls_first(), "role"]
    ranged = faults(rows).repartitionByRange(n, *order, F.substring("text", 1, PREFIX)).sortWithinPartitions(*order, "text")
    pieces = materialize(ranged.select("conv", "missing", "turn", "role", "text", "times", "fault").mapInArrow(_pieces, _PIECE), "pieces")
    inside = pieces.where("piece IS NULL").select("conv", "missing", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), *[x.split()[0] for x in _PART.split(", ")[4:]])
    edges = pieces.where("piece IS NOT NULL")  # at most two conversations for each range
    key = ["conv", "missing"]
    tables = edges.where("part = 0").select(*key, "piece", "tally", "moves").repartition(n, *key).sortWithinPartitions(*key, "piece")
    chosen = materialize(tables.mapInArrow(_choices, _CHOICE), "choices")
    met = chosen.join(edges.select(*key, "piece", "part", "roles", "texts", "faults", "times"), [*key, "piece"])
    met = met.select(*key, "piece", "part", "p", "q", "last", "n_pieces", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "roles", "texts", "faults", "times")
    mended = met.repartition(n, *key, "piece").sortWithinPartitions(*key, "piece", "part").mapInArrow(_mended, _PART)
    out = inside.unionByName(mended)
    return out.select(F.when(~F.col("missing"), F.col("conv")).alias("conv_id"), *out.columns[2:])


_DIGEST = "conv_id bigint, " + _COUNTS + ", cost bigint, audit string, repaired_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation, one at a time."""

    def records() -> Iterator[list]:
        current, begun = None, False
        for b in batches:
            for m in zip(*(c.to_pylist() for c in b.columns)):
                if current is None or current[0] != m[0]:
                    if current:
                        yield [*current[:7], "".join(current[7]), current[8].hexdigest()]
                    current, begun = [m[0], *m[2:8], [], hashlib.sha256()], False
                current[7].append(m[8])
                for role, text in zip(m[9], m[10]):
                    current[8].update((b"\n" if begun else b"") + f"{role}:{text}".encode())
                    begun = True
        if current:
            yield [*current[:7], "".join(current[7]), current[8].hexdigest()]

    yield from _flushed(records(), _DIGEST)


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation of ``repair_pieces``: its counts, cost, audit and the digest of its repaired text. A conversation in one piece
    is digested where it lies; the others' pieces pass through one task each, in order, one piece at a time."""
    one = F.sha2(F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n"), 256)
    columns = [x.split()[0] for x in _DIGEST.split(", ")]
    inside = pieces.where("pieces = 1").withColumn("repaired_sha256", one).select(*columns)
    across = pieces.where("pieces > 1").drop("pieces")
    across = across.repartition(shuffle_partitions(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "piece")
    return inside.unionByName(across.mapInArrow(_digests, _DIGEST))
