"""The repair of conversations against a search through all edits."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from geneloom.llm import turn_repair
from geneloom.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}  # the grammar as a plain automaton; 0 and 3 accept
NAMES = {"u": "user", "a": "assistant"}


def damage(row):
    conv, turn, role, text = row
    role, text = " " if role is None else role, " " if text is None else text
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if kind == 0:
        return []
    text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def cheapest(rows):
    """The least (cost, audit) and its result over all edits, by uniform-cost search."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if at == len(rows) and state in (0, 3):
            return cost, audit, out
        if (at, state) in done:
            continue
        done.add((at, state))
        for r, to in NEXT[state].items():
            if r in NAMES:
                heapq.heappush(heap, (cost + 3, audit + "I", at, to, (*out, f"{NAMES[r]}:")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, out))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                for r, to in NEXT[state].items():
                    if role[:1] == r:
                        heapq.heappush(heap, (cost + extra, audit + "K", at + 1, to, (*out, f"{role}:{text}")))
                    if r in NAMES:
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", at + 1, to, (*out, f"{NAMES[r]}:{text}")))


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        kept = sorted((x for r in rows if r[0] == conv for x in damage(r)), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, marked, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in kept:
            ink = text.rstrip(SPACE)
            fault = "blank" if not ink.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
            if fault:
                count[fault] += 1
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, lines = cheapest(marked)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def repair(df):
    return turn_repair.digests(turn_repair.repair_pieces(turn_repair.damaged(df), times="times"))


def table(spark, rows):
    rows = [(*r, "x", 7, 1) for r in rows]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, fault string, times bigint, missing int").repartition(3)


def conversation(rng, conv, n):
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "user", "assistant"]
    texts = ["Yes.", "No!", "cut", " ", "", None, "Why?\n", "more words.", "a", "b.", "été ?"]
    return [(conv, rng.choice([i, i, i, None, i + 2]), rng.choice(roles), rng.choice(texts)) for i in range(n)]


def test_repairs_equal_a_full_search(spark):
    rng = random.Random(3)
    rows = [r for c in range(250) for r in conversation(rng, c if c else None, rng.randrange(1, 9))]
    rows += [rows[5]] * 3
    assert found(repair(table(spark, rows))) == expected(rows)


def test_a_conversation_over_many_ranges_is_one(spark):
    rng = random.Random(5)
    rows = [r for c in range(6) for r in conversation(rng, c, 5)] + conversation(rng, 77, 700) + [(88, 1, "user", "Hi.")] * 40 + conversation(rng, None, 300)
    df = table(spark, rows)
    pieces = turn_repair.repair_pieces(turn_repair.damaged(df), times="times")
    assert pieces.where("conv_id = 77").agg(F.max("pieces")).first()[0] > 1
    assert found(turn_repair.digests(pieces)) == expected(rows)


def test_a_very_long_text_and_its_copies(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", "word " * 100_000 + ".") for t in range(4)] + [(1, 9, "assistant", " " * 300_000)]
    assert found(repair(table(spark, rows))) == expected(rows)


def test_an_empty_table_and_a_conversation_without_rows(spark):
    assert found(repair(table(spark, []))) == {}
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert found(repair(table(spark, [(5, gone, "user", "Hello.")]))) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("size", [1, 2, 7])
def test_pieces_compose_to_the_whole(size):
    rng = random.Random(size)
    for _ in range(40):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), "t", rng.choice([0, 0, 0, 1, 3]), rng.choice([1, 1, 1, 2])) for _ in range(rng.randrange(1, 30))]
        cost, front, moves = turn_repair.parse(rows)
        more, index, last = turn_repair.finish(front)
        cut = [rows[i:i + size] for i in range(0, len(rows), size)]
        total, before, after, end = turn_repair.joined_path([turn_repair.transfer(c) for c in cut])
        plans = []
        for c, p, q in zip(cut, before, after):
            _, f, m = turn_repair.parse(c, turn_repair.stacks()[p])
            plans += turn_repair.plan_of(m, next(i for i, x in enumerate(f) if x[0] == turn_repair.stacks()[q]))
        assert (total, plans, end) == (cost + more, turn_repair.plan_of(moves, index), last)


def test_the_query_on_its_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op13_turn_repair"](spark, "/root/testdata/sf0.001")) == expected(rows)
