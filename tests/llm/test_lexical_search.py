"""Ranked search against plain scoring of every pair."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from geneloom.llm import lexical_search as ls
from geneloom.llm.lexical_search import Search, Sparse, Tree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, top=10):
    bags = [(d, Counter(bag(t))) for d, t in docs if bag(t)]
    n_docs, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, b in bags:
            m = 100 - 75 + (75 * b.total() * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t in bag(text) if b[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def found(spark, frame, docs, items):
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id bigint, text string, rank int").repartition(2)
    return sorted((tuple(r) for r in ls.search(frame(docs), q).collect()), key=str)


def test_scores_and_ranks_equal_plain_ones(spark, frame, texts):
    items = [(i, " ".join(bag(texts[i * 7][1])[:25])) for i in range(12)] + [(50, texts[3][1]), (51, "Nowhere-word zzzqqq"), (52, ""), (53, None)]
    docs = [*texts, (7, "x"), (None, texts[0][1]), (None, None), (8, ""), (9, " .,;"), texts[1], texts[1], (3, texts[5][1])]
    assert found(spark, frame, docs, items) == expected(docs, items)


def test_ties_copies_and_repeated_items(spark, frame):
    docs = [(i, "alpha beta ÄÖ été 42") for i in range(40, 0, -1)] + [(100, "alpha"), (101, "Gamma GAMMA"), (None, "alpha beta ÄÖ été 42")]
    items = [(1, "ALPHA beta"), (1, "ALPHA beta"), (2, "gamma alpha alpha"), (3, "ÄÖ"), (None, "42")]
    assert found(spark, frame, docs, items) == expected(docs, items)


def test_a_very_long_text_is_read_whole(spark, frame):
    docs = [(1, "w " * 300_000 + "needle"), (2, "needle"), (3, "w")]
    items = [(1, "needle"), (2, "w " * 50_000 + "needle")]
    assert found(spark, frame, docs, items) == expected(docs, items)


def test_empty_tables(spark, frame):
    assert found(spark, frame, [], [(1, "a")]) == [] == found(spark, frame, [(1, "a")], []) == found(spark, frame, [(1, None)], [(1, "a")])


def test_blocks_of_items_give_the_same(spark, frame, texts, monkeypatch):
    items = [(i, " ".join(bag(texts[i][1])[:20])) for i in range(30)]
    monkeypatch.setattr(ls, "BLOCK_TERMS", 150)
    assert found(spark, frame, texts, items) == expected(texts, items)


def _random(rng, n, terms, low, high):
    rows = [np.sort(rng.choice(terms, rng.integers(low, high), replace=False)) for _ in range(n)]
    start = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    term = np.concatenate(rows).astype(np.int64)
    return Sparse(start, term, rng.integers(1, 1000, len(term)))


@pytest.mark.parametrize("seed", range(6))
def test_trees_bound_and_prune_without_loss(seed):
    rng = np.random.default_rng(seed)
    docs, items = _random(rng, 700, 300, 1, 12), _random(rng, 33, 300, 1, 8)
    plain = np.zeros((33, 700), np.int64)
    for i in range(33):
        q = np.zeros(300, np.int64)
        q[items.term[items.start[i]:items.start[i + 1]]] = items.value[items.start[i]:items.start[i + 1]]
        plain[i] = docs.dots(np.arange(700), q)
    tree = Tree(docs, np.ones(300, np.int64), 4)
    for level in range(1, len(tree.levels)):
        down, up, group = tree.levels[level - 1], tree.levels[level], tree.group[level]
        for r in range(down.rows):
            own = dict(zip(up.term[up.start[r // group]:up.start[r // group + 1]], up.value[up.start[r // group]:up.start[r // group + 1]]))
            assert all(own[t] >= v for t, v in zip(down.term[down.start[r]:down.start[r + 1]], down.value[down.start[r]:down.start[r + 1]]))
    s = Search(items, 300, np.zeros(33, np.int64))
    for at in range(0, 700, 350):
        s.add(docs.take(np.arange(at, at + 350)), np.arange(at, at + 350), np.zeros(350, bool), np.ones(300, np.int64))
    for i in range(33):
        order = np.lexsort((np.arange(700), -plain[i]))[:10]
        order = order[plain[i][order] > 0]
        assert list(zip(s.score[i], s.doc[i])) == list(zip(plain[i][order], order))
    assert s.scored < 33 * 700 * 0.7  # the bounds do drop pairs
    scored, high = s.scored, Search(items, 300, np.full(33, 1 << 40))
    high.add(docs, np.arange(700), np.zeros(700, bool), np.ones(300, np.int64))
    assert high.scored == 0 and high.pairs <= 1 < scored  # a whole batch goes at the roots
