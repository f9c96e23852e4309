import random
import re

import corpus_pipeline
import numpy as np
from geneloom.llm import ngram_join, queries
from geneloom.llm.text import holding, materialize

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text):
    w = tuple(re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)))
    return {w[i:i + 4] for i in range(len(w) - 3)} if len(w) >= 4 else {w} if w else set()


def brute_force(rows):
    """[(id, size, smallest id of the component)] for rows with distinct ids."""
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(k, least.get(root(i), k))
    return sorted((k, len(sets[i]), least[root(i)]) for i, (k, _) in enumerate(rows))


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def near_copies(rng, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_query_equals_brute_force(spark, texts):
    assert result(queries.op7_ngram_join(spark, "/root/testdata/sf0.001")) == brute_force(texts)


def test_groups_of_near_copies(spark, frame, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "STAR_WIDTH", 5)
    rng = random.Random(5)
    common = [f"common{i}" for i in range(30)]
    texts = near_copies(rng, [f"a{i}" for i in range(90)], 60, 9) + near_copies(rng, common + [f"b{i}" for i in range(60)], 25, 6)
    texts += [" ".join(common + [f"own{k}x{i}" for i in range(40)]) for k in range(20)]
    texts += ["same text of six words here"] * 9 + ["Same  Text\tof six words HERE", "one two three", "ONE two\nthree", "one two", "", None, " \n", "x " * 3000, "x " * 4000]
    rng.shuffle(texts)
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    assert result(ngram_join.link_components(frame(rows)).drop("key")) == brute_force(rows)


def test_without_stars_nothing_is_lost(spark, frame, monkeypatch):
    rng = random.Random(6)
    rows = list(enumerate(near_copies(rng, [f"a{i}" for i in range(120)], 40, 7)))
    expected = brute_force(rows)
    for stars, longest in ((0, 1), (0, 6), (1, 3)):
        monkeypatch.setattr(ngram_join, "STARS", stars)
        monkeypatch.setattr(ngram_join, "LONGEST", longest)
        assert result(ngram_join.link_components(frame(rows)).drop("key")) == expected


def test_bands_and_blocks_lose_no_link(spark, frame, monkeypatch):
    monkeypatch.setattr(ngram_join, "STARS", 0)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rng = random.Random(8)
    texts = []
    for group in range(3):  # sets of all sizes from 60 to 140, each a part of the next: links at the very limit of sizes
        words = [f"g{group}w{i}" for i in range(143)]
        texts += [" ".join(words[:n]) for n in rng.sample(range(63, 144), 25)]
    rows = list(enumerate(texts))
    assert result(ngram_join.link_components(frame(rows)).drop("key")) == brute_force(rows)


def test_only_sets_of_possible_pairs_are_written(spark, frame, monkeypatch):
    written = []

    def counted(df, label="step"):
        out = materialize(df, label)
        written.extend([out.count()] if label == "sets" else [])
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    part = lambda k: " ".join(f"p{k}w{i}" for i in range(20))
    texts = [f"{part(k)} {part(k + 1)}" for k in range(40)]  # each shares 17 of 37 shingles with the next one
    rows = list(enumerate([*texts, f"{part(50)} {part(51)}", f"{part(50)} {part(51)} more"]))
    assert result(ngram_join.link_components(frame(rows)).drop("key")) == brute_force(rows)
    assert 2 <= sum(written) <= 6


def test_near_copies_meet_at_their_centre(spark, frame, monkeypatch):
    pairs = []

    def counted(df, label="step"):
        out = materialize(df, label)
        pairs.extend([out.count()] if label == "pairs" else [])
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    rows = list(enumerate(near_copies(random.Random(9), [f"a{i}" for i in range(150)], 500, 12)))
    assert result(ngram_join.link_components(frame(rows)).drop("key")) == brute_force(rows)
    assert len(pairs) == ngram_join.STARS + 1 and pairs[-1] < 100  # the star rounds leave few pairs to the full candidate join


def test_rows_that_may_be_held_lose_none(spark):
    ids = spark.range(0, 3000, 3)
    got = {r.id for r in holding(spark.range(3000).union(spark.sql("select cast(null as bigint)")), ids, "id").collect()}
    assert got >= set(range(0, 3000, 3)) and None not in got and len(got) < 1300
    assert holding(spark.range(50), ids.where("id < 0"), "id").count() == 0


def test_signatures_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 700, 5000):
        x = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        y = np.unique(np.concatenate([x[n // 5:], rng.integers(0, 1 << 64, n // 7, np.uint64)]))
        apart = sum(bin(int(v)).count("1") for v in (ngram_join.signature(x) ^ ngram_join.signature(y)).view(np.uint64))
        assert apart <= len(np.setxor1d(x, y)) and (apart == 0 or n > 0)


def test_odd_tables(spark, frame):
    assert ngram_join.link_components(frame([])).count() == 0
    got = ngram_join.link_components(frame([(None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (5, None), (5, None), (6, "q"), (6, "r s t u v")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("4", "4"), ("5", "5"), ("5", "5"), ("6", "6"), ("6", "6"), ("None", "4"), ("None", "4")]


def test_one_of_each_group_stays(spark, frame):
    kept = ngram_join.keep_one(frame([(3, "a b c d e f"), (1, "A b c d e f"), (2, "other words stand in here"), (9, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 9]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "key"]


def test_one_row_of_each_group_stays_with_odd_ids(spark, frame):
    a, b, c, d = ("one two three four five six", "other words that stand in here", "a third text of its own", "the fourth of these texts here")
    rows = [(3, a), (6, a), (6, b), (None, a), (None, c), (None, ""), (None, None), (None, d), (None, d), (None, d.upper()), (8, "x y z x y z"), (8, "x y z x y z"), (9, None), (9, None)]
    for keep in (ngram_join.keep_one, lambda docs: corpus_pipeline.deduplicate_documents(spark, docs, "")):
        got = sorted(((r.doc_id, (r.text or "").lower()) for r in keep(frame(rows)).collect()), key=str)
        assert got == sorted([(3, a), (6, b), (None, c), (None, ""), (None, ""), (None, d), (8, "x y z x y z"), (9, ""), (9, "")], key=str)
    assert [r.text for r in ngram_join.keep_one(frame([(None, a), (1, a)])).collect()] == [a]
    assert ngram_join.keep_one(frame([])).count() == 0
