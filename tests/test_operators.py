"""Operators on hand-checked fixtures, on both the broadcast and the salted path."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from geneloom.functions import ids
from geneloom.operators import features, graph, inference, linalg, mapping, quality, ranges, reshape, skew, vectors
from geneloom.models.specs import SPECS, InferenceSpec
from geneloom.models.stub import LetterModel, WordHashModel


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def entrez_index(master):
    return mapping.id_index(mapping.id_pairs(master, "ensembl_gene_id", [ids.split_tokens("map_entrez_ids_all")]))


def test_unique_index_excludes_ambiguous(spark, master):
    src = spark.createDataFrame([("1",), ("2",), ("20",), ("99",), ("",)], "k string")
    routed = mapping.route(src, "k", entrez_index(master))
    assert rows(routed, "k", "gene", "status") == sorted([("1", "ENSG1", "mapped"), ("2", "ENSG2", "mapped"), ("20", None, "ambiguous"),
                                                          ("99", None, "unmapped"), ("", None, "excluded")], key=lambda x: x[0])
    assert sum(r[1] for r in rows(mapping.status_counts(routed))) == 5


def test_routing_on_the_salted_path(spark, master, no_broadcast):
    src = spark.createDataFrame([(i, "1" if i % 3 else str(i)) for i in range(300)], "i int, k string")
    got = mapping.route(src, "k", entrez_index(master))
    assert got.count() == 300
    assert got.where("k = '1' AND gene = 'ENSG1'").count() == 200


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame([(i, i % 7 if i % 2 else 0) for i in range(500)], "i int, k int")
    right = spark.createDataFrame([(k, f"v{k}{j}") for k in range(6) for j in range(2)], "k int, v string")
    hot = skew.hot_keys(skew.key_frequency(left, ["k"]), ["k"], "_rows", 2)
    for how in ("inner", "left"):
        shown = F.coalesce("v", F.lit("-")).alias("v")
        assert rows(skew.salted_join(left, right, ["k"], hot, how), "i", "k", shown) == rows(left.join(right, ["k"], how), "i", "k", shown)


def test_tiers_fall_through_and_stop(spark):
    cur = spark.createDataFrame([("AAA", "G1"), ("BBB", "G2"), ("BBB", "G4")], "id string, gene string")
    prev = spark.createDataFrame([("AAA", "G3"), ("BBB", "G2")], "id string, gene string")
    alias = spark.createDataFrame([("X", "G1"), ("X", "G2"), ("Y", "G2")], "id string, gene string")
    src = spark.createDataFrame([("AAA",), ("BBB",), ("X",), ("Y",), ("Q",)], "k string")
    tiers = [("current", cur), ("previous", prev), ("alias", alias)]
    through = {r["k"]: (r["gene"], r["method"], r["status"]) for r in mapping.resolve_tiers(src, "k", tiers, False).collect()}
    assert through == {"AAA": ("G1", "current", "mapped"), "BBB": ("G2", "previous", "mapped"), "X": (None, None, "ambiguous"),
                       "Y": ("G2", "alias", "mapped"), "Q": (None, None, "unmapped")}
    stop = {r["k"]: (r["gene"], r["status"]) for r in mapping.resolve_tiers(src, "k", tiers, True).collect()}
    assert stop["BBB"] == (None, "ambiguous") and stop["AAA"] == ("G1", "mapped") and stop["Y"] == ("G2", "mapped")


def test_reconcile_rules(spark):
    df = spark.createDataFrame([("5", ["5"], ["6"]), ("5", ["6"], []), ("", ["6"], []), ("", ["6"], ["7"]), ("", [], []), ("5", [], [])],
                               "c string, a array<string>, b array<string>")
    one = [tuple(r[0]) for r in df.select(mapping.reconcile(F.col("c"), F.col("a"), F.col("b"), False)).collect()]
    assert one == [("5", "agreement", ""), ("5", "conflict", "current=5; external=6"), ("6", "filled_from_external", ""),
                   ("", "missing_ambiguous_external", "external=6;7"), ("", "still_missing", ""), ("5", "current_only_no_external_mapping", "")]
    many = [tuple(r[0])[:2] for r in df.select(mapping.reconcile(F.col("c"), F.col("a"), F.col("b"), True)).collect()]
    assert many[3] == ("6;7", "filled_from_external")


def test_one_to_one_join_refuses_duplicates(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        mapping.one_to_one_join(a, b, "k")


def test_best_method_keeps_unused_count(spark):
    df = spark.createDataFrame([("g", 1, [1.0]), ("g", 1, [3.0]), ("g", 2, [9.0]), ("h", 2, [5.0])], "gene string, tier int, v array<double>")
    assert rows(mapping.best_method_mean(df, "gene", "tier", "v"), "gene", "tier", "vector", "n_unused_rows") == [("g", 1, [2.0], 1), ("h", 2, [5.0], 0)]


def test_vector_mean_is_order_free(spark):
    df = spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0]), ("b", [0.0, 0.0])], "k string, v array<double>")
    want = [("a", [2.0, 4.0], 2), ("b", [0.0, 0.0], 1)]
    assert rows(vectors.vector_mean(df, ["k"], "v")) == rows(vectors.vector_mean(df.orderBy(F.desc("v")), ["k"], "v")) == sorted(
        (k, v, n) for k, v, n in want)


def test_zscore_population_and_constant(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "i int, v array<double>")
    assert rows(vectors.zscore(df, "v")) == [(1, [-1.0, 0.0]), (2, [1.0, 0.0])]


def test_imputation(spark):
    df = spark.createDataFrame([(1, [1.0, None]), (2, [float("nan"), None]), (3, [3.0, float("inf")])], "i int, v array<double>")
    assert rows(vectors.impute_column_mean(df, "v")) == [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [3.0, 0.0])]


def test_tfidf_example(spark):
    tf = spark.createDataFrame([("r1", "t1", 1.0), ("r1", "t2", 1.0), ("r2", "t1", 1.0)], "row string, col string, value double")
    got = {(r["row"], r["col"]): round(r["value"], 6) for r in features.tfidf(tf, "row", "col").collect()}
    assert got == {("r1", "t1"): 0.579739, ("r1", "t2"): 0.814802, ("r2", "t1"): 1.0}


def test_tfidf_salted_path(spark, no_broadcast):
    test_tfidf_example(spark)


def test_ppmi_example(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "s string, d string, w double")
    got = {(r["row"], r["col"]): round(r["value"], 6) for r in graph.ppmi(graph.symmetric_adjacency(e, "s", "d", "w")).collect()}
    assert got == {k: 0.693147 for k in (("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"))}


def test_xor_edges(spark):
    e = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "x boolean, y boolean")
    assert tuple(features.edge_class_counts(e, F.col("x"), F.col("y")).first()) == (4, 2, 1, 1)


def test_closure_with_diamond_and_idempotence(spark):
    p = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "D"), ("D", "C")], "child string, parent string")
    got = rows(graph.closure(p))
    assert got == [("A", "B"), ("A", "C"), ("A", "D"), ("B", "C"), ("D", "C")]
    again = spark.createDataFrame(got, "child string, parent string")
    assert rows(graph.closure(again)) == got


def test_closure_on_the_salted_path(spark, no_broadcast):
    test_closure_with_diamond_and_idempotence(spark)


def test_null_keys_survive_a_salted_left_join(spark):
    left = spark.createDataFrame([(i, None if i % 2 else i % 5) for i in range(100)], "i int, k int")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(5)], "k int, v string")
    hot = skew.hot_keys(skew.key_frequency(left, ["k"]), ["k"], "_rows", 3)
    got = skew.salted_join(left, right, ["k"], hot, "left")
    assert got.count() == 100 and got.where("v IS NULL").count() == 50


def test_channels_keep_first_score(spark):
    links = spark.createDataFrame([("a", "b", 200, 100, 1), ("b", "a", 900, 300, 2), ("a", "a", 999, 999, 3)], "p string, q string, x int, y int, o int")
    assert rows(graph.channel_edges(links, "p", "q", ["x", "y"], "o", 150)) == [("x", "a", "b", 200), ("y", "b", "a", 300)]
    plan = graph.channel_edges(links, "p", "q", ["x", "y"], "o", 150)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_walk_steps_are_uniform(spark):
    pairs = graph.neighbour_pairs(spark.createDataFrame([("hub", f"n{i}") for i in range(8)] + [("n0", "n1")], "s string, d string"), "s", "d")
    walks = [r["walk"] for r in graph.random_walks(pairs, 60, 25, block=4).collect()]
    assert len(walks) == 9 * 60 and len({tuple(w) for w in walks}) > 500 and all(len(w) == 25 for w in walks)
    seen = {}
    for w in walks:
        for x, y in zip(w, w[1:]):
            seen.setdefault(x, {}).setdefault(y, 0)
            seen[x][y] += 1
    for x, n in seen.items():  # every neighbour is met, about equally often
        assert len(n) == (8 if x == "hub" else 2 if x in ("n0", "n1") else 1)
        mean = sum(n.values()) / len(n)
        assert sum((c - mean) ** 2 / mean for c in n.values()) < 30


@pytest.mark.parametrize("joins", ["broadcast", "shuffle"])
def test_closure_of_chains_cycles_and_hubs(spark, joins, request):
    if joins == "shuffle":
        request.getfixturevalue("no_broadcast")
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 20) for i in range(30)] + [(200, 201), (201, 202), (202, 200)] + [(0, 1)]
    want, onward = set(), {}
    for a, b in edges:
        onward.setdefault(a, set()).add(b)
    for a in onward:
        todo, done = list(onward[a]), set()
        while todo:
            x = todo.pop()
            if x not in done:
                done.add(x)
                todo += onward.get(x, ())
        want |= {(a, x) for x in done}
    got = [tuple(r) for r in graph.closure(spark.createDataFrame(edges, "child int, parent int")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_window_pairs_lose_none_at_chunk_cuts(spark):
    rng = np.random.default_rng(1)
    sentences = [[f"w{x}" for x in rng.integers(0, 9, n)] for n in (0, 1, 2, 63, 64, 65, 75, 300)]
    want = {}
    for s in sentences:
        for i in range(len(s)):
            for d in range(1, 5):
                if i + d < len(s):
                    for k in ((s[i], s[i + d]), (s[i + d], s[i])):
                        want[k] = want.get(k, 0) + (4 - d + 1) / 4
    df = spark.createDataFrame([(s,) for s in sentences], "t array<string>")
    got = {(r["row"], r["col"]): r["value"] for r in graph.window_pairs(df, "t", 4).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_skip_gram_ranks_planted_neighbours_first(spark):
    rng = np.random.default_rng(2)
    groups = [[f"{g}{i}" for i in range(5)] for g in "abcdefghij"]
    sentences = [[groups[k][i] for i in rng.integers(0, 5, 12)] for k in rng.integers(0, 10, 300)] + [["lonely"]]
    df = spark.createDataFrame([(s,) for s in sentences], "t array<string>")
    v = {r["word"]: np.array(r["vector"]) for r in graph.skip_gram(df, "t", 10, 3).collect()}
    assert not v.pop("lonely").any() and len(v) == 50
    unit = {w: x / np.linalg.norm(x) for w, x in v.items()}
    for w, x in unit.items():
        near = sorted((o for o in unit if o != w), key=lambda o: -(x @ unit[o]))[:4]
        assert {o[0] for o in near} == {w[0]}


def test_walks_follow_edges_and_repeat(spark):
    pairs = graph.neighbour_pairs(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("e", "e")], "s string, d string"), "s", "d")
    edges = {tuple(r) for r in pairs.collect()}
    first = {(r["node"], r["round"]): r["walk"] for r in graph.random_walks(pairs, 3, 7).collect()}
    assert len(first) == 12 and all(len(w) == 7 for w in first.values())
    assert all((w[i], w[i + 1]) in edges for w in first.values() for i in range(6))
    assert first == {(r["node"], r["round"]): r["walk"] for r in graph.random_walks(pairs.repartition(3), 3, 7).collect()}


def test_row_index_neighbours_and_sums(spark):
    df = spark.range(200).select((F.col("id") * 37 % 200).alias("x"), (F.col("id") % 3).alias("g"))
    got = rows(ranges.with_row_index(df, ["x"], "n", 5), "x", "n")
    assert got == [(i, i) for i in range(200)]
    sums = {r["x"]: r["s"] for r in ranges.running_sum(df, ["x"], "x", "s", 5).collect()}
    assert all(sums[i] == i * (i + 1) // 2 for i in range(200))
    near = ranges.with_neighbours(df, ["g"], ["x"], ["x"], buckets=5).collect()
    by_group = {}
    for r in near:
        by_group.setdefault(r["g"], []).append(r["x"])
    for r in near:
        order = sorted(by_group[r["g"]])
        i = order.index(r["x"])
        assert r["prev_x"] == (order[i - 1] if i else None)
        assert r["next_x"] == (order[i + 1] if i + 1 < len(order) else None)


@pytest.mark.parametrize("data", [[3], [1, 2], [5, 1, 1, 9], [2, 2, 2, 7, 8]])
def test_exact_median(spark, data):
    df = spark.createDataFrame([(float(x),) for x in data], "v double")
    assert ranges.exact_median(df, "v").first()[0] == float(np.median(data))


def test_segments(spark):
    df = spark.range(10).select(F.col("id").alias("k"))
    off = spark.createDataFrame([(2,), (5,)], "s bigint")
    assert rows(reshape.segment_of(df, "k", off, "s"), "k", "s") == [(k, 2 if k < 5 else 5) for k in range(2, 10)]


def sparse_matrix(seed=0, shape=(60, 40), density=0.2):
    rng = np.random.default_rng(seed)
    return rng.random(shape) * (rng.random(shape) < density)


def coordinates(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*a.nonzero())], "r int, c int, v double")


@pytest.mark.parametrize("basis, shape, k", [(256, (60, 40), 3), (6, (90, 60), 4), (256, (1, 1), 3)])
def test_truncated_svd_matches_numpy(spark, basis, shape, k, monkeypatch):
    monkeypatch.setattr(linalg, "BASIS_WIDTH", basis)  # a small basis restarts, a large one closes
    a = sparse_matrix(shape=shape, density=0.2 if min(shape) > 1 else 2)
    f = linalg.truncated_svd(coordinates(spark, a), "r", "c", "v", k, tolerance=1e-9)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    k = min(k, len(s))
    assert np.allclose(f.singular_values, s[:k], rtol=1e-8)
    v = vt[:k].T
    v = v * np.sign(v[np.abs(v).argmax(axis=0), range(k)])
    got = np.zeros((shape[0], k))
    for r in f.scores.collect():
        got[r["row"]] = r["vector"]
    assert np.allclose(got, a @ v, atol=1e-5)
    loads = np.array([r["vector"] for r in f.loadings.collect()])
    assert np.allclose(loads.T @ loads, np.eye(k), atol=1e-10)
    assert (f.residuals <= 1e-9).all()
    proof = linalg.svd_proof(coordinates(spark, a), "r", "c", "v", f).collect()
    assert len(proof) == k and all(r["residual"] < 1e-7 and r["off_unit"] < 1e-9 and r["off_scores"] < 1e-9 and r["top_loading"] > 0 for r in proof)


def test_svd_of_a_matrix_of_low_rank_and_of_equal_values(spark):
    low = np.outer(np.arange(1.0, 31), np.arange(1.0, 21))
    f = linalg.truncated_svd(coordinates(spark, low), "r", "c", "v", 4)
    assert np.allclose(f.singular_values[0], np.linalg.norm(low)) and np.allclose(f.singular_values[1:], 0, atol=1e-6 * f.singular_values[0])
    f = linalg.truncated_svd(coordinates(spark, np.eye(12)), "r", "c", "v", 5)
    assert np.allclose(f.singular_values, 1)


def test_a_wrong_factorisation_fails_its_proof(spark):
    a = sparse_matrix()
    f = linalg.truncated_svd(coordinates(spark, a), "r", "c", "v", 3, tolerance=1e-9)
    f.loadings = f.loadings.withColumn("vector", F.transform("vector", lambda x: x * 1.001))
    assert all(r["off_unit"] > 1e-4 and r["off_scores"] > 1e-5 for r in linalg.svd_proof(coordinates(spark, a), "r", "c", "v", f).collect())


def test_r_factors_reduce_in_a_tree(spark):
    x = np.random.default_rng(4).standard_normal((300, 5)) @ np.diag([1e6, 1e3, 1, 1e-3, 1e-6])
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>").repartition(40)
    r = linalg._r_factor(df, lambda b: linalg._matrix(b.column(0)))
    assert np.allclose(np.abs(np.diag(r)), np.abs(np.diag(np.linalg.qr(x, mode="r"))), rtol=1e-8)  # a Gram matrix would lose the small ones


def test_svd_refuses_negative_values(spark):
    with pytest.raises(ValueError):
        linalg.truncated_svd(spark.createDataFrame([(1, 1, -1.0)], "r int, c int, v double"), "r", "c", "v", 1)


@pytest.mark.parametrize("basis", [256, 5])
def test_pca_matches_numpy(spark, basis, monkeypatch):
    monkeypatch.setattr(linalg, "BASIS_WIDTH", basis)
    x = np.random.default_rng(1).standard_normal((80, 12)) @ np.diag(np.arange(12, 0, -1))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>")
    f = linalg.dense_factorisation(df, "i", "v", 4, centre=True, oversample=1 if basis == 5 else 10)
    xc = x - x.mean(0)
    s = np.linalg.svd(xc, compute_uv=False)
    assert np.allclose(f.singular_values, s[:4], rtol=1e-5)
    assert np.allclose(f.explained_variance_ratio, s[:4] ** 2 / (s ** 2).sum(), rtol=1e-5)
    t = np.array([r["v"] for r in f.scores.orderBy("i").collect()])
    assert np.allclose((t ** 2).sum(0), s[:4] ** 2, rtol=1e-5)


def test_dense_layer(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "i int, v array<float>")
    w = np.array([[1, 0], [0, 1], [1, 1]], np.float32)
    y = linalg.dense_layer(df, ["i"], "v", w, np.zeros(3, np.float32), np.ones(3, np.float32), np.zeros(3, np.float32)).first()["v"]
    h = np.array([1, 2, 3.0])
    assert np.allclose(y, (h - h.mean()) / np.sqrt(h.var() + 1e-5), atol=1e-5)


def test_gate_flags(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.0, 1.0]), ("c", [float("nan"), 2.0])], "k string, v array<double>")
    row = quality.gate(df, "k", "v", quality.GATE_STRICT).first()
    assert (row["n_rows"], row["n_nan"], row["n_zero_vectors"], row["n_duplicate_keys"], row["n_duplicate_vectors"]) == (4, 1, 1, 1, 1)
    assert row["status"] == quality.CHECK
    clean = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 1.0])], "k string, v array<double>")
    assert quality.gate(clean, "k", "v", quality.GATE_STRICT).first()["status"] == quality.PASSED


def test_inference_pooling_and_failures(spark):
    df = spark.createDataFrame([("a", "ACGTA" * 500), ("b", "CC"), ("c", "")], "k string, s string")
    for name in ("nucleotide_transformer", "dna_bert2", "rna_fm", "msa_transformer", "orthrus", "hyena_dna"):
        got = {r["k"]: r["vector"] for r in inference.embed(df, "k", "s", SPECS[name], LetterModel).collect()}
        assert set(got) == {"a", "b"} and np.allclose(got["a"], [0.4, 0.2, 0.2, 0.2]) and np.allclose(got["b"], [0, 1, 0, 0]), name


def test_memory_backoff_and_isolation(spark):
    class Hungry(LetterModel):
        def tokens(self, piece):
            if len(piece) > 100:
                raise RuntimeError("CUDA out of memory")
            if "N" in piece:
                raise ValueError("bad letter")
            return LetterModel.tokens(self, piece)

    spec = InferenceSpec("m", "fixed", size=1000, min_piece=10)
    df = spark.createDataFrame([("a", "ACGT" * 300), ("b", "ACNG")], "k string, s string")
    done = inference.embed_pieces(inference.cut(df, "k", "s", spec), "k", spec, Hungry, retries=2)
    assert {r["k"]: r["vector"] for r in inference.pool(done, "k", spec).collect()} == {"a": [0.25] * 4}
    assert rows(inference.failures(done, "k"), "k", "n_failed") == [("b", 1)]


def test_token_halving():
    parts = inference.halve_to_limit("A" * 1600, lambda p: len(p) + 2, 512)
    assert sum(map(len, parts)) == 1600 and max(map(len, parts)) <= 510
    with pytest.raises(ValueError):
        inference.halve_to_limit("A" * 90, lambda p: 1000, 512)


def test_walks_leave_no_edge_table_behind(spark):
    from pathlib import Path

    from geneloom.session import scratch_root

    pairs = graph.neighbour_pairs(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "x string, y string"), "x", "y")
    left = lambda: {p.name for p in Path(scratch_root(spark)).glob("geneloom-slots-*")}
    before = left()
    walks = graph.random_walks(pairs, 2, 9, block=4)
    assert left() == before and sorted(walks.schema.names) == ["node", "round", "walk", "walk_id"]
    assert sorted((r["node"], r["round"], len(r["walk"]), r["walk"][0]) for r in walks.collect()) == [(n, i, 9, n) for n in "abc" for i in (0, 1)]


def test_closure_round_joins_one_middle_term_per_path(spark):
    """A round used to join all pairs found last, so a long chain met each of its pairs many times."""
    import geneloom.operators.graph as g

    seen, plain = [], g.spread_join

    def counted(left, right, *rest):
        out = plain(left, right, *rest)
        seen.append(out.count())
        return out

    g.spread_join = counted
    try:
        n = graph.closure(spark.range(63).selectExpr("id AS child", "id + 1 AS parent")).count()
    finally:
        g.spread_join = plain
    assert n == 64 * 63 // 2 and sum(seen) < 2 * n


def test_svd_packs_hot_keys_and_stops_once_the_residual_is_small(spark, monkeypatch):
    calls, plain = [], linalg._SparseSpace.extend
    monkeypatch.setattr(linalg, "CELLS", 4)
    monkeypatch.setattr(linalg, "PRODUCTS", 8)
    monkeypatch.setattr(linalg._SparseSpace, "extend", lambda self, *a: calls.append(1) or plain(self, *a))
    a = np.random.default_rng(1).random((40, 30)) * 0.01 + 1.0
    cells = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(40) for j in range(30)], "r int, c int, v double")
    f = linalg.truncated_svd(cells, "r", "c", "v", 1, oversample=1)
    want = np.linalg.svd(a)
    got = np.array([x["vector"][0] for x in f.scores.orderBy("row").collect()])
    assert abs(f.singular_values[0] / want[1][0] - 1) < 1e-9 and np.allclose(got, np.abs(want[0][:, 0]) * want[1][0], atol=1e-4)
    assert len(calls) < 5  # a basis used to be filled to its last block


def test_conflict_candidates_shuffle_no_pairs(spark, no_broadcast, monkeypatch):
    """A key that many sources and many genes share gives the product of both; only keys may be shuffled, also for owners of many keys."""
    ev = [("m", "hot", g) for g in range(120)] + [("n", f"own{g % 50}", g) for g in range(120)] + [("m", "hot", 7), ("n", "hot", None), ("m", "hot", None)]
    src = [(s, [("m", "hot"), ("n", f"own{s}"), ("n", "")]) for s in range(40)] + [(3, [("n", "own9"), ("m", None)]), (99, [("n", "own70")]), (None, [("m", "hot")])]
    evidence = spark.createDataFrame(ev, "method string, key string, gene int")
    source = spark.createDataFrame(src, "sid int, ks array<struct<method:string,key:string>>")
    want = {}
    for s, ks in src:
        if s is not None:
            want.setdefault(s, set()).update(g for m, k, g in ev if (m, k) in ks and k)
    want = sorted((s, -1 if g is None else g, len(c)) for s, c in want.items() if len(c) > 1 for g in c)

    def got():
        df = mapping.conflict_candidates(source, "sid", F.col("ks"), evidence)
        return df, sorted((r.sid, -1 if r.gene is None else r.gene, r.n_candidates) for r in df.collect())

    df, found = got()
    assert found == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[(sid|gene)#\d+, (sid|gene)#", plan)  # pairs are new where the join makes them
    for limit in (0, 1, 2):
        monkeypatch.setattr(mapping, "MAX_OWN_KEYS", limit)
        assert got()[1] == want


def test_words_are_split_once_per_text(spark):
    """A text of many pieces must not be split again for each of them, nor a piece be searched for words twice."""
    text = "  ".join(f"w{i}" for i in range(1000)) + " "
    got = inference.cut(spark.createDataFrame([(1, text), (2, " "), (3, None)], "k int, t string"), "k", "t", SPECS["text_bert"])
    words = text.split()
    assert rows(got) == [(1, n, " ".join(words[i:i + 256])) for n, i in enumerate(range(0, 1000, 256))]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    model = WordHashModel(4)
    model.token_count("a B c")
    kept = model._words("a B c")
    assert kept is model._words("a B c") and model._words("x") == ["x"] and model._words("") == []
    assert model.tokens("a B c")[0].shape == (3, 4)


def test_undirected_work_runs_on_one_row_per_pair(spark, no_broadcast):
    """Adjacency and PPMI shuffle one row per undirected pair, self edges and missing ends included, and equal the two-sided form."""
    data = [("a", "b", 2.0), ("b", "a", 3.0), ("a", "a", 1.5), ("c", "a", 4.0), ("a", None, 2.0), (None, None, 1.0), ("d", "e", 1.0), ("d", "e", -1.0), ("b", "c", 7.0)]
    edges = spark.createDataFrame([(k, *e) for k in ("x", "y") for e in data] + [("y", "d", "c", 3.0)], "k string, s string, d string, w double")
    want = {}
    for k, s, d, w in edges.collect():
        for row, col in ((s, d), (d, s)):
            want[k, row, col] = want.get((k, row, col), 0.0) + w
    adj = graph.symmetric_adjacency(edges, "s", "d", "w", ["k"])
    assert {(r.k, r.row, r.col): r.value for r in adj.collect()} == {key: v for key, v in want.items() if v} and adj.count() == len([v for v in want.values() if v])
    plan = adj._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode") < plan.index("Aggregate")  # both directions come after the sums

    def cells(df):
        return sorted((r.k, r.row, r.col, round(r.value, 9)) for r in df.collect())

    assert cells(graph.symmetric_ppmi(edges, "s", "d", "w", ["k"])) == cells(graph.ppmi(adj, ["k"]))
    one = edges.where("k = 'y'")
    shown = cells(graph.symmetric_ppmi(one, "s", "d", "w").withColumn("k", F.lit("")))
    assert shown == cells(graph.ppmi(graph.symmetric_adjacency(one, "s", "d", "w")).withColumn("k", F.lit(""))) and shown


def test_small_vocabulary_is_broadcast(spark):
    """The size of the frequencies is known before the cells are joined, so no cell is shuffled for its term."""
    tf = spark.range(20000).select((F.col("id") % 4000).alias("d"), F.concat(F.lit("t"), F.col("id") % 7).alias("t"), F.lit(1.0).alias("value"))
    got = features.tfidf(features.count_matrix(tf, "d", "t"), "d", "t")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan and "Aggregate" not in plan
    assert got.groupBy("d").agg(F.sum(F.col("value") * F.col("value")).alias("n")).where("abs(n - 1) > 1e-9").isEmpty()


def test_a_step_of_the_svd_writes_and_joins_no_tables(spark, monkeypatch):
    """Each block of the basis was some ten jobs with tables written between them."""
    written, plain = [], linalg.materialize
    monkeypatch.setattr(linalg, "materialize", lambda df, label="step": written.append(label) or plain(df, label))
    counts = []
    for tolerance in (0.9, 1e-6):
        steps, extend = [], linalg._SparseSpace.extend
        with monkeypatch.context() as m:
            m.setattr(linalg._SparseSpace, "extend", lambda self, *a: steps.append(1) or extend(self, *a))
            f = linalg.truncated_svd(coordinates(spark, sparse_matrix(3, (40, 30), 0.3)), "r", "c", "v", 2, tolerance=tolerance, oversample=2)
        counts.append((len(steps), len(written)))
        written.clear()
    assert counts[0][0] < counts[1][0] and counts[0][1] == counts[1][1]
    assert np.allclose(f.singular_values, np.linalg.svd(sparse_matrix(3, (40, 30), 0.3), compute_uv=False)[:2])


@pytest.mark.parametrize("files", [True, False])
def test_svd_by_files_and_by_joins(spark, monkeypatch, files):
    """Text keys, a hot row and a hot column, repeated cells, and cells without a row or a column."""
    from geneloom.operators import mapped

    monkeypatch.setattr(linalg, "CELLS", 4)
    monkeypatch.setattr(linalg, "PRODUCTS", 32)
    if not files:
        monkeypatch.setattr(mapped, "folder", lambda *a: None)
    a = sparse_matrix(5, (30, 20), 0.1)
    a[3, :], a[:, 7] = 1.0, 0.5
    cells = [(f"r{i:02d}", f"c{j:02d}", float(a[i, j]) / 2) for i, j in zip(*a.nonzero())] * 2
    df = spark.createDataFrame(cells + [(None, "c07", 3.0), ("r03", None, 9.0), (None, None, 1.0)], "r string, c string, v double")
    f = linalg.truncated_svd(df, "r", "c", "v", 3, tolerance=1e-9)
    _, s, vt = np.linalg.svd(a)
    assert np.allclose(f.singular_values, s[:3])
    got = {r["row"]: r["vector"] for r in f.scores.collect()}
    loadings = {r["col"]: np.array(r["vector"]) for r in f.loadings.collect()}
    v = np.array([loadings[f"c{j:02d}"] for j in range(20)])
    assert np.allclose(np.abs(v), np.abs(vt[:3].T), atol=1e-6) and set(loadings) == {f"c{j:02d}" for j in range(20)}
    assert np.allclose([got[f"r{i:02d}"] for i in range(30)], a @ v, atol=1e-9)
    assert np.allclose(got.pop(None), 3 * v[7]) and len(got) == 30  # a missing row has scores but takes no part


def test_the_proof_joins_a_cell_once_with_its_vector(spark):
    """Cells used to be copied for each component before they were summed."""
    a = sparse_matrix(6, (40, 25), 0.3)
    f = linalg.truncated_svd(coordinates(spark, a), "r", "c", "v", 5, tolerance=1e-9)
    proof = linalg.svd_proof(coordinates(spark, a), "r", "c", "v", f)
    assert not re.search(r"Aggregate \[(row|col)#\d+L?, dim#", proof._jdf.queryExecution().optimizedPlan().toString())
    assert [r["component"] for r in proof.orderBy("component").collect()] == [1, 2, 3, 4, 5]
    assert all(r["residual"] < 1e-7 and r["off_unit"] < 1e-9 and r["off_scores"] < 1e-9 and r["top_loading"] > 0 for r in proof.collect())


def test_a_product_reads_any_share_of_the_entries(spark, monkeypatch, tmp_path):
    """Rows cut by the shares of tasks are put together, whatever the shares."""
    from geneloom.operators import mapped

    rng = np.random.default_rng(8)
    a = (rng.random((23, 17)) < 0.3) * rng.random((23, 17))
    a[4, :], a[5, :] = rng.random(17), 0  # a hot row, and one without entries
    cells = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*a.nonzero())], "i bigint, j bigint, v double")
    s = mapped.sparse(cells, "i", "j", "v", 23, 17, cells.count(), str(tmp_path / "s"))
    assert (np.diff(s.starts()) == (a != 0).sum(axis=1)).all() and np.allclose(s.values(), a[a.nonzero()]) and (s.others() == a.nonzero()[1]).all()
    got = linalg._products(np.diff(s.starts()), s.others(), s.values(), np.eye(17), 5, 3)
    assert np.allclose(got, a)


def test_numpy_hashes_as_spark_does(spark):
    from geneloom.functions.num import xxhash64

    x = np.concatenate([np.random.default_rng(9).integers(-2**63, 2**63, 50), [0, -1, 2**63 - 1, -2**63]])
    df = spark.createDataFrame([(int(v), i) for i, v in enumerate(x)], "x bigint, i int").select("i", F.xxhash64("x", "i", F.lit(7)).alias("h"), F.xxhash64("x", F.lit(1 << 40)).alias("g"))
    got = df.orderBy("i").collect()
    h = xxhash64(np.int32(7), xxhash64(np.arange(len(x), dtype=np.int32), xxhash64(x, 42)))
    assert h.view(np.int64).tolist() == [r["h"] for r in got]
    assert xxhash64(np.int64(1 << 40), xxhash64(x, 42)).view(np.int64).tolist() == [r["g"] for r in got]


def test_walks_are_stepped_where_they_start(spark):
    """Steps were joins that shuffled all walks, blocks of steps were tables, and all walks were shuffled at the end."""
    from pathlib import Path

    from geneloom.session import scratch_root

    edges = [("hub", f"n{i:02d}") for i in range(30)] + [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(29)] + [("ä", "hub"), ("x", "ä")]
    pairs = graph.neighbour_pairs(spark.createDataFrame(edges, "s string, d string"), "s", "d")
    tables = lambda: {p.name for p in Path(scratch_root(spark)).glob("geneloom-walks-*")}
    before = tables()
    walks = graph.random_walks(pairs, 4, 23)
    plan = walks._jdf.queryExecution().optimizedPlan().toString()
    assert tables() == before and "Join" not in plan and "Aggregate" not in plan
    as_rows = lambda df: sorted((r["walk_id"], r["node"], r["round"], tuple(r["walk"])) for r in df.collect())
    assert as_rows(walks) == as_rows(graph._joined_walks(pairs, 4, 23, 42, 10)) and walks.count() == 33 * 4


def test_walks_of_other_keys_and_one_way_edges_are_joined(spark):
    numbers = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2)], "node int, neighbour int")
    assert all(abs(x - y) == 1 for r in graph.random_walks(numbers, 2, 5).collect() for x, y in zip(r["walk"], r["walk"][1:]))
    one_way = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "end")], "node string, neighbour string")
    as_rows = lambda df: sorted((r["walk_id"], tuple(r["walk"])) for r in df.collect())
    assert as_rows(graph.random_walks(one_way, 20, 4)) == as_rows(graph._joined_walks(one_way, 20, 4, 42, 10))


def test_walk_invariants_count_wrong_steps_and_equal_walks(spark):
    """All walks were shuffled to count the distinct ones, and all steps sorted to be looked up."""
    from geneloom.queries.matrices import invariants

    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")], "node string, neighbour string")
    walks = [("a", ["a", "b", "c"]), ("a", ["a", "b", "c"]), ("a", ["a", "b", "a"]), ("b", ["c", "b", "a"]), ("c", ["c", "a", "c"]), ("c", ["c", "a", "b"])]
    df = invariants(spark.createDataFrame(walks, "node string, walk array<string>"), pairs)
    got = sorted(map(tuple, df.collect()))
    assert got == [("a", 2, 9, 0, True), ("b", 1, 3, 0, False), ("c", 2, 6, 3, True)]
    good = invariants(spark.createDataFrame(walks[:3], "node string, walk array<string>"), pairs)
    assert [tuple(r) for r in good.collect()] == [("a", 2, 9, 0, True)]
    assert "LeftSemi" in good._jdf.queryExecution().optimizedPlan().toString()  # only walks with a common fingerprint are compared


@pytest.mark.parametrize("space", ["files", "joins", "dense"])
def test_a_restart_keeps_half_of_the_basis_and_the_next_block(spark, monkeypatch, space):
    """A restart used to keep one block and to multiply it again."""
    from geneloom.operators import mapped

    monkeypatch.setattr(linalg, "BASIS_WIDTH", 12)
    if space == "joins":
        monkeypatch.setattr(mapped, "folder", lambda *a: None)
    kind = {"files": linalg._SparseSpace, "joins": linalg._JoinedSpace, "dense": linalg._DenseSpace}[space]
    spans, extend = [], kind.extend
    monkeypatch.setattr(kind, "extend", lambda self, basis, size, lo, hi: spans.append((lo, hi)) or extend(self, basis, size, lo, hi))
    a = np.random.default_rng(3).random((60, 40)) * (np.random.default_rng(4).random((60, 40)) < 0.3)
    if space == "dense":
        df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(a)], "i int, v array<double>")
        f = linalg.dense_factorisation(df, "i", "v", 1, centre=False, tolerance=1e-3, oversample=1)
    else:
        f = linalg.truncated_svd(coordinates(spark, a), "r", "c", "v", 2, tolerance=1e-3, oversample=0)
    assert space == "dense" or len(spans) > 6
    assert spans[:7] == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 10), (10, 12), (6, 8)][:len(spans)]  # a restart after 12 vectors
    assert np.allclose(f.singular_values, np.linalg.svd(a, compute_uv=False)[:len(f.singular_values)], rtol=1e-5)
