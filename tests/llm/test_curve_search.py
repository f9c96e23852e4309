"""Nearest neighbours against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from geneloom.llm import curve_search as cs
from geneloom.llm.queries import QUERIES


def exact(ids, x, top=20, every=20):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            best = {}
            for j, v in zip(ids, x):
                if j != i:
                    best[j] = max(best.get(j, -np.inf), float(q @ v))
            out[i] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:top]
    return out


def frame(spark, rows):
    rows = [(i, None if v is None else [None if e is None else float(e) for e in v], 1, 0.5, 9) for i, v in rows]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int, score double, cell bigint").repartition(3)


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def search(spark, rows, **limits):
    return found(cs.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, **limits))


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert [v for v, _ in a[k]] == [v for v, _ in b[k]]
        assert np.allclose([s for _, s in a[k]], [s for _, s in b[k]], rtol=1e-12)


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_each_point_and_moves_by_one(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    order = np.argsort(cs.hilbert(points, bits))
    assert sorted(cs.hilbert(points, bits)) == list(range(len(points)))
    assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def test_a_small_table_is_searched_whole(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[:, 0] *= 5  # norms differ
    rows = [(i - 40, v) for i, v in enumerate(x)]
    close(search(spark, rows), exact([i for i, _ in rows], x.astype(np.float64)))


def test_odd_vectors_take_no_part_and_copies_tie(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (260, 4)).astype(np.float64)
    x[60:200] = [1, 2, 3, 1]
    x[(x == 0).all(axis=1)] = 1
    good = list(enumerate(x))
    odd = [(1000, None), (1020, [0, 0, 0, 0]), (1040, [1, None, 1, 1]), (1060, [float("nan"), 1, 1, 1]), (1080, [float("inf"), 1, 1, 1]), (1100, [1, 1]), (1120, []), (None, [1, 1, 1, 9])]
    rows = good + odd + [good[70], good[80], good[80], good[3]]
    close(search(spark, rows), exact(list(range(260)), x))


def test_one_id_with_several_vectors(spark):
    rows = [(20, [1, 0]), (20, [0, 1]), (1, [2, 0]), (2, [0, 3]), (2, [1, 1])]
    close(search(spark, rows), {20: [(2, 3.0), (1, 2.0)]})


def test_few_rows_and_none(spark):
    assert search(spark, []) == {} == search(spark, [(20, None)])
    assert search(spark, [(20, [1, 2])]) == {}
    close(search(spark, [(20, [1, 2]), (21, [1, 1])]), {20: [(21, 3.0)]})


@pytest.mark.parametrize("hot", [False, True])
def test_windows_reach_their_recall(spark, hot):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 32))
    x = centres[rng.integers(0, 60, 6000)] + 0.15 * rng.standard_normal((6000, 32))
    x[:2500] = rng.standard_normal((2500, 32))
    if hot:
        x[2000:4000] = x[7]
        x[4000:5000] = x[8] + 0.001 * rng.standard_normal((1000, 32))
    x = x.astype(np.float32).astype(np.float64)
    rows = list(enumerate(x))
    got = search(spark, rows)
    ask = np.arange(0, 6000, 20)
    true = x[ask] @ x.T
    true[np.arange(len(ask)), ask] = -np.inf
    hits = 0
    for i, row in zip(ask, true):
        order = np.lexsort((np.arange(6000), -row))[:20]
        assert len(got[i]) == 20 and all(np.isclose(s, x[i] @ x[v], rtol=1e-12) for v, s in got[i]) and i not in dict(got[i])
        hits += len({v for v, _ in got[i]} & set(order))
    assert hits >= 0.93 * 20 * len(ask)


def test_windows_widen_only_as_far_as_needed():
    names = [(w.size, w.reach) for w in cs.widths(300)]
    assert names[:7] == [(1, 0), (2, 0), (4, 0), (8, 0), (16, 0), (32, 0), (64, 1)] and names[-1] == (64, 8)
    w, fine = cs.Windows(8, 0), np.arange(300)
    assert all(abs(f - g) < 4 or w.cell(np.array([g]), 1, 3)[0] in w.looked_at(np.array([f]), 1, 3)[0] for f in range(40, 60) for g in range(f - 4, f + 4))


def test_the_query_on_its_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.array(df.embedding.tolist(), np.float64)
    close(found(QUERIES["op12_curve_search"](spark, "/root/testdata/sf0.001")), exact(df.vec_id.tolist(), x))
