"""Approximate nearest neighbours by shifted space-filling curves.

Every vector is projected by a few random rotations and placed on a Hilbert curve for each. Along a curve, quantiles of the keys cut the
vectors into cells of about equal size; cells are laid differently on each curve. A query looks through the cells around its own place on
every curve, and what it finds there is scored exactly, in double precision, and merged. Largest inner products are nearest neighbours once
a further coordinate gives all vectors the same norm and the query is scaled to it, so norms may differ.

How wide the windows must be depends on the data. A few queries are searched exactly, by one pass over all vectors, and the narrowest
windows that would have found ``target`` of their neighbours are taken. Vectors that are alike in direction get by with small windows at
any number; directions drawn at random have no near neighbours, and windows for them grow with the table.

Of more than ``top`` + 1 equal vectors only those with the smallest ids are candidates, as no other one can rank; one of the equal queries
is searched and the others take its result. So no cell holds more than a bounded number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import lookup
from .text import materialize, shuffle_partitions

TOP, EVERY = 20, 20  # fixed values of the contract
CURVES, DIMS, BITS = 3, 8, 7  # one 56-bit key for each curve
FINE = 1024  # vectors between two quantiles
WIDEST = 64  # quantiles in the largest cell: 65,536 vectors, what a task holds at a time
SAMPLE_CELLS = 1 << 20  # numbers in the sample that centres and scales the projections: 16,384 vectors of 64
PILOTS, TARGET = 128, 0.96
CHUNK = 512  # queries scored at a time


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The places of points of whole numbers below 2^bits on the Hilbert curve through their cube."""
    x = points.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):  # undo the turns and mirrors of the curve, from the largest cube inwards
        low = np.uint64((1 << b) - 1)
        for i in range(len(x)):
            flip = (x[i] >> np.uint64(b)) & one == one
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(b)) & one == one, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << one) | ((row >> np.uint64(b)) & one)
    return key.astype(np.int64)


@dataclass
class Curves:
    """The projections, fitted on a sample: turn[c] takes a centred vector with its further coordinate to the cube of curve c."""

    turn: list[np.ndarray]
    low: list[np.ndarray]
    width: list[np.ndarray]
    centre: np.ndarray
    norm: float

    @classmethod
    def fit(cls, sample: np.ndarray, norm: float, curves: int = CURVES, dims: int = DIMS, seed: int = 11) -> Curves:
        rng = np.random.default_rng(seed)
        x = cls._level(sample, norm)
        centre = x.mean(axis=0)
        turn = [np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0][:, :dims] for _ in range(curves)]
        placed = [(x - centre) @ t for t in turn]
        low = [np.quantile(p, 0.001, axis=0) for p in placed]
        width = [np.maximum(np.quantile(p, 0.999, axis=0) - lo, 1e-12) for p, lo in zip(placed, low)]
        # the cube is half as large again as the data, which lie elsewhere in it for each curve
        shift = [rng.random(t.shape[1]) * 0.5 for t in turn]
        return cls(turn, [lo - w * s for lo, w, s in zip(low, width, shift)], [w * 1.5 for w in width], centre, norm)

    @staticmethod
    def _level(x: np.ndarray, norm: float) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))])

    def keys(self, x: np.ndarray, asking: bool) -> np.ndarray:
        """(curve, vector): places of vectors as candidates, or as queries."""
        if asking:
            x = np.column_stack([x * (self.norm / np.linalg.norm(x, axis=1))[:, None], np.zeros(len(x))])
        else:
            x = self._level(x, self.norm)
        x = x - self.centre
        cube = [np.clip((x @ t - lo) / w, 0, 1 - 2.0 ** -20) * (1 << BITS) for t, lo, w in zip(self.turn, self.low, self.width)]
        return np.stack([hilbert(c.astype(np.int64), BITS) for c in cube])


def fine_cells(key: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The quantile each key lies in. Vectors whose key is a bound several times over are dealt out among its quantiles."""
    first, last = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
    mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)  # any odd multiplier
    return first + (mixed % (last - first + 1).astype(np.uint64)).astype(np.int64)


@dataclass(frozen=True)
class Windows:
    """Cells of ``size`` quantiles. A query looks through its own and ``reach`` to either side; with 0, through the nearer one only."""

    size: int
    reach: int

    def cell(self, fine: np.ndarray, curve: int, curves: int) -> np.ndarray:
        return (fine + curve * self.size // curves) // self.size

    def looked_at(self, fine: np.ndarray, curve: int, curves: int) -> np.ndarray:
        """(query, cell); the same cell twice never."""
        at = self.cell(fine, curve, curves)
        if self.reach:
            return at[:, None] + np.arange(-self.reach, self.reach + 1)
        nearer = np.where((fine + curve * self.size // curves) % self.size * 2 >= self.size, 1, -1)
        return np.stack([at, at + nearer], axis=1)


def widths(quantiles: int) -> Iterator[Windows]:
    """From narrow to wide; the last covers everything."""
    size = 1
    while size < min(WIDEST, 2 * quantiles):
        yield Windows(size, 0)
        size *= 2
    reach = 1
    while True:
        yield Windows(size, reach)
        if reach * size >= quantiles:
            return
        reach *= 2


def best_pairs(ask: np.ndarray, x: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the ``top`` ids with the largest exact inner products for each query, ties to smaller ids. Equal ids are one."""
    out = []
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    light = x.astype(np.float32)
    reach = float(np.linalg.norm(x, axis=1).max()) if len(x) else 0.0
    for at in range(0, len(ask) if len(x) else 0, CHUNK):
        q = ask[at:at + CHUNK]
        near = q.astype(np.float32) @ light.T
        each = near if len(heads) == len(ids) else np.maximum.reduceat(near, heads, axis=1)  # an id with several vectors counts once
        k = min(top, each.shape[1])
        edge = np.partition(each, each.shape[1] - k, axis=1)[:, each.shape[1] - k]
        slack = 4e-7 * x.shape[1] * reach * np.linalg.norm(q, axis=1)  # what single precision may be wrong by
        row, col = np.nonzero(near >= (edge - slack)[:, None])
        score = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", q[row[i:i + 65536]], x[col[i:i + 65536]]) for i in range(0, len(row), 65536)]])
        best = np.lexsort((-score, ids[col], row))
        row, col, score = row[best], col[best], score[best]
        first = np.concatenate([[True], (row[1:] != row[:-1]) | (ids[col][1:] != ids[col][:-1])])
        row, col, score = row[first], col[first], score[first]
        best = np.lexsort((ids[col], -score, row))
        row, col, score = row[best], col[best], score[best]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < top
        out.append((row[keep] + at, ids[col[keep]], score[keep]))
    return tuple(np.concatenate([np.zeros(0, t), *[o[i] for o in out]]) for i, t in enumerate((np.int64, np.int64, np.float64)))


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


# --- the Spark plan -----------------------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part: an id, and a vector of finite numbers, not all zero, of the table's commonest length."""
    v = F.col(vector)
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = vectors.where(F.col(vec_id).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("vec"))
    length = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return rows.where(F.size("vec") == (length["n"] if length else 0))


def index(rows: DataFrame, asks: Column, top: int) -> tuple[DataFrame, DataFrame]:
    """The rows that are candidates or searched, as (vec_id, vec, candidate, asking), and the queries (vec_id, like) that take the result of ``like``."""
    h = rows.withColumns({"h": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec"), "asks": F.coalesce(asks, F.lit(False))})
    keys = ["h", "h2"]
    counts = h.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > top + 1)
    counts = materialize(counts, "copies")
    alike = h.select(*keys, "vec_id").join(counts.select(*keys), keys, "left_semi")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
    least = alike.groupBy(*keys, "vec_id").agg(F.count(F.lit(1)).alias("n")).withColumn("place", place).where(F.col("place") <= top + 1)
    least = materialize(least.groupBy(*keys).agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "least")  # at most top + 1 each
    met = lookup(h, least, keys, "left", counts, "_rows", ["vec_id"])
    alone = met.where("ids IS NULL").select("vec_id", "vec", F.lit(True).alias("candidate"), F.col("asks").alias("asking"))
    some = met.where("array_contains(ids, vec_id)").groupBy(*keys, "vec_id").agg(F.first("vec").alias("vec"), F.first("ids").alias("ids"))
    some = some.select("vec_id", "vec", F.lit(True).alias("candidate"), (F.col("vec_id") == F.col("ids")[0]).alias("asking"))
    return alone.unionByName(some), met.where("ids IS NOT NULL AND asks").select("vec_id", F.col("ids")[0].alias("like")).distinct()


def _keys(rows: DataFrame, curves: Curves) -> DataFrame:
    """The candidates' places on each curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(k) for k in curves.keys(_matrix(b.column("vec")), False)], names=[f"k{c}" for c in range(len(curves.turn))])

    return rows.where("candidate").select("vec").mapInArrow(run, ", ".join(f"k{c} bigint" for c in range(len(curves.turn))))


def exact_neighbours(rows: DataFrame, ask: np.ndarray, ids: np.ndarray, top: int) -> DataFrame:
    """(query, vec_id, score, rank): for some given vectors their neighbours among all candidates, but for themselves, by brute force."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q, v, s = best_pairs(ask, _matrix(b.column("vec")), b.column("vec_id").to_numpy(), top + 1)
                keep = ids[q] != v
                yield pa.RecordBatch.from_arrays([pa.array(q[keep].astype(np.int32)), pa.array(v[keep]), pa.array(s[keep])], names=["query", "vec_id", "score"])

    found = rows.where("candidate").select("vec_id", "vec").mapInArrow(run, "query int, vec_id bigint, score double").distinct()
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= top)


def chosen_windows(rows: DataFrame, curves: Curves, bounds: list[np.ndarray], top: int, target: float) -> Windows:
    """The narrowest windows that hold ``target`` of the exact neighbours of the pilot queries."""
    quantiles = len(bounds[0]) + 1
    pilots = rows.where("asking").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PILOTS).select("vec_id", "vec").collect()
    n = len(curves.turn)
    options = list(widths(quantiles))
    if not pilots or quantiles == 1:
        return options[-1]
    ask, ids = np.array([r["vec"] for r in pilots], np.float64), np.array([r["vec_id"] for r in pilots], np.int64)
    near = exact_neighbours(rows, ask, ids, top).select("query", "vec_id").collect()  # PILOTS x top
    met = rows.where("candidate").join(F.broadcast(rows.sparkSession.createDataFrame([(v,) for v in {r["vec_id"] for r in near}], "vec_id bigint")), "vec_id", "left_semi").collect()
    slot = {r["vec_id"]: i for i, r in enumerate(met)}
    found = np.array([r["vec"] for r in met], np.float64)
    theirs, own = curves.keys(found, False), curves.keys(ask, True)
    met_ids = np.array([r["vec_id"] for r in met], np.int64)
    q, v = np.array([r["query"] for r in near]), np.array([slot[r["vec_id"]] for r in near])
    for w in options:
        hit = np.zeros(len(q), bool)
        for c in range(n):
            cells = w.looked_at(fine_cells(own[c], ids, bounds[c]), c, n)
            hit |= (cells[q] == w.cell(fine_cells(theirs[c], met_ids, bounds[c]), c, n)[v][:, None]).any(axis=1)
        if hit.mean() >= target:
            return w
    return options[-1]


def placed(rows: DataFrame, curves: Curves, bounds: list[np.ndarray], windows: Windows) -> DataFrame:
    """(cell, asking, vec_id, vec): each candidate once for each curve, each query for each cell that it looks through."""
    n = len(curves.turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column("vec_id").to_numpy(), _matrix(b.column("vec"))
            for asking in (False, True):
                of = np.flatnonzero(b.column("asking" if asking else "candidate").to_numpy(zero_copy_only=False))
                keys = curves.keys(x[of], asking) if len(of) else []
                for c, key in enumerate(keys):
                    fine = fine_cells(key, ids[of], bounds[c])
                    cells = windows.looked_at(fine, c, n) if asking else windows.cell(fine, c, n)[:, None]
                    inside = ((cells >= 0) & (cells <= windows.cell(np.array([len(bounds[c])]), c, n)[0])).ravel()
                    at = pa.array(np.repeat(of, cells.shape[1])[inside])
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()[inside] * n + c), pa.array(np.full(len(at), asking)), b.column("vec_id").take(at), b.column("vec").take(at)],
                                                     names=["cell", "asking", "vec_id", "vec"])

    kind = rows.schema["vec"].dataType.simpleString()
    return rows.select("vec_id", "vec", "candidate", "asking").mapInArrow(run, f"cell bigint, asking boolean, vec_id bigint, vec {kind}")


def scored(cells: DataFrame, top: int) -> DataFrame:
    """(query, vec_id, score): for each query in each cell its best ``top`` candidates there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ask, asks, x, ids = None, [], [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if ask and x:
                who = np.concatenate(asks)
                q, v, s = best_pairs(np.concatenate(ask), np.concatenate(x), np.concatenate(ids), top)
                yield pa.RecordBatch.from_arrays([pa.array(who[q]), pa.array(v), pa.array(s)], names=["query", "vec_id", "score"])

        for b in batches:
            all_cells, asking = b.column("cell").to_numpy(), b.column("asking").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], (all_cells[1:] != all_cells[:-1]) | (asking[1:] != asking[:-1])])) if b.num_rows else []
            for at, to in zip(cuts, [*cuts[1:], b.num_rows]):
                if all_cells[at] != cell:
                    yield from done()
                    cell, ask, asks, x, ids = all_cells[at], [], [], [], []
                own, some = _matrix(b.column("vec").slice(at, to - at)), b.column("vec_id").slice(at, to - at).to_numpy()
                (ask if asking[at] else x).append(own)
                (asks if asking[at] else ids).append(some)
        yield from done()

    n = shuffle_partitions(cells.sparkSession)
    return cells.repartition(n, "cell").sortWithinPartitions("cell", "asking").mapInArrow(run, "query bigint, vec_id bigint, score double")


def nearest(vectors: DataFrame, asks: Column, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``asks`` holds its ``top`` nearest found among all other rows, by inner product.

    Vectors that are missing, zero, of another length than most, or hold a missing or non-finite number take no part; nor do rows without an
    id. Repeated rows count once. Of several vectors with one id each is searched and found, and the best score of a pair counts. An empty
    table gives an empty one. ``target`` is the share of true neighbours that the windows are to hold, measured on ``PILOTS`` queries.
    """
    rows, others = index(usable(vectors, vec_id, vector), asks, top)
    rows, others = materialize(rows, "index"), materialize(others, "alike")
    shape = rows.agg(F.count_if("candidate").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))).alias("s"), F.first(F.size("vec")).alias("d")).first()
    if not shape["n"]:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = rows.where("candidate").orderBy(F.xxhash64("vec"), "vec_id").limit(max(64, SAMPLE_CELLS // shape["d"])).select("vec").collect()
    curves = Curves.fit(np.array([r["vec"] for r in sample], np.float64), float(np.sqrt(shape["s"])))
    quantiles = -(-shape["n"] // FINE)
    bounds = [np.zeros(0, np.int64)] * CURVES
    if quantiles > 1:  # 8 bytes for each FINE vectors and curve reach the driver
        parts = F.array(*[F.lit(i / quantiles) for i in range(1, quantiles)])
        cut = _keys(rows, curves).agg(*[F.percentile_approx(f"k{c}", parts, max(10_000, 8 * quantiles)).alias(f"k{c}") for c in range(CURVES)]).first()
        bounds = [np.sort(np.array(cut[f"k{c}"], np.int64)) for c in range(CURVES)]
    windows = chosen_windows(rows, curves, bounds, top, target)
    found = scored(placed(rows, curves, bounds, windows), top + 1)
    found = found.repartition(shuffle_partitions(found.sparkSession), "query").groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    best = found.withColumn("place", place).where(F.col("place") <= top + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    best = materialize(best, "near")
    alike = lookup(others.withColumnRenamed("like", "query"), best, ["query"], "inner", others.groupBy(F.col("like").alias("query")).agg(F.count(F.lit(1)).alias("_rows")), "_rows", ["vec_id"])
    asked = rows.where("asking").select(F.col("vec_id").alias("query")).join(others.select(F.col("like").alias("query")).distinct(), "query", "left_anti").distinct()
    each = best.join(asked, "query", "left_semi").select(F.col("query").alias("query_id"), "near").unionByName(alike.select(F.col("vec_id").alias("query_id"), "near"))
    near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    each = each.select("query_id", F.posexplode(near).alias("at", "x"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
