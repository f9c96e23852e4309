"""Ranked lexical search by dual trees: for each query item the documents with the highest integer scores, exactly.

A document is a sparse vector of impacts, an item one of weights, and a score is their inner product; all numbers are non-negative. One
pass over the texts counts what the weights need and writes each document's terms and occurrences, as far as items have them. The search
then runs over batches of these vectors. A batch's documents are ordered by their strongest terms and become a tree, and so do the items;
a node holds the largest coordinate of what is below it, so the inner product of two nodes bounds every score between them. A pair of
nodes whose bound lies under the weakest kth score of its items is dropped with all its pairs. One sixteenth of the documents is searched
first; its kth scores, one number per item, let the other tasks drop most of their batches at the roots.

Items are searched in blocks of a bounded number of terms, each block against all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import LOWER, UPPER, materialize, whole
from .tokens import bounded

TOP = 10  # fixed values of the contract, with the score's own numbers
BLOCK_TERMS = 1 << 20  # terms of the items of one block, about: 100 MB on the driver and in a task
BATCH_DOCS, BATCH_TERMS = 8192, 1 << 21  # documents and their terms in one tree
LEAF, FAN = 16, 8
FIRST, SLICES = 1, 16  # the share of the documents searched first
_TERM = bytes(b if b in range(0x30, 0x3A) or b in range(0x61, 0x7B) or b >= 0x80 else 0x20 for b in bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode())))


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of letters, digits and characters beyond ASCII, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM).split() if text else []


def length_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents with n terms each."""
    return 25 + np.array([75 * int(x) * documents // total for x in n], np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Sparse:
    """Rows of (term, value); row i is cells[start[i]:start[i + 1]], terms ascending."""

    start: np.ndarray
    term: np.ndarray
    value: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.start) - 1

    def take(self, order: np.ndarray) -> Sparse:
        size = np.diff(self.start)[order]
        start = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(start[-1]) + np.repeat(self.start[:-1][order] - start[:-1], size)
        return Sparse(start, self.term[at], self.value[at])

    def maxima(self, group: int) -> Sparse:
        """A row for each ``group`` rows: the largest value of each term."""
        owner = np.repeat(np.arange(self.rows) // group, np.diff(self.start))
        order = np.lexsort((self.term, owner))
        owner, term, value = owner[order], self.term[order], self.value[order]
        head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])])) if len(term) else np.zeros(0, np.int64)
        n = -(-self.rows // group)
        best = np.maximum.reduceat(value, head) if len(head) else value
        return Sparse(np.concatenate([[0], np.cumsum(np.bincount(owner[head], minlength=n))]).astype(np.int64), term[head], best)

    def dots(self, rows: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The inner products of some rows with a dense vector."""
        size = self.start[rows + 1] - self.start[rows]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[rows] - (ends - size), size)
        sums = np.concatenate([[0], np.cumsum(other[self.term[at]] * self.value[at])])
        return sums[ends] - sums[ends - size]


def strongest_first(x: Sparse, scale: np.ndarray) -> np.ndarray:
    """The rows ordered by their strongest term, then by their second, so that neighbours are alike."""
    keys = []
    value = x.value * scale[x.term]
    owner = np.repeat(np.arange(x.rows), np.diff(x.start))
    for _ in range(3):
        order = np.lexsort((x.term, -value, owner))
        head = np.full(x.rows, -1, np.int64)
        filled = np.diff(x.start) > 0
        top = order[x.start[:-1][filled]]
        head[filled] = x.term[top]
        keys.append(head)
        value = value.copy()
        value[top] = -1
    return np.lexsort((*keys[::-1],))


class Tree:
    """Levels of maxima over ordered rows, the rows themselves at the bottom."""

    def __init__(self, rows: Sparse, scale: np.ndarray, leaf: int):
        self.order = strongest_first(rows, scale)
        self.levels, self.group = [rows.take(self.order)], [1]
        while self.levels[-1].rows > 1 or len(self.levels) == 1:
            fan = leaf if len(self.levels) == 1 else FAN
            self.levels.append(self.levels[-1].maxima(fan))
            self.group.append(fan)

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The children, one level down."""
        fan, n = self.group[level], self.levels[level - 1].rows
        out = (nodes[:, None] * fan + np.arange(fan)).ravel()
        return out[out < n]


class Search:
    """The best ``top`` documents of each item of a block, over any number of batches."""

    def __init__(self, items: Sparse, n_terms: int, floor: np.ndarray, top: int = TOP):
        self.top, self.floor = top, floor  # floor: a score that ``top`` documents are known to reach
        self.tree = Tree(items, np.ones(n_terms, np.int64), 1)
        self.dense = np.zeros(n_terms, np.int64)
        n = items.rows
        self.score, self.missing, self.doc = [np.zeros(0, np.int64)] * n, [np.zeros(0, bool)] * n, [np.zeros(0, np.int64)] * n
        self.pairs = self.scored = 0

    def kth(self, items: np.ndarray) -> int:
        """The weakest kth score of some items: what a document must reach to matter to one of them. At least 1."""
        return min(max(1, self.floor[i], self.score[i][-1] if len(self.score[i]) == self.top else 0) for i in items)

    def add(self, docs: Sparse, ids: np.ndarray, missing: np.ndarray, scale: np.ndarray) -> None:
        """``ids`` of the documents, and which of them have none; ``scale`` weighs terms for the order of the tree."""
        if not docs.rows:
            return
        tree = Tree(docs, scale, LEAF)
        todo = [(len(self.tree.levels) - 1, 0, len(tree.levels) - 1, np.zeros(1, np.int64))]
        while todo:
            level, node, depth, nodes = todo.pop()
            span = math.prod(self.tree.group[1:level + 1])
            under = self.tree.order[node * span:(node + 1) * span]
            items = self.tree.levels[level]
            a, b = items.start[node], items.start[node + 1]
            self.dense[items.term[a:b]] = items.value[a:b]
            bound = tree.levels[depth].dots(nodes, self.dense)
            self.pairs += len(nodes)
            keep = bound >= self.kth(under)
            if keep.any():
                nodes = nodes[keep]
                if level == 0 and depth == 1:
                    self._leaves(int(under[0]), tree, nodes[np.argsort(-bound[keep], kind="stable")], np.sort(bound[keep])[::-1], ids, missing)
                else:
                    nodes = tree.below(depth, nodes) if depth > 1 else nodes
                    for child in self.tree.below(level, np.array([node])) if level else [node]:
                        todo.append((max(level - 1, 0), int(child), max(depth - 1, 1), nodes))
            self.dense[items.term[a:b]] = 0

    def _leaves(self, item: int, tree: Tree, nodes: np.ndarray, bound: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """The leaves in the order of their bounds, some at a time, until none can matter."""
        at, width = 0, 4
        while at < len(nodes) and bound[at] >= self.kth([item]):
            rows = tree.below(1, nodes[at:at + width])
            score = tree.levels[0].dots(rows, self.dense)
            self.scored += len(rows)
            good = score >= self.kth([item])
            own = tree.order[rows[good]]
            s, miss, doc = np.concatenate([self.score[item], score[good]]), np.concatenate([self.missing[item], missing[own]]), np.concatenate([self.doc[item], ids[own]])
            best = np.lexsort((doc, miss, -s))[:self.top]
            self.score[item], self.missing[item], self.doc[item] = s[best], miss[best], doc[best]
            at, width = at + width, width * 2


# --- the Spark plan -----------------------------------------------------------------------------------------------------------------


def vectors(docs: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc, n, terms, tfs) of each text with a term: how many it has, and those in ``vocabulary``, ascending, with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 16 << 20):
            n, size, ids, tfs, keep = [], [], [], [], []
            for i, t in enumerate(batch.column("text")):
                # encoded text is read as it is; a string is never made
                found = t.as_buffer().to_pybytes().translate(_TERM).split() if t.is_valid else []
                if found:
                    counts: dict[int, int] = {}
                    for w in map(vocabulary.get, found):
                        counts[w] = counts.get(w, 0) + 1
                    counts.pop(None, None)
                    keep.append(i)
                    n.append(len(found))
                    size.append(len(counts))
                    for w in sorted(counts):
                        ids.append(w)
                        tfs.append(counts[w])
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists], names=["doc", "n", "terms", "tfs"])

    d = docs.select(F.col(doc_id).cast("bigint").alias("doc"), whole(text).alias("text"))
    return d.mapInArrow(run, "doc bigint, n bigint, terms array<int>, tfs array<int>")


def _sparse(terms: pa.ListArray, value: np.ndarray) -> Sparse:
    offsets = terms.offsets.to_numpy().astype(np.int64)
    return Sparse(offsets - offsets[0], terms.flatten().to_numpy().astype(np.int64), value)


def best_documents(found: DataFrame, items: Sparse, weights: np.ndarray, documents: int, total: int, floor: np.ndarray, top: int) -> DataFrame:
    """(item, doc, score): of each task's vectors the best ``top`` for each item, none below ``floor``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, len(weights), floor, top)
        waiting, rows, cells = [], 0, 0

        def turn() -> None:
            nonlocal waiting, rows, cells
            if waiting:
                x = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                tf = x.column("tfs").flatten().to_numpy().astype(np.int64)
                size = np.diff(x.column("terms").offsets.to_numpy())
                m = np.repeat(length_norm(x.column("n").to_numpy(), documents, total), size)
                doc = x.column("doc")
                search.add(_sparse(x.column("terms"), impact(tf, m)), doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), weights)
            waiting, rows, cells = [], 0, 0

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                some = batch.slice(at, BATCH_DOCS)
                waiting.append(some)
                rows, cells = rows + some.num_rows, cells + len(some.column("terms").flatten())
                if rows >= BATCH_DOCS or cells >= BATCH_TERMS:
                    turn()
        turn()
        n = [len(s) for s in search.score]
        if sum(n):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(n)), n).astype(np.int32)), pa.array(np.concatenate(search.doc), pa.int64(), mask=np.concatenate(search.missing)),
                pa.array(np.concatenate(search.score))], names=["item", "doc", "score"])

    out = found.select("doc", "n", "terms", "tfs").mapInArrow(run, "item int, doc bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last()))
    return out.withColumn("rank", place).where(F.col("rank") <= top)


def _block(docs: DataFrame, items: list, doc_id: str, text: str, top: int) -> DataFrame:
    """(item, rank, doc, score) for one block of items (id, text); ``item`` is the place in the block."""
    spark = docs.sparkSession
    bags = [terms(t) for _, t in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for b in bags for t in b}))}
    found = materialize(vectors(docs, doc_id, text, vocabulary).withColumn("slice", F.pmod(F.hash("doc", "n", "terms"), F.lit(SLICES))), "vectors")
    count = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    # one number for each term of the block
    df = {r["t"]: r["n"] for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = np.array([weight(df[i], count["n"]) if i in df else 0 for i in range(len(vocabulary))], np.int64)
    rows = [np.unique([vocabulary[t] for t in b if vocabulary[t] in df], return_counts=True) for b in bags]
    start = np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])]).astype(np.int64)
    term = np.concatenate([np.zeros(0, np.int64), *[t.astype(np.int64) for t, _ in rows]])
    q = Sparse(start, term, np.concatenate([np.zeros(0, np.int64), *[n.astype(np.int64) for _, n in rows]]) * weights[term])
    floor = np.zeros(len(items), np.int64)
    if not len(term):
        return spark.createDataFrame([], "item int, rank int, doc bigint, score bigint")
    search = lambda part, least: best_documents(found.where(part), q, weights, count["n"], count["l"], least, top)
    first = materialize(search(F.col("slice") < FIRST, floor), "first")
    for r in first.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == top).collect():  # one number per item
        floor[r["item"]] = r["least"]
    both = first.select("item", "doc", "score").unionByName(search(F.col("slice") >= FIRST, floor).select("item", "doc", "score"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last()))
    return both.withColumn("rank", place).where(F.col("rank") <= top).select("item", "rank", "doc", "score")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` its ``top`` documents with a score above 0.

    A missing or empty text has no term; such documents and items rank nowhere. Equal scores go by the smaller doc_id, a missing one last.
    Each row of either table stands for itself: repeated documents take a rank each, repeated items get the same ranks each. Empty tables
    give an empty one. A text of any length is read whole.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    given = materialize(items.select(F.col(item_id).alias("id"), whole(item_text).alias("text")).withColumn("size", F.char_length("text")), "items")
    blocks = max(1, -(-(given.agg(F.sum("size")).first()[0] or 0) // (6 * BLOCK_TERMS)))  # a term and its blank have 6 characters or so
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for b in range(blocks):
        some = given.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b) if blocks > 1 else given
        own = [(r["id"], r["text"]) for r in some.collect()]  # one block
        if own:
            names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(own)], f"item int, item_id {kind}")
            ranked = materialize(_block(docs, own, doc_id, text, top), "ranked")
            out = out.unionByName(ranked.join(names, "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score"))
    return out
