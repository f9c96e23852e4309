"""Packing documents into training sequences by best-fit decreasing.

A document longer than a window is first cut into full windows, each a sequence of its own; what remains of every document is
shorter than a window. The remainders are dealt evenly into blocks of a fixed size, and each block is packed by best-fit
decreasing: a segment tree over the remaining capacities finds the tightest open window that still takes a piece. Each block leaves
about one window part empty, so padding falls with the block size and does not depend on the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import materialize
from .tokens import bounded, default_tokenizer, encoder

WINDOW = 4096  # fixed value of the contract
BLOCK_PIECES = 50_000  # pieces packed together in one task: about 10 MB
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint"
PLACED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens): each document's ids, with the end id, in full windows and one remainder.

    ``ids`` are little-endian unsigned 32-bit numbers. A missing or empty text is one piece with the end id alone. Repeated rows are
    documents of their own.
    """
    path = tokenizer or default_tokenizer()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in bounded(batches, "text"):
            ids, bounds = coder.encode(batch.column("text"))
            tokens = np.diff(bounds)
            count = -(-tokens // window)
            row = np.repeat(np.arange(len(tokens)), count)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * window
            length = np.minimum(window, tokens[row] - start)
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4  # the pieces follow one another as the ids do
            binary = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), binary, pa.array(tokens[row])],
                                             names=["doc_id", "start", "length", "ids", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, PIECES)


class OpenWindows:
    """Windows by remaining capacity, with a segment tree of counts above the capacities."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.waiting: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, which: int) -> None:
        self.waiting[capacity].append(which)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The capacity and the number of the tightest window with room for ``need``."""
        at, count = need + self.leaves, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up, until a right neighbour holds a window
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._add(capacity, -1)
        return capacity, self.waiting[capacity].pop()

    def _add(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each length the number of its window and its offset there."""
    which, offset, n, tree = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0, OpenWindows(window)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            found, n = (window, n), n + 1
        which[i], offset[i] = found[1], window - found[0]
        if found[0] > need:
            tree.put(found[0] - need, found[1])
    return which, offset


def place(pieces: DataFrame, window: int = WINDOW, block: int = BLOCK_PIECES) -> DataFrame:
    """``pieces`` without their ids, with ``sequence_id`` and the gapless ``offset`` there. An empty table gives an empty table."""
    digests = materialize(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), "pieces")
    blocks = max(1, -(-digests.count() // block))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, done, rows, held = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done, rows, held
            t = pa.Table.from_batches(rows).combine_chunks()
            which, offset = best_fit_decreasing(t.column("length").to_numpy(), window)
            t = t.append_column("sequence_id", pa.array((task << 32) + done + which)).append_column("offset", pa.array(offset))
            done, rows, held = done + int(which.max()) + 1, [], 0
            yield from t.to_batches()

        for batch in batches:
            rows, held = [*rows, batch], held + batch.num_rows
            if held >= 2 * block:
                yield from flush()
        if held:
            yield from flush()

    return digests.repartition(blocks).mapInArrow(pack, PLACED)


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    return place(cut(docs, doc_id, text, window, tokenizer), window)


def sequences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """(sequence_id, n_tokens, ids): the ids of each sequence, its pieces in order of their offsets. Documents need distinct ids here."""
    pieces = cut(docs, doc_id, text, window, tokenizer).select("doc_id", "start", "ids")
    placed = pack_documents(docs, doc_id, text, window, tokenizer)
    joined = placed.join(pieces.withColumnsRenamed({"doc_id": "d", "start": "s"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("start") == F.col("s")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])  # a window's pieces: bounded
    return joined.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
