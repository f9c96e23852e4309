"""Token files: length-delimited binary records with masked checksums, and an offset index beside each file.

A record is: length (8 bytes), masked checksum of the length (4), payload, masked checksum of the payload (4), all little-endian.
The checksum is CRC-32C, rotated by 15 bits plus a constant, so any reader of this common framing can read the files. A payload is a
document: flags (2 bytes: bytes per id, whether the document id is present), document id (8), ids. The index holds two 8-byte numbers per
record: its offset, and the ids before it in the file; it ends with the file's size and ids. Readers seek to any record by it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .text import materialize, shuffle_partitions, whole
from .tokens import bounded, default_tokenizer, encoder

MASK_DELTA, POLYNOMIAL = 0xA282EAD8, 0x82F63B78  # fixed values of the framing: mask constant, CRC-32C reversed
LANE = 256  # bytes that one lane of the checksum covers
READ_RECORDS = 2048  # records per reading task slice
MANIFEST = "shard int, path string, n_records bigint, n_tokens bigint, n_bytes bigint"


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_BYTE = _byte_table()
_low = np.arange(1 << 16, dtype=np.uint32)
_PAIR = _BYTE[(_low >> 8) ^ (_BYTE[_low & 255] & 255)] ^ (_BYTE[_low & 255] >> 8)  # two bytes at once


def _zeros_operator(n_bytes: int) -> np.ndarray:
    """Four tables of 256: what ``n_bytes`` zero bytes (a multiple of two) make of a state."""
    state = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    for _ in range(n_bytes // 2):
        state = _PAIR[state & 0xFFFF] ^ (state >> 16)
    table = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            table[byte] ^= np.where(np.arange(256) >> bit & 1, state[8 * byte + bit], 0).astype(np.uint32)
    return table


_SHIFTS: list[np.ndarray] = []


def _apply(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    return table[0][state & 255] ^ table[1][(state >> 8) & 255] ^ table[2][(state >> 16) & 255] ^ table[3][state >> 24]


def crc32c(payloads: list[bytes]) -> np.ndarray:
    """CRC-32C of each payload (of four bytes or more). All lanes of all payloads advance together; leading zeros do not change a raw state."""
    if not payloads:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(p) for p in payloads])
    lanes = -(-sizes // LANE)
    ends = np.cumsum(lanes)
    data = bytearray(int(ends[-1]) * LANE)
    for p, end in zip(payloads, (ends * LANE).tolist()):
        data[end - len(p):end] = p
    data = np.frombuffer(data, np.uint8).copy()
    first = ends * LANE - sizes
    for k in range(4):
        data[first + k] ^= 0xFF  # the usual start value
    columns = np.ascontiguousarray(data.view("<u2").reshape(-1, LANE // 2).T)
    state = np.zeros(len(columns[0]), np.uint32)
    for column in columns:
        state = _PAIR[(state ^ column) & 0xFFFF] ^ (state >> 16)
    after = np.repeat(ends, lanes) - 1 - np.arange(len(state))  # lanes that follow in the same payload
    bit = 0
    while (after >> bit).any():
        while len(_SHIFTS) <= bit:
            _SHIFTS.append(_zeros_operator(LANE) if not _SHIFTS else _doubled(_SHIFTS[-1]))
        on = (after >> bit & 1).astype(bool)
        state[on] = _apply(_SHIFTS[bit], state[on])
        bit += 1
    return np.bitwise_xor.reduceat(state, ends - lanes) ^ np.uint32(0xFFFFFFFF)


def _doubled(table: np.ndarray) -> np.ndarray:
    return np.stack([_apply(table, table[k]) for k in range(4)])


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint64)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA & 0xFFFFFFFF).astype("<u4")


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The records of the payloads, and the size of each record."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    length_sums, sums = masked(crc32c(lengths)), masked(crc32c(payloads))
    out = b"".join(x for n, a, p, b in zip(lengths, length_sums, payloads, sums) for x in (n, a.tobytes(), p, b.tobytes()))
    return out, np.array([len(p) + 16 for p in payloads], np.int64)


def unframe(data: bytes) -> list[bytes]:
    """The payloads of whole records; damaged records raise."""
    payloads, at, checks = [], 0, []
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        if at + 16 + n > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        payloads.append(data[at + 12:at + 12 + n])
        checks.append((data[at:at + 8], data[at + 8:at + 12], data[at + 12 + n:at + 16 + n]))
        at += 16 + n
    if not (np.array_equal(masked(crc32c([c[0] for c in checks])), np.frombuffer(b"".join(c[1] for c in checks), "<u4"))
            and np.array_equal(masked(crc32c(payloads)), np.frombuffer(b"".join(c[2] for c in checks), "<u4"))):
        raise ValueError("a checksum does not match")
    return payloads


def pack_document(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return struct.pack("<BBq", width, doc_id is not None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def unpack_document(payload: bytes) -> tuple[int | None, np.ndarray]:
    width, present, doc_id = struct.unpack_from("<BBq", payload)
    return (doc_id if present else None), np.frombuffer(payload, f"<u{width}", offset=10)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, shards: int | None = None) -> DataFrame:
    """Write ``docs`` in ascending id order (a missing id first) as token files in ``folder``; return their manifest.

    One file per range of ids. Each task attempt writes files of its own name, and only those of attempts that succeeded are in the
    manifest (shard, path, n_records, n_tokens, n_bytes), so lost executors and repeated tasks do no harm. A missing text is empty: the end id alone.
    Rows with one id are written one after another. An empty table gives an empty manifest.
    """
    path, spark = tokenizer or default_tokenizer(), docs.sparkSession
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64(whole("text"))]
    d = d.repartitionByRange(shards or shuffle_partitions(spark), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, coder = TaskContext.get(), encoder(path)
        batches = bounded(batches, "text")
        first = next(batches, None)
        if first is None:
            return
        name = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        store, local = _filesystem(name)
        store.create_dir(local.rpartition("/")[0], recursive=True)
        sizes, tokens = [], []
        with store.open_output_stream(local + ".rec") as out:
            batch = first
            while batch is not None:
                ids, bounds = coder.encode(batch.column("text"))
                payloads = [pack_document(k, ids[a:b]) for k, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist())]
                data, size = frame(payloads)
                out.write(data)
                sizes.append(size)
                tokens.append(np.diff(bounds))
                batch = next(batches, None)
        sizes, tokens = np.concatenate(sizes), np.concatenate(tokens)
        index = np.stack([np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(tokens)])], axis=1).astype("<i8")
        with store.open_output_stream(local + ".idx") as out:
            out.write(index.tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [name], "n_records": [len(sizes)],
                                          "n_tokens": [int(tokens.sum())], "n_bytes": [int(sizes.sum())]})

    return materialize(d.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all records; ``start`` counts the ids of all records before, ``ids`` are little-endian unsigned 32-bit.

    The slices of the files are dealt out at random, each found by the index.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    slices = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    slices = slices.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_records") - 1, F.lit(READ_RECORDS).cast("bigint"))))
    slices = slices.select("path", "base", "at", "n_records").repartition(shuffle_partitions(manifest.sparkSession), "path", "at")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, local = _filesystem(row["path"])
                n = min(READ_RECORDS, row["n_records"] - row["at"])
                with store.open_input_file(local + ".idx") as f:
                    f.seek(16 * row["at"])
                    index = np.frombuffer(f.read(16 * (n + 1)), "<i8").reshape(-1, 2)
                with store.open_input_file(local + ".rec") as f:
                    f.seek(int(index[0, 0]))
                    lo = 0
                    while lo < n:  # a few MB at once, or one record
                        hi = max(lo + 1, int(np.searchsorted(index[:, 0], index[lo, 0] + (4 << 20), side="right")) - 1)
                        documents = [unpack_document(p) for p in unframe(f.read(int(index[hi, 0] - index[lo, 0])))]
                        counts = [len(ids) for _, ids in documents]
                        if counts != np.diff(index[lo:hi + 1, 1]).tolist():
                            raise ValueError(f"index and records of {row['path']} differ")
                        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in documents], pa.int64()), pa.array(row["base"] + index[lo:hi, 1]), pa.array(counts, pa.int64()),
                                                          pa.array([ids.astype("<u4").tobytes() for _, ids in documents], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                        lo = hi

    return slices.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def round_trip(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    return read_token_files(write_token_files(docs, scratch_path(spark, "tokens"), **options))
