"""Matrices as ``.npy`` files: a Spark data source that reads row ranges in parallel and writes shards under one commit.

``spark.read.format("npy_rows").load(path)`` reads a single ``.npy`` file, or a
folder that was written here, as ``[row, vector]``. Writing makes one shard per
task and, once every task is done, a manifest; a failed job removes its shards
and leaves no manifest, and a folder without one is not read. Paths are on a
file system that all executors mount.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT, MANIFEST = "npy_rows", "manifest.json"
BLOCK_BYTES = 64 << 20  # of one partition of a read


def local_path(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


@dataclass(frozen=True)
class Header:
    """Where the numbers of a ``.npy`` file start, and what they are."""

    start: int
    rows: int
    width: int
    dtype: str

    @classmethod
    def of(cls, path: str) -> Header:
        with open(path, "rb") as f:
            version = np.lib.format.read_magic(f)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, fortran, dtype = read(f)
            if len(shape) != 2 or fortran or dtype.hasobject:
                raise ValueError(f"{path}: not a row-major matrix of numbers")
            return cls(f.tell(), shape[0], shape[1], dtype.str)


@dataclass
class _Range(InputPartition):
    """Rows ``first`` to ``last`` of a file; ``ids``: the file that names them, or their own numbers count."""

    path: str
    header: Header
    first: int
    last: int
    ids: str | None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = local_path(options["path"])
        self.block = int(options.get("blockbytes", BLOCK_BYTES))
        self.width = int(options.get("width", 0))

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            with open(os.path.join(self.path, MANIFEST)) as f:  # a folder without one was never committed
                shards = [(os.path.join(self.path, s["data"]), os.path.join(self.path, s["rows"])) for s in json.load(f)["shards"]]
        else:
            shards = [(self.path, None)]
        out: list[InputPartition] = []
        for path, ids in shards:
            h = Header.of(path)
            if self.width and h.width != self.width:
                raise ValueError(f"{path}: {h.width} columns, not {self.width}")
            step = max(1, self.block // max(1, h.width * np.dtype(h.dtype).itemsize))
            out += [_Range(path, h, at, min(at + step, h.rows), ids) for at in range(0, h.rows, step)]
        return out or [_Range("", Header(0, 0, 0, "<f4"), 0, 0, None)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        h, at = part.header, part.first
        size = np.dtype(h.dtype).itemsize
        while at < part.last:
            n = min(4096, part.last - at)
            with open(part.path, "rb") as f:
                f.seek(h.start + at * h.width * size)
                x = np.frombuffer(f.read(n * h.width * size), h.dtype)
            if part.ids:
                with open(part.ids, "rb") as f:
                    f.seek(at * 8)
                    rows = np.frombuffer(f.read(n * 8), "<i8")
            else:
                rows = np.arange(at, at + n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * h.width), pa.array(x.astype(np.float32)))
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int64)), lists], names=["row", "vector"])
            at += n


@dataclass
class _Shard(WriterCommitMessage):
    data: str
    rows: str
    n: int
    width: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = local_path(options["path"]), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """One shard; its name is new, so a repeated task never meets the file of its first attempt."""
        os.makedirs(self.path, exist_ok=True)
        name = uuid.uuid4().hex
        shard = _Shard(f"{name}.npy", f"{name}.rows", 0, 0)
        raw = os.path.join(self.path, f"{name}.part")
        try:
            with open(raw, "wb") as data, open(os.path.join(self.path, shard.rows), "wb") as rows:
                for b in batches:
                    if b.num_rows:
                        x = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(b.num_rows, -1)
                        if shard.width and x.shape[1] != shard.width:
                            raise ValueError(f"vectors of {shard.width} and {x.shape[1]} numbers")
                        shard.width, shard.n = x.shape[1], shard.n + len(x)
                        data.write(x.tobytes())
                        rows.write(b.column("row").to_numpy().astype("<i8").tobytes())
            with open(os.path.join(self.path, shard.data), "wb") as out, open(raw, "rb") as data:
                np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (shard.n, shard.width)})
                while chunk := data.read(1 << 22):
                    out.write(chunk)
        except BaseException:
            self._drop([shard])
            raise
        finally:
            if os.path.exists(raw):
                os.remove(raw)
        return shard

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        shards = [m for m in messages if m is not None]
        target = os.path.join(self.path, MANIFEST)
        if len({s.width for s in shards if s.n}) > 1:
            self.abort(messages)
            raise ValueError("shards differ in width")
        old = []
        if os.path.exists(target):
            with open(target) as f:
                old = json.load(f)["shards"]
        kept = [] if self.overwrite else old
        listed = kept + [{"data": s.data, "rows": s.rows, "n": s.n} for s in shards if s.n]
        with open(target + ".new", "w") as f:
            json.dump({"rows": sum(s["n"] for s in listed), "shards": listed}, f)
        os.replace(target + ".new", target)  # the commit
        self._drop([s for s in shards if not s.n])
        if self.overwrite:
            self._drop([_Shard(s["data"], s["rows"], 0, 0) for s in old])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop([m for m in messages if m is not None])

    def _drop(self, shards: list[_Shard]) -> None:
        for s in shards:
            for name in (s.data, s.rows):
                if os.path.exists(os.path.join(self.path, name)):
                    os.remove(os.path.join(self.path, name))


class NpyRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "row bigint, vector array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def read_npy_rows(spark: SparkSession, path: str, **options) -> DataFrame:
    """``[row, vector]`` of a ``.npy`` file or a committed folder; each task seeks to its own rows."""
    spark.dataSource.register(NpyRows)
    reader = spark.read.format(FORMAT)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)


def write_npy_rows(df: DataFrame, path: str, row: str, vector: str) -> None:
    """Write ``[row, vector]`` as shards and a manifest; nothing passes through the driver."""
    df.sparkSession.dataSource.register(NpyRows)
    rows = df.selectExpr(f"cast(`{row}` as bigint) as row", f"cast(`{vector}` as array<float>) as vector")
    rows.write.format(FORMAT).mode("append").save(path)
