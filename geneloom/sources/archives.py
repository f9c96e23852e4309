"""Readers for archives, pickled dictionaries and binary matrices.

The work runs in tasks on ``binaryFile`` rows or file slices; the driver only
looks at headers. Checkpoints that need an absent library are read when the
library is present and refused with a clear error otherwise.
"""

from __future__ import annotations

import hashlib
import io
import pickle
import tarfile
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_single_member_zip(spark: SparkSession, path, sep: str = "\t") -> DataFrame:
    """String table from a zip that holds exactly one delimited file."""
    return zip_table(spark.read.format("binaryFile").load(path).select("path", "content"), sep)


def zip_table(files: DataFrame, sep: str = "\t") -> DataFrame:
    """String table from ``[path, content]`` zips of one delimited file each, all with the same header."""

    def lines(batches):
        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = z.namelist()
                    if len(names) != 1:
                        raise ValueError(f"expected one file inside {where}, found {names}")
                    with io.TextIOWrapper(z.open(names[0]), encoding="utf-8", newline="") as text:
                        rows, no = [], 0
                        for line in text:
                            rows.append((no, line.rstrip("\r\n")))
                            no += 1
                            if len(rows) == 10000:
                                yield pd.DataFrame(rows, columns=["file_row", "value"])
                                rows = []
                        if rows:
                            yield pd.DataFrame(rows, columns=["file_row", "value"])

    raw = files.mapInPandas(lines, "file_row bigint, value string")
    head = raw.where("file_row = 0").first()
    if head is None:
        raise ValueError("the archive is empty")
    names = head["value"].split(sep)
    cells = F.split("value", sep)
    return raw.where("file_row > 0 AND value <> ''").select(
        *[F.coalesce(F.get(cells, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)], "file_row")


def read_tar_members(spark: SparkSession, path, sha256: dict[str, str]) -> DataFrame:
    """``[member, content, sha256]`` of the named regular members; a wrong digest is an error."""
    return tar_members(spark.read.format("binaryFile").load(path).select("content"), sha256)


def tar_members(files: DataFrame, sha256: dict[str, str]) -> DataFrame:
    wanted = dict(sha256)

    def unpack(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for name, expected in wanted.items():
                        info = tar.getmember(name)
                        if not info.isfile():
                            raise ValueError(f"{name} is not a regular file")
                        data = tar.extractfile(info).read()
                        got = hashlib.sha256(data).hexdigest()
                        if expected and got != expected:
                            raise ValueError(f"{name}: digest {got} differs from {expected}")
                        yield pd.DataFrame({"member": [name], "content": [data], "sha256": [got]})

    return files.select("content").mapInPandas(unpack, "member string, content binary, sha256 string")


class _DataOnly(pickle.Unpickler):
    """Accepts containers, numbers, text and numpy arrays; refuses every other class."""

    _allowed = {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"),
                ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar"), ("numpy._core.numeric", "_frombuffer"),
                ("numpy.core.numeric", "_frombuffer"), ("collections", "OrderedDict")}

    def find_class(self, module, name):
        if (module, name) not in self._allowed:
            raise pickle.UnpicklingError(f"{module}.{name} is not plain data")
        return super().find_class(module, name)


def read_pickled_dictionary(spark: SparkSession, path, kind: str = "vector") -> DataFrame:
    """``[key, vector]`` (``kind='vector'``) or ``[key, value]`` text pairs of a pickled dict."""
    return pickle_entries(spark.read.format("binaryFile").load(path).select("content"), kind)


def pickle_entries(files: DataFrame, kind: str = "vector") -> DataFrame:
    schema = "key string, vector array<float>" if kind == "vector" else "key string, value string"

    def load(batches):
        for pdf in batches:
            for content in pdf["content"]:
                data = _DataOnly(io.BytesIO(content)).load()
                if not isinstance(data, dict):
                    raise ValueError("expected a pickled dictionary")
                rows = []
                for k, v in data.items():
                    rows.append((str(k), np.asarray(v, dtype=np.float32) if kind == "vector" else str(v)))
                    if len(rows) == 2000:
                        yield pd.DataFrame(rows, columns=["key", "vector" if kind == "vector" else "value"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["key", "vector" if kind == "vector" else "value"])

    return files.select("content").mapInPandas(load, schema)


def read_npy(spark: SparkSession, path: str, dtype: str | None = None, dim: int | None = None, block: int = 4096) -> DataFrame:
    """``[row, vector]`` of a 2-D ``.npy`` on a path all executors can open; each task maps its own rows."""
    shape_of = np.load(path, mmap_mode="r", allow_pickle=False)
    n, width = shape_of.shape
    if (dim is not None and width != dim) or (dtype is not None and str(shape_of.dtype) != dtype):
        raise ValueError(f"unexpected matrix: shape {shape_of.shape}, dtype {shape_of.dtype}")

    def slices(batches):
        m = np.load(path, mmap_mode="r", allow_pickle=False)
        for pdf in batches:
            for start in pdf["start"]:
                part = np.asarray(m[start:start + block], dtype=np.float32)
                yield pd.DataFrame({"row": np.arange(start, start + len(part)), "vector": list(part)})

    starts = spark.range(0, n, block).withColumnRenamed("id", "start")
    return starts.repartition(max(1, min(1000, -(-n // block)))).mapInPandas(slices, "row bigint, vector array<float>")


def read_checkpoint_table(spark: SparkSession, path: str, key: str | None = None, preferred: tuple[str, ...] = ()) -> DataFrame:
    """``[token_id, vector]`` of a 2-D weight; Parquet exports are read as they are.

    ``preferred`` lists key names or endings in order; without a match the widest
    table wins, as a vocabulary weight has the most rows.
    """
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select("token_id", "vector")
    try:
        import torch
    except ImportError as err:
        raise RuntimeError("reading a model checkpoint needs torch; export the weight to Parquet [token_id, vector]") from err
    state = torch.load(path, map_location="cpu", weights_only=True)
    tables = {k: v for k, v in state.items() if getattr(v, "ndim", 0) == 2}
    name = key or next((k for p in preferred for k in tables if k == p or k.endswith(p)), None) or max(tables, key=lambda k: tables[k].shape[0])
    weight = tables[name].float().numpy()
    return spark.createDataFrame(pd.DataFrame({"token_id": np.arange(len(weight)), "vector": list(weight)}), "token_id bigint, vector array<float>")


def read_annotated_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``[gene_id, vector]`` of an annotated matrix file; Parquet exports are read as they are."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select("gene_id", "vector")
    try:
        import anndata
    except ImportError as err:
        raise RuntimeError("reading this file needs anndata; export it to Parquet [gene_id, vector]") from err
    data = anndata.read_h5ad(path)
    x = data.X.toarray() if hasattr(data.X, "toarray") else np.asarray(data.X)
    return spark.createDataFrame(pd.DataFrame({"gene_id": list(data.obs_names), "vector": list(x.astype("float32"))}), "gene_id string, vector array<float>")


def read_context_parquet(spark: SparkSession, path: str) -> DataFrame:
    """``entrez_id, tissue, embedding`` columns only, vectors as float."""
    return spark.read.parquet(path).select("entrez_id", "tissue", F.col("embedding").cast("array<float>").alias("embedding"))
