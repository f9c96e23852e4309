"""Writers: tables, vector packages, text formats and file digests."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import with_row_index


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, sep: str = "\t") -> None:
    """Delimited text with a header and a fixed column order; extra columns are left out."""
    df.select(*(columns or df.columns)).write.mode("overwrite").csv(path, sep=sep, header=True, emptyValue="", quote='"', escape='"')


def wrap_lines(sequence, width: int = 80) -> Column:
    c = F.col(sequence) if isinstance(sequence, str) else sequence
    return F.regexp_replace(c, f"(.{{{width}}})", "$1\n")


def write_fasta(df: DataFrame, path: str, header_parts: list[str], sequence: str, width: int = 80) -> None:
    """One record per row: ``>a|b|c`` and the sequence in lines of ``width``."""
    head = F.concat(F.lit(">"), F.concat_ws("|", *header_parts))
    body = F.regexp_replace(wrap_lines(sequence, width), "\n$", "")
    df.select(F.concat(head, F.lit("\n"), body).alias("value")).write.mode("overwrite").text(path)


def write_sentences(df: DataFrame, tokens: str, path: str) -> None:
    df.select(F.array_join(tokens, " ").alias("value")).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)


def vector_package(vectors: DataFrame, genes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Canonical matrix table: ``embedding_row, key, gene columns, vector``.

    Alignment is the row itself; the dense row number is kept for exports.
    """
    joined = vectors.join(genes, key)
    return with_row_index(joined, order, "embedding_row")


def write_package(package: DataFrame, path: str, metadata: dict, reports: dict[str, DataFrame]) -> None:
    """Matrix as Parquet, gene columns and reports as TSV, provenance as one JSON row."""
    package.write.mode("overwrite").parquet(f"{path}/matrix")
    gene_columns = [c for c, t in package.dtypes if not t.startswith("array")]
    write_table(package.orderBy("embedding_row"), f"{path}/genes", gene_columns)
    for name, report in reports.items():
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in report.dtypes]
        write_table(report.select(*flat), f"{path}/reports/{name}")
    write_metadata(package.sparkSession, metadata, f"{path}/metadata")


def metadata_row(counts: DataFrame, **fixed) -> DataFrame:
    """Join a one-row count table and constants into one JSON document column."""
    cols = [F.lit(v).alias(k) for k, v in fixed.items()]
    return counts.select(F.to_json(F.struct(*cols, *counts.columns)).alias("value"))


def write_metadata(spark, metadata: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def text_report(title: str, summary: DataFrame) -> str:
    """Plain text of a one-row summary."""
    row = summary.limit(1).collect()[0].asDict()
    return "\n".join([title, "=" * len(title), "", *[f"{k}: {v}" for k, v in row.items()]]) + "\n"


def export_npz(package: DataFrame, path: str, max_cells: int = 200_000_000) -> None:
    """Optional single-file export of a package that is small enough for one machine."""
    import numpy as np

    n = package.count()
    first = package.select("vector").first()
    if first is None or n * len(first[0]) > max_cells:
        raise ValueError("the matrix is empty or too large for a single file; read the Parquet table instead")
    rows = package.orderBy("embedding_row").toPandas()
    gene = "ensembl_gene_id" if "ensembl_gene_id" in rows else rows.columns[1]
    np.savez_compressed(path, embeddings=np.stack(rows["vector"]).astype("float32"), gene=rows[gene].to_numpy(dtype=str))


def export_npy(package: DataFrame, path: str, max_cells: int = 200_000_000) -> None:
    import numpy as np

    n = package.count()
    first = package.select("vector").first()
    if first is None or n * len(first[0]) > max_cells:
        raise ValueError("the matrix is empty or too large for a single file; read the Parquet table instead")
    rows = package.orderBy("embedding_row").select("vector").toPandas()
    np.save(path, np.stack(rows["vector"]).astype("float32"))


LARGE_FILE = 128 << 20  # bytes; files up to this size are read as one cell


def file_digests(spark, paths: list[str] | str) -> DataFrame:
    """``[path, length, sha256, md5]`` of whole files.

    A digest is a chain over the bytes in their order, so one task has to see
    all of a file; it need not hold it. A large file is read by many tasks as
    the bytes between line ends, which one task per file hashes in their order.
    A byte that goes missing on that way is an error, never a wrong digest.
    """
    files = spark.read.format("binaryFile").load(paths)
    whole = files.where(F.col("length") <= LARGE_FILE).select("path", "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))
    # the text reader names a file by its encoded address
    large = {r["file_path"]: r["path"] for r in files.where(F.col("length") > LARGE_FILE).select("path", "_metadata.file_path").collect()}
    return whole.unionByName(_chained_digests(spark, large)) if large else whole


def _chained_digests(spark, paths: dict[str, str]) -> DataFrame:
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text([re.sub(r"([*?{}\[\]\\])", r"\\\1", p) for p in paths.values()]).select(
        meta["file_path"].alias("path"), meta["file_size"].alias("length"), meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, length, seen, chains = None, 0, 0, ()

        def result() -> pa.RecordBatch:
            if length - seen == 1:  # a line end closes the file
                for c in chains:
                    c.update(b"\n")
            elif length != seen:
                raise ValueError(f"{path}: {seen} bytes read, {length} expected")
            return pa.RecordBatch.from_pydict({"path": [paths[path]], "length": [length], "sha256": [chains[0].hexdigest()], "md5": [chains[1].hexdigest()]})

        for batch in batches:
            names, sizes, values = batch.column("path"), batch.column("length"), batch.column("bytes")
            start = 0
            while start < len(names):
                name = names[start].as_py()
                if name != path:
                    if path is not None:
                        yield result()
                    path, length, seen, chains, lead = name, sizes[start].as_py(), 0, (hashlib.sha256(), hashlib.md5()), b""
                n = pc.sum(pc.equal(names.slice(start), name)).as_py()  # the rows of one file are neighbours
                part = lead + b"\n".join(values.slice(start, n).to_pylist())
                for c in chains:
                    c.update(part)
                seen, start, lead = seen + len(part), start + n, b"\n"
        if path is not None:
            yield result()

    in_order = lines.repartition(len(paths), "path").sortWithinPartitions("path", "block", "at").select("path", "length", "bytes")
    return in_order.mapInArrow(run, "path string, length bigint, sha256 string, md5 string")
