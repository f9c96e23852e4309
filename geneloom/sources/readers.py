"""Readers for delimited text, vector text and JSON dictionaries.

Each reader returns a lazy DataFrame. ``file_row`` orders the rows as they stand
in the files (path, block offset, row within the block), because "first wins"
and "last wins" rules need that order; it is never used as a join position.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids, num
from ..operators import mapping
from ..operators.ranges import with_row_index
from . import splits


def file_order() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def read_lines(spark: SparkSession, path, line_sep: str | None = None) -> DataFrame:
    """``[value, file_row]`` of text files (plain or gzip)."""
    reader = spark.read
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    return reader.text(path).select("value", file_order().alias("file_row"))


def first_lines(spark: SparkSession, path, n: int) -> list[str]:
    """The first lines of a file, or of a folder's files by name, for deciding its layout. Spark itself reads the largest file first."""
    lines, found = spark.read.text(path), []
    here = F.regexp_replace("_metadata.file_path", ":/+", ":/")  # file:/a and file:///a are one file
    for name in sorted(lines.inputFiles()):
        found += [r["value"] for r in lines.where(here == re.sub(":/+", ":/", name)).head(n - len(found))]
        if len(found) == n:
            break
    return found


def without_head(lines: DataFrame, head: list[str], text: Column) -> DataFrame:
    """``lines`` without the first occurrence of each head line in each file; equal lines further down are data."""
    first = lines.where(text.isin(head)).groupBy(F.col("file_row.path"), text).agg(F.min("file_row").alias("head_row")).select("head_row")
    return lines.join(first, F.col("file_row") == F.col("head_row"), "left_anti")


def read_text_table(spark: SparkSession, path, sep: str = ",", required: list[str] | None = None, multi_line: bool = False,
                    keep_na: bool = False) -> DataFrame:
    """Header table with every column a string; NA spellings become ``''``.

    Quoted line breaks need ``multi_line``, which gives up splitting a file.
    """
    raw = (spark.read.option("header", True).option("inferSchema", False).option("sep", sep).option("quote", '"')
           .option("escape", '"').option("multiLine", multi_line).option("mode", "PERMISSIVE").csv(path))
    names = [c.lstrip("﻿") for c in raw.columns]
    table = raw.select(*[F.col(f"`{c}`") for c in raw.columns], file_order().alias("file_row")).toDF(*names, "file_row")
    missing = [c for c in required or [] if c not in names]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    if keep_na:
        return table
    return table.select(*[ids.na_to_empty(F.col(f"`{c}`")).alias(c) for c in names], "file_row")


def read_keyed_table(spark: SparkSession, path, key: str = "ensembl_gene_id") -> DataFrame:
    """Row table that must be non-empty and contain the key column."""
    table = read_text_table(spark, path, required=[key])
    if table.isEmpty():
        raise ValueError(f"{path} is empty")
    return table


def read_headerless(spark: SparkSession, path, names: list[str], sep: str = "\t", types: str = "string") -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    table = spark.read.schema(schema).option("sep", sep).csv(path).select(*names, file_order().alias("file_row"))
    return table if types == "string" else table.select(*[F.col(n).try_cast(types).alias(n) for n in names], "file_row")


def read_header_or_names(spark: SparkSession, path, names: list[str], sep: str = "\t") -> DataFrame:
    """Use the header if it has the expected names, else read headerless under them (extra columns dropped)."""
    head = (first_lines(spark, path, 1) or [""])[0].split(sep)
    if set(names) <= set(head):
        return read_text_table(spark, path, sep).select(*names, "file_row")
    if len(head) < len(names):
        raise ValueError(f"{path}: cannot interpret columns {head}")
    wide = read_headerless(spark, path, names + [f"_x{i}" for i in range(len(head) - len(names))], sep)
    return wide.select(*[ids.na_to_empty(n).alias(n) for n in names], "file_row")


# First cells that mark a header row.
HEADER_CELLS = ("gene", "token", "entrez", "entrez_id", "gene_id", "id")


def _vector_cells(line, sep: str) -> Column:
    return F.split(line, sep)


def _floats(cells) -> Column:
    return F.transform(cells, lambda c: num.to_number(c))


def _require_finite(df: DataFrame, vector: str, what) -> DataFrame:
    bad = df.where(~num.is_finite(vector)).limit(1).count()
    if bad:
        raise ValueError(f"{what} has non-finite numeric values")
    return df


def read_sniffed_vectors(spark: SparkSession, path) -> DataFrame:
    """``[source_token, vector, file_row]``; a header row is recognised by its first cell."""
    first = (first_lines(spark, path, 1) or [""])[0]
    header = first.split(",", 1)[0].strip().lower() in HEADER_CELLS
    lines = read_lines(spark, path).where(F.trim("value") != "")
    if header:
        lines = without_head(lines, [first], F.col("value"))
    cells = F.split("value", ",")
    out = lines.select(F.get(cells, F.lit(0)).alias("source_token"), _floats(F.slice(cells, F.lit(2), F.size(cells) - 1)).alias("vector"), "file_row")
    return _require_finite(out, "vector", path)


def read_entry_vectors(spark: SparkSession, path, key: str = "Entry") -> DataFrame:
    """``[Entry, vector, file_row]`` of a typed table whose first column must be ``Entry``."""
    header = (first_lines(spark, path, 1) or [""])[0].split(",")
    if not header or header[0] != key:
        raise ValueError(f"{path} does not have {key} as first column")
    schema = T.StructType([T.StructField(key, T.StringType())] + [T.StructField(f"_c{i}", T.FloatType()) for i in range(1, len(header))])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    return raw.select(key, F.array(*[F.col(f"_c{i}") for i in range(1, len(header))]).alias("vector"), file_order().alias("file_row"))


def read_headerless_vectors(spark: SparkSession, path, sep: str = ",") -> DataFrame:
    """``[source_id, vector, file_row]``: id and floats; rows without digits in the id or with a gap are dropped."""
    cells = F.split("value", sep)
    rows = read_lines(spark, path).where(F.trim("value") != "").select(
        F.regexp_extract(F.get(cells, F.lit(0)), r"(\d+)", 1).alias("source_id"), _floats(F.slice(cells, F.lit(2), F.size(cells) - 1)).alias("vector"), "file_row")
    return rows.where((F.col("source_id") != "") & F.forall("vector", lambda x: x.isNotNull()))


def read_id_list(spark: SparkSession, path) -> DataFrame:
    """``[source_id, row_index]`` of non-blank lines, normalised Entrez ids."""
    rows = read_lines(spark, path).where(ids.strip("value") != "").select(ids.norm_entrez_strict("value").alias("source_id"), "file_row")
    return with_row_index(rows, ["file_row"], "row_index").select("source_id", "row_index")


def read_repaired_matrix(spark: SparkSession, path, id_list: DataFrame, expected_dim: int) -> DataFrame:
    """``[source_id, row_index, vector]``: drop a header row, blank rows and columns and an id column.

    Rows meet their ids by an equi-join on the row index.
    """
    cells = read_lines(spark, path).where(F.trim("value") != "").select(_floats(F.split("value", ",")).alias("v"), "file_row")
    n_ids = id_list.count()
    indexed = with_row_index(cells, ["file_row"], "r")
    if indexed.count() == n_ids + 1:
        indexed = indexed.where("r > 0").withColumn("r", F.col("r") - 1)
    indexed = indexed.where(F.exists("v", lambda x: x.isNotNull()))
    used = indexed.select(F.posexplode("v").alias("c", "x")).where("x IS NOT NULL").select("c").distinct()
    keep = sorted(r["c"] for r in used.collect())  # one entry per matrix column
    if len(keep) == expected_dim + 1:
        keep = keep[1:]
    out = with_row_index(indexed.select("file_row", F.array(*[F.get(F.col("v"), F.lit(c)) for c in keep]).alias("vector")), ["file_row"], "row_index")
    if out.count() != n_ids:
        raise ValueError("matrix rows do not match the id list")
    if out.where(F.exists("vector", lambda x: x.isNull())).limit(1).count():
        raise ValueError("matrix has missing values after conversion")
    return id_list.join(out.select("row_index", "vector"), "row_index")


def read_word_vectors(spark: SparkSession, path) -> DataFrame:
    """``[source_id, vector, status, file_row]`` of whitespace word vectors.

    An optional ``count dim`` first line sets the width, else the first row does.
    Unusable rows keep a status: ``cannot_parse_floats`` or ``wrong_dim_<n>_expected_<d>``.
    """
    head = [x.split() for x in first_lines(spark, path, 2)]
    header = bool(head) and len(head[0]) == 2 and head[0][0].isdigit() and head[0][1].isdigit()
    dim = int(head[0][1]) if header else (len(head[0]) - 1 if head else 0)
    parts = F.split(ids.strip("value"), r"\s+")
    rows = read_lines(spark, path).where(ids.strip("value") != "")
    if header:
        rows = without_head(rows, [" ".join(head[0])], F.regexp_replace(ids.strip("value"), r"\s+", " "))
    vec = _floats(F.slice(parts, F.lit(2), F.size(parts) - 1))
    rows = rows.select(F.get(parts, F.lit(0)).alias("source_id"), vec.alias("vector"), "file_row")
    status = (F.when(F.exists("vector", lambda x: x.isNull()), F.lit("cannot_parse_floats"))
              .when(F.size("vector") != dim, F.concat(F.lit("wrong_dim_"), F.size("vector"), F.lit(f"_expected_{dim}")))
              .when(~num.is_finite("vector"), F.lit("nonfinite_vector")).otherwise(F.lit("ok")))
    return rows.select("source_id", "vector", status.alias("status"), "file_row")


def read_dense_rows(spark: SparkSession, path, id_path=None) -> DataFrame:
    """Whitespace matrix ``[row_index, vector]``, joined to a line-per-row id file if given."""
    rows = read_lines(spark, path).where(ids.strip("value") != "").select(_floats(F.split(ids.strip("value"), r"\s+")).alias("vector"), "file_row")
    indexed = with_row_index(rows, ["file_row"], "row_index").select("row_index", "vector")
    if id_path is None:
        return indexed
    names = read_lines(spark, id_path).where(ids.strip("value") != "").select(ids.strip("value").alias("source_id"), "file_row")
    names = with_row_index(names, ["file_row"], "row_index").select("source_id", "row_index")
    if names.count() != indexed.count():
        raise ValueError("id list and matrix have different lengths")
    return names.join(indexed, "row_index")


def read_links(spark: SparkSession, path, int_columns: list[str]) -> DataFrame:
    """Space-separated links with a header; scores as integers."""
    raw = spark.read.option("header", True).option("sep", " ").csv(path)
    keep = [c for c in raw.columns if c not in int_columns]
    return raw.select(*keep, *[F.col(c).try_cast("int").alias(c) for c in int_columns if c in raw.columns], file_order().alias("file_row"))


def read_chunks(spark: SparkSession, glob, key: str, sep: str = "\t") -> DataFrame:
    """All files of a glob as one string table; a repeated key is an error."""
    table = read_text_table(spark, glob, sep, required=[key], keep_na=True)
    mapping.assert_unique(table, [key], str(glob))
    return table


def read_gct(spark: SparkSession, path) -> DataFrame:
    """Expression table after two preamble lines; needs ``Name`` and ``Description``."""
    names = first_lines(spark, path, 3)[2].split("\t")
    if not {"Name", "Description"} <= set(names):
        raise ValueError(f"{path}: not an expression table")
    preamble = first_lines(spark, path, 3)
    rows = without_head(read_lines(spark, path).where(F.col("value") != ""), preamble, F.col("value"))
    cells = F.split("value", "\t")
    return rows.select(*[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)], "file_row")


def read_json_vectors(spark: SparkSession, path) -> DataFrame:
    """``[key, vector]`` of one JSON object of number lists.

    The file is split at closing brackets, so each entry is a record of its own
    and a large dictionary is read by many tasks.
    """
    entry = r'(?s)"((?:[^"\\]|\\.)*)"\s*:\s*\[(.*)$'
    rows = spark.read.option("lineSep", "]").text(path).select(
        F.regexp_extract("value", entry, 1).alias("key"), F.regexp_extract("value", entry, 2).alias("v")).where("key <> ''")
    return rows.select("key", _floats(F.filter(F.split("v", ","), lambda x: ids.strip(x) != "")).alias("vector"))


def _json_pairs(spark: SparkSession, path, per_line: bool) -> DataFrame:
    """``[key, value]`` of a JSON object per file, read by many tasks, or per line. Of a key that occurs twice in a file the last value counts."""
    if per_line:
        return spark.read.text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    entries = splits.read_json_entries(spark, path)
    return entries.groupBy("file", "key").agg(F.max_by("value", "entry").alias("value")).select("key", "value")


def read_json_texts(spark: SparkSession, path, per_line: bool = False) -> DataFrame:
    """``[key, text]`` of a JSON object per file (or per line); keys upper-cased, blanks dropped."""
    pairs = _json_pairs(spark, path, per_line)
    return pairs.select(F.upper(ids.strip("key")).alias("key"), ids.strip("value").alias("text")).where("key <> '' AND text <> ''")


def read_vocabulary(spark: SparkSession, path, per_line: bool = False) -> DataFrame:
    """``[token, token_id]`` of a JSON object per file (or per line); ids that are no integers are NULL."""
    pairs = _json_pairs(spark, path, per_line)
    return pairs.select(F.col("key").alias("token"), F.when(F.col("value").rlike(r"^-?\d+$"), F.col("value")).try_cast("bigint").alias("token_id"))


def score_columns(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """``[candidate, score]``: how many rows satisfy each test, best first."""
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in tests.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), F.col(n).alias("score")) for n in tests])).alias("s")).select(
        "s.*").orderBy(F.desc("score"), "candidate")


def dictionary_direction(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """One row: is the dictionary id -> token or token -> id?"""
    forward = F.count_if(ids.strip_version_suffix(left).startswith("ENSG") & F.col(right).rlike(r"^\d+$"))
    backward = F.count_if(ids.strip_version_suffix(right).startswith("ENSG") & F.col(left).rlike(r"^\d+$"))
    return pairs.agg(forward.alias("ens_to_int"), backward.alias("int_to_ens")).withColumn(
        "direction", F.when(F.col("ens_to_int") >= F.col("int_to_ens"), F.lit("ens_to_int")).otherwise(F.lit("int_to_ens")))


def pick_best_candidate(spark: SparkSession, candidates: dict[str, DataFrame], test) -> str:
    """Name of the source with the most rows that satisfy ``test``."""
    scores = None
    for name, df in candidates.items():
        one = df.agg(F.count_if(test).alias("score")).withColumn("candidate", F.lit(name))
        scores = one if scores is None else scores.unionByName(one)
    best = scores.orderBy(F.desc("score"), "candidate").first()
    if best is None or best["score"] == 0:
        raise ValueError("no usable source found")
    return best["candidate"]
