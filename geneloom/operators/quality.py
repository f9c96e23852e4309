"""Quality gates, row accounting and summary reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import count_inf, count_nan, l2_norm, percent
from .vectors import column_stats, duplicate_vector_count

PASSED, FAILED, CHECK = "processed_qc_passed", "processed_qc_failed", "processed_qc_check_needed"


def require_columns(df: DataFrame, columns: list[str], what: str = "input") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    return df


def column_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """``[column_name, present, n_rows]`` of required columns, beside the number of rows they were asked of."""
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    flags = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(c in df.columns).alias("present")) for c in columns])
    return n.select(F.explode(flags).alias("c"), "n_rows").select("c.column_name", "c.present", "n_rows")


def find_column(df: DataFrame, candidates: list[str]) -> str | None:
    """First candidate that exists, ignoring case."""
    lower = {c.lower(): c for c in df.columns}
    return next((lower[c.lower()] for c in candidates if c.lower() in lower), None)


def columns_containing(df: DataFrame, preferred: list[str], parts: list[str]) -> list[str]:
    """Preferred columns first, then any column whose name contains one of ``parts``."""
    lower = {c.lower(): c for c in df.columns}
    first = [lower[p.lower()] for p in preferred if p.lower() in lower]
    rest = [c for c in df.columns if c not in first and any(p in c.lower() for p in parts)]
    return [*first, *rest]


def row_flags(df: DataFrame, vector: str) -> DataFrame:
    """NaN, Inf and zero-vector counts in one pass over the rows."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(count_nan(vector)), F.lit(0)).alias("n_nan"),
        F.coalesce(F.sum(count_inf(vector)), F.lit(0)).alias("n_inf"),
        F.count_if(l2_norm(vector) == 0).alias("n_zero_vectors"))


def constant_columns(df: DataFrame, vector: str) -> DataFrame:
    return column_stats(df, vector).where(F.col("hi") - F.col("lo") == 0)


def gate(df: DataFrame, key: str, vector: str, fail_on: tuple[str, ...], bad_status: str = CHECK,
         token: str | None = None) -> DataFrame:
    """One-row gate: the counters and a status that depends on those in ``fail_on``.

    ``fail_on`` is any of ``n_nan, n_inf, n_zero_vectors, n_duplicate_keys,
    n_duplicate_vectors, n_constant_columns, n_duplicate_tokens``.
    """
    out = row_flags(df, vector)
    distinct = df.agg(F.count_distinct(key).alias("d")).scalar()
    out = out.withColumn("n_duplicate_keys", F.col("n_rows") - distinct)
    if "n_duplicate_vectors" in fail_on:
        out = out.withColumn("n_duplicate_vectors", duplicate_vector_count(df, key, vector).select("n_duplicates").scalar())
    if "n_constant_columns" in fail_on:
        out = out.withColumn("n_constant_columns", constant_columns(df, vector).agg(F.count(F.lit(1)).alias("n")).scalar())
    if "n_duplicate_tokens" in fail_on:
        out = out.withColumn("n_duplicate_tokens", F.col("n_rows") - df.agg(F.count_distinct(token).alias("d")).scalar())
    bad = reduce(lambda a, b: a | b, [F.col(c) > 0 for c in fail_on])
    return out.withColumn("status", F.when(bad, F.lit(bad_status)).otherwise(F.lit(PASSED)))


# Which counters stop which family of packages.
GATE_STRICT = ("n_nan", "n_inf", "n_zero_vectors", "n_duplicate_vectors", "n_constant_columns", "n_duplicate_keys")
GATE_ANNOTATION = ("n_nan", "n_inf", "n_zero_vectors", "n_constant_columns", "n_duplicate_keys")
GATE_BASIC = ("n_nan", "n_inf", "n_zero_vectors", "n_duplicate_keys")
GATE_TOKEN = (*GATE_BASIC, "n_duplicate_tokens")


def permutation_check(df: DataFrame, index: str) -> DataFrame:
    """One row: is the index column exactly 0..n-1?"""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(index).alias("lo"), F.max(index).alias("hi"),
        F.count_distinct(index).alias("n_distinct")).withColumn(
        "is_permutation", (F.col("lo") == 0) & (F.col("hi") == F.col("n_rows") - 1) & (F.col("n_distinct") == F.col("n_rows")))


def coverage(part: DataFrame, whole: DataFrame) -> DataFrame:
    n = part.agg(F.count(F.lit(1)).alias("n")).scalar()
    return whole.agg(F.count(F.lit(1)).alias("n_total")).select(
        n.alias("n_mapped"), "n_total", percent(n, "n_total").alias("coverage_percent"))


def added_and_lost(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row ``[n_added, n_lost, n_kept]`` comparing two key sets in one aggregate."""
    both = (old.select(key).withColumn("_o", F.lit(1)).withColumn("_n", F.lit(0))
            .unionByName(new.select(key).withColumn("_o", F.lit(0)).withColumn("_n", F.lit(1))))
    per_key = both.groupBy(key).agg(F.max("_o").alias("o"), F.max("_n").alias("n"))
    return per_key.agg(F.count_if((F.col("n") == 1) & (F.col("o") == 0)).alias("n_added"),
                       F.count_if((F.col("o") == 1) & (F.col("n") == 0)).alias("n_lost"),
                       F.count_if((F.col("o") == 1) & (F.col("n") == 1)).alias("n_kept"))
