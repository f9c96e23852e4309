"""Vector aggregates, column statistics and standardisation."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import l2_norm


def mean_of(vector, weight=None) -> Column:
    """Element-wise (weighted) mean aggregate: a JVM aggregate with map-side combine."""
    v = array_to_vector(vector)
    agg = Summarizer.mean(v) if weight is None else Summarizer.mean(v, weight if isinstance(weight, Column) else F.col(weight))
    return vector_to_array(agg)


def sum_of(vector) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(vector)))


def max_of(vector) -> Column:
    return vector_to_array(Summarizer.max(array_to_vector(vector)))


def vector_mean(df: DataFrame, keys: list[str], vector: str, weight=None, out: str = "vector",
                extra: list[Column] | None = None) -> DataFrame:
    """One vector per key: the mean of all its vectors, plus the row count and ``extra`` aggregates."""
    return df.groupBy(*keys).agg(
        mean_of(F.col(vector), weight).alias(out), F.count(F.lit(1)).alias("n_source_rows"), *(extra or []))


def explode_vector(df: DataFrame, keys: list[str], vector: str, pos: str = "dim", value: str = "value") -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias(pos, value))


def column_stats(df: DataFrame, vector: str) -> DataFrame:
    """Per position: mean, population deviation, min, max, count, NaN and Inf counts.

    ``posexplode`` plus a plain hash aggregate runs inside generated code, and
    each map task sends one row per position.
    """
    v = F.col("value")
    return (explode_vector(df, [], vector)
            .withColumn("value", v.cast("double"))
            .groupBy("dim")
            .agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"),
                 F.count(v).alias("n"), F.count_if(F.isnan(v)).alias("n_nan"),
                 F.count_if(F.abs(v) == F.lit(float("inf"))).alias("n_inf")))


def _stat_arrays(stats: DataFrame) -> DataFrame:
    """The statistics as one row of arrays; its size is the vector width."""
    ordered = F.array_sort(F.collect_list(F.struct("dim", "mean", "std")))
    return stats.agg(ordered.alias("s"))


def zscore(df: DataFrame, vector: str, out: str | None = None, dtype: str = "double",
           stats: DataFrame | None = None) -> DataFrame:
    """Column z-score with population deviation; a zero deviation divides by one.

    The statistics are a one-row scalar subquery of vector width, inlined by the
    planner, so no join and no shuffle of the vectors takes place.
    """
    arrays = _stat_arrays(stats if stats is not None else column_stats(df, vector))
    centred = F.zip_with(F.col(vector), F.col("_stats"), lambda x, p: (x.cast("double") - p["mean"]) / F.when(
        p["std"] == 0, F.lit(1.0)).otherwise(p["std"]))
    return (df.withColumn("_stats", arrays.scalar())
            .withColumn(out or vector, centred.cast(f"array<{dtype}>")).drop("_stats"))


def impute_column_mean(df: DataFrame, vector: str) -> DataFrame:
    """Replace NULL / NaN / Inf cells by the mean of the finite cells of the column, else 0."""
    finite = F.transform(F.col(vector), lambda x: F.when(
        x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x.cast("double")))
    ready = df.withColumn(vector, finite)
    means = (explode_vector(ready, [], vector).groupBy("dim")
             .agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean")))
    row = means.agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("s")).scalar()
    filled = F.zip_with(F.col(vector), F.col("_means"), lambda x, p: F.coalesce(x, p["mean"]))
    return ready.withColumn("_means", row).withColumn(vector, filled).drop("_means")


def l2_normalize(df: DataFrame, vector: str) -> DataFrame:
    norm = l2_norm(vector)
    return df.withColumn(vector, F.when(norm == 0, F.col(vector).cast("array<double>")).otherwise(
        F.transform(F.col(vector), lambda x: x.cast("double") / norm)))


def central_window_summary(vector, center: int, half: int, op: str = "mean") -> Column:
    """Mean or max of the positions within ``half`` of the centre, ignoring NaN."""
    part = F.filter(F.slice(F.col(vector), max(center - half, 0) + 1, half + min(center, half)),
                    lambda x: ~F.isnan(x))
    if op == "max":
        return F.array_max(part).cast("double")
    return F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.when(F.size(part) > 0, F.size(part))


def duplicate_vector_count(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows minus distinct vectors, as one row ``[n_rows, n_distinct, n_duplicates]``.

    Only 8-byte fingerprints are shuffled for all rows; whole vectors are
    compared for the rows whose fingerprint occurs more than once.
    """
    prints = df.select(F.xxhash64(vector).alias("_fp"))
    repeated = prints.groupBy("_fp").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1).select("_fp")
    suspects = df.withColumn("_fp", F.xxhash64(vector)).join(repeated, "_fp", "left_semi")
    groups = suspects.groupBy("_fp", vector).agg(F.count(F.lit(1)).alias("_c"))
    extra = groups.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("n_duplicates")).scalar()
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", (F.col("n_rows") - extra).alias("n_distinct"), extra.alias("n_duplicates"))
