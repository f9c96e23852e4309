"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# At most this many keys are treated as hot; by the pigeonhole principle every
# key with more than 1/256 of all rows is among the 256 most frequent ones.
MAX_HOT_KEYS = 256
SALTS = 64


def hot_keys(freq: DataFrame, keys: list[str], count_col: str, limit: int = MAX_HOT_KEYS) -> DataFrame:
    """The most frequent keys of a ``[keys, count]`` table; never more than ``limit`` rows."""
    return freq.orderBy(F.col(count_col).desc(), *keys).limit(limit).select(*keys)


def key_frequency(df: DataFrame, keys: list[str], count_col: str = "_rows") -> DataFrame:
    """Row count per key; the counts are combined on the map side before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    hot: DataFrame,
    how: str = "inner",
    spread_by: list[str] | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join in which the rows of hot keys are spread over ``salts`` tasks.

    ``hot`` is a bounded table of keys (see :func:`hot_keys`). Left rows with a
    hot key get a salt derived from ``spread_by``; right rows with a hot key are
    copied once per salt. All other rows keep salt 0, so the result is the plain
    join. ``how`` may be ``inner`` or ``left``.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    flag = F.broadcast(hot.select(*keys).withColumn("_hot", F.lit(True)))
    spread = F.xxhash64(*(spread_by or [c for c in left.columns if c not in keys] or keys))
    unmatched = F.lit(False)  # NULL keys match nothing, but would all meet in one task
    for k in keys:
        unmatched = unmatched | F.col(k).isNull()
    left = (left.join(flag, keys, "left")
            .withColumn("_salt", F.when(F.coalesce("_hot", F.lit(False)) | unmatched, F.pmod(spread, F.lit(salts)).cast("int")).otherwise(F.lit(0)))
            .drop("_hot"))
    right = (right.join(flag, keys, "left")
             .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                                            .otherwise(F.array(F.lit(0)))))
             .drop("_hot"))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def plan_bytes(df: DataFrame) -> float:
    """The optimizer's own size estimate of a plan, in bytes."""
    try:
        return float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # no JVM handle (Spark Connect): treat as large
        return float("inf")


def fits_broadcast(df: DataFrame) -> bool:
    spark = df.sparkSession
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    if raw.startswith("-"):
        return False
    return plan_bytes(df) <= float(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(raw))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", spread_by: list[str] | None = None,
                salts: int = SALTS) -> DataFrame:
    """Equi-join with a table whose keys may repeat; the rows of keys that are hot on the left are spread, unless the right side is broadcast anyway."""
    if fits_broadcast(right):
        return left.join(right, keys, how)
    return salted_join(left, right, keys, hot_keys(key_frequency(left, keys), keys, "_rows"), how, spread_by, salts)


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    freq: DataFrame | None = None,
    freq_col: str = "_rows",
    spread_by: list[str] | None = None,
) -> DataFrame:
    """Join against a table that is unique on ``keys``.

    A right side the planner will broadcast on its own needs nothing special.
    Otherwise hot left keys are salted; ``freq`` may hand over a key count that
    is known anyway, which saves the counting pass.
    """
    if fits_broadcast(right):
        return left.join(right, keys, how)
    counts = freq if freq is not None else key_frequency(left, keys, freq_col)
    return salted_join(left, right, keys, hot_keys(counts, keys, freq_col), how, spread_by)
