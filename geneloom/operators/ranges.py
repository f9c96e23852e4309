"""Order-dependent operators without a single-task global window.

A table is range-partitioned and sorted once by a *unique* order, written to the
shared folder with its bucket number and position, and then finished with one
row of carry-over per bucket. No task ever holds more than one range bucket, so
a hot group is cut into as many buckets as its rows need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions

BUCKET, POSITION = "_bucket", "_position"


def sorted_buckets(df: DataFrame, order: list, buckets: int | None = None) -> DataFrame:
    """Range-partition and sort by ``order``; adds ``_bucket`` and ``_position``."""
    n = buckets or shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return materialize(
        ranged.withColumn(BUCKET, F.spark_partition_id())
        .withColumn(POSITION, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "buckets")


def _carry(per_bucket: DataFrame, column: str, alias: str) -> DataFrame:
    """Sum of ``column`` over all earlier buckets; one row per bucket."""
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.select(BUCKET, F.coalesce(F.sum(column).over(before), F.lit(0)).alias(alias))


def with_row_index(df: DataFrame, order: list, name: str = "row_index", buckets: int | None = None) -> DataFrame:
    """0-based dense index in the given order."""
    placed = sorted_buckets(df, order, buckets)
    sizes = placed.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    offsets = F.broadcast(_carry(sizes, "_n", "_offset"))  # one row per bucket
    return (placed.join(offsets, BUCKET)
            .withColumn(name, F.col("_offset") + F.col(POSITION))
            .drop(BUCKET, POSITION, "_offset"))


def running_sum(df: DataFrame, order: list, column: str, name: str, buckets: int | None = None) -> DataFrame:
    """Cumulative sum of ``column`` in the given (unique) order."""
    placed = sorted_buckets(df, order, buckets)
    totals = placed.groupBy(BUCKET).agg(F.sum(column).alias("_n"))
    offsets = F.broadcast(_carry(totals, "_n", "_offset"))
    inside = Window.partitionBy(BUCKET).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, 0)
    return (placed.join(offsets, BUCKET)
            .withColumn(name, F.col("_offset") + F.sum(column).over(inside))
            .drop(BUCKET, POSITION, "_offset"))


def with_neighbours(
    df: DataFrame,
    group: list[str],
    order: list[str],
    columns: list[str],
    following: str = "next_",
    preceding: str = "prev_",
    buckets: int | None = None,
) -> DataFrame:
    """Values of the previous and next row of the same group (NULL at its ends).

    ``group + order`` must be unique. Equal to ``lag``/``lead`` over
    ``partition by group order by order``.
    """
    placed = sorted_buckets(df, [*group, *order], buckets)
    payload = F.struct(*[F.col(c) for c in dict.fromkeys([*group, *columns])])
    edges = placed.groupBy(BUCKET).agg(
        F.min_by(payload, POSITION).alias("_first"), F.max_by(payload, POSITION).alias("_last"))
    across = Window.orderBy(BUCKET)  # one row per bucket
    edges = F.broadcast(edges.select(
        BUCKET, F.lead("_first").over(across).alias("_after"), F.lag("_last").over(across).alias("_before")))
    inside = Window.partitionBy(BUCKET).orderBy(POSITION)
    out = (placed.join(edges, BUCKET)
           .withColumn("_nxt", F.coalesce(F.lead(payload).over(inside), F.col("_after")))
           .withColumn("_prv", F.coalesce(F.lag(payload).over(inside), F.col("_before"))))

    def same(side):
        cond = F.col(side).isNotNull()
        for g in group:
            cond = cond & F.col(side)[g].eqNullSafe(F.col(g))
        return cond

    for c in columns:
        out = (out.withColumn(following + c, F.when(same("_nxt"), F.col("_nxt")[c]))
               .withColumn(preceding + c, F.when(same("_prv"), F.col("_prv")[c])))
    return out.drop(BUCKET, POSITION, "_after", "_before", "_nxt", "_prv")


def first_seen_index(df: DataFrame, key: str, order_col: str, name: str = "dense_index") -> DataFrame:
    """Number the distinct keys by first appearance (ties cannot occur if the order is unique)."""
    firsts = df.groupBy(key).agg(F.min(order_col).alias("first_row"))
    return with_row_index(firsts, ["first_row", key], name)


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """Exact median as one row ``[median]``, by position in the value counts.

    Values are counted first, so the sorted table has one row per distinct value
    and no task collects the column.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_c"))
    placed = running_sum(counts, [column], "_c", "_upto")
    total = placed.agg(F.max("_upto").alias("_total")).scalar()
    lo = F.floor((total - 1) / 2)
    hi = F.floor(total / 2)
    start = F.col("_upto") - F.col("_c")
    hits = placed.select(
        F.col(column).cast("double").alias("_v"),
        ((start <= lo) & (lo < F.col("_upto"))).cast("int").alias("_lo"),
        ((start <= hi) & (hi < F.col("_upto"))).cast("int").alias("_hi"))
    return hits.where((F.col("_lo") + F.col("_hi")) > 0).agg(
        ((F.max(F.when(F.col("_lo") == 1, F.col("_v"))) + F.max(F.when(F.col("_hi") == 1, F.col("_v")))) / 2)
        .alias("median"))


def forward_fill(df: DataFrame, order: list, column: str, name: str, buckets: int | None = None) -> DataFrame:
    """Last non-NULL value of ``column`` at or before each row of the given order."""
    placed = sorted_buckets(df, order, buckets)
    lasts = placed.groupBy(BUCKET).agg(
        F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(POSITION))).alias("_last"))
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    carry = F.broadcast(lasts.select(BUCKET, F.last("_last", ignorenulls=True).over(before).alias("_carry")))
    inside = Window.partitionBy(BUCKET).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, 0)
    return (placed.join(carry, BUCKET)
            .withColumn(name, F.coalesce(F.last(column, ignorenulls=True).over(inside), F.col("_carry")))
            .drop(BUCKET, POSITION, "_carry"))
