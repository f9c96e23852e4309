"""Column expressions and session helpers that the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, release, ship, shuffle_partitions  # noqa: F401  (re-used by the operators)

BIT_WORDS = 1 << 18  # most words of 64 bits that ``holding`` broadcasts
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# fixed values: what separates words, as the queries define them
SPACE = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # for text whose A-Z are lower case


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(c: str = "text") -> Column:
    """A text; a missing one is empty."""
    return F.coalesce(F.col(c), F.lit(""))


def ascii_lower(c) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def words(c, separator: str = SPACE) -> Column:
    """The runs between separators, without empty ones. An empty text has none."""
    return F.array_remove(F.split(c, separator), "")


def subsequence(c: Column | str, start: Column, length: Column | int) -> Column:
    """``length`` elements from the 0-based ``start``."""
    return F.slice(c, start + 1, length)


def holding(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` may be among that of the table ``ids`` (without nulls): no such row is lost, a few others stay.

    Each id sets two bits of a 64-bit word, and the words are broadcast: one for four ids, at most ``BIT_WORDS``. So rows that a join with
    ``ids`` would drop go before their texts are moved.
    """
    words_of_bits = 1 << min(BIT_WORDS.bit_length() - 1, max(0, (ids.count() - 1) // 4).bit_length())
    kind = rows.select(column).union(ids.select(column)).schema[0].dataType.simpleString()  # as a join would compare them
    hashed = f"xxhash64(cast(`{column}` as {kind}))"
    slot = F.expr(f"{hashed} & {words_of_bits - 1}L")
    two = F.expr(f"shiftleft(1L, cast(shiftright({hashed}, 40) & 63 as int)) | shiftleft(1L, cast(shiftright({hashed}, 50) & 63 as int))")
    table_of_bits = ids.select(slot.alias("__slot"), two.alias("__two")).groupBy("__slot").agg(F.bit_or("__two").alias("__bits"))
    found = rows.withColumns({"__at": slot, "__mine": two})
    met = (F.col("__at") == F.col("__slot")) & (F.col("__bits").bitwiseAND(F.col("__mine")) == F.col("__mine"))
    return found.join(F.broadcast(table_of_bits), met, "left_semi").where(F.col(column).isNotNull()).select(rows.columns)
