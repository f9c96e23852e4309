"""Corpus-wide line deduplication with built-in functions only.

Lines become 128-bit hashes of their keys. The hashes are range-partitioned by (hash, document) and sorted by (hash, document,
position), so a line that a third of all documents hold lies in many ranges, one after another. In each range a stream over the
sorted rows keeps the first occurrence of a line per document; counts and the keeping document are then summed with map-side
combine. The result per document is the sorted positions of its dropped lines, not yet a compressed
keep bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import LOWER, UPPER, materialize, shuffle_partitions, whole

STRIPPED = " \t\n\x0b\f\r"  # fixed value: what is stripped from both ends of a line
MIN_CHARS, MIN_DOCUMENTS = 20, 3  # fixed values of the contract


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def lines(c: str = "text") -> Column:
    return F.split(whole(c), "\n", -1)


def occurrences(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, body, pos) for each line whose key is long enough; ``body`` tells texts with one id apart."""
    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(whole(text)).alias("body"), F.posexplode(lines(text)).alias("pos", "line"))
    rows = rows.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc", "body", "pos")


def keep_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc, body, dropped): for each text that loses lines, their ascending 0-based numbers.

    A line goes if its key has ``min_chars`` code points or more and at least ``min_documents`` different ids hold it, except in the
    largest id. A missing id counts as one id, smaller than all others.
    """
    spark = docs.sparkSession
    order = ["h1", "h2", F.col("doc").desc()]
    ranged = occurrences(docs, doc_id, text, min_chars).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, "body", "pos")
    ranged = materialize(ranged.withColumn("bucket", F.spark_partition_id()), "lines")
    # stream: the first row of each (line, document) of a range; ranges never split such a pair
    stream = Window.partitionBy("bucket").orderBy("h1", "h2", F.col("doc").desc())
    before = F.lag(F.struct("h1", "h2", "doc")).over(stream)
    first = ranged.select("bucket", "h1", "h2", "doc", before.alias("b")).where(F.col("b").isNull() | ~F.col("b").eqNullSafe(F.struct("h1", "h2", "doc")))
    per_range = first.groupBy("bucket", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("doc"))
    shared = per_range.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= min_documents)
    # back to the rows of each range: a hot line has one row per range on this side
    told = per_range.select("bucket", "h1", "h2").join(shared.select("h1", "h2", "keeper"), ["h1", "h2"])
    gone = ranged.join(told, ["bucket", "h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    return gone.groupBy("doc", "body").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def kept_lines(all_lines: str, edges: str) -> Column:
    """The lines between the dropped ones, run by run: linear in the number of lines. Both arguments name columns, which are computed once."""
    run = lambda i: (F.get(edges, i - 1) + 1, F.get(edges, i) - F.get(edges, i - 1) - 1)  # noqa: E731  (first line, how many)
    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.slice(F.col(all_lines), run(i)[0] + 1, run(i)[1])))


def deduplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``docs`` with the remaining lines as ``text`` and two further columns: ``n_lines`` before, ``n_dropped``.

    A missing or empty text is one empty line and comes back empty. Repeated rows are alike: each loses the same lines, and rows with
    the largest id all keep theirs. Other columns pass through; ``n_lines`` and ``n_dropped`` of the input are replaced. An empty
    table gives an empty table.
    """
    runs = keep_runs(docs, doc_id, text, **limits).select(F.col("doc").alias("__doc"), F.col("body").alias("__body"), F.col("dropped").alias("__dropped"))
    rows = docs.withColumn("__text_hash", F.xxhash64(whole(text)))
    joined = rows.join(runs, rows[doc_id].eqNullSafe(F.col("__doc")) & (F.col("__text_hash") == F.col("__body")), "left")
    joined = joined.withColumn("__lines", lines(text))
    joined = joined.withColumns({"n_lines": F.size("__lines").cast("bigint"), "n_dropped": F.coalesce(F.size("__dropped"), F.lit(0)).cast("bigint"),
                                 "__edges": F.concat(F.array(F.lit(-1)), "__dropped", F.array(F.size("__lines")))})
    kept = F.when(F.col("__dropped").isNull(), whole(text)).otherwise(F.array_join(kept_lines("__lines", "__edges"), "\n"))
    return joined.withColumn(text, kept).drop("__doc", "__body", "__dropped", "__text_hash", "__lines", "__edges")
