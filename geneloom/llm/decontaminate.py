"""Benchmark decontamination with built-in functions only.

The windows of the benchmark are a set of hashes that is broadcast while its counted size allows it (otherwise the planner joins by
hash, and a position sends its own window, never its document). Each document is scanned once: every word position gives the hash of
the window that starts there, the join finds the hits, and the words themselves are compared before a hit counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import NOT_ALNUM, ascii_lower, materialize, subsequence, whole, words

WINDOW = 10  # fixed value of the contract
BROADCAST_WINDOWS = 500_000  # about 150 MB of windows: more than that is joined by hash


def normalised(c: str = "text"):
    return words(ascii_lower(whole(c)), NOT_ALNUM)


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, k, gram, h): each run of ``window`` words; an item of fewer words, but not none, is one run of k words."""
    w = items.select(F.col(item_id).alias("item"), normalised(text).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("k", F.least(F.size("w"), F.lit(window)))
    w = w.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k"))))
    return w.select("item", "k", subsequence("w", F.col("i"), F.col("k")).alias("gram")).distinct().withColumn("h", F.xxhash64("gram"))


def scan(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, starts, items), ``starts`` the hits as sorted (position, length) pairs.

    A missing or empty text has no words and no hits; nor has any document if no item has words. Repeated rows are scanned each for
    itself. Ids are those of the items with an occurring window, distinct; a missing item id stands for itself in the windows, but in
    no list of ids.
    """
    grams = materialize(benchmark_windows(items, item_id, item_text, window), "grams")
    sizes = {r["k"]: r["n"] for r in grams.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``window`` rows
    lengths = sorted(sizes) or [window]
    grams = F.broadcast(grams) if sum(sizes.values()) <= BROADCAST_WINDOWS else grams
    base = docs.select(F.col(doc_id).alias("doc"), F.monotonically_increasing_id().alias("row"), normalised(text).alias("w"))
    base = base.withColumn("n_words", F.size("w"))
    # per length: the places where a window can start; the first has place 0 always, so that each document keeps a row
    places = [F.struct(F.lit(k).alias("k"), F.sequence(F.lit(0), F.greatest(F.col("n_words") - k, F.lit(0))).alias("at")) for k in lengths]
    at = base.withColumn("p", F.explode(F.array(*places))).select("doc", "row", "w", "n_words", F.col("p.k").alias("k"), F.explode("p.at").alias("i"))
    at = at.select("doc", "row", "n_words", "k", "i", subsequence("w", F.col("i"), F.col("k")).alias("words")).withColumn("wh", F.xxhash64("words"))
    g = grams.select(F.col("item").alias("g_item"), F.col("k").alias("gk"), F.col("gram"), F.col("h"))
    hit = (F.col("wh") == F.col("h")) & (F.col("k") == F.col("gk")) & (F.col("words") == F.col("gram"))
    found = at.join(g, hit, "left").where(F.col("gk").isNotNull() | ((F.col("i") == 0) & (F.col("k") == lengths[0])))
    start = F.when(F.col("gk").isNotNull(), F.struct("i", "gk"))
    return found.groupBy("row").agg(F.first("doc").alias("doc_id"), F.first("n_words").cast("bigint").alias("n_words"),
                                    F.sort_array(F.collect_set(start)).alias("starts"), F.collect_set("g_item").alias("items"))


def covered(starts: str = "starts"):
    """How many words lie in any hit."""
    acc = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(a, s):
        end = F.greatest(a["end"], s["i"] + s["gk"])
        return F.struct(end.alias("end"), (a["n"] + end - F.greatest(a["end"], s["i"])).alias("n"))

    return F.aggregate(starts, acc, add, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids): item_ids as strings, sorted."""
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return scan(docs, items, **names).select("doc_id", "n_words", covered().cast("bigint").alias("n_hit"), ids.alias("item_ids"))


def remove_contaminated(docs: DataFrame, items: DataFrame, max_hit_share: float = 0.0, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """``docs`` without the documents of whose words more than ``max_hit_share`` are hit. Columns and clean documents stay as they are.

    Documents are told apart by id and text, so of two rows with one id only the contaminated one goes.
    """
    keyed = docs.withColumn("__body", F.sha2(whole(text), 256))
    bad = scan(keyed.select(F.struct(F.col(doc_id).alias("id"), "__body").alias("__key"), F.col(text)), items, doc_id="__key", text=text, **names)
    bad = bad.where(covered() > F.lit(max_hit_share) * F.col("n_words")).select(F.col("doc_id.id").alias("__id"), F.col("doc_id.__body").alias("__bad")).distinct()
    return keyed.join(bad, keyed[doc_id].eqNullSafe(F.col("__id")) & (F.col("__body") == F.col("__bad")), "left_anti").drop("__body")


def remove_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """(doc_id, kept): the words of each document outside all hits, in order, normalised and joined by a space."""
    found = scan(docs.select(F.struct(F.col(doc_id).alias("id"), whole(text).alias("t")).alias("__key"), F.col(text)), items, doc_id="__key", text=text, **names)
    found = found.withColumn("__w", words(ascii_lower(F.col("doc_id.t")), NOT_ALNUM))
    edges = F.concat(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("gk"))), "starts", F.array(F.struct(F.size("__w").alias("i"), F.lit(0).alias("gk"))))
    acc = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,n:int>>").alias("gaps"))

    def add(a, s):
        gap = F.struct(a["end"].alias("at"), F.greatest(s["i"] - a["end"], F.lit(0)).alias("n"))
        return F.struct(F.greatest(a["end"], s["i"] + s["gk"]).alias("end"), F.concat(a["gaps"], F.array(gap)).alias("gaps"))

    found = found.withColumn("__gaps", F.aggregate(edges, acc, add, lambda a: a["gaps"]))
    kept = F.flatten(F.transform("__gaps", lambda g: F.slice("__w", g["at"] + 1, g["n"])))
    return found.select(F.col("doc_id.id").alias("doc_id"), F.array_join(kept, " ").alias("kept"))
