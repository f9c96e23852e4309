"""Quality rules with built-in functions only: counts per document and a hashed n-gram log-likelihood ratio.

Word 1- and 2-grams are hashed into ``BUCKETS`` buckets. Two multinomials over the buckets are counted over all documents: one of
the trusted target (rows marked good), one of the raw corpus. A document's score is the mean log ratio over its n-grams, so it
does not depend on length, and every document meets the same threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import holding, materialize, whole, words

BUCKETS = 1 << 15  # size of both multinomials: the only table that is held in memory, 256 KB
PRIOR_SHARE = 1.0  # pseudo-counts of the target as a share of its n-grams, spread as the raw corpus is: alike at every size
THRESHOLD = -0.06  # mean log ratio below which a document is not kept
# fixed values of the contract
MIN_WORDS, MAX_REPEAT_PERCENT, SYMBOLS = 50, 50, r"[#*$%&|<>]"


def bucket(*grams) -> Column:
    return F.pmod(F.xxhash64(*grams), F.lit(BUCKETS)).cast("int")


def gram_buckets(docs: DataFrame, text: str) -> DataFrame:
    """(bucket) of each 1- and 2-gram of the texts."""
    d = docs.select(words(whole(text)).alias("w")).where(F.size("w") > 0)
    d = d.select("w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i"))
    one, two = F.get("w", F.col("i")), F.get("w", F.col("i") + 1)
    return d.select(F.explode(F.array(bucket(one), F.when(two.isNotNull(), bucket(one, two)))).alias("bucket")).where("bucket is not null")


def bucket_counts(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, n_raw, n_target) over all documents; ``trusted`` has the ids of the target, once or more each.

    The corpus is counted where it is read. Only texts whose ids may be trusted are looked at again; the few false alarms among them are
    found by ids alone and taken out, in a join that the planner may broadcast by its size check. Rows without an id take no part in it.
    """
    ids = materialize(trusted.select(F.col(doc_id).alias("id")).where("id is not null").distinct(), "trusted")
    near = holding(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")), ids, "id")
    alarms = materialize(near.select("id").distinct().join(ids, "id", "left_anti"), "alarms")
    target = near.join(alarms, "id", "left_anti")
    raw = gram_buckets(docs, text).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_raw"))
    hits = gram_buckets(target, "t").groupBy("bucket").agg(F.count(F.lit(1)).alias("n_target"))
    return raw.join(hits, "bucket", "left").select("bucket", "n_raw", F.coalesce("n_target", F.lit(0)).alias("n_target"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(bucket, ratio): the log ratio of each bucket that was counted, at most ``BUCKETS`` rows whatever the corpus; 0 without a target.

    Both counts enter as shares of their totals, so a corpus and its double have the same ratios; none is below
    log(PRIOR_SHARE / (1 + PRIOR_SHARE)).
    """
    totals = counts.agg(F.sum("n_raw").alias("raw"), F.sum("n_target").alias("target"))
    p_raw, total = F.col("n_raw") / totals.select("raw").scalar(), totals.select("target").scalar()
    ratio = F.log((F.col("n_target") / total / p_raw + PRIOR_SHARE) / (1 + PRIOR_SHARE))
    return counts.select("bucket", F.when(total > 0, ratio).otherwise(0.0).alias("ratio"))


def mean_log_ratio(docs: DataFrame, w: str, ratios: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``llr``, the mean over all 1- and 2-grams of the words in column ``w``; 0 without words.

    The positions are exploded and looked up in the broadcast table within one stage; each document is summed before the shuffle.
    """
    d = docs.withColumn("__row", F.monotonically_increasing_id())
    d = d.select("__row", w, *keep, F.explode(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)))).alias("__i"))
    one, two = F.get(w, F.col("__i")), F.get(w, F.col("__i") + 1)
    d = d.select("__row", *keep, F.when(one.isNotNull(), bucket(one)).alias("__b1"), F.when(two.isNotNull(), bucket(one, two)).alias("__b2"))
    for n in ("1", "2"):
        side = ratios.select(F.col("bucket").alias(f"__k{n}"), F.col("ratio").alias(f"__r{n}"))
        d = d.join(F.broadcast(side), F.col(f"__b{n}") == F.col(f"__k{n}"), "left")
    total = F.sum(F.coalesce("__r1", F.lit(0.0)) + F.coalesce("__r2", F.lit(0.0)))
    grams = F.greatest(F.count("__b1") + F.count("__b2"), F.lit(1))
    return d.groupBy("__row").agg(*[F.first(c).alias(c) for c in keep], (total / grams).alias("llr")).drop("__row")


def with_repeats(docs: DataFrame, w: str, run: int = 3) -> DataFrame:
    """``docs`` with ``n_repeat_words``: how many words of the array ``w`` lie in a window of three that it holds twice or more.

    Each window becomes one number: a hash and, below it, the place. Sorting the numbers brings equal windows together, so the
    work is n log n for a text of any length; neighbours with one hash are compared word by word.
    """
    m, s = F.col("__m"), "__sorted"
    gram = lambda at: [F.get(w, (at + k).cast("int")) for k in range(run)]
    number = lambda i: F.pmod(F.xxhash64(*gram(i)), F.expr("4611686018427387904 div __m")) * m + i

    def equal(x, y):
        same = (x - x % m) == (y - y % m)
        for a, b in zip(gram(x % m), gram(y % m)):
            same = same & (a == b)
        return F.coalesce(same, F.lit(False))

    d = docs.withColumn("__m", (F.size(w) - (run - 1)).cast("bigint"))
    numbers = F.transform(F.sequence(F.lit(0).cast("bigint"), m - 1), number)
    d = d.withColumn(s, F.when(m < 2, F.array().cast("array<bigint>")).otherwise(F.sort_array(numbers)))
    d = d.withColumn("__twice", F.filter(s, lambda x, k: equal(x, F.get(s, k - 1)) | equal(x, F.get(s, k + 1))))
    d = d.withColumn("__places", F.sort_array(F.transform("__twice", lambda x: x % m)))
    acc = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))

    def add(a, p):
        return F.struct((p + run).alias("end"), (a["n"] + p + run - F.greatest(a["end"], p)).alias("n"))

    d = d.withColumn("n_repeat_words", F.aggregate("__places", acc, add, lambda a: a["n"]))
    return d.drop("__m", s, "__twice", "__places")


def quality_rules(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept).

    A missing or empty text has no words: it fails the base rules and its ``llr`` is 0. Repeated rows get equal results. With no
    trusted rows at all every ratio is 0, so that only the base rules decide. An empty table gives an empty table.
    """
    ratios = log_ratios(materialize(bucket_counts(docs, trusted, doc_id, text), "counts"))
    d = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("t"))
    d = d.withColumn("w", words(F.col("t")))
    d = d.withColumn("dup", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = with_repeats(d, "w")
    d = d.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.char_length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
                 F.regexp_count("t", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"), (F.size("dup") - F.size(F.array_distinct("dup"))).cast("bigint").alias("n_dup_lines"),
                 "n_repeat_words", "w")
    d = mean_log_ratio(d, "w", ratios, [c for c in d.columns if c != "w"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
