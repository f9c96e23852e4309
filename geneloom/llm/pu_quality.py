"""Quality classifier learned from trusted positives and unlabelled text (non-negative positive-unlabelled risk).

A text is described by shares and lengths, each put into one of a few bins; the score is linear in the bins. With the squared loss
every term of the risk is a function of second moments, so one pass with map-side sums over all documents gives all that descent
needs: the moments have a fixed size, and the descent on the driver equals full-batch training on the whole corpus. The class prior
is estimated from the tails of a first positive-against-unlabelled score: the share of good text cannot exceed, for any cut, the
unlabelled share above it divided by the positives' share above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ascii_lower, materialize, whole, words

CUT = 0.3  # fixed value of the contract: predicted 1 from this score on
SHARES = (0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85)  # bin edges; the first bin is 0 exactly
LENGTHS = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 14.0)
WIDTH = max(len(SHARES), len(LENGTHS)) + 1
RIDGE, STEPS, HISTOGRAM, LEAST_TAIL = 1e-4, 4000, 400, 0.1


def features(text: str = "text") -> list[tuple[Column, tuple[float, ...]]]:
    """(value, bin edges) of each feature, over the whole text; column ``__w`` holds its words. Without words or letters a share is 0."""
    t, n, chars = whole(text), F.size("__w"), F.char_length(whole(text))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return [
        (F.log2(n + 1.0), LENGTHS),
        (share(chars, n), LENGTHS),
        (share(count(r"[#*$%&|<>{}\\^~=_@]"), n), SHARES),
        (share(count(r"[!?]"), n), SHARES),
        (share(count(r"[.,;:]"), n), SHARES),
        (share(count(r"\p{Lu}"), count(r"\p{L}")), SHARES),
        (share(count(r"\p{Nd}"), chars), SHARES),
        (share(count(r"[^\p{L}\p{Nd}\s]"), chars), SHARES),
        (share(count(r"(?:^|\s)(\S++)(?=\s+\1(?:\s|$))"), n), SHARES),
        (share(F.size(F.array_distinct("__w")), n), SHARES),
        (share(F.size(F.array_distinct("__w")), F.sqrt(n.cast("double"))), LENGTHS),
        (share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)), SHARES),
    ]


def with_bins(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``bins``: per feature the place of its bin among the ``12 * WIDTH`` weights."""
    d = docs.withColumn("__w", words(ascii_lower(whole(text))))
    bins = [F.lit(k * WIDTH) + sum(((v > e).cast("int") for e in edges), F.lit(0)) for k, (v, edges) in enumerate(features(text))]
    return d.withColumn("bins", F.array(*bins)).drop("__w")


def moments(binned: DataFrame, dimension: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Sums of outer products over all rows and over trusted ones, and both counts. A bias follows the bins."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, dimension + 1, dimension + 1))
        for batch in batches:
            if batch.num_rows:
                bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                good = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
                for at in range(0, len(bins), 2048):
                    x = np.zeros((len(bins[at:at + 2048]), dimension + 1))
                    np.put_along_axis(x, bins[at:at + 2048], 1.0, axis=1)
                    x[:, -1] = 1.0
                    p = x[good[at:at + 2048]]
                    total[0] += x.T @ x
                    total[1] += p.T @ p
        which, i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(i), pa.array(j), pa.array(total[which, i, j])], names=["which", "i", "j", "v"])

    sums = binned.select("bins", "trusted").mapInArrow(partial, "which bigint, i bigint, j bigint, v double")
    total = np.zeros((2, dimension + 1, dimension + 1))
    for r in sums.groupBy("which", "i", "j").agg(F.sum("v").alias("v")).collect():  # at most 2 (dimension + 1)^2 rows, whatever the corpus
        total[r["which"], r["i"], r["j"]] = r["v"]
    return total[0], total[1], total[0, -1, -1], total[1, -1, -1]


def least_squares(u: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Weights that tell trusted rows (+1) from all rows (-1), both classes weighing the same: the first score."""
    return np.linalg.solve(u + p + RIDGE * np.eye(len(u)), p[-1] - u[-1])


def class_prior(binned: DataFrame, weights: np.ndarray) -> float:
    """The smallest ratio of tails, over the cuts that at least ``LEAST_TAIL`` of the positives pass, with room for sampling error."""
    b = F.greatest(F.lit(0), F.least(F.lit(HISTOGRAM - 1), F.floor((linear(weights) + 1) / 2 * HISTOGRAM))).cast("int")
    rows = binned.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("u"), F.sum(F.col("trusted").cast("int")).alias("p")).collect()  # at most HISTOGRAM rows
    u, p = np.zeros(HISTOGRAM), np.zeros(HISTOGRAM)
    for r in rows:
        u[r["b"]], p[r["b"]] = r["u"], r["p"]
    tail_u, tail_p = u[::-1].cumsum() / u.sum(), p[::-1].cumsum() / p.sum()
    use = tail_p >= LEAST_TAIL
    room = np.sqrt(tail_p[use] * (1 - tail_p[use]) / p.sum()) + np.sqrt(tail_u[use] * (1 - tail_u[use]) / u.sum())
    return float(np.clip(((tail_u[use] + room) / tail_p[use]).min(), 0.05, 0.99))


def descend(u: np.ndarray, p: np.ndarray, prior: float) -> np.ndarray:
    """Minimise the non-negative risk with squared loss over normalised moments. Where the unlabelled risk less the positives' share in
    it turns negative, the step climbs that term instead, so that it is not fitted below 0."""
    w = np.zeros(len(u))
    rate = 1.0 / (np.linalg.eigvalsh(u + p)[-1] + RIDGE)
    for _ in range(STEPS):
        uw, pw = u @ w, p @ w
        negative = (u[-1, -1] + 2 * uw[-1] + w @ uw - prior * (p[-1, -1] + 2 * pw[-1] + w @ pw)) / 4
        slope_negative = (u[-1] + uw - prior * (p[-1] + pw)) / 2
        slope_positive = prior * (pw - p[-1]) / 2
        w = w + rate * slope_negative if negative < -1e-3 else w - rate * (slope_positive + slope_negative + RIDGE * w)
    return w


def linear(weights: np.ndarray) -> Column:
    """The linear score of column ``bins``."""
    table = F.array(*[F.lit(float(x)) for x in weights[:-1]])
    return F.aggregate("bins", F.lit(float(weights[-1])), lambda a, b: a + F.get(table, b))


def classify(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, body, score), ``body`` a hash that tells texts with one id apart.

    ``trusted`` has the ids of the trusted positives, once or more each; all documents are the unlabelled side. A missing or empty text
    has the features of a text without words and a score as any other. Repeated rows get equal scores. Without any trusted row nothing
    can be learned: every score is 0.5. An empty table gives an empty table.
    """
    ids = trusted.select(F.col(doc_id).alias("t_id")).where("t_id is not null").distinct()
    d = with_bins(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", F.xxhash64(whole("text")).alias("body"), "bins")
    d = materialize(d, "bins").join(ids, F.col("doc_id") == F.col("t_id"), "left")
    d = materialize(d.select("doc_id", "body", "bins", F.col("t_id").isNotNull().alias("trusted")), "marked")
    u, p, n_u, n_p = moments(d, len(features()) * WIDTH)
    if not n_p:
        return d.select("doc_id", "body", F.lit(0.5).alias("score"))
    u, p = u / n_u, p / n_p
    weights = descend(u, p, class_prior(d, least_squares(u, p)))
    return d.select("doc_id", "body", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (linear(weights) + 1) / 2)).alias("score"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the labels of an id must not be learned from. A missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Ids outside the held-out fold whose labels all say 1."""
    return labels.where(~held_out(doc_id)).groupBy(doc_id).agg(F.min(F.coalesce(quality, F.lit(0))).alias("q")).where("q = 1").select(doc_id)


def remove_rejected(docs: DataFrame, trusted: DataFrame, cut: float = CUT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that score below ``cut``; columns stay as they are."""
    bad = classify(docs, trusted, doc_id, text).where(F.col("score") < cut).select(F.col("doc_id").alias("__id"), F.col("body").alias("__bad")).distinct()
    keyed = docs.withColumn("__body", F.xxhash64(whole(text)))
    return keyed.join(bad, keyed[doc_id].eqNullSafe(F.col("__id")) & (F.col("__body") == F.col("__bad")), "left_anti").drop("__body")
