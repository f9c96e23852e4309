"""Batched model inference: cut, embed in Arrow batches, pool.

Sequences are cut into pieces by JVM expressions and the pieces are the unit of
work, so one very long sequence is spread over many tasks. Python only runs the
model; pooling is a JVM vector aggregate.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as sq
from ..models.specs import InferenceSpec
from ..session import materialize
from .vectors import mean_of, sum_of


def cut(df: DataFrame, key: str, text: str, spec: InferenceSpec) -> DataFrame:
    """``[key, piece_no, piece]``; blank texts give no piece."""
    if spec.cut in ("whole", "token_bound") and not spec.size:
        pieces = F.array(F.col(text))
    elif spec.cut == "words":
        # a column of its own: within the lambda the split would run again for every piece
        df = df.select(key, text, F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("_words"))
        words = F.col("_words")
        starts = F.filter(F.sequence(F.lit(0), F.size(words), F.lit(spec.size)), lambda i: i < F.size(words))
        pieces = F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, spec.size), " "))
    elif spec.cut == "min_tail":
        pieces = sq.chunks_min_tail(text, spec.size, spec.min_tail)
    elif spec.cut == "window":
        pieces = F.transform(sq.windows(text, spec.size), lambda w: w["piece"])
    else:
        pieces = sq.chunks(text, spec.size)
    if spec.full_length_up_to:
        pieces = F.when(F.length(text) <= spec.full_length_up_to, F.array(F.col(text))).otherwise(pieces)
    return df.select(key, F.posexplode(pieces).alias("piece_no", "piece")).where("length(piece) > 0")


def halve_to_limit(piece: str, count: Callable[[str], int], limit: int, floor: int = 100, at_blanks: bool = False) -> list[str]:
    """Halve a piece until every part tokenises to at most ``limit`` tokens; with ``at_blanks`` between words where it has several."""
    todo, done = [piece], []
    while todo:
        part = todo.pop()
        if count(part) <= limit:
            done.append(part)
        elif at_blanks and " " in part:
            words = part.split(" ")
            half = len(words) // 2
            todo += [" ".join(words[half:]), " ".join(words[:half])]
        elif len(part) <= floor:
            raise ValueError(f"cannot cut a part of length {len(part)} to {limit} tokens")
        else:
            half = len(part) // 2
            todo += [part[half:], part[:half]]
    return done


def _out_of_memory(err: Exception) -> bool:
    return isinstance(err, MemoryError) or "out of memory" in str(err).lower()


def _token_sums(model, piece: str, spec: InferenceSpec) -> tuple[np.ndarray, int]:
    """Sum of the usable token vectors and their number; halves the piece when memory runs out."""
    try:
        matrix, special = model.tokens(piece)
    except (MemoryError, RuntimeError) as err:
        if not _out_of_memory(err) or len(piece) <= max(spec.min_piece, 1):
            raise
        half = len(piece) // 2
        a, b = _token_sums(model, piece[:half], spec), _token_sums(model, piece[half:], spec)
        return a[0] + b[0], a[1] + b[1]
    kept = matrix[~special]
    return kept.sum(axis=0), len(kept)


def embed_pieces(pieces: DataFrame, key: str, spec: InferenceSpec, load_model: Callable[[], object],
                 retries: int = 1, wait_seconds: float = 0.0) -> DataFrame:
    """``[key, piece_no, length, n_tokens, vector, error]``.

    The model is loaded once per task. ``vector`` is the token sum
    (``token_sum``) or the token mean (``piece_length``). A failing piece keeps
    its row with ``error`` set; ``retries`` repeats it with linear back-off.
    """
    key_type = pieces.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, piece_no int, length int, n_tokens int, vector array<double>, error string"
    by_length = spec.pool == "piece_length"

    def attempt(model, piece):
        for turn in range(1, retries + 1):
            try:
                parts = [piece]
                if spec.cut in ("token_bound", "words") and model.token_count(piece) > spec.max_tokens:
                    parts = halve_to_limit(piece, model.token_count, spec.max_tokens, at_blanks=spec.cut == "words")
                return [(len(p), *_token_sums(model, p, spec)) for p in parts], None
            except Exception as err:  # isolate the row, keep the batch
                last = err
                if turn < retries and wait_seconds:
                    time.sleep(wait_seconds * turn)
        return [(len(piece), None, 0)], repr(last)

    def run(batches):
        model = load_model()
        for pdf in batches:
            rows = []
            for k, no, piece in zip(pdf[key], pdf["piece_no"], pdf["piece"]):
                parts, error = attempt(model, piece)
                for length, total, n in parts:
                    vec = None if total is None else (total / max(n, 1) if by_length else total)
                    rows.append((k, no, length, n, vec, error))
            yield pd.DataFrame(rows, columns=[key, "piece_no", "length", "n_tokens", "vector", "error"])

    return pieces.select(key, "piece_no", "piece").mapInPandas(run, schema)


def pool(embedded: DataFrame, key: str, spec: InferenceSpec) -> DataFrame:
    """``[key, vector, n_tokens, n_pieces]`` of the keys whose pieces all succeeded."""
    good = embedded.where(F.col("error").isNull() & (F.col("n_tokens") > 0))
    failed = embedded.where(F.col("error").isNotNull()).select(key).distinct()
    counts = [F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces")]
    if spec.pool == "piece_length":
        out = good.groupBy(key).agg(mean_of("vector", F.col("length").cast("double")).alias("vector"), *counts)
    else:
        out = good.groupBy(key).agg(sum_of("vector").alias("vector"), *counts)
        n = F.col("n_tokens")
        out = out.withColumn("vector", F.transform("vector", lambda x: x / n))
    return out.join(failed, key, "left_anti")


def failures(embedded: DataFrame, key: str) -> DataFrame:
    """``[key, n_failed, error]``: the keys left out, with one error text each."""
    return (embedded.where(F.col("error").isNotNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias("n_failed"), F.min("error").alias("error")))


def outcomes(df: DataFrame, embedded: DataFrame, key: str) -> DataFrame:
    """``[key, status, n_pieces, n_failed, n_tokens]`` of every key of ``df``: ``ok``, ``failed`` if a piece failed, ``empty`` without tokens."""
    tally = embedded.groupBy(key).agg(F.count(F.lit(1)).alias("n_pieces"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.sum("n_tokens").alias("n_tokens"))
    out = df.select(key).distinct().join(tally, key, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_pieces", "n_failed", "n_tokens")})
    status = F.when(F.col("n_failed") > 0, F.lit("failed")).when(F.col("n_tokens") == 0, F.lit("empty")).otherwise(F.lit("ok"))
    return out.select(key, status.alias("status"), "n_pieces", "n_failed", "n_tokens")


def embed(df: DataFrame, key: str, text: str, spec: InferenceSpec, load_model: Callable[[], object],
          retries: int = 1) -> DataFrame:
    """Cut, embed and pool in one call; the model runs once and its output is kept in the shared folder."""
    done = materialize(embed_pieces(cut(df, key, text, spec), key, spec, load_model, retries), "pieces")
    return pool(done, key, spec)


def predict_tracks(windows: DataFrame, key: str, sequence: str, load_model: Callable[[], object], bins: int, tracks: int,
                   channels_first: bool = False, half: int = 1) -> DataFrame:
    """``[key, vector]``: mean of the central bins of a (bins x tracks) prediction.

    The one-hot input lives only inside the task; the sequence column is a plain string.
    """
    key_type = windows.schema[key].dataType.simpleString()
    centre = bins // 2

    def run(batches):
        model = load_model()
        for pdf in batches:
            out = []
            for k, s in zip(pdf[key], pdf[sequence]):
                y = np.asarray(model.predict(sq.one_hot_numpy(s, channels_first)), dtype=np.float64)
                if y.shape != (bins, tracks):
                    raise ValueError(f"unexpected prediction shape {y.shape}")
                out.append((k, y[centre - half:centre + half + 1].mean(axis=0)))
            yield pd.DataFrame(out, columns=[key, "vector"])

    return windows.select(key, sequence).mapInPandas(run, f"{key} {key_type}, vector array<double>")


def masked_mean(values, attention, special):
    """Mean of the values whose token is attended and not special; the divisor is at least one."""
    marked = F.zip_with(values, F.zip_with(attention, special, lambda a, s: a & ~s),
                        lambda v, keep: F.when(keep, v.cast("double")))
    kept = F.filter(marked, lambda v: v.isNotNull())
    return F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / F.greatest(F.size(kept), F.lit(1))


def trailing_numbers(cells, n: int):
    """The last ``n`` cells of a prediction row as numbers; leading columns are metadata."""
    from ..functions.num import to_number

    return F.transform(F.slice(cells, -n, n), to_number)


def one_hot_totals(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """``[key, totals]``: column sums of the (L x 4) one-hot encoding, built inside the task."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "totals": [sq.one_hot_numpy(s).sum(axis=0, dtype=np.float64) for s in pdf[sequence]]})

    return df.select(key, sequence).mapInPandas(run, f"{key} {key_type}, totals array<double>")
