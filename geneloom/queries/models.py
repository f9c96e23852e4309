"""Batched inference with deterministic models whose result SQL can state."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..models.specs import SPECS, InferenceSpec
from ..models.stub import LetterModel, WordHashModel
from ..operators import inference
from ..plans import genome
from ..session import materialize
from .registry import big, query, r
from .sequences import DUCK_DNA, dna

# With one-hot letters every pooling rule must give the letter shares of the whole text.
SHARES = ", ".join(f"round((length(s) - length(replace(s, '{b}', '')))::DOUBLE / length(s), 6) + 0.0 AS share_{b.lower()}" for b in "ACGT")


def _shares(df, *keep):
    return df.select("doc_id", *keep, *[r(F.col("vector")[i]).alias(f"share_{b.lower()}") for i, b in enumerate("ACGT")])


def _sequence_query(name, covers, spec, pieces_sql):
    sql = f"SELECT doc_id, n_pieces, n_tokens, {SHARES} FROM (SELECT doc_id, s, {pieces_sql} AS n_pieces, length(s) AS n_tokens FROM (SELECT doc_id, {DUCK_DNA} AS s FROM documents) a WHERE length(s) > 0) q"

    @query(name, covers, sql)
    def build(t):
        d = t.texts.select("doc_id", dna().alias("s"))
        e = inference.embed(d, "doc_id", "s", spec, LetterModel)
        return _shares(e, big("n_pieces").alias("n_pieces"), big("n_tokens").alias("n_tokens"))


CEIL = "(length(s) + {0} - 1) // {0}"
_sequence_query("embed_fixed_chunks_6000", "V2 A15 Q19", SPECS["nucleotide_transformer"], CEIL.format(6000))
_sequence_query("embed_fixed_chunks_12000", "V4 V6 A15", SPECS["hyena_dna"], CEIL.format(12000))
_sequence_query("embed_min_tail_chunks", "V5 A14 Q20", SPECS["rna_fm"],
                "CASE WHEN length(s) > 1000 AND length(s) % 1000 BETWEEN 1 AND 199 THEN length(s) // 1000 ELSE (length(s) + 999) // 1000 END")
_sequence_query("embed_full_length_or_chunks", "V7 A14", SPECS["orthrus"], f"CASE WHEN length(s) <= 50000 THEN 1 ELSE {CEIL.format(50000)} END")
_sequence_query("embed_protein_windows", "V8 A14 Q21", SPECS["msa_transformer"], CEIL.format(1022))


@query("embed_token_bounded_chunks", "V3 Q22 A14", f"SELECT doc_id, {SHARES} FROM (SELECT doc_id, {DUCK_DNA} AS s FROM documents) q WHERE length(s) > 0")
def _v3(t):
    d = t.texts.select("doc_id", dna().alias("s"))
    return _shares(inference.embed(d, "doc_id", "s", SPECS["dna_bert2"], LetterModel))


@query("embed_texts_masked_mean", "V1 A16")
def _v1(t):
    return inference.embed(t.texts, "doc_id", "text", SPECS["text_bert"], lambda: WordHashModel(8)).select("doc_id", "n_tokens", "vector")


@query("embed_text_outcomes", "V1 A14 A16", """
SELECT doc_id, CASE WHEN n = 0 THEN 'empty' ELSE 'ok' END AS status, n AS n_tokens FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM documents) q""")
def _v1b(t):
    # a text of any length is cut into pieces below the model's limit, and all its tokens count
    spec = SPECS["text_bert"]
    done = materialize(inference.embed_pieces(inference.cut(t.texts, "doc_id", "text", spec), "doc_id", spec, lambda: WordHashModel(8)), "pieces")
    return inference.outcomes(t.documents, done, "doc_id").select("doc_id", "status", "n_tokens")


class _Flaky(LetterModel):
    """Fails at the first attempt of every piece, and at all attempts of pieces that start with T."""

    seen: set = set()

    def tokens(self, piece):
        if piece.startswith("T"):
            raise ValueError("rejected piece")
        if piece not in self.seen:
            self.seen.add(piece)
            raise RuntimeError("try again")
        return super().tokens(piece)


@query("retries_and_outcomes", "I5 I6", f"""
WITH d AS (SELECT doc_id, {DUCK_DNA} AS s FROM documents), p AS (SELECT doc_id, substr(s, i + 1, 1000) AS x FROM (SELECT doc_id, s, unnest(range(0, length(s), 1000)) AS i FROM d) q),
c AS (SELECT doc_id, count(*) AS n_pieces, count(*) FILTER (WHERE x LIKE 'T%') AS n_failed, coalesce(sum(length(x)) FILTER (WHERE x NOT LIKE 'T%'), 0)::BIGINT AS n_tokens FROM p GROUP BY 1)
SELECT d.doc_id, CASE WHEN n_failed > 0 THEN 'failed' WHEN coalesce(n_tokens, 0) = 0 THEN 'empty' ELSE 'ok' END AS status,
 coalesce(n_pieces, 0) AS n_pieces, coalesce(n_failed, 0) AS n_failed, coalesce(n_tokens, 0) AS n_tokens FROM d LEFT JOIN c ON d.doc_id = c.doc_id""")
def _i5(t):
    spec = InferenceSpec("remote", "fixed", size=1000)
    d = t.texts.select("doc_id", dna().alias("s"))
    done = materialize(inference.embed_pieces(inference.cut(d, "doc_id", "s", spec), "doc_id", spec, _Flaky, retries=2, wait_seconds=0.0001), "pieces")
    return inference.outcomes(t.documents, done, "doc_id")


class _Ramp:
    """Track t of bin b is (number of A in the input) + b + t."""

    def predict(self, hot):
        return hot[:, 0].sum() + np.arange(9)[:, None] + np.arange(3)[None, :]


@query("predict_central_tracks", "V9 A23 N2 SC16", f"""
WITH d AS (SELECT doc_id, {DUCK_DNA} AS s, (doc_id * 37) % 900 AS c FROM documents),
w AS (SELECT doc_id, substr(s, greatest(c - 128, 0) + 1, greatest(least(c + 128, length(s)) - greatest(c - 128, 0), 0)) AS x FROM d),
k(track) AS (VALUES (0), (1), (2))
SELECT doc_id, track, round(ln(1 + (length(x) - length(replace(x, 'A', '')) + 4 + track)), 6) + 0.0 AS value FROM w, k""")
def _v9(t):
    from ..functions import seq

    w = t.texts.select("doc_id", seq.centered_slice(dna(), (F.col("doc_id") * 37) % 900, 256).alias("s"))
    p = inference.predict_tracks(w, "doc_id", "s", _Ramp, 9, 3)
    return p.select("doc_id", F.posexplode("vector").alias("track", "v")).select("doc_id", "track", r(F.log1p("v")).alias("value"))


@query("ensemble_splice_profiles", "V10 A21 A22", """
SELECT label AS gene, cast(p AS INTEGER) AS dim, round(avg(vec_id * 2 + p % 2), 6) + 0.0 AS value
FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS p) k GROUP BY 1, 2""")
def _v10(t):
    sites = t.embeddings.select(F.col("label").alias("gene"), F.when(F.col("vec_id") % 2 == 0, F.lit("donor")).otherwise(F.lit("acceptor")).alias("site_type"),
                                (F.col("vec_id") * 2).cast("double").alias("v"))
    runs = sites.withColumn("model", F.explode(F.sequence(F.lit(-2), F.lit(2)))).select(
        "gene", "site_type", "model", F.array(F.col("v") + F.col("model"), F.col("v") + F.col("model") + 1).alias("acceptor"),
        F.array(F.col("v") - F.col("model"), F.col("v") - F.col("model") + 1).alias("donor"))
    prof = genome.site_profiles(runs, "gene", 2)
    return prof.select("gene", F.posexplode(F.slice("vector", 1, 4)).alias("dim", "value")).withColumn("value", r("value"))


@query("trailing_prediction_columns", "V11 N1", """
SELECT l_returnflag, count(*) AS n, round(sum(l_discount), 3) + 0.0 AS first_column, round(sum(l_tax), 3) + 0.0 AS last_column FROM lineitem GROUP BY 1""")
def _v11(t):
    cells = F.array(*[F.col(c).cast("string") for c in ("l_returnflag", "l_orderkey", "l_quantity", "l_discount", "l_tax")])
    last = inference.trailing_numbers(cells, 2)
    return t.lineitem.select("l_returnflag", last.alias("v")).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum(F.col("v")[0]), 3).alias("first_column"), r(F.sum(F.col("v")[1]), 3).alias("last_column"))


class _Picky(LetterModel):
    """Refuses pieces that start with T, like a remote model that rejects an interval."""

    def tokens(self, piece):
        if piece.startswith("T"):
            raise ValueError("rejected piece")
        return super().tokens(piece)


@query("failed_rows_are_isolated", "V12 I5 I6", f"""
WITH d AS (SELECT doc_id, {DUCK_DNA} AS s FROM documents), p AS (SELECT doc_id, substr(s, i + 1, 1000) AS x FROM (SELECT doc_id, s, unnest(range(0, length(s), 1000)) AS i FROM d) q)
SELECT doc_id, count(*) AS n_pieces, count(*) FILTER (WHERE x LIKE 'T%') AS n_failed FROM p GROUP BY 1""")
def _v12(t):
    spec = InferenceSpec("remote", "fixed", size=1000)
    d = t.texts.select("doc_id", dna().alias("s"))
    e = inference.embed_pieces(inference.cut(d, "doc_id", "s", spec), "doc_id", spec, _Picky, retries=2)
    return e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.count_if(F.col("error").isNotNull()).alias("n_failed"))
