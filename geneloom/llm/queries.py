"""The queries of the numbered operators: each applies its operator to a whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curve_search, decontaminate, html_text, lexical_search, license_scan, line_dedup, llr_rules, ngram_join, packing, pu_quality, records, secret_scan, turn_repair
from .text import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents")).drop("text")
    base = found.withColumn("base", F.filter("spans", lambda x: x["kind"].isin([r.kind for r in secret_scan.BASE])))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return base.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicate_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.round_trip(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = pu_quality.trusted_ids(table(spark, sf_dir, "labels"))
    found = pu_quality.classify(table(spark, sf_dir, "documents"), trusted)
    return found.select("doc_id", pu_quality.held_out().alias("held_out"), "score", (F.col("score") >= pu_quality.CUT).cast("int").alias("predicted"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return llr_rules.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_curve_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % curve_search.EVERY == 0)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = turn_repair.damaged(table(spark, sf_dir, "conversations"))
    return turn_repair.digests(turn_repair.repair_pieces(damaged, times="times"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_packing, op3_license_scan, op4_html_text, op5_line_dedup, op6_decontaminate, op7_ngram_join, op8_token_records, op9_pu_quality, op10_quality_rules, op11_lexical_search, op12_curve_search, op13_turn_repair)}
