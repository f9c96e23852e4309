"""Aggregation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import features, mapping, ranges, vectors
from ..plans import genome
from .registry import big, query, r

UNNEST = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings"


@query("vector_mean_per_key", "A1", f"""
SELECT label, cast(dim AS INTEGER) AS dim, round(avg(x), 6) + 0.0 AS value, count(*) AS n_source_rows FROM ({UNNEST}) u GROUP BY 1, 2""")
def _a1(t):
    m = vectors.vector_mean(t.embeddings, ["label"], "embedding")
    return m.select("label", "n_source_rows", F.posexplode("vector").alias("dim", "value")).withColumn("value", r("value"))


@query("two_step_group_mean", "A2", """
WITH a AS (SELECT l_partkey, l_suppkey, avg(l_quantity) AS q, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, count(*) AS n_parts, round(avg(q), 4) + 0.0 AS mean_quantity, round(avg(p), 3) + 0.0 AS mean_price FROM a GROUP BY 1""")
def _a2(t):
    a = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"))
    return a.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_parts"), r(F.avg("q"), 4).alias("mean_quantity"), r(F.avg("p"), 3).alias("mean_price"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("max_level_pivot", "A3", "SELECT o_custkey, " + ", ".join(
    f"coalesce(max(o_totalprice) FILTER (WHERE o_orderpriority = '{p}'), 0.0) AS \"{p}\"" for p in PRIORITIES) + " FROM orders GROUP BY 1")
def _a3(t):
    return features.max_pivot(t.orders, "o_custkey", "o_orderpriority", F.col("o_totalprice"),
                              features.distinct_labels(t.orders, "o_orderpriority"))


@query("multi_hot_pivot", "A4", """
WITH e AS (SELECT user_id, unnest(list_distinct([event_type, CASE WHEN value > 10 THEN 'large' ELSE event_type END])) AS lab FROM events)
SELECT user_id, """ + ", ".join(f"max(CASE WHEN lab = '{x}' THEN 1.0::DOUBLE ELSE 0.0 END) AS \"{x}\"" for x in
                              ["click", "error", "large", "purchase", "signup", "view"]) + " FROM e GROUP BY 1")
def _a4(t):
    cell = F.concat_ws(";", "event_type", F.when(F.col("value") > 10, F.lit("large")).otherwise(F.lit("")))
    e = t.events.select("user_id", ids.split_semicolon(cell).alias("labels"))
    names = features.distinct_labels(e.select(F.explode("labels").alias("l")), "l")
    return features.multi_hot(e, "user_id", F.col("labels"), names)


@query("value_counts_sorted", "A5 O1", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def _a5(t):
    return t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source", "lang")


@query("exact_distinct_counts", "A6", """
SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1""")
def _a6(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_suppkey").alias("n_suppliers"))


@query("interval_length_sum", "A7", """
SELECT l_orderkey, cast(sum(cast(l_quantity AS BIGINT) - l_linenumber + 1) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS exon_length FROM lineitem GROUP BY 1""")
def _a7(t):
    span = big("l_quantity") - F.col("l_linenumber") + 1
    return t.lineitem.groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_linestatus") == "O", span)).alias("exon_length"))


@query("set_union_aggregate", "A8", """
SELECT l_suppkey, string_agg(DISTINCT tag, '|' ORDER BY tag) AS tags FROM (SELECT l_suppkey, unnest([l_returnflag, l_linestatus]) AS tag FROM lineitem) q GROUP BY 1""")
def _a8(t):
    tags = t.lineitem.select("l_suppkey", F.explode(F.array("l_returnflag", "l_linestatus")).alias("tag"))
    return tags.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("tags"))


@query("first_and_last_non_empty", "A9", """
SELECT user_id, arg_min(event_type, event_id) FILTER (WHERE event_type <> 'error') AS first_good, arg_max(event_type, event_id) AS last_type,
 arg_max(value, event_id) FILTER (WHERE value > 5) AS last_large FROM events GROUP BY 1""")
def _a9(t):
    e = F.col("event_id")
    return t.events.groupBy("user_id").agg(
        F.min_by("event_type", F.when(F.col("event_type") != "error", e)).alias("first_good"), F.max_by("event_type", e).alias("last_type"),
        F.max_by("value", F.when(F.col("value") > 5, e)).alias("last_large"))


@query("context_mean_without_global", "A10", f"""
WITH u AS ({UNNEST}), k AS (SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0)
SELECT label, cast(dim AS INTEGER) AS dim, round(avg(x), 6) + 0.0 AS value, count(*) AS context_count FROM u WHERE vec_id IN (SELECT vec_id FROM k) GROUP BY 1, 2""")
def _a10(t):
    from ..plans.tabular import context_mean

    e = t.embeddings.select(F.col("label").alias("gene"), "embedding",
                            F.when(F.col("vec_id") % 7 == 0, F.lit("global")).otherwise(F.lit("liver")).alias("tissue"))
    m = context_mean(e, "gene", "tissue", "embedding")
    return m.select(F.col("gene").alias("label"), "context_count", F.posexplode("vector").alias("dim", "value")).withColumn("value", r("value"))


@query("global_context_pick", "A11", """
SELECT label, max(vec_id) AS vec_id FROM embeddings WHERE vec_id % 7 = 0 GROUP BY 1""")
def _a11(t):
    from ..plans.tabular import global_context

    e = t.embeddings.select(F.col("label").alias("gene"), "vec_id", F.array(F.col("vec_id").cast("double")).alias("embedding"),
                            F.when(F.col("vec_id") % 7 == 0, F.lit("global")).otherwise(F.lit("liver")).alias("tissue"))
    g = global_context(e, "gene", "tissue", "embedding", "vec_id")
    return g.select(F.col("gene").alias("label"), big(F.col("vector")[0]).alias("vec_id"))


@query("sum_duplicate_coordinates", "A12", """
SELECT o_custkey AS row, l_suppkey AS col, round(sum(l_quantity), 4) + 0.0 AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def _a12(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return features.count_matrix(j.select(F.col("o_custkey").alias("row"), F.col("l_suppkey").alias("col"), "l_quantity"), "row", "col", "l_quantity") \
        .withColumn("value", r("value", 4))


@query("binary_profile_dedupe", "A13", """
SELECT count(*) AS n_rows, count(DISTINCT (user_id, event_type)) AS n_pairs, count(*) - count(DISTINCT (user_id, event_type)) AS n_duplicates FROM events""")
def _a13(t):
    per_pair = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c"))
    return per_pair.agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_pairs"), F.sum(F.col("c") - 1).alias("n_duplicates"))


@query("length_weighted_vector_mean", "A14", f"""
SELECT label, cast(dim AS INTEGER) AS dim, round(sum(x * (1 + vec_id % 5)) / sum(1 + vec_id % 5), 6) + 0.0 AS value FROM ({UNNEST}) u GROUP BY 1, 2""")
def _a14(t):
    m = vectors.vector_mean(t.embeddings, ["label"], "embedding", (F.col("vec_id") % 5 + 1).cast("double"))
    return m.select("label", F.posexplode("vector").alias("dim", "value")).withColumn("value", r("value"))


@query("token_sum_mean", "A15", f"""
SELECT label, cast(dim AS INTEGER) AS dim, round(sum(x) / sum(1 + vec_id % 3), 6) + 0.0 AS value FROM ({UNNEST}) u GROUP BY 1, 2""")
def _a15(t):
    m = t.embeddings.groupBy("label").agg(vectors.sum_of("embedding").alias("s"), F.sum(F.col("vec_id") % 3 + 1).alias("n"))
    return m.select("label", "n", F.posexplode("s").alias("dim", "value")).select("label", "dim", r(F.col("value") / F.col("n")).alias("value"))


@query("masked_mean_pooling", "A16", f"""
SELECT vec_id, round(coalesce(sum(x) FILTER (WHERE dim % 3 > 0 AND dim < 60), 0) / greatest(count(*) FILTER (WHERE dim % 3 > 0 AND dim < 60), 1), 6) + 0.0 AS pooled
FROM ({UNNEST}) u GROUP BY 1""")
def _a16(t):
    from ..operators.inference import masked_mean

    attention = F.transform("embedding", lambda x, i: i < 60)
    special = F.transform("embedding", lambda x, i: i % 3 == 0)
    return t.embeddings.select("vec_id", r(masked_mean(F.col("embedding"), attention, special)).alias("pooled"))


@query("central_window_summaries", "A17 N3", f"""
WITH u AS ({UNNEST}), a AS (SELECT vec_id,
 avg(x) FILTER (WHERE dim BETWEEN 30 AND 33) AS central_1kb_mean, avg(x) FILTER (WHERE dim BETWEEN 12 AND 51) AS central_10kb_mean,
 avg(x) AS central_100kb_mean, avg(x) AS full_1mb_mean, max(x) FILTER (WHERE dim BETWEEN 12 AND 51) AS central_10kb_max FROM u GROUP BY 1)
SELECT vec_id, summary_stat, round(sign(v) * ln(1 + abs(v)), 6) + 0.0 AS value FROM a UNPIVOT (v FOR summary_stat IN
 (central_1kb_mean, central_10kb_mean, central_100kb_mean, full_1mb_mean, central_10kb_max))""")
def _a17(t):
    # the vector positions stand for 64 bins of 250 bases
    summaries = t.embeddings.select("vec_id", F.explode(genome.window_summaries("embedding", 64, 250)).alias("s"))
    return summaries.select("vec_id", "s.summary_stat", r("s.value").alias("value"))


@query("central_window_summaries_long", "A17 N3", f"""
WITH u AS ({UNNEST}), a AS (SELECT vec_id, dim % 2 AS track,
 avg(x) FILTER (WHERE dim BETWEEN 30 AND 33) AS central_1kb_mean, avg(x) FILTER (WHERE dim BETWEEN 12 AND 51) AS central_10kb_mean,
 avg(x) AS central_100kb_mean, avg(x) AS full_1mb_mean, max(x) FILTER (WHERE dim BETWEEN 12 AND 51) AS central_10kb_max FROM u GROUP BY 1, 2)
SELECT vec_id, cast(track AS INTEGER) AS track, summary_stat, round(sign(v) * ln(1 + abs(v)), 6) + 0.0 AS value FROM a UNPIVOT (v FOR summary_stat IN
 (central_1kb_mean, central_10kb_mean, central_100kb_mean, full_1mb_mean, central_10kb_max))""")
def _a17b(t):
    tracks = vectors.explode_vector(t.embeddings, ["vec_id"], "embedding", "bin", "value").select(
        "vec_id", "bin", (F.col("bin") % 2).alias("track"), F.col("value").cast("double").alias("value"))
    return genome.window_features(tracks, "vec_id", 64, 250).select("vec_id", "track", "summary_stat", r("value").alias("value"))


@query("report_scalars", "A18", """
SELECT count(*) AS n, min(n_chars) AS shortest, median(n_chars)::DOUBLE AS middle, max(n_chars) AS longest FROM documents""")
def _a18(t):
    mid = ranges.exact_median(t.documents, "n_chars").scalar()
    return t.documents.agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest")).withColumn("middle", mid)


@query("column_mean_and_deviation", "A19", f"""
SELECT cast(dim AS INTEGER) AS dim, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS std, stddev_pop(x) = 0 AS zero_std FROM ({UNNEST}) u GROUP BY 1""")
def _a19(t):
    return vectors.column_stats(t.embeddings, "embedding").select("dim", r("mean").alias("mean"), r("std").alias("std"), (F.col("std") == 0).alias("zero_std"))


@query("column_mean_imputation", "A20", f"""
WITH u AS (SELECT vec_id, dim, CASE WHEN (vec_id + dim) % 4 = 0 OR dim = 5 THEN NULL ELSE x END AS x FROM ({UNNEST}) q),
m AS (SELECT dim, coalesce(avg(x), 0) AS m FROM u GROUP BY 1)
SELECT vec_id, round(sum(coalesce(x, m) * (u.dim + 1)), 6) + 0.0 AS weighted_sum FROM u JOIN m ON u.dim = m.dim GROUP BY 1""")
def _a20(t):
    gaps = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i) % 4 == 0, F.lit(float("nan"))).when(
        i == 5, F.lit(None)).otherwise(x.cast("double")))
    filled = vectors.impute_column_mean(t.embeddings.select("vec_id", gaps.alias("v")), "v")
    ws = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return filled.select("vec_id", r(ws).alias("weighted_sum"))


@query("site_type_profile_average", "A21 A22 U6", """
WITH s AS (SELECT label AS gene, CASE WHEN vec_id % 3 = 0 THEN 'donor' ELSE 'acceptor' END AS site_type, unnest(embedding)::DOUBLE AS x,
  unnest(list_reverse(embedding))::DOUBLE AS y, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
k(g, pos) AS (VALUES ('all', 0), ('donor', 2), ('acceptor', 4)),
a AS (SELECT gene, pos, d, avg(x) AS ax, avg(y) AS dx FROM s JOIN k ON g = 'all' OR g = site_type GROUP BY ALL)
SELECT gene, cast(pos * 64 + d AS INTEGER) AS dim, round(ax, 6) + 0.0 AS value FROM a
UNION ALL SELECT gene, cast((pos + 1) * 64 + d AS INTEGER), round(dx, 6) + 0.0 FROM a""")
def _a21(t):
    p = t.embeddings.select(F.col("label").alias("gene"), F.when(F.col("vec_id") % 3 == 0, F.lit("donor")).otherwise(F.lit("acceptor")).alias("site_type"),
                            F.lit(0).alias("model"), F.col("embedding").cast("array<double>").alias("acceptor"),
                            F.reverse(F.col("embedding").cast("array<double>")).alias("donor"))
    return genome.site_profiles(p, "gene", 64).select("gene", F.posexplode("vector").alias("dim", "value")).withColumn("value", r("value"))


@query("ensemble_mean_over_models", "A22", f"""
SELECT label, cast(dim AS INTEGER) AS dim, round(avg(m), 6) + 0.0 AS value FROM
 (SELECT label, dim, vec_id % 5 AS model, avg(x) AS m FROM ({UNNEST}) u GROUP BY ALL) q GROUP BY 1, 2""")
def _a22(t):
    per_model = vectors.vector_mean(t.embeddings.withColumn("model", F.col("vec_id") % 5), ["label", "model"], "embedding")
    m = vectors.vector_mean(per_model.drop("n_source_rows"), ["label"], "vector")
    return m.select("label", F.posexplode("vector").alias("dim", "value")).withColumn("value", r("value"))


@query("central_three_bins_mean", "A23", f"SELECT vec_id, round(avg(x), 6) + 0.0 AS value FROM ({UNNEST}) u WHERE dim BETWEEN 31 AND 33 GROUP BY 1")
def _a23(t):
    return t.embeddings.select("vec_id", r(genome.central_bins("embedding", 64)).alias("value"))


@query("ambiguity_report_long", "A25 R2", """
WITH p AS (SELECT 'name' AS mapping_column, p_name AS id, p_brand AS gene FROM part UNION SELECT 'size', cast(p_size AS VARCHAR), p_brand FROM part),
n AS (SELECT mapping_column, id, count(*) AS n_genes FROM p GROUP BY 1, 2 HAVING count(*) > 1)
SELECT p.mapping_column, p.id, gene, n_genes FROM p JOIN n ON p.mapping_column = n.mapping_column AND p.id = n.id""")
def _a25(t):
    pairs = t.part.select(F.explode(F.array(
        F.struct(F.lit("name").alias("mapping_column"), F.col("p_name").alias("id")),
        F.struct(F.lit("size").alias("mapping_column"), F.col("p_size").cast("string").alias("id")))).alias("m"),
        F.col("p_brand").alias("gene")).select("m.*", "gene")
    return mapping.ambiguity_report(pairs, ["mapping_column"]).select("mapping_column", "id", "gene", "n_genes")


@query("first_source_examples", "A26", """
SELECT user_id, string_agg(event_type, ';' ORDER BY event_id) AS source_keys_examples FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) q WHERE rn <= 10 GROUP BY 1""")
def _a26(t):
    return mapping.source_examples(t.events, "user_id", "event_id", "event_type", 10)
