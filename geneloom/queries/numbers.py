"""Numeric functions, predicates and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import num
from ..operators import features, quality
from .registry import query, r, scalar

scalar("to_number_or_null", "N1", "customer", "c_custkey", {
    "raw": "CASE c_custkey % 5 WHEN 0 THEN 'x1' WHEN 1 THEN '' WHEN 2 THEN concat(' ', cast(c_custkey AS STRING), '.5 ') WHEN 3 THEN '1e3' ELSE concat('-', cast(c_custkey AS STRING)) END"}, {
    "number": (lambda raw: num.to_number(raw), "try_cast(nullif(trim(raw), '') AS DOUBLE)")})
scalar("log1p_values", "N2", "part", "p_partkey", {"x": "p_retailprice"}, {
    "y": (lambda x: r(F.log1p(x)), "round(ln(1 + x), 6) + 0.0")})
scalar("signed_log1p_values", "N3", "customer", "c_custkey", {"x": "c_acctbal - 4500"}, {
    "y": (lambda x: r(num.signed_log1p(x)), "round(sign(x) * ln(1 + abs(x)), 6) + 0.0")})
scalar("safe_divisor", "N5", "lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey", {"x": "l_discount"}, {
    "d": (lambda x: num.safe_std(x), "CASE WHEN x = 0 THEN 1.0 ELSE x END")})
scalar("character_sum_tie_hash", "N8", "customer", "c_custkey", {"raw": "concat(c_name, c_mktsegment)"}, {
    "tie": (lambda raw: num.character_sum(raw, 1000), "cast(list_sum(list_transform(string_split(raw, ''), lambda x: ascii(x))) % 1000 AS INTEGER)")})
scalar("indexed_feature_names", "N10", "part", "p_partkey", {"g": "p_type", "o": "p_size - 25"}, {
    "svd_name": (lambda g, o: num.indexed_name("svd_", F.col("p_partkey"), 1), "concat('svd_', p_partkey + 1)"),
    "offset_name": (lambda g, o: num.offset_name(g, o), "printf('%s_offset_%+d', g, o)")})

PRIORITY = {"1-URGENT": 3.0, "2-HIGH": 2.0, "3-MEDIUM": 1.0, "5-LOW": 0.0}


@query("ordinal_levels_with_exclusions", "N4 F5 A24", """
SELECT o_orderstatus, count(*) AS n_rows,
 count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT','2-HIGH','3-MEDIUM','5-LOW')) AS n_excluded,
 round(sum(CASE o_orderpriority WHEN '1-URGENT' THEN 3.0 WHEN '2-HIGH' THEN 2.0 WHEN '3-MEDIUM' THEN 1.0 WHEN '5-LOW' THEN 0.0 END)::DOUBLE, 6) + 0.0 AS level_sum
FROM orders GROUP BY 1""")
def _ordinal(t):
    o = t.orders.select("o_orderstatus", num.ordinal_level("o_orderpriority", PRIORITY).alias("level"))
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("level").isNull()).alias("n_excluded"),
                                          r(F.sum("level")).alias("level_sum"))


@query("vector_norm_and_finite", "N6 N7", """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x AS DOUBLE) * cast(x AS DOUBLE)))), 6) + 0.0 AS norm,
 true AS is_finite FROM embeddings""")
def _norms(t):
    return t.embeddings.select("vec_id", r(num.l2_norm("embedding")).alias("norm"), num.is_finite("embedding").alias("is_finite"))


@query("coverage_percent", "N9 A18", """
SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS n_mapped, count(*) AS n_total,
 round_even(100.0::DOUBLE * (SELECT count(DISTINCT o_custkey) FROM orders) / count(*), 4) AS coverage_percent FROM customer""")
def _coverage(t):
    return quality.coverage(t.orders.select("o_custkey").distinct(), t.customer)


@query("protein_coding_style_filter", "F1", """
SELECT p_type, count(*) AS n FROM part WHERE p_type = 'ECONOMY' AND p_size BETWEEN 1 AND 22 AND p_brand IN ('Brand#1','Brand#2','Brand#3') GROUP BY 1""")
def _f1(t):
    p = t.part
    return p.where((F.col("p_type") == "ECONOMY") & F.col("p_size").between(1, 22) & F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")) \
        .groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query("annotation_row_filter", "F2 A24", """
WITH a AS (SELECT l_returnflag = 'R' AS is_p, CASE l_linenumber % 3 WHEN 0 THEN 'NOT|involved_in' WHEN 1 THEN 'involved_in' ELSE 'NOTE|part_of' END AS q,
  l_linestatus = 'O' AS is_db FROM lineitem)
SELECT count(*) AS data_rows, count(*) FILTER (WHERE NOT is_p) AS other_aspect,
 count(*) FILTER (WHERE is_p AND list_contains(string_split(q, '|'), 'NOT')) AS negated,
 count(*) FILTER (WHERE is_p AND NOT list_contains(string_split(q, '|'), 'NOT') AND NOT is_db) AS other_database,
 count(*) FILTER (WHERE is_p AND NOT list_contains(string_split(q, '|'), 'NOT') AND is_db) AS kept FROM a""")
def _f2(t):
    from ..plans.annotations import annotation_accounting

    m = F.col("l_linenumber") % 3
    rows = t.lineitem.select(
        F.when(F.col("l_returnflag") == "R", F.lit("P")).otherwise(F.lit("F")).alias("aspect"),
        F.when(m == 0, F.lit("NOT|involved_in")).when(m == 1, F.lit("involved_in")).otherwise(F.lit("NOTE|part_of")).alias("qualifier"),
        F.when(F.col("l_linestatus") == "O", F.lit("UniProtKB")).otherwise(F.lit("Other")).alias("db"))
    return annotation_accounting(rows)


@query("one_gene_endpoint_edges", "F3", """
WITH e AS (SELECT l_returnflag = 'R' AS x, l_linestatus = 'O' AS y FROM lineitem)
SELECT count(*) AS n_edges, count(*) FILTER (WHERE x <> y) AS n_one_gene, count(*) FILTER (WHERE x AND y) AS n_both_gene,
 count(*) FILTER (WHERE NOT x AND NOT y) AS n_no_gene FROM e""")
def _f3(t):
    return features.edge_class_counts(t.lineitem, F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")


@query("score_threshold_and_self_edges", "F4", """
SELECT o_custkey, l_suppkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_quantity >= 25 AND o_custkey <> l_suppkey GROUP BY 1, 2""")
def _f4(t):
    li = t.lineitem.where(F.col("l_quantity") >= 25).select("l_orderkey", "l_suppkey")
    return (li.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .where(F.col("o_custkey") != F.col("l_suppkey")).groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")))


@query("complete_finite_rows", "F6", """
SELECT label, count(*) AS n_complete FROM embeddings WHERE NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x) OR x > 0.25), true) GROUP BY 1""")
def _f6(t):
    small = F.forall("embedding", lambda x: x <= 0.25)
    return t.embeddings.where(num.is_finite("embedding") & small).groupBy("label").agg(F.count(F.lit(1)).alias("n_complete"))


@query("id_format_guard", "F7", r"""
SELECT count(*) AS n_ids, count(*) FILTER (WHERE NOT regexp_full_match(c_name, 'Customer#[0-9]{9}')) AS n_bad,
 bool_and(regexp_full_match(c_name, 'Customer#[0-9]{9}')) AS all_ok FROM customer""")
def _f7(t):
    ok = F.col("c_name").rlike(r"^Customer#[0-9]{9}$")
    return t.customer.agg(F.count(F.lit(1)).alias("n_ids"), F.count_if(~ok).alias("n_bad"), F.every(ok).alias("all_ok"))


@query("prefix_filter", "F8", "SELECT split_part(url, ':', 1) AS scheme, count(*) AS n FROM pages WHERE url LIKE 'https%' GROUP BY 1")
def _f8(t):
    return t.pages.where(F.col("url").startswith("https")).groupBy(F.split_part("url", F.lit(":"), F.lit(1)).alias("scheme")).agg(
        F.count(F.lit(1)).alias("n"))


@query("token_id_range_check", "F9", """
SELECT p_brand, count(*) FILTER (WHERE k >= 0 AND k < 500) AS n_valid, count(*) FILTER (WHERE NOT (k >= 0 AND k < 500)) AS n_invalid
FROM (SELECT p_brand, p_partkey - 100 AS k FROM part) q GROUP BY 1""")
def _f9(t):
    ok = F.col("k").between(0, 499)
    return t.part.select("p_brand", (F.col("p_partkey") - 100).alias("k")).groupBy("p_brand").agg(
        F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid"))


@query("kept_status_filter", "F10", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F','O') GROUP BY 1, 2")
def _f10(t):
    return t.orders.where(F.col("o_orderstatus").isin("F", "O")).groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("segment_slice_by_offset", "F11 W10", """
WITH o AS (SELECT DISTINCT s_suppkey * 15 AS start_at FROM supplier),
s AS (SELECT start_at, lead(start_at) OVER (ORDER BY start_at) AS next_at FROM o)
SELECT s.start_at, count(*) AS n_rows, min(p_partkey) AS lo, max(p_partkey) AS hi
FROM part JOIN s ON p_partkey >= s.start_at AND p_partkey < coalesce(s.next_at, (SELECT max(p_partkey) + 1 FROM part)) GROUP BY 1""")
def _f11(t):
    from ..operators.reshape import segment_of

    return segment_of(t.part, "p_partkey", t.supplier.select((F.col("s_suppkey") * 15).alias("start_at")), "start_at") \
        .groupBy("start_at").agg(F.count(F.lit(1)).alias("n_rows"), F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"))


@query("skip_done_keys", "F12 I1", """
SELECT count(*) AS n_todo, min(o_orderkey) AS first_key FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey)""")
def _f12(t):
    from ..streaming.incremental import remaining

    return remaining(t.orders, t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").agg(
        F.count(F.lit(1)).alias("n_todo"), F.min("o_orderkey").alias("first_key"))
