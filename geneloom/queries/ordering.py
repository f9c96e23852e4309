"""Ranking, ordering, set and reshape operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import num
from ..operators import quality, ranges, reshape, vectors
from ..plans import master as gene_master
from .aggregates import UNNEST
from .registry import big, query, r


@query("pick_canonical_row", "W1 W2 N8", """
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 3 END AS tag_rank,
  CASE WHEN l_linenumber <= 5 THEN l_linenumber ELSE 99 END AS tsl_rank,
  (l_partkey * 31 + l_suppkey) % 100000 AS tie, l_linestatus = 'O' AS coding FROM lineitem),
f AS (SELECT *, max(CASE WHEN coding THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS any_coding FROM c),
rk AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY tag_rank, tsl_rank, -l_quantity, tie, l_partkey, l_suppkey) AS rn FROM f WHERE coding OR any_coding = 0)
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, CASE WHEN l_returnflag = 'A' THEN 'MANE_Select' WHEN l_returnflag = 'N' THEN 'appris_principal_1'
 WHEN l_linenumber = 1 THEN 'transcript_support_level_1' ELSE 'longest_exon_sum_fallback' END AS rule FROM rk WHERE rn = 1""")
def _w1(t):
    li = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.when(F.col("l_returnflag") == "A", F.array(F.lit("MANE_Select"))).when(
            F.col("l_returnflag") == "N", F.array(F.lit("appris_principal_1"))).otherwise(F.array(F.lit("basic"))).alias("tags"),
        F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber").cast("string")).otherwise(F.lit("NA")).alias("tsl"),
        F.when(F.col("l_linestatus") == "O", F.lit("protein_coding")).otherwise(F.lit("other")).alias("kind"),
        ((F.col("l_partkey") * 31 + F.col("l_suppkey")) % 100000).alias("tie"))
    best = gene_master.pick_canonical(li, "l_orderkey", "tags", "tsl", "l_quantity", "kind",
                                      tie=F.struct("tie", "l_partkey", "l_suppkey"))
    return best.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", gene_master.selection_rule("tags", "tsl").alias("rule"))


@query("longest_sequence_per_key", "W3", """
SELECT source, max(n_chars) AS longest, min(doc_id) AS doc_id FROM (SELECT *, max(n_chars) OVER (PARTITION BY source) AS m FROM documents) q WHERE n_chars = m GROUP BY 1""")
def _w3(t):
    best = F.min_by(F.struct("n_chars", "doc_id"), F.struct(-F.col("n_chars"), "doc_id")).alias("b")
    return t.documents.groupBy("source").agg(best).select("source", F.col("b.n_chars").alias("longest"), F.col("b.doc_id").alias("doc_id"))


@query("first_row_per_key", "W4", "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
def _w4(t):
    return t.events.groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("event_type"))


@query("dense_row_index", "W5", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS embedding_row FROM orders")
def _w5(t):
    o = t.orders.select("o_orderkey", (-F.col("o_totalprice")).alias("neg"))
    return ranges.with_row_index(o, ["neg", "o_orderkey"], "embedding_row").select("o_orderkey", "embedding_row")


@query("first_seen_index", "W6", """
SELECT l_partkey, row_number() OVER (ORDER BY f) - 1 AS dense_index FROM (SELECT l_partkey, min(o) AS f FROM
 (SELECT l_partkey, l_orderkey * 1000000 + l_partkey AS o FROM lineitem) a GROUP BY 1) q""")
def _w6(t):
    li = t.lineitem.select("l_partkey", (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("o"))
    return ranges.first_seen_index(li, "l_partkey", "o").select("l_partkey", "dense_index")


@query("cumulative_share", "W7", """
WITH p AS (SELECT l_partkey, sum(cast(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents FROM lineitem GROUP BY 1)
SELECT l_partkey, round(cents / (SELECT sum(cents) FROM p)::DOUBLE, 9) + 0.0 AS share,
 round((sum(cents) OVER (ORDER BY -cents, l_partkey ROWS UNBOUNDED PRECEDING))::DOUBLE / (SELECT sum(cents) FROM p)::DOUBLE, 9) + 0.0 AS cumulative FROM p""")
def _w7(t):
    p = t.lineitem.groupBy("l_partkey").agg(F.sum(big(F.round(F.col("l_extendedprice") * 100))).alias("cents")).withColumn("neg", -F.col("cents"))
    total = p.agg(F.sum("cents").cast("double").alias("s")).scalar()
    c = ranges.running_sum(p, ["neg", "l_partkey"], "cents", "upto")
    return c.select("l_partkey", r(F.col("cents") / total, 9).alias("share"), r(F.col("upto") / total, 9).alias("cumulative"))


@query("duplicate_key_counts", "W8", """
SELECT count(*) AS n_rows, count(DISTINCT l_partkey) AS n_keys, count(*) - count(DISTINCT l_partkey) AS n_repeats FROM lineitem""")
def _w8(t):
    c = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("c"))
    return c.agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.sum(F.col("c") - 1).alias("n_repeats"))


@query("adjacent_row_gap", "W9", """
SELECT event_id, user_id, event_id - lag(event_id) OVER w AS since_previous, lead(event_id) OVER w - event_id AS until_next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def _w9(t):
    n = ranges.with_neighbours(t.events.select("event_id", "user_id"), ["user_id"], ["event_id"], ["event_id"])
    return n.select("event_id", "user_id", (F.col("event_id") - F.col("prev_event_id")).alias("since_previous"),
                    (F.col("next_event_id") - F.col("event_id")).alias("until_next"))


@query("next_greater_offset", "W10", """
SELECT start_at, lead(start_at) OVER (ORDER BY start_at) AS next_at FROM (SELECT DISTINCT o_custkey * 10 AS start_at FROM orders) q""")
def _w10(t):
    o = t.orders.select((F.col("o_custkey") * 10).alias("start_at")).distinct()
    return ranges.with_neighbours(o, [], ["start_at"], ["start_at"]).select("start_at", F.col("next_start_at").alias("next_at"))


@query("largest_magnitude_per_position", "W11", f"""
SELECT cast(dim AS INTEGER) AS dim, round(arg_min(x, (-abs(x), vec_id)), 6) + 0.0 AS top_value, arg_min(vec_id, (-abs(x), vec_id)) AS vec_id FROM ({UNNEST}) u GROUP BY 1""")
def _w11(t):
    e = vectors.explode_vector(t.embeddings, ["vec_id"], "embedding").withColumn("value", F.col("value").cast("double"))
    best = F.min_by(F.struct("value", "vec_id"), F.struct(-F.abs("value"), "vec_id")).alias("b")
    return e.groupBy("dim").agg(best).select("dim", r("b.value").alias("top_value"), "b.vec_id")


@query("limited_subset", "O2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def _o2(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(100)


@query("longest_texts_top_k", "O3", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def _o3(t):
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query("id_set_union", "U1", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation")
def _u1(t):
    return (t.customer.select(F.col("c_nationkey").alias("k")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k")))
            .unionByName(t.nation.select(F.col("n_nationkey").alias("k"))).distinct())


@query("id_set_intersection", "U2", "SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def _u2(t):
    flags = t.events.groupBy("user_id").agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("p"), F.max((F.col("event_type") == "error").cast("int")).alias("e"))
    return flags.where("p = 1 AND e = 1").select("user_id")


@query("keys_added_and_lost", "U3", """
WITH o AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'), n AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01')
SELECT (SELECT count(*) FROM n WHERE k NOT IN (SELECT k FROM o)) AS n_added, (SELECT count(*) FROM o WHERE k NOT IN (SELECT k FROM n)) AS n_lost,
 (SELECT count(*) FROM o WHERE k IN (SELECT k FROM n)) AS n_kept""")
def _u3(t):
    cut = F.lit("1999-01-01").cast("timestamp")
    return quality.added_and_lost(t.lineitem.where(F.col("l_shipdate") < cut), t.lineitem.where(F.col("l_shipdate") >= cut), "l_partkey")


@query("concatenated_row_sets", "U5", """
SELECT kind, count(*) AS n, sum(id)::BIGINT AS id_sum FROM (SELECT 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'part', p_partkey FROM part) q GROUP BY 1""")
def _u5(t):
    parts = [t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")),
             t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")),
             t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"))]
    return reshape.union_all(parts).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


@query("concatenated_vectors", "U6", """
SELECT vec_id, len(list_concat(embedding, embedding)) AS width, round(list_sum(list_transform(list_concat(embedding, list_reverse(embedding)), lambda x, i: cast(x AS DOUBLE) * i)), 6) + 0.0 AS weighted_sum FROM embeddings""")
def _u6(t):
    a = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    b = t.embeddings.select("vec_id", F.reverse(F.col("embedding").cast("array<double>")).alias("vector"))
    c = reshape.concat_vectors([a, b], "vec_id")
    ws = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda p, x: p + x)
    return c.select("vec_id", big(F.size("vector")).alias("width"), r(ws).alias("weighted_sum"))


@query("distinct_vector_count", "U7", """
SELECT count(*) AS n_rows, count(DISTINCT v) AS n_distinct, count(*) - count(DISTINCT v) AS n_duplicates FROM (SELECT list_transform(embedding, lambda x: round(x, 0)) AS v FROM embeddings) q""")
def _u7(t):
    coarse = t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.round(x, 0)).alias("v"))
    return vectors.duplicate_vector_count(coarse, "vec_id", "v")


@query("distinct_rows", "U8", "SELECT DISTINCT p_brand, p_type, p_size FROM part")
def _u8(t):
    return t.part.select("p_brand", "p_type", "p_size").distinct()


@query("transpose_to_long", "R1", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, m AS "column", v AS value FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax FROM lineitem) q
UNPIVOT (v FOR m IN (l_quantity, l_tax))""")
def _r1(t):
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k")
    wide = t.lineitem.select(key, "l_quantity", "l_tax")
    return reshape.transpose_long(wide, "k", ["l_quantity", "l_tax"]).select("k.*", "column", "value")


@query("explode_multi_valued", "R2", """
SELECT p_partkey, cast(i - 1 AS INTEGER) AS position, tok FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tok, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) q""")
def _r2(t):
    return t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("position", "tok"))


@query("wide_to_vector", "R3", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax), 6) + 0.0 AS norm FROM lineitem""")
def _r3(t):
    v = num.wide_to_vector(["l_quantity", "l_discount", "l_tax"])
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(num.l2_norm(v)).alias("norm"))


@query("vector_to_wide", "R4", "SELECT vec_id, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) + 0.0 AS dim_{i}" for i in range(64)) + " FROM embeddings")
def _r4(t):
    wide = t.embeddings.select("vec_id", *num.vector_to_wide(num.as_double_vector("embedding"), 64))
    return wide.select("vec_id", *[r(f"dim_{i}").alias(f"dim_{i}") for i in range(64)])
