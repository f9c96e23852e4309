"""Identifier mapping and join operators on analogues of the gene tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mapping
from .registry import big, query, r

# master = part: a part answers to its own number and to number + size, so some
# numbers name one part and others several. Sources are order lines.
PAIRS_SQL = """pairs AS (SELECT cast(p_partkey AS VARCHAR) AS id, p_partkey AS gene FROM part
 UNION SELECT cast(p_partkey + p_size AS VARCHAR), p_partkey FROM part),
idx AS (SELECT id, count(DISTINCT gene) AS n_genes, min(gene) AS g FROM pairs GROUP BY 1)"""
SOURCE_SQL = """src AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, CASE WHEN l_linenumber = 7 THEN '' ELSE
 cast(l_partkey * (CASE WHEN l_linenumber = 6 THEN 1000000 ELSE 1 END) + l_linenumber AS VARCHAR) END AS k FROM lineitem)"""
ROUTED_SQL = f"""WITH {PAIRS_SQL}, {SOURCE_SQL},
routed AS (SELECT src.*, coalesce(n_genes, 0) AS n_genes, CASE WHEN n_genes = 1 THEN g END AS gene,
 CASE WHEN k = '' THEN 'excluded' WHEN n_genes = 1 THEN 'mapped' WHEN n_genes > 1 THEN 'ambiguous' ELSE 'unmapped' END AS status
 FROM src LEFT JOIN idx ON k = id)"""


def part_pairs(t):
    return mapping.id_pairs(t.part, "p_partkey", [F.array(F.col("p_partkey").cast("string")),
                                                  F.array((F.col("p_partkey") + F.col("p_size")).cast("string"))])


def line_source(t):
    far = F.when(F.col("l_linenumber") == 6, F.lit(1000000)).otherwise(F.lit(1))
    key = F.when(F.col("l_linenumber") == 7, F.lit("")).otherwise((F.col("l_partkey") * far + F.col("l_linenumber")).cast("string"))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", key.alias("k"))


@query("unique_only_join", "J1", ROUTED_SQL + " SELECT k, gene, n_genes, status, count(*) AS n_rows FROM routed GROUP BY ALL")
def _j1(t):
    routed = mapping.route(line_source(t), "k", mapping.id_index(part_pairs(t)))
    return routed.groupBy("k", "gene", "n_genes", "status").agg(F.count(F.lit(1)).alias("n_rows"))


@query("source_routing_accounting", "J2 A24", ROUTED_SQL + " SELECT status, count(*) AS n_rows FROM routed GROUP BY 1")
def _j2(t):
    return mapping.status_counts(mapping.route(line_source(t), "k", mapping.id_index(part_pairs(t))))


# tiers: current = brand-size, previous = name-size, alias = size alone (text keys of parts)
TIERS_SQL = """tiers AS (SELECT 0 AS tier, concat(p_name, '/', p_size) AS id, p_partkey AS gene FROM part WHERE p_partkey % 2 = 0
 UNION SELECT 1, concat(p_name, '/', p_size), p_partkey FROM part WHERE p_partkey % 2 = 1
 UNION SELECT 2, concat(p_name, '/', p_size), p_partkey FROM part WHERE p_type = 'ECONOMY'),
hit AS (SELECT id, tier, min(gene) AS g, min(gene) = max(gene) AS u FROM tiers GROUP BY 1, 2),
w AS (SELECT id, max(g) FILTER (WHERE tier = 0) AS g0, bool_or(u) FILTER (WHERE tier = 0) AS u0,
 max(g) FILTER (WHERE tier = 1) AS g1, bool_or(u) FILTER (WHERE tier = 1) AS u1,
 max(g) FILTER (WHERE tier = 2) AS g2, bool_or(u) FILTER (WHERE tier = 2) AS u2 FROM hit GROUP BY 1),
src AS (SELECT p_partkey AS source_row, concat(p_name, '/', CASE WHEN p_partkey % 5 = 0 THEN p_size + 30 ELSE p_size END) AS id FROM part)"""


def _tiers(t):
    key = F.concat_ws("/", "p_name", F.col("p_size").cast("string"))
    base = t.part.select(key.alias("id"), F.col("p_partkey").alias("gene"), "p_type")
    tiers = [("current", base.where(F.col("gene") % 2 == 0)), ("previous", base.where(F.col("gene") % 2 == 1)),
             ("alias", base.where("p_type = 'ECONOMY'"))]
    size = F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 30).otherwise(F.col("p_size"))
    src = t.part.select(F.col("p_partkey").alias("source_row"), F.concat_ws("/", "p_name", size.cast("string")).alias("id"))
    return src, tiers


@query("tiered_join_fall_through", "J3 J6", f"""WITH {TIERS_SQL}
SELECT source_row, src.id, CASE WHEN u0 THEN g0 WHEN u1 THEN g1 WHEN u2 THEN g2 END AS gene,
 CASE WHEN u0 THEN 'current' WHEN u1 THEN 'previous' WHEN u2 THEN 'alias' END AS method,
 CASE WHEN u0 OR u1 OR u2 THEN 'mapped' WHEN g0 IS NOT NULL OR g1 IS NOT NULL OR g2 IS NOT NULL THEN 'ambiguous' ELSE 'unmapped' END AS status
FROM src LEFT JOIN w ON src.id = w.id""")
def _j3(t):
    src, tiers = _tiers(t)
    return mapping.resolve_tiers(src, "id", tiers, stop_on_ambiguity=False)


@query("tiered_join_stop_on_ambiguity", "J4", f"""WITH {TIERS_SQL}
SELECT source_row, src.id, CASE WHEN g0 IS NOT NULL THEN CASE WHEN u0 THEN g0 END WHEN g1 IS NOT NULL THEN CASE WHEN u1 THEN g1 END WHEN u2 THEN g2 END AS gene,
 CASE WHEN g0 IS NOT NULL THEN 'current' WHEN g1 IS NOT NULL THEN 'previous' WHEN g2 IS NOT NULL THEN 'alias' END AS method,
 CASE WHEN g0 IS NOT NULL THEN CASE WHEN u0 THEN 'mapped' ELSE 'ambiguous' END WHEN g1 IS NOT NULL THEN CASE WHEN u1 THEN 'mapped' ELSE 'ambiguous' END
  WHEN g2 IS NOT NULL THEN CASE WHEN u2 THEN 'mapped' ELSE 'ambiguous' END ELSE 'unmapped' END AS status
FROM src LEFT JOIN w ON src.id = w.id""")
def _j4(t):
    src, tiers = _tiers(t)
    return mapping.resolve_tiers(src, "id", tiers, stop_on_ambiguity=True)


@query("primary_hides_alias", "J5", """
WITH p AS (SELECT DISTINCT p_brand AS id, p_partkey AS gene, 'primary' AS kind FROM part
 UNION SELECT DISTINCT concat(p_name, p_size), p_partkey, 'primary' FROM part WHERE p_partkey % 3 = 0
 UNION SELECT DISTINCT concat(p_name, p_size), p_partkey, 'alias' FROM part WHERE p_partkey % 3 > 0),
q AS (SELECT * FROM p WHERE kind = 'primary' OR id NOT IN (SELECT id FROM p WHERE kind = 'primary'))
SELECT id, CASE WHEN count(DISTINCT gene) = 1 THEN min(gene) END AS gene, min(kind) AS kind FROM q GROUP BY 1""")
def _j5(t):
    p = t.part
    ns = F.concat("p_name", F.col("p_size").cast("string"))
    pairs = (p.select(F.col("p_brand").alias("id"), F.col("p_partkey").alias("gene"), F.lit("primary").alias("kind"))
             .unionByName(p.select(ns.alias("id"), F.col("p_partkey").alias("gene"),
                                   F.when(F.col("p_partkey") % 3 == 0, F.lit("primary")).otherwise(F.lit("alias")).alias("kind"))))
    return mapping.primary_over_alias(pairs).select("id", "gene", "kind")


@query("best_method_per_key_mean", "J7", """
WITH e AS (SELECT label, vec_id % 3 AS tier, embedding FROM embeddings),
b AS (SELECT label, min(tier) AS tier FROM e GROUP BY 1),
k AS (SELECT e.label, e.tier, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM e JOIN b ON e.label = b.label AND e.tier = b.tier),
c AS (SELECT e.label, count(*) FILTER (WHERE e.tier = b.tier) AS n_source_rows, count(*) FILTER (WHERE e.tier > b.tier) AS n_unused_rows FROM e JOIN b ON e.label = b.label GROUP BY 1)
SELECT k.label, k.tier, n_source_rows, n_unused_rows, cast(dim AS INTEGER) AS dim, round(avg(cast(x AS DOUBLE)), 6) + 0.0 AS value
FROM k JOIN c ON k.label = c.label GROUP BY ALL""")
def _j7(t):
    e = t.embeddings.select("label", (F.col("vec_id") % 3).alias("tier"), "embedding")
    best = mapping.best_method_mean(e, "label", "tier", "embedding")
    out = best.select("label", "tier", "n_source_rows", big("n_unused_rows").alias("n_unused_rows"),
                      F.posexplode("vector").alias("dim", "value"))
    return out.withColumn("value", r("value"))


EVIDENCE_SQL = """ev AS (SELECT 'by_city' AS method, concat('n', s_nationkey) AS key, s_suppkey AS gene FROM supplier
 UNION SELECT 'by_key', concat('k', s_suppkey), s_suppkey FROM supplier
 UNION SELECT 'by_balance', concat('b', cast(floor(s_acctbal / 50) AS BIGINT)), s_suppkey FROM supplier),
src AS (SELECT s_suppkey AS sid, [{'m': 'by_balance', 'k': concat('b', cast(floor(s_acctbal / 50) AS BIGINT))},
  {'m': 'by_key', 'k': CASE WHEN s_suppkey % 3 = 0 THEN concat('k', s_suppkey) ELSE '' END},
  {'m': 'by_city', 'k': CASE WHEN s_suppkey % 7 = 0 THEN concat('n', s_nationkey) ELSE 'none' END}] AS ks FROM supplier),
asked AS (SELECT sid, unnest(ks) AS q FROM src), hits AS (SELECT sid, method, gene FROM asked JOIN ev ON q.m = method AND q.k = key AND q.k <> '')"""


def _evidence(t):
    s = t.supplier
    bal = F.concat(F.lit("b"), F.floor(F.col("s_acctbal") / 50).cast("string"))
    city, own = F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("k"), "s_suppkey")
    ev = s.select(F.explode(F.array(
        F.struct(F.lit("by_city").alias("method"), city.alias("key")), F.struct(F.lit("by_key").alias("method"), own.alias("key")),
        F.struct(F.lit("by_balance").alias("method"), bal.alias("key")))).alias("k"), F.col("s_suppkey").alias("gene")).select("k.*", "gene")
    keys = F.array(
        F.struct(F.lit("by_balance").alias("method"), bal.alias("key")),
        F.struct(F.lit("by_key").alias("method"), F.when(F.col("sid") % 3 == 0, own).otherwise(F.lit("")).alias("key")),
        F.struct(F.lit("by_city").alias("method"), F.when(F.col("sid") % 7 == 0, city).otherwise(F.lit("none")).alias("key")))
    return s.withColumn("sid", F.col("s_suppkey")), keys, ev


@query("evidence_agreement_join", "J8 J9", f"""WITH {EVIDENCE_SQL},
f AS (SELECT sid, count(DISTINCT gene) AS n, min(gene) AS g, string_agg(DISTINCT method, ';' ORDER BY method) AS methods FROM hits GROUP BY 1)
SELECT src.sid, CASE WHEN n = 1 THEN g END AS gene, coalesce(methods, '') AS methods,
 CASE WHEN n IS NULL THEN 'unmapped' WHEN n = 1 THEN 'mapped' ELSE 'ambiguous' END AS status FROM src LEFT JOIN f ON src.sid = f.sid""")
def _j8(t):
    src, keys, ev = _evidence(t)
    return mapping.agree(src, "sid", keys, ev).select("sid", "gene", "methods", "status")


@query("evidence_conflict_report", "J9 Q5", f"""WITH {EVIDENCE_SQL}, p AS (SELECT DISTINCT sid, gene FROM hits),
n AS (SELECT sid, count(*) AS n_candidates FROM p GROUP BY 1 HAVING count(*) > 1)
SELECT p.sid, gene, n_candidates FROM p JOIN n ON p.sid = n.sid""")
def _j9(t):
    src, keys, ev = _evidence(t)
    return mapping.conflict_candidates(src, "sid", keys, ev).select("sid", "gene", "n_candidates")


@query("left_join_with_indicator", "J10 J18", """
SELECT n_name, c_custkey, o_orderkey, CASE WHEN o_orderkey IS NULL THEN 'left_only' ELSE 'both' END AS merge_state
FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def _j10(t):
    merged = mapping.indicator_join(t.customer.select("c_custkey", "c_nationkey"), t.orders.select("o_custkey", "o_orderkey"), "c_custkey", "o_custkey")
    return merged.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_name", "c_custkey", "o_orderkey", "merge_state")


@query("one_to_one_join", "J11", "SELECT documents.doc_id, n_chars, quality, toxic FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id")
def _j11(t):
    return mapping.one_to_one_join(t.documents.select("doc_id", "n_chars"), t.labels, "doc_id")


@query("exact_id_semi_join", "J12", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _j12(t):
    return t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left_semi")


@query("unmapped_on_both_sides", "J13", """
SELECT 'customer' AS side, c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'order', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def _j13(t):
    a = t.customer.select(F.lit("customer").alias("side"), F.col("c_custkey").alias("k"))
    a = a.join(t.orders.select(F.col("o_custkey").alias("k")), "k", "left_anti")
    b = t.orders.select(F.lit("order").alias("side"), F.col("o_orderkey").alias("k"))
    b = b.join(t.lineitem.select(F.col("l_orderkey").alias("k")), "k", "left_anti")
    return a.unionByName(b)


@query("ordered_first_match", "J14", """
WITH known AS (SELECT DISTINCT cast(l_partkey AS VARCHAR) AS k FROM lineitem),
c AS (SELECT p_partkey, unnest([cast(p_partkey + 7 AS VARCHAR), 'none', cast(p_partkey AS VARCHAR), cast(p_partkey + p_size AS VARCHAR)]) AS k,
 unnest([0, 1, 2, 3]) AS pos FROM part)
SELECT p_partkey, arg_min(c.k, pos) AS matched_key, min(pos) AS matched_position FROM c JOIN known ON c.k = known.k GROUP BY 1""")
def _j14(t):
    k = F.col("p_partkey")
    cands = F.array((k + 7).cast("string"), F.lit("none"), k.cast("string"), (k + F.col("p_size")).cast("string"))
    src = t.lineitem.select(F.col("l_partkey").cast("string").alias("sk"))
    return mapping.first_match(t.part, "p_partkey", cands, src, "sk")


@query("exact_then_stripped_lookup", "J15", """
WITH g AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('G', p_partkey, '.', p_size) ELSE concat('G', p_partkey) END AS gid FROM part),
tok AS (SELECT concat('G', p_partkey) AS k, p_partkey + 1 AS tok FROM part WHERE p_partkey % 3 > 0
 UNION SELECT concat('G', p_partkey, '.', p_size), p_partkey + 5 FROM part WHERE p_partkey % 8 = 0)
SELECT g.gid, coalesce(a.tok, b.tok) AS tok, CASE WHEN a.tok IS NOT NULL THEN 'exact' WHEN b.tok IS NOT NULL THEN 'stripped' ELSE 'missing' END AS status
FROM g LEFT JOIN tok a ON g.gid = a.k LEFT JOIN tok b ON split_part(g.gid, '.', 1) = b.k""")
def _j15(t):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    plain = F.concat(F.lit("G"), k)
    versioned = F.concat(plain, F.lit("."), s)
    g = t.part.select(F.when(k % 2 == 0, versioned).otherwise(plain).alias("gid"))
    tok = (t.part.where(k % 3 > 0).select(plain.alias("k"), (k + 1).alias("tok"))
           .unionByName(t.part.where(k % 8 == 0).select(versioned.alias("k"), (k + 5).alias("tok"))))
    return mapping.exact_then_stripped(g, "gid", tok, "k", "tok", "missing", "exact", "stripped").select("gid", "tok", "status")


@query("transcript_version_fallback", "J16", """
WITH rec AS (SELECT p_partkey AS file_row, concat('T', p_partkey % 1500, '.', p_size % 4) AS rid, p_name AS seq FROM part),
v AS (SELECT rid AS k, arg_min(seq, file_row) AS seq FROM rec GROUP BY 1),
u AS (SELECT split_part(rid, '.', 1) AS k, arg_min(seq, file_row) AS seq FROM rec GROUP BY 1),
m AS (SELECT p_partkey, concat('T', p_partkey, '.', p_size % 3) AS tv, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('T', p_partkey) END AS tp FROM part)
SELECT p_partkey, CASE WHEN v.k IS NOT NULL THEN tv ELSE tp END AS source_id, coalesce(v.seq, u.seq) AS seq,
 CASE WHEN v.k IS NOT NULL THEN 'canonical_transcript_id_versioned_exact' ELSE 'canonical_transcript_id_unversioned_exact' END AS method
FROM m LEFT JOIN v ON tv = v.k LEFT JOIN u ON tp = u.k AND tp <> '' WHERE v.k IS NOT NULL OR u.k IS NOT NULL""")
def _j16(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    rec = t.part.select(k.alias("file_row"), F.concat(F.lit("T"), k % 1500, F.lit("."), s % 4).alias("rid"), F.col("p_name").alias("seq"))
    m = t.part.select("p_partkey", F.concat(F.lit("T"), k, F.lit("."), s % 3).alias("tv"),
                      F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("T"), k)).alias("tp"))
    return mapping.transcript_lookup(m, "p_partkey", "tv", "tp", rec, "rid", "file_row", "seq")


@query("gather_vector_by_row_id", "J17", """
SELECT doc_id, vec_id, round(embedding[1]::DOUBLE, 6) + 0.0 AS first_value FROM labels JOIN embeddings ON doc_id % (SELECT count(*) FROM embeddings) = vec_id""")
def _j17(t):
    n = t.embeddings.agg(F.count(F.lit(1)).alias("n")).scalar()
    src = t.labels.withColumn("vec_id", F.col("doc_id") % n)
    return src.join(t.embeddings, "vec_id").select("doc_id", "vec_id", r(F.col("embedding")[0].cast("double")).alias("first_value"))


@query("apply_mapping_with_default", "J19", """
SELECT c_custkey, coalesce(n, '') AS id_value, coalesce(n_status, 'not_queried_or_no_result') AS id_mapping_status
FROM customer LEFT JOIN (SELECT o_custkey, cast(count(*) AS VARCHAR) AS n, 'found' AS n_status FROM orders GROUP BY 1) o ON c_custkey = o_custkey""")
def _j19(t):
    found = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("string").alias("id_value")).withColumn(
        "id_mapping_status", F.lit("found"))
    return mapping.apply_mapping(t.customer.select("c_custkey"), "c_custkey", found, ["id_value", "id_mapping_status"])


RECON_SQL = """WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN cast(c_custkey % 10 AS VARCHAR)
   ELSE concat(c_custkey % 10, '|', c_custkey % 7) END AS cur,
  CASE WHEN c_custkey % 4 = 0 THEN []::VARCHAR[] ELSE [cast(c_custkey % 5 AS VARCHAR)] END AS ea,
  CASE WHEN c_custkey % 2 = 0 THEN []::VARCHAR[] ELSE [cast(c_custkey % 6 AS VARCHAR)] END AS eb FROM customer),
s AS (SELECT *, list_sort(list_distinct(list_filter(string_split(cur, '|'), lambda x: x <> ''))) AS c, list_sort(list_distinct(list_concat(ea, eb))) AS e FROM b)"""


def _recon(t, fill_all):
    k = F.col("c_custkey")
    cur = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, (k % 10).cast("string")).otherwise(
        F.concat_ws("|", (k % 10).cast("string"), (k % 7).cast("string")))
    none = F.array().cast("array<string>")
    a = F.when(k % 4 == 0, none).otherwise(F.array((k % 5).cast("string")))
    b = F.when(k % 2 == 0, none).otherwise(F.array((k % 6).cast("string")))
    out = t.customer.select("c_custkey", mapping.reconcile(cur, a, b, fill_all).alias("x"))
    return out.select("c_custkey", "x.value", "x.status", "x.note")


@query("reconcile_single_fill", "J20 U1 U2", RECON_SQL + """
SELECT c_custkey, CASE WHEN len(c) > 0 THEN cur WHEN len(e) = 1 THEN e[1] ELSE '' END AS value,
 CASE WHEN len(c) > 0 AND len(e) = 0 THEN 'current_only_no_external_mapping' WHEN len(c) > 0 AND list_has_any(c, e) THEN 'agreement' WHEN len(c) > 0 THEN 'conflict'
  WHEN len(e) = 1 THEN 'filled_from_external' WHEN len(e) > 1 THEN 'missing_ambiguous_external' ELSE 'still_missing' END AS status,
 CASE WHEN len(c) > 0 AND len(e) > 0 AND NOT list_has_any(c, e) THEN concat('current=', array_to_string(c, ';'), '; external=', array_to_string(e, ';'))
  WHEN len(c) = 0 AND len(e) > 1 THEN concat('external=', array_to_string(e, ';')) ELSE '' END AS note FROM s""")
def _j20(t):
    return _recon(t, False)


@query("reconcile_fill_all", "J21 U1 U2", RECON_SQL + """
SELECT c_custkey, CASE WHEN len(c) > 0 THEN array_to_string(c, ';') ELSE array_to_string(e, ';') END AS value,
 CASE WHEN len(c) > 0 AND len(e) = 0 THEN 'current_only_no_external_mapping' WHEN len(c) > 0 AND list_has_any(c, e) THEN 'agreement' WHEN len(c) > 0 THEN 'conflict'
  WHEN len(e) > 0 THEN 'filled_from_external' ELSE 'still_missing' END AS status,
 CASE WHEN len(c) > 0 AND len(e) > 0 AND NOT list_has_any(c, e) THEN concat('current=', array_to_string(c, ';'), '; external=', array_to_string(e, ';')) ELSE '' END AS note FROM s""")
def _j21(t):
    return _recon(t, True)


@query("conform_vectors", "J1 J2 A1 N6 SC20", """
WITH pairs AS (SELECT cast(p_partkey + 1 AS VARCHAR) AS id, p_partkey // 4 AS gene FROM part WHERE p_size > 25 UNION SELECT cast(p_partkey AS VARCHAR), p_partkey // 4 FROM part),
idx AS (SELECT id, count(DISTINCT gene) AS n, min(gene) AS g FROM pairs GROUP BY 1),
m AS (SELECT g AS gene, embedding FROM embeddings JOIN idx ON cast(vec_id AS VARCHAR) = id WHERE n = 1),
x AS (SELECT gene, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM m),
a AS (SELECT gene, d, avg(v) AS v FROM x GROUP BY 1, 2),
c AS (SELECT gene, count(*) AS n_source_rows FROM m GROUP BY 1)
SELECT a.gene, n_source_rows, round(sqrt(sum(v * v)), 6) + 0.0 AS norm, round(sum(v * d), 6) + 0.0 AS weighted_sum
FROM a JOIN c ON a.gene = c.gene GROUP BY ALL""")
def _conform(t):
    pairs = mapping.id_pairs(
        t.part.withColumn("gene_no", F.floor(F.col("p_partkey") / 4)), "gene_no",
        [F.array(F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 25, (F.col("p_partkey") + 1).cast("string")).otherwise(F.lit("")))])
    src = t.embeddings.select(F.col("vec_id").cast("string").alias("k"), "embedding")
    routed = mapping.route(src, "k", mapping.id_index(pairs))
    genes = mapping.collapse(routed, "gene", "embedding", "k")
    from ..functions.num import l2_norm

    ws = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return genes.select("gene", "n_source_rows", r(l2_norm("vector")).alias("norm"), r(ws).alias("weighted_sum"))
