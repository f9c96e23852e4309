"""Graph, matrix and quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, num
from ..operators import features, graph, linalg, quality, ranges, vectors
from .aggregates import UNNEST
from ..session import materialize
from .registry import query, r

# an order-customer-supplier network: customers and suppliers as nodes
EDGE_SQL = """e AS (SELECT concat('c', o_custkey) AS a, concat('s', l_suppkey) AS b, l_quantity, l_discount, l_tax, l_extendedprice,
 l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def edges(t):
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    j = li.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"), "l_quantity", "l_discount", "l_tax",
                    "l_extendedprice", (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("o"))


@query("channel_split_first_wins", "G1 SC30", f"""
WITH {EDGE_SQL}, l AS (SELECT a, b, o, 'discount' AS channel, l_discount * 1000 AS score FROM e UNION ALL SELECT a, b, o, 'tax', l_tax * 1000 FROM e)
SELECT channel, a AS src, b AS dst, round(arg_min(score, o) / 1000.0::DOUBLE, 6) + 0.0 AS weight FROM l WHERE score >= 35 GROUP BY 1, 2, 3""")
def _g1(t):
    e = edges(t).select("a", "b", "o", (F.col("l_discount") * 1000).alias("discount"), (F.col("l_tax") * 1000).alias("tax"))
    c = graph.channel_edges(e, "a", "b", ["discount", "tax"], "o", 35)
    return c.select("channel", "src", "dst", r(F.col("score") / 1000.0).alias("weight"))


@query("node_universe", "G2", f"WITH {EDGE_SQL} SELECT a AS node FROM e UNION SELECT b FROM e")
def _g2(t):
    return graph.node_universe(edges(t), "a", "b")


@query("symmetric_adjacency", "G3", f"""
WITH {EDGE_SQL}, d AS (SELECT a AS row, b AS col, l_quantity AS q FROM e UNION ALL SELECT b, a, l_quantity FROM e)
SELECT row, col, round(sum(q), 4) + 0.0 AS value FROM d GROUP BY 1, 2 HAVING sum(q) <> 0""")
def _g3(t):
    return graph.symmetric_adjacency(edges(t), "a", "b", "l_quantity").withColumn("value", r("value", 4))


@query("neighbour_lists", "G4", f"""
WITH {EDGE_SQL}, p AS (SELECT a AS node, b AS neighbour FROM e UNION SELECT b, a FROM e)
SELECT node, neighbour FROM p""")
def _g4(t):
    return graph.neighbour_pairs(edges(t), "a", "b")


ADJ_SQL = f"""{EDGE_SQL}, d AS (SELECT a AS row, b AS col, l_quantity AS q FROM e UNION ALL SELECT b, a, l_quantity FROM e),
adj AS (SELECT row, col, sum(q) AS v FROM d GROUP BY 1, 2), rs AS (SELECT row AS n, sum(v) AS s FROM adj GROUP BY 1),
pp AS (SELECT row, col, ln((SELECT sum(v) FROM adj) * v / (a.s * b.s)) AS v FROM adj JOIN rs a ON row = a.n JOIN rs b ON col = b.n)"""


@query("sparse_ppmi", "G5", f"WITH {ADJ_SQL} SELECT row, col, round(v, 6) + 0.0 AS value FROM pp WHERE v > 0")
def _g5(t):
    return graph.symmetric_ppmi(edges(t), "a", "b", "l_quantity").withColumn("value", r("value"))


@query("row_l2_normalised_ppmi", "M8", f"""
WITH {ADJ_SQL}, k AS (SELECT * FROM pp WHERE v > 0) SELECT row, col, round(v / sqrt(sum(v * v) OVER (PARTITION BY row)), 6) + 0.0 AS value FROM k""")
def _m8(t):
    p = materialize(graph.symmetric_ppmi(edges(t), "a", "b", "l_quantity"), "ppmi")
    return features.l2_normalize_rows(p, "row", "col").withColumn("value", r("value"))


@query("random_walks", "G6")
def _g6(t):
    pairs = graph.neighbour_pairs(edges(t), "a", "b")
    return graph.random_walks(pairs)


# 10 walks of 80 nodes from every node, each step an edge, each walk another one
@query("random_walk_invariants", "G6", f"""
WITH {EDGE_SQL} SELECT node, 10 AS walks, 800 AS visits, 0 AS steps_off_edges, true AS starts_here FROM (SELECT a AS node FROM e UNION SELECT b FROM e) q""")
def _g6b(t):
    pairs = materialize(graph.neighbour_pairs(edges(t), "a", "b"), "pairs")
    return invariants(materialize(graph.random_walks(pairs), "walks"), pairs)


def invariants(walks, pairs):
    """``[node, walks, visits, steps_off_edges, starts_here]`` of walks on ``[node, neighbour]``."""
    n = F.size("walk") - 1
    steps = walks.select("node", F.explode(F.arrays_zip(F.slice("walk", F.lit(1), n).alias("x"), F.slice("walk", F.lit(2), n).alias("y"))).alias("e")).select("node", "e.x", "e.y")
    # steps are looked up among the edges, each once; only those that are none look for their walks
    ends = pairs.select(F.col("node").alias("x"), F.col("neighbour").alias("y")).hint("shuffle_hash")
    wrong = materialize(steps.select("x", "y").join(ends, ["x", "y"], "left_anti").distinct(), "off")
    off = steps.join(wrong, ["x", "y"]).groupBy("node").agg(F.count(F.lit(1)).alias("off")) if not wrong.isEmpty() else None
    per = walks.groupBy("node").agg(F.sum(F.size("walk")).alias("visits"), F.bool_and(F.col("walk")[0] == F.col("node")).alias("starts_here"))
    per = per.join(distinct_walks(walks), "node")
    per = per.join(off, "node", "left").withColumn("off", F.coalesce("off", F.lit(0))) if off is not None else per.withColumn("off", F.lit(0))
    return per.select("node", F.col("walks").cast("int").alias("walks"), F.col("visits").cast("int").alias("visits"), F.col("off").cast("int").alias("steps_off_edges"), "starts_here")


def distinct_walks(walks):
    """``[node, walks]``: the number of distinct walks. Fingerprints are shuffled; the walks themselves only if they share one."""
    prints = walks.select("node", F.xxhash64("walk").alias("f"))
    counted = materialize(prints.groupBy("node", "f").agg(F.count(F.lit(1)).alias("n")), "prints")
    shared = counted.where("n > 1").select("node", "f")
    again = walks.withColumn("f", F.xxhash64("walk")).join(shared, ["node", "f"], "left_semi").groupBy("node", "f").agg(F.count_distinct("walk").alias("many"))
    return counted.join(again, ["node", "f"], "left").groupBy("node").agg(F.sum(F.coalesce("many", F.lit(1))).alias("walks"))


HIER_SQL = """par AS (SELECT concat('N', n_nationkey) AS child, concat('R', n_regionkey) AS parent FROM nation
 UNION SELECT concat('C', c_custkey), concat('N', c_nationkey) FROM customer UNION SELECT concat('O', o_orderkey), concat('C', o_custkey) FROM orders
 UNION SELECT concat('R', r_regionkey), 'ROOT' FROM region)"""


def hierarchy(t):
    return (t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("child"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
            .unionByName(t.customer.select(F.concat(F.lit("C"), "c_custkey").alias("child"), F.concat(F.lit("N"), "c_nationkey").alias("parent")))
            .unionByName(t.orders.select(F.concat(F.lit("O"), "o_orderkey").alias("child"), F.concat(F.lit("C"), "o_custkey").alias("parent")))
            .unionByName(t.region.select(F.concat(F.lit("R"), "r_regionkey").alias("child"), F.lit("ROOT").alias("parent"))))


@query("chain_closure", "G8", """
SELECT a.c_custkey AS term, b.c_custkey AS ancestor FROM customer a JOIN customer b ON b.c_custkey > a.c_custkey AND a.c_custkey // 200 = b.c_custkey // 200""")
def _g8b(t):
    # chains of 200 customers, each under the next
    k = t.customer.where("c_custkey % 200 < 199").select(F.col("c_custkey").alias("child"), (F.col("c_custkey") + 1).alias("parent"))
    return graph.closure(k.join(t.customer, F.col("parent") == F.col("c_custkey"), "left_semi"))


@query("ancestor_closure", "G8", f"""
WITH RECURSIVE {HIER_SQL}, r(term, ancestor) AS (SELECT child, parent FROM par UNION SELECT r.term, par.parent FROM r JOIN par ON r.ancestor = par.child)
SELECT term, ancestor FROM r""")
def _g8(t):
    return graph.closure(hierarchy(t))


@query("annotation_propagation", "G9", f"""
WITH RECURSIVE {HIER_SQL}, r(term, ancestor) AS (SELECT child, parent FROM par UNION SELECT r.term, par.parent FROM r JOIN par ON r.ancestor = par.child),
d AS (SELECT DISTINCT o_orderpriority AS entity, concat('C', o_custkey) AS term FROM orders)
SELECT entity, term FROM d UNION SELECT entity, ancestor FROM d JOIN r ON d.term = r.term""")
def _g9(t):
    anc = graph.closure(hierarchy(t))
    ann = t.orders.select(F.col("o_orderpriority").alias("entity"), F.concat(F.lit("C"), "o_custkey").alias("term")).distinct()
    return graph.propagate(ann, "entity", "term", anc)


@query("ontology_corpus", "G7 SK8", """
WITH d AS (SELECT DISTINCT concat('p', c_custkey) AS entity, concat('GO:N', c_nationkey) AS term, c_mktsegment AS seg, n_regionkey AS rk FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT entity, 'entity' AS kind, concat('UNIPROT_', upper(entity), ' GO_', least(substr(term, 4), concat('R', rk)), ' GO_', greatest(substr(term, 4), concat('R', rk)), ' symbol_', lower(seg)) AS sentence FROM d
UNION ALL SELECT entity, 'pair', concat('UNIPROT_', upper(entity), ' GO_', substr(term, 4), ' GO_R', rk) FROM d
UNION ALL SELECT concat('GO:N', n_nationkey), 'metadata', concat('GO_N', n_nationkey, ' namespace_nationlevel ', array_to_string(list_filter(regexp_extract_all(lower(n_name), '[a-z0-9]+'), lambda x: length(x) >= 2), ' '), ' GO_R', n_regionkey) FROM nation
UNION ALL SELECT concat('GO:R', r_regionkey), 'metadata', concat('GO_R', r_regionkey, ' namespace_nationlevel ', lower(r_name)) FROM region
UNION ALL SELECT concat('GO:N', n_nationkey), 'edge', concat('GO_N', n_nationkey, ' GO_R', n_regionkey) FROM nation""")
def _g7(t):
    up = t.nation.select(F.concat(F.lit("GO:N"), "n_nationkey").alias("term"), F.concat(F.lit("GO:R"), "n_regionkey").alias("ancestor"))
    c = t.customer.select(F.concat(F.lit("p"), "c_custkey").alias("entity"), F.concat(F.lit("GO:N"), "c_nationkey").alias("term"), F.col("c_mktsegment").alias("symbol"))
    none = F.array().cast("array<string>")
    terms = (t.nation.select(F.concat(F.lit("GO:N"), "n_nationkey").alias("term_id"), F.col("n_name").alias("name"),
                             F.array(F.concat(F.lit("GO:R"), "n_regionkey"), F.lit("GO:unknown")).alias("parents"))
             .unionByName(t.region.select(F.concat(F.lit("GO:R"), "r_regionkey").alias("term_id"), F.col("r_name").alias("name"), none.alias("parents")))
             .select("*", F.lit("nation_level").alias("namespace"), F.lit("").alias("definition"), none.alias("synonyms")))
    s = graph.association_sentences(c.select("entity", "term"), up, c.select("entity", "symbol")).unionByName(graph.ontology_sentences(terms))
    return s.select("entity", "kind", F.array_join("tokens", " ").alias("sentence"))


@query("typed_context_features", "G10 F3", """
WITH e AS (SELECT l_returnflag AS rel, l_linestatus, concat('o', l_orderkey) AS x, concat('p', l_partkey) AS y, l_returnflag = 'R' AS xg, l_linestatus = 'O' AS yg FROM lineitem),
k AS (SELECT CASE WHEN xg THEN x ELSE y END AS gene, concat(rel, '||', CASE WHEN xg THEN 'source' ELSE 'target' END, '||', l_linestatus, '||', CASE WHEN xg THEN y ELSE x END) AS feature FROM e WHERE xg <> yg)
SELECT gene, feature, count(*)::DOUBLE AS value FROM k GROUP BY 1, 2""")
def _g10(t):
    e = t.lineitem.select("l_returnflag", "l_linestatus", F.concat(F.lit("o"), "l_orderkey").alias("x"), F.concat(F.lit("p"), "l_partkey").alias("y"))
    kept = features.one_gene_edges(e, F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    left = F.col("gene_is_left")
    side = F.when(left, F.lit("source")).otherwise(F.lit("target"))
    return features.typed_features(kept, F.when(left, F.col("x")).otherwise(F.col("y")),
                                   ["l_returnflag", side, "l_linestatus", F.when(left, F.col("y")).otherwise(F.col("x"))])


@query("node_attribute_with_fallback", "G11", """
SELECT concat('Cust::', o_custkey) AS node, coalesce(c_mktsegment, 'Cust') AS kind, count(*) AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) c ON o_custkey = c_custkey GROUP BY 1, 2""")
def _g11(t):
    nodes = t.orders.groupBy(F.concat(F.lit("Cust::"), "o_custkey").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    table = t.customer.where("c_custkey % 3 > 0").select(F.concat(F.lit("Cust::"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    return graph.node_attribute(nodes, "node", table, "id", "kind", ids.node_kind("node")).select("node", "kind", "n")


def brand_sentences(t):
    """The brands that a customer ordered, in order; some lists are longer than a chunk."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    words = li.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    lines = words.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "p_brand"))).alias("l"))
    return lines.select("o_custkey", F.col("l.p_brand").alias("tokens"))


PAIRS_SQL = """WITH t AS (SELECT o_custkey, p_brand AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS p
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
p AS (SELECT x.w AS a, y.w AS b, (11 - (y.p - x.p)) / 10.0::DOUBLE AS n FROM t x JOIN t y ON x.o_custkey = y.o_custkey AND y.p > x.p AND y.p - x.p <= 10),
c AS (SELECT row, col, sum(n) AS value FROM (SELECT a AS row, b AS col, n FROM p UNION ALL SELECT b, a, n FROM p) q GROUP BY 1, 2)"""


@query("skip_gram_window_pairs", "G12", f"{PAIRS_SQL} SELECT row, col, round(value, 4) + 0.0 AS value FROM c")
def _g12a(t):
    return graph.window_pairs(brand_sentences(t), "tokens", 10).withColumn("value", r("value", 4))


@query("skip_gram_noise_weights", "G12", f"""
{PAIRS_SQL}, s AS (SELECT row AS w, sum(value) AS s FROM c GROUP BY 1), z AS (SELECT sum(s ** 0.75) AS z FROM s),
v AS (SELECT row, col, ln(value * z / (x.s * y.s ** 0.75)) AS value FROM c JOIN s x ON row = x.w JOIN s y ON col = y.w, z)
SELECT row, col, round(value, 6) + 0.0 AS value FROM v WHERE value > 0""")
def _g12b(t):
    return graph.shifted_ppmi(graph.window_pairs(brand_sentences(t), "tokens", 10), 0.0, graph.SMOOTHING).withColumn("value", r("value"))


@query("skip_gram_brand_vectors", "G12")
def _g12(t):
    return graph.skip_gram(brand_sentences(t), "tokens", dim=128, window=10)


@query("skip_gram_walk_vectors", "G12 G6", f"""
WITH {EDGE_SQL} SELECT node AS word, 128 AS width, true AS finite FROM (SELECT a AS node FROM e UNION SELECT b FROM e) q""")
def _g12c(t):
    walks = materialize(graph.random_walks(graph.neighbour_pairs(edges(t), "a", "b")), "walks")
    v = graph.skip_gram(walks, "walk", dim=128, window=10)
    return v.select("word", F.size("vector").alias("width"), F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))).alias("finite"))


@query("column_zscore", "M1 M9 N5", f"""
WITH u AS ({UNNEST}), s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS sd FROM u GROUP BY 1)
SELECT vec_id, cast(u.dim AS INTEGER) AS dim, round((x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 5) + 0.0 AS value FROM u JOIN s ON u.dim = s.dim""")
def _m1(t):
    z = vectors.zscore(t.embeddings, "embedding")
    return z.select("vec_id", F.posexplode("embedding").alias("dim", "value")).withColumn("value", r("value", 5))


TF_SQL = """tok AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 2)) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS c FROM tok GROUP BY 1, 2), df AS (SELECT term, count(*) AS d FROM tf GROUP BY 1),
n AS (SELECT count(DISTINCT doc_id) AS n FROM tf)"""


def term_counts(t):
    tok = t.texts.select("doc_id", F.explode(ids.text_tokens("text")).alias("term"))
    return features.count_matrix(tok, "doc_id", "term")


@query("tfidf_raw_counts", "M2 A12", f"""
WITH {TF_SQL}, w AS (SELECT doc_id, tf.term, c * (ln((1.0::DOUBLE + n) / (1 + d)) + 1) AS v FROM tf JOIN df ON tf.term = df.term, n)
SELECT doc_id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) + 0.0 AS value FROM w""")
def _m2(t):
    return features.tfidf(term_counts(t), "doc_id", "term").withColumn("value", r("value"))


@query("tfidf_sublinear", "M3", """
WITH tf AS (SELECT o_custkey, l_partkey, count(*)::DOUBLE AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
df AS (SELECT l_partkey, count(*) AS d FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT o_custkey) AS n FROM tf),
w AS (SELECT o_custkey, tf.l_partkey, (1 + ln(c)) * (ln((1.0::DOUBLE + n) / (1 + d)) + 1) AS v FROM tf JOIN df ON tf.l_partkey = df.l_partkey, n)
SELECT o_custkey, l_partkey, round(v / sqrt(sum(v * v) OVER (PARTITION BY o_custkey)), 6) + 0.0 AS value FROM w""")
def _m3(t):
    j = t.lineitem.select("l_orderkey", "l_partkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return features.tfidf(features.count_matrix(j, "o_custkey", "l_partkey"), "o_custkey", "l_partkey", sublinear=True).withColumn("value", r("value"))


def order_weights(t):
    """Customers by suppliers, sublinear TF-IDF."""
    j = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return features.tfidf(features.count_matrix(j, "o_custkey", "l_suppkey"), "o_custkey", "l_suppkey", sublinear=True)


PROVEN = """SELECT cast(i AS INTEGER) AS component, true AS residual_small, true AS orthonormal, true AS scores_are_products, true AS sign_fixed FROM range(1, {}) r(i)"""


def proven(f, coords, row, col, value):
    p = linalg.svd_proof(coords, row, col, value, f)
    return p.select("component", (F.col("residual") < 2e-5).alias("residual_small"), (F.col("off_unit") < 1e-8).alias("orthonormal"),
                    (F.col("off_scores") < 1e-8).alias("scores_are_products"), (F.col("top_loading") > 0).alias("sign_fixed"))


@query("truncated_svd_scores", "M4 M5")
def _m4(t):
    return linalg.truncated_svd(order_weights(t), "o_custkey", "l_suppkey", "value", k=8).scores


@query("truncated_svd_proof", "M4 M5", PROVEN.format(9))
def _m4b(t):
    w = materialize(order_weights(t), "weights")
    return proven(linalg.truncated_svd(w, "o_custkey", "l_suppkey", "value", k=8), w, "o_custkey", "l_suppkey", "value")


# the leading singular vector by power iteration; the gap to the second one is wide for a matrix without negative cells
@query("leading_svd_scores", "M4 M5", """
WITH RECURSIVE tf AS (SELECT o_custkey, l_suppkey, count(*)::DOUBLE AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
df AS (SELECT l_suppkey, count(*) AS d FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT o_custkey) AS n FROM tf),
w AS (SELECT o_custkey, tf.l_suppkey, (1 + ln(c)) * (ln((1.0::DOUBLE + n) / (1 + d)) + 1) AS v FROM tf JOIN df ON tf.l_suppkey = df.l_suppkey, n),
a AS (SELECT o_custkey AS r, l_suppkey AS c, v / sqrt(sum(v * v) OVER (PARTITION BY o_custkey)) AS v FROM w),
g AS (SELECT x.c AS i, y.c AS j, sum(x.v * y.v) AS g FROM a x JOIN a y ON x.r = y.r GROUP BY 1, 2),
p(k, i, v) AS (SELECT 0, l_suppkey, 1.0::DOUBLE FROM df UNION ALL
  SELECT k, i, s / sqrt(sum(s * s) OVER ()) FROM (SELECT p.k + 1 AS k, g.i AS i, sum(g.g * p.v) AS s FROM p JOIN g ON p.i = g.j WHERE p.k < 40 GROUP BY 1, 2) q)
SELECT r AS o_custkey, round(sum(a.v * p.v), 5) + 0.0 AS score FROM a JOIN p ON a.c = p.i WHERE p.k = 40 GROUP BY 1""")
def _m4c(t):
    f = linalg.truncated_svd(order_weights(t), "o_custkey", "l_suppkey", "value", k=8)
    return f.scores.select(F.col("row").alias("o_custkey"), r(F.col("vector")[0], 5).alias("score"))


@query("svd_explained_variance", "M6 W7")
def _m6(t):
    f = linalg.dense_factorisation(t.embeddings, "vec_id", "embedding", 16, centre=False)
    return f.variance_table(t.spark)


# the shares of all components together, against column variances taken from the table
@query("svd_variance_of_all", "M6", f"""
WITH u AS ({UNNEST}), v AS (SELECT dim, var_pop(x) AS v FROM u GROUP BY 1)
SELECT count(*) AS components, round(sum(v), 6) + 0.0 AS variance, round(1.0::DOUBLE, 6) AS share FROM v""")
def _m6b(t):
    f = linalg.dense_factorisation(t.embeddings, "vec_id", "embedding", 64, centre=False)
    per = vectors.explode_vector(f.scores, [], "embedding").groupBy("dim").agg(F.var_pop("value").alias("v"))
    total = F.lit(float(f.explained_variance_ratio.sum()))
    return per.agg(F.count(F.lit(1)).alias("components"), r(F.sum("v")).alias("variance"), r(total).alias("share"))


def embedding_cells(t, scaled=None):
    return vectors.explode_vector(scaled if scaled is not None else t.embeddings, ["vec_id"], "embedding")


@query("dense_svd_proof", "M4 M5 M6", PROVEN.format(17))
def _m6c(t):
    f = linalg.dense_factorisation(t.embeddings, "vec_id", "embedding", 16, centre=False)
    f.scores, f.loadings = f.scores.select(F.col("vec_id").alias("row"), F.col("embedding").alias("vector")), f.loadings.withColumnRenamed("dim", "col")
    return proven(f, embedding_cells(t), "vec_id", "dim", "value")


@query("pca_scores", "M7 M5")
def _m7(t):
    z = vectors.zscore(t.embeddings, "embedding")
    return linalg.dense_factorisation(z, "vec_id", "embedding", 16, centre=True).scores


@query("pca_proof", "M7 M5", PROVEN.format(17))
def _m7c(t):
    z = materialize(vectors.zscore(t.embeddings, "embedding"), "scaled")
    f = linalg.dense_factorisation(z, "vec_id", "embedding", 16, centre=True)
    f.scores, f.loadings = f.scores.select(F.col("vec_id").alias("row"), F.col("embedding").alias("vector")), f.loadings.withColumnRenamed("dim", "col")
    return proven(f, embedding_cells(t, z), "vec_id", "dim", "value")  # standardised columns are centred


@query("pca_total_variance", "M7", f"""
WITH u AS ({UNNEST}), s AS (SELECT dim, stddev_pop(x) AS sd FROM u GROUP BY 1)
SELECT round(sum(CASE WHEN sd = 0 THEN 0.0 ELSE 1.0 END)::DOUBLE, 4) + 0.0 AS score_variance FROM s""")
def _m7b(t):
    # all components together keep the whole variance of standardised columns
    z = vectors.zscore(t.embeddings, "embedding")
    f = linalg.dense_factorisation(z, "vec_id", "embedding", 64, centre=True)
    per = vectors.explode_vector(f.scores, [], "embedding").groupBy("dim").agg(F.var_pop("value").alias("v"))
    return per.agg(r(F.sum("v"), 4).alias("score_variance"))


def fused(t):
    """Two evidence channels of the order network at the published sizes: 128 per channel, 256 together."""
    from ..plans.network import fuse_channels

    e = edges(t).select("a", "b", "o", (F.col("l_discount") * 1000).alias("discount"), (F.col("l_tax") * 1000).alias("tax"))
    c = graph.channel_edges(e, "a", "b", ["discount", "tax"], "o", 50)
    return fuse_channels(c.withColumn("weight", F.col("score") / 1000.0), ["discount", "tax"]).select("node", "vector")


@query("fused_channels", "M10 U6")
def _m10(t):
    return fused(t)


# scores of one decomposition: every position standardised and uncorrelated with every other
@query("fused_channels_proof", "M10 U6", f"""
WITH {EDGE_SQL}, l AS (SELECT a, b FROM e WHERE l_discount * 1000 >= 50 OR l_tax * 1000 >= 50), n AS (SELECT count(*) AS n FROM (SELECT a FROM l UNION SELECT b FROM l) q)
SELECT n AS n_nodes, 256 AS width, true AS all_finite, true AS centred, true AS unit_deviation, true AS uncorrelated FROM n""")
def _m10b(t):
    f = materialize(fused(t), "fused")
    n = f.agg(F.count(F.lit(1)).alias("n_nodes"), F.max(F.size("vector")).alias("width"),
              F.bool_and(F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))).alias("all_finite"))
    return n.crossJoin(linalg.moments_proof(f, "vector"))  # one row each


@query("dense_encoder_layer", "M11", f"""
WITH u AS ({UNNEST}), h AS (SELECT vec_id, greatest(sum(CASE WHEN dim % 2 = 0 THEN x ELSE 0 END), 0) AS h0, greatest(sum(CASE WHEN dim % 2 = 1 THEN x ELSE 0 END) + 20, 0) AS h1,
  greatest(sum(x) + 50, 0) AS h2 FROM u GROUP BY 1), m AS (SELECT *, (h0 + h1 + h2) / 3 AS mu FROM h),
v AS (SELECT *, ((h0 - mu) ** 2 + (h1 - mu) ** 2 + (h2 - mu) ** 2) / 3 AS va FROM m)
SELECT vec_id, round((h0 - mu) / sqrt(va + 0.00001), 4) + 0.0 AS y0, round((h1 - mu) / sqrt(va + 0.00001), 4) + 0.0 AS y1, round((h2 - mu) / sqrt(va + 0.00001) * 2 + 1, 4) + 0.0 AS y2 FROM v""")
def _m11(t):
    import numpy as np

    # outputs far apart, so that single precision decides no digit that is compared
    w = np.zeros((3, 64), dtype=np.float64)
    w[0, 0::2], w[1, 1::2], w[2, :] = 1, 1, 1
    b, g, o = np.array([0, 20, 50], np.float64), np.array([1, 1, 2], np.float64), np.array([0, 0, 1], np.float64)
    y = linalg.dense_layer(t.embeddings, ["vec_id"], "embedding", w, b, g, o, dtype="double")
    return y.select("vec_id", *[r(F.col("embedding")[i], 4).alias(f"y{i}") for i in range(3)])


@query("vector_dtype_upcast", "M12 SC20", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: cast(x AS DOUBLE))), 6) + 0.0 AS total FROM embeddings")
def _m12(t):
    up = t.embeddings.select("vec_id", num.as_double_vector(num.as_float_vector("embedding")).alias("v"))
    return up.select("vec_id", r(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("quality_gate", "Q1 Q2 Q3 Q4 U7", """
SELECT count(*) AS n_rows, 0::BIGINT AS n_nan, 0::BIGINT AS n_inf, 0::BIGINT AS n_zero_vectors, count(*) - count(DISTINCT label) AS n_duplicate_keys,
 count(*) - count(DISTINCT embedding) AS n_duplicate_vectors, 0::BIGINT AS n_constant_columns, 'processed_qc_check_needed' AS status FROM embeddings""")
def _q1(t):
    return quality.gate(t.embeddings, "label", "embedding", quality.GATE_STRICT)


DAMAGED = """SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN (vec_id + i) % 50 = 0 THEN 'nan'::DOUBLE WHEN (vec_id + i) % 77 = 0 THEN 'inf'::DOUBLE
 WHEN vec_id % 9 = 0 THEN 0.0 ELSE x::DOUBLE END) AS v FROM embeddings"""


@query("nan_and_inf_counts", "Q2 Q3", f"""
SELECT count(*) AS n_rows, sum(len(list_filter(v, lambda x: isnan(x))))::BIGINT AS n_nan, sum(len(list_filter(v, lambda x: isinf(x))))::BIGINT AS n_inf,
 count(*) FILTER (WHERE len(list_filter(v, lambda x: x <> 0 OR isnan(x))) = 0) AS n_zero_vectors FROM ({DAMAGED}) d""")
def _q2(t):
    v = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i + 1) % 50 == 0, F.lit(float("nan"))).when(
        (F.col("vec_id") + i + 1) % 77 == 0, F.lit(float("inf"))).when(F.col("vec_id") % 9 == 0, F.lit(0.0)).otherwise(x.cast("double")))
    return quality.row_flags(t.embeddings.select("vec_id", v.alias("v")), "v")


@query("constant_columns", "Q4", f"""
WITH u AS (SELECT dim, CASE WHEN dim % 10 = 0 THEN 1.0 ELSE x END AS x FROM ({UNNEST}) q) SELECT cast(dim AS INTEGER) AS dim, max(x)::DOUBLE AS constant_value FROM u GROUP BY 1 HAVING max(x) = min(x)""")
def _q4(t):
    v = F.transform("embedding", lambda x, i: F.when(i % 10 == 0, F.lit(1.0)).otherwise(x.cast("double")))
    return quality.constant_columns(t.embeddings.select(v.alias("v")), "v").select("dim", F.col("hi").alias("constant_value"))


@query("row_mapping_report", "Q5 W5", """
WITH f AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS embedding_row FROM (SELECT DISTINCT o_custkey FROM orders) q)
SELECT c_custkey, CASE WHEN embedding_row IS NULL THEN 'unmapped' ELSE 'mapped' END AS status, embedding_row FROM customer LEFT JOIN f ON c_custkey = o_custkey""")
def _q5(t):
    rows = ranges.with_row_index(t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct(), ["c_custkey"], "embedding_row")
    rep = t.customer.select("c_custkey").join(rows, "c_custkey", "left")
    return rep.select("c_custkey", F.when(F.col("embedding_row").isNull(), F.lit("unmapped")).otherwise(F.lit("mapped")).alias("status"), "embedding_row")


@query("duplicate_mapping_report", "Q6", """
SELECT l_partkey, count(*) AS source_key_count, min(l_orderkey) AS first_source, 'averaged_duplicate_source_rows_mapping_to_same_master_gene' AS action FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def _q6(t):
    c = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("source_key_count"), F.min("l_orderkey").alias("first_source"))
    return c.where("source_key_count > 1").withColumn("action", F.lit("averaged_duplicate_source_rows_mapping_to_same_master_gene"))


@query("permutation_check", "Q7", """
SELECT count(*) AS n_rows, min(p_partkey) AS lo, max(p_partkey) AS hi, count(DISTINCT p_partkey) AS n_distinct, min(p_partkey) = 0 AND max(p_partkey) = count(*) - 1 AND count(DISTINCT p_partkey) = count(*) AS is_permutation FROM part""")
def _q7(t):
    return quality.permutation_check(t.part, "p_partkey")


@query("review_flags", "Q8", """
WITH b AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'conflict' WHEN 1 THEN 'missing_ambiguous_external' ELSE 'agreement' END AS es, CASE WHEN c_custkey % 5 = 0 THEN 'conflict' ELSE 'agreement' END AS us,
 CASE WHEN c_custkey % 3 = 1 THEN '' ELSE 'x' END AS e, CASE WHEN c_custkey % 4 = 0 THEN 'null' ELSE 'y' END AS u FROM customer)
SELECT c_custkey, coalesce(nullif(concat_ws(';', CASE WHEN es = 'conflict' OR us = 'conflict' THEN 'conflict' END, CASE WHEN es = 'missing_ambiguous_external' THEN 'ambiguous_entrez' END,
 CASE WHEN e = '' THEN 'missing_entrez' END, CASE WHEN u = 'null' THEN 'missing_uniprot' END), ''), 'ok') AS review FROM b""")
def _q8(t):
    from ..operators.mapping import review_flag

    k = F.col("c_custkey")
    es = F.when(k % 3 == 0, F.lit("conflict")).when(k % 3 == 1, F.lit("missing_ambiguous_external")).otherwise(F.lit("agreement"))
    us = F.when(k % 5 == 0, F.lit("conflict")).otherwise(F.lit("agreement"))
    e, u = F.when(k % 3 == 1, F.lit("")).otherwise(F.lit("x")), F.when(k % 4 == 0, F.lit("null")).otherwise(F.lit("y"))
    return t.customer.select("c_custkey", review_flag(es, us, e, u).alias("review"))


@query("family_batch_summary", "Q9", """
SELECT source, count(*) AS n_rows, count(DISTINCT lang) AS n_langs, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents GROUP BY 1""")
def _q9(t):
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("lang").alias("n_langs"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))
