"""Readers and writers: whole tables are written in a source format and scanned back."""

from __future__ import annotations

import io
import pickle
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids, num
from ..operators import quality, vectors
from ..plans import genome
from ..plans.network import alias_entrez
from ..session import scratch_path
from ..sources import archives, bio, readers, shards, sinks, splits
from ..streaming.incremental import drain_files, resume, resume_rows
from .registry import big, query, r
from .sequences import DUCK_DNA, dna


def _lines(t, df, label):
    path = scratch_path(t.spark, label)
    sinks.write_lines(df, path)
    return path


def _table(t, df, label, sep=","):
    path = scratch_path(t.spark, label)
    sinks.write_table(df, path, sep=sep)
    return path


DIRTY_CUSTOMER = "CASE c_custkey % 4 WHEN 0 THEN 'NA' WHEN 1 THEN 'n/a' WHEN 2 THEN 'say \"hi\", ok' ELSE c_mktsegment END"


@query("scan_text_table", "SC1 SC2 SK1", f"""
SELECT cast(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 4 < 2 THEN '' ELSE {DIRTY_CUSTOMER} END AS cell FROM customer""")
def _sc1(t):
    path = _table(t, t.customer.select("c_custkey", "c_name", F.expr(DIRTY_CUSTOMER).alias("cell")), "csv")
    return readers.read_keyed_table(t.spark, path, "c_custkey").drop("file_row")


@query("scan_tab_separated", "SC3 SC8 SC9", "SELECT cast(p_partkey AS VARCHAR) AS p_partkey, p_brand FROM part")
def _sc3(t):
    path = _table(t, t.part.select("p_partkey", "p_name", "p_brand", "p_type"), "tsv", "\t")
    return readers.read_chunks(t.spark, path, "p_partkey").select("p_partkey", "p_brand")


@query("scan_headerless_edges", "SC4", "SELECT cast(o_custkey AS VARCHAR) AS gene1, cast(o_orderkey AS VARCHAR) AS gene2 FROM orders")
def _sc4(t):
    path = _lines(t, t.orders.select(F.concat_ws("\t", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("value")), "edges")
    return readers.read_headerless(t.spark, path, ["gene1", "gene2"]).drop("file_row")


VEC_SQL = "round(list_sum(list_transform(embedding, lambda x, i: cast(x AS DOUBLE) * i)), 4) + 0.0"


def _weighted(c="vector"):
    """Checksum of a vector in source precision, which is single."""
    return r(F.aggregate(F.transform(c, lambda x, i: x.cast("float").cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4)


def _vector_text(sep):
    return F.array_join(F.transform("embedding", lambda x: x.cast("string")), sep)


@query("scan_sniffed_vector_table", "SC5", f"SELECT concat('inhib_', vec_id) AS source_token, {VEC_SQL} AS checksum FROM embeddings")
def _sc5(t):
    head = t.spark.range(1).select(F.lit(-1).cast("bigint").alias("k"), F.concat(F.lit("gene"), F.repeat(F.lit(",v"), 64)).alias("value"))
    body = t.embeddings.select(F.col("vec_id").alias("k"), F.concat(F.lit("inhib_"), "vec_id", F.lit(","), _vector_text(",")).alias("value"))
    path = _lines(t, head.unionByName(body).orderBy("k"), "sniffed")
    return readers.read_sniffed_vectors(t.spark, path).select("source_token", _weighted().alias("checksum"))


@query("scan_repaired_matrix", "SC6", f"SELECT cast(vec_id + 10 AS VARCHAR) AS source_id, {VEC_SQL} AS checksum FROM embeddings")
def _sc6(t):
    id_path = _lines(t, t.embeddings.orderBy("vec_id").select((F.col("vec_id") + 10).cast("string").alias("value")), "ids")
    body = t.embeddings.orderBy("vec_id").select(F.concat("vec_id", F.lit(","), _vector_text(","), F.lit(",")).alias("value"))
    path = _lines(t, body, "matrix")
    rows = readers.read_repaired_matrix(t.spark, path, readers.read_id_list(t.spark, id_path), 64)
    return rows.select("source_id", _weighted().alias("checksum"))


@query("scan_entry_vector_table", "SC7", f"SELECT concat('P', vec_id) AS entry, {VEC_SQL} AS checksum FROM embeddings")
def _sc7(t):
    wide = t.embeddings.select(F.concat(F.lit("P"), "vec_id").alias("Entry"), *[F.col("embedding")[i].alias(f"f{i}") for i in range(64)])
    rows = readers.read_entry_vectors(t.spark, _table(t, wide, "entry"))
    return rows.select(F.col("Entry").alias("entry"), _weighted().alias("checksum"))


@query("scan_annotation_features", "SC10 A7 A8", """
SELECT concat('G', l_orderkey) AS gene, count(*) AS n_features, count(*) FILTER (WHERE l_linenumber <= 3) AS n_exons,
 cast(sum(cast(l_quantity AS BIGINT) + 1) FILTER (WHERE l_linenumber <= 3) AS BIGINT) AS exon_length, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS tags
FROM lineitem GROUP BY 1""")
def _sc10(t):
    attrs = F.format_string('gene_id "G%d.3"; transcript_id "T%d"; tag "%s"; tag "%s"; level 2;', "l_orderkey", "l_partkey", "l_returnflag", "l_returnflag")
    feature = F.when(F.col("l_linenumber") <= 3, F.lit("exon")).otherwise(F.lit("CDS"))
    line = F.concat_ws("\t", F.lit("chr1"), F.lit("X"), feature, F.col("l_partkey").cast("string"), (F.col("l_partkey") + big("l_quantity")).cast("string"),
                       F.lit("."), F.lit("+"), F.lit("."), attrs)
    note = t.spark.range(1).select(F.lit("#!genome-build x").alias("value"))
    g = bio.read_gtf(t.spark, _lines(t, t.lineitem.select(line.alias("value")).unionByName(note), "gtf"))
    is_exon = F.col("feature") == "exon"
    return g.groupBy(ids.strip_version(F.col("attributes")["gene_id"]).alias("gene")).agg(
        F.count(F.lit(1)).alias("n_features"), F.count_if(is_exon).alias("n_exons"), F.sum(F.when(is_exon, F.col("stop") - F.col("start") + 1)).alias("exon_length"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))), ";").alias("tags"))


@query("scan_association_file", "SC11 SC12 A13", """
SELECT concat('P', o_custkey) AS accession, count(DISTINCT concat('GO:', o_orderkey % 50)) AS n_terms FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' GROUP BY 1""")
def _sc11(t):
    from ..plans.annotations import process_profiles

    cells = [F.lit("UniProtKB"), F.concat(F.lit("P"), "o_custkey"), F.lit("SYM"), F.when(F.col("o_orderpriority") == "5-LOW", F.lit("NOT|x")).otherwise(F.lit("x")),
             F.concat(F.lit("GO:"), F.col("o_orderkey") % 50), F.lit("ref"), F.lit("IEA"), F.lit(""), F.when(F.col("o_orderstatus") == "O", F.lit("P")).otherwise(F.lit("F"))]
    body = t.orders.select(F.concat_ws("\t", *[c.cast("string") for c in cells], *[F.lit("") for _ in range(8)]).alias("value"))
    head = t.spark.range(1).select(F.lit("!gaf-version: 2.2").alias("value"))
    g = bio.read_gaf(t.spark, _lines(t, head.unionByName(body), "gaf"))
    return process_profiles(g).groupBy("accession").agg(F.count(F.lit(1)).alias("n_terms"))


@query("scan_ontology_stanzas", "SC13", """
SELECT concat('GO:', c_custkey) AS term_id, c_name AS name, concat('GO:', c_nationkey) AS parents, concat(c_mktsegment, '~alt') AS synonyms FROM customer WHERE c_custkey % 10 <> 3""")
def _sc13(t):
    stanza = F.concat(F.lit("\n[Term]\nid: GO:"), "c_custkey", F.lit("\nname: "), "c_name", F.lit("\nnamespace: ns\ndef: \"d\" []\nsynonym: \""), "c_mktsegment",
                      F.lit("\" EXACT []\nsynonym: \"alt\" RELATED []\nis_a: GO:"), "c_nationkey", F.lit(" ! parent"),
                      F.when(F.col("c_custkey") % 10 == 3, F.lit("\nis_obsolete: true")).otherwise(F.lit("")))
    terms = bio.read_obo(t.spark, _lines(t, t.customer.select(stanza.alias("value")), "obo"))
    return terms.select("term_id", "name", F.array_join("parents", "~").alias("parents"), F.array_join("synonyms", "~").alias("synonyms"))


@query("scan_sequence_records", "SC14 SK6 Q10", f"""
SELECT concat('ENST', doc_id) AS record_id, length(s) AS n, md5(s) AS digest FROM (SELECT doc_id, {DUCK_DNA} AS s FROM documents) q WHERE length(s) > 0""")
def _sc14(t):
    path = scratch_path(t.spark, "fasta")
    d = t.texts.select(F.concat(F.lit("ENST"), "doc_id").alias("id"), "lang", dna().alias("s")).where("length(s) > 0")
    sinks.write_fasta(d, path, ["id", "lang"], "s")
    f = bio.read_fasta(t.spark, path)
    return f.select(F.substring_index("header", "|", 1).alias("record_id"), big(F.length("sequence")).alias("n"), F.md5("sequence").alias("digest"))


@query("scan_protein_index", "SC15", f"""
WITH d AS (SELECT doc_id, {DUCK_DNA} AS s FROM documents), k AS (SELECT doc_id, concat('P', doc_id // 2, '-', doc_id % 2) AS a, concat('P', doc_id // 2) AS b, s FROM d WHERE length(s) > 0)
SELECT a AS accession, md5(s) AS digest FROM k UNION ALL SELECT b, arg_min(md5(s), doc_id) FROM k GROUP BY 1""")
def _sc15(t):
    path = scratch_path(t.spark, "protein")
    half = F.floor(F.col("doc_id") / 2)
    d = t.documents.orderBy("doc_id").select(F.lit("sp").alias("db"), F.concat(F.lit("P"), half, F.lit("-"), F.col("doc_id") % 2).alias("acc"),
                                             F.lit("NAME x").alias("name"), dna().alias("s")).where("length(s) > 0")
    sinks.write_fasta(d, path, ["db", "acc", "name"], "s")
    return bio.read_protein_index(t.spark, path).select("accession", F.md5("sequence").alias("digest"))


@query("scan_expression_table", "SC17 A2", """
SELECT concat('G', p_partkey % 700) AS gene, round(avg(p_size), 6) + 0.0 AS tissue_a, round(avg(coalesce(CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice END, 0)), 4) + 0.0 AS tissue_b FROM part GROUP BY 1""")
def _sc17(t):
    head = t.spark.createDataFrame([(-3, "#1.2"), (-2, "rows\tcolumns"), (-1, "Name\tDescription\ttissue_a\ttissue_b")], "k bigint, value string")
    price = F.when(F.col("p_partkey") % 9 == 0, F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string"))
    body = t.part.select(F.col("p_partkey").alias("k"), F.concat_ws("\t", F.concat(F.lit("G"), F.col("p_partkey") % 700, F.lit("."), "p_size"), "p_name",
                                                                   F.col("p_size").cast("string"), price).alias("value"))
    g = readers.read_gct(t.spark, _lines(t, head.unionByName(body).orderBy("k"), "gct"))
    zero = F.lit(0.0)
    return g.groupBy(ids.strip_version_suffix("Name").alias("gene")).agg(
        r(F.avg(F.coalesce(num.to_number("tissue_a"), zero))).alias("tissue_a"), r(F.avg(F.coalesce(num.to_number("tissue_b"), zero)), 4).alias("tissue_b"))


@query("scan_json_vector_dictionary", "SC21", f"SELECT concat('Gene_', vec_id) AS key, {VEC_SQL} AS checksum FROM embeddings")
def _sc21(t):
    entry = F.concat(F.lit('"Gene_'), "vec_id", F.lit('": ['), _vector_text(", "), F.lit("],"))
    return readers.read_json_vectors(t.spark, _lines(t, t.embeddings.select(entry.alias("value")), "json")).select("key", _weighted().alias("checksum"))


@query("scan_json_text_dictionary", "SC22", """
SELECT upper(trim(c_name)) AS key, count(*) AS n, min(c_mktsegment) AS text FROM customer WHERE c_custkey % 5 > 0 GROUP BY 1""")
def _sc22(t):
    doc = F.to_json(F.create_map(F.lower(F.concat(F.lit(" "), "c_name")), F.when(F.col("c_custkey") % 5 == 0, F.lit(" ")).otherwise(F.col("c_mktsegment"))))
    rows = readers.read_json_texts(t.spark, _lines(t, t.customer.select(doc.alias("value")), "texts"), per_line=True)
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text"))


def _json_objects(t, entries, label, size=400):
    """A file for each ``size`` entries ``[k, entry]``, each one JSON object without line ends of its own."""
    rows = entries.withColumn("bucket", F.floor(F.col("k") / size))
    span = Window.partitionBy("bucket").orderBy("k")
    text = F.concat(F.when(F.lag("k").over(span).isNull(), F.lit("{")).otherwise(F.lit("")), "entry", F.when(F.lead("k").over(span).isNull(), F.lit("}")).otherwise(F.lit(",")))
    path = scratch_path(t.spark, label)
    rows.select("bucket", "k", text.alias("value")).sortWithinPartitions("bucket", "k").select("bucket", "value").write.partitionBy("bucket").text(path)
    return path


@query("scan_json_object_in_splits", "SC22", """
SELECT upper(concat('Gene,', doc_id)) AS key, length(trim(text)) AS n, md5(trim(text)) AS digest FROM documents WHERE trim(text) <> ''""")
def _sc22b(t):
    doc = F.to_json(F.create_map(F.concat(F.lit("Gene,"), "doc_id"), "text"))
    path = _json_objects(t, t.documents.select(F.col("doc_id").alias("k"), F.substring(doc, F.lit(2), F.length(doc) - 2).alias("entry")), "object")
    rows = readers.read_json_texts(t.spark, path)
    return rows.select("key", big(F.length("text")).alias("n"), F.md5("text").alias("digest"))


@query("scan_vocabulary_in_splits", "SC23", """
SELECT concat(p_name, ' ', p_partkey) AS token, CASE WHEN p_partkey % 7 > 0 THEN p_partkey END AS token_id FROM part""")
def _sc23b(t):
    pid = F.when(F.col("p_partkey") % 7 > 0, F.col("p_partkey").cast("string")).otherwise(F.lit("[1, 2]"))
    entry = F.concat(F.lit('"'), "p_name", F.lit(" "), "p_partkey", F.lit('": '), pid)
    path = _json_objects(t, t.part.select(F.col("p_partkey").alias("k"), entry.alias("entry")), "vocabulary")
    return readers.read_vocabulary(t.spark, path)


@query("scan_sequence_tiles", "SC14 SC16", f"""
WITH d AS (SELECT doc_id, {DUCK_DNA} AS s FROM documents), t AS (SELECT doc_id, s, unnest(range(0, (length(s) + 999) // 1000)) AS tile_no FROM d)
SELECT concat('ENST', doc_id) AS record_id, length(s) AS record_length, tile_no, md5(substr(s, tile_no * 1000 + 1, 1000)) AS digest FROM t""")
def _sc14b(t):
    path = scratch_path(t.spark, "fasta")
    sinks.write_fasta(t.texts.select(F.concat(F.lit("ENST"), "doc_id").alias("id"), dna().alias("s")), path, ["id"], "s")
    heads, tiles = splits.read_fasta_tiles(t.spark, path, 1000)
    out = tiles.join(heads, ["file", "record"])
    return out.select("record_id", big("length").alias("record_length"), "tile_no", F.md5("bases").alias("digest"))


@query("windows_from_tiled_sequences", "SC16 Q25", f"""
WITH d AS (SELECT doc_id, {DUCK_DNA} AS s, (doc_id * 37) % 900 - 100 AS center FROM documents),
w AS (SELECT doc_id, s, center - 128 AS a, center + 128 AS b, length(s) AS n FROM d)
SELECT doc_id, md5(concat(repeat('N', greatest(-a, 0)), substr(s, greatest(a, 0) + 1, least(b, n) - greatest(a, 0)), repeat('N', greatest(b - n, 0)))) AS digest
FROM w WHERE least(b, n) > greatest(a, 0)""")
def _sc16b(t):
    path = scratch_path(t.spark, "fasta")
    sinks.write_fasta(t.texts.select(F.concat(F.lit("chr"), "doc_id").alias("id"), dna().alias("s")), path, ["id"], "s")
    tiles = genome.tiles_from_fasta(t.spark, path, 100)
    k = (F.col("doc_id") * 37) % 900 - 100
    sites = t.documents.select("doc_id", F.concat(F.lit("chr"), "doc_id").alias("chromosome"), (k - 128).alias("a"), (k + 128).alias("b"))
    sites = sites.join(tiles.select("chromosome", "chrom_length").distinct(), "chromosome")
    return genome.genome_windows(sites, "doc_id", tiles, "a", "b", 100).select("doc_id", F.md5("sequence").alias("digest"))


@query("npy_shards_round_trip", "SC26 SK2 SK3", "SELECT vec_id AS row, unnest(embedding)::DOUBLE AS value, cast(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM embeddings")
def _sc26(t):
    path = scratch_path(t.spark, "npy")
    shards.write_npy_rows(t.embeddings, path, "vec_id", "embedding")
    back = shards.read_npy_rows(t.spark, path, width=64)
    return back.select("row", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


@query("scan_vocabulary", "SC23 F9", "SELECT 'k' AS token, cast(json_extract(props, '$.k') AS BIGINT) AS token_id, count(*) AS n FROM events GROUP BY 1, 2")
def _sc23(t):
    v = readers.read_vocabulary(t.spark, _lines(t, t.events.select(F.col("props").alias("value")), "vocab"), per_line=True)
    return v.groupBy("token", "token_id").agg(F.count(F.lit(1)).alias("n"))


@query("scan_word_vectors", "SC28", f"""
SELECT concat('SYM', vec_id) AS source_id, CASE vec_id % 10 WHEN 3 THEN 'cannot_parse_floats' WHEN 4 THEN 'wrong_dim_65_expected_64' ELSE 'ok' END AS status,
 CASE WHEN vec_id % 10 NOT IN (3, 4) THEN {VEC_SQL} END AS checksum FROM embeddings""")
def _sc28(t):
    k = F.col("vec_id") % 10
    line = F.concat(F.lit("SYM"), "vec_id", F.lit(" "), _vector_text(" "), F.when(k == 3, F.lit("x")).when(k == 4, F.lit(" 0.5")).otherwise(F.lit("")))
    head = t.embeddings.agg(F.concat(F.count(F.lit(1)), F.lit(" 64")).alias("value")).select(F.lit(-1).cast("bigint").alias("k"), "value")
    path = _lines(t, head.unionByName(t.embeddings.select(F.col("vec_id").alias("k"), line.alias("value"))).orderBy("k"), "word")
    return readers.read_word_vectors(t.spark, path).select("source_id", "status", F.when(F.col("status") == "ok", _weighted()).alias("checksum"))


@query("scan_dense_rows_with_ids", "SC29", f"SELECT concat('ENSP', vec_id) AS source_id, {VEC_SQL} AS checksum FROM embeddings")
def _sc29(t):
    e = t.embeddings.orderBy("vec_id")
    names = _lines(t, e.select(F.concat(F.lit("ENSP"), "vec_id").alias("value")), "names")
    rows = _lines(t, e.select(_vector_text("  ").alias("value")), "rows")
    return readers.read_dense_rows(t.spark, rows, names).select("source_id", _weighted().alias("checksum"))


@query("scan_scored_links", "SC30", """
SELECT o_custkey::VARCHAR AS protein1, count(*) AS n, cast(sum(cast(l_discount * 100 AS INTEGER)) AS BIGINT) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def _sc30(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("protein1"), F.col("l_suppkey").alias("protein2"), F.round(F.col("l_discount") * 100).cast("int").alias("database"))
    return readers.read_links(t.spark, _table(t, j, "links", " "), ["database"]).groupBy("protein1").agg(F.count(F.lit(1)).alias("n"), F.sum("database").alias("score"))


@query("alias_entrez_sets", "SC31", """
SELECT DISTINCT concat('n', c_nationkey) AS node, cast(c_custkey AS VARCHAR) AS entrez FROM customer WHERE c_mktsegment IN ('HOUSEHOLD', 'MACHINERY')""")
def _sc31(t):
    seg = F.col("c_mktsegment")
    source = F.when(seg == "HOUSEHOLD", F.lit("Ensembl_HGNC_Entrez_ID")).when(seg == "MACHINERY", F.lit("KEGG_GeneID")).otherwise(F.lit("UniProt_AC"))
    a = t.customer.select(F.concat(F.lit("n"), "c_nationkey").alias("node"), F.concat("c_custkey", F.lit(".0")).alias("alias"), source.alias("source"))
    return alias_entrez(a)


@query("candidate_column_scores", "SC33", r"""
SELECT candidate, score FROM (SELECT count(*) FILTER (WHERE url ~ '^https') AS secure, count(*) FILTER (WHERE html LIKE '%<table%') AS tables, count(*) FILTER (WHERE length(html) >= 20) AS long_enough FROM pages) q
UNPIVOT (score FOR candidate IN (secure, tables, long_enough))""")
def _sc33(t):
    return readers.score_columns(t.pages, {"secure": F.col("url").rlike("^https"), "tables": F.col("html").contains("<table"), "long_enough": F.length("html") >= 20})


@query("dictionary_direction", "SC34", """
SELECT count(*) FILTER (WHERE p_partkey % 3 = 0) AS ens_to_int, count(*) FILTER (WHERE p_partkey % 3 = 1) AS int_to_ens,
 CASE WHEN count(*) FILTER (WHERE p_partkey % 3 = 0) >= count(*) FILTER (WHERE p_partkey % 3 = 1) THEN 'ens_to_int' ELSE 'int_to_ens' END AS direction FROM part""")
def _sc34(t):
    k = F.col("p_partkey")
    ens, num_ = F.concat(F.lit("ENSG"), k, F.lit(".1")), F.col("p_size").cast("string")
    return readers.dictionary_direction(t.part.select(F.when(k % 3 == 0, ens).when(k % 3 == 1, num_).otherwise(F.col("p_name")).alias("a"),
                                                      F.when(k % 3 == 0, num_).when(k % 3 == 1, ens).otherwise(F.col("p_brand")).alias("b")), "a", "b")


@query("vector_package_round_trip", "SK2 SK3 SK10 W5", f"""
SELECT label, row_number() OVER (ORDER BY label) - 1 AS embedding_row, n, checksum FROM (SELECT label, count(*) AS n, round(sum(x * (dim + 1)) / count(DISTINCT vec_id), 4) + 0.0 AS checksum FROM
 (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) u GROUP BY 1) q""".replace("count(*) AS n,", "count(DISTINCT vec_id) AS n,"))
def _sk2(t):
    v = vectors.vector_mean(t.embeddings, ["label"], "embedding")
    genes = t.embeddings.select("label").distinct()
    path = scratch_path(t.spark, "package")
    p = sinks.vector_package(v, genes, "label", ["label"])
    sinks.write_package(p, path, {"name": "round trip"}, {"counts": v.select("label", "n_source_rows")})
    back = t.spark.read.parquet(f"{path}/matrix")
    return back.select("label", "embedding_row", F.col("n_source_rows").alias("n"), r(F.aggregate(
        F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4).alias("checksum"))


@query("metadata_document", "SK4 SK5", """
SELECT count(*) AS n_rows, count(DISTINCT p_brand) AS n_brands, 'PROBE' AS source FROM part""")
def _sk4(t):
    counts = t.part.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("p_brand").alias("n_brands"))
    path = _lines(t, sinks.metadata_row(counts, source="PROBE"), "meta")
    return t.spark.read.schema("n_rows bigint, n_brands bigint, source string").json(path)


@query("content_digests", "SK11", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def _sk11(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("file_digest_manifest", "SK11")
def _sk11b(t):
    return sinks.file_digests(t.spark, f"{t.sf_dir}/*.parquet").select(F.substring_index("path", "/", -1).alias("file"), "length", "sha256", "md5")


@query("chunked_append_and_resume", "SK9 I1 I2 I3 I4 F12", """
SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM orders GROUP BY 1""")
def _i1(t):
    sink = scratch_path(t.spark, "resume")
    o = t.orders.select("o_orderkey", "o_orderstatus")
    resume(o.where("o_orderstatus = 'F'"), "o_orderkey", sink, lambda d: d)
    return resume(o, "o_orderkey", sink, lambda d: d).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))


@query("done_masks_resume", "I2 I4", "SELECT vec_id % 2 AS half, count(*) AS n, count(DISTINCT vec_id) AS n_rows FROM embeddings GROUP BY 1")
def _i2(t):
    sink = scratch_path(t.spark, "masks")
    e = t.embeddings.select("vec_id", "embedding")
    shape = {"width": 64}
    resume_rows(e.where("vec_id % 2 = 0"), "vec_id", shape, sink, lambda d: d)  # a first run that got half of the rows
    both = resume_rows(e, "vec_id", shape, sink, lambda d: d)
    return both.groupBy((F.col("vec_id") % 2).alias("half")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vec_id").alias("n_rows"))


@query("required_columns", "U4", """
SELECT want AS column_name, want IN (SELECT column_name FROM information_schema.columns WHERE table_name = 'documents') AS present, (SELECT count(*) FROM documents) AS n_rows
FROM (SELECT unnest(['doc_id', 'text', 'ensembl_gene_id', 'lang', 'entrez_id']) AS want) q""")
def _u4(t):
    return quality.column_report(t.documents, ["doc_id", "text", "ensembl_gene_id", "lang", "entrez_id"])


@query("text_mapping_report", "SK5", """
SELECT line FROM (SELECT unnest(['Mapping report', '==============', '', concat('n_rows: ', count(*)), concat('n_brands: ', count(DISTINCT p_brand)), concat('largest: ', max(p_size))]) AS line FROM part) q""")
def _sk5(t):
    counts = t.part.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("p_brand").alias("n_brands"), F.max("p_size").alias("largest"))
    report = sinks.text_report("Mapping report", counts)  # a one-row summary
    path = _lines(t, t.spark.createDataFrame([(report.rstrip("\n"),)], "value string"), "report")
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query("scan_association_file_leniently", "SC12 F2", """
SELECT count(*) AS total_rows, count(*) FILTER (WHERE o_orderkey % 7 > 0 AND o_orderpriority = '5-LOW') AS skipped_not,
 count(*) FILTER (WHERE o_orderkey % 7 > 0 AND o_orderpriority <> '5-LOW' AND o_orderkey % 50 < 40) AS kept,
 count(*) FILTER (WHERE o_orderkey % 7 = 0 OR (o_orderpriority <> '5-LOW' AND o_orderkey % 50 >= 40)) AS skipped_bad FROM orders""")
def _sc12(t):
    from ..plans.annotations import lenient_annotations

    cells = [F.lit("UniProtKB"), F.concat(F.lit("P"), F.lpad(F.col("o_custkey").cast("string"), 5, "0")), F.lit("SYM"), F.when(F.col("o_orderpriority") == "5-LOW", F.lit("NOT|x")).otherwise(F.lit("x")),
             F.concat(F.lit("GO:"), F.col("o_orderkey") % 50), F.lit("ref"), F.lit("IEA"), F.lit(""), F.lit("P")]
    full = F.concat_ws("\t", *[c.cast("string") for c in cells], *[F.lit("") for _ in range(8)])
    body = t.orders.select(F.when(F.col("o_orderkey") % 7 == 0, F.concat_ws("\t", *[c.cast("string") for c in cells[:5]])).otherwise(full).alias("value"))  # short lines and no version
    terms = t.orders.where("o_orderkey % 50 < 40").select(F.concat(F.lit("GO:"), F.col("o_orderkey") % 50).alias("term_id")).distinct()
    return lenient_annotations(bio.read_gaf(t.spark, _lines(t, body, "gaf"), strict=False), terms)[1]


@query("drained_file_stream", "I1", "SELECT event_type, count(*) AS n, round(sum(value), 2) + 0.0 AS total FROM events GROUP BY 1")
def _i1s(t):
    sink, checkpoint = scratch_path(t.spark, "stream"), scratch_path(t.spark, "checkpoint")
    schema = t.events.schema
    out = drain_files(t.spark, t.sf_dir, "events.parquet", schema, lambda s: s.select("event_id", "event_type", "value"), sink, checkpoint)
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("total"))


def _packed(df, pack):
    """One archive ``[path, content]`` per Arrow batch of the table."""

    def run(batches):
        for i, pdf in enumerate(batches):
            if len(pdf):
                yield pd.DataFrame({"path": [f"part-{i}"], "content": [pack(pdf)]})

    return df.mapInPandas(run, "path string, content binary")


@query("scan_zipped_table", "SC18", "SELECT cast(c_custkey AS VARCHAR) AS \"Gene\", c_mktsegment AS \"Level\" FROM customer")
def _sc18(t):
    def pack(pdf):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("levels.tsv", "Gene\tLevel\n" + "".join(f"{k}\t{s}\n" for k, s in zip(pdf["c_custkey"], pdf["c_mktsegment"])))
        return out.getvalue()

    return archives.zip_table(_packed(t.customer.select("c_custkey", "c_mktsegment"), pack)).select("Gene", "Level")


@query("scan_tar_members", "SC19 SK11", "SELECT cast(s_suppkey AS VARCHAR) AS name, s_name AS label FROM supplier")
def _sc19(t):
    def pack(pdf):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            data = "".join(f"{k}\t{n}\n" for k, n in zip(pdf["s_suppkey"], pdf["s_name"])).encode()
            info = tarfile.TarInfo("entities.tsv")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        return out.getvalue()

    members = archives.tar_members(_packed(t.supplier.select("s_suppkey", "s_name"), pack), {"entities.tsv": ""})
    lines = members.select(F.explode(F.split(F.decode("content", "utf-8"), "\n")).alias("v")).where("v <> ''")
    return lines.select(F.split_part("v", F.lit("\t"), F.lit(1)).alias("name"), F.split_part("v", F.lit("\t"), F.lit(2)).alias("label"))


@query("scan_pickled_vectors", "SC24", f"SELECT concat('S', vec_id) AS key, {VEC_SQL} AS checksum FROM embeddings")
def _sc24(t):
    def pack(pdf):
        return pickle.dumps({f"S{k}": [float(x) for x in v] for k, v in zip(pdf["vec_id"], pdf["embedding"])})

    rows = archives.pickle_entries(_packed(t.embeddings.select("vec_id", "embedding"), pack))
    return rows.select("key", _weighted().alias("checksum"))
