"""Readers for annotation, ontology and sequence formats on plain text scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from .readers import read_lines

ATTRIBUTE = r'(\S+ "[^"]*")'


def attribute_pairs(text) -> Column:
    found = F.regexp_extract_all(text, F.lit(ATTRIBUTE), F.lit(1))
    return F.transform(found, lambda p: F.struct(F.regexp_extract(p, r'^(\S+) "', 1).alias("key"), F.regexp_extract(p, r'"([^"]*)"', 1).alias("value")))


def read_gtf(spark: SparkSession, path) -> DataFrame:
    """``[chromosome, source, feature, start, stop, strand, attributes, tags, n_fields, file_row]``.

    ``attributes`` keeps the last value of a repeated key; all ``tag`` values
    are in ``tags``. Callers choose their own rule on ``n_fields``.
    """
    lines = read_lines(spark, path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    parsed = lines.select(F.split("value", "\t").alias("f"), "file_row").withColumn("n_fields", F.size("f"))
    parsed = parsed.where("n_fields >= 9").withColumn("pairs", attribute_pairs(F.get("f", F.lit(8))))
    plain = F.filter("pairs", lambda p: p["key"] != "tag")
    names = F.array_distinct(F.transform(plain, lambda p: p["key"]))
    last = F.map_from_entries(F.transform(names, lambda k: F.struct(
        k.alias("key"), F.element_at(F.filter(plain, lambda p: p["key"] == k), -1)["value"].alias("value"))))
    cells = [F.get("f", F.lit(i)) for i in range(9)]
    return parsed.select(
        cells[0].alias("chromosome"), cells[1].alias("source"), cells[2].alias("feature"), cells[3].try_cast("bigint").alias("start"),
        cells[4].try_cast("bigint").alias("stop"), cells[6].alias("strand"), last.alias("attributes"),
        F.transform(F.filter("pairs", lambda p: p["key"] == "tag"), lambda p: p["value"]).alias("tags"), "n_fields", "file_row")


def exons(gtf: DataFrame) -> DataFrame:
    return gtf.where((F.col("feature") == "exon") & (F.col("n_fields") == 9)).select(
        F.coalesce(F.col("attributes")["transcript_id"], F.lit("")).alias("transcript_id"), "chromosome", "start", "stop", "strand",
        F.coalesce(F.col("attributes")["exon_number"].try_cast("int"), F.lit(0)).alias("exon_number"))


# Annotation file versions that are understood.
ANNOTATION_VERSIONS = ("2.1", "2.2")


def annotation_headers(spark: SparkSession, path) -> DataFrame:
    """``[key, value]`` of the ``!key: value`` lines, keys in lower case; the last one wins."""
    lines = read_lines(spark, path).where(F.col("value").startswith("!") & F.col("value").contains(":"))
    body = F.substring("value", 2, 1 << 20)
    return lines.groupBy(F.lower(ids.strip(F.substring_index(body, ":", 1))).alias("key")).agg(
        F.max_by(ids.strip(F.regexp_replace(body, r"^[^:]*:", "")), "file_row").alias("value"))


def read_gaf(spark: SparkSession, path, strict: bool = True) -> DataFrame:
    """Annotation rows ``[db, accession, symbol, qualifier, go_id, evidence, aspect, n_fields, file_row]``.

    Strict mode raises unless every row has 17 fields and the version is known.
    """
    lines = read_lines(spark, path).where(~F.col("value").startswith("!") & (F.col("value") != ""))
    rows = lines.select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("f"), "file_row").withColumn("n_fields", F.size("f"))
    if strict:
        bad = rows.where("n_fields <> 17").limit(1).collect()
        if bad:
            raise ValueError(f"annotation line has {bad[0]['n_fields']} fields; expected 17")
        version = annotation_headers(spark, path).where("key = 'gaf-version'").select("value").first()
        if version is None or version["value"] not in ANNOTATION_VERSIONS:
            raise ValueError(f"unsupported or missing annotation version: {version}")

    def cell(i):
        return ids.strip(F.coalesce(F.get("f", F.lit(i)), F.lit("")))

    return rows.select(cell(0).alias("db"), cell(1).alias("accession"), cell(2).alias("symbol"), cell(3).alias("qualifier"),
                       cell(4).alias("go_id"), cell(6).alias("evidence"), cell(8).alias("aspect"), "n_fields", "file_row")


def read_obo(spark: SparkSession, path) -> DataFrame:
    """``[term_id, name, namespace, definition, synonyms, parents]`` of non-obsolete terms; last stanza wins."""
    stanzas = read_lines(spark, path, "\n[").where(F.col("value").startswith("Term]") | F.col("value").startswith("[Term]"))
    s = F.col("value")

    def one(tag):
        return ids.strip(F.regexp_extract(s, rf"(?m)^{tag}: (.*)$", 1))

    terms = stanzas.select(
        one("id").alias("term_id"), one("name").alias("name"), one("namespace").alias("namespace"), one("def").alias("definition"),
        F.regexp_extract_all(s, F.lit(r'(?m)^synonym: [^"\n]*"([^"]+)"'), F.lit(1)).alias("synonyms"),
        F.array_distinct(F.regexp_extract_all(s, F.lit(r"(?m)^is_a: (\S+)"), F.lit(1))).alias("parents"),
        s.rlike(r"(?m)^is_obsolete: true").alias("obsolete"), "file_row").where("term_id <> '' AND NOT obsolete")
    cols = ["name", "namespace", "definition", "synonyms", "parents"]
    return terms.groupBy("term_id").agg(F.max_by(F.struct(*cols), "file_row").alias("t")).select("term_id", "t.*")


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """``[header, record_id, sequence, file_row]``, one row per record; text before the first record is dropped."""
    records = read_lines(spark, path, "\n>").where(F.trim("value") != "")
    body = F.regexp_replace("value", "^>", "")
    head = F.regexp_replace(F.substring_index(body, "\n", 1), "\r$", "")
    seq = F.when(body.contains("\n"), F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n", ""), r"\s+", "")).otherwise(F.lit(""))
    return records.select(ids.strip(head).alias("header"), F.substring_index(ids.strip(head), " ", 1).alias("record_id"), seq.alias("sequence"), "file_row")


def read_protein_index(spark: SparkSession, path) -> DataFrame:
    """``[accession, sequence]``: accession and its isoform base, the first record wins.

    Comment lines between records are dropped and stop marks removed. As in a
    sequential index, a base id claims its slot when its record is read.
    """
    records = read_lines(spark, path, "\n>")
    # metadata before the first record has no record mark
    block = F.regexp_replace("value", r"(?m)^[#!;].*$", "")
    started = records.select(block.alias("b"), "file_row", F.col("value").alias("v")).where(
        F.trim("b") != "").withColumn("b", F.when(F.col("b").contains(">"), F.regexp_replace("b", r"(?s)^.*?>", "")).otherwise(F.col("b")))
    head = F.substring_index("b", "\n", 1)
    seq = F.upper(F.replace(F.regexp_replace(F.regexp_replace("b", r"^[^\n]*\n", ""), r"\s+", ""), F.lit("*"), F.lit("")))
    acc = ids.fasta_accession(F.substring_index(ids.strip(head), " ", 1))
    rows = started.select(acc.alias("acc"), seq.alias("sequence"), "file_row").where("acc <> '' AND sequence <> ''")
    keys = rows.select(F.posexplode(F.array_distinct(F.array("acc", ids.base_accession("acc")))).alias("p", "accession"), "sequence", "file_row")
    return keys.groupBy("accession").agg(F.min_by("sequence", F.struct("file_row", "p")).alias("sequence"))


def chromosome_lengths(fasta: DataFrame) -> DataFrame:
    return fasta.select(F.col("record_id").alias("chromosome"), F.length("sequence").cast("bigint").alias("chrom_length"))
