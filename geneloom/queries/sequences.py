"""Sequence functions on letters derived from the whole document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq
from ..operators import inference
from .registry import big, query, scalar

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASES = ("ACGT" * 13)[:52]
# the same DNA for both engines: letters mapped to bases, everything else dropped
DUCK_DNA = f"regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g')"
DUCK_LETTERS = "regexp_replace(text, '[^A-Za-z]', '', 'g')"


def dna(c="text"):
    return F.regexp_replace(F.translate(F.col(c), LETTERS, BASES), "[^ACGT]", "")


def letters(c="text"):
    return F.regexp_replace(F.col(c), "[^A-Za-z]", "")


def _text_query(name, covers, raw, duck_raw, outs):
    inner = f"SELECT doc_id, {duck_raw} AS s FROM documents"
    select = ", ".join(f"{sql} AS {alias}" for alias, (_, sql) in outs.items())

    @query(name, covers, f"SELECT doc_id, {select} FROM ({inner}) q")
    def build(t):
        df = t.texts.select("doc_id", raw().alias("s"))
        return df.select("doc_id", *[fn(F.col("s")).alias(alias) for alias, (fn, _) in outs.items()])


_text_query("clean_dna_letters", "Q10 Q14", letters, DUCK_LETTERS, {
    "dna_digest": (lambda s: F.md5(seq.clean_dna(s)), "md5(regexp_replace(replace(upper(s), 'U', 'T'), '[^ACGTN]', 'N', 'g'))"),
    "rna_digest": (lambda s: F.md5(seq.dna_to_rna(s)),
                   "md5(replace(regexp_replace(replace(upper(s), 'U', 'T'), '[^ACGTN]', 'N', 'g'), 'T', 'U'))"),
})
_text_query("clean_rna_and_validate", "Q11 Q12", letters, DUCK_LETTERS, {
    "rna_digest": (lambda s: F.md5(seq.clean_rna(s)), "md5(replace(replace(upper(s), 'T', 'U'), 'E', ''))"),
    "is_valid": (lambda s: seq.valid_rna(seq.clean_rna(s)), "regexp_full_match(replace(replace(upper(s), 'T', 'U'), 'E', ''), '[ACGUN]+')"),
    "dna_is_valid": (lambda s: seq.valid_rna(seq.dna_to_rna(s)), "length(s) > 0"),
})
_text_query("clean_marked_rna", "Q13", letters, DUCK_LETTERS, {
    "digest": (lambda s: F.md5(seq.clean_marked_rna(s)), "md5(regexp_replace(replace(upper(s), 'T', 'U'), '[^ACGUNE]', 'N', 'g'))")})
_text_query("codon_markers", "Q15", dna, DUCK_DNA, {
    "marked_length": (lambda s: big(F.length(seq.codon_markers(s))), "length(s) + (length(s) + 2) // 3"),
    "digest": (lambda s: F.md5(seq.codon_markers(s)), r"md5(regexp_replace(s, '(.{1,3})', 'E\1', 'g'))")})
_text_query("reverse_complement", "Q16", dna, DUCK_DNA, {
    "digest": (lambda s: F.md5(seq.reverse_complement(s)), "md5(reverse(translate(s, 'ACGT', 'TGCA')))")})


@query("one_hot_base_counts", "Q17", "SELECT doc_id, " + ", ".join(
    f"cast(length(s) - length(replace(s, '{b}', '')) AS DOUBLE) AS n_{b.lower()}" for b in "ACGT")
    + f" FROM (SELECT doc_id, {DUCK_DNA} AS s FROM documents) q")
def _one_hot(t):
    counts = inference.one_hot_totals(t.texts.select("doc_id", dna().alias("s")), "doc_id", "s")
    return counts.select("doc_id", *[F.col("totals")[i].alias(f"n_{b.lower()}") for i, b in enumerate("ACGT")])


_text_query("clean_protein_letters", "Q18", letters, DUCK_LETTERS, {
    "digest": (lambda s: F.md5(seq.clean_protein(s)), "md5(regexp_replace(upper(s), '[^ACDEFGHIKLMNPQRSTVWYX]', 'X', 'g'))")})


@query("fixed_size_chunks", "Q19", f"""
SELECT doc_id, cast(i // 1000 AS INTEGER) AS piece_no, md5(substr(s, i + 1, 1000)) AS digest,
       length(substr(s, i + 1, 1000)) AS piece_length
FROM (SELECT doc_id, s, unnest(range(0, length(s), 1000)) AS i FROM (SELECT doc_id, {DUCK_DNA} AS s FROM documents) a) b""")
def _chunks(t):
    return t.texts.select("doc_id", F.posexplode(seq.chunks(dna(), 1000)).alias("piece_no", "p")).select(
        "doc_id", "piece_no", F.md5("p").alias("digest"), big(F.length("p")).alias("piece_length"))


@query("chunks_with_minimum_tail", "Q20", f"""
WITH d AS (SELECT doc_id, {DUCK_DNA} AS s FROM documents),
n AS (SELECT doc_id, s, length(s) AS n,
        CASE WHEN length(s) > 1000 AND length(s) % 1000 BETWEEN 1 AND 199 THEN length(s) // 1000
             ELSE (length(s) + 999) // 1000 END AS c FROM d WHERE length(s) > 0),
p AS (SELECT doc_id, s, n, c, unnest(range(0, c)) AS i FROM n)
SELECT doc_id, cast(i AS INTEGER) AS piece_no,
       CASE WHEN i = c - 1 THEN n - i * 1000 ELSE 1000 END AS piece_length,
       md5(CASE WHEN i = c - 1 THEN substr(s, i * 1000 + 1) ELSE substr(s, i * 1000 + 1, 1000) END) AS digest FROM p""")
def _tail_chunks(t):
    return t.texts.select("doc_id", F.posexplode(seq.chunks_min_tail(dna(), 1000, 200)).alias("piece_no", "p")).select(
        "doc_id", "piece_no", big(F.length("p")).alias("piece_length"), F.md5("p").alias("digest"))


@query("protein_windows", "Q21", f"""
SELECT doc_id, i AS start0, least(i + 1022, length(s)) AS stop0, md5(substr(s, i + 1, 1022)) AS digest
FROM (SELECT doc_id, s, unnest(CASE WHEN length(s) = 0 THEN [0] ELSE range(0, length(s), 1022) END) AS i
      FROM (SELECT doc_id, {DUCK_LETTERS} AS s FROM documents) a) b""")
def _windows(t):
    return t.texts.select("doc_id", F.explode(seq.windows(letters(), 1022)).alias("w")).select(
        "doc_id", big("w.start").alias("start0"), big("w.stop").alias("stop0"), F.md5("w.piece").alias("digest"))


@query("locate_coding_region", "Q23", f"""
WITH d AS (SELECT doc_id, {DUCK_DNA} AS s FROM documents),
c AS (SELECT doc_id, s, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'N' ELSE substr(s, 1 + cast(doc_id % 50 AS BIGINT), 3 + cast(doc_id % 9 AS BIGINT)) END AS cds FROM d),
h AS (SELECT *, instr(s, cds) AS hit FROM c),
g AS (SELECT *, CASE WHEN hit > 0 THEN instr(substr(s, hit + 1), cds) ELSE 0 END AS again FROM h),
st AS (SELECT *, CASE WHEN s = '' THEN 'missing_cdna_sequence' WHEN cds = '' THEN 'missing_cds_sequence'
      WHEN hit = 0 THEN 'cds_not_found_inside_cdna' WHEN again > 0 THEN 'mapped_cds_multiple_hits_used_first' ELSE 'mapped' END AS status FROM g)
SELECT doc_id, status, CASE WHEN status LIKE 'mapped%' THEN hit - 1 ELSE -1 END AS start0,
  CASE WHEN status LIKE 'mapped%' THEN hit - 1 + length(cds) ELSE -1 END AS stop0,
  CASE WHEN status LIKE 'mapped%' THEN md5(replace(concat(substr(s, 1, hit - 1), regexp_replace(cds, '(.{{1,3}})', 'E\\1', 'g'),
       substr(s, hit + length(cds))), 'T', 'U')) END AS input_digest FROM st""")
def _locate(t):
    k = F.col("doc_id") % 4
    d = t.texts.select("doc_id", dna().alias("s")).withColumn(
        "cds", F.when(k == 0, F.lit("")).when(k == 1, F.lit("N")).otherwise(F.substring(
            "s", (F.col("doc_id") % 50 + 1).cast("int"), (F.col("doc_id") % 9 + 3).cast("int"))))
    d = d.withColumn("h", seq.locate_cds("s", "cds"))
    return d.select("doc_id", "h.status", "h.start0", "h.stop0", F.when(
        F.col("h.status").startswith("mapped"), F.md5(seq.marked_transcript("s", "h.start0", "h.stop0"))).alias("input_digest"))


scalar("transcription_start_site", "Q24", "part", "p_partkey", {
    "strand": "CASE p_partkey % 5 WHEN 0 THEN '.' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '+' ELSE '-' END",
    "lo": "CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE concat(cast(p_partkey * 10 AS STRING), '.0') END",
    "hi": "cast(p_partkey * 10 + p_size AS STRING)",
    "chrom": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 1000 END"}, {
    "tss": (lambda strand, lo, hi, chrom: seq.tss_1based(strand, seq.coordinate(lo), seq.coordinate(hi)),
            "CASE strand WHEN '+' THEN try_cast(try_cast(lo AS DOUBLE) AS BIGINT) WHEN '-' THEN cast(hi AS BIGINT) END"),
    "status": (lambda strand, lo, hi, chrom: seq.tss_status(chrom, seq.coordinate(lo), seq.coordinate(hi), strand),
               "CASE WHEN chrom IS NULL THEN 'chromosome_not_in_fasta' WHEN lo = 'x' THEN 'invalid_coordinates' WHEN strand = '.' THEN 'invalid_strand' ELSE 'ok' END"),
})


@query("start_site_window_in_bounds", "Q25 SK7", f"""
WITH d AS (SELECT doc_id, length({DUCK_DNA}) AS n FROM documents),
w AS (SELECT doc_id, n, (doc_id * 37) % 2000 AS tss FROM d)
SELECT doc_id, CASE WHEN tss - 500 < 0 OR tss + 500 > n THEN 'window_out_of_bounds' ELSE 'ok' END AS status,
  CASE WHEN NOT (tss - 500 < 0 OR tss + 500 > n) THEN concat('doc', doc_id, chr(9), tss - 500, chr(9), tss + 500) END AS bed_line FROM w""")
def _bounds(t):
    d = t.texts.select("doc_id", F.length(dna()).alias("n"), ((F.col("doc_id") * 37) % 2000).alias("tss"))
    ok = (F.col("tss") - 500 >= 0) & (F.col("tss") + 500 <= F.col("n"))
    line = F.concat_ws("\t", F.concat(F.lit("doc"), "doc_id"), (F.col("tss") - 500).cast("string"), (F.col("tss") + 500).cast("string"))
    return d.select("doc_id", F.when(ok, F.lit("ok")).otherwise(F.lit("window_out_of_bounds")).alias("status"),
                    F.when(ok, line).alias("bed_line"))


@query("padded_sequence_slice", "SC16 Q27", f"""
WITH d AS (SELECT doc_id, {DUCK_DNA} AS s, (doc_id * 37) % 900 - 100 AS center FROM documents),
w AS (SELECT doc_id, s, center - 128 AS a, center + 128 AS b, length(s) AS n FROM d),
p AS (SELECT doc_id, concat(repeat('N', greatest(least(0, b) - a, 0)),
   substr(s, greatest(least(greatest(a, 0), n), 0) + 1, greatest(least(b, n) - least(greatest(a, 0), n), 0)),
   repeat('N', greatest(b - greatest(n, a), 0))) AS x FROM w)
SELECT doc_id, length(x) AS slice_length, md5(x) AS digest, md5(reverse(translate(x, 'ACGT', 'TGCA'))) AS minus_digest FROM p""")
def _padded(t):
    d = t.texts.select("doc_id", dna().alias("s"), ((F.col("doc_id") * 37) % 900 - 100).alias("center"))
    d = d.select("doc_id", seq.centered_slice("s", "center", 256).alias("x"))
    return d.select("doc_id", big(F.length("x")).alias("slice_length"), F.md5("x").alias("digest"),
                    F.md5(seq.reverse_complement("x")).alias("minus_digest"))


@query("splice_sites_from_ordered_exons", "Q26 W9", """
WITH e AS (SELECT DISTINCT l_orderkey, l_partkey * 100 AS a, l_partkey * 100 + cast(l_quantity AS BIGINT) AS b FROM lineitem),
n AS (SELECT *, lead(a) OVER w AS next_a, lag(b) OVER w AS prev_b, lag(a) OVER w AS prev_a, lead(b) OVER w AS next_b,
        l_orderkey % 2 = 0 AS plus FROM e WINDOW w AS (PARTITION BY l_orderkey ORDER BY a, b))
SELECT l_orderkey, 'donor' AS site_type, CASE WHEN plus THEN b ELSE a END AS site_1based FROM n
 WHERE CASE WHEN plus THEN next_a IS NOT NULL ELSE prev_a IS NOT NULL END
UNION ALL
SELECT l_orderkey, 'acceptor', CASE WHEN plus THEN a ELSE b END FROM n
 WHERE CASE WHEN plus THEN prev_a IS NOT NULL ELSE next_a IS NOT NULL END""")
def _splice(t):
    from ..plans.genome import splice_sites

    exons = t.lineitem.select("l_orderkey", (F.col("l_partkey") * 100).alias("start"),
                              (F.col("l_partkey") * 100 + big("l_quantity")).alias("stop"),
                              F.when(F.col("l_orderkey") % 2 == 0, F.lit("+")).otherwise(F.lit("-")).alias("strand")).distinct()
    return splice_sites(exons, "l_orderkey").select("l_orderkey", "site_type", "site_1based")


@query("fasta_lines_wrapped", "SK6", f"""
SELECT doc_id, md5(regexp_replace(s, '(.{{80}})', '\\1\n', 'g')) AS digest, (length(s) + 79) // 80 AS n_lines
FROM (SELECT doc_id, {DUCK_DNA} AS s FROM documents) q""")
def _fasta(t):
    from ..sources.sinks import wrap_lines

    d = t.texts.select("doc_id", dna().alias("s"))
    return d.select("doc_id", F.md5(wrap_lines("s", 80)).alias("digest"),
                    F.floor((F.length("s") + 79) / F.lit(80)).alias("n_lines"))
