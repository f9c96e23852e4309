"""Identifier and string functions (row-wise)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from .registry import query, scalar

DIRTY = """CASE c_custkey % 8 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'None' WHEN 2 THEN 'null' WHEN 3 THEN 'NA'
 WHEN 4 THEN 'NONE' WHEN 5 THEN '' WHEN 6 THEN concat('  ', c_name) ELSE concat(c_mktsegment, ' ') END"""
EXACT = "CASE WHEN trim({0}) IN ('', 'nan', 'NaN', 'None', 'NONE') THEN '' ELSE trim({0}) END"
ANY = "CASE WHEN lower(trim({0})) IN ('', 'nan', 'none', 'na') THEN '' ELSE trim({0}) END"
ANY_NULL = "CASE WHEN lower(trim({0})) IN ('', 'nan', 'none', 'null', 'na') THEN '' ELSE trim({0}) END"

scalar("clean_missing_spellings", "S1", "customer", "c_custkey", {"raw": DIRTY}, {
    "cleaned_exact": (lambda raw: ids.clean(raw, "exact"), EXACT.format("raw")),
    "cleaned_any_case": (lambda raw: ids.clean(raw, "any_case"), ANY.format("raw")),
    "cleaned_with_null": (lambda raw: ids.clean(raw, "any_case_null"), ANY_NULL.format("raw")),
    "trimmed": (lambda raw: ids.clean(raw, "trim"), "trim(raw)"),
    "csv_cell": (lambda raw: ids.na_to_empty(raw), "CASE WHEN raw IN ('', 'NA', 'None', 'null', 'NaN') THEN '' ELSE raw END"),
})

scalar("strip_version_suffix", "S2", "part", "p_partkey", {
    "raw": "concat(p_brand, '.', cast(p_size AS STRING), CASE WHEN p_partkey % 3 = 0 THEN '_PAR_Y' ELSE '' END)"}, {
    "base": (lambda raw: ids.strip_version(raw), "split_part(raw, '.', 1)"),
    "suffix_free": (lambda raw: ids.strip_version_suffix(raw), r"regexp_replace(raw, '\.\d+$', '')"),
})

scalar("norm_symbol_upper", "S3", "customer", "c_custkey", {"raw": DIRTY}, {
    "symbol": (lambda raw: ids.norm_symbol(raw), "upper(" + EXACT.format("raw") + ")")})

ENTREZ = """CASE c_custkey % 6 WHEN 0 THEN concat(cast(c_custkey AS STRING), '.0') WHEN 1 THEN cast(c_custkey AS STRING)
 WHEN 2 THEN concat('abc', cast(c_custkey AS STRING)) WHEN 3 THEN '' WHEN 4 THEN concat(cast(c_custkey AS STRING), 'e1')
 ELSE concat(' 00', cast(c_custkey AS STRING), ' ') END"""
scalar("norm_entrez_float_tolerant", "S4", "customer", "c_custkey", {"raw": ENTREZ}, {
    "tolerant": (lambda raw: ids.norm_entrez(raw),
                 "coalesce(cast(cast(try_cast(nullif(trim(raw), '') AS DOUBLE) AS BIGINT) AS VARCHAR), trim(raw))"),
    "strict": (lambda raw: ids.norm_entrez_strict(raw),
               r"CASE WHEN regexp_full_match(trim(raw), '\d+(\.0)?') THEN cast(cast(cast(trim(raw) AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE trim(raw) END"),
})
scalar("clean_entrez_digits", "S5 S32", "customer", "c_custkey", {"raw": ENTREZ}, {
    "entrez": (lambda raw: ids.clean_entrez(raw),
               r"CASE WHEN regexp_full_match(trim(raw), '\d+(\.0)?') THEN regexp_extract(trim(raw), '^(\d+)', 1) ELSE '' END"),
    "canonical": (lambda raw: ids.canonical_digits(raw),
                  r"CASE WHEN regexp_full_match(trim(raw), '\d+') THEN cast(cast(trim(raw) AS BIGINT) AS VARCHAR) ELSE '' END"),
})
scalar("component_token_label", "S6", "customer", "c_custkey", {
    "raw": """CASE c_custkey % 4 WHEN 0 THEN concat('inhib_', cast(c_custkey AS STRING))
 WHEN 1 THEN concat('INHIB_', cast(c_custkey AS STRING), '.0') WHEN 2 THEN cast(c_custkey AS STRING)
 ELSE concat('x', cast(c_custkey AS STRING)) END"""}, {
    "entrez": (lambda raw: ids.component_token_id(raw), "CASE WHEN c_custkey % 4 = 3 THEN '' ELSE cast(c_custkey AS VARCHAR) END"),
    "method": (lambda raw: ids.component_token_method(raw),
               "CASE WHEN lower(raw) LIKE 'inhib^_%' ESCAPE '^' THEN 'entrez_id_exact_unique_from_inhibitory_augmented_token' ELSE 'entrez_id_exact_unique' END"),
})
MIXED = """concat(cast(p_partkey AS STRING), '.0|', cast(p_size AS STRING), ';0,A', cast(p_partkey AS STRING), ' 12.0')"""
scalar("extract_isolated_ids", "S7", "part", "p_partkey", {"raw": MIXED}, {
    "id_list": (lambda raw: F.array_join(F.array_sort(ids.extract_entrez_ids(raw)), ","),
                r"""array_to_string(list_sort(list_distinct(list_filter(string_split_regex(
 regexp_replace(raw, '(\d+)\.0($|[\s,;|])', '\1\2', 'g'), '[^A-Za-z0-9]+'), lambda x: regexp_full_match(x, '\d+') AND x <> '0'))), ',')"""),
})
scalar("extract_digit_runs", "S8", "part", "p_partkey", {"raw": MIXED}, {
    "id_list": (lambda raw: F.array_join(ids.extract_digit_runs(raw), ","), r"array_to_string(regexp_extract_all(raw, '\d+'), ',')")})
scalar("canonical_accession", "S9", "part", "p_partkey", {
    "raw": "concat(CASE WHEN p_partkey % 2 = 0 THEN 'sp|' ELSE '' END, 'p', cast(p_partkey AS STRING), '-', cast(p_size AS STRING))"}, {
    "plain": (lambda raw: ids.canonical_uniprot(raw), "upper(split_part(raw, '-', 1))"),
    "last_field": (lambda raw: ids.canonical_uniprot(raw, True), "upper(split_part(split_part(raw, '|', -1), '-', 1))"),
    "base": (lambda raw: ids.base_accession(raw), "split_part(raw, '-', 1)"),
})
scalar("fasta_record_accession", "S10", "part", "p_partkey", {
    "raw": "CASE WHEN p_partkey % 2 = 0 THEN concat('sp|P', cast(p_partkey AS STRING), '|', p_name) ELSE concat('Q', cast(p_partkey AS STRING), ' ', p_name) END"}, {
    "accession": (lambda raw: ids.fasta_accession(raw), "CASE WHEN p_partkey % 2 = 0 THEN concat('P', p_partkey) ELSE concat('Q', p_partkey) END")})
scalar("clean_protein_stable_id", "S11", "part", "p_partkey", {
    "raw": """CASE p_partkey % 4 WHEN 0 THEN concat('9606.ENSP', cast(p_partkey AS STRING)) WHEN 1 THEN concat('ENSP', cast(p_partkey AS STRING), '.', cast(p_size AS STRING))
 WHEN 2 THEN concat('ENSX', cast(p_partkey AS STRING)) ELSE concat(' ENSP', cast(p_partkey AS STRING), ' ') END"""}, {
    "protein": (lambda raw: ids.clean_ensp(raw), r"regexp_extract(trim(raw), '^(?:9606\.)?(ENSP\d+)(?:\.\d+)?$', 1)")})
scalar("versioned_id_compose", "S12", "part", "p_partkey", {
    "base": "CASE WHEN p_partkey % 5 = 0 THEN 'nan' ELSE p_brand END",
    "ver": "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE cast(p_size AS STRING) END"}, {
    "versioned": (lambda base, ver: ids.versioned_id(base, ver),
                  "CASE WHEN base = 'nan' THEN '' WHEN ver = '' THEN base ELSE concat(base, '.', ver) END")})
CELL = "concat(p_type, '|', p_name, ', ', p_brand, ';;', CASE WHEN p_partkey % 2 = 0 THEN 'NA' ELSE p_type END, '|')"
NON_NA = "lambda x: lower(trim(x)) NOT IN ('', 'nan', 'none', 'na')"
scalar("split_multi_valued_cell", "S13", "part", "p_partkey", {"raw": CELL}, {
    "any_separator": (lambda raw: F.array_join(ids.split_tokens(raw), "~"),
                      rf"array_to_string(list_filter(string_split_regex(raw, '[|,;\s]+'), {NON_NA}), '~')"),
    "symbols": (lambda raw: F.array_join(ids.split_tokens(raw, ids.SYMBOL_SEPARATOR), "~"),
                f"array_to_string(list_transform(list_filter(string_split_regex(raw, '[|,;]+'), {NON_NA}), lambda x: trim(x)), '~')"),
    "pipes": (lambda raw: F.array_join(ids.split_pipe(raw), "~"),
              "array_to_string(list_transform(list_filter(string_split(raw, '|'), lambda x: trim(x) <> ''), lambda x: trim(x)), '~')"),
    "semicolons": (lambda raw: F.array_join(ids.split_semicolon(raw), "~"),
                   "array_to_string(list_transform(list_filter(string_split(raw, ';'), lambda x: trim(x) <> ''), lambda x: trim(x)), '~')"),
    "review_ids": (lambda raw: F.array_join(F.array_sort(F.array_distinct(ids.split_ids_any(raw))), "~"),
                   r"array_to_string(list_sort(list_distinct(list_filter(string_split_regex(raw, '[|,; ]'), lambda x: x <> ''))), '~')"),
})
scalar("join_sorted_unique", "S14", "part", "p_partkey", {"raw": CELL}, {
    "joined": (lambda raw: ids.join_unique(F.split(raw, r"[|,;]"), "|", "any_case"),
               f"array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split_regex(raw, '[|,;]'), {NON_NA}), lambda x: trim(x)))), '|')")})

@query("unique_in_first_seen_order", "S15",
       "SELECT p_partkey, concat(p_type, '|', p_brand, '|', p_name) AS kept FROM part")
def _unique_order(t):
    raw = F.split(F.concat_ws("|", "p_type", "p_brand", "p_type", F.lit(""), "p_name", "p_brand"), r"\|")
    return t.part.select("p_partkey", F.array_join(ids.unique_keep_order(raw), "|").alias("kept"))


@query("flatten_nested_json", "S16 SC23",
       "SELECT event_id, concat(user_id, ',x', event_type, ',', event_type, ',True') AS leaves, "
       "json_extract_string(props, '$.k') AS prop_leaf FROM events")
def _leaves(t):
    doc = F.concat(F.lit('{"a": ['), "user_id", F.lit(', "x'), "event_type", F.lit('"], "b": {"c": ["'), "event_type",
                   F.lit('"]}, "d": null, "e": true}'))
    return t.events.select("event_id", F.array_join(ids.json_leaves(doc), ",").alias("leaves"),
                           F.array_join(ids.json_leaves("props"), ",").alias("prop_leaf"))


@query("hit_protein_preference", "S17", """
SELECT event_id,
 CASE event_id % 4 WHEN 0 THEN concat('S', user_id) WHEN 1 THEN concat('T', user_id, '|', event_type)
      WHEN 2 THEN event_type ELSE '' END AS protein_ids,
 CASE event_id % 4 WHEN 0 THEN 'mapped_reviewed_swissprot' WHEN 1 THEN 'mapped_unreviewed_trembl'
      WHEN 2 THEN 'mapped_other' ELSE 'missing' END AS protein_status
FROM events""")
def _hit(t):
    u, e = F.col("user_id").cast("string"), F.col("event_type")
    doc = (F.when(F.col("event_id") % 4 == 0, F.format_string('{"uniprot": {"TrEMBL": "T%s", "Swiss-Prot": ["S%s", "S%s"]}}', u, u, u))
           .when(F.col("event_id") % 4 == 1, F.format_string('{"uniprot": {"TrEMBL": ["T%s", "%s", "T%s"]}}', u, e, u))
           .when(F.col("event_id") % 4 == 2, F.format_string('{"uniprot": {"Other": "%s"}}', e))
           .otherwise(F.lit('{"entrezgene": 1}')))
    return t.events.select("event_id", ids.hit_uniprot(doc).alias("h")).select(
        "event_id", F.col("h.ids").alias("protein_ids"), F.col("h.status").alias("protein_status"))


@query("hit_confirms_query", "S18",
       "SELECT event_id, event_id % 3 <> 2 AS confirmed FROM events")
def _confirm(t):
    u = F.col("user_id").cast("string")
    doc = (F.when(F.col("event_id") % 3 == 0, F.format_string('{"ensembl": {"gene": "%s"}}', u))
           .when(F.col("event_id") % 3 == 1, F.format_string('{"ensembl": [{"gene": "none"}, {"gene": "%s"}]}', u))
           .otherwise(F.lit('{"ensembl": [{"gene": "other"}]}')))
    return t.events.select("event_id", ids.hit_matches_query(doc, u).alias("confirmed"))


@query("mapping_status_text", "S19", """
SELECT c_custkey, CASE
 WHEN e = '' AND u = '' THEN 'found_but_missing_entrez_and_uniprot'
 WHEN e = '' THEN p || '; missing_entrez; mapped_other'
 WHEN u = '' THEN p || '; mapped_entrez; missing_uniprot'
 ELSE p || '; mapped_entrez; mapped_other' END AS mapping_status
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS e,
             CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS u,
             CASE WHEN c_custkey % 2 = 0 THEN 'mapped_exact_ensembl' ELSE 'mapped_without_exact_ensembl_confirmation' END AS p
      FROM customer) q""")
def _status(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", ids.mapping_status(
        k % 2 == 0, F.when(k % 3 == 0, F.lit("")).otherwise(F.col("c_name")),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.col("c_mktsegment")), F.lit("mapped_other")).alias("mapping_status"))


scalar("matrix_column_name_parse", "S20", "part", "p_partkey", {
    "raw": "CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE concat(p_name, ' (', cast(p_partkey AS STRING), ')') END"}, {
    "symbol": (lambda raw: ids.gene_column_symbol(raw), "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END".replace("p_name", r"regexp_extract(raw, '^(.+) \((\d+)\)$', 1)")),
    "entrez": (lambda raw: ids.gene_column_entrez(raw), r"regexp_extract(raw, '^(.+) \((\d+)\)$', 2)"),
})
scalar("concept_key_parse", "S21", "customer", "c_custkey", {
    "raw": """CASE c_custkey % 4 WHEN 0 THEN concat('Gene_', cast(c_custkey AS STRING)) WHEN 1 THEN concat('Gene_', cast(c_custkey AS STRING), '_7')
 WHEN 2 THEN concat('Gene_x', cast(c_custkey AS STRING)) ELSE c_name END"""}, {
    "value": (lambda raw: ids.concept_key(raw)["value"],
              "CASE c_custkey % 4 WHEN 0 THEN cast(c_custkey AS VARCHAR) WHEN 1 THEN concat(c_custkey, '|7') WHEN 2 THEN concat('x', c_custkey) END"),
    "status": (lambda raw: ids.concept_key(raw)["status"],
               "CASE c_custkey % 4 WHEN 0 THEN 'single_entrez' WHEN 1 THEN 'multi_entrez' WHEN 2 THEN 'bad_gene_concept' ELSE 'non_gene' END"),
})
scalar("node_kind_and_local_id", "S22", "customer", "c_custkey", {
    "raw": """CASE c_custkey % 3 WHEN 0 THEN concat('Gene::', cast(c_custkey AS STRING)) WHEN 1 THEN concat('Bio::', c_mktsegment, '::', cast(c_custkey AS STRING)) ELSE c_name END"""}, {
    "kind": (lambda raw: ids.node_kind(raw), "CASE c_custkey % 3 WHEN 0 THEN 'Gene' WHEN 1 THEN 'Bio' ELSE '' END"),
    "local_id": (lambda raw: ids.node_local_id(raw), "CASE WHEN raw LIKE '%::%' THEN substr(raw, instr(raw, '::') + 2) ELSE raw END"),
    "is_gene": (lambda raw: ids.is_gene_node(raw, ids.node_kind(raw)), "c_custkey % 3 = 0"),
})
scalar("typed_feature_key", "S23", "customer", "c_custkey", {"a": "c_mktsegment", "b": "concat(' ', c_name)", "n": "c_nationkey"}, {
    "feature_key": (lambda a, b, n: ids.typed_key(a, b, n), "concat(a, '||', trim(b), '||', cast(n AS VARCHAR))")})
scalar("ontology_and_entity_tokens", "S24", "part", "p_partkey", {
    "go": "concat('GO:', cast(p_partkey AS STRING))", "acc": "concat('sp|p', cast(p_partkey AS STRING), '-2')", "sym": "p_name"}, {
    "term_token": (lambda go, acc, sym: ids.go_token(go), "concat('GO_', p_partkey)"),
    "entity_token": (lambda go, acc, sym: ids.entity_token(acc), "concat('UNIPROT_P', p_partkey)"),
    "symbol_token": (lambda go, acc, sym: ids.symbol_token(sym), "concat('symbol_', lower(regexp_replace(sym, '[^A-Za-z0-9]+', '_', 'g')))"),
})
scalar("text_tokenizer", "S25", "documents", "doc_id", {"raw": "text"}, {
    "n_tokens": (lambda raw: F.size(ids.text_tokens(raw)).cast("bigint"),
                 "len(list_filter(regexp_extract_all(lower(raw), '[a-z0-9]+'), lambda x: length(x) >= 2))"),
    "token_digest": (lambda raw: F.md5(F.array_join(ids.text_tokens(raw), " ")),
                     "md5(array_to_string(list_filter(regexp_extract_all(lower(raw), '[a-z0-9]+'), lambda x: length(x) >= 2), ' '))"),
})
scalar("special_token_flag", "S26", "customer", "c_custkey", {
    "raw": "CASE c_custkey % 4 WHEN 0 THEN concat('<', c_mktsegment, '>') WHEN 1 THEN '[PAD]' WHEN 2 THEN ' ' ELSE c_name END"}, {
    "is_special": (lambda raw: ids.is_special_token(raw), "c_custkey % 4 <> 3")})
scalar("first_existing_cell", "S27", "customer", "c_custkey", {
    "a": "CASE c_custkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'NaN' ELSE c_name END", "b": "CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END"}, {
    "picked": (lambda a, b: ids.first_existing(a, b), "CASE WHEN c_custkey % 3 = 2 THEN a WHEN b <> '' THEN b ELSE '' END")})
scalar("find_stable_ids", "S28", "part", "p_partkey", {
    "raw": "concat(p_name, ' ENSG', cast(p_partkey AS STRING), '.4|ENST', cast(p_size AS STRING), ' ENSG1')"}, {
    "gene": (lambda raw: ids.find_gene_id(raw), r"regexp_extract(raw, 'ENSG\d+')"),
    "transcript": (lambda raw: ids.find_transcript_id(raw), r"regexp_extract(raw, 'ENST\d+')")})
scalar("prefix_filtered_tokens", "S29", "part", "p_partkey", {
    "raw": "concat('ENST', cast(p_partkey AS STRING), '|NM_', cast(p_size AS STRING), ', XR_', cast(p_size AS STRING), ';other')"}, {
    "refseq": (lambda raw: F.array_join(ids.tokens_with_prefix(raw, ids.REFSEQ_PREFIXES), "|"), "concat('NM_', p_s, '|XR_', p_s)".replace("p_s", r"regexp_extract(raw, 'NM_(\d+)', 1)")),
    "transcripts": (lambda raw: F.array_join(ids.tokens_with_prefix(raw, ["ENST"]), "|"), "concat('ENST', p_partkey)")})
scalar("network_protein_ids", "S30", "part", "p_partkey", {
    "raw": "concat('ENSP', cast(p_partkey AS STRING), '|X', cast(p_size AS STRING))"}, {
    "string_ids": (lambda raw: F.array_join(ids.string_protein_ids(ids.split_pipe(raw)), "|"), "concat('9606.ENSP', p_partkey)")})
scalar("feature_name_text", "S31", "documents", "doc_id", {"raw": "text"}, {
    "digest": (lambda raw: F.md5(ids.feature_text(raw)), "md5(replace(replace(replace(raw, chr(9), ' '), chr(10), ' '), '|', '/'))"),
    "pipe_name": (lambda raw: F.concat_ws("|", F.lit("CAGE"), F.length(ids.feature_text(raw)).cast("string"), F.lit("track0")),
                  "concat('CAGE|', length(raw), '|track0')")})
scalar("entity_entrez_number", "S32", "customer", "c_custkey", {
    "raw": "CASE WHEN c_custkey % 3 = 0 THEN concat('Gene::', c_name) ELSE concat('Gene::0', cast(c_custkey AS STRING)) END"}, {
    "entrez": (lambda raw: ids.gene_entity_entrez(raw), "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END")})
