"""Plans that build the gene dimension table in four steps; each step writes its table once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, num
from ..operators import mapping, quality
from ..operators.ranges import with_row_index
from ..session import materialize

# Annotation release and assembly of the base table.
RELEASE, ASSEMBLY = "v49", "GRCh38"


def tag_rank(tags) -> Column:
    tags = ids._col(tags)
    return (F.when(F.array_contains(tags, "MANE_Select"), F.lit(0)).when(F.array_contains(tags, "Ensembl_canonical"), F.lit(1))
            .when(F.exists(tags, lambda x: x.startswith("appris_principal")), F.lit(2)).otherwise(F.lit(3)))


def support_rank(tsl) -> Column:
    """Leading integer of the support level, 99 if there is none."""
    first = F.regexp_extract(ids.strip(F.coalesce(ids._col(tsl), F.lit(""))), r"^([+-]?\d+)(\s|$)", 1)
    return F.coalesce(F.when(first != "", first).try_cast("int"), F.lit(99))


def selection_rule(tags, tsl) -> Column:
    tags = ids._col(tags)
    appris = F.array_sort(F.filter(tags, lambda x: x.startswith("appris_principal")))
    return (F.when(F.array_contains(tags, "MANE_Select"), F.lit("MANE_Select"))
            .when(F.array_contains(tags, "Ensembl_canonical"), F.lit("Ensembl_canonical"))
            .when(F.size(appris) > 0, F.get(appris, F.lit(0)))
            .when(F.coalesce(ids._col(tsl), F.lit("")).startswith("1"), F.lit("transcript_support_level_1"))
            .otherwise(F.lit("longest_exon_sum_fallback")))


def pick_canonical(transcripts: DataFrame, gene: str, tags: str, tsl: str, length: str, kind: str, tie: Column) -> DataFrame:
    """Best transcript per gene: coding ones first, then tag, support level, length, tie.

    Whether a gene has any coding transcript is the leading part of the order, so
    one ``min_by`` per gene does both the fallback and the ranking.
    """
    order = F.struct(F.when(F.col(kind) == "protein_coding", F.lit(0)).otherwise(F.lit(1)),
                     tag_rank(tags), support_rank(tsl), -F.col(length), tie)
    payload = [c for c in transcripts.columns if c != gene]
    best = transcripts.groupBy(gene).agg(F.min_by(F.struct(*payload), order).alias("_b"))
    return best.select(gene, "_b.*")


# Columns of the base table, in order.
BASE_COLUMNS = ("ensembl_gene_id ensembl_gene_id_versioned gene_symbol gene_type chromosome gene_start gene_end strand "
                "canonical_transcript_id canonical_transcript_id_versioned canonical_transcript_name canonical_transcript_type "
                "canonical_protein_id canonical_protein_id_versioned ccdsid canonical_selection_rule canonical_transcript_tags "
                "transcript_support_level exon_length entrez_id uniprot_id havana_gene havana_transcript gencode_release "
                "assembly mapping_notes").split()


def build_base_table(gtf: DataFrame) -> DataFrame:
    """Step 1. ``gtf`` has ``chromosome, source, feature, start, stop, strand, attributes (map), tags (array), file_row``.

    Gene records: the last line per id wins. Transcripts: exon lengths add up,
    tags unite, the first protein and CCDS id count.
    """
    at = F.col("attributes")

    def attr(name):
        return F.coalesce(at[name], F.lit(""))

    rows = gtf.where(F.col("n_fields") == 9).select(
        "*", attr("gene_id").alias("gene_v"), F.substring_index(attr("gene_id"), ".", 1).alias("gene"),
        F.coalesce(at["gene_type"], at["gene_biotype"], F.lit("")).alias("gene_type"),
        attr("transcript_id").alias("tx_v"), F.substring_index(attr("transcript_id"), ".", 1).alias("tx"))
    rows = rows.where((F.col("gene") != "") & (F.col("gene_type") == "protein_coding"))
    gene_rows = rows.where("feature = 'gene'").select("gene", "file_row", F.struct(
        F.col("gene_v").alias("ensembl_gene_id_versioned"), attr("gene_name").alias("gene_symbol"), "gene_type", "chromosome",
        F.col("start").cast("string").alias("gene_start"), F.col("stop").cast("string").alias("gene_end"), "strand",
        attr("havana_gene").alias("havana_gene")).alias("g"))
    genes = gene_rows.groupBy("gene").agg(F.max_by("g", "file_row").alias("g")).select("gene", "g.*")

    def first_filled(name):
        return F.min_by(attr(name), F.when(attr(name) != "", F.col("file_row")))

    head = F.struct(F.col("gene").alias("owner"), "tx_v", attr("transcript_name").alias("tx_name"), F.coalesce(at["transcript_type"], at["transcript_biotype"], F.lit("")).alias("tx_type"),
                    attr("transcript_support_level").alias("tsl"), attr("havana_transcript").alias("havana_transcript"))
    tx = (rows.where("tx <> ''").groupBy("gene", "tx").agg(
        F.min_by(head, "file_row").alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
        F.coalesce(first_filled("protein_id"), F.lit("")).alias("protein_v"), F.coalesce(first_filled("ccdsid"), F.lit("")).alias("ccdsid"),
        F.coalesce(F.sum(F.when(F.col("feature") == "exon", F.col("stop") - F.col("start") + 1)), F.lit(0)).alias("exon_length"))
        .select("gene", "tx", "h.*", "tags", "protein_v", "ccdsid", "exon_length"))
    best = pick_canonical(tx, "gene", "tags", "tsl", "exon_length", "tx_type", F.struct(num.character_sum("tx"), "tx"))
    joined = genes.join(best, "gene", "left")
    none = F.col("tx").isNull()

    def text(c):
        return F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))

    out = {
        "ensembl_gene_id": F.col("gene"), "canonical_transcript_id": text("tx"), "canonical_transcript_id_versioned": text("tx_v"),
        "canonical_transcript_name": text("tx_name"), "canonical_transcript_type": text("tx_type"),
        "canonical_protein_id": F.substring_index(text("protein_v"), ".", 1), "canonical_protein_id_versioned": text("protein_v"),
        "ccdsid": text("ccdsid"), "canonical_selection_rule": F.when(none, F.lit("no_transcript_found")).otherwise(selection_rule("tags", "tsl")),
        "canonical_transcript_tags": text(F.array_join("tags", ";")), "transcript_support_level": text("tsl"),
        "exon_length": text(F.col("exon_length").cast("string")), "entrez_id": F.lit(""), "uniprot_id": F.lit(""),
        "havana_transcript": text("havana_transcript"), "gencode_release": F.lit(RELEASE), "assembly": F.lit(ASSEMBLY),
        "mapping_notes": F.when(none, F.lit("No protein-coding transcript parsed for this protein-coding gene.")).otherwise(F.lit("")),
    }
    return materialize(joined.select(*[out.get(c, F.col(c)).alias(c) for c in BASE_COLUMNS]), "base")


def enrichment_mapping(hits: DataFrame) -> DataFrame:
    """``[ensembl_gene_id, entrez_id, uniprot_id, id_mapping_status, id_mapping_source]`` from JSON hits ``[hit, file_row]``.

    A later answer for the same query id replaces an earlier one.
    """
    h = F.col("hit")
    q = F.coalesce(F.get_json_object(h, "$.query"), F.lit(""))
    entrez = ids.strip(F.coalesce(F.get_json_object(h, "$.entrezgene"), F.lit("")))
    missing = F.coalesce(F.get_json_object(h, "$.notfound") == "true", F.lit(False))
    rows = hits.select("file_row", q.alias("ensembl_gene_id"), missing.alias("missing"), entrez.alias("entrez"), ids.hit_uniprot(h).alias("u"),
                       ids.hit_matches_query(h, q).alias("exact"))
    status = F.when(F.col("missing"), F.lit("not_found")).otherwise(ids.mapping_status("exact", "entrez", F.col("u.ids"), F.col("u.status")))
    row = F.struct(F.when(F.col("missing"), F.lit("")).otherwise(F.col("entrez")).alias("entrez_id"),
                   F.when(F.col("missing"), F.lit("")).otherwise(F.col("u.ids")).alias("uniprot_id"),
                   status.alias("id_mapping_status"), F.lit("mygene.info").alias("id_mapping_source"))
    return rows.groupBy("ensembl_gene_id").agg(F.max_by(row, "file_row").alias("m")).select("ensembl_gene_id", "m.*")


def enrich_ids(base: DataFrame, hits: DataFrame) -> DataFrame:
    """Step 2: overwrite Entrez and protein ids from pre-fetched query hits."""
    cols = ["entrez_id", "uniprot_id", "id_mapping_status", "id_mapping_source"]
    out = mapping.apply_mapping(base.withColumn("ensembl_gene_id", ids.strip("ensembl_gene_id")), "ensembl_gene_id", enrichment_mapping(hits), cols)
    return materialize(out.withColumn("id_mapping_source", F.lit("mygene.info")), "enriched")


def enrichment_counts(enriched: DataFrame) -> DataFrame:
    e, u = ids.strip("entrez_id") != "", ids.strip("uniprot_id") != ""
    return enriched.agg(F.count(F.lit(1)).alias("rows"), F.count_if(e).alias("mapped_entrez"), F.count_if(u).alias("mapped_uniprot"),
                        F.count_if(e & u).alias("mapped_both"), F.count_if(F.col("id_mapping_status") == "not_found").alias("not_found"),
                        F.count_if(~e).alias("missing_entrez"), F.count_if(~u).alias("missing_uniprot"))


def _external(df: DataFrame, gene, entrez, uniprot) -> DataFrame:
    """Sets of external ids per unversioned gene."""
    rows = df.select(ids.strip_version(gene, "any_case_null").alias("gene"), ids.clean(entrez, "any_case_null").alias("e"), uniprot.alias("u")).where("gene <> ''")
    return rows.groupBy("gene").agg(F.array_sort(F.collect_set(F.when(F.col("e") != "", F.col("e")))).alias("e"),
                                    F.array_sort(F.array_distinct(F.flatten(F.collect_set("u")))).alias("u"))


# Header spellings of the second id source.
MART_GENE = ("Gene stable ID", "ensembl_gene_id", "Ensembl gene ID")
MART_ENTREZ = ("NCBI gene (formerly Entrezgene) ID", "entrezgene_id", "EntrezGene ID")
MART_REVIEWED = ("UniProtKB/Swiss-Prot ID", "uniprotswissprot", "UniProt/SwissProt ID")
MART_UNREVIEWED = ("UniProtKB/TrEMBL ID", "uniprotsptrembl", "UniProt/TrEMBL ID")


def _pick(df: DataFrame, names) -> Column:
    found = [F.when(F.coalesce(F.col(f"`{n}`"), F.lit("")) != "", F.col(f"`{n}`")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(""))


def crosscheck_ids(enriched: DataFrame, hgnc: DataFrame, mart: DataFrame) -> DataFrame:
    """Step 3: compare ids with two external sources, fill gaps, flag rows for review."""
    none = F.array().cast("array<string>")
    h = _external(hgnc, F.col("ensembl_gene_id"), F.col("entrez_id"), ids.split_ids_any("uniprot_ids"))
    b = _external(mart, _pick(mart, MART_GENE), _pick(mart, MART_ENTREZ),
                  F.array_union(ids.split_ids_any(_pick(mart, MART_REVIEWED)), ids.split_ids_any(_pick(mart, MART_UNREVIEWED))))
    base = enriched.withColumn("ensembl_gene_id", ids.strip_version("ensembl_gene_id", "any_case_null"))
    for c in ("entrez_id", "uniprot_id"):
        if c not in base.columns:
            base = base.withColumn(c, F.lit(""))
    joined = (base.join(h.select(F.col("gene").alias("ensembl_gene_id"), F.col("e").alias("_he"), F.col("u").alias("_hu")), "ensembl_gene_id", "left")
              .join(b.select(F.col("gene").alias("ensembl_gene_id"), F.col("e").alias("_be"), F.col("u").alias("_bu")), "ensembl_gene_id", "left"))
    joined = joined.select(*base.columns, *[F.coalesce(c, none).alias(c) for c in ("_he", "_hu", "_be", "_bu")])
    joined = joined.withColumn("_e", mapping.reconcile(F.col("entrez_id"), F.col("_he"), F.col("_be"), False)).withColumn(
        "_u", mapping.reconcile(F.col("uniprot_id"), F.col("_hu"), F.col("_bu"), True))
    kept = [F.col("_e.value").alias(c) if c == "entrez_id" else F.col("_u.value").alias(c) if c == "uniprot_id" else F.col(c) for c in base.columns]
    notes = F.array_compact(F.array(F.when(F.col("_e.note") != "", F.concat(F.lit("entrez: "), F.col("_e.note"))),
                                    F.when(F.col("_u.note") != "", F.concat(F.lit("uniprot: "), F.col("_u.note")))))
    return materialize(joined.select(
        *kept, ids.join_unique("_he", ";", "any_case_null").alias("entrez_id_hgnc"), ids.join_unique("_be", ";", "any_case_null").alias("entrez_id_biomart"),
        F.col("_e.status").alias("entrez_agreement_status"), ids.join_unique("_hu", ";", "any_case_null").alias("uniprot_id_hgnc"),
        ids.join_unique("_bu", ";", "any_case_null").alias("uniprot_id_biomart"), F.col("_u.status").alias("uniprot_agreement_status"),
        mapping.review_flag("_e.status", "_u.status", F.col("_e.value"), F.col("_u.value")).alias("mapping_review_flag"),
        F.array_join(notes, " | ").alias("mapping_notes_crosscheck")), "crosschecked")


# Columns taken from the nomenclature table as (target, source, kind).
# ``text`` copies, ``symbols`` / ``tokens`` re-join pipe lists, ``gene`` and ``entrez`` normalise.
HGNC_COLUMNS = (
    ("hgnc_id", "hgnc_id", "text"), ("hgnc_approved_symbol", "symbol", "text"), ("hgnc_name", "name", "text"),
    ("hgnc_status", "status", "text"), ("hgnc_locus_group", "locus_group", "text"), ("hgnc_locus_type", "locus_type", "text"),
    ("hgnc_previous_symbols", "prev_symbol", "symbols"), ("hgnc_alias_symbols", "alias_symbol", "symbols"),
    ("hgnc_previous_names", "prev_name", "tokens"), ("hgnc_alias_names", "alias_name", "tokens"),
    ("hgnc_gene_group", "gene_group", "text"), ("hgnc_gene_group_id", "gene_group_id", "text"),
    ("hgnc_ensembl_gene_id", "ensembl_gene_id", "gene"), ("hgnc_entrez_id", "entrez_id", "entrez"),
    ("hgnc_uniprot_ids", "uniprot_ids", "tokens"), ("hgnc_refseq_accessions", "refseq_accession", "tokens"),
    ("hgnc_ccds_ids", "ccds_id", "tokens"), ("hgnc_ucsc_id", "ucsc_id", "text"), ("hgnc_mane_select", "mane_select", "text"),
    ("hgnc_omim_ids", "omim_id", "tokens"), ("hgnc_orphanet_ids", "orphanet", "tokens"), ("hgnc_rnacentral_ids", "rna_central_ids", "tokens"),
)


def _hgnc_value(df: DataFrame, source: str, kind: str) -> Column:
    c = F.coalesce(F.col(source), F.lit("")) if source in df.columns else F.lit("")
    if kind == "symbols":
        return ids.join_unique(F.transform(ids.split_pipe(c), F.upper))
    if kind == "tokens":
        return ids.join_unique(ids.split_pipe(c))
    return {"text": c, "gene": ids.strip_version(c), "entrez": ids.norm_entrez(c)}[kind]


def _hgnc_keys(df: DataFrame) -> Column:
    def get(c):
        return F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")

    def key(method, v):
        return F.struct(F.lit(method).alias("method"), v.alias("key"))

    return F.concat(
        F.array(key("ensembl", ids.strip_version(get("ensembl_gene_id"))), key("symbol", ids.norm_symbol(get("symbol"))),
                key("entrez", ids.norm_entrez(get("entrez_id")))),
        F.transform(ids.split_pipe(get("uniprot_ids")), lambda u: key("uniprot", u)))


def match_nomenclature(master: DataFrame, hgnc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nomenclature rows matched to exactly one gene, and the long conflict table.

    Only keys that name one gene count as evidence.
    """
    protein_cols = mapping.existing_columns(master, ["uniprot_id", "uniprot_id_hgnc", "uniprot_id_biomart"])

    def one(method, value):
        return F.struct(F.lit(method).alias("method"), value.alias("key"))

    proteins = F.flatten(F.array(*[ids.split_pipe(c) for c in protein_cols])) if protein_cols else F.array().cast("array<string>")
    keys = F.concat(F.array(one("ensembl", ids.strip_version("ensembl_gene_id")), one("symbol", ids.norm_symbol("gene_symbol")),
                            one("entrez", ids.norm_entrez("entrez_id"))), F.transform(proteins, lambda u: one("uniprot", u)))
    pairs = master.select(F.explode(F.array_distinct(keys)).alias("k"), F.col("ensembl_gene_id").alias("gene")).select("k.*", "gene").where("key <> ''")
    evidence = mapping.evidence_index(pairs).where("lo = hi").select("method", "key", F.col("lo").alias("gene"))
    source = hgnc.withColumn("_src", F.col("file_row"))
    agreed = mapping.agree(source, "_src", _hgnc_keys(source), evidence)
    conflicts = mapping.conflict_candidates(source, "_src", _hgnc_keys(source), evidence).join(
        source.select("_src", *[c for c in ("hgnc_id", "symbol", "ensembl_gene_id", "entrez_id", "uniprot_ids") if c in source.columns]), "_src").drop("_src")
    values = F.struct(*[_hgnc_value(agreed, s, k).alias(t) for t, s, k in HGNC_COLUMNS])
    agreed = materialize(agreed, "agreed")
    matched = agreed.where("status = 'mapped'").groupBy("gene").agg(F.max_by(values, "file_row").alias("h")).select("gene", "h.*")
    return matched, conflicts


def gtf_identifiers(gtf: DataFrame, master: DataFrame, suffix: str) -> DataFrame:
    """Transcript, protein and name sets per master gene from one annotation file."""
    at = F.col("attributes")

    def attr(n):
        return ids.clean(F.coalesce(at[n], F.lit("")))

    rows = gtf.where("n_fields >= 9").select(
        ids.strip_version(attr("gene_id")).alias("gene"), F.upper(attr("gene_name")).alias("name"),
        ids.strip_version(attr("transcript_id")).alias("t"), attr("transcript_version").alias("tv"),
        ids.strip_version(attr("protein_id")).alias("p"), attr("protein_version").alias("pv"))
    known = master.select(F.col("ensembl_gene_id").alias("gene"))
    rows = rows.where("gene <> ''").join(known, "gene", "left_semi").distinct()

    def cell(value, cond):
        return ids.join_unique(F.collect_set(F.when(cond, value)))

    has_t, has_p = F.col("t") != "", F.col("p") != ""
    return rows.groupBy("gene").agg(
        cell(F.col("t"), has_t).alias(f"all_ensembl_transcript_ids_{suffix}"),
        cell(ids.versioned_id("t", "tv"), has_t).alias(f"all_ensembl_transcript_ids_{suffix}_versioned"),
        cell(F.col("p"), has_p).alias(f"all_ensembl_protein_ids_{suffix}"),
        cell(ids.versioned_id("p", "pv"), has_p).alias(f"all_ensembl_protein_ids_{suffix}_versioned"),
        cell(F.col("name"), F.col("name") != "").alias(f"gene_names_{suffix}"))


# Combined mapping columns that the ambiguity report covers.
MAPPING_COLUMNS = ("map_symbols_all map_ensembl_gene_ids_all map_entrez_ids_all map_uniprot_ids_all map_refseq_ids_all map_ccds_ids_all "
                   "map_ensembl_transcript_ids_all map_ensembl_protein_ids_all map_string_protein_ids_all").split()


def finalize(crosschecked: DataFrame, hgnc: DataFrame, gtf_current: DataFrame, gtf_grch37: DataFrame) -> dict[str, DataFrame]:
    """Step 4: nomenclature columns, annotation sets, combined mapping columns and their ambiguity report."""
    matched, conflicts = match_nomenclature(crosschecked, hgnc)
    cur, old = "grch38_current", "grch37"
    wide = crosschecked.withColumn("_g", ids.strip_version("ensembl_gene_id"))
    for part in (matched, gtf_identifiers(gtf_current, crosschecked, cur), gtf_identifiers(gtf_grch37, crosschecked, old)):
        wide = wide.join(part.withColumnRenamed("gene", "_g"), "_g", "left")
    fresh = [c for c in wide.columns if c not in crosschecked.columns and c != "_g"]
    wide = materialize(wide.select(*crosschecked.columns, *[F.coalesce(c, F.lit("")).alias(c) for c in fresh]), "wide")

    def col(c):
        return F.col(c) if c in wide.columns else F.lit("")

    def pipes(*names):
        return F.flatten(F.array(*[ids.split_pipe(col(n)) for n in names]))

    def single(*exprs):
        return F.array(*exprs)

    tx, pr = "all_ensembl_transcript_ids_", "all_ensembl_protein_ids_"
    combined = {
        "map_symbols_all": ids.join_unique(F.transform(F.concat(single(col("gene_symbol"), col("hgnc_approved_symbol")), pipes(
            "hgnc_previous_symbols", "hgnc_alias_symbols", f"gene_names_{cur}", f"gene_names_{old}")), lambda x: ids.norm_symbol(x))),
        "map_ensembl_gene_ids_all": ids.join_unique(single(*[ids.strip_version(col(c)) for c in ("ensembl_gene_id", "ensembl_gene_id_versioned", "hgnc_ensembl_gene_id")])),
        "map_entrez_ids_all": ids.join_unique(single(*[ids.norm_entrez(col(c)) for c in ("entrez_id", "entrez_id_hgnc", "entrez_id_biomart", "hgnc_entrez_id")])),
        "map_uniprot_ids_all": ids.join_unique(pipes("uniprot_id", "uniprot_id_hgnc", "uniprot_id_biomart", "hgnc_uniprot_ids")),
        "map_refseq_ids_all": ids.join_unique(F.concat(pipes("hgnc_refseq_accessions"), ids.tokens_with_prefix(col("hgnc_mane_select"), ids.REFSEQ_PREFIXES))),
        "map_ccds_ids_all": ids.join_unique(pipes("ccdsid", "hgnc_ccds_ids")),
        "map_ensembl_transcript_ids_all": ids.join_unique(F.concat(
            single(ids.strip_version(col("canonical_transcript_id"))), pipes(tx + cur, tx + old),
            F.transform(ids.tokens_with_prefix(col("hgnc_mane_select"), ["ENST"]), lambda x: ids.strip_version(x)))),
        "map_ensembl_transcript_ids_all_versioned": ids.join_unique(F.concat(
            single(ids.clean(col("canonical_transcript_id_versioned"))), pipes(f"{tx}{cur}_versioned", f"{tx}{old}_versioned"))),
        "map_ensembl_protein_ids_all": ids.join_unique(F.concat(single(ids.strip_version(col("canonical_protein_id"))), pipes(pr + cur, pr + old))),
        "map_ensembl_protein_ids_all_versioned": ids.join_unique(F.concat(
            single(ids.clean(col("canonical_protein_id_versioned"))), pipes(f"{pr}{cur}_versioned", f"{pr}{old}_versioned"))),
    }
    out = wide.select("*", *[e.alias(c) for c, e in combined.items()])
    sources = F.array_compact(F.array(
        F.when(F.col("hgnc_id") != "", F.lit("HGNC_complete_set")),
        F.when((F.col(tx + cur) != "") | (F.col(pr + cur) != ""), F.lit("Ensembl_GRCh38_current_GTF")),
        F.when((F.col(tx + old) != "") | (F.col(pr + old) != ""), F.lit("Ensembl_GRCh37_87_GTF"))))
    out = out.withColumn("map_string_protein_ids_all", ids.join_unique(ids.string_protein_ids(ids.split_pipe("map_ensembl_protein_ids_all")))).withColumn(
        "identifier_enrichment_sources", F.array_join(sources, "|"))
    out = materialize(out, "final")

    def tagged(c):
        return F.transform(ids.split_pipe(c), lambda t: F.struct(F.lit(c).alias("mapping_column"), t.alias("id")))

    listed = F.flatten(F.array(*[tagged(c) for c in MAPPING_COLUMNS]))
    pairs = out.select(F.explode(listed).alias("m"), F.col("ensembl_gene_id").alias("gene")).select("m.*", "gene")
    return {"master": out, "ambiguous": mapping.ambiguity_report(pairs, ["mapping_column"]), "conflicts": conflicts}


def numbered(master: DataFrame) -> DataFrame:
    """The table with the 0-based row index that downstream exports refer to."""
    quality.require_columns(master, ["ensembl_gene_id"], "master table")
    return with_row_index(master, ["ensembl_gene_id"], "master_row_index")
