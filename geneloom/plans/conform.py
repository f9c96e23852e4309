"""Conform a vector source to the gene table: one plan per key family.

Every plan takes a source ``[source_key, vector, file_row]`` and the gene table
and returns the same set of tables: ``vectors`` (one row per gene), ``routing``
(one row per source row with its status), ``duplicates`` and ``gate``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, num
from ..operators import mapping, quality, vectors
from ..session import materialize

# Columns listed for every gene of a package.
GENE_OUT = ["ensembl_gene_id", "gene_symbol", "gene_type", "entrez_id", "uniprot_id", "canonical_transcript_id", "canonical_protein_id"]
DUPLICATE_ACTION = "averaged_duplicate_source_rows_mapping_to_same_master_gene"

# Columns of the gene table that carry each key type.
ENTREZ_COLUMNS = ["entrez_id", "hgnc_entrez_id", "map_entrez_ids_all"]
ENTREZ_COLUMNS_WIDE = ["entrez_id", "map_entrez_ids_all", "entrez_id_hgnc", "entrez_id_biomart", "hgnc_entrez_id"]
PROTEIN_COLUMNS = ["uniprot_id", "hgnc_uniprot_ids", "map_uniprot_ids_all"]
GENE_ID_COLUMNS = ["ensembl_gene_id", "hgnc_ensembl_gene_id", "map_ensembl_gene_ids_all", "all_ensembl_gene_ids_all"]
PRIMARY_SYMBOLS = ["gene_symbol", "symbol", "hgnc_symbol"]
ALIAS_SYMBOLS = ["alias_symbol", "alias_symbols", "prev_symbol", "prev_symbols", "hgnc_alias_symbols", "hgnc_prev_symbols", "alias_symbols_hgnc",
                 "prev_symbols_hgnc", "map_gene_symbols_all", "gene_symbols_all", "all_symbols"]


def _pairs(master: DataFrame, columns: list[str], normalise, pattern: str = ids.ANY_SEPARATOR, policy: str = "any_case") -> DataFrame:
    cols = mapping.existing_columns(master, columns)
    if not cols:
        raise ValueError(f"the gene table has none of {columns}")
    tokens = [F.transform(ids.split_tokens(c, pattern, policy), lambda x: normalise(x)) for c in cols]
    return mapping.id_pairs(master, "ensembl_gene_id", tokens)


def gene_columns(master: DataFrame) -> DataFrame:
    """The columns every package lists for its genes, with blanks filled from the nomenclature columns."""
    have = set(master.columns)
    fill = {"entrez_id": ["entrez_id", "hgnc_entrez_id"], "uniprot_id": ["uniprot_id", "hgnc_uniprot_ids"], "gene_symbol": ["gene_symbol", "hgnc_approved_symbol"]}
    return master.select(*[
        ids.first_existing(*[c for c in fill[n] if c in have]).alias(n) if n in fill else
        (F.col(n) if n in have else F.lit("")).alias(n) for n in GENE_OUT])


def finish(routed: DataFrame, master: DataFrame, flags: tuple[str, ...] = quality.GATE_BASIC, examples: int = 10) -> dict[str, DataFrame]:
    """Collapse routed rows ``[source_key, vector, gene, method, status, file_row]`` to the package tables."""
    routed = materialize(routed, "routed")  # read by the vectors, the examples and the reports
    good = routed.where(F.col("status") == mapping.MAPPED)
    extra = [F.array_join(F.array_sort(F.collect_set("method")), ";").alias("mapping_methods"), F.min("file_row").alias("first_row")]
    genes = vectors.vector_mean(good, ["gene"], "vector", extra=extra)
    shown = mapping.source_examples(good, "gene", "file_row", "source_key", examples)
    table = (genes.join(shown, "gene").withColumnRenamed("gene", "ensembl_gene_id").join(gene_columns(master), "ensembl_gene_id")
             .withColumnRenamed("n_source_rows", "source_key_count").withColumn("vector", num.as_float_vector("vector")))
    table = materialize(table, "genes")
    duplicates = table.where("source_key_count > 1").select(
        "ensembl_gene_id", "gene_symbol", "source_key_count", "source_keys_examples", "mapping_methods", F.lit(DUPLICATE_ACTION).alias("action"))
    return {"vectors": table, "routing": routed.drop("vector"), "duplicates": duplicates,
            "gate": quality.gate(table, "ensembl_gene_id", "vector", flags)}


def _routed(source: DataFrame, key: Column, index: DataFrame, method: Column) -> DataFrame:
    return mapping.route(source.withColumn("_key", key), "_key", index).withColumn(
        "method", F.when(F.col("status") == mapping.MAPPED, method)).drop("_key")


def by_protein(source: DataFrame, master: DataFrame) -> dict[str, DataFrame]:
    index = mapping.id_index(_pairs(master, PROTEIN_COLUMNS, ids.canonical_uniprot))
    return finish(_routed(source, ids.canonical_uniprot("source_key"), index, F.lit("uniprot_accession_exact_unique")), master)


def by_component_token(source: DataFrame, master: DataFrame) -> dict[str, DataFrame]:
    """Entrez tokens that may carry the inhibitory prefix; other tokens are excluded."""
    index = mapping.id_index(_pairs(master, ENTREZ_COLUMNS, ids.component_token_id))
    return finish(_routed(source, ids.component_token_id("source_key"), index, ids.component_token_method("source_key")), master)


def by_entrez(source: DataFrame, master: DataFrame) -> dict[str, DataFrame]:
    index = mapping.id_index(_pairs(master, ENTREZ_COLUMNS, ids.norm_entrez_strict))
    return finish(_routed(source, ids.norm_entrez_strict("source_key"), index, F.lit("entrez_id_exact_unique")), master)


def by_entrez_two_step(source: DataFrame, master: DataFrame) -> dict[str, DataFrame]:
    """Mean per Entrez id first, then per gene; ids are every digit run of five columns."""
    cols = mapping.existing_columns(master, ENTREZ_COLUMNS_WIDE)
    index = mapping.id_index(mapping.id_pairs(master, "ensembl_gene_id", [ids.extract_digit_runs(c) for c in cols]))
    per_id = vectors.vector_mean(source, ["source_key"], "vector", extra=[F.min("file_row").alias("file_row")]).drop("n_source_rows")
    return finish(_routed(per_id, F.col("source_key"), index, F.lit("entrez_id_exact_unique")), master)


def by_concept(source: DataFrame, master: DataFrame) -> dict[str, DataFrame]:
    """Concept names of a single Entrez id; multi-id and other concepts are excluded with their own status."""
    index = mapping.id_index(_pairs(master, ["map_entrez_ids_all"], ids.norm_entrez, r"\|", "exact"))
    concept = ids.concept_key("source_key")
    kept = F.when(concept["status"] == "single_entrez", ids.norm_entrez(concept["value"])).otherwise(F.lit(""))
    routed = _routed(source, kept, index, F.lit("entrez_id_exact_unique"))
    status = F.when(concept["status"] != "single_entrez", concept["status"]).when(
        ~num.is_finite("vector"), F.lit("nonfinite_vector")).otherwise(F.col("status"))
    return finish(routed.withColumn("status", status), master)


def _symbol_tiers(master: DataFrame, normalise, pattern: str, policy: str, labels: tuple[str, str, str]) -> list[tuple[str, DataFrame]]:
    groups = (["gene_symbol", "hgnc_approved_symbol"], ["hgnc_previous_symbols"], ["hgnc_alias_symbols"])
    return [(label, _pairs(master, cols, normalise, pattern, policy)) for label, cols in zip(labels, groups)]


# Tier labels as they appear in mapping reports.
UPPER_TIERS = ("direct_current_gene_symbol", "hgnc_previous_symbol", "hgnc_alias_symbol")
EXACT_TIERS = ("symbol_current_or_hgnc_approved_exact_unique", "symbol_hgnc_previous_exact_unique", "symbol_hgnc_alias_exact_unique")
PROTEIN_TIERS = ("direct_canonical_protein_id", "ensembl_grch38_current_gtf_protein_id", "ensembl_grch37_gtf_protein_id")


def _flag_nonfinite(routed: DataFrame) -> DataFrame:
    return routed.withColumn("status", F.when(~num.is_finite("vector"), F.lit("nonfinite_vector")).otherwise(F.col("status")))


def by_symbol(source: DataFrame, master: DataFrame, best_method_only: bool = False) -> dict[str, DataFrame]:
    """Upper-cased symbols over current, previous and alias tiers; ambiguity falls through.

    ``best_method_only`` averages just the rows of the best tier present per gene.
    """
    tiers = _symbol_tiers(master, F.upper, r"\|", "exact", UPPER_TIERS)
    keyed = source.withColumn("_key", ids.norm_symbol("source_key"))
    routed = _flag_nonfinite(mapping.resolve_tiers(keyed, "_key", tiers, stop_on_ambiguity=False).drop("_key"))
    if not best_method_only:
        return finish(routed, master)
    rank = F.array_position(F.array(*[F.lit(x) for x in UPPER_TIERS]), F.col("method")).cast("int")
    ranked = routed.withColumn("tier", F.when(F.col("status") == mapping.MAPPED, rank))
    best = ranked.where("tier IS NOT NULL").groupBy("gene").agg(F.min("tier").alias("_best"))
    marked = ranked.join(best, "gene", "left").withColumn(
        "status", F.when(F.col("tier") > F.col("_best"), F.lit("unused_rescue")).otherwise(F.col("status"))).drop("tier", "_best")
    return finish(marked, master, examples=5)


def by_symbol_or_protein(source: DataFrame, master: DataFrame) -> dict[str, DataFrame]:
    """Protein stable ids go through the protein tiers, all other keys through the symbol tiers."""
    proteins = [(label, _pairs(master, [c], ids.strip_version, r"\|", "exact")) for label, c in zip(
        PROTEIN_TIERS, ("canonical_protein_id", "all_ensembl_protein_ids_grch38_current", "all_ensembl_protein_ids_grch37"))]
    symbols = _symbol_tiers(master, F.upper, r"\|", "exact", UPPER_TIERS)
    keyed = source.withColumn("_key", ids.norm_symbol("source_key"))
    is_protein = F.col("_key").startswith("ENSP")
    a = mapping.resolve_tiers(keyed.where(is_protein).withColumn("_key", ids.strip_version("_key")), "_key", proteins, False)
    b = mapping.resolve_tiers(keyed.where(~is_protein), "_key", symbols, False)
    return finish(_flag_nonfinite(a.unionByName(b).drop("_key")), master)


def by_exact_symbol(source: DataFrame, master: DataFrame) -> dict[str, DataFrame]:
    """Case-sensitive symbols; the first tier that knows a symbol decides, unique or not."""
    tiers = _symbol_tiers(master, lambda x: x, ids.SYMBOL_SEPARATOR, "any_case", EXACT_TIERS)
    keyed = source.withColumn("_key", ids.clean("source_key", "any_case"))
    return finish(mapping.resolve_tiers(keyed, "_key", tiers, stop_on_ambiguity=True).drop("_key"), master)


def by_primary_symbol(source: DataFrame, master: DataFrame) -> dict[str, DataFrame]:
    """Upper-cased symbols where a primary use hides alias uses of the same token."""
    parts = []
    for kind, cols in (("primary", PRIMARY_SYMBOLS), ("alias", ALIAS_SYMBOLS)):
        present = mapping.existing_columns(master, cols)
        if present:
            parts.append(_pairs(master, present, F.upper, r"[;,|]", "trim").withColumn("kind", F.lit(kind)))
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionByName(p)
    index = mapping.primary_over_alias(pairs)
    routed = mapping.route(source.withColumn("_key", F.upper("source_key")), "_key", index.select("id", "gene", "n_genes"))
    kinds = index.select(F.col("id").alias("_key"), F.col("kind").alias("method"))
    return finish(routed.join(kinds, "_key", "left").drop("_key"), master)


def by_gene_id(source: DataFrame, master: DataFrame, columns: list[str] | None = None, whole_suffix: bool = False) -> dict[str, DataFrame]:
    """Gene stable ids; keys of another kind are excluded."""
    norm = ids.strip_version if whole_suffix else (lambda c: ids.strip_version_suffix(ids.clean(c, "any_case")))
    pairs = _pairs(master, columns or GENE_ID_COLUMNS, norm).where(F.col("id").startswith("ENSG"))
    key = norm(F.col("source_key"))
    kept = F.when(key.startswith("ENSG"), key).otherwise(F.lit(""))
    return finish(_routed(source, kept, mapping.id_index(pairs), F.lit("ensembl_gene_id_exact_unique")), master)


def by_token_table(master: DataFrame, tokens: DataFrame, weights: DataFrame, specials: list[int]) -> dict[str, DataFrame]:
    """Driven by the gene table: exact id, then unversioned id, then the vector of the token."""
    named = mapping.exact_then_stripped(master.select("ensembl_gene_id"), "ensembl_gene_id", tokens, "token", "token_id",
                                        "missing_genecompass_token", "mapped_exact_ensembl_gene_id", "mapped_stripped_ensembl_gene_id")
    joined = named.join(weights, "token_id", "left")
    found = F.col("token_id").isNotNull()
    report = joined.withColumn("status", F.when(found & F.col("vector").isNull(), F.lit("invalid_token_id")).when(
        found & F.col("token_id").isin(*(specials or [-1])), F.lit("special_token_not_gene")).otherwise(F.col("status")))
    kept = report.where(F.col("status").startswith("mapped_")).withColumn("vector", num.as_float_vector("vector"))
    return {"vectors": kept.join(gene_columns(master), "ensembl_gene_id"), "routing": report.drop("vector"),
            "gate": quality.gate(kept, "ensembl_gene_id", "vector", quality.GATE_TOKEN, token="token_id")}


def gather_tokens(vocabulary: DataFrame, weights: DataFrame) -> DataFrame:
    """Usable gene tokens ``[source_key, vector, file_row]`` of a vocabulary and its weight table."""
    usable = vocabulary.where(~ids.is_special_token("token") & F.col("token_id").isNotNull() & (F.col("token_id") >= 0)).distinct()
    return usable.join(weights, "token_id").select(F.col("token").alias("source_key"), "vector", F.col("token_id").alias("file_row"))


def offset_segment(rows: DataFrame, species: str, offsets: dict[str, int], total: int) -> tuple[DataFrame, DataFrame]:
    """Token-aligned rows ``[..., row_no]`` of one species and the trailing rows without a token.

    Row ``i`` of the species owns token ``start + i`` up to the next larger offset.
    """
    if species not in offsets:
        raise ValueError(f"no offset for {species}")
    start = offsets[species]
    stop = min([v for v in offsets.values() if v > start], default=total)
    n = rows.count()
    if stop - start > n:
        raise ValueError(f"{stop - start} tokens but only {n} rows for {species}")
    return (rows.where(F.col("row_no") < stop - start).withColumn("token_id", F.col("row_no") + start),
            rows.where(F.col("row_no") >= stop - start))


@dataclass(frozen=True)
class Package:
    """How a published package is read and mapped."""

    name: str
    scan: str
    plan: str


def _family(prefix: str, names: str, scan: str, plan: str) -> list[Package]:
    return [Package(f"{prefix}{n}", scan, plan) for n in names.split()]


# Package names with their source format and mapping plan.
PACKAGES = {p.name: p for p in [
    *_family("probe_", "aac albert apaac bert_bfd bert_pfam blast cpc_prot esmb1 gene2vec_uniprot hmmer ksep learned_vec mut2vec pfam protvec "
             "seqvec t5 tcga_embedding unirep xlnet", "read_entry_vectors", "by_protein"),
    *_family("newt_", "archs4_256 cellnet collectri dorothea go_256 go_graph msigdb_bundle", "read_sniffed_vectors", "by_component_token"),
    *_family("bioconceptvec_", "cbow fasttext glove skipgram", "read_json_vectors", "by_concept"),
    Package("esm2", "read_repaired_matrix", "by_entrez"),
    Package("frogs_archs4_256", "read_headerless_vectors", "by_entrez_two_step"),
    Package("gene2vec", "read_word_vectors", "by_symbol"),
    Package("genept_ada", "read_pickled_dictionary", "by_symbol_best"),
    Package("genept_model3_gene_protein", "read_pickled_dictionary", "by_symbol_best"),
    Package("mashup_string", "read_dense_rows", "by_symbol_or_protein"),
    Package("geneformer_v2_316m", "read_checkpoint_table", "by_gene_id"),
    Package("genecompass_base_gene_token", "read_checkpoint_table", "by_token_table"),
    Package("scgpt_whole_human", "read_checkpoint_table", "by_exact_symbol"),
    Package("scgpt_pancancer", "read_checkpoint_table", "by_primary_symbol"),
    Package("scfoundation_gene_pos", "read_checkpoint_table", "by_exact_symbol"),
    Package("scprint_medium_v1_5_gene", "read_checkpoint_table", "by_scprint_id"),
    Package("uce_33l", "read_checkpoint_table", "by_exact_symbol"),
]}

PLANS = {
    "by_protein": by_protein, "by_component_token": by_component_token, "by_entrez": by_entrez, "by_entrez_two_step": by_entrez_two_step,
    "by_concept": by_concept, "by_symbol": by_symbol, "by_symbol_best": lambda s, m: by_symbol(s, m, best_method_only=True),
    "by_symbol_or_protein": by_symbol_or_protein, "by_exact_symbol": by_exact_symbol, "by_primary_symbol": by_primary_symbol,
    "by_gene_id": by_gene_id, "by_scprint_id": lambda s, m: by_gene_id(s, m, ["ensembl_gene_id"], whole_suffix=True),
}


def conform(package: str, source: DataFrame, master: DataFrame) -> dict[str, DataFrame]:
    """Run the mapping plan of a named package on a scanned source."""
    return PLANS[PACKAGES[package].plan](source, master)
