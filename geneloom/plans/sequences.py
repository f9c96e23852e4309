"""Plans that prepare gene sequences and texts and embed them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, seq
from ..models.specs import SPECS
from ..operators import inference, mapping, quality
from ..session import materialize

GENE_HEAD = ["ensembl_gene_id", "gene_symbol", "entrez_id", "uniprot_id", "canonical_transcript_id", "canonical_transcript_id_versioned"]


def coding_sequences(master: DataFrame, cds_records: DataFrame) -> DataFrame:
    """Report of every gene with its coding sequence, lookup rule and status."""
    found = mapping.transcript_lookup(master, "ensembl_gene_id", "canonical_transcript_id_versioned", "canonical_transcript_id",
                                      cds_records.withColumn("sequence", seq.clean_dna("sequence")), "record_id", "file_row", "sequence")
    out = master.select(*[c for c in GENE_HEAD if c in master.columns]).join(found, "ensembl_gene_id", "left")
    have = F.coalesce(F.length("sequence"), F.lit(0)) > 0
    return (out.withColumn("cds_length_nt", F.coalesce(F.length("sequence"), F.lit(0)))
            .withColumn("status", F.when(have | F.col("source_id").isNotNull(), F.lit("mapped")).otherwise(F.lit("missing_cds_sequence")))
            .withColumn("source_id", F.coalesce("source_id", F.lit(""))).withColumn("method", F.coalesce("method", F.lit(""))))


def coding_headers(report: DataFrame) -> DataFrame:
    """``[header, sequence]`` of the mapped coding sequences for a FASTA sink."""
    return report.where("cds_length_nt > 0").select(F.concat_ws(
        "|", "ensembl_gene_id", "gene_symbol", "source_id", F.concat(F.lit("cds_length_nt="), "cds_length_nt")).alias("header"), "sequence")


def marked_transcripts(master: DataFrame, cdna_records: DataFrame, cds: DataFrame) -> DataFrame:
    """Full transcripts with codon-marked coding region; ``cds`` is ``[ensembl_gene_id, sequence]``."""
    cdna = mapping.transcript_lookup(master, "ensembl_gene_id", "canonical_transcript_id_versioned", "canonical_transcript_id",
                                     cdna_records.withColumn("sequence", seq.clean_dna("sequence")), "record_id", "file_row", "sequence")
    base = (master.select(*[c for c in GENE_HEAD if c in master.columns])
            .join(cdna.withColumnRenamed("sequence", "cdna"), "ensembl_gene_id", "left")
            .join(cds.select("ensembl_gene_id", seq.clean_dna("sequence").alias("cds")), "ensembl_gene_id", "left"))
    hit = base.withColumn("h", seq.locate_cds("cdna", "cds")).select("*", "h.status", F.col("h.start0").alias("cds_start_0based"),
                                                                    F.col("h.stop0").alias("cds_end_0based_exclusive")).drop("h")
    mapped = F.col("status").startswith("mapped")
    out = hit.withColumn("input", F.when(mapped, seq.marked_transcript("cdna", "cds_start_0based", "cds_end_0based_exclusive")))
    return (out.withColumn("rna", F.when(mapped, seq.dna_to_rna("cdna")))
            .withColumn("mrna_length_nt", F.coalesce(F.length("cdna"), F.lit(0))).withColumn("cds_length_nt", F.coalesce(F.length("cds"), F.lit(0)))
            .withColumn("input_length", F.coalesce(F.length("input"), F.lit(0)))
            .withColumn("mapping_method", F.when(mapped, F.concat("method", F.lit("__cds_substring_match"))).otherwise(F.lit("")))
            .drop("cdna", "cds", "method"))


def longest_valid_rna(records: DataFrame, master: DataFrame, header: str = "header", sequence: str = "sequence") -> dict[str, DataFrame]:
    """Cleaned RNA per master gene, the longest of several; invalid records are counted."""
    rows = records.select(ids.find_gene_id(header).alias("ensembl_gene_id"), ids.find_transcript_id(header).alias("transcript_id"),
                          seq.clean_rna(sequence).alias("sequence"), "file_row").where("ensembl_gene_id <> ''")
    good = rows.where(seq.valid_rna("sequence")).join(master.select("ensembl_gene_id"), "ensembl_gene_id", "left_semi")
    best = F.min_by(F.struct("transcript_id", "sequence"), F.struct(-F.length("sequence"), "file_row")).alias("b")
    out = good.groupBy("ensembl_gene_id").agg(best, F.count(F.lit(1)).alias("n_records")).select(
        "ensembl_gene_id", "b.transcript_id", "b.sequence", F.length("b.sequence").alias("sequence_length"), "n_records")
    return {"sequences": out, "missing": master.select("ensembl_gene_id").join(out, "ensembl_gene_id", "left_anti"),
            "stats": rows.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(~seq.valid_rna("sequence")).alias("n_invalid"))}


def protein_jobs(master: DataFrame, protein_index: DataFrame) -> DataFrame:
    """First protein accession of each gene that has a sequence; no ambiguity check, genes may share one."""
    preferred = ["uniprot_id", "uniprot", "uniprot_accession"]
    cols = quality.columns_containing(master, preferred, ["uniprot"])
    tokens = F.flatten(F.array(*[ids.split_tokens(c, r"[|,; ]+", "trim") for c in cols]))
    candidates = F.array_distinct(F.flatten(F.transform(tokens, lambda x: F.array(x, ids.base_accession(x)))))
    picked = mapping.first_match(master, "ensembl_gene_id", candidates, protein_index, "accession")
    out = picked.select("ensembl_gene_id", F.col("matched_key").alias("accession")).join(protein_index, "accession")
    out = out.withColumn("sequence", seq.clean_protein("sequence")).withColumn("sequence_length", F.length("sequence"))
    return out.where("sequence <> ''")


def summary_jobs(master: DataFrame, summaries: DataFrame) -> DataFrame:
    """First of current, approved and all symbols that has a summary text, with the column it came from."""
    named = [c for c in ("gene_symbol", "hgnc_approved_symbol") if c in master.columns]
    head = F.array(*[F.upper(ids.strip(c)) for c in named])
    more = F.transform(ids.split_tokens("map_symbols_all", r"\|", "trim"), F.upper) if "map_symbols_all" in master.columns else F.array().cast("array<string>")
    picked = mapping.first_match(master, "ensembl_gene_id", F.concat(head, more), summaries, "key")
    source = F.coalesce(F.get(F.array(*[F.lit(c) for c in named]), F.col("matched_position")), F.lit("map_symbols_all_fallback"))
    return picked.select("ensembl_gene_id", F.col("matched_key").alias("key"), source.alias("summary_mapping_source")).join(summaries, "key").select(
        "ensembl_gene_id", F.col("key").alias("summary_key"), "summary_mapping_source", F.col("text").alias("summary_text"))


def embed_sequences(jobs: DataFrame, model: str, load_model: Callable[[], object], text: str = "sequence", retries: int = 1) -> dict[str, DataFrame]:
    """Vectors, failures, one outcome per gene and gate of one sequence or text model."""
    spec = SPECS[model]
    todo = jobs
    if model == "helix_mrna":
        todo = todo.withColumn(text, seq.clean_marked_rna(text))
    pieces = inference.cut(todo, "ensembl_gene_id", text, spec)
    done = materialize(inference.embed_pieces(pieces, "ensembl_gene_id", spec, load_model, retries), "pieces")
    pooled = inference.pool(done, "ensembl_gene_id", spec)
    return {"vectors": pooled, "failures": inference.failures(done, "ensembl_gene_id"),
            "outcomes": inference.outcomes(todo, done, "ensembl_gene_id"),
            "gate": quality.gate(pooled, "ensembl_gene_id", "vector", quality.GATE_BASIC)}
