"""Gene pipelines on tiny inputs with results worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geneloom.models.stub import LetterModel, WordHashModel
from geneloom.plans import annotations, conform, context, genome, master as gm, network, sequences, tabular
from geneloom.sources import bio
from geneloom.streaming import incremental


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def vec(df, key="ensembl_gene_id"):
    return {r[key]: [float(x) for x in r["vector"]] for r in df.collect()}


def source(spark, items):
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(items)], "source_key string, vector array<double>, file_row int")


def test_component_tokens(spark, master):
    out = conform.conform("newt_cellnet", source(spark, [("1", [1.0, 3.0]), ("1.0", [3.0, 5.0]), ("20", [9.0, 9.0]), ("inhib_2", [0.0, 0.0]), ("ABC", [1.0, 1.0])]), master)
    assert vec(out["vectors"]) == {"ENSG1": [2.0, 4.0], "ENSG2": [0.0, 0.0]}
    assert [r[1] for r in rows(out["routing"], "file_row", "status")] == ["mapped", "mapped", "ambiguous", "mapped", "excluded"]
    assert rows(out["duplicates"], "ensembl_gene_id", "source_key_count", "source_keys_examples") == [("ENSG1", 2, "1;1.0")]
    assert out["gate"].first()["n_zero_vectors"] == 1 and out["gate"].first()["status"] != "processed_qc_passed"


def test_protein_and_concept_and_symbols(spark, master):
    assert vec(conform.conform("probe_aac", source(spark, [("p3-9", [1.0]), ("P1", [2.0]), ("Q", [3.0])]), master)["vectors"]) == {"ENSG3": [1.0], "ENSG1": [2.0]}
    out = conform.conform("bioconceptvec_cbow", source(spark, [("Gene_1", [1.0]), ("Gene_1_2", [2.0]), ("Disease_1", [3.0]), ("Gene_20", [4.0])]), master)
    assert vec(out["vectors"]) == {"ENSG1": [1.0]}
    assert [r[1] for r in rows(out["routing"], "file_row", "status")] == ["mapped", "multi_entrez", "non_gene", "ambiguous"]
    out = conform.conform("gene2vec", source(spark, [("aaa", [1.0]), ("Y", [2.0]), ("X", [3.0]), ("OLD2", [4.0]), ("Q", [float("nan")])]), master)
    assert vec(out["vectors"]) == {"ENSG1": [1.0], "ENSG2": [3.0]}
    best = conform.conform("genept_ada", source(spark, [("BBB", [1.0]), ("Y", [9.0]), ("OLD2", [9.0])]), master)
    assert vec(best["vectors"]) == {"ENSG2": [1.0]}
    assert [r[1] for r in rows(best["routing"], "file_row", "status")] == ["mapped", "unused_rescue", "unused_rescue"]
    exact = conform.conform("scgpt_whole_human", source(spark, [("aaa", [1.0]), ("AAA", [2.0])]), master)
    assert vec(exact["vectors"]) == {"ENSG1": [2.0]}
    prim = conform.conform("scgpt_pancancer", source(spark, [("bbb", [1.0]), ("x", [2.0]), ("z", [3.0])]), master)
    assert vec(prim["vectors"]) == {"ENSG2": [1.0], "ENSG3": [3.0]}
    ens = conform.conform("geneformer_v2_316m", source(spark, [("ENSG2.7", [1.0]), ("MT1", [2.0])]), master)
    assert vec(ens["vectors"]) == {"ENSG2": [1.0]}
    two = conform.conform("frogs_archs4_256", source(spark, [("2", [1.0]), ("2", [3.0]), ("20", [9.0])]), master)
    assert vec(two["vectors"]) == {"ENSG2": [2.0]}


def test_token_table_plan(spark, master):
    tokens = spark.createDataFrame([("ENSG1", 0), ("ENSG2", 1), ("ENSG3", 7)], "token string, token_id bigint")
    weights = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "token_id bigint, vector array<float>")
    out = conform.by_token_table(master, tokens, weights, [1])
    assert vec(out["vectors"]) == {"ENSG1": [1.0]}
    assert [r[1] for r in rows(out["routing"], "ensembl_gene_id", "status")] == ["mapped_exact_ensembl_gene_id", "special_token_not_gene", "invalid_token_id"]
    seg = spark.range(5).select(F.col("id").alias("row_no"))
    kept, left = conform.offset_segment(seg, "human", {"human": 10, "mouse": 13}, 99)
    assert kept.count() == 3 and left.count() == 2 and kept.agg(F.max("token_id")).first()[0] == 12


GTF = """chr1\tH\tgene\t100\t500\t.\t+\t.\tgene_id "ENSG1.3"; gene_type "protein_coding"; gene_name "AAA"; level 2;
chr1\tH\ttranscript\t100\t500\t.\t+\t.\tgene_id "ENSG1.3"; transcript_id "T1.1"; gene_type "protein_coding"; transcript_type "protein_coding"; tag "appris_principal_1"; transcript_support_level "1";
chr1\tH\texon\t100\t199\t.\t+\t.\tgene_id "ENSG1.3"; transcript_id "T1.1"; gene_type "protein_coding"; transcript_type "protein_coding"; exon_number 1; protein_id "E1.4";
chr1\tH\texon\t300\t399\t.\t+\t.\tgene_id "ENSG1.3"; transcript_id "T1.1"; gene_type "protein_coding"; transcript_type "protein_coding"; exon_number 2;
chr1\tH\ttranscript\t100\t500\t.\t+\t.\tgene_id "ENSG1.3"; transcript_id "T2.1"; gene_type "protein_coding"; transcript_type "protein_coding"; tag "MANE_Select"; transcript_support_level "5";
chr1\tH\texon\t100\t109\t.\t+\t.\tgene_id "ENSG1.3"; transcript_id "T2.1"; gene_type "protein_coding"; transcript_type "protein_coding"; exon_number 1;
chr2\tH\tgene\t1\t9\t.\t-\t.\tgene_id "ENSG2.1"; gene_type "lncRNA"; gene_name "NC";
"""


@pytest.fixture()
def gtf(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(GTF)
    return bio.read_gtf(spark, str(tmp_path / "a.gtf"))


def test_master_steps(spark, gtf):
    base = gm.build_base_table(gtf)
    r = base.collect()
    assert len(r) == 1 and (r[0]["canonical_transcript_id"], r[0]["canonical_selection_rule"], r[0]["exon_length"]) == ("T2", "MANE_Select", "10")
    t1 = gm.build_base_table(gtf.where(~F.coalesce(F.col("attributes")["transcript_id"], F.lit("")).startswith("T2"))).first()
    assert (t1["canonical_transcript_id"], t1["canonical_selection_rule"], t1["exon_length"], t1["canonical_protein_id_versioned"]) == (
        "T1", "appris_principal_1", "200", "E1.4")
    hits = spark.createDataFrame([('{"query":"ENSG1","entrezgene":7,"uniprot":{"Swiss-Prot":"P1"},"ensembl":{"gene":"ENSG1"}}', 1)], "hit string, file_row int")
    enriched = gm.enrich_ids(base, hits)
    e = enriched.first()
    assert (e["entrez_id"], e["uniprot_id"], e["id_mapping_status"]) == ("7", "P1", "mapped_exact_ensembl; mapped_entrez; mapped_reviewed_swissprot")
    assert gm.enrichment_counts(enriched).first()["mapped_both"] == 1
    hgnc = spark.createDataFrame([("HGNC:1", "AAA", "OLD1|old2", "", "ENSG1", "8", "P1|P9", "NM_1", "ENST7.1|NM_2", 1)],
                                 "hgnc_id string, symbol string, prev_symbol string, alias_symbol string, ensembl_gene_id string, entrez_id string, "
                                 "uniprot_ids string, refseq_accession string, mane_select string, file_row int")
    mart = spark.createDataFrame([("ENSG1", "8", "P1", "")], "`Gene stable ID` string, entrezgene_id string, uniprotswissprot string, uniprotsptrembl string")
    crossed = gm.crosscheck_ids(enriched, hgnc, mart)
    c = crossed.first()
    assert (c["entrez_agreement_status"], c["uniprot_agreement_status"], c["mapping_review_flag"]) == ("conflict", "agreement", "conflict")
    assert c["mapping_notes_crosscheck"] == "entrez: current=7; external=8"
    final = gm.finalize(crossed, hgnc, gtf, gtf)
    f = final["master"].first()
    assert f["hgnc_previous_symbols"] == "OLD1|OLD2" and f["map_symbols_all"] == "AAA|OLD1|OLD2"
    assert f["map_entrez_ids_all"] == "7|8" and f["map_refseq_ids_all"] == "NM_1|NM_2"
    assert f["map_ensembl_transcript_ids_all"] == "ENST7|T1|T2"
    assert f["identifier_enrichment_sources"] == "HGNC_complete_set|Ensembl_GRCh38_current_GTF|Ensembl_GRCh37_87_GTF"
    assert final["conflicts"].count() == 0 and final["ambiguous"].count() == 0
    assert len(final["master"].columns) == 26 + 2 + 8 + 44


def test_splice_sites_and_windows(spark):
    ex = spark.createDataFrame([(t, s, a, b) for t, s in (("p", "+"), ("m", "-")) for a, b in ((10, 20), (30, 40), (50, 60))],
                               "t string, strand string, start bigint, stop bigint")
    got = rows(genome.splice_sites(ex, "t"), "t", "site_type", "site_1based")
    assert [x for x in got if x[0] == "p"] == [("p", "acceptor", 30), ("p", "acceptor", 50), ("p", "donor", 20), ("p", "donor", 40)]
    assert [x for x in got if x[0] == "m"] == [("m", "acceptor", 20), ("m", "acceptor", 40), ("m", "donor", 30), ("m", "donor", 50)]
    chrom = spark.createDataFrame([("c", "ACGTACGTAC" * 3)], "chromosome string, sequence string")
    sites = spark.createDataFrame([(1, "c", -2, 5, 30), (2, "c", 8, 22, 30), (3, "c", 27, 33, 30)], "k int, chromosome string, a bigint, b bigint, chrom_length int")
    w = dict(rows(genome.genome_windows(sites, "k", genome.chromosome_tiles(chrom, 7), "a", "b", 7)))
    assert w == {1: "NNACGTA", 2: "ACACGTACGTACAC", 3: "TACNNN"}


def test_start_site_plan(spark):
    m = spark.createDataFrame([("a", "c", "101", "200", "+"), ("b", "c", "101", "1200.0", "-"), ("d", "x", "1", "2", "+"), ("e", "c", "q", "2", "+"), ("f", "c", "1", "2", ".")],
                              "ensembl_gene_id string, chromosome string, gene_start string, gene_end string, strand string")
    ch = spark.createDataFrame([("c", 2000)], "chromosome string, chrom_length bigint")
    got = {r["ensembl_gene_id"]: (r["tss_1based"], r["window_status"]) for r in genome.bounded_windows(genome.start_sites(m, ch)).collect()}
    assert got == {"a": (101, "window_out_of_bounds"), "b": (1200, "ok"), "d": (None, "chromosome_not_in_fasta"), "e": (None, "invalid_coordinates"), "f": (None, "invalid_strand")}


def gene_table(spark):
    return spark.createDataFrame([(f"ENSG{i}", f"S{i}", "protein_coding", str(i), f"P{i}") for i in range(1, 6)],
                                 "ensembl_gene_id string, gene_symbol string, gene_type string, entrez_id string, uniprot_id string")


def test_expression_plan(spark):
    gct = spark.createDataFrame([("ENSG1.1", "a", "1", "5", 1), ("ENSG1.2", "b", "3", "5", 2), ("ENSG2.1", "c", "x", "5", 3)],
                                "Name string, Description string, t1 string, t2 string, file_row int")
    out = tabular.expression_vectors(gct, gene_table(spark))
    assert vec(out["vectors"]) == {"ENSG1": [1.0, 0.0], "ENSG2": [-1.0, 0.0]} and out["unmapped"].count() == 3


def test_protein_level_and_location_plans(spark):
    ihc = spark.createDataFrame([("ENSG1", "n", "t", "c", lev, "r", i) for i, lev in enumerate(["Low", "High", "Ascending"])] + [("ENSG2", "n", "u", "c", "Medium", "r", 9)],
                                "Gene string, `Gene name` string, Tissue string, `Cell type` string, Level string, Reliability string, file_row int")
    out = tabular.protein_level_vectors(ihc, gene_table(spark))
    assert vec(out["vectors"]) == {"ENSG1": [1.0, -1.0], "ENSG2": [-1.0, 1.0]}
    assert rows(out["excluded_levels"]) == [("Ascending", 1)]
    sub = spark.createDataFrame([("ENSG1", "n", "r", "A;B", "", "", 1), ("ENSG2", "n", "r", "", " B ", "A", 2), ("ENSG3", "n", "r", "", "", "", 3)],
                                "Gene string, `Gene name` string, Reliability string, `Main location` string, `Additional location` string, `Extracellular location` string, file_row int")
    v = vec(tabular.location_vectors(sub, gene_table(spark))["vectors"])
    assert v["ENSG1"] == v["ENSG2"] and np.allclose(v["ENSG3"], [-np.sqrt(2)] * 2)


def test_dependency_plan(spark):
    eff = spark.createDataFrame([("m1", "1", "2", "", "9"), ("m2", "3", "6", "4", "9"), ("m3", "5", "1", "4", "9")],
                                "ModelID string, `A (1)` string, `B (2)` string, `C (3)` string, bad string").select(
        "ModelID", *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in ("A (1)", "B (2)", "C (3)", "bad")])
    out = tabular.dependency_vectors(eff, gene_table(spark), "ModelID", k=2)
    x = np.array([[1, 3, 5], [2, 6, 1], [4, 4, 4]], float)
    z = (x - x.mean(0)) / x.std(0)
    s = np.linalg.svd(z, compute_uv=False)
    got = np.array([v for _, v in sorted(vec(out["vectors"]).items())])
    assert np.allclose((got ** 2).sum(0), s[:2] ** 2) and out["unmapped"].count() == 2


def test_context_vectors_plan(spark):
    r = spark.createDataFrame([("1", "global", [1.0]), ("1", "liver", [2.0]), ("1", "skin", [4.0]), ("2", "liver", [7.0])], "entrez_id string, tissue string, embedding array<double>")
    out = tabular.context_vectors(r.withColumn("file_row", F.monotonically_increasing_id()), gene_table(spark))
    assert vec(out["global"], "gene") == {"ENSG1": [1.0]} and vec(out["mean"], "gene") == {"ENSG1": [3.0], "ENSG2": [7.0]}


def test_entity_and_exact_plans(spark):
    ent = spark.createDataFrame([("Gene::1", 0), ("Gene::x", 1), ("Drug::1", 2), ("Gene::99", 3)], "name string, index bigint")
    mat = spark.createDataFrame([(i, [float(i), 1.0 + i * i]) for i in range(4)], "row bigint, vector array<float>")
    out = tabular.entity_vectors(ent, mat, gene_table(spark))
    assert vec(out["vectors"], "gene") == {"ENSG1": [0.0, 1.0]}
    assert [x[1] for x in rows(out["routing"], "name", "status")] == ["mapped", "unmapped", "non_numeric_gene_identifier"]
    with pytest.raises(ValueError):
        tabular.entity_vectors(ent.where("index < 3 AND index <> 1"), mat, gene_table(spark))
    with pytest.raises(ValueError):
        tabular.exact_id_vectors(spark.createDataFrame([("ENSG1", [1.0])], "gene_id string, vector array<float>"), gene_table(spark), 1)


def test_relation_context(spark):
    e = spark.createDataFrame([("r", "d", "1", "gene/protein", "A", "x", "drug", "X"), ("r", "d", "x", "drug", "X", "1", "gene/protein", "A"),
                               ("r", "d", "1", "gene/protein", "A", "2", "gene/protein", "B"), ("r", "d", "2", "gene/protein", "B", "y", "drug", "Y"),
                               ("q", "d", "3", "gene/protein", "C", "y", "drug", "Y"), ("q", "d", "3", "gene/protein", "C", "z", "drug", "Z")],
                              "relation string, display_relation string, x_id string, x_type string, x_name string, y_id string, y_type string, y_name string")
    parts = context.relation_features(e)
    assert rows(parts["matrix"]) == [("1", "r||d||drug||x", 2.0), ("2", "r||d||drug||y", 1.0), ("3", "q||d||drug||y", 1.0), ("3", "q||d||drug||z", 1.0)]
    assert tuple(parts["edge_counts"].first()) == (6, 5, 1, 0)
    out = context.context_vectors(parts, gene_table(spark), k=2)
    assert out["vectors"].count() == 3 and out["unmapped_master"].count() == 2 and out["unmapped_source"].count() == 0
    nodes = spark.createDataFrame([("Gene::1", "A", "Gene"), ("Bio::x", "X", "Process")], "id string, name string, kind string")
    edges = spark.createDataFrame([("Gene::1", "GpB", "Bio::x"), ("Bio::y", "BpG", "Gene::2"), ("Gene::1", "GiG", "Gene::2")], "source_id string, metaedge string, target_id string")
    assert rows(context.metaedge_features(nodes, edges)["matrix"]) == [("1", "GpB||source||Process||Bio::x", 1.0), ("2", "BpG||target||Bio||Bio::y", 1.0)]


def test_annotation_vectors(spark):
    g = [(f"P{i}", f"GO:{j}") for i in range(1, 5) for j in range(i, i + 3)]
    gaf = spark.createDataFrame([("UniProtKB", a, "S", "x", t, "IEA", "P", 17, i) for i, (a, t) in enumerate(g)] + [("UniProtKB", "P1", "S", "NOT", "GO:9", "IEA", "P", 17, 99)],
                                "db string, accession string, symbol string, qualifier string, go_id string, evidence string, aspect string, n_fields int, file_row int")
    assert annotations.annotation_accounting(gaf).first()["negated"] == 1
    out = annotations.process_term_vectors(gaf, gene_table(spark), k=2)
    assert out["vectors"].count() == 4 and all(len(v) == 2 for v in vec(out["vectors"], "gene").values())
    terms = spark.createDataFrame([(f"GO:{i}", f"term number {i}", "bp", "", [], [f"GO:{i + 1}"]) for i in range(1, 8)],
                                  "term_id string, name string, namespace string, definition string, synonyms array<string>, parents array<string>")
    on = annotations.ontology_vectors(gaf, terms, gene_table(spark), dim=4, window=3)
    assert on["vectors"].count() == 4
    z = np.array(list(vec(on["vectors"], "gene").values()))
    assert np.allclose(z.mean(0), 0, atol=1e-5) and np.allclose(z.std(0), 1, atol=1e-4)
    s = on["stats"].first()
    assert s["total_rows"] == s["skipped_not"] + s["kept"] + s["skipped_bad"]


def test_network_plans(spark, monkeypatch):
    links = spark.createDataFrame([("9606.E1", "9606.E2", 900, 0, 10), ("9606.E2", "9606.E3", 500, 0, 20), ("9606.E3", "9606.E4", 300, 0, 30), ("9606.E4", "9606.E1", 200, 400, 40)],
                                  "protein1 string, protein2 string, neighborhood int, fusion int, file_row int")
    for c in ("cooccurence", "coexpression", "experimental", "database", "textmining"):
        links = links.withColumn(c, F.lit(0) + F.col("neighborhood"))
    links = links.withColumn("fusion", F.col("neighborhood"))
    info = spark.createDataFrame([(f"9606.E{i}", f"s{i}") for i in range(1, 5)], "node string, preferred string")
    aliases = spark.createDataFrame([("9606.E1", "1", "KEGG_GeneID"), ("9606.E2", "3", "Ensembl_HGNC_entrez_id"), ("9606.E3", "3", "other")], "node string, alias string, source string")
    m = gene_table(spark)
    routed = {r["node"]: (r["gene"], r["status"]) for r in network.map_network_nodes(info, info, aliases, m).collect()}
    assert routed == {"9606.E1": ("ENSG1", "mapped"), "9606.E2": (None, "ambiguous"), "9606.E3": ("ENSG3", "mapped"), "9606.E4": ("ENSG4", "mapped")}
    monkeypatch.setattr(network.graph, "LINK_CHANNELS", ("neighborhood", "fusion"))
    out = network.fused_network_vectors(links, info, aliases, m, per_channel=2, final=2)
    assert set(vec(out["vectors"], "gene")) == {"ENSG1", "ENSG3", "ENSG4"}
    e = spark.createDataFrame([("1", "2"), ("2", "3.0"), ("3", "1"), ("4", "4"), ("x", "1")], "gene1 string, gene2 string")
    w = network.walk_vectors(e, m, walks=2, length=6, dim=4, window=2)
    assert set(vec(w["vectors"], "gene")) == {"ENSG1", "ENSG2", "ENSG3"}


def test_sequence_plans(spark):
    m = spark.createDataFrame([("ENSG1", "A", "T1", "T1.2"), ("ENSG2", "B", "T2", ""), ("ENSG3", "C", "T3", "T3.1")],
                              "ensembl_gene_id string, gene_symbol string, canonical_transcript_id string, canonical_transcript_id_versioned string")
    rec = spark.createDataFrame([("T1.2", "ATGAAA", 1), ("T1.2", "GGG", 2), ("T2.9", "ATGC", 3)], "record_id string, sequence string, file_row int")
    cds = sequences.coding_sequences(m, rec)
    assert rows(cds, "ensembl_gene_id", "status", "cds_length_nt") == [("ENSG1", "mapped", 6), ("ENSG2", "mapped", 4), ("ENSG3", "missing_cds_sequence", 0)]
    cdna = spark.createDataFrame([("T1.2", "CCATGAAAG", 1), ("T2.1", "GGGG", 2)], "record_id string, sequence string, file_row int")
    t = {r["ensembl_gene_id"]: (r["status"], r["input"]) for r in sequences.marked_transcripts(m, cdna, cds.where("cds_length_nt > 0")).collect()}
    assert t == {"ENSG1": ("mapped", "CCEAUGEAAAG"), "ENSG2": ("cds_not_found_inside_cdna", None), "ENSG3": ("missing_cdna_sequence", None)}
    fa = spark.createDataFrame([("ENSG1|ENST1", "EAUG", 1), ("ENSG1|ENST2", "AUGGA", 2), ("ENSG2", "AXX", 3)], "header string, sequence string, file_row int")
    rna = sequences.longest_valid_rna(fa, m)
    assert rows(rna["sequences"], "ensembl_gene_id", "transcript_id", "sequence") == [("ENSG1", "ENST2", "AUGGA")] and rna["missing"].count() == 2
    done = sequences.embed_sequences(cds.where("cds_length_nt > 0"), "nucleotide_transformer", LetterModel)
    assert np.allclose(vec(done["vectors"])["ENSG1"], [4 / 6, 0, 1 / 6, 1 / 6]) and done["failures"].count() == 0
    p = spark.createDataFrame([("P1", "MK"), ("P3", "LL")], "accession string, sequence string")
    assert rows(sequences.protein_jobs(gene_table(spark), p), "ensembl_gene_id", "accession") == [("ENSG1", "P1"), ("ENSG3", "P3")]
    s = spark.createDataFrame([("S1", "about one"), ("S2", "about two")], "key string, text string")
    jobs = sequences.summary_jobs(gene_table(spark), s)
    assert rows(jobs, "ensembl_gene_id", "summary_mapping_source") == [("ENSG1", "gene_symbol"), ("ENSG2", "gene_symbol")]
    assert sequences.embed_sequences(jobs, "text_bert", lambda: WordHashModel(4), "summary_text")["vectors"].count() == 2


def test_resume_by_key(spark, tmp_path):
    todo = spark.createDataFrame([(i, float(i)) for i in range(6)], "k int, v double")
    sink = str(tmp_path / "sink")
    incremental.resume(todo.where("k < 4"), "k", sink, lambda d: d)
    assert sorted(r["k"] for r in incremental.resume(todo, "k", sink, lambda d: d).collect()) == list(range(6))


def test_file_stream_picks_up_only_new_files(spark, tmp_path):
    src, sink, chk = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "chk")
    df = spark.range(5)
    df.write.parquet(src)
    assert incremental.drain_files(spark, src, "*.parquet", df.schema, lambda d: d, sink, chk).count() == 5
    spark.range(5, 8).write.mode("append").parquet(src)
    assert incremental.drain_files(spark, src, "*.parquet", df.schema, lambda d: d, sink, chk).count() == 8


def test_canonical_splice_sites(spark):
    m = spark.createDataFrame([("g1", "c", "+", "T1", "T1.2"), ("g2", "c", "+", "T2", ""), ("g3", "z", "+", "T1", ""), ("g4", "c", "-", "T9", ""), ("g5", "c", "-", "T1", "")],
                              "ensembl_gene_id string, chromosome string, strand string, canonical_transcript_id string, canonical_transcript_id_versioned string")
    ex = spark.createDataFrame([("T1.2", "c", 10, 20, "+", 1), ("T1.2", "c", 30, 40, "+", 2), ("T2.1", "c", 5, 9, "+", 1)],
                               "transcript_id string, chromosome string, start bigint, stop bigint, strand string, exon_number int")
    ch = spark.createDataFrame([("c", 100)], "chromosome string, chrom_length bigint")
    table, sites = genome.canonical_splice_sites(m, ex, ch)
    assert rows(table, "ensembl_gene_id", "site_status", "n_splice_sites") == [
        ("g1", "ok", 2), ("g2", "single_exon_or_no_junctions", 0), ("g3", "chromosome_not_in_fasta", 0),
        ("g4", "canonical_transcript_exons_not_found", 0), ("g5", "ok", 2)]
    assert rows(sites, "ensembl_gene_id", "site_type", "site_0based") == [("g1", "acceptor", 29), ("g1", "donor", 19), ("g5", "acceptor", 19), ("g5", "donor", 29)]
    bounds = genome.splice_input_bounds(sites).first()
    assert bounds["input_stop"] - bounds["input_start"] == 10_101


def test_regulatory_plan(spark):
    m = spark.createDataFrame([(f"ENSG{i}", "s", "protein_coding", "1", "p", "chr1", "1", "2", "+", "GRCh38") for i in range(1, 6)] +
                              [("ENSG9", "s", "protein_coding", "1", "p", "chrM", "1", "2", "+", "GRCh38")],
                              "ensembl_gene_id string, gene_symbol string, gene_type string, entrez_id string, uniprot_id string, chromosome string, "
                              "gene_start string, gene_end string, strand string, assembly string")
    x = [[1.0, 2.0, 7.0], [2.0, 1.0, 7.0], [4.0, 4.0, 7.0], [0.0, 3.0, 7.0]]
    chunks = spark.createDataFrame([(f"ENSG{i + 1}", "iv", "5", *[str(v) for v in r]) for i, r in enumerate(x)],
                                   "ensembl_gene_id string, input_interval string, tss_1based string, `a|b` string, f2 string, f3 string")
    out = tabular.regulatory_vectors(chunks, m, ["a|b", "f2", "f3"], k=2)
    z = np.array(x)
    s = z.std(0)
    z = (z - z.mean(0)) / np.where(s == 0, 1, s)
    got = np.array([v for _, v in sorted(vec(out["vectors"]).items())])
    assert np.allclose((got ** 2).sum(0), np.linalg.svd(z, compute_uv=False)[:2] ** 2)
    assert [r["zero_std"] for r in out["feature_stats"].orderBy("dim").collect()] == [False, False, True]
    with pytest.raises(ValueError):
        tabular.regulatory_vectors(chunks.union(chunks), m, ["a|b", "f2", "f3"], k=2)


def test_exact_ids_keep_source_rows(spark):
    m = spark.createDataFrame([("ENSG00000000001",), ("ENSG00000000002",)], "ensembl_gene_id string")
    src = spark.createDataFrame([("ENSG00000000002", [1.0, 2.0]), ("ENSG00000000007", [3.0, 1.0])], "gene_id string, vector array<float>")
    out = tabular.exact_id_vectors(src, m, 2)
    assert vec(out["vectors"], "gene_id") == {"ENSG00000000002": [1.0, 2.0]}
    assert rows(out["routing"]) == [("ENSG00000000002", "mapped_exact_ensembl_gene_id"), ("ENSG00000000007", "not_in_master_table")]
