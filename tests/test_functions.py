"""Row-wise functions on hand-checked values."""

from pyspark.sql import functions as F

from geneloom.functions import ids, num, seq


def values(spark, raw, *exprs, schema="s string"):
    df = spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in raw], schema)
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_cleaning_policies_differ(spark):
    got = values(spark, [" NaN ", "NONE", "null", "na", " x "], ids.clean("s", "exact"), ids.clean("s", "any_case"), ids.clean("s", "any_case_null"))
    assert got == [("", "", ""), ("", "", ""), ("null", "null", ""), ("na", "", ""), ("x", "x", "x")]


def test_version_rules_differ_on_par_suffix(spark):
    assert values(spark, ["ENSG1.2_PAR_Y", "ENSG1.2"], ids.strip_version("s"), ids.strip_version_suffix("s")) == [
        ("ENSG1", "ENSG1.2_PAR_Y"), ("ENSG1", "ENSG1")]


def test_entrez_rules(spark):
    got = values(spark, ["7157.0", "abc", "", "1d", "inhib_9", "INHIB_9.0"], ids.norm_entrez("s"), ids.clean_entrez("s"), ids.component_token_id("s"))
    assert got == [("7157", "7157", "7157"), ("abc", "", ""), ("", "", ""), ("1d", "", ""), ("inhib_9", "", "9"), ("INHIB_9.0", "", "9")]


def test_digit_runs_trap(spark):
    assert values(spark, ["7157.0"], ids.extract_digit_runs("s"), ids.extract_entrez_ids("s")) == [(["7157", "0"], ["7157"])]
    assert values(spark, ["12.0|5;0,A7 5"], ids.extract_entrez_ids("s")) == [(["12", "5"],)]


def test_accessions(spark):
    assert values(spark, ["P3-2", "sp|p9-1"], ids.canonical_uniprot("s"), ids.canonical_uniprot("s", True)) == [("P3", "P3"), ("SP|P9", "P9")]
    assert values(spark, ["9606.ENSP01.3", "ENSP7", "x"], ids.clean_ensp("s")) == [("ENSP01",), ("ENSP7",), ("",)]


def test_json_hits(spark):
    hit = '{"query":"g1","entrezgene":7,"uniprot":{"TrEMBL":["T1"],"Swiss-Prot":"S1"},"ensembl":{"gene":"g1"}}'
    got = values(spark, [hit], ids.hit_uniprot("s")["ids"], ids.hit_uniprot("s")["status"], ids.hit_matches_query("s", F.lit("g1")))
    assert got == [("S1", "mapped_reviewed_swissprot", True)]
    assert values(spark, ['{"a":["x:y",{"b":[1,null,"q\\"r"]}]}'], ids.json_leaves("s")) == [(["x:y", "1", 'q"r'],)]


def test_concept_keys(spark):
    got = values(spark, ["Gene_7157", "Gene_1_2", "Gene_x", "Disease_1"], ids.concept_key("s")["value"], ids.concept_key("s")["status"])
    assert got == [("7157", "single_entrez"), ("1|2", "multi_entrez"), ("x", "bad_gene_concept"), (None, "non_gene")]


def test_numbers(spark):
    assert values(spark, ["1e3", " 2.5 ", "1d", "", "-inf", "0x1"], num.to_number("s")) == [(1000.0,), (2.5,), (None,), (None,), (float("-inf"),), (None,)]
    got = values(spark, [(4.0,), (-4.0,)], num.signed_log1p("v"), schema="v double")
    assert [round(x[0], 6) for x in got] == [1.609438, -1.609438]
    assert values(spark, ["Low", "High", "Ascending"], num.ordinal_level("s")) == [(1.0,), (3.0,), (None,)]


def test_sequence_basics(spark):
    assert values(spark, ["ACGN"], seq.reverse_complement("s")) == [("NCGT",)]
    assert values(spark, ["AUGGC"], seq.codon_markers("s")) == [("EAUGEGC",)]
    assert values(spark, ["acgux-"], seq.clean_dna("s"), seq.dna_to_rna("s")) == [("ACGTNN", "ACGUNN")]
    assert values(spark, ["ACN"], seq.one_hot_dna("s")) == [([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 0]],)]


def test_chunk_tail_rule(spark):
    for length, expected in ((2300, [1000, 1000, 300]), (2100, [1000, 1100]), (2000, [1000, 1000]), (150, [150]), (1100, [1100]), (0, [])):
        got = values(spark, ["A" * length], F.transform(seq.chunks_min_tail("s", 1000, 200), F.length))
        assert got == [(expected,)], length
    assert values(spark, ["ABCDEFG"], seq.chunks("s", 3)) == [(["ABC", "DEF", "G"],)]


def test_padded_slices(spark):
    got = values(spark, ["ACGTACGT"], seq.padded_slice("s", F.lit(-2), F.lit(3)), seq.padded_slice("s", F.lit(6), F.lit(11)), seq.centered_slice("s", F.lit(4), 4))
    assert got == [("NNACG", "GTNNN", "GTAC")]


def test_coding_region_statuses(spark):
    df = spark.createDataFrame([("AACCC", "CC"), ("AACCT", "CC"), ("AAA", "CC"), ("", "CC"), ("AA", "")], "a string, b string")
    assert [r[0] for r in df.select(seq.locate_cds("a", "b")["status"]).collect()] == [
        "mapped_cds_multiple_hits_used_first", "mapped", "cds_not_found_inside_cdna", "missing_cdna_sequence", "missing_cds_sequence"]
