"""Readers and writers on small files."""

import gzip
import io
import json
import pickle
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from geneloom.sources import archives, bio, readers, sinks


def write(path, text):
    path.write_text(text)
    return str(path)


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_text_table_na_and_bom(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_bytes(b"\xef\xbb\xbfensembl_gene_id,gene_symbol\nENSG1,NA\nENSG2,\"a, \"\"b\"\"\"\n")
    t = readers.read_keyed_table(spark, str(p))
    assert rows(t, "ensembl_gene_id", "gene_symbol") == [("ENSG1", ""), ("ENSG2", 'a, "b"')]
    with pytest.raises(ValueError):
        readers.read_text_table(spark, str(p), required=["nope"])


def test_gzip_gtf(spark, tmp_path):
    p = tmp_path / "a.gtf.gz"
    with gzip.open(p, "wt") as fh:
        fh.write("#c\nchr1\tH\texon\t10\t20\t.\t+\t.\tgene_id \"G1.2\"; tag \"a\"; tag \"b\"; exon_number 3; transcript_id \"T1\";\nshort\tline\n")
    r = bio.read_gtf(spark, str(p)).first()
    assert (r["attributes"]["gene_id"], r["tags"], r["start"], r["n_fields"]) == ("G1.2", ["a", "b"], 10, 9)


def gaf_line(acc, go, qualifier="x", aspect="P", db="UniProtKB", n=17):
    cells = [db, acc, "S", qualifier, go, "r", "IEA", "", aspect] + [""] * 8
    return "\t".join(cells[:n])


def test_gaf_strict_and_lenient(spark, tmp_path):
    good = write(tmp_path / "g.gaf", "!gaf-version: 2.2\n" + gaf_line("P1", "GO:1") + "\n")
    assert bio.read_gaf(spark, good).count() == 1
    with pytest.raises(ValueError):
        bio.read_gaf(spark, write(tmp_path / "b.gaf", "!gaf-version: 2.2\n" + gaf_line("P1", "GO:1", n=15) + "\n"))
    with pytest.raises(ValueError):
        bio.read_gaf(spark, write(tmp_path / "v.gaf", "!gaf-version: 1.0\n" + gaf_line("P1", "GO:1") + "\n"))
    assert bio.read_gaf(spark, write(tmp_path / "l.gaf", gaf_line("P1", "GO:1", n=15) + "\n"), strict=False).count() == 1


def test_obo(spark, tmp_path):
    text = "format-version: 1.2\n\n[Term]\nid: GO:1\nname: one\nnamespace: bp\ndef: \"d\" []\nsynonym: \"uno\" EXACT []\nis_a: GO:2 ! two\n\n" \
           "[Term]\nid: GO:9\nname: gone\nis_obsolete: true\n\n[Typedef]\nid: part_of\n"
    r = bio.read_obo(spark, write(tmp_path / "a.obo", text)).collect()
    assert [(x["term_id"], x["name"], x["namespace"], x["synonyms"], x["parents"]) for x in r] == [("GO:1", "one", "bp", ["uno"], ["GO:2"])]


def test_fasta_and_protein_index(spark, tmp_path):
    p = write(tmp_path / "a.fa", ">T1.2 cdna\nACGT\nAC\n>T2\nGG\n")
    assert rows(bio.read_fasta(spark, p), "record_id", "sequence") == [("T1.2", "ACGTAC"), ("T2", "GG")]
    q = write(tmp_path / "p.fa", "# note\n>sp|P1-2|N x\nmk*\n! c\nLL\n>sp|P1|N\nWW\n")
    assert rows(bio.read_protein_index(spark, q)) == [("P1", "MKLL"), ("P1-2", "MKLL")]


def test_vector_tables(spark, tmp_path):
    e = write(tmp_path / "e.csv", "Entry,a,b\nP1,1,2\n")
    assert rows(readers.read_entry_vectors(spark, e), "Entry", "vector") == [("P1", [1.0, 2.0])]
    with pytest.raises(ValueError):
        readers.read_entry_vectors(spark, write(tmp_path / "x.csv", "Id,a\nP1,1\n"))
    for text in ("gene,v0\n7157,1\n", "7157,1\n"):
        assert rows(readers.read_sniffed_vectors(spark, write(tmp_path / "n.csv", text)), "source_token", "vector") == [("7157", [1.0])]
    with pytest.raises(ValueError):
        readers.read_sniffed_vectors(spark, write(tmp_path / "b.csv", "7157,x\n"))
    f = write(tmp_path / "f.csv", "id7,1,2\nabc,1,2\n8,1,\n")
    assert rows(readers.read_headerless_vectors(spark, f), "source_id", "vector") == [("7", [1.0, 2.0])]
    w = write(tmp_path / "w.txt", "3 2\nA 1 2\nB 1\nC 1 x\n")
    assert rows(readers.read_word_vectors(spark, w), "source_id", "status") == [("A", "ok"), ("B", "wrong_dim_1_expected_2"), ("C", "cannot_parse_floats")]


def test_data_rows_that_equal_a_head_line_stay(spark, tmp_path):
    w = write(tmp_path / "w.txt", "3 1\nA 2\n3 1\n")
    assert rows(readers.read_word_vectors(spark, w), "source_id", "vector") == [("3", [1.0]), ("A", [2.0])]
    g = write(tmp_path / "g.gct", "#1.2\n2\t1\nName\tDescription\nx\ty\n2\t1\n")
    assert rows(readers.read_gct(spark, g), "Name", "Description") == [("2", "1"), ("x", "y")]


def test_matrix_repair(spark, tmp_path):
    ids = readers.read_id_list(spark, write(tmp_path / "ids.txt", "7\n8.0\n"))
    for text in ("a,b\n1,2\n3,4\n", "100,1,2,\n200,3,4,\n"):
        got = readers.read_repaired_matrix(spark, write(tmp_path / "m.csv", text), ids, 2)
        assert rows(got, "source_id", "vector") == [("7", [1.0, 2.0]), ("8", [3.0, 4.0])]
    with pytest.raises(ValueError):
        readers.read_repaired_matrix(spark, write(tmp_path / "m.csv", "1,2\n"), ids, 2)


def test_json_dictionaries(spark, tmp_path):
    v = write(tmp_path / "v.json", json.dumps({"Gene_7": [1.5, -2e-1], "Disease": [0, 1]}, indent=1))
    assert rows(readers.read_json_vectors(spark, v)) == [("Disease", [0.0, 1.0]), ("Gene_7", [1.5, -0.2])]
    t = write(tmp_path / "t.json", json.dumps({" tp53 ": " text ", "b": {"x": 1}, "c": " "}))
    assert {k for k, _ in rows(readers.read_json_texts(spark, t))} == {"TP53", "B"}
    assert rows(readers.read_vocabulary(spark, write(tmp_path / "k.json", '{"A": 1, "B": "x"}'))) == [("A", 1), ("B", None)]


def test_archives_and_binaries(spark, tmp_path):
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as out:
        out.writestr("a.tsv", "Gene\tLevel\nG1\tLow\nG2\t\n")
    assert rows(archives.read_single_member_zip(spark, str(z)), "Gene", "Level") == [("G1", "Low"), ("G2", "")]
    with zipfile.ZipFile(z, "a") as out:
        out.writestr("b.tsv", "x")
    with pytest.raises(Exception):
        archives.read_single_member_zip(spark, str(z))
    t = tmp_path / "a.tar.gz"
    with tarfile.open(t, "w:gz") as tar:
        info = tarfile.TarInfo("e.tsv")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"abc"))
    assert archives.read_tar_members(spark, str(t), {"e.tsv": ""}).first()["content"] == b"abc"
    with pytest.raises(Exception):
        archives.read_tar_members(spark, str(t), {"e.tsv": "0" * 64}).collect()
    p = tmp_path / "d.pkl"
    p.write_bytes(pickle.dumps({"TP53": np.array([1, 2], dtype=np.float32), "B": [3.0, 4.0]}))
    assert rows(archives.read_pickled_dictionary(spark, str(p))) == [("B", [3.0, 4.0]), ("TP53", [1.0, 2.0])]
    p.write_bytes(pickle.dumps({"x": __import__("pathlib").Path("a")}))
    with pytest.raises(Exception):
        archives.read_pickled_dictionary(spark, str(p)).collect()
    m = tmp_path / "m.npy"
    np.save(m, np.arange(10, dtype=np.float32).reshape(5, 2))
    assert rows(archives.read_npy(spark, str(m), "float32", 2, block=2))[4] == (4, [8.0, 9.0])
    with pytest.raises(ValueError):
        archives.read_npy(spark, str(m), dim=3)


def test_package_and_text_sinks(spark, tmp_path):
    v = spark.createDataFrame([("G2", [1.0]), ("G1", [2.0])], "ensembl_gene_id string, vector array<double>")
    g = spark.createDataFrame([("G1", "A"), ("G2", "B")], "ensembl_gene_id string, gene_symbol string")
    p = sinks.vector_package(v, g, "ensembl_gene_id", ["ensembl_gene_id"])
    sinks.write_package(p, str(tmp_path / "out"), {"n": 2}, {"r": g})
    assert rows(spark.read.parquet(str(tmp_path / "out/matrix")), "embedding_row", "ensembl_gene_id") == [(0, "G1"), (1, "G2")]
    assert json.loads(spark.read.text(str(tmp_path / "out/metadata")).first()[0]) == {"n": 2}
    sinks.export_npz(p, str(tmp_path / "x.npz"))
    assert np.load(tmp_path / "x.npz")["embeddings"].tolist() == [[2.0], [1.0]]
    sinks.write_fasta(g.withColumn("s", F.lit("ACGTA")), str(tmp_path / "fa"), ["ensembl_gene_id", "gene_symbol"], "s", 2)
    assert {r[0] for r in spark.read.text(str(tmp_path / "fa")).collect()} == {">G1|A", ">G2|B", "AC", "GT", "A"}
    assert "n_rows: 2" in sinks.text_report("t", g.agg(F.count(F.lit(1)).alias("n_rows")))


def parts(folder, *texts):
    folder.mkdir()
    for i, text in enumerate(texts):
        (folder / f"part-{i:05d}.txt").write_text(text)
    return str(folder)


def test_head_lines_stand_in_the_first_file_not_in_the_largest(spark, tmp_path):
    assert readers.first_lines(spark, parts(tmp_path / "a b", "x\n", "", "y\nz\n" * 50), 3) == ["x", "y", "z"]
    genes = parts(tmp_path / "gct", "#1.2\n", "n\tc\nName\tDescription\tt\n", "".join(f"G{i}\td\t{i}\n" for i in range(50)))
    assert sorted(int(r["t"]) for r in readers.read_gct(spark, genes).collect()) == list(range(50))


def test_sniffed_header_in_a_small_first_file(spark, tmp_path):
    sniffed = parts(tmp_path / "sniffed", "gene,v,v\n", "".join(f"t{i},{i},1\n" for i in range(50)))
    assert readers.read_sniffed_vectors(spark, sniffed).count() == 50


def test_word_vector_header_in_a_small_first_file(spark, tmp_path):
    words = parts(tmp_path / "words", "50 2\n", "".join(f"w{i} {i} 1\n" for i in range(49)) + "w49 1\n")
    assert rows(readers.read_word_vectors(spark, words).groupBy("status").count()) == [("ok", 49), ("wrong_dim_1_expected_2", 1)]


def test_digests_of_large_files_are_chained(spark, tmp_path, monkeypatch):
    """A file above the limit is never one cell; its digest is that of the whole file, whatever its bytes and last line end."""
    import hashlib
    import random

    from geneloom.sources import sinks

    rng = random.Random(5)
    blobs = {"a b.bin": rng.randbytes(300_000), "end.bin": rng.randbytes(50_000) + b"\n", "two[1].bin": b"\n\n" + rng.randbytes(9_000) + b"\r\n\n",
             "only.bin": b"\n" * 2_000, "none.bin": b"x" * 5_000, "small.bin": b"\xff\n"}
    for name, data in blobs.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(sinks, "LARGE_FILE", 1_000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # as for a file over 2 GB, a larger cell is refused
    try:
        got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["sha256"], r["md5"]) for r in sinks.file_digests(spark, f"{tmp_path}/*.bin").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest(), hashlib.md5(d).hexdigest()) for n, d in blobs.items()}
