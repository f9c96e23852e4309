"""Single documents that many tasks read, against a plain reader."""

import json
import random

import pytest
from pyspark.sql import functions as F

from geneloom.plans import genome
from geneloom.sources import splits


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_json_entries_cross_splits(spark, small_splits, tmp_path):
    rng = random.Random(1)
    odd = ['a,b', '{"x": [1, 2}', 'quote " in', "back\\slash", "\\", '\\",', "new\nline", "", "é, ü", "]]", "long " * 60 + ", end"]
    docs = []
    for f in range(2):
        doc = {f"k{i},{rng.choice(odd)}": rng.choice(odd) for i in range(60)} | {"nested": {"a": [1, {"b": ","}]}, "list": [1, 2, 3], "n": None}
        (tmp_path / f"{f}.json").write_text(json.dumps(doc, ensure_ascii=bool(f), indent=2 if f else None))
        docs.append(doc)
    (tmp_path / "2.json").write_text("  {}\n")
    got = splits.read_json_entries(spark, str(tmp_path))
    assert splits.placed_pieces(spark, str(tmp_path), ",").select("file", "block").distinct().count() > 20
    rows = got.collect()
    assert len(rows) == sum(map(len, docs))
    for f, doc in enumerate(docs):
        own = sorted((r for r in rows if r["file"].endswith(f"{f}.json")), key=lambda r: r["entry"])
        assert [r["key"] for r in own] == list(doc)
        for r in own:
            want = doc[r["key"]]
            assert (r["value"] if isinstance(want, str) or want is None else json.loads(r["value"])) == want


def test_json_number_lists(spark, small_splits, tmp_path):
    doc = {f"g{i}": [i + j / 4 for j in range(40)] for i in range(30)}
    (tmp_path / "v.json").write_text(json.dumps(doc))
    rows = splits.read_json_entries(spark, str(tmp_path / "v.json"), "array<double>").collect()
    assert {r["key"]: list(r["value"]) for r in rows} == doc


@pytest.mark.parametrize("tile", [7, 64, 5000])
def test_fasta_records_cross_splits(spark, small_splits, tmp_path, tile):
    rng = random.Random(tile)
    records = [(f"id{i} note {i}", "".join(rng.choices("ACGTN", k=n))) for i, n in enumerate([0, 1, 2000, 59, 60, 61, 700, 0, 3])]
    text = "; junk before\nACGT\n" + "".join(f">{h}\r\n" + "".join(s[i:i + 60] + "\r\n" for i in range(0, len(s), 60)) for h, s in records) + "\n\n"
    (tmp_path / "s.fa").write_bytes(text.encode())
    heads, tiles = splits.read_fasta_tiles(spark, str(tmp_path / "s.fa"), tile)
    got = heads.orderBy("record").collect()
    assert [(r["header"], r["record_id"], r["length"]) for r in got] == [(h, h.split()[0], len(s)) for h, s in records]
    parts = {}
    for r in tiles.orderBy("record", "tile_no").collect():
        assert r["tile_no"] == len(parts.setdefault(r["record"], [])) and len(r["bases"]) <= tile
        parts[r["record"]].append(r["bases"])
    assert {i + 1: s for i, (_, s) in enumerate(records) if s} == {k: "".join(v) for k, v in parts.items()}
    assert tiles.groupBy("record").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] == -(-2000 // tile)


def test_fasta_text_is_cut_once(spark, tmp_path):
    """Tiles, headers and lengths read the written cut; no plan runs the Python pass again. Lines of one tile are one piece."""
    (tmp_path / "s.fa").write_text(">r1 x\nACG\nTAC\nGTA\n\n>r2\n>r3\nAC GT\n")
    heads, tiles = splits.read_fasta_tiles(spark, str(tmp_path / "s.fa"), 4)
    assert sorted(tuple(r) for r in heads.select("record_id", "length").collect()) == [("r1", 9), ("r2", 0), ("r3", 4)]
    assert sorted(tuple(r) for r in tiles.select("record", "tile_no", "bases").collect()) == [(1, 0, "ACGT"), (1, 1, "ACGT"), (1, 2, "A"), (3, 0, "ACGT")]
    for df in (heads, tiles, genome.tiles_from_fasta(spark, str(tmp_path / "s.fa"), 4)):
        assert "mapinarrow" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
