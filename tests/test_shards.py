"""The .npy source and sink."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from geneloom.sources import shards


def rows(df):
    return {r["row"]: list(r["vector"]) for r in df.collect()}


@pytest.mark.parametrize("dtype", ["<f4", "<f8", "<i2"])
def test_a_file_is_read_in_row_ranges(spark, tmp_path, dtype):
    x = np.arange(300).reshape(100, 3).astype(dtype)
    np.save(tmp_path / "m.npy", x)
    df = shards.read_npy_rows(spark, str(tmp_path / "m.npy"), blockBytes=7 * 3 * x.itemsize)
    assert df.rdd.getNumPartitions() == 15
    assert rows(df) == {i: [float(v) for v in r] for i, r in enumerate(x)}
    with pytest.raises(Exception, match="3 columns"):
        shards.read_npy_rows(spark, str(tmp_path / "m.npy"), width=4).collect()


def test_shards_and_a_manifest_come_back(spark, tmp_path):
    df = spark.range(200).select((F.col("id") * 3).alias("n"), F.array(F.col("id") / 4, F.lit(1.5)).alias("v")).repartition(5)
    path = str(tmp_path / "out")
    shards.write_npy_rows(df, path, "n", "v")
    made = json.loads((tmp_path / "out" / shards.MANIFEST).read_text())
    assert made["rows"] == 200 and len(made["shards"]) == 5
    assert sum(len(np.load(tmp_path / "out" / s["data"])) for s in made["shards"]) == 200  # plain .npy files
    assert rows(shards.read_npy_rows(spark, path)) == {3 * i: [i / 4, 1.5] for i in range(200)}
    shards.write_npy_rows(df.selectExpr("n + 1000 as n", "v").limit(7), path, "n", "v")
    assert shards.read_npy_rows(spark, path).count() == 207


def test_a_failed_task_leaves_no_manifest(spark, tmp_path):
    bad = spark.range(100, numPartitions=4).select(F.col("id").alias("n"), F.when(F.col("id") == 77, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("v"))
    path = tmp_path / "bad"
    with pytest.raises(Exception):
        shards.write_npy_rows(bad, str(path), "n", "v")
    assert not [p for p in path.iterdir() if p.name == shards.MANIFEST]
    with pytest.raises(Exception):
        shards.read_npy_rows(spark, str(path)).collect()


def test_empty_tables(spark, tmp_path):
    shards.write_npy_rows(spark.createDataFrame([], "n bigint, v array<float>"), str(tmp_path / "e"), "n", "v")
    assert rows(shards.read_npy_rows(spark, str(tmp_path / "e"))) == {}
