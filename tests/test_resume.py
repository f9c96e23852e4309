"""Done masks, whole-text pooling with outcomes, and pivots of any width."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geneloom.models.specs import SPECS
from geneloom.models.stub import WordHashModel
from geneloom.operators import features, inference
from geneloom.streaming.incremental import resume_rows


def test_masks_skip_finished_rows_over_bucket_edges(spark, tmp_path):
    todo = spark.createDataFrame([(i,) for i in [0, 1, 7, 8, 9, 32766, 32767, 32768, 32769, 65535, 65536, 100_000]], "n bigint")
    sink, asked = str(tmp_path / "sink"), []

    def work(df):
        asked.append(sorted(r["n"] for r in df.collect()))
        return df.withColumn("v", F.col("n") * 2)

    resume_rows(todo.where("n IN (0, 8, 32767, 65536)"), "n", {"rows": 12}, sink, work)
    out = resume_rows(todo, "n", {"rows": 12}, sink, work)
    assert asked[1] == [1, 7, 9, 32766, 32768, 32769, 65535, 100_000]
    assert sorted(tuple(r) for r in out.select("n", "v").collect()) == sorted((r["n"], r["n"] * 2) for r in todo.collect())
    resume_rows(todo, "n", {"rows": 12}, sink, work)
    assert asked[2] == []
    with pytest.raises(ValueError, match="another shape"):
        resume_rows(todo, "n", {"rows": 13}, sink, work)


def test_a_batch_that_died_before_its_masks_is_made_anew(spark, tmp_path):
    todo, sink = spark.range(50).withColumnRenamed("id", "n"), str(tmp_path / "sink")
    resume_rows(todo.where("n < 10"), "n", {}, sink, lambda d: d)
    todo.where("n BETWEEN 10 AND 20").withColumn("batch", F.lit(1)).write.mode("append").partitionBy("batch").parquet(f"{sink}/rows")  # no masks
    out = resume_rows(todo, "n", {}, sink, lambda d: d)
    assert sorted(r["n"] for r in out.collect()) == list(range(50))


def test_long_texts_pool_whole_and_failed_keys_stay(spark):
    class Picky(WordHashModel):
        def tokens(self, piece):
            if "bad" in piece:
                raise ValueError("rejected")
            return super().tokens(piece)

    spec = SPECS["text_bert"]
    long = " ".join(f"w{i}" for i in range(600))
    dense = " ".join("a.b.c.d.e" for _ in range(300))  # five tokens a word: a piece is beyond the limit and is cut again
    df = spark.createDataFrame([(1, long), (2, dense), (3, "fine bad " + long), (4, ""), (5, None), (6, " \n ")], "k int, t string")
    done = inference.embed_pieces(inference.cut(df, "k", "t", spec), "k", spec, lambda: Picky(4))
    got = {r["k"]: (r["status"], r["n_tokens"]) for r in inference.outcomes(df, done, "k").collect()}
    assert got == {1: ("ok", 600), 2: ("ok", 1500), 3: ("failed", got[3][1]), 4: ("empty", 0), 5: ("empty", 0), 6: ("empty", 0)}
    vector = {r["k"]: r["vector"] for r in inference.pool(done, "k", spec).collect()}
    assert vector.keys() == {1, 2} and np.allclose(vector[1], WordHashModel(4).tokens(long)[0].mean(axis=0))
    assert np.allclose(vector[2], WordHashModel(4).tokens(dense)[0].mean(axis=0))


def test_pivots_of_any_width_are_one_aggregate(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 5.0), (1, None, 9.0), (2, "b", -3.0), (3, None, 1.0), (4, "c", None)], "k int, l string, v double")
    got = {tuple(r) for r in features.max_pivot(df, "k", "l", F.col("v"), ["a", "b", "c", "none"]).collect()}
    assert got == {(1, 5.0, 0.0, 0.0, 0.0), (2, 0.0, -3.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0, 0.0), (4, 0.0, 0.0, 0.0, 0.0)}
    sets = spark.createDataFrame([(1, ["a", "a", "b"]), (1, ["c"]), (2, []), (3, None)], "k int, l array<string>")
    got = {tuple(r) for r in features.multi_hot(sets, "k", F.col("l"), ["a", "b", "c"]).collect()}
    assert got == {(1, 1.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0)}
