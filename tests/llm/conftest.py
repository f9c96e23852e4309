import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark):
    """(doc_id, text) of the smallest table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture()
def frame(spark):
    """A table of (doc_id, text) over three partitions, with columns whose names clash with those of the operators."""

    def build(rows):
        rows = [(k, t, "en", "s", 0, 7, "x") for k, t in rows]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines bigint, key string"
        return spark.createDataFrame(rows, schema).repartition(3)

    return build
