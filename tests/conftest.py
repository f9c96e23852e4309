import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from geneloom.session import build_session

    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}
    if "SPARK_CONF_DIR" not in os.environ:
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="geneloom-tests-")
    session = build_session("tests", "local[4]", **conf)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture()
def no_broadcast(spark):
    """Force the shuffle (salted) join paths."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture(scope="session")
def master(spark):
    rows = [
        ("ENSG1", "AAA", "protein_coding", "OLD1", "X", "1", "1", "P1"),
        ("ENSG2", "BBB", "protein_coding", "OLD2", "X|Y", "2", "2|20", "P2"),
        ("ENSG3", "CCC", "protein_coding", "AAA", "Z", "20", "20", "P3-2"),
    ]
    return spark.createDataFrame(rows, "ensembl_gene_id string, gene_symbol string, gene_type string, hgnc_previous_symbols string, "
                                       "hgnc_alias_symbols string, entrez_id string, map_entrez_ids_all string, uniprot_id string")
