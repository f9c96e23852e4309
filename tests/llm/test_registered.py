"""A missing name in an operator file would make all these queries vanish without a word."""

import __spark_entry__ as entry
from geneloom.llm.queries import QUERIES


def test_all_numbered_queries_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert {"op5_line_dedup", "op6_decontaminate", "op11_lexical_search"} <= set(entry.oracle_sql())
