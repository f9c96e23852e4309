"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the input and the local cores; BENCH_QUERIES may name queries, or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = """conform_vectors unique_only_join tiered_join_fall_through evidence_agreement_join ordered_first_match
vector_mean_per_key max_level_pivot multi_hot_pivot sum_duplicate_coordinates pick_canonical_row dense_row_index cumulative_share
adjacent_row_gap channel_split_first_wins symmetric_adjacency sparse_ppmi ancestor_closure typed_context_features column_zscore
tfidf_raw_counts tfidf_sublinear quality_gate text_tokenizer chunks_with_minimum_tail embed_min_tail_chunks scan_sequence_records
pca_scores""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")

    from geneloom.queries import REGISTRY
    from geneloom.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    names = list(REGISTRY) if wanted == "all" else wanted.split() if wanted else HEADLINE
    REGISTRY["value_counts_sorted"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the executors
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if wanted:
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus), "driver_memory": spark.conf.get("spark.driver.memory"),
                      "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions"))}))
    spark.stop()


if __name__ == "__main__":
    main()
