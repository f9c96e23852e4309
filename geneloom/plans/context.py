"""Plans on heterogeneous knowledge graphs: typed neighbour features of genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import features, graph, linalg, mapping, quality, vectors
from ..session import materialize
from .tabular import GENE_COLUMNS


def relation_features(edges: DataFrame, gene_type: str = "gene/protein") -> dict[str, DataFrame]:
    """Edges ``relation, display_relation, x_id, x_type, x_name, y_*`` to counts per gene and typed neighbour.

    Only edges with exactly one gene endpoint are kept; the key has no side.
    """
    x, y = F.col("x_type") == gene_type, F.col("y_type") == gene_type
    counts = features.edge_class_counts(edges, x, y)
    kept = features.one_gene_edges(edges, x, y)

    def pick(near, far):
        return F.when(F.col("gene_is_left"), F.col(near)).otherwise(F.col(far))

    flat = kept.select(ids.strip(pick("x_id", "y_id")).alias("gene"), ids.strip(pick("x_name", "y_name")).alias("symbol"),
                       "relation", "display_relation", pick("y_type", "x_type").alias("n_type"), pick("y_id", "x_id").alias("n_id")).where("gene <> ''")
    return {"matrix": features.typed_features(flat, F.col("gene"), ["relation", "display_relation", "n_type", "n_id"]),
            "symbols": flat.groupBy("gene").agg(F.min("symbol").alias("source_symbol")), "edge_counts": counts,
            "relation_counts": flat.groupBy("relation").agg(F.count(F.lit(1)).alias("included_edge_count")),
            "type_counts": flat.groupBy("n_type").agg(F.count(F.lit(1)).alias("included_edge_count"))}


def metaedge_features(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Edges ``source_id, metaedge, target_id`` with a node table ``id, name, kind``; the key carries the gene side."""
    quality.require_columns(nodes, ["id", "name", "kind"], "node table")
    table = nodes.groupBy("id").agg(F.max("kind").alias("kind"), F.max("name").alias("name"))
    ends = edges.select("metaedge", "source_id", "target_id")
    for side in ("source", "target"):
        kinds = table.select(F.col("id").alias("_id"), F.col("kind").alias(f"{side}_kind"))
        ends = graph.node_attribute(ends.withColumn("_id", F.col(f"{side}_id")), "_id", kinds, "_id", f"{side}_kind",
                                    ids.node_kind("_id")).drop("_id")
    s, t = ids.is_gene_node("source_id", "source_kind"), ids.is_gene_node("target_id", "target_kind")
    counts = features.edge_class_counts(ends, s, t)
    kept = features.one_gene_edges(ends, s, t)
    left = F.col("gene_is_left")

    def pick(a, b):
        return F.when(left, F.col(a)).otherwise(F.col(b))

    flat = kept.select(ids.node_local_id(pick("source_id", "target_id")).alias("gene"), pick("source_id", "target_id").alias("gene_node"),
                       "metaedge", F.when(left, F.lit("source")).otherwise(F.lit("target")).alias("side"),
                       pick("target_kind", "source_kind").alias("n_kind"), pick("target_id", "source_id").alias("n_id")).where("gene <> ''")
    names = flat.select("gene", F.col("gene_node").alias("id")).distinct().join(table.select("id", "name"), "id", "left")
    return {"matrix": features.typed_features(flat, F.col("gene"), ["metaedge", "side", "n_kind", "n_id"]),
            "symbols": names.groupBy("gene").agg(F.coalesce(F.min("name"), F.lit("")).alias("source_symbol")), "edge_counts": counts,
            "relation_counts": flat.groupBy("metaedge").agg(F.count(F.lit(1)).alias("included_edge_count")),
            "type_counts": flat.groupBy("n_kind").agg(F.count(F.lit(1)).alias("included_edge_count"))}


def context_vectors(parts: dict[str, DataFrame], master: DataFrame, k: int = 256) -> dict[str, DataFrame]:
    """Sublinear TF-IDF, SVD and z-score over all source genes, then a fan-out join by Entrez id."""
    quality.require_columns(master, GENE_COLUMNS, "master table")
    matrix = materialize(parts["matrix"], "features")
    if matrix.isEmpty():
        raise ValueError("no context edges were included")
    n_rows, n_cols = (matrix.agg(F.count_distinct("gene").alias("g"), F.count_distinct("feature").alias("f")).first())
    weights = features.tfidf(matrix, "gene", "feature", sublinear=True)
    f = linalg.truncated_svd(weights, "gene", "feature", "value", min(k, n_rows - 1, n_cols - 1))
    source = vectors.zscore(materialize(f.scores, "scores"), "vector", dtype="float").withColumnRenamed("row", "source_entrez_id")
    source = source.join(parts["symbols"].withColumnRenamed("gene", "source_entrez_id"), "source_entrez_id", "left")
    merged = mapping.indicator_join(master.select(*GENE_COLUMNS), source, "entrez_id", "source_entrez_id")
    mapped = merged.where("merge_state = 'both'").drop("merge_state")
    return {"vectors": mapped, "unmapped_master": merged.where("merge_state = 'left_only'").select(*GENE_COLUMNS),
            "unmapped_source": source.select("source_entrez_id", "source_symbol").join(
                master.select(F.col("entrez_id").alias("source_entrez_id")), "source_entrez_id", "left_anti"),
            "variance": f.variance_table(master.sparkSession),
            "features": matrix.groupBy("feature").agg(F.count(F.lit(1)).alias("n_genes")),
            "gate": quality.gate(mapped, "ensembl_gene_id", "vector", quality.GATE_BASIC)}
