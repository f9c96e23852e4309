"""Plans on numeric tables: expression, dependency, protein level and location, context vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, num
from ..operators import features, linalg, mapping, quality, reshape, vectors
from ..session import materialize
from .genome import standard_protein_coding

GENE_COLUMNS = ["ensembl_gene_id", "gene_symbol", "gene_type", "entrez_id", "uniprot_id"]


def _split(joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (joined.where("merge_state = 'both'").drop("merge_state"),
            joined.where("merge_state = 'left_only'").select(*GENE_COLUMNS))


def _conform(master: DataFrame, source: DataFrame, left_key: str, right_key: str) -> tuple[DataFrame, DataFrame]:
    quality.require_columns(master, GENE_COLUMNS, "master table")
    return _split(mapping.indicator_join(master.select(*GENE_COLUMNS), source, left_key, right_key))


def expression_vectors(gct: DataFrame, master: DataFrame) -> dict[str, DataFrame]:
    """Tissue medians: unversioned id, mean of duplicates, log1p, z-score over mapped genes."""
    quality.require_columns(gct, ["Name", "Description", "file_row"], "expression table")
    tissues = [c for c in gct.columns if c not in ("Name", "Description", "file_row")]
    cells = F.array(*[F.coalesce(num.to_number(F.col(f"`{c}`")), F.lit(0.0)) for c in tissues])
    rows = gct.select(ids.strip_version_suffix("Name").alias("source_id"), "Name", "Description", "file_row", cells.alias("vector"))
    merged = vectors.vector_mean(rows, ["source_id"], "vector", extra=[
        F.min_by(F.struct(F.col("Name").alias("source_id_versioned"), F.col("Description").alias("source_symbol")), "file_row").alias("m")])
    mapped, unmapped = _conform(master, merged.select("source_id", "vector", "m.*"), "ensembl_gene_id", "source_id")
    mapped = materialize(mapped.withColumn("vector", F.transform("vector", F.log1p)), "mapped")
    return {"vectors": vectors.zscore(mapped, "vector", dtype="float"), "unmapped": unmapped}


def dependency_vectors(effect: DataFrame, master: DataFrame, model_key: str, k: int = 256) -> dict[str, DataFrame]:
    """Models x genes table: parse gene columns, impute, transpose, merge, standardise, PCA.

    ``effect`` is wide with one column per gene. The transposed matrix is the long
    table keyed by gene column.
    """
    genes = [c for c in effect.columns if c != model_key]
    long = reshape.transpose_long(effect, model_key, genes, "source_column", "value")
    long = long.withColumn("symbol", ids.gene_column_symbol("source_column")).withColumn(
        "source_entrez", ids.gene_column_entrez("source_column")).where("source_entrez <> ''")
    means = long.groupBy("source_column").agg(F.coalesce(F.avg(F.when(~F.isnan("value"), F.col("value"))), F.lit(0.0)).alias("_m"))
    filled = long.join(means, "source_column").withColumn(
        "value", F.when(F.col("value").isNull() | F.isnan("value"), F.col("_m")).otherwise(F.col("value")))
    merged = filled.groupBy("source_entrez", model_key).agg(F.avg("value").alias("value"))
    rows = reshape.long_to_vectors(merged, "source_entrez", model_key, "value")
    meta = long.groupBy("source_entrez").agg(F.min_by("symbol", "source_column").alias("source_symbol"))
    mapped, unmapped = _conform(master, rows.join(meta, "source_entrez"), "entrez_id", "source_entrez")
    scaled = materialize(vectors.zscore(mapped, "vector"), "scaled")
    f = linalg.dense_factorisation(scaled, "ensembl_gene_id", "vector", k, centre=True)
    return {"vectors": scaled.drop("vector").join(f.scores, "ensembl_gene_id"), "unmapped": unmapped,
            "variance": f.variance_table(master.sparkSession)}


def protein_level_vectors(ihc: DataFrame, master: DataFrame) -> dict[str, DataFrame]:
    """Max ordinal level per gene and tissue, absent tissues 0, z-score over mapped genes."""
    quality.require_columns(ihc, ["Gene", "Gene name", "Tissue", "Cell type", "Level", "Reliability"], "level table")
    rows = ihc.withColumn("level_value", num.ordinal_level("Level"))
    excluded = rows.where("level_value IS NULL").groupBy("Level").agg(F.count(F.lit(1)).alias("n_rows"))
    usable = rows.where("level_value IS NOT NULL")
    tissues = features.distinct_labels(usable, "Tissue")
    best = usable.groupBy("Gene", "Tissue").agg(F.max("level_value").alias("level_value"))
    source = reshape.long_to_vectors(best, "Gene", "Tissue", "level_value", tissues)
    names = usable.groupBy("Gene").agg(F.min_by("Gene name", "file_row").alias("hpa_gene_name"))
    mapped, unmapped = _conform(master, source.join(names, "Gene").withColumnRenamed("Gene", "hpa_gene"), "ensembl_gene_id", "hpa_gene")
    spark = master.sparkSession
    return {"vectors": vectors.zscore(mapped, "vector", dtype="float"), "unmapped": unmapped, "excluded_levels": excluded,
            "columns": spark.createDataFrame([(i, x) for i, x in enumerate(tissues)], "position int, tissue string")}


LOCATION_COLUMNS = ("Main location", "Additional location", "Extracellular location")


def location_vectors(subcell: DataFrame, master: DataFrame) -> dict[str, DataFrame]:
    """Multi-hot locations from three list columns, z-score over mapped genes."""
    quality.require_columns(subcell, ["Gene", "Gene name", "Reliability", *LOCATION_COLUMNS], "location table")
    lists = F.array_union(F.array_union(*[ids.split_semicolon(c) for c in LOCATION_COLUMNS[:2]]), ids.split_semicolon(LOCATION_COLUMNS[2]))
    pairs = subcell.select("Gene", F.explode(lists).alias("location")).distinct()
    places = features.distinct_labels(pairs, "location")
    if not places:
        raise ValueError("no locations parsed")
    hot = pairs.withColumn("v", F.lit(1.0))
    everyone = subcell.groupBy("Gene").agg(F.min_by(F.struct(F.col("Gene name").alias("hpa_gene_name"), F.col("Reliability").alias("hpa_reliability")),
                                                    "file_row").alias("m"))
    dense = reshape.long_to_vectors(hot, "Gene", "location", "v", places)
    source = everyone.join(dense, "Gene", "left").select(
        F.col("Gene").alias("hpa_gene"), "m.*", F.coalesce("vector", F.array_repeat(F.lit(0.0), len(places))).alias("vector"))
    mapped, unmapped = _conform(master, source, "ensembl_gene_id", "hpa_gene")
    spark = master.sparkSession
    return {"vectors": vectors.zscore(mapped, "vector", dtype="float"), "unmapped": unmapped,
            "columns": spark.createDataFrame([(i, x) for i, x in enumerate(places)], "position int, location string")}


def context_mean(rows: DataFrame, gene: str, tissue: str, vector: str) -> DataFrame:
    """Mean over all contexts but ``global``, with the context count."""
    m = vectors.vector_mean(rows.where(F.col(tissue) != "global"), [gene], vector)
    return m.withColumnRenamed("n_source_rows", "context_count")


def global_context(rows: DataFrame, gene: str, tissue: str, vector: str, order: str) -> DataFrame:
    """The ``global`` row of each gene; the last one wins."""
    return rows.where(F.col(tissue) == "global").groupBy(gene).agg(F.max_by(vector, order).alias("vector"))


# Columns that may hold Entrez ids, best first.
ENTREZ_PREFERRED = ["entrez_id", "entrez_gene_id", "ncbi_gene_id", "map_entrez_id", "map_entrez_ids_all", "entrez_ids_all"]


def context_vectors(rows: DataFrame, master: DataFrame) -> dict[str, DataFrame]:
    """``entrez_id, tissue, embedding`` rows to one global and one context-mean vector per gene.

    Each gene takes its first unambiguous Entrez id that has a vector of the kind.
    """
    gene = quality.find_column(master, ["ensembl_gene_id", "gene_id", "master_ensembl_gene_id", "ensembl_id"])
    cols = quality.columns_containing(master, ENTREZ_PREFERRED, ["entrez", "ncbi_gene"])
    if gene is None or not cols:
        raise ValueError("the master table needs a gene id and an Entrez column")
    ordered = F.array_distinct(F.flatten(F.array(*[ids.extract_entrez_ids(c) for c in cols])))
    owners = master.where(ids.strip(gene) != "").select(F.col(gene).alias("gene"), ordered.alias("cands"))
    unique = mapping.id_index(owners.select(F.explode("cands").alias("id"), "gene")).where("n_genes = 1").select("id")
    # the order of the rows as they were read, before any join
    placed = rows.withColumn("_row", F.col("file_row") if "file_row" in rows.columns else F.monotonically_increasing_id())
    wanted = placed.withColumn("entrez_id", F.col("entrez_id").cast("string")).join(
        unique.withColumnRenamed("id", "entrez_id"), "entrez_id", "left_semi").withColumn("embedding", num.as_float_vector("embedding"))
    out = {}
    for name, table in (("global", global_context(wanted, "entrez_id", "tissue", "embedding", "_row").withColumn("context_count", F.lit(1).cast("bigint"))),
                        ("mean", context_mean(wanted, "entrez_id", "tissue", "embedding"))):
        picked = mapping.first_match(owners, "gene", F.col("cands"), table, "entrez_id")
        out[name] = picked.select("gene", F.col("matched_key").alias("entrez_id")).join(table, "entrez_id").select(
            "gene", "entrez_id", "context_count", num.as_float_vector("vector").alias("vector"))
    out["context_counts"] = rows.groupBy("tissue").agg(F.count(F.lit(1)).alias("rows"))
    return out


def regulatory_vectors(chunks: DataFrame, master: DataFrame, feature_columns: list[str], k: int = 256) -> dict[str, DataFrame]:
    """Union of summary chunks, one-to-one join, imputation, standardisation, PCA."""
    target = standard_protein_coding(master).select(*GENE_COLUMNS, "chromosome", "gene_start", "gene_end", "strand", "assembly")
    cells = [num.to_number(F.col(f"`{c}`")) for c in feature_columns]
    given = F.forall(F.array(*[F.col(f"`{c}`").isNotNull() for c in feature_columns]), lambda x: x)
    raw = chunks.select("ensembl_gene_id", "input_interval", "tss_1based", F.array(*cells).alias("vector"), given.alias("_full"))
    merged = mapping.one_to_one_join(target, raw, "ensembl_gene_id")
    covered = merged.where("_full").drop("_full")
    filled = materialize(vectors.impute_column_mean(covered, "vector"), "filled")
    stats = vectors.column_stats(filled, "vector")
    scaled = materialize(vectors.zscore(filled, "vector", stats=stats), "scaled")
    f = linalg.dense_factorisation(scaled, "ensembl_gene_id", "vector", k, centre=True, seed=0)
    return {"vectors": scaled.drop("vector").join(f.scores, "ensembl_gene_id"), "standardised": scaled,
            "feature_stats": stats.select("dim", "mean", "std", (F.col("std") == 0).alias("zero_std")),
            "components": f.loadings, "variance": f.variance_table(master.sparkSession)}


def entity_vectors(entities: DataFrame, matrix: DataFrame, master: DataFrame) -> dict[str, DataFrame]:
    """Graph entities ``[name, index]`` with a matrix ``[row, vector]``: numeric gene entities, mean per gene."""
    check = quality.permutation_check(entities, "index").first()
    if not check["is_permutation"]:
        raise ValueError("entity indices are not a permutation of the matrix rows")
    mapping.assert_unique(entities, ["name"], "entity names")
    genes = entities.where(F.col("name").startswith("Gene::")).withColumn("entrez", F.coalesce(
        ids.gene_entity_entrez("name").cast("string"), F.lit("")))
    column = "map_entrez_ids_all" if "map_entrez_ids_all" in master.columns else "entrez_id"
    tokens = F.filter(F.transform(F.split(column, r"\|"), ids.canonical_digits), lambda x: x != "")
    routed = mapping.route(genes, "entrez", mapping.id_index(mapping.id_pairs(master, "ensembl_gene_id", [tokens])))
    routed = routed.withColumn("status", F.when(F.col("status") == "excluded", F.lit("non_numeric_gene_identifier")).otherwise(F.col("status")))
    picked = routed.where("status = 'mapped'").select("gene", F.col("index").alias("row"), "status").join(matrix, "row")
    out = mapping.collapse(picked, "gene", "vector", "row", [F.min("row").alias("first_row")])
    return {"vectors": out.withColumn("vector", num.as_float_vector("vector")), "routing": routed,
            "gate": quality.gate(out, "gene", "vector", quality.GATE_STRICT)}


def exact_id_vectors(source: DataFrame, master: DataFrame, dim: int) -> dict[str, DataFrame]:
    """``[gene_id, vector]`` rows kept if the id is a master gene; no collapse."""
    bad = source.agg(F.count_if(~F.col("gene_id").rlike(r"^ENSG[0-9]{11}$")).alias("bad_id"),
                     F.count_if(~num.is_finite("vector")).alias("bad_vector"), F.count_if(F.size("vector") != dim).alias("bad_dim")).first()
    if any(bad):
        raise ValueError(f"source rows break the id, finite or width rule: {bad.asDict()}")
    mapping.assert_unique(source, ["gene_id"], "source ids")
    known = master.select(F.col("ensembl_gene_id").alias("gene_id"), F.lit("mapped_exact_ensembl_gene_id").alias("status"))
    report = source.select("gene_id").join(known, "gene_id", "left").fillna("not_in_master_table", ["status"])
    kept = source.join(known.select("gene_id"), "gene_id", "left_semi").withColumn("vector", num.as_float_vector("vector"))
    return {"vectors": kept, "routing": report, "gate": quality.gate(kept, "gene_id", "vector", quality.GATE_STRICT)}
