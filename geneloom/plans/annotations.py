"""Plans on gene annotation files: term profiles and ontology corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import features, graph, linalg, mapping, quality, vectors
from ..session import materialize


def negated(qualifier) -> Column:
    return F.array_contains(F.transform(F.split(qualifier, r"\|"), ids.strip), "NOT")


def _process_classes(df: DataFrame) -> tuple[Column, Column, Column, Column]:
    other_aspect = F.col("aspect") != "P"
    is_not = ~other_aspect & negated("qualifier")
    other_db = ~other_aspect & ~is_not & (F.col("db") != "UniProtKB")
    return other_aspect, is_not, other_db, ~other_aspect & ~is_not & ~other_db


def annotation_accounting(rows: DataFrame) -> DataFrame:
    """Row accounting of a process-annotation filter in one aggregate; the classes are disjoint."""
    a, n, d, k = _process_classes(rows)
    return rows.agg(F.count(F.lit(1)).alias("data_rows"), F.count_if(a).alias("other_aspect"), F.count_if(n).alias("negated"),
                    F.count_if(d).alias("other_database"), F.count_if(k).alias("kept"))


def process_profiles(gaf: DataFrame) -> DataFrame:
    """Distinct ``[accession, go_id]`` of non-negated process annotations."""
    kept = gaf.where(_process_classes(gaf)[3])
    bad = kept.where((F.col("accession") == "") | ~F.col("go_id").startswith("GO:")).limit(1).count()
    if bad:
        raise ValueError("malformed process association")
    return kept.select("accession", "go_id").distinct()


def process_term_vectors(gaf: DataFrame, master: DataFrame, k: int = 256) -> dict[str, DataFrame]:
    """TF-IDF + SVD of term profiles, mapped to genes by accession and averaged per gene."""
    profiles = materialize(process_profiles(gaf), "profiles")
    weights = features.tfidf(profiles.withColumn("value", F.lit(1.0)), "accession", "go_id")
    f = linalg.truncated_svd(weights, "accession", "go_id", "value", k)
    source = f.scores.withColumnRenamed("row", "accession")
    column = "map_uniprot_ids_all" if "map_uniprot_ids_all" in master.columns else "uniprot_id"
    index = mapping.id_index(mapping.id_pairs(master, "ensembl_gene_id", [ids.split_tokens(column, r"\|", "trim")]))
    routed = mapping.route(source, "accession", index)
    genes = mapping.collapse(routed, "gene", "vector", "accession")
    return {"vectors": genes, "routing": routed.drop("vector"),
            "gate": quality.gate(genes, "gene", "vector", quality.GATE_ANNOTATION),
            "variance": f.variance_table(master.sparkSession)}


def lenient_annotations(gaf: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``[entity, term, symbol, evidence]`` of rows usable with a known term, and the row accounting."""
    known = terms.select(F.col("term_id").alias("go_id"), F.lit(True).alias("_known"))
    full = gaf.withColumn("entity", ids.canonical_uniprot("accession", last_pipe_field=True))
    joined = full.join(known, "go_id", "left")
    short = F.col("n_fields") < 15
    is_not = ~short & F.array_contains(F.split("qualifier", r"\|"), "NOT")
    good = ~short & ~is_not & (F.col("db") == "UniProtKB") & (F.col("entity") != "") & F.col("_known").isNotNull()
    stats = joined.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(is_not).alias("skipped_not"),
                       F.count_if(good).alias("kept"), F.count_if(~is_not & ~good).alias("skipped_bad"))
    kept = joined.where(good).select("entity", F.col("go_id").alias("term"), ids.strip("symbol").alias("symbol"), "evidence")
    return kept, stats


def ontology_vectors(gaf: DataFrame, terms: DataFrame, master: DataFrame, dim: int = 200, window: int = 10) -> dict[str, DataFrame]:
    """Corpus of annotation and ontology sentences, skip-gram, mapped and standardised per gene."""
    kept, stats = lenient_annotations(gaf, terms)
    kept = materialize(kept, "annotations")
    parents = terms.select(F.col("term_id").alias("child"), F.explode("parents").alias("parent"))
    known = terms.select(F.col("term_id").alias("parent"))
    ancestors = graph.closure(parents.join(known, "parent", "left_semi"))
    corpus = graph.association_sentences(kept, ancestors, kept.select("entity", "symbol")).unionByName(
        graph.ontology_sentences(terms))
    corpus = materialize(corpus, "corpus")
    words = graph.skip_gram(corpus, "tokens", dim, window)
    entities = kept.select("entity").distinct().withColumn("word", ids.entity_token("entity"))
    source = entities.join(words, "word").select("entity", "vector")
    cols = mapping.existing_columns(master, ["uniprot_id", "hgnc_uniprot_ids", "map_uniprot_ids_all"])
    tokens = [F.transform(ids.split_tokens(c), lambda x: ids.canonical_uniprot(x, True)) for c in cols]
    routed = mapping.route(source, "entity", mapping.id_index(mapping.id_pairs(master, "ensembl_gene_id", tokens)))
    genes = mapping.collapse(routed, "gene", "vector", "entity")
    return {"vectors": vectors.zscore(genes, "vector", dtype="float"), "routing": routed.drop("vector"),
            "corpus": corpus, "stats": stats}
