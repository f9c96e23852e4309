"""Identifier mapping: unique-only joins, tiers, evidence agreement, reconciliation.

Uniqueness never needs the list of candidate genes: a key maps to exactly one
gene when its smallest and largest gene agree, and both are plain hash
aggregates with map-side combine. Candidate lists are delivered as long tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..session import materialize
from .skew import lookup, spread_join
from .vectors import vector_mean

MAPPED, AMBIGUOUS, UNMAPPED, EXCLUDED = "mapped", "ambiguous", "unmapped", "excluded"
MAX_OWN_KEYS = 64  # an owner's keys up to this number are kept in one cell
PAIR_SALTS = 8  # joins of many with many spread hot keys over as many tasks; the rows of the other side are copied as often


def id_pairs(master: DataFrame, gene: str, tokens: list[Column], keep=None) -> DataFrame:
    """``[id, gene]`` for every token of every mapping column, one scan of the master table."""
    merged = F.array_distinct(F.flatten(F.array(*tokens)))
    pairs = master.select(F.explode(merged).alias("id"), F.col(gene).alias("gene")).where(F.col("id") != "")
    return pairs.where(keep(F.col("id"))) if keep else pairs


def existing_columns(df: DataFrame, candidates: list[str]) -> list[str]:
    return [c for c in candidates if c in df.columns]


def id_index(pairs: DataFrame) -> DataFrame:
    """``[id, gene, n_genes]``, one row per id; ``gene`` is filled only if it is the only one."""
    return pairs.groupBy("id").agg(
        F.min("gene").alias("_lo"), F.count_distinct("gene").alias("n_genes")).select(
        "id", F.when(F.col("n_genes") == 1, F.col("_lo")).alias("gene"), "n_genes")


def ambiguity_report(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Long report ``[by, id, gene, n_genes]`` of ids that name more than one gene."""
    keys = [*(by or []), "id"]
    distinct = pairs.select(*keys, "gene").distinct()
    counts = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_genes")).where("n_genes > 1")
    return lookup(distinct, counts, keys, "inner")


def route(source: DataFrame, key: str, index: DataFrame, gene: str = "gene") -> DataFrame:
    """Left join of the source to the index with a ``status`` for every source row."""
    idx = index.select(F.col("id").alias(key), F.col("gene").alias(gene), "n_genes")
    joined = lookup(source, idx, [key], "left")
    return joined.withColumn("n_genes", F.coalesce("n_genes", F.lit(0))).withColumn(
        "status",
        F.when(F.coalesce(F.col(key), F.lit("")) == "", F.lit(EXCLUDED))
        .when(F.col("n_genes") == 1, F.lit(MAPPED))
        .when(F.col("n_genes") > 1, F.lit(AMBIGUOUS))
        .otherwise(F.lit(UNMAPPED)))


def status_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"))


def collapse(routed: DataFrame, gene: str, vector: str, key: str, extra: list[Column] | None = None) -> DataFrame:
    """Mean vector per mapped gene with its source count."""
    return vector_mean(routed.where(F.col("status") == MAPPED), [gene], vector, extra=extra)


def source_examples(routed: DataFrame, gene: str, order: str, key: str, n: int = 10, sep: str = ";") -> DataFrame:
    """The first ``n`` source keys of each gene in source order.

    The rank filter is a group limit that Spark also applies before the shuffle,
    so a gene with many rows sends at most ``n`` rows per map task.
    """
    from pyspark.sql import Window

    ranked = routed.select(gene, order, key).withColumn(
        "_r", F.row_number().over(Window.partitionBy(gene).orderBy(order))).where(F.col("_r") <= n)
    return ranked.groupBy(gene).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_r", F.col(key).cast("string").alias("k")))), lambda s: s["k"]), sep)
        .alias("source_keys_examples"))


def tier_index(tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """Merge the tiers' ``[id, gene]`` pairs into one row per id.

    ``hits`` holds, per tier in order, ``struct(gene, unique)``; NULL where the
    tier does not know the id. One wide index means one join for all tiers.
    """
    union = None
    for pos, (_, pairs) in enumerate(tiers):
        part = pairs.select("id", "gene", F.lit(pos).alias("tier"))
        union = part if union is None else union.unionByName(part)
    per_tier = union.groupBy("id", "tier").agg(F.min("gene").alias("lo"), F.max("gene").alias("hi"))
    hit = F.struct(F.col("lo").alias("gene"), (F.col("lo") == F.col("hi")).alias("unique"))
    return per_tier.groupBy("id").agg(
        *[F.first(F.when(F.col("tier") == i, hit), ignorenulls=True).alias(f"hit_{i}") for i in range(len(tiers))])


def resolve_tiers(source: DataFrame, key: str, tiers: list[tuple[str, DataFrame]], stop_on_ambiguity: bool) -> DataFrame:
    """Adds ``gene``, ``method`` (tier label) and ``status`` to the source.

    Fall-through: the first tier with a unique hit wins and ambiguity is only
    reported when no tier has one. Stop: the first tier that knows the key
    decides, unique or not.
    """
    index = tier_index(tiers).withColumnRenamed("id", key)
    joined = lookup(source, index, [key], "left")
    gene = method = status = None
    hits = [(label, F.col(f"hit_{i}")) for i, (label, _) in enumerate(tiers)]

    def chain(expr, cond, value):
        return F.when(cond, value) if expr is None else expr.when(cond, value)

    for label, hit in hits:
        unique = F.coalesce(hit["unique"], F.lit(False))
        gene = chain(gene, unique, hit["gene"])
        method = chain(method, unique, F.lit(label))
        status = chain(status, unique, F.lit(MAPPED))
        if stop_on_ambiguity:
            gene = chain(gene, hit.isNotNull(), F.lit(None))
            method = chain(method, hit.isNotNull(), F.lit(label))
            status = chain(status, hit.isNotNull(), F.lit(AMBIGUOUS))
    known = None
    for _, hit in hits:
        known = hit.isNotNull() if known is None else known | hit.isNotNull()
    if not stop_on_ambiguity:
        status = status.when(known, F.lit(AMBIGUOUS))
    return joined.select(*source.columns, gene.alias("gene"), method.alias("method"),
                         status.otherwise(F.lit(UNMAPPED)).alias("status"))


def primary_over_alias(pairs: DataFrame) -> DataFrame:
    """Index of ``[id, gene, kind]`` in which any primary use of a token hides its alias uses."""
    per_kind = pairs.groupBy("id", "kind").agg(F.min("gene").alias("lo"), F.max("gene").alias("hi"))
    best = per_kind.groupBy("id").agg(F.min_by(
        F.struct("lo", "hi", "kind"), F.when(F.col("kind") == "primary", F.lit(0)).otherwise(F.lit(1))).alias("b"))
    unique = F.col("b.lo") == F.col("b.hi")
    return best.select("id", F.when(unique, F.col("b.lo")).alias("gene"), F.col("b.kind").alias("kind"),
                       F.when(unique, F.lit(1)).otherwise(F.lit(2)).alias("n_genes"))


def best_method_mean(mapped: DataFrame, gene: str, tier: str, vector: str, label: str | None = None) -> DataFrame:
    """Mean vector over the rows of the best (lowest) tier present for each gene.

    Means are formed per (gene, tier) first; choosing the tier is then a second
    aggregate over at most a handful of rows per gene, with no join back.
    """
    per_tier = vector_mean(mapped, [gene, tier], vector)
    return per_tier.groupBy(gene).agg(
        F.min(tier).alias(tier),
        F.min_by("vector", tier).alias("vector"),
        F.min_by("n_source_rows", tier).alias("n_source_rows"),
        (F.sum("n_source_rows") - F.min_by("n_source_rows", tier)).alias("n_unused_rows"))


def evidence_index(evidence: DataFrame) -> DataFrame:
    """``[method, key, gene]`` -> one row per (method, key) with its gene range."""
    return evidence.groupBy("method", "key").agg(F.min("gene").alias("lo"), F.max("gene").alias("hi"))


def agree(source: DataFrame, src: str, keys: Column, evidence: DataFrame) -> DataFrame:
    """Union of candidates over several key types; mapped only if all name one gene.

    ``keys`` is ``array<struct(method, key)>``. Output ``[src, gene, methods, status]``.
    """
    asked = source.select(src, F.explode(keys).alias("k")).select(
        src, F.col("k.method").alias("method"), F.col("k.key").alias("key")).where("key <> ''")
    hits = lookup(asked, evidence_index(evidence), ["method", "key"], "inner")
    found = hits.groupBy(src).agg(
        F.min("lo").alias("_lo"), F.max("hi").alias("_hi"),
        F.array_join(F.array_sort(F.collect_set("method")), ";").alias("methods"))
    joined = lookup(source, found, [src], "left")
    unique = F.col("_lo") == F.col("_hi")
    return joined.select(
        *source.columns,
        F.when(unique, F.col("_lo")).alias("gene"), F.coalesce("methods", F.lit("")).alias("methods"),
        F.when(F.col("_lo").isNull(), F.lit(UNMAPPED)).when(unique, F.lit(MAPPED))
        .otherwise(F.lit(AMBIGUOUS)).alias("status"))


def _with_own_keys(rows: DataFrame, owner: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The ``[owner, method, key]`` rows of owners with at most ``MAX_OWN_KEYS`` keys, these sorted in ``name``, and the rows of all other owners."""
    rows = materialize(rows, "keys")
    wide = rows.groupBy(owner).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MAX_OWN_KEYS).select(F.col(owner).alias("_wide"))
    is_wide = F.col(owner).eqNullSafe(F.col("_wide"))
    own = rows.join(wide, is_wide, "left_anti").groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("method", "key"))).alias(name))
    few = own.select(owner, name, F.explode(name).alias("k")).select(owner, "k.method", "k.key", name)
    return materialize(few, "keys_few"), materialize(rows.join(wide, is_wide, "left_semi"), "keys_many")


def conflict_candidates(source: DataFrame, src: str, keys: Column, evidence: DataFrame) -> DataFrame:
    """Long table ``[src, gene, n_candidates]`` of the candidates of sources whose evidence disagrees.

    A key shared by many sources and many genes gives the product of both as
    pairs. They are never held or shuffled: a pair comes from the first of the
    source's keys that the gene has, so it is known to be new where the join
    makes it. The join runs twice, once to count per source, then for the
    sources in conflict. Only owners with very many keys make their pairs
    distinct by a shuffle.
    """
    on = ["method", "key"]
    asked = source.where(F.col(src).isNotNull()).select(src, F.explode(keys).alias("k")).select(
        src, F.col("k.method").alias("method"), F.col("k.key").alias("key")).where("key <> ''").distinct()
    few, many = _with_own_keys(asked, src, "_asked")
    held, held_many = _with_own_keys(evidence.select(*on, "gene").where("method IS NOT NULL AND key IS NOT NULL").distinct(), "gene", "_held")
    few = few.select(src, *on, F.filter("_asked", lambda k: k < F.struct("method", "key")).alias("_before"))

    def first_hits(questions):
        hits = spread_join(questions, held, on, "inner", [src], PAIR_SALTS)
        return hits.where((F.size("_before") == 0) | ~F.arrays_overlap("_before", "_held"))

    rest = None
    if not (many.isEmpty() and held_many.isEmpty()):
        rest = spread_join(many, held.select(*on, "gene").unionByName(held_many.select(*on, "gene")), on, "inner", [src], PAIR_SALTS).select(src, "gene")
        rest = rest.unionByName(spread_join(few.select(src, *on), held_many, on, "inner", [src], PAIR_SALTS).select(src, "gene")).distinct()
    pairs = first_hits(few).select(src, "gene")
    counted = (pairs if rest is None else pairs.unionByName(rest)).groupBy(src).agg(F.count(F.lit(1)).alias("n_candidates"))
    counted = materialize(counted.where("n_candidates > 1"), "conflicts")
    out = first_hits(lookup(few, counted, [src], "inner")).select(src, "gene", "n_candidates")
    return out if rest is None else out.unionByName(lookup(rest, counted, [src], "inner").select(src, "gene", "n_candidates"))


def first_match(owner: DataFrame, owner_key: str, candidates: Column, source: DataFrame, source_key: str) -> DataFrame:
    """First candidate (in order) of each owner that the source knows.

    ``candidates`` is an array of keys. Output ``[owner_key, matched_key, matched_position]``.
    """
    known = source.select(F.col(source_key).alias("_k")).distinct()
    asked = owner.select(owner_key, F.posexplode(candidates).alias("_p", "_k")).where("_k <> ''")
    hits = lookup(asked, known, ["_k"], "inner")
    return hits.groupBy(owner_key).agg(F.min_by("_k", "_p").alias("matched_key"),
                                       F.min("_p").alias("matched_position"))


def indicator_join(master: DataFrame, source: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join with a ``merge_state``; shared keys on either side fan out."""
    marked = source.withColumn("_present", F.lit(True)).withColumn("_on", F.col(right_key))
    return (spread_join(master.withColumn("_on", F.col(left_key)), marked, ["_on"], "left")
            .withColumn("merge_state", F.when(F.col("_present"), F.lit("both")).otherwise(F.lit("left_only")))
            .drop("_present", "_on"))


def assert_unique(df: DataFrame, keys: list[str], what: str) -> None:
    """Raise if a key repeats; one aggregate, stops at the first offender."""
    bad = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if bad:
        raise ValueError(f"{what}: duplicate key {[bad[0][k] for k in keys]}")


def one_to_one_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    assert_unique(left, [key], "left side")
    assert_unique(right, [key], "right side")
    return left.join(right, key, how)


def exact_then_stripped(master: DataFrame, id_col: str, tokens: DataFrame, token_key: str, value: str,
                        missing: str, exact: str, stripped: str) -> DataFrame:
    """Look an id up as it is, then without its version; status names the rule."""
    asked = master.withColumn("_q", F.array(F.col(id_col), F.substring_index(id_col, ".", 1)))
    asked = asked.select(id_col, F.posexplode("_q").alias("_p", "_k")).where("_k <> ''").distinct()
    best = (spread_join(asked, tokens.select(F.col(token_key).alias("_k"), F.col(value).alias("_v")), ["_k"], "inner", [id_col])
            .groupBy(id_col).agg(F.min_by("_v", "_p").alias(value), F.min("_p").alias("_p")))
    return lookup(master, best, [id_col], "left").withColumn(
        "status", F.when(F.col("_p") == 0, F.lit(exact)).when(F.col("_p") == 1, F.lit(stripped))
        .otherwise(F.lit(missing))).drop("_p")


# Names of the three transcript lookup rules, in order.
TRANSCRIPT_RULES = (
    "canonical_transcript_id_versioned_exact",
    "canonical_transcript_id_unversioned_exact",
    "canonical_transcript_id_exact_in_versioned_index",
)


def transcript_lookup(master: DataFrame, gene: str, versioned: str, plain: str,
                      records: DataFrame, record_id: str, file_row: str, payload: str) -> DataFrame:
    """Versioned, then unversioned, then plain-in-versioned lookup of a sequence.

    The first record of the file wins per key. Output ``[gene, source_id, payload, method]``.
    """
    keyed = records.select(
        F.explode(F.array(
            F.struct(F.lit("v").alias("kind"), F.col(record_id).alias("key")),
            F.struct(F.lit("u").alias("kind"), F.substring_index(record_id, ".", 1).alias("key")))).alias("k"),
        F.col(file_row).alias("_row"), F.col(payload).alias(payload))
    index = keyed.groupBy("k").agg(F.min_by(payload, "_row").alias(payload))
    asked = master.select(gene, F.posexplode(F.array(
        F.struct(F.lit("v").alias("kind"), ids.strip(versioned).alias("key")),
        F.struct(F.lit("u").alias("kind"), ids.strip(plain).alias("key")),
        F.struct(F.lit("v").alias("kind"), ids.strip(plain).alias("key")))).alias("_p", "k")).where("k.key <> ''")
    hits = lookup(asked, index, ["k"], "inner")
    best = hits.groupBy(gene).agg(F.min_by(F.struct(F.col("k.key").alias("source_id"), payload, "_p"), "_p").alias("b"))
    rule = F.element_at(F.array(*[F.lit(r) for r in TRANSCRIPT_RULES]), F.col("b._p") + 1)
    return best.select(gene, "b.source_id", F.col(f"b.{payload}").alias(payload), rule.alias("method"))


def apply_mapping(master: DataFrame, key: str, mapping: DataFrame, columns: list[str],
                  default_status: str = "not_queried_or_no_result", status_col: str = "id_mapping_status") -> DataFrame:
    """Overwrite columns from a mapping table; rows without a result get blanks and the default status."""
    kept = [c for c in master.columns if c not in columns]
    joined = lookup(master.select(*kept), mapping.select(key, *columns), [key], "left")
    return joined.select(*kept, *[
        F.coalesce(F.col(c), F.lit(default_status if c == status_col else "")).alias(c) for c in columns])


def reconcile(current: Column, external_a: Column, external_b: Column, fill_all: bool) -> Column:
    """``struct(value, status, note)`` of a current id cell against two external id arrays."""
    cur = F.array_distinct(ids.split_ids_any(current))
    ext = F.array_union(external_a, external_b)

    def cell(arr):
        return ids.join_unique(arr, ";", "any_case_null")

    def result(value, status, note=None):
        return F.struct(value.alias("value"), F.lit(status).alias("status"),
                        (F.lit("") if note is None else note).alias("note"))

    shown = cell(cur) if fill_all else ids.clean(current, "any_case_null")
    conflict = F.concat(F.lit("current="), cell(cur), F.lit("; external="), cell(ext))
    known = (F.when((F.size(cur) > 0) & (F.size(ext) == 0), result(shown, "current_only_no_external_mapping"))
             .when((F.size(cur) > 0) & F.arrays_overlap(cur, ext), result(shown, "agreement"))
             .when(F.size(cur) > 0, result(shown, "conflict", conflict)))
    if fill_all:
        return known.when(F.size(ext) > 0, result(cell(ext), "filled_from_external")).otherwise(
            result(F.lit(""), "still_missing"))
    return (known.when(F.size(ext) == 1, result(cell(ext), "filled_from_external"))
            .when(F.size(ext) > 1, result(F.lit(""), "missing_ambiguous_external",
                                          F.concat(F.lit("external="), cell(ext))))
            .otherwise(result(F.lit(""), "still_missing")))


def review_flag(entrez_status, uniprot_status, entrez, uniprot) -> Column:
    es, us = ids._col(entrez_status), ids._col(uniprot_status)
    flags = F.array_compact(F.array(
        F.when((es == "conflict") | (us == "conflict"), F.lit("conflict")),
        F.when(es == "missing_ambiguous_external", F.lit("ambiguous_entrez")),
        F.when(ids.clean(entrez, "any_case_null") == "", F.lit("missing_entrez")),
        F.when(ids.clean(uniprot, "any_case_null") == "", F.lit("missing_uniprot"))))
    return F.when(F.size(flags) == 0, F.lit("ok")).otherwise(F.array_join(flags, ";"))
