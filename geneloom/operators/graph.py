"""Graph operators on long edge tables."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids
from ..functions.num import xxhash64
from ..session import materialize, release, shuffle_partitions
from . import mapped
from .ranges import with_row_index
from .skew import lookup, spread_join

# Evidence channels and score threshold of a detailed links file.
LINK_CHANNELS = ("neighborhood", "fusion", "cooccurence", "coexpression", "experimental", "database", "textmining")
MIN_SCORE = 150
MAX_CHANNELS = 10000  # one total per channel is broadcast


def channel_edges(links: DataFrame, a: str, b: str, channels: list[str], order: str, min_score: float) -> DataFrame:
    """Split a weighted multigraph by channel: ``[channel, src, dst, score]``.

    Scores below the threshold and self edges go; of the rows of one undirected
    pair the first in file order is kept. Its direction and score are numbers, so
    the aggregate keeps them in place in a hash table and sorts nothing.
    """
    long = (links.where(F.col(a) != F.col(b))
            .unpivot([a, b, order], list(channels), "channel", "score")
            .where(F.col("score") >= min_score))
    rising = F.col(a) < F.col(b)
    return (long.withColumn("_lo", F.least(a, b)).withColumn("_hi", F.greatest(a, b))
            .groupBy("channel", "_lo", "_hi").agg(F.min_by(rising, order).alias("_rising"), F.min_by("score", order).alias("score"))
            .select("channel", F.when(F.col("_rising"), F.col("_lo")).otherwise(F.col("_hi")).alias("src"),
                    F.when(F.col("_rising"), F.col("_hi")).otherwise(F.col("_lo")).alias("dst"), "score"))


def node_universe(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    return edges.select(F.explode(F.array(a, b)).alias("node")).distinct()


def undirected_pairs(edges: DataFrame, a: str, b: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """``[by, lo, hi, value]``: one row per undirected pair with the sum of its edges; a self edge counts twice, once per direction."""
    by = by or []
    rising = F.coalesce(F.col(a) <= F.col(b), F.col(a).isNull())  # a missing end comes first
    pairs = edges.select(*by, F.when(rising, F.col(a)).otherwise(F.col(b)).alias("lo"), F.when(rising, F.col(b)).otherwise(F.col(a)).alias("hi"),
                         F.col(weight).alias("value")).groupBy(*by, "lo", "hi").agg(F.sum("value").alias("value"))
    return pairs.withColumn("value", F.when(F.col("lo").eqNullSafe(F.col("hi")), F.col("value") + F.col("value")).otherwise(F.col("value")))


def both_directions(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``[by, row, col, value]`` from one row per undirected pair."""
    there = F.struct(F.col("lo").alias("row"), F.col("hi").alias("col"))
    back = F.struct(F.col("hi").alias("row"), F.col("lo").alias("col"))
    ends = F.explode(F.when(F.col("lo").eqNullSafe(F.col("hi")), F.array(there)).otherwise(F.array(there, back)))
    return pairs.select(*(by or []), ends.alias("e"), "value").select(*(by or []), "e.row", "e.col", "value")


def symmetric_adjacency(edges: DataFrame, a: str, b: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """``[by, row, col, value]``: both directions, duplicates summed, zeros dropped.

    Both directions have the same sum, so it is formed once per undirected pair
    and copied after the shuffle.
    """
    return both_directions(undirected_pairs(edges, a, b, weight, by).where("value <> 0"), by)


def neighbour_pairs(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``[node, neighbour]`` of the unweighted undirected graph; blank and self edges skipped. A pair is shuffled once, not once per direction."""
    ok = edges.where((F.coalesce(F.col(a), F.lit("")) != "") & (F.coalesce(F.col(b), F.lit("")) != "")
                     & (F.col(a) != F.col(b)))
    once = ok.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()
    return once.select(F.explode(F.array(
        F.struct(F.col("lo").alias("node"), F.col("hi").alias("neighbour")),
        F.struct(F.col("hi").alias("node"), F.col("lo").alias("neighbour")))).alias("e")).select("e.*")


def ppmi(adj: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Positive pointwise mutual information on the non-zero cells of ``[by, row, col, value]``.

    The adjacency is written once, as four later steps read it. Row and column
    sums double as the frequency tables for salting hub nodes.
    """
    by = by or []
    adj = materialize(adj, "adjacency")
    rows = adj.groupBy(*by, "row").agg(F.sum("value").alias("_rs"), F.count(F.lit(1)).alias("_deg"))
    cols = adj.groupBy(*by, "col").agg(F.sum("value").alias("_cs"), F.count(F.lit(1)).alias("_deg"))
    out = lookup(adj, rows.select(*by, "row", "_rs"), [*by, "row"], "inner", rows, "_deg", ["col"])
    out = lookup(out, cols.select(*by, "col", "_cs"), [*by, "col"], "inner", cols, "_deg", ["row"])
    if by:
        totals = materialize(rows.groupBy(*by).agg(F.sum("_rs").alias("_total")), "totals")  # one row per channel
        if totals.count() > MAX_CHANNELS:
            raise ValueError(f"more than {MAX_CHANNELS} channels")
        out = out.join(F.broadcast(totals), by)
    else:
        out = out.withColumn("_total", rows.agg(F.sum("_rs").alias("t")).scalar())
    score = F.log(F.col("_total") * F.col("value") / (F.col("_rs") * F.col("_cs")))
    return out.select(*by, "row", "col", score.alias("value")).where("value > 0")


def symmetric_ppmi(edges: DataFrame, a: str, b: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """:func:`ppmi` of :func:`symmetric_adjacency`, with half of its rows until the end.

    Both directions of a pair have one score, and a node's row sum is its column
    sum, so one row per undirected pair meets one table of node sums.
    """
    by = by or []
    pairs = materialize(undirected_pairs(edges, a, b, weight, by).where("value <> 0"), "pairs")
    sums = materialize(both_directions(pairs, by).groupBy(*by, F.col("row").alias("node")).agg(
        F.sum("value").alias("_sum"), F.count(F.lit(1)).alias("_deg")), "node_sums")
    out = pairs
    for end, other in (("lo", "hi"), ("hi", "lo")):
        at = sums.select(*by, F.col("node").alias(end), F.col("_sum").alias(f"_{end}"), "_deg")
        out = lookup(out, at.drop("_deg"), [*by, end], "inner", at, "_deg", [other])
    if by:
        totals = materialize(sums.groupBy(*by).agg(F.sum("_sum").alias("_total")), "totals")  # one row per channel
        if totals.count() > MAX_CHANNELS:
            raise ValueError(f"more than {MAX_CHANNELS} channels")
        out = out.join(F.broadcast(totals), by)
    else:
        out = out.withColumn("_total", sums.agg(F.sum("_sum").alias("t")).scalar())
    score = F.log(F.col("_total") * F.col("value") / (F.col("_lo") * F.col("_hi")))
    return both_directions(out.select(*by, "lo", "hi", score.alias("value")).where("value > 0"), by)


def closure(parents: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """``[term, ancestor]``: all ancestors over ``[child, parent]`` edges, a depth of 2ⁿ in n rounds.

    A pair at a distance above 2ⁿ has a term at distance 2ⁿ between, so each
    round joins the pairs at just that distance with all pairs known, and the
    distance doubles: one middle term per shortest path, not all of them. Pairs
    that end in a root are not sent through the join. Cycles end the rounds as
    any graph does, once no pair is new. Each round is written to the shared
    folder, so lineage stays one step deep.
    """
    spark = parents.sparkSession
    edges = parents.select(F.col(child).alias("term"), F.col(parent).alias("ancestor")).distinct()
    inner = edges.select(F.col("term").alias("ancestor")).distinct().withColumn("_open", F.lit(True))
    # every edge carries whether its parent has parents of its own
    known = materialize(lookup(edges, inner, ["ancestor"], "left").select(
        "term", "ancestor", F.coalesce("_open", F.lit(False)).alias("_open"), F.lit(1).alias("_far")), "edges")
    span = 1
    while True:
        frontier = known.where(F.col("_open") & (F.col("_far") == span)).select("term", F.col("ancestor").alias("_mid"))
        onward = known.select(F.col("term").alias("_mid"), F.col("ancestor").alias("_next"), F.col("_open").alias("_next_open"), F.col("_far").alias("_next_far"))
        grown = spread_join(frontier, onward, ["_mid"], "inner", ["term"]).select(
            "term", F.col("_next").alias("ancestor"), F.col("_next_open").alias("_open"), (F.col("_next_far") + span).alias("_far"))
        both = materialize(grown.unionByName(known).groupBy("term", "ancestor").agg(F.max("_open").alias("_open"), F.min("_far").alias("_far")), "closure")
        release(spark, known)
        known = both
        if known.where(F.col("_far") > span).isEmpty():
            return known.select("term", "ancestor")
        span *= 2


def propagate(annotations: DataFrame, entity: str, term: str, ancestors: DataFrame) -> DataFrame:
    """Direct annotations plus all their ancestors, distinct."""
    direct = annotations.select(entity, F.col(term).alias("term")).distinct()
    lifted = spread_join(direct, ancestors.select("term", "ancestor"), ["term"], "inner", [entity]).select(entity, F.col("ancestor").alias("term"))
    return direct.unionByName(lifted).distinct()


def node_attribute(nodes: DataFrame, id_col: str, lookup_table: DataFrame, key: str, value: str, fallback) -> DataFrame:
    """Attribute from a node table, else derived from the id itself."""
    right = lookup_table.select(F.col(key).alias(id_col), F.col(value))
    return lookup(nodes, right, [id_col], "left").withColumn(value, F.coalesce(F.col(value), fallback))


def association_sentences(annotations: DataFrame, ancestors: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """``[entity, kind, tokens]``: one sentence per entity and one per direct pair.

    A sentence holds the distinct terms of one entity or one term, so its length
    is bounded by the ontology, not by the number of annotation rows.
    """
    direct = annotations.select("entity", "term").distinct()
    lifted = propagate(direct, "entity", "term", ancestors)
    terms = lifted.groupBy("entity").agg(F.array_sort(F.collect_set(ids.go_token("term"))).alias("t"))
    head = F.array(ids.entity_token("entity"))
    if symbols is not None:
        extra = symbols.where("symbol <> ''").groupBy("entity").agg(
            F.array_sort(F.collect_set("symbol")).alias("s"))
        terms = lookup(terms, extra, ["entity"], "left")
        tail = F.transform(F.coalesce("s", F.array().cast("array<string>")), ids.symbol_token)
    else:
        tail = F.array().cast("array<string>")
    by_entity = terms.select("entity", F.lit("entity").alias("kind"), F.concat(head, "t", tail).alias("tokens"))
    paths = ancestors.groupBy("term").agg(F.array_sort(F.collect_set(ids.go_token("ancestor"))).alias("up"))
    pairs = lookup(direct, paths, ["term"], "left").select(
        "entity", F.lit("pair").alias("kind"),
        F.concat(head, F.array(ids.go_token("term")), F.coalesce("up", F.array().cast("array<string>"))).alias("tokens"))
    return by_entity.unionByName(pairs)


def ontology_sentences(terms: DataFrame) -> DataFrame:
    """``[entity, kind, tokens]``: metadata sentence per term and one per child-parent edge.

    ``terms`` has ``term_id, name, namespace, definition, synonyms, parents``.
    Parents outside the term table are dropped.
    """
    known = terms.select(F.col("term_id").alias("parent")).distinct()
    edges = lookup(terms.select("term_id", F.explode("parents").alias("parent")).distinct(), known, ["parent"], "inner")
    ups = edges.groupBy("term_id").agg(F.array_sort(F.collect_set("parent")).alias("up"))
    empty = F.array().cast("array<string>")
    space = F.when(F.coalesce("namespace", F.lit("")) != "", F.array(F.concat(
        F.lit("namespace_"), F.replace("namespace", F.lit("_"), F.lit(""))))).otherwise(empty)
    synonyms = F.flatten(F.transform(F.coalesce("synonyms", empty), ids.text_tokens))
    parents = F.transform(F.coalesce("up", empty), ids.go_token)
    meta = lookup(terms, ups, ["term_id"], "left").select(
        F.col("term_id").alias("entity"), F.lit("metadata").alias("kind"),
        F.concat(F.array(ids.go_token("term_id")), space, ids.text_tokens("name"), ids.text_tokens("definition"),
                 synonyms, parents).alias("tokens")).where(F.size("tokens") > 1)
    links = edges.select(F.col("term_id").alias("entity"), F.lit("edge").alias("kind"),
                         F.array(ids.go_token("term_id"), ids.go_token("parent")).alias("tokens"))
    return meta.unionByName(links)


def adjacency_slots(pairs: DataFrame) -> DataFrame:
    """Edge table addressed by position: ``[slot, node, neighbour, next_start, next_degree]``.

    The neighbours of a node occupy consecutive slots from its ``start``. A walk
    step is then an equi-join on the slot number, which spreads the visits of a
    hub over all its edges.
    """
    placed = materialize(with_row_index(pairs.select("node", "neighbour"), ["node", "neighbour"], "slot"), "slots")
    spans = placed.groupBy("node").agg(F.min("slot").alias("start"), F.count(F.lit(1)).alias("degree"))
    ahead = spans.select(F.col("node").alias("neighbour"), F.col("start").alias("next_start"),
                         F.col("degree").alias("next_degree"))
    slots = materialize(lookup(placed, ahead, ["neighbour"], "inner", spans.withColumnRenamed("node", "neighbour"),
                               "degree", ["node"]), "slots")
    release(pairs.sparkSession, placed)
    return slots


STRIDE = 512  # nodes whose walks a task steps and hands on at a time


def random_walks(pairs: DataFrame, walks_per_node: int = 10, length: int = 80, seed: int = 42, block: int = 10) -> DataFrame:
    """Uniform random walks ``[walk_id, node, round, walk]`` from every node.

    The neighbours of a node stand in their order, and the next one is number
    ``hash(seed, walk, step) mod degree``, so a walk is reproducible whatever the
    partitioning. The graph is two flat files of numbers that tasks map; walks
    are stepped where they start, and neither they nor their steps are shuffled
    or written. Where tasks cannot map the shared folder, a step is a join.
    """
    text = isinstance(pairs.schema["node"].dataType, T.StringType)
    at = mapped.folder(pairs.sparkSession, "graph") if text else None
    found = _mapped_graph(pairs, at) if at else None
    if found is None:
        return _joined_walks(pairs, walks_per_node, length, seed, block)
    graph, names, index = found
    schema = T.StructType([T.StructField("walk_id", T.LongType()), T.StructField("node", T.StringType()), T.StructField("round", T.IntegerType()),
                           T.StructField("walk", T.ArrayType(T.StringType()))])

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, other, texts = graph.starts(), graph.others(), names.array()
        for b in batches:
            for i in range(0, b.num_rows, STRIDE):
                some = b.slice(i, STRIDE)
                walk_id = np.ascontiguousarray(some.column(1).flatten().to_numpy(zero_copy_only=False))
                path = np.empty((len(walk_id), length), np.int64)
                path[:, 0] = np.repeat(some.column(0).to_numpy(), walks_per_node)
                round_ = np.tile(np.arange(walks_per_node, dtype=np.int32), some.num_rows)
                begun = xxhash64(walk_id, 42)
                for step in range(1, length):
                    here = path[:, step - 1]
                    first = start[here]
                    degree = start[here + 1] - first
                    path[:, step] = other[first + xxhash64(_small(seed), xxhash64(np.int32(step), begun)).view(np.int64) % degree]
                words = texts.take(pa.array(path.ravel())).cast(pa.string())
                offsets = pa.array(np.arange(len(path) + 1, dtype=np.int32) * np.int32(length))
                nodes = texts.take(pa.array(path[:, 0])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(walk_id), nodes, pa.array(round_), pa.ListArray.from_arrays(offsets, words)], names=schema.names)

    spark = pairs.sparkSession
    tasks = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    ids_of = F.transform(F.sequence(F.lit(0), F.lit(walks_per_node - 1)), lambda i: F.xxhash64("node", i, F.lit(seed)))
    return index.select("id", ids_of.alias("walks")).repartition(tasks).mapInArrow(walks, schema)


def _small(n: int):
    """A Python number as the literal that Spark makes of it."""
    return np.int32(n) if -(1 << 31) <= n < 1 << 31 else np.int64(n)


def _mapped_graph(pairs: DataFrame, at: str) -> tuple[mapped.Sparse, mapped.Texts, DataFrame] | None:
    """``[node, neighbour]`` as neighbour lists over the numbers of the nodes, their names, and ``[node, id]``; None if a neighbour has none itself."""
    spark = pairs.sparkSession
    pairs = materialize(pairs.select("node", "neighbour"), "pairs")
    release(spark)  # what made the pairs is shuffled no more
    degrees = materialize(pairs.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    ends = pairs.select(F.col("neighbour").alias("node")).distinct().join(degrees.withColumn("known", F.lit(True)), "node", "full")
    if not ends.where("known IS NULL OR node IS NULL").isEmpty():
        release(spark, pairs)
        return None
    index = mapped.numbered(degrees, "node", "id")
    rows, n = index.count(), pairs.count()
    at_end = {"node": "from", "neighbour": "to"}
    placed = pairs
    for end, other in (("node", "neighbour"), ("neighbour", "from")):
        here = index.select(F.col("node").alias(end), F.col("id").alias(at_end[end]))
        placed = lookup(placed, here, [end], "inner", degrees.withColumnRenamed("node", end), "degree", [other]).drop(end)
    placed = materialize(placed, "placed")
    release(spark, pairs)
    graph = mapped.sparse(placed, "from", "to", None, rows, rows, n, os.path.join(at, "edges"))
    names = mapped.texts(index, "node", "id", rows, os.path.join(at, "names"))
    release(spark, placed)
    return graph, names, index


def _joined_walks(pairs: DataFrame, walks_per_node: int, length: int, seed: int, block: int) -> DataFrame:
    """Walks by joins, for a shared folder that tasks cannot map and for nodes that are no texts or have no neighbours.

    A walk on its way is its id, where it stands and the nodes of the current
    block; a finished block is written and left behind, so a step shuffles the same few bytes at any length, and the
    shuffle files of the block go. The edges are dealt once, not once per block.
    The blocks of a walk meet once, at the end.
    """
    spark = pairs.sparkSession
    slots = adjacency_slots(pairs)
    origin = slots.groupBy("node").agg(F.min("slot").alias("start"), F.count(F.lit(1)).alias("degree"))
    state = origin.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(walks_per_node - 1)))).select(
        F.xxhash64("node", "round", F.lit(seed)).alias("walk_id"), F.array("node").alias("trail"), "start", "degree", F.col("round").cast("byte" if walks_per_node < 128 else "int"))
    # dealt and sorted by slot once, for all steps
    hop = slots.select("slot", F.col("neighbour").alias("_to"), "next_start", "next_degree").repartition(
        shuffle_partitions(spark), "slot").sortWithinPartitions("slot").persist()
    done = []
    for step in range(1, length):
        if step % block == 0:
            state = materialize(state, "walks")
            done.append(state)
            release(spark)
            state = state.select("walk_id", F.array().cast(state.schema["trail"].dataType).alias("trail"), "start", "degree")
        pick = F.col("start") + F.pmod(F.xxhash64("walk_id", F.lit(step), F.lit(seed)), F.col("degree"))
        state = (state.withColumn("slot", pick).drop("start", "degree").join(hop, "slot")
                 .withColumns({"trail": F.concat("trail", F.array("_to")), "start": F.col("next_start"), "degree": F.col("next_degree")})
                 .drop("slot", "_to", "next_start", "next_degree"))
    done.append(materialize(state, "walks"))
    hop.unpersist()
    release(spark, slots)
    # the first block starts with the node and names the round
    rows = None
    for i, d in enumerate(done):
        part = d.select("walk_id", F.struct(F.lit(i).alias("part"), "trail").alias("p"), (F.col("round").cast("int") if not i else F.lit(None).cast("int")).alias("round"))
        rows = part if rows is None else rows.unionByName(part)
    whole = F.flatten(F.array_sort(F.collect_list("p"))["trail"]).alias("walk")  # length / block parts
    return rows.groupBy("walk_id").agg(whole, F.max("round").alias("round")).select("walk_id", F.col("walk")[0].alias("node"), "round", "walk")


CHUNK = 64  # words of a sentence that are paired at a time


def window_pairs(sentences: DataFrame, tokens: str, window: int) -> DataFrame:
    """``[row, col, value]``: how often two words stand within ``window`` words, both ways.

    A pair at distance d counts ``(window - d + 1) / window``, the chance that a
    window of random width up to ``window`` holds it. Sentences of any length
    are cut into overlapping chunks, so no pair is lost at a cut, and pairs are
    summed where they arise before the shuffle.
    """
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(CHUNK)))
    chunks = sentences.where(F.size(tokens) > 1).select(F.col(tokens).alias("_t"), start.alias("_at")).select(
        F.slice("_t", F.col("_at") + 1, CHUNK + window).alias("c"))
    pairs = F.flatten(F.transform(F.slice("c", 1, CHUNK), lambda x, i: F.transform(
        F.slice("c", i + 2, window), lambda y, d: F.struct(x.alias("row"), y.alias("col"), d.alias("d")))))
    near = chunks.select(F.explode(pairs).alias("p")).groupBy("p.row", "p.col", "p.d").agg(F.count(F.lit(1)).alias("n"))
    one = near.groupBy("row", "col").agg(F.sum((F.lit(window) - F.col("d")) * F.col("n")).alias("n"))
    return symmetric_adjacency(one.withColumn("n", F.col("n") / F.lit(float(window))), "row", "col", "n")


def shifted_ppmi(counts: DataFrame, shift: float, smoothing: float) -> DataFrame:
    """Positive PMI of a symmetric ``[row, col, value]`` less ``shift``, with context counts raised to ``smoothing``.

    Row and column sums are the same numbers, so they are taken once; they also
    tell how the hot words are to be spread.
    """
    counts = materialize(counts, "counts")
    sums = materialize(counts.groupBy("row").agg(F.sum("value").alias("_rs"), F.count(F.lit(1)).alias("_deg")), "sums")
    smooth = sums.agg(F.sum(F.pow("_rs", F.lit(smoothing))).alias("s")).scalar()
    other = sums.select(F.col("row").alias("col"), F.pow("_rs", F.lit(smoothing)).alias("_cs"), "_deg")
    out = lookup(counts, sums.select("row", "_rs"), ["row"], "inner", sums, "_deg", ["col"])
    out = lookup(out, other.select("col", "_cs"), ["col"], "inner", other, "_deg", ["row"])
    score = F.log(F.col("value") * smooth / (F.col("_rs") * F.col("_cs"))) - F.lit(float(shift))
    return out.select("row", "col", score.alias("value")).where("value > 0")


NEGATIVES, SMOOTHING = 5, 0.75  # fixed values: the usual noise samples per pair and their exponent


def skip_gram(sentences: DataFrame, tokens: str, dim: int, window: int) -> DataFrame:
    """``[word, vector]``: skip-gram with negative sampling, solved as the factorisation it stands for.

    With ``k`` noise samples the optimum of the objective is the PMI of word and
    context less ``log k``; its positive part is sparse, and U·√S of its
    truncated SVD are the word vectors. Counting and factorising are joins and
    aggregates: no task holds the vocabulary, and sentences may have any length.
    A word that no context tells from noise has the zero vector.
    """
    from .linalg import truncated_svd

    words = sentences.select(F.explode(tokens).alias("word")).distinct()
    weights = materialize(shifted_ppmi(window_pairs(sentences, tokens, window), math.log(NEGATIVES), SMOOTHING), "ppmi")
    if weights.isEmpty():
        return words.withColumn("vector", F.array_repeat(F.lit(0.0), dim))
    f = truncated_svd(weights, "row", "col", "value", dim)
    root = F.array(*[F.lit(float(x ** -0.5) if x > 0 else 0.0) for x in f.singular_values])
    found = f.scores.select(F.col("row").alias("word"), F.zip_with("vector", root, lambda x, s: x * s).alias("vector"))
    return words.join(found, "word", "left").withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), len(f.singular_values))))
