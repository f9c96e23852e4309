"""Self-join of documents on the Jaccard similarity of their word n-grams, with adaptive multi-match prefixes.

Shingles are 64-bit hashes. All of a document's shingles are put in one global order, the rare ones first; rarity is read from a
table of ``SKETCH`` counters that covers every document. Similar sets share at least l shingles within their l-prefixes (the base
prefix and l - 1 more), so each document picks the l with the least estimated cost: postings to be read, and verifications, of which
at most postings / l remain. Two documents are candidates if their prefixes share min(l, l') shingles or more.

Each set also carries a signature: the parity of its shingles in each of ``BITS`` buckets. Two signatures differ in no more bits than the
sets differ in shingles, so a pair whose signatures differ too much cannot link and goes before anything is shipped for it.

Equal sets are one class from the start. Rounds of star joins come first: each class meets one other class that it shares a rare
shingle with, and what links is contracted. Only shingles that still touch different components go on to the full candidate join,
whose hot shingles are dealt out in blocks. So a group of near copies costs few pairs, and no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, UPPER, holding, materialize, release
from .tokens import bounded

SHINGLE, PERCENT = 4, 85  # fixed values of the contract
SKETCH = 1 << 17  # counters of the rarity table: 1 MB, whatever the corpus
LONGEST = 6  # the longest prefix scheme tried
VERIFY_COST = 8.0  # what one verification costs per 100 shingles, in postings
STARS, STAR_WIDTH, BLOCK = 2, 256, 2048
BITS = 512  # of a signature, as 64-bit numbers
SIGNS = [f"s{i}" for i in range(BITS // 64)]
_BYTES = bytes.maketrans((UPPER + "\t\n\x0b\x0c\r").encode(), (LOWER + "     ").encode())
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)  # any odd multipliers
_INVERSE = np.uint64(pow(int(_ODD[0]), -1, 1 << 64))
_VALUES = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64)  # one value per byte


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


class Shingler:
    """The sorted distinct shingle hashes of the texts of a batch. Words and shingles are hashed for all its texts at once."""

    def __init__(self, size: int = SHINGLE):
        self.size = size

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts]
        data = np.frombuffer((b" ".join(raw) + b" ").translate(_BYTES), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in raw])
        black = np.concatenate([[False], data != 32, [False]])
        turns = np.flatnonzero(black[1:] != black[:-1])
        start, stop = turns[0::2], turns[1::2]
        # the hash of a word: its bytes' values times powers of an odd number, summed; the powers are taken relative to its start
        power = np.full(len(data), _ODD[0], np.uint64)
        power[:1] = 1
        power = np.cumprod(power, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * power, dtype=np.uint64)])
        back = np.full(len(data), _INVERSE, np.uint64)
        back[:1] = 1
        back = np.cumprod(back, dtype=np.uint64)
        word = _mixed((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64))
        at = np.searchsorted(start, np.concatenate([[0], ends]))  # the first word of each text
        full = self._shingles(word, self.size) if len(word) >= self.size else word[:0]
        out = []
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= self.size:
                out.append(np.unique(full[a:b - self.size + 1]))
            else:
                out.append(self._shingles(word[a:b], b - a) if b > a else word[:0])
        return out

    @staticmethod
    def _shingles(word: np.ndarray, k: int) -> np.ndarray:
        x = np.full(len(word) - k + 1, k, np.uint64)
        for i in range(k):
            x = (x ^ word[i:len(word) - k + 1 + i]) * _ODD[i % 4]
            x ^= x >> np.uint64(31)
        return _mixed(x)


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def rarity(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """How many documents each counter of the sketch has seen, over all of (doc, text). Tasks send sums per counter, never shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(size), np.zeros(SKETCH, np.int64)
        for batch in bounded(batches, "text"):
            for s in shingle(batch.column("text")):
                slots = (s % np.uint64(SKETCH)).astype(np.int64)
                if len(slots) * 8 < SKETCH:
                    np.add.at(seen, slots, 1)
                else:
                    seen += np.bincount(slots, minlength=SKETCH)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["slot", "n"])

    total = np.zeros(SKETCH, np.int64)
    for r in docs.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most SKETCH rows
        total[r["slot"]] = r["n"]
    return total


def prefix(s: np.ndarray, seen: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int, float]:
    """The chosen prefix of a set in the global order (rare first, then by hash), its l, and how many documents hold a shingle of it, on average."""
    if not len(s):
        return s, 1, 0.0
    rare = seen[(s % np.uint64(SKETCH)).astype(np.int64)]
    order = np.lexsort((s, rare))
    need = (percent * len(s) + 99) // 100
    schemes = np.arange(1, min(LONGEST, need) + 1)
    postings = np.cumsum(rare[order])[len(s) - need + schemes - 1]
    best = int(schemes[np.argmin(postings * (1 + VERIFY_COST * len(s) / 100 / schemes))])
    return s[order[:len(s) - need + best]], best, float(postings[best - 1]) / (len(s) - need + best)


def signature(s: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each of ``BITS`` buckets."""
    odd = np.bincount((s >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def apart(a: str, b: str) -> Column:
    """In how many bits the signatures with column suffixes ``a`` and ``b`` differ."""
    return sum((F.bit_count(F.col(f"{s}{a}").bitwiseXOR(F.col(f"{s}{b}"))) for s in SIGNS), F.lit(0))


def may_link(a: str, b: str, percent: int = PERCENT) -> Column:
    """Whether the sets with column suffixes ``a`` and ``b`` can be alike enough by size and signature. Never false for a link."""
    n_a, n_b = F.col(f"n{a}"), F.col(f"n{b}")
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * apart(a, b) <= (100 - percent) * (n_a + n_b))


def prefixes(docs: DataFrame, seen: np.ndarray, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc, mark, key, n, l, tokens, central, signature) for each row of (doc, mark, text): the key and size of its set, and its prefix. Equal sets have one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for batch in bounded(batches, "text"):
            sets = shingle(batch.column("text"))
            chosen = [prefix(s, seen, percent) for s in sets]
            signs = np.stack([signature(s) for s in sets], axis=1) if sets else np.zeros((len(SIGNS), 0), np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc"), batch.column("mark"), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([x[1] for x in chosen], pa.int64()), pa.array([x[0].view(np.int64) for x in chosen], pa.list_(pa.int64())),
                pa.array([x[2] for x in chosen], pa.float64()), *(pa.array(x) for x in signs)],
                names=["doc", "mark", "key", "n", "l", "tokens", "central", *SIGNS])

    return docs.mapInArrow(run, ", ".join(["doc bigint, mark bigint, key bigint, n bigint, l bigint, tokens array<bigint>, central double", *(f"{s} bigint" for s in SIGNS)]))


BYTES = 6  # of each hash that a shipped set keeps; two sets of 10,000 agree by chance in one shingle of 2.8 million such pairs


def packed(s: np.ndarray) -> bytes:
    """The lower ``BYTES`` bytes of each hash, sorted."""
    return np.sort(s & np.uint64((1 << 8 * BYTES) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpacked(b: pa.Buffer) -> np.ndarray:
    out = np.zeros((len(b) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(b, np.uint8).reshape(-1, BYTES)
    return out.view("<u8").ravel()


def whole_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(key, items): the whole set of each (text), packed. A set that repeats within a batch comes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for batch in bounded(batches, "text"):
            sets = {set_key(s): s for s in shingle(batch.column("text")) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(sets.keys(), pa.int64()), pa.array([packed(s) for s in sets.values()], pa.binary())], names=["key", "items"])

    return docs.mapInArrow(run, "key bigint, items binary")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The written pairs (a, b) whose sets link, compared in full. ``classes`` (key, mark) names a text of each set by its hash: only the
    texts of (mark, text) that the pairs name are cut into sets again, and only those sets are written and leave their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "sa"):
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                common = int((np.searchsorted(y, x, "right") > np.searchsorted(y, x)).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    named = materialize(classes.join(keys, "key", "left_semi").select("key", "mark"), "named")
    sets = whole_sets(holding(docs, named, "mark"), size).join(named.select("key"), "key", "left_semi")
    sets = materialize(sets.groupBy("key").agg(F.first("items").alias("items")), "sets")
    sa, sb = (sets.select(F.col("key").alias(c), F.col("items").alias(f"s{c}")) for c in "ab")
    links = materialize(pairs.join(sb, "b").join(sa, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint"), "links")
    release(docs.sparkSession, named, sets)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (a, b): the smallest node of its component. Large and small stars in turn, each with
    map-side minima and written to the shared folder."""
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.unionByName(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = now


def contracted(placed: DataFrame, links: DataFrame) -> DataFrame:
    """``placed`` (key, comp, central) after the components that the links (a, b) touch have become one."""
    side = lambda c: placed.select(F.col("key").alias(c), F.col("comp").alias(f"c{c}"))
    edges = links.join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    found = components(edges)
    return placed.join(found, F.col("comp") == F.col("node"), "left").select("key", F.coalesce("label", "comp").alias("comp"), "central")


def open_postings(postings: DataFrame, placed: DataFrame) -> DataFrame:
    """The postings with their component, for shingles that still touch two components or more."""
    p = postings.join(placed, "key")
    torn = p.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
    return p.join(torn, "token")


def star_pairs(postings: DataFrame, signs: DataFrame, turn: int, percent: int = PERCENT) -> DataFrame:
    """(a, b), at most one per class: one member of each component at a shingle meets the hub there, and keeps the hub whose signature is
    nearest, if the two may link. A hot shingle has a hub for each ``STAR_WIDTH`` members.

    In the first turn the hub is the most central member. An edit puts shingles of its own into a prefix, so of a group of near copies
    the text with the fewest edits has the most common prefix, and links with the most others. Later turns take any member.
    """
    order = F.col("central") if turn == 0 else F.xxhash64("key", F.lit(turn))
    one = postings.withColumn("order", order).groupBy("token", "comp").agg(F.max_by("key", "order").alias("x"), F.max("order").alias("order"), F.max("holders").alias("holders"))
    one = one.withColumn("part", F.pmod(F.xxhash64("x", F.lit(turn)), F.ceil(F.col("holders") / STAR_WIDTH)))
    hubs = one.groupBy("token", "part").agg(F.max_by("x", "order").alias("hub"))
    met = one.join(hubs, ["token", "part"]).where("x <> hub").select(F.col("x").alias("a"), F.col("hub").alias("b")).distinct()
    best = possible(met, signs, percent).groupBy("a").agg(F.min_by("b", "apart").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def possible(pairs: DataFrame, signs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that may link by the table (key, n, signature), which is far smaller than the sets, and how far their signatures are apart."""
    side = lambda c: signs.select(F.col("key").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", *SIGNS)])
    return pairs.join(side("b"), "b").join(side("a"), "a").where(may_link("_a", "_b", percent)).select("a", "b", apart("_a", "_b").alias("apart"))


def candidate_pairs(postings: DataFrame, signs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) of different components whose prefixes share min(l, l') shingles and whose sizes, positions and signatures allow a link.

    Sizes that allow a link lie in one band or in two next to each other, so the holders of a shingle meet by band; a band of many
    holders is dealt out in blocks, and each pair of blocks meets in a place of its own.
    """
    step = math.log(100 / percent) * (1 + 1e-9)  # a little wide, so that rounding puts no link two bands apart
    p = materialize(postings.join(signs.select("key", *SIGNS), "key").withColumn("band", F.floor(F.log("n") / step).cast("int")), "open")
    many = p.groupBy("token", "band").agg(F.count(F.lit(1)).alias("members"))
    parts = many.select("token", F.explode(F.array("band", F.col("band") - 1)).alias("band"), "members").groupBy("token", "band").agg(F.max("members").alias("members"))
    parts = parts.withColumn("blocks", F.ceil(F.col("members") / BLOCK)).where("blocks > 1").select("token", "band", "blocks")
    columns = ["key", "comp", "n", "l", "pos", *SIGNS]

    def side(c: str, slots: DataFrame, mine: str, other: str) -> DataFrame:
        d = slots.join(parts, ["token", "band"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        d = d.withColumn(mine, F.pmod(F.xxhash64("key"), F.col("blocks"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        return d.select("token", "band", "row", "column", *[F.col(x).alias(f"{x}_{c}") for x in columns], *(["below"] if c == "b" else []))

    a = side("a", p, "row", "column")
    b = side("b", p.withColumn("below", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.col("band") - F.col("below")), "column", "row")
    before, after = F.least("pos_a", "pos_b"), F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    fit = ((F.col("below") == 1) | (F.col("key_a") < F.col("key_b"))) & (F.col("comp_a") != F.col("comp_b")) & ((100 + percent) * (before + after) >= percent * (F.col("n_a") + F.col("n_b")))
    met = a.join(b, ["token", "band", "row", "column"]).where(fit & may_link("_a", "_b", percent))
    met = met.groupBy("key_a", "key_b", "n_a", "n_b", "l_a", "l_b").agg(F.count(F.lit(1)).alias("m"), F.max("pos_a").alias("i"), F.max("pos_b").alias("j"))
    most = F.col("m") + F.least(F.col("n_a") - F.col("i"), F.col("n_b") - F.col("j")) - 1  # what they can share after the last match
    met = met.where((F.col("m") >= F.least("l_a", "l_b")) & ((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))))
    return met.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))


def link_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: (doc_id, key, n_shingles, component_id); equal sets have equal keys.

    A missing or empty text, or one without words, has the empty set: it links with nothing and is its own component. Repeated rows are
    linked as any equal sets are. Rows with one id and different texts are compared each for itself. A missing id is never the smallest
    id; a component without any id has a null. An empty table gives an empty table. Hashes of shingles and of sets have 64 bits.
    """
    out = linked_rows(docs, doc_id, text, size, percent)
    return out.select(F.col("doc").alias("doc_id"), "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))


def linked_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc, mark, key, n, comp, component_id) for each row of ``docs``: the hash of its text, and the key of its component, which no other
    component has (those without any id all have a null ``component_id``). ``comp`` is null in rows without words."""
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    spark = docs.sparkSession
    found = materialize(prefixes(d, rarity(d, size), size, percent).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    rows = materialize(found.select("doc", "mark", "key", "n"), "rows")
    classes = materialize(found.where("n > 0").groupBy("key").agg(F.min("row").alias("row"), F.min("doc").alias("doc"), F.min("mark").alias("mark")), "classes")
    first = found.join(classes.select("row"), "row", "left_semi")
    postings = first.select("key", "n", "l", F.posexplode("tokens").alias("pos", "token"))
    holders = postings.groupBy("token").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    postings = materialize(postings.join(holders, "token"), "postings")
    signs = materialize(first.select("key", "n", "central", *SIGNS), "signs")
    release(spark, found)
    placed = materialize(signs.join(postings.select("key"), "key", "left_semi").select("key", F.col("key").alias("comp"), "central"), "placed")
    for turn in range(STARS):
        still = materialize(open_postings(postings, placed), "open")
        pairs = materialize(star_pairs(still, signs, turn, percent), "pairs")
        release(spark, still)
        links = verified(pairs, classes, d, size, percent)
        release(spark, pairs)
        placed = materialize(contracted(placed, links), "placed")
        release(spark, links)
    pairs = materialize(candidate_pairs(open_postings(postings, placed), signs, percent), "pairs")
    release(spark, postings, signs)
    links = verified(pairs, classes, d, size, percent)
    release(spark, pairs)
    placed = materialize(contracted(placed, links), "placed")
    least = classes.join(placed, "key", "left").select("key", "doc", F.coalesce("comp", "key").alias("comp"))
    ids = least.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = least.join(ids, "comp").select("key", "comp", "component_id")
    return rows.select("doc", "mark", "key", "n").join(named, "key", "left")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id. Rows without words stay, all of them. Columns stay as they are.

    Rows are told apart by id and text (its 64-bit hash): of rows with one id and different texts each stays or goes with its own
    component. A missing id comes last; a component without any id keeps one row. If the smallest id has several texts in a component,
    the text with the smallest hash stays; of repeated rows (id and text) one stays, any of them.
    """
    rows = linked_rows(docs, doc_id, text, **limits).where("n > 0")
    rows = materialize(rows.groupBy("comp", "doc", "mark").agg(F.count(F.lit(1)).alias("repeats")), "members")
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "mark")).alias("best")).select(F.col("best.doc").alias("b_doc"), F.col("best.mark").alias("b_mark"))
    same = F.col("doc").eqNullSafe(F.col("b_doc")) & (F.col("mark") == F.col("b_mark"))
    told = rows.join(best, same, "left").where("b_mark IS NULL OR repeats > 1")
    told = materialize(told.select(F.col("doc").alias("__doc"), F.col("mark").alias("__of"), F.col("b_mark").isNull().alias("gone")), "told")
    marked = docs.withColumn("__mark", F.xxhash64(text))
    met = marked[doc_id].cast("bigint").eqNullSafe(F.col("__doc")) & (marked["__mark"] == F.col("__of"))
    kept = marked.join(told, met, "left_anti")
    repeated = told.where("NOT gone")
    if not repeated.isEmpty():
        kept = kept.unionByName(marked.join(repeated, met, "left_semi").dropDuplicates([doc_id, "__mark"]))
    return kept.drop("__mark")
