"""Large single documents read by many tasks: one JSON object, or FASTA records longer than a split.

Spark cuts a text file at any separator. What a piece means depends on what
came before it: whether a string is open, how deep the brackets are, which
record it belongs to and how many residues precede it. Each split states what
it does to that state; the states compose along the file in windows over one
row per split; then each split is read again from its own start state.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

FILE = ["file", "block"]
_MARK = re.compile(r'\\.|["\[\]{}]', re.S)


def _before():
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def placed_pieces(spark: SparkSession, path, separator: str) -> DataFrame:
    """``[file, block, at, value]``: the pieces between separators, each with the split it starts in and its place there."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")


def _by_split(pieces: DataFrame, handle: Callable, schema: str, *more: str) -> DataFrame:
    """``handle(rows of one split)`` gives rows of ``schema`` after ``file`` and ``block``. The rows of a split are neighbours and in order."""
    names = ["file", "block", *[c.split()[0] for c in re.split(r", (?![^<]*>)", schema)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out, heavy = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema=arrow)

        def splits() -> Iterator[tuple]:
            current, state = None, None
            for r in rows:
                if r[:2] != current:
                    if current is not None:
                        yield from ((*current, *x) for x in state.end())
                    current, state = r[:2], handle(*r[4:])
                yield from ((*current, *x) for x in state.piece(r[2], r[3]))
            if current is not None:
                yield from ((*current, *x) for x in state.end())

        for x in splits():
            out.append(x)
            heavy += sum(len(v) for v in x if isinstance(v, str))
            if len(out) >= 4096 or heavy > 1 << 23:
                yield batch()
                out, heavy = [], 0
        if out:
            yield batch()

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "map<int,bigint>": pa.map_(pa.int32(), pa.int64())}
    arrow = pa.schema([("file", pa.string()), ("block", pa.int64())] + [(c.split()[0], kinds[c.split()[1]]) for c in re.split(r", (?![^<]*>)", schema)])
    return pieces.select("file", "block", "at", "value", *more).mapInArrow(run, f"file string, block bigint, {schema}")


# --- one JSON object ----------------------------------------------------------


class _JsonEffect:
    """What a split does, for both answers to whether it starts within a string: change of depth, and its commas by relative depth."""

    def __init__(self):
        self.quotes, self.depth, self.commas = 0, [0, 0], [{}, {}]

    def piece(self, at: int, value: str):
        for m in _MARK.finditer(value):
            c = m[0]
            if c == '"':
                self.quotes ^= 1
            elif len(c) == 1:
                self.depth[self.quotes] += 1 if c in "[{" else -1  # outside a string if it started as ``quotes`` says
        outside = self.quotes
        self.commas[outside][self.depth[outside]] = self.commas[outside].get(self.depth[outside], 0) + 1
        return ()

    def end(self):
        yield (self.quotes, *self.depth, *[list(c.items()) for c in self.commas])


class _JsonCut:
    """Pieces with the number of their entry, without the braces of the object itself."""

    def __init__(self, inside: int, depth: int, entry: int):
        self.inside, self.depth, self.entry = inside, depth, entry

    def piece(self, at: int, value: str):
        first, last = (0 if self.depth else len(value)), len(value)
        for m in _MARK.finditer(value):
            c = m[0]
            if c == '"':
                self.inside ^= 1
            elif len(c) == 1 and not self.inside:
                self.depth += 1 if c in "[{" else -1
                if c == "{" and self.depth == 1:
                    first = m.end()
                elif c == "}" and self.depth == 0:
                    last = m.start()
        if self.depth or last < len(value):
            yield self.entry, at, value[first:last]
        self.entry += not self.inside and self.depth == 1

    def end(self):
        return ()


def read_json_entries(spark: SparkSession, path, value_type: str = "string") -> DataFrame:
    """``[file, entry, key, value]`` of one JSON object per file, entries numbered in their order.

    Pieces lie between commas. A comma ends an entry where no string is open and
    only the object itself is; that is known once the states before the split
    are. An entry may run over any number of pieces and splits; one entry is one
    row. A key that occurs twice gives two rows.
    """
    pieces = placed_pieces(spark, path, ",")
    effects = _by_split(pieces, _JsonEffect, "quotes int, depth0 int, depth1 int, commas0 map<int,bigint>, commas1 map<int,bigint>")
    before = effects.withColumn("inside", F.coalesce(F.sum("quotes").over(_before()) % 2, F.lit(0)).cast("int"))
    own = lambda name: F.when(F.col("inside") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    before = before.withColumn("depth", F.coalesce(F.sum(own("depth")).over(_before()), F.lit(0)).cast("int"))
    ends = F.coalesce(F.try_element_at(own("commas"), F.lit(1) - F.col("depth")), F.lit(0))
    before = before.withColumn("entry", F.coalesce(F.sum(ends).over(_before()), F.lit(0)))
    states = F.broadcast(before.select(*FILE, "inside", "depth", "entry"))  # one row per split
    cut = _by_split(pieces.join(states, FILE), _JsonCut, "entry bigint, at bigint, piece string", "inside", "depth", "entry")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "piece"))), lambda x: x["piece"]), ",")
    entries = cut.groupBy("file", "entry").agg(whole.alias("text")).where(F.trim("text") != "")
    parsed = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), f"map<string,{value_type}>")
    return entries.select("file", "entry", F.explode(parsed).alias("key", "value"))


# --- FASTA --------------------------------------------------------------------


class _FastaEffect:
    def __init__(self):
        self.headers, self.tail = 0, 0

    def piece(self, at: int, value: str):
        if value.startswith(">"):
            self.headers, self.tail = self.headers + 1, 0
        else:
            self.tail += len("".join(value.split()))
        return ()

    def end(self):
        yield self.headers, self.tail


def _fasta_cut(tile: int) -> type:
    class Cut:
        """Headers as tile -1, residues as pieces of tiles with their offset. Lines before the first header belong to record 0 and go."""

        def __init__(self, record: int, offset: int):
            self.record, self.offset = record, offset
            self.parts: list[str] = []  # residues of one tile at most, from several lines
            self.held = 0

        def flush(self):
            if self.parts:
                start = self.offset - self.held
                yield self.record, start // tile, start, "".join(self.parts)
                self.parts, self.held = [], 0

        def piece(self, at: int, value: str):
            if value.startswith(">"):
                yield from self.flush()
                self.record, self.offset = self.record + 1, 0
                yield self.record, -1, 0, value[1:].strip()
                return
            line = "".join(value.split())
            while line and self.record:
                part = line[:tile - self.offset % tile]
                line = line[len(part):]
                self.parts.append(part)
                self.held += len(part)
                self.offset += len(part)
                if self.offset % tile == 0:
                    yield from self.flush()

        def end(self):
            yield from self.flush()

    return Cut


def read_fasta_tiles(spark: SparkSession, path, tile: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """Records ``[file, record, header, record_id, length]`` and their residues ``[file, record, tile_no, bases]``.

    A record is never one row: a chromosome is as many tiles as it is long, and
    its lines may lie in any number of splits. The cut text is written once, as
    tiles, headers and lengths all read it.
    """
    pieces = placed_pieces(spark, path, "\n")
    effects = _by_split(pieces, _FastaEffect, "headers bigint, tail bigint")
    order = Window.partitionBy("file").orderBy("block")
    since = F.sum((F.col("headers") > 0).cast("int")).over(order)  # splits with a header, so far
    run = F.sum("tail").over(Window.partitionBy("file", "since").orderBy("block"))
    states = effects.withColumn("record", F.coalesce(F.sum("headers").over(_before()), F.lit(0))).withColumn("since", since).withColumn("run", run)
    states = states.withColumn("offset", F.coalesce(F.lag("run").over(order), F.lit(0)))
    states = F.broadcast(states.select(*FILE, "record", "offset"))  # one row per split
    cut = materialize(_by_split(pieces.join(states, FILE), _fasta_cut(tile), "record bigint, tile_no bigint, start bigint, piece string", "record", "offset"), "fasta_cut")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"]), "")
    tiles = cut.where("tile_no >= 0").groupBy("file", "record", "tile_no").agg(text.alias("bases"))
    sizes = cut.where("tile_no >= 0").groupBy("file", "record").agg(F.sum(F.length("piece")).cast("bigint").alias("length"))
    heads = cut.where("tile_no < 0").select("file", "record", F.col("piece").alias("header"), F.substring_index("piece", " ", 1).alias("record_id"))
    records = heads.join(sizes, ["file", "record"], "left").withColumn("length", F.coalesce("length", F.lit(0)))
    return records, tiles
