"""Token ids of a public tokenizer, encoded in Arrow batches with a bounded memory of chunks."""

from __future__ import annotations

import itertools
import os
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOGETHER = 256  # chunks per call of the tokenizer
END_ID = 2  # fixed value of the contract: closes each document
BATCH_BYTES = 4 << 20  # text that is encoded at once, unless a single text is longer
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")  # letters that no normaliser turns into anything but letters
MEMORY_CHUNKS = 600_000  # chunks remembered per worker (about 120 MB), then the memory starts anew


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have at most ``limit`` bytes, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def roomy(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with room for ``n`` elements, at least doubled where it had none."""
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(len(a), n - len(a)), a.dtype)])


class Encoder:
    """White space never joins tokens of this kind of tokenizer, so each run between blanks is encoded once and remembered. Nor do letters
    join the marks behind them, where a trial of all marks says so: then ``word`` and ``,`` are encoded, and ``word,`` is put together."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shape = self.tokenizer.normalizer
        self.lowers = shape is not None and shape.normalize_str("AbYZ") == "abyz"  # then A-Z are lowered before chunks are told apart
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]  # found as they are written, whatever the normaliser
        tails = [*string.punctuation, *map("".join, itertools.product(string.punctuation, repeat=2))]
        tails = [t for t in tails if not any(t in x for x in self.added)]
        found = [e.ids for e in self.tokenizer.encode_batch([["\u00e9a"], *([x] for t in tails for x in (t, f"\u00e9a{t}"))], is_pretokenized=True, add_special_tokens=False)]
        self.parts = all(found[0] + tail == both for tail, both in zip(found[1::2], found[2::2]))
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 1  # slot 0 is the end of a document
        self.start, self.size, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 1
        self.size[0] = 1

    def learn(self, chunks: list[str]) -> None:
        """Remember the chunks, which are distinct and new."""
        whole, cut = [], {}
        for c in chunks:
            stem = c.rstrip(string.punctuation) if self.parts else c
            if len(stem) < len(c) and LETTERS.fullmatch(stem):
                cut[c] = (stem, c[len(stem):])
            else:
                whole.append(c)
        fresh = [*dict.fromkeys([*whole, *(x for x in itertools.chain.from_iterable(cut.values()) if x not in self.slots)])]
        groups = [fresh[at:at + TOGETHER] for at in range(0, len(fresh), TOGETHER)]
        found = self.tokenizer.encode_batch(groups, is_pretokenized=True, add_special_tokens=False)
        ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in found), np.uint32)
        self.remember(fresh, ids, np.concatenate([np.zeros(0, np.int64), *[np.bincount(np.array(e.word_ids, np.int64), minlength=len(g)) for e, g in zip(found, groups)]]))
        if cut:
            both = np.fromiter(map(self.slots.__getitem__, itertools.chain.from_iterable(cut.values())), np.int64, 2 * len(cut))
            self.remember(list(cut), self.ids_of(both), self.size[both].reshape(-1, 2).sum(axis=1))

    def remember(self, chunks: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n, to = self.n, self.n + len(chunks)
        self.pool = roomy(self.pool, self.used + len(ids))
        self.start, self.size = roomy(self.start, to), roomy(self.size, to)
        self.pool[self.used:self.used + len(ids)] = ids
        self.start[n:to] = self.used + np.cumsum(size) - size
        self.size[n:to] = size
        self.used, self.n = self.used + len(ids), to
        self.slots.update(zip(chunks, range(n, to)))

    def ids_of(self, slots: np.ndarray) -> np.ndarray:
        """The ids of the slots, one after another."""
        size = self.size[slots]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, self.used) < 1 << 31 else np.int64
        source = np.repeat((self.start[slots] - ends + size).astype(kind), size)
        source += np.arange(total, dtype=kind)
        return self.pool[source]

    def lowered(self, texts: pa.Array) -> pa.Array:
        """The texts with A-Z in lower case, or as they are where that could make or break an added token."""
        low = pc.ascii_lower(texts)
        touched = any(pc.any(pc.match_substring(low, t.lower())).as_py() for t in self.added)
        return texts if touched else low

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one document after another, and where each document begins and ends. A missing text is empty."""
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(self.lowered(texts) if self.lowers else texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten().dictionary_encode()
        seen = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.slots) > MEMORY_CHUNKS:
            self.forget()
        self.learn([c for c in seen if c not in self.slots])
        slot = np.fromiter(map(self.slots.__getitem__, seen), np.int64, len(seen))
        chunk = slot[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        at = offsets - offsets[0]
        if end_id is not None:
            self.pool[0] = end_id
            chunk = np.insert(chunk, at[1:], 0)
            at = at + np.arange(len(at))
        return self.ids_of(chunk), np.concatenate([[0], np.cumsum(self.size[chunk])])[at]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
