"""License scan: identifier tags and notice phrases by Aho-Corasick, licence expressions by a shunting-yard parser.

Phrases are looked for in the text's words joined by single blanks, tags in the lower-cased text itself. What follows a tag is read
as a licence expression with the operators and, or and with.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import bounded

# fixed values of the contract: phrase and label
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# further notices of this scan
FURTHER = {
    "gnu general public license version 3": "gpl-3", "gnu general public license version 2": "gpl-2", "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl", "mozilla public license version 2": "mpl-2", "bsd 3 clause license": "bsd-3-clause",
    "bsd 2 clause license": "bsd-2-clause", "under the isc license": "isc", "creative commons attribution sharealike": "cc-by-sa", "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd", "cc by 4 0": "cc-by", "cc0 1 0": "cc0", "public domain dedication": "public-domain", "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx-license-identifier:", "license-identifier:")
# how freely a text may be used, from 0 to 1
FREEDOM = {"cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "0bsd": 1.0, "mit": 0.9, "isc": 0.9, "bsd-2-clause": 0.9, "bsd-3-clause": 0.9, "apache-2": 0.9, "cc-by": 0.8,
           "mpl-2": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl-2": 0.4, "gpl-3": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "all-rights-reserved": 0.0}
UNKNOWN = 0.5  # no notice, or a licence without an entry above
EXCEPTION_GAIN = 0.1  # what an exception (with) adds
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_NOT_WORD = bytes.maketrans(bytes(b for b in range(128) if not (48 <= b < 58 or 97 <= b < 123)), b" " * 92)


@functools.lru_cache(maxsize=1)
def _automata():
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in (BASE | FURTHER).items():
        phrases.add_word(f" {phrase} ", (label, phrase in BASE, len(phrase) + 1))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def label_of(identifier: str) -> str:
    """An identifier as a label: lower case, without -only, -or-later, + and a final .0."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    name = re.sub(r"(?<=\d)\.0$", "", name)
    return re.sub(r"^(cc-by(?:-nc|-sa|-nd)*|cc0|lgpl|agpl)-[\d.]+$", r"\1", name)


def evaluate(tokens: list[str]) -> tuple[set[str], float] | None:
    """Labels and freedom of an expression: or takes the freer side, and the stricter, with adds an exception to the left side. None if malformed."""
    values: list[tuple[set[str], float]] = []
    operators: list[str] = []

    def reduce() -> bool:
        op = operators.pop()
        if op == "(" or len(values) < 2:
            return False
        (rl, rf), (ll, lf) = values.pop(), values.pop()
        values.append((ll, min(1.0, lf + EXCEPTION_GAIN)) if op == "with" else (ll | rl, max(lf, rf) if op == "or" else min(lf, rf)))
        return True

    wants_value = True
    for token in tokens:
        if token == "(" and wants_value:
            operators.append(token)
        elif token == ")" and not wants_value:
            while operators and operators[-1] != "(":
                if not reduce():
                    return None
            if not operators:
                return None
            operators.pop()
        elif token in PRECEDENCE and not wants_value:
            while operators and PRECEDENCE.get(operators[-1], 0) >= PRECEDENCE[token]:
                if not reduce():
                    return None
            operators.append(token)
            wants_value = True
        elif token not in PRECEDENCE and token not in "()" and wants_value:
            label = label_of(token)
            values.append(({label}, FREEDOM.get(label, UNKNOWN)))
            wants_value = False
        else:
            return None
    while operators:
        if not reduce():
            return None
    return values[0] if len(values) == 1 and not wants_value else None


def expression_after(text: str, at: int) -> tuple[set[str], float] | None:
    """The longest expression that begins at ``at`` and stays on the line."""
    tokens = []
    for m in re.compile(r"[^\S\n]*(\(|\)|[a-z0-9][a-z0-9.+-]*)").finditer(text, at):
        if m.start() != (at if not tokens else end):
            break
        token, end = m[1].rstrip("."), m.end()
        if tokens and token not in PRECEDENCE and token not in "()" and tokens[-1] not in PRECEDENCE and tokens[-1] != "(":
            break  # two names side by side: prose follows
        tokens.append(token)
    while tokens and (tokens[-1] in PRECEDENCE or (evaluate(tokens) is None and tokens[-1] == ")")):
        tokens.pop()
    return evaluate(tokens) if tokens else None


def scan(text: str) -> tuple[int, list[int], set[str], set[str], float]:
    """Number of words; the words at which base phrases begin; base labels; all labels; freedom of the strictest notice."""
    phrases, tags = _automata()
    lowered = text.encode("utf-8", "surrogatepass").lower()
    words = lowered.translate(_NOT_WORD).split()
    joined = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    starts, base, labels, freedom, at, n = [], set(), set(), [], 0, 0
    for end, (label, is_base, size) in sorted(phrases.iter(joined), key=lambda x: x[0] - x[1][2]):
        labels.add(label)
        freedom.append(FREEDOM.get(label, UNKNOWN))
        if is_base:
            begin = end - size
            n, at = n + joined.count(" ", at, begin), begin
            starts.append(n)
            base.add(label)
    lowered = lowered.decode("utf-8", "surrogatepass")
    for end, tag in tags.iter(lowered):
        if (value := expression_after(lowered, end + 1)) is not None:
            labels |= value[0]
            freedom.append(value[1])
    return len(words), starts, base, labels, min(freedom, default=UNKNOWN)


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: word count, places of base phrases, labels (distinct, sorted, comma-joined) and the freedom as ``score``.

    A missing or empty text has no words, no labels and the score of an unknown licence. Phrases that overlap all count. A tag without
    a well-formed expression gives no label. Repeated rows are scanned each for itself; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            rows = []
            for k, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n, starts, base, labels, freedom = scan(t or "")
                rows.append((k, n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), freedom))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
