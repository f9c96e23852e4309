"""The shunting-yard parser, the tags and the labels of the licence scan."""

import random

import pytest
from geneloom.llm import license_scan as ls

NAMES = ["mit", "apache-2.0", "gpl-3.0-only", "cc-by-nc-4.0", "own-terms"]


def drawn(rng, depth):
    """A random expression as tokens, with what it means by the definition of its operators."""
    if not depth or rng.random() < 0.3:
        name = rng.choice(NAMES)
        label = ls.label_of(name)
        return [name], ({label}, ls.FREEDOM.get(label, ls.UNKNOWN))
    op = rng.choice(["and", "or", "with"])
    (lt, (ll, lf)), (rt, (rl, rf)) = drawn(rng, depth - 1), drawn(rng, depth - 1)
    left, right = ["(", *lt, ")"] if len(lt) > 1 else lt, ["(", *rt, ")"] if len(rt) > 1 else rt
    if op == "with":
        return [*left, op, *right], (ll, min(1.0, lf + ls.EXCEPTION_GAIN))
    return [*left, op, *right], (ll | rl, max(lf, rf) if op == "or" else min(lf, rf))


def test_expressions_with_brackets_mean_what_their_parts_mean():
    rng = random.Random(5)
    for _ in range(500):
        tokens, value = drawn(rng, 4)
        assert ls.evaluate(tokens) == value


def test_with_binds_before_and_before_or():
    assert ls.evaluate("cc0 or gpl-2 and mit".split()) == ({"cc0", "gpl-2", "mit"}, 1.0)
    assert ls.evaluate("gpl-2 and mit or cc0".split()) == ({"cc0", "gpl-2", "mit"}, 1.0)
    assert ls.evaluate("( cc0 or gpl-2 ) and mit".split()) == ({"cc0", "gpl-2", "mit"}, 0.9)
    assert ls.evaluate("mit and gpl-2 with linking-exception".split()) == ({"mit", "gpl-2"}, 0.5)


@pytest.mark.parametrize("text", ["", "and", "mit and", "and mit", "mit mit", "( mit", "mit )", "( )", "mit ( mit )", "with with", "mit or or mit"])
def test_malformed_expressions_have_no_value(text):
    assert ls.evaluate(text.split()) is None


@pytest.mark.parametrize("name, label", [("MIT", "mit"), ("Apache-2.0", "apache-2"), ("GPL-3.0-or-later", "gpl-3"), ("GPL-2.0+", "gpl-2"), ("LGPL-2.1-only", "lgpl"), ("CC-BY-SA-4.0", "cc-by-sa"), ("CC0-1.0", "cc0"), ("BSD-3-Clause", "bsd-3-clause")])
def test_labels_of_identifiers(name, label):
    assert ls.label_of(name) == label


def test_tags_are_read_to_the_end_of_their_expression():
    scan = lambda t: ls.scan(t)[3:]
    assert scan("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND CC0-1.0\nMIT") == ({"mit", "apache-2", "cc0"}, 0.9)
    assert scan("SPDX-License-Identifier: MIT and that is all") == ({"mit", "that"}, 0.5)
    assert scan("SPDX-License-Identifier: MIT. Further text") == ({"mit"}, 0.9)
    assert scan("SPDX-License-Identifier:\nMIT") == (set(), ls.UNKNOWN)
    assert scan("no tag here, MIT") == (set(), ls.UNKNOWN)
