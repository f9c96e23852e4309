"""Pages that the ratio alone does not settle, very long markup, and the ratio method against a plain version."""

import math
import random
import time

import numpy as np
import pytest
from geneloom.llm import html_text

PROSE = [f"Sentence {i} of a long paragraph, which goes on and on to tell a story about many things and people." for i in range(20)]
BODY = "".join(f"<p>{x}</p>" for x in PROSE)
NOISE = "<p>Words of no concern to the story, yet as many of them as a line of prose may well have in it.</p>"


def lines(body):
    return html_text.main_text(f"<html><body>{body}</body></html>").split("\n")


@pytest.mark.parametrize("name", ["sidebar-right", "ad-slot", "site-footer", "comments-area", "leftSidebar", "post_comments", "cookie-bar", "related-posts", "main-nav"])
def test_parts_go_for_a_piece_of_their_name(name):
    for key in ("class", "id"):
        part = f'<div {key}="{name}">{NOISE}</div>'
        assert lines(f"<div>{BODY}</div>{part}") == PROSE
        assert lines(f"{part}<div>{BODY}{part}</div>") == PROSE
        assert lines(f"<article>{BODY}{part}</article>") == PROSE


@pytest.mark.parametrize("name", ["has-sidebar", "no-ads", "comments-open", "category-related", "content-with-sidebar", "tag-promo"])
def test_wrappers_and_states_stay(name):
    assert lines(f'<div class="{name}">{BODY}</div>') == PROSE
    assert lines(f'<article class="{name}">{BODY}</article>') == PROSE


def test_comments_longer_than_the_article_go_while_seeds_stay():
    comments = f'<div id="comments">{NOISE * 60}</div>'
    assert lines(f"<div>{BODY}</div>{comments}") == PROSE
    assert lines(f"<article>{BODY}</article>{comments}") == PROSE
    assert len(lines(comments)) == 60  # alone they are all that the page says


def test_an_article_of_links_is_kept_and_a_list_of_links_is_not():
    links = "".join(f"<p><a href=x>{x}</a></p>" for x in PROSE)
    assert lines(f"<nav><a href=x>Home</a></nav><article>{links}</article>") == PROSE
    assert lines(f"<main>{links}</main>") == PROSE
    assert lines(f"<div>{links}</div>") == [""]
    assert lines(f"<article>{BODY}<p><a href=x>One more</a></p></article>") == [*PROSE, "One more"]


def test_comments_without_an_end():
    assert lines(f"<article>{BODY}</article><!-- x <p>never shown</p>") == PROSE
    assert lines(f"<article><!-- a > b -->{BODY}<!----></article>") == PROSE
    assert lines(f"<article>{BODY}</article><script><!-- var x;</script>") == PROSE


@pytest.mark.parametrize("markup", ["<div><p>" * 130_000 + "text", "<div><p>some words here" * 45_000, "<div>" * 100_000 + "x" + "</div>" * 80_000, "<div class=sidebar>some words here " * 30_000,
                                    "<b>" * 100_000 + "<p>x</p>" * 80_000, "<div>" * 90_000 + "</section>" * 50_000 + "x", "<div id=comments>words and words " * 30_000, "<article><li>words " * 50_000])
def test_a_megabyte_of_open_tags_takes_time_in_proportion(markup):
    half = time.process_time()
    html_text.main_text(markup[:len(markup) // 4])
    start = time.process_time()
    html_text.main_text(markup)
    end = time.process_time()
    assert end - start < 10 and end - start < 12 * max(0.1, start - half)  # 16 times would be quadratic


def plain_seeds(ratios):
    """Smoothing and two means by their definitions, value by value."""
    logs = [math.log(1 + r) for r in ratios]
    weight = lambda d: math.exp(-d * d / 2)
    at = lambda i: logs[min(max(i, 0), len(logs) - 1)]
    level = [sum(weight(d) * at(i + d) for d in range(-2, 3)) / sum(weight(d) for d in range(-2, 3)) for i in range(len(logs))]
    low, high = min(level), max(level)
    while high > low:
        cut = (low + high) / 2
        below, above = [x for x in level if x <= cut], [x for x in level if x > cut]
        if not above or (sum(below) / len(below), sum(above) / len(above)) == (low, high):
            break
        new = sum(below) / len(below), sum(above) / len(above)
        if max(abs(new[0] - low), abs(new[1] - high)) < 1e-12:
            break
        low, high = new
    out = [x >= (low + high) / 2 and r > 0 for x, r in zip(level, ratios)]
    return (out if any(out) else [r > 0 for r in ratios]), level, (low + high) / 2


def test_seeds_equal_a_plain_version():
    rng = random.Random(3)
    for _ in range(300):
        ratios = [rng.choice([0.0, 1.0, rng.random() * 9, 30 + rng.random() * 90]) for _ in range(rng.randrange(1, 60))]
        want, level, cut = plain_seeds(ratios)
        got = html_text.seeds(np.array(ratios))
        assert all(g == w or abs(x - cut) < 1e-9 for g, w, x in zip(got, want, level))


def test_ratios_are_characters_outside_links_per_tag():  # from the tag after the last block to the one that ends this
    page = html_text.Blocks()
    page.feed("<div><p>four <b>bold</b> words</p><p><a href=x>link</a> rest</p></div>")
    page.flush()
    assert [b[:3] for b in page.blocks] == [("four bold words", 5, 0), ("link rest", 4, 4)]
    assert [page.tags_of[b[3]] for b in page.blocks] == ["p", "p"]
