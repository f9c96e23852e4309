"""The operators on built-in functions and the scans, against plain Python on the smallest table and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from geneloom.llm import decontaminate, html_text, license_scan, line_dedup, llr_rules, pu_quality, queries, secret_scan, text
from geneloom.llm.text import LOWER, UPPER

SMALL = "/root/testdata/sf0.001"
FOLD = str.maketrans(UPPER, LOWER)
ODD = ["", None, " ", "\n\n", "a", "É è\u0085x", "word " * 3000, "a b c a b c a b c", "password = abcdefghijklmnop deadbeefdeadbeefdead", "x\nx\ny"]
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def alnum_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD)) if w]


def base_spans(text):
    found = []
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for k, (kind, pattern, group, least) in enumerate([("assign", assign, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [x[2] for x in sorted(found)]


def test_secrets_equal_regular_expressions(spark, texts):
    got = {r.doc_id: r for r in queries.op1_secret_scan(spark, SMALL).collect()}
    assert len(got) == len(texts)
    for k, t in texts:
        spans = base_spans(t)
        assert got[k].base_sha256 == sha(",".join(spans)) and set(spans) <= set(got[k].spans.split(","))
        assert [got[k].n_assign, got[k].n_access, got[k].n_hex] == [sum(s.startswith(x) for s in spans) for x in ("assign", "access", "hex")]


def test_secrets_of_odd_rows(spark, frame):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "AKIA" + "B" * 14), (8, "é" * 3 + "0" * 16)]
    got = secret_scan.scan_secrets(frame(rows)).collect()
    base = {r.kind for r in secret_scan.BASE}
    found = sorted((str(r.doc_id), str(r.text), [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in base]) for r in got)
    assert found == sorted((str(k), str(t), base_spans(t)) for k, t in rows)
    assert secret_scan.scan_secrets(frame([])).count() == 0


def test_licenses_equal_a_plain_search(spark, texts):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    got = {r.doc_id: r for r in queries.op3_license_scan(spark, SMALL).collect()}
    assert len(got) == len(texts)
    for k, t in texts:
        w = alnum_words(t)
        places = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
        r = got[k]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x[1] for x in places})) and 0 <= r.score <= 1
        assert {x[1] for x in places} <= set(filter(None, r.labels.split(",")))


def test_licenses_of_odd_rows(frame):
    assert license_scan.scan_licenses(frame(list(enumerate(ODD)) + [(None, "x")])).count() == len(ODD) + 1
    assert license_scan.scan_licenses(frame([])).count() == 0


def plain_line_dedup(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    for k, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(k)
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and k != max(holders[key(x)]))]
        out.append((k, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out)


def test_line_dedup_of_odd_rows(spark, frame):
    line = "A line of more than twenty characters"
    rows = list(enumerate(ODD)) + [(20 + k, f"{line}\nown {k}\n \t{line.upper()} ") for k in range(5)] + [(30, line), (31, line[:19]), (32, line[:19]), (33, line[:19])]
    got = line_dedup.deduplicate_lines(frame(rows))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, sha(r.text)) for r in got.collect()) == plain_line_dedup(rows)
    assert line_dedup.deduplicate_lines(frame([])).count() == 0


def plain_contamination(rows, items):
    grams = [(i, w[a:a + min(10, len(w))]) for i, t in items if (w := alnum_words(t)) for a in range(len(w) - min(10, len(w)) + 1)]
    out = []
    for k, t in rows:
        w = alnum_words(t)
        hit, ids = set(), set()
        for i, g in grams:
            for a in range(len(w) - len(g) + 1):
                if w[a:a + len(g)] == g:
                    hit |= set(range(a, a + len(g)))
                    ids.add(str(i))
        out.append((str(k), len(w), len(hit), sorted(ids)))
    return sorted(out)


def test_contamination_of_odd_rows(spark, frame):
    passage = " ".join(f"w{i}" for i in range(14))
    items = [(1, passage), (2, "Short item"), (3, None), (4, "!!"), (5, passage), (6, "word " * 12)]
    rows = list(enumerate(ODD)) + [(20, f"start {passage.upper()} end"), (21, "a short, ITEM; short item"), (22, " ".join(passage.split()[:9])), (None, passage), (22, passage)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(frame(rows), bench).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r.item_ids)) for r in got) == plain_contamination(rows, items)
    kept = decontaminate.remove_contaminated(frame(rows), bench)
    assert kept.count() == sum(x[2] == 0 for x in plain_contamination(rows, items))
    assert decontaminate.contamination(frame([]), bench).count() == 0
    assert decontaminate.contamination(frame(rows), bench.where("false")).where("n_hit > 0").count() == 0


def plain_rules(text):
    t = text or ""
    split = lambda x: [w for w in re.split(r"[\x20\x09-\x0D]+", x) if w]
    w = split(t)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if split(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w)


def test_quality_rules(spark, texts, frame):
    found = lambda rows: sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert found(queries.op10_quality_rules(spark, SMALL).collect()) == sorted((str(k), *plain_rules(t)) for k, t in texts)
    rows = list(enumerate(ODD)) + [(None, "a b c"), (3, "| a | a | a")]
    none = spark.createDataFrame([], "doc_id bigint")
    got = llr_rules.quality_rules(frame(rows), none).collect()
    assert found(got) == sorted((str(k), *plain_rules(t)) for k, t in rows)
    assert all(r.kept == (not r.base_failed) for r in got)


def plain_ratios(spark, rows, good):
    """The mean log ratio of each (id, text), counted in plain Python; the hash alone is Spark's."""
    split = lambda x: [w for w in re.split(r"[\x20\x09-\x0D]+", x or "") if w]
    grams = {t: [(w,) for w in split(t)] + list(zip(split(t), split(t)[1:])) for _, t in rows}
    every = sorted({g for x in grams.values() for g in x})
    frame = spark.createDataFrame([(*g, None)[:2] for g in every], "a string, b string")
    slots = dict(zip(every, [r[0] for r in frame.select(F.when(F.col("b").isNull(), llr_rules.bucket("a")).otherwise(llr_rules.bucket("a", "b"))).collect()]))
    raw = Counter(slots[g] for _, t in rows for g in grams[t])
    target = Counter(slots[g] for k, t in rows if k in good for g in grams[t])
    share = llr_rules.PRIOR_SHARE
    ratio = {b: math.log((target[b] / target.total() / (n / raw.total()) + share) / (1 + share)) for b, n in raw.items()}
    return [(k, t, sum(ratio[slots[g]] for g in grams[t]) / max(1, len(grams[t]))) for k, t in rows]


def test_log_likelihood_ratio_and_rejections_equal_plain_counts(spark, frame):
    rng = random.Random(4)
    draw = lambda stem, n: " ".join(f"{stem}{int(rng.random() ** 3 * 90)}" for _ in range(n))
    rows = [(k, draw("good", 120)) for k in range(12)] + [(100 + k, draw("junk", 120)) for k in range(12)] + [(50, ""), (51, None), (52, draw("good", 40) + " " + draw("junk", 40))]
    good = {0, 1, 2}  # three trusted rows are enough to reject by
    trusted = spark.createDataFrame([(0,), (1,), (2,), (2,), (None,), (999,)], "doc_id bigint")
    verdicts = {}
    for k, t, llr in plain_ratios(spark, rows, good):
        verdicts[k] = (round(llr, 9), not plain_rules(t)[5] and llr >= llr_rules.THRESHOLD)
    got = llr_rules.quality_rules(frame(rows), trusted).collect()
    assert {r.doc_id: (round(r.llr, 9), r.kept) for r in got} == verdicts
    assert all(verdicts[k][1] for k in good) and not any(verdicts[100 + k][1] for k in range(12))
    assert min(verdicts[k][0] for k in range(12)) > max(verdicts[100 + k][0] for k in range(12))
    twice = llr_rules.quality_rules(frame(rows + rows), trusted).collect()  # a corpus and its double judge alike
    assert {(r.doc_id, round(r.llr, 9), r.kept) for r in twice} == {(k, *v) for k, v in verdicts.items()}


def test_target_counts_move_no_texts_and_lose_none(spark, frame, monkeypatch):
    rows = [(k, f"w{k % 7} w{k % 11} w{k % 13}") for k in range(400)] + [(None, "w1 w2"), (5, "w5 w6")]
    trusted = spark.createDataFrame([(k,) for k in range(0, 400, 5)] * 2, "doc_id int")
    plain = Counter(w for k, t in rows if k is not None and k % 5 == 0 for w in [*t.split(), *zip(t.split(), t.split()[1:])])
    for most in (1 << 18, 1):  # with one word of bits nearly every id is a false alarm
        monkeypatch.setattr(text, "BIT_WORDS", most)
        counts = llr_rules.bucket_counts(frame(rows), trusted)
        assert "SortMergeJoin [id" not in counts._jdf.queryExecution().executedPlan().toString()
        found = counts.agg(F.sum("n_raw"), F.sum("n_target")).first()
        assert tuple(found) == (400 * 5 + 3 + 3, plain.total())


def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a><a href=y>About</a></nav><div class="sidebar"><p>Buy now, buy often.</p></div>
<article><h1>A  title</h1><p>First &amp; long paragraph with many words that tell a story about things.</p><script>var x = 1;</script><p>Short.</p>
<p>Second long paragraph, which goes on to tell the rest of the story to its <b>end</b>.</p><form><input>Send</form></article><div id="comments"><p>I liked it, said a reader.</p></div><footer>(c)</footer></body></html>"""
    assert html_text.main_text(page).split("\n") == ["A title", "First & long paragraph with many words that tell a story about things.", "Short.",
                                                     "Second long paragraph, which goes on to tell the rest of the story to its end."]
    for odd in ("", "<", "<p", "</p></div>", "<script>never closed", "<!-- "):
        html_text.main_text(odd)


LONG = [f"Sentence {i} of a long paragraph, which goes on and on to tell a story about many things and people." for i in range(40)]


def body_lines(body):
    return html_text.main_text(f'<html><body><nav><a href="x">Home</a></nav>{body}<footer>(c)</footer></body></html>').split("\n")


def test_main_text_of_unequal_articles():
    articles = "".join(f"<article>{''.join(f'<p>{x}</p>' for x in part)}</article>" for part in (LONG[:38], LONG[38:]))
    assert body_lines(articles) == LONG
    assert body_lines(f"<main>{articles}</main>") == LONG


def test_main_text_of_pages_of_divs():
    for tag in ("div", "section"):
        part = lambda *x: f"<{tag}>{''.join(f'<p>{y}</p>' for y in x)}</{tag}>"
        assert body_lines(f"<{tag}>A title</{tag}>" + part(LONG[0]) + part(*LONG[1:39]) + part(LONG[39])) == ["A title", *LONG]
        links = "<div><a href=x>One</a> <a href=y>Two</a></div>"
        assert body_lines(links + f"<{tag}>" + part(LONG[0]) + part(*LONG[1:]) + f"</{tag}>" + links) == LONG


def test_main_text_of_prose_beside_teaser_articles():
    first, last = ("".join(f"<p>{x}</p>" for x in part) for part in ([*LONG[:20], "Short."], LONG[21:]))
    for tag in ("main", "div"):
        lines = body_lines(f"<{tag}><h1>A title</h1>{first}<article><p>{LONG[20]}</p></article>{last}</{tag}>")
        assert lines == ["A title", *LONG[:20], "Short.", *LONG[20:]]


def test_main_text_in_parts_with_layout_names():
    prose = "".join(f"<p>{x}</p>" for x in LONG)
    for names in ("site has-sidebar", "container no-ads", "form", "social", "noticeBoard"):
        assert body_lines(f'<div class="{names}">{prose}</div>') == LONG
        assert body_lines(f'<span id="{names}">{prose}</span>') == LONG
    for names in ("post comments-open", "post category-social", "related"):
        assert body_lines(f'<article class="{names}">{prose}</article>') == LONG
    aside = '<div class="box sidebar"><p>Buy now, buy often, and tell all your friends and readers about it.</p></div>'
    for tag, names in (("article", "post comments-open"), ("div", "site has-sidebar"), ("div", "form")):
        assert body_lines(f'<{tag} class="{names}">{aside}{prose}<span class="share">Share this</span></{tag}>{aside}') == LONG
    assert body_lines(f'<article>{"".join(f"<p>{x}</p>" for x in LONG[:9])}</article><div id="comments">{"".join(f"<p>{x}</p>" for x in LONG[9:])}</div>') == LONG[:9]
    assert body_lines(f'<div class="ad">{LONG[0]}</div><div class="promo">{LONG[1]}</div>') == LONG[:2]


def test_pages_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", ""), (None, None, "<p>Only a text.</p>")], "page_id bigint, url string, html string")
    assert sorted(r.text for r in html_text.extract(pages).collect()) == ["", "", "Only a text."]
    assert html_text.extract(pages.where("false")).count() == 0


def test_classifier_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op9_pu_quality(spark, sf)
    r = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", "quality").toPandas()
    good, bad = r.score[r.quality == 1].values, r.score[r.quality == 0].values
    assert ((good[:, None] > bad[None]) + 0.5 * (good[:, None] == bad[None])).mean() > 0.97


@pytest.mark.parametrize("trusted", [[], [0], [0, 0, 5, None]])
def test_classifier_of_odd_rows(spark, frame, trusted):
    ids = spark.createDataFrame([(k,) for k in trusted], "doc_id bigint")
    rows = list(enumerate(ODD)) + [(None, "x"), (5, "other")]
    got = pu_quality.classify(frame(rows), ids).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert pu_quality.classify(frame([]), ids).count() == 0
    kept = pu_quality.remove_rejected(frame(rows), ids)
    assert kept.columns == frame(rows).columns
