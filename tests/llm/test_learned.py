"""Toxicity, language identification and HTML extraction: rules of the folds,
defined odd cases, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from gridwright.llm import html_extract, language_id, toxicity

WORDS = {"en": "the and that with from this there which would about".split(),
         "fr": "le la les que dans avec pour une être déjà".split()}


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(["en", "en", "fr"])
        w = [rng.choice(WORDS[lang]) + rng.choice(["", "s", "er"]) for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(4):
                w.insert(rng.randint(0, len(w)), rng.choice(["moronic", "scumbag", "vejuté", "vejuais"]))
        docs.append((i, " ".join(w), lang, "extra"))
        if rng.random() < 0.7:
            labels.append((i, 1, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus()
    odd = [(9000, None, None, ""), (9001, "", "en", ""), (9002, "123 ... !?", "fr", ""), (None, "the and that", "en", ""),
           (5, docs[5][1], "en", ""), (9003, "moronic scumbag " * 30_000, "en", "")]
    d = spark.createDataFrame(docs + odd, "doc_id bigint, text string, lang string, score string")
    return d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), {i: ("moronic" in t or "scumbag" in t or
                                                                                         "veju" in t) for i, t, *_ in docs}


def held(i, parts, rest):
    return zlib.crc32(str(i).encode()) % parts == rest


def test_toxicity_scores_and_folds(frames):
    d, labels, truth = frames
    got = toxicity.toxicity(d, labels).collect()
    assert len(got) == d.count()
    right = [r["predicted"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth]
    assert np.mean(right) > 0.97
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"], 3, 1))
    by = {r["doc_id"]: r for r in got}
    assert by[9000]["score"] == by[9001]["score"] < 0.7 and by[9003]["predicted"] == 1


def test_toxicity_ignores_held_out_labels(spark, frames):
    d, labels, _ = frames
    flipped = spark.createDataFrame([(r["doc_id"], r["quality"], 1 - r["toxic"] if held(r["doc_id"], 3, 1) else r["toxic"])
                                     for r in labels.collect()], "doc_id bigint, quality int, toxic int")
    key = lambda r: (r["doc_id"] or -1, r["score"])
    assert sorted(map(key, toxicity.toxicity(d, labels).collect())) == sorted(map(key, toxicity.toxicity(d, flipped).collect()))


def test_toxicity_without_labels_and_rows(spark, frames):
    d, labels, _ = frames
    none = toxicity.toxicity(d, labels.limit(0))
    assert {r["predicted"] for r in none.collect()} == {0}
    assert toxicity.toxicity(d.limit(0), labels).count() == 0
    kept = toxicity.drop_toxic(d, labels)
    assert kept.columns == d.columns and 0 < kept.count() < d.count()


def test_nnpu_separates_from_unlabelled():
    rng = np.random.default_rng(1)
    xp = np.c_[np.ones(50), rng.integers(0, 2, 50)]
    xu = np.c_[(rng.random(600) < 0.1), rng.integers(0, 2, 600)].astype(float)
    w, b = toxicity.nnpu(xp, xu, 0.1)
    assert w[0] + b > 1 and b < -1 and abs(w[1]) < w[0] / 3


def test_language(frames):
    d, _, _ = frames
    got = language_id.identify(d).collect()
    assert len(got) == d.count()
    lang = {r["doc_id"]: r["lang"] for r in d.collect()}
    odd = {9000, 9001, 9002}
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] not in odd]
    assert np.mean(right) > 0.95
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == held("" if r["doc_id"] is None else r["doc_id"], 5, 0)
        assert (r["lang_pred"] == "und") == (r["doc_id"] in odd)


def test_language_without_rows(spark, frames):
    d, _, _ = frames
    assert language_id.identify(d.limit(0)).count() == 0
    unknown = language_id.identify(d.filter("lang is null"))
    assert {r["lang_pred"] for r in unknown.collect()} == {"und"}


def test_grams_cover_very_long_texts(monkeypatch):
    t = "".join(random.Random(3).choice("abc é!") for _ in range(5000))
    whole = language_id.grams(t)
    monkeypatch.setattr(language_id, "_BLOCK", 37)
    assert (language_id.grams(t) == whole).all() and whole.sum() == 3 * len(t) - 3


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home">
<header><a href="/">Home</a> <a href="/b">B</a></header><nav><ul><li><a href=/x>x</a><li><a href=/y>y</a></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it better for all of you.</div>
<main><article><h1>A &amp; B</h1><p>First   para <b>bold<br><p>Second&nbsp;para <a href="z">link</a>.
<aside>Side box</aside><div class="ad">Buy now</div><form><input><p>Your name</p></form><p>Of.</p><!-- no --></article>
<section id="comments"><article><p>Great post, I read all of it and liked it very much indeed.</p></article></section></main>
<script>var t="</p><article>x</article>";</script><footer>&copy; site</footer></body></html>"""


def test_main_text():
    tree = html_extract.grow(*html_extract.labelled())
    assert html_extract.main_text([PAGE], tree) == ["A & B First para bold Second para link. Of."]
    long = "word " * 60
    open_page = f"<div><a href=a>one</a> <a href=b>two</a></div><p>{long}</p><p>{long}</p><div><a href=c>three</a></div>"
    assert html_extract.main_text([open_page], tree) == [(long * 2).strip()]
    assert html_extract.main_text([None, "", "<!-- x", "<script>a", "<p>a &am b &lt;i&gt;</p>" + f"<p>{long}</p>"], tree)[:4] == [""] * 4


def test_main_text_with_left_out_and_empty_tags():
    tree = html_extract.grow(*html_extract.labelled())
    a, b = "first " * 40, "second " * 40
    both = (a + b).strip()
    for page in (f"<html><head><title>T</title><body><article><p>{a}<p>{b}</article>",
                 f"<html><head><title>T</title><meta charset=x><article><p>{a}<p>{b}</article>",
                 f"<article><p>{a}</p><svg viewBox='0 0 1 1'/><p>{b}</p></article>",
                 f"<article><p>{a}</p><math/><p>{b}</p></article>",
                 f"<article><p>{a}</p><button-group><p>{b}</p></button-group></article><button>x</button>",
                 f"<article><p>{a}</p><select-menu></select-menu><p>{b}</p></article>",
                 f"<article><p>{a}</p><button><p>{b}</p></article><button>x</button>",
                 f"<article><p>{a}</p><iframe src=x><p>{b}</p></article>",
                 f"<article><p>{a}</p><svg><title>t</title><svg>x</svg>y</svg><p>{b}</p></article>",
                 f"<article><p>{a}</p><button>x<!-- <button> --></button><p>{b}</p></article>"):
        assert html_extract.main_text([page], tree) == [both], page
    for tag in ("script", "style"):
        assert html_extract.main_text([f"<article><p>{a}</p><{tag}>x<p>{b}</p></article>"], tree) == [a.strip()]
    for bad in ("<svg>" * 30_000, "<svg " * 30_000, "<svg/>" * 30_000, "<button>x" * 20_000 + "</button>" * 20_000):
        html_extract.blocks(bad)


def test_tree_fits_its_table():
    x, y = html_extract.labelled()
    assert ((html_extract.judge(html_extract.grow(x, y), x) >= 0.5) == y).all()


def test_extract_keeps_rows_and_columns(spark):
    d = spark.createDataFrame([(1, "u", PAGE, "keep"), (1, "u", PAGE, "keep"), (None, None, None, "k")],
                              "page_id bigint, url string, html string, words string")
    got = html_extract.extract(d).collect()
    assert [r["text"][:5] for r in got] == ["A & B", "A & B", ""] and got[2]["words"] == "k"
    assert html_extract.extract(d.limit(0)).count() == 0


def test_html_is_linear_on_open_markup():
    for bad in ("<a \"" * 30_000, "<" * 100_000, "<div>" * 20_000, "<p class='" * 20_000, "<b>" * 20_000 + "</i>" * 20_000):
        html_extract.blocks(bad)


def test_wrappers_that_only_sound_like_furniture():
    tree = html_extract.grow(*html_extract.labelled())
    art = " ".join(f"word{k} and the text" for k in range(27))
    p = f"<p>{art}</p><p>{art}</p>"
    nav = "<nav><ul><li><a href=x>Home</a><li><a href=y>About us</a></ul></nav>"
    for body in (f'{nav}<div class="overflow-hidden"><article>{p}</article></div>', f'{nav}<main aria-hidden="false">{p}</main>',
                 f'{nav}<article data-note="the hidden cost">{p}</article>', f'{nav}<article class="post no-comments">{p}</article>',
                 f'<div class="site has-sidebar">{nav}<div>{p}</div></div>', f'<form id="aspnetForm">{nav}<div>{p}</div></form>',
                 f'{nav}<article>{p}<form><label>Your name please</label><p>send us mail</p></form></article>'
                 f'<div class="post-comments"><p>{art}</p></div>',
                 f'{nav}<div hidden>secret words here</div><p style="color:red;display: none">more secret</p><b aria-hidden=true>x</b>'
                 f"<article>{p}</article>"):
        assert html_extract.main_text([f"<html><body>{body}</body></html>"], tree) == [f"{art} {art}"], body


def test_language_sample_is_the_first_ids_by_hash(spark, monkeypatch):
    d = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', if(id % 7 = 0, null, 'b')) as lang")
    d = d.union(d.filter("doc_id < 50")).union(spark.sql("select cast(null as bigint), 'a'"))
    rows = d.filter("doc_id is not null and lang is not null").distinct().selectExpr("doc_id", "lang", "xxhash64(doc_id) as h").collect()

    def brute(per_lang):
        return {(r["doc_id"], r["lang"]) for lang in "ab" for r in sorted((r for r in rows if r["lang"] == lang), key=lambda r: r["h"])[:per_lang]}

    for bits, n in ((16, 200), (3, 200), (16, 10_000), (2, 1)):
        monkeypatch.setattr(language_id, "PLACES", bits)
        assert {tuple(r) for r in language_id.sample_ids(d, n).collect()} == brute(n)
    monkeypatch.setattr(language_id, "FIT_DOCS", 60)  # shared by the languages
    assert {tuple(r) for r in language_id.sample_ids(d, 200).collect()} == brute(30)
    monkeypatch.setattr(language_id, "MAX_LANGS", 1)
    assert {r["lang"] for r in language_id.sample_ids(d, 200).collect()} == {"b"}
    assert language_id.sample_ids(d.limit(0)).count() == 0


def test_language_of_a_very_long_text(spark, frames):
    d, _, _ = frames
    long = spark.createDataFrame([(9500, "le la les que dans avec " * 60_000, None, "")], d.schema)
    got = language_id.identify(d.union(long)).filter("doc_id = 9500").first()
    assert got["lang_pred"] == "fr"
