"""Quality rules, language ID, token counts, byte-level BPE and HTML extraction against brute force, the libraries and odd tables."""

import base64
import functools
import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from llm.helpers import LONG, PROSE, TEXTS, bag, odd_documents

from coverlens.llm import byte_bpe, html_extract, language_id, quality_rules, token_counts

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.merge_table(RANKS).ranks, special_tokens={})


def fuzz(seed, n):
    r = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", "漢", "😀", "1", "23", "!", "...", "aaaa", "the", " the", "\r\n", " ", "​", "²", "_", "eses", ".", ","]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["a" * 3000, "ab" * 2000, " " * 500, "\n" * 33, "", "abcabcbcbca" * 100]


def test_merge_replay_equals_the_library(library):
    words = byte_bpe.ChunkCache(P.PATTERN, byte_bpe.merge_table(RANKS).encode, limit=300)
    for seed in range(3):  # the cache is trimmed between blocks
        texts = fuzz(seed, 700) + ["".join(random.Random(seed).choices("abcdehlnorst ", k=4000))]
        words.learn(texts)
        for t in texts:
            assert np.frombuffer(words.ids(t), "<u4").tolist() == library.encode_ordinary(t), t


def test_bpe_digests_and_round_trip(spark, library):
    docs = odd_documents(spark)
    rows = docs.select("doc_id", "text").collect()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert bag(byte_bpe.digests(docs, RANKS, P.PATTERN).collect()) == bag(want)
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert bag((i, bytes(d).decode()) for i, d in back) == bag((i, t or "") for i, t in rows)
    assert byte_bpe.digests(docs.limit(0), RANKS, P.PATTERN).collect() == []


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts_equal_the_library(spark, name):
    docs = odd_documents(spark)
    extra = spark.createDataFrame([(100 + k, t) for k, t in enumerate([LONG * 3, " lead " + LONG, LONG.replace(" ", "  "), "▁ mark " * 9000, *fuzz(5, 60)])], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(extra)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(P.path(name))
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    want = [(i, len((t or "").encode()), n := count(t or ""), n > 4096) for i, t in docs.collect()]
    assert bag(token_counts.token_counts(docs, P.path(name)).collect()) == bag(want)


def slow_rules(text):
    words, blank = [""], " \t\n\v\f\r"
    for c in text:
        words = [*words, ""] if c in blank else [*words[:-1], words[-1] + c]
    words = [w for w in words if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(blank)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_quality_rules(spark):
    docs = odd_documents(spark)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect() if r.doc_id is not None}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        if t is None or len(t) < 3000:
            assert tuple(got[i])[1:6] == slow_rules(t or ""), t
    for text in ("a b c a b c x", "a a a a", "# * x | y\n\nz\nz\n \nz", "q w e r t y q w e"):
        assert quality_rules.judge(text, lambda b: b + b"x")[:5] == slow_rules(text)
    assert not got[0].kept and not got[10].kept and got[0].base_failed
    rng = random.Random(3)
    prose = " ".join("".join(rng.choices("aaeeiiouubcdlmnrst", k=rng.randint(1, 9))) for _ in range(400))
    noise = " ".join("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=60)) for _ in range(400))
    kept = quality_rules.keep_good(spark.createDataFrame([(1, prose, 0), (2, noise, 0), (3, None, 0), (4, prose, 0)], "doc_id long, text string, kept int"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4] and kept.columns == ["doc_id", "text", "kept"]
    assert quality_rules.in_band(5000, 2.2) and not quality_rules.in_band(5000, 9.0) and not quality_rules.in_band(5000, 1.1)


def test_quality_rules_reject_planted_parts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("n_chars > 1000").select("doc_id", "text")
    rows, rng = docs.where("length(text) > 10000").orderBy("doc_id").limit(12).collect(), random.Random(4)
    clean = " ".join(r.text for r in rows if not quality_rules.judge(r.text, zlib.compress)[5])[:55_000]
    code = base64.b64encode(rng.randbytes(34_000)).decode()
    hexes = " ".join(f"{rng.getrandbits(32):08x}" for _ in range(2000))
    again = "".join(f"{k} same part of the text once more and more\n" for k in range(1000))
    bad = [hexes, clean + code[:45_000], clean[:30_000] + code[:20_000] + clean[30_000:], clean + again]
    planted = spark.createDataFrame(list(enumerate([clean, *bad], 10_000_000)), "doc_id long, text string")
    got = {r.doc_id - 10_000_000: r.kept for r in quality_rules.quality_rules(docs.union(planted)).where("doc_id >= 10000000").collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False}


def words_in(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


LANGS = {"aa": ["ka", "ri", "to", "mu"], "bb": ["sch", "ung", "eit", "ver"], "cc": ["oux", "elle", "tre", "ê"]}


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(i, words_in(rng, LANGS[la], rng.randint(20, 60)), la) for i in range(240) for la in [sorted(LANGS)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.langs == ["aa", "bb", "cc"]
    held = language_id.identify(docs.where(language_id.held_out()), model).join(docs, "doc_id").collect()
    assert len(held) > 30 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    mixed = words_in(rng, LANGS["aa"], 30) + " " + words_in(rng, LANGS["cc"], 30)
    r = language_id.label_words(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    truth = ["aa"] * 30 + ["cc"] * 30
    assert sum(a == b for a, b in zip(r.langs, truth)) / 60 > 0.9
    odd = {r.doc_id: r for r in language_id.identify(odd_documents(spark), model).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == "und" and odd[0].score == 0 and all(0 <= r.score <= 1 for r in odd.values())
    assert odd[4].lang_pred == odd[5].lang_pred
    even = " ".join(words_in(rng, LANGS[k], 20) for k in ("aa", "bb", "cc"))
    kept = language_id.keep_known(spark.createDataFrame([(1, even), (2, "12 34"), (3, None)], "doc_id long, text string"), model)
    assert [r.doc_id for r in kept.collect()] == [1]
    nothing = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert sorted(r.doc_id for r in language_id.keep_known(docs, model).collect()) == list(range(240))


def test_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    e, trans, start = rng.normal(size=(700, 3)) * 2, rng.normal(size=(3, 3)), rng.normal(size=3)
    first = np.zeros(700, bool)
    first[[0, 1, 5, 300, 301, 699]] = True
    p = language_id.marginals(e, first, trans, start)
    cuts = [*np.flatnonzero(first).tolist(), 700]
    for a, b in zip(cuts, cuts[1:]):
        x, n = e[a:b], b - a
        fwd, bwd = np.zeros((n, 3)), np.zeros((n, 3))
        fwd[0] = start + x[0]
        for i in range(1, n):
            fwd[i] = np.logaddexp.reduce(fwd[i - 1][:, None] + trans, 0) + x[i]
        for i in range(n - 2, -1, -1):
            bwd[i] = np.logaddexp.reduce(trans + (x[i + 1] + bwd[i + 1])[None], 1)
        assert np.allclose(np.exp(fwd + bwd - np.logaddexp.reduce(fwd[-1])), p[a:b], atol=1e-9)


PAGES = {
    "<html><body><nav><a href=1>Home</a></nav><article><h1>T &amp; x</h1><p>One  two<br>three</p><p>four <b>five</b></article><footer>Foot words here</footer>": "T & x\nOne two three\nfour five",
    "<article><p>alpha beta</p><aside>side words</aside><div class='ad banner'>buy now</div><p>gamma</p><script>var t='</p>';</script></article><div id=comments><p>nice post</p></div>": "alpha beta\ngamma",
    "": "",
    "<nav>only menu</nav>": "",
    "plain text": "plain text",
    "<article><p>unclosed <i>text<p>next<!-- hidden --> one</article><form><p>mail</p></form>": "unclosed text\nnext one",
}


ARTICLE = "<h1>Head line</h1><p>alpha beta gamma delta</p><p>epsilon zeta</p>"
TEXT = "Head line\nalpha beta gamma delta\nepsilon zeta"
WRAPPED = {
    f'<body><div class="page with-sidebar"><article>{ARTICLE}</article></div>': TEXT,
    f'<body><div class="no-sidebar"><main>{ARTICLE}</main></div>': TEXT,
    f'<body><div class="has-header wrapper"><article>{ARTICLE}</article></div>': TEXT,
    f"<html><head><title>T t</title><body><article>{ARTICLE}</article>": TEXT,
    f"<html><head><title>T t</title><article>{ARTICLE}</article>": TEXT,
    "<article><p class='promo'>Lead words here</p><p id=notice-period>period of notice</p></article>": "Lead words here\nperiod of notice",
    "<article><header><h1>Head line</h1></header><p>alpha beta</p><footer>by me</footer></article>": "Head line\nalpha beta",
    f"<article>{ARTICLE}</article><div class=user-posts><p>I like it so much</p><p>me too very much indeed yes</p></div>": TEXT,
    f"<form><div class=sidebar><article>{ARTICLE}</article></div><p>send this</p></form>": TEXT,
    f"<body><div class=header>{ARTICLE}</div>": TEXT,
    f"<article>{ARTICLE}<article class=comment><p>well said</p></article></article>": TEXT,
    f"<div class='related-work'>{ARTICLE}</div><div class='site-footer'>foot words</div>": TEXT,
}


@pytest.mark.parametrize("html", WRAPPED)
def test_hints_never_cover_the_article(html):
    for weights in ({}, html_extract_weights()):
        assert html_extract.main_text(html, weights) == WRAPPED[html]


@functools.cache
def html_extract_weights():
    """Weights of the pages at hand, counted without Spark."""
    seen = sum((html_extract.label_counts(h) for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()), Counter())
    return {k: html_extract.weight(k, seen[k, 1], seen[k, 0]) for k, _ in seen}


def test_very_long_page():
    html = "<body><nav>" + "<a href=x>m</a>" * 20_000 + "</nav><article>" + "<p>word and word</p>" * 60_000 + "</article>"
    assert html_extract.main_text(html, {}) == "\n".join(["word and word"] * 60_000)


def test_html_extraction(spark):
    rows = [(k, f"u{k}", h) for k, h in enumerate(PAGES)] + [(90, None, None), (1, "u1", list(PAGES)[1]), (None, "x", "<p>a</p>")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = bag(html_extract.extracted(pages).collect())
    want = [(k, u, t, len(t)) for k, u, h in rows for t in [PAGES.get(h, "a" if h else "")]]
    assert got == bag(want)
    assert html_extract.extracted(pages.limit(0)).collect() == []


def test_best_region_equals_all_regions():
    rng = random.Random(2)
    for _ in range(200):
        parts = [rng.choice(["<p>w w</p>", "<div>", "</div>", "<ul><li><a>l</a></li></ul>", "<p>w</p>", "text ", "<h2>h h h</h2>"]) for _ in range(12)]
        weights = {k: rng.uniform(-3, 3) for k in ("p", "div", "li", "body", "ul", "h2")} | {k: rng.uniform(-3, -0.1) for k in ("<p", "<div", "<ul", "<li", "<a", "<h2")}
        items = [(k, v, 0.0) for k, v, _, _ in html_extract.tokens("".join(parts))]
        items = [(k, v, weights[f"<{v.lstrip('/')}"] if k == "<" else len(v.split()) * weights[k]) for k, v, _ in items]
        best = max([0.0] + [sum(s for _, _, s in items[i:j]) for i in range(len(items)) for j in range(i + 1, len(items) + 1)])
        text = html_extract.main_text("".join(parts), weights)
        spans = [items[i:j] for i in range(len(items) + 1) for j in range(i, len(items) + 1) if abs(sum(s for _, _, s in items[i:j]) - best) < 1e-9]
        assert text.split() in [" ".join(v for k, v, _ in s if k != "<").split() for s in spans]
