"""Packing, license scans, near-dedup, Jaccard join, URL filters and the pipeline against brute force, SQL twins and odd tables."""

import random
import textwrap
import zlib

import numpy as np
import oracle
import public_tokenizers as P
import pytest
from llm.helpers import LONG, PROSE, bag, find, jaccard_brute, odd_documents, reach

import corpus_pipeline
from coverlens.llm import embedding_dedup, jaccard_join, license_scan, packing, quality_rules, url_filter
from coverlens.llm.common import components
from coverlens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
JSON = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_plan_equals_best_fit_of_items(seed):
    rng = random.Random(seed)
    cap = rng.choice([7, 20, 64])
    counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, cap + 1), min(cap, 12))}
    plan = packing.best_fit_plan(counts, cap)
    used, seen = {}, {}
    for length, rank, n, first, per, at in plan:
        assert rank == seen.get(length, 0)
        seen[length] = rank + n
        for k in range(n):
            used.setdefault(first + k // per, []).append((at + k % per * length, length))
    assert seen == counts
    for items in used.values():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and sum(items[-1]) <= cap
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = min((r for r in rooms if r >= length), default=None)
            rooms.append((cap if fit is None else fit) - length)
            if fit is not None:
                rooms.remove(fit)
    assert len(used) == len(rooms)


def test_packing(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(JSON)
    docs = odd_documents(spark)
    rows = packing.packed(docs, JSON).collect()
    want = []
    for i, t in docs.select("doc_id", "text").collect():
        ids = model.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert bag(r[:5] for r in rows) == bag(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in places.values():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and sum(items[-1]) <= 2048
    with_ids = packing.pieces(docs, JSON, with_ids=True).where("doc_id = 7 AND piece = 1").first()
    assert len(with_ids.ids) == with_ids.length == 2048
    assert packing.packed(docs.limit(0), JSON).collect() == []


def test_units_give_the_ids_of_whole_texts():
    marks = ["a", "é", "字", "1", ".", "'s", "–", "😀", "\x7f", "\u0301", " ", " ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b"]
    texts = [None, "", " ", "\n", "<|endoftext|> in text", LONG, "x" * 300_000] + ["".join(random.Random(i).choice(marks) for _ in range(40)) for i in range(2000)]
    encoder = packing.UnitEncoder(JSON, cache_bytes=20_000)
    data = [(t or "").encode() for t in texts]
    for part in (data, data[::-1], data[:1], [b"", b""], []):
        ids, bounds = encoder.block(part)
        assert [bytes(ids[a:b]) for a, b in zip(bounds, bounds[1:])] == [encoder.text(t) for t in part]


def copies(rng):
    """Texts with exact copies, near copies around the threshold and a large group of different near copies."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 120))]
        rows += [" ".join(base)] * rng.randint(1, 3)
        for _ in range(3):
            near = list(base)
            for _ in range(rng.randint(1, 4)):
                near[rng.randrange(len(near))] = word()
            rows.append(" ".join(near))
    base = [word() for _ in range(300)]
    for _ in range(60):
        near = list(base)
        near[rng.randrange(300)] = word()
        rows.append(" ".join(near))
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_jaccard_join(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    texts = copies(random.Random(4))
    docs = spark.createDataFrame([(i * 3 % 211, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.union(odd_documents(spark).selectExpr("doc_id + 1000", "text"))
    rows = [tuple(r) for r in docs.collect()]
    links, roots = jaccard_brute(rows)
    got = jaccard_join.jaccard_join(docs).collect()
    want = [(i, i if not (t or "").split() else r, n, (i if not (t or "").split() else r) == i and (i is not None or not (t or "").split())) for (i, t), n, r in zip(rows, links, roots)]
    assert bag((r.doc_id, r.class_id, r.n_links) for r in got) == bag(w[:3] for w in want)
    assert sum(r.kept for r in got if r.doc_id is not None) == sum(w[3] for w in want if w[0] is not None)
    assert jaccard_join.jaccard_join(docs.limit(0)).collect() == []
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    classes = {r for (i, t), r in zip(rows, roots) if (t or "").split()}
    assert sorted(r.doc_id for r in kept.collect() if (r.text or "").split() and r.doc_id is not None) == sorted(c for c in classes if c is not None)


def test_forest_depth():
    for recall in (0.9, 0.99, 0.9999):
        d = jaccard_join.forest_depth(0.8, recall)
        assert 1 - (1 - 0.8**d) ** jaccard_join.TREES >= recall > 1 - (1 - 0.8 ** (d + 1)) ** jaccard_join.TREES or d == jaccard_join.FULL_DEPTH


@pytest.mark.parametrize("block", [2048, 10])
def test_embedding_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(8):
        base = rng.normal(size=24)
        rows += [(base + rng.normal(size=24) * s, k % 3) for s in (0, 0, 0.1, 0.25, 0.3, 0.4, 0.6)]
    rows += [(rng.normal(size=24), 1) for _ in range(60)]
    rows = [([float(np.float32(x)) for x in v], la) for v, la in rows]
    odd = [(None, 1), ([0.0] * 24, 1), ([1.0, float("nan")], 1), ([1.0, None], 1), ([float("inf")] * 24, 1), (rows[0][0], None), ([], 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([3.0], 2)]
    rows = [(i, *r) for i, r in enumerate(rows + odd)] + [(0, *rows[0])]
    near = []
    usable = lambda v, la: la is not None and v and None not in v and np.isfinite(v).all() and any(v)
    for i, (_, v, la) in enumerate(rows):
        near.append([])
        for j, (_, w, lb) in enumerate(rows):
            if i != j and usable(v, la) and usable(w, lb) and la == lb and len(v) == len(w):
                x, y = np.array(v), np.array(w)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    near[-1].append(j)
    want = [(r[0], len(n), c, c == r[0]) for r, n, c in zip(rows, near, reach(rows, near))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert bag(embedding_dedup.near_duplicates(vectors).collect()) == bag(want) and sum(map(len, near)) > 40
    assert embedding_dedup.near_duplicates(vectors.limit(0)).collect() == []


def test_close_pairs_drops_nothing():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 40)), np.repeat(rng.normal(size=(5, 40)), 20, 0) + rng.normal(size=(100, 40)) * 0.2])
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {tuple(p) for p in np.argwhere(np.triu(u @ u.T >= 0.93, 1)).tolist()}
    got = {(i, j) for a, b in embedding_dedup.close_pairs(x, x, turn, 0.93, True) for i, j in zip(a.tolist(), b.tolist())}
    assert got == want and want


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(500, 560)]
    root = list(range(600))
    for a, b in edges:
        a, b = find(root, a), find(root, b)
        root[max(a, b)] = min(a, b)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {n: find(root, n) for a, b in edges if a != b for n in (a, b)}


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    assert oracle.compare(spark, duck, SF, name, QUERIES[name], ORACLE[name]) is None


def test_license_scan(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (0, "a/LICENSE", mit), (1, "a/b/c/x", "plain words only"), (2, "a/b/LICENSE", gpl), (3, "a/b/c/y", "some text. " + mit + " more text " * 30), (4, "z", None), (5, None, gpl),
        (6, "a/q", "about licence matters in general"), (7, "a/b/c/x", "plain words only"), (None, "a/z", ""), (8, "a/LICENSE2", mit), (9, "a/COPYING", gpl), (10, "a/long", LONG + " licensed"),
    ]
    files = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, path string, text string, license string, score double")
    got = {r.doc_id: r for r in license_scan.license_scan(files).collect()}
    assert [got[k].license for k in (0, 1, 2, 3, 5, 6, 7, None, 10)] == ["MIT", "GPL-3.0", "GPL-3.0", "MIT", "GPL-3.0", "MIT", "GPL-3.0", "MIT", "MIT"]
    assert got[1].license_from == "a/b" and got[6].license_from == "a" and got[3].license_from == "a/b/c/y" and not got[3].is_license_file and got[0].is_license_file
    assert got[4].license == "GPL-3.0" and got[4].license_from == ""  # file 5 without a path lies in the root
    assert license_scan.license_scan(files.limit(0)).collect() == []


def wrapped(mark, text, width=40):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_license_scan_of_headers_and_whole_texts(spark):
    notices, whole = {}, dict(license_scan.WHOLE)
    for name, text in license_scan.NOTICES:
        notices.setdefault(name, text)
    code = "\nint main(int argc, char **argv) { return run(argc, argv); }\n" * 40
    rows = [(f"h/{i}/{name}", name, wrapped(mark, text) + code, False) for i, mark in enumerate((" * ", "# ", "// ", "dnl ")) for name, text in notices.items()]
    rows += [(f"h/{name}", name, wrapped("# ", "Copyright 2020 Some Body. " + whole[name]) + code, False) for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "Zlib")]
    rows += [(f"w/{name}/LICENSE", name, "Copyright (c) 2019-2021 Jane Roe and others\n\n" + wrapped("", text, 60), True) for name, text in whole.items()]
    rows += [("w/GPL-3.0/src/x.c", "GPL-3.0", code, False), ("n/prose", None, PROSE * 20 + " a licence and a copyright are words " + PROSE, False)]
    files = spark.createDataFrame([(i, path, text) for i, (path, _, text, _) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.path: (r.license, r.is_license_file) for r in license_scan.license_scan(files).collect()}
    assert got == {path: (name, is_file) for path, name, _, is_file in rows}


def test_url_filter(spark):
    urls = ["http://A.Example.ORG/es/1?x", "https://example.org/en/12#t", "https://xexample.org/es/", "http://n.com/fr/9.html", "http://n.com/de/", "http://bad.net/p/1", "http://good.net/p/2", "nothing", None, "http://org", "http://org/", "://h.net?q"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(0, urls[0], "h", "p"), (None, None, None, None)], "page_id long, url string, host string, verdict string")
    outcomes = spark.createDataFrame([("bad.net", 1)] * 40 + [("good.net", 0)] * 40 + [(None, 1), ("", 1)], "host string, bad int")
    got = {r.page_id: r for r in url_filter.url_filter(pages, outcomes).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(12)] == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("xexample.org", "/es/", "org/", "allow"), ("n.com", "/fr/9.html", "com/fr/", "allow"),
        ("n.com", "/de/", "com/de/", "block"), ("bad.net", "/p/1", None, "block"), ("good.net", "/p/2", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("org", "", None, "allow"), ("org", "/", "org/", "allow"), ("h.net", "", None, "allow")]
    assert {r.verdict for r in url_filter.url_filter(pages, outcomes.limit(0)).collect()} == {"allow", "block"}
    assert url_filter.url_filter(pages.limit(0), outcomes).collect() == []


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    compress = __import__("zstandard").ZstdCompressor(level=3).compress
    good = [(r.doc_id, r.text) for r in docs if quality_rules.judge(r.text or "", compress)[-1]]
    _, roots = jaccard_brute(good)
    assert {r.doc_id for r in out} == set(roots)


def test_stages_on_odd_tables(spark):
    docs = odd_documents(spark)
    for empty in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            got = stage(spark, empty, SF)
            assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] if k < 3 else "sequence_id" in got.columns
            got.collect()


def test_license_scan_of_a_very_long_text(spark):
    text = " ".join(f"w{i % 5000}" for i in range(1_000_000)) + ". Released under the MIT License. " + "x y z " * 1000
    assert len(text) > 5_000_000
    rows = license_scan.license_scan(spark.createDataFrame([(1, "a/b", text), (2, "a/c", None)], "doc_id long, path string, text string")).orderBy("doc_id").collect()
    assert [(r.own_license, r.license) for r in rows] == [("MIT", "MIT"), (None, None)]


def test_license_windows_lie_around_licence_words(spark):
    words = [f"w{i}" for i in range(400)]
    words[200] = "licence"
    cuts = {tuple(r.tokens) for r in license_scan.windows(spark.createDataFrame([("k", " ".join(words))], "text_key string, text string")).collect()}
    want = {tuple(words[at : at + size]) for size in license_scan.WINDOWS for at in range(0, max(400 - size + size // 8 - 1, 0) + 1, size // 8)}
    assert cuts == {w for w in want if "licence" in w}


def test_memory_is_given_back_at_the_end_of_a_task(monkeypatch):
    from coverlens.llm import common

    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    out = common.tidy(lambda batches: (b * 2 for b in batches))(iter([1, 2]))
    assert next(out) == 2 and not calls
    assert list(out) == [4] and calls == [1]
