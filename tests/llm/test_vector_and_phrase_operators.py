"""Top-k search, centroid clustering and collocations against brute force on odd tables, and their SQL twins."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import oracle
import pytest
from llm.helpers import bag, odd_documents

from coverlens.llm import centroids, collocations, topk_search
from coverlens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, row long, vec binary, cluster int, rank int, score long, block long, dim int"


@pytest.mark.parametrize("name", ["op11_topk_search", "op12_centroid_clustering", "op13_collocations"])
def test_twin(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), SF, name, QUERIES[name], ORACLE[name]) is None


def vectors(rng, n, dim):
    """Ids with gaps, repeated rows, a vector that a third of the rows share, and every unusable kind; columns that clash with our own."""
    hot = rng.normal(size=dim)
    rows = [(i, [float(np.float32(v)) for v in (hot if i % 3 == 0 else rng.normal(size=dim))]) for i in range(n)]
    rows += rows[:4] + [(20, rows[1][1]), (None, rows[2][1]), (40, None), (60, [None] * dim), (80, [math.nan] * dim), (100, [math.inf] * dim), (7, []), (120, []), (140, [1.0, -2.0]), (141, [3.0, 0.5]), (160, [0.0] * dim), (-20, [1e30] * dim)]
    return [(i, v, None, 1, b"x", 2, 3, 4, 5, 6) for i, v in rows]


def whole(v):
    return [math.floor(64 * x) for x in v]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 16)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk_search, "GATHER", 2)
    rows = vectors(np.random.default_rng(1), 200, 8)
    known = [(i, whole(v)) for i, v, *_ in rows if i is not None and usable(v)]
    want = []
    for a, (i, q) in enumerate(known):
        if i % 20 == 0:
            scores = [(-min(2**63 - 1, max(-(2**63), sum(x * y for x, y in zip(q, v)))), j) for b, (j, v) in enumerate(known) if a != b and len(v) == len(q)]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:20], 1)]
    got = topk_search.top_k(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    # the huge vector goes beyond 64 bits, where floats of 2^62 stand for its components
    far = lambda r: r[0] == -20 or r[2] == -20
    assert bag(r for r in got.collect() if not far(r)) == bag(r for r in want if not far(r))
    assert topk_search.top_k(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("dim", [1, 3, 64, 100])
def test_segment_bounds_hold(dim):
    rng = np.random.default_rng(dim)
    q, v = np.floor(64 * rng.normal(size=(30, dim))), np.floor(64 * rng.normal(size=(50, dim)) + rng.integers(-100, 100, (50, 1)))
    score = q @ v.T
    for level in topk_search.LEVELS:
        assert (topk_search.statistics(q, level) @ topk_search.statistics(v, level).T >= score - 1e-6 * np.abs(score) - 1e-6).all()
    least = np.sort(score, 1)[:, -5]
    qs, vs = topk_search.survivors(q, v, least)
    i, j = np.nonzero(score >= least[:, None])
    assert set(i) <= set(qs) and set(j) <= set(vs)


def test_clusters(spark):
    rows = vectors(np.random.default_rng(2), 150, 6) + [(300 + i, [float(i)] * 6, None, 1, b"x", 2, 3, 4, 5, 6) for i in range(5)]
    kept = [(i, np.array([min(2**27, w) for w in whole(v)], object)) for i, v, *_ in rows if usable(v) and len(v) == 6]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), i, v.astype(float).tobytes()) for i, v in kept if i is not None)
    centers = [[int(x) for x in np.frombuffer(b)] for _, _, b in order[:16]]

    def assign():
        return [min((int(((v - np.array(c, object)) ** 2).sum()), n) for n, c in enumerate(centers)) for _, v in kept]

    for _ in range(3):
        own = assign()
        for n in range(len(centers)):
            part = [v for (_, v), (_, c) in zip(kept, own) if c == n]
            if part:
                centers[n] = [int(sum(x)) // len(part) for x in zip(*part)]
    own = assign()
    inertia = Counter()
    for d, c in own:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    want = [(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, own)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert bag(centroids.clusters(table, dim=6).collect()) == bag(want)
    few = table.where("vec_id IN (1, 2)")
    assert {r.distance for r in centroids.clusters(few, dim=6).collect()} == {0}
    assert centroids.clusters(table.limit(0)).collect() == []


def brute(rows, least, cover=80, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, *w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    out = {}
    many = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = {(p[0], *p[s : s + n]) for p, a in many.items() for n in range(2, len(p) - 1) for s in range(1, len(p) - n + 1) if 100 * a >= cover * f[(p[0], *p[s : s + n])]}
    for p, a in many.items():
        if p not in covered:
            cuts = [(2000000 * a // (f[p[:k]] + f[(p[0], *p[k:])]), k) for k in range(2, len(p))]
            score, k = min(cuts)
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), f[p[:k]], f[(p[0], *p[k:])]))
    return [(lang, r, p.decode(), -a, x, y, total[lang], -s) for lang, found in out.items() for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]


@pytest.mark.parametrize("period", [2, 32])
def test_collocations(spark, period):
    rng = random.Random(period)
    words = ["Alpha", "beta", "İstanbul", "ẞ", "x\x1fy", "gamma", "\x00", "zeta", "a-b"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\x0b", " , "]) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    rows = [(t, rng.choice(["en", "fr", None, "und"])) for t in texts] + [(texts[3], "en")] * 40 + [("same " * 5000, "en"), (None, "en"), ("", None), (" ,;\n", "xx"), ("one two", "yy")]
    docs = spark.createDataFrame([(*r, "f", 1, 2) for r in rows], "text string, lang string, phrase string, freq int, ahead int")
    assert bag(collocations.collocations(docs, least=3, period=period).collect()) == bag(brute(rows, 3))
    assert bag(collocations.collocations(docs, least=3, top=5, period=period).collect()) == bag(brute(rows, 3, top=5))
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_collocations_of_odd_documents(spark):
    docs = odd_documents(spark)
    assert bag(collocations.collocations(docs).collect()) == bag(brute([(r.text, r.lang) for r in docs.collect()], 30))


def test_full_bitmap_changes_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert bag(collocations.collocations(docs, bits=64).collect()) == bag(brute([(r.text, r.lang) for r in docs.select("text", "lang").collect()], 30))
