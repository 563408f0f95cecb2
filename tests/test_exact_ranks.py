"""Exact rank tests against enumeration of all signs and choices, ties included."""

import itertools
import math
import random

import numpy as np
import pytest

from coverlens.operators import stats as S


def mid_ranks(values):
    v = np.asarray(values, float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def groups(rng):
    return {g: [(rng.choice("ab"), float(rng.choice([-3, -2, -1, 0, 1, 2, 2.5, 4, 5]))) for _ in range(n)] for g, n in enumerate([1, 2, 3, 5, 8, 11, 12])}


@pytest.fixture(scope="module")
def table(spark):
    data = groups(random.Random(4))
    return data, spark.createDataFrame([(g, arm, v) for g, rows in data.items() for arm, v in rows], "g int, arm string, v double")


def test_signed_ranks_over_all_signs(table):
    data, df = table
    got = {r.g: (r.statistic, r.p) for r in S.wilcoxon_paired(df, ["g"], "v", "exact").collect()}
    for g, rows in data.items():
        d = np.array([v for _, v in rows if v])
        if not len(d):
            assert got[g][1] == 1.0
            continue
        r = mid_ranks(np.abs(d))
        w = min(r[d > 0].sum(), r[d < 0].sum())
        sums = [sum(x for x, s in zip(r, signs) if s) for signs in itertools.product((0, 1), repeat=len(r))]
        assert got[g] == (w, pytest.approx(min(1.0, 2 * sum(s <= w for s in sums) / len(sums))))


def test_rank_sums_over_all_choices(table):
    data, df = table
    got = {r.g: r for r in S.mann_whitney_exact(df, ["g"], "arm", "a", "b", "v").collect()}
    for g, rows in data.items():
        a = np.array([arm == "a" for arm, _ in rows])
        r = mid_ranks([v for _, v in rows])
        m = a.sum()
        few = a if m <= (~a).sum() else ~a
        obs = r[few].sum()
        sums = [r[list(c)].sum() for c in itertools.combinations(range(len(r)), int(few.sum()))]
        p = min(1.0, 2 * min(sum(s <= obs for s in sums), sum(s >= obs for s in sums)) / len(sums))
        assert (got[g].n_a, got[g].n_b, got[g].U) == (m, len(r) - m, r[a].sum() - m * (m + 1) / 2)
        assert got[g].p == pytest.approx(p)


def test_empty(table):
    _, df = table
    assert S.mann_whitney_exact(df.limit(0), ["g"], "arm", "a", "b", "v").collect() == []
    assert S.wilcoxon_paired(df.limit(0), ["g"], "v", "exact").collect() == []


def test_large_groups(spark):
    """No ties in 400 differences and 240 values: counted against a walk over the elements."""
    rng = random.Random(9)
    d = [(0, v if rng.random() < 0.55 else -v) for v in range(1, 401)]
    got = S.wilcoxon_paired(spark.createDataFrame(d, "g int, v int"), ["g"], "v", "exact").first()
    ways = np.array([1.0])
    for r in range(1, 401):
        ways = (np.pad(ways, (0, r)) + np.pad(ways, (r, 0))) / 2
    assert got.p == pytest.approx(min(1.0, 2 * ways[: int(got.statistic) + 1].sum()), rel=1e-9)
    v = [(0, "a" if i % 8 == 0 else "b", i * 7919 % 240 + 3.0 * (i % 8 == 0) / 4) for i in range(240)]
    got = S.mann_whitney_exact(spark.createDataFrame(v, "g int, arm string, v double"), ["g"], "arm", "a", "b", "v").first()
    r = mid_ranks([x for _, _, x in v])
    obs = int(r[[a == "a" for _, a, _ in v]].sum())
    ways = np.zeros((31, 240 * 30 + 1))
    ways[0, 0] = 1
    for x in r.astype(int):
        ways[1:, x:] = ways[1:, x:] + ways[:-1, : ways.shape[1] - x]
    p = min(1.0, 2 * min(ways[30, : obs + 1].sum(), ways[30, obs:].sum()) / ways[30].sum())
    assert got.p == pytest.approx(p, rel=1e-9) and got.n_a == 30


def test_few_roots_of_large_groups(spark):
    """A group with ties against counting, and arms of 400 in 3,000 values, with and without ties, against the normal curve."""
    rng = random.Random(5)
    tied = [(0, "a" if rng.random() < 0.15 else "b", rng.randrange(30)) for _ in range(300)]
    large = [(g, "a" if i % 15 in (3, 8) else "b", ((i * 7919 + 1500) % 3000 + 60 * (i % 15 == 3)) // width) for g, width in ((1, 1), (2, 50)) for i in range(3000)]
    got = {r.g: r for r in S.mann_whitney_exact(spark.createDataFrame(tied + large, "g int, arm string, v long"), ["g"], "arm", "a", "b", "v").collect()}
    arm, r = np.array([a == "a" for _, a, _ in tied]), (2 * mid_ranks([v for _, _, v in tied])).astype(int)
    m, obs = int(arm.sum()), int(r[arm].sum())
    ways = np.zeros((m + 1, int(np.sort(r)[-m:].sum()) + 1))
    ways[0, 0] = 1
    for x in r:
        ways[1:, x:] = ways[1:, x:] + ways[:-1, : ways.shape[1] - x]
    p = min(1.0, 2 * min(ways[m, : obs + 1].sum(), ways[m, obs:].sum()) / ways[m].sum())
    assert got[0].n_a == m and got[0].p == pytest.approx(p, rel=1e-9)
    for g in (1, 2):
        arm, v = (np.array(x) for x in zip(*[(a == "a", v) for k, a, v in large if k == g]))
        na, nb, c = int(arm.sum()), int((~arm).sum()), np.unique(v, return_counts=True)[1]
        u, sd = mid_ranks(v)[arm].sum() - na * (na + 1) / 2, math.sqrt(na * nb / 12 * (3001 - (c**3 - c).sum() / (3000 * 2999)))
        normal = math.erfc(max(0.0, abs(u - na * nb / 2) - 0.5) / sd / math.sqrt(2))
        assert got[g].U == u and got[g].p == pytest.approx(normal, abs=2e-4) and 0.01 < got[g].p < 0.99
