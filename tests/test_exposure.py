import numpy as np
import pytest
from pyspark.sql import functions as F

from coverlens.operators import belief as B
from coverlens.operators import exposure as X
from coverlens.operators.grid import GridSpec, footprint, normalize_grid


def pings(spark, rows):
    return spark.createDataFrame(rows, "run_id string, agent_id int, t int, x double, y double")


def cells(spark, grid):
    a = np.asarray(grid, float)
    return spark.createDataFrame([("g", int(r), int(c), float(a[r, c]), True) for r in range(a.shape[0]) for c in range(a.shape[1])],
                                 "grid_id string, row int, col int, p double, valid boolean")


def test_two_cells(spark):
    p = pings(spark, [("r", 0, 0, 0.5, 0.5), ("r", 0, 1, 1.5, 0.5)])
    r = X.mission_endpoints(p, cells(spark, [[0.5, 0.5]]), GridSpec(1, 2), 0.4, 0.8).first()
    assert r.P_detect == pytest.approx(0.8) and r.RMST == pytest.approx(0.8)
    assert (r.exposures, r.observed_cells, r.max_n) == (2, 2, 1)


def test_runs_that_see_nothing_have_rows(spark):
    p = pings(spark, [("r", 0, 0, 0.5, 0.5), ("r", 0, 3, 1.5, 0.5), ("far", 0, 1, 90.0, 90.0)])
    c, g = cells(spark, [[0.5, 0.5]]), GridSpec(1, 2)
    far = X.mission_endpoints(p, c, g, 0.4, 0.8).where("run_id = 'far'").first()
    assert (far.P_detect, far.RMST, far.L, far.exposures, far.observed_cells, far.revisit_fraction) == (0.0, 4.0, 0.0, 0, 0, None)
    e = X.exposure_events(p, g, 0.4)
    n = X.exposure_counts(e)
    for df, want in ((X.expected_detection(n, c, 0.8, p), ("far", 0.0)), (X.coverage(e, c, p), ("far", 0.0, 0)), (X.expected_rmst(e, c, 0.8, F.lit(3), p), ("far", 4.0)), (X.exposure_stats(n, None, p), ("far", 0, 0, 0, None, None))):
        assert df.count() == 2 and tuple(df.where("run_id = 'far'").first()) == want


def test_multiplicity(spark):
    p = pings(spark, [("r", a, t, 0.5, 0.5) for a in range(2) for t in range(2)])
    c = X.exposure_counts(X.exposure_events(p, GridSpec(1, 1), 0.4))
    assert c.first().n == 4
    assert X.expected_detection(c, cells(spark, [[1.0]]), 0.8).first().P_detect == pytest.approx(1 - 0.2**4)


def test_interleaved_times_and_rmst_against_brute_force(spark):
    rng = np.random.default_rng(3)
    T, q = 40, 0.3
    rows = [("r", a, int(t), float(rng.integers(0, 4)) + 0.5, float(rng.integers(0, 3)) + 0.5) for a in range(3) for t in rng.choice(T + 1, 18, replace=False)]
    prior = rng.random((3, 4))
    prior /= prior.sum()
    g = GridSpec(3, 4)
    got = X.expected_rmst(X.exposure_events(pings(spark, rows), g, 1.0), cells(spark, prior), 1 - q, F.lit(T)).first().RMST
    want = 0.0
    for r in range(3):
        for c in range(4):
            ts = [t for _, _, t, x, y in rows if np.hypot(c + 0.5 - x, r + 0.5 - y) <= 1.0]
            want += prior[r, c] * sum(q ** sum(t <= s for t in ts) for s in range(T + 1))
    assert got == pytest.approx(want, abs=1e-10)


def test_footprint_stays_inside_and_handles_outside_positions(spark):
    p = pings(spark, [("r", 0, 0, 0.1, 0.1), ("r", 0, 1, -50.0, 2.0), ("r", 0, 2, 99.0, 99.0)])
    got = {(r.row, r.col) for r in footprint(p, GridSpec(3, 3), 1.0).collect()}
    assert got == {(0, 0)}


def test_recovery_curve_is_cumulative_and_ends_at_the_endpoints(spark):
    rng = np.random.default_rng(5)
    rows = [("r", a, t, float(rng.random() * 6), float(rng.random() * 6)) for a in range(3) for t in range(30)]
    prior = np.full((6, 6), 1 / 36)
    p, c, g = pings(spark, rows), cells(spark, prior), GridSpec(6, 6)
    curve = X.recovery_curve(p, c, g, 1.2, 0.8, 7, X.first_crossing(p, 20.0), 1000.0).orderBy("step").toPandas()
    end = X.mission_endpoints(p, c, g, 1.2, 0.8).first()
    assert curve.step.tolist() == [0, 7, 14, 21, 28, 29]
    assert curve.P_detect_cumulative.iloc[-1] == pytest.approx(end.P_detect) and curve.L_cumulative.iloc[-1] == pytest.approx(end.L)
    assert (curve.P_detect_cumulative.diff().dropna() >= -1e-12).all() and (curve.distance_absolute.diff().dropna() >= 0).all()


def test_moving_target(spark):
    p = pings(spark, [("r", 0, t, float(t), 0.0) for t in range(5)])
    tr = spark.createDataFrame([(1, t, 2.0, 0.0) for t in range(5)], "target_id int, t int, x double, y double")
    r = X.moving_target_detection(p, tr, 1.0, 0.5, F.lit(4)).first()
    assert r.exposures == 3 and r.P_detect == pytest.approx(1 - 0.5**3)
    assert r.RMST == pytest.approx(1 + 0.5 + 0.25 + 0.125 + 0.125)


def test_targets_found_against_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = [("r", a, t, float(rng.random() * 40), float(rng.random() * 40)) for a in range(2) for t in range(6)]
    tg = [(i, float(rng.random() * 40), float(rng.random() * 40)) for i in range(200)]
    got = {r.target_id for r in X.targets_found(pings(spark, rows), spark.createDataFrame(tg, "target_id int, x double, y double"), 1.5).collect()}

    def d(px, py, a, b):
        v, w = np.subtract(b, a), np.subtract((px, py), a)
        u = np.clip(np.dot(v, w) / np.dot(v, v), 0, 1)
        return np.hypot(*(w - u * v))

    pts = {a: [(x, y) for _, aa, _, x, y in sorted(rows, key=lambda r: r[2]) if aa == a] for a in range(2)}
    want = {i for i, x, y in tg if any(d(x, y, s, e) <= 1.5 for ps in pts.values() for s, e in zip(ps, ps[1:]))}
    assert got == want and want


def test_normalize_rejects_bad_mass(spark):
    with pytest.raises(Exception, match="grid mass"):
        normalize_grid(cells(spark, [[0.5, -0.1]])).collect()


# ---- belief -----------------------------------------------------------------------------------------------------------


def obs(spark, rows):
    return spark.createDataFrame([("r", r, c, t, 1) for r, c, t in rows], "run_id string, row int, col int, t int, k long")


def full(post, prior):
    """Dense map from touched cells and background."""
    d = {(r.row, r.col): r.posterior for r in post.collect()}
    a = np.asarray(prior, float)
    rest = sum(a[i, j] for i in range(a.shape[0]) for j in range(a.shape[1]) if (i, j) not in d)
    return np.array([[d.get((i, j), a[i, j] / rest * d[(-1, -1)] if rest else 0) for j in range(a.shape[1])] for i in range(a.shape[0])])


def test_uniform_belief_one_and_three_misses(spark):
    u = np.full((2, 2), 0.25)
    p = full(B.posterior(B.evidence_weights(obs(spark, [(0, 0, 1)]), 0.8, float("inf")), cells(spark, u)), u)
    assert p.ravel() == pytest.approx([0.0625, 0.3125, 0.3125, 0.3125])
    w = B.evidence_weights(obs(spark, [(0, 0, 1), (0, 0, 2), (0, 0, 3)]), 0.8, 0.0).first()
    assert w.ell == pytest.approx(0.2**3)


def test_no_detection_power_keeps_prior_and_posterior_sums_to_one(spark):
    u = np.full((2, 2), 0.25)
    o = obs(spark, [(0, 0, 1), (1, 1, 5)])
    assert full(B.posterior(B.evidence_weights(o, 0.0, 10.0), cells(spark, u)), u).ravel() == pytest.approx([0.25] * 4)
    s = B.posterior_at(o, cells(spark, u), 0.8, 10.0, [3, 9]).groupBy("time").agg(F.sum("posterior").alias("s")).collect()
    assert [r.s for r in s] == pytest.approx([1.0, 1.0])


@pytest.mark.parametrize("tau", [0.0, 7.0])
def test_mass_conserving_belief_against_dense_recursion(spark, tau):
    rng = np.random.default_rng(2)
    prior = rng.random((3, 3))
    o = [(int(r), int(c), int(t)) for t in range(1, 12) for r, c in {(int(a), int(b)) for a, b in rng.integers(0, 3, (2, 2))}]
    got = full(B.mass_conserving_belief(obs(spark, o), cells(spark, prior), 0.8, tau, 15), prior)
    post, base, last, seen = prior.copy(), prior.copy(), np.zeros((3, 3)), np.zeros((3, 3), bool)

    def decay(t):
        nonlocal post
        m = seen & (t > last)
        if tau > 0 and m.any():
            before = post.sum()
            post[m] = base[m] + (prior[m] - base[m]) * (1 - np.exp(-(t - last[m]) / tau))
            post *= before / post.sum()

    for t in range(16):  # at every step: look, then relax
        before = post.sum()
        hit = [(r, c) for r, c, tt in o if tt == t]
        for rc in hit:
            post[rc] *= 0.2
        post *= before / post.sum()
        for rc in hit:
            last[rc], seen[rc], base[rc] = t, True, post[rc]
        decay(t)
    assert got == pytest.approx(post) and got.sum() == pytest.approx(prior.sum())


def test_targets_found_in_rounds(spark, monkeypatch):
    """Places that many segments cross are settled early, those that one alone reaches late; equal places are found together."""
    seen = []
    reach = X._reach
    monkeypatch.setattr(X, "_reach", lambda s, *a: seen.append(s) or reach(s, *a))
    rng = np.random.default_rng(3)
    rows = [("r", a, t, float(rng.uniform(0, 30)), float(rng.uniform(0, 30))) for a in range(40) for t in range(20)] + [("q", 0, 0, 2.0, 2.0), ("q", 0, 1, 28.0, 3.0)]
    tg = [(i, float(i % 34 - 2), float(i // 34 % 34 - 2)) for i in range(2 * 34 * 34)]
    got = {(r.run_id, r.target_id) for r in X.targets_found(pings(spark, rows), spark.createDataFrame(tg, "target_id int, x double, y double"), 0.4).collect()}
    want = set()
    at = np.array([p[1:] for p in tg])
    for a, b in zip(rows, rows[1:]):
        if a[:2] == b[:2]:
            p, d = np.array(a[3:]), np.array(b[3:]) - np.array(a[3:])
            u = np.clip((at - p) @ d / (d @ d), 0, 1)
            want |= {(a[0], int(i)) for i in np.flatnonzero(np.hypot(*(at - p - u[:, None] * d).T) <= 0.4)}
    assert got == want and len(seen) == X.FIND_ROUNDS
