"""The coupled belief against a plain step-by-step map."""

import numpy as np
import pytest

from coverlens.operators import belief as B


def step_by_step(prior, looks, p_d, tau, end, time_zero):
    """Map after step `end`; looks maps a step to its cells."""
    post, base, last, mass = prior.copy(), prior.copy(), np.full(prior.shape, -1), prior.sum()
    for t in range(end + 1):
        if looks.get(t):
            at = tuple(np.array(sorted(looks[t])).T)
            post[at] *= 1 - p_d
            post *= mass / post.sum()
            base[at], last[at] = post[at], t
        old = (last >= (0 if time_zero else 1)) & (last < t)
        if old.any():
            post[old] = base[old] + (prior[old] - base[old]) * (1 - np.exp(-(t - last[old]) / tau))
            post *= mass / post.sum()
    return post


def table(spark, prior, looks, run="r"):
    cells = spark.createDataFrame([("g", r, c, float(v), True) for (r, c), v in np.ndenumerate(prior)], "grid_id string, row int, col int, p double, valid boolean")
    obs = [(run, int(r), int(c), t, 1) for t, at in looks.items() for r, c in at]
    return spark.createDataFrame(obs, "run_id string, row int, col int, t int, k long"), cells


def check(got, prior, post):
    rows = {(r.row, r.col): r.posterior for r in got}
    rest = rows.pop((-1, -1))
    assert all(abs(v - post[k]) < 1e-11 for k, v in rows.items())
    assert abs(rest + sum(rows.values()) - prior.sum()) < 1e-10
    assert abs(rest - (post.sum() - sum(post[k] for k in rows))) < 1e-10


@pytest.mark.parametrize("time_zero", [True, False])
@pytest.mark.parametrize(("p_d", "tau"), [(0.8, 5.0), (1.0, 0.5), (0.3, 1000.0), (0.0, 3.0)])
def test_belief_equals_the_map_of_every_step(spark, p_d, tau, time_zero):
    rng = np.random.default_rng(3)
    prior = rng.random((40, 5)) * (rng.random((40, 5)) > 0.2)
    looks = {t: {(int(rng.integers(40)), int(rng.integers(5))) for _ in range(rng.integers(0, 30))} for t in range(0, 30, 3)}
    looks[0] = {(0, 0), (1, 1), (39, 4)}
    looks[3] = looks[3] | {(1, 1)}
    looks[4] = {(1, 1), (2, 2)}
    obs, cells = table(spark, prior, looks)
    check(B.mass_conserving_belief(obs, cells, p_d, tau, 33, time_zero).collect(), prior, step_by_step(prior, looks, p_d, tau, 33, time_zero))


def test_late_looks_long_silence_and_no_looks(spark):
    prior = np.full((2, 2), 0.25)
    obs, cells = table(spark, prior, {0: {(0, 0)}, 50: {(1, 1)}})
    check(B.mass_conserving_belief(obs, cells, 0.8, 10.0, 40).collect(), prior, step_by_step(prior, {0: {(0, 0)}}, 0.8, 10.0, 40, True))
    far = {(r.row, r.col): r.posterior for r in B.mass_conserving_belief(obs, cells, 0.8, 10.0, 900).collect()}
    assert abs(far[0, 0] - 0.25) < 1e-9 and abs(far[1, 1] - 0.25) < 1e-9
    assert B.mass_conserving_belief(obs.limit(0), cells, 0.8, 10.0, 40).collect() == []


def test_cells_of_a_detection_are_no_evidence(spark):
    events = spark.createDataFrame([("r", 0, 1, 3, 4), ("r", 0, 2, 3, 4), ("r", 1, 1, 3, 4)], "run_id string, agent_id int, t int, row int, col int")
    found = spark.createDataFrame([("r", 3, 4, 1)], "run_id string, row int, col int, t int")
    assert [(r.t, r.k) for r in B.observations(events, detected=found).collect()] == [(2, 1)]
