import datetime as dt
import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from coverlens.operators import belief as B
from coverlens.operators import exposure as X
from coverlens.operators.grid import GridSpec, footprint
from coverlens.schemas import STREAM_PING
from coverlens.sources import adapters as A
from coverlens.streaming import pings as S

T0 = dt.datetime(2024, 1, 1)
END = (10**9, 9, 100_000, 50.0, 50.0)  # far away and later than all others: brings the watermark past them


def stream(spark, path, batches, last=END):
    """One file, and so one micro-batch, per list of (event, agent, t, x, y), and one more with the last event."""
    for i, rows in enumerate([*batches, [last]]):
        data = [(e, "r", a, t, float(x), float(y), T0 + dt.timedelta(seconds=t)) for e, a, t, x, y in rows]
        spark.createDataFrame(data, STREAM_PING).coalesce(1).write.mode("append").parquet(str(path))
        for f in sorted(path.glob("part-*.parquet")):
            if not f.name.startswith("part-b"):
                f.rename(path / f"part-b{i}.parquet")
    return spark.readStream.schema(STREAM_PING).option("maxFilesPerTrigger", 1).parquet(str(path))


def shuffled(rng, n=120):
    """Pings of three agents over 40 seconds in four batches; within the delay of 30 seconds they come in any order, some twice."""
    rows = [(e, rng.randrange(3), rng.randrange(40), rng.randrange(8) + 0.5, rng.randrange(8) + 0.5) for e in range(n)]
    rng.shuffle(rows)
    order = sorted(rows + rows[:10], key=lambda r: r[2] + rng.random() * 25)
    return rows, [order[i * len(order) // 4 : (i + 1) * len(order) // 4] for i in range(4)]


@pytest.mark.parametrize("tau", [0.0, 7.0])
def test_out_of_order_evidence_equals_batch(spark, tmp_path, tau):
    rows, batches = shuffled(random.Random(1))
    grid = GridSpec(8, 8)
    src = S.stream_pings(stream(spark, tmp_path / "in", batches), "30 seconds")
    table, lost = S.drain(S.stream_evidence(src, grid, 1.2, 0.8, tau, "1 second", block=4), "evidence-test")
    got = {(r.row, r.col): (r.last_t, r.ell) for r in table.groupBy("row", "col").agg(F.max_by(F.struct("last_t", "ell"), "last_t").alias("s")).select("row", "col", "s.*").collect()}
    pings = spark.createDataFrame([("r", a, t, x, y) for _, a, t, x, y in rows], "run_id string, agent_id int, t int, x double, y double")
    want = {(r.row, r.col): (r.last_t, r.ell) for r in B.evidence_weights(B.observations(X.exposure_events(pings, grid, 1.2)), 0.8, tau).collect()}
    assert lost == 0 and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_evidence_without_recovery_is_never_forgotten(spark, tmp_path):
    src = stream(spark, tmp_path / "in", [[(1, 0, 0, 0.5, 0.5)], [(2, 0, 90_000, 0.5, 0.5)]])
    rows = S.run_to_table(S.stream_evidence(S.stream_pings(src, "1 second"), GridSpec(2, 2), 0.4, 0.8, 0.0, "1 second"), "forget-test").orderBy("last_t").collect()
    assert [(r.last_t, round(r.ell, 6)) for r in rows] == [(0, 0.2), (90_000, 0.04)]


def test_recovered_evidence_is_forgotten_without_a_change(spark, tmp_path):
    src = stream(spark, tmp_path / "in", [[(1, 0, 0, 0.5, 0.5)], [(2, 1, 5_000, 1.5, 1.5)], [(3, 0, 90_000, 0.5, 0.5)]])
    rows = S.run_to_table(S.stream_evidence(S.stream_pings(src, "1 second"), GridSpec(2, 2), 0.4, 0.8, 2.0, "1 second"), "fade-test").where("row = 0").orderBy("last_t").collect()
    assert [(r.last_t, r.ell) for r in rows] == [(0, pytest.approx(0.2)), (90_000, pytest.approx(0.2))]


def test_late_rows_are_counted(spark, tmp_path):
    src = stream(spark, tmp_path / "in", [[(1, 0, 10, 0.5, 0.5)], [(2, 0, 1_000, 0.5, 0.5)], [(3, 1, 1_000, 1.5, 1.5)], [(4, 0, 5, 0.5, 0.5), (5, 0, 1_001, 0.5, 0.5)]])
    table, lost = S.drain(S.stream_evidence(S.stream_pings(src, "30 seconds"), GridSpec(2, 2), 0.4, 0.8, 0.0, "1 second"), "late-test")
    assert lost == 1
    assert [(r.last_t, round(r.ell, 6)) for r in table.where("row = 0").orderBy("last_t").collect()] == [(10, 0.2), (1_000, 0.04), (1_001, 0.008)]


def moves(rows):
    last, out = {}, []
    for e, a, t, x, y in sorted(rows, key=lambda r: (r[2], r[0])):
        px, py, pt = last.get(a, (x, y, None))
        out.append((a, t, e, round(float(np.hypot(x - px, y - py)), 6), None if pt is None else t - pt))
        last[a] = (x, y, t)
    return out


def test_out_of_order_moves_and_crossing_equal_batch(spark, tmp_path):
    rows, batches = shuffled(random.Random(2))
    src = stream(spark, tmp_path / "in", batches)
    got = S.run_to_table(S.stream_steps(S.stream_pings(src, "30 seconds"), "1 second"), "moves-test").collect()
    want = moves(rows)
    assert sorted((r.agent_id, r.t, r.event_id, round(r.step, 6), r.dt) for r in got) == sorted(want)
    bound = S.run_to_table(S.stream_step_bound(S.stream_pings(src, "30 seconds"), 2.0, "1 second", reach=80.0), "bound-test").collect()
    assert sorted((r.agent_id, r.event_id) for r in bound) == sorted((a, e) for a, _, e, s, d in want if d is not None and s > 2.0 * max(d, 1))
    per = {}
    for _, t, _, s, _ in want:
        per[t] = per.get(t, 0) + s
    total, hit = 0.0, None
    for t in sorted(per):
        total += per[t]
        if total >= 200 and hit is None:
            hit = (t, round(total, 4))
    alerts = S.run_to_table(S.stream_crossing(S.stream_pings(src, "30 seconds"), 200.0, "1 second"), "crossing-test").collect()
    assert [(r.trigger_step, round(r.failure_distance, 4)) for r in alerts] == [hit]


def test_running_exposure_in_update_mode(spark, tmp_path):
    src = stream(spark, tmp_path / "in", [[(1, 0, 0, 0.5, 0.5)], [(2, 0, 1, 0.5, 0.5), (3, 1, 1, 0.5, 0.5)]], (4, 2, 1, 0.5, 0.5))
    q = S.stream_exposure(src, GridSpec(1, 1), 0.4, None).writeStream.format("memory").queryName("running").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("running").agg(F.max("n")).first()[0] == 4


@pytest.mark.parametrize("last", [(4, 2, 1, 0.5, 0.5), END])
def test_exposure_totals_hold_open_windows(spark, tmp_path, last):
    """Days 0 and 1 in two batches, and a last event that leaves a day open; with an end far behind both days are closed."""
    src = S.stream_pings(stream(spark, tmp_path / "in", [[(1, 0, 0, 0.5, 0.5), (1, 0, 0, 0.5, 0.5)], [(2, 0, 90_000, 0.5, 0.5), (3, 1, 90_000, 1.5, 0.5)]], last), "2 days")
    got = {(r.row, r.col): r.n for r in S.exposure_totals(src, GridSpec(1, 2), 0.4, "totals-test").collect()}
    assert got == {(0, 0): 2 + (last != END), (0, 1): 1}


def test_exposure_query_counts_the_last_day(spark):
    d = "/root/testdata/sf0.001"
    n = queries()["stream_exposure"](spark, d).agg(F.sum("n")).first()[0]
    assert n == footprint(A.pings(spark, d), A.grid_spec(spark, d), 1.5).count()


class FakeHandle:
    """States and timers of one key, with the watermark past every step."""

    def __init__(self):
        self.timers, self.lists, self.maps, self.value = [], [], {}, None

    def getValueState(self, *_):
        return SimpleNamespace(get=lambda: self.value, update=lambda v: setattr(self, "value", v), clear=lambda: setattr(self, "value", None))

    def getListState(self, *_):
        return SimpleNamespace(exists=lambda: bool(self.lists), get=lambda: iter(list(self.lists)), appendList=self.lists.extend, clear=self.lists.clear, put=lambda v: self.lists.__setitem__(slice(None), v))

    def getMapState(self, *_):
        m = self.maps
        return SimpleNamespace(containsKey=m.__contains__, getValue=m.get, updateValue=m.__setitem__, removeKey=m.pop, iterator=lambda: iter(m.items()), keys=lambda: iter(list(m)))

    def registerTimer(self, at):
        self.timers.append(at)


@pytest.mark.parametrize("kind", ["evidence", "moves"])
def test_one_timer_releases_all_complete_steps(kind):
    steps, handle = 50, FakeHandle()
    if kind == "evidence":
        p = S.EvidenceProcessor(0.8, 0.0, 4, 1000)
        rows, key = pd.DataFrame({"row": 1, "col": 1, "t": range(steps), "due": [(t + 1) * 1000 for t in range(steps)]}), ("r", 0, 0)
    else:
        p = S.MoveProcessor(False, None)
        rows, key = pd.DataFrame({"due": [(t + 1) * 1000 for t in range(steps)], "us": range(steps), "event_id": range(steps), "agent_id": 1, "t": range(steps), "x": 1.0, "y": [float(t) for t in range(steps)]}), ("r", 0)
    p.init(handle)
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 1000 * steps - 1000)
    list(p.handleInputRows(key, iter([rows]), now))
    assert handle.timers == [1000]
    out = pd.concat(p.handleExpiredTimer(key, now, SimpleNamespace(getExpiryTimeInMs=lambda: 1000)))
    assert handle.timers == [1000, 1000 * steps]  # the last step waits
    assert out["last_t" if kind == "evidence" else "t"].tolist() == list(range(steps - 1))
