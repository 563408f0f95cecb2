"""Filling and clipping of shapes with holes and parts against cell-by-cell tests and closed forms."""

import math
import random

import pytest

from coverlens.operators import shapes as S
from coverlens.operators.grid import GridSpec

RINGS = "feature_id long, rings array<array<struct<x: double, y: double>>>"


def shape(spark, *shapes):
    return spark.createDataFrame([(i, [[(float(x), float(y)) for x, y in ring] for ring in rings]) for i, rings in enumerate(shapes)], RINGS)


def brute(rings, n_rows, n_cols):
    """Even-odd test of every cell, with all cells on a border."""
    edges = []
    for ring in rings:
        ring = [(int(x), int(y)) for x, y in ring]
        ring = ring if len(ring) > 1 and ring[0] == ring[-1] else ring + ring[:1]
        edges += list(zip(ring, ring[1:]))
    out = set()
    for r in range(n_rows):
        for c in range(n_cols):
            inside = edge = False
            for (ax, ay), (bx, by) in edges:
                turn = (bx - ax) * (r - ay) - (c - ax) * (by - ay)
                edge |= turn == 0 and min(ax, bx) <= c <= max(ax, bx) and min(ay, by) <= r <= max(ay, by)
                if (ay <= r) != (by <= r):
                    inside ^= c < ax + (r - ay) * (bx - ax) / (by - ay)
            if inside or edge:
                out.add((r, c))
    return out


SQUARE = [(1, 1), (12, 1), (12, 12), (1, 12)]
HOLE = [(4, 4), (4, 9), (9, 9), (9, 4), (4, 4)]
ISLAND = [(6, 6), (7, 6), (7, 7), (6, 7)]


def test_ring_with_hole_and_island(spark):
    got = {(r.row, r.col) for r in S.fill_cells(shape(spark, [SQUARE, HOLE, ISLAND]), GridSpec(15, 15), ["feature_id"]).collect()}
    assert got == brute([SQUARE, HOLE, ISLAND], 15, 15)
    assert (5, 5) not in got and (6, 6) in got and (4, 4) in got and (2, 2) in got


def test_random_shapes(spark):
    rng = random.Random(5)
    shapes = [[[(rng.randint(-4, 24), rng.randint(-4, 24)) for _ in range(rng.randint(1, 7))] for _ in range(rng.randint(1, 3))] for _ in range(60)]
    got = {}
    for r in S.fill_cells(shape(spark, *shapes), GridSpec(20, 20), ["feature_id"]).collect():
        got.setdefault(r.feature_id, set()).add((r.row, r.col))
    for i, rings in enumerate(shapes):
        assert got.get(i, set()) == brute(rings, 20, 20), rings


def test_runs_are_disjoint_and_nothing_is_gathered(spark):
    rng = random.Random(6)
    shapes = [[[(rng.randint(-4, 24), rng.randint(-4, 24)) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 3))] for _ in range(40)]
    runs = S.fill_runs(shape(spark, *shapes), GridSpec(20, 20), ["feature_id"])
    cells = [(r.feature_id, r.row, c) for r in runs.collect() for c in range(r.c0, r.c1 + 1)]
    assert len(cells) == len(set(cells))
    assert {(i, *c) for i, rings in enumerate(shapes) for c in brute(rings, 20, 20)} == set(cells)
    # cells of all shapes of a task in one hash table grow with the file that the task reads
    plan = S.fill_cells(shape(spark, *shapes), GridSpec(20, 20), ["feature_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Sort" not in plan


def test_parts_and_nothing(spark):
    f = spark.createDataFrame([(1, [[[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)], []], [], [[]], [[(5.0, 5.0)]]])], "feature_id long, polygons array<array<array<struct<x: double, y: double>>>>")
    parts = S.multi_parts(f, ["feature_id"])
    assert [(r.part, len(r.rings)) for r in parts.collect()] == [(0, 1), (3, 1)]
    cells = {(r.part, r.row, r.col) for r in S.fill_cells(parts, GridSpec(9, 9), ["feature_id", "part"]).collect()}
    assert (3, 5, 5) in cells and (0, 1, 1) in cells and (0, 2, 0) not in cells
    assert S.fill_cells(f.limit(0).select("feature_id", f.polygons[0].alias("rings")), GridSpec(3, 3), ["feature_id"]).collect() == []


def area(spark, rings, x, y, r):
    return S.clip_areas(shape(spark, rings), x, y, r, ["feature_id"]).first().area


def test_clipped_areas_have_closed_forms(spark):
    assert area(spark, [SQUARE], 6.5, 6.5, 50.0) == pytest.approx(121)
    assert area(spark, [SQUARE], 6.5, 6.5, 2.0) == pytest.approx(math.pi * 4)
    assert area(spark, [SQUARE[::-1]], 1.0, 6.0, 2.0) == pytest.approx(math.pi * 2)
    assert area(spark, [SQUARE], 1.0, 1.0, 3.0) == pytest.approx(math.pi * 9 / 4)
    assert area(spark, [SQUARE], 40.0, 40.0, 3.0) == pytest.approx(0, abs=1e-9)
    segment = lambda r, d: r * r * math.acos(d / r) - d * math.sqrt(r * r - d * d)
    assert area(spark, [SQUARE], 0.0, 6.0, 2.0) == pytest.approx(segment(2, 1))
    assert area(spark, [SQUARE, HOLE], 6.5, 6.5, 3.0) == pytest.approx(4 * segment(3, 2.5))
    assert area(spark, [SQUARE, HOLE[::-1]], 6.5, 6.5, 50.0) == pytest.approx(96)


def test_clipped_pieces_follow_each_other(spark):
    rows = S.clip_pieces(shape(spark, [SQUARE]), 1.0, 1.0, 3.0, ["feature_id"]).orderBy("edge", "nth").collect()
    lines = [(round(r.px, 9), round(r.py, 9), round(r.qx, 9), round(r.qy, 9)) for r in rows if r.kind == "line"]
    assert lines == [(1, 1, 4, 1), (1, 4, 1, 1)]
    assert sum(r.turn for r in rows if r.kind == "arc") == pytest.approx(math.pi / 2)


def test_clipped_lines(spark):
    f = spark.createDataFrame([(1, [(-5.0, 1.0), (5.0, 1.0), (5.0, 9.0)]), (2, [(0.0, 0.0), (0.5, 0.0)]), (3, [(3.0, 3.0)]), (4, [(0.0, 2.0), (0.0, 2.0), (9.0, 2.0)])], "feature_id long, pts array<struct<x: double, y: double>>")
    got = [(r.feature_id, r.seg, round(r.ax, 6), round(r.bx, 6), round(r.length, 6)) for r in S.clip_lines(f, 0.0, 0.0, 2.0, ["feature_id"]).collect()]
    assert got == [(1, 0, -round(math.sqrt(3), 6), round(math.sqrt(3), 6), round(2 * math.sqrt(3), 6)), (2, 0, 0.0, 0.5, 0.5)]
