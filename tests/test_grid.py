"""Grids whose cells lack mass, a place or a verdict, or are listed twice."""

import os
import random

import duckdb
import numpy as np
import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from __spark_entry__ import oracle_sql, queries
from coverlens.operators.grid import GridSpec, focal_score
from coverlens.plans import priors as P
from coverlens.plans.registry import rounded
from coverlens.sources import adapters as A

SF = "/root/testdata/sf0.001"
INF = float("inf")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """sf0.001 with vectors that are null, empty, short or long, hold nulls, come twice or have no id."""
    d = str(tmp_path_factory.mktemp("odd"))
    t = pq.read_table(f"{SF}/embeddings.parquet")
    rows = t.to_pylist()
    for r in rows:
        v = r["embedding"]
        r["embedding"] = {7: None, 11: [], 13: v[:40], 17: v + v[:3], 19: [None if i % 9 == 4 else x for i, x in enumerate(v)]}.get(r["vec_id"] % 50, v)
    rows += [rows[k] for k in (3, 23, 223)] + [rows[60] | {"vec_id": None}]
    pq.write_table(pa.Table.from_pylist(rows, t.schema), f"{d}/embeddings.parquet")
    for name in oracle.TABLES:
        if name != "embeddings":
            os.symlink(f"{SF}/{name}.parquet", f"{d}/{name}.parquet")
    return d


def test_focal_score_of_odd_cells(spark):
    cells = spark.createDataFrame([(0, 0, 0.5, True), (0, 1, None, None), (0, 2, 0.25, True), (0, 2, 0.25, True), (0, 3, 1.0, False), (None, 1, 8.0, True)], "row int, col int, p double, valid boolean")
    seen = spark.createDataFrame([(0, 0)], "row int, col int")
    got = {(r.row, r.col): r.score for r in focal_score(cells, seen, GridSpec(1, 4), 1.0, 0.5).collect()}
    assert got == {(0, 0): 0.25, (0, 1): -INF, (0, 2): 3.0, (0, 3): -INF}


def test_every_vector_is_one_row_of_cells(spark, odd):
    c = A.cells(spark, odd).where("row IS NOT NULL").groupBy("grid_id", "row").agg({"col": "max", "*": "count"}).collect()
    assert len(c) == 500 and {(r.grid_id, r["max(col)"]) for r in c} == {("g0", 63)} and {r["count(1)"] for r in c} == {64, 128}


@pytest.mark.parametrize("name", ["focal_score", "value_map"])
def test_scores_of_odd_vectors_match_sql(spark, odd, name):
    assert oracle.compare(spark, oracle.connect(odd), odd, name, queries()[name], oracle_sql()[name]) is None


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """sf0.001 with lone cells of mass whose total makes every second mass a half of the tenth digit; a sum has one term, so no order shows."""
    d, total, rng = str(tmp_path_factory.mktemp("halves")), 2**11 * 5**9, random.Random(1)
    w = np.zeros((500, 64), np.int64)
    at = [(r, c) for r in range(0, 500, 3) for c in range(0, 64, 3)]
    for k, cell in enumerate(at):
        left = len(at) - k
        w[cell] = rng.randrange(total * 4 // (left * 5), total * 6 // (left * 5)) if left > 1 else total
        total -= int(w[cell])
    sign = np.where(np.arange(500) % 17 == 0, -1, 1)[:, None]
    e = np.where(w > 0, sign * (w + 0.5) / 1e6, 0.0).astype(np.float32)
    assert int(np.floor(np.abs(e.astype(np.float64)) * 1e6).sum()) == 2**11 * 5**9
    t = pq.read_table(f"{SF}/embeddings.parquet")
    pq.write_table(pa.Table.from_pylist([{"vec_id": i, "embedding": v, "label": 0} for i, v in enumerate(e.tolist())], t.schema), f"{d}/embeddings.parquet")
    for name in oracle.TABLES:
        if name != "embeddings":
            os.symlink(f"{SF}/{name}.parquet", f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("name", ["focal_score", "value_map"])
def test_halves_of_the_last_digit_match_sql(spark, halves, name):
    assert oracle.compare(spark, oracle.connect(halves), halves, name, queries()[name], oracle_sql()[name]) is None


def test_rounding_matches_sql(spark):
    h = [(random.Random(k).randrange(10**7) + 0.5) / 1e10 for k in range(2000)]
    x = h + [-v for v in h] + [float(np.nextafter(v, 0)) for v in h] + [0.0, 1.5, 1e18 / 7, 1e300, -1e300, INF, -INF, None]
    df = spark.createDataFrame(list(enumerate(x)), "i int, x double")
    want = duckdb.connect().execute("SELECT round(unnest(?::DOUBLE[]), 10)", [x]).fetchall()
    assert [r.x for r in rounded(df, 10).orderBy("i").collect()] == [r[0] for r in want]


def test_scores_are_exact_in_any_order(spark):
    w = {(r.row, r.col): r for r in A.cell_weights(spark, SF).collect()}
    total, g = sum(r.w for r in w.values()), A.grid_spec(spark, SF)
    seen = {(r.row, r.col) for r in P.R.footprint(A.pings(spark, SF), g, 1.5).select("row", "col").distinct().collect()}
    twice = {k: r.w * (1 if k in seen else 2) for k, r in w.items()}
    want = {k: sum(twice.get((k[0] + i, k[1] + j), 0) for i in (-1, 0, 1) for j in (-1, 0, 1)) / 2 / total if r.valid else -INF for k, r in w.items()}
    assert {(r.row, r.col): r.score for r in P._focal(spark, SF).collect()} == want
