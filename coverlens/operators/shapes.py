"""Areas with holes and parts: scanline filling, and exact clipping to a circle.

A shape is a row with ``rings``: an array of point arrays, outlines and holes alike. A place is inside by the even-odd rule over all
rings, so holes are left out, and an island in a hole is in again. Rings need not repeat their first point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.operators.grid import GridSpec, to_cell


def closed(ring: Column) -> Column:
    """The ring with its first point at its end."""
    return F.when(F.size(ring) == 0, ring).when((F.size(ring) > 1) & (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1)), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def ring_edges(rings: Column) -> Column:
    """All edges (ax, ay, bx, by) of all rings."""
    point = lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    one = lambda r: F.zip_with(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), point)
    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 0), lambda r: one(closed(r))))


def multi_parts(features: DataFrame, keys: list[str]) -> DataFrame:
    """``polygons`` (array of arrays of rings) to one row per part, its place in ``part``; empty parts and rings are dropped."""
    parts = features.select(*keys, F.posexplode("polygons").alias("part", "rings"))
    return parts.withColumn("rings", F.filter("rings", lambda r: F.size(r) > 0)).where(F.size("rings") > 0)


def _merged(runs: Column) -> Column:
    """Disjoint runs of a list of runs (c0, c1) in order of their starts. The list grows by gaps alone, not by runs."""
    end = lambda s: F.filter(F.array(s["cur"]), lambda r: r["c0"] <= r["c1"])
    run = lambda c0, c1: F.struct(c0.alias("c0"), c1.alias("c1"))
    none = run(F.lit(0), F.lit(-1))

    def step(s, r):
        touches = (s["cur"]["c0"] <= s["cur"]["c1"]) & (r["c0"] <= s["cur"]["c1"] + 1)
        return F.struct(F.when(touches, s["done"]).otherwise(F.concat(s["done"], end(s))).alias("done"),
                        F.when(touches, run(s["cur"]["c0"], F.greatest(s["cur"]["c1"], r["c1"]))).otherwise(run(r["c0"], r["c1"])).alias("cur"))

    start = F.struct(F.filter(F.array(none), lambda r: F.lit(False)).alias("done"), none.alias("cur"))
    return F.aggregate(runs, start, step, lambda s: F.concat(s["done"], end(s)))


def fill_runs(features: DataFrame, grid: GridSpec, keys: list[str]) -> DataFrame:
    """(keys, row, c0, c1): disjoint runs of cells of each shape, borders of all rings included.

    Corners become whole cells. Each edge gives its crossing with every row between its ends; every row has an even number of them, so a
    shape's crossings sorted by row and place pair up to runs. The work grows with the border and the runs, not with the area's cells times
    its edges. Level edges and corners are runs of their own. ``keys`` name a shape. All of it happens inside the shape's row, so nothing but
    the shapes is sent or gathered: they are dealt out by key, for a file of few rows fills very many cells.
    """
    def corner(p):
        r, c = to_cell(p["x"], p["y"], grid)
        return F.struct(c.cast("long").alias("x"), r.cast("long").alias("y"))

    def crossing(e, row):
        d, down = F.abs(e["by"] - e["ay"]), F.signum(e["by"] - e["ay"]).cast("long")
        n = (row - e["ay"]) * (e["bx"] - e["ax"]) * down
        rest = F.pmod(n, d)
        floor = e["ax"] + F.call_function("div", n - rest, d)
        return F.struct(row.alias("row"), (floor + rest / d).alias("x"), (floor + F.when(rest > 0, 1).otherwise(0)).alias("up"), floor.alias("down"))

    def flat(e):
        level = e["ay"] == e["by"]  # every corner is the start of an edge
        return F.struct(e["ay"].alias("row"), F.when(level, F.least(e["ax"], e["bx"])).otherwise(e["ax"]).alias("c0"), F.when(level, F.greatest(e["ax"], e["bx"])).otherwise(e["ax"]).alias("c1"))

    first = lambda e: F.greatest(F.least(e["ay"], e["by"]), F.lit(0))
    last = lambda e: F.least(F.greatest(e["ay"], e["by"]), F.col("_rows")) - 1
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    s = features.select(*keys, "rings").repartition(*keys).withColumns({"_rows": grid.rows.cast("long"), "_cols": grid.cols.cast("long")})
    s = s.select(*keys, "_rows", "_cols", ring_edges(F.transform("rings", lambda ring: F.transform(ring, corner))).alias("_e"))
    xs = F.flatten(F.transform(F.filter("_e", lambda e: first(e) <= last(e)), lambda e: F.transform(F.sequence(first(e), last(e)), lambda row: crossing(e, row))))
    s = s.withColumn("_x", F.array_sort(xs))
    pairs = F.transform(upto(F.expr("size(_x) DIV 2")), lambda k: F.struct(F.get("_x", k * 2)["row"].alias("row"), F.get("_x", k * 2)["up"].alias("c0"), F.get("_x", k * 2 + 1)["down"].alias("c1")))
    runs = F.transform(F.concat(pairs, F.transform("_e", flat)), lambda r: F.struct(r["row"].alias("row"), F.greatest(r["c0"], F.lit(0)).alias("c0"), F.least(r["c1"], F.col("_cols") - 1).alias("c1")))
    s = s.select(*keys, F.array_sort(F.filter(runs, lambda r: (r["c0"] <= r["c1"]) & (r["row"] >= 0) & (r["row"] < F.col("_rows")))).alias("_r"))
    opens = F.filter(upto(F.size("_r")), lambda i: (i == 0) | (F.get("_r", i)["row"] != F.get("_r", i - 1)["row"]))
    s = s.withColumn("_o", F.concat(opens, F.array(F.size("_r"))))  # where each row begins in the list, and its end
    lines = F.transform(upto(F.size("_o") - 1), lambda k: F.slice("_r", F.get("_o", k) + 1, F.get("_o", k + 1) - F.get("_o", k)))
    s = s.select(*keys, F.explode(lines).alias("_l"))
    s = s.select(*keys, F.get("_l", F.lit(0))["row"].alias("row"), F.explode(_merged(F.transform("_l", lambda r: F.struct(r["c0"].cast("int").alias("c0"), r["c1"].cast("int").alias("c1"))))).alias("_m"))
    return s.select(*keys, F.col("row").cast("int").alias("row"), "_m.c0", "_m.c1")


def fill_cells(features: DataFrame, grid: GridSpec, keys: list[str]) -> DataFrame:
    """Distinct (keys, row, col): the cells of the runs, which are disjoint."""
    return fill_runs(features, grid, keys).select(*keys, "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def _span(ax: Column, ay: Column, bx: Column, by: Column, radius: float) -> tuple[Column, Column, Column]:
    """Part [t0, t1] of an edge, given from the circle's centre, that lies in the circle, and whether there is any."""
    dx, dy = bx - ax, by - ay
    a, b, c = dx * dx + dy * dy, ax * dx + ay * dy, ax * ax + ay * ay - radius * radius
    disc = b * b - a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    t0 = F.greatest(F.lit(0.0), F.try_divide(-b - root, a))
    t1 = F.least(F.lit(1.0), F.try_divide(-b + root, a))
    return t0, t1, (a > 0) & (disc > 0) & (t0 < t1)


def clip_lines(features: DataFrame, x: float, y: float, radius: float, keys: list[str]) -> DataFrame:
    """(keys, seg, ax, ay, bx, by, length): the part of every segment of a line ``pts`` that lies in the circle."""
    pts = F.col("pts")
    seg = F.zip_with(F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))),
                     lambda a, b: F.struct((a["x"] - x).alias("ax"), (a["y"] - y).alias("ay"), (b["x"] - x).alias("bx"), (b["y"] - y).alias("by")))
    e = features.select(*keys, F.posexplode(seg).alias("seg", "e")).select(*keys, "seg", "e.*")
    t0, t1, some = _span(*[F.col(c) for c in ("ax", "ay", "bx", "by")], radius)
    e = e.withColumns({"_t0": t0, "_t1": t1}).where(some)
    at = lambda p, q, t, o: F.col(p) + (F.col(q) - F.col(p)) * F.col(t) + o
    length = (F.col("_t1") - F.col("_t0")) * F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    return e.select(*keys, "seg", at("ax", "bx", "_t0", x).alias("ax"), at("ay", "by", "_t0", y).alias("ay"), at("ax", "bx", "_t1", x).alias("bx"), at("ay", "by", "_t1", y).alias("by"), length.alias("length"))


def clip_pieces(features: DataFrame, x: float, y: float, radius: float, keys: list[str]) -> DataFrame:
    """(keys, ring, edge, kind, ...): the border of a polygon clipped to the circle, as straight pieces and arcs in order.

    Per edge up to three pieces: an arc for its part before the circle, a straight piece inside, an arc for its part behind. An arc runs
    from angle ``a0`` by ``turn``; the arcs of a ring add up to the parts of the circle that the polygon covers, so the signed areas of all
    pieces add up to the clipped area. Rings keep their direction: holes against their outline subtract themselves.
    """
    rings = F.transform("rings", lambda r: F.transform(closed(r), lambda p: F.struct((p["x"] - x).alias("x"), (p["y"] - y).alias("y"))))
    r = features.select(*keys, F.posexplode(rings).alias("ring", "r"))
    e = r.select(*keys, "ring", F.posexplode(ring_edges(F.array("r"))).alias("edge", "e")).select(*keys, "ring", "edge", "e.*")
    t0, t1, some = _span(*[F.col(c) for c in ("ax", "ay", "bx", "by")], radius)
    # an edge that misses the circle is one arc from end to end
    e = e.withColumns({"_t0": F.when(some, t0).otherwise(1.0), "_t1": F.when(some, t1).otherwise(1.0)})
    at = lambda t: [F.col(p) + (F.col(q) - F.col(p)) * t for p, q in (("ax", "bx"), ("ay", "by"))]
    ends = [at(t) for t in (F.lit(0.0), F.col("_t0"), F.col("_t1"), F.lit(1.0))]

    def piece(kind, p, q):
        cross, dot = p[0] * q[1] - q[0] * p[1], p[0] * q[0] + p[1] * q[1]
        turn = F.atan2(cross, dot)
        area = turn * (radius * radius / 2) if kind == "arc" else cross / 2
        return F.struct(F.lit(kind).alias("kind"), p[0].alias("px"), p[1].alias("py"), q[0].alias("qx"), q[1].alias("qy"), F.atan2(p[1], p[0]).alias("a0"), turn.alias("turn"), area.alias("area"))

    pieces = F.array(*[F.struct(use.alias("use"), piece(kind, p, q).alias("piece")) for use, kind, p, q in (
        (F.col("_t0") > 0, "arc", ends[0], ends[1]), (F.col("_t0") < F.col("_t1"), "line", ends[1], ends[2]), (F.col("_t1") < 1, "arc", ends[2], ends[3]))])
    out = e.select(*keys, "ring", "edge", F.posexplode(pieces).alias("nth", "p")).where("p.use").select(*keys, "ring", "edge", "nth", "p.piece.*")
    moved = [F.when(F.col("kind") == "line", F.col(c) + o).alias(c) for c, o in (("px", x), ("py", y), ("qx", x), ("qy", y))]
    return out.select(*keys, "ring", "edge", "nth", "kind", *moved, "a0", "turn", "area")


def clip_areas(features: DataFrame, x: float, y: float, radius: float, keys: list[str]) -> DataFrame:
    """(keys, area): exact area of each polygon inside the circle; the first ring is the outline, others are holes of either direction."""
    p = clip_pieces(features, x, y, radius, keys).groupBy(*keys, "ring").agg(F.abs(F.sum("area")).alias("a"))
    return p.groupBy(*keys).agg(F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))).alias("area"))
