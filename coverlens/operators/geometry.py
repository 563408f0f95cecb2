"""Path and polygon operators. Paths are pings ordered by ``t`` inside PATH keys; shapes are arrays of points."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverlens.functions.hashing import uniform
from coverlens.operators.grid import GridSpec, footprint, lognormal_pdf, to_cell
from coverlens.operators.scan import chunk, on_keys, running_sums, sums_below, with_few_totals, with_previous, with_totals
from coverlens.operators.shapes import fill_cells

PATH = ["run_id", "agent_id"]

# Share of finds per feature type.
FEATURE_PROBABILITIES = {
    "linear": 0.25, "field": 0.14, "structure": 0.13, "road": 0.13, "drainage": 0.12,
    "water": 0.08, "brush": 0.02, "scrub": 0.03, "woodland": 0.07, "rock": 0.04,
}

# Search radius in km by environment, climate and size (small, medium, large, xlarge).
RADIUS_KM = {
    ("flat", "temperate"): (0.6, 1.8, 3.2, 9.9),
    ("flat", "dry"): (1.3, 2.1, 6.6, 13.1),
    ("mountainous", "temperate"): (1.1, 3.1, 5.8, 18.3),
    ("mountainous", "dry"): (1.6, 3.2, 6.5, 19.3),
}
SIZES = ("small", "medium", "large", "xlarge")

# Standard normal quantiles at 25, 50, 75 and 95 percent.
QUANTILE_Z = {0.25: -0.6744897501960817, 0.5: 0.0, 0.75: 0.6744897501960817, 0.95: 1.6448536269514722}


def dist(x1, y1, x2, y2) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def with_steps(pings: DataFrame, keys: list[str] = PATH) -> DataFrame:
    """Previous position and step length (0 on the first point)."""
    p = with_previous(pings, keys, "t", ["x", "y"])
    return p.withColumn("step", F.coalesce(dist(F.col("x"), F.col("y"), F.col("prev_x"), F.col("prev_y")), F.lit(0.0)))


def with_distance(pings: DataFrame, keys: list[str] = PATH) -> DataFrame:
    """Step length and cumulative length ``cum`` along each path."""
    return running_sums(with_steps(chunk(pings, "t"), keys), keys, "t", {"cum": F.col("step")}).drop("_chunk")


def route_length(pings: DataFrame, keys: list[str] = PATH) -> DataFrame:
    return with_steps(pings).groupBy(*keys).agg(F.sum("step").alias("length"))


def max_step(pings: DataFrame, keys: list[str]) -> DataFrame:
    return with_steps(pings).groupBy(*keys).agg(F.max("step").alias("max_step"))


def no_repeats(pings: DataFrame, keys: list[str]) -> DataFrame:
    """True where no two consecutive positions are equal."""
    same = (F.col("x") == F.col("prev_x")) & (F.col("y") == F.col("prev_y"))
    return with_steps(pings).groupBy(*keys).agg(F.bool_and(~F.coalesce(same, F.lit(False))).alias("no_repeats"))


def densify(features: DataFrame, distance: float) -> DataFrame:
    """max(1, int(len / d)) points per segment plus the last point; d <= 0 keeps the vertices."""
    idx = F.explode(F.sequence(F.lit(0), F.size("pts") - 1)).alias("seg")
    keep = [c for c in features.columns if c != "pts"]
    s = features.where(F.size("pts") > 0).select(*keep, "pts", idx)
    a, b = F.get("pts", F.col("seg")), F.get("pts", F.col("seg") + 1)
    s = s.select(*keep, "seg", a.alias("a"), b.alias("b"))
    length = dist(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
    n = F.greatest(F.lit(1), (length / distance).cast("int")) if distance > 0 else F.lit(1)
    s = s.withColumn("n", F.when(F.col("b").isNull(), F.lit(1)).otherwise(n))
    s = s.select(*keep, "seg", "a", "b", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    f = F.col("i") / F.col("n")
    at = lambda c: F.coalesce(F.col(f"a.{c}") + f * (F.col(f"b.{c}") - F.col(f"a.{c}")), F.col(f"a.{c}"))
    return s.select(*keep, "seg", "i", at("x").alias("x"), at("y").alias("y"))


def resample_path(pings: DataFrame, resolution: float, keys: list[str] = PATH) -> DataFrame:
    """ceil(len / resolution) + 1 points, evenly spaced by arc length; each segment emits its own samples (no range join)."""
    d = running_sums(with_steps(chunk(pings, "t"), keys), keys, "t", {"cum": F.col("step")})
    # the start of a segment is the running length of the row before it, read back so that both ends are the same number
    d = with_previous(d, keys, "t", ["cum"]).drop("_chunk").withColumn("_from", F.coalesce("prev_cum", F.lit(-1.0)))
    d = with_totals(d, keys, {"total": F.max("cum")}).where("total > 0")
    n = F.ceil(F.col("total") / resolution).cast("int")
    at = lambda i: F.col("total") * i / F.col("n")
    d = d.withColumn("n", n)
    lo = F.greatest(F.lit(0), F.floor(F.col("_from") / F.col("total") * F.col("n")).cast("int") - 1)
    hi = F.least(F.col("n"), F.ceil(F.col("cum") / F.col("total") * F.col("n")).cast("int") + 1)
    e = d.select("*", F.explode(F.sequence(lo, hi)).alias("i")).withColumn("s", at(F.col("i")))
    e = e.where((F.col("s") > F.col("_from")) & (F.col("s") <= F.col("cum")))
    f = F.when(F.col("step") > 0, (F.col("s") - F.col("prev_cum")) / F.col("step")).otherwise(0.0)
    pos = lambda c: F.when(F.col("step") > 0, F.col(f"prev_{c}") + f * (F.col(c) - F.col(f"prev_{c}"))).otherwise(F.col(c))
    return e.select(*keys, "i", F.col("s").alias("distance"), pos("x").alias("x"), pos("y").alias("y"))


def split_path(pings: DataFrame, n: int, exact: bool = True, keys: list[str] = PATH) -> DataFrame:
    """Cut each path into ``n`` parts by length.

    exact: sub-segments cut at k * total / n. Otherwise: boundaries at the nearest vertices, duplicates merged.
    """
    d = with_totals(with_distance(pings, keys), keys, {"total": F.max("cum")})
    if exact:
        seg = d.where((F.col("step") > 0) & (F.col("total") > 0)).withColumn("_from", F.col("cum") - F.col("step"))
        bound = lambda k: F.col("total") * k / n
        lo = F.greatest(F.lit(0), F.floor(F.col("_from") / F.col("total") * n).cast("int") - 1)
        hi = F.least(F.lit(n - 1), F.floor(F.col("cum") / F.col("total") * n).cast("int") + 1)
        s = seg.select("*", F.explode(F.sequence(lo, hi)).alias("part"))
        s = s.withColumns({"_a": F.greatest("_from", bound(F.col("part"))), "_b": F.least("cum", bound(F.col("part") + 1))})
        s = s.where("_b > _a")
        at = lambda q, c: F.col(f"prev_{c}") + (F.col(q) - F.col("_from")) / F.col("step") * (F.col(c) - F.col(f"prev_{c}"))
        return s.select(*keys, "part", "t", at("_a", "x").alias("x0"), at("_a", "y").alias("y0"), at("_b", "x").alias("x1"),
                        at("_b", "y").alias("y1"), (F.col("_b") - F.col("_a")).alias("length"))
    k = F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("k")
    cand = d.where("total > 0").select(*keys, "t", "cum", "total", k)
    gap = F.abs(F.col("cum") - F.col("total") * F.col("k") / n)
    cut = cand.groupBy(*keys, "k").agg(F.min_by("t", F.struct(gap, "t")).alias("b")).select(*keys, "b")
    ends = d.groupBy(*keys).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    ends = ends.select(*keys, F.explode(F.array("lo", "hi")).alias("b"))
    b = cut.unionByName(ends).distinct()
    w = Window.partitionBy(*keys).orderBy("b")  # at most n + 1 boundaries per path
    return b.select(*keys, (F.row_number().over(w) - 1).alias("part"), F.col("b").alias("start_t"), F.lead("b").over(w).alias("end_t")).where(
        "end_t IS NOT NULL")


def truncate_path(pings: DataFrame, max_length: float | None, keys: list[str] = PATH) -> DataFrame:
    """Prefix of at most ``max_length``; the last point is interpolated. No limit (or <= 0) keeps the path."""
    d = with_distance(pings, keys)
    if max_length is None or max_length <= 0:
        return d.select(*keys, "t", "x", "y", "cum")
    start = F.col("cum") - F.col("step")
    kept = d.where((F.col("cum") <= max_length) | ((start < max_length) & (F.col("step") > 0)))
    f = (F.lit(max_length) - start) / F.col("step")
    cut = F.col("cum") > max_length
    at = lambda c: F.when(cut, F.col(f"prev_{c}") + f * (F.col(c) - F.col(f"prev_{c}"))).otherwise(F.col(c))
    return kept.select(*keys, "t", at("x").alias("x"), at("y").alias("y"), F.least("cum", F.lit(float(max_length))).alias("cum"))


def trim_ends(pings: DataFrame, useful: Column, keys: list[str] = PATH) -> DataFrame:
    """Rows from the first to the last useful point, with the number of points removed on each side."""
    p = with_totals(pings.withColumn("_u", useful), keys, {"_first": F.min(F.when(F.col("_u"), F.col("t"))), "_last": F.max(F.when(F.col("_u"), F.col("t")))})
    cut = p.groupBy(*keys).agg(
        F.count_if(F.col("t") < F.col("_first")).alias("prefix_removed"), F.count_if(F.col("t") > F.col("_last")).alias("suffix_removed"))
    kept = p.where("t BETWEEN _first AND _last").select(*keys, "t", "x", "y")
    return on_keys(kept, cut, keys)


def has_unseen(waypoints: DataFrame, cells: DataFrame, observed: DataFrame, grid: GridSpec, radius: float, keys: list[str]) -> DataFrame:
    """Whether a waypoint's footprint holds a valid cell that was not observed."""
    fp = footprint(waypoints, grid, radius).select(*keys, "row", "col")
    live = cells.where("valid").select("row", "col").join(observed.select("row", "col").distinct(), ["row", "col"], "left_anti")
    hit = fp.join(live, ["row", "col"], "left_semi").select(*keys).distinct().withColumn("has_unseen", F.lit(True))
    out = on_keys(waypoints.select(*keys), hit, keys, "left")
    return out.select(*keys, F.coalesce("has_unseen", F.lit(False)).alias("has_unseen"))


def entry_cost(agents: DataFrame, tasks: DataFrame) -> DataFrame:
    """Distance from an agent to the nearer end of each of its run's tasks, with the orientation.

    ``tasks`` holds the few parts a run was split into, so the fan-out per agent is the split count.
    """
    j = agents.join(tasks, "run_id")
    f = dist(F.col("x0"), F.col("y0"), F.col("x"), F.col("y"))
    r = dist(F.col("x1"), F.col("y1"), F.col("x"), F.col("y"))
    return j.select("run_id", "agent_id", "task_id", F.least(f, r).alias("cost"), F.when(f <= r, "forward").otherwise("reverse").alias("orientation"))


# ---- shapes --------------------------------------------------------------------------------------------------------


def edges(pts: Column) -> Column:
    """Array of (a, b) point pairs of consecutive vertices."""
    return F.zip_with(F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))),
                      lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _fold(pts: Column, term) -> Column:
    return F.aggregate(edges(pts), F.lit(0.0), lambda acc, e: acc + term(e["a"], e["b"]))


def _cross(a, b):
    return a["x"] * b["y"] - b["x"] * a["y"]


def signed_area(pts: Column) -> Column:
    return _fold(pts, _cross) / 2


def line_length(pts: Column) -> Column:
    return _fold(pts, lambda a, b: dist(a["x"], a["y"], b["x"], b["y"]))


def polygon_centroid(pts: Column) -> tuple[Column, Column]:
    a6 = _fold(pts, _cross) * 3
    return (F.try_divide(_fold(pts, lambda a, b: (a["x"] + b["x"]) * _cross(a, b)), a6),
            F.try_divide(_fold(pts, lambda a, b: (a["y"] + b["y"]) * _cross(a, b)), a6))


def line_centroid(pts: Column) -> tuple[Column, Column]:
    n = line_length(pts)
    return (F.try_divide(_fold(pts, lambda a, b: (a["x"] + b["x"]) / 2 * dist(a["x"], a["y"], b["x"], b["y"])), n),
            F.try_divide(_fold(pts, lambda a, b: (a["y"] + b["y"]) / 2 * dist(a["x"], a["y"], b["x"], b["y"])), n))


def feature_weights(features: DataFrame, types: DataFrame, x: float, y: float, mu: Column, sigma: Column, buffer: float = 15.0) -> DataFrame:
    """Area (or buffered line area) x type weight x log-normal density at the centroid, summing to one."""
    pts = F.col("pts")
    poly, line = F.col("geom_type") == "Polygon", F.col("geom_type") == "LineString"
    area = F.when(poly, F.abs(signed_area(pts))).when(line, line_length(pts) * (2 * buffer) + math.pi * buffer * buffer).otherwise(0.0)
    px, py = polygon_centroid(pts)
    lx, ly = line_centroid(pts)
    f = features.withColumns({"area": area, "cx": F.when(poly, px).when(line, lx).otherwise(pts[0]["x"]),
                              "cy": F.when(poly, py).when(line, ly).otherwise(pts[0]["y"])})
    km = dist(F.col("cx"), F.col("cy"), F.lit(x), F.lit(y)) / 1000.0
    f = f.join(types, "feature_type").withColumn("_w", F.col("area") * F.col("weight") * lognormal_pdf(km, mu, sigma))
    t = with_totals(f, [], {"_s": F.sum("_w")})
    return t.withColumn("area_probability", F.when(F.col("_s") > 0, F.col("_w") / F.col("_s")).otherwise(0.0)).drop("_w", "_s", "weight")


def flatten_geometries(features: DataFrame) -> DataFrame:
    """Multi-part shapes (``parts``: array of point arrays) to single parts; empty parts dropped."""
    return features.select("feature_id", "feature_type", F.posexplode("parts").alias("part", "pts")).where(F.size("pts") > 0)


def rasterize(features: DataFrame, grid: GridSpec, sample_distance: float) -> DataFrame:
    """Cells touched per feature type: lines by sampled points, polygons by scanlines, points skipped, outside dropped.

    Polygons are filled on whole-cell vertices with the outline included; a column ``holes`` (array of point arrays) is left out of them.
    """
    lines = densify(features.where("geom_type = 'LineString'").select("feature_type", "pts"), sample_distance)
    r, c = to_cell(F.col("x"), F.col("y"), grid)
    line_cells = lines.select("feature_type", r.alias("row"), c.alias("col")).where(F.col("row").between(F.lit(0), grid.rows - 1) & F.col("col").between(F.lit(0), grid.cols - 1))
    rings = F.concat(F.array("pts"), F.coalesce("holes", F.array().cast(features.schema["holes"].dataType))) if "holes" in features.columns else F.array("pts")
    poly = features.where("geom_type = 'Polygon'").select("feature_id", "feature_type", rings.alias("rings"))
    poly_cells = fill_cells(poly, grid, ["feature_id", "feature_type"]).select("feature_type", "row", "col")
    return line_cells.unionByName(poly_cells).distinct().withColumn("mark", F.lit(1.0))


def clip_features(features: DataFrame, x: float, y: float, radius: float, sample_distance: float) -> DataFrame:
    """Sampled outline points inside a circle (an approximation of the exact clip that tightens with the sampling)."""
    d = densify(features, sample_distance)
    return d.where((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) <= radius * radius)


def radius_lookup(df: DataFrame) -> DataFrame:
    """Search radius by (env_type, climate, size) from the fixed table."""
    lookup = F.create_map(*[v for (e, c), km in RADIUS_KM.items() for s, r in zip(SIZES, km) for v in (F.lit(f"{e}|{c}|{s}"), F.lit(r))])
    return df.withColumn("radius_km", F.try_element_at(lookup, F.concat_ws("|", "env_type", "climate", "size")))


def fit_lognormal(quantiles: DataFrame, keys: list[str]) -> DataFrame:
    """Least squares of ln(value) on the normal score of its probability: mu, |sigma| and rmse per key."""
    q = quantiles.withColumns({"_y": F.log("value"), "_z": reduce(lambda acc, kv: acc.when(F.col("prob") == kv[0], F.lit(kv[1])), list(QUANTILE_Z.items())[1:],
                                                                F.when(F.col("prob") == 0.25, F.lit(QUANTILE_Z[0.25])))})
    return q.groupBy(*keys).agg(F.regr_intercept("_y", "_z").alias("mu"), F.abs(F.regr_slope("_y", "_z")).alias("sigma"),
                                F.sqrt((F.regr_syy("_y", "_z") - F.pow(F.regr_sxy("_y", "_z"), 2) / F.regr_sxx("_y", "_z")) / F.count("*")).alias("rmse"))


def weighted_sample(features: DataFrame, n: int, seed: int, order: str = "feature_no") -> DataFrame:
    """``n`` draws: feature type by total weight, then feature by weight, then a point at a random place on its outline.

    Draws meet the cumulative-weight intervals through equal-width buckets of [0, 1), an equi-join instead of a range join. There are as
    many buckets as features, and the last interval of a type ends at 1 whatever its sum rounds to, so every draw finds its feature.
    """
    spark = features.sparkSession
    types = features.groupBy("feature_type").agg(F.sum("area_probability").alias("tw"))
    tw = Window.orderBy("feature_type")  # one row per feature type: a short fixed list
    tt = types.withColumns({"hi": F.sum("tw").over(tw), "all": F.sum("tw").over(Window.partitionBy())})
    table = tt.agg(F.array_sort(F.collect_list(F.struct((F.col("hi") / F.col("all")).alias("hi"), "feature_type")))).scalar()
    draws = spark.range(n).select(F.col("id").alias("draw"), uniform(seed, F.col("id"), "type").alias("u1"), uniform(seed, F.col("id"), "feature").alias("u2"),
                                  uniform(seed, F.col("id"), "place").alias("u3")).withColumn("_t", table)
    last = F.element_at(F.col("_t"), -1)["feature_type"]
    draws = draws.select("draw", "u2", "u3", F.coalesce(F.get(F.filter("_t", lambda s: F.col("u1") < s["hi"]), 0)["feature_type"], last).alias("feature_type"))
    f = features.where("area_probability > 0").withColumn("_w", F.col("area_probability"))
    f = sums_below(with_few_totals(f, ["feature_type"], {"_end": F.max(order)}), ["feature_type"], order, ["_w"], totals=True)
    buckets = features.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    hi = F.when(F.col(order) == F.col("_end"), 1.0).otherwise((F.col("_w_below") + F.col("_w")) / F.col("_w_all"))
    f = f.withColumns({"lo": F.col("_w_below") / F.col("_w_all"), "hi": hi})
    f = f.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") * buckets), F.least(F.floor(F.col("hi") * buckets), buckets - 1))))
    j = draws.withColumn("bucket", F.floor(F.col("u2") * buckets)).join(f, ["feature_type", "bucket"]).where("u2 >= lo AND u2 < hi")
    seg = F.floor(F.col("u3") * (F.size("pts") - 1)).cast("int")
    frac = F.col("u3") * (F.size("pts") - 1) - seg
    a, b = F.get("pts", seg), F.get("pts", seg + 1)
    return j.select("draw", "feature_type", "feature_id", (a["x"] + frac * (b["x"] - a["x"])).alias("x"), (a["y"] + frac * (b["y"] - a["y"])).alias("y"))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to a segment (a zero-length segment is a point)."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    u = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - ax) * dx + (py - ay) * dy, n))), F.lit(0.0))
    return dist(px, py, ax + u * dx, ay + u * dy)


def _box_gap(p: str, lo: str, hi: str) -> Column:
    return F.greatest(F.col(lo) - F.col(f"{p}1"), F.col(f"{p}0") - F.col(hi), F.lit(0.0))


def _box_reach(p: str, lo: str, hi: str) -> Column:
    return F.greatest(F.abs(F.col(f"{p}1") - F.col(lo)), F.abs(F.col(hi) - F.col(f"{p}0")))


def _nearer(df: DataFrame, near: Column, far: Column, keep: list[str]) -> DataFrame:
    """Rows whose nearest place is no farther than the best guaranteed distance of their tile; a hair of slack covers rounding."""
    j = df.select(*keep, near.alias("_near"), far.alias("_far"))
    j = j.withColumn("_best", F.min("_far").over(Window.partitionBy("tx", "ty")))  # the boxes of one tile
    return j.where(F.col("_near") <= F.col("_best") * (1 + 1e-9) + 1e-9).select(*keep)


def nearest_feature(points: DataFrame, features: DataFrame, keys: list[str], bucket: float, extent: float) -> DataFrame:
    """Nearest feature (by its outline) per point, exact at any distance.

    Outline segments live in the bucket of their midpoint; buckets merge four to one into a pyramid of bounding boxes. Tiles of points, four
    buckets wide, walk down it: at each level a box survives only if its nearest place is no farther than the best distance that some box
    guarantees to all of the tile, and last the segments likewise. So what is sent grows with the tiles, not with the points; distinct
    points meet only the segments of their tile and keep the nearest as they go. ``extent`` (the width of the feature area) sets the
    number of levels.
    """
    e = features.select("feature_id", F.explode(edges(F.col("pts"))).alias("e")).select(
        "feature_id", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))
    segs = e.groupBy("ax", "ay", "bx", "by").agg(F.min("feature_id").alias("feature_id")).withColumns({
        "cx": F.floor((F.col("ax") + F.col("bx")) / (2 * bucket)), "cy": F.floor((F.col("ay") + F.col("by")) / (2 * bucket))})
    box = [F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ay", "by")).alias("y1")]
    merge = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]
    up = lambda c: F.floor(F.col(c) / 2)
    levels = [segs.groupBy("cx", "cy").agg(*box)]
    for _ in range(max(1, math.ceil(math.log2(extent / bucket)))):
        levels.append(levels[-1].groupBy(up("cx").alias("cx"), up("cy").alias("cy")).agg(*merge))
    top = levels[-1].agg(F.collect_list(F.struct("cx", "cy"))).scalar()  # a handful of boxes around the extent
    width = 4 * bucket
    at = points.select("x", "y").distinct().withColumns({"tx": F.floor(F.col("x") / width), "ty": F.floor(F.col("y") / width)})
    tiles = at.groupBy("tx", "ty").agg(F.min("x").alias("px0"), F.max("x").alias("px1"), F.min("y").alias("py0"), F.max("y").alias("py1"))
    own = tiles.columns
    cand = tiles.withColumn("_n", F.explode(top)).select(*own, F.col("_n.cx").alias("px"), F.col("_n.cy").alias("py"))
    gx, gy, rx, ry = _box_gap("px", "x0", "x1"), _box_gap("py", "y0", "y1"), _box_reach("px", "x0", "x1"), _box_reach("py", "y0", "y1")
    for level in reversed(levels[:-1]):
        j = cand.join(level.withColumns({"px": up("cx"), "py": up("cy")}), ["px", "py"])
        j = _nearer(j, F.sqrt(gx * gx + gy * gy), F.sqrt(rx * rx + ry * ry), [*own, "cx", "cy"])
        cand = j.withColumnsRenamed({"cx": "px", "cy": "py"})
    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    j = cand.join(segs.withColumnsRenamed({"cx": "px", "cy": "py"}), ["px", "py"]).withColumns({
        "x0": F.least("ax", "bx"), "x1": F.greatest("ax", "bx"), "y0": F.least("ay", "by"), "y1": F.greatest("ay", "by")})
    # the distance to a segment is convex: over a tile it is largest at a corner
    far = F.greatest(*[segment_distance(F.col(x), F.col(y), *ends) for x in ("px0", "px1") for y in ("py0", "py1")])
    j = _nearer(j, F.sqrt(gx * gx + gy * gy), far, ["tx", "ty", "feature_id", "ax", "ay", "bx", "by"])
    j = at.join(j, ["tx", "ty"]).withColumn("_d", segment_distance(F.col("x"), F.col("y"), *ends))
    best = j.groupBy("tx", "ty", "x", "y").agg(F.min("_d").alias("_d"), F.min_by("feature_id", F.struct("_d", "feature_id")).alias("feature_id"))
    best = best.select("x", "y", "feature_id", F.col("_d").alias("distance"))
    return points.select(*keys, "x", "y").join(best, ["x", "y"]).select(*keys, "feature_id", "distance")
