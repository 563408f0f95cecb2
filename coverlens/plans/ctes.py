"""SQL text shared by the DuckDB twins: the driver tables as pings, cells and runs."""

E0 = """
e0 AS (SELECT event_type AS run_id, CAST(user_id AS INT) AS agent_id,
    CAST(floor((epoch_us(ts) / 1000000.0 - 1704067200) / 3600) AS INT) AS t, event_id,
    CAST(CAST(json_extract_string(props, '$.k') AS INT) % 64 AS DOUBLE) AS x, value AS y, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""

# every event is a ping: the n-th event of a user within a step belongs to the user's n-th agent
PING = E0 + """,
ping AS (SELECT run_id, (row_number() OVER (PARTITION BY run_id, agent_id, t ORDER BY event_id) - 1) * 4294967296 + agent_id AS agent_id, t, x, y FROM e0)"""

# streams: every event is a ping of its user; positions of a step follow each other by time and event
STREAM_PING = E0 + """,
ping AS (SELECT run_id, agent_id, t, x, y, event_id, ts FROM e0 JOIN events USING (event_id))"""
STREAM_STEP = """
st0 AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, t - lag(t) OVER w AS dt FROM ping WINDOW w AS (PARTITION BY run_id, agent_id ORDER BY ts, event_id)),
st AS (SELECT *, coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0.0) AS step FROM st0)"""

CELL = """
w0 AS (SELECT 'g0' AS grid_id, CAST(vec_id AS INT) AS "row", CAST(i - 1 AS INT) AS col, CAST(embedding[i] AS DOUBLE) AS e
    FROM embeddings, range(1, 65) r(i)),
w AS (SELECT grid_id, "row", col, CAST(floor(abs(e) * 1e6) AS BIGINT) AS w, e > -0.2 AS valid FROM w0),
cell AS (SELECT grid_id, "row", col, w / (SELECT sum(w) FROM w) AS p, valid FROM w)"""

# footprint of radius 1.5 on unit cells
FOOT = """
spec AS (SELECT CAST(max(vec_id) + 1 AS INT) AS n_rows, 64 AS n_cols FROM embeddings),
foot AS (SELECT p.*, CAST(trunc(p.y) AS INT) + dr AS "row", CAST(trunc(p.x) AS INT) + dc AS col
    FROM ping p, range(-2, 3) a(dr), range(-2, 3) b(dc), spec
    WHERE CAST(trunc(p.y) AS INT) + dr >= 0 AND CAST(trunc(p.y) AS INT) + dr < n_rows
      AND CAST(trunc(p.x) AS INT) + dc >= 0 AND CAST(trunc(p.x) AS INT) + dc < n_cols
      AND sqrt((CAST(trunc(p.x) AS INT) + dc + 0.5 - p.x) * (CAST(trunc(p.x) AS INT) + dc + 0.5 - p.x)
             + (CAST(trunc(p.y) AS INT) + dr + 0.5 - p.y) * (CAST(trunc(p.y) AS INT) + dr + 0.5 - p.y)) <= 1.5)"""

CNT = """
cnt AS (SELECT run_id, "row", col, count(*) AS n FROM foot GROUP BY ALL)"""

STEP = """
st0 AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM ping WINDOW w AS (PARTITION BY run_id, agent_id ORDER BY t)),
st AS (SELECT *, coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0.0) AS step FROM st0),
cum AS (SELECT *, sum(step) OVER (PARTITION BY run_id, agent_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS cum FROM st)"""


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + " " + select


def runs(level: bool = False) -> str:
    k = "k, " if level else ""
    return f"""
b0 AS (SELECT CAST(s_nationkey AS INT) AS dataset, CAST(l_suppkey AS INT) AS planning_seed, CAST(l_linenumber - 1 AS INT) AS k,
    l_returnflag AS planning_mode, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(l_quantity AS BIGINT) AS q,
    CAST(round(l_tax * 100) AS BIGINT) AS x, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, l_linenumber, l_linestatus
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
runs AS (SELECT dataset, planning_seed, {k}planning_mode, sum(d) / (count(*) * 10.0) AS "P_detect", sum(q) / count(*) AS "RMST",
    sum(x) / (count(*) * 8.0) AS "L", CAST(max(q) AS INT) AS "T", 50 AS "T_common", 51 AS "H_common",
    sum(c) / 100.0 AS actual_distance_total, max(c) / 100.0 AS max_step_distance, CAST(count(*) AS INT) AS number_of_replans,
    count(*) FILTER (l_linestatus = 'O') / count(*) AS revisit_fraction, count(*) / count(DISTINCT l_linenumber) AS exposure_multiplicity,
    sum(q) / 1000.0 AS planner_wall_time, md5(CAST(planning_seed AS VARCHAR)) AS initial_positions_hash
    FROM b0 GROUP BY dataset, planning_seed, {k}planning_mode)"""


# ---- Student t in SQL: closed finite sums for whole degrees of freedom, independent of the engine's own routine -------------


def t_sf(t: str, nu: str) -> str:
    c = f"({nu} / ({nu} + ({t}) * ({t})))"
    sin = f"(({t}) / sqrt({nu} + ({t}) * ({t})))"
    even = f"{sin} * coalesce(list_sum(list_transform(range(0, CAST({nu} // 2 AS BIGINT)), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow({c}, j))), 0)"
    odd = (f"2 / pi() * (atan(({t}) / sqrt({nu})) + {sin} * sqrt({c}) * coalesce(list_sum(list_transform(range(0, CAST(({nu} - 1) // 2 AS BIGINT)), "
           f"lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow({c}, j))), 0))")
    return f"((1 - (CASE WHEN {nu} % 2 = 0 THEN {even} ELSE {odd} END)) / 2)"


def t_quantile(name: str, degrees: str, p: float) -> str:
    """CTE name(nu, q): quantile by bisection for every degree of freedom in ``degrees``."""
    mid = "((a.lo + a.hi) / 2)"
    return f"""
{name} AS (SELECT nu, list_reduce(list_transform(range(0, 100), lambda i: {{'lo': 0.0::DOUBLE, 'hi': 1000.0::DOUBLE}}),
    lambda a, b: CASE WHEN {t_sf(mid, 'nu')} > {1 - p!r} THEN {{'lo': {mid}, 'hi': a.hi}} ELSE {{'lo': a.lo, 'hi': {mid}}} END).lo AS q
    FROM (SELECT DISTINCT CAST(n - 1 AS BIGINT) AS nu FROM {degrees} WHERE n >= 2))"""


def endpoint_state(x: str, margin: float) -> str:
    return (f"CASE WHEN {x}_mean >= {margin} AND {x}_ci_lo > 0 THEN 'IMPROVED' WHEN {x}_mean <= -{margin} AND {x}_ci_hi < 0 THEN 'WORSENED' "
            f"WHEN {x}_equivalent THEN 'EQUIVALENT' ELSE 'INCONCLUSIVE' END")


JOINT = """CASE WHEN "dPdet_state" = 'WORSENED' OR "dRMST_rel_state" = 'WORSENED' THEN 'WORSENING' WHEN "dPdet_state" = 'IMPROVED' OR "dRMST_rel_state" = 'IMPROVED' THEN 'IMPROVEMENT'
    WHEN "dPdet_state" = 'EQUIVALENT' AND "dRMST_rel_state" = 'EQUIVALENT' THEN 'EQUIVALENT' ELSE 'INCONCLUSIVE' END"""


def summary(src: str, by: str, name: str = "sm", m1: float = 0.01, m2: float = 0.02) -> str:
    """CTEs ending in ``name``: the summary table of a contrast CTE."""
    def cols(x):
        return (f'avg("{x}") AS "{x}_mean", stddev_samp("{x}") AS "{x}_sd", count(*) FILTER ("{x}" > 0) AS "{x}_favorable_count", '
                f'count(*) FILTER ("{x}" >= 0) AS "{x}_non_adverse_count"')

    def ci(x, m):
        se = f'"{x}_sd" / sqrt(n)'
        lo = t_sf(f'(("{x}_mean" + {m}) / ({se}))', "nu")
        hi = t_sf(f'(-("{x}_mean" - {m}) / ({se}))', "nu")
        return (f'{se} AS "{x}_se", "{x}_mean" - q * {se} AS "{x}_ci_lo", "{x}_mean" + q * {se} AS "{x}_ci_hi", {lo} AS "{x}_tost_p_lower", {hi} AS "{x}_tost_p_upper"')

    eq = lambda x: f'coalesce("{x}_tost_p_lower" < 0.05 AND "{x}_tost_p_upper" < 0.05, false) AS "{x}_equivalent", greatest("{x}_tost_p_lower", "{x}_tost_p_upper") AS "{x}_tost_p_max"'
    a, b = "dPdet", "dRMST_rel"
    return f"""
{name}_m AS (SELECT {by}, count(*) AS n, {cols(a)}, {cols(b)} FROM {src} GROUP BY {by}),{t_quantile(name + '_tq', name + '_m', 0.975)},
{name}_c AS (SELECT m.*, nu, {ci(a, m1)}, {ci(b, m2)} FROM {name}_m m LEFT JOIN {name}_tq ON nu = n - 1),
{name}_e AS (SELECT *, {eq(a)}, {eq(b)} FROM {name}_c),
{name}_s AS (SELECT *, {endpoint_state('"dPdet"', m1).replace('"dPdet"_', 'dPdet_')} AS "dPdet_state", {endpoint_state('"dRMST_rel"', m2).replace('"dRMST_rel"_', 'dRMST_rel_')} AS "dRMST_rel_state" FROM {name}_e),
{name} AS (SELECT *, {JOINT} AS state FROM {name}_s)"""


def contrasts(name: str = "con", src: str = "runs", keys: str = "dataset, planning_seed", control: str = "A", method: str = "R") -> str:
    return f"""
{name} AS (SELECT {keys}, r."P_detect" - a."P_detect" AS "dPdet", (a."RMST" - r."RMST") / 51.0 AS "dRMST_rel", r."L" - a."L" AS "dL"
    FROM (SELECT * FROM {src} WHERE planning_mode = '{control}') a JOIN (SELECT * FROM {src} WHERE planning_mode = '{method}') r USING ({keys}))"""
