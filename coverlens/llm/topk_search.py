"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments. Its segment means m and deviations s bound the squared distance of two vectors from below by the sum of
length * ((m - m')^2 + (s - s')^2), and so, as 2 q.v = |q|^2 + |v|^2 - d^2, their product from above by the sum of length * (m m' + s s').
Vectors are dealt to blocks by a hash. Every round compares all blocks of queries with three times as many new blocks of candidates as
the rounds before: the k-th best score so far drops pairs by coarse segments, then by finer ones, and what is left is multiplied
exactly. As a hash deals the blocks, about 3 k candidates of a query outlive a round, whatever the size of the table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import checkpointed
from coverlens.llm.whole_vectors import whole_vectors

SCALE = 64
TOP = 20
EVERY = 20
BLOCK = 4096
QUERY_BLOCK = 512
#: Query blocks that share one copy of a candidate block.
GATHER = 16
#: Segments of a vector, coarse to fine.
LEVELS = (4, 8, 16)
#: Components beyond this count as this.
LIMIT = float(2**62)
SLACK = 1e-9
LOW, HIGH = -(2**63), 2**63 - 1
#: Blocks compared after a round for each compared before it.
GROWTH = 4
BLOCKED = "block long, dim int, ids binary, rows binary, vecs binary"
#: Entries of the best candidates so far: number of the query in its block, score, id and row of the candidate.
ENTRIES = ("q", "scores", "found", "found_rows")
STATE = "block long, dim int, least binary, " + ", ".join(f"{c} binary" for c in ENTRIES)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(length) * mean and sqrt(length) * deviation of every segment: the product of two such rows bounds that of the vectors."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    parts = [x[:, a:b] for a, b in zip(cuts, cuts[1:])]
    means = [p.mean(1) * np.sqrt(p.shape[1]) for p in parts]
    spreads = [np.sqrt(((p - p.mean(1, keepdims=True)) ** 2).sum(1)) for p in parts]
    return np.stack(means + spreads, 1) if parts else np.zeros((len(x), 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of whole-numbered rows, beyond 64 bits brought to the ends of a long."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [[int(v) for v in r] for r in b]
    return np.array([[min(HIGH, max(LOW, sum(int(v) * w for v, w in zip(r, o)))) for o in whole] for r in a], np.int64).reshape(len(a), len(b))


def survivors(q: np.ndarray, v: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows of q and of v that hold every pair whose product reaches the query's least score."""
    qs, vs = np.arange(len(q)), np.arange(len(v))
    if not np.isfinite(least).any():
        return qs, vs
    room = SLACK * (np.sqrt((q**2).sum(1))[:, None] * np.sqrt((v**2).sum(1)) + 1)
    alive = np.ones((len(q), len(v)), bool)
    for level in LEVELS:
        bound = statistics(q[qs], level) @ statistics(v[vs], level).T + room[np.ix_(qs, vs)]
        alive[np.ix_(qs, vs)] &= bound >= least[qs, None]
        left = alive[np.ix_(qs, vs)]
        qs, vs = qs[left.any(1)], vs[left.any(0)]
        if not len(qs) or level >= q.shape[1]:
            break
    return qs, vs


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries of each group, in the order group, score descending, id, row."""
    order = np.lexsort((rows, ids, ~score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


def longs(data: bytes | None) -> np.ndarray:
    return np.frombuffer(data or b"", np.int64)


def table_of(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([r[name] for r in rows], kinds[kind]) for name, kind in fields], [name for name, _ in fields])


def pack(key: tuple, rows: pa.Table) -> pa.Table:
    """The vectors of a block in one row per length, in the order of their ids."""
    out = []
    for dim in rows["dim"].unique().to_pylist():
        part = rows.filter(pc.equal(rows["dim"], dim)).sort_by([("id", "ascending"), ("row", "ascending")])
        ids, at = (np.array(part[c], np.int64).tobytes() for c in ("id", "row"))
        out.append({"block": key[0].as_py(), "dim": dim, "ids": ids, "rows": at, "vecs": b"".join(part["vec"].to_pylist())})
    return table_of(out, BLOCKED)


def tile(one: dict, other: dict, k: int) -> dict | None:
    """What one candidate block may add to the best of one query block: at most k entries per query."""
    own, ids, rows = longs(one["rows"]), longs(other["ids"]), longs(other["rows"])
    q, v = (np.frombuffer(b["vecs"], np.float64).reshape(n, one["dim"]) for b, n in ((one, len(own)), (other, len(ids))))
    least, last = longs(one["least"]).reshape(2, -1) if one["least"] else np.repeat([[LOW], [HIGH]], len(own), 1)
    qs, vs = survivors(q, v, np.where(least == LOW, -np.inf, least.astype(np.float64)))
    if not len(qs) or not len(vs):
        return None
    score = products(q[qs], v[vs])
    keep = (score > least[qs, None]) | ((score == least[qs, None]) & (ids[vs] <= last[qs, None]))
    keep &= own[qs, None] != rows[vs]
    if keep.sum() > 4 * k * len(qs):  # many: only what reaches the k-th score of the block, of equal scores the first k
        masked = np.where(keep, score, LOW)
        kth = np.partition(masked, -k, axis=1)[:, -k, None]
        equal = keep & (masked == kth)
        keep &= (masked > kth) | (equal & (np.cumsum(equal, 1) <= k))
    i, j = np.nonzero(keep)
    at = best(i, score[i, j], ids[vs[j]], rows[vs[j]], k)
    i, j = i[at], j[at]
    return dict(zip(ENTRIES, (qs[i].tobytes(), score[i, j].tobytes(), ids[vs[j]].tobytes(), rows[vs[j]].tobytes()))) if len(i) else None


def compare(k: int):
    """Function of some query blocks and one candidate block."""

    def run(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        others = {c["dim"]: c for c in candidates.to_pylist()}
        tiles = ((one, tile(one, others[one["dim"]], k)) for one in queries.to_pylist() if one["dim"] in others)
        return table_of([{"block": one["block"], "dim": one["dim"], "least": None} | found for one, found in tiles if found], STATE)

    return run


def merge(k: int):
    """Function of all entries of one query block: the k best of each query; least holds the k-th score and its id, if there are k."""

    def run(key: tuple, parts: pa.Table) -> pa.Table:
        q, score, ids, rows = (np.concatenate([longs(p) for p in parts[c].to_pylist()]) for c in ENTRIES)
        at = best(q, score, ids, rows, k)
        q, score, ids, rows = q[at], score[at], ids[at], rows[at]
        n = max(len(longs(p)) for p in parts["own"].to_pylist())
        ends = np.searchsorted(q, np.arange(n), side="right")
        full = np.bincount(q, minlength=n) >= k
        least = np.array([np.where(full, score[ends - 1], LOW), np.where(full, ids[ends - 1], HIGH)]) if len(q) else np.repeat([[LOW], [HIGH]], n, 1)
        found = dict(zip(ENTRIES, (q.tobytes(), score.tobytes(), ids.tobytes(), rows.tobytes())))
        return table_of([{"block": key[0].as_py(), "dim": key[1].as_py(), "least": least.astype(np.int64).tobytes()} | found], STATE)

    return run


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For every row whose id is divisible by `every` the k other rows of the highest integer inner product with it: query_id, rank, id, score.

    Components are floor(64 * x). Vectors that are null or hold null or non-finite components and rows without id take no part; vectors of
    different lengths do not meet. Ties go to the smaller id. A repeated row is another row: a query and a candidate of its own. A query
    with fewer than k candidates returns them all. Scores beyond 64 bits count as the ends of a long. Other columns are not read. An
    empty table gives an empty result."""
    rows = whole_vectors(vectors.where(F.col(id_col).isNotNull()), id_col, vec_col, SCALE, LIMIT).withColumn("id", F.col("id").cast("long"))
    rows = checkpointed(rows)
    asks = F.pmod("id", F.lit(every)) == 0
    n, n_queries = rows.agg(F.count("*"), F.count_if(asks)).first()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))

    def packed(part: DataFrame, count: int) -> DataFrame:
        return checkpointed(part.groupBy(F.pmod(F.xxhash64("row"), F.lit(count)).alias("block")).applyInArrow(pack, BLOCKED))

    candidates, queries = packed(rows, blocks), packed(rows.where(asks), query_blocks)
    own = queries.select("block", "dim", F.lit(None).cast("binary").alias("least"), *[F.lit(b"").alias(c) for c in ENTRIES], F.col("rows").alias("own"))
    state, seen = None, 0
    while seen < blocks:
        upto = min(blocks, max(1, seen * GROWTH))
        asking = queries.withColumn("least", F.lit(None).cast("binary")) if state is None else queries.join(state.select("block", "dim", "least"), ["block", "dim"])
        asking = asking.withColumn("gather", F.floor(F.col("block") / GATHER)).withColumn("other", F.explode(F.sequence(F.lit(seen), F.lit(upto - 1)))).repartition("gather", "other")
        met = candidates.where(F.col("block").between(seen, upto - 1)).withColumn("gather", F.explode(F.sequence(F.lit(0), F.lit((query_blocks - 1) // GATHER))))
        met = met.select("dim", "ids", "rows", "vecs", F.col("gather").cast("long").alias("gather"), F.col("block").cast("int").alias("other"))
        found = asking.groupBy("gather", "other").cogroup(met.groupBy("gather", "other")).applyInArrow(compare(k), STATE).withColumn("own", F.lit(None).cast("binary"))
        before = own if state is None else state.withColumn("own", F.lit(None).cast("binary")).union(own)
        state = checkpointed(before.union(found).groupBy("block", "dim").applyInArrow(merge(k), STATE))
        seen = upto

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, score, ids = (longs(r[c]) for c in ("q", "scores", "found"))
                asked = longs(r["ids"])[q]
                rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(rank.astype(np.int32)), pa.array(ids), pa.array(score)], ["query_id", "rank", "id", "score"])

    out = state.join(queries.select("block", "dim", "ids"), ["block", "dim"]).select("q", "scores", "found", "ids").mapInArrow(unpack, "query_id long, rank int, id long, score long")
    return out.withColumnRenamed("id", id_col)


def twin_sql(k: int = TOP, every: int = EVERY) -> str:
    """DuckDB SQL of the same rows, by multiplying every query with every vector."""
    return (
        "WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),"
        " pairs AS (SELECT q.row, q.vec_id AS query_id, v.vec_id, list_dot_product(q.v, v.v)::BIGINT AS score, v.row AS other FROM v q JOIN v ON v.row <> q.row AND len(v.v) = len(q.v)"
        f" WHERE q.vec_id % {every} = 0)"
        " SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id, other)::INTEGER AS rank, vec_id, score FROM pairs"
        f" QUALIFY rank <= {k}"
    )
