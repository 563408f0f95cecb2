"""Centroid clustering by PCA-rotated filtering, exact in whole numbers.

Vectors are turned once into the axes of their covariance, largest first; kept are the leading coordinates and the norm of the rest. The
squared distance of the leading coordinates plus the squared difference of the rest norms is a lower bound of the squared distance to a
centroid. A vector measures the centroid of the least bound exactly and then only centroids whose bound does not exceed that distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import checkpointed
from coverlens.llm.whole_vectors import stacked, whole_vectors

DIM = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
LEAD = 16
#: Components beyond this count as this: squared distances of 64 components then fit 64 bits.
LIMIT = float(2**27)
SLACK = 1e-9
MOST = 2**63 - 1


def moments(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance axes of all vectors, largest first; sums of dim x (dim + 1) numbers per task are added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            x = np.hstack([stacked(batch.column(0).to_pylist(), dim), np.ones((batch.num_rows, 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    cells = rows.select("vec").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    m = np.zeros((dim + 1, dim + 1))
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        m[r["i"], r["j"]] = r["v"]
    n = max(m[dim, dim], 1.0)
    mean = m[dim, :dim] / n
    spread = m[:dim, :dim] / n - np.outer(mean, mean)
    return mean, np.linalg.eigh((spread + spread.T) / 2)[1][:, ::-1].copy()


def rotated(x: np.ndarray, mean: np.ndarray, turn: np.ndarray, lead: int) -> np.ndarray:
    """Leading rotated coordinates and the norm of the others as last column."""
    y = (x - mean) @ turn
    return np.hstack([y[:, :lead], np.sqrt((y[:, lead:] ** 2).sum(1, keepdims=True))])


def nearest(x: np.ndarray, short: np.ndarray, centroids: np.ndarray, short_c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every row of x; ties to the smaller number."""
    x, centroids = x.astype(np.int64), centroids.astype(np.int64)
    # both matrices end with the rest norm, so one squared distance of them is the whole bound
    a, c = (short**2).sum(1)[:, None], (short_c**2).sum(1)
    bound = a + c - 2 * short @ short_c.T
    bound -= SLACK * (a + c + 1)
    guess = bound.argmin(1)
    best = ((x - centroids[guess]) ** 2).sum(1)
    exact = np.full(bound.shape, MOST)
    exact[np.arange(len(x)), guess] = best
    i, k = np.nonzero(bound <= best[:, None])
    other = k != guess[i]
    i, k = i[other], k[other]
    exact[i, k] = ((x[i] - centroids[k]) ** 2).sum(1)
    cluster = exact.argmin(1)
    return cluster, exact[np.arange(len(x)), cluster]


def capped(total) -> int:
    return min(int(total or 0), MOST)


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, lead: int = LEAD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly `dim` components, none null or non-finite, as whole numbers floor(64 * x) brought to +-2^27. The first
    centroids are the k kept vectors with the smallest sha256 of "1:<id>", all of them if there are fewer; a row without id is assigned,
    but starts no centroid. Repeated rows are vectors of their own. An inertia beyond 64 bits counts as the largest long. Other columns
    are not read. No kept vector, or none with an id, gives an empty result. k x (dim + 1) sums per round reach the driver."""
    spark, id_type = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    lead = min(lead, dim)
    rows = checkpointed(whole_vectors(vectors, id_col, vec_col, SCALE, LIMIT, dim).select("id", "vec"))
    mean, turn = moments(rows, dim)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = rotated(stacked(batch.column(1).to_pylist(), dim), mean, turn, lead)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s.tobytes() for s in short], pa.binary())], ["id", "vec", "short"])

    rows = checkpointed(rows.mapInArrow(shorten, f"id {id_type}, vec binary, short binary"))
    hashed = rows.where("id IS NOT NULL").select("id", "vec", F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256).alias("hash"))
    first = hashed.orderBy("hash", "id", "vec").limit(k).collect()
    if not first:
        return rows.limit(0).select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    centroids = stacked([r["vec"] for r in first], dim)

    def assigned(batch: pa.RecordBatch, centers: np.ndarray, short_c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = stacked(batch.column("vec").to_pylist(), dim)
        return x, *nearest(x, stacked(batch.column("short").to_pylist(), lead + 1), centers, short_c)

    for _ in range(rounds):
        short_c = rotated(centroids, mean, turn, lead)

        def sums(batches: Iterator[pa.RecordBatch], centers=centroids, short_c=short_c) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(centers), dim + 1), np.int64)
            for batch in batches:
                x, cluster, _ = assigned(batch, centers, short_c)
                np.add.at(total, cluster, np.hstack([x.astype(np.int64), np.ones((len(x), 1), np.int64)]))
            c, i = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(total[c, i])], ["c", "i", "v"])

        found = rows.select("vec", "short").mapInArrow(sums, "c int, i int, v long").groupBy("c", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        total = {(r["c"], r["i"]): int(r["v"]) for r in found.collect()}
        centroids = np.array([[total.get((c, i), 0) // total[c, dim] for i in range(dim)] if (c, dim) in total else old for c, old in enumerate(centroids)], np.float64)
    short_c = rotated(centroids, mean, turn, lead)

    def assign(batches: Iterator[pa.RecordBatch], centers=centroids, short_c=short_c) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cluster, distance = assigned(batch, centers, short_c)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    out = checkpointed(rows.mapInArrow(assign, f"id {id_type}, cluster int, distance long"))
    inertia = {r["cluster"]: int(r["v"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("v")).collect()}
    digests = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    whole = capped(sum(inertia.values()))
    facts = spark.createDataFrame([(c, capped(v), whole, digests[c]) for c, v in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows at most
    return out.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def twin_sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of the same rows, by comparing every vector with every centroid."""
    ctes = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT row, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM kept)",
        "starts AS (SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id), vec_id) - 1 AS c FROM kept)",
        f"c0 AS MATERIALIZED (SELECT c, i, x FROM starts JOIN parts USING (row) WHERE c < {k})",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"a{r} AS MATERIALIZED (SELECT row, min_by(c, d * {k} + c) AS c, min(d)::BIGINT AS d FROM (SELECT p.row, c.c, sum((p.x - c.x) * (p.x - c.x)) AS d"
            f" FROM parts p JOIN c{r} c USING (i) GROUP BY p.row, c.c) GROUP BY row)"
        )
        if r < rounds:
            # floor division: the remainder of a negative sum is brought above 0
            ctes.append(
                f"c{r + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(n.x, o.x) AS x FROM c{r} o LEFT JOIN (SELECT c, i, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS x"
                f" FROM a{r} JOIN parts USING (row) GROUP BY c, i) n USING (c, i))"
            )
    ctes.append(f"digests AS (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return (
        f"WITH {', '.join(ctes)} SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256"
        f" FROM a{rounds} JOIN kept USING (row) JOIN digests USING (c)"
    )
