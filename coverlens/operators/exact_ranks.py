"""Exact rank distributions by their characteristic functions.

A rank sum over all signs, or over all choices of the smaller arm, is a whole number between 0 and some N - 1, once ranks are doubled (mid-ranks
are whole then), moved to start at 0 and divided by their common divisor. Its distribution is known from its characteristic function at
the N-th roots of unity, and a tail is one weighted sum over them. The roots are independent of each other: they are dealt to tasks in blocks, so no task holds a
distribution. A task holds its block and the distinct ranks of its group. Tails are right to about 1e-14, whatever the sizes; the work is
N times the group's distinct ranks.

Two samples need fewer roots. Sums so far from the mean that their chance is below TINY may fold onto the others, so the roots span that reach
instead of N. The Fourier transform of a group's ranks bounds the mean over all choices at every root of a block; where it is below TINY the
root adds nothing, and a few dozen are left of a large group without ties. There a mean over the choices is one coefficient of a product over
the elements, read off a circle whose points span the reach of a binomial count; small arms go element by element.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.operators.scan import on_keys

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROOTS = 1 << 15
CELLS = 1 << 20
#: A product of factors of at most 1 that has come below this adds nothing to a sum in double precision.
NOTHING = 1e-30
#: Chances and means below this are left out of a sum over roots.
TINY = 1e-20


def _tail(k: np.ndarray, n: int, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(weight, half angle): the sum of weight * Re(phi * exp(-i * half angle)) over the roots ``k``, all of them from 0 to n // 2, is the
    chance of a value of at most ``at``. The other roots are conjugates of these."""
    sin = np.sin(np.pi * k / n)
    w = np.where(k == 0, at + 1.0, np.sin(np.pi * ((k * (at + 1)) % (2 * n)) / n) / np.where(k == 0, 1.0, sin))
    return w * np.where((k == 0) | (2 * k == n), 1.0, 2.0) / n, np.pi * ((k * at) % (2 * n)) / n


def signed_tail(r: np.ndarray, c: np.ndarray, at: int, n: int, first: int, last: int) -> float:
    """Share of the roots in the chance that the sum over random signs (0 or r, each rank c times) is at most ``at``."""
    if at < 0:
        return 0.0
    k = np.arange(first, last, dtype=np.int64)
    w, half = _tail(k, n, at)
    phi = np.ones(len(k))
    for x, m in sorted(zip(r.tolist(), c.tolist()), reverse=True):
        phi *= np.cos(np.pi * ((k * x) % (2 * n)) / n) ** m
        if abs(phi).max() < NOTHING:
            return 0.0
    return float((w * phi * np.cos(np.pi * ((k * (n - 1)) % (2 * n)) / n - half)).sum())


def choice_roots(r: np.ndarray, most: int) -> int:
    """Number of roots for the sum of ``most`` elements chosen at random from ranks 0 .. max(r): all sums, or twice the distance from the
    mean that a sum exceeds with a chance below TINY (Hoeffding); a whole number of blocks if there are several."""
    n = min(most * int(r.max()) + 1, 2 * math.ceil(int(r.max()) * math.sqrt(most * math.log(2 / TINY) / 2)) + 1)
    return n if n <= ROOTS else -(-n // ROOTS) * ROOTS


def _left(r: np.ndarray, c: np.ndarray, most: int, n: int, block: int) -> np.ndarray:
    """Roots ``block``, ``block`` + n / ROOTS, ... up to n // 2, without those where the mean over the choices is below TINY.

    The mean is the coefficient of y ** most in the product of 1 + y * exp(i * angle * rank), over the number of choices. Any circle |y| = u
    bounds it; on the circle the sum of exp(i * angle * rank) bounds the product, by |1 + u * exp(i a)| <= sqrt(1 + u * u) * exp(u / (1 + u * u) * cos a)
    and, better near angle 0, by (1 + u) * exp(-u / (1 + u) ** 2 * (1 - cos a))."""
    size, far = int(c.sum()), max(1, n // ROOTS)
    turn, fold = c * np.exp(2j * np.pi * ((r * block) % n) / n), r % (n // far)
    sums = abs(np.fft.ifft(np.bincount(fold, turn.real, n // far) + 1j * np.bincount(fold, turn.imag, n // far), norm="forward"))
    choices = math.lgamma(size + 1) - math.lgamma(most + 1) - math.lgamma(size - most + 1)
    bound = np.zeros(len(sums))
    for u in np.geomspace(most / (size - most), 1.0, 24) if most else ():
        far_off = size / 2 * math.log1p(u * u) + u / (1 + u * u) * sums
        near = size * math.log1p(u) - u / (1 + u) ** 2 * (size - sums)
        bound = np.minimum(bound, np.minimum(far_off, near) - most * math.log(u) - choices)
    k = block + far * np.arange(len(sums), dtype=np.int64)
    return k[(k <= n // 2) & (bound > math.log(TINY))]


def _by_elements(r: np.ndarray, c: np.ndarray, most: int, n: int, k: np.ndarray) -> np.ndarray:
    """Means over the choices of exp(i * angle * sum) at the roots ``k``. ``e[j]`` is that of the choices of j among the elements so far: a
    weighted mean of two terms at each step."""
    size, i = int(c.sum()), 0
    e = np.zeros((most + 1, len(k)), complex)
    e[0] = 1.0
    for x, m in zip(r.tolist(), c.tolist()):
        turn = np.exp(2j * np.pi * ((k * x) % n) / n)
        for _ in range(m):
            i += 1
            lo, hi = max(1, most - (size - i)), min(i, most)  # no other count can still become ``most``
            if lo <= hi:
                j = np.arange(lo, hi + 1)[:, None] / i
                e[lo : hi + 1] = (1.0 - j) * e[lo : hi + 1] + j * (turn * e[lo - 1 : hi])
    return e[most]


def _on_circle(r: np.ndarray, c: np.ndarray, p: float, n: int, k: np.ndarray, y: int) -> np.ndarray:
    """The same, read off ``y`` points of the circle on which the coefficient is the chance of p * size of a binomial count."""
    circle = 2 * np.pi * np.arange(y) / y
    back = np.exp(-2j * np.pi * ((round(p * int(c.sum())) * np.arange(y)) % y) / y)
    e, step = np.empty(len(k) + 1, complex), max(1, CELLS // y)
    for i, root in enumerate([0, *k.tolist()]):
        g, angle = np.ones(y, complex), 2 * np.pi * ((r * root) % n) / n
        for x in range(0, len(r), step):
            g *= ((1 - p + p * np.exp(1j * (angle[x : x + step, None] + circle))) ** c[x : x + step, None]).prod(0)
        e[i] = (g * back).mean()
    return e[1:] / e[0].real


def choice_tail(r: np.ndarray, c: np.ndarray, most: int, at: list[int], n: int, block: int) -> list[float]:
    """Share of a block of the ``n`` roots in the chances that the sum of ``most`` elements chosen at random (each rank c times) is at most
    each of ``at``."""
    size, k = int(c.sum()), _left(r, c, most, n, block)
    # a binomial count with mean ``most`` misses it by ``y`` with a chance below TINY (Bernstein) of that, at least 1 / (size + 1), of meeting it
    rare = math.log(2 * (size + 1) / TINY)
    y = min(size + 1, math.ceil(rare / 3 + math.sqrt(rare * rare / 9 + 2 * rare * most * (size - most) / size)) + 1)
    if size * most <= 4 * len(r) * y:
        step = max(1, CELLS // (most + 1))
        e = np.concatenate([np.empty(0, complex), *[_by_elements(r, c, most, n, k[i : i + step]) for i in range(0, len(k), step)]])
    else:
        e = _on_circle(r, c, most / size, n, k, y)
    # the roots see sums from ``low`` on: all, or those around the mean
    low = 0 if n > most * int(r.max()) else most * int((r * c).sum()) // size - n // 2
    e = e * np.exp(-2j * np.pi * ((k * (low % n)) % n) / n)
    out = []
    for a in at:
        w, half = _tail(k, n, min(a - low, n - 1))
        out.append(float((w * (e * np.exp(-1j * half)).real).sum()) if a >= low else 0.0)
    return out


def _by_blocks(ranks: DataFrame, keys: list[str], plan, tails, names: list[str]) -> DataFrame:
    """(keys, names): sums over blocks of roots. ``plan`` gives (values, N, blocks) of a group's rows, ``tails`` the shares of a block."""
    ddl = ", ".join(f"`{k}` {ranks.schema[k].dataType.simpleString()}" for k in keys)

    def blocks(key, p):
        count = plan(p)[2]
        return pd.DataFrame({**{k: [v] * count for k, v in zip(keys, key)}, "_block": range(count)})

    def share(key, p):
        r, n, _ = plan(p)
        return pd.DataFrame([[*key[: len(keys)], *tails(r, n, p, int(p["_block"].iloc[0]))]], columns=[*keys, *names])

    b = ranks.groupBy(*keys).applyInPandas(blocks, f"{ddl}, _block long")
    # a given number of partitions: the rows are few and small, the work behind them is not
    parts = int(ranks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = on_keys(ranks, b, keys).repartition(parts, *keys, "_block").groupBy(*keys, "_block").applyInPandas(share, ", ".join([ddl, *[f"`{x}` double" for x in names]]))
    return out.groupBy(*keys).agg(*[F.greatest(F.lit(0.0), F.sum(x)).alias(x) for x in names])


def signed_rank_p(ranks: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _p): two-sided p of the smaller signed-rank sum. ``ranks`` holds (keys, _rank, _n) per distinct size of difference,
    ``stats`` the statistic of each key."""
    own = keys or ["_one"]
    one = [] if keys else [F.lit(1).alias("_one")]
    x = on_keys(ranks, stats.select(*keys, F.col("statistic").alias("_s")), keys)
    x = x.select(*keys, *one, (2 * F.col("_rank")).cast("long").alias("r"), F.col("_n").cast("long").alias("c"), (2 * F.col("_s")).cast("long").alias("s"))

    def plan(p):
        r = p["r"].to_numpy() // int(np.gcd.reduce(p["r"].to_numpy()))
        n = int((r * p["c"].to_numpy()).sum()) + 1
        return r, n, n // 2 // ROOTS + 1

    def tails(r, n, p, block):
        first, last = block * ROOTS, min((block + 1) * ROOTS, n // 2 + 1)
        return [signed_tail(r, p["c"].to_numpy(), int(p["s"].iloc[0]) // int(np.gcd.reduce(p["r"].to_numpy())), n, first, last)]

    return _by_blocks(x, own, plan, tails, ["_le"]).select(*keys, F.least(F.lit(1.0), 2 * F.col("_le")).alias("_p"))


def mann_whitney_exact(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_a, n_b, U, p) from (keys, _v, _wa, _wb, _below): distinct values with the counts of both arms and of all smaller values.

    The rank sum of the smaller arm runs over all choices of that many elements, ties by mid-ranks; p is twice the smaller tail."""
    n = ranks.groupBy(*keys).agg(F.sum("_wa").cast("long").alias("n_a"), F.sum("_wb").cast("long").alias("n_b"),
                                 F.sum((2 * F.col("_below") + F.col("_wa") + F.col("_wb") + 1) * F.col("_wa")).cast("long").alias("_ra"),
                                 F.sum((2 * F.col("_below") + F.col("_wa") + F.col("_wb") + 1) * F.col("_wb")).cast("long").alias("_rb"))
    n = n.withColumns({"most": F.least("n_a", "n_b"), "_obs": F.when(F.col("n_a") <= F.col("n_b"), F.col("_ra")).otherwise(F.col("_rb"))})
    own = keys or ["_one"]
    one = [] if keys else [F.lit(1).alias("_one")]
    x = on_keys(ranks, n.select(*keys, "most", "_obs"), keys)
    x = x.select(*keys, *one, (2 * F.col("_below") + F.col("_wa") + F.col("_wb") + 1).cast("long").alias("r"), (F.col("_wa") + F.col("_wb")).cast("long").alias("c"), "most", "_obs")

    def scale(p):
        r = p["r"].to_numpy()
        return int(r.min()), max(1, int(np.gcd.reduce(r - r.min())))

    def plan(p):
        low, by = scale(p)
        r = (p["r"].to_numpy() - low) // by
        n = choice_roots(r, int(p["most"].iloc[0]))
        return r, n, max(1, n // ROOTS)

    def tails(r, n, p, block):
        low, by = scale(p)
        most = int(p["most"].iloc[0])
        at = (int(p["_obs"].iloc[0]) - most * low) // by
        return choice_tail(r, p["c"].to_numpy(), most, [at, at - 1], n, block)

    g = on_keys(n, _by_blocks(x, own, plan, tails, ["_le", "_lt"]).select(*keys, "_le", "_lt"), keys)
    p = F.least(F.lit(1.0), 2 * F.least(F.col("_le"), F.greatest(F.lit(0.0), 1 - F.col("_lt"))))
    na = F.col("n_a").cast("double")
    return g.select(*keys, "n_a", "n_b", (F.col("_ra") / 2 - na * (na + 1) / 2).alias("U"), p.alias("p"))
