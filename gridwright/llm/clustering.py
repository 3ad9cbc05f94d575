"""Centroid clustering (Lloyd rounds on integer vectors) whose nearest-centroid
search is the equal-average equal-variance search (Ra and Kim, 1993; Lee and
Chen, 1994).

Centroids are sorted by their component sum. For a vector ``x`` the scan starts
at its own sum and goes outward. With ``k`` components, ``S`` the sum, ``Q`` the
sum of squares and ``V = sqrt(k Q - S^2)`` (k times the deviation),

    k |x - c|^2  >=  (Sx - Sc)^2 + (Vx - Vc)^2.

A direction ends once ``(Sx - Sc)^2 > k * best``: sums only get further away. A
centroid that passes is skipped if the whole right side exceeds ``k * best``.
Both compare integers: ``V`` is held between its integer square root and that
plus one, so no centroid is rejected that is as near as the best. What is left
gets the exact integer distance; of equal distances the smaller number wins.
The scan runs for all vectors of an Arrow batch at once.

Each round is one Spark job: a task sums its vectors by centroid, the sums of
all tasks are added in DECIMAL(38,0), at most ``clusters`` rows come back to
the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import written

CLUSTERS, ROUNDS, SIZE, SCALE = 40, 5, 64, 256
#: Integers up to this number keep every square, sum and product of the search in 64 bits; others use Python integers.
SMALL = 1 << 24
#: Largest integer of a component: up to here doubles hold every integer and distances fit DECIMAL(38,0).
LARGEST = 1 << 53
_LONG = (1 << 63) - 1


def _roots(v: np.ndarray) -> np.ndarray:
    """Integer square roots of non-negative integers."""
    if v.dtype == object:
        return np.array([math.isqrt(x) for x in v], dtype=object)
    r = np.sqrt(v.astype(np.float64)).astype(np.int64)
    r -= (r * r > v).astype(np.int64)
    r += ((r + 1) * (r + 1) <= v).astype(np.int64)
    return r


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component sum ``S`` and ``floor(V)`` of every row."""
    s = x.sum(axis=1)
    return s, _roots(x.shape[1] * (x * x).sum(axis=1) - s * s)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid of every row of
    ``x`` (integers), and how many distances were computed."""
    n, k = x.shape
    m = len(centroids)
    sx, vx = _moments(x)
    sc, vc = _moments(centroids)
    order = np.argsort(sc, kind="stable")
    c, sc, vc = centroids[order], sc[order], vc[order]
    best_no = np.full(n, m, dtype=np.int64)
    best = np.zeros(n, dtype=x.dtype)
    right = np.searchsorted(sc, sx)  # next centroid to look at on either side
    left = right - 1
    live = np.arange(n)
    computed = 0
    while len(live):
        lo, hi = left[live], right[live]
        s = sx[live]
        gap_lo = np.where(lo >= 0, s - sc[np.maximum(lo, 0)], 0)
        gap_hi = np.where(hi < m, sc[np.minimum(hi, m - 1)] - s, 0)
        down = (lo >= 0) & ((hi >= m) | (gap_lo <= gap_hi))
        at = np.where(down, lo, hi)
        gap = np.where(down, gap_lo, gap_hi)
        left[live] = np.where(down, lo - 1, lo)
        right[live] = np.where(down, hi, hi + 1)
        first = best_no[live] == m
        room = k * best[live]
        far = ~first & (gap * gap > room).astype(bool)  # the nearer side is too far: so is all that is left
        # floor(V) of both: |Vx - Vc| is more than |floor Vx - floor Vc| - 1
        dev = np.maximum(np.abs(vx[live] - vc[at]) - 1, 0)
        test = ~far & (first | (gap * gap + dev * dev <= room).astype(bool))
        rows, which = live[test], at[test]
        if len(rows):
            d = x[rows] - c[which]
            d = (d * d).sum(axis=1)
            computed += len(rows)
            no = order[which]
            old, old_no = best[rows], best_no[rows]
            new = old_no == m
            old = np.where(new, d, old)
            win = (d < old).astype(bool) | ((d == old).astype(bool) & (no < old_no))
            best[rows[win]], best_no[rows[win]] = d[win], no[win]
        live = live[~far & ((left[live] >= 0) | (right[live] < m))]
    return best_no, best, computed


def _integers(column: pa.Array, size: int, scale: int, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors ``floor(scale * x)`` and centroids in one type: 64-bit if all
    of them are small, else Python integers."""
    x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, size)
    small = np.abs(x).max() <= SMALL and all(abs(v) <= SMALL for row in centroids for v in row)
    if small:
        return x.astype(np.int64), np.array(centroids, dtype=np.int64)
    return x.astype(np.int64).astype(object), np.array(centroids, dtype=object)


def kept_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", size: int = SIZE,
                 scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` of the vectors that take part, written once."""
    fits = F.filter(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(LARGEST / scale)))
    rows = vectors.filter((F.size(F.col(embedding)) == size) & (F.size(fits) == size))
    return written(rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v")), "vectors")


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, scale: int = SCALE, seed: str = "2:") -> list[list[int]]:
    """The vectors with the smallest sha256 of ``seed`` and ``vec_id``; a null
    id counts as empty text, repeated ids follow the order of their components."""
    text = F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = kept.select(F.sha2(text, 256).alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return [[math.floor(scale * float(x)) for x in r["v"]] for r in rows]


def _sums(kept: DataFrame, centroids: list[list[int]], size: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of every non-empty cluster."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [0] * len(centroids)
        total = [np.zeros(size, dtype=object) for _ in centroids]
        for b in batches:
            if b.num_rows:
                x, c = _integers(b.column(0), size, scale, centroids)
                no, _, _ = nearest(x, c)
                for k in np.unique(no).tolist():
                    mine = x[no == k]
                    count[k] += len(mine)
                    total[k] = total[k] + mine.sum(axis=0).astype(object)
        for k, n in enumerate(count):
            if n:
                yield pa.RecordBatch.from_pydict({"cluster": pa.array([k] * (size + 1), pa.int32()),
                                                  "place": pa.array(range(-1, size), pa.int32()),
                                                  "amount": [str(v) for v in (n, *total[k].tolist())]})

    parts = kept.select("v").mapInArrow(run, "cluster int, place int, amount string")
    whole = parts.groupBy("cluster", "place").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"))
    got = {(r["cluster"], r["place"]): int(r["amount"]) for r in whole.collect()}  # clusters x (components + 1) rows
    return {k: (n, [got[k, j] for j in range(size)]) for (k, place), n in got.items() if place == -1}


def fit(kept: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE,
        seed: str = "2:") -> list[list[int]]:
    """Centroids after ``rounds`` rounds of assignment and exact floor means;
    the centroid of an empty cluster stays."""
    centroids = first_centroids(kept, clusters, scale, seed)
    for _ in range(rounds if centroids else 0):
        for k, (n, total) in _sums(kept, centroids, size, scale).items():
            centroids[k] = [t // n for t in total]
    return centroids


def assign(kept: DataFrame, centroids: list[list[int]], size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance``; a distance past BIGINT is null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                no, d, _ = nearest(*_integers(b.column(1), size, scale, centroids))
                d = [v if v <= _LONG else None for v in d] if d.dtype == object else d
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(no, pa.int32()), pa.array(d, pa.int64())],
                                                 names=["vec_id", "cluster", "distance"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE,
            vec_id: str = "vec_id", embedding: str = "embedding", seed: str = "2:") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``
    for every vector with exactly ``size`` components, none of them null, NaN or
    infinite; other vectors, null ones included, have no row. Nor has a vector
    with a component whose integer is beyond ``LARGEST``.

    A component ``x`` counts as the integer ``floor(scale * x)``. Ties go to
    the smaller cluster number; repeated rows stay, one result row each; a null
    id counts as empty text when the first centroids are drawn. With fewer
    vectors than ``clusters`` each is a first centroid; an empty table gives an
    empty result; other columns, whatever their names, are ignored. A distance
    past BIGINT is null, and so is an inertia that holds one or is past BIGINT."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, vec_id, embedding, size, scale)
    centroids = fit(kept, clusters, rounds, size, scale, seed)
    each = written(assign(kept, centroids, size, scale), "assigned")
    per = each.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count_if(F.col("distance").isNull()).alias("lost"))
    by = {r["cluster"]: None if r["lost"] or r["d"] > _LONG else int(r["d"]) for r in per.collect()}  # one row per cluster
    total = None if None in by.values() or sum(by.values()) > _LONG else sum(by.values())
    rows = [(k, v, hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for k, v in sorted(by.items())]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, centroid_sha256 string")
    return each.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("bigint").alias("inertia"), "centroid_sha256")
