"""Centroid clustering by an equal-average equal-variance search.

Vectors and centroids are integer vectors of ``dim`` components.  For a vector
x and a centroid c with component sums s and deviations v (the length of what
is left after taking the mean from each component),

    dim * |x - c|^2  >=  (s_x - s_c)^2 + dim * (v_x - v_c)^2.

Centroids are sorted by their sums.  The search starts at the vector's own sum
and goes outward, always to the nearer side; it ends where the first term alone
exceeds the least distance found (all that follow are further out), and passes
over a centroid that both terms reject.  The first test is exact on integers,
the second keeps a margin for its rounding, and what is left is measured in
whole numbers, so the result is that of a full search, ties included.

Each round reads the vectors once; tasks send one row of sums per centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batched, slices, stored

DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: components up to this, divided by dim, keep all terms within 64 bits: the largest is (2 * dim * component)^2
LIMIT = 1 << 30
#: rows that a task compares at a time
ROWS = 4096
#: share of the second test's bound left for rounding
MARGIN = 1e-9


def kept(vector: Column, dim: int = DIM) -> Column:
    """Whether a vector has ``dim`` components, none null and none without a finite value."""
    x = vector.cast("array<double>")
    return (F.size(x) == dim) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def fits(ints: np.ndarray) -> bool:
    """Whether 64 bits suffice for all that is computed of these components."""
    return not ints.size or bool(np.abs(ints).max() <= LIMIT // ints.shape[1])


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact: 64-bit integers where these suffice, else Python's own."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if not fits(scaled):
        floors = [int(x) if np.isfinite(x) else int(v) * scale for x, v in zip(scaled.ravel(), vectors.astype(np.float64).ravel())]
        out = np.empty(len(floors), object)
        out[:] = floors
        return out.reshape(scaled.shape)
    return scaled.astype(np.int64)


def deviations(ints: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """dim^(1/2) * v of each row, from an exact dim * sum of squares - square of the sum."""
    squares = (ints * ints).sum(axis=1) * ints.shape[1] - sums * sums
    return np.sqrt(squares.astype(np.float64))


class Search:
    """Centroids in order of their component sums."""

    def __init__(self, centroids: list[list[int]]):
        rows = np.array(centroids, object)
        rows = rows.astype(np.int64) if fits(rows) else rows
        sums = rows.sum(axis=1)
        self.order = np.array(sorted(range(len(rows)), key=lambda i: (sums[i], i)), np.int64)
        self.rows, self.sums = rows[self.order], sums[self.order]
        self.deviations = deviations(self.rows, self.sums)
        self.measured = 0

    def nearest(self, ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and squared distances of each row's nearest centroid, the smallest number among equals."""
        own_rows, own_sums = self.rows, self.sums
        if ints.dtype != own_rows.dtype:
            ints, own_rows, own_sums = ints.astype(object), own_rows.astype(object), own_sums.astype(object)
        n, dim = ints.shape
        sums = ints.sum(axis=1)
        spread = deviations(ints, sums)
        high = np.searchsorted(own_sums, sums)
        low = high - 1
        best = np.full(n, -1, np.int64)
        least = np.zeros(n, ints.dtype)
        left = np.arange(n)  # rows still searching
        while len(left):
            lo, hi, s = low[left], high[left], sums[left]
            below = np.abs(s - own_sums[np.maximum(lo, 0)])
            above = np.abs(own_sums[np.minimum(hi, len(own_rows) - 1)] - s)
            down = (lo >= 0) & ((hi >= len(own_rows)) | (below <= above))
            at, gap = np.where(down, lo, hi), np.where(down, below, above)
            first = best[left] < 0
            open_ = (first | (gap * gap <= least[left] * dim)).astype(bool)
            left, at, gap, first, down = left[open_], at[open_], gap[open_], first[open_], down[open_]
            apart = spread[left] - self.deviations[at]
            bound = (gap.astype(np.float64) ** 2 + apart * apart) * (1 - MARGIN)
            # rounding of the deviations themselves: their error is relative to their size
            slack = MARGIN * (spread[left] + self.deviations[at]) ** 2
            near = first | (bound - slack <= least[left].astype(np.float64) * dim)
            rows, cells = left[near], at[near]
            apart = ints[rows] - own_rows[cells]
            found = (apart * apart).sum(axis=1)
            self.measured += len(rows)
            number = self.order[cells]
            better = (best[rows] < 0) | (found < least[rows]) | ((found == least[rows]) & (number < best[rows]))
            better = better.astype(bool)
            best[rows[better]], least[rows[better]] = number[better], found[better]
            low[left[down]] -= 1
            high[left[~down]] += 1
            left = left[(low[left] >= 0) | (high[left] < len(own_rows))]
        return best, least


def _vectors(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer vectors of the kept rows."""
    for batch in slices(batches, ROWS):
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        yield batch.column(0), whole(flat.reshape(-1, dim), scale)


def _long(values: np.ndarray) -> pa.Array:
    """Whole numbers as longs, null where one does not fit."""
    if values.dtype == object:
        return pa.array([int(v) if v < 1 << 63 else None for v in values], pa.int64())
    return pa.array(values)


def _round(vectors: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> list[list[int]]:
    """The floors of the clusters' means; a centroid without vectors stays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        total, count = [[0] * dim for _ in centroids], [0] * len(centroids)
        for _, ints in _vectors(batches, dim, scale):
            number, _ = search.nearest(ints)
            for c in np.unique(number).tolist():
                own = ints[number == c]
                count[c] += len(own)
                total[c] = [a + b for a, b in zip(total[c], own.sum(axis=0).tolist())]
        rows = [(c, count[c], [Decimal(x) for x in total[c]]) for c in range(len(centroids)) if count[c]]
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["cluster", "n", "total"])

    found = vectors.mapInArrow(sums, "cluster int, n long, total array<decimal(38,0)>")
    columns = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dim)]
    # one row per centroid
    means = {r["cluster"]: [int(r[f"s{i}"]) // r["n"] for i in range(dim)] for r in found.groupBy("cluster").agg(F.sum("n").alias("n"), *columns).collect()}
    return [means.get(c, row) for c, row in enumerate(centroids)]


def seeds(vectors: DataFrame, centroids: int, seed: int, dim: int, scale: int) -> list[list[int]]:
    """The integer vectors with the smallest hashes of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), F.col("v")).limit(centroids).collect()
    return [whole(np.array([r.v], np.float64), scale)[0].tolist() for r in rows]


def cluster_vectors(
    df: DataFrame,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    dim: int = DIM,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): a row for each kept row of ``df``.

    Kept are vectors of ``dim`` components that are all finite; null vectors,
    null, NaN or infinite components and other lengths are left out.  Fewer
    rows than ``centroids`` give as many centroids; without any the result is
    empty.  Rows that share an id stay rows of their own; ones without an id
    become centroids last.  Seeds of equal hash are taken in order of their
    components.  Components may reach 10^30; distances and sums of them that do
    not fit a long are null.  Other columns are not read.
    """
    vectors = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(kept(F.col("v"), dim)).transform(batched)
    cells = seeds(vectors, centroids, seed, dim, scale)
    if not cells:
        none = F.lit(None).cast
        return vectors.limit(0).select("vec_id", none("int").alias("cluster"), *[none("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], none("array<decimal(38,0)>").alias("centroid"))
    for _ in range(rounds):
        cells = _round(vectors, cells, dim, scale)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(cells)
        for ids, ints in _vectors(batches, dim, scale):
            number, distance = search.nearest(ints)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), _long(distance)], names=["vec_id", "cluster", "distance"])

    id_type = vectors.schema["vec_id"].dataType.simpleString()
    assigned = stored(vectors.mapInArrow(assign, f"vec_id {id_type}, cluster int, distance long"), "clusters")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    exact = F.when(F.count("*") == F.count("distance"), exact)
    # one row per centroid
    inertia = {r["cluster"]: r["x"] if r["x"] is None else int(r["x"]) for r in assigned.groupBy("cluster").agg(exact.alias("x")).collect()}
    total = None if None in inertia.values() else sum(inertia.values())
    long = lambda x: None if x is None or x >= 1 << 63 else x
    rows = [(c, long(x), long(total), [Decimal(v) for v in cells[c]]) for c, x in inertia.items()]
    facts = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<decimal(38,0)>")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def clusters_report(df: DataFrame) -> DataFrame:
    """``cluster_vectors`` with the digest of each vector's centroid in place of its components."""
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return cluster_vectors(df).withColumn("centroid_sha256", digest).drop("centroid")


def _oracle(centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> str:
    """DuckDB SQL for ``clusters_report``: a full search, each vector against the stated centroids."""
    ctes = [
        f"""kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INT) AS c, v
            FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {centroids}) s)""",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"""a{i} AS MATERIALIZED (SELECT vec_id, r, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS best
                FROM (SELECT k.vec_id, k.r, k.v, c.c, CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
                      FROM kept k, c{i} c) x GROUP BY vec_id, r)"""
        )
        if i < rounds:
            ctes.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (
                    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS v
                    FROM (SELECT c, p, sum(x) AS s, count(*) AS n
                          FROM (SELECT best.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i}) u GROUP BY c, p) w GROUP BY c) m ON m.c = o.c)"""
            )
    return f"""WITH {", ".join(ctes)}
        SELECT a.vec_id, a.best.c AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best.c"""


ORACLE = _oracle()
