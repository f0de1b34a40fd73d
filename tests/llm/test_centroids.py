import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import catalog, centroids

INF, NAN = float("inf"), float("nan")


def brute(rows, k=16, rounds=3):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) by plain loops."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(64 * x) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cells = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cells))

    for _ in range(rounds):
        own = [[] for _ in cells]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        cells = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for vs, c in zip(own, cells)]
    found = [(vec_id, *nearest(v)[::-1]) for vec_id, v in kept]
    inertia = [sum(d for _, i, d in found if i == c) for c in range(len(cells))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cells]
    return sorted(((v, c, d, inertia[c], sum(inertia), digests[c]) for v, c, d in found), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("v", F.lit(0)).repartition(3)


def test_search_is_a_full_search():
    rng = np.random.default_rng(1)
    for trial in range(60):
        dim, k = int(rng.integers(1, 9)), int(rng.integers(1, 30))
        high = int(rng.choice([2, 4, 1000, 1 << 26]))
        cells = rng.integers(-high, high + 1, (k, dim))
        cells[rng.integers(0, k)] = cells[0]
        x = rng.integers(-high, high + 1, (200, dim))
        if trial % 5 == 0:  # Python's integers
            x = x.astype(object) * 10**15
            cells = cells.astype(object) * 10**15
        number, distance = centroids.Search(cells.tolist()).nearest(x)
        full = ((x[:, None, :] - cells[None]) ** 2).sum(axis=2)
        want = [min((d, i) for i, d in enumerate(row)) for row in full.tolist()]
        assert list(zip(distance.tolist(), number.tolist())) == want


def test_search_rejects_centroids():
    rng = np.random.default_rng(2)
    cells = rng.normal(0, 100, (64, 64)) + rng.normal(0, 300, (64, 1))
    x = np.repeat(cells, 20, axis=0) + rng.normal(0, 5, (64 * 20, 64))
    search = centroids.Search(np.floor(cells).astype(int).tolist())
    search.nearest(np.floor(x).astype(np.int64))
    assert search.measured < 0.25 * len(x) * len(cells)


def test_edge_rows(spark):
    rng = random.Random(3)
    vec = lambda s=1.0: [float(np.float32(rng.gauss(0, s))) for _ in range(64)]
    same = vec()
    rows = [(i, vec()) for i in range(60)] + [(100 + i, same) for i in range(40)] + [(7, vec()), (7, same), (None, vec()), (None, same)]
    rows += [(200, None), (201, []), (202, vec()[:63]), (203, [*vec(), 1.0]), (204, [NAN, *vec()[1:]]), (205, [INF, *vec()[1:]]), (206, [None, *vec()[1:]]), (207, [-INF, *vec()[1:]])]
    rows += [(300, [0.0] * 64), (301, [-0.0] * 64), (302, [1e5, *[0.0] * 63])]
    got = centroids.clusters_report(frame(spark, rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_few_rows_large_components_and_none(spark):
    few = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [float(1 << 21)] * 64), (4, [-float(1 << 21)] * 64)]
    assert sorted(map(tuple, centroids.clusters_report(frame(spark, few)).collect()), key=str) == brute(few)
    assert centroids.clusters_report(frame(spark, [(1, None)])).collect() == []
    empty = centroids.clusters_report(frame(spark, few).limit(0))
    assert empty.collect() == [] and empty.columns[-1] == "centroid_sha256"
    # too large for a long: null
    huge = [(i, [1e30 * (i % 2)] + [0.0] * 63) for i in range(40)]
    got = centroids.cluster_vectors(frame(spark, huge), centroids=1, rounds=0).collect()
    assert len(got) == 40 and any(r.distance is None for r in got) and all(r.inertia is None for r in got)


def test_query_matches_brute_force(spark, sf_small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    got = catalog.queries()["op12_centroids"](spark, sf_small)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
