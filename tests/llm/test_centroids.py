"""Centroid clustering against every distance and DuckDB SQL."""

import hashlib
import math
import random

import numpy as np
import duckdb

from tillroll.llm import centroids, queries

SF = "/root/testdata/sf0.001"


def brute(rows, dim, k, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]

    def order(r):
        return (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    cs = [v for _, v in sorted(kept, key=order)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cs = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cs)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    own = {}
    for _, c, d in out:
        own[c] = own.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, c, d, own[c], sum(own.values()), sha[c]) for i, c, d in out), key=str)


def test_cases(spark):
    rng = random.Random(4)
    vec = [[rng.choice([-1.0, -0.3, 0.0, 0.2, 0.9]) for _ in range(6)] for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(vec)] + [(3, vec[3]), (None, vec[5]), (None, vec[6]), (70, None), (71, []), (72, vec[0][:5]),
                                                  (73, [None] + vec[0][1:]), (74, [float("nan")] + vec[0][1:]),
                                                  (75, vec[1][:5] + [float("-inf")]), (76, [-0.0] * 6), (77, [1e4] * 6)]
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, _v string")
    for parts in (1, 7):
        got = centroids.report(df.repartition(parts), dim=6, clusters=5).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, 6, 5, 3, 64)
    few = centroids.report(df.where("vec_id < 3"), dim=6, clusters=5).collect()
    assert sorted((tuple(r) for r in few), key=str) == brute(rows[:3], 6, 5, 3, 64)
    assert centroids.report(df.limit(0), dim=6).columns == centroids.report(df, dim=6, clusters=2).columns
    assert centroids.report(df.limit(0), dim=6).count() == 0


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(1)
    for spread in (3, 1000, 1 << 27):
        v, c = rng.integers(-spread, spread, (300, 8)), rng.integers(-spread, spread, (9, 8))
        pivots = rng.integers(-spread, spread, (6, 8))
        pivots[3] = pivots[2]                                 # a pair without distance bounds nothing
        c[0], v[0], v[1] = pivots[0], pivots[1], c[1]
        between = ((pivots[0::2] - pivots[1::2]) ** 2).sum(axis=1)
        exact = centroids.squares(v, c)
        low = centroids.ptolemaic(centroids.squares(v, pivots), centroids.squares(c, pivots), between)
        assert (low <= exact).all() and (low > 0.3 * exact).any()
        best, far, done = centroids.nearest(v, centroids.squares(v, pivots), pivots, c)
        assert best.tolist() == exact.argmin(axis=1).tolist() and far.tolist() == exact.min(axis=1).tolist()
        assert done < exact.size


def test_query_and_sql(spark):
    got = sorted(tuple(r) for r in queries.op11_centroid_clustering(spark, SF).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == sorted(con.sql(centroids.SQL).fetchall())
