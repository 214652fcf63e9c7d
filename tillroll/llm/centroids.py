"""Centroid clustering of integer vectors, pruned by Ptolemy's inequality.

For four points of Euclidean space Ptolemy's inequality gives

    d(v, c) >= | d(v, s) d(c, t) - d(v, t) d(c, s) | / d(s, t)

so a pair of pivots (s, t) bounds the distance of a vector to a centroid from
distances that are known already.  The pivots are the starting centroids, in
fixed pairs (0, 1), (2, 3), ...: the first assignment needs a vector's
distances to them anyway, and they are stored with the vector.  Every later
round knows the few distances between pivots and its centroids, skips the
centroids whose bound is above a distance already found, and measures the
others exactly, in integers.  Bounds are doubles, rounded down by more than
their error, and a centroid is skipped only if its bound is strictly above:
pruning changes no result and no tie.

Components become ``floor(scale * x)``.  Sums, counts, squared distances and
floors of means are integers, so neither the order of rows nor the number of
partitions changes a result.

A round is one pass over the stored vectors.  A task returns, per batch, one
row of component sums for each centroid with vectors; the shuffle holds these
sums only and the driver receives ``k`` rows.  Starting centroids come from a
top-k.  A hot cluster is no hot key.

Cases.  Vectors that are null, of another length, or hold null or non-finite
components are left out, as are those with a component beyond +-2**27 after
scaling (squared distances would leave 64 bits).  Ids may be null or repeated:
rows of equal hash start in the order of their components, null ids last.
With fewer than ``k`` vectors there are fewer centroids; an empty table gives
an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
LIMIT = 1 << 27
#: Relative margins of the bound: far above the few rounding errors of 2**-53 it is made of.
_LOSS, _SLACK = 2.0 ** -46, 1 - 2.0 ** -46


def integers(df: DataFrame, vec: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``df`` with ``vec`` as an array of long; rows without a usable vector go."""
    x = F.transform(F.col(vec), lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) <= F.lit(float(LIMIT) / scale)))   # NaN is above every number
    return (df.where((F.size(F.col(vec)) == dim) & good)
            .withColumn(vec, F.transform(x, lambda v: F.floor(v * scale).cast("long"))))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``v`` to rows of ``c``."""
    return np.stack([((v - x) ** 2).sum(axis=1) for x in c], axis=1)


def ptolemaic(to_pivots: np.ndarray, centroid_pivots: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Lower bounds of squared distances, never above the true ones.

    ``to_pivots``: squared distances vector x pivot; ``centroid_pivots``:
    centroid x pivot; ``between``: squared distance of each pair's pivots.
    """
    v, c = np.sqrt(to_pivots.astype(float)), np.sqrt(centroid_pivots.astype(float))
    low = np.zeros((len(v), len(c)))
    for pair, apart in enumerate(np.sqrt(between.astype(float))):
        if apart == 0:
            continue
        s, t = 2 * pair, 2 * pair + 1
        a, b = v[:, s, None] * c[None, :, t], v[:, t, None] * c[None, :, s]
        low = np.maximum(low, (np.abs(a - b) - (a + b) * _LOSS) / apart)
    return low * low * _SLACK


def nearest(v: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray,
            centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance, distances computed); ties: smaller number."""
    n, k = len(v), len(centroids)
    pairs = len(pivots) // 2
    between = ((pivots[0:2 * pairs:2] - pivots[1:2 * pairs:2]) ** 2).sum(axis=1)
    low = ptolemaic(to_pivots, squares(centroids, pivots), between)
    rows = np.arange(n)
    best = low.argmin(axis=1)                                   # a likely one, to have a distance to prune by
    found = ((v - centroids[best]) ** 2).sum(axis=1)
    done, first = n, best.copy()
    for c in range(k):
        open_ = rows[(first != c) & (low[:, c] <= found)]
        d = ((v[open_] - centroids[c]) ** 2).sum(axis=1)
        better = (d < found[open_]) | ((d == found[open_]) & (c < best[open_]))
        best[open_[better]], found[open_[better]] = c, d[better]
        done += len(open_)
    return best.astype(np.int32), found, done


def _assigner(centroids: np.ndarray, pivots: np.ndarray, id_type, output: str):
    """Arrow function over (id, vector[, pivot distances])."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1))
            if output == "first":
                near = squares(v, pivots)
                best, far = near.argmin(axis=1), None
            else:
                best, far, _ = nearest(v, _matrix(batch.column(2)), pivots, centroids)
            if output == "first":
                size = near.shape[1]
                lists = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * size, pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["_id", "_v", "_p"])
            elif output == "sums":
                hit = np.unique(best)
                sums = [v[best == c].sum(axis=0) for c in hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hit), pa.array([int((best == c).sum()) for c in hit], pa.int64()),
                     pa.array([s.tolist() for s in sums], pa.list_(pa.int64()))], names=["_c", "_n", "_s"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(far)],
                                                 names=["_id", "cluster", "distance"])

    longs = T.ArrayType(T.LongType())
    schema = {
        "first": T.StructType([T.StructField("_id", id_type), T.StructField("_v", longs), T.StructField("_p", longs)]),
        "sums": T.StructType([T.StructField("_c", T.IntegerType()), T.StructField("_n", T.LongType()),
                              T.StructField("_s", longs)]),
        "rows": T.StructType([T.StructField("_id", id_type), T.StructField("cluster", T.IntegerType()),
                              T.StructField("distance", T.LongType())])}[output]
    return run, schema


def _means(sums: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """New centroids: exact floors of the means; without vectors the old ones."""
    dims = sums.select("_c", "_n", F.posexplode("_s").alias("_d", "_x"))
    total = (dims.groupBy("_c", "_d").agg(F.sum(F.col("_x").cast("decimal(38,0)")).alias("_x"), F.sum("_n").alias("_n"))
             .groupBy("_c").agg(F.max("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("_d", "_x"))).alias("_x")))
    new = centroids.copy()
    for row in total.collect():                                 # k rows
        new[row["_c"]] = [int(x["_x"]) // row["_n"] for x in row["_x"]]
    return new


def seeds(df: DataFrame, vec_id: str, vec: str, clusters: int, seed: int) -> np.ndarray:
    """The vectors of smallest sha256 of ``<seed>:<id>``, in hash order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(vec_id).cast("string")).cast("binary"), 256)
    top = df.select(F.col(vec).alias("_v"), mark.alias("_h")).orderBy(F.asc_nulls_last("_h"), "_v").limit(clusters).collect()
    return np.array([r["_v"] for r in top], np.int64)


def cluster(df: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", dim: int = DIM, clusters: int = CLUSTERS,
            rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((``vec_id``, ``cluster``, ``distance``) per usable vector, the final centroids)."""
    ids = df.schema[vec_id].dataType
    ready = integers(df.select(F.col(vec_id).alias("_id"), F.col(vec).alias("_v")), "_v", dim, scale)
    pivots = seeds(ready, "_id", "_v", clusters, seed)
    name = F.col("_id").alias(vec_id)
    if not len(pivots):
        none = ready.select(name, F.lit(0).cast("int").alias("cluster"), F.lit(0).cast("long").alias("distance")).where(F.lit(False))
        return none, pivots

    def passed(rows, centroids, output):
        run, schema = _assigner(centroids, pivots, ids, output)
        return rows.mapInArrow(run, schema)
    known = common.stored(passed(ready, pivots, "first"), "pivots")
    centroids = pivots
    for _ in range(rounds):
        centroids = _means(passed(known, centroids, "sums"), centroids)
    return passed(known, centroids, "rows").select(name, "cluster", "distance"), centroids


def report(df: DataFrame, **options) -> DataFrame:
    """``cluster`` with the inertia of its cluster and of all, and a digest of the centroid."""
    rows, centroids = cluster(df, **options)
    if not len(centroids):
        return rows.select("*", *[F.lit(0).cast("long").alias(c) for c in ("cluster_inertia", "inertia")],
                           F.lit("").alias("centroid_sha256"))
    rows = common.stored(rows, "clusters")
    own = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}                # k rows
    total = sum(own.values())
    table = rows.sparkSession.createDataFrame(
        [(c, Decimal(own.get(c, 0)), Decimal(total), ",".join(map(str, x.tolist()))) for c, x in enumerate(centroids)],
        "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), _text string")   # k rows
    table = table.select("cluster", F.expr("try_cast(cluster_inertia AS bigint)").alias("cluster_inertia"),
                         F.expr("try_cast(inertia AS bigint)").alias("inertia"),
                         F.sha2(F.col("_text").cast("binary"), 256).alias("centroid_sha256"))
    return rows.join(F.broadcast(table), "cluster").select(*rows.columns, "cluster_inertia", "inertia", "centroid_sha256")


def sql(table: str = "embeddings", dim: int = DIM, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE,
        seed: int = SEED) -> str:
    """The result of ``report`` as DuckDB SQL: every distance, round by round."""
    parts = [f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM {table} WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
cells AS (SELECT r, unnest(v) AS x, unnest(range({dim})) AS d FROM kept),
c0 AS (
  SELECT c, unnest(v) AS x, unnest(range({dim})) AS d FROM (
    SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM kept
    QUALIFY c < {clusters}) AS first)"""]
    for k in range(rounds + 1):
        parts.append(f"""
a{k} AS MATERIALIZED (
  SELECT r, c, s FROM (SELECT r, c, sum((cells.x - c{k}.x) ** 2)::HUGEINT AS s FROM cells JOIN c{k} USING (d) GROUP BY r, c) AS far
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY s, c) = 1)""")
        if k < rounds:
            parts.append(f"""
c{k + 1} AS MATERIALIZED (
  SELECT c{k}.c, c{k}.d, coalesce(m.x, c{k}.x) AS x FROM c{k} LEFT JOIN (
    SELECT c, d, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM a{k} JOIN cells USING (r) GROUP BY c, d
  ) AS m ON m.c = c{k}.c AND m.d = c{k}.d)""")
    parts.append(f"""
sums AS (SELECT c, sum(s) AS s FROM a{rounds} GROUP BY c),
marks AS (SELECT c, sha256(string_agg(CAST(x AS BIGINT)::VARCHAR, ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)""")
    return ",".join(parts) + f"""
SELECT vec_id, c::INTEGER AS cluster, a.s::BIGINT AS distance, sums.s::BIGINT AS cluster_inertia,
  (SELECT sum(s) FROM sums)::BIGINT AS inertia, h AS centroid_sha256
FROM a{rounds} AS a JOIN kept USING (r) JOIN sums USING (c) JOIN marks USING (c)"""


SQL = sql()
