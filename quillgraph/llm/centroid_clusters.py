"""Centroid clustering over distinct quantised vectors (operator 13).

Vectors are turned into integers; equal ones become one row with a multiplicity.  Lloyd's rounds run over the distinct
vectors: each task assigns its rows to the nearest centroid and adds up multiplicity times vector in integers, so that the
result doesn't depend on the order of additions.  The driver holds the centroids and one sum a cluster.  At the end the
assignments are joined back to the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SCALE, DIMENSIONS, CLUSTERS, ROUNDS = 1024, 64, 8, 10
#: Components are held within this, so that a squared distance of 64 components fits 64 bits.
BOUND = 1 << 27
#: Vectors of more than one row in so many are joined by a broadcast: fewer than so many exist.
FREQUENT = 1024


def quantised(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``v``: floor(scale * x) of each component, as little-endian 32-bit integers in one binary value.

    Vectors that are null, of another length, or with a null, infinite or NaN component are left out.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            right = np.flatnonzero(sizes == dimensions)
            values = lists.take(pa.array(right)).flatten()
            x = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            whole = np.isfinite(x).all(axis=1)
            x = np.clip(np.floor(x[whole] * scale), -BOUND, BOUND).astype("<i4")
            ids = batch.column("vec_id").take(pa.array(right[whole]))
            yield pa.RecordBatch.from_arrays([ids, as_binary(x)], ["vec_id", "v"])

    kind = rows.schema[vec_id].dataType.simpleString()
    return rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(make, f"vec_id {kind}, v binary")


def as_binary(x: np.ndarray) -> pa.Array:
    """One binary value a row."""
    flat = np.ascontiguousarray(x)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (flat.itemsize * flat.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def as_matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Values of ``as_binary`` as 64-bit integers, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dimensions).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller on ties) and its squared distance."""
    every = np.stack([np.square(x - c).sum(axis=1) for c in centroids], axis=1)
    best = every.argmin(axis=1)
    return best, every[np.arange(len(x)), best]


def weighted_sums(x: np.ndarray, weight: np.ndarray, cluster: np.ndarray, clusters: int) -> Iterator[tuple[int, int, list[int]]]:
    """Cluster, rows and exact sum of weight times vector, for each cluster that has rows."""
    for c in range(clusters):
        own = cluster == c
        if own.any():
            v, w = x[own], weight[own]
            if int(np.abs(v).max(initial=0)) * int(w.sum(dtype=object)) >= 1 << 62:  # Python's integers don't overflow
                v, w = v.astype(object), w.astype(object)
            yield c, int(w.sum()), [int(s) for s in w @ v]


def first_centroids(rows: DataFrame, clusters: int, dimensions: int, seed: int = 3) -> np.ndarray:
    """The vectors of the smallest SHA-256 of their ids, in that order: at most ``clusters`` rows."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    best = rows.select(digest.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([np.frombuffer(r.v, "<i4") for r in best], np.int64).reshape(-1, dimensions)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the exact mean of each cluster; an empty one stays.

    One row a cluster and component reaches the driver.
    """
    clusters, dimensions = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = as_matrix(batch.column("v"), dimensions)
            best, _ = nearest(x, centroids)
            found = list(weighted_sums(x, batch.column("n").to_numpy(), best, clusters))
            columns = [[c for c, _, _ in found], [str(n) for _, n, _ in found], [[str(s) for s in total] for _, _, total in found]]
            kinds = [pa.int32(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["cluster", "n", "total"])

    parts = distinct.mapInArrow(sums, "cluster int, n string, total array<string>")
    each = parts.select("cluster", F.col("n").cast("decimal(38,0)").alias("n"), F.posexplode("total").alias("place", "s"))
    every = each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = centroids.copy()
    for r in every:
        out[r.cluster, r.place] = int(r.s) // int(r.n)
    return out


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``distinct`` (v, n) with ``cluster`` and ``distance``."""
    dimensions = centroids.shape[1]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance = nearest(as_matrix(batch.column("v"), dimensions), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("n"), pa.array(best.astype(np.int32)), pa.array(distance)], ["v", "n", "cluster", "distance"])

    return distinct.mapInArrow(label, "v binary, n long, cluster int, distance long")


def centroid_clusters(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, DataFrame]:
    """Assignments (``vec_id``, ``cluster``, ``distance``, a row for each row with a usable vector) and clusters.

    Clusters: ``cluster``, ``centroid`` (integers), ``size``, ``cluster_inertia`` and ``inertia``, a row for each cluster that
    has vectors.  Vectors that are null, of another length, or with a null or non-finite component are left out.  Rows that
    repeat an id or a vector are rows of their own; a null id is kept and counts as an empty text where centroids are
    drawn, ids of equal hash are ordered by their vectors' bytes.  Fewer usable vectors than ``clusters`` make fewer
    clusters, none make empty tables.  Components beyond ``BOUND`` are taken as that bound.  Other columns are not read.
    """
    spark = rows.sparkSession
    kept = quantised(rows, vec_id, vector, dimensions, scale)
    distinct = written(kept.groupBy("v").agg(F.count("*").alias("n")), "distinct-vectors")
    centroids = first_centroids(kept, clusters, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        after = moved(distinct, centroids)
        if (after == centroids).all():  # all later rounds would leave them too
            break
        centroids = after
    if len(centroids):
        labels = written(assigned(distinct, centroids), "vector-clusters")
    else:
        labels = distinct.selectExpr("v", "n", "CAST(0 AS int) AS cluster", "0L AS distance").where("false")
    weight = F.col("distance").cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")
    found = labels.groupBy("cluster").agg(F.sum("n").alias("size"), F.sum(weight).cast("long").alias("cluster_inertia")).collect()  # a row a cluster
    total = sum(r.cluster_inertia for r in found)
    about = [(r.cluster, [int(c) for c in centroids[r.cluster]], r["size"], r.cluster_inertia, total) for r in found]
    return joined_back(kept, labels), spark.createDataFrame(about, "cluster int, centroid array<long>, size long, cluster_inertia long, inertia long")


def joined_back(kept: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row's assignment.  Vectors with a large share of all rows go out by a broadcast, so that none fills a task."""
    rows = labels.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first().rows
    often = F.col("n") > rows / FREQUENT
    heavy = F.broadcast(labels.where(often).select("v", "cluster", "distance"))
    common = kept.join(heavy, "v").select("vec_id", "cluster", "distance")
    rare = kept.join(heavy, "v", "left_anti").join(labels.where(~often).select("v", "cluster", "distance"), "v").select("vec_id", "cluster", "distance")
    return common.union(rare)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, clusters = centroid_clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    about = clusters.select("cluster", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op13_sql() -> str:
    """The rounds one after the other; a CTE each."""
    near = """a{r} AS MATERIALIZED (
  SELECT vec_id, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
  FROM (SELECT k.vec_id, c.cluster, CAST(sum((k.x - c.x) * (k.x - c.x)) AS BIGINT) AS distance FROM kept k JOIN c{r} c ON k.place = c.place GROUP BY k.vec_id, c.cluster) d
  GROUP BY vec_id
)"""
    move = """c{s} AS MATERIALIZED (
  SELECT c.cluster, c.place, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT cluster, place, CAST((t - ((t % n) + n) % n) // n AS BIGINT) AS x
    FROM (SELECT a.cluster, k.place, sum(k.x) AS t, count(*) AS n FROM kept k JOIN a{r} a ON k.vec_id = a.vec_id GROUP BY a.cluster, k.place) s
  ) m ON c.cluster = m.cluster AND c.place = m.place
)"""
    steps = []
    for r in range(ROUNDS):
        steps += [near.format(r=r), move.format(r=r, s=r + 1)]
    steps.append(near.format(r=ROUNDS))
    return f"""
WITH usable AS MATERIALIZED (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}
), kept AS MATERIALIZED (
  SELECT vec_id, place, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM usable) u
), first AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS cluster FROM usable
  ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) LIMIT {CLUSTERS}
), c0 AS MATERIALIZED (
  SELECT CAST(f.cluster AS INTEGER) AS cluster, k.place, k.x FROM first f JOIN kept k ON f.vec_id = k.vec_id
), {", ".join(steps)}, sums AS (
  SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a{ROUNDS} GROUP BY cluster
), names AS (
  SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster
)
SELECT a.vec_id, a.cluster, a.distance, s.cluster_inertia, CAST((SELECT sum(distance) FROM a{ROUNDS}) AS BIGINT) AS inertia, n.centroid_sha256
FROM a{ROUNDS} a JOIN sums s ON a.cluster = s.cluster JOIN names n ON a.cluster = n.cluster
"""


OP13_SQL = _op13_sql()
