"""A stored vector index: inverted lists around centroids, pruned at read; the exact search (``retrieval``) stays beside it.

Centroids are fitted on a bounded sample; every row is indexed.  A question reads the lists of its nearest centroids only.
How many those are is measured on the sample: so many that ``TARGET`` of the true neighbours are found there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.vectors import cosine, doubles
from quillgraph.operators.graph import cut
from quillgraph.operators.retrieval import NearestRows, query_slices, unit
from quillgraph.operators.stored_index import StoredIndex

#: Rows that centroids are fitted on at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 32_768
#: Centroids at most; a fitted one has 16 sample rows at least on average.
MAX_LISTS = 2048
#: Share of the nearest rows that a question's lists should hold, on the sample.
TARGET = 0.97
#: Rows of the sample that are asked for to measure it.
ASKED = 512


def fit(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Directions of ``lists`` clusters of rows of length one (spherical k-means, from evenly spaced rows)."""
    centroids = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-10, sums / np.maximum(size, 1e-10), centroids)
    return centroids


def probes_needed(x: np.ndarray, centroids: np.ndarray, k: int, target: float = TARGET) -> int:
    """Nearest lists that hold ``target`` of the ``k`` nearest rows, asked for rows of the sample itself."""
    some = x[np.linspace(0, len(x) - 1, min(ASKED, len(x))).astype(int)]
    own = (x @ centroids.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(some @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    best = np.argpartition(-(some @ x.T), min(k, len(x) - 1), axis=1)[:, :k]
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


class VectorIndex:
    """Rows (vec_id, embedding) by list.  ``probes``: lists that a question reads unless it says otherwise."""

    def __init__(self, spark: SparkSession, path: str, centroids: np.ndarray, probes: int, id_type: str = "long"):
        self.spark, self.path, self.centroids, self.probes = spark, path.rstrip("/"), centroids, probes
        self.stored = StoredIndex(spark, self.path, f"vec_id {id_type}, embedding array<float>", "vec_id", "list")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None, k: int = 8) -> VectorIndex:
        """An index of all ``vectors`` (vec_id, embedding) with an embedding; others are left out."""
        spark, rows = vectors.sparkSession, vectors.where("embedding IS NOT NULL").select("vec_id", "embedding")
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toPandas()
        x = unit(np.array(sample["embedding"].tolist(), float).reshape(len(sample), -1 if len(sample) else 0))
        n = rows.count()
        lists = max(1, min(lists or round(n**0.5), MAX_LISTS, len(x) // 16 or 1))
        centroids = fit(x, lists) if len(x) else np.zeros((1, 1))
        probes = probes_needed(x, centroids, k) if len(x) else 1
        about = [(i, c.tolist(), probes, dict(rows.dtypes)["vec_id"]) for i, c in enumerate(centroids)]
        spark.createDataFrame(about, "list int, centroid array<double>, probes int, id_type string").coalesce(1).write.parquet(f"{path.rstrip('/')}/centroids")
        index = cls(spark, path, centroids, probes, dict(rows.dtypes)["vec_id"])
        index.add(rows)
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        about = spark.read.parquet(f"{path.rstrip('/')}/centroids").orderBy("list").collect()  # MAX_LISTS rows at most
        return cls(spark, path, np.array([r.centroid for r in about]), about[0].probes, about[0].id_type)

    def listed(self, rows: DataFrame) -> DataFrame:
        """``vec_id``, ``embedding``, ``list`` of the nearest centroid."""
        centroids, kind = self.centroids, dict(rows.dtypes)["vec_id"]

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("embedding")
                own = (np.array(x.to_pylist(), float).reshape(len(x), -1) @ centroids.T).argmax(axis=1) if len(x) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], [*batch.schema.names, "list"])

        return rows.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(near, f"vec_id {kind}, embedding array<float>, list int")

    def add(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """Take in new rows, and take away those of the ids ``gone`` (vec_id) first; the lists stay as they were fitted."""
        return self.stored.add(self.listed(rows.where("embedding IS NOT NULL")), gone)

    def asked_lists(self, vectors: np.ndarray, probes: int | None = None) -> np.ndarray:
        """The nearest lists of each vector."""
        n = min(probes or self.probes, len(self.centroids))
        return np.argsort(-(unit(vectors) @ self.centroids.T), axis=1, kind="stable")[:, :n]

    def topk(self, query: list[float], k: int = 8, probes: int | None = None) -> DataFrame:
        """``vec_id``, ``score`` of the ``k`` nearest rows in the question's lists, ties by id."""
        lists = self.asked_lists(np.array([query], float), probes)[0].tolist()
        vector = F.array(*[F.lit(float(x)) for x in query])
        rows = self.stored.read(F.col("list").isin(lists)).select("vec_id", cosine(doubles(F.col("embedding")), vector).alias("score"))
        return rows.orderBy(F.desc(F.round("score", 9)), "vec_id").limit(k)

    def topk_batch(self, queries: DataFrame, k: int = 8, probes: int | None = None) -> DataFrame:
        """``query_id``, ``vec_id``, ``score``, ``rank``: the nearest rows of each of ``queries`` (query_id, vector).

        Queries go out in slices of bounded size.  A task multiplies the rows of a list with the queries that ask for it.
        """
        out, kind = None, dict(queries.dtypes)["query_id"]
        for some in query_slices(queries):
            if not len(some):
                continue
            ids, raw = some["query_id"].to_numpy(), np.array(some["vector"].tolist(), float)
            asked, q = self.asked_lists(raw, probes), unit(raw)
            of = {int(x): np.flatnonzero((asked == x).any(axis=1)) for x in np.unique(asked)}

            def best(batches: Iterator[pd.DataFrame], ids=ids, q=q, of=of) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    for number, rows in batch.groupby("list"):
                        mine = of[int(number)]
                        found, x = NearestRows(q[mine], k), rows["embedding"]
                        found.take_in(rows["vec_id"].to_numpy(), lambda i, j, x=x: x.iloc[i:j].tolist())
                        for columns in found.rows(ids[mine]):
                            yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

            rows = self.stored.read(F.col("list").isin(list(of))).select("vec_id", "embedding", "list")
            part = rows.mapInPandas(best, f"query_id {kind}, vec_id {dict(rows.dtypes)['vec_id']}, score double")
            out = part if out is None else out.union(part)
        if out is None:
            return self.spark.createDataFrame([], f"query_id {kind}, vec_id long, score double, rank int")
        ranked = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
        return out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    def near_pairs(self, threshold: float, probes: int | None = None, block: int = 2000) -> DataFrame:
        """``a`` < ``b``, ``sim``: pairs with cosine ``threshold`` or more of which one lies in a list that the other asks for.

        Rows ask their nearest lists; a list of many rows, or that many ask, is multiplied in blocks of about ``block`` rows
        a side, each a task's group.  ``retrieval.similar_pairs`` is the exact form.
        """
        n, centroids = min(probes or self.probes, len(self.centroids)), self.centroids
        rows = cut(self.stored.read().select("vec_id", "embedding", "list"), self.spark)
        kind = dict(rows.dtypes)["vec_id"]

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array(batch.column("embedding").to_pylist(), float).reshape(batch.num_rows, -1)
                near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :n] if len(x) else np.zeros((0, n))
                at = np.repeat(np.arange(batch.num_rows), n)
                some = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("embedding"), pa.array(near.ravel().astype(np.int32))], ["vec_id", "embedding", "list"])

        asks = rows.select("vec_id", "embedding").mapInArrow(ask, f"vec_id {kind}, embedding array<float>, list int")
        asks = cut(asks, self.spark)
        blocks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
        sizes = F.broadcast(blocks(rows, "own_blocks").join(blocks(asks, "asking_blocks"), "list"))  # a row a list
        side = lambda df, own, other, mine: (
            df.join(sizes, "list").withColumn(mine, F.pmod(F.xxhash64("vec_id"), F.col(f"{mine}_blocks")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))).select("vec_id", "embedding", "list", "own", "asking", F.lit(own).alias("held"))
        )
        sent = side(rows, True, "asking", "own").union(side(asks, False, "own", "asking").select("vec_id", "embedding", "list", "own", "asking", "held"))

        def multiply(some: pd.DataFrame) -> pd.DataFrame:
            left, right = some[some["held"]], some[~some["held"]]
            a, b = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            if not len(a) or not len(b):
                return pd.DataFrame({"a": a[:0], "b": b[:0], "sim": np.zeros(0)})
            sim = unit(np.array(left["embedding"].tolist(), float)) @ unit(np.array(right["embedding"].tolist(), float)).T
            i, j = np.nonzero((sim >= threshold) & (a[:, None] != b[None, :]))
            return pd.DataFrame({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j]), "sim": sim[i, j]})

        found = sent.groupBy("list", "own", "asking").applyInPandas(multiply, f"a {kind}, b {kind}, sim double")
        return found.groupBy("a", "b").agg(F.max("sim").alias("sim"))


def recall(found: DataFrame, exact: DataFrame, on: list[str]) -> float:
    """Share of the rows of ``exact`` that ``found`` has, by the columns ``on``."""
    both = exact.select(*on).join(found.select(*on).withColumn("hit", F.lit(1)), on, "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]
