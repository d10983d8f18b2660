"""Edges from both ends, stored once for walks of several hops, which then move the frontier and not the edges.

A frontier of a checked size goes out to all tasks, which read the stored edges where they are.  Beyond it, the edges are
stored again, bucketed by node, and each hop deals out the frontier only.  A node with a large share of all edges has
its edges in several parts, and stands in the frontier once for each, so that no hub fills a task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Rows of a frontier that are sent to every executor at most.
SENT_ROWS = 1_000_000
#: Nodes with more than one in so many edge ends are hubs; fewer than so many exist.
HUBS = 1024


def adjacency(edges: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """``node``, ``neighbour``, ``label``, ``direction``: every edge from both ends; only some labels if given.  One pass over the edges."""
    kept = edges.where(F.col("label").isin(labels)) if labels else edges
    end = lambda node, neighbour, direction: F.struct(F.col(node).alias("node"), F.col(neighbour).alias("neighbour"), "label", F.lit(direction).alias("direction"))
    return kept.select(F.explode(F.array(end("src", "dst", "outgoing"), end("dst", "src", "incoming"))).alias("e")).select("e.*")


def stored(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """``df`` written as Parquet and read back, with its number of rows, counted while writing."""
    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


class StoredAdjacency:
    def __init__(self, edges: DataFrame, folder: str, labels: list[str] | None = None):
        self.spark, self.folder = edges.sparkSession, folder
        self.near, self.rows = stored(adjacency(edges, labels), f"{folder}/near")
        self.bucketed: DataFrame | None = None
        self.hubs: DataFrame | None = None

    def hop(self, frontier: DataFrame, count: int, node: str = "node_id") -> DataFrame:
        """``frontier`` (of ``count`` rows) with each node's ``neighbour``, ``label`` and ``direction``."""
        if count <= SENT_ROWS:
            return self.near.join(F.broadcast(frontier), F.col("node") == F.col(node)).drop("node")
        self._bucket()
        asked = frontier.join(F.broadcast(self.hubs), F.col(node) == F.col("hub"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
        # merged by sorted buckets: a broadcast or a hash table isn't for frontiers of this size
        return self.bucketed.hint("merge").join(asked, (F.col("node") == F.col(node)) & (F.col("part") == F.col("_part"))).drop("node", "part", "_part", "hub", "pieces")

    def _bucket(self) -> None:
        if self.bucketed is not None:
            return
        least = max(1, self.rows // HUBS)
        degree = self.near.groupBy(F.col("node").alias("hub")).agg(F.count("*").alias("n")).where(F.col("n") > least)
        self.hubs, _ = stored(degree.select("hub", F.ceil(F.col("n") / least).cast("int").alias("pieces")), f"{self.folder}/hubs")
        parts = self.near.join(F.broadcast(self.hubs), F.col("node") == F.col("hub"), "left").withColumn("part", F.pmod(F.xxhash64("neighbour"), F.coalesce("pieces", F.lit(1))).cast("int")).drop("hub", "pieces")
        buckets, self.name = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"adjacency_{uuid.uuid4().hex}"
        parts.repartition(buckets, "node", "part").write.bucketBy(buckets, "node", "part").sortBy("node", "part").option("path", f"{self.folder}/bucketed").saveAsTable(self.name)
        self.bucketed = self.spark.table(self.name)

    def close(self) -> None:
        """Forget the bucketed table's name; its files stay in the folder."""
        if self.bucketed is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            self.bucketed = None


def sized(df: DataFrame, count: int) -> DataFrame:
    """``df`` marked to be sent out if it is small enough."""
    return F.broadcast(df) if count <= SENT_ROWS else df


def anti(rows: DataFrame, others: list[tuple[DataFrame, int]], on: list[str]) -> DataFrame:
    """``rows`` without those of ``others`` (each with its number of rows)."""
    for df, count in others:
        rows = rows.join(sized(df.select(*on), count), on, "left_anti")
    return rows

