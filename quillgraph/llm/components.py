"""Connected components of links by alternating large and small stars, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import shared_path


def star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over ``u``, ``v``; every edge out points to a smaller node, none repeats.

    Each step is an aggregation that combines before it shuffles and a join that Spark may split where a node is hot.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return small.union(least.select("u", F.col("m").alias("v"))).distinct()


def counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` written to the shared folder, with their number and a sum of their hashes, taken while writing."""
    spark, path, seen = edges.sparkSession, shared_path(edges.sparkSession, "links"), Observation()
    few = edges.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    few.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).write.parquet(path)
    return spark.read.schema("u long, v long").parquet(path), (seen.get["n"], seen.get["h"])


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (the smallest node of its component) for every node of ``edges`` (``u``, ``v``) but the labels themselves."""
    now, state = counted(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while state != before and state[0]:
        before = state
        now, state = counted(star(now))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
