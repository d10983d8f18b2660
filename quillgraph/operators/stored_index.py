"""Stored indexes: rows in Parquet, one folder for each part that a question may ask for, taken in by generations.

A generation adds rows and may take ids away from earlier ones; it counts once its marker is written, so that a failed
write is never read.  Nothing is overwritten.  ``compacted`` writes all that counts as one generation elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources.files import stored_paths

#: Rows that one file holds, about: larger parts are dealt out to several tasks.
FILE_ROWS = 1_000_000
#: Ids taken away that are sent to every executor at most; more are joined by a shuffle.
SENT_IDS = 1_000_000


class StoredIndex:
    """``rows`` below ``path``, by generation and ``part``.  ``key``: the column by which rows are taken away again."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, part: str = "part"):
        self.spark, self.path, self.key, self.part = spark, path.rstrip("/"), key, part
        self.schema = f"{schema}, generation int, {part} int"

    def generations(self) -> list[int]:
        return [int(p.rpartition("=")[2]) for p in stored_paths(self.spark, f"{self.path}/done/generation=*")]

    def add(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """Take in ``rows`` (with their part) and take away what earlier generations hold of the keys ``gone``; the generation's number.

        A part of many rows is dealt out to several tasks by a hash of its rows' keys, so that a hot one fills none.
        """
        done = self.generations()
        number = (done[-1] if done else 0) + 1
        while stored_paths(self.spark, f"{self.path}/*/generation={number}"):  # left by a write that failed
            number += 1
        rows = rows.persist()
        try:
            sizes = rows.groupBy(self.part).agg(F.ceil(F.count("*") / FILE_ROWS).alias("pieces")).where("pieces > 1")
            few = rows.join(F.broadcast(sizes.limit(100_000)), self.part, "left")
            dealt = few.withColumn("_piece", F.pmod(F.xxhash64(self.key), F.coalesce("pieces", F.lit(1)))).repartition(self.part, "_piece").drop("pieces", "_piece")
            dealt.sortWithinPartitions(self.part, *[c for c in ("token",) if c in rows.columns]).write.partitionBy(self.part).parquet(f"{self.path}/rows/generation={number}")
        finally:
            rows.unpersist()
        if gone is not None:
            gone.select(self.key).distinct().write.parquet(f"{self.path}/gone/generation={number}")
        self.spark.range(1).coalesce(1).write.parquet(f"{self.path}/done/generation={number}")
        return number

    def read(self, asked: Column | None = None) -> DataFrame:
        """All rows that count; ``asked``: a condition on parts and columns, which prunes folders and reaches the scan."""
        done = self.generations()
        if not done:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/generation={n}" for n in done])
        rows = rows if asked is None else rows.where(asked)
        gone = [p for p in stored_paths(self.spark, f"{self.path}/gone/generation=*") if int(p.rpartition("=")[2]) in done]
        if gone:
            kind = dict(rows.dtypes)[self.key]
            ids = self.spark.read.schema(f"{self.key} {kind}, generation int").option("basePath", f"{self.path}/gone").parquet(*gone)
            last = ids.groupBy(self.key).agg(F.max("generation").alias("_gone"))
            last = F.broadcast(last) if ids.count() <= SENT_IDS else last
            rows = rows.join(last, self.key, "left").where(F.col("_gone").isNull() | (F.col("generation") >= F.col("_gone"))).drop("_gone")
        return rows

    def compacted(self, path: str) -> StoredIndex:
        """All that counts as one generation of a new index."""
        out = StoredIndex(self.spark, path, self.schema.rpartition(", generation")[0], self.key, self.part)
        out.add(self.read().drop("generation"))
        return out
