"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix (operator 8).

How many rows go from each input partition to each shard is drawn first, from the law that a uniform random permutation
of all rows would give: row after row of the matrix is a multivariate hypergeometric draw from the room left in the
shards.  Each partition permutes its rows and deals them out by its row of the matrix, the rows are exchanged, and each
shard permutes what it got.  Only the matrix (partitions x shards integers) is made on the driver.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import null_to_empty, table, written

IN_PARTITION = (1 << 33) - 1
PI = Decimal("3.14159265358979323846264338327950288419716939937511")


def communication_matrix(rows: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows to send from each partition to each shard; column sums differ by one at most."""
    rng = np.random.default_rng(seed)
    total = int(rows.sum())
    room = np.full(shards, total // shards, np.int64)
    room[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(rows), shards), np.int64)
    for i, n in enumerate(rows.tolist()):
        left = int(room.sum())
        if n == left:
            out[i] = room
        else:
            # one hypergeometric draw for each shard: how many of the n rows fall into its room
            need = n
            for s in range(shards):
                left -= int(room[s])
                out[i, s] = need if left == 0 else draw(rng, int(room[s]), left, need)
                need -= int(out[i, s])
        room -= out[i]
    return out


def log_factorial(n: int) -> Decimal:
    """log(n!) to 25 digits behind the point: Stirling's series, from 64 up."""
    if n < 64:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    series = sum(Decimal(a) / (b * x**k) for a, b, k in ((1, 12, 1), (-1, 360, 3), (1, 1260, 5), (-1, 1680, 7), (1, 1188, 9), (-691, 360360, 11), (1, 156, 13)))
    return (x + Decimal("0.5")) * x.ln() - x + Decimal("0.5") * (2 * PI).ln() + series


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric number of any size: how many of ``n`` rows drawn from ``good`` and ``bad`` ones are good.

    numpy draws it for populations under 10**9 of each kind.  Beyond, points are drawn evenly from the table-mountain
    that covers the region of the ratio of uniforms (Stadlober's constants) and kept where they lie in it; chances are
    worked out in decimals, as the doubles of large logarithms would be too coarse.
    """
    if n == 0 or good == 0:
        return 0
    if max(good, bad) < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    with localcontext(prec=50):
        total = good + bad
        chance = lambda k: -sum(log_factorial(x) for x in (k, good - k, n - k, bad - n + k))
        mode = chance((n + 1) * (good + 1) // (total + 2))
        mean = n * good / total
        width = 2 * math.sqrt(2 / math.e) * math.sqrt(mean * (bad / total) * ((total - n) / (total - 1)) + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
        while True:
            u, v = 1 - rng.random(), rng.random()
            k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
            if max(0, n - bad) <= k <= min(good, n) and 2 * Decimal(u).ln() <= chance(k) - mode:
                return k


def uniform(key: Column, buckets: int) -> Column:
    """Bucket 0 to ``buckets - 1`` of a 64-bit hash, in the order of the hash."""
    return F.floor((key.cast("double") / 2.0**64 + 0.5) * buckets).cast("long").cast("int") % F.lit(buckets)


def shuffle_to_shards(df: DataFrame, shards: int = 16, seed: int = 8, block: int = 20_000) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards - 1``; sizes at most one apart) and ``slot`` (0, 1, ... within the shard).

    Every assignment of rows to shards and slots is equally likely over seeds; the seed and the input's partitions decide it.
    Columns of ``df`` with these names are replaced.  Rows may repeat and any column may be null: a row is known by its place in its partition, which is written down
    (the rows go to the shared folder once) before anything is drawn, so lost executors can't change the outcome.
    Slots are worked out in blocks of about ``block`` rows, so no task holds a whole shard.  An empty input gives no rows.
    """
    spark = df.sparkSession
    # the rows go along as one column, so no name of theirs can clash
    placed = df.select(F.struct("*").alias("row")).withColumn("_p", F.spark_partition_id()).withColumn("_key", F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
    placed = placed.sortWithinPartitions("_key").withColumn("_rank", F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION)))
    placed = written(placed.drop("_key"), "shards")
    sizes = placed.groupBy("_p").count().orderBy("_p").toPandas()
    matrix = communication_matrix(sizes["count"].to_numpy(np.int64), shards, seed)
    cuts = list(zip(sizes["_p"].tolist(), np.cumsum(matrix, axis=1)[:, :-1].tolist(), strict=True))
    cuts = spark.createDataFrame(cuts, "_p int, _cuts array<bigint>")
    blocks = max(1, -(-int(sizes["count"].sum()) // (shards * block)))
    sent = placed.join(cuts, "_p").withColumn("shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_rank")))).drop("_cuts")
    sent = sent.withColumn("_key", F.xxhash64(F.lit(~seed), "_p", "_rank")).withColumn("_block", uniform(F.col("_key"), blocks))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", "_block").count().select("shard", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_block").orderBy("_key", "_p", "_rank")
    return (
        sent.join(offsets, ["shard", "_block"])
        .withColumn("slot", F.col("_offset") + F.row_number().over(within) - 1)
        .select(*[F.col("row")[c].alias(c) for c in df.columns if c not in ("shard", "slot")], "shard", "slot")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = null_to_empty()
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return shuffle_to_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
