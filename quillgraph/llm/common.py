"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the digest contracts: runs of anything but space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of ids or digests that are broadcast at most (16 to 100 MB); more are joined by a shuffle.
SENT_ROWS = 1_000_000


def shared_root(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``, or one made for a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def give_back() -> None:
    """Hand freed memory back to the system.  Python workers live on from task to task, beside others of their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


class _Made(threading.local):
    """Paths made by the operators called in a thread: what one thread's pipeline clears, another's query doesn't read."""

    def __init__(self):
        self.paths: list[str] = []


_MADE = _Made()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    _MADE.paths.append(f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE.paths[-1]


def mark_shared() -> int:
    """A place in the list of paths made in this thread, for ``clean_shared``."""
    return len(_MADE.paths)


def clean_shared(spark: SparkSession, mark: int = 0, keep: str | None = None) -> None:
    """Delete what the operators have written to the shared folder in this thread since ``mark``, but for ``keep``.

    Results of that time which aren't stored elsewhere yet are lost.
    """
    made, _MADE.paths[mark:] = _MADE.paths[mark:], []
    for path in made:
        if path != keep:
            delete_path(spark, path)
    if keep in made:
        _MADE.paths.append(keep)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return [x.getPath().toString() for x in found or []]


def written(df: DataFrame, name: str = "table", fewer: int = 1) -> DataFrame:
    """``df`` written once to the shared folder as zstd Parquet and read back: cuts lineage, survives lost executors.

    ``fewer``: deal the rows out to a fraction of the shuffle partitions' number of files, for tables much smaller than
    the input (every file costs several calls to the file system).  This is a shuffle, not ``coalesce``: a task that
    computes many partitions one after the other keeps the sort buffers of their joins until it ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    if fewer > 1:
        df = df.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // fewer))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_to_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))

