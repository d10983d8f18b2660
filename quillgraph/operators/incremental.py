"""Incremental maintenance: snapshot diffs, deltas, stale outputs, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """``rel_path``, ``change`` (new, changed, deleted) of two snapshots (rel_path, mtime, size); unchanged paths are left out."""
    a = current.select("rel_path", F.struct("mtime", "size").alias("now"))
    b = previous.select("rel_path", F.struct("mtime", "size").alias("was"))
    kind = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(~F.col("now").eqNullSafe(F.col("was")), "changed")
    return a.join(b, "rel_path", "full_outer").select("rel_path", kind.alias("change")).where("change IS NOT NULL")


def apply_delta(notes: DataFrame, upserts: DataFrame, deletes: DataFrame, key: str = "note_id", force: bool = False) -> DataFrame:
    """``notes`` after a delta: deleted and replaced rows go, upserts come in; those with an unchanged ``hash`` stay as they were.

    ``force``: take every upsert.
    """
    fresh = upserts if force else upserts.join(notes.select(key, "hash"), [key, "hash"], "left_anti")
    gone = deletes.select(key).union(fresh.select(key)).distinct()
    return notes.join(gone, key, "left_anti").unionByName(fresh)


def delta_counts(notes: DataFrame, upserts: DataFrame, deletes: DataFrame, key: str = "note_id") -> DataFrame:
    """``change`` (added, updated, removed) and ``n``."""
    both = upserts.select(key, F.col("hash").alias("new_hash")).join(notes.select(key, "hash"), key, "left")
    kinds = both.select(F.when(F.col("hash").isNull(), "added").when(F.col("hash") != F.col("new_hash"), "updated").alias("change"))
    removed = deletes.join(notes.select(key), key, "left_semi").select(F.lit("removed").alias("change"))
    return kinds.where("change IS NOT NULL").union(removed).groupBy("change").agg(F.count("*").alias("n"))


def stale(existing: DataFrame, valid: DataFrame, key: str = "path") -> DataFrame:
    """Outputs that no source stands behind any more.  Without any valid path nothing is stale: a failed run deletes nothing."""
    some = valid.select(F.lit(1).alias("_one")).limit(1)
    return existing.join(valid.select(key).distinct(), key, "left_anti").join(F.broadcast(some)).drop("_one")


def corpus_fingerprint(notes: DataFrame, *by: str) -> DataFrame:
    """``n_notes``, ``fingerprint``: changes if any path or body does, whatever the order; a sum, so it combines before it shuffles."""
    digest = F.md5(F.concat_ws(":", "note_id", F.md5("body")))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    return notes.groupBy(*by).agg(F.count("*").alias("n_notes"), F.sum(number).cast("string").alias("fingerprint"))
