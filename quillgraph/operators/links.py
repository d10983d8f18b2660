"""Resolution of link targets to notes: equi-joins on path suffixes and stems, best match first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import stem

# Of several notes with a suffix the first of these types wins; types not listed come last.
TYPE_PRIORITY = ["tool", "concept", "codeUnit", "codeSymbol", "index", "codebase"]


def type_rank(note_type: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, TYPE_PRIORITY)), note_type)
    return F.when(at == 0, 99).otherwise(at - 1)


def suffix_index(notes: DataFrame) -> DataFrame:
    """``workspace``, ``key``, ``note_id``: the best note for every path suffix, with and without .md, and ``stem:`` name."""
    parts = F.split("note_id", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    bare = F.transform(suffixes, lambda s: F.regexp_replace(s, r"\.md$", ""))
    keys = F.array_distinct(F.concat(suffixes, bare, F.array(F.concat(F.lit("stem:"), F.lower(stem(F.col("note_id")))))))
    rows = notes.select("workspace", "note_id", "note_type", F.explode(keys).alias("key"))
    best = rows.groupBy("workspace", "key").agg(F.min(F.struct(type_rank(F.col("note_type")).alias("r"), F.col("note_id"))).alias("best"))
    return best.select("workspace", "key", F.col("best.note_id").alias("note_id"))


def resolve_links(links: DataFrame, notes: DataFrame, link_prefix: str = "") -> DataFrame:
    """``links`` (workspace, target, ...) with ``note_id`` and ``how`` (exact, md, suffix, stem); both null if nothing fits.

    A target is looked up as a note id, with .md, as a path suffix and last by its stem in any case.  All four are
    lookups of one key each; targets are resolved once however often they occur.  Both joins are merged, never sent out:
    exploded and grouped rows are many more than their estimated size says, and the driver would hold them all.
    """
    target = F.when(F.col("target").startswith(link_prefix), F.substring("target", len(link_prefix) + 1, 1 << 20)).otherwise(F.col("target")) if link_prefix else F.col("target")
    targets = links.select("workspace", "target").distinct()
    tries = targets.select(
        "workspace",
        "target",
        F.posexplode(
            F.array(
                F.struct(F.lit("exact").alias("how"), F.concat(F.lit("id:"), target).alias("key")),
                F.struct(F.lit("md").alias("how"), F.concat(F.lit("id:"), target, F.lit(".md")).alias("key")),
                F.struct(F.lit("suffix").alias("how"), target.alias("key")),
                F.struct(F.lit("stem").alias("how"), F.concat(F.lit("stem:"), F.lower(stem(target))).alias("key")),
            )
        ).alias("pos", "t"),
    ).select("workspace", "target", "pos", "t.how", "t.key")
    ids = notes.select("workspace", F.concat(F.lit("id:"), "note_id").alias("key"), "note_id")
    found = tries.join(ids.union(suffix_index(notes).select("workspace", "key", "note_id")).hint("merge"), ["workspace", "key"])
    best = found.groupBy("workspace", "target").agg(F.min_by(F.struct("note_id", "how"), "pos").alias("b"))
    return links.join(best.hint("merge"), ["workspace", "target"], "left").select(*links.columns, "b.note_id", "b.how")
