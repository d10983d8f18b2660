"""Parsed notes from raw markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T


def parse_notes(raw: DataFrame) -> DataFrame:
    """Note columns of raw notes (workspace, note_id, text), all by column functions."""
    front, body = T.split_front(F.col("text"))
    rows = raw.withColumns({"_front": front, "body": body})
    f, path = F.col("_front"), F.col("note_id")
    first = lambda *keys: F.coalesce(*[T.front_field(f, k) for k in keys])
    tier = T.front_field(f, "tier")
    kind = T.note_type(first("type", "note_type"), path)
    return rows.select(
        "workspace",
        "note_id",
        path.alias("path"),
        T.title(T.front_field(f, "title"), F.col("body"), path).alias("title"),
        kind.alias("note_type"),
        F.coalesce(F.when(tier.isin(*T.TIERS), tier), F.lit("")).alias("tier"),
        T.tag_list(T.front_list(f, "tags")).alias("tags"),
        F.coalesce(first("symbolKind"), F.lit("")).alias("symbol_kind"),
        first("parentFile").alias("parent_file"),
        first("parentModule").alias("parent_module"),
        F.coalesce(F.regexp_replace(first("path"), "^/+|/+$", ""), T.dir_name(path)).alias("source_dir"),
        first("time_created", "created").alias("time_created"),
        first("last_edited", "updated").alias("last_edited"),
        "body",
        F.when(kind == "tool", F.coalesce(first("tool_id"), T.stem(path))).alias("tool_id"),
        T.wikilinks(F.col("body")).alias("links_out"),
        F.md5("text").alias("hash"),
    )
