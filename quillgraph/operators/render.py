"""Answers as markdown.  The rows of an answer are a bounded top-k, so the last step puts them into one text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import excerpt

from .graph import EDGE_PHRASES, by_label

NOTHING = "<!-- nothing found -->"

#: Sections in order: title, explanation, condition on tier and type.
SECTIONS = [
    ("Module Context", "What each folder does.", "tier = '3'"),
    ("File Context", "Exports, imports and role of each file.", "tier = '2'"),
    ("Symbol Details", "Signatures and behaviour.", "tier = '1' AND NOT called"),
    ("Call Relationships", "Symbols reached from other symbols of the answer.", "tier = '1' AND called"),
    ("Path Traces", "How the best of them connect.", "FALSE"),
    ("Concepts & Patterns", "Heuristics and practices.", "tier = '' AND note_type = 'concept'"),
    ("Additional Context", "", "tier = '' AND note_type NOT IN ('concept', 'tool')"),
    ("Tools", "", "note_type = 'tool'"),
]


TRACES = [i for i, (title, _, _) in enumerate(SECTIONS) if title == "Path Traces"][0]


def traces(steps: DataFrame, notes: DataFrame) -> DataFrame:
    """``pair_id``, ``text``: each path of an answer in one line, its notes by their paths."""
    named = steps.join(notes.select(F.col("note_id").alias("node_id"), "path"), "node_id", "left").withColumn("path", F.coalesce("path", "node_id"))
    arrow = F.when(F.col("edge_direction") == "outgoing", "\u2192").otherwise("\u2190")
    phrase = F.concat(arrow, F.lit("["), F.coalesce(by_label(F.col("edge_label"), EDGE_PHRASES), F.lower("edge_label")), F.lit("]"), arrow, F.lit(" "))
    part = F.concat(F.when(F.col("pos") > 0, phrase).otherwise(""), "path")
    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("part"), "path"))), lambda x: F.struct(x["part"], x["path"]))
    lines = named.groupBy("pair_id").agg(line.alias("l"))
    head = F.concat(F.lit("**"), F.get("l", F.lit(0))["path"], F.lit(" \u2192 "), F.element_at("l", -1)["path"], F.lit("**\n"))
    return lines.select("pair_id", F.concat(head, F.array_join(F.transform("l", lambda x: x["part"]), " "), F.lit("\n")).alias("text"))


def context(notes: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """One row ``markdown``: the notes of an answer (path, note_type, tier, score, depth, content) by section and score.

    With ``note_id`` and ``linked_from``, symbols reached from other symbols stand apart.  ``steps`` (of
    ``shortest_paths``) are shown as traces.
    """
    called = F.lit(False)
    if "linked_from" in notes.columns:
        symbols = notes.where("tier = '1'").select(F.col("note_id").alias("linked_from"), F.lit(True).alias("_called")).distinct()
        notes, called = notes.join(F.broadcast(symbols), "linked_from", "left"), F.coalesce("_called", F.lit(False))
    notes = notes.withColumn("called", called)
    number = F.coalesce(*[F.when(F.expr(cond), F.lit(i)) for i, (_, _, cond) in enumerate(SECTIONS)])
    mark = F.when(F.col("depth") == 0, "* | ").otherwise("")
    head = F.concat(F.lit("### "), "path", F.lit(" ("), mark, F.lit("score: "), F.format_number("score", 3), F.lit(")\n"))
    via = F.lit("")
    if {"via", "linked_from"} <= set(notes.columns):
        via = F.coalesce(F.concat(F.lit("_via: "), "linked_from", F.lit(" \u2014["), by_label(F.col("via"), EDGE_PHRASES), F.lit("]\u2192 here_\n")), F.lit(""))
    text = F.concat(head, via, F.coalesce("content", F.lit("")), F.lit("\n"))
    rows = notes.select(number.alias("section"), F.struct((-F.col("score")).alias("s"), "path", text.alias("text")).alias("n"))
    sections = rows.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda x: x["text"]), "\n").alias("body"))
    if steps is not None:
        shown = traces(steps, notes).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pair_id", "text"))), lambda x: x["text"]), "\n").alias("body"))
        sections = sections.union(shown.where("body <> ''").select(F.lit(TRACES), "body"))
    titles = [F.lit(f"## {t}\n" + (f"_{why}_\n" if why else "") + "\n") for t, why, _ in SECTIONS]
    whole = sections.select(F.struct("section", F.concat(F.element_at(F.array(*titles), F.col("section") + 1), "body").alias("text")).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["text"]), "\n")
    return whole.agg(F.when(F.count("*") == 0, NOTHING).otherwise(F.concat(F.lit("# Knowledge Base Context\n\n"), joined)).alias("markdown"))


def discovery(rows: DataFrame, query: str) -> DataFrame:
    """One row ``markdown``: a map of entry points, modules and hubs (``discovery`` rows with path and degree).

    With ``content``, excerpts of the first entry points and modules follow.
    """
    line = F.concat(F.lit("- [["), "note_id", F.lit("]] `"), "path", F.lit("`"), F.when(F.col("kind") == "hub", F.concat(F.lit(" degree="), F.coalesce("degree", F.lit(0)).cast("string"))).otherwise(""))
    order = F.array_position(F.array(*map(F.lit, ("entrypoint", "module", "hub"))), F.col("kind"))
    kinds = rows.groupBy("kind", order.alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    titles = ("## Likely Entrypoints", "## Module Map", "## High-Connectivity Notes", "## Entrypoint Details", "## Module Details")
    title = F.element_at(F.array(*map(F.lit, titles)), F.col("n").cast("int"))
    if "content" in rows.columns:
        for n, (kind, most) in enumerate((("entrypoint", 4), ("module", 6))):
            shown = detail(rows.where(F.col("kind") == kind), most).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
            kinds = kinds.unionByName(shown.where("body <> ''").select(F.lit(f"{kind} details").alias("kind"), F.lit(4 + n).cast("long").alias("n"), "body"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(title, F.lit("\n\n"), "body").alias("text")))), lambda x: x["text"])
    return kinds.agg(F.concat(F.lit(f'## Discovery Mode\nQuery: "{query}"\n\n'), F.array_join(parts, "\n\n")).alias("markdown"))


def within_budget(markdown: F.Column, max_chars: int = 15_000) -> F.Column:
    """An answer cut to its budget (500 characters at least), saying so."""
    most = max(500, max_chars)
    return F.when(F.length(markdown) <= most, markdown).otherwise(F.concat(F.substring(markdown, 1, most), F.lit("\n\n[truncated]")))


def wire(notes: DataFrame) -> DataFrame:
    """Retrieved notes as JSON lines; empty strings become null."""
    cols = [F.when(F.col(c) != "", F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in notes.dtypes]
    return notes.select(F.to_json(F.struct(*cols)).alias("json"))


def detail(notes: DataFrame, most: int = 4) -> DataFrame:
    """Excerpts of the first notes of a list (pos, note_id, content)."""
    return notes.orderBy("pos").limit(most).select("pos", F.concat(F.lit("### "), "note_id", F.lit("\n"), excerpt(F.col("content"))).alias("text"))
