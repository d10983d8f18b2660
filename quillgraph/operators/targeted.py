"""Targeted retrieval: seeds by vectors or keywords, what their graph adds, and how the best of them connect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T

from . import graph, retrieval

ROWS = ["note_id", "role", "score", "depth", "linked_from", "via", "pos"]


#: The best notes (note_id, score) of a query by its words, so many of them.
Keywords = Callable[[str, int], DataFrame]


def seeds_of(notes: DataFrame, hits: DataFrame | None, query: str, k: int = 8, keywords: Keywords | None = None) -> DataFrame:
    """``note_id``, ``score``, ``pos`` of the seeds: the notes of the vector ``hits`` (note_id, score; a top-k) with their
    tags' boost, or the best by keywords where there are no hits (``keywords``: a stored index's, else by reading the notes)."""
    seeds = None
    if hits is not None:
        seeds = graph.cut(retrieval.boosted_seeds(hits, notes, T.tokens(F.lit(query))).select("note_id", "score"), notes.sparkSession)
        if not seeds.limit(1).count():
            seeds = None
    if seeds is None:
        seeds = graph.cut(keywords(query, k) if keywords else retrieval.keyword_topk(notes, query, k), notes.sparkSession)
    order = Window.orderBy(F.desc(F.round("score", 9)), "note_id")  # of k rows
    return seeds.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def targeted(
    notes: DataFrame,
    edges: DataFrame,
    hits: DataFrame | None,
    query: str,
    k: int = 8,
    depth: int = 0,
    similarity: Callable[[Column], Column] | None = None,
    most: int = 50,
    keywords: Keywords | None = None,
) -> tuple[DataFrame, DataFrame]:
    """An answer's rows (``ROWS``) and the steps of the paths between its first three seeds.

    ``role``: seed; path (on a shortest path between two of the first three, not a seed; ``linked_from`` its pair's
    start, ``depth`` 1); neighbour (``depth`` > 0 only: reached from the seeds over the graph, see ``graph.expand``, and
    neither of the others; the ``most`` best by score).  ``notes``: note_id, title, tags, path, body, note_type, and tier and name_tokens for
    ``depth``.  A row of each note; ``pos`` counts within the role.
    """
    seeds = graph.cut(seeds_of(notes, hits, query, k, keywords), notes.sparkSession)
    pairs = graph.seed_pairs(seeds)
    steps = graph.cut(graph.shortest_paths(edges, pairs), notes.sparkSession)
    none = F.lit(None).cast("string")
    out = seeds.select("note_id", F.lit("seed").alias("role"), "score", F.lit(0).alias("depth"), none.alias("linked_from"), none.alias("via"), "pos")
    known = notes.where("note_type <> 'index'").select("note_id")
    found = graph.path_notes(steps).join(seeds.select("note_id"), "note_id", "left_anti").join(notes.select("note_id"), "note_id", "left_semi")
    found = found.join(pairs.select("pair_id", F.col("start").alias("linked_from")), "pair_id")
    place = F.row_number().over(Window.orderBy("pair_id", F.col("pos")))  # of three paths
    found = found.select("note_id", F.lit("path").alias("role"), "score", F.lit(1).alias("depth"), "linked_from", none.alias("via"), place.alias("pos"))
    out = out.unionByName(found)
    if depth:
        more = graph.expand(edges, notes.join(known, "note_id", "left_semi"), seeds, T.tokens(F.lit(query)), depth, similarity=similarity)
        more = more.join(out.select("note_id"), "note_id", "left_anti").orderBy(F.desc(F.round("score", 9)), "note_id").limit(most)
        place = F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "note_id"))
        out = out.unionByName(more.select("note_id", F.lit("neighbour").alias("role"), "score", "depth", "linked_from", F.col("label").alias("via"), place.alias("pos")))
    return out.select(*ROWS), steps
