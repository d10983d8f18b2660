"""Typed note graphs: ``edges`` (src, label, dst), distinct; ``notes`` (note_id, tier, path, tags, ...)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.vectors import triple_factor
from quillgraph.operators.adjacency import StoredAdjacency, adjacency, anti, sized, stored

# How much of a score passes over an edge, and how an edge reads.
EDGE_WEIGHTS = {"CALLS": 0.80, "CONTAINS_SYMBOL": 0.85, "DEFINED_IN": 0.70, "CONTAINS": 0.70, "IMPORTS": 0.60, "LINKS_TO": 0.50, "BELONGS_TO": 0.40}
EDGE_PHRASES = {
    "CALLS": "calls",
    "CONTAINS_SYMBOL": "contains",
    "DEFINED_IN": "is defined in",
    "CONTAINS": "contains file",
    "IMPORTS": "imports",
    "LINKS_TO": "links to",
    "BELONGS_TO": "belongs to",
}
#: Edge labels in the order in which ties are broken.
LABEL_ORDER = list(EDGE_WEIGHTS)


def by_label(label: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), label)


def label_rank(label: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LABEL_ORDER)), label)


def note_edges(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Typed edges of parsed notes.

    ``notes``: note_id, tier ('' if none), parent_file, parent_module (resolved note ids or null), source_dir (of tier 3).
    ``links``: src, dst (resolved).  Symbols are defined in files and files belong to modules, with the inverse edges;
    links between symbols are calls, between files imports, between a module and its direct child containment, else links.
    """
    up = notes.select("note_id", "tier", "parent_file", "parent_module")
    kinds = [("1", "parent_file", "DEFINED_IN", "CONTAINS_SYMBOL"), ("2", "parent_module", "BELONGS_TO", "CONTAINS")]
    out = None
    for tier, parent, to, back in kinds:
        rows = up.where((F.col("tier") == tier) & F.col(parent).isNotNull())
        pair = rows.select(
            F.explode(
                F.array(
                    F.struct(F.col("note_id").alias("src"), F.lit(to).alias("label"), F.col(parent).alias("dst")),
                    F.struct(F.col(parent).alias("src"), F.lit(back).alias("label"), F.col("note_id").alias("dst")),
                )
            ).alias("e")
        ).select("e.*")
        out = pair if out is None else out.union(pair)
    side = lambda c: notes.select(F.col("note_id").alias(c), F.col("tier").alias(f"{c}_tier"), F.col("source_dir").alias(f"{c}_dir"))
    typed = links.where("src <> dst").join(side("src"), "src").join(side("dst"), "dst")
    same = lambda t: (F.col("src_tier") == t) & (F.col("dst_tier") == t)
    child = lambda a, b: F.coalesce(is_child(F.col(f"{a}_dir"), F.col(f"{b}_dir")), F.lit(False))
    label = (
        F.when(same("1"), "CALLS").when(same("2"), "IMPORTS").when(same("3") & child("dst", "src"), "CONTAINS").when(same("3") & child("src", "dst"), "BELONGS_TO")
    ).otherwise("LINKS_TO")
    typed = typed.select("src", label.alias("label"), "dst")
    inverse = typed.where(F.col("label").isin("CONTAINS", "BELONGS_TO")).select(
        F.col("dst").alias("src"), F.when(F.col("label") == "CONTAINS", "BELONGS_TO").otherwise("CONTAINS").alias("label"), F.col("src").alias("dst")
    )
    return out.union(typed).union(inverse).where("src <> dst").distinct()


def is_child(child: Column, parent: Column) -> Column:
    """Whether folder ``child`` lies directly in ``parent`` ('.': the top)."""
    above = F.when(child.contains("/"), F.regexp_replace(child, "/[^/]*$", "")).otherwise(".")
    return (child != ".") & (above == parent)


def degrees(edges: DataFrame, notes: DataFrame, visits: bool = True) -> DataFrame:
    """``note_id``, ``degree`` of the notes given.

    ``visits``: an edge with both ends among the notes counts twice at either end, with one end once; else each once.
    """
    inside = notes.select("note_id").distinct()
    ends = edges.join(inside.select(F.col("note_id").alias("src"), F.lit(1).alias("a")), "src", "left").join(
        inside.select(F.col("note_id").alias("dst"), F.lit(1).alias("b")), "dst", "left"
    )
    weight = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 2 if visits else 1).otherwise(1)
    both = ends.where("a IS NOT NULL OR b IS NOT NULL").select(
        F.explode(F.array(F.when(F.col("a") == 1, F.col("src")), F.when(F.col("b") == 1, F.col("dst")))).alias("note_id"), weight.alias("w")
    )
    return both.where("note_id IS NOT NULL").groupBy("note_id").agg(F.sum("w").alias("degree"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one of a local session."""
    if not spark.sparkContext.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="quillgraph-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, spark: SparkSession) -> DataFrame:
    """``df`` with its lineage cut: a reliable checkpoint in the shared folder."""
    shared_folder(spark)
    return df.checkpoint()


def shortest_paths(edges: DataFrame, pairs: DataFrame, labels: list[str] | None = None, max_depth: int = 8) -> DataFrame:
    """Steps of one shortest path for each of ``pairs`` (pair_id, start, end), undirected, at most ``max_depth`` hops.

    Columns pair_id, pos, node_id, edge_label, edge_direction, from_node_id; pos 0 is the start.  Pairs without a path
    have no rows.  Of several parents the smallest (node, label order, direction) is taken.  All pairs advance together,
    a level a hop: the stored edges are joined with the frontier.  Edges go both ways, so that a level's neighbours lie
    in it, in the one before or in the next: only these two are taken out.  Levels hold nodes only, which are made distinct
    by hash; parents are looked up on the way back, for a node a pair.
    """
    spark, folder = edges.sparkSession, scratch_path(edges.sparkSession, "paths")
    near = StoredAdjacency(edges, f"{folder}/edges", labels)
    start = pairs.select("pair_id", F.col("start").alias("node_id"), F.lit(0).alias("pos"), (F.col("start") == F.col("end")).alias("is_end"))
    levels = [stored(start, f"{folder}/level-0")]
    ends = sized(pairs.select("pair_id", "end"), levels[0][1])
    for hop in range(1, max_depth + 1):
        frontier, count = levels[-1]
        closed = reduce(DataFrame.union, [df.where("is_end").select("pair_id") for df, _ in levels])
        live = frontier.join(sized(closed, levels[0][1]), "pair_id", "left_anti").select("pair_id", "node_id")
        step = near.hop(live, count).select("pair_id", F.col("neighbour").alias("node_id"))
        step = anti(step, levels[-2:], ["pair_id", "node_id"]).distinct().join(ends, "pair_id")
        step = step.select("pair_id", "node_id", F.lit(hop).alias("pos"), (F.col("node_id") == F.col("end")).alias("is_end"))
        level = stored(step, f"{folder}/level-{hop}")
        if not level[1]:
            break
        levels.append(level)
    found = walk_back(near, levels, folder)
    near.close()
    return found


def walk_back(near: StoredAdjacency, levels: list[tuple[DataFrame, int]], folder: str) -> DataFrame:
    """From each pair's end to its start along the smallest parents, a level at a time from the last one that was reached."""
    out, want, pairs = [], None, levels[0][1]
    none = F.lit(None).cast("string")
    for pos in reversed(range(len(levels))):
        here = levels[pos][0].where("is_end").select("pair_id", "node_id")
        if want is not None:  # a row a pair at most
            here = here.union(want)
        if pos:
            # an edge seen from its other end
            direction = F.when(F.col("direction") == "outgoing", "incoming").otherwise("outgoing")
            via = F.struct(F.col("neighbour").alias("node"), label_rank(F.col("label")).alias("r"), direction.alias("d"), "label")
            above = levels[pos - 1][0].select("pair_id", F.col("node_id").alias("neighbour"))
            parents = near.hop(here, pairs).select("pair_id", "node_id", "neighbour", via.alias("via"))
            best = parents.join(above.hint("merge"), ["pair_id", "neighbour"], "left_semi").groupBy("pair_id", "node_id").agg(F.min("via").alias("v"))
            here = best.select("pair_id", F.lit(pos).alias("pos"), "node_id", F.col("v.label").alias("edge_label"), F.col("v.d").alias("edge_direction"), F.col("v.node").alias("from_node_id"))
        else:
            here = here.select("pair_id", F.lit(0).alias("pos"), "node_id", none.alias("edge_label"), F.lit("").alias("edge_direction"), none.alias("from_node_id"))
        here, _ = stored(here, f"{folder}/steps-{pos}")
        out.append(here)
        want = here.select("pair_id", F.col("from_node_id").alias("node_id")) if pos else None
    return reduce(DataFrame.union, out)


def triple_text(label: Column, direction: Column, title: Column, neighbour: Column) -> Column:
    """An edge as a phrase, from its source to its target: "a calls b"."""
    phrase = F.coalesce(by_label(label, EDGE_PHRASES), F.lower(label))
    out = direction == "outgoing"
    return F.concat_ws(" ", F.when(out, title).otherwise(neighbour), phrase, F.when(out, neighbour).otherwise(title))


def path_notes(steps: DataFrame) -> DataFrame:
    """Notes of shortest paths (``shortest_paths``), each once, from the first pair that meets it.

    ``note_id``, ``pair_id``, ``pos``, ``score``: 1 at a path's ends, half as much in its middle, at least 0.5.
    """
    length = steps.groupBy("pair_id").agg(F.max("pos").alias("length"))
    near = F.least("pos", F.col("length") - F.col("pos")) / F.greatest("length", F.lit(1))
    scored = steps.join(length, "pair_id").select("node_id", "pair_id", "pos", F.greatest(F.lit(0.5), 1 - near * 0.5).alias("score"))
    return scored.groupBy("node_id").agg(F.min(F.struct("pair_id", "pos", "score")).alias("f")).select(F.col("node_id").alias("note_id"), "f.*")


def seed_pairs(seeds: DataFrame, most: int = 3) -> DataFrame:
    """``pair_id`` (10 * first + second), ``start``, ``end`` of the first ``most`` seeds (note_id, pos), 9 at most."""
    few = seeds.where(F.col("pos") <= most)
    a, b = few.select(F.col("note_id").alias("start"), F.col("pos").alias("i")), few.select(F.col("note_id").alias("end"), F.col("pos").alias("j"))
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).select((10 * F.col("i") + F.col("j")).cast("int").alias("pair_id"), "start", "end")


def expand(
    edges: DataFrame,
    notes: DataFrame,
    seeds: DataFrame,
    query_tokens: Column,
    depth: int = 1,
    down_threshold: float = 0.60,
    similarity: Callable[[Column], Column] | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Neighbours of seeds with scores that pass over the edges.

    ``seeds``: note_id, score, pos.  ``notes``: note_id, tier, tags, name_tokens, title.  ``similarity``: of an edge's
    phrase (``triple_text``) to the query; it scales the score by 0.6 to 1.4, without it nothing does.  Each neighbour is claimed once, by the
    first seed, then the first edge label, that reaches it.  Containment is followed downwards only from seeds of score
    ``down_threshold`` or more; imports only to notes whose name shares a token with the query.  Beyond the first hop
    only calls from symbols are followed.  ``ordered``: by hop, then the best first.
    """
    spark, folder = edges.sparkSession, scratch_path(edges.sparkSession, "expansion")
    near = StoredAdjacency(edges, f"{folder}/edges") if depth > 1 else None
    info = notes.select("note_id", "tier", "tags", "name_tokens", *(["title"] if similarity else []))
    first, count = stored(seeds.select("note_id", "score", "pos"), f"{folder}/seeds")
    frontier = first
    if similarity:
        titles = notes.select("note_id", F.col("title").alias("from_title"))
        frontier = titles.join(sized(first, count), "note_id", "right").select("note_id", "score", "pos", F.coalesce("from_title", "note_id").alias("from_title"))
    seen, out = [(first, count)], None
    for hop in range(1, depth + 1):
        asked = frontier.withColumnRenamed("note_id", "linked_from").withColumnRenamed("score", "from_score")
        if near is not None:
            reach = near.hop(asked, count, "linked_from")
        else:
            reach = adjacency(edges).join(sized(asked, count), F.col("node") == F.col("linked_from")).drop("node")
        if hop > 1:
            reach = reach.where("label = 'CALLS'")
        reach = anti(reach.withColumnRenamed("neighbour", "note_id"), seen, ["note_id"])
        first_ = F.struct("pos", label_rank(F.col("label")).alias("r"), "direction", "linked_from")
        carried = ["from_score", "label", *(["from_title"] if similarity else [])]
        down = F.col("label").isin("CONTAINS", "CONTAINS_SYMBOL") & (F.col("direction") == "outgoing") & (F.col("from_score") < down_threshold)
        # what may claim a note depends on the note for imports only, by whether its name has a word of the query
        best = reach.where(~down).groupBy("note_id", (F.col("label") == "IMPORTS").alias("_import")).agg(F.min(F.struct(first_.alias("f"), *carried)).alias("m"))
        best = best.select("note_id", "_import", "m.*").join(info, "note_id").where(~(F.col("_import") & ~F.arrays_overlap("name_tokens", query_tokens)))
        notes_ = [c for c in info.columns if c != "note_id"]
        claimed = best.groupBy("note_id").agg(F.min_by(F.struct("f", *carried, *notes_), F.col("f")).alias("m")).select("note_id", "m.f.*", *[f"m.{c}" for c in carried + notes_])
        matches = F.size(F.filter("tags", lambda t: F.array_contains(query_tokens, t)))
        score = F.col("from_score") * by_label(F.col("label"), EDGE_WEIGHTS) * (1 + F.least(matches * 0.1, F.lit(0.3)))
        if similarity:
            score = score * triple_factor(similarity(triple_text(F.col("label"), F.col("direction"), F.col("from_title"), F.col("title"))))
        claimed = claimed.select("note_id", score.alias("score"), "linked_from", "label", "direction", F.lit(hop).alias("depth"), "tier", "pos", *(["title"] if similarity else []))
        if hop < depth:
            claimed, count = stored(claimed, f"{folder}/hop-{hop}")
            seen.append((claimed, count))
            frontier = claimed.where("tier = '1'").select("note_id", "score", "pos", *([F.col("title").alias("from_title")] if similarity else []))
        out = claimed if out is None else out.unionByName(claimed)
    out = out.select("note_id", "score", "linked_from", "label", "direction", "depth")
    return out.orderBy("depth", F.desc(F.round("score", 9)), "note_id") if ordered else out


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) by min-label propagation with pointer jumping, until nothing changes."""
    spark = links.sparkSession
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), spark)
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node")
    while True:
        labels = cut(labels, spark)
        around = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = labels.join(around, "node").join(jump, "label", "left").select("node", "label", F.least("label", "low", "far").alias("to"))
        moved = cut(moved, spark)
        if not moved.where("to <> label").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))
        labels = moved.select("node", F.col("to").alias("label"))


