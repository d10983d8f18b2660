"""Clusters of near-duplicate notes from vector similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import tag_list

from .embedding import embed
from .graph import components, cut
from .retrieval import similar_pairs
from .vector_index import VectorIndex


def candidates(notes: DataFrame, types: list[str], excluded_tags: list[str]) -> DataFrame:
    """Notes of some types without any of the tags, which are normalized first."""
    unwanted = tag_list(F.array(*map(F.lit, excluded_tags)).cast("array<string>"))
    return notes.where(F.col("note_type").isin(types) & ~F.coalesce(F.arrays_overlap("tags", unwanted), F.lit(False)))


def strongest(pairs: DataFrame, k: int) -> DataFrame:
    """``pairs`` (a, b, sim) that are among the ``k`` most similar of either end, ties by id."""
    both = pairs.select("a", "b", "sim", F.col("a").alias("end"), F.col("b").alias("other")).union(pairs.select("a", "b", "sim", "b", "a"))
    place = F.row_number().over(Window.partitionBy("end").orderBy(F.desc(F.round("sim", 9)), "other"))
    return both.withColumn("_n", place).where(F.col("_n") <= k).select("a", "b", "sim").distinct()


def near_duplicate_clusters(
    vectors: DataFrame, threshold: float = 0.85, min_size: int = 2, neighbours: int | None = None, index: VectorIndex | None = None
) -> tuple[DataFrame, DataFrame]:
    """Clusters and their members.

    ``vectors``: vec_id, embedding, already filtered by type and tags (``candidates``).  ``neighbours``: pairs count only
    among the so many strongest of either end.  ``index``: a stored index of the vectors, by which pairs are found without
    multiplying all (it may miss some); without it the search is exact.  A cluster is a connected component of pairs at
    ``threshold`` or above, called by its smallest id, with size and the largest, smallest and mean similarity of its
    pairs.  The representative has the most partners, then the smallest id; members carry their similarity to it (0 if
    they aren't partners).
    """
    pairs = similar_pairs(vectors, threshold) if index is None else index.near_pairs(threshold)
    return clusters_of(pairs if neighbours is None else strongest(pairs, neighbours), min_size)


def query_pairs(notes: DataFrame, index: VectorIndex, provider: str = "hash", threshold: float = 0.85, neighbours: int = 10, most_chars: int = 1200) -> DataFrame:
    """``a`` < ``b``, ``sim``: notes of which one is found when the other is asked for.

    Each of ``notes`` (note_id, title, body; the candidates) is a question, its title and the first ``most_chars`` characters
    of its body, whose ``neighbours`` nearest chunks are looked up in a stored index of chunks (vec_id: note_id, or
    note_id#chunk and a number).  The best chunk counts for its note; notes that aren't candidates and those under
    ``threshold`` are left out, as are questions that the provider fails on.
    """
    question = F.concat(F.col("title"), F.lit("\n\n"), F.substring("body", 1, most_chars))
    asked = cut(notes.select(F.col("note_id").alias("query_id"), embed(question, provider).alias("vector")), notes.sparkSession)
    hits = index.topk_batch(asked.where("vector IS NOT NULL"), neighbours).where(F.col("score") >= threshold)
    found = hits.select(F.col("query_id").alias("asker"), F.regexp_replace("vec_id", r"#chunk\d+$", "").alias("note_id"), "score").where("asker <> note_id")
    found = found.join(notes.select("note_id"), "note_id", "left_semi")
    return found.groupBy(F.least("asker", "note_id").alias("a"), F.greatest("asker", "note_id").alias("b")).agg(F.max("score").alias("sim"))


def clusters_of(pairs: DataFrame, min_size: int = 2) -> tuple[DataFrame, DataFrame]:
    """Clusters and members of pairs (a, b, sim), as ``near_duplicate_clusters`` has them."""
    pairs = cut(pairs, pairs.sparkSession)
    member = components(pairs).withColumnRenamed("node", "vec_id").withColumnRenamed("component", "cluster_id")
    ends = pairs.select("a", "b", "sim").join(member.withColumnRenamed("vec_id", "a"), "a")
    stats = ends.groupBy("cluster_id").agg(F.max("sim").alias("max_sim"), F.min("sim").alias("min_sim"), F.avg("sim").alias("avg_sim"))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("vec_id")).groupBy("vec_id").agg(F.count("*").alias("degree"))
    sized = member.join(degree, "vec_id").groupBy("cluster_id").agg(F.count("*").alias("size"), F.min_by("vec_id", F.struct(-F.col("degree"), F.col("vec_id"))).alias("representative"))
    clusters = sized.where(F.col("size") >= min_size).join(stats, "cluster_id")
    both = pairs.select("a", "b", "sim").union(pairs.select("b", "a", "sim"))
    members = member.join(clusters.select("cluster_id", "representative"), "cluster_id")
    near = both.select(F.col("a").alias("vec_id"), F.col("b").alias("representative"), "sim")
    members = members.join(near, ["vec_id", "representative"], "left")
    sim = F.when(F.col("vec_id") == F.col("representative"), 1.0).otherwise(F.coalesce("sim", F.lit(0.0)))
    return clusters, members.select("cluster_id", "vec_id", sim.alias("sim"))
