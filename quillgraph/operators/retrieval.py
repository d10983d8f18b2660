"""Vector and keyword retrieval, discovery, and their combination."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.vectors import cosine, doubles, tag_boost

#: Bytes of query vectors that may be sent to every executor.
MAX_QUERY_BYTES = 64 << 20
#: Scores that a task holds at a time, and rows that it multiplies at a time.
TILE, TILE_ROWS = 1 << 20, 512


def vector_topk(chunks: DataFrame, query: list[float], k: int = 8, workspace: Column | None = None) -> DataFrame:
    """The ``k`` rows of ``chunks`` (vec_id, embedding, ...) nearest to a vector, ties by id; ``workspace``: a filter."""
    rows = chunks if workspace is None else chunks.where(workspace)
    vector = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("score", cosine(doubles(F.col("embedding")), vector)).orderBy(F.desc("score"), "vec_id").limit(k)


def query_slices(queries: DataFrame, max_bytes: int = MAX_QUERY_BYTES) -> Iterator[pd.DataFrame]:
    """``queries`` (query_id, vector) in slices that may be sent to every executor."""
    size = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    slices = max(1, -(-(size[0] * (size[1] or 0) * 8) // max_bytes))
    for i in range(slices):
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i) if slices > 1 else queries
        yield some.orderBy("query_id").toPandas()


def vector_topk_batch(chunks: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """``query_id``, ``vec_id``, ``score``, ``rank``: the ``k`` nearest rows for each query vector.

    A slice of the queries goes to every task, which multiplies it with its rows in tiles of bounded size and keeps the k
    best of each query over all its rows; only those are shuffled.
    """
    out = None
    for some in query_slices(queries):
        if not len(some):
            continue
        ids, q = some["query_id"].to_numpy(), unit(np.array(some["vector"].tolist(), float))
        sent = chunks.sparkSession.sparkContext.broadcast((ids, q))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            found = NearestRows(q, k)
            for batch in batches:
                found.take_in(batch.column("vec_id").to_numpy(zero_copy_only=False), lambda i, j, x=batch.column("embedding"): x[i:j].to_pylist())
            for columns in found.rows(ids):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

        part = chunks.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(best, "query_id long, vec_id long, score double")
        out = part if out is None else out.union(part)
    if out is None:
        return chunks.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    ranked = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


class NearestRows:
    """The ``k`` nearest of the rows seen so far for each of ``q``, by score to 9 places, then by id."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k, self.asked = q, k, max(1, TILE // TILE_ROWS)
        self.vec, self.score = None, np.zeros((len(q), 0))

    def take_in(self, vec: np.ndarray, vectors: Callable[[int, int], list]) -> None:
        """Rows of the ids ``vec``; ``vectors`` gives those from one place up to another."""
        for i in range(0, len(vec), TILE_ROWS):
            some = vec[i : i + TILE_ROWS]
            self._add(some, unit(np.array(vectors(i, i + len(some)), float)))

    def _add(self, vec: np.ndarray, rows: np.ndarray) -> None:
        before = np.zeros((len(self.q), 0), vec.dtype) if self.vec is None else self.vec
        width = min(self.k, before.shape[1] + len(vec))
        kept_vec, kept_score = np.empty((len(self.q), width), vec.dtype), np.empty((len(self.q), width))
        for i in range(0, len(self.q), self.asked):
            mine = slice(i, i + self.asked)
            score = np.concatenate([self.score[mine], self.q[mine] @ rows.T], axis=1)
            both = np.concatenate([before[mine], np.broadcast_to(vec, (len(score), len(vec)))], axis=1)
            order = np.lexsort((both, -score.round(9)), axis=1)[:, :width]
            kept_vec[mine], kept_score[mine] = np.take_along_axis(both, order, 1), np.take_along_axis(score, order, 1)
        self.vec, self.score = kept_vec, kept_score

    def rows(self, ids: np.ndarray, size: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query ids, row ids and scores of what was kept, ``size`` queries at a time."""
        for i in range(0, len(ids) if self.vec is not None else 0, size):
            mine = slice(i, i + size)
            yield np.repeat(ids[mine], self.vec.shape[1]), self.vec[mine].ravel(), self.score[mine].ravel()


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of (nearly) no length become zero."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n < 1e-10, 0.0, x / np.maximum(n, 1e-10))


def similar_pairs(vectors: DataFrame, threshold: float, block: int = 2000) -> DataFrame:
    """``a`` < ``b``, ``sim``: all pairs of ``vectors`` (vec_id, embedding) with cosine ``threshold`` or more.

    Vectors are dealt out to blocks of about ``block`` rows; a task multiplies two blocks and gives out only the pairs
    that reach the threshold.  A row is sent to as many tasks as there are blocks.
    """
    n = vectors.count()
    blocks = max(1, -(-n // block))
    own = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = own.withColumn("other", other).select("vec_id", "embedding", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def multiply(rows: pd.DataFrame) -> pd.DataFrame:
        p, q = rows["p"].iat[0], rows["q"].iat[0]
        left, right = rows[rows["own"] == p], rows[rows["own"] == q]
        a, b = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "sim": []})
        sim = unit(np.array(left["embedding"].tolist(), float)) @ unit(np.array(right["embedding"].tolist(), float)).T
        i, j = np.nonzero(sim >= threshold)
        kept = a[i] < b[j] if p == q else a[i] != b[j]
        i, j = i[kept], j[kept]
        return pd.DataFrame({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j]), "sim": sim[i, j]})

    return sent.groupBy("p", "q").applyInPandas(multiply, "a long, b long, sim double")


def query_words(query: str) -> list[str]:
    """The distinct normalized words of a query."""
    found = (re.sub("[^a-z0-9]+", "_", w).strip("_") for w in query.lower().split())
    return [w for w in dict.fromkeys(found) if w]


def shared_words(text: Column, words: list[str]) -> Column:
    """How many of ``words`` are normalized words of a text; one pattern each, without taking the text apart.

    A pattern is only tried where the text holds the word's longest part, which is the cheaper test.
    """
    edge, inner = r"[^a-z0-9\s]*", r"[^a-z0-9\s]+"
    lower = F.lower(text)
    found = lambda w: lower.contains(max(w.split("_"), key=len)) & lower.rlike(rf"(?:^|\s){edge}{inner.join(w.split('_'))}{edge}(?:\s|$)")
    hits = [F.coalesce(found(w).cast("int"), F.lit(0)) for w in words]
    return reduce(add, hits, F.lit(0))


def keyword_topk(notes: DataFrame, query: str, k: int = 8) -> DataFrame:
    """``note_id``, ``score`` of the best notes by shared words, scaled to the best.

    ``notes``: note_id, title, tags (array), path, body, note_type.  A word shared with the title counts 0.4, with the
    tags 0.3, with the path 0.2, with the body 0.05 (0.3 in all at most).  Ties by id.
    """
    words = query_words(query)
    path = F.regexp_replace("path", r"[/.]+", " ")
    raw = (
        0.4 * shared_words(F.col("title"), words)
        + 0.3 * F.size(F.array_intersect("tags", F.array(*map(F.lit, words)).cast("array<string>")))
        + 0.2 * shared_words(path, words)
        + F.least(0.05 * shared_words(F.col("body"), words), F.lit(0.3))
    )
    scored = notes.where("note_type <> 'index'").select("note_id", raw.alias("raw")).where("raw > 0")
    best = scored.orderBy(F.desc(F.round("raw", 9)), "note_id").limit(k)
    top = best.agg(F.max("raw").alias("top"))
    return best.join(F.broadcast(top)).select("note_id", (F.col("raw") / F.col("top")).alias("score"))


def best_per_note(hits: DataFrame, note: str = "note_id") -> DataFrame:
    """The best score of each note over its chunks."""
    return hits.groupBy(note).agg(F.max("score").alias("score"))


def boosted_seeds(hits: DataFrame, notes: DataFrame, query_tokens: Column, said: DataFrame | None = None, workspace: str | None = None) -> DataFrame:
    """Notes of chunk hits (note_id, score), index notes and deleted notes left out, with tag boost, best score each.

    ``said``: what the index itself says of notes (columns of ``notes``); it stands in for notes that aren't there any
    more.  ``workspace``: all must be of it; one that isn't fails the job, as the index was asked for the wrong one.
    """
    known = notes
    if said is not None:
        more = said.dropDuplicates(["note_id"]).join(notes.select("note_id"), "note_id", "left_anti")
        known = notes.unionByName(more, allowMissingColumns=True).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    kept = best_per_note(hits).join(known.where("note_type <> 'index'"), "note_id")
    if workspace is not None:
        kept = kept.where(F.assert_true(F.col("workspace") == workspace, F.concat(F.lit(f"outside of workspace {workspace}: "), "note_id")).isNull())
    return kept.withColumn("score", tag_boost(F.col("score"), F.col("tags"), query_tokens))


def module_score(path: Column) -> Column:
    """The top folder 1, below it .04 less a level from 0.9 on."""
    depth = F.size(F.split(path, "/")) - 1
    return F.when(depth == 0, F.lit(1.0)).otherwise(0.9 - 0.04 * F.least(depth, F.lit(5)))


def hub_score(degree: Column) -> Column:
    return 0.55 + F.least(degree, F.lit(20)) / 40


def discovery(notes: DataFrame, degree: DataFrame, k: int = 8) -> DataFrame:
    """A queryless map: ``note_id``, ``kind`` (entrypoint, module, hub), ``score``, ``pos``; each note once, in order.

    Entry points (files tagged so) by depth and path; modules by score (the top folder 1, below it .04 less a level) and
    path; hubs (files and modules with edges) by degree.
    """
    depth = F.size(F.split("path", "/")) - 1
    rows = notes.where("note_type <> 'index'").join(degree, "note_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    files = rows.where((F.col("tier") == "2") & F.array_contains("tags", "entrypoint"))
    half = max(2, k // 2)
    module, hub = module_score(F.col("path")), hub_score(F.col("degree"))
    lists = [
        ("entrypoint", files.select("note_id", "path", F.lit(1.0).alias("score")), [depth, F.col("path")], half),
        ("module", rows.where("tier = '3'").select("note_id", "path", module.alias("score")), [F.desc(F.round("score", 9)), depth, F.col("path")], k),
        ("hub", rows.where("tier IN ('2', '3') AND degree > 0").select("note_id", "path", hub.alias("score")), [F.desc(F.round("score", 9)), F.col("path")], half),
    ]
    out = None
    for n, (kind, df, order, most) in enumerate(lists):
        few = df.orderBy(*order).limit(most)
        few = few.withColumn("pos", F.row_number().over(Window.orderBy(*order)) + 1000 * n).withColumn("kind", F.lit(kind))
        out = few if out is None else out.union(few)
    first = out.groupBy("note_id").agg(F.min(F.struct("pos", "kind", "score")).alias("f")).select("note_id", "f.*")
    return first.orderBy("pos").limit(max(k, 8)).withColumn("pos", F.row_number().over(Window.orderBy("pos")))


def resolve_endpoints(notes: DataFrame, queries: list[str]) -> DataFrame:
    """``query``, ``note_id``, ``resolved_by``: a note of that id, else the first (by id) whose title holds the query, in any case.

    The queries are a short list from the caller; they are tested together in one scan.
    """
    asked = F.explode(F.array(*map(F.lit, queries))).alias("query")
    how = F.when(F.col("note_id") == F.col("query"), 0).when(F.lower("title").contains(F.lower("query")), 1)
    hits = notes.select("note_id", "title", asked).withColumn("how", how).where("how IS NOT NULL")
    best = hits.groupBy("query").agg(F.min(F.struct("how", "note_id")).alias("b"))
    return best.select("query", "b.note_id", F.when(F.col("b.how") == 0, "exact").otherwise("substring").alias("resolved_by"))
