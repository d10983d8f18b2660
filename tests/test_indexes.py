"""Stored vector and keyword indexes against the exact searches."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import retrieval
from quillgraph.operators.clusters import near_duplicate_clusters
from quillgraph.operators.keyword_index import KeywordIndex
from quillgraph.operators.stored_index import StoredIndex
from quillgraph.operators.vector_index import VectorIndex, recall

from .conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters with noise, one of them large and tight, as a group of near copies is."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 2
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16))
    x[:1000] = centres[0] + rng.normal(size=(1000, 16)) * 0.05
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))] + [(5000, None)], "vec_id long, embedding array<float>").cache()


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return VectorIndex.build(vectors, f"file://{tmp_path_factory.mktemp('vectors')}/i")


def test_vector_recall_and_pruning(spark, vectors, index):
    queries = vectors.where("vec_id % 100 = 50").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = retrieval.vector_topk_batch(vectors.where("embedding IS NOT NULL"), queries, 8)
    found = index.topk_batch(queries, 8)
    assert index.probes < len(index.centroids) / 3
    assert recall(found, exact, ["query_id", "vec_id"]) >= 0.9
    whole = index.topk_batch(queries, 8, probes=len(index.centroids))
    key = lambda df: sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in df.collect())
    assert key(whole) == key(exact), "all lists: the exact search"
    one = index.topk(vectors.where("vec_id = 1550").first().embedding, 8)
    assert [r.vec_id for r in one.collect()] == [r.vec_id for r in found.where("query_id = 1550").orderBy("rank").collect()]
    text = plan(one)
    assert "list" in text.split("PartitionFilters")[1][:80]
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    some = index.stored.read(F.col("list").isin(index.asked_lists(np.ones((1, 16)))[0].tolist()))
    assert 0 < files(some) <= index.probes * 2 < files(index.stored.read())


def test_vector_pairs(vectors, index):
    few = vectors.where("embedding IS NOT NULL AND vec_id >= 900")
    small = VectorIndex.build(few, index.path + "-few")
    exact, found = retrieval.similar_pairs(few, 0.9), small.near_pairs(0.9, block=300)
    assert found.join(exact, ["a", "b"], "left_anti").count() == 0 and recall(found, exact, ["a", "b"]) >= 0.9


def test_clusters_by_index(spark, vectors, tmp_path):
    few = vectors.where("vec_id BETWEEN 950 AND 1400")
    index = VectorIndex.build(few, f"file://{tmp_path}/i")
    exact, members = near_duplicate_clusters(few, 0.97)
    got, _ = near_duplicate_clusters(few, 0.97, index=index)
    size = lambda df: sorted(r["size"] for r in df.collect())
    assert size(exact)[-1] == size(got)[-1] == 50


def test_vector_index_takes_in_changes(spark, vectors, tmp_path):
    path = f"file://{tmp_path}/i"
    VectorIndex.build(vectors.where("vec_id < 500"), path)
    opened = VectorIndex.open(spark, path)
    opened.add(spark.createDataFrame([(7, [9.0] * 16), (9000, [9.0] * 16)], "vec_id long, embedding array<float>"), spark.createDataFrame([(7,), (8,)], "vec_id long"))
    rows = {r.vec_id: r.embedding for r in VectorIndex.open(spark, path).stored.read().collect()}
    assert len(rows) == 500 and rows[7] == [9.0] * 16 and 8 not in rows and 9000 in rows
    assert [r.vec_id for r in opened.topk([9.0] * 16, 2).collect()] == [7, 9000]
    again = opened.stored.compacted(f"file://{tmp_path}/c")
    assert again.generations() == [1] and again.read().count() == 500


def test_empty_vector_index(spark, tmp_path):
    empty = VectorIndex.build(spark.createDataFrame([], "vec_id long, embedding array<float>"), f"file://{tmp_path}/i")
    assert empty.stored.read().count() == 0


def test_unfinished_generations_do_not_count(spark, tmp_path):
    held = StoredIndex(spark, f"file://{tmp_path}/s", "id long", "id")
    rows = lambda *x: spark.createDataFrame([(i, i % 2) for i in x], "id long, part int")
    held.add(rows(1, 2))
    rows(9).write.partitionBy("part").parquet(f"file://{tmp_path}/s/rows/generation=2")  # its writer died
    assert held.add(rows(3), rows(1).select("id")) == 3
    assert sorted(r.id for r in held.read().collect()) == [2, 3]


def test_keyword_index(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet").select(F.concat(F.lit("n"), "doc_id").alias("note_id"), F.substring("text", 1, 30).alias("title"), F.array("lang", "source").alias("tags"), F.concat_ws("/", "lang", "source").alias("path"), F.col("text").alias("body"), F.when(F.col("doc_id") % 50 == 0, "index").otherwise("concept").alias("note_type"))
    index = KeywordIndex(spark, f"file://{tmp_path}/k", buckets=16)
    index.add(d.where("note_id <> 'n7'"))
    index.add(d.where("note_id IN ('n7', 'n9')"), d.where("note_id = 'n9'").select("note_id"))
    for query in ("the thing and of it", "en web", "The, the", "nothingatall", ""):
        want = [(r.note_id, round(r.score, 9)) for r in retrieval.keyword_topk(d, query, 12).collect()] if query else []
        got = index.topk(query, 12)
        assert sorted((r.note_id, round(r.score, 9)) for r in got.collect()) == sorted(want), query
    text = plan(index.topk("the thing", 5))
    assert "body" not in text.replace("in_body", "") and "bucket" in text.split("PartitionFilters")[1][:60]
