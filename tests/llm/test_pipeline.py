"""The pipeline's stages, one after the other."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from quillgraph.llm import quality_crf
from quillgraph.llm.common import path_glob, shared_root

from ..conftest import SF
from . import brute


def test_stages(spark, tokenizer_file):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    start = {r.doc_id: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_classifier", "near_dedup", "suffix_dedup", "decontamination", "bpe"]

    good = stage["quality_classifier"](spark, docs, SF).cache()
    field = quality_crf.train_quality_field(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {i for i, s in zip(start, field.scores([r.text for r in start.values()]), strict=True) if s >= 0.3}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns

    single = stage["near_dedup"](spark, good, SF).cache()
    label = brute.classes([(i, start[i].text) for i in sorted(want)])
    assert {r.doc_id for r in single.collect()} == {i for i, c in label.items() if i == c} and single.columns == docs.columns

    cut = stage["suffix_dedup"](spark, single, SF).cache()
    assert cut.count() == single.count() and cut.columns == docs.columns
    lost = brute.repeated_bytes([(r.doc_id, r.text) for r in single.collect()])
    for r in cut.collect():
        kept = lost[r.doc_id][3]
        assert len(kept) <= len(r.text.encode()) <= len(kept) + 6 * lost[r.doc_id][2] and r.n_chars == len(r.text)

    clean = stage["decontamination"](spark, cut, SF).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, _ in brute.contaminated([(r.doc_id, r.text) for r in cut.collect()], items)}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in cut.collect()} - bad

    coded = stage["bpe"](spark, clean, SF).collect()
    ids = {r.doc_id: r.ids for r in coded}
    for r in coded:
        want = tokenizer_file.encode(r.text, add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.decoded_sha256 == brute.sha(tokenizer_file.decode(want, skip_special_tokens=False))
    assert {(r.doc_id, r.text, r.lang, r.source) for r in coded} == {(r.doc_id, r.text, r.lang, r.source) for r in clean.collect()}
    before = set(path_glob(spark, shared_root(spark) + "/*"))
    rows = corpus_pipeline.run(spark, SF).collect()
    left = set(path_glob(spark, shared_root(spark) + "/*")) - before
    assert len(left) == 1 and "decontamination" in left.pop(), "tables of stages that are done are deleted"
    assert Counter(r.doc_id for r in rows) == Counter(ids.keys())


def test_stages_on_awkward_documents(spark, documents, docs, empty):
    for frame in (docs, empty):
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SF).cache()
            frame.count()
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2, docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.union(nulls), SF).count() <= len(documents) + 2, name


def test_stages_keep_any_columns(spark, documents, docs):
    """Repeated ids and rows, ties, and extra columns with the names the stages use themselves."""
    frame = docs.union(docs.where("doc_id < 3")).selectExpr(
        "*", "doc_id AS score", "text AS predicted", "map(1, text) AS hits", "timestamp_micros(doc_id) AS kept", "doc_id AS node", "doc_id AS label", "'x' AS block", "doc_id AS ids", "n_chars AS n_tokens"
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.schema.names == frame.schema.names, name
        before = {(r.doc_id, r.kept, r.label, r.n_tokens, str(r.hits)) for r in frame.collect()}
        assert {(r.doc_id, r.kept, r.label, r.n_tokens, str(r.hits)) for r in out.collect()} <= before, name
    last = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
    assert last.count() == frame.count() and {"score", "hits", "node", "ids", "n_tokens", "decoded_sha256"} <= set(last.columns)
