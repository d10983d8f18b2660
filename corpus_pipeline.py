"""The corpus preparation pipeline (part of the training-data operators).

Documents that the quality classifier accepts; one of each class of near duplicates; without repeated strings; without
those that hold a benchmark item; as token ids.  A stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.bpe_codec import bpe_stage
from quillgraph.llm.common import clean_shared, mark_shared, shared_path
from quillgraph.llm.decontamination import decontamination_stage
from quillgraph.llm.near_dedup import near_dedup_stage
from quillgraph.llm.quality_crf import quality_stage
from quillgraph.llm.suffix_dedup import suffix_dedup_stage

STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: No SQL: the classifier and the tokenizer are beyond it.  The tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again.

    What a stage has read and made in between is deleted once it is written; the last but one's table stays.
    """
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark_shared()
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        clean_shared(spark, mark, keep=path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
