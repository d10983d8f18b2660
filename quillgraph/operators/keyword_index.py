"""A stored keyword index: which notes have a word, and where, by buckets of words.

A question reads the buckets of its words, not the notes; the rows are those of ``retrieval.keyword_topk``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import tokens
from quillgraph.operators.retrieval import query_words
from quillgraph.operators.stored_index import StoredIndex

#: Folders that words are dealt out to.
BUCKETS = 256
FIELDS = ("title", "tags", "path", "body")


def bucket(word, buckets: int):
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def postings(notes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``token``, ``note_id`` and a flag for each field that has it, of notes other than index notes, with the token's ``bucket``.

    ``notes``: note_id, title, tags (normalized), path, body, note_type.  Missing fields have no words.
    """
    words = {"title": tokens(F.col("title")), "tags": F.array_distinct("tags"), "path": tokens(F.regexp_replace("path", r"[/.]+", " ")), "body": tokens(F.col("body"))}
    none = F.array().cast("array<string>")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(words[f], none).alias("words")) for f in FIELDS])
    each = notes.where("note_type <> 'index'").select("note_id", F.explode(fields).alias("f")).select("note_id", "f.field", F.explode("f.words").alias("token"))
    flags = [F.max(F.col("field") == f).alias(f"in_{f}") for f in FIELDS]
    return each.where("token IS NOT NULL").groupBy("token", "note_id").agg(*flags).withColumn("bucket", bucket("token", buckets))


class KeywordIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, id_type: str = "string"):
        self.spark, self.buckets = spark, buckets
        self.stored = StoredIndex(spark, path, f"token string, note_id {id_type}, " + ", ".join(f"in_{f} boolean" for f in FIELDS), "note_id", "bucket")

    def add(self, notes: DataFrame, gone: DataFrame | None = None) -> int:
        """Take in notes, and take away what is held of the notes ``gone`` (note_id) first; a changed note is in both."""
        return self.stored.add(postings(notes, self.buckets), gone)

    def topk(self, query: str, k: int = 8) -> DataFrame:
        """``note_id``, ``score`` as ``retrieval.keyword_topk``: by words shared with title, tags, path and body, scaled to the best; ties by id."""
        words = query_words(query)
        asked = self.spark.range(1).select(F.explode(F.array(*map(F.lit, words)).cast("array<string>")).alias("w")).select(bucket("w", self.buckets).alias("b")).distinct()
        buckets = [r.b for r in asked.collect()]  # one a word of the query
        rows = self.stored.read(F.col("bucket").isin(buckets) & F.col("token").isin(words))
        n = {f: F.count_if(F.col(f"in_{f}")) for f in FIELDS}
        raw = 0.4 * n["title"] + 0.3 * n["tags"] + 0.2 * n["path"] + F.least(0.05 * n["body"], F.lit(0.3))
        best = rows.groupBy("note_id").agg(raw.alias("raw")).orderBy(F.desc(F.round("raw", 9)), "note_id").limit(k)
        return best.join(F.broadcast(best.agg(F.max("raw").alias("top")))).select("note_id", (F.col("raw") / F.col("top")).alias("score"))
