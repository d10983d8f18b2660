"""Embedding providers and the chunk table of a vector index."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.vectors import cosine

from .retrieval import boosted_seeds

Provider = Callable[[list[str]], np.ndarray]


def hash_provider(texts: list[str], size: int = 64) -> np.ndarray:
    """A deterministic stand-in for a model: signed hashed words, one row per text."""
    out = np.zeros((len(texts), size))
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            out[i, h % size] += 1.0 if h & 0x8000_0000 else -1.0
    return out


PROVIDERS: dict[str, Provider] = {"hash": hash_provider}


def register_provider(name: str, provider: Provider) -> None:
    """Add a model: a function from a batch of texts to an array of vectors, run in the tasks."""
    PROVIDERS[name] = provider


def vectors_or_errors(run: Provider, texts: list[str], retries: int = 2) -> list[tuple[list[float] | None, str | None]]:
    """A vector or what went wrong, for each text.  A batch that fails is taken text by text, and a text that fails is tried again."""
    said = ""
    for _ in range(1 if len(texts) > 1 else 1 + retries):
        try:
            return [([float(x) for x in v], None) for v in run(texts)] if texts else []
        except Exception as error:  # noqa: BLE001  the provider's trouble, whatever it is
            said = f"{type(error).__name__}: {error}"
    return [(None, said)] if len(texts) == 1 else [x for t in texts for x in vectors_or_errors(run, [t], retries)]


def embedded(text: Column, provider: str = "hash", retries: int = 2) -> Column:
    """``vector`` and ``error`` of texts, a batch at a time; a null text counts as empty.  A text that the provider fails on has a null vector."""
    run = PROVIDERS[provider]

    @F.pandas_udf("struct<vector: array<double>, error: string>")
    def both(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(vectors_or_errors(run, batch.fillna("").tolist(), retries), columns=["vector", "error"], dtype=object)

    return both(text)


def embed(text: Column, provider: str = "hash") -> Column:
    """Vectors of texts (``embedded``)."""
    return embedded(text, provider)["vector"]


def chunk_table(notes: DataFrame, provider: str = "hash", size: int = 1536, overlap: int = 200) -> DataFrame:
    """``workspace``, ``note_id``, ``chunk_index``, ``chunk_id``, ``embedding``, ``error``: title and body in overlapping chunks.

    A chunk that the provider failed on has no vector and says why; a later update embeds its note again.
    """
    rows = notes.select("workspace", "note_id", F.explode(T.chunks(F.concat("title", F.lit("\n\n"), "body"), size, overlap)).alias("c"))
    many = F.when(F.col("c.chunk_index") == 0, F.col("note_id")).otherwise(F.concat("note_id", F.lit("#chunk"), F.col("c.chunk_index").cast("string")))
    made = rows.select("workspace", "note_id", "c.chunk_index", many.alias("chunk_id"), embedded(F.col("c.text"), provider).alias("e"))
    return made.select("workspace", "note_id", "chunk_index", "chunk_id", F.col("e.vector").alias("embedding"), "e.error")


def nearest_chunks(chunks: DataFrame, vector: Column, k: int = 8) -> DataFrame:
    """``note_id``, ``chunk_id``, ``score`` of the ``k`` chunks nearest to a query's vector."""
    scored = chunks.where("embedding IS NOT NULL").select("note_id", "chunk_id", cosine(F.col("embedding"), vector).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), "chunk_id").limit(k)


def hybrid_seeds(notes: DataFrame, chunks: DataFrame, query: str, k: int = 8, provider: str = "hash") -> DataFrame:
    """The notes of the ``k`` chunks nearest to a query, boosted by the tags that the query names, best first."""
    vector = F.array(*[F.lit(float(x)) for x in PROVIDERS[provider]([query])[0]])
    seeds = boosted_seeds(nearest_chunks(chunks, vector, k), notes, T.tokens(F.lit(query)))
    return seeds.select("note_id", "path", "title", "score").orderBy(F.desc(F.round("score", 9)), "note_id")
