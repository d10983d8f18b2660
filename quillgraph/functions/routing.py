"""Which kind of retrieval a query asks for."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_token, strip

# The phrases and words that decide the mode.
DISCOVER_PHRASES = [
    "get oriented",
    "orient me",
    "where should i start",
    "where do i start",
    "start reading",
    "entry points",
    "entrypoints",
    "codebase map",
    "map of the codebase",
    "high level",
    "big picture",
    "architecture",
    "overview",
    "how is this organized",
    "how is this structured",
    "walk me through",
]
BROAD_TERMS = [
    "discover", "explore", "orientation", "overview", "map", "structure", "architecture", "entrypoint", "entrypoints", "module", "modules",
    "start", "starts", "flow", "flows", "main", "important", "key", "core", "system", "codebase",
]
FILLER = ["the", "this", "that", "a", "an", "to", "for", "of", "in", "is", "are", "me", "show", "what"]


def words_in(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def query_mode(query: Column, requested: Column | None = None) -> Column:
    """``discover`` for orientation prompts, ``targeted`` for everything else; a valid request decides."""
    q = F.lower(strip(query))
    phrase = reduce(or_, [q.contains(p) for p in DISCOVER_PHRASES])
    words = F.filter(F.transform(F.split(q, "[^A-Za-z0-9_./-]+"), normalize_token), lambda t: t != "")
    symbol_like = F.exists(words, lambda t: t.contains("_"))
    meant = F.filter(words, lambda t: ~F.array_contains(words_in(FILLER), t))
    broad = (F.size(meant) > 0) & F.forall(meant, lambda t: F.array_contains(words_in(BROAD_TERMS), t))
    mode = F.when(F.coalesce(phrase, F.lit(False)), "discover").when(F.coalesce(~symbol_like & broad, F.lit(False)), "discover").otherwise("targeted")
    return mode if requested is None else F.when(requested.isin("discover", "targeted"), requested).otherwise(mode)
