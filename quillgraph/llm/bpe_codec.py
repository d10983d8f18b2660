"""BPE encoding and decoding with a pair occurrence index (operator 5).

A task takes its partition in slices of whole texts.  All distinct words of a slice that the worker hasn't met before are
laid out as one linked list of symbols.  An index maps each adjacent pair that has a merge to all its positions there.  Active ranks are applied in ascending order: every
still valid occurrence of the pair is merged, left to right, and the pairs that the merge makes with its neighbours
join the lists of their own ranks.  A merge's parts always have smaller ranks than what they make, so no rank becomes
active after it was passed.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, null_to_empty, table
from .tokenizer_files import tokenizer_source
from .word_symbols import Vocabulary, load_vocabulary, pieces, symbols


def encode_words(words: list[np.ndarray], merge: dict[tuple[int, int], int]) -> list[list[int]]:
    """The merged symbols of each word (arrays of base symbols)."""
    sizes = np.array([len(w) for w in words], np.int64)
    symbol = np.concatenate(words).tolist() if words else []
    n = len(symbol)
    stops = np.cumsum(sizes)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    for s in stops.tolist():
        after[s - 1] = -1
    for s in (stops - sizes).tolist():
        before[s] = -1
    occurrences: defaultdict[int, list[int]] = defaultdict(list)
    pair_of: dict[int, tuple[int, int]] = {}
    for i in range(n):
        if after[i] >= 0 and (made := merge.get(p := (symbol[i], symbol[i + 1]))) is not None:
            occurrences[made].append(i)
            pair_of[made] = p
    active = list(occurrences)
    heapq.heapify(active)
    while active:
        made = heapq.heappop(active)
        left, right = pair_of[made]
        for i in sorted(occurrences.pop(made)):
            j = after[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue  # an earlier merge took one of its parts
            symbol[i], symbol[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (more := merge.get(p := (made, symbol[k]))) is not None:
                    if more not in occurrences:
                        heapq.heappush(active, more)
                        pair_of[more] = p
                    occurrences[more].append(i)
            h = before[i]
            if h >= 0 and (more := merge.get(p := (symbol[h], made))) is not None:
                if more not in occurrences:
                    heapq.heappush(active, more)
                    pair_of[more] = p
                occurrences[more].append(h)
    out, i = [], 0
    for size in sizes.tolist():
        out.append([s for s in symbol[i : i + size] if s >= 0])
        i += size
    return out


class WordCodec:
    """Encodes and decodes for one Python worker; remembers words it has met, up to ``max_words`` of them."""

    def __init__(self, vocab: Vocabulary, max_words: int = 300_000):
        self.vocab, self.max_words = vocab, max_words
        self.names = [t.encode() for t in vocab.tokens]
        self.forget()

    def forget(self) -> None:
        """Known words: their number, where their ids begin in ``flat`` (one more entry than words), their decoding."""
        self.known: dict[bytes, int] = {}
        self.shown: list[bytes] = []
        self.flat, self.begins = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def learn(self, words: list[bytes]) -> None:
        base = [np.frombuffer(w, np.uint8).astype(np.int32) for w in words]
        for b in base:
            b[-1] += 256
        merged = encode_words(base, self.vocab.merge)
        ids = [[self.vocab.symbol_ids[s] for s in m] for m in merged]
        for word, mine in zip(words, ids, strict=True):
            self.known[word] = len(self.shown)
            self.shown.append(self.show(mine))
        self.flat = np.concatenate([self.flat, np.fromiter((i for mine in ids for i in mine), "<u4")])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum([len(mine) for mine in ids])])

    def show(self, ids: list[int]) -> bytes:
        """Decoding: the tokens' strings, joined by spaces (this vocabulary's file names no decoder)."""
        return b" ".join([self.names[i] for i in ids])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bytes]]:
        """Ids of each text, and the text decoded from them."""
        normal, owner, after = pieces(texts, self.vocab)
        stream, begins = symbols(normal)
        # words as bytes: a separator that no word holds goes in after every word end
        last = stream >= 256
        plain = (stream & 255).astype(np.uint8)
        at = np.arange(len(stream)) + np.cumsum(last) - last
        spaced = np.full(len(stream) + int(last.sum()), 32, np.uint8)
        spaced[at] = plain
        words = spaced.tobytes().split(b" ")[:-1]
        if len(self.known) > self.max_words:
            self.forget()
        if new := [w for w in dict.fromkeys(words) if w not in self.known]:
            self.learn(new)
        which = [self.known[w] for w in words]
        # ids of all words in one gather
        numbers = np.array(which, np.int64)
        sizes = self.begins[numbers + 1] - self.begins[numbers]
        stops = np.cumsum(sizes)
        ids = self.flat[np.arange(stops[-1] if len(stops) else 0) + np.repeat(self.begins[numbers] - stops + sizes, sizes)]
        word_at = np.concatenate([[0], np.cumsum(last)])[begins]
        id_at = np.concatenate([[0], stops])[word_at].tolist()
        upto = word_at.tolist()
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        shown: list[list[bytes]] = [[] for _ in texts]
        for p, (text, special) in enumerate(zip(owner.tolist(), after, strict=True)):
            parts[text].append(ids[id_at[p] : id_at[p + 1]])
            shown[text] += [self.shown[w] for w in which[upto[p] : upto[p + 1]]]
            if special >= 0:
                parts[text].append(np.array([special], "<u4"))
                shown[text].append(self.names[special])
        return [(a[0] if len(a) == 1 else np.concatenate(a), b" ".join(b)) for a, b in zip(parts, shown, strict=True)]


_CODECS: dict[str, WordCodec] = {}


def codec(source: str) -> WordCodec:
    if source not in _CODECS:
        _CODECS.clear()
        _CODECS[source] = WordCodec(load_vocabulary(source))
    return _CODECS[source]


def slices(texts: list[str], chars: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters (one text at least), to bound the memory of a batch."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > chars:
            yield some
            give_back()
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def bpe_encode(docs: DataFrame, text: str = "text", tokenizer_path: str | None = None, output: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text (``array<int>``); a null text has none."""
    source = tokenizer_source(docs.sparkSession, tokenizer_path)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for some in slices(batch.tolist()):
                yield pd.Series([ids.astype(np.int32) for ids, _ in codec(source.value).encode(some)], dtype=object)
        give_back()

    return docs.withColumn(output, encode(null_to_empty(text)))


def bpe_decode(df: DataFrame, ids: str = "ids", tokenizer_path: str | None = None, output: str = "decoded") -> DataFrame:
    """``df`` with the text that token ids decode to, special tokens kept; null ids decode to an empty text."""
    source = tokenizer_source(df.sparkSession, tokenizer_path)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([codec(source.value).show(list(x)).decode() for x in batch], dtype=object)

    return df.withColumn(output, decode(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def bpe_digests(docs: DataFrame, text: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: the same codec, without moving ids out of the tasks.

    Columns of these names are replaced.
    """
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256")
    source = tokenizer_source(docs.sparkSession, tokenizer_path)

    @F.pandas_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some in slices(batch.tolist()):
                rows = [(len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()) for ids, decoded in codec(source.value).encode(some)]
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    return docs.withColumn("_bpe", digest(null_to_empty(text))).select("*", "_bpe.*").drop("_bpe")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of every document, with ``ids``, ``n_tokens`` and the digest of the text they decode to (``decoded_sha256``).

    Columns of these names are replaced.
    """
    source, new = tokenizer_source(spark, None), ("ids", "n_tokens", "decoded_sha256")

    @F.pandas_udf("struct<ids: array<int>, n_tokens: long, decoded_sha256: string>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some in slices(batch.tolist()):
                rows = [(ids.astype(np.int32), len(ids), hashlib.sha256(decoded).hexdigest()) for ids, decoded in codec(source.value).encode(some)]
                yield pd.DataFrame(rows, columns=list(new))
        # other stages run in this worker too
        _CODECS.clear()
        load_vocabulary.cache_clear()
        give_back()

    # the columns go along under names that can't clash
    own = {c: f"in{i}" for i, c in enumerate(docs.columns) if c not in new}
    named = docs.select(*[F.col(c).alias(x) for c, x in own.items()])
    out = named.withColumn("bpe", both(null_to_empty(own["text"])))
    return out.select(*[F.col(x).alias(c) for c, x in own.items()], "bpe.*")
