"""Token counts by a compiled finite-state transducer (operator 2).

The BPE of a word is followed from left to right: after each base symbol the machine knows the last token of the
encoding of what it has read.  A longer token may still cover several of those symbols, so a state keeps, for every
suffix that begins some token, the suffix's node in the token trie, the last token before that suffix and how many
tokens fewer the encoding had there.  There are finitely many such states; a transition carries the change in the
number of tokens.  Word ends lead back to the start state, whatever the state was.

States are compiled when first met (as in lazily determinised automata) into two dense tables, so stepping is array
indexing over many chunks at once.  A chunk's *state map* sends an entry state to (exit state, tokens emitted).  Of a map
only one entry is worked out at first, the one that the symbols since the last word end (``LOOK`` at most) lead to.  Maps
of neighbouring chunks are composed by a parallel prefix scan, where the exit of one is the entry worked out for the
next.  Where it isn't, as may happen in words longer than ``LOOK``, the right entry is worked out and scanned again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, null_to_empty, table
from .tokenizer_files import tokenizer_source
from .word_symbols import Vocabulary, load_vocabulary, pieces, symbols

START = 0
#: Symbols before a chunk from which its entry state is first guessed.
LOOK = 64


class CountingTransducer:
    """A lazily compiled deterministic transducer that counts the tokens of base-symbol streams.

    ``max_states`` bounds the tables: beyond it they are dropped and compiled anew, which changes time, not results.
    """

    def __init__(self, vocab: Vocabulary, max_states: int = 120_000):
        self.merge, self.max_states = vocab.merge, max_states
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.parts: dict[int, tuple[int, ...]] = {i: (i,) for i in range(512)}
        for (a, b), made in vocab.merge.items():
            self.parts[made] = self.parts[a] + self.parts[b]
        for token, path in self.parts.items():
            node = 0
            for s in path:
                nxt = self.children[node].get(s)
                if nxt is None:
                    nxt = self.children[node][s] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = token
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.column = np.full(512, -1, np.int32)
        self.width = 0
        self.states: dict[tuple, int] = {((0, -1, 0),): START}
        self.keys: list[tuple] = [((0, -1, 0),)]
        self.next = np.full((1024, 64), -1, np.int32)
        self.delta = np.zeros((1024, 64), np.int8)

    def neighbours(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' symbols is just these two tokens."""
        if left < 0:
            return True
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            seq = [*self.parts[left], *self.parts[right]]
            while len(seq) > 1:
                rank, i = min(((self.merge.get(p, 1 << 30), i) for i, p in enumerate(zip(seq, seq[1:], strict=False))))
                if rank == 1 << 30:
                    break
                seq[i : i + 2] = [rank]
            known = self.fits[left, right] = seq == [left, right]
        return known

    def compile(self, state: int, symbol: int) -> None:
        """Fill in one transition."""
        final, entries, found = symbol >= 256, [], None
        for node, last, behind in self.keys[state]:
            child = self.children[node].get(symbol)
            if child is None:
                continue
            token = self.token_at[child]
            if found is None and token >= 0 and self.neighbours(last, token):
                found = (token, 1 - behind)
            if not final and self.children[child]:
                entries.append((child, last, behind))
        token, delta = found
        column = self.column[symbol]
        if column < 0:
            if self.width == self.next.shape[1]:
                self.next = np.pad(self.next, ((0, 0), (0, 32)), constant_values=-1)
                self.delta = np.pad(self.delta, ((0, 0), (0, 32)))
            column = self.column[symbol] = self.width
            self.width += 1
        if final:
            target = START
        else:
            key = (*((child, last, behind + delta) for child, last, behind in entries), (0, token, 0))
            target = self.states.get(key)
            if target is None:
                target = self.states[key] = len(self.keys)
                self.keys.append(key)
                if target >= len(self.next):
                    more = max(1024, len(self.next) // 4)
                    self.next = np.pad(self.next, ((0, more), (0, 0)), constant_values=-1)
                    self.delta = np.pad(self.delta, ((0, more), (0, 0)))
        self.next[state, column], self.delta[state, column] = target, delta

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One transition of many machines."""
        column = self.column[symbol]
        target = self.next[state, column]
        if (missing := np.flatnonzero((target < 0) | (column < 0))).size:
            for s, c in set(zip(state[missing].tolist(), symbol[missing].tolist(), strict=True)):
                if self.column[c] < 0 or self.next[s, self.column[c]] < 0:
                    self.compile(s, c)
            column = self.column[symbol]
            target = self.next[state, column]
        return target, self.delta[state, column]

    def run(self, stream: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and emitted tokens of the stretches [begin, end) of ``stream`` entered in ``state``."""
        exits, counts = state.astype(np.int32).copy(), np.zeros(len(begin), np.int64)
        order = np.argsort(begin - end, kind="stable")  # longest first: those still running are a prefix
        sizes = (end - begin)[order]
        at, now, sums = begin[order], exits[order], np.zeros(len(begin), np.int64)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            now[:live], made = self.step(now[:live], stream[at[:live] + t])
            sums[:live] += made
        exits[order], counts[order] = now, sums
        return exits, counts

    def count(self, stream: np.ndarray, begins: np.ndarray, chunk: int = 256) -> np.ndarray:
        """Tokens of each piece; piece i is ``stream[begins[i]:begins[i + 1]]`` and enters in the start state."""
        if len(self.keys) > self.max_states:
            self.reset()
        sizes = np.diff(begins)
        per = -(-sizes // chunk)
        piece = np.repeat(np.arange(len(sizes)), per)
        if not len(piece):
            return np.zeros(len(sizes), np.int64)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(per) - per, per)
        begin = begins[:-1][piece] + nth * chunk
        end = np.minimum(begin + chunk, begins[1:][piece])
        ends = np.flatnonzero(stream >= 256)
        last = np.append(-1, ends)[np.searchsorted(ends, begin)] + 1  # after the last word end before the chunk
        look = np.maximum(np.maximum(last, begins[:-1][piece]), begin - LOOK)
        entry, _ = self.run(stream, look, begin, np.zeros(len(piece), np.int32))
        exits, tokens = self.run(stream, begin, end, entry)
        while True:
            total, sound = self.scan(entry, exits, tokens, nth == 0)
            if sound.all():
                break
            wrong = np.flatnonzero((nth > 0) & (entry != np.roll(exits, 1)))
            entry[wrong] = exits[wrong - 1]
            exits[wrong], tokens[wrong] = self.run(stream, begin[wrong], end[wrong], entry[wrong])
        done = np.flatnonzero(per)  # pieces with a chunk; their last ones hold the sums
        out = np.zeros(len(sizes), np.int64)
        out[done] = total[np.cumsum(per)[done] - 1]
        return out

    @staticmethod
    def scan(entry: np.ndarray, exits: np.ndarray, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens from the piece's start to the end of every chunk, and whether all maps on the way fit together.

        Every chunk's map is composed with that of the stretch to its left, all at once; the stretches double each time.
        """
        entry, tokens, begun, sound = entry.copy(), tokens.copy(), first.copy(), np.ones(len(entry), bool)
        reach = 1
        while not begun.all():
            right = np.flatnonzero(~begun)
            left = right - reach
            fits = sound[right] & sound[left] & (exits[left] == entry[right])
            entry[right], tokens[right], begun[right], sound[right] = entry[left], tokens[right] + tokens[left], begun[left], fits
            reach *= 2
        return tokens, sound


_MACHINES: dict[str, tuple[Vocabulary, CountingTransducer]] = {}


def machine(source: str) -> tuple[Vocabulary, CountingTransducer]:
    """The vocabulary and transducer of this Python worker; states compiled for one task serve the next."""
    if source not in _MACHINES:
        _MACHINES.clear()
        vocab = load_vocabulary(source)
        _MACHINES[source] = vocab, CountingTransducer(vocab)
    return _MACHINES[source]


def count_texts(texts: list[str], source: str, slice_chars: int = 2_000_000) -> np.ndarray:
    """Tokens of each text.  Slices of about ``slice_chars`` characters (one text at least) bound the memory."""
    vocab, counter = machine(source)
    out = np.zeros(len(texts), np.int64)
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and (j == i or chars + len(texts[j]) <= slice_chars):
            chars += len(texts[j])
            j += 1
        normal, owner, after = pieces(texts[i:j], vocab)
        stream, begins = symbols(normal)
        found = counter.count(stream, begins) + (np.asarray(after) >= 0)
        out[i:j] = np.bincount(owner, found, j - i).astype(np.int64)
        i = j
    return out


def token_counts(docs: DataFrame, text: str = "text", tokenizer_path: str | None = None, output: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text, special strings inside texts counting one each.

    A null text counts as empty (0 tokens).  No shuffle: each task counts its rows batch by batch.
    """
    source = tokenizer_source(docs.sparkSession, tokenizer_path)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(count_texts(batch.tolist(), source.value))
        give_back()

    return docs.withColumn(output, count(null_to_empty(text)))


#: Longest context of the reported limit.
CONTEXT = 2048


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs).select(
        "doc_id",
        F.octet_length(null_to_empty()).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > CONTEXT).alias("over_limit"),
    )
