"""Benchmark decontamination by SimHash of item-sized windows (operator 4).

For every item, windows of as many words slide over the documents.  Window and item get a 256-bit SimHash of their
weighted five-word shingles, cut into 16 blocks of 16 bits.  An item is listed under each value of each of its blocks with
at most one bit flipped, and a window asks for its own blocks' values with at most one bit flipped, so that they meet where
a block differs in at most two bits: 272 lookups a window, however many items there are.  Two fingerprints at most SURE
bits apart have such a block, so all of them are found; of those farther apart, nearly all up to RADIUS.  4 % of unrelated
items have such a block.

Fingerprints of similar shingles that repeat much may differ in any number of bits: a shingle that counts forty times
weighs forty times in every bit.  An item's rarest shingles, so many that a window without all of them can't be similar,
find what the fingerprints don't.  Every item found either way is verified by its exact weighted similarity to each window
of the text, in one sweep over the shingles they share.

A window that shares no shingle with an item of its size can't reach any similarity with one, so only windows around
shared shingles are fingerprinted.

Words are compared without case and punctuation; a word of nothing else is skipped.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, null_to_empty, table, written
from .word_hashes import mix, text_slices, window_hashes, word_hashes, words_of

SHINGLE = 5
THRESHOLD = 0.8
BITS, BLOCKS = 256, 16
#: Bits that may differ when one of the blocks surely differs in two at most.
SURE = 3 * BLOCKS - 1
#: Similarity 0.8 without repeated shingles is a cosine of 0.89, so fingerprints differ in 39 bits on average; 5.7 is the standard deviation.
RADIUS = 62
HITS = "array<struct<item_id: long, start: int, words: int, distance: int, similarity: double>>"
#: Pairs of a window and an item that may be looked up at a time.
TILE = 1 << 20
#: Items of a slice; each is listed 272 times.
SLICE_ITEMS = 50_000
#: What a lookup changes in a block's value: nothing or one bit.
FLIPS = np.array([0, *(1 << b for b in range(16))], np.uint32)
_SPACE = re.compile("[\x20\x09-\x0d]")


@cache
def character_kinds() -> np.ndarray:
    """For each code point 1 if it is punctuation or a symbol, 2 if it separates words, else 0."""
    kinds = np.fromiter((unicodedata.category(chr(c))[0] in "PS" for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    kinds[[32, *range(9, 14)]] = 2
    return kinds


def fold_slice(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the folded words, where each text's begin, their places among all raw words, where each text's raw words begin."""
    texts = [t.casefold() for t in texts]
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    kinds = character_kinds()[data]
    edge = np.diff(np.concatenate([[False], kinds != 2, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept = kinds == 0
    before = np.concatenate([[0], np.cumsum(kept)])
    first, last = before[begin], before[end]
    place = np.flatnonzero(last > first)
    raw = np.searchsorted(begin, np.cumsum([0] + [len(t) + 1 for t in texts]))
    return word_hashes(data[kept], first[place], last[place]), np.searchsorted(place, raw), place, raw


def folded_words(texts: list[str], size: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words without case and punctuation, where each text's begin, and each word's place among its text's raw words.

    Words left empty are dropped.  A single text is taken in pieces of about ``size`` characters, to bound the memory.
    """
    if len(texts) > 1 or len(texts[0]) <= size:
        hashes, bounds, place, raw = fold_slice(texts)
        return hashes, bounds, place - np.repeat(raw[:-1], np.diff(bounds))
    parts, places, passed, at = [], [], 0, 0
    while at < len(texts[0]):
        space = _SPACE.search(texts[0], at + size)
        stop = space.start() if space else len(texts[0])
        hashes, _, place, raw = fold_slice([texts[0][at:stop]])
        parts.append(hashes)
        places.append(place + passed)
        passed += int(raw[-1])
        at = stop
    hashes = np.concatenate(parts)
    return hashes, np.array([0, len(hashes)]), np.concatenate(places)


def fingerprints(shingles: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every run of ``width`` shingles, as 32-bit integers; a shingle counts as often as it occurs."""
    out, step = [], 4096  # windows at a time, to bound the memory
    for i in range(0, len(shingles) - width + 1, step):
        some = shingles[i : i + step + width - 1]
        longer = [some]
        while len(longer) < BITS // 64:
            longer.append(mix(longer[-1]))
        bits = np.unpackbits(np.stack(longer, axis=1).view(np.uint8), axis=1)
        sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
        out.append(np.packbits(2 * (sums[width:] - sums[:-width]) > width, axis=1).view(np.uint32))
    return np.concatenate(out)


def overlap_needed(a: int, b: int) -> int:
    """How many shingles two lists of ``a`` and ``b`` must share to have a weighted similarity of 0.8: 9 x >= 4 (a + b)."""
    return -(-4 * (a + b) // 9)


def block_values(prints: np.ndarray) -> np.ndarray:
    """The values of the blocks of each fingerprint, with the block's number in their upper half."""
    return prints.view(np.uint16) + (np.arange(BLOCKS, dtype=np.uint32) << np.uint32(16))


def each_of(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``count`` places from ``begin``: the range and the place of every one of their places."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - (np.cumsum(count) - count - begin)[which]


class SizeIndex:
    """The items of one number of words."""

    def __init__(self, words: int, ids: list[int], hashes: list[np.ndarray]):
        self.words, self.ids = words, np.array(ids)
        self.gram = min(SHINGLE, words)
        self.width = words - self.gram + 1
        self.shingles = [window_hashes(h, self.gram) for h in hashes]
        self.prints = np.concatenate([fingerprints(s, self.width) for s in self.shingles])
        self.known = np.unique(np.concatenate(self.shingles))
        # the items under each value that one of their blocks is at most a bit away from, and where each value's begin
        values = (block_values(self.prints)[:, :, None] ^ FLIPS).reshape(-1)
        order = np.argsort(values, kind="stable")
        self.values, begin = np.unique(values[order], return_index=True)
        self.begin = np.append(begin, len(values))
        self.listed = (order // (BLOCKS * len(FLIPS))).astype(np.int32)
        self.counted = [np.unique(s, return_counts=True) for s in self.shingles]
        self._list_rare()

    def _list_rare(self) -> None:
        """The items under each of their rarest shingles, so many that no window without all of these is similar."""
        held, holders = np.unique(np.concatenate([values for values, _ in self.counted]), return_counts=True)
        lost = self.width - overlap_needed(-(-4 * self.width // 5), self.width) + 1
        rare = []
        for values, counts in self.counted:
            order = np.argsort(holders[np.searchsorted(held, values)], kind="stable")
            rare.append(values[order[: np.searchsorted(np.cumsum(counts[order]), lost) + 1]])
        values = np.concatenate(rare)
        order = np.argsort(values, kind="stable")
        self.rare, begin = np.unique(values[order], return_index=True)
        self.rare_begin = np.append(begin, len(values))
        self.rare_items = np.repeat(np.arange(len(rare)), [len(r) for r in rare])[order]

    def sharing(self, shingles: np.ndarray) -> np.ndarray:
        """The items of which one of the rarest shingles is among these."""
        at = np.minimum(np.searchsorted(self.rare, shingles), len(self.rare) - 1)
        at = np.unique(at[self.rare[at] == shingles])
        return np.unique(self.rare_items[each_of(self.rare_begin[at], self.rare_begin[at + 1] - self.rare_begin[at])[1]])

    def best_window(self, item: int, shingles: np.ndarray, places: np.ndarray, width: int, last: int) -> tuple[int, int]:
        """The most shingles that an item shares with a window of ``width``, and the first window (0 to ``last``) that has so many.

        ``shingles`` and their ascending ``places`` are those of a text that the item may have.  One counts in the windows
        that hold it but hold it less often before than the item has it.
        """
        known, counts = self.counted[item]
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        own = np.flatnonzero(known[at] == shingles)
        if len(own) < overlap_needed(width, self.width):
            return 0, 0
        own = own[np.argsort(at[own], kind="stable")]
        at, place, n = at[own], places[own], np.arange(len(own))
        full = n - np.searchsorted(at, at) >= counts[at]
        low = np.maximum(np.maximum(place - width, np.where(full, place[np.maximum(n - counts[at], 0)], -1)) + 1, 0)
        high = np.minimum(place, last)
        counted = low <= high
        low, high = np.sort(low[counted]), np.sort(high[counted])
        shared = np.searchsorted(low, low, side="right") - np.searchsorted(high, low)
        best = int(shared.argmax())
        return int(shared[best]), int(low[best])

    def looked_up(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a window and an item that have a block at most two bits apart, each once."""
        asked, which = np.unique(block_values(prints), return_inverse=True)
        probes = asked[:, None] ^ FLIPS
        at = np.minimum(np.searchsorted(self.values, probes), len(self.values) - 1)
        value, probe = np.nonzero(self.values[at] == probes)
        at = at[value, probe]
        which_list, place = each_of(self.begin[at], self.begin[at + 1] - self.begin[at])
        found = np.unique(value[which_list] * len(self.ids) + self.listed[place])  # of each value asked, the items near it
        value, item = found // len(self.ids), found % len(self.ids)
        count = np.bincount(value, minlength=len(asked))
        which = which.reshape(-1)
        block, place = each_of((np.cumsum(count) - count)[which], count[which])
        pair = np.unique(block // BLOCKS * len(self.ids) + item[place])
        return pair // len(self.ids), pair % len(self.ids)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a window and an item at most RADIUS bits apart that have a near block (all up to SURE), and their distance."""
        windows, items, distances = [], [], []
        step = max(16, TILE // len(self.ids))
        for i in range(0, len(prints), step):
            window, item = self.looked_up(prints[i : i + step])
            distance = np.bitwise_count(prints[i + window] ^ self.prints[item]).sum(axis=1, dtype=np.int64)
            inside = distance <= RADIUS
            windows.append(i + window[inside])
            items.append(item[inside])
            distances.append(distance[inside])
        return np.concatenate(windows), np.concatenate(items), np.concatenate(distances)


class ItemIndex:
    """All items, by their number of words, and a filter of their shingles."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        by_size: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        for item, hashes in items:
            if len(hashes):
                ids, lists = by_size.setdefault(len(hashes), ([], []))
                ids.append(item)
                lists.append(hashes)
        self.sizes = [SizeIndex(n, *by_size[n]) for n in sorted(by_size)]
        self.grams = sorted({s.gram for s in self.sizes})
        self.filters = {}
        for g in self.grams:
            known = np.unique(np.concatenate([s.known for s in self.sizes if s.gram == g]))
            bits = np.zeros(1 << max(20, int(len(known) * 32).bit_length()), bool)
            bits[known & np.uint64(len(bits) - 1)] = True
            self.filters[g] = known, bits

    def find(self, hashes: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple]]:
        """Hits of each text that has any: item, first word, words, distance, similarity; the best window of each item."""
        out: dict[int, dict[int, tuple]] = {}
        for gram in self.grams:
            known, bits = self.filters[gram]
            every = window_hashes(hashes, gram)
            at = np.flatnonzero(bits[every & np.uint64(len(bits) - 1)])
            at = at[np.isin(every[at], known)]
            owner = np.searchsorted(bounds, at, side="right") - 1
            inside = at + gram <= bounds[owner + 1]
            at, owner = at[inside], owner[inside]
            if not len(at):
                continue
            for size in self.sizes:
                if size.gram == gram:
                    mine = np.isin(every[at], size.known)
                    for text in np.unique(owner[mine]).tolist():
                        self.find_in(out.setdefault(text, {}), size, every, at[mine & (owner == text)], bounds[text], bounds[text + 1])
        return {t: [(i, *h) for i, h in sorted(hits.items())] for t, hits in out.items() if hits}

    def find_in(self, best: dict[int, tuple], size: SizeIndex, every: np.ndarray, at: np.ndarray, first: int, last: int) -> None:
        """Windows of one text that hold one of the shingles at ``at``; a text shorter than the items is its only window."""
        count = int(last - first) - size.gram + 1
        width = min(count, size.width)
        if 5 * width < 4 * size.width:  # the shorter has at most this share of the longer's shingles
            return
        low = np.maximum(at - width + 1, first)
        high = np.minimum(at, first + count - width)
        cut = np.flatnonzero(low[1:] > np.maximum.accumulate(high)[:-1] + 1) + 1
        found = [size.sharing(every[at])]
        for a, b in zip(np.append(0, cut), np.append(cut, len(low)), strict=True):
            begin, end = int(low[a]), int(high[a:b].max())
            found.append(size.candidates(fingerprints(every[begin : end + width], width))[1])
        words = width + size.gram - 1
        for item in np.unique(np.concatenate(found)).tolist():
            shared, start = size.best_window(item, every[at], at - first, width, count - width)
            if shared < overlap_needed(width, size.width):
                continue
            similar, key = shared / (width + size.width - shared), int(size.ids[item])
            if key in best and (best[key][3], -best[key][0] if best[key][1] == words else 0) >= (similar, -start if best[key][1] == words else 0):
                continue
            mine = fingerprints(every[first + start : first + start + width], width)[0]
            best[key] = (start, words, int(np.bitwise_count(mine ^ size.prints[item]).sum()), similar)


class Benchmark:
    """Items by their folded words; those of punctuation only, which have none, by their raw words."""

    def __init__(self, items: list[tuple[int, str]]):
        folded = [(item, folded_words([text])[0], text) for item, text in items]
        self.folded = ItemIndex([(item, hashes) for item, hashes, _ in folded])
        self.raw = ItemIndex([(item, words_of([text.encode()])[3]) for item, hashes, text in folded if not len(hashes)])

    def find(self, texts: list[str], data: list[bytes]) -> dict[int, list[tuple]]:
        """As ``ItemIndex.find``; first word and words count the raw words of a text."""
        hashes, bounds, place = folded_words(texts)
        out = {}
        for text, hits in self.folded.find(hashes, bounds).items():
            mine = place[bounds[text] : bounds[text + 1]]
            out[text] = [(item, int(mine[at]), int(mine[at + words - 1] - mine[at]) + 1, *rest) for item, at, words, *rest in hits]
        if self.raw.sizes:
            _, _, _, hashes, bounds = words_of(data)
            for text, hits in self.raw.find(hashes, bounds).items():
                out[text] = sorted(out.get(text, []) + hits)
        return out


_INDEXES: dict[str, Benchmark] = {}


def item_slices(benchmark: DataFrame, max_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in slices of about ``max_bytes`` and SLICE_ITEMS, one after the other: each is sent to every executor."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    total, count = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    slices = max(-(-(total or 0) // max_bytes), -(-count // SLICE_ITEMS))
    for i in range(slices):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i) if slices > 1 else items
        yield [(r.item_id, r.text) for r in some.collect()]


def finder(sent: Broadcast):
    """A column function from texts to their hits among the items sent."""
    key = uuid.uuid4().hex

    @F.pandas_udf(HITS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[key] = Benchmark(sent.value)
        names = ("item_id", "start", "words", "distance", "similarity")
        for batch in batches:
            texts = batch.tolist()
            out: list[list[dict]] = [[] for _ in texts]
            for i, j, some in text_slices(texts):
                for k, hits in _INDEXES[key].find(texts[i:j], some).items():
                    out[i + k] = [dict(zip(names, h, strict=True)) for h in hits]
            yield pd.Series(out, dtype=object)
        give_back()

    return find


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", output: str = "hits", max_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with an array of the benchmark items found in each whole text, in a column of the name ``output``.

    A hit is an item with a window of as many words whose weighted five-word shingles (the whole, for items of fewer
    words) have a similarity of 0.8 or more; of several windows the most similar, then the first.  A text shorter than an
    item is its one window.  Words are compared without case and punctuation, and words of punctuation only are skipped
    (an item of nothing else is compared as it is); ``start`` and ``words`` count the text's words as they stand.  Null
    and empty texts have no hits; null and empty items are never found; rows may repeat and their ids may be null.  A
    column of ``docs`` that has the name ``output`` is replaced.

    No similar pair is left out.  The benchmark goes to the executors in slices of ``max_bytes``, one at a time: with more
    than one, the documents are written to the shared folder before the next.  There is no shuffle.
    """
    spark, names = docs.sparkSession, [c for c in docs.columns if c != output]
    own = {c: f"in{i}" for i, c in enumerate(names)}  # names that can't clash
    rows, sent = docs.select(*[F.col(c).alias(x) for c, x in own.items()], F.array().cast(HITS).alias("hits")), None
    for items in item_slices(benchmark, max_bytes):
        if sent is not None:
            rows = written(rows, "hits")
            sent.destroy()
        sent = spark.sparkContext.broadcast(items)
        rows = rows.withColumn("hits", F.concat("hits", finder(sent)(null_to_empty(own[text]))))
    return rows.select(*[F.col(x).alias(c) for c, x in own.items()], F.col("hits").alias(output))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_hits(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a hit; any columns they have stay."""
    named = docs.toDF(*[c if c == "text" else f"in_{c}" for c in docs.columns])
    left = with_hits(named, table(spark, sf_dir, "benchmark"))
    return left.where(F.size("hits") == 0).drop("hits").toDF(*docs.columns)
