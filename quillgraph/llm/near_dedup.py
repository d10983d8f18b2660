"""Near-duplicate documents by ProbMinHash, banding and verification (operator 1).

Five-word shingles, weighted by how often a text has them.  Every shingle sends out arrivals at exponential waiting
times, the faster the larger its weight, each to a random register; a register keeps its earliest arrival's shingle.
A shingle stops as soon as its next arrival is later than all registers of the text.  Two texts agree in a register
with their probability Jaccard similarity.  Registers are hashed in bands; texts that share a band are candidates.

Equal texts are one node.  Within a band's bucket, nodes are compared with its most central one first.  The buckets that
are still in several components are then compared in blocks inside tasks, by longer sketches of one bit a register; only
pairs of different components that may be similar leave a task, so that rows grow with links and not with pairs.
Candidates are verified by the exact similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SENT_ROWS, give_back, null_to_empty, table, written
from .components import components
from .word_hashes import arrow_slices, mix, window_hashes, words_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 36, 6
REGISTERS = BANDS * ROWS
#: Five standard deviations of the registers' estimate at the threshold.
SLACK = 5 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5
#: Registers of the longer sketches, of which one bit each is kept: two texts agree in a bit with probability (1 + similarity) / 2.
BITS = 2048
#: Four standard deviations of the similarity estimated from those bits, at the threshold.
BIT_SLACK = 4 * ((1 - THRESHOLD**2) / BITS) ** 0.5
#: Nodes of a bucket that are compared as one block.
BLOCK = 4096
GOLD = np.uint64(0x9E3779B97F4A7C15)


def weighted_shingles(hashes: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, shingle hash and count, sorted by text and hash.  A text of fewer words than ``size`` is one shingle."""
    every = window_hashes(hashes, size)
    words = np.diff(bounds)
    texts, shingles = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if len(every):
        owner = np.searchsorted(bounds, np.arange(len(every)), side="right") - 1
        inside = np.arange(len(every)) + size <= bounds[1:][owner]
        texts.append(owner[inside])
        shingles.append(every[inside])
    for i in np.flatnonzero((words > 0) & (words < size)).tolist():
        own = hashes[bounds[i] : bounds[i + 1]]
        texts.append(np.array([i]))
        shingles.append(mix(window_hashes(own, len(own)) + np.uint64(len(own))))
    text, shingle = np.concatenate(texts), np.concatenate(shingles)
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    starts = np.flatnonzero(fresh)
    return text[starts], shingle[starts], np.diff(np.append(starts, len(text)))


def prob_min_hash(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """The shingle of each register's earliest arrival; 0 throughout for texts without shingles.

    An arrival's time and register depend on the shingle and the arrival's number only, so that equal shingles act
    alike in all texts.  All texts proceed together: each round makes the next arrivals of the shingles still running.
    """
    first = np.full((texts, registers), np.inf)
    kept = np.zeros((texts, registers), np.uint64)
    clock, made, many = np.zeros(len(text)), 0, 4
    at, name, rate = text, shingle, weight.astype(float)
    while len(at):
        number = np.arange(made + 1, made + many + 1, dtype=np.uint64) * GOLD
        draw = mix(name[:, None] + number[None, :])
        waits = -np.log(((draw >> np.uint64(16)).astype(float) + 0.5) * 2.0**-48)
        time = clock[:, None] + np.cumsum(waits, axis=1) / rate[:, None]
        place = at[:, None] * registers + ((draw & np.uint64(0xFFFF)) * np.uint64(registers) >> np.uint64(16)).astype(np.int64)
        flat, place, name_of = time.ravel(), place.ravel(), np.repeat(name, many)
        better = flat < first.ravel()[place]
        flat, place, name_of = flat[better], place[better], name_of[better]
        np.minimum.at(first.ravel(), place, flat)
        won = flat == first.ravel()[place]
        kept.ravel()[place[won]] = name_of[won]
        clock, made = time[:, -1], made + many
        running = clock < first.max(axis=1)[at]
        at, name, rate, clock = at[running], name[running], rate[running], clock[running]
        many = min(64, many * 2)
    return kept


def band_keys(kept: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, the band's number included."""
    parts = kept.reshape(len(kept), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD, parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key + parts[:, :, r])
    return key


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common shingles d of 1 / sum over all e of max(x[e] / x[d], y[e] / y[d]); shingles sorted and distinct."""
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])], y[np.searchsorted(every, b[0])] = a[1], b[1]
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.maximum(y, 1e-300), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    xs, ys = np.cumsum(x[::-1])[::-1], np.cumsum(y) - y
    common = np.flatnonzero((x > 0) & (y > 0))
    begin = np.searchsorted(ratio, ratio[common], side="left")
    return float((1 / (xs[begin] / x[common] + ys[begin] / y[common])).sum())


def sketches(docs: DataFrame) -> DataFrame:
    """``d``, the text's 128-bit hash ``t1``, ``t2``, its band keys and one byte of each register; no row for a text without words' keys."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, some in arrow_slices(batch, "text"):
                _, _, _, hashes, bounds = words_of(some)
                kept = prob_min_hash(*weighted_shingles(hashes, bounds), j - i)
                keys = band_keys(kept).view(np.int64)
                bytes_ = (mix(kept) & np.uint64(255)).astype(np.uint8)
                words = np.diff(bounds) > 0
                names = ["d", "t1", "t2"]
                columns = [batch.column(c).slice(i, j - i) for c in names]
                bands = pa.array([k if w else [] for k, w in zip(keys, words.tolist(), strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*columns, bands, pa.array([x.tobytes() for x in bytes_], pa.binary())], [*names, "bands", "registers"])
        give_back()

    return docs.mapInArrow(make, "d long, t1 long, t2 long, bands array<long>, registers binary")


def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of registers in which two texts agree, from one byte of each."""
    if not len(a):
        return pd.Series([], dtype=float)
    x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
    return pd.Series((x == y).mean(axis=1))


def similarity(a: pd.Series, m: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([probability_jaccard((w, x), (y, z)) for w, x, y, z in zip(a, m, b, n, strict=True)], dtype=float)


def shingle_table(docs: DataFrame) -> DataFrame:
    """``node``, its sorted shingle hashes and their counts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, some in arrow_slices(batch, "text"):
                _, _, _, hashes, bounds = words_of(some)
                text, shingle, count = weighted_shingles(hashes, bounds)
                upto = np.searchsorted(text, np.arange(j - i + 1))
                order = [np.argsort(shingle[a:b].view(np.int64)) for a, b in zip(upto, upto[1:], strict=False)]
                spans = list(zip(upto, upto[1:], order, strict=False))
                shingles = pa.array([shingle[a:b].view(np.int64)[o] for a, b, o in spans], pa.list_(pa.int64()))
                counts = pa.array([count[a:b][o].astype(np.int32) for a, b, o in spans], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("d").slice(i, j - i), shingles, counts], ["node", "shingles", "counts"])
        give_back()

    return docs.select("d", "text").mapInArrow(make, "node long, shingles array<long>, counts array<int>")


def central_pivots(live: DataFrame) -> DataFrame:
    """``bucket`` and its ``pivot``: the node that meets the most others, over all its buckets.

    In a group of near copies that is the one nearest to what they all come from, and the same in most of its buckets.
    """
    met = live.groupBy("node").agg(F.sum("n").alias("met"))
    return live.join(met, "node").groupBy("bucket").agg(F.min(F.struct(-F.col("met"), "node")).alias("best")).select("bucket", F.col("best.node").alias("pivot"))


def relabelled(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``pairs`` (``a``, ``b``) with ``p`` and ``q``, the labels of both; those of one label are left out."""
    if labels is None:
        return pairs.select("a", "b", F.col("a").alias("p"), F.col("b").alias("q"))
    for c, name in (("a", "p"), ("b", "q")):
        pairs = pairs.join(labels.select(F.col("node").alias(c), F.col("label").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
    return pairs.where("p <> q")


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after the components of ``links`` (between labels ``p`` and ``q``) have grown together."""
    found = components(links.select(F.col("p").alias("u"), F.col("q").alias("v")))
    if labels is None:
        return found
    moved = labels.join(found.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    return written(moved.select("node", F.coalesce("to", "label").alias("label")).union(found), "labels", fewer=16)


class Shingles:
    """Shingle sets of the nodes that some candidate needs, each made once."""

    def __init__(self, docs: DataFrame):
        self.docs, self.made = docs, None

    def of(self, wanted: DataFrame) -> DataFrame:
        """The sets of all nodes so far and of those in ``wanted`` (``d``)."""
        wanted = wanted.distinct()
        if self.made is not None:
            wanted = wanted.join(self.made.select(F.col("node").alias("d")), "d", "left_anti")
        wanted = written(wanted, "wanted", fewer=16)
        if wanted.count() <= SENT_ROWS:
            wanted = F.broadcast(wanted)
        more = written(shingle_table(self.docs.join(wanted, "d", "left_semi")), "shingles", fewer=4)
        self.made = more if self.made is None else self.made.union(more)
        return self.made

    def judge(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with ``same``: whether their similarity reaches the threshold."""
        similar, every = F.pandas_udf(similarity, "double"), self.of(pairs.select(F.explode(F.array("a", "b")).alias("d")))
        for c in "ab":
            pairs = pairs.join(every.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"), F.col("counts").alias(f"n{c}")), c)
        return written(pairs.select("a", "b", "p", "q", (similar("sa", "na", "sb", "nb") >= THRESHOLD).alias("same")), "judged", fewer=16)


def bit_sketches(sets: DataFrame) -> DataFrame:
    """``node`` and ``sketch``: the lowest bits of ``BITS`` registers, packed, of shingle sets (``shingle_table``)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                sizes = some.column("shingles").value_lengths().to_numpy(zero_copy_only=False)
                shingle, count = [some.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("shingles", "counts")]
                kept = prob_min_hash(np.repeat(np.arange(len(sizes)), sizes), shingle.view(np.uint64), count, len(sizes), BITS)
                bits = np.packbits((mix(kept) & np.uint64(1)).astype(np.uint8), axis=1)
                yield pa.RecordBatch.from_arrays([some.column("node"), pa.array([x.tobytes() for x in bits], pa.binary())], ["node", "sketch"])
        give_back()

    return sets.select("node", "shingles", "counts").mapInArrow(make, "node long, sketch binary")


def close_pairs(
    bits: np.ndarray, other: np.ndarray, label: np.ndarray, other_label: np.ndarray, mine: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of different labels whose sketches say that they may be similar enough, and that are ``mine`` to tell.

    Of those that surely are, one for each pair of labels: it ties them.
    """
    found_i, found_j, sure = [], [], {}
    most = int((1 - (THRESHOLD - BIT_SLACK)) / 2 * BITS)  # differing bits
    few = int((1 - (THRESHOLD + BIT_SLACK)) / 2 * BITS)
    rows = max(1, (1 << 20) // max(1, other.size))
    for at in range(0, len(bits), rows):
        apart = np.bitwise_count(bits[at : at + rows, None, :] ^ other[None, :, :]).sum(axis=2, dtype=np.int32)
        i, j = np.nonzero((apart <= most) & (label[at : at + rows, None] != other_label[None, :]))
        if mine is not None:
            own = mine(at + i, j)
            i, j = i[own], j[own]
        close = apart[i, j] <= few
        found_i.append(at + i[~close])
        found_j.append(j[~close])
        for x, y in zip((at + i[close]).tolist(), j[close].tolist(), strict=True):
            sure.setdefault((min(label[x], other_label[y]), max(label[x], other_label[y])), (x, y))
    found_i.append(np.array([x for x, _ in sure.values()], np.int64))
    found_j.append(np.array([y for _, y in sure.values()], np.int64))
    return np.concatenate(found_i), np.concatenate(found_j)


def short(key):
    """A band's key in 31 bits."""
    return F.pmod(key, F.lit((1 << 31) - 1)).cast("int")


def bucket_pairs(live: DataFrame, known: DataFrame, block: int | None = None) -> DataFrame:
    """Pairs ``a`` > ``b`` of different labels that share a bucket and may be similar enough, by their longer sketches.

    ``live``: node, bucket, n (the bucket's nodes).  ``known``: node, label, sketch, bands (in ``short``).  A bucket of more
    than ``block`` nodes is dealt out to blocks, and every pair of blocks is a group of its own.  Groups are read one after
    the other from sorted rows: a task holds two blocks at most.  Nodes that share several buckets are told in the first.
    """
    block = block or BLOCK
    rows = live.join(known, "node").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = rows.select("bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "label", "sketch", "bands", short(F.col("bucket")).alias("key"))

    def pairs(group: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        some = pa.Table.from_batches(group).combine_chunks()
        own, node, label = [some.column(c).to_numpy() for c in ("own", "node", "label")]
        if len(node) < 2 or (label == label[0]).all():
            return None
        bits = np.frombuffer(b"".join(some.column("sketch").to_pylist()), "<u8").reshape(len(node), -1)
        p, q = int(some.column("p")[0].as_py()), int(some.column("q")[0].as_py())
        left, right = (np.flatnonzero(own == p), np.flatnonzero(own == q)) if p != q else (np.arange(len(node)),) * 2
        bands, key = some.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1), some.column("key")[0].as_py()

        def here(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            x = bands[left[i]]
            first = (x == bands[right[j]]).argmax(axis=1)
            return x[np.arange(len(x)), first] == key

        i, j = close_pairs(bits[left], bits[right], label[left], label[right], here)
        a, b = node[left[i]], node[right[j]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("bucket", "p", "q")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for begin, end in zip(edges, edges[1:], strict=False):
                if (mine := tuple(keys[begin].tolist())) != key:
                    if group and (out := pairs(group)) is not None:
                        yield out
                    group, key = [], mine
                group.append(batch.slice(begin, end - begin))
        if group and (out := pairs(group)) is not None:
            yield out
        give_back()

    sorted_ = sent.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    return sorted_.mapInArrow(compare, "a long, b long").distinct()


def links_between(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node``, ``label``: the components of verified links between ``nodes`` (node, bands, registers); ``docs``: d, text.

    Nodes without links may be missing.  Each bucket's nodes are compared with its pivot first.  Buckets that are then in
    several components are compared as a whole, in blocks.
    """
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    several = rows.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count("*").cast("int").alias("n")).where("x < y")
    live = written(rows.join(several.select("bucket", "n"), "bucket"), "buckets", fewer=4)
    registers, agree = nodes.select("node", "registers"), F.pandas_udf(agreement, "double")

    def near(pairs: DataFrame) -> DataFrame:
        for c, name in (("a", "x"), ("b", "y")):
            pairs = pairs.join(registers.select(F.col("node").alias(c), F.col("registers").alias(name)), c)
        return written(pairs.where(agree("x", "y") >= THRESHOLD - SLACK).select("a", "b"), "candidates", fewer=16)

    shingles = Shingles(docs)
    pairs = live.join(central_pivots(live), "bucket").where("node <> pivot")
    judged = shingles.judge(relabelled(near(pairs.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()), None))
    labels = merged(None, judged.where("same"))
    # on with the buckets that are neither of one component nor fully compared
    left = live.where("n > 2")
    named = left.join(labels, "node", "left").select("bucket", F.coalesce("label", "node").alias("label"))
    apart = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y")
    live = written(left.join(apart.select("bucket"), "bucket", "left_semi"), "buckets", fewer=4)
    if live.limit(1).count():
        left = live.select("node").distinct()
        sets = shingles.of(left.withColumnRenamed("node", "d")).join(left, "node", "left_semi").dropDuplicates(["node"])
        known = bit_sketches(sets).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        known = known.join(nodes.select("node", F.transform("bands", short).alias("bands")), "node")
        pairs = written(bucket_pairs(live, written(known, "bit-sketches", fewer=4)), "close-pairs", fewer=16)
        labels = merged(labels, shingles.judge(relabelled(pairs.join(judged.select("a", "b"), ["a", "b"], "left_anti"), labels)).where("same"))
    return labels


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and ``class_id``, the smallest id of the documents it is linked with, directly or not.

    Documents are linked if their texts are equal or the probability Jaccard similarity of their weighted five-word
    shingles is 0.8 or more.  Texts of one to four words are one shingle; texts without words (null texts too) are
    linked to equal ones only.  Rows that repeat an id are one document and give one row.  A null id has the class null
    and links nothing; each such row is kept.
    """
    whole = null_to_empty(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), whole.alias("text"))
    keyed = rows.where("d IS NOT NULL").select("d", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    sketch = written(sketches(keyed), "sketches")
    # one node for equal texts: that of the smallest id
    same = sketch.groupBy("t1", "t2").agg(F.min(F.struct("d", "bands", "registers")).alias("s"))
    same = written(same.select("t1", "t2", F.col("s.d").alias("node"), "s.bands", "s.registers"), "distinct-sketches", fewer=4)
    labels = links_between(same.where(F.size("bands") > 0).select("node", "bands", "registers"), rows.where("d IS NOT NULL"))
    of = sketch.select("d", "t1", "t2").join(same.select("t1", "t2", "node"), ["t1", "t2"]).groupBy("d").agg(F.min("node").alias("node"), F.max("node").alias("other"))
    of = written(of, "nodes", fewer=4)
    # ids with several texts tie their nodes together
    ties = of.where("node < other").select(F.col("node").alias("q"), F.col("other").alias("p"))
    if ties.limit(1).count():
        labels = merged(labels, relabelled(ties.select(F.col("p").alias("a"), F.col("q").alias("b")), labels))
    out = of.join(labels, "node", "left").select(F.col("d").alias("doc_id"), F.coalesce("label", "node").alias("class_id"))
    return out.union(rows.where("d IS NULL").select(F.col("d"), F.lit(None).cast("long")))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest id, which is the class's id.  Rows without id all stay.

    Of rows that repeat a kept id, the one with the least text stays (null first).
    """
    every = written(near_duplicate_classes(docs).where("doc_id IS NOT NULL"), "classes")
    gone = every.where("doc_id <> class_id").select("doc_id")
    if gone.count() <= SENT_ROWS:
        gone = F.broadcast(gone)
    stay = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids", fewer=16)
    if not again.limit(1).count():
        return stay
    whole = stay.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text")).alias("row"))
    return stay.join(again, "doc_id", "left_anti").select(docs.columns).union(whole.select("row.*"))
