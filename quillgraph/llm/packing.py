"""Hierarchical packing of documents into windows of several lengths (operator 12).

A document is its token ids and an end id.  Whole windows of the longest tier are cut off its front; what remains is routed
to the shortest tier that holds it.  Tiers are packed from the longest on: the largest remainder opens a window, its gap is
filled with the largest remainders of shorter tiers that fit whole, and at last with the front of the smallest one that
does not.  So every window but the last of a task is full; that one is cut into full windows of smaller powers of two.
Nothing is padded, and a document is cut only where a gap is smaller than all that is left.

Tasks pack what they read, slice by slice.  The windows are numbered over all tasks by counts of windows a task and tier,
and dealt to steps so that each step has the same number of windows of each tier, give or take one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_tokens import BYTE_BPE, byte_tokens
from .common import SENT_ROWS, give_back, null_to_empty, table, written
from .tokenizer_files import default_path, tokenizer_source

TIERS = (1024, 512, 256, 128)
END_ID = 0
#: Tokens a step has, about.
STEP_TOKENS = 1 << 20
#: Tokens whose remainders are packed together.
SLICE_TOKENS = 1 << 22
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, tier int, task int, place long, offset long, ids array<int>"
NUMBERED = ("start", "length", "ids_crc32", "doc_tokens", "tier", "step", "sequence_id", "offset")


class Pool:
    """Remainders by size: the largest up to a size and the smallest over it are found by bits of one integer."""

    def __init__(self, most: int):
        self.by_size: list[list] = [[] for _ in range(most + 1)]
        self.sizes = 0

    def put(self, size: int, piece) -> None:
        self.by_size[size].append(piece)
        self.sizes |= 1 << size

    def _take(self, size: int):
        piece = self.by_size[size].pop()
        if not self.by_size[size]:
            self.sizes &= ~(1 << size)
        return size, piece

    def largest(self, most: int, over: int = 0):
        """A piece of the largest size in (over, most], or none."""
        found = self.sizes & ((1 << (most + 1)) - 1)
        size = found.bit_length() - 1
        return self._take(size) if size > over else None

    def smallest(self, over: int):
        """A piece of the smallest size above ``over``, or none."""
        found = self.sizes >> (over + 1)
        return self._take((found & -found).bit_length() + over) if found else None


class Packer:
    """Packs the documents of one task.  A piece is (document, start, ids); a window is a list of pieces."""

    def __init__(self, tiers: tuple[int, ...], slice_tokens: int):
        self.tiers, self.slice_tokens = sorted(tiers, reverse=True), slice_tokens
        if any(t & (t - 1) or t < 1 for t in tiers) or not tiers:
            raise ValueError("tiers are powers of two")
        self.pool, self.waiting = Pool(self.tiers[0]), 0

    def add(self, document, ids: np.ndarray) -> Iterator[tuple[int, list]]:
        """Windows (tier, pieces) that the document fills on its own; its remainder waits."""
        longest = self.tiers[0]
        whole = len(ids) // longest * longest
        for at in range(0, whole, longest):
            yield longest, [(document, at, ids[at : at + longest])]
        if whole < len(ids):
            self.pool.put(len(ids) - whole, (document, whole, ids[whole:].copy()))
        self.waiting += len(ids)
        if self.waiting >= self.slice_tokens:
            yield from self.pack()

    def pack(self, last: bool = False) -> Iterator[tuple[int, list]]:
        """Windows of what waits.  One that can't be filled waits on, or is cut if nothing more comes."""
        self.waiting, shorter = 0, [*self.tiers[1:], 0]
        for tier, under in zip(self.tiers, shorter, strict=True):
            while opener := self.pool.largest(tier, under):
                window, gap = [opener[1]], tier - opener[0]
                while gap:
                    if fits := self.pool.largest(gap):
                        window.append(fits[1])
                        gap -= fits[0]
                    elif more := self.pool.smallest(gap):
                        document, start, ids = more[1]
                        window.append((document, start, ids[:gap]))
                        self.pool.put(more[0] - gap, (document, start + gap, ids[gap:]))
                        gap = 0
                    else:
                        break
                if not gap:
                    yield tier, window
                elif last:
                    yield from self.cut(window)
                else:
                    for piece in window:
                        self.pool.put(len(piece[2]), piece)
                    return  # nothing else is left

    def cut(self, window: list) -> Iterator[tuple[int, list]]:
        """Full windows of powers of two, the largest first."""
        left = sum(len(p[2]) for p in window)
        pieces = window[::-1]
        while left:
            size = gap = 1 << (left.bit_length() - 1)
            out = []
            while gap:
                document, start, ids = pieces.pop()
                out.append((document, start, ids[:gap]))
                if len(ids) > gap:
                    pieces.append((document, start + gap, ids[gap:]))
                gap -= min(gap, len(ids))
            left -= size
            yield size, out


def packed_pieces(docs: DataFrame, doc_id: str, text: str, tiers: tuple[int, ...], source, with_ids: bool, slice_tokens: int) -> DataFrame:
    """Pieces with their window's tier, task and place among the task's windows of the tier."""
    kind = docs.schema[doc_id].dataType
    named = docs.select(F.col(doc_id).alias("doc_id"), null_to_empty(text).alias("text"))
    width = {"long": np.int64, "int": np.int32}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer, task = byte_tokens(source.value), Packer(tiers, slice_tokens), TaskContext.get().partitionId()
        made: dict[int, int] = {}
        rows: list[tuple] = []

        def note(windows: Iterator[tuple[int, list]]) -> None:
            for tier, window in windows:
                place = made[tier] = made.get(tier, -1) + 1
                offset = 0
                for (name, total), start, ids in window:
                    crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"))
                    rows.append((name, start, len(ids), crc, total, tier, task, place, offset, ids.astype(np.int32) if with_ids else None))
                    offset += len(ids)

        def batch_of() -> pa.RecordBatch:
            fields = [x.split(" ") for x in PIECE.split(", ")]
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], id_type)] + [pa.array(np.array(c, width[k])) if k in width else pa.array(c, pa.list_(pa.int32())) for c, (_, k) in zip(columns[1:], fields, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", *[n for n, _ in fields]])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                for name, text in zip(some.column("doc_id").to_pylist(), some.column("text"), strict=True):
                    ids = np.append(tokens.ids(text.as_py()), np.uint32(END_ID))
                    note(packer.add((name, len(ids)), ids))
                if len(rows) >= 10_000 or with_ids and rows:
                    yield batch_of()
            give_back()
        note(packer.pack(last=True))
        if rows:
            yield batch_of()
        give_back()

    return named.mapInArrow(pack, f"doc_id {kind.simpleString()}, {PIECE}")


def pack_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tiers: tuple[int, ...] = TIERS,
    tokenizer_path: str | None = None,
    with_ids: bool = True,
    step_tokens: int = STEP_TOKENS,
    slice_tokens: int = SLICE_TOKENS,
) -> DataFrame:
    """A row for each piece of a document: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``tier`` (its window's
    length), ``step``, ``sequence_id`` (its window's number, from 0 without gaps), ``offset`` in it, and ``ids`` if asked for.

    Every id of every document lies in one piece, and every window is full.  A document's ids end with ``END_ID``, so that
    an empty or null text has one.  Rows that repeat an id or a text are documents of their own; a null id is kept.  Other
    columns are not read.  An empty table gives no rows.

    ``step``: the windows of each tier are spread evenly over the steps (their number is all tokens by ``step_tokens``), so
    that steps have the same tokens and the same mixture of lengths but for one window of each tier.
    """
    spark = docs.sparkSession
    source = tokenizer_source(spark, tokenizer_path or default_path(BYTE_BPE))
    pieces = written(packed_pieces(docs, doc_id, text, tuple(tiers), source, with_ids, slice_tokens), "pieces")
    counts = pieces.groupBy("tier", "task").agg((F.max("place") + 1).alias("windows"))
    # a row for each task and tier: their sums so far are the tasks' first numbers
    before = F.coalesce(F.sum("windows").over(Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = written(counts.select("tier", "task", before.alias("first"), "windows"), "windows", fewer=16)
    tier_rows = firsts.groupBy("tier").agg(F.sum("windows").alias("n")).orderBy(F.desc("tier")).collect()  # one a power of two
    steps = max(1, sum(r.tier * r.n for r in tier_rows) // step_tokens)
    upto = np.cumsum([0] + [r.n for r in tier_rows]).tolist()
    about = spark.createDataFrame([(r.tier, r.n, u) for r, u in zip(tier_rows, upto, strict=False)], "tier int, n long, before long")
    firsts = firsts.join(F.broadcast(about), "tier").select("tier", "task", "first", "n", "before")
    if firsts.count() <= SENT_ROWS:
        firsts = F.broadcast(firsts)
    number = F.col("first") + F.col("place")
    numbered = pieces.join(firsts, ["tier", "task"]).withColumn("sequence_id", F.col("before") + number)
    numbered = numbered.withColumn("step", F.floor(number.cast("decimal(20,0)") * F.lit(steps) / F.col("n")).cast("long"))
    return numbered.select("doc_id", *NUMBERED, *["ids"] * with_ids)


def training_windows(pieces: DataFrame) -> DataFrame:
    """``step``, ``sequence_id``, ``tier`` and ``ids`` of every window, from pieces with ids; a window is bounded by its tier."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.min("step").alias("step"), F.min("tier").alias("tier"), F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step")
