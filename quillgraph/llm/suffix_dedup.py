"""Removal of repeated byte strings by suffix sorting with bucket-pointer refinement (operator 9).

Suffixes are sorted no deeper than the length of a repeat, and only where repeats are possible: at windows whose anchor
(see ``shared_windows``) occurs in several documents.

1. Documents are dealt out to blocks, equal texts to the same one.  Each block lists the anchors of its windows, as sorted integers per
   hash range.
2. Each hash range finds the anchors held by several documents and tells the blocks that have them.
3. Each block sends the bytes around its shared anchors, one copy of equal bytes, to the anchor's range.  Windows of
   anchors that very many blocks hold go separately, by their own hash, so no range gets a common phrase's contexts.
4. Each range sorts the windows it got: initial buckets of q-grams are refined by the buckets of later offsets, and the
   refined buckets serve the next, deeper round.  Windows in one bucket at full depth are equal byte for byte.  The
   windows of common phrases are sorted in two steps: a part of the blocks at a time, then what is smallest in each part.
5. Blocks get back the windows that a smaller document holds, and cut them out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import give_back, null_to_empty, table, written
from .shared_windows import covered, units
from .substring_dedup import LAST
from .word_hashes import mix, window_hashes, word_hashes

GRAM = 20
_BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64))
OTHER_BASE = np.uint64(0xD1342543DE82EF95)
BLOCK_BYTES = 4 << 20
RANGE_BYTES = 8 << 20
#: Bytes whose suffixes are sorted at a time.
SORT_BYTES = 2 << 20
#: Copies of a text that share a block at most.
BLOCK_COPIES = 1000
#: Blocks whose windows of common phrases are sorted together in the first step.
PART_BLOCKS = 256
#: A phrase that many blocks hold is common if it is sent in more units than one for so many bytes of ``hot_blocks`` blocks.
UNIT_BYTES = 1 << 14
SENT = "range int, part int, block int, anchor array<int>, doc array<int>, l array<int>, n array<int>, d array<long>, data binary"
LISTED = "range int, block int, one array<int>, many array<int>, units array<int>"
#: What the steps need of a document.
CORE = ["d", "t", "text", "copied", "block"]


def refine_buckets(data: np.ndarray, begin: np.ndarray, end: np.ndarray, depth: int, q: int = 8) -> np.ndarray:
    """Bucket of every place of ``data`` from which ``depth`` bytes fit into its stretch [begin, end); -1 elsewhere.

    Equal strings of ``depth`` bytes, and only they, share a bucket.  Places first get the bucket of their q-gram.  A
    round then splits each bucket of several places by the buckets of the places ``step`` bytes later.  Buckets are
    sorted ``reach`` deep, so this makes them ``reach + step`` deep; the next round looks up the new ones.
    """
    sizes = end - begin
    left = np.zeros(len(data), np.int32)  # bytes up to the end of the place's stretch
    stops = np.cumsum(sizes)
    inner = np.arange(int(stops[-1]), dtype=np.int64) - np.repeat(stops - sizes, sizes)
    left[np.repeat(begin, sizes) + inner] = np.repeat(sizes, sizes) - inner
    reach = min(q, depth)
    places = np.flatnonzero(left >= reach)
    gram = np.zeros(len(places), np.uint64)
    for k in range(reach):
        gram = (gram << np.uint64(8)) | data[places + k]
    bucket = np.full(len(data), -1, np.int32)
    bucket[places] = np.unique(gram, return_inverse=True)[1]
    while reach < depth:
        step = min(reach, depth - reach)
        places = np.flatnonzero(left >= reach + step)
        now = bucket[places]
        several = np.flatnonzero(np.bincount(now, minlength=1)[now] > 1)
        key = now[several].astype(np.int64) << 32 | bucket[places[several] + step]
        fresh = np.arange(len(places), dtype=np.int32) + len(places)
        fresh[several] = np.unique(key, return_inverse=True)[1]
        bucket = np.full(len(data), -1, np.int32)
        bucket[places] = fresh
        reach += step
    return bucket


class Block:
    """The documents of one block as bytes, in an order that every step finds again.

    ``whole``: documents whose text a smaller document has as well.  They lose everything, and what they hold is looked
    up through that document, so no step needs their bytes.
    """

    def __init__(self, rows: pa.Table, window: int):
        core = rows.select(CORE).to_pandas().fillna({"text": ""}).sort_values(["t", "d", "text"], kind="stable")
        self.order, self.rows, self.number = core.index.to_numpy(), core.reset_index(drop=True), int(core["block"].iat[0])
        self.window = window
        self.d = self.rows["d"].to_numpy(np.int64)
        first = self.rows.groupby("text", sort=False)["d"].transform("min").to_numpy(np.int64)
        self.whole = self.rows["copied"].to_numpy(bool) | (self.d > first)
        texts = [x.encode() for x in self.rows["text"]]
        self.sizes = np.array([len(x) for x in texts], np.int64)
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Units (windows l to r in ``data``, anchor, document), and the place hashes they were found by."""
        hashes = _BYTE_HASH[self.data]
        # the line end after each text belongs to none: windows over it are dropped
        l, r, anchor = units(hashes, np.append(self.begins, len(self.data)), self.window, GRAM)  # noqa: E741
        doc = np.searchsorted(self.begins, l, side="right") - 1
        r = np.minimum(r, self.begins[doc] + self.sizes[doc] - self.window)
        good = (l <= r) & ~self.whole[doc]
        return l[good], r[good], anchor[good], doc[good], hashes

    def lost(self, doc: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:  # noqa: E741
        """The bytes of the windows l to r of the documents, and those of the documents that lose everything."""
        gone = np.flatnonzero(self.whole & (self.sizes >= self.window))
        begin = np.concatenate([self.begins[doc] + l, self.begins[gone]])
        end = np.concatenate([self.begins[doc] + r, self.begins[gone] + self.sizes[gone] - self.window])
        return covered(len(self.data), begin, end, self.window)


def snippets(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of ``size`` bytes from ``begin``, one after the other, and where each begins and ends in that."""
    stop = np.cumsum(size)
    inner = np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - size, size)
    return data[np.repeat(begin, size) + inner], stop - size, stop


def split_anchor(anchor: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash range of an anchor, and 32 more bits of it: enough to tell candidates; bytes are compared in the end."""
    part = (anchor % np.uint64(ranges)).astype(np.int32)
    return part, ((anchor // np.uint64(ranges)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def by_range(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The ranges that occur, and the places of each."""
    order = np.argsort(part, kind="stable")
    found, begin = np.unique(part[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, begin[1:]), strict=False))


def frame(rows: list[tuple], schema: str) -> pa.Table:
    """Rows as an Arrow table of a schema of ints, longs, their arrays and binary."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    named = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(named)
    sized = {"array<int>": np.int32, "array<long>": np.int64}
    exact = lambda x, kind: [v if v is None or kind not in sized else np.asarray(v, sized[kind]) for v in x]
    return pa.table({name: pa.array(exact(x, kind), kinds[kind]) for (name, kind), x in zip(named, columns, strict=True)})


def repeated_strings(rows: DataFrame, blocks: int, ranges: int, window: int = 50, hot_blocks: int = 256, hot_units: int = 0) -> DataFrame:
    """``block``, ``doc`` (documents by their place in the block), ``l``, ``r``: windows l to r that a smaller document holds.

    ``rows``: the columns of ``CORE`` and any others.  An anchor that more than ``hot_blocks`` blocks hold, in more than
    ``hot_units`` units that differ within their block, is looked up window by window.  This takes some ten times the
    bytes, so it is left to anchors that would fill their range: with many blocks, any few common words are in hundreds.
    """

    def list_anchors(rows: pa.Table) -> pa.Table:
        block = Block(rows, window)
        l, r, anchor, doc, _ = block.units()  # noqa: E741
        out = []
        if len(anchor):
            order = np.lexsort((block.d[doc], anchor))
            a, d = anchor[order], block.d[doc][order]
            first = np.ones(len(a), bool)
            first[1:] = a[1:] != a[:-1]
            starts = np.flatnonzero(first)
            ends = np.append(starts[1:], len(a)) - 1
            part, rest = split_anchor(a[starts], ranges)
            many = d[starts] != d[ends]
            count = ends - starts + 1
            again = np.flatnonzero(np.repeat(count > 1, count))
            group, at = (np.cumsum(first) - 1)[again], order[again]
            content = word_hashes(*snippets(block.data, l[at], r[at] - l[at] + window))
            by = np.lexsort((content, group))
            same = (group[by][1:] == group[by][:-1]) & (content[by][1:] == content[by][:-1])
            count -= np.bincount(group[by][1:][same], minlength=len(count))  # equal ones are sent once
            split = ((i, at[~many[at]], at[many[at]]) for i, at in by_range(part))
            out = [(i, block.number, rest[one], rest[several], np.append(count[one], count[several])) for i, one, several in split]
        give_back()
        return frame(out, LISTED)

    def find_shared(rows: pd.DataFrame) -> pd.DataFrame:
        lists = [np.unique(np.concatenate([a, b])) for a, b in zip(rows["one"], rows["many"], strict=True)]
        every, holders = np.unique(np.concatenate(lists), return_counts=True)
        inside = np.isin(every, np.unique(np.concatenate(list(rows["many"]))))
        places = np.searchsorted(every, np.concatenate([x for both in zip(rows["one"], rows["many"], strict=True) for x in both]))
        units = np.bincount(places, np.concatenate(list(rows["units"])))
        shared, hot = every[(holders > 1) | inside], every[(holders > hot_blocks) & (units > hot_units)]
        mine = [x[np.isin(x, shared, assume_unique=True)] for x in lists]
        return pd.DataFrame(
            {"range": rows["range"], "block": rows["block"], "shared": mine, "hot": [x[np.isin(x, hot, assume_unique=True)] for x in mine]}
        )

    def send(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not len(rows) or not len(told):
            return frame([], SENT)
        block, told = Block(rows, window), told.to_pandas()
        l, r, anchor, doc, hashes = block.units()  # noqa: E741
        part, rest = split_anchor(anchor, ranges)

        def listed(column: str) -> np.ndarray:
            keys = [np.int64(p) << np.int64(32) | x.view(np.uint32).astype(np.int64) for p, x in zip(told["range"], told[column], strict=True)]
            mine = part.astype(np.int64) << 32 | rest.view(np.uint32).astype(np.int64)
            return np.isin(mine, np.concatenate(keys))

        shared, hot = listed("shared"), listed("hot")
        common = np.zeros(int(shared.sum()), bool)
        if hot.any():  # these go window by window, each by a hash of its own
            n = (r - l + 1)[hot]
            at = np.repeat(l[hot], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            own = window_hashes(hashes, window)[at]
            keep = shared & ~hot
            l, r = np.concatenate([l[keep], at]), np.concatenate([r[keep], at])  # noqa: E741
            anchor, doc = np.concatenate([anchor[keep], own]), np.concatenate([doc[keep], np.repeat(doc[hot], n)])
            part, rest = split_anchor(anchor, ranges)
            common = np.arange(len(l)) >= int(keep.sum())
        else:
            l, r, doc, part, rest = l[shared], r[shared], doc[shared], part[shared], rest[shared]  # noqa: E741
        text, begin, end = snippets(block.data, l, r - l + window)
        u1, u2 = word_hashes(text, begin, end), word_hashes(text, begin, end, base=OTHER_BASE)
        d = block.d[doc]
        order = np.lexsort((d, u2, u1))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (u1[order][1:] != u1[order][:-1]) | (u2[order][1:] != u2[order][:-1])
        group = np.cumsum(fresh) - 1
        lowest = d[order][fresh][group] if len(order) else d
        first = np.zeros(len(order), bool)
        first[order] = d[order] == lowest
        out = []
        local = np.flatnonzero(~first)
        offset = l - block.begins[doc]
        if len(local):  # a smaller document of this very block holds them
            out.append((block.number % ranges, -1, block.number, None, doc[local], offset[local], (r - l + 1)[local], None, None))
        for some, number in ((first & ~common, -1), (first & common, block.number // PART_BLOCKS)):
            at = np.flatnonzero(some)
            for i, m in by_range(part[at]):
                m = at[m]
                shown = snippets(text, begin[m], end[m] - begin[m])[0].tobytes()
                out.append((i, number, block.number, rest[m], doc[m], offset[m], (r - l + 1)[m], d[m], zstandard.compress(shown, 1)))
        give_back()
        return frame(out, SENT)

    def find_repeats(rows: pd.DataFrame) -> pd.DataFrame:
        """Windows found (with the range -1), and rows of ``SENT`` for the next step: the windows of common phrases that are smallest in their part."""
        known = rows[rows["data"].isnull()]
        out = [(-1, -1, b, None, doc, l, n, None, None) for b, doc, l, n in zip(known["block"], known["doc"], known["l"], known["n"], strict=True)]  # noqa: E741
        rows = rows[rows["data"].notnull()]
        if len(rows):
            block = np.repeat(rows["block"].to_numpy(), rows["doc"].map(len))
            anchor, doc, l, n, d = (np.concatenate(list(rows[c])) for c in ("anchor", "doc", "l", "n", "d"))  # noqa: E741
            data = np.frombuffer(b"".join(zstandard.decompress(x) for x in rows["data"]), np.uint8)
            size = n.astype(np.int64) + window - 1
            end = np.cumsum(size)
            hit, low, high = repeats_in_range(data, end - size, end, anchor, d, n, window)
            give_back()
            for b, some in by_range(block[hit]):
                k = hit[some]
                out.append((-1, -1, b, None, doc[k], l[k] + low[some], high[some] - low[some] + 1, None, None))
            if rows["part"].iat[0] >= 0:
                left = np.setdiff1d(np.arange(len(n)), hit)
                for b, m in by_range(block[left]):
                    m = left[m]
                    shown = snippets(data, (end - size)[m], size[m])[0].tobytes()
                    out.append((rows["range"].iat[0], -1, b, anchor[m], doc[m], l[m], n[m], d[m], zstandard.compress(shown, 1)))
        give_back()
        typed = [(a, b, c, *(None if x is None else np.asarray(x, np.int32) for x in some), d, data) for a, b, c, *some, d, data in out]
        return pd.DataFrame(typed, columns=[c.split()[0] for c in SENT.split(", ")])

    listed = rows.groupBy("block").applyInArrow(list_anchors, LISTED)
    shared = listed.groupBy("range").applyInPandas(find_shared, "range int, block int, shared array<int>, hot array<int>")
    sent = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send, SENT)
    found = sent.groupBy("range", "part").applyInPandas(find_repeats, SENT)
    if blocks > hot_blocks:  # else no phrase is that common
        # what is found already passes through: a table of it would end the query, and the documents be sent once more
        found = found.groupBy("range", F.when(F.col("range") < 0, F.col("block"))).applyInPandas(find_repeats, SENT)
    return found.select("block", "doc", "l", F.zip_with("l", "n", lambda x, y: x + y - 1).alias("r"))


def repeats_by_anchor(
    data: np.ndarray, begin: np.ndarray, end: np.ndarray, anchor: np.ndarray, d: np.ndarray, n: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """Windows (unit, and place in it) that a smaller document holds; the units are sorted by anchor.

    Equal windows have equal anchors, so a few anchors at a time (``SORT_BYTES``, one anchor at least) are sorted.
    """
    stop = np.concatenate([[0], np.cumsum(end - begin)])
    units_, places, i = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(stop, stop[i] + SORT_BYTES, side="right")) - 1)
        j = int(np.searchsorted(anchor, anchor[j - 1], side="right"))
        some, first, last = snippets(data, begin[i:j], end[i:j] - begin[i:j])
        bucket = refine_buckets(some, first, last, window)
        count = n[i:j]
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        owner = np.repeat(np.arange(i, j), count)
        b = bucket[first[owner - i] + inner]
        smallest = np.full(int(b.max()) + 1, LAST, np.int64)
        np.minimum.at(smallest, b, d[owner])
        lost = smallest[b] < d[owner]
        units_.append(owner[lost])
        places.append(inner[lost])
        give_back()
        i = j
    return np.concatenate(units_), np.concatenate(places)


def repeats_in_range(
    data: np.ndarray, begin: np.ndarray, end: np.ndarray, anchor: np.ndarray, d: np.ndarray, n: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of one hash range, and their windows (first and last, counted from the unit's begin) that a smaller document holds."""
    content = word_hashes(data, begin, end)
    order = np.lexsort((d, content, anchor))
    a, c = anchor[order], content[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    starts = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    lowest = d[order][starts]
    whole = order[d[order] > lowest[group]]
    units_, low, high = [whole], [np.zeros(len(whole), np.int64)], [n[whole].astype(np.int64) - 1]
    # anchors with several contents: their distinct units are sorted
    new_anchor = np.ones(len(starts), bool)
    new_anchor[1:] = a[starts][1:] != a[starts][:-1]
    which = np.cumsum(new_anchor) - 1
    mixed = np.flatnonzero(np.bincount(which)[which] > 1)
    if len(mixed):
        rep = order[starts[mixed]]
        owner, inner = repeats_by_anchor(data, begin[rep], end[rep], a[starts[mixed]], d[rep], n[rep].astype(np.int64), window)
        # every unit of that content in that document has lost them
        same = order[d[order] == lowest[group]]
        group_of = np.empty(len(order), np.int64)
        group_of[order] = group
        position = np.full(len(starts), -1, np.int64)
        position[mixed] = np.arange(len(mixed))
        owners = position[group_of[same]]
        upto = np.searchsorted(owner, np.arange(len(rep) + 1))
        same, owners = same[owners >= 0], owners[owners >= 0]
        times = upto[owners + 1] - upto[owners]
        pick = np.repeat(upto[owners], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        units_.append(np.repeat(same, times))
        low.append(inner[pick])
        high.append(inner[pick])
    return np.concatenate(units_), np.concatenate(low), np.concatenate(high)


def whole_characters(data: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """``lost`` without the characters (in UTF-8) of which some byte stays."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(starts):
        return lost
    gone = np.minimum.reduceat(lost, starts)
    return np.repeat(gone, np.diff(np.append(starts, len(data))))


def remove_repeated_strings(
    docs: DataFrame,
    window: int = 50,
    block_bytes: int = BLOCK_BYTES,
    range_bytes: int = RANGE_BYTES,
    hot_blocks: int = 256,
    characters: bool = False,
    copies: int = BLOCK_COPIES,
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the remaining bytes), one row for each of its rows.

    Bytes of strings of ``window`` bytes that also start in a document with a smaller id are removed; all strings are
    judged on the input and none crosses documents.  ``characters``: a character stays whole if any of its bytes does,
    so that ``kept`` is UTF-8.  A null text counts as empty and stays null.  A null id counts as larger than any other; rows with equal ids
    never remove each other's bytes.  Columns of ``docs`` with the names of new ones are replaced.
    """
    whole, new = null_to_empty(), ("n_bytes", "n_removed", "n_spans", "kept")
    others = [c for c in docs.columns if c not in ("text", *new)]
    # the columns of ``docs`` go along under names that can't clash
    rows = docs.select(
        *[F.col(c).alias(f"in{i}") for i, c in enumerate(others)],
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"),
        F.xxhash64(whole).alias("t"),
        F.xxhash64(F.lit(1), whole).alias("t2"),
        F.octet_length(whole).alias("size"),
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    blocks, ranges = max(1, -(-total // block_bytes)), max(1, -(-total // range_bytes))
    # equal texts meet in a block; of a text with very many copies, as many blocks as it takes
    many = rows.groupBy("t", "t2", "size").agg(F.count("*").alias("copies"), F.min("d").alias("lo")).where(F.col("copies") > copies)
    rows = rows.join(written(many, "many-copies", fewer=16), ["t", "t2", "size"], "left")
    salt = F.when(F.col("copies").isNotNull(), F.pmod(F.xxhash64("d"), F.ceil(F.col("copies") / copies))).otherwise(0)
    rows = rows.select(
        *[f"in{i}" for i in range(len(others))],
        "text",
        "d",
        "t",
        F.coalesce(F.col("d") > F.col("lo"), F.lit(False)).alias("copied"),
        F.pmod(F.xxhash64("t", salt), F.lit(blocks)).cast("int").alias("block"),
    )
    found = repeated_strings(rows, blocks, ranges, window, hot_blocks, hot_blocks * (block_bytes // UNIT_BYTES))
    names = {f"in{i}": c for i, c in enumerate(others)} | {"text": "text"}

    def cut(rows: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(rows, window)
        doc, l, r = (np.concatenate([np.zeros(0, np.int64), *found[c].to_pandas()]).astype(np.int64) for c in ("doc", "l", "r"))  # noqa: E741
        lost = block.lost(doc, l, r)
        if characters:
            lost = whole_characters(block.data, lost)
        edge = np.flatnonzero(lost & ~np.concatenate([[False], lost[:-1]]))
        ends = block.begins + block.sizes
        gone = np.concatenate([[0], np.cumsum(lost, dtype=np.int32)])
        out = rows.select(list(names)).take(block.order)
        added = {
            "n_bytes": block.sizes,
            "n_removed": (gone[ends] - gone[block.begins]).astype(np.int64),
            "n_spans": (np.searchsorted(edge, ends) - np.searchsorted(edge, block.begins)).astype(np.int64),
        }
        for name, values in added.items():
            out = out.append_column(name, pa.array(values, pa.int64()))
        give_back()
        kept = [block.data[b:e][~lost[b:e]].tobytes() for b, e in zip(block.begins, ends, strict=True)]
        return out.append_column("kept", pa.array(kept, pa.binary()))

    schema = StructType([StructField(name, rows.schema[name].dataType) for name in names])
    schema = schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    out = rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut, schema)
    back = {c: name for name, c in names.items()}
    return out.select(*[F.col(back[c]).alias(c) for c in docs.columns if c not in new], *new)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated strings of 50 bytes, cut at whole characters; ``n_chars`` is counted anew.

    Other columns stay as they are, also those that have the names of the operator's own.
    """
    named = [f"in_{i}" if c not in ("doc_id", "text") else c for i, c in enumerate(docs.columns)]
    left = remove_repeated_strings(docs.toDF(*named), characters=True).withColumn("text", F.col("kept").cast("string")).select(*named).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_strings(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


OP9_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), win AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 100)) AS h
  FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM d)
), hit AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS lo FROM win) WHERE lo < doc_id
), edges AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hit
), runs AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges
), spans AS (
  SELECT doc_id, run, min(i) AS b, max(i) + 50 AS e FROM runs GROUP BY doc_id, run
), pieces AS (
  SELECT d.doc_id, b, substr(x, 2 * lag(e, 1, 0) OVER w + 1, 2 * (b - lag(e, 1, 0) OVER w)) AS piece
  FROM d JOIN (SELECT doc_id, b, e FROM spans UNION ALL SELECT doc_id, len(x) // 2, NULL FROM d) s USING (doc_id)
  WINDOW w AS (PARTITION BY d.doc_id ORDER BY b, e NULLS LAST)
), kept AS (
  SELECT doc_id, string_agg(piece, '' ORDER BY b) AS k FROM pieces GROUP BY doc_id
)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(s.n, 0)::BIGINT AS n_removed, coalesce(s.c, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, sum(e - b) AS n, count(*) AS c FROM spans GROUP BY doc_id) s USING (doc_id)
"""
