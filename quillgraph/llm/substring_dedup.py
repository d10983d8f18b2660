"""Incremental removal of repeated word windows with a log-structured fingerprint index (operator 3).

The index holds, in sorted immutable runs, the anchors of all windows of the history (see ``shared_windows``); runs are
tables bucketed and sorted by anchor.  A new batch's anchors become a run, which is merge-joined with the runs before it,
bucket by bucket and without a shuffle.  Small runs are merged with later ones in the same way until each is over twice as
large as all after it, so a row is written anew only when its run grows by half or more: about log(batches) times, and as
many runs are looked up.  Where an anchor is shared, the windows themselves are verified: by 128-bit hashes of whole units, and of single windows where units
differ.  A manifest names the runs and the units' hashes, so that a later session can go on with the next batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_path, null_to_empty, path_glob, shared_path, table, written
from .shared_windows import content_hashes, covered, units
from .word_hashes import BASE, mix, text_slices, window_hashes, words_of

SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
LAST = (1 << 63) - 1
UNITS = "d long, t long, anchor long, u1 long, u2 long, l int, r int, first boolean"


def first_to_merge(rows: list[int]) -> int:
    """The first of the latest runs to merge into one, so that each run left is over twice as large as all after it."""
    start, after = len(rows) - 1, sum(rows[-1:])
    for i in range(len(rows) - 2, -1, -1):
        if rows[i] <= 2 * after:
            start = i
        after += rows[i]
    return max(start, 0)


class FingerprintIndex:
    """Runs of ``anchor`` (and ``many``, whether several documents of a batch have it), written once and never changed.

    ``path``: a folder that all executors share; an index that is there already is opened.  ``max_runs``: with more of
    them, those that aren't over twice as large as all later ones are merged before the next batch is looked up.  ``buckets``: of the runs (by default as many
    as shuffle partitions), fixed when the index is made.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, max_runs: int = 1, buckets: int | None = None):
        self.spark, self.path, self.max_runs = spark, (path or shared_path(spark, "fingerprints")).rstrip("/"), max_runs
        self.names: dict[str, str] = {}
        found = sorted(path_glob(spark, f"{self.path}/manifest-*/_SUCCESS"))
        state = json.loads(spark.read.text(found[-1].rpartition("/")[0]).first()[0]) if found else {}
        self.version, self.runs, self.batches = state.get("version", 0), state.get("runs", []), state.get("batches", [])
        self.rows: dict[str, int] = state.get("rows", {})
        self.buckets = state.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def save(self) -> None:
        """Write the next manifest; a folder counts once it is complete."""
        self.version += 1
        self.rows = {run: self.rows_of(run) for run in self.runs}
        state = {"version": self.version, "buckets": self.buckets, "runs": self.runs, "batches": self.batches, "rows": self.rows}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.version:09d}")

    def write(self, anchors: DataFrame) -> str:
        run = f"run_{uuid.uuid4().hex}"
        self.names[run] = f"fingerprint_{run}"
        writer = anchors.write.bucketBy(self.buckets, "anchor").sortBy("anchor").format("parquet").option("compression", "zstd")
        writer.option("path", f"{self.path}/{run}").saveAsTable(self.names[run])
        return run

    def read(self, run: str) -> DataFrame:
        if run not in self.names:
            self.names[run] = f"fingerprint_{run}"
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self.names[run]} (anchor BIGINT, many BOOLEAN) USING parquet "
                f"CLUSTERED BY (anchor) SORTED BY (anchor) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'"
            )
        return self.spark.table(self.names[run])

    def rows_of(self, run: str) -> int:
        """Rows of a run, by the files' footers where the manifest doesn't say."""
        return self.rows[run] if run in self.rows else self.read(run).count()

    def lookup(self, run: str, other: str) -> DataFrame:
        """Anchors that both runs have."""
        return self.read(run).select("anchor").hint("merge").join(self.read(other).select("anchor"), "anchor", "left_semi")

    def add(self, units: DataFrame) -> DataFrame:
        """Take in a batch (``window_units`` of its documents); returns the anchors it shares with the history or within itself."""
        if len(self.runs) > self.max_runs:
            self.compact()
        batch = f"units_{uuid.uuid4().hex}"
        units.write.option("compression", "zstd").parquet(f"{self.path}/{batch}")
        held = self.units([batch]).where("first").groupBy("anchor").agg((F.count("*") > 1).alias("many"))
        run = self.write(held)
        found = [self.read(run).where("many").select("anchor"), *[self.lookup(run, other) for other in self.runs]]
        self.runs, self.batches = [*self.runs, run], [*self.batches, batch]
        self.save()
        return written(reduce(DataFrame.union, found).distinct(), "shared-anchors", fewer=4)

    def units(self, batches: list[str] | None = None) -> DataFrame:
        """Units of all batches, or of some."""
        return self.spark.read.schema(UNITS).parquet(*[f"{self.path}/{b}" for b in (batches or self.batches)])

    def compact(self) -> None:
        """Merge the latest runs into one, bucket by bucket, as far back as they aren't over twice as large as all after them."""
        start = first_to_merge([self.rows_of(run) for run in self.runs])
        old = self.runs[start:]
        if len(old) < 2:
            return
        merged = self.read(old[0])
        for run in old[1:]:
            more = self.read(run).withColumnRenamed("many", "more").hint("merge")
            merged = merged.join(more, "anchor", "full").select("anchor", (F.coalesce("many", F.lit(False)) | F.coalesce("more", F.lit(False))).alias("many"))
        self.runs = [*self.runs[:start], self.write(merged)]
        self.save()
        for run in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(run)}")
            delete_path(self.spark, f"{self.path}/{run}")

    def close(self) -> None:
        """Forget the tables' names; the files stay."""
        while self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.popitem()[1]}")


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, the text (null: empty), ``d`` that orders documents (null ids last), and ``t``, which tells rows of one id apart."""
    whole = null_to_empty(text)
    return docs.select("doc_id", whole.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(whole).alias("t"))


def window_units(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each unit: ``d``, ``t``, its anchor, 128-bit content hash, first and last window.

    ``first``: no unit before it in the document has its anchor.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for i, j, some in text_slices(texts):
                _, _, _, hashes, bounds = words_of(some)
                l, r, anchor = units(hashes, bounds, window, gram)  # noqa: E741
                if not len(l):
                    continue
                u = [content_hashes(hashes, l, r, window, s).view(np.int64) for s in SEEDS]
                owner = np.searchsorted(bounds, l, side="right") - 1
                first = np.zeros(len(l), bool)
                first[np.unique(anchor + owner.astype(np.uint64) * BASE, return_index=True)[1]] = True
                yield pd.DataFrame(
                    {
                        "d": batch["d"].to_numpy()[i:j][owner],
                        "t": batch["t"].to_numpy()[i:j][owner],
                        "anchor": anchor.view(np.int64),
                        "u1": u[0],
                        "u2": u[1],
                        "l": (l - bounds[owner]).astype(np.int32),
                        "r": (r - bounds[owner]).astype(np.int32),
                        "first": first,
                    }
                )

    return docs.select("text", "d", "t").mapInPandas(make, UNITS)


def single_windows(docs: DataFrame, ranges: DataFrame, window: int) -> DataFrame:
    """A row for each window of the given ranges (``d``, ``t``, ``l``, ``r``): its 128-bit hash ``w1``, ``w2`` and place ``l``."""
    lists = ranges.groupBy("d", "t").agg(F.collect_set(F.struct("l", "r")).alias("ranges"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, t, text, ranges in zip(batch["d"], batch["t"], batch["text"], batch["ranges"], strict=True):
                _, _, _, hashes, _ = words_of([text.encode()])
                full = [window_hashes(mix(hashes ^ np.uint64(s)), window).view(np.int64) for s in SEEDS]
                at = np.concatenate([np.arange(x["l"], x["r"] + 1) for x in ranges])
                yield pd.DataFrame({"d": d, "t": t, "w1": full[0][at], "w2": full[1][at], "l": at.astype(np.int32)})

    # with all columns of ``docs``, so that this and the last join share one exchange of the texts
    joined = docs.join(lists, ["d", "t"]).select(*docs.columns, "ranges")
    return joined.mapInPandas(make, "d long, t long, w1 long, w2 long, l int")


def verified(units: DataFrame, anchors: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """``d``, ``t``, ``l``, ``r``: the windows l to r of the document also start in one with a smaller ``d``.

    ``units`` of all documents concerned, the ``anchors`` in question, and ``docs`` (as ``keyed`` makes them) for the
    windows of units that share an anchor but not all of their words.
    """
    some = written(units.drop("first").join(anchors, "anchor", "left_semi"), "shared-units")
    first = some.groupBy("u1", "u2").agg(F.min("d").alias("lo"))
    # written, so that the join below reads both sides from exchanges that Spark may split where an anchor is very common
    several = written(some.groupBy("anchor").agg(F.min("u1").alias("a"), F.max("u1").alias("b")).where("a <> b").select("anchor"), "open-anchors", fewer=16)
    matched = some.join(first, ["u1", "u2"])
    whole = matched.where("d > lo").select("d", "t", "l", "r")
    # the first holder of each distinct unit stands for it where an anchor has several
    open_ = matched.where("d = lo").join(several, "anchor", "left_semi").select("d", "t", "l", "r")
    windows = single_windows(docs, open_, window)
    smallest = windows.groupBy("w1", "w2").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select("w1", "w2", "lo")
    single = windows.join(smallest, ["w1", "w2"]).where("d > lo").select("d", "t", "l", F.col("l").alias("r"))
    return whole.union(single)


def repeated_windows(docs: DataFrame, batches: int = 3, window: int = 50, gram: int = 8, max_runs: int = 1) -> DataFrame:
    """As ``verified``, for ``docs`` (as ``keyed`` makes it) taken in as ``batches`` batches by rising id, as they would arrive."""
    index = FingerprintIndex(docs.sparkSession, max_runs=max_runs)
    cuts = sorted(set(docs.where(F.col("d") < LAST).approxQuantile("d", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    edges = [None, *map(int, cuts), None]
    shared = []
    try:
        for low, high in zip(edges, edges[1:], strict=False):
            batch = docs if low is None else docs.where(F.col("d") > low)
            batch = batch if high is None else batch.where(F.col("d") <= high)
            shared.append(index.add(window_units(batch, window, gram)))
    finally:
        index.close()
    return verified(index.units(), reduce(DataFrame.union, shared).distinct(), docs, window)


def remove_repeats(docs: DataFrame, batches: int = 3, window: int = 50, gram: int = 8, max_runs: int = 1) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (remaining words joined by one space).

    Words of windows of ``window`` words that also start in a document with a smaller id are removed; all windows are
    judged on the input.  Null texts have no words; texts under ``window`` words lose none.  A null id counts as larger
    than any other; rows with equal ids never remove each other's words, and each gets a result of its own.  Other
    columns are ignored.
    """
    rows = keyed(docs)
    return cut_windows(rows, repeated_windows(rows, batches, window, gram, max_runs), window)


def remove_repeats_of_batch(index: FingerprintIndex, batch: DataFrame, history: DataFrame, window: int = 50, gram: int = 8) -> DataFrame:
    """As ``remove_repeats``, for the documents of a new batch, against the ``history`` that the index holds and each other.

    The batch is taken in; what earlier batches gave stays as it was.  ``history``: the documents taken in before; of
    their texts, only those are read that share an anchor but not a whole unit with the batch.
    """
    rows, before = keyed(batch), keyed(history)
    anchors = index.add(window_units(rows, window, gram))
    spans = verified(index.units(), anchors, before.union(rows), window)
    return cut_windows(rows, spans, window)


def cut_windows(rows: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """``rows`` (as ``keyed`` makes them) without the words of their ``spans``."""
    lists = spans.groupBy("d", "t").agg(F.collect_list("l").alias("l"), F.collect_list("r").alias("r"))

    def cut(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches_:
            texts = batch["text"].tolist()
            for i, j, some in text_slices(texts):
                out = []
                for k in range(i, j):
                    data, begin, end, hashes, _ = words_of([some[k - i]])
                    lost = np.zeros(len(begin), bool)
                    if (l := batch["l"].iat[k]) is not None:
                        lost = covered(len(begin), np.asarray(l, np.int64), np.asarray(batch["r"].iat[k], np.int64), window)
                    out.append((len(begin), int(lost.sum()), joined_words(data, begin[~lost], end[~lost]).decode()))
                done = pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])
                done.insert(0, "doc_id", batch["doc_id"].iloc[i:j].to_numpy())
                yield done.astype({"doc_id": "Int64"})

    joined = rows.join(lists, ["d", "t"], "left").select("doc_id", "text", "l", "r")
    return joined.mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept string")


def joined_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    """The words' bytes with one space between."""
    if not len(begin):
        return b""
    sizes = end - begin + 1
    out = np.full(int(sizes.sum()), 32, np.uint8)
    stops = np.cumsum(sizes)
    inner = np.arange(len(out)) - np.repeat(stops - sizes, sizes)
    is_word = inner < np.repeat(sizes - 1, sizes)
    out[is_word] = data[(np.repeat(begin, sizes) + inner)[is_word]]
    return out[:-1].tobytes()


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
), hit AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS lo FROM win) WHERE lo < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM hit, (SELECT unnest(range(0, 50)) AS k)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""
