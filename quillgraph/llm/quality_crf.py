"""Document quality from a linear-chain conditional random field over lines (operator 7).

Every non-blank line is a position of the chain with the label good or bad.  Its features are shares of character
kinds in the line and in the lines before and after it.  The field is fitted on a bounded sample of labelled documents,
each line taking its document's label.  Forward-backward gives every line's probability of being good; their mean,
weighted by the lines' lengths, is the document's evidence, which a logistic fit on the same sample turns into a
probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, null_to_empty, table
from .bpe_codec import slices
from .word_hashes import word_hashes, word_ranges

#: Kinds of characters that are counted; each but the first two is a share of the line's characters.
KINDS = ["letter", "upper", "digit", "space", "symbol", "bar", "shout", "stop", "mark", "other"]
N_OWN = 13


def _kinds() -> np.ndarray:
    """Bit set of kinds for the code points below 0x250; those above count as letters."""
    out = np.zeros(0x251, np.uint16)
    for c in range(0x250):
        ch = chr(c)
        on = []
        if ch.isalpha():
            on = ["letter", "upper"] if ch.isupper() else ["letter"]
        elif ch.isdigit():
            on = ["digit"]
        elif ch.isspace():
            on = ["space"]
        elif ch in "#*$%&<>":
            on = ["symbol"]
        elif ch == "|":
            on = ["bar"]
        elif ch == "!":
            on = ["shout"]
        elif ch in ".,;:?'\"()-":
            on = ["stop"]
        elif ch in "/\\_=+@[]{}~^`":
            on = ["mark"]
        else:
            on = ["other"]
        for k in on:
            out[c] |= 1 << KINDS.index(k)
    out[0x250] = 1
    return out


_TABLE = _kinds()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every non-blank line of all texts, the lines' lengths, and each text's number of such lines."""
    # text ends are line ends; white space only makes a line blank
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = _TABLE[np.minimum(points, 0x250)]
    ends = np.flatnonzero(points == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    owner = np.searchsorted(text_ends, ends)
    size = (ends - begins).astype(np.int64)
    counts = np.empty((len(ends), len(KINDS)))
    for k in range(len(KINDS)):
        counts[:, k] = np.add.reduceat(((kind >> k) & 1).astype(np.int32), begins)
    counts[:, KINDS.index("space")] -= 1  # the line end itself
    full = counts[:, KINDS.index("space")] < size
    repeats = repeated_share(joined, len(ends))
    counts, size, owner = counts[full], size[full], owner[full]
    n = np.maximum(size, 1)[:, None]
    own = np.empty((len(size), N_OWN))
    own[:, 0] = 1.0
    own[:, 1] = counts[:, 1] / np.maximum(counts[:, 0], 1)
    own[:, 2:10] = counts[:, 2:] / n
    own[:, 10] = np.minimum(np.log1p(size) / 8, 1.5)
    own[:, 11] = size < 40
    own[:, 2:10] = np.sqrt(np.maximum(own[:, 2:10], 0))
    own[:, 12] = np.sqrt(repeats[full])
    lines = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = owner[1:] == owner[:-1]
    before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    return np.concatenate([own, before, after], axis=1), size.astype(float), lines


def repeated_share(joined: str, n_lines: int) -> np.ndarray:
    """Share of each line's words that equal the word before them in it."""
    data = np.frombuffer(joined.encode(), np.uint8)
    begin, end = word_ranges(data)
    hashes = word_hashes(data, begin, end)
    line = np.searchsorted(np.flatnonzero(data == 10), begin)
    words = np.bincount(line, minlength=n_lines)
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1]))
    return np.bincount(line[again + 1], minlength=n_lines) / np.maximum(words, 1)


@dataclass
class ChainField:
    """``weights``: evidence for a good line from its features; ``moves[a, b]``: from label a to b (0 bad, 1 good)."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, x: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, expected moves summed over all chains, and each chain's log normaliser."""
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ self.weights
        first = np.cumsum(lines) - lines
        order = np.argsort(-lines, kind="stable")
        sizes, first = lines[order], first[order]
        longest = int(sizes[0]) if len(sizes) else 0
        alpha, beta = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        for t in range(longest):
            at = first[: np.searchsorted(-sizes, -t, side="left")] + t
            alpha[at] = emit[at] if t == 0 else emit[at] + _lse(alpha[at - 1][:, :, None] + self.moves, 1)
        for t in range(longest - 2, -1, -1):
            at = first[: np.searchsorted(-sizes, -(t + 1), side="left")] + t
            beta[at] = _lse(self.moves + (emit[at + 1] + beta[at + 1])[:, None, :], 2)
        both = alpha + beta
        total = _lse(both, 1)
        inner = np.ones(len(x), bool)
        inner[first[sizes > 0]] = False
        to = np.flatnonzero(inner)
        pair = alpha[to - 1][:, :, None] + self.moves + (emit[to] + beta[to])[:, None, :] - total[to][:, None, None]
        return np.exp(both[:, 1] - total), np.exp(pair).sum(0), total

    def evidence(self, x: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' probabilities of being good; 0.5 for a text without lines."""
        good, _, _ = self.marginals(x, lines)
        owner = np.repeat(np.arange(len(lines)), lines)
        weight = np.bincount(owner, size, len(lines))
        return np.where(weight > 0, np.bincount(owner, size * good, len(lines)) / np.maximum(weight, 1e-9), 0.5)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        p = self.evidence(*line_features(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * p + self.shift, -40, 40)))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit_field(texts: list[str], labels: np.ndarray, rounds: int = 200, rate: float = 0.05, penalty: float = 1e-4) -> ChainField:
    """Maximum conditional likelihood by Adam, then the logistic calibration of documents.  Same input, same field.

    Without examples of both labels every text gets the share of good ones (0.5 if there are none).
    """
    if len(set(labels.tolist())) < 2:
        share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
        return ChainField(np.zeros(3 * N_OWN), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    x, size, lines = line_features(texts)
    y = np.repeat(labels, lines)
    n = max(len(y), 1)
    field = ChainField(np.zeros(x.shape[1]), np.zeros((2, 2)))
    first = np.zeros(len(y), bool)
    first[(np.cumsum(lines) - lines)[lines > 0]] = True
    to = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[to - 1], y[to]), 1)
    moments = [np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)]
    for step in range(1, rounds + 1):
        good, moved, _ = field.marginals(x, lines)
        slope = np.concatenate([x.T @ (y - good) / n - penalty * field.weights, (seen - moved).ravel() / n])
        moments = [0.9 * moments[0] + 0.1 * slope, 0.99 * moments[1] + 0.01 * slope**2]
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        field.weights = field.weights + move[:-4]
        field.moves = field.moves + move[-4:].reshape(2, 2)
    e = field.evidence(x, size, lines)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton, lightly ridged
        p = 1 / (1 + np.exp(-np.clip(a * e + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((labels - p) * e).sum() - 1e-3 * a, (labels - p).sum()])
        h = np.array([[(w * e * e).sum() + 1e-3, (w * e).sum()], [(w * e).sum(), w.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a + np.clip(d[0], -2, 2), b + np.clip(d[1], -2, 2)
    field.slope, field.shift = float(a), float(b)
    return field


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train_quality_field(docs: DataFrame, labels: DataFrame, max_docs: int = 2000, max_chars: int = 20_000) -> ChainField:
    """Fit on at most ``max_docs`` labelled documents of at most ``max_chars`` characters.

    The sample is chosen by a hash of the id among labelled rows that aren't held out, and is what the driver collects:
    ``max_docs * max_chars`` characters at most, whatever the size of the tables.  Null ids or labels are passed over;
    of repeated ids one row counts.
    """
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_docs)
    )
    rows = (
        docs.select("doc_id", null_to_empty().alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .where(F.length("text") <= max_chars)
        .dropDuplicates(["doc_id"])
        .orderBy("doc_id")
        .limit(max_docs)
        .collect()
    )
    field = fit_field([r.text for r in rows], np.array([r.quality for r in rows], np.int64))
    del rows
    give_back()
    return field


def score_quality(docs: DataFrame, field: ChainField, threshold: float = 0.3, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with a ``score`` (0 to 1, higher: better) and ``predicted`` (1 if the score reaches ``threshold``).

    Whole texts of any length are scored, in one pass without a shuffle.  A null text is scored as an empty one, which
    has no line and so the evidence 0.5.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [field.scores(some) for some in slices(batch.tolist())]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    out = docs.withColumn(score, scored(null_to_empty()))
    return out.withColumn(predicted, F.when(F.col(score) >= threshold, 1).otherwise(0))


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = train_quality_field(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, field).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts, with their columns, whatever these are called."""
    field = train_quality_field(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    named = docs.toDF(*[c if c == "text" else f"in_{c}" for c in docs.columns])
    return score_quality(named, field).where("predicted = 1").drop("score", "predicted").toDF(*docs.columns)
