"""Fill-in-middle transformation with succinct rank and select over code point boundaries (operator 11).

The bytes of a slice of texts have one bitvector: a bit is set where a code point begins.  It is packed into 64-bit words;
a directory holds the number of set bits before every block of eight words and, within a block, before every word.  The
popcount of a text's range is its number of code points; the two cuts are the places that select finds for two ranks.
No text is decoded or split into characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, null_to_empty, table

#: Markers before prefix, suffix and middle.  A text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, those that stay plain, and of the others those with the suffix first.
PLAIN_OF_100, SUFFIX_FIRST_OF_100 = 10, 20
NEW = ("n", "form", "prefix_chars", "middle_chars", "output")
_WORDS = 8  # of 64 bits in a block


class BitVector:
    """Set bits counted (``rank``) and found (``select``) for whole arrays of places."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = -(-(len(packed) + 1) // 8)  # one bit more at least, so that the end has a rank
        words = -(-words // _WORDS) * _WORDS
        self.words = np.zeros(words, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        counts = np.bitwise_count(self.words).astype(np.int64).reshape(-1, _WORDS)
        upto = np.cumsum(counts, axis=1)
        self.inner = (upto - counts).astype(np.int16)
        self.blocks = np.concatenate([[0], np.cumsum(upto[:, -1])])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of set bits before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.blocks[word // _WORDS] + self.inner.ravel()[word] + np.bitwise_count(self.words[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the set bit that has ``k`` others before it."""
        block = np.searchsorted(self.blocks, k, side="right") - 1
        rest = k - self.blocks[block]
        word = (self.inner[block] <= rest[:, None]).sum(axis=1) - 1
        rest -= self.inner[block, word]
        word += block * _WORDS
        bits, at = self.words[word], word << 6
        for half in (32, 16, 8, 4, 2, 1):  # go on in the half that holds it
            low = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            upper = rest >= low
            rest -= np.where(upper, low, 0)
            at = at + np.where(upper, half, 0)
            bits = np.where(upper, bits >> np.uint64(half), bits)
        return at


def byte_cuts(data: np.ndarray, bounds: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Code points of each text (``data[bounds[i]:bounds[i + 1]]``), those of its prefix and middle, and both cuts as byte places."""
    begins = np.ones(len(data) + 1, bool)  # one behind the last text: its end is found by select too
    begins[:-1] = (data & 0xC0) != 0x80
    bits = BitVector(begins)
    before = bits.rank(bounds)
    n = np.diff(before)
    one, two = h1 % (n + 1), h2 % (n + 1)
    first, last = np.minimum(one, two), np.maximum(one, two)
    return n, first, last - first, bits.select(before[:-1] + first), bits.select(before[:-1] + last)


def string_slices(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs [i, j) of texts of about ``size`` bytes, one text at least: their bytes in one piece, and where each begins in it."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    stops = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(stops, stops[i] + size, side="right")) - 1)
        whole = texts.buffers()[2]
        yield i, j, whole[stops[i] : stops[j]].to_pybytes() if whole is not None else b"", stops[i : j + 1] - stops[i]
        i = j


def drawn(doc_id: str) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of a document's id; a null id counts as an empty text."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n`` (code points of the whole text), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    Forms: ``plain`` (the text as it is; no cuts, null counts), ``psm`` (prefix, suffix, middle behind their markers) and
    ``spm`` (suffix, prefix, middle).  The form and the cuts depend on the id alone, and on the text only in that an empty
    one and one that holds a marker stay plain: rows that repeat an id are cut alike, a null id is one id, a null text is
    an empty one.  Every row is kept, with all its columns; columns of the new names are replaced.  An empty table stays
    empty.
    """
    kind = "struct<n: long, prefix_chars: long, middle_chars: long, output: string>"

    @F.arrow_udf(kind)
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
        for texts, forms, h1, h2 in batches:
            h1, h2 = [h.to_numpy(zero_copy_only=False) for h in (h1, h2)]
            for i, j, data, bounds in string_slices(texts):
                n, first, middle, one, two = byte_cuts(np.frombuffer(data, np.uint8), bounds, h1[i:j], h2[i:j])
                names, out = forms.slice(i, j - i).to_pylist(), []
                for a, b, x, y, form in zip(bounds[:-1].tolist(), bounds[1:].tolist(), one.tolist(), two.tolist(), names, strict=True):
                    if form == "plain":
                        out.append(data[a:b])
                    elif form == "psm":
                        out.append(b"".join([marks[0], data[a:x], marks[1], data[y:b], marks[2], data[x:y]]))
                    else:
                        out.append(b"".join([marks[1], data[y:b], marks[0], data[a:x], marks[2], data[x:y]]))
                cutless = np.array([f == "plain" for f in names], bool)
                columns = [pa.array(n), pa.array(first, mask=cutless), pa.array(middle, mask=cutless), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.StructArray.from_arrays(columns, ["n", "prefix_chars", "middle_chars", "output"])
            if not len(texts):
                yield pa.StructArray.from_arrays([pa.array([], pa.int64())] * 3 + [pa.array([], pa.string())], ["n", "prefix_chars", "middle_chars", "output"])
            give_back()

    # the columns go along under names that can't clash
    own = {c: f"in{i}" for i, c in enumerate(docs.columns)}
    h1, h2, h3, h4 = drawn(own[doc_id])
    whole = null_to_empty(own[text])
    marked = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    form = F.when((whole == "") | marked | (h3 % 100 >= 100 - PLAIN_OF_100), "plain").when(h4 % 100 < SUFFIX_FIRST_OF_100, "spm").otherwise("psm")
    named = docs.select(*[F.col(c).alias(x) for c, x in own.items()]).withColumn("form", form)
    out = named.withColumn("cut", cut(whole, "form", h1, h2))
    kept = [F.col(x).alias(c) for c, x in own.items() if c not in NEW]
    return out.select(*kept, "cut.n", "form", "cut.prefix_chars", "cut.middle_chars", "cut.output")


def fill_in_middle_restored(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made of."""
    between = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    one = F.when(form == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    rest = F.substr(body, F.length(one) + F.length(between) + 1)
    two = F.substring_index(rest, MIDDLE, 1)
    middle = F.substr(rest, F.length(two) + len(MIDDLE) + 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle_restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP11_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, text, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM drawn
), cuts AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
  SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1) AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
