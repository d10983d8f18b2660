"""Quality rules from repetition inside a document and line frequency across documents (operator 6).

Everything is DataFrame functions.  The text is scanned once; what remains of a document is its counts and one hash
and word count for each line, kept in a table in the shared folder, on which the frequency of lines is worked out.  The
texts themselves are only needed again to cut the frequent lines out of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import null_to_empty, table, written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column) -> Column:
    """Words of an array that lie in a three-word window found twice or more in it.

    Windows are compared by 64-bit hash.  Most texts repeat none, which a distinct count shows; for the others the
    windows are sorted by hash, so that equal ones are neighbours.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 3, F.array().cast("array<bigint>")).otherwise(hashes)


def repeated_positions(windows: Column) -> Column:
    order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(order: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(order, k).getField("h") == x.getField("h"), F.lit(False))
        return F.transform(order, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x.getField("i")))

    return order, twice


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words``."""
    whole = null_to_empty(text)
    base = docs.withColumn("_text", whole).withColumns(
        {
            "_words": F.array_remove(F.split("_text", SPACES, -1), ""),
            "_lines": F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    base = base.withColumn("_windows", repeated_words(F.col("_words")))
    order, twice = repeated_positions(F.col("_windows"))
    none = F.array().cast("array<struct<h: bigint, i: int>>")
    base = base.withColumn("_order", F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), none).otherwise(order))
    base = base.withColumn("_at", F.sort_array(F.array_compact(twice(F.col("_order")))))
    steps = F.transform("_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col("_at"), k + 1) - p, F.lit(3))))
    return base.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.regexp_replace("_text", SPACES, "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.aggregate(steps, F.lit(0), lambda a, b: a + b).cast("long"),
        }
    ).drop("_words", "_windows", "_order", "_at")


def normal_line(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(line, SPACES, " ")))


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_docs: int = 100,
    min_left: float = 0.3,
) -> DataFrame:
    """One row per document: the counts, ``n_left`` (words outside frequent lines), ``base_failed``, ``kept`` and ``frequent``.

    A line is frequent on a host if more than ``max_docs`` documents of that host hold it, white space and case aside;
    copies of a text count like any documents.  Frequent lines are removed (``without_frequent_lines`` gives the text;
    ``frequent`` are the hashes of those that the document holds).  A document is depleted, and not kept, if less than
    ``min_left`` of its words are left.  ``base_failed`` documents (under 50 words, or more than half of the words in
    repeated windows) aren't kept either.  A null text is empty, a null host a host of its own; rows that repeat an id
    count as one document of a line, and each gets a row; those without an id count as documents if their texts differ.
    Other columns of ``docs`` are ignored.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(host), F.lit("\0")).alias("host"))
    scanned = document_counts(slim).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "host",
        F.xxhash64("_text").alias("copy"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.transform(
            "_lines",
            lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.size(F.array_remove(F.split(x, SPACES, -1), "")).alias("words")),
        ).alias("lines"),
    )
    scanned = written(scanned, "quality-lines")
    document = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("copy")).alias("copy")).alias("document")
    seen = scanned.select("host", document, F.explode(F.array_distinct(F.col("lines.h"))).alias("h")).distinct()
    frequent = seen.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > max_docs).select("host", "h")
    lost = (
        scanned.select("row", "host", F.explode("lines").alias("line"))
        .select("row", "host", F.col("line.h").alias("h"), F.col("line.words").alias("words"))
        .groupBy("row", "host", "h")
        .agg(F.sum("words").alias("words"))
        .join(frequent, ["host", "h"])
        .groupBy("row")
        .agg(F.sum("words").alias("lost"), F.collect_list("h").alias("frequent"))
    )
    out = scanned.join(lost, "row", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("n_words") - F.coalesce(F.col("lost"), F.lit(0))).alias("n_left"),
        F.coalesce("frequent", F.array().cast("array<bigint>")).alias("frequent"),
        "copy",
        "host",
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_left") >= min_left * F.col("n_words")))


def without_frequent_lines(docs: DataFrame, verdicts: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The kept documents of ``docs``, their frequent lines cut out of the text; other columns stay.

    ``verdicts``: what ``quality_rules`` says of the same documents.  Lines are told by their hashes, blank ones stay.  A
    kept null text can't be (it has no words).
    """
    names = ("doc_id", "copy", "host", "kept", "frequent")
    said = verdicts.where("kept").select(*[F.col(c).alias(f"_q_{c}") for c in names]).dropDuplicates(["_q_doc_id", "_q_copy", "_q_host"])
    key = {"doc_id": F.col(doc_id), "copy": F.xxhash64(null_to_empty(text)), "host": F.coalesce(F.col(host), F.lit("\0"))}
    same = [x.eqNullSafe(F.col(f"_q_{c}")) for c, x in key.items()]
    joined = docs.join(said, same[0] & same[1] & same[2])
    left = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains("_q_frequent", F.xxhash64(normal_line(x))))
    return joined.withColumn(text, F.array_join(left, "\n")).select(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("frequent", "copy", "host")


OP6_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS host FROM documents
), split AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM base
), windows AS (
  SELECT doc_id, t, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, t, words, unnest(range(1, len(words) - 1)) AS i FROM split)
), twice AS (
  SELECT doc_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), norm AS (
  SELECT doc_id, t, host, trim(lower(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line,
         len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, t, host, unnest(lines) AS l FROM split)
), frequent AS (
  SELECT host, line FROM norm GROUP BY host, line HAVING count(DISTINCT doc_id) > 100
), lost AS (
  SELECT doc_id, sum(n) AS n FROM norm JOIN frequent USING (host, line) GROUP BY doc_id
), counts AS (
  SELECT s.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         (len(words) - coalesce(lost.n, 0))::BIGINT AS n_left
  FROM split s LEFT JOIN covered c USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_left >= 0.3 * n_words AS kept
FROM counts
"""
