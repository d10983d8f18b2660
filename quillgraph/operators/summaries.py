"""Bottom-up summaries: what a note's children say, and which notes need a new summary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import front_field, split_front, strip
from quillgraph.operators.graph import cut
from quillgraph.sources.files import read_markdown, write_files

# Characters of children's summaries that a note of a tier is given at most, and the field that names the parent.
CHILD_BUDGET = {"1": 0, "2": 12_000, "3": 16_000}
PARENTS = {"2": "parentFile", "3": "parentModule"}
PROMPT_VERSION = "1"
#: What makes a stored summary out of date if it differs.
SETTINGS = ["tier", "provider", "model", "prompt_version", "source_hash", "child_hash", "summary_hash"]


def child_hashes(children: DataFrame) -> DataFrame:
    """``parent``, ``n_children``, ``child_hash``: changes if any child's ``link`` or ``summary`` does, whatever the order.

    A sum of the children's hashes, so that it combines before it shuffles and a parent may have any number of children.
    """
    digest = F.md5(F.concat_ws("\n", "link", "summary"))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    return children.groupBy("parent").agg(F.count("*").alias("n_children"), F.sum(number).cast("string").alias("child_hash"))


def summary_records(notes: DataFrame, workspace: str) -> DataFrame:
    """Notes of a tier with ``link``, by which parents name them: code/<workspace>/<path without .md>."""
    return notes.where(F.col("tier").isin("1", "2", "3")).withColumn("link", F.concat(F.lit(f"code/{workspace}/"), F.regexp_replace("path", r"\.md$", "")))


def summary_section(summary: Column, meta: dict[str, Column]) -> Column:
    """A summary as a section of its note, with what it was made from."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in meta.items()]
    return F.concat(F.lit("## Summary\n\n<!-- cg:summary-meta\n"), F.concat_ws("\n", *lines), F.lit("\n-->\n\n"), strip(summary), F.lit("\n"))


def tier_totals(outcomes: DataFrame) -> DataFrame:
    """``tier``, ``summarized``, ``skipped``, ``failed`` of outcomes (tier, outcome)."""
    return outcomes.groupBy("tier").agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("summarized", "skipped", "failed")])


def needs_summary(notes: DataFrame, stored: DataFrame, settings: list[str]) -> DataFrame:
    """``note_id``, ``stale``: no stored text, or any of ``settings`` (tier, model, source_hash, child_hash, ...) differs."""
    both = notes.select("note_id", *settings).join(stored.select("note_id", "summary", *[F.col(c).alias(f"_{c}") for c in settings]), "note_id", "left")
    stale = F.coalesce("summary", F.lit("")) == ""
    for c in settings:
        stale = stale | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return both.select("note_id", stale.alias("stale"))


def child_context(children: DataFrame, budget: int, parts: int = 64) -> DataFrame:
    """``parent``, ``link``, ``part``: children's texts in order of link, cut where the parent's budget of characters ends.

    What lies beyond the budget of a part of a parent's children lies beyond that of all, so the parts leave out most
    first; the order of all is then worked out on links and lengths, and texts are joined to the few that are kept.
    """
    slim = children.select("parent", "link", F.length("text").alias("n"))
    spent = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("link").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slim = slim.withColumn("_part", F.pmod(F.xxhash64("link"), F.lit(parts)))
    near = slim.withColumn("_spent", spent("parent", "_part")).where(F.col("_spent") < budget)
    kept = near.withColumn("_spent", spent("parent")).where(F.col("_spent") < budget).select("parent", "link", "_spent")
    return children.join(kept, ["parent", "link"]).select("parent", "link", F.expr(f"substring(text, 1, {budget} - _spent)").alias("part"))


def read_summaries(spark: SparkSession, root: str, workspace: str) -> DataFrame:
    """Notes of a tier below ``root``: path, link, tier, both parents, ``text`` without its summary, ``summary`` and what is stored of how it was made."""
    raw = read_markdown(spark, root, workspace)
    front, body = split_front(F.col("text"))
    rows = raw.select(F.col("note_id").alias("path"), front.alias("front"), "text").withColumn("tier", front_field(F.col("front"), "tier"))
    section = F.regexp_extract("text", r"(?s)(?:^|\n)(## Summary\b.*)$", 1)
    meta = F.regexp_extract(section, r"(?s)<!-- cg:summary-meta\n(.*?)\n-->", 1)
    stored = {f"was_{k}": F.nullif(F.regexp_extract(meta, rf"(?m)^{k}: ?(.*)$", 1), F.lit("")) for k in SETTINGS}
    summary = strip(F.regexp_replace(F.regexp_replace(section, r"^## Summary[^\n]*", ""), r"(?s)<!-- cg:summary-meta\n.*?\n-->", ""))
    plain = F.regexp_replace(F.regexp_replace("text", r"(?s)(?:^|\n)## Summary\b.*$", ""), r"\s+$", "")
    parents = {k: front_field(F.col("front"), k) for k in PARENTS.values()}
    rows = rows.withColumns({**parents, **stored, "summary": summary, "plain": plain})
    return summary_records(rows.drop("text", "front").withColumnRenamed("plain", "text"), workspace)


def summarize_tier(notes: DataFrame, tier: str, model: dict[str, str], write: Callable[[list[str]], list[str]]) -> DataFrame:
    """Notes of one tier with ``outcome`` (summarized, skipped, failed), their new ``summary`` and ``note``, the file's new text.

    ``notes``: as ``read_summaries`` gives them, those of the tier below with the summaries written before.  A note is
    skipped if its summary is there and nothing it was made from has changed.  A note whose child has no summary fails, as
    does one that ``write`` fails on; the others go on.
    """
    own = notes.where(F.col("tier") == tier)
    none = F.lit(None).cast("string")
    if tier in PARENTS:
        below = notes.where(F.col("tier") == str(int(tier) - 1)).select(F.col(PARENTS[tier]).alias("parent"), "link", "summary").where("parent IS NOT NULL")
        below = below.join(own.select(F.col("link").alias("parent")), "parent", "left_semi")
        text = F.concat(F.lit("### "), "link", F.lit("\n"), "summary", F.lit("\n\n"))
        context = child_context(below.select("parent", "link", text.alias("text")), CHILD_BUDGET[tier]).groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("link", "part"))).alias("parts"))
        missing = below.groupBy("parent").agg(F.count_if(F.coalesce("summary", F.lit("")) == "").alias("missing"))
        kids = child_hashes(below).select(F.col("parent").alias("link"), "child_hash").join(missing.withColumnRenamed("parent", "link"), "link")
        own = own.join(kids, "link", "left").join(context.select(F.col("parent").alias("link"), F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("context")), "link", "left")
    else:
        own = own.withColumns({"child_hash": none, "missing": F.lit(0), "context": none})
    now = {"tier": F.col("tier"), **{k: F.lit(model.get(k, "")) for k in ("provider", "model")}, "prompt_version": F.lit(PROMPT_VERSION), "source_hash": F.sha2("text", 256), "child_hash": F.coalesce("child_hash", F.lit("")), "summary_hash": F.sha2(strip(F.col("summary")), 256)}
    own = own.withColumns({f"now_{k}": v for k, v in now.items()})
    stale = F.col("summary") == ""
    for k in SETTINGS:
        stale = stale | ~F.coalesce(f"now_{k}", F.lit("")).eqNullSafe(F.coalesce(f"was_{k}", F.lit("")))
    prompt = F.concat(F.lit(f"Tier: {tier}\n\nPrimary note:\n\n"), strip(F.col("text")), F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit("\n\nChild summaries:\n\n"), strip(F.col("context")))).otherwise(""))
    own = own.withColumn("outcome", F.when(~stale, "skipped").when(F.coalesce("missing", F.lit(0)) > 0, "failed").otherwise("asked"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = []
            for text in batch["prompt"]:
                try:
                    said.append(write([text])[0].strip() or None)
                except Exception:  # noqa: BLE001  the model's trouble, whatever it is; the note counts as failed
                    said.append(None)
            yield pd.DataFrame({"path": batch["path"], "said": pd.Series(said, dtype=object)})

    said = own.where("outcome = 'asked'").select("path", prompt.alias("prompt")).mapInPandas(ask, "path string, said string")
    done = own.join(said, "path", "left").withColumn("outcome", F.when(F.col("outcome") != "asked", F.col("outcome")).when(F.col("said").isNull(), "failed").otherwise("summarized"))
    meta = {k: F.sha2(F.col("said"), 256) if k == "summary_hash" else F.col(f"now_{k}") for k in SETTINGS}
    note = F.when(F.col("outcome") == "summarized", F.concat("text", F.lit("\n\n"), summary_section(F.col("said"), meta)))
    return done.select(*[F.col(c) for c in notes.columns if c != "summary"], F.when(F.col("outcome") == "summarized", F.col("said")).otherwise(F.col("summary")).alias("summary"), "outcome", note.alias("note"))


def summarize_workspace(spark: SparkSession, root: str, workspace: str, model: dict[str, str], write: Callable[[list[str]], list[str]]) -> dict:
    """Summaries of all notes below ``root``, from symbols up to folders, written into the notes; counts by tier, and ``failed``, the tier that stopped it.

    ``write`` turns prompts into texts and runs in the tasks.  Each tier reads the summaries that the one below has just
    written.  A tier with a failure keeps what it has written and stops those above; a later run does what is left.
    """
    notes, outcomes, failed = cut(read_summaries(spark, root, workspace), spark), [], None
    for tier in ("1", "2", "3"):
        done = cut(summarize_tier(notes, tier, model, write), spark)
        write_files(done.where("note IS NOT NULL").select(F.col("path").alias("rel_path"), F.col("note").alias("content")), root)
        outcomes.append(done.select("tier", "outcome"))
        notes = cut(notes.where(F.col("tier") != tier).unionByName(done.drop("outcome", "note")), spark)
        if done.where("outcome = 'failed'").limit(1).count():
            failed = tier
            break
    every = outcomes[0]
    for more in outcomes[1:]:
        every = every.union(more)
    counts = {r.tier: r.asDict() for r in tier_totals(every).collect()}  # a row a tier
    return {"tiers": {t: {k: v for k, v in c.items() if k != "tier"} for t, c in counts.items()}, "failed": failed}
