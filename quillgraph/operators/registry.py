"""The registry of workspaces as a table: checks, registrations, status, and what is deleted with a workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the form of a workspace's name, of 2 to 64 characters.
NAME_PATTERN = "^[a-z0-9][a-z0-9_-]{0,62}[a-z0-9]$"


def valid_name(name: Column) -> Column:
    return F.coalesce(F.length(name).between(2, 64) & name.rlike(NAME_PATTERN), F.lit(False))


def valid_languages(languages: Column) -> Column:
    """Whether all of an array are non-empty strings; null isn't valid, an empty array is."""
    return F.coalesce(~F.exists(languages, lambda x: x.isNull() | (x == "")), F.lit(False))


def languages_of(languages: Column) -> Column:
    """Each language once, in order of first mention."""
    return F.array_distinct(languages)


def register(registry: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry after ``asked`` entries (workspace, name, languages, ...) and, of each, ``workspace``, ``outcome``.

    ``outcome``: registered, bad_name, bad_languages, or taken (an entry of that name is there, or asked for by a
    smaller workspace id).
    """
    held = registry.select("name").distinct().withColumn("_held", F.lit(True))
    first = asked.groupBy("name").agg(F.min("workspace").alias("_first"))
    rows = asked.join(held, "name", "left").join(first, "name", "left")
    outcome = (
        F.when(~valid_name(F.col("name")), "bad_name")
        .when(~valid_languages(F.col("languages")), "bad_languages")
        .when(F.col("_held").isNotNull() | (F.col("workspace") != F.col("_first")), "taken")
        .otherwise("registered")
    )
    rows = rows.withColumn("outcome", outcome)
    added = rows.where("outcome = 'registered'").withColumn("languages", languages_of(F.col("languages"))).select(*registry.columns)
    return registry.unionByName(added), rows.select("workspace", "outcome")


def unregister(registry: DataFrame, notes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry without the workspaces ``gone`` (workspace), and the paths of notes that go with them."""
    return registry.join(gone, "workspace", "left_anti"), notes.join(gone, "workspace", "left_semi").select("workspace", "path")


def patched(status: DataFrame, patch: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """``status`` (workspace, status: map) with a patch (the same) laid over it, and both over the defaults."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]) if defaults else F.create_map().cast("map<string,string>")
    new = patch.select("workspace", F.col("status").alias("_patch"))
    none = F.create_map().cast("map<string,string>")
    over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)
    whole = over(over(base, F.coalesce("status", none)), F.coalesce("_patch", none))
    return status.join(new, "workspace", "left").select("workspace", whole.alias("status"))


def status_view(registry: DataFrame, jobs: DataFrame, notes: DataFrame) -> DataFrame:
    """Each workspace with its running and waiting jobs (jobs: workspace, state), its number of notes and whether it is busy."""
    queue = jobs.groupBy("workspace").agg(F.count_if(F.col("state") == "running").alias("running"), F.count_if(F.col("state") == "pending").alias("waiting"))
    size = notes.groupBy("workspace").agg(F.count("*").alias("n_notes"))
    out = registry.select("workspace").join(queue, "workspace", "left").join(size, "workspace", "left").fillna(0, ["running", "waiting", "n_notes"])
    return out.withColumn("busy", F.col("running") > 0)


def total_notes(notes: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """``n_workspaces``, ``n_notes``: how much a rebuild of some workspaces (workspace) has read."""
    asked = rebuilt.select("workspace").distinct()
    return asked.join(notes.groupBy("workspace").agg(F.count("*").alias("n")), "workspace", "left").agg(F.count("*").alias("n_workspaces"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_notes"))


def not_paused(events: DataFrame, paused: DataFrame) -> DataFrame:
    """Events of workspaces that aren't paused; a paused workspace of null pauses all."""
    every = paused.where("workspace IS NULL").limit(1).select(F.lit(True).alias("_all"))
    left = events.join(paused.where("workspace IS NOT NULL").select("workspace").distinct(), "workspace", "left_anti").select(*events.columns)
    return left.join(F.broadcast(every), F.lit(True), "left").where("_all IS NULL").drop("_all")
