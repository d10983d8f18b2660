"""The driver's tables seen as notes, graphs, vectors and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import tag_list, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: one per document, tagged with its language and source."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("src/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("doc_id").alias("note_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        tag_list(F.array("lang", "source")).alias("tags"),
        F.col("source").alias("workspace"),
        F.when(F.col("doc_id") % 50 == 0, "index").otherwise("concept").alias("note_type"),
    )


NOTES_SQL = """
notes AS (
  SELECT 'src/' || source || '/doc_' || doc_id || '.md' AS path, doc_id AS note_id, string_split(text, chr(10))[1] AS title, text AS body,
         [lang, source] AS tags, source AS workspace, CASE WHEN doc_id % 50 = 0 THEN 'index' ELSE 'concept' END AS note_type
  FROM documents
)"""


def key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customer ordered from which supplier."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct()


def star_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as modules, nations as files, customers and suppliers as symbols."""
    region = table(spark, sf_dir, "region").select(key("r:", "r_regionkey").alias("note_id"), F.col("r_name").alias("title"), F.lit("3").alias("tier"), F.lower("r_name").alias("path"))
    nation = table(spark, sf_dir, "nation").select(
        key("n:", "n_nationkey").alias("note_id"),
        F.col("n_name").alias("title"),
        F.lit("2").alias("tier"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/"), F.lower("n_name")).alias("path"),
    )
    out = region.union(nation)
    for name, p, k, n in (("customer", "c:", "c_custkey", "c_name"), ("supplier", "s:", "s_suppkey", "s_name")):
        out = out.union(table(spark, sf_dir, name).select(key(p, k), F.col(n), F.lit("1"), F.concat(F.lit("sym/"), key(p, k))))
    tags = F.when((F.col("tier") == "2") & (F.length("title") <= 5), F.array(F.lit("entrypoint"))).otherwise(F.array().cast("array<string>"))
    return out.select("*", tags.alias("tags"), F.lit("concept").alias("note_type"), tokens(F.col("title")).alias("name_tokens"))


STAR_NOTES_SQL = """
star AS (
  SELECT 'r:' || r_regionkey AS note_id, r_name AS title, '3' AS tier, lower(r_name) AS path FROM region
  UNION ALL SELECT 'n:' || n_nationkey, n_name, '2', 'r' || n_regionkey || '/' || lower(n_name) FROM nation
  UNION ALL SELECT 'c:' || c_custkey, c_name, '1', 'sym/c:' || c_custkey FROM customer
  UNION ALL SELECT 's:' || s_suppkey, s_name, '1', 'sym/s:' || s_suppkey FROM supplier
)"""


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges of the star schema, both directions of containment, distinct."""
    nation = table(spark, sf_dir, "nation").select(key("n:", "n_nationkey").alias("a"), key("r:", "n_regionkey").alias("b"))
    symbols = table(spark, sf_dir, "customer").select(key("c:", "c_custkey").alias("a"), key("n:", "c_nationkey").alias("b"))
    symbols = symbols.union(table(spark, sf_dir, "supplier").select(key("s:", "s_suppkey"), key("n:", "s_nationkey")))
    called = calls(spark, sf_dir)
    nations = (
        called.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .where("c_nationkey <> s_nationkey")
        .select(key("n:", "c_nationkey").alias("a"), key("n:", "s_nationkey").alias("b"))
        .distinct()
    )
    both = lambda df, to, back: df.select("a", F.lit(to), "b").union(df.select("b", F.lit(back), "a"))
    out = both(nation, "BELONGS_TO", "CONTAINS").union(both(symbols, "DEFINED_IN", "CONTAINS_SYMBOL"))
    out = out.union(called.select(key("c:", "o_custkey"), F.lit("CALLS"), key("s:", "l_suppkey"))).union(nations.select("a", F.lit("IMPORTS"), "b"))
    return out.toDF("src", "label", "dst")


STAR_EDGES_SQL = """
called AS (
  SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey
), contained AS (
  SELECT 'n:' || n_nationkey AS a, 'r:' || n_regionkey AS b, 'BELONGS_TO' AS up, 'CONTAINS' AS down FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'DEFINED_IN', 'CONTAINS_SYMBOL' FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'DEFINED_IN', 'CONTAINS_SYMBOL' FROM supplier
), edges AS (
  SELECT a AS src, up AS label, b AS dst FROM contained UNION ALL SELECT b, down, a FROM contained
  UNION ALL SELECT 'c:' || o_custkey, 'CALLS', 's:' || l_suppkey FROM called
  UNION ALL SELECT DISTINCT 'n:' || c_nationkey, 'IMPORTS', 'n:' || s_nationkey
    FROM called JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey
), near AS (
  SELECT src AS node, dst AS neighbour, label, 'outgoing' AS direction FROM edges
  UNION ALL SELECT dst, src, label, 'incoming' FROM edges
)"""

#: Order in which edge labels break ties, as SQL.
LABEL_RANK_SQL = "list_position(['CALLS', 'CONTAINS_SYMBOL', 'DEFINED_IN', 'CONTAINS', 'IMPORTS', 'LINKS_TO', 'BELONGS_TO'], label)"


def vector_notes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings as symbols, their labels as files, and edges: each vector's label, and a link to another vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    k = F.col("vec_id").cast("string")
    kind = F.when(F.col("vec_id") % 50 == 0, "index").otherwise("concept")
    tag = F.concat(F.lit("l"), F.col("label").cast("string"))
    vectors = e.select(F.concat(F.lit("v:"), k).alias("note_id"), F.concat(F.lit("Vector "), k).alias("title"), F.lit("1").alias("tier"), F.concat(F.lit("vec/"), k).alias("path"), F.array(tag).alias("tags"), kind.alias("note_type"), F.lit("").alias("body"))
    files = e.select("label").distinct().select(key("l:", "label"), key("Label ", "label"), F.lit("2"), key("label/", "label"), F.array(tag), F.lit("concept"), F.lit(""))
    n = e.agg(F.count("*").alias("n"))
    other = F.concat(F.lit("v:"), ((F.col("vec_id") * 7 + 1) % F.col("n")).cast("string"))
    owned = e.select(key("v:", "vec_id").alias("v"), key("l:", "label").alias("l"))
    links = e.join(F.broadcast(n)).select(key("v:", "vec_id").alias("src"), F.lit("LINKS_TO").alias("label"), other.alias("dst")).where("src <> dst")
    edges = owned.select(F.col("v").alias("src"), F.lit("DEFINED_IN").alias("label"), F.col("l").alias("dst")).union(owned.select("l", F.lit("CONTAINS_SYMBOL"), "v")).union(links)
    return vectors.union(files), edges.distinct()


VECTOR_NOTES_SQL = """
vnotes AS (
  SELECT 'v:' || vec_id AS note_id, CASE WHEN vec_id % 50 = 0 THEN 'index' ELSE 'concept' END AS note_type, ['l' || label] AS tags FROM embeddings
), edges AS (
  SELECT 'v:' || vec_id AS src, 'DEFINED_IN' AS label, 'l:' || label AS dst FROM embeddings
  UNION SELECT 'l:' || label, 'CONTAINS_SYMBOL', 'v:' || vec_id FROM embeddings
  UNION SELECT * FROM (SELECT 'v:' || vec_id AS src, 'LINKS_TO', 'v:' || (vec_id * 7 + 1) % (SELECT count(*) FROM embeddings) AS dst FROM embeddings) WHERE src <> dst
), near AS (
  SELECT src AS node, dst AS neighbour, label, 'outgoing' AS direction FROM edges
  UNION ALL SELECT dst, src, label, 'incoming' FROM edges
)"""


def tiered_notes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents by fours as module, file, symbol and plain note, each in the one before it, and links between them."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"))
    name = lambda c: F.concat(F.lit("d"), c.cast("string"), F.lit(".md"))
    k, m = F.col("k"), F.col("k") % 4
    up = name(k - 1)
    folder = F.when(k % 8 == 0, F.concat(F.lit("m"), k.cast("string"))).otherwise(F.concat(F.lit("m"), (k - 4).cast("string"), F.lit("/s"), k.cast("string")))
    notes = d.select(
        name(k).alias("note_id"),
        F.element_at(F.array(*map(F.lit, ("3", "2", "1", ""))), (m + 1).cast("int")).alias("tier"),
        F.when(m == 2, up).alias("parent_file"),
        F.when(m == 1, up).alias("parent_module"),
        F.when(m == 0, folder).otherwise(".").alias("source_dir"),
    )
    n = d.agg(F.count("*").alias("n"))
    targets = F.explode(F.array_distinct(F.array(k + 4, (k * 3 + 4) % F.col("n"), k - 4))).alias("to")
    return notes, d.join(F.broadcast(n)).select("k", targets).select(name(k).alias("src"), name(F.col("to")).alias("dst"))


def pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as push deliveries: users as workspaces; the type as ref; every seventh without delivery id."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        "ts",
        F.concat(F.lit("w"), (F.col("user_id") % 40).cast("string")).alias("workspace"),
        F.when(F.col("event_type") == "view", F.lit("refs/heads/main")).when(F.col("event_type") == "click", F.lit("")).otherwise(F.concat(F.lit("refs/heads/"), "event_type")).alias("ref"),
        F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 1000).cast("string")).alias("delivery_id"),
        F.col("user_id").cast("string").alias("commit"),
        F.when(F.col("event_id") % 11 == 0, "").when(F.col("event_id") % 13 == 0, "wrong").otherwise("secret").alias("token"),
    )


PUSHES_SQL = """
pushes AS (
  SELECT event_id, ts, 'w' || (user_id % 40) AS workspace,
         CASE WHEN event_type = 'view' THEN 'refs/heads/main' WHEN event_type = 'click' THEN '' ELSE 'refs/heads/' || event_type END AS ref,
         CASE WHEN event_id % 7 <> 0 THEN (event_id % 1000)::VARCHAR END AS delivery_id, user_id::VARCHAR AS commit,
         CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'wrong' ELSE 'secret' END AS token
  FROM events
), keyed AS (
  SELECT *, CASE WHEN coalesce(delivery_id, '') <> '' THEN 'delivery:' || workspace || ':' || delivery_id
                 ELSE 'push:' || workspace || ':' || coalesce(ref, '') || ':' || coalesce(commit, '') END AS key
  FROM pushes
)"""
