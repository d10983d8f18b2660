"""Registered queries of the retrieval engine and their SQL equivalents.

Every query runs over its whole tables.  ``register`` pairs a query with the SQL that gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions import vectors as V
from quillgraph.functions.routing import BROAD_TERMS, DISCOVER_PHRASES, FILLER, query_mode
from quillgraph.operators import clusters, embedding, events, graph, incremental, keyword_index, links, mirror, registry, render, retrieval, summaries, targeted, vector_index
from quillgraph.sources import files

from . import fixtures as X
from .fixtures import LABEL_RANK_SQL, NOTES_SQL, PUSHES_SQL, STAR_EDGES_SQL, STAR_NOTES_SQL, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"
#: Distinct normalized words of an expression, sorted.
TOKENS = "list_sort(list_distinct(list_filter([" + NORM.format("w") + " for w in regexp_split_to_array(lower({}), '\\s+')], lambda x: x <> '')))"


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(c) -> F.Column:
    return F.round(c, 6)


# ---- vectors

COSINE = "list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[])"


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@register(f"SELECT vec_id, label, round({COSINE.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')}, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 8")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.vector_topk(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 8)
    return top.select("vec_id", "label", rounded("score").alias("score"))


@register(f"SELECT vec_id, label, round({COSINE.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 8")
def vector_topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.vector_topk(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 8, F.col("label") == 3)
    return top.select("vec_id", "label", rounded("score").alias("score"))


@register(
    f"""
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, s.score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(s.score, 9) DESC, e.vec_id)::INT AS rank
  FROM embeddings q, embeddings e, LATERAL (SELECT {COSINE.format("q.embedding", "e.embedding")} AS score) s WHERE q.vec_id % 100 = 0
) WHERE rank <= 8"""
)
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "embeddings")
    queries = chunks.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.vector_topk_batch(chunks, queries, 8).select("query_id", "vec_id", rounded("score").alias("score"), "rank")


@register(
    f"""
SELECT note_id, round(max(s), 6) AS score FROM (
  SELECT vec_id % 100 AS note_id, {COSINE.format("embedding", "(SELECT embedding FROM embeddings WHERE vec_id = 0)")} AS s FROM embeddings
) GROUP BY note_id"""
)
def vector_best_per_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = F.array(*[F.lit(float(x)) for x in first_vector(spark, sf_dir)])
    hits = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 100).alias("note_id"), V.cosine(V.doubles(F.col("embedding")), vector).alias("score"))
    return retrieval.best_per_note(hits).select("note_id", rounded("score").alias("score"))


@register(
    f"""
SELECT vec_id, round(0.8 * greatest(0.6, least(1.4, {COSINE.format("embedding", "(SELECT embedding FROM embeddings WHERE vec_id = 0)")} + 0.5)), 6) AS score FROM embeddings"""
)
def triple_factor_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = F.array(*[F.lit(float(x)) for x in first_vector(spark, sf_dir)])
    sim = V.cosine(V.doubles(F.col("embedding")), vector)
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(F.lit(0.8) * V.triple_factor(sim)).alias("score"))


@register()
def vector_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``vector_topk_batch`` by a stored index: no SQL, the lists that are read hold most of the nearest rows, not all."""
    chunks = table(spark, sf_dir, "embeddings")
    index = vector_index.VectorIndex.build(chunks, graph.scratch_path(spark, "vectors"))
    queries = chunks.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return index.topk_batch(queries, 8).select("query_id", "vec_id", rounded("score").alias("score"), "rank")


PAIRS_SQL = f"""
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b, {COSINE.format("a.embedding", "b.embedding")} AS sim
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COSINE.format("a.embedding", "b.embedding")} >= 0.4
)"""


@register(f"WITH {PAIRS_SQL} SELECT a, b, round(sim, 6) AS sim FROM pairs")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.similar_pairs(table(spark, sf_dir, "embeddings"), 0.4).select("a", "b", rounded("sim").alias("sim"))


@register(
    f"""
WITH RECURSIVE {PAIRS_SQL}, both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT DISTINCT a AS node, a AS other FROM both_ways UNION SELECT r.node, p.b FROM reach r JOIN both_ways p ON r.other = p.a),
member AS (SELECT node, min(other) AS cluster_id FROM reach GROUP BY node),
degree AS (SELECT a AS node, count(*) AS d FROM both_ways GROUP BY a),
rep AS (SELECT cluster_id, node AS representative, count(*) OVER (PARTITION BY cluster_id) AS size,
               row_number() OVER (PARTITION BY cluster_id ORDER BY d DESC, node) AS n FROM member JOIN degree USING (node))
SELECT r.cluster_id, r.size, r.representative, round(max(sim), 6) AS max_sim, round(min(sim), 6) AS min_sim, round(avg(sim), 6) AS avg_sim
FROM rep r JOIN member m USING (cluster_id) JOIN pairs p ON p.a = m.node WHERE r.n = 1 GROUP BY ALL"""
)
def near_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = clusters.near_duplicate_clusters(table(spark, sf_dir, "embeddings"), 0.4)
    return found.select("cluster_id", "size", "representative", *[rounded(c).alias(c) for c in ("max_sim", "min_sim", "avg_sim")])


# ---- text

WORDS = "the thing and of it"


def keyword_sql(where: str) -> str:
    shared = lambda e: f"len(list_intersect({e}, q))"
    body = TOKENS.format("body")
    return f"""
WITH {NOTES_SQL}, raw AS (
  SELECT note_id, 0.4 * {shared(TOKENS.format("title"))} + 0.3 * {shared("[" + NORM.format("t") + " for t in tags]")}
         + 0.2 * {shared(TOKENS.format("regexp_replace(path, '[/.]+', ' ', 'g')"))} + least(0.05 * {shared(body)}, 0.3) AS raw
  FROM notes, (SELECT {TOKENS.format(f"'{WORDS}'")} AS q) WHERE note_type <> 'index' {where}
), best AS (SELECT * FROM raw WHERE raw > 0 ORDER BY round(raw, 9) DESC, note_id LIMIT 8)
SELECT note_id, round(raw / (SELECT max(raw) FROM best), 6) AS score FROM best"""


@register(keyword_sql(""))
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_topk(X.notes(spark, sf_dir), WORDS).select("note_id", rounded("score").alias("score"))


@register(keyword_sql(""))
def keyword_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = X.notes(spark, sf_dir)
    index = keyword_index.KeywordIndex(spark, graph.scratch_path(spark, "keywords"), id_type=dict(notes.dtypes)["note_id"])
    index.add(notes)
    return index.topk(WORDS).select("note_id", rounded("score").alias("score"))


@register(keyword_sql("AND workspace = 'src3'"))
def keyword_search_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.keyword_topk(X.notes(spark, sf_dir).where("workspace = 'src3'"), WORDS).select("note_id", rounded("score").alias("score"))


@register(f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents")
def token_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(T.tokens(F.col("text"))).alias("tokens"))


@register(f"SELECT p_partkey, list_sort(list_distinct([{NORM.format('t')} for t in [p_brand, p_type, p_name]])) AS tags FROM part")
def tag_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_sort(T.tag_list(F.array("p_brand", "p_type", "p_name"))).alias("tags"))


@register("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Doc ' || doc_id WHEN doc_id % 3 = 1 THEN 'H ' || doc_id ELSE 'Doc ' || doc_id || ' Of ' || upper(source[1]) || source[2:] END AS title FROM documents")
def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    front = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" Doc "), number))
    body = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x\n# H "), number, F.lit("\n"), "text")).otherwise("")
    path = F.concat(F.lit("notes/doc-"), number, F.lit("_of-"), "source", F.lit(".md"))
    return d.select("doc_id", T.title(front, body, path).alias("title"))


@register("SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1') AS stem FROM pages")
def stem_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.stem(F.col("url")).alias("stem"))


@register(
    """
SELECT doc_id, CASE WHEN length(t) <= 1200 THEN t ELSE regexp_replace(t[1:1200], '\\s+$', '') || chr(10) || '...' END AS excerpt
FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)"""
)
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@register("SELECT doc_id, [lang, 'doc ' || doc_id] AS links FROM documents")
def wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    body = F.concat(F.lit("see [["), "lang", F.lit("]] or [[ doc "), F.col("doc_id").cast("string"), F.lit("|that]] and [[  ]] [["), "lang", F.lit("|again]]\n"), "text")
    return d.select("doc_id", T.wikilinks(body).alias("links"))


def fronted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes with frontmatter; every fifth block isn't closed."""
    n = F.col("doc_id").cast("string")
    close = F.when(F.col("doc_id") % 5 == 0, "").otherwise("---\n")
    head = F.concat(F.lit("---\ntype: Tool\ntier: "), (F.col("doc_id") % 4).cast("string"), F.lit("\nparentFile:  a/b"), n, F.lit(".md \ntags:\n  - X "), "lang", F.lit("\n  - two\n"), close)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(head, F.lit("\n"), "text").alias("text"))


@register(
    """
SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 4 > 0 THEN (doc_id % 4)::VARCHAR ELSE '' END AS tier,
       CASE WHEN doc_id % 5 <> 0 THEN 'a/b' || doc_id || '.md' ELSE '' END AS parent_file,
       CASE WHEN doc_id % 5 <> 0 THEN ['x_' || lang, 'two'] ELSE [] END AS tags, CASE WHEN doc_id % 5 <> 0 THEN 'tool' ELSE 'concept' END AS note_type
FROM documents"""
)
def frontmatter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    front, _ = T.split_front(F.col("text"))
    d = fronted(spark, sf_dir).withColumn("front", front)
    f = F.col("front")
    tier = T.front_field(f, "tier")
    return d.select(
        "doc_id",
        F.coalesce(F.when(tier.isin(*T.TIERS), tier), F.lit("")).alias("tier"),
        F.coalesce(T.front_field(f, "parentFile"), F.lit("")).alias("parent_file"),
        T.tag_list(T.front_list(f, "tags")).alias("tags"),
        T.note_type(T.front_field(f, "type"), F.lit("x/y.md")).alias("note_type"),
    )


@register("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'codeUnit' WHEN 1 THEN 'tool' WHEN 2 THEN 'index' ELSE 'concept' END AS note_type FROM documents")
def note_type_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 4
    path = F.when(m == 1, F.concat(F.lit("tools/"), "source", F.lit(".md"))).when(m == 2, "a/Index.md").otherwise("a/b.md")
    return table(spark, sf_dir, "documents").select("doc_id", T.note_type(F.when(m == 0, " CodeUnit ").when(m == 3, "nonsense"), path).alias("note_type"))


@register(
    """
SELECT doc_id, (i // 1336)::INT AS chunk_index, md5(text[i + 1:i + 1536]) AS h
FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 1536 THEN [0] ELSE range(0, length(text), 1336) END) AS i FROM documents)"""
)
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.chunks(F.col("text"))).alias("c"))
    return d.select("doc_id", "c.chunk_index", F.md5("c.text").alias("h"))


@register("SELECT doc_id, md5(text) AS hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))


@register(
    """
SELECT source AS workspace, count(*) AS n_notes, sum(('0x' || md5(doc_id || ':' || md5(text))[1:15])::BIGINT)::VARCHAR AS fingerprint
FROM documents GROUP BY source"""
)
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.notes(spark, sf_dir).select(F.col("note_id").cast("string").alias("note_id"), "body", "workspace")
    return incremental.corpus_fingerprint(d, "workspace")


@register("SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return d.where("n > 1")


@register("SELECT doc_id, round(0.5 * (1 + least(0.1 * len(list_filter([lang, source, 'x'], lambda t: t IN ('en', 'src1', 'x'))), 0.3)), 6) AS score FROM documents")
def tag_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = F.array(F.lit("en"), F.lit("src1"), F.lit("x"))
    return table(spark, sf_dir, "documents").select("doc_id", rounded(V.tag_boost(F.lit(0.5), F.array("lang", "source", F.lit("x")), query)).alias("score"))


def quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


@register(
    f"""
WITH q AS (
  SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Show me the MODULES' WHEN 1 THEN 'big picture of ' || text WHEN 2 THEN 'system flow of src_1' ELSE text END AS query
  FROM conversations WHERE role = 'user'
), w AS (
  SELECT *, list_filter([{NORM.format("w")} for w in regexp_split_to_array(lower(query), '[^A-Za-z0-9_./-]+')], lambda t: t <> '') AS words FROM q
), m AS (
  SELECT *, list_filter(words, lambda t: t NOT IN ({quoted(FILLER)})) AS meant FROM w
)
SELECT conv_id, turn, CASE WHEN {" OR ".join(f"contains(lower(query), '{p}')" for p in DISCOVER_PHRASES)} THEN 'discover'
  WHEN len(list_filter(words, lambda t: contains(t, '_'))) = 0 AND len(meant) > 0 AND len(list_filter(meant, lambda t: t NOT IN ({quoted(BROAD_TERMS)}))) = 0 THEN 'discover'
  ELSE 'targeted' END AS mode FROM m"""
)
def query_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    m = F.col("turn") % 4
    query = F.when(m == 0, "Show me the MODULES").when(m == 1, F.concat(F.lit("big picture of "), "text")).when(m == 2, "system flow of src_1").otherwise(F.col("text"))
    return c.select("conv_id", "turn", query_mode(query).alias("mode"))


# ---- links and graph


@register(
    """
WITH n AS (
  SELECT 'w' || p_size % 5 AS workspace, 'parts/' || replace(p_name, ' ', '_') || '/' || p_partkey || '.md' AS note_id, p_partkey AS k FROM part
), l AS (
  SELECT workspace, k, note_id AS own, CASE k % 5 WHEN 0 THEN note_id WHEN 1 THEN replace(note_id, '.md', '') WHEN 2 THEN k || '.md'
         WHEN 3 THEN 'elsewhere/' || k || '.txt' ELSE 'none/x' || k END AS target FROM n
)
SELECT workspace, target, CASE WHEN k % 5 < 4 THEN own END AS note_id,
       CASE k % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'md' WHEN 2 THEN 'suffix' WHEN 3 THEN 'stem' END AS how FROM l"""
)
def link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select(
        F.concat(F.lit("w"), (F.col("p_size") % 5).cast("string")).alias("workspace"),
        F.concat(F.lit("parts/"), F.translate("p_name", " ", "_"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("note_id"),
        F.lit("concept").alias("note_type"),
        F.col("p_partkey").alias("k"),
    )
    k, m = F.col("k").cast("string"), F.col("k") % 5
    target = (
        F.when(m == 0, F.col("note_id"))
        .when(m == 1, F.regexp_replace("note_id", r"\.md$", ""))
        .when(m == 2, F.concat(k, F.lit(".md")))
        .when(m == 3, F.concat(F.lit("elsewhere/"), k, F.lit(".txt")))
        .otherwise(F.concat(F.lit("none/x"), k))
    )
    return links.resolve_links(n.select("workspace", target.alias("target")), n)


@register(f"WITH {STAR_EDGES_SQL} SELECT src, label, dst FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.star_edges(spark, sf_dir)


@register(f"WITH {STAR_EDGES_SQL} SELECT label, count(*) AS n_edges, count(DISTINCT src) AS n_sources FROM edges GROUP BY label")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.star_edges(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_sources"))


DEGREE_SQL = f"""
{STAR_EDGES_SQL}, {STAR_NOTES_SQL}, degree AS (
  SELECT note_id, sum(w)::BIGINT AS degree FROM (
    SELECT s.note_id, CASE WHEN d.note_id IS NULL THEN 1 ELSE 2 END AS w FROM edges JOIN inside s ON s.note_id = src LEFT JOIN inside d ON d.note_id = dst
    UNION ALL SELECT d.note_id, CASE WHEN s.note_id IS NULL THEN 1 ELSE 2 END FROM edges JOIN inside d ON d.note_id = dst LEFT JOIN inside s ON s.note_id = src
  ) GROUP BY note_id
)"""


@register(f"WITH {DEGREE_SQL.replace(', degree AS', ', inside AS (SELECT note_id FROM star WHERE tier IN (chr(50), chr(51))), degree AS')} SELECT * FROM degree")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(X.star_edges(spark, sf_dir), X.star_notes(spark, sf_dir).where("tier IN ('2', '3')"))


@register(f"WITH {STAR_EDGES_SQL} SELECT * FROM near WHERE label IN ('CALLS', 'BELONGS_TO')")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(X.star_edges(spark, sf_dir), ["CALLS", "BELONGS_TO"])


def path_sql(pairs: str, labels: str, tail: str, base: str = STAR_EDGES_SQL) -> str:
    return f"""
WITH RECURSIVE {base}, ends AS ({pairs}), used AS (SELECT * FROM near {labels}),
reach AS (
  SELECT pair_id, "start" AS node, 0 AS pos FROM ends
  UNION SELECT r.pair_id, u.neighbour, r.pos + 1 FROM reach r JOIN used u ON u.node = r.node WHERE r.pos < 8
), dist AS (SELECT pair_id, node, min(pos) AS pos FROM reach GROUP BY pair_id, node),
parent AS (
  SELECT d.pair_id, d.node, d.pos, u.node AS from_node, u.label, u.direction,
         row_number() OVER (PARTITION BY d.pair_id, d.node ORDER BY u.node, {LABEL_RANK_SQL.replace("label)", "u.label)")}, u.direction) AS n
  FROM dist d JOIN used u ON u.neighbour = d.node JOIN dist p ON p.pair_id = d.pair_id AND p.node = u.node AND p.pos = d.pos - 1
), steps AS (
  SELECT d.pair_id, d.node, d.pos FROM dist d JOIN ends e ON e.pair_id = d.pair_id AND e."end" = d.node
  UNION SELECT s.pair_id, p.from_node, s.pos - 1 FROM steps s JOIN parent p ON p.pair_id = s.pair_id AND p.node = s.node AND p.n = 1
)
{tail}"""


STEPS_SQL = """
SELECT s.pair_id, s.pos, s.node AS node_id, p.label AS edge_label, coalesce(p.direction, '') AS edge_direction, p.from_node AS from_node_id
FROM steps s LEFT JOIN parent p ON p.pair_id = s.pair_id AND p.node = s.node AND p.n = 1"""


def pairs_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "pair_id int, start string, end string")


@register(path_sql("""SELECT 1 AS pair_id, 'c:1' AS "start", 'c:77' AS "end" UNION ALL SELECT 2, 's:3', 'r:2' UNION ALL SELECT 3, 'n:4', 'n:4' UNION ALL SELECT 4, 'c:1', 'nowhere'""", "", STEPS_SQL))
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pairs_of(spark, [(1, "c:1", "c:77"), (2, "s:3", "r:2"), (3, "n:4", "n:4"), (4, "c:1", "nowhere")])
    return graph.shortest_paths(X.star_edges(spark, sf_dir), pairs)


@register(path_sql("""SELECT 1 AS pair_id, 'c:1' AS "start", 'c:77' AS "end" UNION ALL SELECT 2, 'n:1', 'n:3' UNION ALL SELECT 3, 'n:1', 'c:1'""", "WHERE label IN ('CALLS', 'BELONGS_TO')", STEPS_SQL))
def path_with_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pairs_of(spark, [(1, "c:1", "c:77"), (2, "n:1", "n:3"), (3, "n:1", "c:1")])
    return graph.shortest_paths(X.star_edges(spark, sf_dir), pairs, ["CALLS", "BELONGS_TO"])


@register(
    path_sql(
        """SELECT 12 AS pair_id, 'c:1' AS "start", 's:2' AS "end" UNION ALL SELECT 13, 'c:1', 'n:3' UNION ALL SELECT 23, 's:2', 'n:3'""",
        "",
        "SELECT node AS node_id, min(pair_id) AS first_pair, 1 AS depth FROM steps WHERE node NOT IN ('c:1', 's:2', 'n:3') GROUP BY node",
    )
)
def inter_seed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = graph.shortest_paths(X.star_edges(spark, sf_dir), pairs_of(spark, [(12, "c:1", "s:2"), (13, "c:1", "n:3"), (23, "s:2", "n:3")]))
    return steps.where(~F.col("node_id").isin("c:1", "s:2", "n:3")).groupBy("node_id").agg(F.min("pair_id").alias("first_pair")).withColumn("depth", F.lit(1))


@register(
    f"""
WITH {STAR_NOTES_SQL}, q AS (
  SELECT unnest(['c:5', 'CUSTOMER#00000001', 'asia', 'zzz']) AS query
), hits AS (
  SELECT query, note_id, CASE WHEN note_id = query THEN 0 WHEN contains(lower(title), lower(query)) THEN 1 END AS how FROM q, star
)
SELECT query, arg_min(note_id, struct_pack(h := how, n := note_id)) AS note_id, CASE min(how) WHEN 0 THEN 'exact' ELSE 'substring' END AS resolved_by
FROM hits WHERE how IS NOT NULL GROUP BY query"""
)
def endpoint_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.resolve_endpoints(X.star_notes(spark, sf_dir), ["c:5", "CUSTOMER#00000001", "asia", "zzz"])


#: How an edge reads, as SQL.
PHRASE_SQL = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in graph.EDGE_PHRASES.items()) + " END"
SEEDS = [("n:1", 0.9, 1), ("c:1", 0.5, 2), ("s:2", 0.7, 3)]


def expand_sql(depth: int, triples: bool = False) -> str:
    seeds = "VALUES ('n:1', 0.9::DOUBLE, 1), ('c:1', 0.5, 2), ('s:2', 0.7, 3)"
    weight = "CASE label WHEN 'CALLS' THEN 0.80 WHEN 'CONTAINS_SYMBOL' THEN 0.85 WHEN 'DEFINED_IN' THEN 0.70 WHEN 'CONTAINS' THEN 0.70 WHEN 'IMPORTS' THEN 0.60 WHEN 'LINKS_TO' THEN 0.50 ELSE 0.40 END"
    words = "['entrypoint', 'china', 'france', 'japan']"
    phrase = f"CASE direction WHEN 'outgoing' THEN st.title ELSE t.title END || ' ' || {PHRASE_SQL} || ' ' || CASE direction WHEN 'outgoing' THEN t.title ELSE st.title END"
    factor = f"greatest(0.6, least(1.4, len(list_intersect({TOKENS.format(phrase)}, {words})) / 4 + 0.5))" if triples else "1"
    hop = lambda n, source, extra: f"""
hop{n} AS (
  SELECT note_id, score, linked_from, label, direction, {n} AS depth, pos, tier FROM (
    SELECT e.neighbour AS note_id, f.score * {weight} * {factor} * (1 + CASE WHEN t.tier = '2' AND length(t.title) <= 5 THEN 0.1 ELSE 0 END) AS score, f.note_id AS linked_from, label, direction, f.pos, t.tier,
           row_number() OVER (PARTITION BY e.neighbour ORDER BY f.pos, {LABEL_RANK_SQL}, direction, f.note_id) AS n
    FROM {source} f JOIN near e ON e.node = f.note_id JOIN star t ON t.note_id = e.neighbour JOIN star st ON st.note_id = f.note_id
    WHERE e.neighbour NOT IN (SELECT note_id FROM seeds) {extra}
      AND NOT (label IN ('CONTAINS', 'CONTAINS_SYMBOL') AND direction = 'outgoing' AND f.score < 0.6)
      AND NOT (label = 'IMPORTS' AND NOT list_has_any({TOKENS.format("t.title")}, {words}))
  ) WHERE n = 1
)"""  # noqa: E731
    ctes = hop(1, "seeds", "")
    tail = "SELECT * FROM hop1"
    if depth > 1:
        ctes += "," + hop(2, "(SELECT note_id, score, pos FROM hop1 WHERE tier = '1')", "AND label = 'CALLS' AND e.neighbour NOT IN (SELECT note_id FROM hop1)")
        tail += " UNION ALL SELECT * FROM hop2"
    return f"WITH {STAR_EDGES_SQL}, {STAR_NOTES_SQL}, seeds(note_id, score, pos) AS ({seeds}), {ctes} SELECT note_id, round(score, 6) AS score, linked_from, label, direction, depth FROM ({tail})"


def expansion(spark: SparkSession, sf_dir: str, depth: int, similarity=None) -> DataFrame:
    seeds = spark.createDataFrame(SEEDS, "note_id string, score double, pos int")
    query = F.array(*map(F.lit, ["entrypoint", "china", "france", "japan"]))
    out = graph.expand(X.star_edges(spark, sf_dir), X.star_notes(spark, sf_dir), seeds, query, depth, similarity=similarity)
    return out.withColumn("score", rounded("score"))


@register(expand_sql(1))
def expand_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expansion(spark, sf_dir, 1)


@register(expand_sql(2))
def expand_calls_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expansion(spark, sf_dir, 2)


@register(expand_sql(2, triples=True))
def expand_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges' phrases weighed by the share of the query's words that they hold."""
    words = F.array(*map(F.lit, ["entrypoint", "china", "france", "japan"]))
    return expansion(spark, sf_dir, 2, lambda text: F.size(F.array_intersect(T.tokens(text), words)) / 4)


@register(
    """
WITH d AS (
  SELECT doc_id AS k, 'd' || doc_id || '.md' AS note_id, ['3', '2', '1', ''][doc_id % 4 + 1] AS tier, 'd' || (doc_id - 1) || '.md' AS up,
         CASE WHEN doc_id % 4 <> 0 THEN '.' WHEN doc_id % 8 = 0 THEN 'm' || doc_id ELSE 'm' || (doc_id - 4) || '/s' || doc_id END AS dir FROM documents
), owned AS (
  SELECT note_id AS a, up AS b, CASE tier WHEN '1' THEN 'DEFINED_IN' ELSE 'BELONGS_TO' END AS there, CASE tier WHEN '1' THEN 'CONTAINS_SYMBOL' ELSE 'CONTAINS' END AS back FROM d WHERE tier IN ('1', '2')
), l AS (
  SELECT s.note_id AS src, t.note_id AS dst, s.tier AS st, t.tier AS tt,
         CASE WHEN contains(s.dir, '/') THEN regexp_replace(s.dir, '/[^/]*$', '') ELSE '.' END AS s_up, CASE WHEN contains(t.dir, '/') THEN regexp_replace(t.dir, '/[^/]*$', '') ELSE '.' END AS t_up, s.dir AS sd, t.dir AS td
  FROM d s JOIN d t ON t.k IN (s.k + 4, (s.k * 3 + 4) % (SELECT count(*) FROM d), s.k - 4) WHERE s.k <> t.k
), typed AS (
  SELECT src, CASE WHEN st = '1' AND tt = '1' THEN 'CALLS' WHEN st = '2' AND tt = '2' THEN 'IMPORTS' WHEN st = '3' AND tt = '3' AND td <> '.' AND t_up = sd THEN 'CONTAINS'
    WHEN st = '3' AND tt = '3' AND sd <> '.' AND s_up = td THEN 'BELONGS_TO' ELSE 'LINKS_TO' END AS label, dst FROM l
)
SELECT a AS src, there AS label, b AS dst FROM owned UNION SELECT b, back, a FROM owned UNION SELECT * FROM typed
UNION SELECT dst, CASE label WHEN 'CONTAINS' THEN 'BELONGS_TO' ELSE 'CONTAINS' END, src FROM typed WHERE label IN ('CONTAINS', 'BELONGS_TO')"""
)
def note_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.note_edges(*X.tiered_notes(spark, sf_dir))


@register(
    f"WITH {STAR_NOTES_SQL} SELECT note_id, round(CASE WHEN d = 0 THEN 1 ELSE 0.9 - 0.04 * least(d, 5) END, 6) AS score FROM (SELECT *, len(string_split(path, '/')) - 1 AS d FROM star WHERE tier = '3')"
)
def discovery_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.star_notes(spark, sf_dir).where("tier = '3'").select("note_id", rounded(retrieval.module_score(F.col("path"))).alias("score"))


INSIDE_ALL = DEGREE_SQL.replace(", degree AS", ", inside AS (SELECT note_id FROM star), degree AS")


@register(f"WITH {INSIDE_ALL} SELECT note_id, degree, round(0.55 + least(degree, 20) / 40.0, 6)::DOUBLE AS score FROM degree JOIN star USING (note_id) WHERE tier IN ('2', '3')")
def discovery_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.star_notes(spark, sf_dir)
    hubs = graph.degrees(X.star_edges(spark, sf_dir), n).join(n.where("tier IN ('2', '3')").select("note_id"), "note_id")
    return hubs.select("note_id", "degree", rounded(retrieval.hub_score(F.col("degree"))).alias("score"))


@register(
    f"""
WITH {INSIDE_ALL}, r AS (
  SELECT s.*, coalesce(degree, 0) AS degree, len(string_split(path, '/')) - 1 AS d FROM star s LEFT JOIN degree USING (note_id)
), lists AS (
  SELECT note_id, 'entrypoint' AS kind, 1.0 AS score, row_number() OVER (ORDER BY d, path) AS pos, 4 AS most FROM r WHERE tier = '2' AND length(title) <= 5
  UNION ALL SELECT note_id, 'module', CASE WHEN d = 0 THEN 1 ELSE 0.9 - 0.04 * least(d, 5) END,
    1000 + row_number() OVER (ORDER BY CASE WHEN d = 0 THEN 1 ELSE 0.9 - 0.04 * least(d, 5) END DESC, d, path), 1008 FROM r WHERE tier = '3'
  UNION ALL SELECT note_id, 'hub', 0.55 + least(degree, 20) / 40.0, 2000 + row_number() OVER (ORDER BY least(degree, 20) DESC, path), 2004 FROM r WHERE tier IN ('2', '3') AND degree > 0
), firsts AS (
  SELECT note_id, min(pos) AS pos, arg_min(kind, pos) AS kind, arg_min(score, pos) AS score FROM lists WHERE pos <= most GROUP BY note_id
)
SELECT note_id, kind, round(score, 6)::DOUBLE AS score, row_number() OVER (ORDER BY pos)::INT AS pos FROM firsts ORDER BY pos LIMIT 8"""
)
def discovery_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.star_notes(spark, sf_dir)
    return retrieval.discovery(n, graph.degrees(X.star_edges(spark, sf_dir), n)).withColumn("score", rounded("score"))


# ---- maintenance


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    now = d.where("doc_id % 10 <> 3").select(F.col("doc_id").cast("string").alias("rel_path"), "doc_id", F.col("n_chars").alias("size"), (F.col("doc_id") % 2).alias("mtime"))
    was = d.where("doc_id % 10 <> 4").select(
        F.col("doc_id").cast("string").alias("rel_path"), (F.col("n_chars") + F.when(F.col("doc_id") % 10 == 5, 1).otherwise(0)).alias("size"), (F.col("doc_id") % 2).alias("mtime")
    )
    return now, was


@register("SELECT doc_id::VARCHAR AS rel_path, CASE doc_id % 10 WHEN 3 THEN 'deleted' WHEN 4 THEN 'new' ELSE 'changed' END AS change FROM documents WHERE doc_id % 10 IN (3, 4, 5)")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.manifest_diff(*snapshots(spark, sf_dir))


@register(
    """
SELECT doc_id AS note_id, CASE WHEN doc_id % 10 = 5 THEN md5(text || 'x') ELSE md5(text) END AS hash FROM documents WHERE doc_id % 10 <> 3"""
)
def incremental_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), "text")
    old = d.where("note_id % 10 <> 4").select("note_id", F.md5("text").alias("hash"))
    changed = F.when(F.col("note_id") % 10 == 5, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    new = d.where("note_id % 10 IN (4, 5, 6)").select("note_id", F.md5(changed).alias("hash"))
    return incremental.apply_delta(old, new, d.where("note_id % 10 = 3"))


@register("SELECT doc_id::VARCHAR AS path FROM documents WHERE doc_id % 6 = 5")
def stale_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id")
    valid = d.where("doc_id % 2 = 0").select("path").union(d.where("doc_id % 3 <> 2").select("path")).distinct()
    return incremental.stale(d.select("path"), valid)


# ---- events

keyed_pushes = lambda spark, sf_dir: (lambda p: p.withColumn("key", events.claim_key(F.col("workspace"), F.col("delivery_id"), F.col("ref"), F.col("commit"))))(X.pushes(spark, sf_dir))


@register(f"WITH {PUSHES_SQL} SELECT key, arg_min(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM keyed GROUP BY key")
def webhook_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.first_claims(keyed_pushes(spark, sf_dir)).select("key", "event_id")


DECISION_SQL = f"""
{PUSHES_SQL}, pre AS (
  SELECT *, CASE WHEN token = '' THEN 'missing_token' WHEN workspace IN ('w38', 'w39') THEN 'unknown_workspace' WHEN token <> 'secret' THEN 'bad_token'
    WHEN coalesce(nullif(ref, ''), 'refs/heads/main') <> 'refs/heads/main' THEN 'ignored_ref' ELSE 'ok' END AS pre FROM keyed
), decided AS (
  SELECT event_id, workspace, ts, CASE WHEN pre <> 'ok' THEN pre WHEN row_number() OVER (PARTITION BY key, pre = 'ok' ORDER BY ts, event_id) = 1 THEN 'accepted' ELSE 'duplicate' END AS reason FROM pre
)"""
STATUS_SQL = "CASE WHEN reason IN ('missing_token', 'bad_token') THEN 401 WHEN reason = 'unknown_workspace' THEN 404 WHEN reason = 'accepted' THEN 202 ELSE 200 END"


def workspaces(spark: SparkSession) -> DataFrame:
    """Thirty-eight git workspaces; the other two of the events are unknown."""
    return spark.range(38).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("workspace"), F.lit("secret").alias("secret"), F.lit("main").alias("branch"), F.lit(True).alias("is_git"))


@register(f"WITH {DECISION_SQL} SELECT event_id, workspace, {STATUS_SQL} AS status, reason FROM decided")
def webhook_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.decisions(keyed_pushes(spark, sf_dir), workspaces(spark))


@register(f"WITH {PUSHES_SQL} SELECT event_id FROM pushes WHERE coalesce(nullif(ref, ''), 'refs/heads/main') = 'refs/heads/main'")
def ref_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pushes(spark, sf_dir).where(events.tracked_ref(F.col("ref"), F.lit("main"))).select("event_id")


@register(
    f"""
WITH {PUSHES_SQL}, g AS (
  SELECT workspace, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM pushes WINDOW w AS (PARTITION BY workspace ORDER BY ts)
), b AS (SELECT workspace, ts, sum(fresh) OVER (PARTITION BY workspace ORDER BY ts) AS batch FROM g)
SELECT workspace, batch::INT AS batch, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY workspace, batch"""
)
def debounce_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.debounced(X.pushes(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), 3_600_000)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@register(
    """
WITH e AS (
  SELECT 'w' || user_id % 40 AS workspace, event_id AS seq, CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'moved' ELSE 'changed' END AS kind,
         'p' || event_id % 200 AS path, 'q' || event_id % 150 AS to_path FROM events
), x AS (
  SELECT workspace, seq, path, CASE WHEN kind = 'changed' THEN 'changed' ELSE 'deleted' END AS kind FROM e
  UNION ALL SELECT workspace, seq, to_path, 'changed' FROM e WHERE kind = 'moved'
)
SELECT workspace, path, arg_max(kind, seq) AS kind FROM x GROUP BY workspace, path"""
)
def pending_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("w"), (F.col("user_id") % 40).cast("string")).alias("workspace"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "moved").otherwise("changed").alias("kind"),
        F.concat(F.lit("p"), (F.col("event_id") % 200).cast("string")).alias("path"),
        F.concat(F.lit("q"), (F.col("event_id") % 150).cast("string")).alias("to_path"),
    )
    return events.pending_paths(e)


@register(f"WITH {PUSHES_SQL} SELECT workspace, least(n, 51)::INT AS batch, count(*) AS n_jobs FROM (SELECT workspace, row_number() OVER (PARTITION BY workspace ORDER BY ts, event_id) AS n FROM pushes) GROUP BY 1, 2")
def coalesced_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.coalesced(X.pushes(spark, sf_dir).select("workspace", "ts", F.col("event_id").alias("job_id")))


@register(f"WITH {PUSHES_SQL} SELECT workspace, max(event_id) FILTER (ts = m) AS job_id FROM (SELECT *, max(ts) OVER (PARTITION BY workspace) AS m FROM pushes) GROUP BY workspace")
def job_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.latest(X.pushes(spark, sf_dir).select("workspace", F.col("event_id").alias("job_id"), "ts"), "workspace", ["ts", "job_id"]).select("workspace", "job_id")


@register(f"WITH {PUSHES_SQL} SELECT event_id AS job_id, workspace, row_number() OVER (PARTITION BY workspace ORDER BY ts, event_id)::INT AS place FROM pushes")
def job_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.places(X.pushes(spark, sf_dir).select(F.col("event_id").alias("job_id"), "workspace", "ts")).drop("ts")


@register(
    f"""
WITH RECURSIVE {PUSHES_SQL}, r AS (
  SELECT event_id AS request_id, workspace, ref, ts, row_number() OVER (PARTITION BY workspace, ref ORDER BY ts, event_id) AS n FROM pushes
), after AS (  -- the first request that finds the job of a request ended
  SELECT a.workspace, a.ref, a.n, min(b.n) AS then FROM r a JOIN r b ON b.workspace = a.workspace AND b.ref = a.ref AND b.n > a.n AND b.ts >= a.ts + INTERVAL 2 HOUR GROUP BY ALL
), started AS (
  SELECT workspace, ref, n FROM r WHERE n = 1 UNION ALL SELECT a.workspace, a.ref, a.then FROM started s JOIN after a USING (workspace, ref, n)
), jobs AS (
  SELECT r.workspace, r.ref, r.n, r.request_id AS job_id, lead(r.n) OVER (PARTITION BY r.workspace, r.ref ORDER BY r.n) AS upto FROM started JOIN r USING (workspace, ref, n)
)
SELECT r.request_id, j.job_id FROM r JOIN jobs j ON j.workspace = r.workspace AND j.ref = r.ref AND r.n >= j.n AND (j.upto IS NULL OR r.n < j.upto)"""
)
def job_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.pushes(spark, sf_dir)
    requests = p.select(F.col("event_id").alias("request_id"), "workspace", F.col("ref").alias("type"), "ts", (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("done_ts"))
    return events.distinct_jobs(requests).select("request_id", "job_id")


@register(
    f"""
WITH {PUSHES_SQL}, j AS (
  SELECT event_id AS job_id, workspace, epoch_us(ts) AS asked, (event_id % 900) * 10000000 AS work FROM pushes
), s AS (
  SELECT *, sum(work) OVER w AS total FROM j WINDOW w AS (PARTITION BY workspace ORDER BY asked, job_id)
), e AS (
  SELECT job_id, workspace, work, total + max(asked - total + work) OVER (PARTITION BY workspace ORDER BY asked, job_id) AS ended FROM s
)
SELECT job_id, workspace, make_timestamp((ended - work)::BIGINT) AS started, make_timestamp(ended::BIGINT) AS ended FROM e"""
)
def job_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = X.pushes(spark, sf_dir).select(F.col("event_id").alias("job_id"), "workspace", "ts", (F.col("event_id") % 900 * 10).alias("seconds"))
    return events.schedule(jobs).select("job_id", "workspace", "started", "ended")


@register("SELECT event_id, user_id, round(value, 3) AS score FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def activity_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.ring(table(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts"), 50, ["ts", "event_id"])
    return rows.select("event_id", "user_id", F.round("value", 3).alias("score"))


@register("SELECT event_id, user_id, (event_id % 7)::INT AS score FROM events WHERE event_id % 7 BETWEEN 1 AND 5 ORDER BY ts DESC, event_id DESC LIMIT 200")
def rating_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 7).cast("int").alias("score"), "ts")
    return events.ring(rated.where(F.col("score").between(1, 5)), 200, ["ts", "event_id"]).drop("ts")


@register(
    f"""
WITH {DECISION_SQL}, last AS (SELECT workspace, arg_max(reason, struct_pack(t := ts, e := event_id)) AS last_status, count(*) FILTER (reason = 'accepted') AS n_accepted FROM decided GROUP BY workspace)
SELECT 'w' || k AS workspace, last_status, coalesce(n_accepted, 0) AS n_accepted, k % 3 = 0 AS is_current, k % 3 = 1 AS drifted
FROM (SELECT unnest(range(0, 38)) AS k) LEFT JOIN last ON last.workspace = 'w' || k"""
)
def workspace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("workspace", "([0-9]+)$", 1).cast("int") % 3
    registered = workspaces(spark).select("workspace", F.when(k < 2, "a").alias("clone_commit"), F.when(k == 0, "a").when(k == 1, "b").alias("synced_commit"))
    pushed = keyed_pushes(spark, sf_dir)
    decided = events.decisions(pushed, workspaces(spark)).join(pushed.select("event_id", "ts"), "event_id")
    return events.workspace_summary(registered, decided)


@register(
    """
SELECT coalesce(a.c_nationkey, b.c_nationkey) AS workspace, CASE WHEN b.c_nationkey IS NULL THEN 'added' ELSE 'removed' END AS change
FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9900) a FULL JOIN (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal < -900) b USING (c_nationkey)
WHERE a.c_nationkey IS NULL OR b.c_nationkey IS NULL"""
)
def registry_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    pick = lambda cond: c.where(cond).select(F.col("c_nationkey").alias("workspace")).distinct()
    return events.registry_diff(pick("c_acctbal > 9900"), pick("c_acctbal < -900"))


# ---- mirrored sources


@register(
    """
SELECT DISTINCT 'o' || a.o_custkey AS caller, 's' || l_suppkey AS callee FROM orders a JOIN lineitem ON a.o_orderkey = l_orderkey
WHERE a.o_custkey % 50 <> l_suppkey % 50"""
)
def call_graph_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    sites = o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select(
        (F.col("o_custkey") % 50).cast("string").alias("path"), F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("caller"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("name")
    )
    exports = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50).cast("string").alias("path"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"))
    return mirror.call_edges(sites, exports).select("caller", F.col("name").alias("callee")).distinct()


@register(
    """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity % 10 < 7 THEN 'f' || floor(l_quantity / 10)::INT END AS fn FROM lineitem"""
)
def interval_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array(*[F.struct(F.lit(f"f{i}").alias("name"), F.lit(10 * i).alias("begin"), F.lit(10 * i + 6).alias("end")) for i in range(6)])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", mirror.enclosing(spans, F.col("l_quantity").cast("int")).alias("fn"))


@register("SELECT 'n' || c_nationkey AS parent, count(*) AS n_children, sum(('0x' || md5(c_name || chr(10) || c_mktsegment)[1:15])::BIGINT)::VARCHAR AS child_hash FROM customer GROUP BY c_nationkey")
def children_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), F.col("c_name").alias("link"), F.col("c_mktsegment").alias("summary"))
    return summaries.child_hashes(c)


@register("SELECT doc_id AS note_id, doc_id % 4 = 0 OR doc_id % 5 = 0 OR doc_id % 9 = 0 AS stale FROM documents")
def summary_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.sha2("text", 256).alias("source_hash"), F.lit("m").alias("model"))
    n = F.col("note_id")
    stored = d.where(n % 9 != 0).select(
        "note_id", F.when(n % 4 == 0, "").otherwise("done").alias("summary"), F.when(n % 5 == 0, "old").otherwise(F.col("source_hash")).alias("source_hash"), "model"
    )
    return summaries.needs_summary(d, stored, ["source_hash", "model"])


@register(
    """
SELECT parent, link, text[1:(12000 - spent)::BIGINT] AS part FROM (
  SELECT source AS parent, doc_id AS link, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM documents
) WHERE spent < 12000"""
)
def child_context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.child_context(table(spark, sf_dir, "documents").select(F.col("source").alias("parent"), F.col("doc_id").alias("link"), "text"), 12000)


@register(
    """
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN ['located under an entrypoint-like directory', 'uses Python __main__ guard'] WHEN page_id % 4 = 1 THEN ['entrypoint-like file name: main.py', 'shebang executable script']
  WHEN page_id % 4 = 2 THEN ['configures argparse CLI handling', 'starts an application server'] ELSE [] END AS marks FROM pages"""
)
def entrypoint_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("page_id") % 4
    path = F.when(m == 0, "scripts/x.py").when(m == 1, "a/Main.py").otherwise("a/b.py")
    head = F.when(m == 0, "if __name__ == '__main__':\n").when(m == 1, "#!/bin/env python\n").when(m == 2, "p = ArgumentParser()\nuvicorn.run (x)\n").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", F.array_sort(mirror.entrypoint_marks("py", path, F.concat(head, "html"))).alias("marks"))


@register(
    """
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
d AS (SELECT page_id, string_split(path, '/') AS s FROM p)
SELECT dir, count(*) AS n_files FROM (SELECT array_to_string(s[1:i], '/') AS dir FROM (SELECT s, unnest(range(1, len(s))) AS i FROM d)) GROUP BY dir"""
)
def module_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return mirror.files_by_folder(paths).groupBy("dir").agg(F.count("*").alias("n_files"))


@register("SELECT doc_id, '---' || chr(10) || 'lang: ' || lang || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'n: ' || n_chars || chr(10) ELSE '' END || 'tags:' || chr(10) || '    - ' || lang || chr(10) || '    - ' || source || chr(10) || '---' || chr(10) AS front FROM documents")
def frontmatter_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"lang": F.col("lang"), "n": F.when(F.col("doc_id") % 2 == 0, F.col("n_chars"))}
    return table(spark, sf_dir, "documents").select("doc_id", T.build_front(fields, {"tags": F.array("lang", "source")}).alias("front"))


@register("SELECT doc_id::VARCHAR AS path, doc_id % 5 AS mtime FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 > doc_id % 4")
def stale_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id")
    sources = d.select("path", (F.col("doc_id") % 5).alias("mtime"))
    return mirror.to_mirror(sources, d.where("doc_id % 3 <> 0").select("path", (F.col("doc_id") % 4).alias("mtime")))


@register("SELECT doc_id AS note_id FROM documents WHERE doc_id % 50 <> 0 AND lang <> 'en'")
def prune_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.candidates(X.notes(spark, sf_dir), ["concept"], ["EN"]).select("note_id")


@register(
    f"""
WITH {PAIRS_SQL}, ends AS (
  SELECT a, b, sim, a AS e, b AS o FROM pairs UNION ALL SELECT a, b, sim, b, a FROM pairs
)
SELECT DISTINCT a, b, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY round(sim, 9) DESC, o) AS n FROM ends) WHERE n <= 2"""
)
def strongest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.strongest(retrieval.similar_pairs(table(spark, sf_dir, "embeddings"), 0.4), 2).select("a", "b", rounded("sim").alias("sim"))


@register("SELECT doc_id, source AS name, length(lang) BETWEEN 2 AND 64 AND regexp_matches(lang, '^[a-z0-9][a-z0-9_-]{0,62}[a-z0-9]$') AS lang_ok, length(source) BETWEEN 2 AND 64 AND regexp_matches(source, '^[a-z0-9][a-z0-9_-]{0,62}[a-z0-9]$') AS source_ok FROM documents")
def workspace_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("name"), registry.valid_name(F.col("lang")).alias("lang_ok"), registry.valid_name(F.col("source")).alias("source_ok"))


@register("SELECT tier, count(*) FILTER (o = 0) AS summarized, count(*) FILTER (o = 1) AS skipped, count(*) FILTER (o = 2) AS failed FROM (SELECT (doc_id % 3 + 1)::VARCHAR AS tier, n_chars % 3 AS o FROM documents) GROUP BY tier")
def summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.element_at(F.array(*map(F.lit, ("summarized", "skipped", "failed"))), (F.col("n_chars") % 3 + 1).cast("int"))
    return summaries.tier_totals(table(spark, sf_dir, "documents").select((F.col("doc_id") % 3 + 1).cast("string").alias("tier"), outcome.alias("outcome")))


@register("SELECT lang AS language, count(*) FILTER (doc_id % 2 = 0) AS written, count(*) FILTER (doc_id % 2 = 1) AS skipped, true AS may_clean FROM documents GROUP BY lang")
def mirror_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return mirror.mirror_totals(d.select(F.col("lang").alias("language"), F.when(F.col("doc_id") % 2 == 0, "written").otherwise("skipped").alias("outcome")))


@register(f"WITH {PUSHES_SQL}, first AS (SELECT key, arg_min(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM keyed GROUP BY key) SELECT key, event_id FROM first WHERE event_id % 3 <> 0")
def claims_released(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = events.first_claims(keyed_pushes(spark, sf_dir)).select("key", "event_id")
    return events.released(claims, claims.where("event_id % 3 = 0"))


@register(
    """
SELECT doc_id, 'code/w/src/' || source || '/doc_' || doc_id AS link, '## Summary' || chr(10) || chr(10) || '<!-- cg:summary-meta' || chr(10) || 'tier: ' || doc_id % 4 || chr(10) || 'source_hash: ' || md5(text) || chr(10) || '-->' || chr(10) || chr(10) || lang || chr(10) AS section
FROM documents WHERE doc_id % 4 > 0"""
)
def summary_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.notes(spark, sf_dir).select(F.col("note_id").alias("doc_id"), "path", "body", F.element_at("tags", 1).alias("lang"), (F.col("note_id") % 4).cast("string").alias("tier"))
    section = summaries.summary_section(F.concat(F.lit(" "), "lang", F.lit("\n")), {"tier": F.col("tier"), "source_hash": F.md5("body")})
    return summaries.summary_records(n, "w").select("doc_id", "link", section.alias("section"))


# ---- answers


@register()
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds for a text query over embedded chunks of all notes (no SQL: the provider hashes words; the tests have a plain form)."""
    n = X.notes(spark, sf_dir).withColumn("note_id", F.col("note_id").cast("string"))
    return embedding.hybrid_seeds(n, embedding.chunk_table(n), "the thing and of it en").withColumn("score", rounded("score"))


@register(
    f"""
WITH {NOTES_SQL}, top AS (
  SELECT vec_id AS note_id, {COSINE.format("embedding", "(SELECT embedding FROM embeddings WHERE vec_id = 0)")} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 8
), s AS (
  SELECT CASE note_type WHEN 'concept' THEN 1 ELSE 2 END AS section, score, path, '### ' || path || ' (* | score: ' || printf('%.3f', score) || ')' || chr(10) || coalesce(body, '') || chr(10) AS line FROM top JOIN notes USING (note_id)
), g AS (
  SELECT section, CASE section WHEN 1 THEN '## Concepts & Patterns' || chr(10) || '_Heuristics and practices._' || chr(10) ELSE '## Additional Context' || chr(10) END || chr(10) || string_agg(line, chr(10) ORDER BY score DESC, path) AS body
  FROM s GROUP BY section
)
SELECT CASE WHEN count(*) = 0 THEN '<!-- nothing found -->' ELSE '# Knowledge Base Context' || chr(10) || chr(10) || string_agg(body, chr(10) ORDER BY section) END AS markdown FROM g"""
)
def context_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered answer for the notes nearest to vector 0."""
    top = retrieval.vector_topk(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 8).select(F.col("vec_id").alias("note_id"), "score")
    n = X.notes(spark, sf_dir).join(top, "note_id").select("note_id", "path", "note_type", F.lit("").alias("tier"), "score", F.lit(0).alias("depth"), F.col("body").alias("content"))
    return render.context(n)


TARGETED_BASE = f"""
{X.VECTOR_NOTES_SQL}, hits AS (
  SELECT 'v:' || vec_id AS note_id, {COSINE.format("embedding", "(SELECT embedding FROM embeddings WHERE vec_id = 1)")} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 8
), boosted AS (
  SELECT note_id, s * (1 + least(0.1 * len(list_filter(tags, lambda t: t IN ('l0', 'l3'))), 0.3)) AS score FROM hits JOIN vnotes USING (note_id) WHERE note_type <> 'index'
), seeds AS (
  SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, note_id)::INT AS pos FROM boosted
)"""


@register(
    path_sql(
        'SELECT (10 * a.pos + b.pos)::INT AS pair_id, a.note_id AS "start", b.note_id AS "end" FROM seeds a JOIN seeds b ON a.pos < b.pos WHERE b.pos <= 3',
        "",
        """, long AS (SELECT pair_id, max(pos) AS l FROM steps GROUP BY pair_id), met AS (
  SELECT node, s.pair_id, s.pos, greatest(0.5, 1 - least(s.pos, l - s.pos) / greatest(l, 1) * 0.5) AS score, row_number() OVER (PARTITION BY node ORDER BY s.pair_id, s.pos) AS n FROM steps s JOIN long USING (pair_id)
)
SELECT note_id, 'seed' AS role, round(score, 6) AS score, 0 AS depth, NULL::VARCHAR AS linked_from, pos FROM seeds
UNION ALL SELECT node, 'path', round(score, 6), 1, e."start", row_number() OVER (ORDER BY m.pair_id, m.pos)::INT FROM met m JOIN ends e USING (pair_id) WHERE n = 1 AND node NOT IN (SELECT note_id FROM seeds)""",
        TARGETED_BASE,
    )
)
def retrieve_targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds nearest to vector 1 with their tags' boost, and the notes on shortest paths between the first three."""
    notes, edges = X.vector_notes(spark, sf_dir)
    chunks = table(spark, sf_dir, "embeddings")
    query = chunks.where("vec_id = 1").select("embedding").first()[0]
    hits = retrieval.vector_topk(chunks, query, 8).select(F.concat(F.lit("v:"), F.col("vec_id").cast("string")).alias("note_id"), "score")
    rows, _ = targeted.targeted(notes, edges, hits, "l0 l3", 8)
    return rows.drop("via").withColumn("score", rounded("score"))


@register(
    f"""
WITH mix AS ({ORACLE_SQL["discovery_mix"]}), {INSIDE_ALL.strip()}, lines AS (
  SELECT kind, m.pos, '- [[' || m.note_id || ']] `' || s.path || '`' || CASE kind WHEN 'hub' THEN ' degree=' || coalesce(degree, 0) ELSE '' END AS line
  FROM mix m JOIN star s USING (note_id) LEFT JOIN degree USING (note_id)
), kinds AS (
  SELECT list_position(['entrypoint', 'module', 'hub'], kind) AS n, string_agg(line, chr(10) ORDER BY pos) AS body FROM lines GROUP BY kind
)
SELECT '## Discovery Mode' || chr(10) || 'Query: "where do I start"' || chr(10) || chr(10)
  || string_agg(['## Likely Entrypoints', '## Module Map', '## High-Connectivity Notes'][n] || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY n) AS markdown FROM kinds"""
)
def retrieve_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.star_notes(spark, sf_dir)
    degree = graph.degrees(X.star_edges(spark, sf_dir), n)
    return render.discovery(retrieval.discovery(n, degree).join(n.select("note_id", "path"), "note_id").join(degree, "note_id", "left"), "where do I start")


@register(
    """
WITH p AS (SELECT 'pkg/mod' || page_id || '.py' AS path, 'f' || page_id AS f FROM pages)
SELECT path, unnest(['import', 'def', 'class', 'method', 'call', 'call', 'call', 'call', 'call', 'call']) AS role, unnest(['helper', f, '_K', 'm', f, 'h', 'f0', '_K', 'm', f]) AS name,
       unnest(['.util', 'def ' || f || '(a, b):', 'class _K(Base):', 'def m(self):', '', '', '', '', '', '']) AS detail,
       unnest([true, true, true, false, false, false, false, false, false, false]) AS exported
FROM p"""
)
def source_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions, imports and calls at the head of sources; a small module stands before each page's whole html."""
    p = table(spark, sf_dir, "pages")
    name = F.concat(F.lit("f"), F.col("page_id").cast("string"))
    head = F.concat(F.lit("from .util import helper as h\n\n\ndef "), name, F.lit("(a, b):\n    return h(a) + f0(b)\n\n\nclass _K(Base):\n    def m(self):\n        return "), name, F.lit("(1, 2)\n\n\n"))
    files = p.select(F.concat(F.lit("pkg/mod"), F.col("page_id").cast("string"), F.lit(".py")).alias("path"), F.concat(head, "html").alias("source"), F.length(head).alias("head"))
    found = mirror.symbols(files.select("path", "source"), "py").join(files.select("path", "head"), "path")
    return found.where("begin < head").select("path", "role", "name", "detail", "exported")


@register(
    """
WITH p AS (SELECT page_id, 'f' || page_id AS f, 'K' || page_id AS k FROM pages)
SELECT page_id, unnest(['import', 'def', 'call', 'class', 'method', 'call', 'reexport']) AS role, unnest(['helper', f, 'h', k, 'm', f, 'g' || page_id]) AS name,
       unnest(['./util.js', f || '(a: string, b): Promise<void>', '', 'export class ' || k || '<T> extends Base', k || '.m(x: number): T', '', './util']) AS detail,
       unnest([true, true, false, true, false, false, true]) AS exported, unnest([NULL, NULL, f, NULL, k, 'm', NULL]) AS owner, unnest([NULL, NULL, f, NULL, NULL, NULL, NULL]) AS caller
FROM p"""
)
def typescript_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions and calls between a template and a comment that hold each page's whole html."""
    html, number = F.coalesce("html", F.lit("")), F.col("page_id").cast("string")
    source = F.concat(
        F.lit("import { helper as h } from './util.js';\nconst page = `"), F.translate(html, "\\`$", "   "),
        F.lit("`;\nexport async function f"), number, F.lit("(a: string, b = '}'): Promise<void> {\n  return h(a);\n}\n/* "), F.replace(html, F.lit("*/"), F.lit("* /")),
        F.lit(" */\nexport class K"), number, F.lit("<T> extends Base {\n  private m(x: number): T { return f"), number, F.lit("(x); }\n}\nexport { h as g"), number, F.lit(" } from './util';\n"),
    )
    files = table(spark, sf_dir, "pages").select(F.concat(number, F.lit(".ts")).alias("path"), source.alias("source"))
    found = mirror.symbols(files, "ts").where("role <> 'const'")
    return found.select(F.regexp_replace("path", r"\.ts$", "").cast("long").alias("page_id"), "role", "name", "detail", "exported", "owner", "caller")


@register(
    """
SELECT page_id, unnest(['import', 'def', 'def']) AS role, unnest(['own.h', 'hid', 'f' || page_id]) AS name, unnest(['own.h', 'static int hid(char c)', 'const char *f' || page_id || '(int a, char **b)']) AS detail,
       unnest([true, false, true]) AS exported
FROM pages"""
)
def c_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions between a comment and a string that hold each page's whole html."""
    html, number = F.coalesce("html", F.lit("")), F.col("page_id").cast("string")
    source = F.concat(
        F.lit('#include "own.h"\n/* '), F.replace(html, F.lit("*/"), F.lit("* /")), F.lit(" */\nstatic int hid(char c) {\n  return c == '{';\n}\nconst char *f"), number,
        F.lit('(int a,\n    char **b) {\n  const char *s = "'), F.translate(html, '\\"\n\r', "    "), F.lit('";\n  return hid(*s) ? s : 0;\n}\n'),
    )
    files = table(spark, sf_dir, "pages").select(F.concat(number, F.lit(".c")).alias("path"), source.alias("source"))
    return mirror.symbols(files, "c").where("role <> 'call'").select(F.regexp_replace("path", r"\.c$", "").cast("long").alias("page_id"), "role", "name", "detail", "exported")


@register(
    """
WITH w AS (
  SELECT DISTINCT 'py' AS language, 'd' || page_id % 7 || '/m' || page_id % 500 AS base FROM pages WHERE page_id % 3 <> 0
  UNION SELECT DISTINCT 'ts', 'd' || page_id % 7 || '/m' || page_id % 500 FROM pages WHERE page_id % 2 = 0
), o AS (
  SELECT base, CASE WHEN substr(base, 2, 1) = '1' THEN 'c' WHEN substr(base, 2, 1) = '5' AND list_contains(list(language), 'ts') THEN 'ts' ELSE min(language) END AS owner FROM w GROUP BY base
)
SELECT language, base || '.' || language AS path, base || CASE WHEN owner = language THEN '' ELSE '_' || language END AS note FROM w JOIN o USING (base)"""
)
def note_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of notes that Python and TypeScript files both want; some are there already, of C or TypeScript."""
    base = F.concat(F.lit("d"), (F.col("page_id") % 7).cast("string"), F.lit("/m"), (F.col("page_id") % 500).cast("string"))
    p = table(spark, sf_dir, "pages").withColumn("base", base)
    wanted = {}
    for language, rows in (("py", p.where("page_id % 3 <> 0")), ("ts", p.where("page_id % 2 = 0"))):
        wanted[language] = mirror.note_names(rows.select(F.concat("base", F.lit(f".{language}")).alias("path")).distinct(), language)
    digit = F.substring("base", 2, 1)
    stored = p.select(F.col("base").alias("note"), F.when(digit == "1", "c").when(digit == "5", "ts").alias("language")).where("language IS NOT NULL").distinct()
    out = None
    for language, named in mirror.owned_names(wanted, stored).items():
        rows = named.select(F.lit(language).alias("language"), "path", "note")
        out = rows if out is None else out.union(rows)
    return out


@register(
    """
WITH f AS (SELECT doc_id, 'p' || doc_id % 40 || '/f' || doc_id || '.py' AS path, 'p' || doc_id % 40 AS dir, 'T' || doc_id % 300 AS exported, 'T' || doc_id * 7 % 330 AS name, 'p' || (doc_id + 7) % 40 || '/f' || doc_id + 7 || '.py' AS near FROM documents),
ranked AS (
  SELECT w.path, w.name, o.path AS def_path,
         row_number() OVER (PARTITION BY w.path, w.name ORDER BY CASE WHEN o.path = w.near THEN 0 WHEN o.dir = w.dir THEN 1 ELSE 2 END, o.path) AS n
  FROM f w JOIN f o ON o.exported = w.name
)
SELECT f.path, f.name, r.def_path FROM f LEFT JOIN ranked r ON r.path = f.path AND r.name = f.name AND r.n = 1"""
)
def type_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that defines a type which another one names: an imported one first, then one of the same folder."""
    place = lambda n: F.concat(F.lit("p"), (n % 40).cast("string"), F.lit("/f"), n.cast("string"), F.lit(".py"))
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    symbols = d.select(place(n).alias("path"), F.lit("class").alias("role"), F.concat(F.lit("T"), (n % 300).cast("string")).alias("name"), F.lit(True).alias("exported"))
    wanted = d.select(place(n).alias("path"), F.concat(F.lit("T"), (n * 7 % 330).cast("string")).alias("name"))
    return mirror.first_owner(wanted, symbols, d.select(place(n).alias("src"), place(n + 7).alias("dst")), ["class"])


@register(
    """
SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN 'Tool' END AS kind, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 4)::VARCHAR END AS tier,
       CASE WHEN doc_id % 5 <> 0 THEN 'a/b' || doc_id || '.md' END AS parent, CASE WHEN doc_id % 5 <> 0 THEN 'X ' || lang END AS first_tag, CASE WHEN doc_id % 5 <> 0 THEN 'two' END AS second_tag
FROM documents"""
)
def frontmatter_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys of the frontmatter as one VARIANT, and some of them taken out of it."""
    front, _ = T.split_front(F.col("text"))
    d = fronted(spark, sf_dir).select("doc_id", T.front_variant(front).alias("v"))
    paths = {"kind": "$.type", "tier": "$.tier", "parent": "$.parentFile", "first_tag": "$.tags[0]", "second_tag": "$.tags[1]"}
    return d.select("doc_id", *[F.variant_get("v", p, "string").alias(c) for c, p in paths.items()])


@register(
    """
WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(source || '-' || doc_id)) AS h FROM documents)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][CAST('0x' || h[17] AS INT) % 4 + 1] || h[18:20] || '-' || h[21:32] AS workspace FROM h"""
)
def workspace_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids derived from names."""
    return table(spark, sf_dir, "documents").select("doc_id", files.name_uuid(F.concat_ws("-", "source", F.col("doc_id").cast("string"))).alias("workspace"))
