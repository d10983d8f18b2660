"""A workspace of notes: build, update, retrieve, find paths, rate."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.routing import query_mode
from quillgraph.functions.vectors import cosine
from quillgraph.operators import embedding, graph, incremental, links, render, retrieval
from quillgraph.operators.graph import cut
from quillgraph.operators.keyword_index import KeywordIndex
from quillgraph.operators.notes import parse_notes
from quillgraph.operators.targeted import targeted
from quillgraph.operators.vector_index import VectorIndex
from quillgraph.sources import files

#: What a stored session holds, and the version of its columns' meaning.
TABLES = ("notes", "chunks", "edges", "manifest")
FORMAT = 2
POINTER = "workspace string, provider string, format int, rows map<string,long>, columns map<string,string>"


class KnowledgeSession:
    """Tables ``notes``, ``chunks`` and ``edges`` of one workspace and the questions asked of them.  Answers are bounded top-k rows."""

    def __init__(self, spark: SparkSession, root: str, workspace: str = "", link_prefix: str = "", provider: str = "hash"):
        self.spark, self.root, self.workspace, self.link_prefix, self.provider = spark, root, workspace, link_prefix, provider
        self.notes: DataFrame | None = None
        self.chunks: DataFrame | None = None
        self.edges: DataFrame | None = None
        self.manifest: DataFrame | None = None
        self.ratings: list[dict] = []
        #: Why stored tables weren't used, the newest last.
        self.notices: list[str] = []
        self.vectors: VectorIndex | None = None
        self.words: KeywordIndex | None = None

    def scan(self, paths: DataFrame | None = None) -> DataFrame:
        """Parsed notes of all files, or of some (rel_path)."""
        return parse_notes(files.read_markdown(self.spark, self.root, self.workspace, paths))

    def build(self) -> KnowledgeSession:
        """Read everything anew."""
        self.manifest = cut(files.snapshot(self.spark, self.root), self.spark)
        self.notes = cut(self.scan(), self.spark)
        self.chunks = cut(embedding.chunk_table(self.notes, self.provider), self.spark)
        self.edges = cut(self.derive_edges(), self.spark)
        return self

    def index(self, path: str) -> None:
        """Store a vector and a keyword index below ``path``, a fresh folder.  Questions read them from then on, and updates keep them."""
        self.vectors = VectorIndex.build(self.chunks.select(F.col("chunk_id").alias("vec_id"), "embedding"), f"{path.rstrip('/')}/vectors")
        self.words = KeywordIndex(self.spark, f"{path.rstrip('/')}/words")
        self.words.add(self.notes)

    def save(self, path: str) -> str:
        """Store notes, chunk vectors, edges and manifest below ``path`` as a new version; its place.

        The version counts once its pointer is written, which says what the tables must hold.  Versions are never written over.
        """
        version, rows, columns = files.next_version(self.spark, path), {}, {}
        for name in TABLES:
            df, seen = getattr(self, name), Observation()
            df.observe(seen, F.count("*").alias("n")).write.parquet(f"{version}/{name}")
            rows[name], columns[name] = seen.get["n"], ",".join(df.columns)
        self.spark.createDataFrame([(self.workspace, self.provider, FORMAT, rows, columns)], POINTER).coalesce(1).write.parquet(f"{version}/complete")
        return version

    def stored(self, version: str) -> dict[str, DataFrame] | str:
        """The tables of a version, or what is wrong with it: foreign, of another format, damaged or incomplete."""
        try:
            state = self.spark.read.schema(POINTER).parquet(f"{version}/complete").first()
            if state is None or state.format != FORMAT:
                return "another format"
            if (state.workspace, state.provider) != (self.workspace, self.provider):
                return f"of workspace {state.workspace!r} and provider {state.provider!r}"
            tables = {name: self.spark.read.parquet(f"{version}/{name}") for name in TABLES}
            for name, df in tables.items():
                if ",".join(df.columns) != state.columns[name]:
                    return f"{name} has other columns"
                if (n := df.count()) != state.rows[name]:
                    return f"{name} has {n} of {state.rows[name]} rows"
        except (PySparkException, Py4JJavaError) as error:  # a file that is missing, cut off or something else
            return f"can't be read: {str(error).splitlines()[0]}"
        return tables

    def open(self, path: str) -> dict[str, int]:
        """Start from the newest stored version and take in what has changed since; from nothing where there is none.

        Counts of notes added, updated and removed.  A version that is damaged, of another format, or of another provider
        or workspace isn't used: ``notices`` says so and everything is built anew.
        """
        found = files.versions(self.spark, path)
        tables = self.stored(found[-1]) if found else None
        if not isinstance(tables, dict):
            if tables is not None:
                self.notices.append(f"{found[-1]}: {tables}")
            self.build()
            return {"added": self.notes.count()}
        for name, df in tables.items():
            setattr(self, name, df)
        return self.update()

    def reindex(self, force: bool = False) -> dict[str, int]:
        """Take in what has changed; with ``force`` read, embed and link everything anew.  Counts of notes added, updated and removed."""
        if not force:
            return self.update()
        before = self.notes
        self.build()
        if before is None:
            return {"added": self.notes.count()}
        gone = before.join(self.notes.select("note_id"), "note_id", "left_anti").select("note_id")
        return {r.change: r.n for r in incremental.delta_counts(before, self.notes, gone).collect()}

    def derive_edges(self) -> DataFrame:
        parents = self.notes
        for c in ("parent_file", "parent_module"):
            asked = parents.where(F.col(c).isNotNull()).select("workspace", F.col(c).alias("target")).distinct()
            found = links.resolve_links(asked, self.notes, self.link_prefix).select(F.col("target").alias(c), F.col("note_id").alias(f"_{c}"))
            parents = parents.join(found, c, "left").drop(c).withColumnRenamed(f"_{c}", c)
        out = self.notes.select("workspace", F.col("note_id").alias("src"), F.explode("links_out").alias("target"))
        out = links.resolve_links(out, self.notes, self.link_prefix).where("note_id IS NOT NULL").select("src", F.col("note_id").alias("dst"))
        return graph.note_edges(parents, out)

    def changes(self) -> DataFrame:
        """What the files differ in from the last build or update."""
        return incremental.manifest_diff(files.snapshot(self.spark, self.root), self.manifest)

    def update(self) -> dict[str, int]:
        """Take in changed files only; counts of notes added, updated and removed."""
        now = cut(files.snapshot(self.spark, self.root), self.spark)
        delta = cut(incremental.manifest_diff(now, self.manifest), self.spark)
        fresh = cut(self.scan(delta.where("change <> 'deleted'").select("rel_path")), self.spark).select(*self.notes.columns)
        gone = delta.where("change = 'deleted'").select(F.col("rel_path").alias("note_id"))
        counts = {r.change: r.n for r in incremental.delta_counts(self.notes, fresh, gone).collect()}
        self.manifest = now
        failed = self.chunks.where("embedding IS NULL").select("note_id").distinct()
        if counts or failed.limit(1).count():
            before = self.notes
            self.notes = cut(incremental.apply_delta(before, fresh, gone), self.spark)
            # vectors of notes that went or changed, or weren't to be had, are made anew, the others stay
            same = self.notes.select("note_id", "hash").join(before.select("note_id", "hash"), ["note_id", "hash"], "left_semi").select("note_id")
            same = same.join(failed, "note_id", "left_anti")
            kept = self.chunks.join(same, "note_id", "left_semi").select(*self.chunks.columns)
            moved = cut(self.notes.join(same, "note_id", "left_anti"), self.spark)
            more = cut(embedding.chunk_table(moved, self.provider), self.spark)
            old, self.chunks = self.chunks, cut(kept.unionByName(more), self.spark)
            if self.words is not None:
                self.words.add(moved, before.join(same, "note_id", "left_anti").select("note_id"))
                self.vectors.add(more.select(F.col("chunk_id").alias("vec_id"), "embedding"), old.join(same, "note_id", "left_anti").select(F.col("chunk_id").alias("vec_id")))
            self.edges = cut(self.derive_edges(), self.spark)
        return counts

    def retrieve(self, query: str, k: int = 8, mode: str | None = None, depth: int = 0, max_chars: int = 15_000) -> dict:
        """``mode``, ``notes`` (rows of the answer, by role and place), ``traces`` (path steps) and the answer as ``markdown``.

        Orientation questions, by ``mode`` or by their words, get the map of ``discover``.  Others are targeted: seeds by
        vectors, or keywords where there are none (or the provider fails), the paths between the first three, and with ``depth`` their
        neighbours, scored by how near their edges' phrases are to the query.
        """
        mode = mode or self.spark.range(1).select(query_mode(F.lit(query)).alias("m")).first().m
        if mode == "discover":
            return {"mode": mode, "notes": [], "traces": [], "markdown": self.discover(query, k)}
        asked, failed = embedding.vectors_or_errors(embedding.PROVIDERS[self.provider], [query])[0]
        if failed:
            self.notices.append(f"query not embedded: {failed}")
        vector = F.array(*[F.lit(x) for x in asked]) if asked else F.lit(None).cast("array<double>")
        hits = None
        if asked and self.vectors is not None:
            hits = self.vectors.topk(asked, k).select(F.regexp_replace("vec_id", r"#chunk\d+$", "").alias("note_id"), F.col("vec_id").alias("chunk_id"), "score")
        elif asked:
            hits = embedding.nearest_chunks(self.chunks, vector, k)
        notes = self.notes.withColumn("name_tokens", T.tokens(F.concat_ws(" ", T.strip(F.col("title")), T.stem(F.col("path")))))
        rows, steps = targeted(notes, self.edges, hits, query, k, depth, lambda text: cosine(embedding.embed(text, self.provider), vector), keywords=self.words.topk if self.words else None)
        rows = cut(rows, self.spark)
        shown = rows.join(self.notes.select("note_id", "path", "title", "note_type", "tier", F.col("body").alias("content")), "note_id")
        markdown = render.context(shown, steps).select(render.within_budget(F.col("markdown"), max_chars).alias("m")).first().m
        order = F.array_position(F.array(*map(F.lit, ("seed", "path", "neighbour"))), F.col("role"))
        return {
            "mode": mode,
            "notes": [r.asDict() for r in shown.drop("content").orderBy(order, "pos").collect()],
            "traces": [r.asDict() for r in steps.orderBy("pair_id", "pos").collect()],
            "markdown": markdown,
        }

    def discover(self, query: str = "", k: int = 8) -> str:
        degree = graph.degrees(self.edges, self.notes)
        rows = retrieval.discovery(self.notes, degree, k).join(self.notes.select("note_id", "path", F.col("body").alias("content")), "note_id").join(degree, "note_id", "left")
        return render.discovery(rows, query).first().markdown

    def find_path(self, start: str, end: str, labels: list[str] | None = None, max_depth: int | None = None) -> list[dict]:
        """Steps of a shortest path between two notes, given by id or part of the title, with their scores; empty if there is none."""
        return self.path(start, end, labels, max_depth)["steps"]

    def path(self, start: str, end: str, labels: list[str] | None = None, max_depth: int | None = None) -> dict:
        """``steps`` of a shortest path between two notes, its ``length`` (null if there is none), both ends' ids and how they were resolved (``exact``, ``substring`` or null)."""
        found = {r.query: r for r in retrieval.resolve_endpoints(self.notes, [start, end]).collect()}
        out = {"steps": [], "length": None}
        for name, query in (("start", start), ("end", end)):
            out |= {f"{name}_id": found[query].note_id, f"{name}_resolved_by": found[query].resolved_by} if query in found else {f"{name}_id": None, f"{name}_resolved_by": None}
        if start not in found or end not in found:
            return out
        pairs = self.spark.createDataFrame([(1, out["start_id"], out["end_id"])], "pair_id int, start string, end string")
        steps = graph.shortest_paths(self.edges, pairs, labels, 8 if max_depth is None else max_depth)
        steps = steps.join(graph.path_notes(steps).select(F.col("note_id").alias("node_id"), "score"), "node_id")
        rows = [r.asDict() for r in steps.orderBy("pos").collect()]  # max_depth and one at most
        return out | {"steps": rows, "length": len(rows) - 1 if rows else None}

    def note(self, note_id: str) -> str | None:
        row = self.notes.where(F.col("note_id") == note_id).select("body").first()
        return row.body if row else None

    def stats(self) -> dict[str, int]:
        return {"n_notes": self.notes.count(), "n_edges": self.edges.count()}

    def rate(self, retrieval_id: str, score: int) -> dict[str, str]:
        """Keep a rating of 1 to 5; the last 200 stay."""
        if not isinstance(score, int) or not 1 <= score <= 5:
            return {"status": "error", "reason": "a rating is 1 to 5"}
        self.ratings = [{"retrieval_id": retrieval_id, "score": score}, *self.ratings][:200]
        return {"status": "ok"}
