"""Work that must not grow faster than its input: what is sent out, joined or held at a time."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillgraph.operators import graph, links, mirror, retrieval


def test_links_are_never_sent_out(spark):
    notes = spark.createDataFrame([("w", f"a/n{i}.md", "concept") for i in range(9)], "workspace string, note_id string, note_type string")
    asked = spark.createDataFrame([("w", "n3"), ("w", "a/n4"), ("w", "none")], "workspace string, target string")
    found = links.resolve_links(asked, notes)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.target, r.note_id, r.how) for r in found.collect()} == {("n3", "a/n3.md", "suffix"), ("a/n4", "a/n4.md", "md"), ("none", None, None)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()  # nor where a stage turns out small


def rows_made(df) -> int:
    """The most rows that an operator of the plan that ran gave out."""
    seen, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if node.metrics().contains("numOutputRows"):
            seen.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return max(seen)


def test_owners_of_a_name_that_many_files_export_and_many_speak_of(spark):
    """400 files export T and 400 speak of it: no row for each pair of them."""
    n, place = F.col("id"), lambda c: F.concat(F.lit("p"), (c % 4).cast("string"), F.lit("/f"), c.cast("string"))
    ids = spark.range(400)
    table = ids.select(place(n).alias("path"), F.lit("class").alias("role"), F.lit("T").alias("name"), F.lit(True).alias("exported"))
    wanted = ids.select(place(n + 402).alias("path"), F.lit("T").alias("name"), n.alias("o")).union(spark.createDataFrame([("q/x", "T", 1), ("p1/y", "none", 2)], "path string, name string, o long"))
    edges = ids.where("id % 2 = 0").select(place(n + 402).alias("src"), place(n).alias("dst"))
    df = mirror.first_owner(wanted, table, edges, ["class"])
    assert df.columns == ["path", "name", "o", "def_path"]
    got = {(r.path, r.o): r.def_path for r in df.collect()}
    assert rows_made(df) <= 1000
    first = {m: min(f"p{m}/f{i}" for i in range(m, 400, 4)) for m in range(4)}
    want = {(f"p{(i + 402) % 4}/f{i + 402}", i): f"p{i % 4}/f{i}" if i % 2 == 0 else first[(i + 402) % 4] for i in range(400)}
    assert got == want | {("q/x", 1): "p0/f0", ("p1/y", 2): None}


def test_nearest_rows_hold_a_tile_of_scores_at_a_time():
    """3000 queries and 6000 rows make 144 MB of scores; ties go to the smaller id, over tiles too."""
    rng = np.random.default_rng(1)
    q, rows = retrieval.unit(rng.standard_normal((3000, 4))), rng.standard_normal((6000, 4))
    rows[4000:4100] = rows[:100]
    found, vec = retrieval.NearestRows(q, 3), np.arange(6000)[::-1].copy()
    tracemalloc.start()
    found.take_in(vec, lambda i, j: rows[i:j].tolist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    ids, got, score = map(np.concatenate, zip(*found.rows(np.arange(3000)), strict=True))
    assert np.array_equal(ids, np.repeat(np.arange(3000), 3)) and len(score) == 9000
    for i in (*range(0, 3000, 97), 2047, 2048, 2999):
        own = q[i] @ retrieval.unit(rows).T
        assert got[3 * i : 3 * i + 3].tolist() == vec[np.lexsort((vec, -own.round(9)))[:3]].tolist()


def test_sources_are_taken_apart_a_few_megabytes_at_a_time(spark):
    sizes = [1, 3 << 20, 2 << 20, 0, 9 << 20, 5, 5]
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(7)], "source": ["x" * n for n in sizes]})
    slices = [s.column("path").to_pylist() for s in mirror.source_slices(batch)]
    assert sum(slices, []) == [str(i) for i in range(7)] and max(len(s) for s in slices) < 7
    assert all(sum(sizes[int(p)] for p in s[:-1]) <= mirror.SLICE_BYTES for s in slices)
    assert [s.num_rows for s in mirror.source_slices(batch.slice(0, 0))] == [0]
    files = spark.createDataFrame([(f"m{i}.py", f"def f{i}(a):\n    return g(a)\n" + "# é\n" * 200_000) for i in range(12)] + [("none.py", None)], "path string, source string").coalesce(1)
    got = {(r.path, r.role, r.name, r.traits.get("signature")) for r in mirror.symbols(files, "py").collect()}
    assert got == {x for i in range(12) for x in ((f"m{i}.py", "def", f"f{i}", f"f{i}(a)"), (f"m{i}.py", "call", "g", None), (f"m{i}.py", "call", f"f{i}", None))}


def test_levels_of_a_walk_hold_nodes_only(spark, monkeypatch):
    """No parents are sorted for every edge of a hop: they are looked up for the nodes of the path."""
    kept, whole = {}, graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, path: kept.setdefault(path.rpartition("/")[2], whole(df, path)))
    edges = spark.createDataFrame([("a", "CALLS", "b"), ("b", "CALLS", "c"), ("a", "IMPORTS", "b"), ("d", "LINKS_TO", "c")], "src string, label string, dst string")
    steps = graph.shortest_paths(edges, spark.createDataFrame([(1, "a", "d"), (2, "d", "a"), (3, "a", "x")], "pair_id int, start string, end string"))
    got = {(r.pair_id, r.pos): (r.node_id, r.edge_label, r.edge_direction, r.from_node_id) for r in steps.collect()}
    assert got == {
        (1, 0): ("a", None, "", None), (1, 1): ("b", "CALLS", "outgoing", "a"), (1, 2): ("c", "CALLS", "outgoing", "b"), (1, 3): ("d", "LINKS_TO", "incoming", "c"),
        (2, 0): ("d", None, "", None), (2, 1): ("c", "LINKS_TO", "outgoing", "d"), (2, 2): ("b", "CALLS", "incoming", "c"), (2, 3): ("a", "CALLS", "incoming", "b"),
    }
    assert all(df.columns == ["pair_id", "node_id", "pos", "is_end"] for name, (df, _) in kept.items() if name.startswith("level"))
