"""Operators on small hand-made inputs."""

from __future__ import annotations

import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.routing import query_mode
from quillgraph.functions.vectors import cosine
from quillgraph.operators import events, graph, incremental, links, mirror, render, retrieval, summaries
from quillgraph.operators.clusters import near_duplicate_clusters
from quillgraph.operators.notes import parse_notes
from quillgraph.session import KnowledgeSession
from quillgraph.sources import files


def column(spark, _expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(_expr.alias("r")).first().r


NOTES = {
    "tools/ripgrep.md": "---\ntitle: Rip Grep\ntags:\n  - Search Tool\n  - cli\n---\nFinds text. See [[concepts/search|that]] and [[Missing]].\n",
    "concepts/search.md": "# Searching\nUses [[ripgrep]] and [[ concepts/search ]].\n",
    "index.md": "all notes\n",
    "code/mod.md": "---\ntype: codeModule\ntier: 3\n---\nroot\n",
    "code/a.md": "---\ntype: CodeUnit\ntier: 2\nparentModule: code/mod\n---\nimports [[b]]\n",
    "code/b.md": "---\ntype: codeUnit\ntier: 2\nparentModule: code/mod.md\n---\nnone\n",
    "code/a/f.md": "---\ntype: codeSymbol\ntier: 1\nparentFile: code/a\ntags: entrypoint, x\n---\ncalls [[g]]\n",
    "code/b/g.md": "---\ntype: codeSymbol\ntier: 1\nparentFile: code/b.md\n---\nnothing\n",
    "open.md": "---\ntitle: never closed\nbody\n",
    "node_modules/skip.md": "no\n",
}


@pytest.fixture()
def root(tmp_path):
    for name, text in NOTES.items():
        p = tmp_path / "notes" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(tmp_path / "notes")


def test_parse_notes(spark, root):
    rows = {r.note_id: r for r in parse_notes(files.read_markdown(spark, root, "w")).collect()}
    assert set(rows) == set(NOTES) - {"node_modules/skip.md"}
    assert rows["tools/ripgrep.md"].title == "Rip Grep" and rows["tools/ripgrep.md"].note_type == "tool"
    assert rows["tools/ripgrep.md"].tags == ["search_tool", "cli"] and rows["code/a/f.md"].tags == ["entrypoint", "x"]
    assert rows["tools/ripgrep.md"].links_out == ["concepts/search", "Missing"]
    assert rows["concepts/search.md"].title == "Searching" and rows["index.md"].note_type == "index"
    assert rows["code/a.md"].note_type == "codeUnit" and rows["code/a.md"].tier == "2" and rows["open.md"].body.startswith("---")


def test_session_end_to_end(spark, root):
    s = KnowledgeSession(spark, root, workspace="w").build()
    edges = {(r.src, r.label, r.dst) for r in s.edges.collect()}
    assert ("code/a/f.md", "CALLS", "code/b/g.md") in edges and ("code/a.md", "IMPORTS", "code/b.md") in edges
    assert ("code/a/f.md", "DEFINED_IN", "code/a.md") in edges and ("code/mod.md", "CONTAINS", "code/a.md") in edges
    assert ("tools/ripgrep.md", "LINKS_TO", "concepts/search.md") in edges and not any(a == b for a, _, b in edges)
    found = s.find_path("code/a/f.md", "code/b.md")
    assert [x["node_id"] for x in found] == ["code/a/f.md", "code/a.md", "code/b.md"]
    assert s.find_path("code/a/f.md", "open.md") == []
    assert [round(x["score"], 6) for x in found] == [1.0, 0.75, 1.0]
    answer = s.retrieve("searching text", k=3)
    assert answer["mode"] == "targeted" and answer["notes"][0]["note_id"] in {"concepts/search.md", "tools/ripgrep.md"}
    assert answer["markdown"].startswith("# Knowledge Base Context") and s.retrieve("where do i start")["mode"] == "discover"
    wide = s.retrieve("calls g", k=2, depth=2)
    assert {x["role"] for x in wide["notes"]} >= {"seed"} and len({x["note_id"] for x in wide["notes"]}) == len(wide["notes"])
    assert s.stats()["n_notes"] == 9 and "Finds text" in s.note("tools/ripgrep.md")
    assert s.rate("r1", 5) == {"status": "ok"} and s.rate("r1", 9)["status"] == "error"


def test_incremental_update(spark, root):
    from pathlib import Path

    s = KnowledgeSession(spark, root, workspace="w").build()
    Path(root, "new.md").write_text("# New\n")
    Path(root, "open.md").unlink()
    time.sleep(0.01)
    Path(root, "concepts/search.md").write_text("# Searching more\n")
    assert {(r.rel_path, r.change) for r in s.changes().collect()} == {("new.md", "new"), ("open.md", "deleted"), ("concepts/search.md", "changed")}
    assert s.update() == {"added": 1, "removed": 1, "updated": 1}
    assert s.note("concepts/search.md").startswith("# Searching more") and s.note("open.md") is None and s.update() == {}


def test_text_functions(spark):
    assert column(spark, T.normalize_token(F.col("x")), x=" Foo/Bär-baz! ") == "foo_b_r_baz"
    assert column(spark, T.stem(F.col("x")), x="a/b.test.md") == "b.test" and column(spark, T.stem(F.col("x")), x=".env") == ".env"
    assert [c.chunk_index for c in column(spark, T.chunks(F.col("x"), 10, 4), x="a" * 25)] == [0, 1, 2, 3, 4]
    assert column(spark, T.chunks(F.col("x"), 10, 4), x="")[0].text == ""
    with pytest.raises(ValueError):
        T.chunks(F.col("x"), 5, 5)
    assert column(spark, T.excerpt(F.col("x"), 5), x="  abcd efg ") == "abcd\n..."
    for query, mode in (("Give me the big picture", "discover"), ("show the modules", "discover"), ("src/a.py flow", "targeted"), ("", "targeted"), ("rip grep", "targeted")):
        assert column(spark, query_mode(F.col("x")), x=query) == mode


def test_zero_vector(spark):
    v = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert [r.s for r in v.select(cosine(F.col("a"), F.col("b")).alias("s")).collect()] == [0.0, 1.0]


def test_link_priority(spark):
    notes = spark.createDataFrame([("w", "a/x.md", "concept"), ("w", "b/x.md", "tool"), ("v", "x.md", "concept")], "workspace string, note_id string, note_type string")
    asked = spark.createDataFrame([("w", "x"), ("w", "a/x"), ("v", "zz/X"), ("w", "q")], "workspace string, target string")
    got = {(r.workspace, r.target): (r.note_id, r.how) for r in links.resolve_links(asked, notes).collect()}
    assert got == {("w", "x"): ("b/x.md", "suffix"), ("w", "a/x"): ("a/x.md", "md"), ("v", "zz/X"): ("x.md", "stem"), ("w", "q"): (None, None)}


def test_shortest_path_and_cycle(spark):
    chain = [(f"n{i}", "LINKS_TO", f"n{i + 1}") for i in range(10)] + [("n3", "LINKS_TO", "n0"), ("n2", "CALLS", "n4")]
    edges = spark.createDataFrame(chain, "src string, label string, dst string")
    pairs = spark.createDataFrame([(1, "n0", "n5"), (2, "n0", "n10"), (3, "n0", "zz")], "pair_id int, start string, end string")
    got = {}
    for r in graph.shortest_paths(edges, pairs).orderBy("pos").collect():
        got.setdefault(r.pair_id, []).append((r.node_id, r.edge_label))
    assert got[1] == [("n0", None), ("n3", "LINKS_TO"), ("n4", "LINKS_TO"), ("n5", "LINKS_TO")] and len(got[2]) == 9 and 3 not in got


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a int, b int")
    got = {r.node: r.component for r in graph.components(pairs).collect()}
    assert {got[i] for i in range(51)} == {0} and got[101] == 100


def test_clusters(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.02]), (4, [0.0, 1.0]), (5, [0.0, 0.0])]
    found, members = near_duplicate_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.99)
    r = found.collect()
    assert len(r) == 1 and (r[0].cluster_id, r[0].size, r[0].representative) == (1, 3, 1)
    assert {m.vec_id for m in members.collect()} == {1, 2, 3}


def test_degrees_modes(spark):
    edges = spark.createDataFrame([("a", "CALLS", "b"), ("a", "CALLS", "z")], "src string, label string, dst string")
    notes = spark.createDataFrame([("a",), ("b",)], "note_id string")
    assert {r.note_id: r.degree for r in graph.degrees(edges, notes).collect()} == {"a": 3, "b": 2}
    assert {r.note_id: r.degree for r in graph.degrees(edges, notes, visits=False).collect()} == {"a": 2, "b": 1}


def test_claim_key_and_stale(spark):
    assert column(spark, events.claim_key(F.lit("w"), F.col("d"), F.col("r"), F.col("c")), d="7", r="x", c="y") == "delivery:w:7"
    assert column(spark, events.claim_key(F.lit("w"), F.col("d"), F.col("r"), F.col("c")), d="", r="x", c="y") == "push:w:x:y"
    have = spark.createDataFrame([("a",), ("b",)], "path string")
    none = spark.createDataFrame([], "path string")
    assert incremental.stale(have, none).count() == 0 and [r.path for r in incremental.stale(have, have.limit(1)).collect()] == ["b"]


def test_render(spark):
    rows = [("1", "a.py", "codeSymbol", "1", 0.5, 0, "body"), ("2", "m", "codeModule", "3", 0.9, 1, "mod"), ("3", "t", "tool", "", 0.1, 1, "tool")]
    notes = spark.createDataFrame(rows, "note_id string, path string, note_type string, tier string, score double, depth int, content string")
    text = render.context(notes).first().markdown
    assert text.index("## Module Context") < text.index("## Symbol Details") < text.index("## Tools") and "### a.py (* | score: 0.500)" in text
    assert render.context(notes.limit(0)).first().markdown == render.NOTHING
    assert len(column(spark, render.within_budget(F.col("x"), 10), x="y" * 900)) == 500 + len("\n\n[truncated]")
    assert json.loads(render.wire(notes.where("note_id = '3'")).first().json).get("tier") is None


PY = '''"""doc"""
from .util import helper as h, other
import os

__all__ = ["run"]


def run(
    a,
    b,
):
    return h(a) + helper(b)


class K:
    def m(self):
        return run(1, 2)


def hidden():
    pass
'''


def test_python_symbols_and_calls(spark):
    rows = [("p/a.py", PY), ("p/util.py", "def helper(x):\n    return x\n\n\ndef _no():\n    return 0\n"), ("p/__init__.py", "")]
    src = spark.createDataFrame(rows, "path string, source string")
    table = mirror.symbols(src, "py").cache()
    got = {(r.path, r.role, r.name): r.exported for r in table.where("role <> 'call'").collect()}
    assert got[("p/a.py", "def", "run")] and not got[("p/a.py", "def", "hidden")] and not got[("p/a.py", "class", "K")]
    assert got[("p/util.py", "def", "helper")] and not got[("p/util.py", "def", "_no")] and ("p/a.py", "method", "m") in got
    calls = {(r.path, r.caller, r.name, r.callee_path) for r in mirror.call_graph(table).collect()}
    assert calls == {("p/a.py", "run", "helper", "p/util.py")}
    assert {(r.src, r.dst) for r in mirror.import_edges(table, src, "py").collect()} == {("p/a.py", "p/util.py")}
    notes = {r.note_path: r.note for r in mirror.file_notes(table, src, "py", "w").collect()}
    assert set(notes) == {"p/a.md", "p/util.md", "p/p-init.md"} and "`helper` in [[code/w/p/util]]" in notes["p/a.md"] and "## Called by" in notes["p/util.md"]


def test_c_and_typescript_symbols(spark):
    c = '#include "x.h"\n#include <stdio.h>\nstatic int hid(int a) { return a; }\nint main(int argc, char **argv) {\n  if (argc) { hid(1); }\n  return 0;\n}\n'
    ts = "import { a as b } from './x';\nexport function run(q: string): void {\n  b(q);\n}\nexport const go = () => run('x');\nclass P {\n  public m(z: number) {\n    return z;\n  }\n}\n"
    got = {(r.role, r.name): r.exported for r in mirror.symbols(spark.createDataFrame([("m.c", c)], "path string, source string"), "c").collect()}
    assert got[("import", "x.h")] and not got[("import", "stdio.h")] and got[("def", "main")] and not got[("def", "hid")] and ("call", "hid") in got and ("call", "if") not in got
    got = {(r.role, r.name): r.exported for r in mirror.symbols(spark.createDataFrame([("x/y.ts", ts)], "path string, source string"), "ts").collect()}
    assert got[("def", "run")] and got[("def", "go")] and not got[("class", "P")] and ("method", "m") in got and got[("import", "a")]
    src = spark.createDataFrame([("x/y.ts", ts), ("x/x/index.ts", "")], "path string, source string")
    assert [tuple(r) for r in mirror.import_edges(mirror.symbols(src, "ts"), src, "ts").collect()] == [("x/y.ts", "x/x/index.ts")]


def test_a_session_starts_from_stored_tables(spark, root, tmp_path, monkeypatch):
    from pathlib import Path

    from quillgraph.operators import embedding

    store = f"file://{tmp_path}/store"
    first = KnowledgeSession(spark, root, workspace="w")
    assert first.open(store) == {"added": 9}
    first.save(store)
    Path(root, "more.md").write_text("# More about searching\n")
    embedded = []
    plain = embedding.chunk_table
    monkeypatch.setattr(embedding, "chunk_table", lambda notes, *a: embedded.extend(r.note_id for r in notes.collect()) or plain(notes, *a))
    second = KnowledgeSession(spark, root, workspace="w")
    assert second.open(store) == {"added": 1} and embedded == ["more.md"]
    second.save(store)
    third = KnowledgeSession(spark, root, workspace="w")
    assert third.open(store) == {} and third.stats() == second.stats() and embedded == ["more.md"]
    assert sorted(map(tuple, third.edges.collect())) == sorted(map(tuple, second.edges.collect()))
    assert KnowledgeSession(spark, root, workspace="other").open(store) == {"added": 10}


def test_targeted_retrieval(spark):
    """Keyword fallback, paths between the first three seeds, neighbours by their edges' phrases, traces."""
    from quillgraph.operators import targeted as module

    names = ["a", "b", "c", "d", "e", "far"]
    notes = spark.createDataFrame(
        [(n, f"Title {n}", ["x"], f"p/{n}", f"word{n} body", "concept", "1", [f"title_{n}", n]) for n in names],
        "note_id string, title string, tags array<string>, path string, body string, note_type string, tier string, name_tokens array<string>",
    )
    edges = spark.createDataFrame([("a", "CALLS", "d"), ("d", "CALLS", "b"), ("c", "LINKS_TO", "b"), ("e", "CALLS", "a"), ("far", "LINKS_TO", "e")], "src string, label string, dst string")
    rows, steps = module.targeted(notes, edges, None, "worda wordb wordc", 3)
    assert [(r.note_id, r.role, round(r.score, 6), r.linked_from) for r in rows.orderBy("role", "pos").collect()] == [("d", "path", 0.75, "a"), ("a", "seed", 1.0, None), ("b", "seed", 1.0, None), ("c", "seed", 1.0, None)]
    hits = spark.createDataFrame([("a", 0.9), ("a", 0.5), ("b", 0.8)], "note_id string, score double")
    similar = lambda text: F.when(text == "Title e calls Title a", 0.9).otherwise(0.2)
    rows, steps = module.targeted(notes, edges, hits, "x", 8, 1, similar)
    got = {r.note_id: (r.role, round(r.score, 6), r.via) for r in rows.collect()}
    assert got == {"a": ("seed", 0.99, None), "b": ("seed", 0.88, None), "d": ("path", 0.75, None), "c": ("neighbour", round(0.88 * 0.5 * 1.1 * 0.7, 6), "LINKS_TO"), "e": ("neighbour", round(0.99 * 0.8 * 1.1 * 1.4, 6), "CALLS")}
    shown = rows.join(notes.select("note_id", "path", "note_type", "tier", F.col("body").alias("content")), "note_id")
    text = render.context(shown, steps).first().markdown
    assert "**p/a \u2192 p/b**\np/a \u2192[calls]\u2192 p/d \u2192[calls]\u2192 p/b\n" in text
    assert text.index("## Symbol Details") < text.index("## Call Relationships") < text.index("## Path Traces") and "_via: a \u2014[calls]\u2192 here_" in text
    empty, none = module.targeted(notes, edges, hits.limit(0), "nothing of it", 3)
    assert empty.count() == none.count() == 0


def test_any_name_is_read(spark, tmp_path):
    """Names with an underscore, a space, a letter beyond ASCII; ignored folders; many folders; changes of such files."""
    names = ["_module.md", "a b.md", "é.md", "x/_module.md", "x/100%25.md", *[f"d{i}/{i % 7}/n.md" for i in range(90)]]
    for name in [*names, "node_modules/p/n.md", "d1/.venv/n.md"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# Title\nof {name}")
    s = KnowledgeSession(spark, f"file://{tmp_path}").build()
    assert {r.note_id: r.body for r in s.notes.collect()} == {n: f"# Title\nof {n}" for n in names}
    assert {r.rel_path for r in s.manifest.collect()} == set(names) and s.update() == {}
    for name in ("a b.md", "_module.md", "d7/0/n.md"):
        (tmp_path / name).write_text(f"# Other\n{name} longer than before, by far")
    (tmp_path / "é.md").unlink()
    read = []
    plain = files.read_files
    files.read_files = lambda paths, root: read.append(paths.count()) or plain(paths, root)
    try:
        assert s.update() == {"updated": 3, "removed": 1}
    finally:
        files.read_files = plain
    assert read == [3], "only changed files are read"
    assert {r.title for r in s.notes.where("note_id IN ('a b.md', '_module.md')").collect()} == {"Other"}


def test_package_files_are_sources(spark, tmp_path):
    for name in ("p/__init__.py", "p/__main__.py", "p/a b.py", "p/.hidden/x.py", "venv/x.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1")
    assert {r.path for r in files.read_sources(spark, str(tmp_path), "py").collect()} == {"p/__init__.py", "p/__main__.py", "p/a b.py"}


def test_only_the_running_job_absorbs(spark):
    rows = [(1, 0, 10), (2, 9, 19), (3, 12, 22), (4, 13, 90), (5, 22, 30), (6, 100, 101)]
    ts = lambda x: datetime(2024, 1, 1) + timedelta(seconds=x)
    frame = spark.createDataFrame([(i, "w", "t", ts(a), ts(b)) for i, a, b in rows], "request_id long, workspace string, type string, ts timestamp_ntz, done_ts timestamp_ntz")
    assert {r.request_id: r.job_id for r in events.distinct_jobs(frame).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}


def test_child_context_is_cut_at_the_budget(spark):
    rows = [("p", i, "x" * (i % 5) + str(i)) for i in range(300)] + [("q", 1, "abc"), ("q", 2, None), ("q", 3, "")]
    got = {(r.parent, r.link): r.part for r in summaries.child_context(spark.createDataFrame(rows, "parent string, link long, text string"), 50, 4).collect()}
    spent, want = {}, {}
    for parent, link, text in rows:
        if spent.get(parent, 0) < 50:
            want[parent, link] = None if text is None else text[: 50 - spent.get(parent, 0)]
        spent[parent] = spent.get(parent, 0) + len(text or "")
    assert got == want


def test_link_prefix_is_no_pattern(spark):
    notes = spark.createDataFrame([("w", "a.md", "concept"), ("w", "b/c.md", "concept")], "workspace string, note_id string, note_type string")
    found = links.resolve_links(spark.createDataFrame([("w", "k.(a"), ("w", "kx(b/c")], "workspace string, target string"), notes, "k.(").collect()
    assert {r.target: r.note_id for r in found} == {"k.(a": "a.md", "kx(b/c": "b/c.md"}


def test_mirror_workspace(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    for name, text in {"p/__init__.py": "from .a import run\n", "p/a.py": "from .util import helper\n\n\ndef run():\n    return helper(1)\n", "p/util.py": "def helper(x):\n    return x\n"}.items():
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text(text)
    (out / "old").mkdir(parents=True)
    (out / "old/stale.md").write_text("x")
    (out / "old/keep.txt").write_text("x")
    first = mirror.mirror_workspace(spark, str(src), str(out), ["py", "py"], "w")
    assert first["cleaned"] == 1 and first["skipped"] == {"py": 0} and first["written"]["py"] >= 6 and (out / "old/keep.txt").exists()
    made = {str(x.relative_to(out)) for x in out.rglob("*.md")}
    assert {"p_module.md", "root_module.md", "p/a.md", "p/a/run.md", "p/p-init.md", "p/util/helper.md"} <= made
    (out / "p/a.md").write_text((out / "p/a.md").read_text().rstrip() + "\n\n## Summary\nwhat it does")
    (src / "p/util.py").unlink()
    assert "skipped" in mirror.mirror_workspace(spark, str(src), str(out), ["py", "cobol"], "w") and (out / "p/util.md").exists(), "an unknown language keeps all"
    again = mirror.mirror_workspace(spark, str(src), str(out), ["py"], "w")
    assert again["cleaned"] == 2 and not (out / "p/util").exists() and "## Summary\nwhat it does" in (out / "p/a.md").read_text()
    assert mirror.mirror_workspace(spark, str(src), str(out), ["py"], "w")["written"] == {"py": 0}
    with pytest.raises(Exception, match="outside the root"):
        files.delete_files(spark.createDataFrame([("../x",)], "rel_path string"), str(out))


def test_registry(spark, tmp_path):
    from quillgraph.operators import registry

    schema = "workspace string, name string, languages array<string>, active boolean"
    held = spark.createDataFrame([("1", "alpha", ["py"], True), ("2", "beta", ["ts"], False)], schema)
    asked = spark.createDataFrame([("3", "alpha", ["py"], True), ("4", "a", ["py"], True), ("5", "good-one", ["c", "py", "c"], True), ("6", "good-one", ["c"], True), ("7", "other", ["", "c"], True), ("8", "none", None, True), ("9", "_x", [], True)], schema)
    after, said = registry.register(held, asked)
    assert {r.workspace: r.outcome for r in said.collect()} == {"3": "taken", "4": "bad_name", "5": "registered", "6": "taken", "7": "bad_languages", "8": "bad_languages", "9": "bad_name"}
    assert {r.workspace: r.languages for r in after.collect()} == {"1": ["py"], "2": ["ts"], "5": ["c", "py"]}
    files.save_registry(after, f"{tmp_path}/registry.json")
    assert {r.workspace for r in files.read_registry(spark, f"{tmp_path}/registry.json", schema).collect()} == {"1", "5"}
    notes = spark.createDataFrame([("1", "code/a.md"), ("5", "code/b.md")], "workspace string, path string")
    left, paths = registry.unregister(after, notes, spark.createDataFrame([("5",)], "workspace string"))
    assert {r.workspace for r in left.collect()} == {"1", "2"} and [tuple(r) for r in paths.collect()] == [("5", "code/b.md")]
    status = spark.createDataFrame([("1", {"a": "old", "b": "kept"}), ("2", None)], "workspace string, status map<string,string>")
    new = registry.patched(status, spark.createDataFrame([("1", {"a": "new"})], "workspace string, status map<string,string>"), {"c": "never", "b": "none"})
    assert {r.workspace: r.status for r in new.collect()} == {"1": {"a": "new", "b": "kept", "c": "never"}, "2": {"c": "never", "b": "none"}}
    jobs = spark.createDataFrame([("1", "running"), ("1", "pending"), ("1", "done")], "workspace string, state string")
    assert sorted(tuple(r) for r in registry.status_view(held, jobs, notes).collect()) == [("1", 1, 1, 1, True), ("2", 0, 0, 0, False)]
    pause = lambda *w: spark.createDataFrame([(x,) for x in w], "workspace string")
    assert registry.not_paused(jobs, pause("1")).count() == 0 and registry.not_paused(jobs, pause("2")).count() == 3 and registry.not_paused(jobs, pause(None)).count() == 0


def test_prune_candidates_and_strongest_pairs(spark):
    from quillgraph.operators import clusters

    notes = spark.createDataFrame([("a", "concept", ["x"]), ("b", "tool", ["x"]), ("c", "concept", ["do_not", "x"]), ("d", "concept", None)], "note_id string, note_type string, tags array<string>")
    assert {r.note_id for r in clusters.candidates(notes, ["concept"], ["Do Not"]).collect()} == {"a", "d"}
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (2, 3, 0.7), (3, 4, 0.6)], "a long, b long, sim double")
    assert {(r.a, r.b) for r in clusters.strongest(pairs, 1).collect()} == {(1, 2), (1, 3), (3, 4)}


def test_an_added_language_and_a_file_that_fails(spark, tmp_path):
    def lines(source):
        if "bad" in source:
            raise ValueError("cannot read this")
        yield from (("def", x, x, True, 0, 1) for x in source.split())

    mirror.register_language("zz", lines, ["skip"])
    (tmp_path / "a.zz").write_text("one two skip(")
    (tmp_path / "b.zz").write_text("bad")
    src = files.read_sources(spark, str(tmp_path), "zz")
    got = {(r.path, r.role, r.name, r.detail) for r in mirror.symbols(src, "zz").collect()}
    assert got == {("a.zz", "def", x, x) for x in ("one", "two", "skip(")} | {("b.zz", "error", "", "ValueError: cannot read this")}
    row = src.where("path = 'a.zz'").select(mirror.mirror_stem(F.col("path"), "zz").alias("s"), mirror.entrypoint_marks("zz", F.col("path"), F.col("source")).alias("m")).first()
    assert (row.s, row.m) == ("a", [])


def test_source_scan_omits(spark, tmp_path):
    for name in ("a.py", "venv/b.py", ".git/c.py", "d.pyi", "s/e.py"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x = 1\n")
    assert {r.path for r in files.read_sources(spark, str(tmp_path), "py").collect()} == {"a.py", "s/e.py"}


def test_summaries(spark):
    kids = spark.createDataFrame([("p", "b", "2"), ("p", "a", "1"), ("q", "c", "3")], "parent string, link string, summary string")
    one = {r.parent: r.child_hash for r in summaries.child_hashes(kids).collect()}
    two = {r.parent: r.child_hash for r in summaries.child_hashes(kids.orderBy("link")).collect()}
    assert one == two and len(one) == 2
    parts = summaries.child_context(spark.createDataFrame([("p", "a", "xxxx"), ("p", "b", "yyyy"), ("p", "c", "z")], "parent string, link string, text string"), 6)
    assert [(r.link, r.part) for r in parts.orderBy("link").collect()] == [("a", "xxxx"), ("b", "yy")]


def test_streams(spark, tmp_path):
    from quillgraph.streaming import events as S

    src = tmp_path / "in"
    src.mkdir()
    lines = [{"workspace": "w", "ts": f"2024-01-01T00:00:0{i}", "payload": p} for i, p in enumerate(('{"ref":"r","after":"1"}', '{"ref":"r","after":"1"}', "broken"))]
    (src / "a.json").write_text("\n".join(map(json.dumps, lines)))
    q = S.claims(S.read_pushes(spark, str(src))).writeStream.format("memory").queryName("claims").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.key for r in spark.table("claims").collect()} == {"push:w:r:1", "push:w::"}
    ev = tmp_path / "ev"
    ev.mkdir()
    (ev / "a.json").write_text("\n".join(json.dumps({"workspace": "w", "path": "p", "to_path": "t", "kind": k, "seq": i}) for i, k in enumerate(("modified", "moved"))))
    stream = spark.readStream.schema("workspace string, path string, to_path string, kind string, seq int").json(str(ev))
    got = []
    S.index_changes(stream, lambda delta: got.extend((r.path, r.kind) for r in delta.collect()), str(tmp_path / "c2")).awaitTermination(60)
    assert sorted(got) == [("p", "deleted"), ("t", "changed")]


def test_keyword_ties_and_scale(spark):
    rows = [("b", "alpha", [], "x/y", "beta", "concept"), ("a", "alpha", [], "x/z", "beta", "concept"), ("c", "none", [], "q", "none", "concept"), ("i", "alpha", [], "x", "beta", "index")]
    notes = spark.createDataFrame(rows, "note_id string, title string, tags array<string>, path string, body string, note_type string")
    got = [(r.note_id, round(r.score, 6)) for r in retrieval.keyword_topk(notes, "Alpha beta", 5).collect()]
    assert sorted(got) == [("a", 1.0), ("b", 1.0)]


def test_symbol_and_module_notes(spark):
    rows = [("p/a.py", PY.replace("class K:", "class K(u.Base):")), ("p/util.py", "class Base:\n    pass\n\n\ndef helper(x):\n    return x\n"), ("p/__init__.py", "from .util import helper\nfrom .a import *\n"), ("p/q/z.py", "")]
    src = spark.createDataFrame(rows, "path string, source string")
    table = mirror.symbols(src, "py").cache()
    assert [tuple(r) for r in mirror.base_classes(table).collect()] == [("p/a.py", "K", "Base", "p/util.py")]
    assert {tuple(r) for r in mirror.public_api(table).collect()} == {("p/util.py", "helper"), ("p/a.py", "run")}
    notes = {r.note_path: r.note for r in mirror.symbol_notes(table, "py", "w").collect()}
    assert set(notes) == {"p/a/run.md", "p/util/Base.md", "p/util/helper.md"}
    assert "## Calls Into\n- [[code/w/p/util/helper|helper]]" in notes["p/a/run.md"] and "## Called By\n- [[code/w/p/a/run|run]]" in notes["p/util/helper.md"]
    folders = {r.note_path: r.note for r in mirror.module_notes(src, "py", "w").collect()}
    assert set(folders) == {"root_module.md", "p_module.md", "p/q_module.md"} and "[[code/w/p/q_module]]" in folders["p_module.md"] and "[[code/w/p/p-init]]" in folders["p_module.md"]
    kept = spark.range(1).select(mirror.keep_summary(F.lit("new\n"), F.lit("old\n## Summary\ntext")).alias("r")).first().r
    assert kept == "new\n\n## Summary\ntext"


def test_embedding_provider(spark):
    from quillgraph.operators import embedding

    notes = spark.createDataFrame([("w", "a", "a", "alpha beta", "", ["x"], "concept"), ("w", "b", "b", "gamma", "delta " * 400, [], "concept"), ("w", "i", "i", "alpha", "", [], "index")], "workspace string, note_id string, path string, title string, body string, tags array<string>, note_type string")
    chunks = embedding.chunk_table(notes, size=500, overlap=100)
    assert {r.chunk_id for r in chunks.where("note_id = 'b'").collect()} >= {"b", "b#chunk1"}
    got = embedding.hybrid_seeds(notes, chunks, "alpha x", 3).collect()
    assert got[0].note_id == "a" and "i" not in {r.note_id for r in got}
