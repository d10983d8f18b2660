"""Damaged and foreign stored tables, failing providers, missing registries, bounded answers, summaries with write-back."""

from __future__ import annotations

import uuid
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import embedding, summaries
from quillgraph.session import KnowledgeSession
from quillgraph.sources import files


@pytest.fixture()
def root(tmp_path):
    for name, text in {"a.md": "# Alpha\nsee [[b]]\n", "b.md": "# Beta\nplain\n", "c.md": "# Gamma\nbroken words\n"}.items():
        (tmp_path / "notes").mkdir(exist_ok=True)
        (tmp_path / "notes" / name).write_text(text)
    return str(tmp_path / "notes")


def test_damaged_and_foreign_tables_are_built_anew(spark, root, tmp_path):
    store = f"file://{tmp_path}/store"
    first = KnowledgeSession(spark, root, workspace="w").build()
    version = Path(first.save(store).removeprefix("file://"))
    again = KnowledgeSession(spark, root, workspace="w")
    assert again.open(store) == {} and again.notices == []
    other = KnowledgeSession(spark, root, workspace="other")
    assert other.open(store) == {"added": 3} and "of workspace 'w'" in other.notices[0]
    part = next((version / "chunks").glob("part-*.parquet"))
    whole = part.read_bytes()
    part.write_bytes(whole[: len(whole) // 2])
    for crc in (version / "chunks").glob(".*.crc"):
        crc.unlink()
    cut_off = KnowledgeSession(spark, root, workspace="w")
    assert cut_off.open(store) == {"added": 3} and "can't be read" in cut_off.notices[0] and cut_off.chunks.count() == 3
    part.unlink()
    fewer = KnowledgeSession(spark, root, workspace="w")
    assert fewer.open(store) == {"added": 3} and "chunks" in fewer.notices[0] or "can't be read" in fewer.notices[0]


def test_versions_are_never_written_over(spark, root, tmp_path):
    store = f"file://{tmp_path}/store"
    s = KnowledgeSession(spark, root, workspace="w").build()
    names = [s.save(store).rpartition("/")[2] for _ in range(2)]
    import shutil

    shutil.rmtree(tmp_path / "store" / names[0])
    (tmp_path / "store" / "v000000007" / "notes").mkdir(parents=True)  # its writer died
    assert s.save(store).endswith("/v000000008") and [p[-10:] for p in files.versions(spark, store)] == [names[1], "v000000008"]


def test_reindex(spark, root):
    s = KnowledgeSession(spark, root, workspace="w").build()
    assert s.reindex() == {}
    Path(root, "b.md").unlink()
    Path(root, "d.md").write_text("# Delta\n")
    assert s.reindex(force=True) == {"added": 1, "removed": 1}
    found = s.path("a.md", "amm")
    assert (found["start_resolved_by"], found["end_id"], found["end_resolved_by"], found["length"], found["steps"]) == ("exact", "c.md", "substring", None, [])
    assert s.path("a.md", "zzz")["end_resolved_by"] is None


def test_a_provider_that_fails_on_one_text(spark, root, tmp_path):
    switch = tmp_path / "works"

    def moody(texts):
        if any("broken" in t for t in texts) and not switch.exists():
            raise RuntimeError("no such luck")
        return embedding.hash_provider(texts)

    embedding.register_provider("moody", moody)
    s = KnowledgeSession(spark, root, workspace="w", provider="moody").build()
    state = {r.note_id: (r.embedding is None, r.error) for r in s.chunks.collect()}
    assert state == {"a.md": (False, None), "b.md": (False, None), "c.md": (True, "RuntimeError: no such luck")}
    answer = s.retrieve("plain beta", k=3, depth=1)
    assert {n["note_id"] for n in answer["notes"]} >= {"b.md"}
    by_words = s.retrieve("broken gamma", k=2)
    assert by_words["notes"][0]["note_id"] == "c.md" and "not embedded" in s.notices[-1]
    switch.write_text("")
    assert s.update() == {} and s.chunks.where("embedding IS NULL").count() == 0
    calls = []
    assert embedding.vectors_or_errors(lambda t: calls.append(len(t)) or 1 / 0, ["x", "y"], 1) == [(None, "ZeroDivisionError: division by zero")] * 2 and calls == [2, 1, 1, 1, 1]


def test_edges_whose_phrase_fails_count_as_middling(spark):
    from quillgraph.functions.vectors import cosine, triple_factor

    vector = F.array(*[F.lit(float(x)) for x in np.ones(64)])
    row = spark.range(1).select(triple_factor(cosine(F.lit(None).cast("array<double>"), vector)).alias("f")).first()
    assert row.f == 1.0


def test_registry_missing_invalid_and_derived_ids(spark, tmp_path):
    schema = "id string, name string, active boolean"
    assert files.read_registry(spark, f"{tmp_path}/none.json", schema).count() == 0
    (tmp_path / "bad.json").write_text("{[")
    assert files.read_registry(spark, f"{tmp_path}/bad.json", schema).count() == 0
    (tmp_path / "r.json").write_text('[{"name": "alpha"}, {"id": "7", "name": "beta"}, {"id": "", "name": "g\\u00e4"}, {"id": "9", "name": "off", "active": false}]')
    found = files.read_registry(spark, f"{tmp_path}/r.json", schema)
    assert {r.name: r.id for r in found.collect()} == {"alpha": str(uuid.uuid5(uuid.NAMESPACE_DNS, "alpha")), "beta": "7", "gä": str(uuid.uuid5(uuid.NAMESPACE_DNS, "gä"))}
    assert files.registered(found, "7")["name"] == "beta" and files.registered(found, "9") is None


def test_only_parents_of_deleted_files_are_cleared(spark, tmp_path):
    for name in ("x/y/z/a.md", "x/y/b.md", "p/q/c.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("t")
    (tmp_path / "empty/of/old").mkdir(parents=True)
    assert files.delete_files(spark.createDataFrame([("x/y/z/a.md",), ("p/q/c.md",)], "rel_path string"), str(tmp_path)) == 2
    assert not (tmp_path / "x/y/z").exists() and (tmp_path / "x/y/b.md").exists() and not (tmp_path / "p").exists() and (tmp_path / "empty/of/old").exists()


def test_whole_frontmatter(spark):
    front = "title: A: b\n# no\nempty:\ntags:\n  - one\n\t- two\n  k: lost\nmeta:\n  a: 1\n  b: x:y\nmixed:\n  a: 1\n  - won\n- not taken\n: none\nlast: 'q'\n  - ignored\n"
    want = {"title": "A: b", "empty": None, "tags": ["one", "two"], "meta": {"a": "1", "b": "x:y"}, "mixed": ["won"], "last": "'q'"}
    assert T.front_fields(front) == want
    row = spark.createDataFrame([(front,), (None,)], "f string").select(T.front_variant(F.col("f")).alias("v")).select(
        F.variant_get("v", "$.tags[1]", "string").alias("tag"), F.variant_get("v", "$.meta.b", "string").alias("b"), F.col("v").isNull().alias("none")
    )
    assert [tuple(r) for r in row.collect()] == [("two", "x:y", False), (None, None, True)]


NOTES = {
    "m_module.md": "---\ntier: 3\n---\n# m\n",
    "m/f.md": "---\ntier: 2\nparentModule: code/w/m_module\n---\n# f\n",
    "m/f/one.md": "---\ntier: 1\nparentFile: code/w/m/f\n---\n# one\n",
    "m/f/two.md": "---\ntier: 1\nparentFile: code/w/m/f\n---\n# two\n",
    "other.md": "no tier\n",
}


def test_summaries_from_the_bottom_up(spark, tmp_path):
    for name, text in NOTES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    model = {"provider": "p", "model": "m1"}

    def write(prompts):
        if "# f\n" in prompts[0] + "\n" and not (tmp_path / "works").exists():
            raise RuntimeError("tier two is down")
        head = next(x for x in prompts[0].split("\n") if x.startswith("# "))
        return [f"about {head[2:]} of {sum(x.startswith('### code/w/') for x in prompts[0].split(chr(10)))} children" + (": " + prompts[0].partition("Child summaries:")[2].replace("\n", " ").strip() if "Child" in prompts[0] else "")]

    run = lambda m=model: summaries.summarize_workspace(spark, str(tmp_path), "w", m, write)
    assert run() == {"tiers": {"1": {"summarized": 2, "skipped": 0, "failed": 0}, "2": {"summarized": 0, "skipped": 0, "failed": 1}}, "failed": "2"}
    assert "about one of 0" in (tmp_path / "m/f/one.md").read_text() and "## Summary" not in (tmp_path / "m_module.md").read_text()
    (tmp_path / "works").write_text("")
    assert run()["tiers"] == {"1": {"summarized": 0, "skipped": 2, "failed": 0}, "2": {"summarized": 1, "skipped": 0, "failed": 0}, "3": {"summarized": 1, "skipped": 0, "failed": 0}}
    file, module = (tmp_path / "m/f.md").read_text(), (tmp_path / "m_module.md").read_text()
    assert "about f of 2 children: ### code/w/m/f/one about one of 0 children" in file and "about m of 1 children" in module and file.startswith(NOTES["m/f.md"].rstrip())
    assert "provider: p\nmodel: m1" in file
    nothing = {"summarized": 0, "failed": 0}
    assert run()["tiers"] == {t: nothing | {"skipped": n} for t, n in (("1", 2), ("2", 1), ("3", 1))}
    # a changed source goes up only as far as summaries change
    (tmp_path / "m/f/two.md").write_text((tmp_path / "m/f/two.md").read_text().replace("# two", "# 2"))
    assert {t: c["summarized"] for t, c in run()["tiers"].items()} == {"1": 1, "2": 1, "3": 1}
    # a summary that someone has changed by hand
    (tmp_path / "m_module.md").write_text((tmp_path / "m_module.md").read_text().replace("about m", "edited m"))
    assert {t: c["summarized"] for t, c in run()["tiers"].items()} == {"1": 0, "2": 0, "3": 1}
    assert sum(c["summarized"] for c in run({"provider": "p", "model": "m2"})["tiers"].values()) == 4 and (tmp_path / "other.md").read_text() == "no tier\n"


def test_a_session_with_indexes(spark, root, tmp_path):
    plain, indexed = KnowledgeSession(spark, root, workspace="w").build(), KnowledgeSession(spark, root, workspace="w").build()
    indexed.index(f"file://{tmp_path}/index")
    seen = lambda s, q: [(n["note_id"], n["role"], round(n["score"], 6)) for n in s.retrieve(q, k=3)["notes"]]
    assert seen(indexed, "plain beta") == seen(plain, "plain beta")
    Path(root, "b.md").write_text("# Zeta\nother words\n")
    Path(root, "c.md").unlink()
    assert indexed.update() == plain.update() == {"updated": 1, "removed": 1}
    assert seen(indexed, "zeta other") == seen(plain, "zeta other")
    assert {r.note_id for r in indexed.words.topk("zeta beta gamma", 5).collect()} == {"b.md"} and indexed.vectors.stored.read().count() == plain.chunks.count()


def test_hits_of_notes_that_are_gone(spark):
    from quillgraph.operators import retrieval

    columns = "note_id string, note_type string, tags array<string>, workspace string"
    notes = spark.createDataFrame([("a", "concept", ["x"], "w"), ("i", "index", [], "w")], columns)
    said = spark.createDataFrame([("a", "index", None, "v"), ("gone", "concept", None, "w"), ("old", "index", None, "w")], columns)
    hits = spark.createDataFrame([("a", 0.5), ("i", 0.9), ("gone", 0.4), ("old", 0.9), ("unknown", 0.9)], "note_id string, score double")
    query = F.array(F.lit("x"))
    assert {r.note_id: round(r.score, 6) for r in retrieval.boosted_seeds(hits, notes, query).collect()} == {"a": 0.55}
    assert {r.note_id: round(r.score, 6) for r in retrieval.boosted_seeds(hits, notes, query, said, "w").collect()} == {"a": 0.55, "gone": 0.4}
    with pytest.raises(Exception, match="outside of workspace other"):
        retrieval.boosted_seeds(hits, notes, query, said, "other").collect()


def test_discovery_shows_excerpts(spark):
    from quillgraph.operators import registry, render

    rows = [(f"e{i}", "entrypoint", i, f"p/e{i}", 1, f"text of e{i}") for i in range(6)] + [("m", "module", 9, "p", 2, "x" * 3000), ("h", "hub", 10, "q", 7, "hub text")]
    text = render.discovery(spark.createDataFrame(rows, "note_id string, kind string, pos int, path string, degree int, content string"), "where").first().markdown
    assert text.index("## High-Connectivity Notes") < text.index("## Entrypoint Details") < text.index("## Module Details")
    assert "### e3\ntext of e3" in text and "text of e4" not in text and "hub text" not in text and text.endswith("x\n...")
    notes = spark.createDataFrame([("1",), ("1",), ("2",)], "workspace string")
    assert registry.total_notes(notes, spark.createDataFrame([("1",), ("3",)], "workspace string")).first() == (2, 2)


def test_clusters_by_questions(spark, tmp_path):
    from quillgraph.operators import clusters
    from quillgraph.operators.vector_index import VectorIndex

    texts = {"a": "one two three four five", "b": "one two three four five", "c": "one two three four six", "d": "quite another thing altogether", "e": "one two three four five"}
    notes = spark.createDataFrame([("w", n, n, "same title", t, [], "concept") for n, t in texts.items()], "workspace string, note_id string, path string, title string, body string, tags array<string>, note_type string")
    chunks = embedding.chunk_table(notes, size=40, overlap=5)
    index = VectorIndex.build(chunks.select(F.col("chunk_id").alias("vec_id"), "embedding"), f"file://{tmp_path}/i")
    pairs = clusters.query_pairs(notes.where("note_id <> 'e'"), index, threshold=0.8)
    assert {(r.a, r.b) for r in pairs.collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    found, members = clusters.clusters_of(pairs)
    assert [(r.cluster_id, r["size"], r.representative) for r in found.collect()] == [("a", 3, "a")] and {r.vec_id for r in members.collect()} == {"a", "b", "c"}
