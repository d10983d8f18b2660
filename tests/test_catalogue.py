"""Every registered query against its SQL, or at least that it runs."""

from __future__ import annotations

import pytest

from quillgraph.plans.catalogue import ORACLE_SQL, QUERIES

from .conftest import SF
from .oracle import connection, same


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(name, spark, con):
    same(QUERIES[name], ORACLE_SQL[name], con, spark, SF)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_runs(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_hybrid_retrieve_plain_form(spark):
    """Chunks embedded and ranked one by one."""
    import math

    from quillgraph.operators.embedding import hash_provider

    query, best = "the thing and of it en", []
    q = hash_provider([query])[0]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    for d in docs:
        whole = (d.text or "").split("\n")[0] + "\n\n" + (d.text or "")
        starts = [0] if len(whole) <= 1536 else range(0, len(whole), 1336)
        for i, v in enumerate(hash_provider([whole[s : s + 1536] for s in starts])):
            size = math.sqrt((v @ v) * (q @ q))
            chunk = str(d.doc_id) if i == 0 else f"{d.doc_id}#chunk{i}"
            best.append((-round(float(v @ q / size) if size > 1e-10 else 0.0, 9), chunk, d))
    want = {}
    for s, _, d in sorted(best, key=lambda x: x[:2])[:8]:
        if d.doc_id % 50:
            score = -s * (1 + min(0.3, 0.1 * len({d.lang, d.source} & set(query.split()))))
            want[str(d.doc_id)] = max(score, want.get(str(d.doc_id), -9))
    got = {r.note_id: r.score for r in QUERIES["hybrid_retrieve"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)


def test_no_cartesian_product(spark):
    for name in ("near_dup_pairs", "link_resolution", "graph_degree", "webhook_decision"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_scan_is_pruned(spark):
    plan = QUERIES["vector_topk_scoped"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan
    plan = QUERIES["graph_edges"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in plan
