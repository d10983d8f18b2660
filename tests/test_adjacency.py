"""Stored edges: plans of a hop, hubs, and paths on random graphs by both ways of joining."""

from __future__ import annotations

import random
from collections import Counter, deque

import pytest

from quillgraph.operators import adjacency, graph

LABELS = ["CALLS", "IMPORTS", "LINKS_TO"]


def edges_of(spark, rng, nodes, count, hub=None):
    rows = {(f"n{rng.randint(0, nodes)}", rng.choice(LABELS), f"n{rng.randint(0, nodes)}") for _ in range(count)}
    if hub:
        rows |= {(hub, "CALLS", f"n{i}") for i in range(nodes)}
    rows = sorted(r for r in rows if r[0] != r[2])
    return rows, spark.createDataFrame(rows, "src string, label string, dst string").repartition(3)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hop_moves_no_edges(spark, tmp_path, monkeypatch):
    rows, edges = edges_of(spark, random.Random(1), 60, 100, hub="hub")
    frontier = spark.createDataFrame([("hub", 1), ("n3", 2), ("none", 3)], "node_id string, tag int")
    near = adjacency.StoredAdjacency(edges, f"file://{tmp_path}/a")
    want = Counter()
    for node, tag in (("hub", 1), ("n3", 2)):
        for src, label, dst in rows:
            want.update([(node, tag, dst, label, "outgoing")] * (src == node) + [(node, tag, src, label, "incoming")] * (dst == node))
    key = lambda df: Counter((r.node_id, r.tag, r.neighbour, r.label, r.direction) for r in df.collect())
    small = near.hop(frontier, 3)
    assert key(small) == want and "BroadcastHashJoin" in plan(small) and "Exchange hashpartitioning" not in plan(small)
    monkeypatch.setattr(adjacency, "SENT_ROWS", 0)
    monkeypatch.setattr(adjacency, "HUBS", 20)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        large = near.hop(frontier, 3)
        text = plan(large)
        # only the frontier is dealt out
        assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text, text
        assert key(large) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert near.hubs.count() >= 1 and near.hubs.where("hub = 'hub'").first().pieces > 2
    near.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("adjacency_")]


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_paths_of_random_graphs(spark, monkeypatch, sent):
    monkeypatch.setattr(adjacency, "SENT_ROWS", sent)
    rng = random.Random(sent)
    rows, edges = edges_of(spark, rng, 40, 45)
    near: dict[str, list] = {}
    for src, label, dst in rows:
        near.setdefault(src, []).append((dst, label, "outgoing"))
        near.setdefault(dst, []).append((src, label, "incoming"))
    pairs = [(i, f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}") for i in range(12)] + [(12, "n1", "n1"), (13, "n1", "nowhere")]
    want = set()
    for number, start, end in pairs:
        level, queue = {start: 0}, deque([start])
        while queue:
            for other, _, _ in near.get(x := queue.popleft(), []):
                if other not in level:
                    level[other] = level[x] + 1
                    queue.append(other)
        if level.get(end, 99) > 5:
            continue
        node = end
        while level[node]:
            parent, _, direction, label = min((p, LABELS.index(lab) if lab != "LINKS_TO" else 9, "outgoing" if d == "incoming" else "incoming", lab) for p, lab, d in near[node] if level.get(p) == level[node] - 1)
            want.add((number, level[node], node, label, direction, parent))
            node = parent
        want.add((number, 0, start, None, "", None))
    got = graph.shortest_paths(edges, spark.createDataFrame(pairs, "pair_id int, start string, end string"), max_depth=5)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20
