"""Fill-in-middle, packing and centroid clusters against plain forms."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import byte_tokens, centroid_clusters, fill_in_middle, packing
from quillgraph.llm.tokenizer_files import default_path

from ..conftest import SF
from .brute import sha

# 11

MARKED = [(30, "a<P>b"), (31, "<M>"), (32, "x<<S>>y"), (33, "<P"), (34, "S>é<"), (35, "日"), (36, "<" * 50 + ">" * 50), (None, None), (None, "no id"), (36, "é" * 300_000)]


def filled(doc_id, text):
    text, h = text or "", sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, documents):
    rows = documents + MARKED + [(100 + i, f"<{i}é>日S><P" * 3) for i in range(200)] + documents[:3]
    frame = spark.createDataFrame([(i, t, "old", 5) for i, t in rows], "doc_id long, text string, form string, in0 int")
    out = fill_in_middle.fill_in_middle(frame)
    assert out.columns == ["doc_id", "text", "in0", *fill_in_middle.NEW]
    got = out.withColumn("back", fill_in_middle.fill_in_middle_restored(F.col("output"), F.col("form"))).collect()
    want = Counter((i, t, *filled(i, t)) for i, t in rows)
    assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    assert all(r.back == (r.text or "") and r.in0 == 5 for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(frame.where("false")).count() == 0


@pytest.mark.parametrize("size", [0, 1, 63, 64, 511, 512, 513, 5000])
def test_bit_vector(size):
    bits = np.random.default_rng(size).random(size) < 0.3
    vector = fill_in_middle.BitVector(bits)
    assert vector.rank(np.arange(size + 1)).tolist() == np.concatenate([[0], np.cumsum(bits)]).astype(int).tolist()
    ones = np.flatnonzero(bits)
    assert vector.select(np.arange(len(ones))).tolist() == ones.tolist()


def test_bit_vector_of_ones_and_gaps():
    for bits in (np.ones(3000, bool), np.arange(9000) % 1500 == 7):
        vector = fill_in_middle.BitVector(bits)
        assert vector.select(np.arange(bits.sum())).tolist() == np.flatnonzero(bits).tolist()


# 12


@pytest.fixture(scope="module")
def byte_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path(byte_tokens.BYTE_BPE))


def test_byte_tokens_equal_the_library(spark, byte_library):
    source = open(default_path(byte_tokens.BYTE_BPE), encoding="utf-8").read()
    tokens = byte_tokens.byte_tokens(source)
    odd = ["", " ", "a<|endoftext|>b<|endoftext|>", "<|endoftext|>", "<|endoftext|", "'s'LL 're", "x" * 20_000, " " * 30_000 + "x", "\r\n\x00\x85​", "é́日本 १२३½", "\U00010400", "12345 1a2b"]
    texts = odd + [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert tokens.fast is not None
    for text in texts:
        assert tokens.ids(text).tolist() == byte_library.encode(text, add_special_tokens=False).ids
    slow = byte_tokens.ByteTokens(source.replace('"use_regex":true', '"use_regex":false').replace('"use_regex": true', '"use_regex": false'))
    assert slow.fast is None and slow.ids("x").tolist() == [87]


def held(rows, docs, library, ids=False):
    """The pieces' rules; ``docs``: id to text, ids unique."""
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in docs.items()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert pieces.keys() == want.keys()
    for i, own in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            part = own[at : at + r.length]
            assert r.start == at and r.doc_tokens == len(own) and r.length > 0 and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert not ids or r.ids == part
            at += r.length
        assert at == len(own)
    assert sorted(windows) == list(range(len(windows)))
    for some in windows.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == some[0].tier <= 1024 and at & (at - 1) == 0 and len({(r.tier, r.step) for r in some}) == 1
    return windows


def test_packing(spark, documents, byte_library):
    docs = dict(documents) | {100 + i: "w " * i for i in range(400)}
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs.items()], "doc_id long, text string, tier int, ids string").repartition(3)
    rows = packing.pack_documents(frame, step_tokens=8192).collect()
    windows = held(rows, docs, byte_library, ids=True)
    # steps have the same number of windows of each tier, give or take one
    each = defaultdict(Counter)
    for some in windows.values():
        each[some[0].tier][some[0].step] += 1
    steps = max(r.step for r in rows) + 1
    assert steps == sum(len(w) and w[0].tier for w in windows.values()) // 8192 > 5
    for tier, found in each.items():
        counts = [found[s] for s in range(steps)]
        assert max(counts) - min(counts) <= 1, tier
    # few cuts: pieces over documents and full windows of long ones
    assert len(rows) < len(docs) + sum(r.doc_tokens // 1024 for r in rows if r.start == 0) + len(windows)
    assert packing.pack_documents(frame.where("false")).count() == 0


def test_packing_in_slices(spark, documents, byte_library):
    """What a slice can't fill waits for the next one."""
    docs = dict(documents)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)
    rows = packing.pack_documents(frame, tiers=(256, 64), slice_tokens=500, with_ids=False).collect()
    windows = held(rows, docs, byte_library)
    assert sum(w[0].tier not in (256, 64) for w in windows.values()) <= 8
    with pytest.raises(ValueError):
        packing.Packer((100,), 1)


def test_packing_of_repeated_rows_and_nulls(spark):
    frame = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, None), (None, None), (None, "d")], "doc_id long, text string")
    rows = packing.pack_documents(frame).collect()
    assert sum(r.length for r in rows) == 4 + 4 + 1 + 1 + 2 == sum({r.sequence_id: r.tier for r in rows}.values())
    assert sum(r.length for r in rows if r.doc_id is None) == 3
    words = packing.training_windows(packing.pack_documents(frame)).collect()
    assert sum(len(r.ids) for r in words) == 12 and all(len(r.ids) == r.tier for r in words)


def test_packing_query(spark, byte_library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held(packing.op12_packing(spark, SF).collect(), docs, byte_library)


# 13


def clusters_of(rows, k=8, rounds=10):
    kept = [(i, tuple(int(np.floor(np.float64(x) * 1024)) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (sha(f"3:{r[0]}"), np.array(r[1], "<i4").tobytes()))[:k]]
    label = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[label(v)[1]].append(v)
        centroids = [tuple(sum(x) // len(own[n]) for x in zip(*own[n], strict=True)) if n in own else c for n, c in enumerate(centroids)]
    found = [(i, *label(v)) for i, v in kept]
    each = Counter()
    for _, d, n in found:
        each[n] += d
    return Counter((i, n, d, each[n], sum(each.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in found)


def query_rows(spark, frame, monkeypatch):
    monkeypatch.setattr(centroid_clusters, "table", lambda *_: frame)
    return Counter(tuple(r) for r in centroid_clusters.op13_centroid_clusters(spark, "").collect())


SCHEMA = "vec_id long, embedding array<float>, v string, n string, cluster int"


def test_centroid_clusters(spark, monkeypatch):
    rng = np.random.default_rng(3)
    some = rng.normal(size=(200, 64)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(some)] + [(300 + i, some[0].tolist()) for i in range(150)] + [(600, some[1].tolist()), (5, some[5].tolist())]
    odd = [None, [], [1.0] * 63, [1.0] * 65, [1.0] * 63 + [None], [1.0] * 63 + [float("nan")], [1.0] * 63 + [float("-inf")]]
    rows += [(700 + i, v) for i, v in enumerate(odd)] + [(800, [0.0] * 64), (801, [-0.0] * 64), (802, [1e-4, -1e-4] * 32)]
    frame = spark.createDataFrame([(i, v, "x", "y", 9) for i, v in rows], SCHEMA).repartition(5)
    monkeypatch.setattr(centroid_clusters, "FREQUENT", 10)  # both ways of joining back
    assert query_rows(spark, frame, monkeypatch) == clusters_of(rows)
    out, about = centroid_clusters.centroid_clusters(frame)
    assert sum(r["size"] for r in about.collect()) == out.count() == len(rows) - len(odd)


def test_few_equal_and_no_vectors(spark, monkeypatch):
    for rows in ([], [(1, None)], [(1, [1.0] * 64), (2, [1.0] * 64), (3, [2.0] * 64)], [(i, [1.0] * 64) for i in range(20)], [(None, [1.0] * 64)]):
        frame = spark.createDataFrame([(i, v, "x", "y", 9) for i, v in rows], SCHEMA)
        got = query_rows(spark, frame, monkeypatch)
        want = clusters_of([(i if i is not None else "", v) for i, v in rows])
        assert got == Counter({((k[0] if k[0] != "" else None), *k[1:]): n for k, n in want.items()})


def test_large_components_and_sums():
    x = np.array([[1 << 27] * 64, [-(1 << 27)] * 64], np.int64)
    best, distance = centroid_clusters.nearest(x, x[::-1])
    assert best.tolist() == [1, 0] and distance.tolist() == [0, 0]
    assert centroid_clusters.nearest(x[:1], x[1:])[1].tolist() == [64 << 56]
    (c, n, total), *_ = centroid_clusters.weighted_sums(x, np.array([1 << 40, 1 << 50]), np.array([0, 0]), 1)
    assert n == (1 << 40) + (1 << 50) and total == [((1 << 40) - (1 << 50)) << 27] * 64
