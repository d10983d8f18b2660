"""The numbered operators against plain forms, on documents with every awkward case."""

from __future__ import annotations

import gzip
import hashlib
import inspect
import zlib
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import (
    bpe_codec,
    common,
    decontamination,
    near_dedup,
    quality_crf,
    quality_rules,
    queries,
    sharding,
    substring_dedup,
    suffix_dedup,
    token_counts,
    tokenizer_files,
    warc,
    word_hashes,
)
from quillgraph.llm.components import components

from ..conftest import SF
from ..oracle import connection, same
from . import brute


@pytest.fixture(scope="session")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_files.default_path())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(name, spark):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name], connection(SF), spark, SF)


# 1


def test_near_duplicates(spark, documents, docs, empty):
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs).collect()}
    assert got == brute.classes(documents)
    assert near_dedup.near_duplicate_classes(empty).count() == 0


def test_near_duplicates_of_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in near_dedup.op1_near_dedup(spark, SF).collect()}
    assert got == brute.classes(rows)


def test_near_duplicate_rows_and_names(spark, documents):
    rows = [(i, t, 1, 2) for i, t in documents] + [(0, documents[0][1], 1, 2), (None, documents[0][1], 1, 2), (None, None, 1, 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node int, label int")
    got = near_dedup.near_duplicate_classes(frame).collect()
    assert len(got) == len(documents) + 2 and sum(r.doc_id is None and r.class_id is None for r in got) == 2
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == brute.classes(documents)


def test_group_of_near_copies_of_each_other(spark):
    """A base that isn't among them: each member is near some others only."""
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.choice(150, rng.integers(1, 4), replace=False):
            words[k] = f"n{rng.integers(1_000_000)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.classes(rows)


def test_prob_min_hash_estimates():
    a, b = {i: 1 + i % 3 for i in range(300)}, {i: 1 + i % 3 for i in range(60, 360)}
    texts = np.concatenate([np.zeros(300, int), np.ones(300, int)])
    names = word_hashes.mix(np.array([*a, *b], np.uint64))
    kept = near_dedup.prob_min_hash(texts, names, np.array([*a.values(), *b.values()]), 2, 4000)
    x, y = Counter(a), Counter(b)
    assert abs((kept[0] == kept[1]).mean() - brute.probability_jaccard(x, y)) < 0.03
    key = lambda c: (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)]))
    assert abs(near_dedup.probability_jaccard(key(x), key(y)) - brute.probability_jaccard(x, y)) < 1e-9


def test_bit_sketches_tell_links_from_others():
    """All pairs at the threshold are kept, but for four deviations; of pairs at 0.67 next to none."""
    rng = np.random.default_rng(2)
    kept = {}
    for share, name in ((0.8, "links"), (0.67, "others")):
        own = round(400 * (1 - share) / (1 + share))  # of 400 shingles each
        found = 0
        for i in range(40):
            every = word_hashes.mix(rng.integers(0, 1 << 62, 400 + own, dtype=np.int64).astype(np.uint64))
            bits = np.packbits((word_hashes.mix(near_dedup.prob_min_hash(np.repeat([0, 1], 400), np.concatenate([every[:400], every[own:]]), np.ones(800), 2, near_dedup.BITS)) & np.uint64(1)).astype(np.uint8), axis=1).view("<u8")
            found += len(near_dedup.close_pairs(bits[:1], bits[1:], np.array([1]), np.array([2]))[0])
        kept[name] = found
    assert kept == {"links": 40, "others": 0}


def test_close_pairs_in_blocks(spark):
    """Every pair of blocks is compared once; pairs of one label are left out; what is surely alike ties two labels once."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (6, near_dedup.BITS // 8), dtype=np.uint8)
    sketch = lambda i: np.packbits(np.unpackbits(base[i % 6]) ^ (rng.random(near_dedup.BITS) < (0.1 if i < 30 else 0.01)))
    rows = [(i, i % 4 if i % 6 == 0 else i, bytearray(sketch(i).tobytes())) for i in range(60)]
    # the buckets of the first band are 0 to 2, those of the second 100 to 105
    known = spark.createDataFrame([(*r, [r[0] % 3, 100 + r[0] % 6]) for r in rows], "node long, label long, sketch binary, bands array<int>")
    live = spark.createDataFrame([(i, i % 3, 20) for i in range(60)] + [(i, 100 + i % 6, 10) for i in range(60)], "node long, bucket long, n int")
    got = {}
    for block in (3, 1000):
        got[block] = {(r.a, r.b) for r in near_dedup.bucket_pairs(live, known, block).collect()}
    bits = {i: np.unpackbits(np.frombuffer(bytes(b), np.uint8)) for i, _, b in rows}
    label = {i: x for i, x, _ in rows}
    apart = {(i, j): int((bits[i] != bits[j]).sum()) for i in bits for j in bits if i > j and i % 6 == j % 6 and label[i] != label[j]}
    most, few = [int((1 - (0.8 + x * near_dedup.BIT_SLACK)) / 2 * near_dedup.BITS) for x in (-1, 1)]
    unsure = {p for p, n in apart.items() if few < n <= most}
    sure = {tuple(sorted((label[i], label[j]))) for (i, j), n in apart.items() if n <= few}
    for pairs in got.values():
        assert unsure <= pairs and all(apart[p] <= most for p in pairs)
        assert {tuple(sorted((label[i], label[j]))) for i, j in pairs - unsure} == sure
    assert len(got[1000]) <= len(got[3])


def replaced(rng, base, count, pool):
    words = list(base)
    for k in rng.choice(len(base), count, replace=False):
        words[k] = f"n{rng.integers(pool)}"
    return words


def group(kind, n):
    """Texts of 150 words without their base: three words replaced in each, one to four, or a variant that a quarter shares and one odd text."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(150)]
    if kind == "three":
        return [" ".join(replaced(rng, base, 3, 10**6)) for _ in range(n)]
    if kind == "one to four":
        return [" ".join(replaced(rng, base, rng.integers(1, 5), 400)) for _ in range(n)]
    variant = replaced(rng, base, 4, 10**6)
    return [" ".join(replaced(rng, variant if i % 4 == 0 else base, 1, 10**6)) for i in range(n - 1)] + [" ".join(replaced(rng, base, 8, 10**6))]


@pytest.mark.parametrize("kind", ["three", "one to four", "variant"])
def test_pairs_follow_the_links_of_a_group(spark, monkeypatch, kind):
    """Pairs that are made and verified, beyond the links themselves, grow with a group or as its links do; classes are exact.

    With three words replaced in each, one pair in a thousand is a link and one in twenty-five is too near to tell by sketches.
    """
    seen = Counter()
    plain = near_dedup.written

    def counting(df, name="table", fewer=1):
        out = plain(df, name, fewer)
        seen[name] += out.count() if name in ("candidates", "close-pairs", "judged") else 0
        return out

    monkeypatch.setattr(near_dedup, "written", counting)
    made = {}
    for n in (400, 800, 1600):
        rows = list(enumerate(group(kind, n)))
        seen.clear()
        got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        every = {}
        for i, t in rows:
            for s in brute.shingles(t):
                every.setdefault(s, len(every))
        sets = np.zeros((n, len(every)), np.float32)
        for i, t in rows:
            sets[i, [every[s] for s in brute.shingles(t)]] = 1
        size, common = sets.sum(axis=1), sets @ sets.T
        a, b = np.nonzero(np.triu(5 * common >= 4 * (size[:, None] + size[None, :] - common), 1))
        label = np.arange(n)
        while True:
            low = label.copy()
            np.minimum.at(low, a, label[b])
            np.minimum.at(low, b, label[a])
            if (low == label).all():
                break
            label = low
        assert got == dict(enumerate(label.tolist()))
        made[n] = (seen["candidates"], seen["close-pairs"], len(a))
        # a node meets one pivot a band at most
        assert seen["candidates"] <= near_dedup.BANDS * n and seen["judged"] <= seen["candidates"] + seen["close-pairs"]
    for n in (400, 800):
        beyond = [max(0, made[x][1] - made[x][2]) for x in (n, 2 * n)]
        assert beyond[1] <= max(2.5 * beyond[0] + 200, beyond[0] * made[2 * n][2] / made[n][2]), made


def test_near_dedup_stage_of_repeated_ids(spark, documents):
    rows = [(1, "b text", {1: "x"}), (1, "a text", {2: "y"}), (2, None, None), (2, "", None), (3, "a text", {3: "z"}), (None, "a text", None), (None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, extra map<int,string>")
    got = near_dedup.near_dedup_stage(spark, frame, SF)
    assert got.columns == frame.columns
    assert sorted((r.doc_id or -1, r.text or "-", r.extra) for r in got.collect()) == [(-1, "-", None), (-1, "a text", None), (1, "a text", {2: "y"}), (2, "-", None)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 2 and 5


def test_token_counts(spark, documents, docs, empty, tokenizer):
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs.withColumn("n_tokens", F.lit("old"))).collect()}
    assert got == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in documents}
    assert token_counts.token_counts(empty).count() == 0


ODD = [
    "'s's''s 'r 're'd'll'l", "!'s !!'s THE's", "a" * 4000, "aé'" * 500, "x<|endoftext|>y<|startoftext|><|endoftext|>", "<|endoftext|>", "İΣς ΣΑΣ",
    "é é", "Ᲊ \U00010400", "१२३ ½ Ⅷ", "日本語、テキスト", "​ ﻿ \x85", "'", "''''", "퟿", "12345 1a2b", "don't I'LL we'Ve",
]


def test_odd_texts(tokenizer):
    source = open(tokenizer_files.default_path(), encoding="utf-8").read()
    want = tokenizer.encode_batch(ODD, add_special_tokens=False)
    assert token_counts.count_texts(ODD, source).tolist() == [len(e.ids) for e in want]
    for (ids, shown), e in zip(bpe_codec.codec(source).encode(ODD), want, strict=True):
        assert ids.tolist() == e.ids and shown.decode() == tokenizer.decode(e.ids, skip_special_tokens=False)


def test_transducer_chunks_and_reset(tokenizer):
    source = open(tokenizer_files.default_path(), encoding="utf-8").read()
    vocab, machine = token_counts.machine(source)
    from quillgraph.llm.word_symbols import pieces, symbols

    normal, owner, _ = pieces([*ODD, "ab" * 700 + " c"], vocab)
    stream, begins = symbols(normal)
    whole = machine.count(stream, begins, 1 << 20)
    for chunk in (1, 3, 64):
        assert machine.count(stream, begins, chunk).tolist() == whole.tolist()
    small = token_counts.CountingTransducer(vocab, max_states=10)
    assert [small.count(stream, begins).tolist() for _ in range(2)] == [whole.tolist()] * 2


def test_state_maps_compose():
    """Maps that fit together add up from the start of their piece; a chunk entered otherwise than left spoils what follows."""
    first = np.array([True, False, False, False, False, True, False])
    exits, tokens = np.array([3, 1, 4, 1, 5, 9, 2]), np.arange(1, 8)
    total, sound = token_counts.CountingTransducer.scan(np.array([0, 3, 1, 4, 1, 0, 9]), exits, tokens, first)
    assert total.tolist() == [1, 3, 6, 10, 15, 6, 13] and sound.all()
    _, sound = token_counts.CountingTransducer.scan(np.array([0, 3, 7, 4, 1, 0, 9]), exits, tokens, first)
    assert sound.tolist() == [True, True, False, False, False, True, True]


def test_long_words_of_any_kind(tokenizer, monkeypatch):
    rng = np.random.default_rng(8)
    source = open(tokenizer_files.default_path(), encoding="utf-8").read()
    texts = ["".join(rng.choice(list("abcdeinorst"), 3000)), "é" * 700 + "x", "".join(rng.choice(list("ab"), 2000)) + " c", "x" * 255 + "\n" + "y" * 257, ""]
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for look in (0, 3, 64):
        monkeypatch.setattr(token_counts, "LOOK", look)
        assert token_counts.count_texts(texts, source).tolist() == want


def test_token_count_rows(spark, documents, docs, tokenizer, tmp_path):
    rows = docs.union(docs).union(spark.createDataFrame([(None, "one two", None, None, None)], docs.schema))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = token_counts.op2_token_counts(spark, str(tmp_path)).collect()
    text = dict(documents) | {None: "one two"}
    assert len(got) == 2 * len(documents) + 1
    for r in got:
        n = len(tokenizer.encode(text[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text[r.doc_id] or "").encode()), n, n > 2048)
    assert any(r.over_limit for r in got)


def test_bpe_round_trip(spark, documents, docs, empty, tokenizer):
    both = bpe_codec.bpe_decode(bpe_codec.bpe_encode(docs))
    digests = {r.doc_id: r for r in bpe_codec.bpe_digests(docs).collect()}
    texts = dict(documents)
    for r in both.collect():
        want = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == tokenizer.decode(want, skip_special_tokens=False)
        d = digests[r.doc_id]
        assert d.n_tokens == len(want) and d.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and d.decoded_sha256 == brute.sha(r.decoded)
    assert bpe_codec.bpe_decode(bpe_codec.bpe_encode(empty)).count() == 0 and bpe_codec.bpe_digests(empty).count() == 0


# 3


def check_words(frame, documents):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in frame.collect()}
    assert got == brute.repeated_words(documents)


@pytest.mark.parametrize("batches, max_runs", [(1, 1), (3, 1), (4, 2)])
def test_repeated_words(documents, docs, batches, max_runs):
    check_words(substring_dedup.remove_repeats(docs.withColumn("kept", F.lit(1)), batches, max_runs=max_runs), documents)


def test_repeated_words_edges(spark, documents, empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
    twice = [(i, t) for i, t in documents] * 2 + [(None, documents[0][1])]
    got = substring_dedup.remove_repeats(spark.createDataFrame(twice, "doc_id long, text string")).collect()
    want = brute.repeated_words(documents)
    assert len(got) == len(twice) and all((r.n_words, r.n_removed, r.kept) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.n_removed for r in got if r.doc_id is None] == [120]


def test_index_is_kept_for_later_batches(spark, documents, tmp_path):
    """Add, close, open in a new index object, add again: as all at once, for documents that come by rising id."""
    schema, path = "doc_id long, text string", f"file://{tmp_path}/index"
    rows = sorted((i, t) for i, t in documents)
    parts = [rows[:8], rows[8:9], rows[9:15], rows[15:]]
    got, before = [], spark.createDataFrame([], schema)
    for part in parts:
        index = substring_dedup.FingerprintIndex(spark, path, max_runs=2, buckets=3)
        batch = spark.createDataFrame(part, schema)
        got += substring_dedup.remove_repeats_of_batch(index, batch, before).collect()
        index.close()
        before = before.union(batch)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == brute.repeated_words(documents)
    again = substring_dedup.FingerprintIndex(spark, path, buckets=99)
    assert again.buckets == 3 and len(again.runs) <= 3 and len(again.batches) == 4
    again.close()


def test_rows_are_merged_few_times():
    """However sizes are spread, runs stay few and geometric, and a row is written about log(batches) times, not once a batch."""
    rng = np.random.default_rng(5)
    k = 2000
    for sizes in ([100] * k, [100_000, *[100] * (k - 1)], [*[100] * (k - 1), 100_000], rng.integers(1, 1000, k).tolist(), (rng.pareto(1, k) * 10 + 1).astype(int).tolist(), [0] * k):
        runs, rewritten = [], 0
        for size in sizes:
            start = substring_dedup.first_to_merge(runs)
            if len(runs) - start > 1:
                runs[start:] = [sum(runs[start:])]
                rewritten += runs[-1]
            assert all(r > 2 * sum(runs[i + 1 :]) for i, r in enumerate(runs[:-1]))
            runs.append(size)
            assert len(runs) <= 2 + np.log2(1 + sum(sizes))
        assert rewritten <= sum(sizes) * (1 + np.log(1 + k * max(sizes) / max(1, min(sizes))) / np.log(1.5))
    assert substring_dedup.first_to_merge([]) == 0 and substring_dedup.first_to_merge([7]) == 0
    assert substring_dedup.first_to_merge([100, 10, 1]) == 2 and substring_dedup.first_to_merge([100, 1, 1]) == 1


def test_large_runs_stay(spark, tmp_path):
    """A run over twice as large as all later ones isn't written anew; sizes outlive the session."""
    path = f"file://{tmp_path}/index"
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(3000 if i == 0 else 100))) for i in range(5)]
    for i, text in docs:
        index = substring_dedup.FingerprintIndex(spark, path, buckets=3)
        frame = substring_dedup.keyed(spark.createDataFrame([(i, text)], "doc_id long, text string"))
        index.add(substring_dedup.window_units(frame, 50, 8))
        if i == 0:
            large = index.runs[0]
        index.close()
    again = substring_dedup.FingerprintIndex(spark, path)
    assert again.runs[0] == large and len(again.runs) in (3, 4) and len(again.batches) == 5
    assert list(again.rows) == again.runs and list(again.rows.values()) == [again.read(r).count() for r in again.runs]
    again.close()


def test_runs_merge_without_a_shuffle(spark, docs):
    index = substring_dedup.FingerprintIndex(spark, max_runs=5, buckets=3)
    units = substring_dedup.keyed(docs)
    for low, high in ((0, 8), (8, 13), (13, 99)):
        index.add(substring_dedup.window_units(units.where(F.col("d").between(low, high - 1)), 50, 8))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = index.lookup(index.runs[2], index.runs[0])._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    every = {a for run in index.runs for (a,) in index.read(run).select("anchor").collect()}
    index.compact()
    assert len(index.runs) == 1 and sorted(r.anchor for r in index.read(index.runs[0]).collect()) == sorted(every)
    index.close()


# 9


@pytest.mark.parametrize("options", [{}, {"block_bytes": 5000, "range_bytes": 9000}, {"block_bytes": 5000, "range_bytes": 5000, "hot_blocks": 0, "copies": 1}])
def test_repeated_bytes(documents, docs, options):
    out = suffix_dedup.remove_repeated_strings(docs.withColumn("kept", F.lit(1)), **options)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()}
    assert got == brute.repeated_bytes(documents)


def test_repeated_bytes_edges(spark, documents, empty):
    assert suffix_dedup.remove_repeated_strings(empty).count() == 0
    twice = [(i, t) for i, t in documents] * 2 + [(None, documents[0][1])]
    got = suffix_dedup.remove_repeated_strings(spark.createDataFrame(twice, "doc_id long, text string")).collect()
    want = brute.repeated_bytes(documents)
    assert len(got) == len(twice) and all((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.n_removed == r.n_bytes for r in got if r.doc_id is None)


def test_repeated_bytes_without_units(spark):
    short = [(i, x) for i, x in enumerate(["abc", "", None, "abc", "x" * 49])]
    out = suffix_dedup.remove_repeated_strings(spark.createDataFrame(short, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in out} == {i: (x, 0) for i, x in short}
    copies = [(i, "a text of which there are copies only, " * 2) for i in range(5)]
    for options in ({}, {"copies": 1, "block_bytes": 100, "range_bytes": 100}):
        out = suffix_dedup.remove_repeated_strings(spark.createDataFrame(copies, "doc_id long, text string"), **options).collect()
        assert sorted((r.doc_id, r.n_removed) for r in out) == [(i, 78 if i else 0) for i in range(5)]


def test_common_phrases_meet_part_by_part(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BLOCKS", 2)
    rng = np.random.default_rng(9)
    phrase = "a phrase of some sixty bytes which every one of the documents has"
    rows = [(int(i), " ".join(f"w{x}" for x in rng.integers(0, 10_000, 60)) + phrase + " ".join(f"v{x}" for x in rng.integers(0, 10_000, 40))) for i in rng.permutation(60)]
    out = suffix_dedup.remove_repeated_strings(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=1500, range_bytes=3000, hot_blocks=3)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()} == brute.repeated_bytes(rows)


@pytest.mark.parametrize("characters", [False, True])
def test_repeated_bytes_of_many_blocks_go_out_once(spark, characters):
    """With more blocks than a common phrase has, no table is made in between, texts are dealt out once, and common words aren't looked up window by window."""
    rng = np.random.default_rng(10)
    phrases = ["".join(chr(97 + x) for x in rng.integers(0, 26, 26)) for _ in range(1000)]
    line = "a line that every other one of these documents has, " * 2
    rows = [(i, " ".join(f"{phrases[rng.integers(0, 1000)]} w{x} w{x * 7 % 99991}" for x in rng.integers(0, 1_000_000, 300)) + line * (i % 2)) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).cache()
    docs.count()
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    jvm, none = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def run(hot_blocks: int) -> tuple[dict, int, int]:
        bus.waitUntilEmpty()
        known, mark = set(stages()), common.mark_shared()
        out = suffix_dedup.remove_repeated_strings(docs, block_bytes=1 << 17, range_bytes=1 << 18, hot_blocks=hot_blocks, characters=characters)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()}
        bus.waitUntilEmpty()
        return got, common.mark_shared() - mark, sum(n for k, n in stages().items() if k not in known)

    def stages() -> dict[int, int]:
        found = store.stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
        return {x.stageId(): x.shuffleWriteBytes() for x in (found.apply(i) for i in range(found.size()))}

    rare, tables, least = run(1000)
    got, made, shuffled = run(8)
    assert got == rare and made == tables and shuffled < 1.5 * least, (made, tables, shuffled, least)
    docs.unpersist()


def test_suffix_stage_carries_any_column(spark, documents):
    schema = "doc_id long, text string, n_chars int, kept timestamp, t map<int,string>, block decimal(30,3), d struct<x:array<double>>, range binary, copied date, many long"
    rows = [(i, t, 0, datetime(2020, 1, 2, 3, 4, 5, 678901 + i), {i: "v"}, Decimal("1.500"), ([1.5, None],), b"x", date(2020, 1, 1), None if i % 2 else 2**60 + i) for i, t in documents]
    frame = spark.createDataFrame(rows, schema)
    out = suffix_dedup.suffix_dedup_stage(spark, frame, SF)
    assert out.columns == frame.columns
    for r, want in zip(sorted(out.collect()), sorted(frame.collect()), strict=True):
        assert r.doc_id == want.doc_id and r[3:] == want[3:] and r.n_chars == (None if r.text is None else len(r.text))


def test_suffix_stage_keeps_characters(spark, documents, docs):
    out = {r.doc_id: r for r in suffix_dedup.suffix_dedup_stage(spark, docs, SF).collect()}
    assert set(out[0].asDict()) == set(docs.columns) and len(out) == len(documents)
    assert all(r.n_chars == len(r.text) for r in out.values()) and out[7].text == "" and out[0].text == documents[0][1]
    assert set(out[16].text) <= {"y", "é"}


def test_refine_buckets():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    begin = np.arange(0, 4000, 200)
    bucket = suffix_dedup.refine_buckets(data, begin, begin + 200, 12, 3)
    seen = {}
    for p in range(4000):
        if p % 200 <= 188:
            assert seen.setdefault(bucket[p], bytes(data[p : p + 12])) == bytes(data[p : p + 12])
        else:
            assert bucket[p] == -1
    assert len(seen) == len({bytes(data[p : p + 12]) for p in range(4000) if p % 200 <= 188})


# 4


def test_decontamination(spark, documents, docs, empty):
    text = dict(documents)
    words = text[1].split()
    items = [(1, " ".join(words[10:50])), (2, "one two three"), (3, " ".join([*words[60:85], "odd", *words[86:100]])), (4, ""), (5, None), (6, "la la la la la la la la"), (7, " ".join(words[:59]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contaminated(documents, [(i, t) for i, t in items if t])
    for size in (1 << 20, 300):
        out = decontamination.with_hits(docs.withColumn("hits", F.lit(1)), bench, max_bytes=size)
        got = {(r.doc_id, h.item_id) for r in out.collect() for h in r.hits}
        assert got == want and {(1, 1), (1, 7), (11, 2), (10, 6)} <= got
    assert decontamination.with_hits(empty, bench).count() == 0
    assert decontamination.with_hits(docs, bench.limit(0)).where(F.size("hits") > 0).count() == 0


def test_decontamination_folds_case_and_punctuation(spark):
    item = "Straße über la ción, qu'il a dit: x1 of the and (dé) no más que un solo paso."
    loud = " - ".join(item.upper().split()).replace("PASO", "PASO!!")
    rows = [(1, "one two " + loud + " three"), (2, item), (3, "nothing of it"), (4, "?! a ... b"), (5, None), (6, "w " * 700_000 + loud)]
    bench = spark.createDataFrame([(1, item), (2, "?! a"), (3, "... ?!"), (4, "?!")], "item_id long, text string")
    out = decontamination.with_hits(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    got = {(r.doc_id, h.item_id): (h.start, h.words, h.similarity) for r in out.collect() for h in r.hits}
    n = len(item.split())
    assert got.pop((1, 1)) == (2, 2 * n - 1, 1.0) and got.pop((2, 1)) == (0, n, 1.0) and got.pop((6, 1)) == (700_000, 2 * n - 1, 1.0)
    assert got.pop((4, 4)) == (0, 1, 1.0), "an item of punctuation is compared as it is"
    assert {k for k in got if k[1] != 2} == set() and got[4, 2] == (1, 1, 1.0)


def test_decontamination_of_texts_shorter_than_an_item(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(n, " ".join(words[:n])) for n in range(30, 42)] + [(50, " ".join(words[4:])), (51, " ".join(words[2:20] + ["odd"] + words[21:])), (52, "w0 w1"), (53, "v1 v2 v3")]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "v1 v2 v3 v4"), (3, " ".join(words[:38]))], "item_id long, text string")
    out = decontamination.with_hits(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    got = {(r.doc_id, h.item_id): (h.start, h.words, h.similarity) for r in out.collect() for h in r.hits}
    for n, text in rows:
        for k, item in ((1, words), (3, words[:38])):
            if len(text.split()) < len(item):
                a, b = brute.shingles(text), brute.shingles(" ".join(item))
                similar = sum((a & b).values()) / sum((a | b).values())
                assert got.get((n, k)) == ((0, len(text.split()), similar) if similar >= 0.8 else None), (n, k)
    assert got[37, 1] == (0, 37, 33 / 36) and (33, 1) in got and (32, 1) not in got and (53, 2) not in got


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(4)
    hashes = [rng.integers(0, 1 << 63, 20).astype(np.uint64) for _ in range(30)]
    hashes += [hashes[0], hashes[1]]
    index = decontamination.SizeIndex(20, list(range(32)), hashes)
    probes = np.concatenate([index.prints[:10], index.prints[:3]])
    for k in range(10):
        for bit in rng.choice(128, decontamination.RADIUS, replace=False):
            probes[k, bit // 32] ^= np.uint32(1) << np.uint32(bit % 32)
    window, item, distance = index.candidates(probes)
    apart = lambda i, j: sum(int(x ^ y).bit_count() for x, y in zip(probes[i], index.prints[j], strict=True))
    want = {(i, j): apart(i, j) for i in range(13) for j in range(32) if apart(i, j) <= decontamination.RADIUS}
    assert dict(zip(zip(window.tolist(), item.tolist(), strict=True), distance.tolist(), strict=True)) == want
    assert {(k, k) for k in range(13) if k < 10} | {(0, 30), (10, 30)} <= set(want)


def test_blocks_select_and_the_radius_holds():
    """Few unrelated items share a near block; at a similarity of 0.8 and a little more next to no pair is beyond the radius."""
    rng = np.random.default_rng(11)
    random_ = decontamination.fingerprints(rng.integers(0, 1 << 63, 4000).astype(np.uint64), 40)[::41]
    near = [(np.bitwise_count(x ^ y) <= decontamination.RADIUS // decontamination.BLOCKS).any() for i, x in enumerate(random_) for y in random_[:i]]
    assert np.mean(near) < 0.03
    for width in (9, 36, 90):
        apart = []
        for _ in range(1500):
            own = rng.integers(0, 1 << 63, width).astype(np.uint64)
            other = own.copy()
            k = width // 9  # similarity (width - k) / (width + k) = 0.8
            other[rng.choice(width, k, replace=False)] = rng.integers(0, 1 << 63, k).astype(np.uint64)
            a, b = decontamination.fingerprints(own, width)[0], decontamination.fingerprints(other, width)[0]
            apart.append(int(np.bitwise_count(a ^ b).sum()))
        assert np.mean(np.array(apart) <= decontamination.RADIUS) > 0.995, width


def test_lookups_follow_the_items_near(spark):
    """Pairs compared are a small share of windows x items at any number of items; all within SURE bits are found, and 99.9 % at 0.8."""
    rng = np.random.default_rng(12)
    hashes = [rng.integers(0, 1 << 63, 44).astype(np.uint64) for _ in range(10_000)]
    windows = decontamination.fingerprints(rng.integers(0, 1 << 63, 300 * 41).astype(np.uint64), 40)[::41]
    shares = []
    for n in (1000, 10_000):
        index = decontamination.SizeIndex(44, list(range(n)), hashes[:n])
        window, item = index.looked_up(windows)
        assert len(set(zip(window.tolist(), item.tolist(), strict=True))) == len(window)
        shares.append(len(window) / (len(windows) * n))
    assert max(shares) < 0.045 and shares[1] < 1.1 * shares[0]  # unrelated blocks: 3.3 %, and more as ties of even sizes are all 0

    def found(prints):
        """Whether window k finds item k, and at what distance it is."""
        window, item, _ = index.candidates(prints)
        hit = np.isin(np.arange(len(prints)), window[window == item])
        return hit, np.bitwise_count(prints ^ index.prints[: len(prints)]).sum(axis=1, dtype=int)

    flipped = index.prints[:1000].copy()
    for row in flipped:  # as far as the guarantee goes, three bits in all blocks but one
        last = int(rng.integers(16))
        for b in range(16):
            for bit in rng.choice(16, 3 - (b == last), replace=False).tolist():
                row.view(np.uint16)[b] ^= np.uint16(1 << bit)
    hit, apart = found(flipped)
    assert hit.all() and set(apart) == {decontamination.SURE}
    near = []
    for k in range(5000):
        other = index.shingles[k].copy()
        other[rng.choice(40, 4, replace=False)] = rng.integers(0, 1 << 63, 4).astype(np.uint64)
        near.append(decontamination.fingerprints(other, 40)[0])
    assert found(np.array(near))[0].mean() > 0.999


def test_decontamination_of_repeated_rows_and_clashing_names(spark, documents):
    item = " ".join(documents[1][1].split()[10:50])
    rows = [(1, documents[1][1], 1, {1: "a"}), (1, documents[1][1], 1, {1: "a"}), (None, documents[1][1], 2, None), (None, None, 3, None), (5, "x", 4, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _hits int, row map<int,string>")
    bench = spark.createDataFrame([(1, item), (1, item), (None, item)], "item_id long, text string")
    got = decontamination.with_hits(frame, bench)
    assert got.columns == [*frame.columns, "hits"]
    assert sorted((r["_hits"], len(r.hits) > 0) for r in got.collect()) == [(1, True), (1, True), (2, True), (3, False), (4, False)]
    stage = decontamination.decontamination_stage(spark, frame, SF)
    assert stage.columns == frame.columns and stage.count() == 5


# 6


def test_quality_rules_edges(spark, documents, docs, empty):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs.withColumn("lines", F.lit(1)), max_docs=1, min_left=0.5).collect()}
    assert len(got) == len(documents) and not got[4].kept and got[4].n_words == 0 and got[10].base_failed and got[10].n_repeat_words == 300
    # the shared line of 2 and 9 is on different hosts; 0 and 3 are no line copies
    assert got[2].n_left == got[2].n_words
    one_host = quality_rules.quality_rules(docs.withColumn("source", F.lit(None).cast("string")), max_docs=1, min_left=0.6).collect()
    left = {r.doc_id: r for r in one_host}
    assert left[2].n_left == 120 and left[2].kept and left[9].n_left == 120
    assert left[0].n_left == left[7].n_left == 0 and not left[7].kept, "copies are documents like any"
    cleaned = {r.doc_id: r.text for r in quality_rules.without_frequent_lines(docs.withColumn("source", F.lit(None).cast("string")), spark.createDataFrame(one_host)).collect()}
    assert set(cleaned) == {i for i, r in left.items() if r.kept} and all(len(t.split()) == left[i].n_left for i, t in cleaned.items())
    assert cleaned[2] == dict(documents)[2].split("\n")[0] and cleaned[17] == dict(documents)[17]
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_of_repeated_rows(spark, documents):
    text = documents[1][1] + "\nA line  of theirs\nlast"
    rows = [(1, text, "h", 1)] * 3 + [(None, text, "h", 1)] * 2 + [(2, text.upper(), "h", 1), (3, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int")
    got = quality_rules.quality_rules(frame, max_docs=2).collect()
    assert len(got) == 7 and all(r.n_left == (0 if r.n_words else r.n_words) for r in got), "ids 1 and 2 and the text without an id hold the lines"
    got = quality_rules.quality_rules(frame, max_docs=3)
    assert all(r.n_left == r.n_words for r in got.collect()) and got.where("kept").count() == 6
    kept = quality_rules.without_frequent_lines(frame, got)
    assert kept.columns == frame.columns and sorted(r.text for r in kept.collect()) == sorted(t for _, t, _, _ in rows if t)


def test_quality_rules_are_native(spark):
    plan = quality_rules.op6_quality_rules(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# 7


def test_quality_field(spark, documents, docs, empty):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    field = quality_crf.train_quality_field(table, labels)
    rows = quality_crf.score_quality(table, field).join(labels, "doc_id").where(quality_crf.held_out()).select("score", "predicted", "quality").collect()
    score, quality = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    good, bad = score[quality == 1], score[quality == 0]
    assert (good[:, None] > bad[None]).mean() > 0.97 and np.mean([(r.predicted == r.quality) for r in rows]) > 0.95
    out = quality_crf.score_quality(docs.withColumn("score", F.lit("old")), field).collect()
    assert len(out) == len(documents) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert quality_crf.score_quality(empty, field).count() == 0
    assert [r.held_out for r in spark.createDataFrame([(7,), (None,)], "doc_id long").select(quality_crf.held_out().alias("held_out")).collect()] == [zlib.crc32(b"7") % 5 == 0, True]


def test_quality_field_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_crf.score_quality(docs, quality_crf.train_quality_field(docs, none)).collect()} == {0.5}


def test_marginals_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    field = quality_crf.ChainField(rng.normal(size=3), rng.normal(size=(2, 2)))
    x, lines = rng.normal(size=(7, 3)), np.array([4, 0, 3])
    good, moved, total = field.marginals(x, lines)
    want, moves, at = [], np.zeros((2, 2)), 0
    for n in lines:
        weights = {}
        for y in product((0, 1), repeat=int(n)):
            s = sum(y[t] * (x[at + t] @ field.weights) for t in range(n)) + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False))
            weights[y] = np.exp(s)
        z = sum(weights.values())
        want += [sum(w for y, w in weights.items() if y[t]) / z for t in range(n)]
        for y, w in weights.items():
            for a, b in zip(y, y[1:], strict=False):
                moves[a, b] += w / z
        at += n
    assert np.allclose(good, want) and np.allclose(moved, moves)


def test_document_score_by_enumeration():
    """Whole texts: every labelling of a text's lines, marginals weighed by the lines' lengths, then the calibration."""
    from itertools import product

    rng = np.random.default_rng(4)
    field = quality_crf.ChainField(rng.normal(size=3 * quality_crf.N_OWN), rng.normal(size=(2, 2)), 3.0, -1.2)
    texts = ["A line of words.\n\n  \nBUY NOW!!! | $$$\nthe the the the", "one line only", "", " \n ", "x\n" * 5 + "é 日本 12"]
    got = field.scores(texts)
    for i, text in enumerate(texts):
        x, size, lines = quality_crf.line_features([text])
        assert lines[0] == sum(bool(line.strip()) for line in text.split("\n")) and size.tolist() == [len(line) for line in text.split("\n") if line.strip()]
        weights = {}
        for y in product((0, 1), repeat=int(lines[0])):
            weights[y] = np.exp(sum(y[t] * (x[t] @ field.weights) for t in range(len(y))) + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False)))
        z = sum(weights.values())
        good = [sum(w for y, w in weights.items() if y[t]) / z for t in range(int(lines[0]))]
        evidence = (size @ np.array(good)) / size.sum() if len(size) else 0.5
        assert abs(got[i] - 1 / (1 + np.exp(-(3.0 * evidence - 1.2)))) < 1e-9


def test_queries_of_repeated_rows_and_null_ids(spark, documents, docs, tokenizer, tmp_path):
    """op5 and op7 give a row for each row, those that repeat the same one, those without an id too."""
    rows = docs.union(docs).union(spark.createDataFrame([(None, "one two\nthree", None, None, None), (None, None, None, None, None)], docs.schema))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i, _ in documents] * 2 + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality_crf.op7_quality_crf(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter({i: 2 for i, _ in documents} | {None: 2})
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got) and len({(r.doc_id, r.score) for r in got}) == len(documents) + 2
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    text = dict(documents)
    coded = bpe_codec.op5_bpe_codec(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in coded) == Counter(r.doc_id for r in got)
    for r in coded:
        if r.doc_id is not None:
            ids = tokenizer.encode(text[r.doc_id] or "", add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert r.decoded_sha256 == brute.sha(tokenizer.decode(ids, skip_special_tokens=False))


# 8


def test_shards(spark, documents, docs, empty):
    many = docs.union(docs).union(docs).repartition(5).withColumn("shard", F.lit(1))
    rows = sharding.shuffle_to_shards(many, 4, block=5).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 3 * len(documents) and set(sizes) == {0, 1, 2, 3} and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert Counter(r.doc_id for r in rows) == Counter({i: 3 for i, _ in documents})
    assert sharding.shuffle_to_shards(empty).count() == 0


def test_matrix_is_uniform():
    rows, total = np.array([3, 0, 5, 2]), np.zeros((4, 3))
    for seed in range(3000):
        m = sharding.communication_matrix(rows, 3, seed)
        assert m.sum(1).tolist() == rows.tolist() and sorted(m.sum(0).tolist()) == [3, 3, 4]
        total += m
    assert np.abs(total / 3000 - rows[:, None] / 3).max() < 0.1


def test_draw_from_large_populations():
    rng = np.random.default_rng(5)
    cases = [(10**9, 10**9, 10**9), (2 * 10**9, 6 * 10**9, 7 * 10**9), (3 * 10**9, 40, 2 * 10**9), (50, 2 * 10**9, 10**8), (6 * 10**11, 9 * 10**12, 2 * 10**9), (10**13, 10**13, 3)]
    for good, bad, n in cases:
        got = np.array([sharding.draw(rng, good, bad, n) for _ in range(1200)], float)
        total = good + bad
        want = n * (good / total) * (bad / total) * ((total - n) / (total - 1))
        assert got.min() >= max(0, n - bad) and got.max() <= min(good, n)
        assert abs(got.mean() - n * (good / total)) < 5 * (want / 1200) ** 0.5 and 0.8 < got.var() / want < 1.25, (good, bad, n)
    assert sharding.draw(rng, 2 * 10**9, 5, 2 * 10**9 + 5) == 2 * 10**9 and sharding.draw(rng, 2 * 10**9, 0, 7) == 7
    assert abs(float(sharding.log_factorial(100)) - sum(np.log(np.arange(1, 101)))) < 1e-9


def test_large_draws_follow_the_law(monkeypatch):
    """The sampler for large populations, on small ones, against the exact chances."""
    from math import comb

    class NoSmall:
        def __init__(self, rng):
            self.random = rng.random

        def hypergeometric(self, good, bad, n):
            raise AssertionError

    source = inspect.getsource(sharding.draw).replace("1_000_000_000", "0")
    space = dict(vars(sharding))
    exec(source, space)  # noqa: S102
    rng = NoSmall(np.random.default_rng(6))
    for good, bad, n in ((7, 9, 6), (30, 5, 20), (3, 200, 50)):
        got = Counter(space["draw"](rng, good, bad, n) for _ in range(6000))
        for k in range(max(0, n - bad), min(good, n) + 1):
            p = comb(good, k) * comb(bad, n - k) / comb(good + bad, n)
            assert abs(got[k] - 6000 * p) < 5 * (6000 * p * (1 - p)) ** 0.5 + 1, (good, bad, n, k)


def test_shard_rows(spark, documents, docs, tmp_path):
    rows = docs.union(docs).union(spark.createDataFrame([(None, None, None, None, None)] * 2, docs.schema))
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op8_sharding(spark, str(tmp_path)).collect()
    text = {i: (t or "").encode() for i, t in documents} | {None: b""}
    assert Counter(r.doc_id for r in got) == Counter({i: 2 for i in text})
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "rows", None)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_shards_keep_clashing_columns(spark):
    frame = spark.createDataFrame([(i, i, str(i), None, i) for i in range(50)], "_p long, _key long, _rank string, _block int, row long").repartition(4)
    got = sharding.shuffle_to_shards(frame, 3)
    assert got.columns == [*frame.columns, "shard", "slot"] and sorted(tuple(r)[:5] for r in got.collect()) == sorted(tuple(r) for r in frame.collect())


# 10


def test_archives_come_in_parts():
    records = [f"{warc.VERSION}\r\nContent-Length: {n}\r\nA: b\r\n\r\n{'x' * n}\r\n\r\n".encode() for n in (0, 5, 300)]
    members = gzip.compress(records[0] + records[1]) + gzip.compress(records[2])
    for size in (1, 7, 1 << 20):
        assert [(h["content-length"], len(b)) for h, b in warc.parse_archive(warc.unzipped(members, size))] == [("0", 0), ("5", 5), ("300", 300)]
    assert list(warc.parse_archive(warc.unzipped(b""))) == []
    with pytest.raises(ValueError):
        list(warc.parse_archive([records[2][:200]]))


def test_payloads_are_not_shuffled(spark):
    """Few revisits: what holds a payload goes from the scan to the writer."""
    records = warc.warc_records(spark.read.parquet(f"{SF}/pages.parquet"))
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "body" in plan and "Exchange hashpartitioning" not in plan


def test_warc_joins_many_revisits(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", "p" * 100 + str(i % 3)) for i in range(20)] + [(None, "u", "p" * 100 + "0")] * 2, "page_id long, url string, html string")
    monkeypatch.setattr(warc, "SENT_ROWS", 0)
    records = warc.warc_records(pages)
    kinds = Counter(r.value.split("\r\n")[1] for r in records.collect())
    assert kinds == {"WARC-Type: response": 3, "WARC-Type: revisit": 19}


def test_warc(spark, tmp_path, monkeypatch):
    big, trick = "p" * 100, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 4
    rows = [(3, "u\r\nX: y", big), (1, None, big), (2, "u", "small"), (9, "u", "small"), (4, "u", None), (5, "u", trick), (6, "u", trick), (1, "u", big), (7, "é", "é" * 50), (8, "u", "é" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages, path, records_per_file=3)
    monkeypatch.setattr(warc, "BATCH_BYTES", 300)
    got = warc.with_originals(warc.read_archives(spark, path)).collect()
    assert len(got) == len(rows)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter(
        {(1, "response", None): 2, (3, "revisit", 1): 1, (2, "response", None): 1, (9, "response", None): 1, (4, "response", None): 1, (5, "response", None): 1}
        | {(6, "revisit", 5): 1, (7, "response", None): 1, (8, "revisit", 7): 1}
    )
    html = {i: t or "" for i, _, t in rows}
    assert all(r.payload == html[r.page_id] and r.payload_bytes == len(r.payload.encode()) and r.payload_digest == brute.sha(r.payload) for r in got)
    none = f"file://{tmp_path}/none"
    warc.write_archives(pages.limit(0), none)
    assert warc.read_archives(spark, none).count() == 0


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    """Small records in one partition, large ones in another, one larger than a file: the mean size says little."""
    pages = spark.createDataFrame([(i, "u", f"{i:05d}" + "x" * 95) for i in range(2000)], "page_id long, url string, html string").coalesce(1)
    large = spark.createDataFrame([(5000 + i, "u", f"{i}" + "y" * n) for i, n in enumerate([30_000] * 60 + [300_000] + [30_000] * 5)], pages.schema).coalesce(1)
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages.union(large), path, file_bytes=200_000, records_per_file=300)
    sizes, counts = [], []
    for file in tmp_path.glob("warc/**/*.txt.gz"):
        data = gzip.decompress(file.read_bytes())
        counts.append(sum(1 for _ in warc.parse_archive([data])))
        if counts[-1] > 1:
            sizes.append(len(data))
    assert sum(counts) == 2066 and max(counts) <= 300
    assert max(sizes) <= 200_000 and sum(s > 100_000 for s in sizes) >= len(sizes) - 3
    got = warc.read_archives(spark, path)
    assert sorted(r.page_id for r in got.collect()) == [*range(2000), *range(5000, 5066)]


def test_responses_stay_where_they_are(spark):
    """Only revisits and what they refer to are joined, so responses, which refer to nothing, aren't gathered in one partition."""
    rows = [("a", 1, "response", "u", None, None, "d", 3, "xyz"), ("a", 1, "response", "u", None, None, "d", 3, "xyz")]
    rows += [("b", 2, "revisit", "u", "a", 1, "d", None, None), ("c", 3, "revisit", "u", "gone", 9, "e", None, None), ("f", 4, "response", "u", None, None, "g", 0, "")]
    got = warc.with_originals(spark.createDataFrame(rows, warc.READ_SCHEMA))
    assert got.columns == [c.split()[0] for c in warc.READ_SCHEMA.split(", ")]
    assert Counter((r.record_id, r.payload_bytes, r.payload) for r in got.collect()) == Counter(
        [("a", 3, "xyz")] * 2 + [("b", 3, "xyz"), ("c", None, None), ("f", 0, "")]
    )
    assert got._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
