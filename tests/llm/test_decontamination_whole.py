"""Operator 4 leaves out no similar pair, however far apart the fingerprints are: against all windows and items."""

from __future__ import annotations

from collections import Counter

import numpy as np

from quillgraph.llm import decontamination


def brute(text: list[str], item: list[str]) -> tuple[int, int, float] | None:
    """First word, words and similarity of the first of the most similar windows; None under 0.8."""
    gram, n = min(5, len(item)), min(len(item), len(text))
    grams = lambda words: Counter(tuple(words[i : i + gram]) for i in range(len(words) - gram + 1))
    own, best = grams(item), None
    for i in range(len(text) - n + 1):
        other = grams(text[i : i + n])
        similar = (own & other).total() / max(1, (own | other).total())
        if similar >= 0.8 and (best is None or similar > best[2]):
            best = i, n, similar
    return best


def found(texts: list[list[str]], items: list[list[str]]) -> dict[tuple[int, int], tuple[int, int, float]]:
    joined = [" ".join(t) for t in texts]
    hits = decontamination.Benchmark([(i, " ".join(x)) for i, x in enumerate(items)]).find(joined, [t.encode() for t in joined])
    return {(t, item): (start, words, similar) for t, some in hits.items() for item, start, words, _, similar in some}


def test_repeated_shingles_set_similar_windows_far_apart():
    """320 shingles in common, and 36 times one shingle against 36 times another: alike by 0.8, fingerprints far apart."""
    common = [f"w{i}" for i in range(324)]
    item, other = common + ["na"] * 40, common + ["la"] * 40
    assert found([["before"] * 7 + other + ["after"]], [item]) == {(0, 0): brute(["before"] * 7 + other + ["after"], item)} != {(0, 0): None}


def test_every_similar_pair_is_found():
    rng = np.random.default_rng(4)
    texts, items = [], []
    for k in range(150):
        words = int(rng.choice([1, 3, 5, 6, 9, 14, 30, 90]))
        item = [f"v{x}" for x in rng.integers(0, int(rng.choice([2, 4, 400])), words)]
        text = list(item)
        for _ in range(int(rng.integers(0, 1 + words // 12))):  # words changed, put in and repeated
            at = int(rng.integers(0, words))
            text[at : at + 1] = [f"u{k}"] * int(rng.integers(0, 4))
        around = [f"v{x}" for x in rng.integers(0, 6, int(rng.integers(0, 40)))]
        items.append(item)
        texts.append(around + text + around[::-1] if k % 3 else text)
    want = {(t, i): hit for t, text in enumerate(texts) for i, item in enumerate(items) if (hit := brute(text, item))}
    assert len(want) > 150 and found(texts, items) == want
