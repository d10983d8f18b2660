"""Plain forms of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def repeated_words(docs: list[tuple[int, str | None]], window: int = 50) -> dict[int, tuple[int, int, str]]:
    words = {i: WORD.findall(t or "") for i, t in docs}
    first: dict[tuple, int] = {}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        lost = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                lost |= set(range(k, k + window))
        out[i] = (len(w), len(lost), " ".join(x for k, x in enumerate(w) if k not in lost))
    return out


def repeated_bytes(docs: list[tuple[int, str | None]], window: int = 50) -> dict[int, tuple[int, int, int, bytes]]:
    data = {i: (t or "").encode() for i, t in docs}
    first: dict[bytes, int] = {}
    for i, b in data.items():
        for k in range(len(b) - window + 1):
            first[b[k : k + window]] = min(first.get(b[k : k + window], i), i)
    out = {}
    for i, b in data.items():
        lost = [False] * len(b)
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < i:
                lost[k : k + window] = [True] * window
        spans = sum(x and not y for x, y in zip(lost, [False, *lost], strict=False))
        out[i] = (len(b), sum(lost), spans, bytes(c for c, x in zip(b, lost, strict=True) if not x))
    return out


def shingles(text: str | None, size: int = 5) -> Counter:
    w = WORD.findall(text or "")
    if len(w) < size:
        return Counter([tuple(w)]) if w else Counter()
    return Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def probability_jaccard(x: Counter, y: Counter) -> float:
    every = set(x) | set(y)
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in every) for d in set(x) & set(y))


def classes(docs: list[tuple[int, str | None]]) -> dict[int, int]:
    label = {i: i for i, _ in docs}
    text = {i: t or "" for i, t in docs}
    sets = {i: shingles(t) for i, t in docs}
    changed = True
    pairs = [(a, b) for a in label for b in label if a < b and (text[a] == text[b] or probability_jaccard(sets[a], sets[b]) >= 0.8)]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def contaminated(docs: list[tuple[int, str | None]], items: list[tuple[int, str]], threshold: float = 0.8) -> set[tuple[int, int]]:
    out = set()
    for i, t in docs:
        w = WORD.findall(t or "")
        for k, text in items:
            n = len(WORD.findall(text))
            want = shingles(text)
            for a in range(len(w) - n + 1 if n else 0):
                got = shingles(" ".join(w[a : a + n]))
                if sum((got & want).values()) >= threshold * sum((got | want).values()):
                    out.add((i, k))
    return out
