"""From text to the base symbols of a word-level BPE vocabulary (lower case, word ends marked, white space dropped).

A base symbol is ``byte`` inside a word and ``byte + 256`` at its end.  Both token operators (counting by transducer,
encoding by pair index) start from the same symbol stream, cut into *pieces*: the stretches of a text between the
special strings of the vocabulary, which become ids of their own.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@dataclass
class Vocabulary:
    """Merges and ids of one tokenizer file; ``tokens[i]`` is the string of id ``i``."""

    tokens: list[str]
    base_ids: list[int]
    #: symbols 0..511 are base symbols, 512 + rank is what merge ``rank`` makes
    merge: dict[tuple[int, int], int]
    symbol_ids: list[int]
    specials: dict[str, int]
    normalizer: object = field(repr=False)
    special_pattern: re.Pattern | None = None


def byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


@lru_cache(maxsize=2)
def load_vocabulary(source: str) -> Vocabulary:
    """``source``: the tokenizer file's JSON text."""
    from tokenizers import Tokenizer

    spec = json.loads(source)
    vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
    chars = byte_characters()
    names = chars + [c + end for c in chars]
    symbol_of = {name: i for i, name in enumerate(names)}
    merge: dict[tuple[int, int], int] = {}
    symbol_ids = [vocab[n] for n in names]
    for rank, (a, b) in enumerate(spec["model"]["merges"]):
        merge[symbol_of[a], symbol_of[b]] = 512 + rank
        symbol_of[a + b] = 512 + rank
        symbol_ids.append(vocab[a + b])
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (max([*vocab.values(), *specials.values()]) + 1)
    for name, i in [*vocab.items(), *specials.items()]:
        tokens[i] = name
    pattern = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
    return Vocabulary(tokens, symbol_ids[:512], merge, symbol_ids, specials, Tokenizer.from_str(source).normalizer, pattern)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point: white space, letter, number, other, or unknown to Python's Unicode tables."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.empty(0x110000, np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        out[c] = UNKNOWN if category == "Cn" else kinds.get(category[0], OTHER)
    out[_WHITE] = SPACE
    return out


def classes_of(points: np.ndarray) -> np.ndarray:
    """Classes of code points; those that Python's tables lack are asked of the tokenizer library's newer ones."""
    known = character_classes()
    kind = known[points]
    if (kind == UNKNOWN).any():
        from tokenizers import Regex, pre_tokenizers

        split = pre_tokenizers.Split(Regex(r"\p{L}+|\p{N}|[^\p{L}\p{N}]+"), "removed", invert=True)
        for c in np.unique(points[kind == UNKNOWN]).tolist():
            parts = len(split.pre_tokenize_str(f"a{chr(c)}{chr(c)}"))
            known[c] = {1: LETTER, 2: OTHER, 3: NUMBER}[parts]
        kind = known[points]
    return kind


def normalise(text: str, vocab: Vocabulary) -> str:
    if text.isascii():
        return text.lower()
    if max(text) < "ɐ" and unicodedata.is_normalized("NFC", text):
        return text.lower()
    return vocab.normalizer.normalize_str(text)


def pieces(texts: list[str], vocab: Vocabulary) -> tuple[list[str], np.ndarray, list[int]]:
    """Normalised pieces, the text each belongs to, and the special id that follows each piece (-1: none)."""
    out: list[str] = []
    owner: list[int] = []
    after: list[int] = []
    for i, text in enumerate(texts):
        if vocab.special_pattern is not None and "<" in text and vocab.special_pattern.search(text):
            parts = vocab.special_pattern.split(text)
        else:
            parts = [text]
        for k in range(0, len(parts), 2):
            out.append(normalise(parts[k], vocab))
            owner.append(i)
            after.append(vocab.specials[parts[k + 1]] if k + 1 < len(parts) else -1)
    return out, np.asarray(owner, np.int64), after


def symbols(normal: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The base symbols of all pieces in one array, and where each piece begins in it (one more entry than pieces)."""
    joined = "\n".join(normal) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = classes_of(points)
    begins = np.cumsum([0] + [len(s) + 1 for s in normal])
    n = len(points)
    before = np.empty(n, np.uint8)
    before[0], before[1:] = SPACE, kind[:-1]
    start = (kind != before) | (kind == NUMBER)
    # contractions: an apostrophe that no run of other characters has swallowed
    at = np.flatnonzero((points == 39) & (before != OTHER))
    if len(at):
        ends = np.append(points, [10, 10, 10])
        one, two = ends[at + 1], ends[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        for hit, size in ((at[short], 2), (at[long], 3)):
            start[hit] = True
            for k in range(1, size):
                start[hit + k] = False
            start[hit[hit + size < n] + size] = True
    last = np.empty(n, bool)
    last[:-1] = start[1:] | (kind[1:] == SPACE)
    last[-1] = True
    data = np.frombuffer(joined.encode("utf-8"), np.uint8)
    if len(data) == n:
        kept = kind != SPACE
        out = data.astype(np.int32) + 256 * last
        position = np.concatenate([[0], np.cumsum(kept)])
        return out[kept], position[begins]
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    stop = np.cumsum(width)
    out = data.astype(np.int32)
    out[stop[last] - 1] += 256
    kept = np.repeat(kind != SPACE, width)
    position = np.concatenate([[0], np.cumsum(kept)])
    return out[kept], position[np.concatenate([[0], stop])[begins]]
