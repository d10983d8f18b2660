"""Token ids of whole texts by a byte-level BPE file, for operators that need ids but aren't about making them."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

BYTE_BPE = "byte_bpe_50k.json"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """Ids as the tokenizers library gives them, without begin, end or padding; special strings in a text are their tokens.

    Where the file's merges stand in the order of what they make (as in byte_bpe_50k.json), the same ids come from
    tiktoken, which takes a sixth of the time; the tests hold both against each other.  Other files go to the library.
    """

    def __init__(self, source: str):
        parsed = json.loads(source)
        model, letters = parsed["model"], byte_letters()
        special = {t["content"]: t["id"] for t in parsed.get("added_tokens") or []}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        merges = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        splitter = parsed.get("pre_tokenizer") or {}
        usual = splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
        plain = all(not t.get(k) for t in parsed.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        ordered = None not in merges and all(a < b for a, b in zip(merges, merges[1:], strict=False)) and all(set(t) <= letters.keys() for t in vocab)
        if usual and plain and ordered and not parsed.get("normalizer") and not model.get("ignore_merges"):
            import tiktoken
            from public_tokenizers import PATTERN

            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
            self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        else:
            from tokenizers import Tokenizer

            self.fast, self.library = None, Tokenizer.from_str(source)
            self.library.no_truncation()
            self.library.no_padding()

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=1)
def byte_tokens(source: str) -> ByteTokens:
    """The worker's tokenizer; one file at a time."""
    return ByteTokens(source)
