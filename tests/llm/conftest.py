"""Documents with every awkward case."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "la", "über", "ción", "x1", "of", "dé", "a", "qu'il", "and"]) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="session")
def documents():
    """Copies, near copies, shared passages, ties, nulls, blanks, a long text, a text that repeats itself."""
    rng = random.Random(5)
    base = [sentence(rng, 120) for _ in range(6)]
    words = base[0].split()
    near = list(words)
    near[40] = "changed"
    shared = sentence(rng, 55)
    rows = [
        (0, base[0]),
        (1, base[1]),
        (7, base[0]),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (2, base[2] + "\n" + shared),
        (9, shared + "\n" + base[3]),
        (8, sentence(rng, 20) + " " + shared + " " + sentence(rng, 30)),
        (11, "one two three"),
        (12, "one two three"),
        (13, "one two four"),
        (10, "la " * 300),
        (14, "la " * 200 + "end"),
        (15, "x" * 3000 + "é" * 40),
        (16, "y" * 10 + "é" * 60),
        (17, sentence(rng, 6000)),
        (18, base[4] + "<|endoftext|>" + base[5]),
        (19, base[4]),
        (20, "a\x00b\x0bc\x85d e " + "日本" * 30),
    ]
    return rows


@pytest.fixture()
def docs(spark, documents):
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in documents], SCHEMA)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer_file():
    from tokenizers import Tokenizer

    from quillgraph.llm.tokenizer_files import default_path

    return Tokenizer.from_file(default_path())
