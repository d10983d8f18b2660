"""Where tokenizer files are; their text goes to the tasks as a broadcast of a few megabytes at most."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import SparkSession

WORD_BPE = "word_bpe_49k.json"
#: A tokenizer file above this is refused: it would be sent to every executor.
MAX_BYTES = 64 << 20


def default_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_source(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The tokenizer file at ``path`` (the driver's own file system), broadcast."""
    with open(path or default_path(), encoding="utf-8") as f:
        source = f.read(MAX_BYTES + 1)
    if len(source) > MAX_BYTES:
        raise ValueError(f"tokenizer file above {MAX_BYTES} characters")
    return spark.sparkContext.broadcast(source)
