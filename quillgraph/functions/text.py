"""Column functions on note text: tokens, links, titles, types, chunks."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = ("tool", "concept", "index", "codebase", "codeUnit", "codeSymbol", "codeModule")
TIERS = ("1", "2", "3")


def strip(c: Column) -> Column:
    """Without white space at either end (Spark's ``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def normalize_token(c: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_|_$", "")


def tokens(c: Column) -> Column:
    """Distinct normalized words, in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(c), r"\s+"), normalize_token), lambda x: x != ""))


def tag_list(c: Column) -> Column:
    """Distinct normalized tags of an array of strings."""
    return F.array_distinct(F.filter(F.transform(c, normalize_token), lambda x: x != ""))


def wikilinks(c: Column) -> Column:
    """Distinct targets of ``[[target]]`` and ``[[target|alias]]``, in order."""
    found = F.regexp_extract_all(c, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), 1)
    return F.array_distinct(F.filter(F.transform(found, strip), lambda x: x != ""))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def dir_name(path: Column) -> Column:
    """The folder of a path; '.' at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def stem(path: Column) -> Column:
    """Last segment without its last extension."""
    return F.regexp_replace(base_name(path), r"^(.+)\.[^.]*$", "$1")


def title(front: Column, body: Column, path: Column) -> Column:
    """The title field, else the first level-one heading, else the stem in words."""
    heading = blank_to_null(F.regexp_extract(body, r"(?m)^# +(.+)$", 1))
    return F.coalesce(blank_to_null(front), heading, F.initcap(F.translate(stem(path), "-_", "  ")))


def note_type(front: Column, path: Column) -> Column:
    """A known type name (any case), else by folder, else by name."""
    known = reduce(lambda acc, t: acc.when(F.lower(strip(front)) == t.lower(), F.lit(t)), TYPES[1:], F.when(F.lower(strip(front)) == TYPES[0], F.lit(TYPES[0])))
    by_path = (
        F.when(path.startswith("tools/"), "tool").when(path.startswith("concepts/"), "concept").when(F.lower(stem(path)) == "index", "index").otherwise("concept")
    )
    return F.coalesce(known, by_path)


def split_front(text: Column) -> tuple[Column, Column]:
    """Frontmatter lines (empty if there is no closed block) and the body, left-stripped."""
    pattern = r"(?s)\A[ \t]*---[ \t]*\r?\n(.*?)(?:^|(?<=\n))[ \t]*---[ \t]*(?:\r?\n(.*))?\z"
    has = text.rlike(pattern)
    body = F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(text)
    return F.when(has, F.regexp_extract(text, pattern, 1)).otherwise(""), F.regexp_replace(body, r"^\s+", "")


def front_field(front: Column, key: str) -> Column:
    """The inline value of one key of the frontmatter; null if it is missing or blank."""
    return blank_to_null(F.regexp_extract(front, rf"(?m)^{key}[ \t]*:[ \t]*(.*)$", 1))


def front_list(front: Column, key: str) -> Column:
    """The ``- item`` lines (indented) below a key, or its inline value split at commas."""
    block = F.regexp_extract(front, rf"(?m)^{key}[ \t]*:[ \t]*\r?\n((?:(?:  |\t)[ \t]*- .*(?:\r?\n|\z))+)", 1)
    items = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]+- (.*)$"), 1), strip)
    inline = F.split(F.regexp_replace(F.coalesce(front_field(front, key), F.lit("")), r"^\[|\]$", ""), ",")
    return F.when(block != "", items).otherwise(F.filter(F.transform(inline, strip), lambda x: x != ""))


def front_fields(text: str) -> dict:
    """All keys of a frontmatter: a text, a list of ``- item`` lines, or a dict of ``key: value`` lines below the key.

    Lines below a key are indented by two spaces or a tab; a list wins over a dict, and neither is null.  Blank lines and
    those that begin with # count for nothing, nor do lines at the edge without a key before a colon.
    """
    out: dict = {}
    key = None
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        if line.startswith(("  ", "\t")):
            if key is None:
                continue
            held = out[key]
            name, colon, value = bare.partition(":")
            if bare.startswith("- "):
                out[key] = [*(held if isinstance(held, list) else []), bare[2:].strip()]
            elif colon and name.strip() and not isinstance(held, list):
                out[key] = (held or {}) | {name.strip(): value.strip()}
            continue
        name, colon, value = line.partition(":")
        key = None
        if colon and name.strip():
            out[name.strip()] = value.strip() or None
            key = None if value.strip() else name.strip()
    return out


def front_variant(front: Column) -> Column:
    """All of a frontmatter (``front_fields``) as one VARIANT, for ``variant_get`` and the like; null stays null."""

    @F.pandas_udf("string")
    def read(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else json.dumps(front_fields(t), ensure_ascii=False))

    return F.parse_json(read(front))


def chunks(text: Column, size: int = 1536, overlap: int = 200) -> Column:
    """Overlapping windows of ``size`` characters as (chunk_index, text) structs; one for a short text."""
    if size <= overlap:
        raise ValueError("a chunk must be longer than the overlap")
    n = F.length(text)
    many = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)),
        lambda s, i: F.struct(i.alias("chunk_index"), F.substring(text, s + 1, F.lit(size)).alias("text")),
    )
    return F.when(n <= size, F.array(F.struct(F.lit(0).alias("chunk_index"), text.alias("text")))).otherwise(many)


def excerpt(text: Column, size: int = 1200) -> Column:
    whole = strip(text)
    cut = F.concat(F.regexp_replace(F.substring(whole, 1, size), r"\s+$", ""), F.lit("\n..."))
    return F.when(F.length(whole) <= size, whole).otherwise(cut)


def build_front(fields: dict[str, Column], lists: dict[str, Column] | None = None) -> Column:
    """A frontmatter block: a line for each field, then lists as indented items; null ones are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields.items()]
    for k, v in (lists or {}).items():
        items = F.array_join(F.transform(v, lambda x: F.concat(F.lit("\n    - "), x)), "")
        lines.append(F.when(F.size(v) > 0, F.concat(F.lit(f"{k}:"), items)))
    return F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n---\n"))
