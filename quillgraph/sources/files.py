"""File sources: notes, source code, snapshots of both, registries and event logs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce
from operator import or_

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that aren't entered, languages and what they leave out.
IGNORED_DIRS = (".obsidian", "node_modules", ".venv", "__pycache__")

#: Languages: file pattern and what is left out by default (``*.x``: a suffix, else a path segment).
LANGUAGES: dict[str, tuple[str, list[str]]] = {
    "ts": ("*.ts", ["dist", "node_modules", "_legacy", ".claude", "*.d.ts"]),
    "py": ("*.py", ["__pycache__", "*.pyi", ".venv", "env", "venv", "dist", "node_modules"]),
    "c": ("*.c", ["build", "dist", "out", "cmake-build-debug", "cmake-build-release", "node_modules", ".git"]),
}


FILES = "rel_path string, mtime timestamp, size long"
#: Folders from which on the tasks list the rest of a tree.
DEALT_OUT = 64


def file_system(root: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a root: a local path, a file: path as it is, or a URI that Arrow can open."""
    if (m := re.match("^file:/*(/.*)$", root)) or root.startswith("/"):
        return pafs.LocalFileSystem(), (m[1] if m else root).rstrip("/") or "/"
    fs, path = pafs.FileSystem.from_uri(root)
    return fs, path.rstrip("/")


def listed(fs: pafs.FileSystem, folder: str, pattern: str, pruned: tuple[str, ...]) -> tuple[list[str], list[pafs.FileInfo]]:
    """Folders to go on with and matching files right in a folder."""
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    folders = [x.path for x in found if x.type == pafs.FileType.Directory and x.base_name not in pruned]
    return folders, [x for x in found if x.type == pafs.FileType.File and fnmatchcase(x.base_name, pattern)]


def file_list(spark: SparkSession, root: str, pattern: str, pruned: tuple[str, ...] = IGNORED_DIRS) -> DataFrame:
    """``rel_path``, ``mtime``, ``size`` of every file of a pattern below ``root``; ``pruned`` folders aren't entered.

    Spark's own file sources skip names that begin with an underscore and encode others, so trees of notes and sources
    are listed by Arrow's file systems, which the executors must reach too: the upper folders here, the trees below the
    first ``DEALT_OUT`` in tasks.
    """
    fs, top = file_system(root)
    folders, files = [top], []
    while folders and len(folders) < DEALT_OUT:
        level, folders = folders, []
        for folder in level:
            more, here = listed(fs, folder, pattern, pruned)
            folders += more
            files += here
    row = lambda x: (x.path[len(top) :].lstrip("/"), x.mtime, x.size)
    out = spark.createDataFrame([row(x) for x in files], FILES)
    if not folders:
        return out

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = file_system(root)
        for batch in batches:
            for start in batch["folder"]:
                open_ = [start]
                while open_:
                    more, here = listed(fs, open_.pop(), pattern, pruned)
                    open_ += more
                    yield pd.DataFrame([row(x) for x in here], columns=["rel_path", "mtime", "size"]).astype({"mtime": "datetime64[us, UTC]", "size": "int64"})

    below = spark.createDataFrame([(x,) for x in folders], "folder string").repartition(min(len(folders), 1024))
    return out.union(below.mapInPandas(walk, FILES))


def read_files(paths: DataFrame, root: str) -> DataFrame:
    """``rel_path``, ``content`` of the files ``paths`` (rel_path) below ``root``; files that are gone by then are left out.

    Bytes that aren't UTF-8 are replaced.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = file_system(root)
        for batch in batches:
            for path in batch["rel_path"]:
                try:
                    with fs.open_input_stream(f"{top}/{path}") as stream:
                        yield pd.DataFrame({"rel_path": [path], "content": [stream.read().decode("utf-8", "replace")]})
                except FileNotFoundError:
                    continue

    return paths.select("rel_path").mapInPandas(read, "rel_path string, content string")


def omitted(path: Column, patterns: list[str]) -> Column:
    """Whether a path has a hidden segment or matches a pattern."""
    parts = F.split(path, "/")
    tests = [F.exists(parts, lambda s: s.startswith("."))]
    tests += [path.endswith(p[1:]) if p.startswith("*.") else F.array_contains(parts, p) for p in patterns]
    return reduce(or_, tests)


def inside(path: str) -> bool:
    """Whether a relative path stays below its root."""
    return bool(path) and not path.startswith("/") and ".." not in path.split("/")


def write_files(files: DataFrame, root: str) -> int:
    """Write files (rel_path, content) below ``root``; the number written.

    A file is written beside its place first and moved there, so nobody reads half of it; a task that runs again writes
    the same.  Paths that leave the root are an error.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = file_system(root)
        for batch in batches:
            for path, content in zip(batch["rel_path"], batch["content"], strict=True):
                if not inside(path):
                    raise ValueError(f"{path!r} is outside the root")
                target = f"{top}/{path}"
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                beside = f"{target}.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(beside) as stream:
                    stream.write(content.encode())
                fs.move(beside, target)
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("rel_path", "content").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def delete_files(files: DataFrame, root: str) -> int:
    """Delete files (rel_path) below ``root``, and folders that are empty then; the number deleted.

    Paths that leave the root are an error; files that are gone already don't count.
    """

    def delete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = file_system(root)
        for batch in batches:
            n = 0
            for path in batch["rel_path"]:
                if not inside(path):
                    raise ValueError(f"{path!r} is outside the root")
                if fs.get_file_info(f"{top}/{path}").type == pafs.FileType.File:
                    fs.delete_file(f"{top}/{path}")
                    n += 1
            yield pd.DataFrame({"n": [n]})

    gone = files.select("rel_path").mapInPandas(delete, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if gone:
        clear_folders(files.select(F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1).alias("folder")).where("folder <> ''").distinct(), root)
    return gone


def clear_folders(folders: DataFrame, root: str) -> None:
    """Delete those of ``folders`` (below ``root``) that are empty, and then those above them; only these are looked at."""

    def clear(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = file_system(root)
        for batch in batches:
            for folder in batch["folder"]:
                while folder:
                    try:
                        if fs.get_file_info(pafs.FileSelector(f"{top}/{folder}")):
                            break
                        fs.delete_dir(f"{top}/{folder}")
                    except FileNotFoundError:  # another task was here
                        pass
                    folder = folder.rpartition("/")[0]
            yield pd.DataFrame({"n": [len(batch)]})

    folders.mapInPandas(clear, "n long").agg(F.sum("n")).collect()


def save_registry(registry: DataFrame, path: str) -> None:
    """The registry as a JSON array, as ``read_registry`` takes it; the new file replaces the old at once."""
    fs, target = file_system(path)
    rows = ",\n".join(r[0] for r in registry.select(F.to_json(F.struct("*"))).collect())  # a line for each workspace
    with fs.open_output_stream(f"{target}.tmp") as stream:
        stream.write(f"[{rows}]".encode())
    fs.move(f"{target}.tmp", target)


def read_markdown(spark: SparkSession, root: str, workspace: str = "", paths: DataFrame | None = None) -> DataFrame:
    """``workspace``, ``note_id`` (path below root), ``text``: every .md file outside ignored folders, or some (rel_path)."""
    files = read_files(dealt(file_list(spark, root, "*.md")) if paths is None else paths, root)
    return files.select(F.lit(workspace).alias("workspace"), F.col("rel_path").alias("note_id"), F.col("content").alias("text"))


def read_sources(spark: SparkSession, root: str, language: str, omit: list[str] | None = None) -> DataFrame:
    """``path``, ``source`` of every source file of a language."""
    pattern, default = LANGUAGES[language]
    left_out = default if omit is None else omit
    pruned = tuple(x for x in left_out if not x.startswith("*."))
    files = file_list(spark, root, pattern, pruned).where(~omitted(F.col("rel_path"), left_out))
    return read_files(dealt(files), root).select(F.col("rel_path").alias("path"), F.col("content").alias("source"))


def dealt(files: DataFrame) -> DataFrame:
    """Files dealt out evenly, whatever folder they were found in."""
    return files.select("rel_path").repartition(files.sparkSession.sparkContext.defaultParallelism * 2)


def snapshot(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """``rel_path``, ``mtime``, ``size`` without reading contents."""
    return file_list(spark, root, pattern)


def name_uuid(name: Column) -> Column:
    """The version 5 UUID of a name in the DNS namespace, as text."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8).cast("string"), 10, 16))
    part = lambda begin, n: F.substring(h, begin, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def read_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Registered workspaces (a JSON array); malformed entries are dropped, as are inactive ones.  A missing file has none.

    A missing ``id`` is derived from the ``name``, where there are such columns.
    """
    if not stored_paths(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    if {"id", "name"} <= set(rows.columns):
        rows = rows.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), name_uuid(F.col("name"))))
    return rows.where(F.coalesce("active", F.lit(True)))


def registered(registry: DataFrame, key: str, by: str = "id") -> dict | None:
    """The entry of one workspace, by id; none if there is none."""
    row = registry.where(F.col(by) == key).first()
    return row.asDict(recursive=True) if row else None


def stored_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, through Spark's own file systems, sorted."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(x.getPath().toString() for x in found or [])


def versions(spark: SparkSession, path: str) -> list[str]:
    """Complete stored versions below a path, oldest first."""
    return [p.removesuffix("/complete/_SUCCESS") for p in stored_paths(spark, f"{path.rstrip('/')}/v*/complete/_SUCCESS")]


def next_version(spark: SparkSession, path: str) -> str:
    """A version's place after all that are there, complete or not: none is ever written over."""
    names = [p.rpartition("/v")[2] for p in stored_paths(spark, f"{path.rstrip('/')}/v*")]
    return f"{path.rstrip('/')}/v{max([int(n) for n in names if n.isdigit()], default=-1) + 1:09d}"
