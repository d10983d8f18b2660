"""Source files as tables: definitions, imports, call sites, and the joins between them.

Extraction (``syntax``) is a helper over one file's text, in Arrow batches; everything after it is joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import base_name, dir_name, stem
from quillgraph.operators.graph import cut
from quillgraph.operators.syntax import CALLS, EXTRACTORS, MOST_BODY, NOT_CALLS, attributed, plain_calls
from quillgraph.sources.files import LANGUAGES, delete_files, file_list, read_files, read_sources, write_files

SYMBOLS = "path string, role string, name string, detail string, exported boolean, begin int, end int, owner string, caller string, traits map<string,string>"
SYMBOL_TYPES = [*[pa.string()] * 4, pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
#: Bytes of sources that are taken apart at a time, and rows that are given out at a time.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 10_000

# File names, folders and source patterns by which entry points are known.
MAIN_FILES = {
    "py": ["__main__.py", "main.py", "cli.py", "server.py", "app.py", "manage.py", "wsgi.py", "asgi.py"],
    "ts": ["main.ts", "cli.ts", "server.ts", "app.ts", "bootstrap.ts"],
    "c": ["main.c"],
}
MAIN_DIRS = {"py": ["bin", "cli", "scripts"], "ts": ["bin", "cli", "scripts"], "c": ["bin", "cli", "tools", "examples", "samples"]}
MAIN_PATTERNS = {
    "py": [
        (r"""\bif\s+__name__\s*==\s*["']__main__["']\s*:""", "uses Python __main__ guard"),
        (r"(?m)^(?:async\s+)?def\s+main\s*\(", "declares a function named main"),
        (r"\bargparse\b|\bArgumentParser\s*\(", "configures argparse CLI handling"),
        (r"\b(?:click|typer)\b|@\w+\.command\b|@\w+\.group\b", "uses click or typer CLI structure"),
        (r"\buvicorn\.run\s*\(|\bapp\.run\s*\(", "starts an application server"),
        (r"\bexecute_from_command_line\s*\(", "Django management command entrypoint"),
    ],
    "ts": [
        (r"\bfunction\s+main\s*\(|\b(?:const|let|var)\s+main\s*=", "declares a function named main"),
        (r"\bfunction\s+bootstrap\s*\(|\b(?:const|let|var)\s+bootstrap\s*=", "declares a bootstrap function"),
        (r"\bmain\s*\([^)]*\)\s*(?:\.catch\s*\(|;|\n)", "invokes main() at module scope"),
        (r"require\.main\s*===\s*module", "uses Node entrypoint guard"),
        (r"\bprocess\.argv\b", "reads process.argv"),
        (r"\b(?:program|commander|yargs)\.(?:parse|command|option)\b", "configures a CLI parser"),
        (r"\b(?:app|server)\.listen\s*\(|\bcreateServer\s*\(", "starts a listening server"),
    ],
    "c": [
        (r"\bmain\s*\([^)]*\)\s*\{", "declares C main function"),
        (r"\bmain\s*\([^)]*\barg[cv]\b", "main signature accepts argc or argv"),
        (r"\bw?WinMain\s*\(", "declares Windows GUI entrypoint"),
        (r"\bgetopt(?:_long)?\s*\(", "parses command line options"),
        (r"\b(?:listen|accept|bind)\s*\(", "starts or accepts server sockets"),
    ],
}


def entrypoint_marks(language: str, path: Column, source: Column) -> Column:
    """Why a file looks like an entry point: an array of reasons, empty if it doesn't."""
    base = F.lower(base_name(path))
    marks = [F.when(base.isin(MAIN_FILES[language]), F.concat(F.lit("entrypoint-like file name: "), base))]
    if language == "ts":
        marks.append(F.when(path == "index.ts", "root index.ts file"))
    folders = F.transform(F.split(dir_name(path), "/"), F.lower)
    marks.append(F.when(F.arrays_overlap(folders, F.array(*map(F.lit, MAIN_DIRS[language]))), "located under an entrypoint-like directory"))
    if language != "c":
        marks.append(F.when(source.startswith("#!"), "shebang executable script"))
    marks += [F.when(source.rlike(p), F.lit(text)) for p, text in MAIN_PATTERNS[language]]
    if language == "py":
        marks.append(F.when(source.rlike(r"\bmain\s*\([^)]*\)") & source.rlike(r"\b__main__\b"), "invokes main() from the __main__ guard"))
    return F.array_compact(F.array(*marks))


def register_language(name: str, extractor, not_calls: list[str] | None = None, pattern: str = "", omit: list[str] | None = None) -> None:
    """Add a language: ``extractor`` yields (role, name, detail, exported, begin, end) of a source text, and the owner and traits if it knows them.

    ``pattern`` and ``omit``: its files, for ``read_sources``.  It has no entry point marks and no specially named files.
    """
    EXTRACTORS[name], NOT_CALLS[name] = extractor, not_calls or []
    MAIN_FILES.setdefault(name, [])
    MAIN_DIRS.setdefault(name, [])
    MAIN_PATTERNS.setdefault(name, [])
    LANGUAGES.setdefault(name, (pattern or f"*.{name}", omit or []))


def symbols(files: DataFrame, language: str) -> DataFrame:
    """Definitions, imports and call sites of ``files`` (path, source), a row each (``SYMBOLS``).

    ``role``: def, class, method, const, ..., import (detail: the module; exported: from this project), reexport or call.
    ``begin`` and ``end`` are offsets in the text.  ``owner``: the class of a method, or the innermost definition around a
    call; ``caller``: the exported symbol that a call counts for.  A null source has no rows; a file that the extractor
    fails on has one of the role "error", with the reason in ``detail``, and fails nothing else.
    """
    extract, calls, skip = EXTRACTORS[language], CALLS.get(language, plain_calls), frozenset(NOT_CALLS[language])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in source_slices(batch):
                rows = []
                for path, source in zip(some.column("path").to_pylist(), some.column("source").to_pylist(), strict=True):
                    try:
                        found = [(*r, None, {})[: 8] if len(r) < 8 else r for r in extract(source)]
                        sites = list(attributed(found, calls(source, skip), language == "py"))
                    except Exception as error:  # noqa: BLE001  one file's trouble
                        rows.append((path, "error", "", f"{type(error).__name__}: {error}", False, 0, 0, None, None, {}))
                        continue
                    rows += [(path, *r[:7], None, r[7]) for r in found]
                    rows += [(path, "call", name, "", False, begin, end, owner, caller, {}) for name, begin, end, owner, caller in sites]
                for i in range(0, len(rows), SLICE_ROWS):
                    *columns, traits = zip(*rows[i : i + SLICE_ROWS], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, [list(x.items()) for x in traits]], SYMBOL_TYPES, strict=True)], [c.split()[0] for c in SYMBOLS.split(", ")])

    return files.where("source IS NOT NULL").select("path", "source").mapInArrow(run, SYMBOLS)


def source_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about SLICE_BYTES of sources, one file at least."""
    size = pc.binary_length(batch.column("source")).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = np.flatnonzero(np.diff((np.cumsum(size) - size) // SLICE_BYTES)) + 1
    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(size)], strict=True):
        yield batch.slice(i, j - i)


def enclosing(spans: Column, position: Column) -> Column:
    """Name of the first of ``spans`` (array of name, begin, end) that holds a position."""
    return F.get(F.filter(spans, lambda s: position.between(s["begin"], s["end"])), 0)["name"]


def call_edges(sites: DataFrame, exports: DataFrame) -> DataFrame:
    """Call sites (path, caller, name) with the exported symbols of that name in other files: adds ``callee_path``."""
    target = exports.select(F.col("path").alias("callee_path"), "name").distinct()
    return sites.join(target, "name").where("path <> callee_path")


def exported_symbols(table: DataFrame) -> DataFrame:
    """``path``, ``name`` of what files define and export; a re-exported name belongs to the file that defines it."""
    return table.where("exported AND role NOT IN ('import', 'reexport')").select("path", "name")


def call_graph(table: DataFrame) -> DataFrame:
    """``path``, ``caller``, ``name``, ``callee_path`` from extracted symbols: calls within an exported symbol, and what they call."""
    return calls_in_repository(table).where("caller IS NOT NULL").select("path", "caller", "name", "callee_path").distinct()


def calls_in_repository(table: DataFrame) -> DataFrame:
    """Every call of a symbol that another file exports: ``path``, ``name``, ``begin``, ``owner``, ``caller``, ``callee_path``."""
    return call_edges(table.where("role = 'call'").select("path", "name", "begin", "owner", "caller"), exported_symbols(table))


def import_edges(table: DataFrame, files: DataFrame, language: str, keep_module: bool = False) -> DataFrame:
    """``src``, ``dst``: imports within the project resolved to files, by the module's path and the package's own file.

    ``keep_module``: with ``module``, as it stands in the import.
    """
    rows = table.where("role = 'import' AND exported").select(F.col("path").alias("src"), F.col("detail").alias("module")).distinct()
    if language == "py":
        up = F.length(F.regexp_extract("module", r"^(\.+)", 1))
        parts = F.split(F.col("src"), "/")
        base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - up, F.lit(0))), "/")
        rest = F.translate(F.regexp_replace("module", r"^\.+", ""), ".", "/")
        target = F.concat_ws("/", F.when(base != "", base), F.when(rest != "", rest))
        tries = F.array(F.concat(target, F.lit(".py")), F.concat_ws("/", F.when(target != "", target), F.lit("__init__.py")))
    else:
        # a module's own suffix is dropped: "./config.js" is config.ts
        plain = F.regexp_replace("module", r"\.[jt]s$", "") if language == "ts" else F.col("module")
        target = normal_path(F.concat(dir_name(F.col("src")), F.lit("/"), plain))
        tries = F.array(F.concat(target, F.lit(".ts")), F.concat(target, F.lit("/index.ts"))) if language == "ts" else F.array(target)
    tried = rows.select("src", "module", F.posexplode(tries).alias("pos", "dst"))
    found = tried.join(files.select(F.col("path").alias("dst")).distinct(), "dst")
    edges = found.groupBy("src", "module").agg(F.min_by("dst", "pos").alias("dst"))
    return edges if keep_module else edges.select("src", "dst").distinct()


def normal_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    step = lambda acc, s: F.when(s.isin(".", ""), acc).when((s == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def mirror_stem(path: Column, language: str) -> Column:
    """Name of a file's note: index and package files are called after their folder."""
    special = {"ts": ("index", "-index"), "py": ("__init__", "-init"), "c": ("main", "-main")}.get(language, ("", ""))
    folder = base_name(dir_name(path))
    return F.when((stem(path) == special[0]) & (folder != "."), F.concat(folder, F.lit(special[1]))).otherwise(stem(path))


def files_by_folder(files: DataFrame) -> DataFrame:
    """``dir``, ``path``: every file with each folder above it."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.where(F.col("path").contains("/")).select(F.explode(above).alias("dir"), "path")


def symbol_file(name: Column) -> Column:
    """A symbol's name as a file name."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[<>,:.\s\[\]]", "_"), "__+", "_"), "^_|_$", "")


def note_names(files: DataFrame, language: str) -> DataFrame:
    """``path``, ``note``: where the note of each file goes, without suffix."""
    folder = F.when(F.col("path").contains("/"), F.concat(dir_name(F.col("path")), F.lit("/"))).otherwise("")
    return files.select("path", F.concat(folder, mirror_stem(F.col("path"), language)).alias("note"))


def module_names(files: DataFrame, language: str) -> DataFrame:
    """``dir``, ``note``: where the note of each folder goes if no other language has it; '.' is the top folder."""
    dirs = files_by_folder(files).select("dir").union(files.select(F.lit(".").alias("dir"))).distinct()
    return dirs.select("dir", F.when(F.col("dir") == ".", "root_module").otherwise(F.concat("dir", F.lit("_module"))).alias("note"))


def owned_names(wanted: dict[str, DataFrame], stored: DataFrame) -> dict[str, DataFrame]:
    """``wanted`` (by language: a key and ``note``) with names of their own: a name that several languages want belongs to one.

    That is the language of the note which is there already (``stored``: note, language), unless it is one of these and wants
    it no more, else the first; the others' names get their language added.  All are settled before anything is written,
    and stay the same in later runs.
    """
    asked = reduce(DataFrame.union, [w.select("note", F.lit(language).alias("language"), F.lit(i).alias("i")) for i, (language, w) in enumerate(wanted.items())])
    was = F.col("was").isNotNull() & (~F.col("was").isin(*wanted) | F.array_contains("languages", F.col("was")))
    first = asked.groupBy("note").agg(F.min_by("language", "i").alias("owner"), F.collect_set("language").alias("languages"))
    first = first.join(stored.select("note", F.col("language").alias("was")), "note", "left").select("note", F.when(was, F.col("was")).otherwise(F.col("owner")).alias("owner"))
    out = {}
    for language, w in wanted.items():
        named = w.join(first, "note").withColumn("note", F.when(F.col("owner") == language, F.col("note")).otherwise(F.concat("note", F.lit(f"_{language}"))))
        out[language] = named.select(*w.columns)
    return out


def stored_languages(notes: DataFrame, out: str) -> DataFrame:
    """``note``, ``language`` of those of ``notes`` (note, without suffix) that are there and name one."""
    found = read_files(notes.select(F.concat("note", F.lit(".md")).alias("rel_path")).distinct(), out)
    language = F.regexp_extract("content", r"^---\n(?:(?!---)[^\n]*\n)*?language:[ \t]*([^\s]+)[ \t]*\n", 1)
    return found.select(F.regexp_replace("rel_path", r"\.md$", "").alias("note"), language.alias("language")).where("language <> ''")


def link(workspace: str, note: Column, shown: Column | None = None) -> Column:
    return F.concat(F.lit(f"[[code/{workspace}/"), note, *([F.lit("|"), shown] if shown is not None else []), F.lit("]]"))


def ordered_lines(line: Column, order: Column) -> Column:
    """Lines of a group, each once at its first place, joined."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line"))))
    return F.array_join(F.array_distinct(F.transform(rows, lambda x: x["line"])), "\n")


def section(title: str, rows: DataFrame, keys: list[str], line: Column, order: Column) -> DataFrame:
    body = rows.groupBy(*keys).agg(ordered_lines(line, order).alias(title))
    return body.select(*keys, F.concat(F.lit(f"\n## {title}\n"), title, F.lit("\n")).alias(title))


def with_sections(out: DataFrame, sections: list[DataFrame], keys: list[str]) -> tuple[DataFrame, list[Column]]:
    titles = [next(c for c in s.columns if c not in keys) for s in sections]
    for s in sections:
        out = out.join(s, keys, "left")
    return out, [F.coalesce(F.col(f"`{t}`"), F.lit("")) for t in titles]


def head(lines: list[Column | str]) -> Column:
    """Frontmatter of the lines that aren't null."""
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines]), F.lit("\n---\n"))


def linked_calls(table: DataFrame, names: DataFrame) -> DataFrame:
    """``calls_in_repository`` with the notes of both files: ``own_note`` and ``callee_note``."""
    calls = calls_in_repository(table).join(names.select(F.col("path").alias("callee_path"), F.col("note").alias("callee_note")), "callee_path")
    return calls.join(names.select("path", F.col("note").alias("own_note")), "path")


def file_notes(
    table: DataFrame, files: DataFrame, language: str, workspace: str, names: DataFrame | None = None, modules: DataFrame | None = None, calls: DataFrame | None = None, edges: DataFrame | None = None
) -> DataFrame:
    """``note_path``, ``note``: a markdown note for each file: frontmatter, exports, imports, functions, and calls in and out of it.

    ``names`` (path, note) and ``modules`` (dir, note): where the notes of files and folders are.  ``calls`` (``linked_calls``)
    and ``edges`` (``import_edges`` with modules): if they are there already.
    """
    names = note_names(files, language) if names is None else names
    modules = module_names(files, language) if modules is None else modules
    calls = linked_calls(table, names) if calls is None else calls
    imports = table.where("role = 'import'")
    edges = import_edges(table, files, language, keep_module=True) if edges is None else edges
    targets = edges.join(names.select(F.col("path").alias("dst"), "note"), "dst").select(F.col("src").alias("path"), F.col("module").alias("detail"), "note")
    inside = imports.where("exported").join(targets, ["path", "detail"], "left")
    inside = inside.groupBy("path", "detail").agg(F.min("note").alias("note"), F.min("begin").alias("begin"), ordered_lines(F.concat(F.lit("`"), F.coalesce(F.col("traits")["binding"], "name"), F.lit("`")), F.struct("begin", "end")).alias("bound"))
    bound = F.when(F.col("bound") == "``", "").otherwise(F.concat(F.lit(" \u2014 "), F.translate(F.col("bound"), "\n", " ")))
    functions = table.where("role IN ('def', 'method')").select("path", "role", "name", "begin", "end", "owner", "exported", "traits")
    per_function = calls.where("owner IS NOT NULL").groupBy("path", F.col("owner").alias("name")).agg(ordered_lines(F.concat(link(workspace, F.col("callee_note")), F.lit(" (`"), "name", F.lit("`)")), F.struct("begin", "callee_note")).alias("into"))
    flags = F.concat_ws(", ", F.when(F.col("traits")["async"] == "true", "async"), F.when(F.col("exported"), "exported"), F.when(F.col("owner").isNotNull(), F.concat(F.lit("method of `"), "owner", F.lit("`"))))
    functions = functions.join(per_function, ["path", "name"], "left")
    line = F.concat(
        F.lit("### `"), F.coalesce(F.col("traits")["signature"], "name"), F.lit("`"), F.when(flags != "", F.concat(F.lit(" *("), flags, F.lit(")*"))).otherwise(""),
        F.coalesce(F.concat(F.lit("\n*Calls into: "), F.translate("into", "\n", " "), F.lit("*")), F.lit("")),
    )
    shown = table.where("exported AND role <> 'import'")
    kind = F.when(F.col("role") == "reexport", "reexport").otherwise(F.coalesce(F.col("traits")["kind"], "role"))
    parts = [
        section("Exports", shown, ["path"], F.concat(F.lit("- "), kind, F.lit(" `"), F.coalesce(F.col("traits")["signature"], "name"), F.lit("`")), F.struct("begin", "name")),
        section("Imports", inside.select("path", F.coalesce(F.concat(F.lit("- "), link(workspace, F.col("note")), bound), F.concat(F.lit("- `"), "detail", F.lit("`"), bound)).alias("line"), F.lit(0).alias("o"), "begin").union(
            imports.where("NOT exported").select("path", F.concat(F.lit("- `"), "detail", F.lit("`")), F.lit(1), "begin")), ["path"], F.col("line"), F.struct("o", "begin")),
        section("Functions", functions, ["path"], line, F.struct("begin", "end")),
        section("Calls", calls, ["path"], F.concat(F.lit("- `"), "name", F.lit("` in "), link(workspace, F.col("callee_note"))), F.struct("name", "callee_note")),
        section("Called by", calls.select(F.col("callee_path").alias("to"), "name", "own_note").withColumnRenamed("to", "path"), ["path"], F.concat(F.lit("- `"), "name", F.lit("` from "), link(workspace, F.col("own_note"))), F.struct("name", "own_note")),
    ]
    out, texts = with_sections(files.join(names, "path").join(modules.select("dir", F.col("note").alias("module")), F.col("dir") == dir_name(F.col("path"))), parts, ["path"])
    entry = F.when(F.size(entrypoint_marks(language, F.col("path"), F.col("source"))) > 0, "  - entrypoint") if language in MAIN_FILES else F.lit(None).cast("string")
    about = head(["type: codeUnit", "tier: 2", F.concat(F.lit("path: "), "path"), F.concat(F.lit(f"parentModule: code/{workspace}/"), "module"), f"language: {language}", f"workspace: {workspace}", "tags:", "  - codeUnit", entry])
    return out.select(F.concat("note", F.lit(".md")).alias("note_path"), F.concat(about, F.lit("# "), "path", F.lit("\n"), *texts).alias("note"))


def first_owner(wanted: DataFrame, table: DataFrame, edges: DataFrame, roles: list[str]) -> DataFrame:
    """``wanted`` (path, name, ...: a symbol and the file that speaks of it) with ``def_path``, the file that exports it.

    Of several, one that the file imports comes first, then one in the same folder, then the first by path.  Names that no file exports have
    a null.
    """
    owner = exported_symbols(table.where(F.col("role").isin(roles))).select(F.col("path").alias("def_path"), "name").distinct()
    asked = wanted.select("path", "name").distinct()
    near = asked.join(edges.select(F.col("src").alias("path"), F.col("dst").alias("def_path")).distinct(), "path").join(owner, ["name", "def_path"])
    near = near.groupBy("path", "name").agg(F.min("def_path").alias("_near"))
    # the first of a folder, and of all, is settled for each name before any file asks for it
    beside = owner.groupBy(dir_name(F.col("def_path")).alias("_dir"), "name").agg(F.min("def_path").alias("_beside"))
    first = beside.groupBy("name").agg(F.min("_beside").alias("_first"))
    named = wanted.withColumn("_dir", dir_name(F.col("path")))
    for found, on in ((near, ["path", "name"]), (beside, ["_dir", "name"]), (first, ["name"])):
        named = named.join(found, on, "left")
    rest = [c for c in wanted.columns if c not in ("path", "name")]
    return named.select("path", "name", *rest, F.coalesce("_near", "_beside", "_first").alias("def_path"))


def base_classes(table: DataFrame) -> DataFrame:
    """``path``, ``name``, ``base``, ``base_path``: bases of Python classes that another file exports (the first by path)."""
    bases = F.split(F.regexp_extract("detail", r"^class\s+\w+\s*\(([^)]*)\)", 1), r"\s*,\s*")
    rows = table.where("role = 'class'").select("path", "name", F.explode(F.transform(bases, lambda b: F.regexp_replace(F.trim(b), r"^.*\.", ""))).alias("base"))
    owner = table.where("exported AND role = 'class'").select(F.col("path").alias("base_path"), F.col("name").alias("base"))
    found = rows.where("base <> ''").join(owner, "base").where("path <> base_path")
    return found.groupBy("path", "name", "base").agg(F.min("base_path").alias("base_path"))


def public_api(table: DataFrame) -> DataFrame:
    """Exported Python symbols (path, name) that some package file (``__init__.py``) imports by name or by ``*``."""
    exports = table.where("exported AND role <> 'import'").select("path", "name", F.regexp_extract("path", r"([^/]+)\.py$", 1).alias("module"))
    taken = table.where((F.col("role") == "import") & F.col("path").endswith("__init__.py")).select(F.col("name").alias("taken"), F.regexp_extract("detail", r"([^.]*)$", 1).alias("module"))
    by_name = exports.join(taken.where("taken <> '*'").select("module", F.col("taken").alias("name")).distinct(), ["module", "name"], "left_semi")
    by_star = exports.join(taken.where("taken = '*'").select("module").distinct(), "module", "left_semi")
    return by_name.select("path", "name").union(by_star.select("path", "name")).distinct()


def symbol_notes(
    table: DataFrame,
    language: str,
    workspace: str,
    files: DataFrame | None = None,
    names: DataFrame | None = None,
    modules: DataFrame | None = None,
    calls: DataFrame | None = None,
    edges: DataFrame | None = None,
) -> DataFrame:
    """``note_path``, ``note``: a note for each exported symbol: what is known of it, its text or signature, what it inherits, calls and names, and what calls it."""
    files = table.select("path").distinct() if files is None else files.select("path")
    names = note_names(files, language) if names is None else names
    modules = module_names(files, language) if modules is None else modules
    note_of = lambda path, name: names.select(F.col("path").alias(path), F.col("note").alias(name))
    calls = linked_calls(table, names) if calls is None else calls
    edges = import_edges(table, files, language) if edges is None else edges
    rows = table.where("exported AND role <> 'import'").groupBy("path", "name").agg(F.min_by(F.struct("role", "detail", "traits"), F.struct("begin", "role")).alias("r")).select("path", "name", "r.*")
    trait = lambda name: F.col("traits")[name]
    to_symbol = lambda note, name: F.concat(F.lit("- "), link(workspace, F.concat(note, F.lit("/"), symbol_file(name)), name))
    bases = rows.where("traits['bases'] IS NOT NULL").select("path", F.col("name").alias("symbol"), F.posexplode(F.transform(F.split(trait("bases"), r"\s*,\s*"), lambda b: F.regexp_replace(b, r"^.*\.", ""))).alias("o", "name"))
    bases = first_owner(bases, table, edges, ["class"]).join(note_of("def_path", "def_note"), "def_path", "left")
    token = F.regexp_extract_all(F.coalesce(trait("signature"), F.lit("")), F.lit(r":\s*[A-Z][A-Za-z0-9_]*|->\s*[A-Z][A-Za-z0-9_]*"), F.lit(0))
    asked = rows.select("path", F.col("name").alias("symbol"), F.posexplode(F.array_distinct(F.transform(token, lambda t: F.regexp_replace(t, r"^\W+", "")))).alias("o", "name"))
    types = first_owner(asked, table, edges, ["class", "type", "interface"]).where("def_path <> path").join(note_of("def_path", "def_note"), "def_path")
    keyed = lambda df: df.select("path", F.col("symbol").alias("name"), *[c for c in df.columns if c not in ("path", "symbol", "name")], F.col("name").alias("other"))
    out_calls = calls.where("caller IS NOT NULL").select("path", F.col("caller").alias("symbol"), "begin", "callee_note", "name")
    in_calls = calls.select(F.col("callee_path").alias("path"), "name", "own_note", "caller", "begin")
    body, signature = trait("body"), trait("signature")
    code = F.when(body.isNotNull(), F.concat(F.lit(f"\n## Implementation\n```{language}\n"), body, F.lit("\n```\n"))).when(signature.isNotNull(), F.concat(F.lit(f"\n## Signature\n```{language}\n"), signature, F.lit("\n```\n"))).otherwise(F.concat(F.lit("\n`"), F.substring("detail", 1, MOST_BODY), F.lit("`\n")))
    parts = [
        section("Inherits", keyed(bases), ["path", "name"], F.coalesce(to_symbol(F.col("def_note"), F.col("other")), F.concat(F.lit("- `"), "other", F.lit("`"))), F.col("o")),
        section("Calls Into", keyed(out_calls), ["path", "name"], to_symbol(F.col("callee_note"), F.col("other")), F.struct("begin", "callee_note")),
        section("Type References", keyed(types), ["path", "name"], to_symbol(F.col("def_note"), F.col("other")), F.col("o")),
        section("Called By", in_calls, ["path", "name"], F.coalesce(to_symbol(F.col("own_note"), F.col("caller")), F.concat(F.lit("- "), link(workspace, F.col("own_note")))), F.struct("own_note", "begin")),
    ]
    api = public_api(table).withColumn("public", F.lit("publicApi: true"))
    named = rows.join(names, "path").join(modules.select("dir", F.col("note").alias("module")), F.col("dir") == dir_name(F.col("path"))).join(api, ["path", "name"], "left")
    out, texts = with_sections(named, parts, ["path", "name"])
    kind = F.when(F.col("role") == "reexport", "reexport").otherwise(F.coalesce(trait("kind"), "role"))
    listed = lambda key, name: F.concat(F.lit(f"{key}: ["), trait(name), F.lit("]"))
    about = head([
        "type: codeSymbol", "tier: 1", F.concat(F.lit("path: "), "path"), F.concat(F.lit(f"parentFile: code/{workspace}/"), "note"), F.concat(F.lit(f"parentModule: code/{workspace}/"), "module"),
        F.concat(F.lit("symbolKind: "), kind), f"language: {language}", F.col("public"), listed("decorators", "decorators"), F.concat(F.lit("routeMethod: "), trait("route_method")),
        F.concat(F.lit('routePath: "'), trait("route_path"), F.lit('"')), F.concat(F.lit("abstract: "), trait("abstract")), F.concat(F.lit("dataclass: "), trait("dataclass")), listed("baseClasses", "bases"),
        f"workspace: {workspace}", "tags:", "  - codeUnit",
    ])
    route = F.coalesce(F.concat(F.lit(" `"), trait("route_method"), F.lit(" "), trait("route_path"), F.lit("`")), F.lit(""))
    title = F.concat(F.lit("# "), F.col("name"), F.lit("\n**Kind:** `"), kind, F.lit("`"), route, F.lit("\n"))
    return out.select(F.concat("note", F.lit("/"), symbol_file(F.col("name")), F.lit(".md")).alias("note_path"), F.concat(about, title, code, *texts).alias("note"))


def module_notes(files: DataFrame, language: str, workspace: str, names: DataFrame | None = None, modules: DataFrame | None = None, others: DataFrame | None = None) -> DataFrame:
    """``note_path``, ``note``: a note for each folder, beside it, with the folder above, the folders right below it and its files.

    ``others`` (dir, note): notes of the folders right below ``dir``, of any language, which are listed too.
    """
    names = note_names(files, language) if names is None else names
    modules = module_names(files, language) if modules is None else modules
    own = names.groupBy(dir_name(F.col("path")).alias("dir")).agg(F.array_sort(F.collect_set(link(workspace, F.col("note")))).alias("files"))
    parent = F.when(F.col("dir") != ".", dir_name(F.col("dir")))
    rows = modules.withColumn("up", parent)
    above = rows.join(modules.select(F.col("dir").alias("up"), F.col("note").alias("up_note")), "up", "left")
    kids = above.where("up IS NOT NULL").groupBy(F.col("up").alias("dir")).agg(F.array_sort(F.collect_set(link(workspace, F.col("note")))).alias("kids"))
    rows = above.drop("up").join(own, "dir", "left").join(kids, "dir", "left")
    held = F.lit(None).cast("array<string>")
    if others is not None:
        rows = rows.join(others.groupBy("dir").agg(F.collect_set(link(workspace, F.col("note"))).alias("held")), "dir", "left")
        held = F.col("held")
    listed = lambda t, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n## {t}\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"))).otherwise("")
    title = F.when(F.col("dir") == ".", "root").otherwise(base_name(F.col("dir")))
    about = head(["type: codeModule", "tier: 3", F.concat(F.lit("path: "), "dir"), F.concat(F.lit("title: "), title), f"language: {language}", f"workspace: {workspace}", "tags:", "  - codeUnit"])
    up = F.coalesce(F.concat(F.lit("\n## Parent\n- "), link(workspace, F.col("up_note")), F.lit("\n")), F.lit(""))
    texts = [up, listed("Submodules", module_links(F.col("kids"), held)), listed("Files", F.coalesce("files", F.array().cast("array<string>")))]
    return rows.select(F.concat("note", F.lit(".md")).alias("note_path"), F.concat(about, F.lit("# "), title, F.lit("\n"), *texts).alias("note"))


def keep_summary(new: Column, old: Column) -> Column:
    """A new note with the summary of the old one: everything from its first summary heading."""
    summary = F.regexp_extract(F.coalesce(old, F.lit("")), r"(?s)(\n## Summary.*)$", 1)
    return F.concat(F.regexp_replace(new, r"\s+$", ""), F.lit("\n"), summary)


def module_links(computed: Column, stored: Column) -> Column:
    """Links of a module's children: those computed and those on disk, each once, in order."""
    return F.array_sort(F.array_union(F.coalesce(computed, F.array().cast("array<string>")), F.coalesce(stored, F.array().cast("array<string>"))))


def mirror_totals(outcomes: DataFrame) -> DataFrame:
    """``language``, ``written``, ``skipped``, ``may_clean`` of outcomes (language, outcome: written, skipped or failed).

    Stale notes may only be deleted if nothing failed in any language and something is valid.
    """
    each = outcomes.groupBy("language").agg(F.count_if(F.col("outcome") == "written").alias("written"), F.count_if(F.col("outcome") == "skipped").alias("skipped"))
    whole = outcomes.agg((F.count_if(F.col("outcome") == "failed") == 0).alias("may_clean"), F.count_if(F.col("outcome") != "failed").alias("_valid"))
    return each.join(F.broadcast(whole.select((F.col("may_clean") & (F.col("_valid") > 0)).alias("may_clean"))))


def mirror_workspace(spark: SparkSession, root: str, out: str, languages: list[str], workspace: str, omit: dict[str, list[str]] | None = None) -> dict[str, dict | int]:
    """Mirror a source tree: a note for each file, symbol and folder below ``out``, stale ones deleted if all went well.

    Summaries of notes that are there already are kept.  Counts of notes written and left as they were, by language, and
    of notes deleted.  An unknown language is skipped and keeps stale notes.  Where several languages have a note of one
    name, it belongs to one of them (``owned_names``).
    """
    asked, hold = list(dict.fromkeys(languages)), lambda df: cut(df, spark)
    known = [x for x in asked if x in EXTRACTORS]
    src = {x: hold(read_sources(spark, root, x, (omit or {}).get(x))) for x in known}
    tables = {x: hold(symbols(src[x], x)) for x in known}
    well = known == asked and not any(t.where("role = 'error'").limit(1).count() for t in tables.values())
    if not known:
        return {"written": {}, "skipped": {}, "cleaned": 0}
    wanted = [{x: note_names(src[x], x) for x in known}, {x: module_names(src[x], x) for x in known}]
    named = []
    for w in wanted:
        stored = hold(stored_languages(reduce(DataFrame.union, [n.select("note") for n in w.values()]), out))
        named.append({x: hold(n) for x, n in owned_names(w, stored).items()})
    names, modules = named
    below = reduce(DataFrame.union, modules.values()).where("dir <> '.'").select(dir_name(F.col("dir")).alias("dir"), F.col("note"), F.concat("dir", F.lit("_module")).alias("base"))
    others = below.where("note = base").select("dir", "note")
    every = None
    for x in known:
        shared = {"names": names[x], "modules": modules[x], "calls": hold(linked_calls(tables[x], names[x])), "edges": hold(import_edges(tables[x], src[x], x, keep_module=True))}
        notes = file_notes(tables[x], src[x], x, workspace, **shared).union(symbol_notes(tables[x], x, workspace, src[x], **shared))
        if src[x].limit(1).count():
            notes = notes.union(module_notes(src[x], x, workspace, names[x], modules[x], others))
        notes = hold(notes.groupBy("note_path").agg(F.min("note").alias("note"), F.lit(x).alias("language")))
        every = notes if every is None else every.union(notes)
    old = read_files(every.select(F.col("note_path").alias("rel_path")), out).select(F.col("rel_path").alias("note_path"), F.col("content").alias("old"))
    both = hold(every.join(old, "note_path", "left").withColumn("note", keep_summary(F.col("note"), F.col("old"))))
    changed = ~F.col("note").eqNullSafe(F.col("old"))
    counts = {r.language: r for r in both.groupBy("language").agg(F.count_if(changed).alias("written"), F.count_if(~changed).alias("skipped")).collect()}  # a row a language
    write_files(both.where(changed).select(F.col("note_path").alias("rel_path"), F.col("note").alias("content")), out)
    cleaned = 0
    if well and counts:
        valid = both.select(F.col("note_path").alias("rel_path")).distinct()
        cleaned = delete_files(file_list(spark, out, "*.md").join(valid, "rel_path", "left_anti").select("rel_path"), out)
    number = lambda what: {x: counts[x][what] if x in counts else 0 for x in known}
    return {"written": number("written"), "skipped": number("skipped"), "cleaned": cleaned}


def to_mirror(sources: DataFrame, mirrors: DataFrame, force: bool = False) -> DataFrame:
    """Sources (path, mtime) without a mirror (path, mtime) at least as new; all with ``force``."""
    fresh = mirrors.select("path", F.col("mtime").alias("mirrored"))
    return sources.join(fresh, "path", "left").where(F.lit(force) | F.col("mirrored").isNull() | (F.col("mirrored") < F.col("mtime"))).select(*sources.columns)
