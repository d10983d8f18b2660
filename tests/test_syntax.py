"""Extraction from TypeScript, C and Python texts, and the notes made of them."""

from __future__ import annotations

import pytest

from quillgraph.operators import mirror, syntax

TS = r"""
import def, { a as b, type T } from './x.js';
import * as ns from "../lib";
import "./side";
import type { Only } from './types';
// export function commented() {}
const text = "export function inString() { }", re = /[}"'`]\/{2}/g;
const tpl = `a ${ inner({ k: `n ${deep()} }` }) } } export class No {`;
export default function main<T extends { k: string }>(this: Window, q: string = "}", n?: Map<string, number[]>, ...rest: Array<() => void>): Promise<{ ok: boolean }> {
  function hidden() { return b('}'); }
  return other(q) /* } */;
}
export const one = 1, go = async ({ a, b }: Props, x = (1 + 2)): Promise<void> => {
  await run<string>(a);
}, two: Array<[number, string]> = [];
export const shout = (s: string) => s.toUpperCase()
export abstract class Store<K> extends Base<{ z: 1 }> implements I {
  private items: Map<string, K> = new Map();
  static handler = (e: Event) => { seen(e); };
  @Input({ a: '}' }) name = '';
  constructor(private readonly db: Db, public x?: number) { super(); init(); }
  get size(): number { return 0; }
  public async load?(@Arg('id') id: string, force = false): Promise<K | { err: string }> {
    const helper = (y: number) => y * 2;
    return this.db.fetch<K>(id, helper(1));
  }
  abstract save(k: K): void;
  *each() { yield 1; }
}
export interface Shape { area(): number; }
export type Alias = { a: string; b: () => void } | 'x;y';
export const enum Color { Red = "}", Blue }
export declare function typed(a: string): void;
export { text as renamed, type T, re } from './re';
export { tpl };
export * from './all';
class Plain { m() { return new Store(); } }
let x = typeof function named() {};
if (x) { lone(); }
"""


def by_role(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_typescript():
    rows = list(syntax.typescript(TS))
    found = by_role(rows)
    assert [(r[1], r[7]["binding"], r[2], r[3], r[7]["kind"]) for r in found["import"]] == [
        ("def", "def", "./x.js", True, "default"), ("a", "b", "./x.js", True, "named"), ("T", "T", "./x.js", True, "named"), ("ns", "ns", "../lib", True, "namespace"), ("", "", "./side", True, ""), ("Only", "Only", "./types", True, "named"),
    ]
    assert [(r[1], r[2]) for r in found["reexport"]] == [("renamed", "./re"), ("T", "./re"), ("re", "./re"), ("tpl", "")]
    defs = {r[1]: r for r in found["def"]}
    assert set(defs) == {"main", "go", "shout", "helper", "typed"}
    assert defs["main"][2] == "main(this: Window, q: string, n?: Map<string, number[]>, ...rest: Array<() => void>): Promise<{ ok: boolean }>"
    assert TS[defs["main"][4] : defs["main"][5]].endswith("/* } */;\n}") and defs["main"][3]
    assert defs["go"][2] == "go({ a, b }: Props, x): Promise<void>" and defs["go"][7]["async"] == "true" and defs["go"][3]
    assert defs["shout"][2] == "shout(s: string)" and TS[defs["shout"][4] : defs["shout"][5]].endswith("s.toUpperCase()")
    assert defs["helper"][2] == "helper(y: number)" and not defs["helper"][3] and defs["typed"][3]
    methods = {r[1]: r for r in found["method"]}
    assert set(methods) == {"load", "save", "each", "m"}
    assert methods["load"][2] == "Store.load(id: string, force): Promise<K | { err: string }>" and methods["load"][6] == "Store" and methods["load"][7]["async"] == "true"
    assert methods["save"][2] == "Store.save(k: K): void" and methods["m"][6] == "Plain"
    assert [(r[1], r[3], r[7].get("bases")) for r in found["class"]] == [("Store", True, "Base"), ("Plain", False, None)]
    exported = {(r[0], r[1]) for r in rows if r[3] and r[0] not in ("import", "reexport")}
    assert exported == {("def", "main"), ("def", "go"), ("def", "shout"), ("def", "typed"), ("const", "one"), ("const", "two"), ("class", "Store"), ("interface", "Shape"), ("type", "Alias"), ("enum", "Color")}
    alias = next(r for r in found["type"])
    assert alias[7]["body"] == "export type Alias = { a: string; b: () => void } | 'x;y'"
    calls = [name for name, _, _ in syntax.typescript_calls(TS, frozenset(syntax.NOT_CALLS["ts"]))]
    assert sorted(calls) == sorted(["inner", "deep", "b", "other", "run", "toUpperCase", "seen", "Input", "init", "Arg", "fetch", "helper", "lone"])


def test_long_bodies_are_cut():
    source = "export function f() {\n" + "x();\n" * 5000 + "}\n"
    row = next(iter(syntax.typescript(source)))
    assert len(row[7]["body"]) == 10_000 + len("\n// ... (truncated)") and row[5] == len(source) - 1


@pytest.mark.parametrize("text", ["", "{", "}", "`${`", "export {", "export const", "class A {", "import {", "/* open", "'", "function f(", "export class A { m(", "a = b / c / d; export const z = `}`", "export type", "x ? /}/ : y", "@", "class B { @ ( }", "class C { [x]: y; #p() {} }", "const f = (", "export const {a} = b, [c] = d;"])
def test_broken_texts_end(text):
    list(syntax.typescript(text))
    list(syntax.typescript_calls(text, frozenset()))
    list(syntax.c_source(text))
    list(syntax.python(text))


C = r"""
#include "own.h" /* " */
  #  include <sys/types.h>
// #include "never.h"
#define OPEN() do { \
    if (x) {
static inline int hid(char c) { return c == '{' || c == '"'; }
struct point { int x; };
const char *name_of(struct point *p,
                    int (*cb)(int)) {
    const char *s = "}}{\"";   /* } */
    if (cb(1)) { hid('}'); }
    return s;
}
int _private(void) { return 0; }
int declared(int a);
static struct point origin = { 0 };
unsigned long after(void)
{
    return name_of(&origin, 0) != 0;
}
"""


def test_c():
    found = by_role(syntax.c_source(C))
    assert [(r[1], r[3]) for r in found["import"]] == [("own.h", True), ("sys/types.h", False)]
    assert [(r[1], r[2], r[3]) for r in found["def"]] == [
        ("hid", "static inline int hid(char c)", False),
        ("name_of", "const char *name_of(struct point *p, int (*cb)(int))", True),
        ("_private", "int _private(void)", False),
        ("after", "unsigned long after(void)", True),
    ]
    assert C[found["def"][1][4] : found["def"][1][5]].endswith("return s;\n}")


PY = '''
import os, sys as system  # both
from .models import Item as I, Base
@dataclasses.dataclass
class Order(Base, abc.ABC, metaclass=M):
    @property
    def total(self, rate: float = 1.0) -> float:
        def inner():
            return helper(1)
        return inner()
    @staticmethod
    def build(cls, x): return tax(x)
class _Kept: pass
@router.get("/orders/{id}")
@cached
async def read(
    id: int,
    item: Item = None,
) -> Order:
    return Order(id)
@app.route("/old", methods=["POST"])
def old(): pass
@pytest.fixture
def db(): return connect()
@abc.abstractmethod
def must(): ...
def _private(): helper(2)
x = helper(3)
'''


def test_python():
    rows = list(syntax.python(PY))
    found = by_role(rows)
    assert [(r[1], r[3]) for r in found["import"]] == [("os", False), ("sys", False), ("Item", True), ("Base", True)]
    order, kept = found["class"]
    assert order[7] == {"decorators": "dataclasses.dataclass", "kind": "class", "signature": "class Order(Base, abc.ABC)", "bases": "Base, abc.ABC", "dataclass": "true", "abstract": "true"} and kept[3]
    assert [(r[1], r[6], r[7]["signature"]) for r in found["method"]] == [("total", "Order", "Order.total(rate: float = 1.0) -> float"), ("inner", "Order", "Order.inner()"), ("build", "Order", "Order.build(cls, x)")]
    defs = {r[1]: r for r in found["def"]}
    assert defs["read"][7] == {"decorators": "router.get, cached", "signature": "read(id: int, item: Item = None) -> Order", "kind": "route", "route_method": "GET", "route_path": "/orders/{id}", "async": "true"}
    assert defs["old"][7]["route_method"] == "POST" and defs["db"][7]["kind"] == "fixture" and defs["must"][7]["abstract"] == "true" and not defs["_private"][3]
    calls = {(name, owner, caller) for name, _, _, owner, caller in syntax.attributed(rows, syntax.plain_calls(PY, frozenset(["Order"])), True) if name in ("helper", "tax", "connect")}
    assert calls == {("helper", "inner", "Order"), ("tax", "build", "Order"), ("connect", "db", "db"), ("helper", "_private", None), ("helper", None, None)}


SOURCES = {
    "app/__init__.py": "from .models import Item\n",
    "app/models.py": "class Base:\n    pass\n\n\nclass Item(Base):\n    def save(self):\n        return store(self)\n",
    "app/views.py": "from .models import Item\nfrom .db import store\n\n\n@router.post('/items')\ndef add(item: Item) -> Item:\n    return store(item)\n\n\nclass _Hidden:\n    def go(self): return store(1)\n",
    "app/db.py": "def store(x):\n    return x\n",
    "other/models.py": "class Item:\n    pass\n",
    "app/views.ts": "import { Item } from './models.js';\nexport function show(i: Item) { return render(i); }\n",
    "app/models.ts": "export interface Item { id: string }\nexport { show } from './views';\n",
    "app/ui/render.ts": "export const render = (i: { id: string }) => i.id;\n",
    "tool/main.c": '#include "util.h"\nint main(int argc, char **argv) { return help("}"); }\n',
    "tool/util.c": "int help(const char *s) { return 0; }\n",
}


def test_notes_of_a_mixed_tree(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    for name, text in SOURCES.items():
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text(text)
    run = lambda *x: mirror.mirror_workspace(spark, str(src), str(out), list(x), "w")
    first = run("py", "ts", "c")
    notes = {str(p.relative_to(out)): p.read_text() for p in out.rglob("*.md")}
    assert first["cleaned"] == 0 and sum(first["written"].values()) == len(notes)
    # names that several languages want
    assert {"app_module.md", "app_module_ts.md", "root_module.md", "root_module_ts.md", "root_module_c.md", "app/ui_module.md", "tool_module.md", "app/models.md", "app/models_ts.md", "app/views.md", "app/views_ts.md", "tool/tool-main.md"} <= set(notes)
    assert "language: py" in notes["app_module.md"] and "language: ts" in notes["app_module_ts.md"]
    assert "[[code/w/app/views_ts]]" in notes["app_module_ts.md"] and "[[code/w/app/views]]" in notes["app_module.md"]
    assert "[[code/w/app/ui_module]]" in notes["app_module.md"] and "## Parent\n- [[code/w/root_module_ts]]" in notes["app_module_ts.md"]
    assert "parentModule: code/w/app_module_ts" in notes["app/views_ts.md"] and "parentFile: code/w/app/views_ts" in notes["app/views_ts/show.md"]
    # what a symbol inherits, names, calls, and what calls it
    item = notes["app/models/Item.md"]
    assert "## Inherits\n- [[code/w/app/models/Base|Base]]" in item and "publicApi: true" in item and "baseClasses: [Base]" in item
    assert "## Calls Into\n- [[code/w/app/db/store|store]]" in item
    add = notes["app/views/add.md"]
    assert "routeMethod: POST" in add and 'routePath: "/items"' in add and "symbolKind: route" in add and "## Type References\n- [[code/w/app/models/Item|Item]]" in add
    called = notes["app/db/store.md"]
    assert "- [[code/w/app/models/Item|Item]]" in called and "- [[code/w/app/views/add|add]]" in called and "- [[code/w/app/views/Hidden|_Hidden]]" in called
    assert "```ts\nexport function show(i: Item) { return render(i); }\n```" in notes["app/views_ts/show.md"] and "[[code/w/app/ui/render/render|render]]" in notes["app/views_ts/show.md"]
    assert "symbolKind: reexport" in notes["app/models_ts/show.md"]
    assert "### `add(item: Item) -> Item` *(exported)*\n*Calls into: [[code/w/app/db]] (`store`)*" in notes["app/views.md"] and "[[code/w/app/models]] — `Item`" in notes["app/views.md"]
    assert "  - entrypoint" in notes["tool/tool-main.md"] and "- `help` in [[code/w/tool/util]]" in notes["tool/tool-main.md"]
    # again, in any order: nothing is written, nothing deleted
    assert run("c", "ts", "py") == {"written": {"py": 0, "ts": 0, "c": 0}, "skipped": first["written"], "cleaned": 0}
    # the owner is gone: its name is free
    for name in SOURCES:
        if not name.endswith(".ts"):
            (src / name).unlink()
    run("py", "ts")
    assert "language: ts" in (out / "app_module.md").read_text() and not (out / "app/db.md").exists() and not (out / "app_module_ts.md").exists()
