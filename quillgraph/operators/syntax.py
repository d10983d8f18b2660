"""What a source file defines, imports and calls, by language: helpers that read one file's text.

A row is (role, name, detail, exported, begin, end, owner, traits).  ``detail`` is the module of an import and the first
line or signature of a definition; ``owner`` the class of a method; ``traits`` what else is known, as text: signature,
body, async, decorators, bases, abstract, dataclass, route_method, route_path, kind, binding.  TypeScript and C are read
after their comments, strings, templates, regular expressions and directives have been blanked out, so that brackets in
them count for nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

# Names that look like calls but aren't reported as such, by language.
NOT_CALLS: dict[str, list[str]] = {
    "py": [
        "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del", "elif", "else", "except",
        "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try", "while",
        "with", "yield", "print", "len", "range", "list", "dict", "set", "tuple", "str", "int", "float", "bool", "bytes", "type", "isinstance",
        "issubclass", "hasattr", "getattr", "setattr", "delattr", "callable", "iter", "next", "enumerate", "zip", "map", "filter", "sorted",
        "reversed", "sum", "min", "max", "abs", "round", "open", "input", "repr", "hash", "id", "dir", "vars", "locals", "globals", "super",
        "object", "property", "staticmethod", "classmethod", "dataclass", "field", "asdict", "Optional", "Any", "List", "Dict", "Set", "Tuple",
        "Union", "Literal", "Callable", "Type", "ClassVar",
    ],
    "c": [
        "auto", "break", "case", "char", "const", "continue", "default", "do", "double", "else", "enum", "extern", "float", "for", "goto", "if",
        "inline", "int", "long", "register", "restrict", "return", "short", "signed", "sizeof", "static", "struct", "switch", "typedef", "union",
        "unsigned", "void", "volatile", "while", "_Alignas", "_Alignof", "_Atomic", "_Bool", "_Complex", "_Generic", "_Imaginary", "_Noreturn",
        "_Static_assert", "_Thread_local",
    ],
    "ts": [
        "if", "for", "while", "switch", "return", "catch", "function", "typeof", "new", "await", "super", "constructor", "import",
    ],
}
# Fixed value: characters of a symbol's text that its note holds at most.
MOST_BODY = 10_000

NAME = r"[A-Za-z_$][\w$]*"
_TS_TOKEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|[`{}/]""", re.S)
_C_TOKEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|(?<![^\n])[ \t]*\#(?:\\.|/(?![/*])|[^\\\n/])*""", re.S)
_TS_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/")
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^]|(?<![\w$.])(?:return|typeof|case|in|of|delete|void|throw|else|do|await|yield))\s*\Z")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{|\Z)", re.S)


def blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


class Code:
    """A text with its comments (``plain``), and also its strings and the like (``code``), blanked out; places stay the same."""

    def __init__(self, source: str, language: str):
        self.source = source
        both, plain = [], []
        token, at, templates = _C_TOKEN if language == "c" else _TS_TOKEN, 0, []

        def keep(end: int) -> None:
            nonlocal at
            both.append(source[at:end])
            plain.append(source[at:end])
            at = end

        def hide(end: int, comment: bool = False) -> None:
            nonlocal at
            both.append(blank(source[at:end]))
            plain.append(both[-1] if comment else source[at:end])
            at = end

        while m := token.search(source, at):
            text = m.group()
            keep(m.start())
            if text.startswith(("//", "/*")):
                hide(m.end(), comment=True)
            elif text[0] in "\"'":
                keep(at + 1)
                hide(m.end() - (len(text) > 1 and text[-1] == text[0]))
                keep(m.end())
            elif text == "/":
                regex = _TS_REGEX.match(source, at) if _BEFORE_REGEX.search(both[-1][-60:] or "".join(both[-3:])[-60:]) else None
                hide(regex.end()) if regex else keep(m.end())
            elif text == "`" or text == "}" and templates and not templates[-1]:
                if text == "}":
                    templates.pop()
                keep(m.end())
                end = _TEMPLATE.match(source, at)
                hide(end.start(1))
                if end.group(1) == "${":
                    templates.append(0)
                keep(end.end())
            elif text in "{}":
                if templates:
                    templates[-1] += 1 if text == "{" else -1
                keep(m.end())
            else:  # a directive
                hide(m.end())
        keep(len(source))
        self.code, self.plain = "".join(both), "".join(plain)
        self.close: dict[int, int] = {}
        self._at, self._depth, open_ = [], [], []
        for m in re.finditer(r"[()\[\]{}]", self.code):
            if m.group() in "([{":
                open_.append(m.start())
            elif open_ and self.code[open_[-1]] + m.group() in ("()", "[]", "{}"):
                self.close[open_.pop()] = m.start()
            self._at.append(m.start())
            self._depth.append(len(open_))

    def depth(self, at: int) -> int:
        """Brackets open before a place."""
        i = bisect_right(self._at, at - 1) - 1
        return self._depth[i] if i >= 0 else 0

    def after(self, at: int, end: int | None = None) -> int:
        """The next place that isn't blank."""
        end = len(self.code) if end is None else end
        while at < end and self.code[at].isspace():
            at += 1
        return at

    def before(self, at: int) -> int:
        """The last place before ``at`` that isn't blank; -1 if there is none."""
        at -= 1
        while at >= 0 and self.code[at].isspace():
            at -= 1
        return at

    def angle(self, at: int, end: int) -> int:
        """Behind the ``>`` that closes the ``<`` at a place; ``at`` itself if none does."""
        depth, i = 0, at
        while i < end:
            c = self.code[i]
            if c == "<":
                depth += 1
            elif c == ">" and self.code[i - 1] != "=":
                depth -= 1
                if not depth:
                    return i + 1
            elif c in "([{":
                i = self.close.get(i, end)
            elif c in ");":
                return at
            i += 1
        return at

    def pieces(self, begin: int, end: int, stop: str) -> Iterator[tuple[int, int]]:
        """Parts between the ``stop`` characters that stand in no brackets."""
        i = begin
        while i < end:
            c = self.code[i]
            if c in "([{" and i in self.close:
                i = self.close[i]
            elif c == "<" and (far := self.angle(i, end)) > i:
                i = far - 1
            elif c == stop and not (stop == "=" and (self.code[i + 1 : i + 2] in ("=", ">") or self.code[i - 1] in "=!<>")):
                yield begin, i
                begin = i + 1
            i += 1
        yield begin, end

    def type_end(self, at: int, arrow: bool = False) -> int:
        """Where a type that begins at a place ends: before a body, an arrow (``arrow``), ``=``, ``,``, ``;`` or a new statement."""
        i, last = at, ":"
        while i < len(self.code):
            c = self.code[i]
            if c in "([" or c == "{" and last in ":|&<,>=":
                i, last = self.close.get(i, len(self.code)) + 1, ")"
                continue
            if c == "<" and (far := self.angle(i, len(self.code))) > i:
                i, last = far, "]"
                continue
            if c == "=" and self.code[i + 1 : i + 2] == ">" and not arrow:
                i, last = i + 2, ">"
                continue
            if c in "{=,;)}" or c == "\n" and last not in ":|&<,>=" and self.code[self.after(i) : self.after(i) + 1] not in ("{", "|", "&", "="):
                return i
            if not c.isspace():
                last = c
            i += 1
        return i

    def expression_end(self, at: int) -> int:
        """Where an expression ends: before ``,``, ``;``, a closing bracket or the line end at which a statement ends."""
        i = at
        while i < len(self.code):
            c = self.code[i]
            if c in "([{":
                i = self.close.get(i, len(self.code)) + 1
                continue
            if c in ",;)]}":
                return i
            if c == "\n":
                last, following = self.code[max(self.before(i), 0)], self.code[self.after(i) : self.after(i) + 1]
                if i > at and last not in "=+-*/%&|?:.<>(!~^{[," and following not in tuple(".?:+-*/%&|,=<>(["):
                    return i
            i += 1
        return i


def typescript(source: str) -> Iterator[tuple]:
    """Imports, exports and functions.  A function within a function isn't a row, one within a method is."""
    c = Code(source, "ts")
    code = c.code
    for m in re.finditer(rf"""(?m)^[ \t]*(?:;[ \t]*)?import\b(?!\s*[(.])([^;"'=]*?)(["'])""", code):
        if c.depth(m.start()):
            continue
        quote = m.start(2)
        module = source[quote + 1 : code.index(m.group(2), quote + 1)] if m.group(2) in code[quote + 1 :] else ""
        names = re.sub(r"\bfrom\s*$|^\s*type\b(?!\s*(?:from\b|,))", "", m.group(1).strip())
        listed = re.search(r"\{(.*)\}", names, re.S)
        found = [("named", re.sub(r"^type\s+", "", p.strip())) for p in (listed.group(1).split(",") if listed else []) if p.strip()]
        rest = names[: listed.start()] if listed else names
        found = [("namespace" if "*" in p else "default", re.split(r"\bas\s+", p.strip())[-1]) for p in rest.split(",") if p.strip()] + found
        for kind, name in found or [("", "")]:
            name, *local = re.split(r"\s+as\s+", name)
            yield "import", name, module, module.startswith("."), m.start(), quote + len(module) + 2, None, {"kind": kind, "binding": (local or [name])[-1]}
    for m in re.finditer(r"(?<![\w$.])export\s+(?:type\s+)?\{", code):
        if not c.depth(m.start()) and (end := c.close.get(m.end() - 1)):
            tail = re.compile(r"""\s*from\s*(["'])""").match(code, end + 1)
            module = source[tail.end() : code.index(tail.group(1), tail.end())] if tail else ""
            for a, b in c.pieces(m.end(), end, ","):
                name = re.split(r"\s+as\s+", re.sub(r"^type\s+", "", c.plain[a:b].strip()))[-1]
                if name:
                    yield "reexport", name, module, True, m.start(), end + 1, None, {}
    yield from _ts_definitions(c)


_TS_DEFINITION = re.compile(
    rf"(?<![\w$.])(export\s+)?(?:default\s+)?(?:declare\s+)?(abstract\s+)?(async\s+)?(function\b\s*\*?|class\b|interface\b|type\b|(?:const\s+)?enum\b|const\b|let\b|var\b)\s*({NAME})"
)


def _ts_definitions(c: Code) -> Iterator[tuple]:
    code, upto = c.code, 0
    for m in _TS_DEFINITION.finditer(code):
        begin, name_end, kind, name = m.start(), m.end(), m.group(4).split()[-1].rstrip("*").strip() or "function", m.group(5)
        kind = "function" if kind.startswith("function") else kind
        if begin < upto or m.group(5) in ("extends", "implements"):
            continue
        exported, top = bool(m.group(1)) and not c.depth(begin), not c.depth(begin)
        if kind == "function":
            p = c.before(begin)
            if not m.group(1) and p >= 0 and (code[p] in "=(,:?&|!+-*/<>[%^~" or re.search(r"(?<![\w$.])(?:return|typeof|new|void|await|yield)\Z", code[max(0, p - 8) : p + 1])):
                continue  # an expression
            params, ret, at = _ts_signature(c, name_end)
            if params is None:
                continue
            end = c.close.get(at, len(code) - 1) + 1 if code[at : at + 1] == "{" else at
            upto = end
            traits = {"signature": f"{name}({params}){ret}", "kind": "function"} | ({"async": "true"} if m.group(3) else {})
            yield "def", name, traits["signature"], exported, begin, end, None, traits | _body(c, begin, end, exported)
        elif kind in ("const", "let", "var"):
            found, at = [], m.start(5)
            while first := re.compile(NAME).match(code, at):
                stop = c.after(first.end())
                if code[stop : stop + 1] == "!":
                    stop = c.after(stop + 1)
                if code[stop : stop + 1] == ":":
                    stop = c.after(c.type_end(stop + 1))
                function = _ts_function_value(c, c.after(stop + 1)) if code[stop : stop + 1] == "=" and code[stop + 1 : stop + 2] not in (">", "=") else None
                end = function[3] if function else c.expression_end(stop + 1 if code[stop : stop + 1] == "=" else stop)
                found.append((first.group(), first.start(), end, function))
                at = c.after(end)
                if code[at : at + 1] != ",":
                    break
                at = c.after(at + 1)
            whole = _body(c, begin, found[-1][2], exported)
            for one, start, end, function in found:
                if function:
                    params, ret, is_async, _ = function
                    traits = {"signature": f"{one}({params}){ret}", "kind": "const"} | ({"async": "true"} if is_async else {})
                    yield "def", one, traits["signature"], exported, begin if one == name else start, end, None, traits | whole
                    upto = max(upto, end)
                elif top:
                    yield kind, one, c.plain[start:end].strip()[:200], exported, begin if one == name else start, end, None, {"kind": "const"} | whole
        elif kind == "class":
            at = name_end
            while at < len(code) and code[at] not in "{;":
                far = c.angle(at, len(code)) if code[at] == "<" else at
                at = far if far > at else c.close.get(at, at) + 1 if code[at] in "([" else at + 1
            end = c.close.get(at, len(code) - 1) + 1 if code[at : at + 1] == "{" else at
            bases = re.search(rf"\bextends\s+({NAME}(?:\.{NAME})*)", code[name_end:at])
            traits = {"kind": "class"} | ({"bases": bases.group(1)} if bases else {}) | ({"abstract": "true"} if m.group(2) else {})
            yield "class", name, c.plain[begin:at].strip(), exported, begin, end, None, traits | _body(c, begin, end, exported)
            yield from _ts_methods(c, name, at + 1, end - 1)
        elif top and not (kind == "type" and code[c.after(name_end) : c.after(name_end) + 1] not in ("=", "<")):
            at = code.find("{", name_end)
            end = c.expression_end(name_end) if kind == "type" or at < 0 else c.close.get(at, len(code) - 1) + 1
            yield kind, name, c.plain[begin:end].split("\n")[0].strip(), exported, begin, end, None, {"kind": kind} | _body(c, begin, end, exported)


def _body(c: Code, begin: int, end: int, exported: bool) -> dict[str, str]:
    text = c.source[begin:end]
    return {"body": text if len(text) <= MOST_BODY else text[:MOST_BODY] + "\n// ... (truncated)"} if exported else {}


def _ts_signature(c: Code, at: int, arrow: bool = False) -> tuple[str | None, str, int]:
    """Parameters and return type of a function whose name ends at a place, and what follows; None if there are no parameters."""
    at = c.after(at)
    if c.code[at : at + 1] == "<":
        at = c.after(c.angle(at, len(c.code)))
    if c.code[at : at + 1] != "(" or at not in c.close:
        return None, "", at
    end = c.close[at]
    shown = [_ts_parameter(c, a, b) for a, b in c.pieces(at + 1, end, ",") if c.code[a:b].strip()]
    at, ret = c.after(end + 1), ""
    if c.code[at : at + 1] == ":":
        stop = c.type_end(at + 1, arrow)
        ret, at = ": " + c.plain[at + 1 : stop].strip(), c.after(stop)
    elif c.code[end + 1 : at].count("\n") and c.code[at : at + 1] not in ("{", "="):
        at = end + 1
    return ", ".join(shown), ret, at


def _ts_parameter(c: Code, begin: int, end: int) -> str:
    """A parameter with its type, without its default, modifiers and decorators."""
    end = next(c.pieces(begin, end, "="))[1]
    head = re.compile(rf"\s*(?:@{NAME}(?:\([^()]*\))?\s*)*(?:(?:public|private|protected|readonly|override)\s+(?={NAME}|[{{\[]))*(\.\.\.)?\s*").match(c.code, begin, end)
    at = head.end()
    stop = c.close.get(at, end) + 1 if c.code[at : at + 1] in "{[" else re.compile(rf"(?:{NAME})?").match(c.code, at, end).end()
    name, at = c.plain[at:stop].strip(), c.after(stop, end)
    optional = "?" if c.code[at : at + 1] == "?" and at < end else ""
    at = c.after(at + len(optional), end)
    kind = f": {c.plain[at + 1 : end].strip()}" if at < end and c.code[at] == ":" else ""
    return f"{head.group(1) or ''}{name}{optional}{kind}"


def _ts_function_value(c: Code, at: int) -> tuple[str, str, bool, int] | None:
    """Parameters, return type, whether async, and end of an arrow function or function expression at a place."""
    m = re.compile(rf"(async\b\s*)?(?:(function)\b\s*\*?\s*(?:{NAME})?|(?=[(<])|({NAME})\s*(?==>))").match(c.code, at)
    if not m:
        return None
    if m.group(3):
        params, ret, stop = m.group(3), "", c.after(m.end())
    else:
        params, ret, stop = _ts_signature(c, m.end(), arrow=not m.group(2))
    if params is None or not m.group(2) and c.code[stop : stop + 2] != "=>":
        return None
    body = stop if m.group(2) else c.after(stop + 2)
    end = c.close.get(body, len(c.code) - 1) + 1 if c.code[body : body + 1] == "{" else c.expression_end(body)
    return params, ret, bool(m.group(1)), end


def _ts_methods(c: Code, owner: str, at: int, end: int) -> Iterator[tuple]:
    member = re.compile(rf"((?:(?:public|private|protected|static|abstract|override|readonly|declare|async)\s+(?=[\w$*#\[\"']))*)((?:get|set)\s+(?=[\w$#\[\"']))?\*?\s*({NAME})?")
    while (at := c.after(at, end)) < end:
        if c.code[at] in ";,":
            at += 1
            continue
        if c.code[at] == "@":
            at = re.compile(r"@[\w$.]+").match(c.code, at).end() if re.compile(r"@[\w$.]+").match(c.code, at) else at + 1
            at = c.close.get(at, at - 1) + 1
            continue
        m = member.match(c.code, at)
        params, ret, stop = None, "", at
        if m.group(3):
            mark = c.after(m.end())
            params, ret, stop = _ts_signature(c, mark + 1 if c.code[mark : mark + 1] == "?" else mark)
        if params is None:  # a property, or a name that isn't plain
            stop = m.end()
            while stop < end and c.code[stop] not in ";\n={(":
                stop = c.close.get(stop, stop) + 1 if c.code[stop] == "[" else stop + 1
            if c.code[stop : stop + 1] == "(":
                _, _, stop = _ts_signature(c, stop)
                at = c.close.get(stop, stop) + 1 if c.code[stop : stop + 1] == "{" else max(stop, at + 1)
            else:
                at = max(c.expression_end(stop + 1) if c.code[stop : stop + 1] == "=" else c.close.get(stop, stop) + 1, at + 1)
            continue
        stop_body = c.close.get(stop, len(c.code) - 1) + 1 if c.code[stop : stop + 1] == "{" else stop
        if m.group(3) != "constructor" and not m.group(2):
            traits = {"signature": f"{owner}.{m.group(3)}({params}){ret}"} | ({"async": "true"} if "async" in m.group(1).split() else {})
            yield "method", m.group(3), traits["signature"], False, at, stop_body, owner, traits
        at = max(stop_body, at + 1)


def typescript_calls(source: str, skip: frozenset[str]) -> Iterator[tuple[str, int, int]]:
    """Calls by name or property, outside comments and strings; not ``new``, definitions or keywords."""
    c = Code(source, "ts")
    for m in re.finditer(rf"(?<![\w$])({NAME})\s*(?:\?\.\s*)?(?:<[^<>();{{}}=]*>)?\s*\(", c.code):
        name, before = m.group(1), c.code[max(0, m.start() - 12) : m.start()]
        if name in skip or re.search(r"(?<![\w$.])(?:new|function|get|set)\s*\*?\s*$", before):
            continue
        opened = c.code.index("(", m.end() - 1)
        behind = c.after(c.close.get(opened, len(c.code)) + 1)
        if name == "async" and c.code[behind : behind + 1] in ("=", ":"):
            continue  # an arrow function
        if c.code[behind : behind + 1] == "{" or c.code[behind : behind + 1] == ":" and re.search(r"(?:^|[;{}\n,]|\b(?:async|static|public|private|protected|override|abstract))\s*$", before) and c.code[c.type_end(behind + 1) : c.type_end(behind + 1) + 1] in ("{", ";"):
            continue  # a method
        yield name, m.start(1), m.end()


def c_source(source: str) -> Iterator[tuple]:
    c = Code(source, "c")
    for m in re.finditer(r'(?m)^[ \t]*#[ \t]*include[ \t]*([<"])([^>"\n]+)', c.plain):
        yield "import", m.group(2).strip(), m.group(2).strip(), m.group(1) == '"', m.start(), m.end(), None, {}
    for m in re.finditer(r"(?<!\w)([A-Za-z_]\w*)\s*\(", c.code):
        end = c.close.get(m.end() - 1)
        if end is None or c.depth(m.start()) or m.group(1) in NOT_CALLS["c"]:
            continue
        body = c.after(end + 1)
        begin = c.after(max(c.code.rfind(x, 0, m.start()) for x in ";}") + 1)
        kind = c.code[begin : m.start()].split()
        if c.code[body : body + 1] != "{" or not kind or not re.fullmatch(r"[\w\s*]+", c.code[begin : m.start()]):
            continue
        signature = " ".join(c.plain[begin : end + 1].split())
        exported = "static" not in kind and not m.group(1).startswith("_")
        yield "def", m.group(1), signature, exported, begin, c.close.get(body, len(source) - 1) + 1, None, {"signature": signature, "kind": "function"}


_STRING = re.compile(r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|#.*""")


def python(source: str) -> Iterator[tuple]:
    """Definitions by indentation, with their decorators and what those say; imports."""
    lines = source.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    listed = re.search(r"(?m)^__all__\s*=\s*[\[(]([^\])]*)", source)
    public = set(re.findall(r"""["'](\w+)["']""", listed.group(1))) if listed else None
    decorators: list[str] = []
    owner: str | None = None
    for n, line in enumerate(lines):
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        if text.startswith("@"):
            decorators.append(text)
            continue
        if m := re.match(r"([ \t]*)(async\s+)?(def|class)\s+(\w+)", line):
            indent, kind, name = len(m.group(1).expandtabs(4)), m.group(3), m.group(4)
            # a definition ends before the next line that isn't deeper; signatures may go over several lines
            k, depth = n, 0
            while k < len(lines):
                bare = _STRING.sub("", lines[k])
                depth += sum(bare.count(c) for c in "([{") - sum(bare.count(c) for c in ")]}")
                if depth <= 0:
                    break
                k += 1
            head = " ".join(x.strip() for x in lines[n : k + 1])
            k += 1
            while k < len(lines) and (not lines[k].strip() or len(lines[k].expandtabs(4)) - len(lines[k].expandtabs(4).lstrip()) > indent):
                k += 1
            if not indent:
                owner = name if kind == "class" else None
            exported = indent == 0 and (public is None or name in public) and (kind == "class" or not name.startswith("_"))
            role = kind if indent == 0 else "method" if kind == "def" else "inner class"
            traits = _python_traits(kind, name, head, decorators, owner if role == "method" else None)
            yield role, name, text, exported, starts[n], starts[min(k, len(lines))] - 1, owner if role == "method" else None, traits | ({"async": "true"} if m.group(2) else {})
        elif m := re.match(r"from\s+(\.*[\w.]*)\s+import\s+(.+)", line):
            for part in m.group(2).split("#")[0].strip("() \\").split(","):
                if part.strip():
                    yield "import", part.split()[0], m.group(1), m.group(1).startswith("."), starts[n], starts[n] + len(line), None, {"binding": part.split()[-1]}
        elif m := re.match(r"import\s+(.+)", line):
            for part in m.group(1).split("#")[0].split(","):
                if part.strip():
                    yield "import", part.split()[0], part.split()[0], False, starts[n], starts[n] + len(line), None, {}
        if line[:1] not in (" ", "\t", ")", "]", "}") and not re.match(r"(?:async\s+)?(?:def|class)\b", line):
            owner = None
        decorators = []


def _python_traits(kind: str, name: str, head: str, decorators: list[str], owner: str | None) -> dict[str, str]:
    names = [d[1:].split("(")[0].strip() for d in decorators]
    out = {"decorators": ", ".join(names)} if names else {}
    ends = {n.rpartition(".")[2] for n in names}
    if kind == "class":
        m = re.match(r"class\s+\w+\s*(?:\((.*)\))?\s*:", head)
        bases = [b.strip() for b in (m.group(1) or "").split(",") if b.strip() and "=" not in b] if m else []
        out |= {"kind": "class", "signature": f"class {name}({', '.join(bases)})" if bases else f"class {name}"}
        out |= {"bases": ", ".join(bases)} if bases else {}
        out |= {"dataclass": "true"} if "dataclass" in ends else {}
        return out | ({"abstract": "true"} if {"ABC", "abc.ABC", "Protocol", "typing.Protocol"} & set(bases) else {})
    m = re.match(r"(?:async\s+)?def\s+\w+\s*\(([^)]*(?:\([^)]*\)[^)]*)*)\)\s*(?:->\s*([^:]+?))?\s*:", head)
    params = m.group(1).strip().rstrip(",") if m else "..."
    if owner and "staticmethod" not in names:
        params = re.sub(r"^(?:self|cls)\b\s*,?\s*", "", params).strip()
    out["signature"] = f"{owner + '.' if owner else ''}{name}({params})" + (f" -> {m.group(2).strip()}" if m and m.group(2) else "")
    out["kind"] = "function"
    out |= {"abstract": "true"} if {"abstractmethod", "abc.abstractmethod"} & set(names) else {}
    for line in decorators:
        if v := re.match(r"""@[\w.]+\.(get|post|put|patch|delete|head|options)\s*\(\s*["']([^"']+)["']""", line, re.I):
            return out | {"kind": "route", "route_method": v.group(1).upper(), "route_path": v.group(2)}
        if v := re.match(r"""@[\w.]*route\s*\(\s*["']([^"']+)["']""", line, re.I):
            verb = re.search(r"""methods\s*=\s*\[\s*["'](\w+)["']""", line, re.I)
            return out | {"kind": "route", "route_method": verb.group(1).upper() if verb else "GET", "route_path": v.group(1)}
    return out | ({"kind": "fixture"} if "fixture" in ends else {})


def plain_calls(source: str, skip: frozenset[str]) -> Iterator[tuple[str, int, int]]:
    """Every name before a parenthesis, comments and strings included."""
    for m in re.finditer(r"(?<![\w$])([A-Za-z_$][\w$]*)\s*\(", source):
        if m.group(1) not in skip:
            yield m.group(1), m.start(), m.end()


def attributed(definitions: list[tuple], calls: Iterator[tuple[str, int, int]], by_class: bool) -> Iterator[tuple]:
    """Calls (name, begin, end) with ``owner``, the innermost definition around them, and ``caller``, the exported symbol they count for.

    One sweep over sorted places, with a stack of the definitions open there.  A symbol is the outermost function, if it
    is exported; for a method it is its class, if that is exported and ``by_class``.
    """
    spans = sorted((d for d in definitions if d[0] in ("def", "method")), key=lambda d: (d[4], -d[5]))
    classes = {d[1] for d in definitions if d[0] == "class" and d[3]}
    open_: list[tuple] = []
    n = 0
    for name, begin, end in sorted(calls, key=lambda x: x[1]):
        while n < len(spans) and spans[n][4] <= begin:
            while open_ and open_[-1][5] < spans[n][4]:
                open_.pop()
            open_.append(spans[n])
            n += 1
        while open_ and open_[-1][5] < begin:
            open_.pop()
        outer = open_[0] if open_ else None
        caller = None if outer is None else (outer[6] if by_class and outer[6] in classes else None) if outer[0] == "method" else outer[1] if outer[3] else None
        yield name, begin, end, open_[-1][1] if open_ else None, caller


EXTRACTORS = {"py": python, "c": c_source, "ts": typescript}
CALLS = {"ts": typescript_calls}
