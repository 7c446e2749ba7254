"""Symbols and configuration fields of source files (P8, P9), ``__all__`` lists (S18) and snippet checks.

Python is read with its own parser. Go, TypeScript/JavaScript and Rust are read by a scanner that blanks comments and strings,
keeps places, and matches braces; declarations are then found by patterns on what is left.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Endings by language.
LANGUAGE = {"py": "python", "go": "go", "js": "js", "jsx": "js", "ts": "js", "tsx": "js", "rs": "rust"}


@dataclass
class Field:
    name: str
    field_type: str | None
    default_value: str | None
    line: int
    is_optional: bool
    tags: dict[str, str] = field(default_factory=dict)
    doc: str | None = None


@dataclass
class Symbol:
    name: str
    type: str
    line: int
    column: int
    signature: str | None = None
    parent: str | None = None
    doc: str | None = None
    fields: list[Field] = field(default_factory=list)


# Python


def _config_kind(node: ast.ClassDef) -> bool:
    marks = [ast.unparse(d) for d in node.decorator_list]
    bases = [ast.unparse(b) for b in node.bases]
    by_mark = any(re.search(r"\bdataclass\b|\battrs?\b|\bdefine\b", m) for m in marks)
    return by_mark or any(re.search(r"BaseModel|BaseSettings|TypedDict", b) for b in bases)


def _python_fields(node: ast.ClassDef) -> list[Field]:
    out = []
    for x in node.body:
        if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name) and not x.target.id.startswith("_"):
            kind = ast.unparse(x.annotation)
            doc = None
            if isinstance(x.value, ast.Call):
                doc = next((k.value.value for k in x.value.keywords if k.arg == "description" and isinstance(k.value, ast.Constant)), None)
            out.append(Field(x.target.id, kind, ast.unparse(x.value) if x.value else None, x.lineno, "None" in kind or "Optional" in kind, doc=doc))
        elif isinstance(x, ast.Assign) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Name) and not x.targets[0].id.startswith("_"):
            out.append(Field(x.targets[0].id, None, ast.unparse(x.value), x.lineno, False))
    return out


def _python(text: str) -> list[Symbol]:
    out: list[Symbol] = []

    def signature(x: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
        head = "async def" if isinstance(x, ast.AsyncFunctionDef) else "def"
        return f"{head} {x.name}({ast.unparse(x.args)})" + (f" -> {ast.unparse(x.returns)}" if x.returns else "")

    def walk(node: ast.AST, owner: str | None, direct: bool) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.ClassDef):
                head = f"class {x.name}" + (f"({', '.join(ast.unparse(b) for b in x.bases)})" if x.bases else "")
                out.append(Symbol(x.name, "class", x.lineno, x.col_offset, head, owner, ast.get_docstring(x), _python_fields(x) if _config_kind(x) else []))
                walk(x, x.name, True)
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                method = owner is not None and direct
                out.append(Symbol(x.name, "method" if method else "function", x.lineno, x.col_offset, signature(x), owner if method else None, ast.get_docstring(x)))
                walk(x, owner, False)
            else:
                walk(x, owner, direct)

    walk(ast.parse(text), None, False)
    return sorted(out, key=lambda s: (s.line, s.column))


def module_all(text: str) -> list[str] | None:
    """The names of a module's ``__all__`` if it is a plain list; null without one or if the module can't be parsed."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return None
    for x in tree.body:
        if isinstance(x, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in x.targets) and isinstance(x.value, ast.List):
            return [e.value for e in x.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    return None


def module_lists(modules: DataFrame, key: str) -> DataFrame:
    """(key, names) of ``modules`` (key, text): the names of each module's ``__all__``, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([module_all(t or "") for t in batch.column(1).to_pylist()], type=pa.list_(pa.string()))], names=[key, "names"])

    return modules.select(key, "text").mapInArrow(run, f"`{key}` {dict(modules.dtypes)[key]}, names array<string>")


# Languages with braces


def blanked(text: str, single: bool = True, keep_raw: bool = False) -> str:
    """``text`` with comments and the insides of strings as blanks, of equal length; line ends stay.

    ``single``: whether single quotes hold strings (not in Rust, where they also mark lifetimes). ``keep_raw``: whether
    back-quoted text stays (Go's field tags).
    """
    quotes = '"' + ("'" if single else "")
    token = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|" + "|".join(rf"{q}(?:\\.|[^{q}\\\n])*{q}?" for q in quotes) + r"|`(?:\\.|[^`\\])*`?", re.S)

    def out(m: re.Match) -> str:
        x = m[0]
        if x[0] == "`" and keep_raw:
            return x
        if x.startswith("/"):
            return re.sub(r"[^\n]", " ", x)
        return x[0] + re.sub(r"[^\n]", " ", x[1:-1]) + (x[-1] if len(x) > 1 else "")

    return token.sub(out, text)


def _body(code: str, at: int) -> tuple[int, int] | None:
    """The inside of the next pair of braces from ``at`` on: (start, end), unless a semicolon comes first."""
    start = code.find("{", at)
    stop = code.find(";", at)
    if start < 0 or 0 <= stop < start:
        return None
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, start):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return start + 1, m.start()
    return start + 1, len(code)


def _place(text: str, at: int) -> tuple[int, int]:
    return text.count("\n", 0, at) + 1, at - (text.rfind("\n", 0, at) + 1)


def _head(text: str, code: str, at: int) -> str:
    end = min((i for i in (code.find("{", at), code.find("\n", at)) if i >= 0), default=len(text))
    return " ".join(text[at:end].split())


_CONFIG_NAME = re.compile(r"(?:Config|Settings|Options)$")


def _go(text: str) -> list[Symbol]:
    code, out = blanked(text, keep_raw=True), []
    for m in re.finditer(r"^func\s+(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(", code, re.M):
        out.append(Symbol(m[2], "method" if m[1] else "function", *_place(text, m.start()), _head(text, code, m.start()), m[1]))
    for m in re.finditer(r"^(?:type\s+|\t)(\w+)(?:\[[^\]]*\])?\s+(struct|interface)\s*\{|^type\s+(\w+)\s+(?!struct\b|interface\b|\()[\w\[\]*.=]", code, re.M):
        name, kind = m[1] or m[3], m[2] or "type"
        s = Symbol(name, kind, *_place(text, m.start()))
        if kind == "struct":
            a, b = _body(code, m.start())
            fields = []
            for f in re.finditer(r"^[ \t]*([A-Za-z_]\w*)[ \t]+([^`\n]+?)[ \t]*(`[^`\n]*`)?[ \t]*$", code[a:b], re.M):
                tags = dict(re.findall(r'(\w+):"([^"]*)"', f[3] or ""))
                fields.append(Field(f[1], f[2].strip(), None, _place(text, a + f.start(1))[0], any(v.endswith(",omitempty") for k, v in tags.items() if k in ("yaml", "json")), tags))
            if _CONFIG_NAME.search(name) or any(f.tags.keys() & {"yaml", "json", "toml", "mapstructure"} for f in fields):
                s.fields = fields
        out.append(s)
    return sorted(out, key=lambda s: (s.line, s.column))


def _js(text: str) -> list[Symbol]:
    code, out = blanked(text), []
    lead = r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
    for m in re.finditer(lead + r"(?:async\s+)?function\s*\*?\s+(\w+)", code, re.M):
        out.append(Symbol(m[1], "function", *_place(text, m.start()), _head(text, code, m.start())))
    for m in re.finditer(lead + r"(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=\n]+)?=>", code, re.M):
        out.append(Symbol(m[1], "function", *_place(text, m.start()), _head(text, code, m.start())))
    for m in re.finditer(lead + r"(?:abstract\s+)?class\s+(\w+)", code, re.M):
        out.append(Symbol(m[1], "class", *_place(text, m.start()), _head(text, code, m.start())))
        inside = _body(code, m.start())
        if inside:
            flat = _level(code, *inside)
            for f in re.finditer(r"^[ \t]*(?:(?:public|private|protected|static|async|get|set)\s+)*([A-Za-z_$#][\w$]*)\s*\([^)]*\)[^;{]*\{", flat, re.M):
                if f[1] not in ("if", "for", "while", "switch", "catch", "function", "return"):
                    at = inside[0] + f.start(1)
                    out.append(Symbol(f[1], "method", *_place(text, at), _head(text, code, at), m[1]))
    for m in re.finditer(lead + r"interface\s+(\w+)", code, re.M):
        s = Symbol(m[1], "interface", *_place(text, m.start()))
        inside = _body(code, m.start())
        if inside and re.search(r"(?:Config|Options|Settings|Props)$", m[1]):
            a, b = inside
            for f in re.finditer(r"^[ \t]*(?:readonly\s+)?([A-Za-z_$][\w$]*)(\?)?\s*:", _level(code, a, b), re.M):
                end = re.compile(r"[;,\n]").search(code, a + f.end())
                kind = text[a + f.end() : end.start() if end else b].strip()
                s.fields.append(Field(f[1], kind, None, _place(text, a + f.start(1))[0], bool(f[2])))
        out.append(s)
    return sorted(out, key=lambda s: (s.line, s.column))


def _level(code: str, a: int, b: int) -> str:
    """code[a:b] with what deeper braces hold as blanks."""
    out, depth = [], 0
    for c in code[a:b]:
        if c == "}":
            depth -= 1
        out.append(c if depth <= 0 or c == "\n" else " ")
        if c == "{":
            depth += 1
    return "".join(out)


def _rust(text: str) -> list[Symbol]:
    code, out = blanked(text, single=False), []
    pub = r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?"
    owners = [(m[1], b) for m in re.finditer(r"^[ \t]*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)", code, re.M) if (b := _body(code, m.start()))]
    for m in re.finditer(pub + r"(?:(?:async|const|unsafe|extern)\s+)*fn\s+(\w+)", code, re.M):
        owner = next((n for n, (a, b) in owners if a <= m.start() < b), None)
        out.append(Symbol(m[1], "method" if owner else "function", *_place(text, m.start()), _head(text, code, m.start()), owner))
    for m in re.finditer(pub + r"(struct|trait|type)\s+(\w+)", code, re.M):
        s = Symbol(m[2], {"struct": "struct", "trait": "interface", "type": "type"}[m[1]], *_place(text, m.start()))
        before = re.search(r"(?:[ \t]*#\[[^\n]*\]\s*\n)+\Z", text[: m.start()])
        serde = before and re.search(r"derive\([^)]*(?:Serialize|Deserialize|serde::)|#\[serde\(", before[0])
        inside = _body(code, m.start())
        if m[1] == "struct" and serde and inside:
            a, b = inside
            for f in re.finditer(r"((?:^[ \t]*#\[[^\n]*\]\s*\n)*)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(\w+)\s*:\s*([^,\n]+)", text[a:b], re.M):
                tags = {}
                for key, p in (("serde_rename", r'rename\s*=\s*"([^"]+)"'), ("serde_skip_if", r'skip_serializing_if\s*=\s*"([^"]+)"')):
                    if got := re.search(p, f[1]):
                        tags[key] = got[1]
                if re.search(r"serde\([^)]*\bdefault\b", f[1]):
                    tags["serde_default"] = "true"
                s.fields.append(Field(f[2], f[3].strip(), None, _place(text, a + f.start(2))[0], f[3].strip().startswith("Option<"), tags))
        out.append(s)
    return sorted(out, key=lambda s: (s.line, s.column))


_READERS = {"python": _python, "go": _go, "js": _js, "rust": _rust}


def symbols_of(path: str, text: str) -> list[Symbol]:
    """The symbols of a file in order of their places; none for other languages and files that can't be parsed."""
    reader = _READERS.get(LANGUAGE.get(path.rsplit(".", 1)[-1].lower(), ""))
    try:
        return reader(text) if reader else []
    except (SyntaxError, ValueError, RecursionError):
        return []


FIELDS = "array<struct<name:string,field_type:string,default_value:string,line:int,is_optional:boolean,tags:map<string,string>,doc:string>>"
SCHEMA = f"file string, ord int, name string, type string, line int, column int, signature string, parent string, doc string, config_fields {FIELDS}"
_ARROW = pa.schema(
    [
        ("file", pa.string()), ("ord", pa.int32()), ("name", pa.string()), ("type", pa.string()), ("line", pa.int32()), ("column", pa.int32()),
        ("signature", pa.string()), ("parent", pa.string()), ("doc", pa.string()),
        ("config_fields", pa.list_(pa.struct([("name", pa.string()), ("field_type", pa.string()), ("default_value", pa.string()), ("line", pa.int32()), ("is_optional", pa.bool_()), ("tags", pa.map_(pa.string(), pa.string())), ("doc", pa.string())]))),
    ]
)


def symbols(sources: DataFrame) -> DataFrame:
    """A row for each symbol of ``sources`` (path, text), with its configuration fields; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, s in enumerate(symbols_of(path or "", text or "")):
                    fields = [{"name": f.name, "field_type": f.field_type, "default_value": f.default_value, "line": f.line, "is_optional": f.is_optional, "tags": list(f.tags.items()), "doc": f.doc} for f in s.fields]
                    rows.append({"file": path, "ord": i, "name": s.name, "type": s.type, "line": s.line, "column": s.column, "signature": s.signature, "parent": s.parent, "doc": s.doc, "config_fields": fields})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return sources.select("path", "text").mapInArrow(run, SCHEMA)


def config_fields(found: DataFrame) -> DataFrame:
    """(file, parent_symbol, name, field_type, default_value, line, is_optional, tags, doc, ord), a row for each field."""
    rows = found.selectExpr("file", "name AS parent_symbol", "posexplode(config_fields) AS (ord, f)")
    return rows.select("file", "parent_symbol", "f.*", "ord")


#: How languages without a parser here write comments and strings: (line comments, block comments, strings of one line, strings of several).
_C = ("//", ("/*", "*/"), "\"'", "")
LEXIS = {
    **dict.fromkeys(("javascript", "js", "jsx", "typescript", "ts", "tsx"), ("//", ("/*", "*/"), "\"'", "`")),
    **dict.fromkeys(("go", "golang"), ("//", ("/*", "*/"), "\"'", "`")),
    **dict.fromkeys(("java", "c", "cpp", "c++", "csharp", "cs", "kotlin", "swift"), _C),
    **dict.fromkeys(("rust", "rs"), ("//", ("/*", "*/"), "", '"')),
    **dict.fromkeys(("bash", "sh", "shell"), ("#", None, "", "\"'")),
}
_PAIRS = {")": "(", "]": "[", "}": "{"}


def unbalanced(language: str, code: str) -> str | None:
    """Why brackets and strings of a snippet don't close, or null: what can be told of a language by its comments and strings alone."""
    line, block, short, long = LEXIS[language]
    shell, rust = line == "#", language in ("rust", "rs")
    open_: list[tuple[str, int]] = []
    at, row, n = 0, 1, len(code)
    while at < n:
        c = code[at]
        if c == "\n":
            row += 1
        elif c == "\\":
            at += 1
        elif code.startswith(line, at) and (not shell or at == 0 or code[at - 1] in " \t\n;"):
            at = code.find("\n", at)
            if at < 0:
                break
            continue
        elif block and code.startswith(block[0], at):
            end = code.find(block[1], at + 2)
            if end < 0:
                return f"line {row}: comment is not closed"
            row += code.count("\n", at, end)
            at = end + 1
        elif rust and c == "'":
            # A character, or the name of a lifetime.
            found = re.match(r"'(?:\\.[^']*|[^'\\\n])'", code[at:])
            at += found.end() - 1 if found else 0
        elif c in short or c in long:
            begin = row
            at += 1
            while at < n and code[at] != c:
                if code[at] == "\n":
                    row += 1
                    if c in short:
                        return f"line {begin}: string is not closed"
                at += 2 if code[at] == "\\" and not (shell and c == "'") and not (language in ("go", "golang") and c == "`") else 1
            if at >= n:
                return f"line {begin}: string is not closed"
        elif c in "([{":
            open_.append((c, row))
        elif c in _PAIRS and not (shell and c == ")" and (not open_ or open_[-1][0] != "(")):
            # The patterns of a shell's case end with a bracket of their own.
            if not open_ or open_.pop()[0] != _PAIRS[c]:
                return f"line {row}: {c!r} without its opening"
        at += 1
    return f"line {open_[-1][1]}: {open_[-1][0]!r} is not closed" if open_ else None


def check_snippet(language: str | None, code: str) -> str | None:
    """Why a snippet isn't valid in its language, or null. Python, JSON, YAML and TOML are parsed; of the languages of ``LEXIS`` brackets,
    strings and comments have to close; others count as valid."""
    name = (language or "").lower()
    if name in LEXIS:
        why = unbalanced(name, code)
        return f"SyntaxError: {why}" if why else None
    try:
        if name in ("python", "py", "python3"):
            ast.parse(code)
        elif name == "json":
            json.loads(code)
        elif name in ("yaml", "yml"):
            import yaml

            list(yaml.safe_load_all(code))
        elif name == "toml":
            import tomllib

            tomllib.loads(code)
    except Exception as e:  # each parser has errors of its own
        return f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:200]
    return None


def snippet_issues(blocks: DataFrame, primary: str | None = None) -> DataFrame:
    """Issues of the code ``blocks`` (doc, line, language, text) that don't parse: errors in the project's ``primary``
    language, else warnings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, n, lang, why) for d, n, lang, code in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (why := check_snippet(lang, code or ""))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["file", "line", "language", "why"])

    bad = blocks.selectExpr("doc", "int(line) AS line", "language", "text").mapInArrow(run, "file string, line int, language string, why string")
    strong = f"lower(language) = '{primary.lower()}'" if primary else "false"
    return bad.selectExpr("'syntax_error' AS type", f"CASE WHEN {strong} THEN 'error' ELSE 'warning' END AS severity", "file", "line", "concat('Syntax error in ', language, ' snippet: ', substring(why, 1, 50)) AS message")
