"""Path predicates and categories as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories of a changed path in the order in which they are tried.
#: (category, parts of the path, endings of the lower-cased path, names within the lower-cased path)
CHANGE_CATEGORIES = (
    ("cli", ("cmd/",), (), ()),
    ("api", ("api/", "internal/", "pkg/", "lib/", "src/"), (), ()),
    ("config", (), (".yml", ".yaml", ".toml", ".json", ".ini", ".conf"), ()),
    ("documentation", ("/docs/", "/documentation/"), (".md", ".rst", ".txt"), ()),
    ("asset", (), (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".pdf", ".mp4", ".webm", ".mov"), ()),
    ("dependency", (), (), ("package.json", "go.mod", "requirements.txt", "cargo.toml", "pom.xml", "build.gradle")),
    ("test", ("test_", "_test.", "test/", "tests/", "spec/", "__tests__/"), (), ()),
    ("infrastructure", (".github/", ".gitlab/", "docker", "Dockerfile", ".ci/", "deploy/"), (), ()),
)
# Endings of scanned files.
CODE_SUFFIXES = ("py", "js", "ts", "tsx", "jsx", "go", "rs", "java", "c", "cpp", "h", "hpp")
DOC_SUFFIXES = ("md", "rst", "txt", "adoc")
CONFIG_SUFFIXES = ("json", "yaml", "yml", "toml", "ini", "cfg", "conf")
ASSET_SUFFIXES = ("png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "pdf")


def _any(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _whens(cases: Iterable[tuple[Column, str | None]], otherwise: Column) -> Column:
    """The value of the first case that holds."""
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return otherwise if out is None else out.otherwise(otherwise)


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The lower-cased ending of a file name without its dot; empty for none and for names that only start with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"[^.].*\.([^.]*)$|^$", 1))


def change_category(path: Column) -> Column:
    """The category of a changed path, ``other`` if none fits. Null for a null path."""
    cases = []
    for name, parts, ends, names in CHANGE_CATEGORIES:
        # One pattern a category keeps the expression small wherever it is inlined.
        found = [re.escape(p) for p in parts] + [f"(?i:{re.escape(e)}$)" for e in ends] + [f"(?i:{re.escape(n)})" for n in names]
        cases.append((slashed(path).rlike("|".join(found)), name))
    return F.when(path.isNotNull(), _whens(cases, F.lit("other")))


def scan_category(path: Column) -> Column:
    """Code, docs, config, assets or other."""
    end, name = suffix(path), F.lower(basename(path))
    cases = [
        (end.isin(*CODE_SUFFIXES), "code"),
        (end.isin(*DOC_SUFFIXES) | F.contains(name, F.lit("readme")) | F.contains(name, F.lit("changelog")), "docs"),
        (end.isin(*CONFIG_SUFFIXES) | name.isin("dockerfile", "makefile"), "config"),
        (end.isin(*ASSET_SUFFIXES), "assets"),
    ]
    return _whens(cases, F.lit("other"))


def doc_category(path: Column) -> Column:
    """The category of a document by its path within the documentation, or null."""
    low = F.lower(path)
    has = lambda *parts: _any(F.contains(low, F.lit(p)) for p in parts)
    ref, dev = has("reference"), has("development")
    cases = [
        (ref & has("command", "cli"), "cli"),
        (ref & has("api"), "api"),
        (ref & has("config"), "config"),
        (ref & has("arch"), "architecture"),
        (has("getting-started", "installation"), "dependency"),
        (dev & has("ci", "cd"), "infrastructure"),
        (dev & has("contrib"), "contributing"),
        (has("guide", "workflow"), "workflows"),
        (F.lower(basename(path)) == "readme.md", "readme"),
    ]
    return _whens(cases, F.lit(None).cast("string"))


def doc_relative(path: Column, docs_root: str) -> Column:
    """A project path as documentation names it: relative to ``docs_root``; outside of it (the root's readme too) as it is."""
    prefix = docs_root.strip("/") + "/"
    return F.when(F.startswith(slashed(path), F.lit(prefix)), F.substring(slashed(path), len(prefix) + 1, 1 << 20)).otherwise(slashed(path))


def hidden(path: Column) -> Column:
    """whether a component of the path starts with a dot."""
    return path.rlike(r"(^|/)\.")


def glob_regex(glob: str) -> str:
    """An fnmatch pattern as a regular expression for the whole string: ``*`` and ``?`` cross slashes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] in ("!", "]") else i + 1)
            if end > 0:
                body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
                out.append("[" + ("^" + body[1:] if body[:1] == "!" else body) + "]")
                i = end + 1
                continue
        out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        i += 1
    return "(?s:" + "".join(out) + ")"


def exclude_regex(globs: Iterable[str]) -> str | None:
    """one regular expression for paths that any of the globs excludes, or None without globs.

    ``**/x`` fits the path or any of its ends after a slash, ``x/**`` the folder x and all in it (x is taken literally), any
    other glob the whole path.
    """
    found = []
    for g in dict.fromkeys(x.replace("\\", "/") for x in globs):
        if g.startswith("**/"):
            found.append(f"(?:.*/)?{glob_regex(g[3:])}")
        elif g.endswith("/**"):
            found.append(re.escape(g[:-3]) + "(?:/.*)?")
        else:
            found.append(glob_regex(g))
    return "(?s)^(?:" + "|".join(found) + ")$" if found else None


def excluded(path: Column, globs: Iterable[str]) -> Column:
    """whether any of the globs excludes the path."""
    pattern = exclude_regex(globs)
    return slashed(path).rlike(pattern) if pattern else F.lit(False)


def gitignore_rules(text: str) -> list[tuple[str, bool]]:
    """the rules of a gitignore file, in order: (regular expression for a path or what it lies in, negated).

    Written from git's documentation: blank lines and comments are skipped; ``!`` negates; a slash before the end ties the
    pattern to the root, else it fits at any depth; a slash at the end fits folders only; ``*`` and ``?`` stop at slashes,
    ``**`` does not.
    """
    out = []
    for raw in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", raw)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        line = line[1:] if line.startswith(("\\#", "\\!")) else line
        folder = line.endswith("/")
        line = line.rstrip("/")
        tied = "/" in line
        line = line.lstrip("/")
        if not line:
            continue
        body, i = [], 0
        while i < len(line):
            if line.startswith("**/", i):
                body.append("(?:.*/)?")
                i += 3
            elif line.startswith("/**", i) and i + 3 == len(line):
                body.append("/.+")
                i += 3
            elif line[i] == "*":
                while line[i : i + 1] == "*":
                    i += 1
                body.append("[^/]*")
            elif line[i] == "?":
                body.append("[^/]")
                i += 1
            elif line[i] == "[" and "]" in line[i + 2 :]:
                end = line.index("]", i + 2)
                inner = line[i + 1 : end]
                body.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
                i = end + 1
            else:
                i += line[i] == "\\" and i + 1 < len(line)
                body.append(re.escape(line[i]))
                i += 1
        start = "^" if tied else "^(?:.*/)?"
        out.append((f"{start}{''.join(body)}{'/.*' if folder else '(?:/.*)?'}$", negated))
    return out


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """whether the last rule that fits the path ignores it."""
    return _whens([(slashed(path).rlike(p), not negated) for p, negated in reversed(rules)], F.lit(False))
