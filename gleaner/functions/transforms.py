"""Rewriting of documents: front matter, links, tables of contents (X7-X10) and the relative paths they need."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.functions.markdown import parse

TOC = "<!-- TOC -->"
#: As the marker's end is written (the marker with a slash after its opening).
TOC_END = "<!--/ TOC -->"
_FENCED = re.compile(r"^ {0,3}(```|~~~).*?^ {0,3}\1[^\n]*$|`[^`\n]+`", re.M | re.S)
_LINK = re.compile(r"(?<!\\)(!?\[(?:[^\]\\]|\\.)*\]\()([^)\s]+)((?:\s+\"[^\"]*\")?\))")


def split_front_matter(text: str) -> tuple[dict | None, str, str | None]:
    """(values, rest, kind) of a document; kind is yaml, toml, json or null. Front matter that can't be read is text."""
    try:
        if m := re.match(r"---[ \t]*\n(.*?)^---[ \t]*(?:\n|\Z)", text, re.S | re.M):
            import yaml

            got = yaml.safe_load(m[1])
            return (got, text[m.end() :], "yaml") if isinstance(got, dict) else (None, text, None)
        if m := re.match(r"\+\+\+[ \t]*\n(.*?)^\+\+\+[ \t]*(?:\n|\Z)", text, re.S | re.M):
            import tomllib

            return tomllib.loads(m[1]), text[m.end() :], "toml"
        if text.startswith("{"):
            got, end = json.JSONDecoder().raw_decode(text)
            if isinstance(got, dict):
                return got, text[end:].lstrip("\n"), "json"
    except Exception:  # noqa: S110  each of the three formats has errors of its own
        pass
    return None, text, None


def join_front_matter(values: dict, body: str, kind: str = "yaml") -> str:
    """A document with front matter (TOML is written for plain values and lists of them)."""
    if kind == "json":
        return json.dumps(values, indent=2, ensure_ascii=False, default=str) + "\n" + body
    if kind == "toml":
        show = lambda v: json.dumps(v, ensure_ascii=False, default=str)
        return "+++\n" + "".join(f"{k} = {show(v)}\n" for k, v in values.items()) + "+++\n" + body
    import yaml

    return "---\n" + yaml.safe_dump(values, sort_keys=False, allow_unicode=True) + "---\n" + body


def relative_link(source: str, target: str) -> str:
    """The link from one file to another, both relative to the same root."""
    return posixpath.relpath(target, posixpath.dirname(source) or ".")


def moved_link(url: str, source: str, moves: dict[str, str]) -> str:
    """A link of ``source`` after files moved (old to new path): both its own place and its target's count."""
    bare, mark, anchor = url.partition("#")
    if not bare or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//|\{\{", bare):
        return url
    old = bare.lstrip("/") if bare.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(source), bare))
    new = moves.get(old, old)
    if bare.startswith("/"):
        return "/" + new + mark + anchor
    here = moves.get(source, source)
    return (bare if new == old and posixpath.dirname(here) == posixpath.dirname(source) else relative_link(here, new)) + mark + anchor


def rewrite_links(text: str, source: str, moves: dict[str, str]) -> str:
    """A document with its links as after ``moves``; code and escaped brackets stay as they are."""
    out, at = [], 0
    swap = lambda m: m[1] + moved_link(m[2], source, moves) + m[3]
    for m in _FENCED.finditer(text):
        out += [_LINK.sub(swap, text[at : m.start()]), m[0]]
        at = m.end()
    return "".join(out) + _LINK.sub(swap, text[at:])


def slug(text: str) -> str:
    kept = re.sub(r"[^\w\s-]", "", text.lower())
    return re.sub(r"[\s_]+", "-", kept).strip("-")


def toc(text: str, max_depth: int = 3) -> str:
    """A list of links to the headings of a document down to a level."""
    seen: dict[str, int] = {}
    out = []
    for h in parse(text):
        if h.kind == "header" and h.level <= max_depth:
            s = slug(h.text)
            n = seen[s] = seen.get(s, -1) + 1
            out.append(f"{'  ' * (h.level - 1)}- [{h.text}](#{s}{f'-{n}' if n else ''})")
    return "\n".join(out)


def with_toc(text: str, max_depth: int = 3) -> str:
    """The document with its table of contents renewed between the markers; without markers it is put at the top, after
    front matter; a marker without its end stays untouched."""
    section = f"{TOC}\n{toc(text, max_depth)}\n{TOC_END}"
    if TOC in text:
        start, end = text.index(TOC), text.find(TOC_END)
        return text if end < start else text[:start] + section + text[end + len(TOC_END) :]
    _, body, kind = split_front_matter(text)
    if kind:
        head = text[: len(text) - len(body)]
        return f"{head}\n{section}\n{body}"
    return f"{section}\n\n{text}"


def tables_of_contents(docs: DataFrame, max_depth: int = 3) -> DataFrame:
    """(doc, toc) of ``docs`` (doc, text)."""
    return _each(docs, lambda t: (toc(t, max_depth),), {"toc": pa.string()})


def front_matter(docs: DataFrame) -> DataFrame:
    """(doc, kind, front_matter, body) of ``docs`` (doc, text); the values as JSON, null without front matter."""

    def read(t: str) -> tuple[str | None, str | None, str]:
        values, body, kind = split_front_matter(t)
        return kind, None if values is None else json.dumps(values, ensure_ascii=False, default=str), body

    return _each(docs, read, {"kind": pa.string(), "front_matter": pa.string(), "body": pa.string()})


def _each(docs: DataFrame, f: Callable[[str], tuple], columns: dict[str, pa.DataType]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [f(t or "") for t in batch.column(1).to_pylist()]
            cols = zip(*made, strict=True) if made else [()] * len(columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=t) for c, t in zip(cols, columns.values(), strict=True))], names=["doc", *columns])

    return docs.select("doc", "text").mapInArrow(run, "doc string, " + ", ".join(f"{c} string" for c in columns))


def migrate(docs: DataFrame, moves: DataFrame, toc_depth: int | None = None) -> DataFrame:
    """K7: ``docs`` (doc, text) at their new places with links rewritten: (doc, new_doc, text, changed).

    ``moves`` (old, new). The moves that a document needs (its own and those of its targets) come to it by joins on its links'
    targets, so that no table of moves has to fit a task.
    """
    from pyspark.sql import functions as F

    def targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, t) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in _targets(doc, text or "")]
            a, b = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.string()), pa.array(b, type=pa.string())], names=["doc", "old"])

    asked = docs.select("doc", "text").mapInArrow(targets, "doc string, old string").distinct()
    own = asked.join(moves, "old").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("moves"))
    given = docs.select("doc", "text").join(own, "doc", "left").select("doc", "text", F.coalesce("moves", F.create_map().cast("map<string,string>")).alias("moves"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table = dict(pairs)
                new = rewrite_links(text or "", doc, table)
                new = with_toc(new, toc_depth) if toc_depth else new
                out.append((doc, table.get(doc, doc), new, new != (text or "") or doc in table))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.bool_()), strict=True)], names=["doc", "new_doc", "text", "changed"])

    return given.mapInArrow(rewrite, "doc string, new_doc string, text string, changed boolean")


def _targets(doc: str, text: str) -> set[str]:
    """The document itself and the files that its links name."""
    out = {doc}
    for m in _LINK.finditer(text):
        bare = m[2].partition("#")[0]
        if bare and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//|\{\{", bare):
            out.add(bare.lstrip("/") if bare.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(doc), bare)))
    return out
