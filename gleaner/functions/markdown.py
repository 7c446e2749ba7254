"""Markdown elements of documents (P1-P5): one parse of a document emits them all.

A line-oriented block pass finds fences, indented code, headings and paragraphs; an inline pass finds code spans, images and
links in what is text. Covered: ATX and Setext headings, fences with attributes, unclosed and nested fences, front matter as
plain text, code spans of any number of backticks, escapes, inline and reference links, autolinks. Not covered: HTML blocks,
and links that span a blank line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

_FENCE = re.compile(r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})\s*([^\s`{]*)?(.*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_LIST = re.compile(r"^ {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$)")
_QUOTE = re.compile(r"^ {0,3}>[ ]?")
_DEFINITION = re.compile(r"^ {0,3}\[([^\]]+)\]:\s*<?([^\s>]+)>?")
_TICKS = re.compile(r"`+")
_TARGET = re.compile(r"\(\s*(?:<([^>]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>")


@dataclass
class Element:
    kind: str
    line: int
    level: int | None = None
    text: str | None = None
    url: str | None = None
    language: str | None = None


def _close_bracket(s: str, at: int) -> int:
    """The place of the bracket that closes the one before ``at``, or -1."""
    depth, i = 1, at
    while i < len(s):
        if s[i] == "\\":
            i += 1
        elif s[i] == "[":
            depth += 1
        elif s[i] == "]":
            depth -= 1
            if not depth:
                return i
        i += 1
    return -1


def _inline(s: str, line: int, definitions: dict[str, str]) -> list[Element]:
    out: list[Element] = []
    i = 0
    while i < len(s):
        c = s[i]
        if c == "\\":
            i += 2
            continue
        if c == "`":
            ticks = _TICKS.match(s, i)[0]
            end = next((m.start() for m in _TICKS.finditer(s, i + len(ticks)) if len(m[0]) == len(ticks)), -1)
            if end < 0:
                i += len(ticks)
                continue
            body = s[i + len(ticks) : end].replace("\n", " ")
            if body.strip() and body[:1] == body[-1:] == " ":
                body = body[1:-1]
            out.append(Element("code_span", line + s.count("\n", 0, i), text=body))
            i = end + len(ticks)
            continue
        if c == "<":
            m = _AUTO.match(s, i)
            if m:
                out.append(Element("link", line + s.count("\n", 0, i), text=m[1], url=m[1]))
                i = m.end()
                continue
        image = c == "!" and s[i + 1 : i + 2] == "["
        if c == "[" or image:
            start = i + 1 + image
            end = _close_bracket(s, start)
            if end > 0:
                label, url, after = s[start:end], None, end + 1
                m = _TARGET.match(s, after)
                if m:
                    url, after = m[1] if m[1] is not None else m[2], m.end()
                elif s[after : after + 1] == "[" and (close := s.find("]", after)) > 0:
                    url = definitions.get((s[after + 1 : close] or label).lower())
                    after = close + 1 if url is not None else after
                else:
                    url = definitions.get(label.lower())
                if url is not None:
                    here = line + s.count("\n", 0, i)
                    out.append(Element("image" if image else "link", here, text=label, url=url))
                    if not image:
                        out += [e for e in _inline(label, here, definitions) if e.kind != "link"]
                    i = after
                    continue
        i += 1
    return out


def parse(text: str) -> list[Element]:
    """All elements of a document in order of their lines: header (level, text), link (text, url), image (text is the
    alternative text, url), code_block (language or null, text) and code_span (text)."""
    lines = text.replace("\r\n", "\n").split("\n")
    definitions: dict[str, str] = {}
    for x in lines:
        m = _DEFINITION.match(x)
        if m:
            definitions.setdefault(m[1].lower(), m[2])
    out: list[Element] = []
    held: list[str] = []
    first = 0

    def flush() -> None:
        if held:
            out.extend(_inline("\n".join(held), first, definitions))
            held.clear()

    i = 0
    while i < len(lines):
        raw = lines[i]
        x = raw
        while _QUOTE.match(x):
            x = _QUOTE.sub("", x, count=1)
        fence = _FENCE.match(x) or (_FENCE.match(_LIST.sub("", x, count=1)) if _LIST.match(x) else None)
        if fence is None and held and re.match(r"^\s+(`{3,}|~{3,})", x):
            fence = _FENCE.match(x.lstrip())  # a fence within a list item
        if fence:
            flush()
            mark, start = fence[1], i
            close = re.compile(rf"^\s*{re.escape(mark[0])}{{{len(mark)},}}\s*$")
            body: list[str] = []
            i += 1
            while i < len(lines) and not close.match(_QUOTE.sub("", lines[i])):
                body.append(lines[i])
                i += 1
            out.append(Element("code_block", start + 1, text="".join(b + "\n" for b in body), language=fence[2] or None))
            i += 1
            continue
        if not held and re.match(r"^(?: {4}|\t)", raw) and raw.strip() and not (i and _LIST.match(lines[i - 1])):
            i += 1  # indented code
            continue
        atx = _ATX.match(x)
        if atx:
            flush()
            title = (atx[2] or "").strip()
            out.append(Element("header", i + 1, level=len(atx[1]), text=title))
            out.extend(_inline(title, i + 1, definitions))
            i += 1
            continue
        setext = _SETEXT.match(x)
        if setext and held:
            title = "\n".join(held).strip()
            out.append(Element("header", first, level=1 if setext[1][0] == "=" else 2, text=title))
            flush()
            i += 1
            continue
        if not x.strip() or _RULE.match(x) or _DEFINITION.match(x):
            flush()
            i += 1
            continue
        if _LIST.match(x):
            flush()
        if not held:
            first = i + 1
        held.append(x.strip())
        i += 1
    flush()
    return out


SCHEMA = "doc string, ord int, kind string, line int, level int, text string, url string, language string"


def elements(docs: DataFrame) -> DataFrame:
    """A row for each element of ``docs`` (doc, text); a null text has none. ``ord`` numbers those of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc, i, e.kind, e.line, e.level, e.text, e.url, e.language) for i, e in enumerate(parse(text or ""))]
                if len(rows) > 20_000:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)

    return docs.select("doc", "text").mapInArrow(run, SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])
