"""Text, link and heading functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists.
#: First words of command-line tools that a subcommand chain leaves out (X11).
CLI_TOOLS = ("git", "docker", "npm", "yarn", "pip", "cargo", "go", "node", "python", "python3", "ruby", "php", "java", "kubectl", "helm", "terraform", "ansible", "make", "brew")
#: Words that don't count for the case of a heading (A2).
MINOR_WORDS = ("a", "an", "the", "and", "but", "or", "for", "nor", "on", "at", "to", "by", "in", "of", "with")
#: Names of a code block's language.
LANGUAGES = {"py": "python", "python3": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "golang": "go", "rs": "rust", "sh": "bash", "shell": "bash", "yml": "yaml", "md": "markdown"}
EXTERNAL = ("http", "https", "ftp", "ftps")


def slugify(text: Column) -> Column:
    """The anchor of a heading: lower case, letters, digits and hyphens, blanks and underscores as hyphens."""
    kept = F.regexp_replace(F.lower(text), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_]+", "-"), "^-+|-+$", "")


def word_list(text: Column) -> Column:
    """The words of a text, cut at any Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    """X13."""
    return F.size(word_list(text))


def strip_fences(text: Column) -> Column:
    """The text without fenced blocks."""
    return F.regexp_replace(text, r"(?ms)^```.*?^```", "")


def blank_fences(text: Column) -> Column:
    """The text with empty lines for those of fenced blocks, and without code spans: every other line keeps its number."""
    pieces = F.transform(F.split(text, "(?m)^```", -1), lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, "[^\n]+", "")).otherwise(F.regexp_replace(x, "`[^`\n]*`", "")))
    return F.array_join(pieces, "")


def lines(text: Column) -> Column:
    """The lines of a text; the n-th is line n."""
    return F.split(text, "\n", -1)


def subcommand(reference: Column, project: str | None = None) -> Column:
    """X11: the words of a command up to its first flag or argument, joined by underscores; the tool's own name is left
    out. Null if none is left."""
    tools = [*CLI_TOOLS, *([project.lower()] if project else [])]
    w = word_list(reference)
    w = F.when(w[0].isin(*tools), F.slice(w, 2, 1 << 20)).otherwise(w)
    plain = F.transform(w, lambda x: x.rlike("^[a-z][a-z0-9-]*$"))
    stop = F.array_position(plain, False)
    taken = F.when(stop == 0, w).otherwise(F.slice(w, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")))
    return F.nullif(F.array_join(taken, "_"), F.lit(""))


def language(name: Column) -> Column:
    """The usual name of a code block's language."""
    low = F.lower(F.trim(name))
    pairs = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, low), low)


def is_external(url: Column) -> Column:
    """whether a link names another host's file."""
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin(*EXTERNAL)


def is_checked_link(url: Column) -> Column:
    """whether a link is to be resolved here: no other host, mail address, shortcode or mere anchor."""
    return ~url.rlike(r"^(?:https?://|mailto:|ftp://|\{\{<|\{\{%|#)") & (url != "")


def link_path(url: Column) -> Column:
    """A link without its anchor."""
    return F.regexp_replace(url, "#.*$", "")


def asset_path(url: Column) -> Column:
    """An asset's URL without anchor and query."""
    return F.regexp_replace(url, "[#?].*$", "")


def heading_style(text: Column) -> Column:
    """A2: title_case if over half of the heading's words after the first, minor words aside, start with a capital; else
    sentence_case. Null for a heading all in capitals, which has neither."""

    def letters(x: Column) -> Column:
        return F.regexp_replace(x, r"(?U)[^\p{Alpha}]", "")

    w = F.transform(F.slice(word_list(text), 2, 1 << 20), letters)
    w = F.filter(w, lambda x: (x != "") & ~F.lower(x).isin(*MINOR_WORDS))
    caps = F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}")))
    shout = (F.upper(text) == text) & (F.lower(text) != text)
    return F.when(shout, None).when(2 * caps > F.size(w), "title_case").otherwise("sentence_case")


def fits_case(text: Column, case: str) -> Column:
    """whether a heading keeps a case rule; one that doesn't start with a letter does."""
    t = F.trim(text)
    alpha = t.rlike(r"^\p{L}")
    if case == "sentence_case":
        ok = t.rlike(r"^\p{Lu}")
    elif case == "title_case":
        w = F.filter(word_list(t), lambda x: F.length(x) > 3)
        ok = (F.size(w) == 0) | (F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}"))) >= 0.7 * F.size(w))
    elif case == "lower":
        ok = (F.lower(t) == t) | t.rlike(r"\p{Lu}")
    elif case == "upper":
        ok = (F.upper(t) == t) & t.rlike(r"\p{Lu}")
    else:
        ok = F.lit(True)
    return ~alpha | ok


def html_links(html: Column) -> Column:
    """The targets of a page's links, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href=["']([^"']+)["']"""), F.lit(1))


def html_images(html: Column) -> Column:
    """(src, alt) of a page's images, in order; alt is null without the attribute."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))
    at = lambda x, name: F.nullif(F.regexp_extract(x, rf"""(?i)\b{name}=["']([^"']*)["']""", 1), F.lit(""))
    return F.filter(F.transform(tags, lambda x: F.struct(at(x, "src").alias("src"), at(x, "alt").alias("alt"))), lambda x: x["src"].isNotNull())


def shortcodes(line: Column) -> Column:
    """(type, content) of the shortcodes of a line, angle brackets first."""
    found = []
    for pattern in (r"\{\{<\s*(\w+)\s+([^>]+)>\}\}", r"\{\{%\s*(\w+)\s+([^%]+)%\}\}"):
        kinds = F.regexp_extract_all(line, F.lit(pattern), F.lit(1))
        texts = F.regexp_extract_all(line, F.lit(pattern), F.lit(2))
        found.append(F.zip_with(kinds, texts, lambda a, b: F.struct(a.alias("type"), F.trim(b).alias("content"))))
    return F.concat(*found)


def newer(version: Column, required: str) -> Column:
    """-1, 0 or 1 as a dotted version is before, equal to or after ``required``, with missing parts as 0; -1 if it is none."""
    parts = lambda v: F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
    padded = lambda a: F.concat(a, F.array_repeat(F.lit(0), 8))
    mine, theirs = padded(parts(version)), padded(parts(F.lit(required)))
    place = F.array_position(F.zip_with(F.slice(mine, 1, 8), F.slice(theirs, 1, 8), lambda a, b: a != b), True)
    after = F.when(F.get(mine, F.greatest(place - 1, F.lit(0)).cast("int")) > F.get(theirs, F.greatest(place - 1, F.lit(0)).cast("int")), 1).otherwise(-1)
    return F.when(version.rlike(r"^[0-9]+(\.[0-9]+)*$"), F.when(place == 0, 0).otherwise(after)).otherwise(-1)


def capped(shown: Column, limit: int) -> Column:
    """K9: a text for display, cut at ``limit`` characters with a note."""
    note = "\n[cut]"
    return F.when(F.length(shown) <= limit, shown).otherwise(F.concat(F.substring(shown, 1, limit - len(note)), F.lit(note)))


def without_root(error: Column, root: str) -> Column:
    """An error's text without the project's place on this machine."""
    return F.regexp_replace(F.replace(error, F.lit(root.rstrip("/") + "/"), F.lit("<project>/")), f"{re.escape(root.rstrip('/'))}(?![^ /])", "<project>/")


def accepted_pattern(pattern: Column) -> Column:
    """whether a glob is not too long, does not lead upwards, and has no repeated groups that could take exponential time."""
    return (F.length(pattern) <= 512) & ~pattern.rlike(r"\([^)]*[+*][^)]*\)[+*{]") & ~pattern.rlike(r"(^|/)\.\.(/|$)")
