"""Properties over generated inputs."""

from __future__ import annotations

import fnmatch
import posixpath
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import markdown, paths, symbols, text, transforms
from gleaner.operators import links

names = st.text("ab./*?[]!-é", max_size=12)


@settings(max_examples=400, deadline=None)
@given(st.text("ab./*?-", max_size=8), st.text("ab./-\n", max_size=10))
def test_globs_equal_fnmatch(glob, path):
    assert bool(re.fullmatch(paths.glob_regex(glob), path)) == fnmatch.fnmatchcase(path, glob)


@settings(max_examples=300, deadline=None)
@given(st.text("ab`*#-=_[]()!<>\\\n \t~|:.", max_size=80))
def test_markdown_always_ends_in_order(source):
    found = markdown.parse(source)
    assert all(1 <= e.line <= source.count("\n") + 1 for e in found)
    assert all(1 <= e.level <= 6 for e in found if e.kind == "header")


@settings(max_examples=200, deadline=None)
@given(st.text("ab{}();:=\"'`/*\n fnclasstructype", max_size=80), st.sampled_from(["a.go", "a.ts", "a.rs", "a.py"]))
def test_symbol_readers_never_fail(source, path):
    assert all(s.line >= 1 and s.name for s in symbols.symbols_of(path, source))


@settings(max_examples=200, deadline=None)
@given(st.text("ab\"'`/*\\\n ", max_size=60))
def test_blanked_keeps_places(source):
    out = symbols.blanked(source)
    assert len(out) == len(source) and [i for i, c in enumerate(out) if c == "\n"] == [i for i, c in enumerate(source) if c == "\n"]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=4), st.one_of(st.integers(-9, 9), st.text("xyz é\"", max_size=6), st.booleans()), max_size=4), st.sampled_from(["yaml", "toml", "json"]), st.text("ab\n", max_size=10))
def test_front_matter_round_trip(values, kind, body):
    if kind == "yaml" and not values:
        return
    body = body.lstrip("\n") if kind == "json" else body
    got, rest, found = transforms.split_front_matter(transforms.join_front_matter(values, body, kind))
    assert (got, rest, found) == (values, body, kind)


def test_paths_equal_posixpath(spark):
    rng = random.Random(4)
    made = ["/".join(rng.choice(["a", "b", ".", "..", "c.md", ""]) for _ in range(rng.randint(1, 7))) for _ in range(500)]
    made = [m for m in made if m and not m.startswith("/")]
    rows = spark.createDataFrame([(m,) for m in made], "x string").select("x", links.normal_path(F.col("x")).alias("n")).collect()
    for r in rows:
        want = posixpath.normpath(r.x)
        # A path that leaves the root has no normal form here, even where it comes back.
        left, ok = 0, True
        for part in r.x.split("/"):
            left += part not in ("", ".", "..") if part != ".." else -1
            ok = ok and left >= 0
        assert r.n == (want if want != "." else "") if ok else r.n is None


def test_slugs_and_words_equal_python(spark):
    rng = random.Random(5)
    made = ["".join(rng.choice("aB é-_ .! \t1ß") for _ in range(rng.randint(0, 20))) for _ in range(500)]
    rows = spark.createDataFrame([(m,) for m in made], "x string").select("x", text.slugify(F.col("x")).alias("s"), text.word_count(F.col("x")).alias("n")).collect()
    for r in rows:
        assert r.s == transforms.slug(r.x) and r.n == len(r.x.split())
