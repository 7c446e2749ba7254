"""The literal fixtures of FIXTURES.md and the corners of each operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleaner.functions import markdown, paths, symbols, text, transforms
from gleaner.operators import changes, conventions, coverage, diff, links, quality, references
from gleaner.sources import git, snapshots


def one(spark, value, column):
    """A column expression's value over one string."""
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_c1_change_detection(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    cur = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256 string")
    got = changes.snapshot_changes(cur, base)
    assert rows(got) == [("b", "modified"), ("c", "deleted"), ("d", "added")]
    assert changes.change_share(got, 3).first()[:] == (3, 100.0) and changes.change_share(got, 0).first()[1] is None
    assert rows(changes.changed_since(cur, base)) == [("b", "9"), ("d", "4")]


@pytest.mark.parametrize(
    ("path", "category"),
    [
        ("cmd/x.go", "cli"), ("src/test_a.py", "api"), ("requirements.txt", "documentation"), ("package.json", "config"), ("go.mod", "dependency"), ("tests/a.py", "test"),
        ("Dockerfile", "infrastructure"), (".github/workflows/ci.yml", "config"), ("logo.png", "asset"), ("LICENSE", "other"),
    ],
)
def test_c2_category(spark, path, category):
    assert one(spark, path, paths.change_category) == category


def test_c3_links(spark):
    tree = ["index.md", "guide.md", "reference/api.md", "reference/cli.md", "tutorials/getting-started.md"]
    keys = links.link_keys(spark.createDataFrame([(t,) for t in tree], "path string"))
    asked = [
        ("index.md", "api.md"), ("index.md", "api"), ("index.md", "reference/api.md"), ("index.md", "/reference/cli.md"), ("index.md", "api.md#section"), ("reference/api.md", "../guide.md"), ("index.md", "../out.md"),
        ("index.md", "nonexistent.md"), ("index.md", "https://x"), ("index.md", "mailto:y"), ("index.md", "#z"), ("reference/api.md", "./cli"), ("index.md", "{{< ref \"a\" >}}"),
    ]
    df = spark.createDataFrame([(d, i, u, 1) for i, (d, u) in enumerate(asked)], "doc string, ord int, url string, line int")
    got = {r.url: r.target for r in links.resolve_links(df, keys).collect()}
    assert got == {
        "api.md": "reference/api.md", "api": "reference/api.md", "reference/api.md": "reference/api.md", "/reference/cli.md": "reference/cli.md", "api.md#section": "reference/api.md",
        "../guide.md": "guide.md", "../out.md": None, "nonexistent.md": None, "./cli": "reference/cli.md",
    }
    assert {r.file for r in links.broken_links(links.resolve_links(df, keys)).collect()} == {"index.md"}


C4 = "# A\n```python\n# not heading\n```\n## bad case\n![](i.png)\n#### skip\n"


def test_c4_markdown(spark):
    docs = spark.createDataFrame([("d.md", C4), ("none.md", None)], "doc string, text string")
    e = markdown.elements(docs)
    assert [(r.level, r.text, r.line) for r in e.where("kind = 'header'").orderBy("ord").collect()] == [(1, "A", 1), (2, "bad case", 5), (4, "skip", 7)]
    assert e.where("kind = 'code_block'").count() == 1 and [(r.text, r.url) for r in e.where("kind = 'image'").collect()] == [("", "i.png")]
    got = sorted((r.rule, r.line) for r in conventions.violations(e, conventions.Conventions(max_depth=3)).collect())
    assert got == [("alt_text", 6), ("heading_case", 5), ("heading_case", 7), ("heading_depth", 7), ("heading_hierarchy", 7)]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("````md\n```\ninner\n```\n````\n# H", [("code_block", 1), ("header", 6)]),
        ("```python {linenos=true}\nx\n```", [("code_block", 1)]),
        ("```\n# never closed\n## here", [("code_block", 1)]),
        ("Title\n=====\ntext `a` ``b ` c``", [("header", 1), ("code_span", 3), ("code_span", 3)]),
        ("[a](b.md) [ref][x] \\[no](c.md) <http://auto.x>\n\n[x]: y.md", [("link", 1), ("link", 1), ("link", 1)]),
        ("- item\n  ```sh\n  $ run\n  ```\n", [("code_block", 2)]),
        ("    # indented code\n\n# real", [("header", 3)]),
        ("[![alt](i.png)](l.md)", [("link", 1), ("image", 1)]),
    ],
)
def test_markdown_corners(source, want):
    assert [(e.kind, e.line) for e in markdown.parse(source)] == want


def test_c5_slugs(spark):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(["Hello World!", "Hello World", "API Reference (v2.0)", "Été_x"])], "doc string, ord int, text string")
    assert [r.slug for r in links.numbered_slugs(df).orderBy("ord").collect()] == ["hello-world", "hello-world-1", "api-reference-v20", "été-x"]


SYM = "file string, name string, type string, line int, column int, signature string, parent string, doc string, ord int"


def test_c6_symbol_diff(spark):
    s = lambda n, sig, line=1: ("a.py", n, "function", line, 0, sig, None, None, 0)
    got = diff.ordered_changes(diff.symbol_changes(spark.createDataFrame([s("f", "s1"), s("g", "s", 5), s("_h", "s1")], SYM), spark.createDataFrame([s("f", "s2"), s("_h", "s2"), s("k", "s")], SYM))).collect()
    assert [(r.name, r.change_type, r.severity) for r in got] == [
        ("g", "removed", "breaking"), ("f", "signature_changed", "breaking"), ("_h", "signature_changed", "non-breaking"), ("k", "added", "non-breaking"),
    ]


def test_c7_config_diff(spark):
    schema = "file string, parent_symbol string, name string, field_type string, default_value string, is_optional boolean, ord int"
    f = lambda n, t, d=None, o=False: ("a.py", "C", n, t, d, o, 0)
    old = [f("b", "str"), f("c", "int"), f("d", "str"), f("e", "str", "1"), f("g", "str", None, True)]
    new = [f("port", "int"), f("b", "str | None"), f("c", "str"), f("e", "str", "2"), f("g", "str")]
    got = {r.field_name: (r.change_type, r.severity, r.new_type) for r in diff.config_changes(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()}
    assert got == {
        "port": ("added", "non-breaking", "int"), "b": ("type_changed", "non-breaking", "str | None"), "c": ("type_changed", "breaking", "str"), "d": ("removed", "breaking", None),
        "e": ("default_changed", "non-breaking", "str"), "g": ("type_changed", "breaking", "str (required)"),
    }


def test_c8_actions(spark):
    rows_ = [("f", "src/a.py", "removed", "function", "breaking"), ("C", "cmd/t/main.go", "added", "class", "non-breaking"), ("g", "x.rs", "signature_changed", "function", "breaking"), ("t", "y/z.tsx", "modified", "type", "non-breaking")]
    df = spark.createDataFrame(rows_, "name string, file string, change_type string, symbol_type string, severity string")
    got = {r.name: (r.action_type, r.priority, r.target_file) for r in diff.actions(df, spark.createDataFrame([("x.rs", "docs/b.md", 2), ("x.rs", "docs/a.md", 1)], "file string, doc string, ord int")).collect()}
    assert got == {
        "f": ("remove_section", "critical", "docs/reference/a.md"), "C": ("add_section", "medium", "docs/cli/t.md"), "g": ("update_section", "high", "docs/a.md"), "t": ("update_section", "low", "docs/api/z.md"),
    }
    cfg = spark.createDataFrame([("a", "removed", "breaking"), ("b", "default_changed", "non-breaking")], "field_name string, change_type string, severity string")
    assert {(r.action_type, r.priority) for r in diff.config_actions(cfg).collect()} == {("remove_section", "critical"), ("update_example", "medium")}


def test_c9_staleness(spark):
    times = ["2024-01-29", "2024-01-17", "2023-12-18", "2023-10-01", None, "", "bad", "2024-01-25T00:00:00Z", "2024-01-02", "2023-11-03"]
    got = [(r.level, r.days_old) for r in changes.staleness(spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, ts string"), "2024-02-01T00:00:00Z").orderBy("i").collect()]
    assert got == [("fresh", 3), ("stale", 15), ("very_stale", 45), ("critical", 123), ("critical", -1), ("critical", -1), ("critical", -1), ("stale", 7), ("very_stale", 30), ("critical", 90)]


def test_staleness_counts_whole_days_to_the_microsecond(spark):
    times = ["2024-01-25T00:00:00.5Z", "2024-01-25T00:00:00.000001Z", "2024-01-25T00:00:00Z", "2024-01-24T23:59:59.999999Z", "2024-01-02 00:00:00.25", "2024-02-01T00:00:00.5Z", "1700-01-01T00:00:00.000001Z"]
    got = [(r.level, r.days_old) for r in changes.staleness(spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, ts string"), "2024-02-01T00:00:00Z").orderBy("i").collect()]
    assert got == [("fresh", 6), ("fresh", 6), ("stale", 7), ("stale", 7), ("stale", 29), ("fresh", -1), ("critical", 118368)]


@pytest.mark.parametrize(("scores", "cover", "want"), [(["good"] * 7, None, "good"), (["good"] * 7, 10.0, "good"), (["fair"] * 7, 10.0, "fair"), (["strange"], None, "fair"), ([], None, "fair"), (["excellent"] * 7, 80.0, "excellent")])
def test_c10_overall_score(spark, scores, cover, want):
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(scores)], "criterion string, score string")
    assert quality.overall_score(df, cover).first().overall == want


def test_c11_classifier(spark):
    spans = ["src/a.py", "run_it()", "Foo.bar()", "SaveVault()", "Vault", "API", "platform", "docs_path", "server_a.port", "platform: hugo"]
    df = spark.createDataFrame([("d", 1, s) for s in spans], "doc string, line int, text string")
    got = {(r.type, r.reference) for r in references.span_references(df).collect()}
    assert got == {("file_path", "src/a.py"), ("function", "run_it()"), ("function", "Foo.bar()"), ("class", "Vault"), ("command", "platform"), ("config_key", "docs_path"), ("config_key", "server_a.port"), ("config_key", "platform")}
    index = spark.createDataFrame([("docs_path", "function")], "name string, type string")
    assert ("function", "docs_path()") in {(r.type, r.reference) for r in references.span_references(df, index).collect()}


def test_c12_list_markers(spark):
    docs = spark.createDataFrame([("1", "- a\n- b\n - c"), ("2", "* a\n* b"), ("3", "- a\n* b\n```\n+ no\n```")], "doc string, text string")
    blocks = spark.createDataFrame([("3", 3, "+ no\n")], "doc string, line int, text string")
    r = quality.marker_majority(quality.list_markers(docs, blocks)).first()
    assert (r.majority_marker, r.total, r.consistency_score, r.inconsistent_files) == ("-", 7, 0.57, 1)
    assert quality.marker_majority(quality.list_markers(docs.where("false"))).first().consistency_score == 1.0


def test_c13_visibility(spark):
    rows_ = [("Run", "a.go"), ("run", "a.go"), ("_x", "a.py"), ("x", "a.py"), ("_x", "a.ts"), ("_x", "a.rs"), ("", "a.py")]
    df = spark.createDataFrame(rows_, "name string, file string")
    none, empty = F.lit(None).cast("array<string>"), F.array().cast("array<string>")
    see = lambda **k: [r[0] for r in df.select(coverage.public(F.col("name"), F.col("file"), F.lit(None), k.pop("all", none), **k)).collect()]
    assert see() == [True, False, False, True, False, True, False]
    assert see(all=empty)[2:4] == [False, False] and see(strategy="all_only")[3] is False and see(all=empty, strategy="underscore_only")[3]
    assert see(include=["_*"], exclude=["*"])[2:4] == [True, False]
    assert coverage.preset_excludes(["jest", "vitest", "?"], ["mine"])[-2:] == ["vi", "mine"]


def test_c14_terminology(spark):
    docs = spark.createDataFrame([("d", "just do it\nuse just-in-time\n```\njust code\n```\nadjust. JUST")], "doc string, text string")
    assert [(r.line, r.term) for r in quality.avoided_terms(docs, [("just", ["just-in-time"])]).orderBy("line").collect()] == [(1, "just"), (6, "just")]


def test_c15_range_join(spark):
    df = spark.createDataFrame([("f", "Outer", 1, 20), ("f", "Inner", 3, 10), ("f", "Deep", 5, 8)], "file string, name string, start int, end int")
    assert {r.name: r.parent for r in coverage.enclosing(df).collect()} == {"Outer": None, "Inner": "Outer", "Deep": "Inner"}


def test_affected_docs(spark):
    changed = spark.createDataFrame([("src/a.py", "api", 1), ("cmd/b.go", "cli", 2), ("x.md", "documentation", 3), ("t.py", "test", 4)], "file string, category string, ord int")
    edges = spark.createDataFrame([("src/a.py", "docs/a.md"), ("src/a.py", "docs/cli.md")], "file string, doc string")
    docs = spark.createDataFrame([("docs/a.md",)], "path string")
    got = {r.doc: (r.exists, r.priority, r.affected_by) for r in changes.affected_docs(changed, edges, {"cli": "docs/cli.md", "test": "docs/t.md"}, docs).collect()}
    assert got == {"docs/a.md": (True, "high", ["src/a.py"]), "docs/cli.md": (False, "high", ["src/a.py", "cmd/b.go"]), "docs/t.md": (False, "medium", ["t.py"])}


@pytest.mark.parametrize(("path", "out"), [("node_modules/a.js", True), ("x/node_modules/y/a.js", True), ("a.pyc", True), ("d/a.pyc", True), ("src/a.py", False), ("b/secrets.json", True), ("my.env", True), ("environment.py", False)])
def test_default_excludes(spark, path, out):
    from gleaner.sources.project import default_excludes

    assert one(spark, path, lambda c: paths.excluded(c, default_excludes())) is out


@pytest.mark.parametrize(("path", "out"), [("a.log", True), ("keep.log", False), ("x/a.log", True), ("build/x", True), ("src/build/x", True), ("root.txt", True), ("x/root.txt", False), ("doc/a/b.pdf", True), ("d/f.tmp", False), ("tmp/d/f.tmp", True)])
def test_gitignore(spark, path, out):
    rules = paths.gitignore_rules("# c\n*.log\n!keep.log\nbuild/\n/root.txt\ndoc/**/*.pdf\ntmp/**\n")
    assert one(spark, path, lambda c: paths.ignored(c, rules)) is out


@pytest.mark.parametrize(("glob", "path", "hit"), [("*.py", "a/b.py", True), ("a?c", "abc", True), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("x.[", "x.[", True)])
def test_globs(spark, glob, path, hit):
    assert one(spark, path, lambda c: paths.excluded(c, [glob])) is hit


def test_headings_and_words(spark):
    assert one(spark, "The Quick Fox of it", text.heading_style) == "title_case" and one(spark, "The quick fox", text.heading_style) == "sentence_case" and one(spark, "API", text.heading_style) is None
    assert one(spark, "lower", lambda c: text.fits_case(c, "sentence_case")) is False and one(spark, "1 lower", lambda c: text.fits_case(c, "sentence_case"))
    assert one(spark, "a\u00a0b c ", text.word_count) == 3
    assert one(spark, "git remote add --x", text.subcommand) == "remote_add" and one(spark, "--x", text.subcommand) is None


CODE = {
    "a.py": "import os\n\nclass Outer:\n    def m(self, a: int = 1) -> str:\n        def inner(): ...\n    class Inner:\n        def n(self): ...\n\nasync def f(): ...\n",
    "c.py": 'from pydantic import BaseModel, Field\n\nclass Db(BaseModel):\n    host: str = Field(default="x", description="The host")\n    port: int = 1\n    user: str | None = None\n    _p: int = 0\n',
    "a.go": 'package a\n\n// func no() {}\nfunc Run(x int) error {\n\treturn nil\n}\n\nfunc (s *Srv) Do() {\n}\n\ntype AppConfig struct {\n\tName string `yaml:"name" json:"name"`\n\tV    string `yaml:"v,omitempty"`\n}\ntype I interface {\n\tM()\n}\ntype ID string\n',
    "a.ts": 'export function go(a: number) {\n}\nconst arrow = async (x) => 1;\nclass K {\n  run(a) {\n    if (a) { }\n  }\n}\ninterface AppConfig {\n  name: string;\n  level?: "a" | "b";\n}\n// class No {}\n',
    "a.rs": '#[derive(Debug, Serialize)]\npub struct AppConfig {\n    pub name: String,\n    #[serde(default, rename = "v")]\n    pub version: Option<String>,\n}\n\nimpl AppConfig {\n    pub fn new() -> Self { x }\n}\nfn free<\'a>(x: &\'a str) {}\ntrait T {}\ntype A = u8;\n',
    "bad.py": "def (",
}


def test_symbols(spark):
    got = symbols.symbols(spark.createDataFrame(list(CODE.items()), "path string, text string"))
    of = lambda f: [(r.name, r.type, r.parent) for r in got.where(F.col("file") == f).orderBy("ord").collect()]
    assert of("a.py") == [("Outer", "class", None), ("m", "method", "Outer"), ("inner", "function", None), ("Inner", "class", "Outer"), ("n", "method", "Inner"), ("f", "function", None)]
    assert of("a.go") == [("Run", "function", None), ("Do", "method", "Srv"), ("AppConfig", "struct", None), ("I", "interface", None), ("ID", "type", None)]
    assert of("a.ts") == [("go", "function", None), ("arrow", "function", None), ("K", "class", None), ("run", "method", "K"), ("AppConfig", "interface", None)]
    assert of("a.rs") == [("AppConfig", "struct", None), ("new", "method", "AppConfig"), ("free", "function", None), ("T", "interface", None), ("A", "type", None)]
    assert of("bad.py") == []
    fields = {(r.file, r.name): (r.field_type, r.is_optional, r.tags) for r in symbols.config_fields(got).collect()}
    assert fields[("c.py", "host")][0] == "str" and fields[("c.py", "user")][1] and ("c.py", "_p") not in fields
    assert fields[("a.go", "V")] == ("string", True, {"yaml": "v,omitempty"}) and fields[("a.ts", "level")][:2] == ('"a" | "b"', True)
    assert fields[("a.rs", "version")] == ("Option<String>", True, {"serde_rename": "v", "serde_default": "true"}) and len(fields) == 9
    assert got.where("name = 'm'").first().signature == "def m(self, a: int=1) -> str"
    assert symbols.module_all("__all__ = ['a', 'b']") == ["a", "b"] and symbols.module_all("x = 1") is None and symbols.module_all("def (") is None


def test_snippets(spark):
    blocks = spark.createDataFrame([("d", 1, "python", "def ("), ("d", 5, "json", "{"), ("d", 9, "go", "?"), ("d", 12, "yaml", "a: 1"), ("d", 15, None, "x")], "doc string, line int, language string, text string")
    assert [(r.line, r.severity) for r in symbols.snippet_issues(blocks, "Python").orderBy("line").collect()] == [(1, "error"), (5, "warning")]


def test_coverage(spark):
    blocks = spark.createDataFrame([("d", "x = my_helper_fn(1)"), ("d", None)], "doc string, text string")
    sym = spark.createDataFrame([("helper", "function"), ("other", "function"), ("Big", "class"), ("x", "function")], "name string, type string")
    code = coverage.names_in_code(blocks, sym)
    assert {r.name for r in code.collect()} == {"helper", "x"}
    spans = spark.createDataFrame([("Big",), ("API",), ("K.other()",)], "text string")
    said = coverage.documented_names(spans, spark.createDataFrame([("## Made(x)\n",)], "text string"))
    assert {r.name for r in said.collect()} == {"Big", "other", "Made"}
    assert rows(coverage.coverage(sym, code)) == [("class", 1, 0, 0.0), ("function", 3, 2, 66.7), (None, 4, 2, 50.0)]


def test_transforms(spark):
    moves = {"docs/a.md": "manual/guide/a.md", "docs/b.md": "manual/b.md"}
    body = "See [b](b.md#x), [self](a.md), [w](https://x.y), \\[no](b.md)\n```\n[c](b.md)\n```\n`[d](b.md)`"
    want = "See [b](../b.md#x), [self](a.md), [w](https://x.y), \\[no](b.md)\n```\n[c](b.md)\n```\n`[d](b.md)`"
    assert transforms.rewrite_links(body, "docs/a.md", moves) == want
    df = spark.createDataFrame([("docs/a.md", body), ("docs/z.md", "none")], "doc string, text string")
    got = {r.doc: (r.new_doc, r.text, r.changed) for r in transforms.migrate(df, spark.createDataFrame(list(moves.items()), "old string, new string")).collect()}
    assert got == {"docs/a.md": ("manual/guide/a.md", want, True), "docs/z.md": ("docs/z.md", "none", False)}
    doc = "---\ntitle: x\n---\n# A\n## B\n## B\n"
    made = transforms.with_toc(doc)
    assert "- [A](#a)\n  - [B](#b)\n  - [B](#b-1)" in made and made.startswith("---\ntitle: x\n---\n\n<!-- TOC -->") and transforms.with_toc(made) == made
    values, rest, kind = transforms.split_front_matter(doc)
    assert (values, kind) == ({"title": "x"}, "yaml") and transforms.split_front_matter(transforms.join_front_matter(values, rest))[:2] == (values, rest)
    assert transforms.split_front_matter("+++\na = 1\n+++\nx")[0] == {"a": 1} and transforms.split_front_matter('{"a": 1}\nx')[1] == "x" and transforms.split_front_matter("--- x")[2] is None


def test_git_and_versions():
    assert git.parse_name_status("M\ta.py\nR100\told.md\tnew.md\nD\tb\n") == [("a.py", "modified"), ("new.md", "renamed"), ("b", "deleted")]
    assert git.is_commit("abc1234") and not git.is_commit("xyz") and git.run_git("/nowhere", "status") is None
    assert [snapshots.newer(v) for v in ("0.9", "1.0.0", "1.0.1", "x")] == [-1, 0, 1, -1] and len(snapshots.capped("x" * 30_000)) == 25_000
    assert "/home" not in snapshots.redacted(ValueError("no /home/u/p/a.md"), "/home/u/p")


def test_probe_and_health(spark):
    urls = spark.createDataFrame([("d", "http://a"), ("e", "http://a"), ("d", "http://b"), ("d", "http://c")], "doc string, src string")
    status = {"http://a": 404, "http://b": 200}
    assert rows(git.probe_assets(urls, status.get).select("type", "file")) == [("external_asset_error", "d"), ("external_asset_error", "e"), ("external_asset_unreachable", "d")]
    lists = [spark.createDataFrame([(f"f{i}",) for i in range(n)], "file string") for n in (6, 9)]
    assert git.doc_health(lists, 1).first()[:] == (9, 1, False) and git.doc_health(lists, 8).first()[2]


def test_locks(tmp_path):
    with snapshots.locked(str(tmp_path)):
        with pytest.raises(TimeoutError):
            with snapshots.locked(str(tmp_path), tries=2, pause=0.01):
                pass
    with snapshots.locked(str(tmp_path)):
        pass


def test_guards(spark, tmp_path):
    from gleaner.plans import guards

    assert guards.checked_root(str(tmp_path)) == str(tmp_path) and guards.checked_patterns(["**/*.py"]) == ["**/*.py"]
    for bad in ("relative", str(tmp_path / "none"), f"{tmp_path}/../x"):
        with pytest.raises(ValueError):
            guards.checked_root(bad)
    for bad in (["x"] * 51, ["y" * 513], ["(a+)+"], ["../x"]):
        with pytest.raises(ValueError):
            guards.checked_patterns(bad)
    (tmp_path / "in").write_text("x")
    (tmp_path / "out").symlink_to("/etc/hostname")
    (tmp_path / "loop").symlink_to(tmp_path / "loop")
    assert guards.within(str(tmp_path), "in") and not guards.within(str(tmp_path), "out")
    with pytest.raises(RecursionError):
        guards.within(str(tmp_path), "loop")
    assert len(guards.summary(conventions.Conventions(max_depth=3))) == 5
    df = spark.range(60).selectExpr("id AS doc")
    assert guards.shown(df, "undocumented", "doc").count() == 50 and "generated_by" in guards.stamped(df, "x").columns
    with guards.time_limit(spark, 30):
        assert df.count() == 60


def test_snippets_without_a_parser():
    from gleaner.functions.symbols import check_snippet

    good = {
        "go": ['func f() { x := `(`; s := "\\"(" } // )', "a[1:2] /* ( */"],
        "js": ["const f = (x) => `${x} ( \n`;", "let s = 'it\\'s';"],
        "typescript": ["type A = { b: Array<string> };"],
        "rust": ["fn f<'a>(x: &'a str) -> char { '(' }", 'let s = "a\nb";'],
        "bash": ["echo \"a ( b\" # (", "case $x in\n  a) echo 1;;\nesac", "echo it\\'s", "for i in $(ls); do echo ${i}; done"],
        "cobol": ["((("],
    }
    bad = {"go": ["func f( {", "}"], "js": ["let s = 'a", "f(1]", "/* open"], "rust": ["fn f() { vec![1 }"], "bash": ["echo \"a", "x=$(ls"], "tsx": ["`a"]}
    assert [(k, x) for k, v in good.items() for x in v if check_snippet(k, x)] == []
    assert [(k, x) for k, v in bad.items() for x in v if not check_snippet(k, x)] == []
