"""A project from its first snapshot to migration, and the registered queries against their oracles."""

from __future__ import annotations

import http.server
import subprocess
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gleaner.operators import conventions
from gleaner.plans import registry
from gleaner.plans.api import Project
from gleaner.sources import git
from gleaner.sources import project as files
from gleaner.streaming.changes import change_rate, stream_changes

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture
def tree(tmp_path):
    made = {
        "src/core.py": "def run_it(x):\n    pass\n\nclass Config:\n    pass\n",
        "cmd/tool/main.go": "package main\n\nfunc Main() {\n}\n",
        "docs/index.md": "# Index\n\nSee [guide](guide.md), [gone](gone.md), `run_it()` and `missing_fn()`.\n\n![](img.png)\n\n```\nx\n```\n",
        "docs/guide.md": "# Guide\n\nUse `src/core.py`.\n\n```python\ndef (\n```\n",
        "mkdocs.yml": "site_name: x\n",
        ".hidden/x.md": "# no\n",
        "node_modules/y.js": "1",
        "README.md": "# Readme\n",
    }
    for name, text in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    for args in (["init", "-q"], ["add", "-A"], ["-c", "user.email=a@b", "-c", "user.name=n", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True)
    return tmp_path


def test_workflow(spark, tree):
    p = Project(spark, str(tree), {"doc_mappings": {"cli": "docs/cli.md"}})
    assert {r.path for r in p.files().collect()} == {"src/core.py", "cmd/tool/main.go", "docs/index.md", "docs/guide.md", "mkdocs.yml", "README.md"}
    info = p.init()
    assert info["files"]["file_count"] == 6 and len(info["files"]["git_commit"]) == 40
    assert p.detect_changes().count() == 0
    (tree / "src/core.py").write_text("def run_it(x, y):\n    pass\n")
    (tree / "cmd/tool/main.go").unlink()
    (tree / "src/new.py").write_text("X = 1\n")
    assert {(r.file, r.category, r.change_type) for r in p.detect_changes().collect()} == {("src/core.py", "api", "modified"), ("cmd/tool/main.go", "cli", "deleted"), ("src/new.py", "api", "added")}
    hit = {r.doc: (r.priority, r.exists) for r in p.affected_docs().collect()}
    assert hit["docs/index.md"] == ("high", True) and hit["docs/guide.md"] == ("high", True) and hit["docs/cli.md"] == ("high", False)
    sym, cfg, todo = p.semantic_changes()
    assert {(r.name, r.change_type) for r in sym.collect()} == {("run_it", "signature_changed"), ("Config", "removed"), ("Main", "removed")} and cfg.count() == 0
    assert todo.first().priority == "critical"
    issues = {(r.type, r.file) for r in p.validate().collect()}
    assert {("broken_link", "docs/index.md"), ("missing_alt_text", "docs/index.md"), ("missing_asset", "docs/index.md"), ("syntax_error", "docs/guide.md"), ("missing_symbol", "docs/index.md"), ("convention", "docs/index.md"), ("stale_reference", "docs/index.md")} <= issues
    assert ("broken_link", "docs/guide.md") not in issues and p.validate(("links",)).count() == 1
    assert p.validate(("links",), incremental=True).count() == 0
    assert [(r.platform, r.confidence) for r in p.detect_platform().collect()] == [("mkdocs", "high")]
    scores, total = p.assess_quality()
    assert scores.count() == 7 and total.first().overall in ("good", "fair")
    commit = info["files"]["git_commit"]
    assert p.detect_changes(commit).count() == 0
    with pytest.raises(ValueError):
        p.detect_changes("not a commit")
    moved = p.migrate(spark.createDataFrame([("docs/guide.md", "docs/manual/guide.md")], "old string, new string"), dry_run=False)
    assert moved.where("changed").count() == 2 and "[guide](manual/guide.md)" in (tree / "docs/index.md").read_text() and (tree / "docs/manual/guide.md").exists()
    assert p.sync("resync")["changes"].count() == 0


def test_status_guards_and_html(spark, tree):
    p = Project(spark, str(tree))
    with pytest.raises(ValueError, match="no snapshot"):
        p.status()
    p.init()
    (tree / "src/core.py").write_text("X = 1\n")
    row = p.status().first()
    assert (row.changes, row.change_percentage, row.level, row.days_old, row.current_version, row.generated_by) == (1, round(100 / 6, 1), "fresh", 0, True, "gleaner")
    kept = files.load_yaml(str(tree / ".gleaner.yml"))
    assert kept == files.DEFAULT_CONFIG and "# exclude: globs" in (tree / ".gleaner.yml").read_text() and Project(spark, str(tree)).settings == kept
    assert files.save_default_config(str(tree / ".gleaner.yml"), {"docs_path": "other"}) is False
    sections = {r.section for r in p.state.read("dependency_map").collect()}
    assert {"doc_to_code", "code_to_doc", "unmatched", "asset", "reference:file_path"} <= sections
    (tree / "docs/html.md").write_text('# H\n\n<a href="lost.md">x</a> `<a href="code.md">`\n\n```\n<img src="no.png">\n```\n<img src="pic.png">\n<p><a href="guide.md">ok</a></p>\n')
    found = {(r.type, r.line, r.message) for r in p.validate(("links", "assets")).collect() if r.file == "docs/html.md"}
    assert {(t, n) for t, n, _ in found} == {("broken_link", 3), ("missing_asset", 8), ("missing_alt_text", 8)}
    for bad in ("..", "docs", str(tree / "none"), f"{tree}/../x"):
        with pytest.raises(ValueError):
            Project(spark, bad)
    with pytest.raises(ValueError):
        Project(spark, str(tree), {"exclude": ["../x"]})


def test_links_out_of_the_root_are_not_read(spark, tree, tmp_path_factory):
    other = tmp_path_factory.mktemp("other") / "secret.md"
    other.write_text("# secret\n")
    (tree / "docs/out.md").symlink_to(other)
    (tree / "docs/in.md").symlink_to(tree / "docs/guide.md")
    got = {r.path for r in files.scan(spark, str(tree)).collect()}
    assert "docs/in.md" in got and "docs/out.md" not in got


def test_scan_limits(spark, tree):
    with pytest.raises(ValueError):
        files.scan(spark, str(tree), max_files=2)
    assert files.scan(spark, str(tree), excludes=[], skip_hidden=False, gitignore=".git/\nnode_modules/\n").where("path like '.hidden%' or path like 'node%'").count() == 1
    docs = files.markdown_files(files.scan(spark, str(tree)), "docs", include_root_readme=True)
    assert [r.path for r in docs.collect()] == ["README.md", "docs/guide.md", "docs/index.md"]
    assert files.doc_index(docs).where("category = 'readme'").count() == 1


def test_bootstrap(spark, tmp_path):
    p = Project(spark, str(tmp_path))
    p.init("bootstrap")
    assert "docs_dir: docs" in (tmp_path / "mkdocs.yml").read_text() and [r.platform for r in p.detect_platform().collect()] == ["mkdocs"]
    for mode, platform in (("other", "mkdocs"), ("bootstrap", "none")):
        with pytest.raises(ValueError):
            p.init(mode, platform)
    assert (tmp_path / "docs/guides/getting-started.md").exists() and p.validate(("links",)).count() == 0
    assert files.load_yaml(str(tmp_path / ".gleaner/conventions.yml"))["terminology"] and files.load_yaml(str(tmp_path / "none.yml")) is None
    assert files.save_default_conventions(str(tmp_path / ".gleaner/conventions.yml")) is False


def test_bootstrap_speaks_of_the_project(spark, tmp_path):
    root = tmp_path / "thing"
    root.mkdir()
    (root / "pyproject.toml").write_text("")
    Project(spark, str(root)).init("bootstrap", "hugo")
    made = {str(f.relative_to(root)): f.read_text() for f in root.rglob("*.md")}
    assert len(made) == 7 and "pip install thing" in made["README.md"] and "hugo server" in made["docs/index.md"]
    assert not any(w in t for t in made.values() for w in ("{name}", "{docs}", "{install}", "{use}", "{build}"))


def _git(tree, *args):
    return subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *args], cwd=tree, check=True, capture_output=True, text=True).stdout


def test_moves_keep_history(spark, tree):
    (tree / "docs/pic.png").write_bytes(b"\x89PNG\xff")
    (tree / "docs/latin.md").write_bytes(b"# caf\xe9\n")
    _git(tree, "add", "-A")
    _git(tree, "commit", "-m", "before")
    (tree / "docs/new.bin").write_bytes(b"\xff")
    p = Project(spark, str(tree))
    moves = [("docs/guide.md", "docs/manual/guide.md"), ("docs/pic.png", "docs/manual/pic.png"), ("docs/latin.md", "docs/manual/latin.md"), ("docs/new.bin", "docs/manual/new.bin")]
    table = spark.createDataFrame(moves, "old string, new string")
    assert {r.method for r in p.migrate(table).collect()} == {"preview"} and not (tree / "docs/manual").exists()
    for bad in (("docs/pic.png", "../pic.png"), ("docs/pic.png", "docs/new.bin")):
        with pytest.raises(ValueError):
            p.migrate(spark.createDataFrame([bad, ("docs/new.bin", "docs/x.bin")], "old string, new string"), dry_run=False)
    how = {r.doc: r.method for r in p.migrate(table, dry_run=False, preserve_history=True).collect()}
    assert how == {"docs/guide.md": "git mv", "docs/pic.png": "git mv", "docs/latin.md": "git mv", "docs/new.bin": "copy", "docs/index.md": "rewrite", **({"README.md": "rewrite"} if "README.md" in how else {})}
    assert not (tree / "docs/guide.md").exists() and (tree / "docs/new.bin").exists() and (tree / "docs/manual/latin.md").read_bytes() == b"# caf\xe9\n"
    assert "R" in {line[0] for line in _git(tree, "diff", "--cached", "-M", "--name-status").splitlines()}
    _git(tree, "commit", "-m", "moved")
    assert "before" in _git(tree, "log", "--follow", "--format=%s", "docs/manual/pic.png")


def test_health_and_web_assets(spark, tree):
    p = Project(spark, str(tree))
    with pytest.raises(ValueError, match="no snapshot"):
        p.health()
    p.init()
    (tree / "src/core.py").write_text("X = 1\n")
    row = p.health().first()
    assert row.files >= 1 and (row.days, row.drift) == (0, row.files >= 10)
    (tree / "docs/web.md").write_text("![a](http://a/x.png)\n\n![b](https://b/y.png)\n\n![c](http://c/z.png)\n")
    status = {"http://a/x.png": 404, "http://c/z.png": 200}
    got = {(r.type, r.file, r.message) for r in p.validate(("external_assets",), prober=status.get).collect()}
    assert got == {("external_asset_error", "docs/web.md", "External asset: http://a/x.png (status 404)"), ("external_asset_unreachable", "docs/web.md", "External asset: https://b/y.png")}
    assert p.validate(("assets",)).where("type like 'external%'").count() == 0


def test_http_status():
    class Answer(http.server.BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(404 if self.path == "/no" else 200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        assert [git.http_status(u) for u in (f"{at}/yes", f"{at}/no", "file:///etc/hosts", "http://[", "http://127.0.0.1:1/x")] == [200, 404, -1, -1, None]
    finally:
        server.shutdown()
        server.server_close()


@pytest.mark.parametrize(("rows", "want"), [
    ([("package.json", '{"description": "no vitepress", "devDependencies": {"@docusaurus/core": "3"}}')], [("docusaurus", "medium", ["package.json"])]),
    ([("package.json", '{"description": "vitepress"}')], []),
    ([("package.json", "vitepress, no JSON"), ("setup.py", None)], []),
    ([("setup.py", "from setuptools import setup"), ("requirements.txt", "MkDocs==1")], [("mkdocs", "medium", ["requirements.txt"]), ("sphinx", "low", ["setup.py"])]),
    ([("setup.py", "sphinx"), ("requirements.txt", "sphinx")], [("sphinx", "medium", ["requirements.txt"])]),
    ([("mkdocs.yml", ""), ("setup.py", "sphinx")], [("mkdocs", "high", ["mkdocs.yml"])]),
])
def test_platforms(spark, rows, want):
    got = conventions.detect_platforms(spark.createDataFrame(rows, "path string, text string")).orderBy("platform").collect()
    assert [(r.platform, r.confidence, r.evidence) for r in got] == want


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", 0), ("b", "2", 10), ("c", "3", 4000)], "path string, sha256 string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    rows.write.parquet(str(tmp_path / "in"))
    base = spark.createDataFrame([("a", "1"), ("b", "x")], "path string, sha256 string")
    got = change_rate(stream_changes(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), base))
    q = got.writeStream.format("memory").queryName("rate").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.change_type, r.n) for r in spark.table("rate").collect()} == {("modified", 1), ("added", 1)}


def _same(spark, name, con):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def show(df):
        plain = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
        number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
        return sorted(repr([round(float(v), 6) if number(v) else v for v in r]) for r in plain.values.tolist())

    assert show(got) == show(want)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, con, name):
    _same(spark, name, con)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(registry.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_stored_json(spark, tmp_path):
    from gleaner.sources import snapshots as s

    (tmp_path / "b.json").write_text('{"version": "1.0.0", "files": {"a.py": "1", "b.py": "2"}, "extra": 1}')
    (tmp_path / "s.json").write_text('{"symbols": {"f": [{"name": "f", "type": "function", "file": "a.py", "line": 3}, {"type": "class"}], "g": []}}')
    (tmp_path / "d.json").write_text('{"doc_to_code": {"x.md": ["a.py", "b.py"], "y.md": []}}')
    (tmp_path / "bad.json").write_text("{not json")
    assert sorted(map(tuple, s.read_baseline_json(spark, str(tmp_path / "b.json")).collect())) == [("a.py", "1"), ("b.py", "2")]
    assert [(r.name, r.file, r.line) for r in s.read_symbols_json(spark, str(tmp_path / "s.json")).collect()] == [("f", "a.py", 3)]
    assert sorted(map(tuple, s.read_dependencies_json(spark, str(tmp_path / "d.json")).collect())) == [("x.md", "a.py"), ("x.md", "b.py")]
    assert s.read_baseline_json(spark, str(tmp_path / "bad.json")).count() == 0


def test_snapshots_replace_each_other(spark, tmp_path):
    from gleaner.sources.snapshots import Snapshots

    s = Snapshots(spark, str(tmp_path / "state"))
    assert s.read("files") is None and s.header("files") is None
    one = s.write("files", spark.range(3), note="a")
    two = s.write("files", spark.range(5), note="b")
    assert one["created_at"] == two["created_at"] and s.read("files").count() == 5 and s.header("files")["note"] == "b"
    (tmp_path / "state" / "files.current.json").write_text("{broken")
    (tmp_path / "state" / ".files.current.json.crc").unlink(missing_ok=True)
    assert s.header("files") is None and s.read("files") is None
