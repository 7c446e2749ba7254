"""The project's interface: eight operations over a project folder, each a plan of the operators (§2.12 of the survey)."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import markdown, paths, symbols, text, transforms
from gleaner.operators import changes, conventions, coverage, diff, links, quality, references
from gleaner.plans import guards
from gleaner.sources import git, project
from gleaner.sources.snapshots import Snapshots, newer

#: Where a project keeps its state, below its root.
STATE = ".gleaner"
CHECKS = ("links", "assets", "snippets", "code_syntax", "symbols", "conventions", "stale_references")
CRITERIA = ("relevance", "accuracy", "purposefulness", "uniqueness", "consistency", "clarity", "structure")
_ISSUE = ["type", "severity", "file", "line", "message"]


@dataclass
class Project:
    """A project folder with its documentation. ``settings``: exclude, sources, docs_path, doc_mappings, include_root_readme."""

    spark: SparkSession
    root: str
    settings: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.root = guards.checked_root(self.root)
        self.settings = (project.load_yaml(f"{self.root}/.gleaner.yml") or {}) | self.settings
        guards.checked_patterns([*(self.settings.get("exclude") or []), *(self.settings.get("sources") or [])])
        self.docs_root = self.settings.get("docs_path") or "docs"
        self.state = Snapshots(self.spark, f"{self.root}/{STATE}")
        self._kept: DataFrame | None = None

    def files(self) -> DataFrame:
        return project.scan(self.spark, self.root, project.default_excludes() + list(self.settings.get("exclude") or []), self.settings.get("gitignore"))

    def docs(self) -> DataFrame:
        """(doc, text) of the markdown files."""
        got = project.markdown_files(self.files(), self.docs_root, bool(self.settings.get("include_root_readme")), ordered=False)
        return got.select(F.col("path").alias("doc"), "text")

    def sources(self) -> DataFrame:
        return project.source_files(self.files(), self.docs_root, self.settings.get("sources")).select("path", "text")

    def symbols(self) -> DataFrame:
        return symbols.symbols(self.sources())

    def references(self, docs: DataFrame | None = None) -> DataFrame:
        docs = self.docs() if docs is None else docs
        e = markdown.elements(docs)
        spans = references.span_references(e.where("kind = 'code_span'"), self.symbols())
        shell = references.bash_commands(e.where("kind = 'code_block'"), git.project_name(self.root))
        return spans.unionByName(references.text_references(docs)).unionByName(shell)

    def dependencies(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(references, matches, unmatched references) of the documents."""
        refs, src, sym = self.references(), self.sources(), self.symbols()
        found = references.match_paths(refs, src)
        found = found.unionByName(references.match_symbols(refs, sym, references.definitions(src)))
        found = found.unionByName(references.match_commands(refs, src, sym, git.project_name(self.root)))
        return refs, found, references.unmatched(refs, found, git.project_name(self.root))

    def _parsed(self, docs: DataFrame) -> DataFrame:
        """The elements of documents, parsed once for all checks of a report; those of the report before are let go."""
        if self._kept is not None:
            self._kept.unpersist()
        self._kept = markdown.elements(docs).persist()
        return self._kept

    def init(self, mode: str = "existing", platform: str = "mkdocs") -> dict:
        """State, configuration and conventions of a project; ``bootstrap`` also writes the first documents and the
        configuration of a platform (mkdocs, hugo or docusaurus). Files that are there stay as they are."""
        if mode not in ("existing", "bootstrap"):
            raise ValueError(f"unknown mode: {mode!r}")
        if mode == "bootstrap":
            if platform not in PLATFORM_FILES:
                raise ValueError(f"no templates for {platform!r}")
            name, language = git.project_name(self.root), conventions.project_facts(self.files()).first()["language"]
            install, use = COMMANDS.get(language, COMMANDS["Unknown"])
            fill = {"{name}": name, "{docs}": self.docs_root, "{install}": install.replace("{name}", name), "{use}": use.replace("{name}", name), "{build}": BUILDS[platform]}
            made = {f"{self.docs_root}/{k}": v for k, v in TEMPLATES.items()} | {"README.md": README} | PLATFORM_FILES[platform]
            for word, said in fill.items():
                made = {k: v.replace(word, said) for k, v in made.items()}
            for path, text in made.items():
                to = project.Path(self.root, path)
                to.parent.mkdir(parents=True, exist_ok=True)
                if not to.exists():
                    to.write_text(text, encoding="utf-8")
        project.save_default_config(f"{self.root}/.gleaner.yml", self.settings | {"docs_path": self.docs_root})
        project.save_default_conventions(f"{self.root}/{STATE}/conventions.yml")
        return self.update_baseline()

    def update_baseline(self) -> dict:
        """Snapshots of files, symbols and dependencies; given up after the seconds of the setting ``timeout``, if there is one."""
        limit = self.settings.get("timeout")
        with guards.time_limit(self.spark, float(limit)) if limit else nullcontext():
            return self._written()

    def _written(self) -> dict:
        files = self.files().select("path", "sha256")
        refs, matched, rest = self.dependencies()
        images = markdown.elements(self.docs()).where("kind = 'image'").select("doc", F.col("url").alias("src"))
        return {
            "files": self.state.write("files", files, file_count=files.count(), **git.head(self.root)),
            "symbols": self.state.write("symbols", self.symbols()),
            "dependencies": self.state.write("dependencies", references.dependencies(matched)),
            "dependency_map": self.state.write("dependency_map", references.dependency_map(refs, matched, rest, images)),
        }

    def status(self) -> DataFrame:
        """One row: changes since the snapshot and their share of its files, its age (days_old, level), and whether it was written by
        this version or a later one; with what made the row and when."""
        info = self.state.header("files")
        if info is None:
            raise ValueError("no snapshot yet: call init() or update_baseline()")
        share = changes.change_share(self.detect_changes(), int(info.get("file_count") or 0))
        now = datetime.now(timezone.utc).isoformat()
        aged = changes.staleness(share.withColumn("ts", F.lit(info.get("updated_at"))), now).drop("ts")
        return guards.stamped(aged.withColumn("current_version", F.lit(newer(str(info.get("version"))) >= 0)), "gleaner")

    def health(self) -> DataFrame:
        """One row (files, days, drift): what git says was touched since the snapshot, and whether the documents may lag behind."""
        info = self.state.header("files")
        if info is None:
            raise ValueError("no snapshot yet: call init() or update_baseline()")
        return git.session_health(self.spark, self.root, info["updated_at"])

    def detect_changes(self, since: str | None = None) -> DataFrame:
        """(file, category, change_type) since the snapshot, or since a commit; nothing is written."""
        if since is not None:
            got = git.changed_files(self.spark, self.root, since)
        else:
            base = self.state.read("files")
            if base is None:
                raise ValueError("no snapshot yet: call init() or update_baseline()")
            got = changes.snapshot_changes(self.files().select("path", "sha256"), base).withColumnRenamed("path", "file")
        return got.select("file", paths.change_category(F.col("file")).alias("category"), "change_type")

    def affected_docs(self, since: str | None = None) -> DataFrame:
        edges = self.state.read("dependencies")
        edges = edges if edges is not None else self.spark.createDataFrame([], "doc string, path string")
        changed = self.detect_changes(since).withColumn("ord", F.col("file"))
        docs = self.docs().select(F.col("doc").alias("path"))
        return changes.affected_docs(changed, edges.select(F.col("path").alias("file"), "doc"), dict(self.settings.get("doc_mappings") or {}), docs)

    def semantic_changes(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(symbol changes, configuration changes, actions) since the snapshot."""
        old, new = self.state.read("symbols"), self.symbols()
        if old is None:
            raise ValueError("no snapshot yet: call init() or update_baseline()")
        cols = ["file", "name", "type", "line", "column", "signature", "parent", "doc", "ord"]
        sym = diff.symbol_changes(old.select(*cols), new.select(*cols))
        cfg = diff.config_changes(symbols.config_fields(old), symbols.config_fields(new))
        edges = self.state.read("dependencies").select(F.col("path").alias("file"), "doc", F.col("doc").alias("ord"))
        todo = diff.actions(sym, edges, docs_path=self.docs_root).select("name", "file", "change_type", "action_type", "priority", "target_file")
        cfg_todo = diff.config_actions(cfg).select(F.col("field_name").alias("name"), "file", "change_type", "action_type", "priority", "target_file")
        return diff.ordered_changes(sym), diff.ordered_config_changes(cfg), diff.ordered_actions(todo.unionByName(cfg_todo))

    def detect_platform(self) -> DataFrame:
        return conventions.detect_platforms(self.files())

    def validate(self, checks: tuple[str, ...] = CHECKS, incremental: bool = False, rules: conventions.Conventions | None = None, prober: Callable[[str], int | None] = git.http_status) -> DataFrame:
        """The issues of the documents by the checks asked for; ``incremental``: only documents that changed since the snapshot. Assets
        on the web are asked for, by ``prober``, in the check external_assets only, which has to be named."""
        docs = self.docs()
        if incremental and (base := self.state.read("files")) is not None:
            fresh = changes.changed_since(self.files().select("path", "sha256"), base).select(F.col("path").alias("doc"))
            docs = docs.join(fresh, "doc", "left_semi")
        e = self._parsed(docs)
        kind = lambda k: e.where(F.col("kind") == k)
        found = []
        if "links" in checks:
            every = self.docs().select(F.col("doc").alias("path"))
            keys = links.link_keys(every)
            said = kind("link").select("doc", "ord", "url", "line").unionByName(_html_elements(docs).where("kind = 'link'").select("doc", "ord", "url", "line"))
            found.append(links.broken_links(links.resolve_links(said, keys)))
        if "assets" in checks or "external_assets" in checks:
            image = ("doc", "ord", "url AS src", "text AS alt", "line")
            shown = kind("image").selectExpr(*image).unionByName(_html_elements(docs).where("kind = 'image'").selectExpr(*image))
        if "assets" in checks:
            found.append(links.asset_issues(shown, self.files()))
        if "external_assets" in checks:
            found.append(git.probe_assets(shown.where("src rlike '(?i)^https?://'").select("doc", "src").distinct(), prober))
        if "snippets" in checks or "code_syntax" in checks:
            primary = conventions.project_facts(self.files()).first()["language"]
            found.append(symbols.snippet_issues(kind("code_block"), primary))
        if "symbols" in checks:
            found.append(coverage.missing_symbols(references.span_references(kind("code_span"), self.symbols()), self.symbols()))
        if "conventions" in checks:
            bad = conventions.violations(e, rules or conventions.Conventions(max_depth=4))
            found.append(bad.selectExpr("'convention' AS type", "severity", "doc AS file", "line", "rule AS message"))
        if "stale_references" in checks:
            found.append(references.stale_references(self.dependencies()[2]))
        out = found[0].select(*_ISSUE) if found else self.spark.createDataFrame([], "type string, severity string, file string, line int, message string")
        for f in found[1:]:
            out = out.unionByName(f.select(*_ISSUE))
        return out

    def assess_quality(self, criteria: tuple[str, ...] = CRITERIA) -> tuple[DataFrame, DataFrame]:
        """(scores by criterion, overall score)."""
        docs = self.docs()
        e = self._parsed(docs)
        kind = lambda k: e.where(F.col("kind") == k)
        sym = self.symbols()
        open_ = sym.where(coverage.public(F.col("name"), F.col("file"), F.col("parent"), F.lit(None).cast("array<string>")))
        names = coverage.documented_names(kind("code_span"), docs).unionByName(coverage.names_in_code(kind("code_block"), open_)).distinct()
        share = coverage.coverage(open_, names).where("type is null").select("percentage")
        m = quality.relevance(docs)
        for other in (
            quality.accuracy(kind("code_block")),
            quality.purposefulness(docs),
            quality.duplicate_headers(kind("header")).agg(F.count(F.lit(1)).alias("duplicate_topics")),
            quality.consistency(docs, kind("code_block")),
            quality.clarity(docs, kind("link"), kind("code_block")).drop("files"),
            quality.structure(docs, kind("header")),
        ):
            m = m.withColumns({c: other.select(c).scalar() for c in other.columns})
        scores = quality.criterion_scores(m.withColumn("coverage", share.scalar())).where(F.col("criterion").isin(*criteria))
        return scores, quality.overall_score(scores, share.first()["percentage"] if open_.limit(1).count() else None)

    def migrate(self, moves: DataFrame, dry_run: bool = True, toc_depth: int | None = None, preserve_history: bool = False) -> DataFrame:
        """The documents after ``moves`` (old, new), and the other files that move (their text is null): (doc, new_doc, text, changed,
        method). Written below the root unless it is a dry run; a file is copied, or moved by git with ``preserve_history`` (copied
        where git refuses). method: preview, copy, git mv, or rewrite for a document that stays in its place."""
        # A document that is no UTF-8 moves as it is.
        docs = transforms.migrate(self.docs().where("text is not null"), moves, toc_depth)
        others = self.files().join(moves.withColumnRenamed("old", "path"), "path").join(docs.select(F.col("doc").alias("path")), "path", "left_anti")
        got = docs.unionByName(others.select(F.col("path").alias("doc"), F.col("new").alias("new_doc"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("changed")))
        if dry_run:
            return got.withColumn("method", F.lit("preview"))
        # Kept first: what is written below changes what the plan would read again.
        self.state.write("migration", got)
        got = self.state.read("migration")
        # As many names as a project has files (``scan`` bounds them).
        rows = got.where("doc != new_doc").selectExpr("doc", "new_doc", "text is null AS bare").orderBy("doc").collect()
        moved, olds = [(r.doc, r.new_doc) for r in rows], {r.doc for r in rows}
        for r in rows:
            if not project.within(self.root, r.new_doc):
                raise ValueError(f"out of the project: {r.new_doc!r}")
            if r.bare and r.new_doc in olds:
                raise ValueError(f"in the place of a file that moves itself: {r.new_doc!r}")
        how = self.spark.createDataFrame([(old, project.move_file(self.root, old, new, git.move if preserve_history else None)) for old, new in moved], "doc string, method string")
        root = self.root

        def write(rows) -> None:
            from pathlib import Path

            for r in rows:
                Path(root, r["new_doc"]).write_text(r["text"], encoding="utf-8")

        got.where("changed and text is not null").foreachPartition(write)
        if preserve_history:
            git.stage(self.root, [new for _, new in moved])
        return got.join(how, "doc", "left").withColumn("method", F.coalesce("method", F.lit("rewrite")))

    def sync(self, mode: str = "check") -> dict[str, DataFrame]:
        """Changes, affected documents, issues and scores; ``resync`` renews the snapshots first, so that no change is left."""
        if mode == "resync":
            self.update_baseline()
        return {"changes": self.detect_changes(), "affected": self.affected_docs(), "issues": self.validate(), "scores": self.assess_quality()[0]}


def _html_elements(docs: DataFrame) -> DataFrame:
    """Links and images that documents (doc, text) hold as HTML: (doc, ord, kind, url, text, line), outside of fenced code. ord
    goes on behind those of markdown elements."""
    plain = docs.select("doc", F.posexplode(text.lines(text.blank_fences(F.col("text")))).alias("pos", "row"))
    each = lambda kind, url, alt: F.struct(F.lit(kind).alias("kind"), url.alias("url"), alt.alias("text"))
    links_ = F.transform(text.html_links(F.col("row")), lambda u: each("link", u, F.lit(None).cast("string")))
    images = F.transform(text.html_images(F.col("row")), lambda i: each("image", i["src"], F.coalesce(i["alt"], F.lit(""))))
    rows = plain.where(F.contains("row", F.lit("<"))).select("doc", "pos", F.posexplode(F.concat(links_, images)).alias("n", "e"))
    return rows.select("doc", (1_000_000 + F.col("pos") * 1_000 + F.col("n")).cast("int").alias("ord"), "e.kind", "e.url", "e.text", (F.col("pos") + 1).cast("int").alias("line"))


#: The first documents of a project that has none (K6). {name}, {docs}, {install}, {use} and {build} are filled in.
README = """# {name}

Say in two sentences what {name} does and for whom.

## Install

```bash
{install}
```

## Documentation

Start with the [guide]({docs}/guides/getting-started.md); settings are listed in the [configuration reference]({docs}/reference/configuration.md).
"""
TEMPLATES = {
    "index.md": """# {name}

Say here what {name} is for, and what it isn't for.

## Find your way

- New here: [install it](guides/installation.md), then [get started](guides/getting-started.md)
- Everyday work: [usage](guides/usage.md)
- Looking something up: [API](reference/api.md) and [configuration](reference/configuration.md)

## About these pages

Build them with:

```bash
{build}
```
""",
    "guides/installation.md": """# Installation

## What you need

List systems, versions and services that have to be there first.

## Install the package

```bash
{install}
```

## Check that it works

```bash
{use}
```

## When it fails

Describe the errors that people meet most and what helps. Then [get started](getting-started.md).
""",
    "guides/getting-started.md": """# Getting started

This page takes a new user to a first result in five minutes. Have it [installed](installation.md) first.

## First steps

```bash
{use}
```

Show what is printed, and say what it means.

## Where to go on

- [Usage](usage.md) for the usual tasks
- [Configuration](../reference/configuration.md) for what can be changed
""",
    "guides/usage.md": """# Usage

## Common tasks

Give each task a heading, the command or code that does it, and the result.

```bash
{use}
```

## Working with others

Say how it is used in scripts, in builds and by a team.

## Questions

Collect what is asked often. Settings are in the [configuration reference](../reference/configuration.md).
""",
    "reference/api.md": """# API reference

Every public function, class and command with its arguments, result and an example.

## Commands

## Functions and classes
""",
    "reference/configuration.md": """# Configuration

## Where settings come from

Name files, environment variables and options, in the order in which they win.

## Settings

| Name | Type | Default | Meaning |
|---|---|---|---|

## Example

```yaml
name: value
```
""",
}
#: How projects of a language are installed and tried.
COMMANDS = {
    "Python": ("pip install {name}", "python -m {name} --help"),
    "JavaScript/TypeScript": ("npm install {name}", "npx {name} --help"),
    "Go": ("go install ./...", "{name} --help"),
    "Rust": ("cargo install {name}", "{name} --help"),
    "Ruby": ("gem install {name}", "{name} --help"),
    "Unknown": ("# the commands that install {name}", "{name} --help"),
}
#: How a platform's pages are built.
BUILDS = {"mkdocs": "mkdocs serve", "hugo": "hugo server", "docusaurus": "npx docusaurus start"}
#: What a platform needs to build them.
PLATFORM_FILES = {
    "mkdocs": {"mkdocs.yml": "site_name: {name}\ndocs_dir: {docs}\nnav:\n  - Home: index.md\n  - Installation: guides/installation.md\n  - Getting started: guides/getting-started.md\n  - Usage: guides/usage.md\n  - API: reference/api.md\n  - Configuration: reference/configuration.md\n"},
    "hugo": {"hugo.yaml": "title: {name}\ncontentDir: {docs}\nmarkup:\n  goldmark:\n    renderer:\n      unsafe: false\n"},
    "docusaurus": {"docusaurus.config.js": "module.exports = {\n  title: '{name}',\n  url: 'https://example.com',\n  baseUrl: '/',\n  presets: [['classic', {docs: {path: '{docs}', routeBasePath: '/'}}]],\n};\n"},
}
