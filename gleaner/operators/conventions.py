"""Documentation conventions (P13, F13) and platform detection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import paths, text
from gleaner.operators.quality import heading_jumps


@dataclass
class Conventions:
    """The rules of a project; None or False leaves a rule out."""

    language_tag: bool = True
    alt_text: bool = True
    heading_case: str | None = "sentence_case"
    hierarchy: bool = True
    max_depth: int | None = None


def violations(elements: DataFrame, rules: Conventions) -> DataFrame:
    """(doc, line, rule, severity) of the elements of documents that break a rule: code blocks without language and images
    without alternative text are errors; headings of the wrong case, that skip a level or are too deep are warnings."""
    heads = elements.where("kind = 'header'")
    row = lambda df, rule, severity: df.select("doc", "line", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
    found = [row(elements.where("false"), "", "")]
    if rules.language_tag:
        found.append(row(elements.where("kind = 'code_block' and coalesce(language, '') = ''"), "language_tag", "error"))
    if rules.alt_text:
        found.append(row(elements.where("kind = 'image' and trim(coalesce(text, '')) = ''"), "alt_text", "error"))
    if rules.heading_case:
        found.append(row(heads.where(~text.fits_case(F.col("text"), rules.heading_case)), "heading_case", "warning"))
    if rules.hierarchy:
        found.append(row(heading_jumps(heads), "heading_hierarchy", "warning"))
    if rules.max_depth:
        found.append(row(heads.where(F.col("level") > rules.max_depth), "heading_depth", "warning"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


# The files that tell of a documentation platform.
_OF = {
    "hugo": (("hugo.toml", "hugo.yaml", "config.toml"), (("go.mod", "hugo"),)),
    "docusaurus": (("docusaurus.config.js", "docusaurus.config.ts"), (("package.json", "docusaurus"), ("package.json", "@docusaurus/core"))),
    "mkdocs": (("mkdocs.yml",), (("requirements.txt", "mkdocs"),)),
    "sphinx": (("conf.py",), (("requirements.txt", "sphinx"), ("setup.py", "sphinx"), ("setup.py", "setuptools"))),
    "vitepress": ((".vitepress/config.js", ".vitepress/config.ts"), (("package.json", "vitepress"),)),
    "jekyll": (("_config.yml",), ()),
}
DOC_FOLDERS = ("docsite", "docs", "documentation", "website", "site")
SPHINX_ROOTS = ("docs/conf.py", "doc/conf.py")
RECOMMENDED = {"Go": "hugo", "JavaScript/TypeScript": "docusaurus", "Node.js": "docusaurus", "Python": "mkdocs"}
#: How sure a configuration, a manifest and a setup script make.
CONFIDENCE = ("high", "medium", "low")
#: Marker files of languages, in order.
LANGUAGES = (
    ("go.mod", "Go"), ("package.json", "JavaScript/TypeScript"), ("Cargo.toml", "Rust"), ("pyproject.toml", "Python"), ("Pipfile", "Python"), ("requirements.txt", "Python"),
    ("setup.py", "Python"), ("pom.xml", "Java"), ("build.gradle", "Java"), ("build.gradle.kts", "Kotlin"), ("Gemfile", "Ruby"), ("composer.json", "PHP"), ("CMakeLists.txt", "C/C++"),
    ("build.sbt", "Scala"), ("mix.exs", "Elixir"), ("Package.swift", "Swift"),
)


def detect_platforms(files: DataFrame) -> DataFrame:
    """(platform, confidence, evidence) of a project's ``files`` (path, text): root configurations (high), else
    those in documentation folders (high), else manifests: a dependency's name in package.json (medium), the platform's name in
    the text of others (medium, low in setup.py). Of a platform's manifests those of the highest confidence are its evidence."""
    spark = files.sparkSession
    root = [(p, f) for p, (configs, _) in _OF.items() for f in (SPHINX_ROOTS if p == "sphinx" else configs)]
    sub = [(p, f"{d}/{f}") for p, (configs, _) in _OF.items() for d in DOC_FOLDERS for f in configs]
    deps = [(p, f, word) for p, (_, manifests) in _OF.items() for f, word in manifests]
    one = files.join(F.broadcast(spark.createDataFrame(root, "platform string, path string")), "path").select("platform", "path", F.lit(1).alias("stage"), F.lit(0).alias("rank"))
    two = files.join(F.broadcast(spark.createDataFrame(sub, "platform string, path string")), "path").select("platform", "path", F.lit(2).alias("stage"), F.lit(0).alias("rank"))
    three = files.join(F.broadcast(spark.createDataFrame(deps, "platform string, path string, word string")), "path")
    named = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>")
    keys = F.concat(*(F.coalesce(F.map_keys(named[k]), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")))
    said = F.when(F.col("path") == "package.json", F.array_contains(keys, F.col("word"))).otherwise(F.contains(F.lower("text"), F.col("word")))
    three = three.where(said).select("platform", "path", F.lit(3).alias("stage"), F.when(F.col("path") == "setup.py", 2).otherwise(1).alias("rank"))
    hits = one.unionByName(two).unionByName(three)
    first = hits.withColumn("first", hits.agg(F.min("stage")).scalar()).where("stage = first")
    best = first.groupBy("platform", "rank").agg(F.array_sort(F.collect_set("path")).alias("evidence")).groupBy("platform").agg(F.min(F.struct("rank", "evidence")).alias("b"))
    return best.select("platform", F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.col("b.rank") + 1).alias("confidence"), "b.evidence")


def project_facts(files: DataFrame) -> DataFrame:
    """One row: language by the first marker file at the root (Unknown without), documentation folder by the first name."""
    spark = files.sparkSession
    marks = spark.createDataFrame([(f, n, i) for i, (f, n) in enumerate(LANGUAGES)], "path string, language string, ord int")
    folders = spark.createDataFrame([(f, i) for i, f in enumerate(("docs", "doc", "documentation", "docsite", "website/docs"))], "folder string, ord int")
    lang = files.join(F.broadcast(marks), "path").agg(F.min_by("language", "ord")).scalar()
    parts = F.split("path", "/")
    heads = files.select(F.explode(F.array(F.when(F.size(parts) > 1, parts[0]), F.when(F.size(parts) > 2, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))))).alias("folder")).distinct()
    docs = heads.join(F.broadcast(folders), "folder").agg(F.min_by("folder", "ord")).scalar()
    return spark.range(1).select(F.coalesce(lang, F.lit("Unknown")).alias("language"), docs.alias("docs_path"))


def category_histogram(files: DataFrame) -> DataFrame:
    """(category, n) of scanned files."""
    return files.groupBy(paths.scan_category(F.col("path")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
