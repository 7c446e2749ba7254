"""Queries over files: a project of a file for each nation is written to the shared folder, scanned, stored and read again."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.plans import guards
from gleaner.plans.carriers import table
from gleaner.plans.code_queries import _MATCH_SQL, _asked
from gleaner.plans.registry import query
from gleaner.operators import conventions, references
from gleaner.sources import project, snapshots

_PATH = """CASE n_nationkey % 6 WHEN 0 THEN 'docs/guides/g' || n_nationkey || '.md' WHEN 1 THEN 'src/m' || n_nationkey || '.py' WHEN 2 THEN 'node_modules/p' || n_nationkey || '.js'
    WHEN 3 THEN 'docs/.drafts/d' || n_nationkey || '.md' WHEN 4 THEN 'cfg/c' || n_nationkey || '.yaml' ELSE 'src/__init__' || n_nationkey || '.py' END"""
_TEXT = "'# ' || n_name || chr(10) || chr(10) || n_regionkey || ' é' || chr(10)"
_FILES = f"f AS (SELECT n_nationkey AS k, {_PATH} AS path, {_TEXT} AS text FROM nation), kept AS (SELECT * FROM f WHERE k % 6 NOT IN (2, 3))"


def _shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a local one only where all runs on one machine and none is named."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
    return f"{(root or tempfile.mkdtemp(prefix='gleaner-')).rstrip('/')}/project-{uuid.uuid4().hex[:12]}"


def _written(spark: SparkSession, files: list[tuple[str, str]]) -> str:
    """The folder in which files (path, text) were written."""
    root = _shared(spark)
    where, base = project._fs(root)
    for path, body in files:
        where.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
        with where.open_output_stream(f"{base}/{path}") as out:
            out.write(body.encode())
    return root


def _project(spark: SparkSession, sf_dir: str) -> str:
    rows = table(spark, sf_dir, "nation").selectExpr(f"{_PATH} AS path", f"{_TEXT} AS text").collect()
    return _written(spark, [(r.path, r.text) for r in rows])


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.scan(spark, _project(spark, sf_dir))


@query("s1_s2_scan", f"WITH {_FILES} SELECT path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM kept")
def s1_s2_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).select("path", "size", "sha256")


@query("s3_o4_markdown_files", f"WITH {_FILES} SELECT path, text, row_number() OVER (ORDER BY path) AS place FROM kept WHERE path LIKE 'docs/%.md'")
def s3_o4_markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # In order of their paths: the place counts rows as they come, and all are in one partition.
    docs = project.markdown_files(_scan(spark, sf_dir), "docs").coalesce(1)
    return docs.select("path", "text", (F.monotonically_increasing_id() + 1).alias("place"))


@query("s4_s5_u2_source_files", f"WITH {_FILES} SELECT path, false AS by_glob FROM kept WHERE path NOT LIKE 'docs/%' UNION ALL SELECT path, true FROM kept WHERE path LIKE 'src/%'")
def s4_s5_u2_source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _scan(spark, sf_dir)
    ending = project.source_files(files).select("path", F.lit(False).alias("by_glob"))
    # Globs that overlap give a file once.
    return ending.unionByName(project.source_files(files, "docs", ["src/**", "**/*.py"]).select("path", F.lit(True).alias("by_glob")))


@query("s6_doc_index", f"WITH {_FILES} SELECT path, regexp_extract(path, '[^/]*$') AS name, substr(path, 6) AS doc, 'workflows' AS category FROM kept WHERE path LIKE 'docs/%.md'")
def s6_doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project.doc_index(project.markdown_files(_scan(spark, sf_dir), "docs"))


@query(
    "k1_k2_s10_snapshots",
    f"WITH {_FILES} SELECT path, sha256(text) AS sha256, (SELECT count(*) FROM kept) AS file_count, true AS created_first FROM kept",
)
def k1_k2_s10_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _scan(spark, sf_dir).select("path", "sha256")
    store = snapshots.Snapshots(spark, _shared(spark))
    one = store.write("files", files.limit(1), file_count=1)
    two = store.write("files", files, file_count=files.count())
    kept = one["created_at"] == two["created_at"] <= two["updated_at"]
    return store.read("files").withColumns({"file_count": F.lit(store.header("files")["file_count"]).cast("long"), "created_first": F.lit(kept)})


@query(
    "s10_s11_s12_stored_files",
    f"""WITH {_FILES} SELECT 'baseline' AS kind, path AS a, sha256(text) AS b FROM f UNION ALL SELECT 'symbols', 'n' || k, path FROM f
    UNION ALL SELECT 'dependencies', 'docs/all.md', path FROM f""",
)
def s10_s11_s12_stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS k", f"{_PATH} AS path", f"sha2({_TEXT}, 256) AS sha").collect()
    stored = {
        "base.json": {"version": "1.0.0", "files": {r.path: r.sha for r in rows}},
        "symbols.json": {"symbols": {f"n{r.k}": [{"name": f"n{r.k}", "type": "function", "file": r.path, "line": 1}, {"type": "no name"}] for r in rows}},
        "deps.json": {"doc_to_code": {"docs/all.md": [r.path for r in rows], "docs/none.md": []}},
    }
    root = _written(spark, [(name, json.dumps(x)) for name, x in stored.items()] + [("bad.json", "{no")])
    base = snapshots.read_baseline_json(spark, f"{root}/base.json").unionByName(snapshots.read_baseline_json(spark, f"{root}/bad.json"))
    found = base.select(F.lit("baseline").alias("kind"), F.col("path").alias("a"), F.col("sha256").alias("b"))
    found = found.unionByName(snapshots.read_symbols_json(spark, f"{root}/symbols.json").select(F.lit("symbols").alias("kind"), F.col("name").alias("a"), F.col("file").alias("b")))
    return found.unionByName(snapshots.read_dependencies_json(spark, f"{root}/deps.json").select(F.lit("dependencies").alias("kind"), F.col("doc").alias("a"), F.col("path").alias("b")))


@query(
    "k3_dependency_map",
    f"""WITH {_MATCH_SQL}, e AS (SELECT DISTINCT doc, path FROM hit), a AS (SELECT DISTINCT 'd' || (s_suppkey % 20) AS doc, 'img' || (s_suppkey % 7) || '.png' AS src FROM supplier), u AS (SELECT doc, type, reference FROM asked EXCEPT SELECT doc, type, reference FROM hit),
    m AS (SELECT 'doc_to_code' AS section, doc AS key, path AS v FROM e UNION ALL SELECT 'code_to_doc', path, doc FROM e UNION ALL SELECT 'reference:' || type, reference, doc FROM asked
        UNION ALL SELECT 'unmatched', reference, doc FROM u UNION ALL SELECT 'asset', src, doc FROM a)
    SELECT section, key, array_to_string(list(DISTINCT v ORDER BY v), ',') AS "values" FROM m GROUP BY ALL""",
)
def k3_dependency_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, known, defined = _asked(spark, sf_dir)
    found = references.match_symbols(refs, known, defined)
    images = table(spark, sf_dir, "supplier").selectExpr("'d' || (s_suppkey % 20) AS doc", "'img' || (s_suppkey % 7) || '.png' AS src")
    got = references.dependency_map(refs, found, references.unmatched(refs, found), images)
    store = snapshots.Snapshots(spark, _shared(spark))
    store.write("dependency_map", got)
    return store.read("dependency_map").withColumn("values", F.array_join("values", ","))


_VERSION = "CASE n_nationkey % 5 WHEN 0 THEN '0.9.' || n_nationkey WHEN 1 THEN '1.0' WHEN 2 THEN '1.0.0.' || n_nationkey WHEN 3 THEN '10.0' ELSE 'v' || n_nationkey END"


@query("x16_versions", f"SELECT {_VERSION} AS version, CASE n_nationkey % 5 WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 4 THEN -1 ELSE 1 END AS newer FROM nation")
def x16_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(f"{_VERSION} AS version").withColumn("newer", text.newer(F.col("version"), snapshots.VERSION))


@query("o6_shown_documents", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def o6_shown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.shown(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "documents", F.desc("n_chars"), F.col("doc_id"))


@query("k11_stamped", "SELECT r_regionkey, 'gleaner' AS generated_by, '2024-01-02T03:04:05' AS generated_at FROM region")
def k11_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    return guards.stamped(table(spark, sf_dir, "region").select("r_regionkey"), "gleaner", lambda: datetime(2024, 1, 2, 3, 4, 5))


@query("a24_summary", "SELECT unnest(['Headings: sentence case', 'Headings: at most level 3', 'Headings: no skipped levels', 'Code blocks: language named', 'Images: alternative text']) AS line, unnest(range(1, 6)) AS place")
def a24_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = guards.summary(conventions.Conventions(max_depth=3))
    return spark.createDataFrame(list(enumerate(lines, 1)), "place long, line string")


_ROOT = "CASE WHEN n_nationkey % 2 = 0 THEN '/home/u/p' ELSE '/srv/x' END"


@query(
    "k9_k10_shown_errors",
    """SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'ValueError: no <project>/docs/' || n_name ELSE 'ValueError: no /srv/x/docs/' || n_name END AS message,
        CASE WHEN length(n_name) <= 8 THEN n_name ELSE substr(n_name, 1, 2) || chr(10) || '[cut]' END AS cut FROM nation""",
)
def k9_k10_shown_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS k", f"'ValueError: no ' || {_ROOT} || '/docs/' || n_name AS error", "n_name AS name")
    return rows.select("k", text.without_root(F.col("error"), "/home/u/p").alias("message"), text.capped(F.col("name"), 8).alias("cut"))


@query("f12_patterns", "SELECT n_nationkey AS k, n_nationkey % 4 = 0 AS accepted FROM nation")
def f12_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = "CASE n_nationkey % 4 WHEN 0 THEN 'src/**/*.' || n_name WHEN 1 THEN '../' || n_name WHEN 2 THEN repeat(n_name, 200) ELSE '(a+)+' || n_name END"
    return table(spark, sf_dir, "nation").selectExpr("n_nationkey AS k", f"{shape} AS pattern").select("k", text.accepted_pattern(F.col("pattern")).alias("accepted"))
