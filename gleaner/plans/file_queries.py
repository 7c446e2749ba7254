"""Queries over files, changes and staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import paths
from gleaner.operators import changes, conventions
from gleaner.plans.carriers import DOC, PATH, table
from gleaner.plans.carriers import paths as part_paths
from gleaner.plans.registry import query

# Every seventh document was elsewhere before, every eleventh is now, every fifth has changed.
_SNAPSHOTS = """base AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'was/' ELSE 'doc/' END || doc_id AS path,
                         sha256(CASE WHEN doc_id % 5 = 0 THEN text || '~' ELSE text END) AS sha256
                  FROM documents),
         cur AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'now/' ELSE 'doc/' END || doc_id AS path, sha256(text) AS sha256 FROM documents)"""
_CHANGES = """SELECT coalesce(c.path, b.path) AS path,
           CASE WHEN b.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' ELSE 'modified' END AS change_type
    FROM cur c FULL OUTER JOIN base b ON c.path = b.path
    WHERE c.sha256 IS DISTINCT FROM b.sha256"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    path = lambda n, other: F.concat(F.when(F.col("doc_id") % n == 0, other).otherwise("doc/"), F.col("doc_id")).alias("path")
    old = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text"))
    return docs.select(path(11, "now/"), F.sha2("text", 256).alias("sha256")), docs.select(path(7, "was/"), F.sha2(old, 256).alias("sha256"))


@query("j1_change_detection", f"WITH {_SNAPSHOTS} {_CHANGES}")
def j1_change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.snapshot_changes(*_snapshots(spark, sf_dir))


@query("j2_changed_since", f"WITH {_SNAPSHOTS} SELECT path, sha256 FROM cur EXCEPT SELECT path, sha256 FROM base")
def j2_changed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.changed_since(*_snapshots(spark, sf_dir))


@query("a21_change_share", f"WITH {_SNAPSHOTS} SELECT count(*) AS changes, round_even(count(*) * 100.0 / (SELECT count(*) FROM documents), 1) AS change_percentage FROM ({_CHANGES})")
def a21_change_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.change_share(changes.snapshot_changes(*_snapshots(spark, sf_dir)), table(spark, sf_dir, "documents").count())


def _like(column: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


def _change_category_sql(path: str) -> str:
    whens = []
    for name, parts, ends, names in paths.CHANGE_CATEGORIES:
        tests = [f"contains({path}, '{p}')" for p in parts] + [f"ends_with(lower({path}), '{e}')" for e in ends] + [f"contains(lower({path}), '{n}')" for n in names]
        whens.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return f"CASE {' '.join(whens)} ELSE 'other' END"


@query("x2_change_category", f"SELECT path, {_change_category_sql('path')} AS category FROM (SELECT {PATH} AS path FROM part)")
def x2_change_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_paths(spark, sf_dir).select("path", paths.change_category(F.col("path")).alias("category"))


@query(
    "x3_a22_scan_categories",
    f"""SELECT CASE WHEN regexp_matches(lower(path), '[.](py|js|ts|tsx|jsx|go|rs|java|c|cpp|h|hpp)$') THEN 'code'
        WHEN regexp_matches(lower(path), '[.](md|rst|txt|adoc)$') OR regexp_matches(lower(path), '(readme|changelog)[^/]*$') THEN 'docs'
        WHEN regexp_matches(lower(path), '[.](json|yaml|yml|toml|ini|cfg|conf)$') OR regexp_matches(lower(path), '(^|/)(dockerfile|makefile)$') THEN 'config'
        WHEN regexp_matches(lower(path), '[.](png|jpg|jpeg|gif|svg|ico|webp|pdf)$') THEN 'assets' ELSE 'other' END AS category, count(*) AS n
    FROM (SELECT {PATH} AS path FROM part) GROUP BY 1""",
)
def x3_a22_scan_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conventions.category_histogram(part_paths(spark, sf_dir))


@query(
    "x4_x5_doc_category",
    f"""SELECT doc, CASE WHEN contains(doc, 'reference') AND {_like("doc", ("command", "cli"))} THEN 'cli' WHEN contains(doc, 'reference') AND contains(doc, 'api') THEN 'api'
        WHEN contains(doc, 'reference') AND contains(doc, 'config') THEN 'config' WHEN contains(doc, 'reference') AND contains(doc, 'arch') THEN 'architecture'
        WHEN {_like("doc", ("getting-started", "installation"))} THEN 'dependency' WHEN contains(doc, 'development') AND {_like("doc", ("ci", "cd"))} THEN 'infrastructure'
        WHEN contains(doc, 'development') AND contains(doc, 'contrib') THEN 'contributing' WHEN {_like("doc", ("guide", "workflow"))} THEN 'workflows'
        WHEN regexp_matches(doc, '(^|/)readme[.]md$') THEN 'readme' END AS category
    FROM (SELECT regexp_replace({PATH}, '^docs/', '') AS doc FROM part)""",
)
def x4_x5_doc_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = part_paths(spark, sf_dir).select(paths.doc_relative(F.col("path"), "docs").alias("doc"))
    return doc.select("doc", paths.doc_category(F.col("doc")).alias("category"))


EXCLUDES = ["**/node_modules/**", "**/*.o", "img/**", "docs/*setup1*", "**/w[12]?/*.mod", "build/**"]


@query(
    "f1_f2_f4_excludes",
    f"""SELECT path, regexp_matches(path, '(^|/)node_modules/') OR regexp_matches(path, '[.]o$') OR regexp_matches(path, '^(img|build)(/|$)')
          OR regexp_matches(path, '^docs/.*setup1') OR regexp_matches(path, '(^|/)w[12]./.*[.]mod$') AS excluded, regexp_matches(path, '(^|/)[.]') AS hidden
    FROM (SELECT {PATH} AS path FROM part)""",
)
def f1_f2_f4_excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return part_paths(spark, sf_dir).select("path", paths.excluded(p, EXCLUDES).alias("excluded"), paths.hidden(p).alias("hidden"))


GITIGNORE = "# built\n*.o\nnode_modules/\n/docs/guide/*\n!/docs/guide/setup1*.md\nw1?/go.mod\n"


@query(
    "f3_gitignore",
    f"""SELECT path, CASE WHEN regexp_matches(path, '^w1./go[.]mod$') THEN true WHEN regexp_matches(path, '^docs/guide/setup1[^/]*[.]md$') THEN false
          WHEN regexp_matches(path, '^docs/guide/') THEN true ELSE regexp_matches(path, '[.]o$') OR regexp_matches(path, '(^|/)node_modules/') END AS ignored
    FROM (SELECT {PATH} AS path FROM part)""",
)
def f3_gitignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_paths(spark, sf_dir).select("path", paths.ignored(F.col("path"), paths.gitignore_rules(GITIGNORE)).alias("ignored"))


@query(
    "a23_staleness",
    """SELECT level, count(*) AS n, CAST(sum(days_old) AS BIGINT) AS days FROM (
        SELECT days_old, CASE WHEN ts IS NULL THEN 'critical' WHEN days_old < 7 THEN 'fresh' WHEN days_old < 30 THEN 'stale' WHEN days_old < 90 THEN 'very_stale' ELSE 'critical' END AS level
        FROM (SELECT CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS ts,
                     coalesce(CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(floor(epoch(TIMESTAMP '2024-03-20 00:00:00' - (ts - INTERVAL 1 DAY * (event_id % 90) + INTERVAL 40 DAY)) / 86400) AS BIGINT) END, -1) AS days_old FROM events))
    GROUP BY level""",
)
def a23_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("ts - make_dt_interval(int(event_id % 90)) + make_dt_interval(40)")
    text = F.when(F.col("event_id") % 17 == 0, F.lit("no time")).otherwise(at.cast("string"))
    rows = table(spark, sf_dir, "events").select(text.alias("ts"))
    return changes.staleness(rows, "2024-03-20T00:00:00").groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("days_old").alias("days"))


MAPPINGS = {"cli": "docs/cli.md", "api": "docs/api.md", "config": "docs/config.md", "infrastructure": "docs/ops.md", "other": "docs/d0/part7.md"}


@query(
    "j3_j4_a14_affected_docs",
    f"""WITH f AS (SELECT {PATH} AS file, p_partkey AS ord, {_change_category_sql(f"({PATH})")} AS category FROM part),
        edges AS (SELECT DISTINCT CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'other/' END || {PATH} AS file, 'docs/d0/part' || (p_partkey // 7 * 7 % 700) || '.md' AS doc FROM part),
        hit AS (
            SELECT e.doc, f.file, ord, 'Code change: ' || f.file AS reason, 1 AS r FROM f JOIN edges e USING (file) WHERE category <> 'documentation'
            UNION ALL
            SELECT m.doc, file, ord, upper(category[1]) || category[2:] || ' changes: ' || file, CASE WHEN category IN ('cli', 'api', 'config') THEN 1 ELSE 2 END
            FROM f JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in MAPPINGS.items())}) m(category, doc) USING (category)
            WHERE category <> 'documentation' AND file NOT IN (SELECT file FROM edges))
    SELECT doc, doc IN (SELECT {DOC} FROM part) AS "exists", arg_min(reason, ord) AS reason, CASE WHEN min(r) = 1 THEN 'high' ELSE 'medium' END AS priority,
           array_to_string(list(file ORDER BY ord), ',') AS affected_by
    FROM hit GROUP BY doc""",
)
def j3_j4_a14_affected_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = part_paths(spark, sf_dir)
    changed = f.select(F.col("path").alias("file"), F.col("p_partkey").alias("ord"), paths.change_category(F.col("path")).alias("category"))
    edges = f.selectExpr("CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'other/' END || path AS file", "'docs/d0/part' || (p_partkey div 7 * 7 % 700) || '.md' AS doc")
    docs = table(spark, sf_dir, "part").selectExpr(f"{DOC} AS path")
    return changes.affected_docs(changed, edges, MAPPINGS, docs).withColumn("affected_by", F.array_join("affected_by", ","))


@query(
    "s17_j20_platforms",
    """WITH f AS (SELECT CASE s_suppkey % 6 WHEN 0 THEN 'docs/mkdocs.yml' WHEN 1 THEN 'website/docusaurus.config.js' WHEN 2 THEN 'package.json' WHEN 3 THEN 'docs/a.md' WHEN 4 THEN 'site/_config.yml' ELSE 'src/mkdocs.yml' END AS path FROM supplier)
    SELECT platform, 'high' AS confidence, path AS evidence
    FROM (SELECT DISTINCT path FROM f) JOIN (VALUES ('mkdocs', 'docs/mkdocs.yml'), ('docusaurus', 'website/docusaurus.config.js'), ('jekyll', 'site/_config.yml')) m(platform, path) USING (path)""",
)
def s17_j20_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "supplier").selectExpr(
        "CASE s_suppkey % 6 WHEN 0 THEN 'docs/mkdocs.yml' WHEN 1 THEN 'website/docusaurus.config.js' WHEN 2 THEN 'package.json' WHEN 3 THEN 'docs/a.md' WHEN 4 THEN 'site/_config.yml' ELSE 'src/mkdocs.yml' END AS path",
        "'uses docusaurus' AS text",
    )
    return conventions.detect_platforms(files).withColumn("evidence", F.array_join("evidence", ","))


@query("s19_project_facts", "SELECT 'JavaScript/TypeScript' AS language, 'docs' AS docs_path")
def s19_project_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "nation").selectExpr("CASE n_nationkey % 4 WHEN 0 THEN 'setup.py' WHEN 1 THEN 'package.json' WHEN 2 THEN 'doc/a.md' ELSE 'docs/b.md' END AS path")
    return conventions.project_facts(files)
