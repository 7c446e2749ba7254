"""Queries over documents: markdown elements, links, quality criteria and conventions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import markdown, text, transforms
from gleaner.operators import conventions, links, quality, references
from gleaner.plans.carriers import ALT, DOC, LANG, LINK, MARK, NL, SUB, SUB_LEVEL, TEXT, TITLE, table
from gleaner.plans.carriers import markdown as part_docs
from gleaner.plans.code_queries import _COVER_SQL, a4_coverage
from gleaner.plans.registry import query

_DOCS = f"d AS (SELECT p_partkey AS k, p_size AS s, {DOC} AS doc, {TEXT} AS text, ({TITLE}) <> '' AS titled, p_brand AS brand, {SUB_LEVEL} AS level, {ALT} AS alt, {LINK} AS link, {MARK} AS mark, {LANG} AS lang FROM part)"
#: Lines before the second heading, and the line of the paragraph and of the fence.
_L = "CASE WHEN titled THEN 2 ELSE 0 END"


def _elements(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return markdown.elements(part_docs(spark, sf_dir)).where(F.col("kind") == kind)


_HEADERS = f"""h AS (SELECT doc, 0 AS ord, 1 AS level, 'Title of ' || brand AS text, 1 AS line FROM d WHERE titled
    UNION ALL SELECT doc, 1, level, regexp_replace(split_part({SUB}, chr(10), 1), '^#+ ', ''), {_L} + 1 FROM d JOIN part ON p_partkey = k)"""


@query("p1_headers", f"WITH {_DOCS}, {_HEADERS} SELECT doc, CAST(level AS INTEGER) AS level, text, CAST(line AS INTEGER) AS line FROM h")
def p1_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir, "header").select("doc", "level", "text", "line")


@query("p2_links", f"WITH {_DOCS} SELECT doc, 'more' AS text, link AS url, CAST({_L} + 3 AS INTEGER) AS line FROM d")
def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir, "link").select("doc", "text", "url", "line")


@query(
    "p3_code_blocks",
    f"WITH {_DOCS} SELECT doc, nullif(lang, '') AS language, '# not a heading' || {NL} || 'call_' || s || '(x)' || {NL} || '- no item' || {NL} AS code, CAST({_L} + 8 AS INTEGER) AS line FROM d",
)
def p3_code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir, "code_block").select("doc", "language", F.col("text").alias("code"), "line")


@query("p4_images", f"WITH {_DOCS} SELECT doc, alt, 'img/i' || (s % 20) || '.png' AS src, CAST({_L} + 3 AS INTEGER) AS line FROM d")
def p4_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir, "image").select("doc", F.col("text").alias("alt"), F.col("url").alias("src"), "line")


@query("p5_code_spans", f"WITH {_DOCS} SELECT doc, unnest(['fn_' || s || '()', 'Brand' || s]) AS text, CAST({_L} + 3 AS INTEGER) AS line FROM d")
def p5_code_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir, "code_span").select("doc", "text", "line")


@query("p6_html_links", """SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]+)"', 1)) AS url FROM pages""")
def p6_html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.html_links(F.col("html"))).alias("url"))


_IMAGE = "'<p><img src=\"a' || p_size || '.png\"' || CASE WHEN p_size % 3 = 0 THEN ' alt=\"x\"' ELSE '' END || '></p>{{< ref \"g' || p_size || '.md\" >}} and {{% note n' || p_size || ' %}}'"


@query("p6_html_images", "SELECT p_partkey AS id, 'a' || p_size || '.png' AS src, CASE WHEN p_size % 3 = 0 THEN 'x' END AS alt FROM part")
def p6_html_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{_IMAGE} AS html")
    return rows.select("id", F.explode(text.html_images(F.col("html"))).alias("i")).select("id", "i.src", "i.alt")


@query("p12_shortcodes", """SELECT p_partkey AS id, unnest(['ref', 'note']) AS type, unnest(['"g' || p_size || '.md"', 'n' || p_size]) AS content FROM part""")
def p12_shortcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{_IMAGE} AS html")
    return rows.select("id", F.explode(text.shortcodes(F.col("html"))).alias("s")).select("id", "s.type", "s.content")


# A link leads from docs/d<a> to ../d<b>/part<n>.md: it stands if that document is there, or any of its name.
_RESOLVED = f"r AS (SELECT q.*, t.doc AS target FROM (SELECT doc, link, {_L} + 3 AS line FROM d) q LEFT JOIN (SELECT doc FROM d) t ON t.doc = 'docs/' || substr(q.link, 4))"


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = part_docs(spark, sf_dir)
    keys = links.link_keys(docs.select(F.col("doc").alias("path")))
    return links.resolve_links(_elements(spark, sf_dir, "link").select("doc", "ord", "url", "line"), keys)


@query("s7_j5_link_resolution", f"WITH {_DOCS}, {_RESOLVED} SELECT doc, link AS url, CAST(line AS INTEGER) AS line, target FROM r")
def s7_j5_link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("doc", "url", "line", "target")


_ASSETS = f"""a AS (SELECT doc, CAST({_L} + 3 AS INTEGER) AS line, alt, 'img/i' || (s % 20) || '.png' AS src, (k % 7) < 5 AND (s % 20) < 15 AS there FROM d),
    issues AS (SELECT 'missing_alt_text' AS type, 'warning' AS severity, doc AS file, line, 'Image missing alt text: ' || src AS message FROM a WHERE alt = ''
        UNION ALL SELECT 'missing_asset', 'error', doc, line, 'Asset not found: ' || src FROM a WHERE NOT there
        UNION ALL SELECT 'broken_link', 'error', doc, CAST(line AS INTEGER), 'Broken link: ' || link || ' (target not found)' FROM r WHERE target IS NULL)"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _elements(spark, sf_dir, "image").select("doc", "ord", F.col("url").alias("src"), F.col("text").alias("alt"), "line")
    files = spark.range(5).selectExpr("'docs/d' || id || '/img/i' AS a", "explode(sequence(0, 14)) AS b").selectExpr("a || b || '.png' AS path")
    return links.asset_issues(images, files).unionByName(links.broken_links(_resolved(spark, sf_dir)))


@query("j6_u1_validation_issues", f"WITH {_DOCS}, {_RESOLVED}, {_ASSETS} SELECT * FROM issues")
def j6_u1_validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir)


@query(
    "a16_severity_totals",
    f"""WITH {_DOCS}, {_RESOLVED}, {_ASSETS}
    SELECT count(*) AS total_issues, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM issues""",
)
def a16_severity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.severity_totals(_issues(spark, sf_dir))


_BREAD = "CASE o_orderkey % 4 WHEN 0 THEN 'Hello World!' WHEN 1 THEN 'API Reference (v2.' || (o_custkey % 3) || ')' WHEN 2 THEN 'hello_world' ELSE '  Été -- ' || o_orderstatus END"


@query(
    "x6_w2_slugs",
    f"""WITH t AS (SELECT o_custkey AS doc, o_orderkey AS ord, {_BREAD} AS text FROM orders),
        s AS (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-') AS base FROM t)
    SELECT doc, ord, text, base || CASE WHEN row_number() OVER w > 1 THEN '-' || (row_number() OVER w - 1) ELSE '' END AS slug FROM s WINDOW w AS (PARTITION BY doc, base ORDER BY ord)""",
)
def x6_w2_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.numbered_slugs(table(spark, sf_dir, "orders").selectExpr("o_custkey AS doc", "o_orderkey AS ord", f"{_BREAD} AS text"))


@query(
    "w1_heading_jumps",
    """SELECT doc, ord, level, previous FROM (SELECT l_orderkey AS doc, l_linenumber AS ord, CAST(l_quantity AS BIGINT) % 6 + 1 AS level,
        lag(CAST(l_quantity AS BIGINT) % 6 + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS previous FROM lineitem) WHERE level > previous + 1""",
)
def w1_heading_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc", "struct(l_linenumber AS n, l_partkey, l_suppkey) AS ord", "CAST(l_quantity AS BIGINT) % 6 + 1 AS level")
    return quality.heading_jumps(rows).withColumn("ord", F.col("ord.n"))


@query("a1_list_markers", f"WITH {_DOCS} SELECT doc, mark AS marker, 2::BIGINT AS n FROM d")
def a1_list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _elements(spark, sf_dir, "code_block").select("doc", "line", "text")
    return quality.list_markers(part_docs(spark, sf_dir), blocks)


@query(
    "a1_w6_marker_majority",
    f"""WITH {_DOCS}, m AS (SELECT mark, count(*) * 2 AS n FROM d GROUP BY 1), t AS (SELECT arg_max(mark, n * 10 - strpos('-*+', mark)) AS top, max(n) AS most, CAST(sum(n) AS BIGINT) AS total FROM m)
    SELECT top AS majority_marker, total, round_even(CAST(most AS DOUBLE) / total, 2) AS consistency_score, (SELECT count(*) FROM d WHERE mark <> top) AS inconsistent_files FROM t""",
)
def a1_w6_marker_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.marker_majority(a1_list_markers(spark, sf_dir))


@query(
    "a2_heading_styles",
    f"""WITH {_DOCS}, {_HEADERS} SELECT d.doc, CAST(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN titled AND upper(brand[1]) = brand[1] THEN 1 ELSE 0 END AS BIGINT) AS title_case,
        CAST(CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END + CASE WHEN titled AND upper(brand[1]) <> brand[1] THEN 1 ELSE 0 END AS BIGINT) AS sentence_case,
        CASE WHEN k % 2 = 0 OR titled THEN 'title_case' ELSE 'sentence_case' END AS style FROM d""",
)
def a2_heading_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.heading_styles(_elements(spark, sf_dir, "header"))


@query("a3_bad_h1", f"WITH {_DOCS} SELECT doc, 0::BIGINT AS h1 FROM d WHERE NOT titled")
def a3_bad_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.bad_h1_counts(part_docs(spark, sf_dir), _elements(spark, sf_dir, "header"))


@query(
    "a6_avoided_terms",
    """WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS doc, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE NOT contains(text, '```'))
    SELECT doc, CAST(line AS INTEGER) AS line, term FROM l, (VALUES ('license', 'mit license'), ('released', NULL), ('version', 'apache')) t(term, but)
    WHERE regexp_matches(text, '\\b' || term || '\\b', 'i') AND (but IS NULL OR NOT regexp_matches(text, '\\b' || but || '\\b', 'i'))""",
)
def a6_avoided_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS STRING) AS doc", "text")
    return quality.avoided_terms(docs, [("license", ["mit license"]), ("released", []), ("version", ["apache"])])


@query(
    "a6_term_usage",
    """SELECT term, CAST(sum(f) AS BIGINT) AS full_form_count, CAST(sum(s) AS BIGINT) AS abbreviation_count, count(*) AS files FROM (
        SELECT 'mit' AS term, len(regexp_extract_all(text, '(?i)mit license')) AS f, len(regexp_extract_all(text, '\\bMIT\\b')) AS s FROM documents
        UNION ALL SELECT 'gpl', len(regexp_extract_all(text, '(?i)general public license')), len(regexp_extract_all(text, '\\bGNU\\b')) FROM documents) WHERE f > 0 OR s > 0 GROUP BY term""",
)
def a6_term_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.term_usage(table(spark, sf_dir, "documents"), [("mit", "MIT License", "MIT"), ("gpl", "General Public License", "GNU")])


@query(
    "a7_relevance",
    f"WITH {_DOCS} SELECT (SELECT sum(CASE WHEN k % 11 = 0 THEN 2 WHEN k % 13 = 0 THEN 10 ELSE 0 END) FROM d) / 10.0 AS deprecated_count, (SELECT count(*) FROM d WHERE k % 11 = 0 OR k % 13 = 0) AS files_with_deprecated",
)
def a7_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.relevance(part_docs(spark, sf_dir))


@query(
    "a8_accuracy",
    f"""WITH {_DOCS} SELECT count(*) AS code_blocks, count(DISTINCT doc) AS files_with_code,
        'python:' || count(*) FILTER (lang <> '') || ',plaintext:' || count(*) FILTER (lang = '') AS languages FROM d""",
)
def a8_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.accuracy(_elements(spark, sf_dir, "code_block"))


@query(
    "a9_purposefulness",
    f"""WITH {_DOCS} SELECT count(*) AS files, count(*) AS files_with_h1, 0::BIGINT AS files_with_toc,
        {", ".join(f"0::BIGINT AS type_{k}" for k in quality.DOC_TYPES)} FROM d""",
)
def a9_purposefulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.purposefulness(part_docs(spark, sf_dir))


@query("a10_duplicate_headers", f"WITH {_DOCS}, {_HEADERS} SELECT lower(trim(text)) AS topic, count(*) AS n FROM h WHERE level <= 2 GROUP BY 1 HAVING count(*) > 1")
def a10_duplicate_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_headers(_elements(spark, sf_dir, "header"))


@query(
    "a11_consistency",
    f"WITH {_DOCS} SELECT CAST(sum(CASE WHEN titled THEN 3 ELSE 2 END) AS BIGINT) AS atx, 0::BIGINT AS setext, count(*) FILTER (lang = '') AS unlabeled_blocks FROM d",
)
def a11_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.consistency(part_docs(spark, sf_dir), _elements(spark, sf_dir, "code_block"))


@query(
    "a12_x13_clarity",
    """WITH t AS (SELECT text, len(list_filter(regexp_split_to_array(text, '[\\p{Z}\\s]+'), lambda x: x <> '')) AS w FROM documents)
    SELECT count(*) AS files, CAST(sum(w) AS BIGINT) AS words, CAST(sum(w) // count(*) AS BIGINT) AS mean_words, count(*) FILTER (regexp_matches(text, '\\bexamples?\\b', 'i')) AS files_with_examples,
        0::BIGINT AS files_with_links, 0::BIGINT AS internal_links, count(*) FILTER (regexp_matches(text, 'table of contents|## contents', 'i')) AS files_with_toc FROM t""",
)
def a12_x13_clarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS STRING) AS doc", "text")
    none = spark.createDataFrame([], "doc string, url string")
    return quality.clarity(docs, none, none)


@query(
    "a13_structure",
    f"""WITH {_DOCS} SELECT CAST(4 AS INTEGER) AS max_depth, (SELECT count(DISTINCT regexp_replace(doc, '/[^/]*$', '')) FROM d) AS folders,
        (SELECT count(*) FROM d WHERE titled AND level > 2) AS jump_files, (SELECT count(*) FROM d WHERE NOT titled) AS bad_h1_files""",
)
def a13_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.structure(part_docs(spark, sf_dir), _elements(spark, sf_dir, "header"))


@query(
    "a15_overall_scores",
    f"""WITH {_DOCS}, {_HEADERS}, {_COVER_SQL}, cov AS (SELECT round_even(count(*) FILTER (name IN (SELECT name FROM doc) OR name IN (SELECT name FROM within_)) * 100.0 / count(*), 1) AS c FROM s),
    m AS (SELECT (SELECT c FROM cov) AS c, (SELECT sum(CASE WHEN k % 11 = 0 THEN 2 WHEN k % 13 = 0 THEN 10 ELSE 0 END) / 10.0 FROM d) AS old, (SELECT count(*) FROM d) AS files,
        (SELECT count(*) FROM (SELECT 1 FROM h WHERE level <= 2 GROUP BY lower(trim(text)) HAVING count(*) > 1)) AS topics, (SELECT count(*) FROM d WHERE lang = '') AS bare,
        (SELECT count(*) FROM d WHERE titled AND level > 2) AS jumps, (SELECT max(level) FROM h) AS deep, (SELECT count(*) FROM d WHERE NOT titled) AS bad),
    r AS (SELECT unnest(['relevance', 'accuracy', 'purposefulness', 'uniqueness', 'consistency', 'clarity', 'structure']) AS criterion,
        unnest([CASE WHEN old <= 10 THEN 'good' ELSE 'fair' END, CASE WHEN files = 0 OR c < 50 THEN 'fair' WHEN c >= 80 AND files > 10 THEN 'excellent' ELSE 'good' END, 'good',
            CASE WHEN topics < 5 THEN 'good' ELSE 'fair' END, CASE WHEN bare < 5 THEN 'good' ELSE 'fair' END, 'good', CASE WHEN jumps < 3 AND deep <= 4 AND bad = 0 THEN 'good' ELSE 'fair' END]) AS score FROM m),
    t AS (SELECT (sum(CASE score WHEN 'excellent' THEN 4 WHEN 'good' THEN 3 WHEN 'fair' THEN 2 ELSE 1 END) + (SELECT CASE WHEN c >= 75 THEN 4 WHEN c >= 50 THEN 3 WHEN c >= 30 THEN 2 ELSE 1 END FROM m)) / 8.0 AS average FROM r)
    SELECT criterion, score, average, CASE WHEN average >= 3.5 THEN 'excellent' WHEN average >= 2.5 THEN 'good' WHEN average >= 1.5 THEN 'fair' ELSE 'poor' END AS overall FROM r, t""",
)
def a15_overall_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = part_docs(spark, sf_dir)
    # Six criteria read the elements: they are parsed once and kept, on disk where memory is short.
    e = markdown.elements(docs).persist()
    kind = lambda k: e.where(F.col("kind") == k)
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
    share = a4_coverage(spark, sf_dir).where("type is null").select("percentage").first()[0]
    scores = quality.criterion_scores(m.withColumn("coverage", F.lit(share)))
    total = quality.overall_score(scores, share)
    return scores.withColumns({c: total.select(c).scalar() for c in total.columns})


@query(
    "p13_conventions",
    f"""WITH {_DOCS} SELECT doc, CAST({_L} + 8 AS INTEGER) AS line, 'language_tag' AS rule, 'error' AS severity FROM d WHERE lang = ''
    UNION ALL SELECT doc, CAST({_L} + 3 AS INTEGER), 'alt_text', 'error' FROM d WHERE alt = ''
    UNION ALL SELECT doc, CAST({_L} + 1 AS INTEGER), 'heading_case', 'warning' FROM d WHERE k % 2 = 1
    UNION ALL SELECT doc, CAST({_L} + 1 AS INTEGER), 'heading_hierarchy', 'warning' FROM d WHERE titled AND level > 2
    UNION ALL SELECT doc, CAST({_L} + 1 AS INTEGER), 'heading_depth', 'warning' FROM d WHERE level > 3""",
)
def p13_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conventions.violations(markdown.elements(part_docs(spark, sf_dir)), conventions.Conventions(max_depth=3))


@query("a19_asset_coverage", f"WITH {_DOCS} SELECT count(*) AS total, count(*) AS local, 0::BIGINT AS external, count(DISTINCT doc) AS documents FROM d")
def a19_asset_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.asset_coverage(_elements(spark, sf_dir, "image").select("doc", F.col("url").alias("src")))


_MIXED = "CASE c_custkey % 6 WHEN 0 THEN 'https://x.org/a' WHEN 1 THEN '#top' WHEN 2 THEN 'a.md#b' WHEN 3 THEN '{{< ref \"a\" >}}' WHEN 4 THEN 'mailto:a@b' ELSE 'FTP://h/i.png?x=1#y' END"


@query(
    "f9_f10_x17_links",
    f"""SELECT url, count(*) AS n, url LIKE 'http%' OR url LIKE 'FTP%' AS external, NOT regexp_matches(url, '^(http|#|mailto|[{{]{{2}}<)') AS checked, regexp_replace(url, '#.*', '') AS path, regexp_replace(url, '[#?].*', '') AS asset
    FROM (SELECT {_MIXED} AS url FROM customer) GROUP BY url""",
)
def f9_f10_x17_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    rows = table(spark, sf_dir, "customer").selectExpr(f"{_MIXED} AS url").groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("url", "n", text.is_external(u).alias("external"), text.is_checked_link(u).alias("checked"), text.link_path(u).alias("path"), text.asset_path(u).alias("asset"))


@query("x12_strip_fences", f"WITH {_DOCS} SELECT doc, sha256(regexp_replace(text, '(?ms)^```.*?^```', '', 'g')) AS sha FROM d")
def x12_strip_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_docs(spark, sf_dir).select("doc", F.sha2(text.strip_fences(F.col("text")), 256).alias("sha"))


@query(
    "x7_x8_k7_migration",
    f"""WITH {_DOCS}, m AS (SELECT *, k % 7 = 0 AS moved, (s0 % 7) = 0 AS target_moved FROM (SELECT *, k % 9 AS s0 FROM d))
    SELECT doc, CASE WHEN k % 7 = 0 THEN replace(doc, 'docs/d0/', 'docs/manual/') ELSE doc END AS new_doc, k % 7 = 0 OR hit AS changed,
        CASE WHEN hit AND k % 7 = 0 THEN replace(substr(link, 4), 'd0/', '') WHEN hit THEN replace(link, '../d0/', '../manual/') ELSE link END AS link
    FROM (SELECT *, ('docs/' || substr(link, 4)) IN (SELECT doc FROM d WHERE k % 7 = 0) AS hit FROM m)""",
)
def x7_x8_k7_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = part_docs(spark, sf_dir)
    moves = docs.where("doc LIKE 'docs/d0/%'").selectExpr("doc AS old", "replace(doc, 'docs/d0/', 'docs/manual/') AS new")
    got = transforms.migrate(docs, moves)
    return got.select("doc", "new_doc", "changed", F.regexp_extract("text", r"\[more\]\(([^)]*)\)", 1).alias("link"))


@query(
    "x9_toc",
    f"""WITH {_DOCS}, h AS (SELECT doc, CASE WHEN titled THEN '- [Title of ' || brand || '](#' || replace(replace(lower('Title of ' || brand), '#', ''), ' ', '-') || ')' ELSE '' END AS one,
        CASE WHEN level <= 3 THEN repeat('  ', CAST(level - 1 AS INTEGER)) || '- [' || t || '](#' || replace(lower(t), ' ', '-') || ')' ELSE '' END AS two
        FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 'The Size Of Box ' ELSE 'the size ' END || s AS t FROM d))
    SELECT doc, one || CASE WHEN one <> '' AND two <> '' THEN chr(10) ELSE '' END || two AS toc FROM h""",
)
def x9_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.tables_of_contents(part_docs(spark, sf_dir))


@query("x10_front_matter", "SELECT p_partkey AS doc, CASE WHEN p_partkey % 3 < 2 THEN ['yaml', 'toml'][p_partkey % 3 + 1] END AS kind, CASE WHEN p_partkey % 3 < 2 THEN '{\"size\": ' || p_size || '}' END AS front_matter, 'body ' || p_size AS body FROM part")
def x10_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS doc",
        f"CASE p_partkey % 3 WHEN 0 THEN '---' || {NL} || 'size: ' || p_size || {NL} || '---' || {NL} WHEN 1 THEN '+++' || {NL} || 'size = ' || p_size || {NL} || '+++' || {NL} ELSE '' END || 'body ' || p_size AS text",
    )
    return transforms.front_matter(rows).withColumn("doc", F.col("doc").cast("long"))
