"""Project data derived from the tables by SQL that Spark and the oracle both run: paths, documents, symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"

#: A project path for each part.
PATH = """CASE p_partkey % 18
  WHEN 0 THEN 'cmd/tool' || p_partkey || '/main.go' WHEN 1 THEN 'src/test_mod' || p_partkey || '.py'
  WHEN 2 THEN 'w' || p_partkey || '/requirements.txt' WHEN 3 THEN 'w' || p_partkey || '/package.json'
  WHEN 4 THEN 'w' || p_partkey || '/go.mod' WHEN 5 THEN 'tests/case_' || p_partkey || '.py'
  WHEN 6 THEN 'w' || p_partkey || '/Dockerfile' WHEN 7 THEN '.github/workflows/ci' || p_partkey || '.yml'
  WHEN 8 THEN 'img/logo' || p_partkey || '.PNG' WHEN 9 THEN 'LICENSE' || p_partkey
  WHEN 10 THEN 'docs/guide/setup' || p_partkey || '.md' WHEN 11 THEN 'docs/reference/cli/cmd' || p_partkey || '.md'
  WHEN 12 THEN 'node_modules/lib' || p_partkey || '/index.js' WHEN 13 THEN 'build/out' || p_partkey || '.o'
  WHEN 14 THEN 'docs/reference/api' || p_partkey || '.md' WHEN 15 THEN 'web/' || p_partkey || '/app.tsx'
  WHEN 16 THEN 'notes/' || p_partkey || '/README.rst' ELSE 'docs/development/ci/' || p_partkey || '.txt' END"""

#: A markdown document for each part, at docs/d<n>/part<key>.md.
DOC = "'docs/d' || (p_partkey % 7) || '/part' || p_partkey || '.md'"
TITLE = f"CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '# Title of ' || p_brand || {NL} || {NL} END"
SUB_LEVEL = "(p_partkey % 3 + 2)"
SUB = f"CASE p_partkey % 3 WHEN 0 THEN '## ' WHEN 1 THEN '### ' ELSE '#### ' END || CASE WHEN p_partkey % 2 = 0 THEN 'The Size Of Box ' ELSE 'the size ' END || p_size"
LINK = "'../d' || (p_partkey % 9) || '/part' || (p_partkey + 2) || '.md'"
ALT = "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'alt text' END"
MARK = "CASE p_partkey % 4 WHEN 0 THEN '*' WHEN 3 THEN '+' ELSE '-' END"
LANG = "CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'python' END"
TEXT = f"""{TITLE} || {SUB} || {NL} || {NL} || 'Use `fn_' || p_size || '()` or `Brand' || p_size || '` with [more](' || {LINK} || ') and ![' || {ALT} || '](img/i' || (p_size % 20) || '.png).'
  || CASE WHEN p_partkey % 11 = 0 THEN ' This is the old, deprecated way; see the release notes.' WHEN p_partkey % 13 = 0 THEN ' It is no longer supported.' ELSE '' END
  || {NL} || {NL} || {MARK} || ' first' || {NL} || {MARK} || ' second just now' || {NL} || {NL} || '```' || {LANG} || {NL} || '# not a heading' || {NL} || 'call_' || p_size || '(x)' || {NL} || '- no item' || {NL} || '```' || {NL}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{PATH} AS path")


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, text) of the documents."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{DOC} AS doc", f"{TEXT} AS text")
