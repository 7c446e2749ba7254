"""Queries over symbols, their differences, and references from documents to code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import markdown, symbols, text
from gleaner.operators import coverage, diff, references
from gleaner.plans.carriers import DOC, PATH, table
from gleaner.plans.carriers import markdown as part_docs
from gleaner.plans.registry import query
from gleaner.sources import git

# Two snapshots of symbols: each part is a symbol that later loses, gains or changes something by its key.
_FILE = "'src/m' || (p_partkey % 40) || CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.go' ELSE '.ts' END"
_NAME = "CASE p_partkey % 4 WHEN 0 THEN '_h' WHEN 1 THEN 'Run' ELSE 'do' END || p_partkey"
_TYPE = "CASE p_partkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'struct' ELSE 'function' END"
# Every seventh had another name before, and another one has now.
_OLD = f"{_FILE} AS file, CASE WHEN p_partkey % 7 = 0 THEN 'was' || p_partkey ELSE {_NAME} END AS name, {_TYPE} AS type, p_size AS line, 1 AS column_, 'def ' || p_size AS signature, CASE WHEN p_partkey % 6 = 0 THEN 'P' END AS parent, CASE WHEN p_partkey % 8 = 0 THEN p_brand END AS doc"
_NEW = (
    f"{_FILE} AS file, CASE WHEN p_partkey % 7 = 1 THEN 'now' || p_partkey ELSE {_NAME} END AS name, {_TYPE} AS type, p_size + CASE WHEN p_partkey % 7 = 2 THEN 5 ELSE 0 END AS line, 1 AS column_, 'def ' || (p_size + CASE WHEN p_partkey % 7 = 3 THEN 1 ELSE 0 END) AS signature, "
    "CASE WHEN p_partkey % 6 = 0 AND p_partkey % 7 <> 4 THEN 'P' WHEN p_partkey % 7 = 4 THEN 'Q' END AS parent, CASE WHEN p_partkey % 8 = 0 AND p_partkey % 7 <> 5 THEN p_brand END AS doc"
)
_SYMBOL_SQL = f"""o AS (SELECT {_OLD} FROM part), n AS (SELECT {_NEW} FROM part),
    ch AS (SELECT coalesce(n.name, o.name) AS name, coalesce(n.file, o.file) AS file, coalesce(n.type, o.type) AS symbol_type, n.line AS line, o.signature AS old_signature, n.signature AS new_signature,
        CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' WHEN o.signature IS DISTINCT FROM n.signature THEN 'signature_changed'
             WHEN o.parent IS DISTINCT FROM n.parent AND o.parent IS NOT NULL THEN 'parent_changed' WHEN o.doc IS DISTINCT FROM n.doc THEN 'doc_changed' WHEN o.line <> n.line THEN 'modified' END AS change_type
        FROM o FULL JOIN n ON o.file = n.file AND o.name = n.name),
    sc AS (SELECT *, CASE WHEN change_type = 'removed' OR change_type = 'signature_changed' AND CASE WHEN file LIKE '%.py' THEN name NOT LIKE '\\_%' ESCAPE '\\' WHEN file LIKE '%.go' THEN regexp_matches(name, '^[A-Z]') ELSE true END
        THEN 'breaking' ELSE 'non-breaking' END AS severity FROM ch WHERE change_type IS NOT NULL)"""


def _symbols(spark: SparkSession, sf_dir: str, expr: str) -> DataFrame:
    # A first, stale row for some symbols: the last of a key counts.
    base = table(spark, sf_dir, "part")
    cols = expr.replace("column_", "`column`")
    rows = base.selectExpr(*_split(cols), "2 AS ord")
    stale = base.where("p_partkey % 9 = 0").selectExpr(*_split(cols), "1 AS ord").withColumn("signature", F.lit("stale"))
    return rows.unionByName(stale)


def _split(expr: str) -> list[str]:
    """Select items of a list at the commas outside of brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(expr):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(expr[last:i])
            last = i + 1
    return [x.strip() for x in [*out, expr[last:]]]


def _symbol_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.symbol_changes(_symbols(spark, sf_dir, _OLD), _symbols(spark, sf_dir, _NEW))


@query("j16_w3_o1_symbol_changes", f"WITH {_SYMBOL_SQL} SELECT name, file, symbol_type, line, old_signature, new_signature, change_type, severity FROM sc")
def j16_w3_o1_symbol_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = diff.ordered_changes(_symbol_changes(spark, sf_dir))
    return got.select("name", "file", "symbol_type", "line", "old_signature", "new_signature", "change_type", "severity")


_FIELD = "'C' || (p_partkey % 30) AS parent_symbol, CASE WHEN p_partkey % 7 = {} THEN '{}' ELSE 'f' END || p_partkey AS name, 'cfg/' || (p_partkey % 5) || '.py' AS file"
_FOLD = f"{_FIELD.format(0, 'was')}, CASE p_partkey % 3 WHEN 0 THEN 'str' WHEN 1 THEN 'int' END AS field_type, 'd' || p_size AS default_value, p_partkey % 2 = 0 AS is_optional"
_FNEW = f"{_FIELD.format(1, 'now')}, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey % 7 = 2 THEN 'str | None' ELSE 'str' END WHEN 1 THEN CASE WHEN p_partkey % 7 = 3 THEN 'str' ELSE 'int' END END AS field_type, 'd' || (p_size + CASE WHEN p_partkey % 7 = 4 THEN 1 ELSE 0 END) AS default_value, p_partkey % 2 = 0 AND p_partkey % 7 <> 5 AS is_optional"
_FIELD_SQL = f"""o AS (SELECT {_FOLD} FROM part), n AS (SELECT {_FNEW} FROM part),
    b AS (SELECT coalesce(n.name, o.name) AS field_name, coalesce(n.parent_symbol, o.parent_symbol) AS parent_symbol, coalesce(n.file, o.file) AS file, o.field_type AS t0, n.field_type AS t1, o.default_value AS d0, n.default_value AS d1,
        o.name IS NULL AS fresh, n.name IS NULL AS gone, coalesce(o.is_optional AND NOT n.is_optional, false) AS tight FROM o FULL JOIN n USING (parent_symbol, name, file)),
    c AS (SELECT *, CASE WHEN fresh THEN 'added' WHEN gone THEN 'removed' WHEN t0 IS DISTINCT FROM t1 THEN 'type_changed' WHEN d0 IS DISTINCT FROM d1 THEN 'default_changed' WHEN tight THEN 'type_changed' END AS change_type FROM b),
    fc AS (SELECT *, CASE WHEN change_type = 'removed' OR change_type = 'type_changed' AND NOT coalesce(t1 LIKE '%None%' AND t0 NOT LIKE '%None%' AND contains(replace(t1, ' | None', ''), t0), false) THEN 'breaking' ELSE 'non-breaking' END AS severity FROM c WHERE change_type IS NOT NULL)"""


@query(
    "j17_o2_config_changes",
    f"""WITH {_FIELD_SQL} SELECT field_name, parent_symbol, file, change_type, severity, d0 AS old_default, d1 AS new_default,
        t0 || CASE WHEN change_type = 'type_changed' AND t0 = t1 THEN ' (optional)' ELSE '' END AS old_type, t1 || CASE WHEN change_type = 'type_changed' AND t0 = t1 THEN ' (required)' ELSE '' END AS new_type,
        CASE change_type WHEN 'added' THEN 'add_field_doc' WHEN 'removed' THEN 'remove_field_doc' ELSE 'update_field_doc' END AS documentation_action FROM fc""",
)
def j17_o2_config_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = lambda expr: table(spark, sf_dir, "part").selectExpr(*_split(expr), "1 AS ord")
    return diff.ordered_config_changes(diff.config_changes(snap(_FOLD), snap(_FNEW)))


_ACTION_SQL = " ".join(f"WHEN change_type = '{a}' AND symbol_type = '{b}' THEN '{{{i}}}'" for i, (a, b) in enumerate(diff.ACTIONS))


def _case(i: int) -> str:
    return _ACTION_SQL.format(*(v[i] for v in diff.ACTIONS.values()))


@query(
    "j18_j19_o3_actions",
    f"""WITH {_SYMBOL_SQL},
    a AS (SELECT *, CASE {_case(0)} ELSE 'update_section' END AS action_type, CASE {_case(1)} ELSE CASE severity WHEN 'breaking' THEN 'medium' ELSE 'low' END END AS base FROM sc)
    SELECT name, file, change_type, action_type, CASE WHEN severity = 'breaking' AND base <> 'critical' THEN 'high' ELSE base END AS priority,
        CASE WHEN regexp_matches(file, 'src/m[012][.]') THEN 'docs/mapped.md' WHEN file LIKE '%.py' THEN 'docs/reference/' || regexp_extract(file, '/(.*)[.]py', 1) || '.md'
             WHEN file LIKE '%.go' THEN 'docs/api/' || regexp_extract(file, '/(.*)[.]go', 1) || '.md' ELSE 'docs/api/' || regexp_extract(file, '/(.*)[.]ts', 1) || '.md' END AS target_file FROM a""",
)
def j18_j19_o3_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.range(3).selectExpr("explode(array('src/m' || id || '.py', 'src/m' || id || '.go', 'src/m' || id || '.ts')) AS file", "'docs/mapped.md' AS doc", "1 AS ord")
    got = diff.actions(_symbol_changes(spark, sf_dir), edges)
    return diff.ordered_actions(got).select("name", "file", "change_type", "action_type", "priority", "target_file")


@query(
    "j18_config_actions",
    f"""WITH {_FIELD_SQL} SELECT change_type, severity, CASE change_type WHEN 'added' THEN 'add_field_doc' WHEN 'removed' THEN 'remove_section' WHEN 'type_changed' THEN 'update_field_doc' ELSE 'update_example' END AS action_type,
        CASE change_type WHEN 'added' THEN 'high' WHEN 'removed' THEN 'critical' WHEN 'type_changed' THEN 'high' ELSE 'medium' END AS priority, count(*) AS n FROM fc GROUP BY ALL""",
)
def j18_config_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = diff.config_actions(j17_o2_config_changes(spark, sf_dir))
    return got.groupBy("change_type", "severity", "action_type", "priority").agg(F.count(F.lit(1)).alias("n"))


# References.
_SPANS = [
    ("src/a.py", "file_path", "src/a.py"), ("run_it()", "function", "run_it()"), ("Foo.bar()", "function", "Foo.bar()"), ("SaveVault()", None, None), ("Vault", "class", "Vault"), ("API", None, None),
    ("platform", "command", "platform"), ("docs_path", "config_key", "docs_path"), ("server_a.port", "config_key", "server_a.port"), ("plat_form: hugo", "config_key", "plat_form"),
    ("the thing", None, None), ("vault backup --all", "command", "vault backup --all"), ("do_run", "function", "do_run()"), ("Ab Cd", None, None), ("x1_", "config_key", "x1_"),
]
_SPAN = "CASE p_partkey % 15 " + " ".join(f"WHEN {i} THEN '{s[0]}'" for i, s in enumerate(_SPANS)) + " END"


@query(
    "p7_reference_classes",
    f"""SELECT {DOC} AS doc, type, reference FROM part JOIN (VALUES {", ".join(f"({i}, '{s[1]}', '{s[2]}')" for i, s in enumerate(_SPANS) if s[1])}) v(k, type, reference) ON p_partkey % 15 = k""",
)
def p7_reference_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "part").selectExpr(f"{DOC} AS doc", "1 AS line", f"{_SPAN} AS text")
    index = spark.createDataFrame([("do_run", "function"), ("do_run", "class")], "name string, type string")
    return references.span_references(spans, index).drop("line")


_RAW = "'# title' || chr(10) || '## make_' || p_size || '(x, y)' || chr(10) || 'Call $ vault sync --all or the add command; add command again' || chr(10) || 'run command and `list` subcommand' || p_brand"


@query(
    "p7_text_references",
    """SELECT p_partkey AS doc, unnest([2, 3, 3, 4]) AS line, unnest(['function', 'command', 'semantic_command', 'semantic_command']) AS type, unnest(['make_' || p_size || '()', 'vault sync --all', 'add', 'list']) AS reference
    FROM part WHERE NOT regexp_matches(p_brand, '^[A-Za-z0-9]') UNION ALL
    SELECT p_partkey, unnest([2, 3, 3]), unnest(['function', 'command', 'semantic_command']), unnest(['make_' || p_size || '()', 'vault sync --all', 'add']) FROM part WHERE regexp_matches(p_brand, '^[A-Za-z0-9]')""",
)
def p7_text_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.text_references(table(spark, sf_dir, "part").selectExpr("p_partkey AS doc", f"{_RAW} AS text"))


_BASH = "'$ vault sync' || chr(10) || '# note' || chr(10) || 'A=1 b' || chr(10) || 'git pull' || chr(10) || 'tool' || p_size || ' go' || chr(10) || 'echo x'"


@query("p10_bash_commands", "SELECT p_partkey AS doc, unnest([8, 12]) AS line, 'command' AS type, unnest(['vault sync', 'tool' || p_size || ' go']) AS reference FROM part WHERE p_partkey % 2 = 0")
def p10_bash_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS doc", "7 AS line", "CASE WHEN p_partkey % 2 = 0 THEN 'bash' ELSE 'python' END AS language", f"{_BASH} AS text")
    return references.bash_commands(rows)


# References to source files: by exact path, by the end of a path, or to nothing.
_REFS = f"refs AS (SELECT 'd' || (p_partkey % 50) AS doc, 'file_path' AS type, CASE p_partkey % 3 WHEN 0 THEN {PATH} WHEN 1 THEN regexp_replace({PATH}, '^[^/]*/', '') ELSE 'nowhere/x' || p_partkey || '.py' END AS reference FROM part)"


@query(
    "j10_j11_path_references",
    f"""WITH {_REFS}, src AS (SELECT {PATH} AS path FROM part), one AS (SELECT DISTINCT doc, reference, path FROM refs JOIN src ON path = reference)
    SELECT doc, 'file_path' AS type, reference, path FROM one
    UNION ALL SELECT DISTINCT doc, 'file_path', reference, path FROM refs JOIN src ON ends_with(path, '/' || reference) WHERE (doc, reference) NOT IN (SELECT doc, reference FROM one)""",
)
def j10_j11_path_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "part")
    refs = base.selectExpr("'d' || (p_partkey % 50) AS doc", "'file_path' AS type", f"CASE p_partkey % 3 WHEN 0 THEN {PATH} WHEN 1 THEN regexp_replace({PATH}, '^[^/]*/', '') ELSE 'nowhere/x' || p_partkey || '.py' END AS reference")
    return references.match_paths(refs, base.selectExpr(f"{PATH} AS path"))


# Suppliers ask for functions; some are in the index, some are only defined in the text of a file, some are nowhere.
_ASK = "'d' || (s_suppkey % 20) AS doc, CASE WHEN s_suppkey % 2 = 0 THEN 'function' ELSE 'class' END AS type, CASE s_suppkey % 4 WHEN 0 THEN 'Cls.do' || s_suppkey || '()' WHEN 1 THEN 'Run' || s_suppkey WHEN 2 THEN 'def_' || (s_suppkey % 10) || '()' ELSE 'None' || s_suppkey END AS reference"
_CODE = "'src/f' || s_suppkey || '.py' AS path, 'import x' || chr(10) || 'def def_' || (s_suppkey % 10) || '(a):' || chr(10) || '    pass' || chr(10) || 'class K' || s_suppkey || ':' AS text"


@query("j13_definitions", "SELECT 'src/f' || s_suppkey || '.py' AS path, unnest(['def_' || (s_suppkey % 10), 'K' || s_suppkey]) AS name FROM supplier")
def j13_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.definitions(table(spark, sf_dir, "supplier").selectExpr(*_split(_CODE)))


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sup = table(spark, sf_dir, "supplier")
    known = table(spark, sf_dir, "part").selectExpr(f"{_NAME} AS name", f"{_FILE} AS file", f"{_TYPE} AS type")
    return sup.selectExpr(*_split(_ASK)), known, references.definitions(sup.selectExpr(*_split(_CODE)))


_MATCH_SQL = f"""asked AS (SELECT DISTINCT *, regexp_extract(replace(reference, '()', ''), '[^.]*$') AS name FROM (SELECT {_ASK} FROM supplier)), sym AS (SELECT DISTINCT {_NAME} AS name, {_FILE} AS file FROM part),
    def AS (SELECT DISTINCT 'src/f' || s_suppkey || '.py' AS path, unnest(['def_' || (s_suppkey % 10), 'K' || s_suppkey]) AS name FROM supplier),
    hit AS (SELECT doc, type, reference, file AS path FROM asked JOIN sym USING (name) UNION ALL SELECT doc, type, reference, path FROM asked JOIN def USING (name) WHERE name NOT IN (SELECT name FROM sym))"""


@query("j12_j13_symbol_references", f"WITH {_MATCH_SQL} SELECT * FROM hit")
def j12_j13_symbol_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.match_symbols(*_asked(spark, sf_dir))


@query("j15_unmatched", f"WITH {_MATCH_SQL} SELECT doc, type, reference FROM asked EXCEPT SELECT doc, type, reference FROM hit")
def j15_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir)
    return references.unmatched(asked[0], references.match_symbols(*asked))


@query(
    "p14_stale_references",
    f"WITH {_MATCH_SQL} SELECT 'stale_reference' AS type, 'warning' AS severity, doc AS file, 1 AS line, 'Reference not found in code: ' || reference AS message FROM (SELECT doc, type, reference FROM asked EXCEPT SELECT doc, type, reference FROM hit)",
)
def p14_stale_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.stale_references(j15_unmatched(spark, sf_dir))


@query("a17_u4_inverted", f"WITH {_MATCH_SQL} SELECT path, array_to_string(list(DISTINCT doc ORDER BY doc), ',') AS docs FROM hit GROUP BY path")
def a17_u4_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = references.dependencies(references.match_symbols(*_asked(spark, sf_dir)))
    return references.inverted(edges, "path", "doc").withColumn("docs", F.array_join("docs", ","))


@query(
    "a18_reference_density",
    """WITH n AS (SELECT c_custkey AS doc, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 5 THEN '1-5' WHEN n <= 10 THEN '6-10' ELSE '11+' END AS bucket, count(*) AS documents, CAST(sum(n) AS BIGINT) AS "references" FROM n GROUP BY 1""",
)
def a18_reference_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "orders").selectExpr("o_custkey AS doc")
    return references.reference_density(table(spark, sf_dir, "customer").selectExpr("c_custkey AS doc"), refs)


_COMMANDS = "'d' || s_suppkey AS doc, CASE WHEN s_suppkey % 2 = 0 THEN 'command' ELSE 'semantic_command' END AS type, CASE WHEN s_suppkey % 2 = 0 THEN 'git ' ELSE '' END || 'tool' || (s_suppkey * 18) AS reference"


@query(
    "j14_x11_command_references",
    f"""WITH c AS (SELECT {_COMMANDS} FROM supplier) SELECT doc, type, reference, path FROM c JOIN (SELECT {PATH} AS path FROM part) ON path = 'cmd/' || replace(reference, 'git ', '') || '/main.go'""",
)
def j14_x11_command_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "supplier").selectExpr(*_split(_COMMANDS))
    return references.match_commands(refs, table(spark, sf_dir, "part").selectExpr(f"{PATH} AS path"))


_WORDS = "CASE c_custkey % 6 WHEN 0 THEN 'git commit -m' WHEN 1 THEN 'vault backup create' WHEN 2 THEN 'add GitHub x' WHEN 3 THEN '--help' WHEN 4 THEN 'docker' ELSE ' Proj add' END"


@query("x11_subcommands", f"SELECT ref, count(*) AS n, CASE ref WHEN 'git commit -m' THEN 'commit' WHEN 'vault backup create' THEN 'vault_backup_create' WHEN 'add GitHub x' THEN 'add' END AS sub FROM (SELECT {_WORDS} AS ref FROM customer) GROUP BY ref")
def x11_subcommands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr(f"{_WORDS} AS ref").groupBy("ref").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("ref", "n", text.subcommand(F.col("ref")).alias("sub"))


@query("x15_languages", "SELECT lang, CASE lang WHEN 'py' THEN 'python' WHEN 'JS' THEN 'javascript' WHEN ' sh ' THEN 'bash' ELSE 'cobol' END AS name, count(*) AS n FROM (SELECT ['py', 'JS', ' sh ', 'COBOL'][n_nationkey % 4 + 1] AS lang FROM nation) GROUP BY ALL")
def x15_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").selectExpr("array('py', 'JS', ' sh ', 'COBOL')[n_nationkey % 4] AS lang")
    return rows.groupBy("lang", text.language(F.col("lang")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


# Visibility and coverage.
_VIS = f"{_NAME} AS name, {_FILE} AS file, CASE WHEN p_partkey % 10 = 0 THEN 'yes' END AS listed"


@query(
    "f6_f8_public_symbols",
    f"""SELECT name, file, CASE WHEN file LIKE '%.go' THEN regexp_matches(name, '^[A-Z]') WHEN file LIKE '%.ts' THEN name NOT LIKE '\\_%' ESCAPE '\\'
        WHEN name LIKE '\\_h1%' ESCAPE '\\' THEN true WHEN name LIKE 'do2%' OR regexp_matches(name, '^Run.0') THEN false WHEN listed IS NOT NULL THEN name = 'do' || 30 ELSE name NOT LIKE '\\_%' ESCAPE '\\' END AS public
    FROM (SELECT {_VIS} FROM part)""",
)
def f6_f8_public_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(*_split(_VIS))
    module = F.when(F.col("listed").isNotNull(), F.array(F.lit("do30")))
    got = coverage.public(F.col("name"), F.col("file"), F.lit(None).cast("string"), module, ["_h1*"], coverage.preset_excludes(["nothing"], ["do2*", "Run?0*"]))
    return rows.select("name", "file", got.alias("public"))


_SYM = "CASE p_partkey % 4 WHEN 0 THEN 'fn_' || p_partkey WHEN 1 THEN 'Brand' || p_partkey WHEN 2 THEN 'call_' || p_partkey ELSE 'all_' || p_partkey END AS name, CASE WHEN p_partkey % 4 = 1 THEN 'class' ELSE 'function' END AS type"
_COVER_SQL = f"""s AS (SELECT {_SYM} FROM part), doc AS (SELECT DISTINCT unnest(['fn_' || p_size, 'Brand' || p_size]) AS name FROM part),
    code AS (SELECT DISTINCT 'call_' || p_size AS w FROM part), within_ AS (SELECT DISTINCT name FROM s JOIN code ON contains(w, name))"""


def _cover(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = part_docs(spark, sf_dir)
    e = markdown.elements(docs)
    known = table(spark, sf_dir, "part").selectExpr(*_split(_SYM))
    said = coverage.documented_names(e.where("kind = 'code_span'"), docs)
    return known, said.unionByName(coverage.names_in_code(e.where("kind = 'code_block'"), known)).distinct()


@query("j8_j9_undocumented", f"WITH {_COVER_SQL} SELECT name, type FROM s WHERE name NOT IN (SELECT name FROM doc) AND name NOT IN (SELECT name FROM within_)")
def j8_j9_undocumented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.undocumented(*_cover(spark, sf_dir))


@query(
    "a4_coverage",
    f"""WITH {_COVER_SQL}, m AS (SELECT type, name IN (SELECT name FROM doc) OR name IN (SELECT name FROM within_) AS hit FROM s)
    SELECT type, count(*) AS total, count(*) FILTER (hit) AS documented, round_even(count(*) FILTER (hit) * 100.0 / count(*), 1) AS percentage FROM m GROUP BY ROLLUP (type)""",
)
def a4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage(*_cover(spark, sf_dir))


@query(
    "j7_missing_symbols",
    f"""WITH {_MATCH_SQL} SELECT 'missing_symbol' AS type, 'warning' AS severity, doc AS file, 1 AS line, 'Documented symbol not found: ' || reference AS message
    FROM (SELECT {_ASK} FROM supplier) WHERE regexp_extract(replace(reference, '()', ''), '[^.]*$') NOT IN (SELECT name FROM sym)""",
)
def j7_missing_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, known, _ = _asked(spark, sf_dir)
    return coverage.missing_symbols(refs.withColumn("line", F.lit(1)), known)


@query("a5_docstring_coverage", f"SELECT count(*) FILTER (name NOT LIKE '\\_%' ESCAPE '\\') AS total, count(*) FILTER (name NOT LIKE '\\_%' ESCAPE '\\' AND doc IS NOT NULL) AS documented FROM (SELECT {_OLD} FROM part)")
def a5_docstring_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.docstring_coverage(table(spark, sf_dir, "part").selectExpr(*_split(_OLD)))


@query("a20_o5_symbol_stats", f"SELECT type, count(*) AS n FROM (SELECT {_TYPE} AS type FROM part) GROUP BY type")
def a20_o5_symbol_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.symbol_stats(table(spark, sf_dir, "part").selectExpr(f"{_TYPE} AS type"))


_RANGE = "l_orderkey AS file, 'n' || l_linenumber || '_' || l_partkey AS name, CAST(l_quantity AS INTEGER) AS start_, CAST(l_quantity + l_tax * 1000 AS INTEGER) + l_linenumber AS end_"


@query(
    "j21_w5_enclosing",
    f"""WITH r AS (SELECT {_RANGE} FROM lineitem) SELECT a.file, a.name, a.start_ AS "start", a.end_ AS "end", arg_min(b.name, (b.end_ - b.start_, b.start_, b.name)) AS parent
    FROM r a LEFT JOIN r b ON a.file = b.file AND b.start_ <= a.start_ AND b.end_ >= a.end_ AND (b.start_ < a.start_ OR b.end_ > a.end_) GROUP BY ALL""",
)
def j21_w5_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_split(_RANGE)).withColumnsRenamed({"start_": "start", "end_": "end"})
    return coverage.enclosing(rows)


@query("j22_symbols_of_a_file", f"SELECT name, type FROM (SELECT {_OLD} FROM part) WHERE file = 'src/m3.py'")
def j22_symbols_of_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*_split(_OLD)).where("file = 'src/m3.py'").select("name", "type")


# Source files: a Python module and a Go file for each part.
_PY = "'@dataclass' || chr(10) || 'class C' || p_partkey || ':' || chr(10) || '    x: int = ' || p_size || chr(10) || '    y: str | None = None' || chr(10) || '    def m(self): ...' || chr(10) || chr(10) || 'def f' || p_partkey || '(a, b=' || p_size || '):' || chr(10) || '    pass' || chr(10)"
_GO = "'package p' || chr(10) || 'func Run' || p_partkey || '(n int) error {' || chr(10) || '}' || chr(10) || 'type S' || p_partkey || 'Config struct {' || chr(10) || chr(9) || 'Name string `yaml:\"name,omitempty\"`' || chr(10) || '}' || chr(10)"


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    py = part.selectExpr("'m' || p_partkey || '.py' AS path", f"{_PY} AS text")
    return py.unionByName(part.selectExpr("'m' || p_partkey || '.go' AS path", f"{_GO} AS text"))


@query(
    "p8_symbols",
    """SELECT 'm' || p_partkey || '.py' AS file, unnest(['C' || p_partkey, 'm', 'f' || p_partkey]) AS name, unnest(['class', 'method', 'function']) AS type, CAST(unnest([2, 5, 7]) AS INTEGER) AS line,
        unnest([NULL, 'C' || p_partkey, NULL]) AS parent, unnest(['class C' || p_partkey, 'def m(self)', 'def f' || p_partkey || '(a, b=' || p_size || ')']) AS signature FROM part
    UNION ALL SELECT 'm' || p_partkey || '.go', unnest(['Run' || p_partkey, 'S' || p_partkey || 'Config']), unnest(['function', 'struct']), CAST(unnest([2, 4]) AS INTEGER), NULL, unnest(['func Run' || p_partkey || '(n int) error', NULL]) FROM part""",
)
def p8_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.symbols(_code(spark, sf_dir)).select("file", "name", "type", "line", "parent", "signature")


@query(
    "p9_config_fields",
    """SELECT 'C' || p_partkey AS parent_symbol, unnest(['x', 'y']) AS name, unnest(['int', 'str | None']) AS field_type, unnest(['' || p_size, 'None']) AS default_value, unnest([false, true]) AS is_optional FROM part
    UNION ALL SELECT 'S' || p_partkey || 'Config', 'Name', 'string', NULL, true FROM part""",
)
def p9_config_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.config_fields(symbols.symbols(_code(spark, sf_dir))).select("parent_symbol", "name", "field_type", "default_value", "is_optional")


@query(
    "p11_snippet_issues",
    """SELECT 'syntax_error' AS type, CASE WHEN p_partkey % 3 = 0 THEN 'error' ELSE 'warning' END AS severity, 'd' || p_partkey AS file, CAST(p_size AS INTEGER) AS line FROM part WHERE p_partkey % 2 = 0""",
)
def p11_snippet_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "part").selectExpr(
        "'d' || p_partkey AS doc", "p_size AS line", "CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'json' ELSE 'go' END AS language",
        "CASE WHEN p_partkey % 2 = 1 THEN CASE p_partkey % 3 WHEN 0 THEN 'x = ' || p_size WHEN 1 THEN '{\"a\": ' || p_size || '}' ELSE 'func f(n int) { return `(` }' END ELSE 'def (' END AS text",
    )
    return symbols.snippet_issues(blocks, "Python").select("type", "severity", "file", "line")


@query("s18_module_all", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'a' || p_size || ',b' END AS names FROM part")
def s18_module_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 2 = 0 THEN '__all__ = [\"a' || p_size || '\", \"b\"]' ELSE 'x = 1' END AS text")
    return symbols.module_lists(rows, "id").withColumn("names", F.array_join("names", ","))


@query(
    "s15_asset_probe",
    """SELECT type, count(*) AS n FROM (SELECT CASE c_nationkey % 3 WHEN 0 THEN 'external_asset_error' WHEN 1 THEN 'external_asset_unreachable' END AS type FROM customer) WHERE type IS NOT NULL GROUP BY type""",
)
def s15_asset_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "customer").selectExpr("'d' || c_custkey AS doc", "'http://h/' || c_nationkey AS src")
    status = lambda u: {0: 404, 1: None}.get(int(u.rsplit("/", 1)[1]) % 3, 200)
    return git.probe_assets(urls, status).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("s16_doc_health", "SELECT count(*) AS files, 3 AS days, true AS drift FROM (SELECT s_nationkey AS f FROM supplier UNION SELECT c_nationkey FROM customer)")
def s16_doc_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS file"), table(spark, sf_dir, "customer").selectExpr("c_nationkey AS file")]
    return git.doc_health(lists, 3)
