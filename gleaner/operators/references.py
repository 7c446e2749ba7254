"""References from documents to code, and the graph they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import paths, text

# Endings and words of the classifier.
PATH_ENDINGS = "go|py|js|ts|tsx|jsx|java|rs|rb|php|c|cpp|h|hpp|cs|swift|kt|yaml|yml|json|cfg"
ACRONYMS = ("API", "CLI", "HTTP", "HTTPS", "URL", "JSON", "XML")
PROSE = ("the", "and", "for", "with", "from", "this", "that", "your", "you", "a", "an", "in", "on", "at", "to", "of")
NO_KEYS = ("the", "and", "for", "with", "from", "this", "that", "your", "you", "file", "path", "name", "type")
NO_COMMANDS = ("run", "help", "version", "test", "build", "install", "start", "stop", "restart")
BLOCKED_TOOLS = (
    "git docker npm yarn pip brew apt yum dnf curl wget tar zip unzip ssh scp rsync sudo su chmod chown apt-get systemctl service "
    "ps kill top htop df du mount umount make cmake gcc clang javac maven gradle python python3 node ruby php java go bash sh zsh fish powershell cmd"
).split()
SHELLS = ("bash", "sh", "shell", "zsh", "console")
CONTROL_WORDS = ("if", "then", "else", "elif", "fi", "for", "while", "do", "done", "case", "esac", "function", "echo", "cd", "export", "exit", "return", "set")
COMMAND = r"[a-z][a-z0-9-]+(?:\s+[a-z][a-z0-9-]+)*(?:\s+--?[a-z][a-z0-9-]*)*"


def classify(code: Column, indexed: Column | None = None) -> Column:
    """(type, reference) of the text of a code span, or null; the first class that fits decides, even to nothing.

    ``indexed``: kinds of the symbols of that name (array), null if there are none.
    """
    none = F.lit(None).cast("struct<type:string,reference:string>")
    of = lambda kind, ref: F.struct(F.lit(kind).alias("type"), ref.alias("reference"))
    first = F.element_at(F.split(code, r"\s+"), 1)
    key = F.regexp_extract(code, "^([a-z_][a-z0-9_]{2,}):", 1)
    out = (
        F.when(code.rlike(rf"^[a-zA-Z0-9_\-/.]+\.(?:{PATH_ENDINGS})$"), of("file_path", code))
        .when(code.rlike(r"^(?:[A-Z][a-zA-Z0-9]*\.)?[a-z_][a-zA-Z0-9_]*\(\)$"), of("function", code))
        .when(code.rlike("^[A-Z][a-zA-Z0-9]+$"), F.when((F.length(code) > 2) & ~code.isin(*ACRONYMS), of("class", code)).otherwise(none))
        .when(code.rlike(f"^{COMMAND}$"), F.when(~first.isin(*PROSE), of("command", code)).otherwise(none))
    )
    if indexed is not None:
        is_name = (F.length(code) >= 3) & code.rlike("^[a-z_][a-zA-Z0-9_]+$") & indexed.isNotNull()
        callable_ = F.arrays_overlap(indexed, F.array(F.lit("function"), F.lit("method")))
        out = out.when(is_name, F.when(callable_, of("function", F.concat(code, F.lit("()")))).otherwise(none))
    return (
        out.when(code.rlike(r"^[a-z_][a-z0-9_]*(?:\.[a-z_][a-z0-9_]*)+$"), of("config_key", code))
        .when(F.contains(code, F.lit(":")), F.when((key != "") & ~key.isin(*NO_KEYS), of("config_key", key)).otherwise(none))
        .when(code.rlike("^[a-z_][a-z0-9_]{2,}$") & ~code.isin(*NO_KEYS), of("config_key", code))
        .otherwise(none)
    )


def span_references(spans: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """P7 for code spans (doc, line, text): (doc, line, type, reference). ``symbols`` (name, type) is the index, if any."""
    if symbols is None:
        got = spans.withColumn("r", classify(F.col("text")))
    else:
        kinds = symbols.groupBy(F.col("name").alias("text")).agg(F.collect_set("type").alias("kinds"))
        got = spans.join(kinds, "text", "left").withColumn("r", classify(F.col("text"), F.col("kinds")))
    return got.where("r is not null").select("doc", "line", "r.type", "r.reference")


def text_references(docs: DataFrame) -> DataFrame:
    """P7 for raw text (doc, text): functions in headings, commands after a prompt, and "X command" phrases, of which each
    command counts once a document, at its first line."""
    rows = docs.select("doc", F.posexplode(text.lines(F.col("text"))).alias("pos", "text")).withColumn("line", F.col("pos") + 1)
    heads = rows.withColumn("f", F.regexp_extract("text", r"^#+\s+([a-z_][a-zA-Z0-9_]*)\s*\([^)]*\)", 1)).where("f <> ''")
    heads = heads.select("doc", "line", F.lit("function").alias("type"), F.concat("f", F.lit("()")).alias("reference"))
    prompts = rows.select("doc", "line", F.explode(F.regexp_extract_all("text", F.lit(rf"\$\s+({COMMAND})"), F.lit(1))).alias("reference"))
    prompts = prompts.where(~F.element_at(F.split("reference", r"\s+"), 1).isin(*PROSE)).select("doc", "line", F.lit("command").alias("type"), "reference")
    said = r"(?i)(?:\b|`)([a-z][a-z0-9-]+)`?\s+(?:command|subcommand|cmd)\b"
    phrases = rows.select("doc", "line", F.explode(F.regexp_extract_all("text", F.lit(said), F.lit(1))).alias("word")).withColumn("reference", F.lower("word"))
    phrases = phrases.where(~F.col("reference").isin(*NO_COMMANDS)).groupBy("doc", "reference").agg(F.min("line").alias("line"))
    phrases = phrases.select("doc", "line", F.lit("semantic_command").alias("type"), "reference")
    return heads.unionByName(prompts).unionByName(phrases)


def bash_commands(blocks: DataFrame, project: str | None = None) -> DataFrame:
    """P10: (doc, line, type, reference) of the commands in shell blocks (doc, line, language, text): comments, assignments,
    control words and common tools aside; with ``project``, only commands that start with it."""
    shell = blocks.where(F.lower("language").isin(*SHELLS))
    rows = shell.select("doc", F.col("line").alias("at"), F.posexplode(text.lines(F.col("text"))).alias("pos", "raw"))
    rows = rows.withColumn("cmd", F.regexp_replace(F.trim("raw"), r"^\$\s+", "")).withColumn("word", F.element_at(F.split("cmd", r"\s+"), 1))
    ok = (F.col("cmd") != "") & ~F.startswith("cmd", F.lit("#")) & ~F.col("word").rlike("^[A-Za-z_][A-Za-z0-9_]*=") & ~F.col("word").isin(*BLOCKED_TOOLS, *CONTROL_WORDS)
    ok = ok & F.col("word").rlike("^[a-z][a-z0-9-]*$")
    if project:
        ok = ok & (F.col("word") == project.lower())
    return rows.where(ok).select("doc", (F.col("at") + F.col("pos") + 1).alias("line"), F.lit("command").alias("type"), F.col("cmd").alias("reference"))


def _identifier(ref: Column) -> Column:
    return F.element_at(F.split(F.replace(ref, F.lit("()"), F.lit("")), r"\."), -1)


def match_paths(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """File references (doc, reference) with the source (path) of exactly that name, else with those that end in it
    after a slash; both by equi-joins, the second on the file's own name."""
    asked = refs.where("type = 'file_path'").select("doc", "reference").distinct()
    exact = asked.join(sources.select("path", F.col("path").alias("reference")).distinct(), "reference")
    left = asked.join(exact.select("doc", "reference"), ["doc", "reference"], "left_anti").withColumn("name", paths.basename(F.col("reference")))
    named = sources.select("path", paths.basename(F.col("path")).alias("name")).distinct()
    ends = left.join(named, "name").where(F.endswith("path", F.concat(F.lit("/"), "reference")))
    cols = ["doc", "reference", "path"]
    return exact.select(*cols).unionByName(ends.select(*cols)).select("doc", F.lit("file_path").alias("type"), "reference", "path")


def definitions(sources: DataFrame) -> DataFrame:
    """(path, name) of what each source (path, text) defines, by the patterns of its language: one pass over each file,
    whatever is asked for."""
    word = "([A-Za-z_$][A-Za-z0-9_$]*)"
    by = {
        "py": [rf"\bdef\s+{word}\s*\(", rf"\bclass\s+{word}\b"],
        "go": [rf"\bfunc\s+{word}\s*\(", rf"\btype\s+{word}\s+(?:struct|interface)\b"],
        "js": [rf"\bfunction\s+{word}\s*\(", rf"\bclass\s+{word}\b", rf"\bconst\s+{word}\s*=\s*(?:function\b|\([^)]*\)\s*=>)", rf"\b{word}\s*:\s*function\s*\("],
        "java": [rf"\b(?:class|interface)\s+{word}\b"],
        "c": [rf"\b(?:class|struct)\s+{word}\b"],
        "rs": [rf"\bfn\s+{word}\s*\(", rf"\b(?:struct|enum)\s+{word}\b"],
        "rb": [rf"\b(?:def|class)\s+{word}\b"],
        "php": [rf"\bfunction\s+{word}\s*\(", rf"\bclass\s+{word}\b"],
    }
    same = {"jsx": "js", "ts": "js", "tsx": "js", "cpp": "c", "h": "c", "hpp": "c", "cc": "c", "cxx": "c"}
    ending = paths.suffix(F.col("path"))
    ending = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in same.items() for x in kv)), ending), ending)
    all_of = lambda ps: F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in ps))
    found = None
    for k, ps in by.items():
        found = F.when(ending == k, all_of(ps)) if found is None else found.when(ending == k, all_of(ps))
    found = found.otherwise(all_of([rf"\b(?:def|func|function)\s+{word}\s*\(", rf"\bclass\s+{word}\b"]))
    return sources.select("path", F.explode(F.array_distinct(found)).alias("name"))


def match_symbols(refs: DataFrame, symbols: DataFrame, defined: DataFrame | None = None) -> DataFrame:
    """Function and class references with the files (file) of the symbols (name) they name, else with the files whose
    text defines them (``definitions``)."""
    asked = refs.where("type in ('function', 'class')").select("doc", "type", "reference", _identifier(F.col("reference")).alias("name")).distinct()
    hit = asked.join(symbols.select("name", F.col("file").alias("path")).distinct(), "name")
    if defined is not None:
        left = asked.join(symbols.select("name").distinct(), "name", "left_anti")
        hit = hit.unionByName(left.join(defined.select("name", "path").distinct(), "name"))
    return hit.select("doc", "type", "reference", "path")


def match_commands(refs: DataFrame, sources: DataFrame, symbols: DataFrame | None = None, project: str | None = None) -> DataFrame:
    """Commands with the sources in a command's folder or file. The key is cut from each path once; spoken commands also
    look in ``commands/``, and only at files that define a symbol (file) if ``symbols`` is given."""
    name = F.when(F.col("type") == "command", text.subcommand(F.col("reference"), project)).otherwise(F.col("reference"))
    asked = refs.where("type in ('command', 'semantic_command')").select("doc", "type", "reference", name.alias("key")).where("key is not null").distinct()
    both = F.regexp_extract_all("path", F.lit(r"\b(cmd|cli|commands?)/(?=[^/.]+[/.])"), F.lit(1))
    keys = F.regexp_extract_all("path", F.lit(r"\b(?:cmd|cli|commands?)/([^/.]+)[/.]"), F.lit(1))
    cut = sources.select("path", F.explode(F.arrays_zip(both.alias("folder"), keys.alias("key"))).alias("k")).select("path", "k.folder", "k.key").distinct()
    hit = asked.join(cut, "key").where("type = 'semantic_command' or folder in ('cmd', 'cli')")
    if symbols is not None:
        has = symbols.select(F.col("file").alias("path")).distinct()
        spoken = hit.where("type = 'semantic_command'").join(has, "path", "left_semi")
        hit = hit.where("type = 'command'").unionByName(spoken.select(hit.columns))
    return hit.select("doc", "type", "reference", "path").distinct()


def dependencies(*matches: DataFrame) -> DataFrame:
    """U4: distinct edges (doc, path)."""
    out = matches[0].select("doc", "path")
    for m in matches[1:]:
        out = out.unionByName(m.select("doc", "path"))
    return out.distinct()


def unmatched(refs: DataFrame, matched: DataFrame, project: str | None = None) -> DataFrame:
    """Distinct (doc, type, reference) without a match (doc, type, reference, path); file paths always count as matched,
    configuration keys never. With ``project``, other commands are left out."""
    asked = refs.where("type <> 'file_path'").select("doc", "type", "reference").distinct()
    out = asked.join(matched.select("doc", "type", "reference").distinct(), ["doc", "type", "reference"], "left_anti")
    if project:
        first = F.element_at(F.split("reference", r"\s+"), 1)
        out = out.where((F.col("type") != "command") | (F.startswith("reference", F.lit(project)) & ~first.isin(*BLOCKED_TOOLS)))
    return out


def stale_references(rest: DataFrame) -> DataFrame:
    """The issues of unmatched references; their line is always 1."""
    message = F.concat(F.lit("Reference not found in code: "), "reference")
    return rest.select(F.lit("stale_reference").alias("type"), F.lit("warning").alias("severity"), F.col("doc").alias("file"), F.lit(1).alias("line"), message.alias("message"))


def inverted(edges: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values) with the distinct values of each key in order."""
    return edges.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(value + "s"))


def dependency_map(refs: DataFrame, matched: DataFrame, rest: DataFrame, images: DataFrame) -> DataFrame:
    """K3: rows (section, key, values) of all that is known of a project's dependencies: code by document and documents by code,
    documents by reference for each type, unmatched references (``rest``), and documents by asset (``images``: doc, src)."""
    edges = dependencies(matched)
    row = lambda section, key, value: (section.alias("section"), F.col(key).alias("key"), F.col(value).alias("v"))
    parts = (
        edges.select(*row(F.lit("doc_to_code"), "doc", "path")),
        edges.select(*row(F.lit("code_to_doc"), "path", "doc")),
        refs.select(*row(F.concat(F.lit("reference:"), "type"), "reference", "doc")),
        rest.select(*row(F.lit("unmatched"), "reference", "doc")),
        images.select(*row(F.lit("asset"), "src", "doc")),
    )
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.groupBy("section", "key").agg(F.array_sort(F.collect_set("v")).alias("values"))


def reference_density(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """(bucket, documents, references) by the number of references of a document: 0, 1-5, 6-10, 11+."""
    n = docs.select("doc").join(refs.groupBy("doc").agg(F.count(F.lit(1)).alias("n")), "doc", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bucket = F.when(F.col("n") == 0, "0").when(F.col("n") <= 5, "1-5").when(F.col("n") <= 10, "6-10").otherwise("11+")
    return n.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("references"))


def asset_coverage(images: DataFrame) -> DataFrame:
    """One row: images, local and external ones, documents that have any."""
    ext = text.is_external(F.col("src"))
    return images.agg(F.count(F.lit(1)).alias("total"), F.count_if(~ext).alias("local"), F.count_if(ext).alias("external"), F.countDistinct("doc").alias("documents"))
