"""Symbols: visibility, lookups and coverage by documentation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import paths

# Names that frameworks and test tools define, by preset (F8).
PRESETS: dict[str, tuple[str, ...]] = {
    "pydantic": ("Config", "model_config", "model_validator", "field_validator", "root_validator", "validator", "validate_*"),
    "django": ("Meta", "DoesNotExist", "MultipleObjectsReturned"),
    "fastapi": ("Config", "model_config"),
    "pytest": ("test_*", "Test*", "fixture", "conftest"),
    "sqlalchemy": ("metadata", "__table__", "__tablename__", "__mapper__", "_sa_*", "registry"),
    "jest": ("describe", "it", "test", "beforeEach", "afterEach", "beforeAll", "afterAll", "expect"),
    "vitest": ("describe", "it", "test", "suite", "beforeEach", "afterEach", "beforeAll", "afterAll", "expect", "vi"),
    "react": ("_render*", "UNSAFE_*", "__*", "$$typeof"),
    "vue": ("$_*", "__v*", "_c", "_h", "_s", "_v", "_e", "_m", "_l"),
    "go-test": ("Test*", "Benchmark*", "Example*", "Fuzz*"),
    "rust-test": ("tests", "test_*", "bench_*"),
    "serde": ("Serialize", "Deserialize", "__serde_*"),
}
ACRONYMS = ("API", "CLI", "HTTP", "HTTPS", "URL", "JSON", "XML", "HTML", "CSS")
_CALL = r"(?:[A-Z][a-zA-Z0-9]*\.)?([A-Z][a-zA-Z0-9]*|[a-z_][a-zA-Z0-9_]*)"


def _fits(name: Column, globs: Iterable[str]) -> Column:
    globs = list(dict.fromkeys(globs))
    return name.rlike("^(?:" + "|".join(paths.glob_regex(g) for g in globs) + ")$") if globs else F.lit(False)


def preset_excludes(presets: Iterable[str], custom: Iterable[str] = ()) -> list[str]:
    """F8: the patterns of the presets and one's own, in order and once each; unknown presets have none."""
    return list(dict.fromkeys([g for p in presets for g in PRESETS.get(p, ())] + list(custom)))


def public(
    name: Column, file: Column, parent: Column, module_all: Column, include: Iterable[str] = (), exclude: Iterable[str] = (), strategy: str = "all_then_underscore"
) -> Column:
    """whether a symbol is part of the public interface of its file.

    Go: a capital first. JavaScript and TypeScript: no underscore first. Python: include patterns, then exclude patterns, then
    the strategy over ``module_all`` (array, null where the module declares none): all_then_underscore, all_only or
    underscore_only. All others are public; an empty name is not.
    """
    plain = ~F.startswith(name, F.lit("_"))
    listed = F.array_contains(module_all, name)
    if strategy == "all_only":
        ruled = F.coalesce(listed, F.lit(False))
    elif strategy == "underscore_only":
        ruled = plain
    else:
        ruled = F.when(module_all.isNotNull(), listed).otherwise(plain)
    python = F.when(_fits(name, include), True).when(_fits(name, exclude), False).otherwise(ruled)
    return (
        F.when(F.coalesce(name, F.lit("")) == "", False)
        .when(F.endswith(file, F.lit(".go")), name.rlike(r"^\p{Lu}"))
        .when(F.endswith(file, F.lit(".py")), python)
        .when(file.rlike(r"\.(?:js|ts|jsx|tsx)$"), plain)
        .otherwise(True)
    )


def documented_names(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """The names (name) that documents mention: calls and class names in code spans (text), functions in headings (docs.text)."""
    call = F.regexp_extract("text", rf"^{_CALL}\(\)$", 1)
    cls = F.when(F.col("text").rlike("^[A-Z][a-zA-Z0-9]+$") & (F.length("text") > 2) & ~F.col("text").isin(*ACRONYMS), F.col("text"))
    one = spans.select(F.coalesce(F.nullif(call, F.lit("")), cls).alias("name")).where("name is not null")
    two = docs.select(F.explode(F.regexp_extract_all("text", F.lit(rf"(?m)^#+\s+{_CALL}\s*\([^)]*\)"), F.lit(1))).alias("name"))
    return one.unionByName(two).distinct()


def names_in_code(blocks: DataFrame, symbols: DataFrame) -> DataFrame:
    """The names (name) of ``symbols`` that stand anywhere in the text of a code block.

    A name is within a block just if it is a part of one of its identifiers. So the distinct identifiers are cut into all their
    parts of the lengths that names have, and these are joined by equality: no block is held against every name.
    """
    names = symbols.select("name").where("name <> ''").distinct()
    lengths = names.agg(F.collect_set(F.length("name"))).scalar()
    words = blocks.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_$]+"), F.lit(0)))).alias("w")).distinct()
    sized = words.select("w", F.explode(lengths).alias("n")).where("n <= length(w)")
    parts = sized.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - F.col("n") + 1), lambda i: F.substring(F.col("w"), i, F.col("n")))).alias("name"))
    return names.join(parts.distinct(), "name", "left_semi")


def undocumented(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """The symbols whose name isn't among ``names`` (name)."""
    return symbols.join(names.select("name").distinct(), "name", "left_anti")


def coverage(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """A4: (type, total, documented, percentage) by type, and for all symbols together (type null)."""
    marked = symbols.join(names.select("name", F.lit(1).alias("hit")).distinct(), "name", "left")
    n, d = F.count(F.lit(1)), F.count("hit")
    share = F.bround(F.col("documented") * 100.0 / F.col("total"), 1)
    return marked.rollup("type").agg(n.alias("total"), d.alias("documented")).withColumn("percentage", share)


def docstring_coverage(symbols: DataFrame) -> DataFrame:
    """A5: one row: public symbols (names without a leading underscore, or with two on either side) and those with a docstring."""
    open_ = ~F.startswith("name", F.lit("_")) | F.col("name").rlike("^__.*__$")
    return symbols.agg(F.count_if(open_).alias("total"), F.count_if(open_ & (F.trim(F.coalesce("doc", F.lit(""))) != "")).alias("documented"))


def missing_symbols(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Issues of function and class references (doc, line, type, reference) to names that no symbol has."""
    name = F.element_at(F.split(F.replace("reference", F.lit("()"), F.lit("")), r"\."), -1)
    asked = refs.where("type in ('function', 'class')").withColumn("name", name)
    gone = asked.join(symbols.select("name").distinct(), "name", "left_anti")
    message = F.concat(F.lit("Documented symbol not found: "), "reference")
    return gone.select(F.lit("missing_symbol").alias("type"), F.lit("warning").alias("severity"), F.col("doc").alias("file"), "line", message.alias("message"))


def symbol_stats(symbols: DataFrame) -> DataFrame:
    """(type, n) by number, the most first; names settle ties."""
    return symbols.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def enclosing(ranges: DataFrame) -> DataFrame:
    """``ranges`` (file, name, start, end) with parent, the name of the smallest range of the same file that strictly
    contains it, or null. The join is within a file; one row a range."""
    o = ranges.select("file", F.col("name").alias("outer"), F.col("start").alias("s"), F.col("end").alias("e"))
    both = ranges.join(o, "file").where("s <= start and e >= end and (s < start or e > end)")
    near = both.groupBy("file", "name", "start", "end").agg(F.min_by("outer", F.struct(F.col("e") - F.col("s"), "s", "outer")).alias("parent"))
    return ranges.join(near, ["file", "name", "start", "end"], "left")
