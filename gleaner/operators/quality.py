"""Quality of documents: the seven criteria, their statistics and the overall score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import paths, text

# Patterns and words of the criteria.
DEPRECATED = (r"\b(deprecated|obsolete|outdated|legacy|old)\b", r"\b(no longer supported|not supported)\b", r"\b(removed in|deprecated in)\b")
MIGRATION = (r"\b(migration|migrating|upgrade|upgrading)\b", r"\b(how to|guide to|documentation for)\b", r"\b(breaking changes?|changelog|release notes)\b")
DOC_TYPES = ("tutorial", "guide", "reference", "api", "concept", "howto", "example", "faq")
SCORES = {"excellent": 4, "good": 3, "fair": 2, "poor": 1}


def _count(text_col: Column, pattern: str) -> Column:
    return F.regexp_count(text_col, F.lit("(?i)" + pattern))


def heading_jumps(headers: DataFrame) -> DataFrame:
    """``headers`` (doc, ord, level, ...) that skip a level, with the level before."""
    before = F.lag("level").over(Window.partitionBy("doc").orderBy("ord"))
    return headers.withColumn("previous", before).where("level > previous + 1")


def list_markers(docs: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """A1: (doc, marker, n) of list items by marker in ``docs`` (doc, text), lines of code ``blocks`` (doc, line, text) aside."""
    rows = docs.select("doc", F.posexplode(text.lines(F.col("text"))).alias("pos", "line"))
    rows = rows.withColumn("marker", F.regexp_extract("line", r"^\s*([-*+])\s+", 1)).where("marker <> ''").withColumn("line", F.col("pos") + 1)
    if blocks is not None:
        # A block covers its fences and the lines between; only the lines of blocks are exploded, not those of documents.
        inside = blocks.select("doc", F.explode(F.sequence("line", F.col("line") + F.regexp_count("text", F.lit("\n")) + 1)).alias("line"))
        rows = rows.join(inside.distinct(), ["doc", "line"], "left_anti")
    return rows.groupBy("doc", "marker").agg(F.count(F.lit(1)).alias("n"))


def marker_majority(markers: DataFrame) -> DataFrame:
    """One row: majority marker (the first of - * + among equals), total, score, files without the majority marker."""
    order = F.instr(F.lit("-*+"), F.col("marker"))
    sums = markers.groupBy("marker").agg(F.sum("n").alias("n"))
    top = sums.agg(F.max_by("marker", F.struct("n", -order)).alias("majority_marker"), F.max("n").alias("most"), F.sum("n").alias("total"))
    files = markers.withColumn("majority_marker", top.select("majority_marker").scalar())
    odd = files.groupBy("doc").agg(F.max((F.col("marker") == F.col("majority_marker")).cast("int")).alias("has")).where("has = 0")
    return top.select(
        "majority_marker", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce(F.bround(F.col("most") / F.col("total"), 2), F.lit(1.0)).alias("consistency_score"),
        odd.agg(F.count(F.lit(1))).scalar().alias("inconsistent_files"),
    )


def heading_styles(headers: DataFrame) -> DataFrame:
    """A2: (doc, title_case, sentence_case, style) of headings (doc, text); title wins a tie; all-caps headings don't count."""
    styled = headers.withColumn("s", text.heading_style(F.col("text"))).where("s is not null")
    n = lambda s: F.count_if(F.col("s") == s).alias(s)
    return styled.groupBy("doc").agg(n("title_case"), n("sentence_case")).withColumn("style", F.when(F.col("title_case") >= F.col("sentence_case"), "title_case").otherwise("sentence_case"))


def bad_h1_counts(docs: DataFrame, headers: DataFrame) -> DataFrame:
    """A3: (doc, h1) of the documents whose number of first-level headings isn't one; none counts too."""
    got = docs.select("doc").join(headers.where("level = 1").select("doc", F.lit(1).alias("one")), "doc", "left")
    return got.groupBy("doc").agg(F.count("one").alias("h1")).where("h1 <> 1")


def avoided_terms(docs: DataFrame, terms: list[tuple[str, list[str]]]) -> DataFrame:
    """(doc, line, term) for each line of ``docs`` (doc, text) that has an avoided word and none of its exceptions. Lines
    are those of the text as it is; lines within fences don't count."""
    fence = F.regexp_extract_all(F.col("text"), F.lit(r"(?ms)^```.*?^```"), F.lit(0))
    # Fenced text is blanked, not cut, so that line numbers stay true.
    blank = F.aggregate(fence, F.col("text"), lambda t, f: F.replace(t, f, F.regexp_replace(f, r"[^\n]", "")))
    rows = docs.select("doc", F.posexplode(text.lines(blank)).alias("pos", "text"))
    quoted = lambda x: "\\Q" + x.replace("\\E", "") + "\\E"
    tests = []
    for word, exceptions in terms:
        hit = F.col("text").rlike(rf"(?i)\b{quoted(word)}\b")
        for e in exceptions:
            hit = hit & ~F.col("text").rlike(rf"(?i)\b{quoted(e)}\b")
        tests.append(F.when(hit, F.lit(word)))
    found = F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array().cast("array<string>")
    return rows.select("doc", (F.col("pos") + 1).alias("line"), F.explode(found).alias("term"))


def term_usage(docs: DataFrame, preferred: list[tuple[str, str, str | None]]) -> DataFrame:
    """(term, full_form_count, abbreviation_count, files) of preferred terms (key, full form, abbreviation) in use."""
    if not preferred:
        return docs.sparkSession.createDataFrame([], "term string, full_form_count long, abbreviation_count long, files long")
    quoted = lambda x: "\\Q" + x.replace("\\E", "") + "\\E"
    each = [
        F.struct(
            F.lit(key).alias("term"),
            F.regexp_count("text", F.lit("(?i)" + quoted(full))).alias("full"),
            (F.regexp_count("text", F.lit(rf"\b{quoted(short)}\b")) if short else F.lit(0)).alias("short"),
        )
        for key, full, short in preferred
    ]
    rows = docs.select(F.explode(F.array(*each)).alias("t")).where("t.full > 0 or t.short > 0")
    return rows.groupBy("t.term").agg(F.sum("t.full").alias("full_form_count"), F.sum("t.short").alias("abbreviation_count"), F.count(F.lit(1)).alias("files"))


def relevance(docs: DataFrame) -> DataFrame:
    """One row: weighted count of marks of outdated text (a tenth in documents about migration) and files that have any."""
    body = text.strip_fences(F.col("text"))
    name = F.lower(paths.basename(F.col("doc")))
    about = F.contains(name, F.lit("migration")) | F.contains(name, F.lit("changelog"))
    for p in MIGRATION:
        about = about | body.rlike("(?i)" + p)
    n = sum((_count(body, p) for p in DEPRECATED), F.lit(0))
    # Tenths are summed as integers: the sum does not depend on the order.
    rows = docs.select((n * F.when(about, 1).otherwise(10)).alias("tenths"), (n > 0).alias("any"))
    return rows.agg((F.coalesce(F.sum("tenths"), F.lit(0)) / 10.0).alias("deprecated_count"), F.count_if("any").alias("files_with_deprecated"))


def accuracy(blocks: DataFrame) -> DataFrame:
    """One row: code blocks, files that have any, languages by number (most first)."""
    lang = F.coalesce(F.nullif(F.lower("language"), F.lit("")), F.lit("plaintext"))
    by = blocks.groupBy(lang.alias("language")).agg(F.count(F.lit(1)).alias("n"))
    named = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "language", "n")))
    named = by.agg(F.array_join(F.transform(named, lambda x: F.concat_ws(":", x["language"], x["n"].cast("string"))), ","))
    return blocks.agg(F.count(F.lit(1)).alias("code_blocks"), F.countDistinct("doc").alias("files_with_code")).withColumn("languages", named.scalar())


def purposefulness(docs: DataFrame) -> DataFrame:
    """One row: files, files with a first-level heading, with a table of contents, and of each type by name or folder."""
    name, folder = F.lower(paths.basename(F.col("doc"))), F.lower(F.regexp_replace("doc", "/?[^/]*$", ""))
    kinds = [F.count_if(F.contains(name, F.lit(k)) | F.contains(folder, F.lit(k))).alias(f"type_{k}") for k in DOC_TYPES]
    return docs.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("text").rlike("(?m)^# .+")).alias("files_with_h1"), F.count_if(F.col("text").rlike("(?i)table of contents|toc")).alias("files_with_toc"), *kinds)


def duplicate_headers(headers: DataFrame) -> DataFrame:
    """A10: (topic, n) of first- and second-level headings that occur more than once."""
    return headers.where("level <= 2").groupBy(F.lower(F.trim("text")).alias("topic")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and topic <> ''")


def consistency(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: code blocks without language, headings with hashes and underlined ones (both counted on raw text)."""
    unlabeled = blocks.agg(F.count_if(F.coalesce("language", F.lit("")) == "")).scalar()
    n = lambda p: F.coalesce(F.sum(F.regexp_count("text", F.lit(p))), F.lit(0))
    return docs.agg(n(r"(?m)^#{1,6} ").alias("atx"), n(r"(?m)^[^\n]+\n(?:=+|-+)[ \t]*$").alias("setext")).withColumn("unlabeled_blocks", unlabeled)


def clarity(docs: DataFrame, links: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: files, words, mean words (rounded down), files with examples, with internal links, and these links."""
    has_code = blocks.select("doc").distinct().withColumn("code", F.lit(True))
    inner = links.where("not startswith(url, 'http://') and not startswith(url, 'https://')").groupBy("doc").agg(F.count(F.lit(1)).alias("inner"))
    rows = docs.join(has_code, "doc", "left").join(inner, "doc", "left")
    words = text.word_count(F.col("text")).cast("long")
    return rows.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(words), F.lit(0)).alias("words"), F.floor(F.sum(words) / F.count(F.lit(1))).alias("mean_words"),
        F.count_if(F.coalesce("code", F.lit(False)) | F.col("text").rlike(r"(?i)\bexamples?\b")).alias("files_with_examples"),
        F.count("inner").alias("files_with_links"), F.coalesce(F.sum("inner"), F.lit(0)).alias("internal_links"),
        F.count_if(F.col("text").rlike("(?i)table of contents|## contents")).alias("files_with_toc"),
    )


def structure(docs: DataFrame, headers: DataFrame) -> DataFrame:
    """One row: folders, deepest heading, files that skip a level, files without exactly one first-level heading."""
    folders = docs.select(F.regexp_replace("doc", "/?[^/]*$", "").alias("f")).where("f <> ''").agg(F.countDistinct("f")).scalar()
    jumps = heading_jumps(headers).agg(F.countDistinct("doc")).scalar()
    bad = bad_h1_counts(docs, headers).agg(F.count(F.lit(1))).scalar()
    return headers.agg(F.coalesce(F.max("level"), F.lit(0)).alias("max_depth")).select("max_depth", folders.alias("folders"), jumps.alias("jump_files"), bad.alias("bad_h1_files"))


def criterion_scores(m: DataFrame) -> DataFrame:
    """The score of each criterion from one row of all measures, as rows (criterion, score)."""
    c = F.col
    good = lambda test: F.when(test, "good").otherwise("fair")
    cov = F.coalesce(c("coverage"), F.lit(100.0))
    rules = {
        "relevance": good(c("deprecated_count") <= 10),
        "accuracy": F.when((c("code_blocks") == 0) | (cov < 50), "fair").when((c("coverage") >= 80) & (c("code_blocks") > 10), "excellent").otherwise("good"),
        "purposefulness": good(c("files_with_h1") >= 0.8 * c("files")),
        "uniqueness": good(c("duplicate_topics") < 5),
        "consistency": good((c("unlabeled_blocks") < 5) & (c("setext") == 0)),
        "clarity": good(c("files_with_examples") >= 0.5 * c("files")),
        "structure": good((c("jump_files") < 3) & (c("max_depth") <= 4) & (c("bad_h1_files") == 0)),
    }
    each = F.array(*(F.struct(F.lit(k).alias("criterion"), v.alias("score")) for k, v in rules.items()))
    return m.select(F.explode(each).alias("r")).select("r.*")


def overall_score(results: DataFrame, coverage: Column | float | None = None) -> DataFrame:
    """One row (average, overall) of ``results`` (criterion, score); an unknown score counts as fair; the coverage in
    percent, if given, as one more criterion."""
    points = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SCORES.items() for x in kv)), F.col("score")), F.lit(2))
    total, n = F.coalesce(F.sum(points), F.lit(0)), F.count(F.lit(1))
    if coverage is not None:
        cov = coverage if isinstance(coverage, Column) else F.lit(coverage)
        total, n = total + F.when(cov >= 75, 4).when(cov >= 50, 3).when(cov >= 30, 2).otherwise(1), n + 1
    avg = F.when(n > 0, total / n).otherwise(F.lit(2.0))
    name = F.when(F.col("average") >= 3.5, "excellent").when(F.col("average") >= 2.5, "good").when(F.col("average") >= 1.5, "fair").otherwise("poor")
    return results.agg(avg.alias("average")).withColumn("overall", name)
