"""Links and assets: the key table, the resolution cascade and the issues they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import paths, text


def normal_path(path: Column) -> Column:
    """A relative path with its ``.`` and ``..`` worked off; null if it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    empty = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))

    def step(a: Column, x: Column) -> Column:
        n = F.size(a["p"])
        up = F.struct(F.slice(a["p"], F.lit(1), F.greatest(n - 1, F.lit(0))).alias("p"), (a["ok"] & (n > 0)).alias("ok"))
        return F.when(x == "..", up).otherwise(F.struct(F.concat(a["p"], F.array(x)).alias("p"), a["ok"].alias("ok")))

    return F.aggregate(parts, empty, step, lambda a: F.when(a["ok"], F.array_join(a["p"], "/")))


def link_keys(docs: DataFrame) -> DataFrame:
    """(key, target) for the documents (path): name, stem, path and path without ending. Of documents with the same key the
    last by path counts."""
    name, path = paths.basename(F.col("path")), F.col("path")
    cut = lambda x: F.regexp_replace(x, r"(?<=[^/])\.[^./]*$", "")
    keys = docs.select(F.explode(F.array(name, cut(name), path, cut(path))).alias("key"), path.alias("target"))
    return keys.groupBy("key").agg(F.max("target").alias("target"))


def candidates(url: Column, folder: Column) -> Column:
    """The keys that a link may mean, in the order in which they are tried; nulls are no keys."""
    u = paths.slashed(text.link_path(url))
    root, dots = F.startswith(u, F.lit("/")), u.rlike(r"^\.\.?/")
    plain = ~root & ~dots
    rel = F.when(~root, normal_path(F.concat_ws("/", folder, u)))
    bare = F.regexp_replace(u, "^/+", "")
    cut = lambda x: F.when(F.contains(x, F.lit(".")), F.regexp_replace(x, r"\.[^.]*$", ""))
    md = lambda x: F.when(~F.endswith(x, F.lit(".md")), F.concat(x, F.lit(".md")))
    return F.array(u, rel, md(rel), cut(rel), F.when(root, bare), F.when(root, cut(bare)), F.when(plain | root, md(u)))


def resolve_links(links: DataFrame, keys: DataFrame) -> DataFrame:
    """``links`` (doc, ord, url, line) that are to be checked, with target, the document of the first candidate key that
    exists, or null. Targets are looked up by an equi-join of exploded candidates; a link comes once."""
    folder = F.regexp_replace(F.regexp_replace(F.col("doc"), "[^/]*$", ""), "/$", "")
    asked = links.where(text.is_checked_link(F.col("url")) & (text.link_path(F.col("url")) != ""))
    tried = asked.select("doc", "ord", "url", "line", F.posexplode(candidates(F.col("url"), folder)).alias("pos", "key"))
    hit = tried.where("key is not null").join(keys, "key").groupBy("doc", "ord").agg(F.min_by("target", "pos").alias("target"))
    return asked.join(hit, ["doc", "ord"], "left").select("doc", "ord", "url", "line", "target")


def broken_links(resolved: DataFrame) -> DataFrame:
    """The issues of links without target."""
    message = F.concat(F.lit("Broken link: "), "url", F.lit(" (target not found)"))
    return resolved.where("target is null").select(F.lit("broken_link").alias("type"), F.lit("error").alias("severity"), F.col("doc").alias("file"), "line", message.alias("message"))


def asset_issues(images: DataFrame, files: DataFrame) -> DataFrame:
    """Issues of ``images`` (doc, ord, src, alt, line): an empty alternative text, and a local file that isn't among
    ``files`` (path). A path is relative to its document, or to the root if it starts with a slash."""
    folder = F.regexp_replace(F.col("doc"), "[^/]*$", "")
    bare = text.asset_path(F.col("src"))
    full = F.when(F.startswith(bare, F.lit("/")), normal_path(bare)).otherwise(normal_path(F.concat(folder, bare)))
    alt = images.where(F.trim(F.coalesce("alt", F.lit(""))) == "").select(
        F.lit("missing_alt_text").alias("type"), F.lit("warning").alias("severity"), F.col("doc").alias("file"), "line", F.concat(F.lit("Image missing alt text: "), "src").alias("message")
    )
    local = images.where(~text.is_external(F.col("src")) & ~F.startswith("src", F.lit("data:")) & (bare != "")).withColumn("path", full)
    gone = local.join(files.select("path").distinct(), "path", "left_anti")
    gone = gone.select(
        F.when(F.col("path").isNull(), "invalid_asset_path").otherwise("missing_asset").alias("type"), F.lit("error").alias("severity"), F.col("doc").alias("file"), "line",
        F.concat(F.lit("Asset not found: "), "src").alias("message"),
    )
    return alt.unionByName(gone)


def severity_totals(issues: DataFrame) -> DataFrame:
    """All issues, errors and warnings; others count in the total only."""
    return issues.agg(
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )


def numbered_slugs(headers: DataFrame) -> DataFrame:
    """``headers`` (doc, ord, text) with slug, numbered from the second occurrence in its document on."""
    slug = text.slugify(F.col("text"))
    n = F.row_number().over(Window.partitionBy("doc", "base").orderBy("ord")) - 1
    return headers.withColumn("base", slug).withColumn("slug", F.when(n == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), n))).drop("base")
