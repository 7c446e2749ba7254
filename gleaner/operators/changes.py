"""Change detection between two checksum snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_changes(cur: DataFrame, base: DataFrame) -> DataFrame:
    """(path, change_type) of the paths that were added, modified or deleted since ``base``; both are (path, sha256)."""
    c, b = cur.select("path", F.col("sha256").alias("_now")), base.select("path", F.col("sha256").alias("_was"))
    both = c.withColumn("_c", F.lit(True)).join(b.withColumn("_b", F.lit(True)), "path", "full_outer")
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_c").isNull(), "deleted").otherwise("modified")
    return both.where(~F.col("_now").eqNullSafe(F.col("_was"))).select("path", kind.alias("change_type"))


def changed_since(cur: DataFrame, base: DataFrame) -> DataFrame:
    """The rows of ``cur`` (path, sha256) that ``base`` doesn't have with the same checksum."""
    return cur.join(base.select("path", "sha256").distinct(), ["path", "sha256"], "left_anti")


def change_share(changes: DataFrame, file_count: int) -> DataFrame:
    """One row: number of changes, and their percentage of ``file_count`` to one place (null if that is 0)."""
    n = F.count(F.lit(1))
    return changes.agg(n.alias("changes"), F.when(F.lit(file_count) > 0, F.bround(n * 100.0 / file_count, 1)).alias("change_percentage"))


def affected_docs(changed: DataFrame, code_to_doc: DataFrame, mappings: dict[str, str], docs: DataFrame) -> DataFrame:
    """The documents that ``changed`` (file, category, ord) touches.

    A file's documents are those that refer to it in ``code_to_doc`` (file, doc), at high priority; without any, the document
    that ``mappings`` gives for its category, at high priority for cli, api and config, else medium. Changes of
    documentation touch nothing. A document comes once, with the reason of its first file, its highest priority, its files in
    order, and whether it is among ``docs`` (path).
    """
    asked = changed.where("category <> 'documentation'")
    direct = asked.join(code_to_doc.select("file", "doc").distinct(), "file").select(
        "doc", "file", "ord", F.concat(F.lit("Code change: "), "file").alias("reason"), F.lit(1).alias("rank")
    )
    rest = asked.join(code_to_doc.select("file").distinct(), "file", "left_anti")
    table = F.create_map(*(F.lit(x) for kv in mappings.items() for x in kv)) if mappings else F.create_map().cast("map<string,string>")
    mapped = rest.withColumn("doc", F.try_element_at(table, F.col("category"))).where("doc is not null")
    mapped = mapped.select(
        "doc", "file", "ord", F.concat(F.initcap("category"), F.lit(" changes: "), "file").alias("reason"),
        F.when(F.col("category").isin("cli", "api", "config"), 1).otherwise(2).alias("rank"),
    )
    both = direct.unionByName(mapped)
    out = both.groupBy("doc").agg(
        F.min_by("reason", F.struct("ord", "file")).alias("reason"),
        F.min("rank").alias("rank"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "file"))), lambda x: x["file"])).alias("affected_by"),
    )
    there = docs.select(F.col("path").alias("doc")).distinct().withColumn("_there", F.lit(True))
    return out.join(there, "doc", "left").select("doc", F.coalesce("_there", F.lit(False)).alias("exists"), "reason", F.when(F.col("rank") == 1, "high").otherwise("medium").alias("priority"), "affected_by")


def staleness(rows: DataFrame, now: str) -> DataFrame:
    """``rows`` (..., ts string) with days_old and level at the time ``now`` (ISO, UTC): under 7 days fresh, under 30
    stale, under 90 very_stale, else critical; a missing or malformed time is critical and -1 days old. Days are whole ones, to the
    microsecond."""
    at = F.try_to_timestamp(F.col("ts"))
    age, day = F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(at), 86_400_000_000
    days = ((age - F.pmod(age, F.lit(day))) / day).cast("long")
    old = F.coalesce(days, F.lit(-1))
    level = F.when(old < 0, "critical").when(old < 7, "fresh").when(old < 30, "stale").when(old < 90, "very_stale").otherwise("critical")
    level = F.when(days < 0, "fresh").otherwise(level)
    return rows.withColumn("days_old", old.cast("int")).withColumn("level", level)
