"""Connected components of a table of links, by rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 64) -> DataFrame:
    """(id, comp): the smallest id that each linked id reaches, over undirected ``links`` (a, b).

    Alternates large-star and small-star steps, which keep connectivity and shrink every component to a star around its
    smallest id in a number of rounds that grows with the logarithm of its size. Each round is written to the shared
    folder; no component ever meets in one task, as neighbours are only reduced to their minimum. The minima are written
    before they are joined to the links again: both sides of that join are then dealt out for it, so that Spark splits the
    many links of a component's hub over tasks. Links of an id to itself and repeated links are harmless; without links
    the result is empty.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = scratch.keep(edges, f"{name}-0")
    for i in range(1, most_rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least-{i}")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, f"{name}-large-{i}")
        low = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low-{i}")
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        after = scratch.keep(small, f"{name}-{i}")
        # Settled once all are stars: nobody has two hubs, and no hub has one.
        ends = after.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("n")), F.struct(F.col("v").alias("id"), F.lit(0).alias("n")))).alias("e"))
        roles = ends.groupBy("e.id").agg(F.sum("e.n").alias("hubs"), F.min("e.n").alias("least"))
        settled = roles.where("hubs > 1 or hubs = 1 and least = 0").isEmpty()
        for old in (f"{name}-{i - 1}", f"{name}-least-{i}", f"{name}-large-{i}", f"{name}-low-{i}"):
            scratch.drop(old)
        edges = after
        if settled:
            break
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    )
