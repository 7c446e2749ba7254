"""Near-dedup where ids repeat, hubs are large and pairs lie at the threshold."""

from __future__ import annotations

import random

import numpy as np
from test_operators import groups, prose

from gleaner.llm import near_dedup, shingles
from gleaner.llm.common import Scratch
from gleaner.llm.components import connected_components


def test_one_id_with_several_texts(spark):
    rng = random.Random(1)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(5, a), (5, b), (7, a + " more"), (8, b + " more"), (9, prose(rng, 40))]
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True)]
    names = [(f"n{i}", t) for i, t in rows]
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(names, "doc_id string, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {"n5": "n5", "n7": "n5", "n8": "n5", "n9": "n9"}


def test_a_repeated_id_does_not_keep_a_copy(spark):
    rng = random.Random(2)
    a, b = prose(rng, 60), prose(rng, 60)
    docs = spark.createDataFrame([(5, a, 1), (7, a, 2), (7, b, 3)], "doc_id long, text string, h int")
    assert sorted((r.doc_id, r.h) for r in near_dedup.drop_near_duplicates(spark, docs).collect()) == [(5, 1), (7, 3)]


def test_pairs_at_and_just_below_the_threshold(spark):
    """Sets of 5 single-word shingles apart: 80 of 100 in common is linked, 79 of 100 is not."""
    rows, want = [], []
    for i in range(40):
        share = 80 if i % 2 else 79
        words = [f"p{i}w{j}" for j in range(100)]
        rows += [(2 * i, " ".join(words[: share + (100 - share) // 2])), (2 * i + 1, " ".join(words[:share] + words[share + (100 - share) // 2 :]))]
    want = groups(rows, 1)
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert sum(r.component_id != r.doc_id for r in got) == 20


def test_bitmaps_never_bound_below_the_truth():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 9000, dtype=np.int64).astype(np.uint64)
    for _ in range(200):
        n, m = rng.integers(1, 3000, 2)
        a, b = rng.choice(pool, n, replace=False), rng.choice(pool[: rng.integers(m, 9001)], m, replace=False)
        words, width = shingles.bitmaps(np.concatenate((a, b)), np.array([n, m]))
        most = shingles.most_in_common(np.int64(n), words[: width[0]], np.int64(m), words[width[0] :])
        assert len(np.intersect1d(a, b)) <= most <= min(n, m)


def test_components_of_a_large_star_and_a_path(spark):
    star = spark.range(1, 100_001).selectExpr("0L AS a", "id AS b")
    path = spark.range(200_000, 200_060).selectExpr("id AS a", "id + 1 AS b")
    got = connected_components(star.unionByName(path), Scratch(spark, "test"))
    assert {(r.comp, r["count"]) for r in got.groupBy("comp").count().collect()} == {(0, 100_001), (200_000, 61)}


def test_a_hub_is_split_over_tasks(spark):
    """The join of a hub's links with its minimum is split, as the minimum is written first."""
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        scratch = Scratch(spark, "test")
        links = scratch.keep(spark.range(0, 100_000, 1, 8).selectExpr("if(id % 50 = 0, id, 0L) AS u", "id * 7919 % 1000003 AS v"), "links")
        from pyspark.sql import functions as F

        least = scratch.keep(links.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = links.join(least, "u")
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
