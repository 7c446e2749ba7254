"""Every registered query and the pipeline over nulls in any column, repeated ids, extra columns with clashing names, and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from gleaner.llm import queries

ROWS = [(None, None, None, None, None), (1, "", None, "s", 0), (1, "x " * 30, "en", "s", 60), (None, "a b c d e f g h i j k", "en", None, None), (2, "a b c d e f g h i j k", "en", "s", 1)]
CLASHES = "id bucket hit target model quality rate copies copy domain n z bands bits key comp spans base_spans score held_out n_tokens token_ids _1 c0 row h lang_pred".split()


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("mine") for c in CLASHES})
    labels = spark.createDataFrame([(None, None, None), (1, None, 1), (2, 1, None), (2, 1, 0)], "doc_id long, quality int, toxic int").withColumn("domain", F.lit(7))
    pages = spark.createDataFrame([(1, None, None), (None, "http://a/b", "<p>x")], "page_id long, url string, html string").withColumns({"text": F.lit(1), "kind": F.lit("k"), "ts": F.lit("t")})
    out = {}
    for name, keep in (("odd", "true"), ("none", "false")):
        out[name] = str(tmp_path_factory.mktemp(name))
        for table, df in (("documents", docs), ("labels", labels), ("pages", pages)):
            df.where(keep).write.parquet(f"{out[name]}/{table}.parquet")
    return out


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, folders, name):
    rows = 2 if name in ("op5_revisits", "op9_html_text") else len(ROWS)
    assert len(queries.QUERIES[name](spark, folders["odd"]).collect()) == rows
    assert queries.QUERIES[name](spark, folders["none"]).collect() == []


def test_pipeline(spark, folders):
    got = pipeline.run(spark, folders["odd"]).collect()
    # Of the two equal texts that the rules keep the one with an id stands for both.
    assert [r.doc_id for r in got] == [2]
    assert pipeline.run(spark, folders["none"]).collect() == []
