"""The pipeline on a small corpus, stage by stage against brute force, and the registered queries' contracts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import base_rules, base_spans, groups, sets
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from gleaner.llm import queries


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder of tables: prose of two languages, junk, exact and near copies, personal data, nulls and empties."""
    rng = random.Random(1)
    say = {"en": "the of and house window bread water is to in that with for".split(), "de": "der die und haus fenster brot wasser ist zu mit nicht ein".split()}
    text = lambda lang, n: ". ".join(" ".join(rng.choice(say[lang]) + ("" if rng.random() < 0.7 else str(rng.randint(0, 60))) for _ in range(rng.randint(5, 9))) for _ in range(n)) + "."
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        rows.append((text(lang, rng.randint(3, 12)), lang))
    for i in range(10):
        base = rows[i][0].split()
        for _ in range(4):
            own = list(base)
            own[rng.randrange(len(own))] = f"edit{rng.randint(0, 99)}"
            rows.append((" ".join(own), rows[i][1]))
    rows += [rows[5]] * 8 + [(" ".join(f"x{rng.randint(0, 20)}###" for _ in range(40)), "en") for _ in range(25)]
    rows += [(f"Write to someone{i}@mail.example.org or +1 (555) 010-99{i:02d}. " + text("en", 4), "en") for i in range(10)] + [(None, "en"), ("", None), ("   ", "de")]
    docs = [(i, t, lang, f"src{i % 4}", len(t or "")) for i, (t, lang) in enumerate(rows)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0 if "###" in (t or "") else 1, int(i % 17 == 0)) for i, t, *_ in docs if i % 2 == 0 and t]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(i, f"http://h{i % 3}.example.com/p/{i % 4}/", f"<article><h1>T</h1><p>{d[1] or ''}</p></article>") for i, d in enumerate(docs[:60])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder), {d[0]: d for d in docs}


def test_stages(spark, sf):
    folder, docs = sf
    given = spark.read.parquet(f"{folder}/documents.parquet")
    columns = given.columns
    at, seen = given, []
    for name, stage in pipeline.STAGES:
        out = stage(spark, at, folder)
        if name != pipeline.STAGES[-1][0]:
            assert sorted(out.columns) == sorted(columns)
            out.write.mode("overwrite").parquet(f"{folder}/stage-{name}")
            out = spark.read.parquet(f"{folder}/stage-{name}")
        seen.append([r.asDict() for r in out.collect()])
        at = out
    quality, near, clean, mixed, encoded = seen
    kept = {r["doc_id"] for r in quality}
    assert not any(base_rules(docs[i][1])[5] or "###" in docs[i][1] for i in kept)
    assert len(kept) > 0.9 * sum(not base_rules(d[1])[5] and "###" not in (d[1] or "") for d in docs.values())
    want = groups([(i, docs[i][1]) for i in sorted(kept)], 5)
    assert sorted(r["doc_id"] for r in near) == sorted({c for _, c in want.values()})
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in near}
    for r in clean:
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"]) and (r["text"] == docs[r["doc_id"]][1] or "[EMAIL]" in r["text"] or "[PHONE]" in r["text"])
    by_id = {r["doc_id"]: r["text"] for r in clean}
    assert {r["doc_id"] for r in mixed} <= by_id.keys() and all(r["text"] == by_id[r["doc_id"]] for r in mixed)
    assert len({r["doc_id"] for r in mixed}) > 0.8 * len(by_id)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(encoded) == len(mixed)
    for r in encoded:
        assert r["token_ids"] == tok.encode(by_id[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["token_ids"])
        assert r["decoded_sha256"] == hashlib.sha256(by_id[r["doc_id"]].encode()).hexdigest()
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in encoded) == sorted((r.doc_id, r.ids_sha256) for r in pipeline.run(spark, folder).collect())


def test_stages_on_empty_documents(spark, sf, tmp_path):
    folder, _ = sf
    at = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        at = stage(spark, at, folder)
        assert at.count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_returns_every_row(spark, sf, name):
    folder, docs = sf
    got = queries.QUERIES[name](spark, folder)
    rows = got.collect()
    per_page = name in ("op5_revisits", "op9_html_text")
    assert len(rows) == (60 if per_page else len(docs))
    if not per_page:
        assert {r.doc_id for r in rows} == docs.keys()
    if "held_out" in got.columns:
        parts, held = (4, 2) if name.startswith("op3") else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) for r in rows)
        assert all(0 <= r.score <= 1 for r in rows)
    if name.startswith("op10"):
        right = [r.lang_pred == docs[r.doc_id][2] for r in rows if re.search("[a-z]", docs[r.doc_id][1] or "") and "###" not in docs[r.doc_id][1]]
        assert sum(right) > 0.97 * len(right) and {r.lang_pred for r in rows if not (docs[r.doc_id][1] or "").strip()} == {"und"}
    if name.startswith("op6"):
        assert all(r.n_shingles == len(sets(docs[r.doc_id][1], 4)) for r in rows)


def test_held_out_labels_do_not_matter(spark, sf, tmp_path):
    """Scores are the same whatever the held-out labels say."""
    folder, _ = sf
    changed = spark.read.parquet(f"{folder}/labels.parquet").withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    changed.write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    one, two = ({r.doc_id: r.score for r in queries.QUERIES["op3_quality_model"](spark, f).collect()} for f in (folder, str(tmp_path)))
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-9 for i in one)
