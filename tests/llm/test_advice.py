"""What the review of round 1 found missing."""

from __future__ import annotations

import logging
import random

import numpy as np

import corpus_pipeline as pipeline
from gleaner.llm import mixing, pii, queries


def corpus(seed, parts):
    """(doc_id, text) of ``parts`` (domain, rows), each domain of its own words and some that all share, and the domains by id."""
    rng = random.Random(seed)
    rows, domain = [], {}
    for name, n in parts:
        for _ in range(n):
            words = [rng.choice(("the", "of", "and", "to", *(f"{name}{i}" for i in range(20)))) for _ in range(rng.randint(30, 60))]
            domain[len(rows)] = name
            rows.append((len(rows), " ".join(words)))
    return rows, domain


def mean_rate(rows, domain, name):
    found = [r.rate for r in rows if domain[r.doc_id] == name]
    return sum(found) / len(found)


def test_registered_weights_lower_toxic_and_poor_text(spark, tmp_path):
    rows, domain = corpus(1, [("good", 420), ("poor", 50), ("toxic", 30)])
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(d != "poor"), int(d == "toxic")) for i, d in domain.items() if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op2_mixing(spark, str(tmp_path)).collect()
    assert mean_rate(got, domain, "toxic") < 0.8 and mean_rate(got, domain, "poor") < 0.8 and mean_rate(got, domain, "good") > 1.0
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows if domain[r[0]] != "poor"], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = [r.doc_id for r in pipeline.mixing_stage(spark, docs, str(tmp_path)).collect()]
    assert sum(domain[i] == "toxic" for i in mixed) / len(mixed) < 0.05


def reached(docs, model, rows):
    """Shares of expected words by domain at the rates of ``rows``."""
    rate = {r.doc_id: r.rate for r in rows}
    sums = sum(np.array(r.tokens) * rate[r.doc_id] for r in mixing.memberships(docs, model).collect())
    return dict(zip(model.names, sums / sums.sum(), strict=True))


def test_scarce_domains_reach_their_targets(spark, caplog):
    rows, domain = corpus(2, [("a", 380), ("b", 20)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, d) for i, d in domain.items()], "doc_id long, domain string")
    weights = {"a": 0.6, "b": 0.4}
    got = mixing.document_rates(docs, labels, weights).collect()
    assert max(r.rate for r in got) > mixing.MOST_RATE
    assert abs(reached(docs, mixing.train(docs, labels), got)["b"] - 0.4) < 0.005
    caplog.clear()
    with caplog.at_level(logging.WARNING):
        capped = mixing.document_rates(docs, labels, weights, most_rate=3.0).collect()
    assert max(r.rate for r in capped) == 3.0 and mean_rate(capped, domain, "b") > 2.0
    assert "asked and reached" in caplog.text and "b 0.4000" in caplog.text


def test_account_numbers_end_before_upper_case_words_and_digits(spark):
    de, gb = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    plain = de.replace(" ", "")
    texts = {
        f"IBAN {plain} BIC COBADEFFXXX": [plain],
        f"{de} EUR": [de],
        f"{plain} 2024": [plain],
        f"{plain} At the bank": [plain],
        f"{de} {gb} OK": [de, gb],
        f"AT12 {de} 7": [de],
        f"pay to {plain}, {gb}.": [plain, gb],
        plain[:-1] + "1 EUR": [],
        plain + "x": [],
        "AB12 " * 400 + de: [de],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.text: [r.text[x.start : x.end] for x in r.added_spans if x.kind == "iban"] for r in pii.pii_spans(docs).collect()}
    assert found == texts
    assert {r.text for r in pii.redact(docs).collect()} >= {"IBAN [IBAN] BIC COBADEFFXXX", "[IBAN] EUR", "[IBAN] 2024"}
