"""Mixing against plain least squares, many domains, targets that can't be met, and a classifier that finds its domains."""

from __future__ import annotations

import random

import numpy as np
import pytest

from gleaner.llm import mixing, queries
from gleaner.llm.language import split_by_crc


def closest(a, targets, most):
    """The sum of squares of gaps, and of distances from rate 1 by its weight, that a plain projected gradient with a safe step comes to."""
    size = a.sum(axis=1)
    share = a / size[:, None]
    top = np.linalg.eigvalsh(a.T @ share).max()
    rho, r = mixing.RIDGE * top, np.ones(len(a))
    worth = lambda r: float(((a.T @ r - targets) ** 2).sum() + rho * (size * (r - 1) ** 2).sum())
    for _ in range(60_000):
        r = np.clip(r - (share @ (a.T @ r - targets) + rho * (r - 1)) / (top + rho), 0, most)
    return worth(r), worth


@pytest.mark.parametrize(("targets", "most", "reached"), [((0.2, 0.5, 0.3), None, True), ((0.9, 0.1, 0.0), None, False), ((0.05, 0.05, 0.9), 2.0, False), ((0.0, 0.0, 1.0), 3.0, False), ((0.5, 0.3, 0.2), 1.5, None)])
def test_rates_against_plain_least_squares(spark, targets, most, reached):
    rng = np.random.default_rng(1)
    a = rng.dirichlet((0.5, 0.3, 0.1), 400) * rng.integers(5, 200, (400, 1))
    want = np.array(targets) * a.sum()
    members = spark.createDataFrame([(x.tolist(),) for x in a], "tokens array<double>").repartition(3)
    rates = mixing.fit_rates(members, want, most_rate=most)
    r = rates(a)
    assert reached in (None, rates.met) and (r >= 0).all() and (most is None or r.max() <= most)
    assert np.allclose(a.T @ r, rates.totals)
    best, worth = closest(a, want, np.inf if most is None else most)
    assert worth(r) <= 1.001 * best + 1e-6 * a.sum() ** 2


def test_labels_that_texts_do_not_tell_leave_the_corpus_whole(spark):
    """A domain of random rows can't be brought down by dropping most of the others."""
    rng = np.random.default_rng(2)
    p = np.array([0.85, 0.05, 0.10]) * np.exp(rng.normal(0, 0.02, (2_000, 3)))
    a = p / p.sum(axis=1, keepdims=True) * rng.integers(20, 90, (2_000, 1))
    members = spark.createDataFrame([(x.tolist(),) for x in a], "tokens array<double>")
    rates = mixing.fit_rates(members, np.array([0.98, 0.0, 0.02]) * a.sum())
    assert not rates.met and (rates(a) < 0.5).mean() < 0.5


def test_a_fit_that_does_not_settle_raises(spark):
    members = spark.createDataFrame([([1.0, 9.0],), ([8.0, 2.0],)], "tokens array<double>")
    with pytest.raises(RuntimeError):
        mixing.fit_rates(members, np.array([15.0, 5.0]), tolerance=0.0, most_steps=0)


def test_more_domains_than_a_few(spark):
    """Every domain of the labels is learned, however rare, and gets its share."""
    rng = random.Random(2)
    names = [f"d{i:02d}" for i in range(40)]
    rows, labels = [], []
    for i in range(1_200):
        d = names[min(int(rng.expovariate(0.1)), 39)] if i >= 80 else names[i % 40]
        rows.append((i, " ".join(rng.choice((f"{d}a", f"{d}b", f"{d}c", "the", "of")) for _ in range(40))))
        labels.append((i, d))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string")
    model = mixing.train(docs, known)
    assert model.names == names
    got = mixing.document_rates(docs, known, {n: 1.0 for n in names}).collect()
    assert sum(r.domain == dict(labels)[r.doc_id] for r in got) > 0.99 * len(rows)
    rate = {r.doc_id: r.rate for r in got}
    sums = sum(np.array(r.tokens) * rate[r.doc_id] for r in mixing.memberships(docs, model).collect())
    assert np.abs(sums / sums.sum() - 1 / 40).max() < 1.1 * mixing.TOLERANCE
    with pytest.raises(ValueError, match="domains"):
        mixing.MOST_DOMAINS, keep = 10, mixing.MOST_DOMAINS
        try:
            mixing.train(docs, known)
        finally:
            mixing.MOST_DOMAINS = keep


def test_domains_of_the_tables_are_found(spark):
    """Recall by domain on the labelled rows of sf0.01, in sample and on a third that was left out."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = mixing.labelled_domains(spark.read.parquet(f"{sf}/labels.parquet"))

    def recall(train, judge):
        model = mixing.train(docs, train)
        rows = docs.join(judge, "doc_id").collect()
        import pyarrow as pa

        post, _ = model(pa.array([r.text for r in rows]))
        hit = [(r.domain, model.names[i] == r.domain) for r, i in zip(rows, post.argmax(axis=1), strict=True)]
        return {d: np.mean([h for x, h in hit if x == d]) for d in model.names}

    every = recall(labels, labels)
    assert every["good"] > 0.98 and every["toxic"] > 0.55 and every["poor"] > 0.5
    parts = split_by_crc(labels, 3, 1)
    held = recall(parts.where("not held_out"), parts.where("held_out").drop("held_out"))
    assert held["good"] > 0.95 and held["toxic"] > 0.35


def test_registered_weights_ask_the_same_of_query_and_pipeline():
    assert abs(sum(queries.DOMAIN_WEIGHTS.values()) - 1) < 1e-9 and queries.DOMAIN_WEIGHTS["poor"] == 0
