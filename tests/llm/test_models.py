"""The quality classifier and language identification against plain versions of their methods."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import WORDS, prose

from gleaner.llm import language, queries
from gleaner.llm import quality_model as Q


def pooled(x, y):
    """Isotonic levels at the distinct ``x`` by the minimax formula."""
    at = np.unique(x)
    mean, n = np.array([y[x == v].mean() for v in at]), np.array([(x == v).sum() for v in at])
    run = lambda j, k: (mean[j : k + 1] * n[j : k + 1]).sum() / n[j : k + 1].sum()
    return at, np.array([max(min(run(j, k) for k in range(i, len(at))) for j in range(i + 1)) for i in range(len(at))])


@pytest.mark.parametrize("n", [4, 9, 120])
def test_quality_scores_against_plain_normal_equations(spark, n):
    rng = random.Random(n)
    rows = [(i, prose(rng, rng.randint(1, 60)) + (" ### $$$ x" * rng.randint(1, 9) if i % 3 == 0 else ".")) for i in range(n)]
    docs = spark.createDataFrame([*rows, (9_000, ""), (9_001, None)], "doc_id long, text string")
    labels = [(i, 0 if i % 3 == 0 and i % 9 else 1) for i, _ in rows]
    model = Q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    fold = {r.doc_id: r.f for r in spark.createDataFrame(labels, "doc_id long, q int").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(Q.FOLDS)).alias("f")).collect()}
    x = np.array([Q.statistics(t) for _, t in rows])
    y, f = np.array([q for _, q in labels], dtype=float), np.array([fold[i] for i, _ in rows])
    scale = x.std(axis=0)
    fourier = Q.Fourier(x.mean(axis=0), np.where(scale > 1e-9, scale, 1.0))
    z = fourier(x)

    def fit(use):
        a = z[use].T @ z[use]
        return np.linalg.solve(a + Q.RIDGE * max(a[0, 0], 1.0) * np.eye(len(a)), z[use].T @ y[use])

    apart = np.array([z[i] @ fit(f != f[i]) for i in range(n)])
    knots, levels = pooled(apart.round(10), y)
    texts = [t for _, t in rows] + ["", ""]
    want = np.clip(np.interp(fourier(np.array([Q.statistics(t) for t in texts])) @ fit(np.ones(n, bool)), knots, levels), 0, 1)
    got = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    assert np.allclose([got[i] for i in [*range(n), 9_000, 9_001]], want, atol=1e-5)


def plain_proportions(model, text):
    """EM over the words of one text, word by word, for every set of the likeliest languages; the best by penalised likelihood."""
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    like = []
    for w in words:
        bucket, _, _ = language.grams([w])
        ll = [sum(float(model.log_p[b, k]) for b in bucket) for k in range(len(model.names))]
        like.append(([math.exp(v - max(ll)) for v in ll], max(ll)))

    def em(allowed):
        pi = {k: 1 / len(allowed) for k in allowed}
        for _ in range(language.ROUNDS):
            new = dict.fromkeys(allowed, 0.0)
            for p, _ in like:
                total = sum(p[k] * pi[k] for k in allowed)
                for k in allowed:
                    new[k] += p[k] * pi[k] / max(total, 1e-300) / len(like)
            pi = new
        return pi, sum(math.log(max(sum(p[k] * pi[k] for k in allowed), 1e-300)) for p, _ in like)

    every, _ = em(range(len(model.names)))
    order = sorted(every, key=lambda k: (-every[k], k))
    cost = language.PENALTY * math.log(len(words) + 1)
    single = [sum(math.log(max(p[k], 1e-300)) for p, _ in like) for k in range(len(model.names))]
    best, chosen = max(single) - cost, {single.index(max(single)): 1.0}
    for k in range(2, len(order) + 1):
        pi, ll = em(order[:k])
        if ll - k * cost > best:
            best, chosen = ll - k * cost, pi
    return {model.names[k]: v for k, v in chosen.items()}


def test_languages_against_plain_em(spark):
    rng = random.Random(1)
    say = lambda lang, n: " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))
    train = [(i, say(lang, 30), lang) for i, lang in enumerate(list(WORDS) * 20)]
    model = language.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    texts = [say("en", 30) + " " + say("fr", 25), say("de", 5) + " " + say("en", 4), say("fr", 3), say("en", 40) + say("de", 30) + " " + say("fr", 30), "x", "Das house"]
    share, has = model.proportions(texts)
    for text, p in zip(texts, share, strict=True):
        want = plain_proportions(model, text)
        assert {model.names[k] for k in np.flatnonzero(p > 1e-12)} == {n for n, v in want.items() if v > 1e-12}
        assert all(abs(p[model.names.index(n)] - v) < 1e-4 for n, v in want.items())
    assert has.all()


def test_rare_languages_among_many_are_learned(spark):
    """More languages than a few dozen, and one of few rows beside a large one of which a sample is drawn."""
    rng = random.Random(2)
    spell = lambda i: ["".join(chr(0x4E00 + 50 * i + rng.randint(0, 40)) for _ in range(3)) for _ in range(30)]
    vocab = {f"l{i:02d}": spell(i) for i in range(80)}
    train = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(20)), lang) for i, lang in enumerate([*vocab] * 2 + ["l00"] * 400)]
    model = language.train(spark.createDataFrame(train, "doc_id long, text string, lang string"), train_rows=100)
    assert model.names == sorted(vocab)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(v) for _ in range(15))) for i, v in enumerate(vocab.values())], "doc_id long, text string")
    assert [r.lang_pred for r in language.identify(docs, model).orderBy("doc_id").collect()] == sorted(vocab)
    language.MOST_LANGUAGES, keep = 50, language.MOST_LANGUAGES
    try:
        with pytest.raises(ValueError, match="languages"):
            language.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    finally:
        language.MOST_LANGUAGES = keep


def test_rows_without_an_id_are_in_no_fold(spark, tmp_path):
    rows = [(None, "la maison et fenêtre", "fr"), (1, "the house and window", "en"), (2, "the bread and water", "en"), (4, "the window", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_language(spark, str(tmp_path)).collect()
    assert {r.lang_pred for r in got} == {"en"} and [r.held_out for r in got if r.doc_id is None] == [False]


def test_held_out_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()}
    got = [r for r in queries.op10_language(spark, sf).collect() if r.held_out and truth[r.doc_id].lang and any(map(str.isalpha, truth[r.doc_id].text or ""))]
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in got]) > 0.98
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").collect()}
    held = [(r.score, quality[r.doc_id], r.predicted) for r in queries.op3_quality_model(spark, sf).collect() if r.held_out and r.doc_id in quality]
    good, bad = [s for s, q, _ in held if q], [s for s, q, _ in held if not q]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    assert np.mean([p == q for _, q, p in held]) > 0.9
