"""The ten operators on small fixtures: brute force, round trips, and nulls, empties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import archives, bpe, html_text, language, mixing, near_dedup, pii, quality_model, quality_rules, queries, revisits, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [None, "", "   \n\t ", "one", "one two three", "a b c d e", "A B c D e", LONG, "same same same same same same same same same same same", "a\nb\n\na\nx y\nx y"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("the of and a lorem ipsum dolor sit amet magna elit sed quis nulla porta vitae".split()) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "one"), (None, "no id here")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def empty(df):
    return df.where("false")


# 1: quality rules


def base_rules(t):
    w = WORD.findall(t or "")
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c, cover, seen, dup = Counter(win), set(), set(), 0
    for i, x in enumerate(win):
        if c[x] > 1:
            cover.update(range(i, i + 5))
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover), failed


def test_quality_rules(spark, odd):
    docs = odd.withColumn("kept", F.lit("mine")).withColumn("Extra", F.lit(1)).withColumn("n_words", F.lit("x"))
    trusted = spark.createDataFrame([(5,), (5,), (None,)], "doc_id long")
    got = quality_rules.quality_rules(docs, trusted)
    assert "Extra" in got.columns and dict(got.dtypes)["kept"] == "boolean"
    rows = got.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(r.text)
        assert not (r.kept and r.base_failed)
        if not r.n_words:
            assert r.ratio == 0
    assert quality_rules.quality_rules(empty(odd), trusted).count() == 0
    none = quality_rules.quality_rules(odd, empty(trusted)).collect()
    assert all(r.ratio == 0 and r.kept == (not r.base_failed) for r in none)


def spark_hash(data, seed=42):
    """Spark's xxhash64 of a string's bytes or of a long, as a signed number."""
    raw = data.encode() if isinstance(data, str) else (data % 2**64).to_bytes(8, "little")
    h = xxhash.xxh64_intdigest(raw, seed=seed % 2**64)
    return h - 2**64 if h >= 2**63 else h


def ratios(rows, trusted, buckets=1 << 16):
    """The mean log ratio of each row of (doc_id, text), counted word by word."""
    grams = []
    for _, t in rows:
        h = [spark_hash(x) for x in WORD.findall(t or "")]
        grams.append([x % buckets for x in h] + [spark_hash(y, spark_hash(x)) % buckets for x, y in zip(h, h[1:], strict=False)])
    target, raw = Counter(), Counter()
    for (d, _), g in zip(rows, grams, strict=True):
        raw.update(g)
        if d in trusted:
            target.update(g)
    q = sum(target.values()) / max(sum(raw.values()), 1)
    out = []
    for (d, _), g in zip(rows, grams, strict=True):
        own, total = Counter(g), 0.0
        for b, n in own.items():
            off = n if raw[b] <= quality_rules.OFTEN else 1
            t, r = target[b] - (off if d in trusted else 0), (raw[b] - off) * q
            total += n * (math.log((t + 1) / (r + 1)) + r * (1 - q) / (2 * (r + 1) ** 2))
        out.append(total / len(g) if g and q else 0.0)
    return out


def test_quality_ratio_and_verdict_against_brute_force(spark):
    rng = random.Random(3)
    say = "the of and a lorem ipsum dolor sit amet".split()
    rows = [(i, " ".join(rng.choice(say) + str(rng.randint(0, 3)) for _ in range(rng.randint(3, 60)))) for i in range(40)]
    rows += [(100 + i, " ".join(f"junk{rng.randint(0, 30)}###" for _ in range(40))) for i in range(40)] + [(200, None), (201, ""), (202, "own own own own word word word 1 2 3 4 5 6 7 8 9"), (203, "often " * 5_000 + "seldom seldom seldom"), (None, "the of and a lorem ipsum dolor sit amet 9"), (3, rows[3][1])]
    trusted = {i for i in range(20)} | {202}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_model", F.lit(1)).withColumn("target", F.lit(2)).withColumn("_q", F.lit(3)).withColumn("id", F.lit(4))
    ids = spark.createDataFrame([(i,) for i in [*trusted, None, 5]], "doc_id long")
    got = quality_rules.quality_rules(docs, ids)
    assert set(docs.columns) <= set(got.columns)
    want = sorted((str(d), round(r, 9), not base_rules(t)[5] and r >= quality_rules.LEAST_RATIO) for (d, t), r in zip(rows, ratios(rows, trusted), strict=True))
    assert sorted((str(r.doc_id), round(r.ratio, 9), r.kept) for r in got.collect()) == want
    assert sum(w[2] for w in want) > 30 and not any(w[2] for w in want if w[0].startswith("1") and len(w[0]) == 3)


def test_quality_ratio_is_the_same_inside_and_outside_the_target(spark):
    """Texts of one kind, half of them trusted: neither half is favoured."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 60)) for _ in range(80))) for i in range(300)]
    trusted = spark.createDataFrame([(i,) for i in range(0, 300, 2)], "doc_id long")
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), trusted).collect()
    inside, outside = (np.mean([r.ratio for r in got if r.doc_id % 2 == k]) for k in (0, 1))
    assert abs(inside - outside) < 0.02 and all(r.kept for r in got)


def test_quality_every_trusted_row_counts(spark):
    """Every trusted row is in the target and judged as one of it, however many there are, also by an id of another type."""
    n = 100_300
    docs = spark.range(n + 40).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7).alias("text"))
    trusted = spark.range(n).select(F.col("id").cast("int").alias("doc_id"))
    m = quality_rules.bucket_model(docs, trusted).first()
    assert (sum(m.t), sum(m.r)) == (n, n + 40)
    flags = quality_rules._flagged(docs, trusted, "target").where("target")
    assert flags.agg(F.count("*"), F.max("doc_id")).first() == (n, n - 1)


def test_quality_own_ngrams_are_taken_off_frequent_buckets_too(spark, monkeypatch):
    """A text's own n-grams are in no count that it is judged by, however many the corpus has of them."""
    rows = [(0, "often " * 3_000 + "a b c"), (1, "often " * 1_500 + "d e"), (2, "a b c d e often"), (3, "often " * 200 + "a d"), (4, "b often often c often e d")]
    docs, ids = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1,), (3,)], "doc_id long")
    got = [round(r.ratio, 9) for r in quality_rules.quality_rules(docs, ids).orderBy("doc_id").collect()]
    monkeypatch.setattr(quality_rules, "OFTEN", math.inf)
    assert got == [round(x, 9) for x in ratios(rows, {1, 3})]


def test_quality_counts_outside_of_lambdas_and_keeps_the_model_out_of_rows(spark):
    """What a row costs: numbers are sorted and told apart by compiled code, the model stays a constant, a filter computes nothing twice."""
    docs, ids = spark.createDataFrame([(0, "a b c")], "doc_id long, text string"), spark.createDataFrame([(0,)], "doc_id long")
    got = quality_rules.quality_rules(docs, ids)
    for df in (got, got.where("kept"), got.where("kept and ratio > 0").select("doc_id", "ratio")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"sort_array\(transform\(concat\([^\n]* AS quality_grams#", plan)) == 1
        assert len(re.findall(r"CASE WHEN \(size\(array_distinct\(quality_windows#", plan)) == 1
        assert "scalar-subquery" in plan and "AS quality_model#" not in plan


# 6: near duplicates


def sets(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(rows, k):
    s = {d: sets(t, k) for d, t in rows}
    root = {d: d for d in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s[d]), find(d)) for d in ids}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(ODD)]
    for g in range(12):
        words = prose(rng, rng.randint(4, 150)).split()
        for _ in range(rng.randint(2, 12)):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 30))):
                own[rng.randrange(len(own))] = f"edit{rng.randint(0, 9)}"
            rows.append((len(rows), " ".join(own).upper() if rng.random() < 0.2 else " \n".join(own)))
    rows += [(len(rows) + i, "exact copies meet in a class of their own") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bands", F.lit("clash"))
    want = groups(rows, 4)
    got = near_dedup.near_duplicates(spark, docs, 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)
    kept = near_dedup.drop_near_duplicates(spark, docs, 4)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()}) and "bands" in kept.columns


def test_near_duplicates_of_a_large_loose_group(spark):
    """Copies that are mostly below the threshold to each other, so that buckets stay mixed after the star."""
    rng = random.Random(6)
    words = prose(rng, 120).split()
    rows = []
    for i in range(330):
        own = list(words)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            own[rng.randrange(len(own))] = f"e{rng.randint(0, 99)}"
        rows.append((i, " ".join(own)))
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups(rows, 4)


def test_near_duplicates_edges(spark, odd):
    assert near_dedup.near_duplicates(spark, empty(odd)).count() == 0
    got = near_dedup.near_duplicates(spark, spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string"), 4).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 2, True)]
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, "x y z x y z w"), (None, None)], "doc_id long, text string")
    got = near_dedup.near_duplicates(spark, docs, 4).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("4", "4", True), ("None", "4", False), ("None", "None", True), ("None", "None", True)]
    assert sorted((str(r.doc_id), str(r.text)) for r in near_dedup.drop_near_duplicates(spark, docs, 4).collect()) == [("4", "a b c d e f"), ("None", "None"), ("None", "x y z x y z w")]


def test_sketch_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1200, dtype=np.int64).astype(np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[200:1200])
    s = shingles.sketches(np.concatenate((a, b)), np.array([1000, 1000]), 128)
    assert (s != 0).all() and abs((s[0] == s[1]).mean() - 800 / 1200) < 0.15
    tiny = shingles.sketches(np.concatenate((a[:1], a[:1], a[:2])), np.array([1, 1, 2]), 128)
    assert (tiny[0] == tiny[1]).all() and (tiny != 0).all()


# 7: personal data


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base_spans(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in BASE for m in re.finditer(p, t or "") if ok(m[0])]


def test_personal_data_base_spans(spark, odd):
    rng = random.Random(7)
    bits = ["a@b.c", "x.y@z-1.co.uk", "@", ".", "1.2.3.4", "300.1.2.3", "0010.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "6011000990139424", "+1 (555) 010-9999", "+12", " ", "é😀", "_", "-", "7", "\n", "12.5"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(400)]
    rows += [(1000, "9" * 5000), (1001, "a" * 50_000 + "@b.c"), (1002, "1.1.1.1 " * 2000), (1003, None)]
    got = pii.span_report(spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(0))).collect()
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        want = base_spans(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r.n_email == sum(w.startswith("email") for w in want) and r.n_phone == sum(w.startswith("phone") for w in want)
        assert set(want) <= set(r.spans.split(","))
    assert pii.span_report(empty(odd)).count() == 0


def test_personal_data_added_by_checksum_and_context(spark):
    rows = [
        (1, "account DE89 3704 0044 0532 0130 00 at the bank"),
        (2, "account DE89 3704 0044 0532 0130 01 at the bank"),
        (3, "my social security number is 078-05-1120"),
        (4, "part 078-05-1120 of the list"),
        (5, "call me: 555-010-1234"),
        (6, "order 555-010-1234"),
    ]
    got = {r.doc_id: r.spans for r in pii.span_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "iban:8:35", 2: "", 3: "ssn:29:40", 4: "", 5: "phone_local:9:21", 6: ""}


def test_redact(spark):
    rows = [(1, "é a@b.cd, 1.2.3.4!"), (2, None), (3, "+1.2.3.4.5678 x"), (4, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base_spans", F.lit(1)).withColumn("lang", F.lit("en"))
    got = pii.redact(docs)
    assert {r.doc_id: r.text for r in got.collect()} == {1: "é [EMAIL], [IP]!", 2: None, 3: "[PHONE] x", 4: "clean"} and set(got.columns) == set(docs.columns)


# 8: BPE


def test_bpe_equals_the_library(spark):
    rng = random.Random(8)
    al = "aab \n\t'sé<|endoftext|>漢字😀  \x00ʼ'LL're 12٣ "
    rows = [(i, "".join(rng.choice(al) for _ in range(rng.randint(0, 60)))) for i in range(600)]
    rows += [(1000 + i, t) for i, t in enumerate([*ODD, "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "a" * 20_000, "  \n\n  a"])]
    tok = Tokenizer.from_file(BPE)
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string"), BPE).collect()
    text = dict(rows)
    for r in got:
        ids = tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert len(got) == len(rows)


def test_bpe_columns(spark, odd):
    docs = odd.withColumn("n_tokens", F.lit("mine")).withColumn("0", F.lit(5))
    got = bpe.encode(docs, BPE)
    assert set(got.columns) == {"doc_id", "0", "n_tokens", "token_ids", "decoded"} and got.count() == odd.count()
    assert all(len(r.token_ids) == r.n_tokens for r in got.collect()) and bpe.encode(empty(odd), BPE).count() == 0
    vocab = bpe.load(BPE)
    assert vocab.decode("0,1,2") == "".join(vocab.bytes[i].decode() for i in range(3)) and vocab.decode(",".join(str(i) for i in vocab.first[[0xC3]])) == "�"


# 10: languages

WORDS = {"en": "the house and window with bread water", "de": "das haus und fenster mit brot wasser", "fr": "la maison et fenêtre avec pain eau"}


def test_language(spark):
    rng = random.Random(10)
    say = lambda lang, n: " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))
    train = [(i, say(lang, 30), lang) for i, lang in enumerate(list(WORDS) * 20)] + [(900, None, "en"), (901, "x y", None)]
    model = language.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.names == ["de", "en", "fr"]
    rows = [(i, say(lang, 25)) for i, lang in enumerate(WORDS)] + [(10, say("en", 40) + " " + say("de", 20)), (11, None), (12, ""), (13, "12 34 !?"), (14, say("fr", 9000))]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")), model).collect()}
    assert [got[i].lang_pred for i in range(3)] == list(WORDS) and got[14].lang_pred == "fr"
    assert got[10].lang_pred == "en" and "de:" in got[10].languages and 0.5 < got[10].score < 0.85
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (11, 12, 13))
    nothing = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), nothing).collect()} == {"und"}


# 3: quality classifier


def test_quality_model(spark, odd):
    rng = random.Random(11)
    good = [(i, ". ".join(prose(rng, 12) for _ in range(rng.randint(1, 8))) + ".", 1) for i in range(150)]
    bad = [(1000 + i, " ".join(f"x{rng.randint(0, 9)}###" for _ in range(rng.randint(5, 90))), 0) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in good[:100] + bad[:40]] + [(None, 1), (5, 1), (7777, None)], "doc_id long, quality int")
    model = quality_model.train(docs, labels)
    got = {r.doc_id: r for r in quality_model.score(docs, model).collect()}
    held = [got[r[0]].predicted == r[2] for r in good[100:] + bad[40:]]
    assert sum(held) / len(held) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert quality_model.score(odd, model).count() == odd.count() and quality_model.score(empty(odd), model).count() == 0
    assert {r.score for r in quality_model.score(odd, quality_model.train(docs, empty(labels))).collect()} == {0.5}


def test_isotonic_pools_violators():
    knots, levels = quality_model.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert np.interp([1, 2, 3, 4], knots, levels).tolist() == [0, 0.5, 0.5, 1]


# 2: mixing


def test_mixing_meets_targets(spark):
    rng = random.Random(12)
    say = lambda v, n: " ".join(rng.choice(v.split()) for _ in range(n))
    rows = [(i, say(WORDS["en"], rng.randint(5, 60))) for i in range(300)] + [(1000 + i, say(WORDS["fr"], rng.randint(5, 60))) for i in range(100)]
    rows += [(5000, None), (5001, ""), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rate", F.lit("mine")).withColumn("lang", F.lit("xx"))
    labels = spark.createDataFrame([(i, "a") for i in range(60)] + [(1000 + i, "b") for i in range(60)] + [(None, "b"), (2, None)], "doc_id long, domain string")
    got = mixing.document_rates(docs, labels, {"a": 0.5, "b": 0.5, "unknown": 0.3}).collect()
    model = mixing.train(docs, labels)
    post = {r.doc_id: (r.n_words, r.tokens) for r in mixing.memberships(docs, model).collect()}
    total = sum(post[r.doc_id][0] for r in got)
    sums = np.zeros(2)
    for r in got:
        sums += np.array(post[r.doc_id][1]) * r.rate
    assert np.abs(sums - total / 2).max() < 0.01 * total and all(0 <= r.rate for r in got)
    assert all(r.rate == 1.0 and r.domain is None for r in got if r.doc_id >= 5000)
    mixed = mixing.mix(docs, labels, {"a": 0.5, "b": 0.5})
    assert mixed.count() == sum(r.copies for r in got) and set(mixed.columns) == {"doc_id", "text", "lang"}
    assert mixing.document_rates(empty(docs), labels, {"a": 1.0}).count() == 0
    assert {r.rate for r in mixing.document_rates(docs, empty(labels), {"a": 1.0}).collect()} == {1.0}


# 4: archives


def feature(data):
    """The feature of a payload, sample by sample."""
    n = len(data)
    mean = sum(data) / n
    deviation = (sum((x - mean) ** 2 for x in data) / n) ** 0.5
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(data).values())
    edge = [int(i * n / 65) for i in range(66)]
    means = [sum(data[a:b]) / max(b - a, 1) for a, b in zip(edge, edge[1:], strict=False)]
    bits = "".join("01"[y > x] for x, y in zip(means, means[1:], strict=False))
    return f"{mean:.4f}:{deviation:.4f}:{entropy + 0.0:.4f}:{int(bits, 2):016x}"


def test_media_ids_of_text_and_archives_that_are_not_listed(spark, tmp_path):
    docs = spark.createDataFrame([("a/b:c.png", "x"), ("", "y"), (None, "z")], "doc_id string, text string")
    assert {(r.doc_id, r.n_bytes) for r in archives.media_columns(spark, docs).collect()} == {("a/b:c.png", 1), ("", 1), (None, 1)}
    folder = f"file://{tmp_path}/a"
    listed = archives.write_archives(docs.coalesce(1), folder)
    listed.write.parquet(f"{tmp_path}/manifest")
    (old,) = (tmp_path / "a").glob("*.zip")
    (tmp_path / "a" / "part-000000-0009.zip").write_bytes(old.read_bytes())
    read = spark.read.format("gleaner_archives")
    assert read.load(folder).count() == 6 and read.option("manifest", f"file://{tmp_path}/manifest").load(folder).count() == 3


def test_media_ranges_follow_the_total(monkeypatch):
    monkeypatch.setattr(archives.ArchiveReader, "archives", lambda self: [(f"a{i}", 64 << 20) for i in range(100)])
    plan = lambda: archives.ArchiveReader({"path": "/x"}).partitions()
    assert len(plan()) == 400 and all(len(p.parts) == 1 for p in plan())
    monkeypatch.setattr(archives, "MOST_RANGES", 20)
    parts = [x for p in plan() for x in p.parts]
    assert len(plan()) <= 25 and sum(b - a for _, _, a, b in parts) == 100 * (64 << 20)


def test_media_round_trip(spark, odd):
    got = archives.media_columns(spark, odd.withColumn("feature", F.lit(1))).collect()
    text = {i: t for i, t in enumerate(ODD)} | {None: "no id here"}
    assert len(got) == odd.count()
    for r in got:
        data = (text[r.doc_id] or "").encode()
        full = data + b" " * ((-len(data)) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert r.media_bytes > 0 and r.error is None and r.feature == feature(full)
    assert archives.media_columns(spark, empty(odd)).count() == 0


def test_archive_ranges_and_damage(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 200) for i in range(50)], "doc_id long, text string").coalesce(1)
    folder = f"file://{tmp_path}/a"
    archives.write_archives(docs, folder).collect()
    spark.dataSource.register(archives.ArchiveSource)
    read = lambda: spark.read.format("gleaner_archives").option("rangeBytes", 2000).load(folder)
    rows = read().collect()
    assert sorted(int(r.name.split(":")[1][:-4]) for r in rows) == list(range(50)) and read().rdd.getNumPartitions() > 3
    assert all(r.attempts == 1 for r in rows)
    (file,) = (tmp_path / "a").glob("*.zip")
    raw = bytearray(file.read_bytes())
    victim = rows[7]
    raw[victim.offset + 60] ^= 255
    file.write_bytes(bytes(raw))
    (tmp_path / "a" / f".{file.name}.crc").unlink(missing_ok=True)
    again = {r.offset: r for r in read().collect()}
    assert again[victim.offset].media is None and again[victim.offset].attempts == archives.ATTEMPTS and "damaged" in again[victim.offset].error
    assert sum(r.media is not None for r in again.values()) == 49
    with pytest.raises(Exception, match="damaged"):
        spark.read.format("gleaner_archives").option("onError", "fail").option("attempts", 1).load(folder).collect()


# 5: revisits


def test_revisits(spark):
    full = lambda i, u, t, s=200, **h: (i, u, t, "response", s, h)
    back = lambda i, u, t, h: (i, u, t, "revisit", 304, h)
    rows = [
        full(1, "http://Ex.com/a/", 10, etag='"x"', **{"content-type": "text/html", "cache-control": "old"}),
        full(2, "https://www.ex.com:443/a#top", 20, 404, etag='"bad"'),
        back(3, "ex.com/a?ref=1", 30, {"etag": 'W/"x"', "cache-control": "new", "content-type": "no"}),
        back(4, "http://ex.com/a", 5, {"etag": '"x"'}),
        full(5, "http://ex.com/a", 200_000, etag='"y"', **{"last-modified": "m"}),
        back(6, "http://ex.com/a", 900_000, {"last-modified": "m"}),
        back(7, "http://ex.com/a", 900_001, {"etag": '"x"', "last-modified": "m"}),
        back(8, "http://ex.com/a", 900_002, {}),
        back(9, None, 900_003, {"etag": '"x"'}),
        back(10, "http://ex.com/b", None, None),
        full(11, "http://ex.com/c", 50, etag='"c"'),
        back(11, "http://ex.com/c", 50, {"etag": '"c"'}),
        back(12, "http://ex.com/c", 50, {"etag": '"c"'}),
        back(12, "http://ex.com/c", 50, {"etag": '"c"'}),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, headers map<string,string>").withColumn("base", F.lit(1))
    got = [(r.record_id, r.base_id, r.verdict) for r in revisits.resolve_revisits(df).collect()]
    want = [(3, 1, "resolved"), (4, None, "no_base"), (6, 5, "resolved"), (7, 5, "mismatch"), (8, 5, "unvalidated"), (9, None, "no_base"), (10, None, "no_base"), (11, None, "no_base"), (12, 11, "resolved"), (12, 11, "resolved")]
    assert sorted(got, key=str) == sorted(want, key=str)
    three = {r.record_id: r.headers for r in revisits.resolve_revisits(df).collect()}[3]
    assert three == {"etag": 'W/"x"', "content-type": "text/html", "cache-control": "new"}
    assert revisits.resolve_revisits(empty(df)).count() == 0
    for seconds, most in ((7, 100_000), (86_400, 1), (1_000_000, 2)):
        small = [(r.record_id, r.base_id, r.verdict) for r in revisits.resolve_revisits(df, seconds, most).collect()]
        assert sorted(small, key=str) == sorted(got, key=str)
    named = df.withColumn("digest", F.concat(F.lit("d"), "record_id"))
    assert {r.record_id: r.digest for r in revisits.resolve_revisits(named).collect()} == {3: "d1", 4: "d4", 6: "d5", 7: "d7", 8: "d8", 9: "d9", 10: "d10", 11: "d11", 12: "d11"}


def test_revisits_against_a_loop_and_the_oracle(spark):
    import duckdb

    rng = random.Random(9)
    rows, n = [], 0
    for _ in range(500):
        n += 1
        u, t = f"http://h/{rng.randint(0, 3)}", rng.randint(0, 3_000)
        tag = rng.choice([None, '"a"', '"b"'])
        h = {"etag": tag} if tag else {}
        rows.append((n, u, t, "response", rng.choice([200, 200, 500]), h) if rng.random() < 0.4 else (n, u, t, "revisit", 304, h))
    want = {}
    for i, u, t, kind, _, h in rows:
        if kind == "revisit":
            base = max((r for r in rows if r[3] == "response" and r[4] == 200 and r[1] == u and (r[2], r[0]) < (t, i)), key=lambda r: (r[2], r[0]), default=None)
            both = base and "etag" in h and "etag" in base[5]
            want[i] = (base and base[0], "no_base" if not base else "unvalidated" if not both else "resolved" if h == base[5] else "mismatch")
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, headers map<string,string>")
    for seconds, most in ((86_400, 100_000), (1_024, 20)):
        assert {r.record_id: (r.base_id, r.verdict) for r in revisits.resolve_revisits(df, seconds, most).collect()} == want
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    oracle = con.execute(queries.ORACLES["op5_revisits"]).fetchdf()
    got = queries.op5_revisits(spark, "/root/testdata/sf0.01").toPandas()
    assert sorted(got.columns) == sorted(oracle.columns) and len(got) == len(oracle)
    for c in ("verdict", "headers", "digest", "canonical"):
        assert dict(zip(got.record_id, got[c], strict=True)) == dict(zip(oracle.record_id, oracle[c], strict=True))


# 9: main text


def test_main_text():
    body = "the cat is on the mat and it was good for all of us " * 6
    page = f'<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><div class="ad">the and of it is buy</div><article><h1>Head &amp; line</h1><p><b>{body}<br><p>Short\n\n one.</p><script>var a="</p>";</script></article><div id="comments"><p>{body}</p></div><footer>&copy; x</footer></body></html>'
    want = " ".join(f"Head & line {body} Short one.".split())
    assert html_text.main_text(page) == want
    assert html_text.main_text(page[: page.index("Short")]) == want.removesuffix(" Short one.")
    plain = f'<body><div class="sidebar"><p>{body}</p></div><div><h1>Title</h1><p>{body}</p><p>Short.</p><p><a href="x">{body}</a></p></div><form>{body}</form><aside>{body}</aside>'
    assert html_text.main_text(plain) == " ".join(f"Title {body} Short.".split())
    wrapped = f'<div class="content-with-sidebar"><div class="page header"><article class="post"><p>{body}</p><div class="share-links">the and of it</div></article></div><div class="ad-slot">{body}</div></div>'
    assert html_text.main_text(wrapped) == " ".join(body.split())
    for x in (None, "", "<", "<article>", "<!-- x", "<p a='>", "<script>"):
        assert html_text.main_text(x) == ""


def test_extract(spark):
    rows = [(1, "u", "<article>one</article>"), (2, None, None), (2, None, None), (3, "v", "<article>" + "é " * 30_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(0))
    got = sorted((r.page_id, r.text[:3], r.n_chars) for r in html_text.extract(df).collect())
    assert got == [(1, "one", 3), (2, "", 0), (2, "", 0), (3, "é é", 59_999)] and html_text.extract(empty(df)).count() == 0
