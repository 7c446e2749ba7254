"""Operator 10: language proportions of a text by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shingles import mix

#: Buckets of the hashed letter trigrams of a language.
BUCKETS = 1 << 15
#: Documents of a language that the model is learned from at most (about; chosen by hash of their id): rare languages keep all.
TRAIN_ROWS = 20_000
#: More languages than this are refused: the model holds a number for each bucket and language.
MOST_LANGUAGES = 1_000
SMOOTH = 0.2
ROUNDS = 12
#: Each language of a document's set costs this many times the log of its number of words.
PENALTY = 3.0
UNKNOWN = "und"
_CHUNK = 1_000_000
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bucket, first trigram of each word, text of each word): the trigrams of every word with a blank before and
    after it, in lower case; a word is a run of letters."""
    low = [t.lower() for t in texts]
    size = np.array([len(t) + 1 for t in low], dtype=np.int64)
    c = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _is_letter()[c]
    c = np.where(is_letter, c, np.uint32(32))
    start = np.flatnonzero(is_letter & ~np.concatenate(([False], is_letter[:-1])))
    if not len(start):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    c = np.concatenate((np.array([32], dtype=np.uint32), c)).astype(np.uint64)
    h = mix(c[:-2] | (c[1:-1] << np.uint64(21)) | (c[2:] << np.uint64(42)))
    keep = is_letter[: len(h)]
    bucket = (h[keep] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    first = (np.cumsum(keep) - 1)[start]
    return bucket, first, np.searchsorted(np.cumsum(size), start, side="right")


@dataclass
class Model:
    names: list[str]
    log_p: np.ndarray  # BUCKETS x languages

    @staticmethod
    def of(counts: dict[str, np.ndarray]) -> "Model":
        names = sorted(counts)
        c = np.stack([counts[n] for n in names], axis=1).astype(np.float64) if names else np.zeros((BUCKETS, 0))
        return Model(names, np.log((c + SMOOTH) / (c.sum(axis=0) + SMOOTH * BUCKETS)).astype(np.float32))

    def proportions(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(language proportions of each text, whether it has a letter). A language outside a text's set has 0."""
        rows, n_lang = len(texts), len(self.names)
        out = np.zeros((rows, n_lang))
        bucket, first, of = grams(texts)
        has = np.zeros(rows, dtype=bool)
        has[of] = True
        if not len(of) or not n_lang:
            return out, has
        word = np.add.reduceat(self.log_p[bucket], first, axis=0).astype(np.float64)
        top = word.max(axis=1, keepdims=True)
        like = np.exp(word - top)
        begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        row, count = of[begin], np.diff(np.concatenate((begin, [len(of)])))
        at = np.repeat(np.arange(len(row)), count)
        base = np.add.reduceat(top[:, 0], begin)

        def fit(allowed: np.ndarray, like: np.ndarray, at: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """EM from even proportions over the allowed languages of each text; the proportions and the log-likelihood."""
            pi = allowed / allowed.sum(axis=1, keepdims=True)
            for _ in range(ROUNDS):
                r = like * pi[at]
                r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
                pi = np.add.reduceat(r, begin, axis=0) / count[:, None]
            mass = np.maximum((like * pi[at]).sum(axis=1), 1e-300)
            return pi, np.add.reduceat(np.log(mass), begin)

        pi, full = fit(np.ones((len(row), n_lang)), like, at, begin, count)
        order = np.argsort(-pi, axis=1, kind="stable")
        cost = PENALTY * np.log(count + 1.0)
        single = np.add.reduceat(np.log(np.maximum(like, 1e-300)), begin, axis=0)
        best_set = single.argmax(axis=1)
        best = single[np.arange(len(row)), best_set] - cost
        chosen = np.zeros_like(pi)
        chosen[np.arange(len(row)), best_set] = 1.0
        for k in range(2, n_lang + 1):
            # The likelihood of all languages bounds that of any set: texts that can't gain by k of them are done.
            live = np.flatnonzero(full - k * cost > best)
            if not len(live):
                break
            allowed = np.zeros((len(live), n_lang))
            np.put_along_axis(allowed, order[live, :k], 1.0, axis=1)
            mine = np.isin(at, live)
            again = np.repeat(np.arange(len(live)), count[live])
            p, ll = fit(allowed, like[mine], again, np.concatenate(([0], np.cumsum(count[live])[:-1])), count[live])
            better = ll - k * cost[live] > best[live]
            chosen[live[better]] = p[better]
            best[live[better]] = (ll - k * cost[live])[better]
        out[row] = chosen
        return out, has


def _runs(column: pa.Array, languages: int = 1) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of so many characters that a number for each word and language stays small."""
    most = _CHUNK * 8 // max(languages, 8)
    at, run, size = 0, [], 0
    for i, x in enumerate(column):
        t = x.as_py() or ""
        if run and size + len(t) > most:
            yield at, run
            at, run, size = i, [], 0
        run.append(t)
        size += len(t)
    if run:
        yield at, run


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns the trigram counts of each non-null ``lang`` of ``docs`` (doc_id, text, lang).

    Fitted on all rows of a language, or, where there are more, on a sample of about ``train_rows`` of them chosen by hash of
    doc_id. Each task sums its counts; what comes to the driver is ``BUCKETS`` numbers a language. All languages are
    learned (over ``MOST_LANGUAGES`` of them raise ValueError); one without a letter in its texts has nothing to be learned.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = sorted(sizes)
    for name, n in sizes.items():
        if n > train_rows:
            drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * train_rows / n)
            known = known.where((F.col("lang") != name) | drawn)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for at, texts in _runs(batch.column(0)):
                bucket, first, of = grams(texts)
                if not len(of):
                    continue
                row = np.repeat(of, np.diff(np.concatenate((first, [len(bucket)]))))
                here = langs[at : at + len(texts)]
                for name in set(here):
                    hit = np.flatnonzero(here == name)
                    mask = np.zeros(len(texts), dtype=bool)
                    mask[hit] = True
                    sums[name] = sums.get(name, 0) + np.bincount(bucket[mask[row]], minlength=BUCKETS)
        for name, c in sums.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), type=pa.string()), pa.array(some.astype(np.int32)), pa.array(c[some].astype(np.int64))], names=["lang", "bucket", "n"])

    made = known.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = {n: np.zeros(BUCKETS) for n in names}
    table = made.toArrow()
    lang, bucket, n = (table[c].to_numpy(zero_copy_only=False) for c in ("lang", "bucket", "n"))
    for name in names:
        hit = lang == name
        counts[name][bucket[hit]] = n[hit]
    return Model.of({name: c for name, c in counts.items() if c.any()})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and languages of each row of ``docs`` (doc_id, text).

    The proportions of all learned languages are fitted to the words of the whole text by EM; then the set of languages (the
    k most likely, k from 1) with the best penalised likelihood is kept. lang_pred is the language of the largest
    proportion (the first by name among equals), score its proportion, languages all of the set as "name:proportion".

    - A null or empty text, and one without a letter, is ``und`` with score 0; so is every text if nothing was learned.
    - Repeated rows give repeated results; an empty table gives an empty one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _runs(batch.column(1), len(model.names)):
                share, has = model.proportions(texts)
                names, scores, sets = [], [], []
                for p, h in zip(share, has, strict=True):
                    known = bool(h) and bool(len(p))
                    i = int(p.argmax()) if known else 0
                    names.append(model.names[i] if known else UNKNOWN)
                    scores.append(min(float(p[i]), 1.0) if known else 0.0)
                    sets.append(",".join(f"{model.names[j]}:{p[j]:.3f}" for j in np.flatnonzero(p > 0)) if known else "")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(names), pa.array(scores, type=pa.float64()), pa.array(sets)], names=["doc_id", "lang_pred", "score", "languages"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, languages string")


def split_by_crc(docs: DataFrame, parts: int, held: int) -> DataFrame:
    """``docs`` with held_out: whether crc32 of doc_id as text is ``held`` modulo ``parts``. A row without a doc_id is in no fold: it is
    not held out, and nothing is learned from it either."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == held, F.lit(False)))
