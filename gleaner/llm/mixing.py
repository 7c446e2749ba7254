"""Operator 2: document rates that bring the expected tokens of soft domains to target weights."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch, free_name, others

#: Labelled rows that the domain classifier learns from at most, the first by hash of their id.
TRAIN_ROWS = 20_000
#: Buckets of the hashed words of a domain.
BUCKETS = 1 << 16
#: More domains than this are refused: the model holds a number for each telling bucket and domain.
MOST_DOMAINS = 1_000
SMOOTH = 0.5
#: A bucket tells domains apart from this chi-square on (and two more for each domain beyond the second); all others are one.
TELLING = 40.0
#: A word's evidence counts this much: words of one text are far from independent.
TEMPER = 0.5
#: Targets count as met within this share of all words.
TOLERANCE = 1e-3
#: Weight of the squared distance of rates from 1, a document counting by its words, beside that of the sums from their targets (as a
#: share of the largest eigenvalue of the domains' Gram matrix). It decides among rates that do alike, and keeps a fit from
#: dropping most of a corpus for a domain that its texts hardly tell.
RIDGE = 3e-4
#: Gradient steps after which a fit that has not come to rest raises an error.
MOST_STEPS = 100
#: A limit on rates for callers that want one (the usual limit on repeated epochs); without one rates have no upper bound.
MOST_RATE = 4.0
_LOG = logging.getLogger(__name__)


def _distinct_buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct hashed words of each row, and the number of words of each row."""
    from gleaner.llm.shingles import word_hashes

    h, n = word_hashes(data, off)
    row = np.repeat(np.arange(len(off) - 1), n)
    one = np.unique(row * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64))
    return one // BUCKETS, one % BUCKETS, n


@dataclass
class Posteriors:
    """A multinomial classifier of domains over the distinct hashed words of a text, with tempered evidence.

    Buckets that tell the domains apart have a probability of their own in each domain; all others share one, so that the
    chance differences of rare words do not add up.
    """

    names: list[str]
    log_prior: np.ndarray
    place: np.ndarray  # bucket -> row of log_p; row 0 is that of all other buckets
    log_p: np.ndarray  # (telling buckets + 1) x domains, as ratios to the whole sample

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(posterior of each domain, number of words) of each text."""
        from gleaner.llm.shingles import chunks

        post, sizes = [], []
        for i, j, data, off in chunks(texts):
            row, bucket, n = _distinct_buckets(data, off)
            at = self.place[bucket]
            like = np.zeros((j - i, len(self.names)))
            for k in range(len(self.names)):
                like[:, k] = np.bincount(row, weights=self.log_p[at, k], minlength=j - i)
            like = self.log_prior + TEMPER * like
            like = np.exp(like - like.max(axis=1, keepdims=True))
            post.append(like / like.sum(axis=1, keepdims=True))
            sizes.append(n)
        return (np.concatenate(post), np.concatenate(sizes)) if post else (np.zeros((0, len(self.names))), np.zeros(0, dtype=np.int64))


def train(docs: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Posteriors:
    """Learns the domains of ``labelled`` (doc_id, domain) from the texts of ``docs``, from at most ``train_rows`` labelled rows.

    Null labels are left out; of several labels of one id the first by name counts; every domain of the sample is learned
    (over ``MOST_DOMAINS`` of them raise ValueError). Without any labelled row there is the one domain "all".
    """
    known = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    sizes = known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()
    names = sorted(r["domain"] for r in sizes)
    if len(names) > MOST_DOMAINS:
        raise ValueError(f"{len(names)} domains, more than {MOST_DOMAINS}")
    if not names:
        return Posteriors(["all"], np.zeros(1), np.zeros(BUCKETS, dtype=np.int32), np.zeros((1, 1)))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "domain")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gleaner.llm.shingles import chunks

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            domain = np.array(batch.column(1).to_pylist(), dtype=object)
            for i, j, data, off in chunks(batch.column(0)):
                row, bucket, _ = _distinct_buckets(data, off)
                of = domain[i:j][row]
                for d in set(domain[i:j]):
                    sums[d] = sums.get(d, 0) + np.bincount(bucket[of == d], minlength=BUCKETS)
        for d, c in sums.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(some), type=pa.string()), pa.array(some.astype(np.int32)), pa.array(c[some].astype(np.int64))], names=["domain", "bucket", "n"])

    table = rows.mapInArrow(count, "domain string, bucket int, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toArrow()
    c = np.zeros((BUCKETS, len(names)))
    d, b, n = (table[x].to_numpy(zero_copy_only=False) for x in ("domain", "bucket", "n"))
    for k, name in enumerate(names):
        c[b[d == name], k] = n[d == name]
    many = {r["domain"]: r["n"] for r in sizes}
    prior = np.array([many[x] for x in names], dtype=float)
    return Posteriors(names, np.log(prior / prior.sum()), *_evidence(c))


def _evidence(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``place`` and ``log_p`` of a classifier by the counts of texts with each bucket (rows) in each domain (columns)."""
    size, of = c.sum(axis=0), c.sum(axis=1)
    want = np.outer(of, size / max(size.sum(), 1.0))
    chi = np.divide((c - want) ** 2, want, out=np.zeros_like(c), where=want > 0).sum(axis=1)
    telling = np.flatnonzero(chi > TELLING + 2 * max(c.shape[1] - 2, 0))
    place = np.zeros(len(c), dtype=np.int32)
    place[telling] = np.arange(1, len(telling) + 1)
    rest, rest_of = size - c[telling].sum(axis=0), of.sum() - of[telling].sum()
    other = np.log((rest + 1) / (size + 1)) - np.log((rest_of + 1) / (of.sum() + 1))
    # Half a text of the whole sample's size is the least that a bucket has in any domain, small or large.
    own = np.log(c[telling] / np.maximum(size, 1.0) + SMOOTH / max(of.sum(), 1.0)) - np.log(of[telling, None] / max(of.sum(), 1.0))
    return place, np.concatenate((other[None, :], own))


@dataclass
class Rates:
    """Rates as what the gradient steps add up to (``move``): all that differs between documents is their own row. ``totals``: the sums
    of the domains at these rates; ``met``: whether they are within the tolerance of the targets."""

    move: np.ndarray
    most: float
    totals: np.ndarray | None = None
    met: bool = False

    def __call__(self, a: np.ndarray) -> np.ndarray:
        """The rates of documents with expected domain tokens ``a``: 1 and all steps, projected to the bounds."""
        return np.clip(1.0 - _shares(a) @ self.move, 0.0, self.most)


def _shares(a: np.ndarray) -> np.ndarray:
    size = a.sum(axis=1, keepdims=True)
    return np.divide(a, size, out=np.zeros_like(a), where=size > 0)


def _potential(u: np.ndarray, most: float) -> np.ndarray:
    """The function of a document's step ``u`` whose derivative is the negative of its rate: of the lowest sum at the best steps."""
    inside = np.clip(u, 1.0 - most, 1.0)
    below = np.where(u < 1.0 - most, u - inside, 0.0)
    return inside * inside / 2 - inside - (most * below if np.isfinite(most) else 0.0)


def fit_rates(members: DataFrame, targets: np.ndarray, tolerance: float = TOLERANCE, most_rate: float | None = None, ridge: float = RIDGE, most_steps: int = MOST_STEPS) -> Rates:
    """Rates r, from 0 (to ``most_rate``, if given), of the rows of ``members`` (tokens array<double>: expected tokens by domain) for which the sums
    of r * tokens are closest to ``targets`` by squares, with ``ridge`` towards r = 1 (see ``RIDGE``), by projected gradient
    steps in the metric that weighs a document by its tokens (long texts do not move more than short ones).

    The gradient of a document is its domain shares times the gaps of the sums, so the steps of all documents add up to one
    vector of the domains, and rates are 1 less a document's part in it, projected to the bounds. A step is one pass that
    sums, over the partitions, the domain totals at several lengths of step at once, along the gradient and as the Gram
    matrix of the documents at no bound turns it; the driver sees those sums only and takes the length that lowers the
    convex function of the steps most. The fit ends when the gradient is within a tenth of ``tolerance`` of the targets' sum (``met`` tells whether
    the targets are within ``tolerance`` then); one that does not in ``most_steps`` raises RuntimeError.
    """
    k, most = len(targets), np.inf if most_rate is None else most_rate

    def sums(tries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(potential, totals and Gram matrix of the documents at no bound) at each of ``tries``; the Gram matrix of all."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(tries), 1 + k + k * k))
            whole = np.zeros((k, k))
            for batch in batches:
                if batch.num_rows:
                    a = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, k)
                    share = _shares(a)
                    whole += a.T @ share
                    for i, m in enumerate(tries):
                        u = share @ m
                        r = np.clip(1.0 - u, 0.0, most)
                        free = (r > 0) & (r < most)
                        out[i] += np.concatenate(([a.sum(axis=1) @ _potential(u, most)], a.T @ r, (a.T @ (share * free[:, None])).ravel()))
            flat = np.concatenate((out.ravel(), whole.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), type=pa.int32()), pa.array(flat)], names=["i", "v"])

        got = members.select("tokens").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(len(tries) * (1 + k + k * k) + k * k)
        for row in got:
            flat[row["i"]] = row["v"]
        return flat[: -k * k].reshape(len(tries), -1), flat[-k * k :].reshape(k, k)

    scale = max(float(targets.sum()), 1.0)
    tries = [np.zeros(k)]
    for _ in range(most_steps + 1):
        each, whole = sums(tries)
        top = float(np.linalg.eigvalsh((whole + whole.T) / 2).max())
        rho = ridge * top
        i = int(np.argmin([s[0] + m @ targets + rho / 2 * (m @ m) for s, m in zip(each, tries, strict=True)]))
        move, totals, free = tries[i], each[i, 1 : k + 1], each[i, k + 1 :].reshape(k, k)
        gap = totals - targets
        slope = gap - rho * move
        if top <= 0 or np.abs(slope).max() <= 0.1 * tolerance * scale:
            return Rates(move, most, totals, bool(np.abs(gap).max() <= tolerance * scale))
        turned = np.linalg.solve((free + free.T) / 2 + rho * np.eye(k), slope)
        tries = [move, *(move + turned * 0.5**j for j in range(6)), *(move + slope / (top + rho) * 4.0**j for j in range(6))]
    raise RuntimeError(f"rates didn't settle in {most_steps} steps")


def memberships(docs: DataFrame, model: Posteriors, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, tokens array<double>) of each row of ``docs``: expected words by domain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            post, n = model(batch.column(1))
            a = post * n[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, type=pa.int64()), lists], names=["doc_id", "n_words", "tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n_words long, tokens array<double>")


OUTPUTS = ["n_words", "domain", "posterior", "rate", "copies"]


def document_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], most_rate: float | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_words, domain (the likeliest), posterior (its), rate and copies; input columns of
    these names are replaced, all others pass through.

    ``weights`` gives each domain's share of all expected words; domains without a weight have 0, and weights are brought to
    a sum of 1. The budget is the corpus as it is: the targets add up to its number of words. Rates have no upper bound unless
    ``most_rate`` gives one. Shares asked and reached are logged, as a warning where they differ by more than the
    tolerance. copies is the rate rounded up or down by a hash of doc_id, so that its expectation is the rate and a rerun
    gives the same.

    - A null, empty or blank text has no words and no part in the fit: domain null, posterior 0, rate 1.
    - Repeated rows get the same rate and copies. Where targets can't be met (a domain nobody belongs to), the rates come as
      close as squares allow. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    model = train(docs, labelled)
    names = model.names
    # The fit passes over the memberships again and again, so they are written once: 8 bytes a domain and document.
    members = scratch.keep(memberships(docs.select("doc_id", "text"), model), "members")
    share = np.array([max(weights.get(n, 0.0), 0.0) for n in names])
    share = share / share.sum() if share.sum() > 0 else np.full(len(names), 1.0 / len(names))
    mass = members.agg(*(F.coalesce(F.sum(F.col("tokens")[i]), F.lit(0.0)) for i in range(len(names)))).first()
    mass = np.array(mass, dtype=float)
    rates = fit_rates(members, share * mass.sum(), most_rate=most_rate)
    reached = rates.totals / max(float(mass.sum()), 1.0)
    level = logging.INFO if rates.met or not mass.sum() else logging.WARNING
    _LOG.log(level, "shares of words by domain, asked and reached: %s", ", ".join(f"{n} {a:.4f} {b:.4f}" for n, a, b in zip(names, share, reached, strict=True)))

    # The rates go back to the rows as a function of their texts: no join, no shuffle of texts.
    kept = others(docs, OUTPUTS)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    given = docs.select(*kept, draw.alias("_draw"), F.col("text").alias("_text"))
    width = len(given.columns) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, n = model(batch.column(width + 1))
            r = np.where(n > 0, rates(p * n[:, None]), 1.0)
            top = p.argmax(axis=1)
            copies = np.floor(r) + (batch.column(width).to_numpy() < r - np.floor(r))
            made = [
                pa.array(n, type=pa.int64()),
                pa.array([names[i] if m else None for i, m in zip(top, n, strict=True)], type=pa.string()),
                pa.array(np.where(n > 0, p.max(axis=1), 0.0)),
                pa.array(r),
                pa.array(copies.astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=[f"c{i}" for i in range(width)] + OUTPUTS)

    schema = "".join(f"c{i} {t}, " for i, (_, t) in enumerate(given.dtypes[:width]))
    out = given.mapInArrow(run, schema + "n_words long, domain string, posterior double, rate double, copies int")
    return out.toDF(*given.columns[:width], *OUTPUTS)


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], most_rate: float | None = None) -> DataFrame:
    """``docs`` with every row as often as its copies say (see ``document_rates``), its columns unchanged but for those of
    the names that operator writes, which are left out."""
    got = document_rates(docs, labelled, weights, most_rate).where("copies > 0")
    copy = free_name(got, "copy")
    return got.withColumn(copy, F.explode(F.sequence(F.lit(1), "copies"))).drop(copy, *OUTPUTS)


def labelled_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled table: toxic, good or poor; rows without a mark are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")
