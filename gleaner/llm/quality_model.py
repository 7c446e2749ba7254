"""Operator 3: ridge scores over random Fourier features of document statistics, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch

#: Labelled rows that are used at most, the first by hash of their id: 24 bytes each to broadcast.
TRAIN_ROWS = 20_000
#: Parts of them (by hash): the scores that calibrate a part come from weights that the other parts are fitted to.
FOLDS = 3
FEATURES = 256
RIDGE = 1e-3
WIDTH = 3.0
#: Fixed value: short function words of several languages, which running prose is full of.
FUNCTION_WORDS = frozenset("a an and are as at be by for from in is it of on or that the this to was with au de des du en et la le les qui que un une auf das der die ein für ist mit und von zu con el los para por se su y".split())
_BLANK = re.compile(r"[\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>@^~=_\\{}\[\]]+")
_DIGIT = re.compile(r"[0-9]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_MARK = re.compile(r"[.,;:!?]")
_SHOUT = re.compile(r"[!?]{2,}")
NAMES = "words word_length symbols digits upper marks shouts bare function distinct top repeats dup_lines line_words ended shortest".split()


def statistics(text: str) -> list[float]:
    """The statistics of a text, each of about unit size; those of a text without words are 0."""
    w = [x for x in _BLANK.split(text) if x]
    n = len(w)
    if not n:
        return [0.0] * len(NAMES)
    size = len(text)
    low = [x.lower() for x in w]
    seen = Counter(low)
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    share = lambda p: len("".join(p.findall(text))) / size
    ended = sum(x.rstrip()[-1:] in ".!?\"'" for x in lines)
    return [
        np.log1p(n) / 4,
        min(sum(map(len, w)) / n, 30.0) / 5,
        min(share(_SYMBOL) * 10, 3.0),
        min(share(_DIGIT) * 10, 3.0),
        share(_UPPER) * 4,
        min(share(_MARK) * 10, 3.0),
        min(len(_SHOUT.findall(text)) / n * 4, 3.0),
        sum(not any(map(str.isalnum, x)) for x in w) / n * 4,
        sum(seen[f] for f in FUNCTION_WORDS if f in seen) / n * 4,
        np.log(len(seen)) / np.log(n + 1.0) * 2,
        max(seen.values()) / n * 4,
        sum(a == b for a, b in zip(low, low[1:], strict=False)) / n * 4,
        (len(lines) - len(set(lines))) / len(lines) * 3,
        np.log1p(n / len(lines)) / 2,
        ended / len(lines),
        1.0 if n < 6 else 0.0,
    ]


@dataclass
class Fourier:
    """Random Fourier features: cosines whose inner products approximate a Gaussian kernel of width ``WIDTH`` over the
    standardised statistics. The directions come from a fixed seed."""

    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(7))
        w = rng.normal(0.0, 1.0 / WIDTH, (len(self.mean), FEATURES))
        shift = rng.uniform(0.0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -6.0, 6.0)
        return np.hstack((np.ones((len(x), 1)), np.sqrt(2.0 / FEATURES) * np.cos(z @ w + shift)))


@dataclass
class Model:
    fourier: Fourier
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best non-decreasing fit of ``y`` on ``x`` by pooling adjacent violators: (knots, levels) for interpolation."""
    # Rows of one score come first to their mean: what a tie gets does not depend on the order of rows.
    at, of = np.unique(x, return_inverse=True)
    mass = np.bincount(of, weights=weight)
    level = np.bincount(of, weights=y * weight) / mass
    pools: list[list[float]] = []  # level, weight, lowest x, highest x
    for i in range(len(at)):
        pools.append([float(level[i]), float(mass[i]), float(at[i]), float(at[i])])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            w = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
    knots = [k for p in pools for k in ((p[2], p[0]), (p[3], p[0]))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def _matrix(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy().reshape(batch.num_rows, -1)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, scratch: Scratch | None = None) -> Model:
    """Fits on the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality 0/1) marks, at most ``train_rows``.

    The statistics of the sample are written once; means and normal equations are then sums over its partitions, by fold, so
    the driver adds a matrix a fold and partition. The isotonic calibration is fitted to scores of rows that had no part
    in the weights that scored them (cross-fitting, at any number of rows); the weights of the model are fitted to all.
    Of contradictory labels of one id the least counts. Without rows of both classes the score is the share of class 1
    (0.5 without any row).
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = rows.select("text", "y", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t or "") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.list_(pa.float64())), b.column(1), b.column(2)], names=["x", "y", "fold"])

    # Dealt anew, not coalesced: the scan of the texts keeps all its tasks, only the bounded sample comes together.
    sample = scratch.keep(rows.mapInArrow(measured, "x array<double>, y double, fold int").repartition(8), "sample")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(NAMES)))
        for b in batches:
            if b.num_rows:
                x = _matrix(b, 0)
                total += np.stack((np.full(x.shape[1], float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)))
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["m"])

    n, s, ss = sum((np.array(r["m"]).reshape(3, -1) for r in sample.mapInArrow(moments, "m array<double>").collect()), np.zeros((3, len(NAMES))))
    mean = s / np.maximum(n, 1)
    scale = np.sqrt(np.maximum(ss / np.maximum(n, 1) - mean**2, 0.0))
    fourier = Fourier(mean, np.where(scale > 1e-9, scale, 1.0))
    d = FEATURES + 1

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, d * d + d))
        for batch in batches:
            fold = batch.column(2).to_numpy()
            for i in np.unique(fold):
                z, y = fourier(_matrix(batch, 0)[fold == i]), batch.column(1).to_numpy()[fold == i]
                total[i] += np.concatenate(((z.T @ z).ravel(), z.T @ y))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["m"])

    total = sum((np.frombuffer(r["m"]).reshape(FOLDS, -1) for r in sample.mapInArrow(normal, "m binary").collect()), np.zeros((FOLDS, d * d + d)))

    def solved(sums: np.ndarray) -> np.ndarray:
        a, b = sums[: d * d].reshape(d, d), sums[d * d :]
        return np.linalg.solve(a + RIDGE * max(a[0, 0], 1.0) * np.eye(d), b)

    weights, without = solved(total.sum(axis=0)), np.stack([solved(total.sum(axis=0) - total[i]) for i in range(FOLDS)])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = (fourier(_matrix(batch, 0)) * without[batch.column(2).to_numpy()]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(s), batch.column(1)], names=["s", "y"])

    found = sample.mapInArrow(scored, "s double, y double").toPandas()
    if not len(found):
        return Model(fourier, weights, np.array([0.0]), np.array([0.5]))
    knots, levels = isotonic(found["s"].to_numpy(), found["y"].to_numpy(), np.ones(len(found)))
    return Model(fourier, weights, knots, levels)


def score(docs: DataFrame, model: Model, cut: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= ``cut``) of each row of ``docs`` (doc_id, text), from the whole text.

    A null, empty or blank text has the statistics of a text without words and is scored like any other. Repeated rows give
    repeated results; an empty table gives an empty one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                s = model.score(np.array([statistics(t or "") for t in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")
