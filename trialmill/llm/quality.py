"""Compression classifier: how much better do dictionaries of good text fit than those of bad text?

Labelled texts of either class fall into groups by which dictionary packs them best; each group trains
a zstandard dictionary.  A text's measure is the difference of its smallest size with bad and with good
dictionaries, normalised by its length.  A logistic fit on rows no dictionary has seen turns it into a
score.  Cut and slope of the curve follow the length, since a difference means less in a short text; the
slope stays above zero, so texts of one length are ordered as the measure orders them.

Models are small (at most `groups` dictionaries of `dict_bytes` a class) and fitted on a bounded
sample; every document is scored whole, without a shuffle.

Lengths beyond those of the rows of the fit count as the nearest of these.

Defined cases: null and empty texts get the share of label 1 as their score; without usable labels
of both classes every score is that share (0 where there are none); repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from trialmill.llm.labelled import Row, held_out, labelled_sample

PER_CLASS = 3000
MAX_BYTES = 24_000_000
GOOD_GROUPS, BAD_GROUPS = 8, 16
DICT_BYTES = 65536
THRESHOLD = 0.3
LEAST_SLOPE = 1e-3


def train_dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the texts themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:] or b" "


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(
        level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False
    )


def sizes(texts: list[bytes], compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    return np.array([[len(c.compress(t)) for c in compressors] for t in texts], np.int64).reshape(len(texts), len(compressors))


def group_dictionaries(texts: list[bytes], groups: int, size: int, rounds: int = 4) -> list[bytes]:
    """Dictionaries of the groups; groups start as bands of compressibility and swap texts by best fit."""
    plain = train_dictionary(texts, size)
    groups = max(1, min(groups, len(texts) // 8))
    if groups == 1:
        return [plain]
    ratio = sizes(texts, [compressor(plain)])[:, 0] / np.array([len(t) + 1 for t in texts])
    mine = np.searchsorted(np.quantile(ratio, np.linspace(0, 1, groups + 1)[1:-1]), ratio)
    for _ in range(rounds):
        found = [train_dictionary([t for t, m in zip(texts, mine) if m == g], size) for g in range(groups) if (mine == g).any()]
        now = sizes(texts, [compressor(d) for d in found]).argmin(axis=1)
        if len(found) == groups and (now == mine).all():
            break
        mine = now
    return found


def measure(texts: list[bytes], good: list, bad: list) -> np.ndarray:
    """Bytes that the good dictionaries save against the bad ones, by byte of the text."""
    return (sizes(texts, bad).min(axis=1) - sizes(texts, good).min(axis=1)) / _lengths(texts)


def _lengths(texts: list[bytes]) -> np.ndarray:
    return np.array([len(t) + 1 for t in texts], float)


@dataclass
class Curve:
    """Logistic curves over the measure; their cut and slope are parabolas of the logarithm of the length."""

    shortest: float
    longest: float
    mean: tuple[float, float]  # of log length and of the measure
    spread: tuple[float, float]
    cut: np.ndarray
    slope: np.ndarray

    def powers(self, lengths: np.ndarray) -> np.ndarray:
        x = (np.log(np.clip(lengths, self.shortest, self.longest)) - self.mean[0]) / self.spread[0]
        return np.stack((np.ones(len(x)), x, x * x), axis=1)

    def __call__(self, measured: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        at = self.powers(lengths)
        scaled = (measured - self.mean[1]) / self.spread[1]
        z = at @ self.cut + np.maximum(at @ self.slope, LEAST_SLOPE) * scaled
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(measured: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rate: float) -> Curve:
    """The curve of best fit; weights restore the share of label 1."""
    logs = np.log(lengths)
    mean, spread = (logs.mean(), measured.mean()), (logs.std() + 1e-9, measured.std() + 1e-9)
    curve = Curve(lengths.min(), lengths.max(), mean, spread, np.zeros(3), np.zeros(3))
    at = curve.powers(lengths)
    weight = np.where(labels > 0, rate / labels.mean(), (1 - rate) / (1 - labels.mean()))
    found = _logistic(np.concatenate((at, at * ((measured - mean[1]) / spread[1])[:, None]), axis=1), labels, weight)
    curve.cut, curve.slope = found[:3], found[3:]
    return curve


@dataclass
class Model:
    good: list[bytes]
    bad: list[bytes]
    curve: Curve | None
    rate: float

    def scorer(self):
        if self.curve is None:
            return lambda texts: np.full(len(texts), self.rate)
        good, bad = [compressor(d) for d in self.good], [compressor(d) for d in self.bad]

        def score(texts: list[bytes]) -> np.ndarray:
            found = self.curve(measure(texts, good, bad), _lengths(texts))
            return np.where([not t.split() for t in texts], self.rate, found)

        return score


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) / weight.sum() + penalty * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x / weight.sum() + penalty * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(sample: list[Row], rate: float, good_groups: int, bad_groups: int, dict_bytes: int) -> Model:
    """Dictionaries from every other row, the calibration from the rest."""
    rows = [r for r in sample if r.text.split()]
    learn, rest = rows[0::2], rows[1::2]
    by = {y: [r.text for r in learn if r.label == y] for y in (0, 1)}
    labels = np.array([r.label for r in rest], float)
    if not by[0] or not by[1] or labels.min(initial=1) == labels.max(initial=0):
        return Model([], [], None, rate)
    good, bad = group_dictionaries(by[1], good_groups, dict_bytes), group_dictionaries(by[0], bad_groups, dict_bytes)
    texts = [r.text for r in rest]
    measured = measure(texts, [compressor(d) for d in good], [compressor(d) for d in bad])
    return Model(good, bad, calibrate(measured, _lengths(texts), labels, rate), rate)


def train(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES,
    good_groups: int = GOOD_GROUPS, bad_groups: int = BAD_GROUPS, dict_bytes: int = DICT_BYTES,
) -> Model:
    return fit(*labelled_sample(docs, labels, "quality", per_class, max_bytes), good_groups, bad_groups, dict_bytes)


def with_score(docs: DataFrame, scorer, column: str = "score") -> DataFrame:
    """`docs` with a score of the whole text; `scorer()` makes the function of a batch of texts."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = scorer()
        for texts in batches:
            yield pd.Series(run([(t or "").encode() for t in texts]), dtype="float64")

    return docs.withColumn(column, score(F.col("text").cast("string")))


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with held_out, score and predicted (1: good)."""
    scored = with_score(docs.drop("held_out", "score", "predicted"), model.scorer)
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

