"""Toxicity by a small convolutional text classifier, trained in numpy.

A word's vector is three hashed embeddings side by side: two of the word, so that it passes for another
only if both hashes meet, and one of its first letters, which inflected forms share.  Filters of several widths run over the words, the largest value of each filter is kept,
and a logistic layer weighs them.  The first embedding feature starts as the bucket's smoothed log
odds in the sample; all of it is then trained by gradient.

The threshold is calibrated by language: the model also learns word profiles of the sample's
languages, guesses the language of a text from its words alone, and shifts the score so that 0.5 is
the best cut of that language on rows kept apart from training.  Languages beyond the `MAX_LANGUAGES`
most frequent have one profile together, with the cut of all rows.

The model has a fixed size and is fitted on a bounded sample; every document is scored whole, without
a shuffle.

Defined cases: null, empty and wordless texts score as one word that means nothing; without labels of
both classes every score is the share of label 1 (0 where there are none); repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from trialmill.llm.common import WordHashes, chunks
from trialmill.llm.labelled import Row, held_out, labelled_sample
from trialmill.llm.licenses import ALNUM
from trialmill.llm.quality import with_score

PER_CLASS = 4000
MAX_BYTES = 24_000_000
BUCKETS = 1 << 15
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PAD = max(WIDTHS) - 1
TABLES = 3
PREFIX_BYTES = 4
PRIOR = 4.0
MAX_LANGUAGES = 16


@dataclass
class Layout:
    """Documents end to end: bucket numbers of the words, a padding word after each, and where each starts."""

    ids: np.ndarray
    real: np.ndarray
    starts: np.ndarray


def lay_out(texts: list[bytes], known: WordHashes) -> Layout:
    words = [t.translate(ALNUM).split() for t in texts]
    sizes = np.array([max(1, len(w)) + PAD for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    ids = np.full((int(sizes.sum()), TABLES), BUCKETS, np.int64)  # row BUCKETS of the tables is padding: zeros
    real = np.zeros(len(ids), bool)
    for start, w in zip(starts.tolist(), words):
        whole, prefix = known.of(w), known.of([x[:PREFIX_BYTES] for x in w])
        for table, bits in enumerate((whole, whole >> np.uint64(32), prefix >> np.uint64(16))):
            ids[start : start + len(w), table] = bits & np.uint64(BUCKETS - 1)
        real[start : start + len(w)] = True
    return Layout(ids, real, starts)


class Network:
    """Embeddings (tables, buckets + 1, dim), filters (width, tables * dim, filters) a width, a logistic layer."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.tables = (rng.normal(size=(TABLES, BUCKETS + 1, DIM)) * 0.05).astype(np.float32)
        self.tables[:, BUCKETS] = 0
        self.filters = [(rng.normal(size=(w, TABLES * DIM, FILTERS)) * (0.5 / w) ** 0.5).astype(np.float32) for w in WIDTHS]
        for f in self.filters:  # some filters start by reading the log odds
            f[:, ::DIM, : FILTERS // 2] = 1.0 / f.shape[0]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = (np.abs(rng.normal(size=(len(WIDTHS), FILTERS))) * 0.3).astype(np.float32)
        self.offset = np.float32(-1.0)

    def embed(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([t[ids[:, k]] for k, t in enumerate(self.tables)], axis=1)

    def responses(self, x: np.ndarray, which: int) -> np.ndarray:
        f = self.filters[which]
        n = len(x) - PAD
        total = x[:n] @ f[0]
        for j in range(1, len(f)):
            total += x[j : n + j] @ f[j]
        return total + self.bias[which]

    def logits(self, layout: Layout) -> np.ndarray:
        x = self.embed(layout.ids)
        total = np.full(len(layout.starts), self.offset, np.float32)
        for which in range(len(WIDTHS)):
            r = self.responses(x, which)
            r[(layout.starts[1:, None] - 1 - np.arange(PAD)).ravel()] = -np.inf  # windows that begin in the padding
            top = np.maximum.reduceat(r, layout.starts, axis=0)
            total += np.maximum(top, 0) @ self.out[which]
        return total

    def step(self, layout: Layout, y: np.ndarray, weight: np.ndarray, memory: dict, rate: float) -> float:
        """One gradient step (Adagrad); only the words that a filter picked get a gradient."""
        x = self.embed(layout.ids)
        ends = np.append(layout.starts[1:], len(x))
        picked, tops, total = [], [], np.full(len(y), self.offset, np.float32)
        for which in range(len(WIDTHS)):
            r = self.responses(x, which)
            where = np.stack([s + r[s : e - PAD].argmax(axis=0) for s, e in zip(layout.starts.tolist(), ends.tolist())])
            top = np.take_along_axis(r, where, axis=0)
            picked.append(where)
            tops.append(top)
            total += np.maximum(top, 0) @ self.out[which]
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        slope = ((p - y) * weight / weight.sum()).astype(np.float32)
        touched, pulls = [], []
        for which, w in enumerate(WIDTHS):
            alive = tops[which] > 0
            self._move(f"o{which}", self.out[which], (np.maximum(tops[which], 0) * slope[:, None]).sum(axis=0), memory, rate)
            g = slope[:, None] * self.out[which][None, :] * alive
            self._move(f"b{which}", self.bias[which], g.sum(axis=0), memory, rate)
            down = np.zeros_like(self.filters[which])
            for j in range(w):
                at = picked[which] + j
                down[j] = np.einsum("df,dfk->kf", g, x[at])
                touched.append(at.ravel())
                pulls.append((g[:, :, None] * self.filters[which][j].T[None]).reshape(-1, TABLES * DIM))
            self._move(f"f{which}", self.filters[which], down, memory, rate)
        memory.setdefault("c", np.zeros(1, np.float32))
        memory["c"] += slope.sum() ** 2
        self.offset -= np.float32(rate * slope.sum() / (memory["c"][0] ** 0.5 + 1e-6))
        touched, pulls = layout.ids[np.concatenate(touched)], np.concatenate(pulls)
        for side in range(TABLES):
            rows, back = np.unique(touched[:, side], return_inverse=True)
            total_pull = np.zeros((len(rows), DIM), np.float32)
            np.add.at(total_pull, back, pulls[:, side * DIM : (side + 1) * DIM])
            total_pull[rows == BUCKETS] = 0
            seen = memory.setdefault(f"e{side}", np.zeros((BUCKETS + 1, DIM), np.float32))
            seen[rows] += total_pull**2
            self.tables[side][rows] -= rate * total_pull / (np.sqrt(seen[rows]) + 1e-6)
        return float(-(weight * np.where(y > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum() / weight.sum())

    @staticmethod
    def _move(name: str, value: np.ndarray, slope: np.ndarray, memory: dict, rate: float) -> None:
        seen = memory.setdefault(name, np.zeros_like(value))
        seen += slope**2
        value -= rate * slope / (np.sqrt(seen) + 1e-6)


@dataclass
class Model:
    network: Network | None
    languages: np.ndarray  # (buckets + 1, languages) log shares of words
    cuts: np.ndarray  # logit that scores 0.5, by language
    rate: float

    def language_of(self, layout: Layout) -> np.ndarray:
        return np.add.reduceat(self.languages[layout.ids[:, 0]], layout.starts, axis=0).argmax(axis=1)

    def scorer(self):
        if self.network is None:
            return lambda texts: np.full(len(texts), self.rate)
        known = WordHashes()

        def score(texts: list[bytes]) -> np.ndarray:
            parts = [np.zeros(0)]
            for part in chunks(texts, 500_000):
                layout = lay_out(texts[part.start : part.stop], known)
                z = self.network.logits(layout) - self.cuts[self.language_of(layout)]
                parts.append(1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30))))
            return np.concatenate(parts)

        return score


def _log_odds(layouts: list[Layout], y: np.ndarray) -> np.ndarray:
    """Smoothed log odds of all buckets, by how many texts of either label have them."""
    have = np.zeros((TABLES, 2, BUCKETS + 1))
    for layout, label in zip(layouts, y.astype(int).tolist()):
        for side in range(TABLES):
            have[side, label][np.unique(layout.ids[layout.real, side])] += 1
    scale = max(1, (y == 0).sum()) / max(1, (y == 1).sum())
    odds = np.log((have[:, 1] * scale + PRIOR * max(1, scale)) / (have[:, 0] + PRIOR * max(1, scale)))
    odds[:, BUCKETS] = 0
    return odds.astype(np.float32)


def _best_cut(logits: np.ndarray, y: np.ndarray, weight: np.ndarray, fallback: float, prior: float = 8.0) -> float:
    """Cut with the least weighted errors, in the middle of its gap; a few rows hardly move the fallback."""
    if not len(y) or y.min() == y.max():
        return fallback
    order = np.argsort(logits)
    z, label, w = logits[order], y[order], weight[order]
    wrong = np.concatenate(([0], np.cumsum(np.where(label > 0, w, -w)))) + w[label == 0].sum()
    edges = np.concatenate(([z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]))
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    cut = float(edges[best[len(best) // 2]])
    n = min((label > 0).sum(), (label == 0).sum())
    return (cut * n + fallback * prior) / (n + prior)


def fit(sample: list[Row], rate: float, epochs: int = 8, batch: int = 64, seed: int = 7) -> Model:
    known = WordHashes()
    y = np.array([r.label for r in sample], np.float32)
    if not len(y) or y.min() == y.max():
        return Model(None, np.zeros((BUCKETS + 1, 1), np.float32), np.zeros(1), rate)
    layouts = [lay_out([r.text], known) for r in sample]
    apart = np.arange(len(sample)) % 5 == 4
    learn = np.flatnonzero(~apart)

    names = sorted({r.lang for r in sample})
    counted = sorted(names, key=lambda n: (-sum(r.lang == n for r in sample), n))[:MAX_LANGUAGES]
    others = len(names) > len(counted)  # they share the last profile
    column = {n: k for k, n in enumerate(counted)}
    words = np.ones((BUCKETS + 1, len(counted) + others))
    for layout, row in zip(layouts, sample):
        np.add.at(words[:, column.get(row.lang, len(counted))], layout.ids[layout.real, 0], 1)
    languages = np.log(words / words.sum(axis=0)).astype(np.float32)
    languages[BUCKETS] = 0

    network = Network(seed)
    network.tables[:, :, 0] = _log_odds([layouts[i] for i in learn], y[learn])
    rng, memory = np.random.default_rng(seed), {}
    for epoch in range(epochs):
        order = rng.permutation(learn)
        for start in range(0, len(order), batch):
            some = order[start : start + batch]
            joined = _join([layouts[i] for i in some])
            network.step(joined, y[some], np.ones(len(some), np.float32), memory, 0.05 / (1 + epoch / 2))
    logits = np.concatenate([network.logits(_join(layouts[i : i + batch])) for i in range(0, len(layouts), batch)])
    weight = np.where(y > 0, rate / max(1e-9, y.mean()), (1 - rate) / max(1e-9, 1 - y.mean()))
    overall = _best_cut(logits[apart], y[apart], weight[apart], 0.0)
    model = Model(network, languages, np.zeros(len(counted) + others), rate)
    mine = np.concatenate([model.language_of(_join(layouts[i : i + batch])) for i in range(0, len(layouts), batch)])
    model.cuts = np.array([
        _best_cut(logits[apart & (mine == k)], y[apart & (mine == k)], weight[apart & (mine == k)], overall) for k in range(len(counted))
    ] + [overall] * others)
    return model


def _join(layouts: list[Layout]) -> Layout:
    sizes = np.array([len(x.ids) for x in layouts])
    return Layout(np.concatenate([x.ids for x in layouts]), np.concatenate([x.real for x in layouts]), np.cumsum(sizes) - sizes)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, **options) -> Model:
    return fit(*labelled_sample(docs, labels, "toxic", per_class, max_bytes), **options)


def classify(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """`docs` with held_out, score and predicted (1: toxic)."""
    scored = with_score(docs.drop("held_out", "score", "predicted"), model.scorer)
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
