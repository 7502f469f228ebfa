import math

import numpy as np
import pytest
import zstandard

from trialmill.llm import quality
from trialmill.llm.labelled import labelled_sample


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality.fit(*labelled_sample(docs, labels, "quality", 3000, 10**8), 3, 3, 16384)


def plain_size(text, dictionary):
    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary),
                                      write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(packer.compress(text))


def plain_score(model, text):
    if not text.split():
        return model.rate
    good, bad = (min(plain_size(text, d) for d in group) for group in (model.good, model.bad))
    curve, n = model.curve, len(text) + 1
    x = (math.log(min(max(n, curve.shortest), curve.longest)) - curve.mean[0]) / curve.spread[0]
    cut, slope = (p[0] + p[1] * x + p[2] * x * x for p in (curve.cut, curve.slope))
    z = cut + max(slope, quality.LEAST_SLOPE) * ((bad - good) / n - curve.mean[1]) / curve.spread[1]
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def test_scores_are_those_of_plain_calls(spark, sf_dir, model):
    rows = quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), model).collect()
    assert rows
    for r in rows:
        want = plain_score(model, (r.text or "").encode())
        assert abs(r.score - want) < 1e-9 and r.predicted == int(r.score >= 0.3)


def test_texts_of_one_length_are_ordered_by_the_difference(model):
    measured = np.linspace(-0.4, 0.4, 81)
    for length in (1, 7, 60, 1000, 30_000, 10**7):
        scores = model.curve(measured, np.full(81, float(length)))
        inside = (scores > 1e-9) & (scores < 1 - 1e-9)
        assert (np.diff(scores) >= 0).all() and (np.diff(scores[inside]) > 0).all()


def test_the_calibration_has_the_least_loss_near_it():
    rng = np.random.default_rng(5)
    lengths = np.exp(rng.uniform(2, 9, 3000))
    measured = rng.normal(0.05, 0.08, 3000)
    labels = (rng.random(3000) < 1 / (1 + np.exp(-(measured - 0.02) * 40))).astype(float)
    curve = quality.calibrate(measured, lengths, labels, labels.mean())

    def loss():
        p = np.clip(curve(measured, lengths), 1e-12, 1 - 1e-12)
        penalty = 5e-4 * (curve.cut @ curve.cut + curve.slope @ curve.slope)
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean() + penalty

    best = loss()
    for part in (curve.cut, curve.slope):
        for i in range(3):
            for step in (-0.05, 0.05):
                part[i] += step
                assert loss() > best
                part[i] -= step
