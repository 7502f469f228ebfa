"""The pipeline's near-duplicate stage against brute force on planted near copies."""

import itertools
import random

import corpus_pipeline
from trialmill.llm import neardup


def _set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _planted():
    rng = random.Random(5)
    texts = []
    for size, changes in ((60, 1), (60, 2), (200, 1), (200, 2), (200, 4), (1000, 8), (1000, 20), (7, 0), (3, 0), (40, 3)):
        for _ in range(12):
            words = [f"w{rng.randrange(5000)}" for _ in range(size)]
            texts.append(" ".join(words))
            for at in rng.sample(range(size), changes):
                words[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words).upper())
    body = [f"t{i}" for i in range(400)]  # one large family: every member differs in its own word
    texts += [" ".join([*body[: 10 * i], f"u{i}", *body[10 * i :]]) for i in range(40)]
    return [(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (None, " "), (None, texts[0])]


def _kept(rows):
    sets = [_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        either = len(sets[i] | sets[j])
        if not either or len(sets[i] & sets[j]) >= 0.8 * either:
            up[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    return sorted(min(d for d in g if d is not None) for g in groups.values())


def test_stage_finds_all_near_copies(spark):
    rows = _planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _kept(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == want
    assert sorted(r.doc_id for r in neardup.keep_one(docs, tile=8).collect()) == want  # keys in many tiles
    assert neardup.keep_one(docs.limit(0)).count() == 0
