"""HyperMinHash near-duplicates against all pairs of whole sets; registers, correction and sieve by themselves."""

import itertools
import random

import numpy as np

from trialmill.llm import hyperminhash as h


def _set(text, width=3):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in words.replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def _planted():
    rng = random.Random(8)
    texts = []
    for size, changes in ((9, 0), (12, 1), (24, 1), (60, 1), (60, 2), (200, 3), (200, 5), (800, 20), (3, 0), (2, 0), (1, 0), (40, 9)):
        for _ in range(10):
            words = [f"w{rng.randrange(4000)}" for _ in range(size)]
            texts.append(" ".join(words))
            for at in rng.sample(range(size), changes):
                words[at] = f"x{rng.randrange(10**6)}"
            texts.append("\t".join(words).upper())
    body = [f"t{i}" for i in range(300)]
    texts += [" ".join([*body[: 7 * i], f"u{i}", *body[7 * i :]]) for i in range(40)]  # one large family
    half = [f"h{i}" for i in range(100)]
    texts += [" ".join(half + [f"v{i}.{j}" for j in range(100)]) for i in range(40)]  # a shared passage, no near copies
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (None, texts[0]), (None, "alone and without an id"), (3, texts[3]), (5, "another text")]


def _plain(rows, least):
    sets = [_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and least[1] * both >= least[0] * (len(sets[i]) + len(sets[j]) - both):
            up[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        known = [d for d in groups[root(i)] if d is not None]
        component = min(known) if known else None
        out.append((doc, len(sets[i]), component, doc == component))
    return out


def test_classes_equal_all_pairs(spark):
    rows = _planted()
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, point int, keys string")
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(_plain(rows, (85, 100)), key=key)
    assert sorted(map(tuple, h.near_duplicates(frame.repartition(3), tile=16).collect()), key=key) == want
    assert h.near_duplicates(frame.limit(0)).count() == 0


def _pair(rng, n, similarity):
    both = round(n * similarity)
    pool = rng.integers(0, 2**63, 2 * n, np.uint64)
    rest = n - both
    return np.unique(pool[:both + rest // 2]), np.unique(np.concatenate((pool[:both], pool[both + rest // 2 : n])))


def _estimate(a, b):
    size = h.BANDS * h.ROWS
    return h.corrected(h.registers(a)[None], h.registers(b)[None], h.spread(np.array([len(a)]), size), h.spread(np.array([len(b)]), size))[0]


def test_tiles_link_what_all_pairs_link():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 150, np.uint64)
    sets = [np.unique(np.concatenate((base[rng.random(150) > drop], rng.integers(0, 2**63, int(150 * drop), np.uint64)))) for drop in rng.uniform(0, 0.15, 60)]
    held = np.stack([h.registers(x) for x in sets])
    for blocks in (np.zeros(60, int), rng.integers(0, 2, 60)):
        near = {
            (i, j) for i in range(60) for j in range(i)
            if (blocks[i] != blocks[j] or not blocks.any()) and 100 * h.intersection(sets[i], sets[j]) >= 85 * len(np.union1d(sets[i], sets[j]))
        }
        labels = np.arange(60) // 2  # some are of one class before
        links = h.tile_links(labels, blocks, held, sets, h.LEAST)

        def parts(pairs):
            up = list(range(30))
            for a, b in pairs:
                up = [up[a] if x == up[b] else x for x in up]
            return [up.index(x) for x in up]

        assert near and parts(links) == parts((labels[i], labels[j]) for i, j in near) and len(links) < 30


def test_estimate_and_sieve():
    rng = np.random.default_rng(4)
    for n in (8, 40, 200, 5000):
        got, passed = [], []
        for _ in range(60):
            a, b = _pair(rng, n, 0.875)
            got.append(_estimate(a, b))
            passed.append(got[-1] >= h.needed(np.array([len(a)]), np.array([len(b)]), h.BANDS * h.ROWS, 0.85)[0])
        assert abs(np.mean(got) - 0.875) < 0.03 and all(passed)
    a, b = (np.unique(rng.integers(0, 2**63, 5000, np.uint64)) for _ in range(2))
    assert _estimate(a, b) < 0.05 < h.needed(np.array([5000]), np.array([5000]), h.BANDS * h.ROWS, 0.85)[0]


def test_registers_are_zeros_and_mantissa():
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(0, 2**64, 20_000, np.uint64))
    values, buckets = h.registers(hashes), h.BANDS * h.ROWS
    mixed = [int(x) for x in h._mixed(hashes)]
    where = [(int(x) >> 32) * buckets >> 32 for x in hashes]
    for bucket in (0, 7, buckets - 1):
        least = min(m for m, b in zip(mixed, where) if b == bucket)
        zeros = 64 - least.bit_length()
        assert values[bucket] == zeros << 10 | ((least << zeros << 1) & (2**64 - 1)) >> 54
    assert len(h.registers(hashes[:0])) == 0 and len(set(h.registers(hashes[:1]))) == 1


def test_chance_matches_fit_what_unlike_sets_show():
    rng = np.random.default_rng(2)
    hits = total = 0
    for _ in range(300):
        a, b = (h.registers(np.unique(rng.integers(0, 2**64, 2000, np.uint64))) for _ in range(2))
        hits, total = hits + int((a == b).sum()), total + len(a)
    expected = h.chance_matches(*[h.spread(np.array([2000]), h.BANDS * h.ROWS)] * 2)[0]
    assert abs(hits / total - expected) < 4 * (expected / total) ** 0.5
