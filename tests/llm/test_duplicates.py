"""SimHash components and window removal against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from trialmill.llm import components, simhash, substrings
from trialmill.llm.common import WordHashes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _plain_print(text):
    words = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(prints):
    """doc -> smallest doc reachable, by comparing all."""
    ids = list(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_the_radius(radius):
    for multiplier in (1, 7):
        masks = simhash.covering_masks(radius, multiplier)
        rng = random.Random(3)
        for _ in range(3000):
            bits = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(m & bits == 0 for m in masks)


def test_both_mask_families_leave_few_bits():
    free = max(64 - (a | b).bit_count() for a in simhash.covering_masks() for b in simhash.covering_masks(multiplier=7))
    assert free <= 24


def test_prints_and_classes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: _plain_print(r.text) for r in docs.collect()}
    classes = _classes(want)
    for bucket in (4096, 2):  # 2: nearly every bucket is cut again
        got = simhash.near_duplicates(docs, bucket=bucket).collect()
        assert {r.doc_id: r.fp % 2**64 for r in got} == want
        assert {r.doc_id: r.component_id for r in got} == classes
    assert len(set(classes.values())) < len(classes)


def test_bucket_links_keep_every_connection():
    rng = np.random.default_rng(5)
    for size in (2, 3, 40, 300):
        base = rng.integers(0, 2**63, 3, dtype=np.uint64)
        values = np.unique(np.array([base[i % 3] ^ np.uint64(1 << int(rng.integers(0, 40))) ^ np.uint64(1 << int(rng.integers(0, 40))) for i in range(size)]))
        keys = np.zeros(len(values), np.int64)
        links = simhash.bucket_links(keys, values, 4)
        got = _tree_classes(values.tolist(), links.tolist())
        want = _classes({v: v for v in values.tolist()})
        assert got == want and len(links) < len(values)


def _tree_classes(nodes, links):
    up = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    return up


def test_simhash_defined_cases(spark):
    rows = [(5, "", "x"), (3, None, "x"), (None, " \t", "x"), (9, "One two three", "x"), (9, "one TWO three", "x"), (None, "lonely words of nobody at all", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got[5, 0] == got[3, 0] == got[None, 0] == 3
    assert sum(1 for k in got if k[0] == 9) == 1 and got[next(k for k in got if k[0] == 9)] == 9
    assert next(v for k, v in got.items() if k[0] is None and k[1]) is None
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 3, 9] and simhash.keep_one(docs.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(60)] + [(7, 7), (500, 501), (501, 500)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(60)} | {500: 500, 501: 500}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _plain_removal(docs, window):
    """doc -> (words, removed, sha256) from all windows in one dictionary."""
    first, words = {}, {}
    for i in sorted(docs):
        words[i] = WORDS.findall(docs[i] or "")
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), (i, s))
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window,group,chunk", [(20, 200_000, 4_000_000), (20, 3, 2000), (4, 1, 300), (1, 5, 500)])
def test_removal_is_that_of_brute_force(spark, window, group, chunk):
    rng = random.Random(window)
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "ß,"]
    passages = [" ".join(rng.choices(vocabulary, k=k)) for k in (5, 19, 20, 21, 60)]
    docs = {}
    for i in range(120):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 40))) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(passages))
        docs[i] = rng.choice(["", " ", "\n"]).join([""]) + rng.choice([" ", "\t", "\n "]).join(parts)
    docs[50], docs[51], docs[52] = docs[3], None, ""
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(frame, window, group=group, chunk=chunk).collect()}
    assert got == _plain_removal(docs, window)


def test_removal_defined_cases(spark):
    long = " ".join(f"x{i}" for i in range(5000))
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, passage, "c"), (1, passage, "c"), (2, f"{passage} tail", "c"), (None, f"head {passage}", "c"), (3, long, "c"), (4, long, "c"), (5, None, "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = sorted((r.doc_id or 99, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(frame).collect())
    assert [g[:3] for g in got] == [(1, 30, 0), (1, 30, 0), (2, 31, 30), (3, 5000, 0), (4, 5000, 5000), (5, 0, 0), (99, 31, 30)]
    assert got[2][3] == "tail" and got[-1][3] == "head"
    assert substrings.remove_repeats(frame.limit(0)).count() == 0


def test_windows_agree_on_their_part():
    known = WordHashes()
    words = known.of([f"w{i % 37}".encode() for i in range(400)])
    *_, hashes, place, least = substrings.windows_of(words, np.array([150, 0, 10, 240]), 20)
    seen = {}
    for h, p, x in zip(hashes.tolist(), place.tolist(), least.tolist()):
        assert seen.setdefault(h, (p, x)) == (p, x)
    assert len(hashes) == 131 + 221
