"""The streamed audit against a plain count over all orders, whatever files fall into which batch."""

import itertools
import random

from trialmill.llm import retraction
from trialmill.session import shared_dir


def _fails(text):
    words = text.replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
    }


def _plain(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(least.get(text or "", doc), doc)
    judged = []
    for doc, text, lang in rows:
        fails = _fails(text or "")
        fails["E"] = doc is not None and least[text or ""] < doc
        judged.append((lang or "", {f for f in fails if fails[f]}, doc in good, doc in toxic))
    first = {}
    for i, (_, fails, _, _) in enumerate(judged):
        for order in itertools.permutations("ABCDE"):
            hit = next((f for f in order if f in fails), None)
            first[i, hit] = first.get((i, hit), 0) + 1
    out = []
    for part in {j[0] for j in judged}:
        members = [(i, *j[1:]) for i, j in enumerate(judged) if j[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = members
            for step, letter in enumerate(order, 1):
                removed = [m for m in left if letter in m[1]]
                redundant = sum(letter in m[1] for m in members) - sum(letter in m[1] for m in left)
                left = [m for m in left if letter not in m[1]]
                out.append((
                    part, "".join(order), step, len(left), len(removed), redundant, sum(m[1] == {letter} for m in members),
                    sum(m[2] for m in removed), sum(m[3] for m in removed), sum(first.get((m[0], letter), 0) for m in members),
                ))
    return sorted(out)


def _fixture():
    rng = random.Random(6)
    long = " ".join(f"w{i}" for i in range(120))
    texts = [long, long + " #", "short", "SHORT TEXT", "", None, "same " * 150, "Ünï $", long.upper(), "a\nb | c"]
    ids = list(range(160))
    rng.shuffle(ids)
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in ids]
    rows += [(None, long, "en"), (None, None, None), (7, long, "en"), (7, long, "fr"), (7, "short", "en"), (-1, "short", "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 160, 3)] + [(3, 0, 1), (None, 1, 1), (7, 1, 0)]
    return rows, labels


def test_counts_equal_the_plain_audit(spark, tmp_path):
    rows, labels = _fixture()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = _plain(rows, labels)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, mask int")
    folder = str(tmp_path / "documents.parquet")
    for start in range(0, len(rows), 30):  # a file each, the last written holds the smallest ids
        spark.createDataFrame(rows[start : start + 30], "doc_id long, text string, lang string").coalesce(1).write.mode("append").parquet(folder)
    for files in (1, 4, None):
        counters = retraction.mask_counters(spark, folder, marks, files)
        assert sorted(map(tuple, retraction.filter_orders(counters).collect())) == want
    one = str(tmp_path / "one.parquet")
    frame.coalesce(1).write.parquet(one)
    assert sorted(map(tuple, retraction.filter_orders(retraction.mask_counters(spark, one, marks)).collect())) == want


def test_text_ids_and_empty_table(spark, tmp_path):
    rows = [("b", "same", "en"), ("a", "same", "en"), (None, "same", "en"), ("c", "other", "en")]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id string, text string, lang string").write.parquet(path)
    labels = spark.createDataFrame([("a", 1, 0)], "doc_id string, quality int, toxic int")
    found = {(r["mask"], r["good"]): r["n"] for r in retraction.mask_counters(spark, path, labels, 1).collect() if r["n"]}
    assert found == {(1, False): 2, (1, True): 1, (17, False): 1}
    empty = str(tmp_path / "e.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(empty)
    assert retraction.filter_orders(retraction.mask_counters(spark, empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_nothing_of_the_stream_stays(spark, tmp_path):
    import os

    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string").write.parquet(path)
    retraction.mask_counters(spark, path, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count()
    assert not [f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("trialmill-audit-")]
