"""Cases in which an operator once did less than the whole job."""

import pytest

import corpus_pipeline
from trialmill.llm import decontam, substrings, toxicity
from trialmill.llm.labelled import Row, labelled_sample


def test_items_without_an_id_are_found(spark):
    held = [" ".join(f"{k}{i}" for i in range(30)) for k in "abc"]
    docs = spark.createDataFrame([(1, f"x y {held[0]} z"), (2, f"{held[1]} q"), (3, "clean words"), (4, held[2])], "doc_id long, text string")
    items = spark.createDataFrame([(None, held[0]), (None, held[1]), (None, None), (7, held[2])], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.coverage) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, None, 1.0), (2, None, 1.0), (4, 7, 1.0)}
    assert [r.doc_id for r in decontam.drop_contaminated(docs, items).collect()] == [3]


def test_rows_without_an_id_are_told_apart_by_64_bits(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, long), (None, f"{long} more")], "doc_id long, text string")
    th = {r.th for r in substrings.repeated_windows(docs).select("th").collect()}
    known = {r.h for r in docs.selectExpr("xxhash64(text) AS h").collect()}
    assert th and th <= known
    items = spark.createDataFrame([(1, long)], "item_id long, text string")
    assert {r.th for r in decontam.contaminated(docs, items).collect()} == known


def test_a_text_beyond_the_budget_is_passed_over(spark):
    ids = [r.doc_id for r in spark.range(1, 80).selectExpr("id AS doc_id", "md5(cast(id AS string)) AS o").where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0").orderBy("o").collect()]
    texts = [(d, "x" * (500 if k == 0 else 10), "en") for k, d in enumerate(ids)]
    texts += [(ids[1], "y" * 10, "en")] * 3  # repeats of an id count once
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, k % 2) for k, d in enumerate(ids)], "doc_id long, toxic int")
    got, _ = labelled_sample(docs, labels, "toxic", 100, 200)
    assert got == [Row(b"x" * 10, k % 2, "en") for k in range(1, 21)]


def test_languages_beyond_the_most_frequent_share_the_overall_cut(monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_LANGUAGES", 2)
    sample = []
    for i in range(400):
        lang = ("aa", "bb", "cc", "dd")[0 if i % 10 < 5 else 1 if i % 10 < 8 else i % 10 - 6]
        sample.append(Row(f"{lang}one {lang}two {'bad' if i % 3 == 0 else 'good'} {lang}three".encode(), int(i % 3 == 0), lang))
    model = toxicity.fit(sample, 0.3, epochs=2)
    assert model.languages.shape[1] == len(model.cuts) == 3
    guess = [model.language_of(toxicity.lay_out([f"{x}one {x}two {x}three".encode()], toxicity.WordHashes()))[0] for x in ("aa", "bb", "cc", "dd")]
    assert guess == [0, 1, 2, 2]


@pytest.mark.parametrize("stage", ["mixing", "quality"])
def test_stages_keep_clashing_columns(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ["u", "size", "source_size", "target", "taken", "n_docs", "score", "predicted", "held_out", "_s", "_mine"]
    given = docs.selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, given, sf_dir)
    rows = got.collect()
    assert got.columns == given.columns and rows
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
