"""Extra columns under names that operators use inside, and vectors of any finite size."""

import pytest
from pyspark.sql import functions as F

from trialmill.llm import decontam, htmltext, mixing, simhash, topk

NAMES = [
    "n_docs", "_s", "_w", "_classes", "_mine", "_host", "_path", "_page_host", "_doc", "_th", "_best", "_row_text", "th", "root", "host", "path",
    "u", "_copy", "k", "weight", "border", "fp",
]


def _with_names(frame):
    return frame.withColumns({c: F.lit(f"own {c}") for c in NAMES})


def _kept(frame):
    rows = frame.select(*NAMES).distinct().collect()
    return len(rows) == 1 and list(rows[0]) == [f"own {c}" for c in NAMES]


def test_documents_keep_extra_columns(spark):
    docs = _with_names(spark.createDataFrame(
        [(i, f"word{i % 7} some more words of document {i % 5} " * 6, "s1") for i in range(20)], "doc_id long, text string, source string"))
    mixed = mixing.pareto_mix(docs)
    assert _kept(mixed) and _kept(mixing.repeat_rows(mixed)) and mixed.count() == 20
    assert mixed.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    assert _kept(simhash.keep_one(docs)) and simhash.keep_one(docs).columns == docs.columns
    items = spark.createDataFrame([(1, "word0 some more words of document 0 " * 6)], "item_id long, text string")
    clean = decontam.drop_contaminated(docs, items)
    assert _kept(clean) and clean.columns == docs.columns and 0 < clean.count() < 20


def test_added_columns_replace_input_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", -1, -2.0)], "doc_id long, text string, source string, size int, taken double")
    assert mixing.pareto_mix(docs).select("size").first()[0] == 3
    pages = _with_names(spark.createDataFrame([(1, "http://h/a", "<article><p>Hello there.</p></article>")], "page_id long, url string, html string"))
    found = htmltext.extract_pages(pages)
    assert _kept(found) and found.first()["text"] == "Hello there."


@pytest.mark.parametrize("size", [1.0, 2e6, 3e6, 1e8, 1e12, 1e30])
def test_top_k_of_large_components(spark, size):
    vectors = [(i, [((i * 7919) % 23 - 11) * size / 16, float(i % 5), 0.25 * (i % 3)]) for i in range(60)] + [(100, [0.5, 0.5, 0.5])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    whole = {i: [max(-2**63, min(2**63 - 1, int((1024 * x) // 1))) for x in v] for i, v in vectors}
    want = []
    for q in (0, 20, 40, 100):
        ranked = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(whole[q], whole[c])))), c) for c in whole if c != q)
        want += [(q, r, c, -s) for r, (s, c) in enumerate(ranked[:10], 1)]
    got = sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 20 == 0).collect()))
    assert got == want if size < 1e30 else len(got) == len(want)
