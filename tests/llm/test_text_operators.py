"""Page text, licence places, quality and toxicity: brute force, hand-made pages, held-out accuracy."""

import re
import zlib
from html import unescape

import pytest
from pyspark.sql import functions as F

from trialmill.llm import htmltext, licenses, quality, toxicity
from trialmill.llm.labelled import held_out, labelled_sample


def test_given_pages_give_their_article(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in htmltext.extract_pages(pages).collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br|article)>", article)
        want = " ".join(x for x in (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks) if x)
        assert r.text == want and r.n_chars == len(want)


PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body class="page-{n}"><header class=top>Site</header>
<div id="nav-main"><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></div>
<div class="layout col-{n}"><div class="body-text v{n}"><h2>Head &amp; title</h2><p>First <b>bo</b>ld,
   second&nbsp;line &#233;.<p>Another paragraph that is long enough to count for something here.
<ul><li>one<li>two</ul><script>var x = "</p><p>not text";</script><div class="ad-box">Buy!</div><table><tr><td>cell<td>next</table>
<!-- hidden <p>no</p> --><form><input><button>Send</button></form></div><aside>Side words, many of them, more than the text has.</aside></div>
<section class="comments"><p>A reader wrote a very long comment that goes on and on and on and on.</p></section>
<div class="cookieNotice">We use cookies, a lot of cookies, and this text is long.</div><footer>Foot</footer></body></html>"""
TEXT = "Head & title First bold, second line é. Another paragraph that is long enough to count for something here. one two cell next"


def test_a_page_of_divs():
    assert htmltext.extract(PAGE.format(n=1)) == TEXT


def test_hosts_agree_on_a_path(spark):
    shell = "<body><div class='story s{n}'>{text}</div><div class=extra>{extra}</div></body>"
    rows = [(i, f"http://h.example/{i}", shell.format(n=i, text="<p>" + "story words " * 20, extra="<p>more")) for i in range(20)]
    rows.append((99, "http://h.example/x", shell.format(n=7, text="<p>" + "story words " * 9, extra="<p>" + "extra stuff here " * 12)))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract_pages(frame).collect()}
    assert got[99] == ("story words " * 9).strip()
    assert htmltext.extract(rows[-1][2]) == ("extra stuff here " * 12).strip()  # alone, the page chooses otherwise
    paths = {r.host: r.path for r in htmltext.host_paths(frame).collect()}
    assert paths == {"h.example": "/body/div.s#.story"}


def test_pages_defined_cases(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no url", "plain &lt;text&gt;  only"), (4, "http://a.b/", "<p>open <i>never closed"),
            (5, "http://a.b/", "</div></p><<p>odd < 5 > 4"), (6, "http://a.b/", "<script>alert(1)"), (6, "http://a.b/", "<script>alert(1)"),
            (7, "http://user@A.b:80/x", "<div>" * 3000 + "deep " + "word " * 50000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in htmltext.extract_pages(frame).collect()]
    by = {g[0]: g[1] for g in got}
    assert len(got) == len(rows) and by[1] == by[2] == by[6] == "" and by[3] == "plain <text> only" and by[4] == "open never closed"
    assert by[7].startswith("deep word") and len(by[7].split()) == 50001
    assert all(n == len(t) for _, t, n in got)
    assert htmltext.extract_pages(frame.limit(0)).count() == 0


LONG = "Words of the article that go on. " * 12


@pytest.mark.parametrize("attribute", [
    'style="overflow:hidden"', 'title="hidden gems"', 'data-hidden="false"', "data-x='role=navigation'", 'data-url="/x?id=login"', "data-class=sidebar",
    'title="class=footer" class=text', "data-aria-hidden=true",
])
def test_only_real_attribute_names_count(attribute):
    assert htmltext.extract(f"<body><div {attribute}><p>{LONG}</div><p>x") == LONG.strip()
    assert htmltext.extract(f"<body><p>{LONG}<div hidden><p>a</div><div ROLE = 'navigation'>b</div><div id=login>c</div>") == LONG.strip()


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar", "hasSidebar", "header-fixed", "layout-left-sidebar", "page footer-dark"])
def test_a_noise_word_on_a_wrapper_keeps_the_article(name):
    box = "<div class=sidebar>Side words.</div><div class='ad-box'>Buy!</div>"
    page = f"<body><div class='{name}'>{box}<div class=text><h1>Head</h1><p>{LONG}</div></div><div class=small>Imprint</div></body>"
    assert htmltext.extract(page) == f"Head {LONG}".strip()
    assert htmltext.extract(f"<body><main><div class='{name}'><div class=navbar-top><p>{LONG}</div></div></main>") == LONG.strip()


def test_long_noise_by_name_stays_out():
    comments = "<div class=comment-list>" + f"<div class=comment><p>Reader says: {LONG}</div>" * 9 + "</div>"
    for article in (f"<article><p>{LONG}</article>", f"<div class=text><h1>Head</h1><p>{LONG}</div>"):
        assert "Reader" not in htmltext.extract(f"<body>{article}{comments}")


def test_all_of_a_path_is_extracted():
    for tag in ("div class=part", "section"):
        name = tag.split()[0]
        page = f"<body><div><{tag}><p>{LONG}</{name}><{tag}><p>Shorter part.</{name}></div>"
        path = f"/body/div/{name}.part" if " " in tag else f"/body/div/{name}"
        for host_path in (None, path):
            assert htmltext.extract(page, host_path) == f"{LONG}Shorter part."


def test_a_container_with_more_text_wins_over_its_best_part():
    lead = "A lead of some length. " * 5
    for page in (
        f"<body><div><h1>Head</h1><p>{lead}</p><div class=text><p>{LONG}</div></div>", f"<body><h1>Head</h1><p>{lead}</p><div><p>{LONG}</div>",
    ):
        root = htmltext.parse(page)
        for host_path in (None, htmltext.best_container(root).path):
            assert htmltext.extract(page, host_path) == f"Head {lead}{LONG}".strip()
    assert htmltext.extract(f"<body><div><div class=a><p>{LONG}</div><section class=b><p>{lead}</section></div>") == f"{LONG}{lead}".strip()
    assert htmltext.extract(f"<body><div><h1>Head</h1><div><p>{LONG}</div></div>") == f"Head {LONG}".strip()
    assert htmltext.extract(f"<body><div><div class=a><p>{LONG}</div><div class=b><a href=/>{LONG}</a></div></div>") == LONG.strip()


def test_math_and_xmp_are_text():
    page = f"<body><div><p>{LONG}<math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><xmp>a <b>&amp;</b></xmp><p>End.</div>"
    assert htmltext.extract(page) == f"{LONG}x=1 a <b>&amp;</b> End."


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _plain_places(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(s, label) for phrase, label in licenses.BASE_PHRASES.items() for s in range(len(words))
            if words[s : s + len(phrase.split())] == phrase.split()]
    starts = [s for s, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_places_are_those_of_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = [(-1, "The MIT License (mit license) -- MIT\nLICENSE cc by, CC-BY cc bye"), (-2, "mit license" * 3), (-3, None), (-4, ""),
             (-5, "GNU General Public License gnu general public license apacheé license apache license"), (None, "cc by"), (None, "cc by")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = licenses.digest(licenses.scan_licenses(docs)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, *_plain_places(r.text)) for r in docs.collect()), key=key) == sorted(
        ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key)
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert any(r.n_base for r in got)


def test_notices_need_their_key_phrases(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    rows = [(1, "x " * 50 + bsd), (2, bsd.replace("source and binary forms", "binary or source form")), (3, bsd.replace("with or", "with and or")),
            (4, bsd[: len(bsd) // 2]), (5, "Licensed under CC BY-NC 4.0."), (6, "This work is licensed under the GNU General Public License, version 3.")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, found string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.digest(licenses.scan_licenses(frame)).collect()}
    assert {i: g[0] for i, g in got.items()} == {1: "bsd", 2: "", 3: "bsd", 4: "", 5: "cc-by,cc-by-nc", 6: "gpl,gpl-3"}
    assert got[1][1] == 1.0 and got[2][1] == 0.0
    assert licenses.scan_licenses(frame.limit(0)).count() == 0


def test_rare_words_weigh_more(spark):
    frame = spark.createDataFrame([(i, "the license of the file") for i in range(20)] + [(99, "apache")], "doc_id long, text string")
    index = licenses.Index()
    found, n = licenses.document_frequencies(frame, index)
    assert n == 21 and found[b"license"] == 20 and found[b"apache"] == 1 and found[b"merchantability" if b"merchantability" in found else b"gnu"] == 0
    weights = dict(zip(found, licenses.idf(found, n)))
    assert weights[b"gnu"] > weights[b"apache"] > weights[b"license"]


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.1"


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.97), (toxicity, "toxic", 0.97)])
def test_held_out_accuracy(spark, larger, module, label, least):
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    model = module.train(docs, labels)
    got = module.classify(docs.join(labels, "doc_id"), model).where("held_out").select(label, "predicted", "score").collect()
    right = sum(r[label] == r.predicted for r in got) / len(got)
    assert right >= least and all(0 <= r.score <= 1 for r in got) and len(got) > 500


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_defined_cases(spark, module, label):
    rows = [(i, f"fine words number {i} in a row of words that go on", "en") for i in range(60)]
    rows += [(100 + i, f"vile trash {i} !!! vile trash !!!", "en") for i in range(60)]
    rows += [(900, None, None), (901, "", "en"), (None, "words without id", "en"), (900, None, None), (902, "word " * 30000, "en")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string")
    bad = 0 if label == "quality" else 1
    marks = [(i, bad if i and i >= 100 else 1 - bad) for i, *_ in rows if i is not None] + [(3, None), (None, 1), (5, 1 - bad), (7777, 1)]
    labels = spark.createDataFrame(marks, f"doc_id long, {label} int")
    model = module.train(docs, labels)
    got = module.classify(docs, model).collect()
    assert len(got) == len(rows) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32((str(r.doc_id) if r.doc_id is not None else "").encode()) % 5 == 0)
    for empty in (module.classify(docs.limit(0), model), module.classify(docs, module.train(docs, labels.limit(0)))):
        assert {r.score for r in empty.collect()} <= {0.0}


def test_only_learnable_rows_are_sampled(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.text for r in docs.join(labels.where(~held_out(F.col("doc_id"))), "doc_id").select("text").collect()}
    sample, rate = labelled_sample(docs, labels, "quality", 10**6, 10**9)
    assert {r.text.decode() for r in sample} <= texts and 0.5 < rate < 1
    small, _ = labelled_sample(docs, labels, "quality", 5, 10**9)
    assert len(small) == 10 and sum(r.label for r in small) == 5
    tight, _ = labelled_sample(docs, labels, "quality", 5, 2000)
    assert sum(len(r.text) for r in tight) <= 2000
