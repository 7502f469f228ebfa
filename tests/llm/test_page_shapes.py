import pytest

from trialmill.llm.htmltext import extract

WORDS = "The river rises early in the year and the mills along it grind through the night until the water falls again."


def page(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


@pytest.mark.parametrize("inner", ["<h1>River</h1><p>{0}</p><p>{0}</p>", "<div class=post><p>{0}</p><p>{0}</p></div>",
                                   "<div id=c><article><h1>River</h1><p>{0}</p></article></div>"])
def test_a_form_around_the_page_keeps_the_main_text(inner):
    form = ("<form id=aspnet action=/x><input type=hidden value=1><nav><a href=/>Home</a></nav>" + inner.format(WORDS)
            + "<label>Your mail</label><select><option>One</option></select><button>Send</button></form>")
    got = extract(page(f"<header>Site</header>{form}<footer>Imprint</footer>"))
    assert got in (f"River {WORDS} {WORDS}", f"{WORDS} {WORDS}", f"River {WORDS}")


@pytest.mark.parametrize("role", ["", " role=form"])
def test_a_form_beside_the_main_text_goes(role):
    tag = "div" if role else "form"
    form = f"<{tag}{role}><label>Mail</label><p>Get our letter</p><p>every single week</p><button>Go</button></{tag}>"
    assert extract(page(f"<article><h1>River</h1><p>{WORDS}</p>{form}</article>")) == f"River {WORDS}"
    assert extract(page(f"<div class=text><p>{WORDS}</p></div>{form}")) == WORDS


def test_a_page_of_controls_is_empty():
    assert extract(page("<form><label>Name</label><input><button>Log in</button> Forgotten?</form>")) == ""


@pytest.mark.parametrize("name,block", [("share-price-table", "<table><tr><td>Mill</td><td>12</td></tr></table>"),
                                        ("related-work", f"<p>{WORDS}</p>"), ("socialHistory", f"<p>{WORDS}</p>")])
def test_a_word_that_starts_a_longer_name_keeps_text(name, block):
    want = "Mill 12" if "table" in name else WORDS
    for outer in ("main", "article"):
        assert extract(page(f"<{outer}><h1>River</h1><p>{WORDS}</p><div class='{name}'>{block}</div></{outer}>")) == f"River {WORDS} {want}"


@pytest.mark.parametrize("name,block", [
    ("related-posts", f"<p>{WORDS}</p>"), ("related", f"<p>{WORDS}</p>"), ("post-comments", f"<p>{WORDS}</p>"), ("ad-slot", f"<p>{WORDS}</p>"),
    ("share-this", "<a href=/a>Tell a friend about it</a>"), ("cookie-policy", f"<p>{WORDS}</p>"), ("share-price", "Tell others")])
def test_additions_by_name_still_go(name, block):
    assert extract(page(f"<main><h1>River</h1><p>{WORDS}</p><div class='{name}'>{block}</div></main>")) == f"River {WORDS}"


@pytest.mark.parametrize("first,second", [("div class=post", "div class=post2"), ("div class=post", "div class='post last'"),
                                          ("article", "article class=b"), ("section class=part-1", "section class=part")])
def test_siblings_of_like_kind_are_one_text(first, second):
    end = f"</{first.split()[0]}>"
    parts = f"<{first}><p>{WORDS}</p><p>{WORDS}</p>{end}<{second}><p>{WORDS}</p>{end}"
    assert extract(page(f"<div id=x>{parts}</div>")) == " ".join([WORDS] * 3)


def test_layout_columns_and_teasers_are_no_siblings():
    columns = f"<div class='col wide'><p>{WORDS}</p><p>{WORDS}</p></div><div class='col small'><p>Also of note today in short</p></div>"
    assert extract(page(f"<div class=row>{columns}</div>")) == f"{WORDS} {WORDS}"
    teaser = "<article class=teaser><p>Read on</p></article>"
    assert extract(page(f"<article class=post><p>{WORDS}</p><p>{WORDS}</p></article>{teaser}")) == f"{WORDS} {WORDS}"
