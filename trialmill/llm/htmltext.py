"""Main text of HTML pages by consensus host paths.

Every page scores its containers: text that is not links, and paragraphs, count for a container and
half for the one around it; one with markedly more of it than the best container in it scores no less
than that.  The best container votes, with its score, for its path: the tags and
classes down to it with digits generalised.  Spark adds the votes up by host; a page is extracted again
at its host's winning path, or at its own best path where it lacks that path or has little there.
Siblings of like kind (articles, or one tag and first class) with much text belong to what is extracted.

Navigation, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments count
nowhere and are cut out; an element that is one of these only by a word of its class or id stays if it
holds the page's main text, and so does a form around the whole page, without its controls.  Within
article and main a word that starts a longer name ("related-work") cuts only what is mostly links or short.  Character references are decoded, blocks are joined by one space.

Defined cases: null and empty html give the empty text; a page without tags is its own text; pages
without a host vote together; unclosed, stray and crossed tags close as browsers do for blocks; long
pages are read whole; repeated rows give equal results; columns that clash with added ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import escape, unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trialmill.llm.common import chunks, cut_lineage, fresh, join_written, shielded, utf8

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul xmp".split()
)
CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
#: Start tags that end an open element of the same line, up to the nearest of the second list.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)),
    "option": (("option",), ("select",)), "body": (("head",), ("html",)),
}
CLOSES_P = BLOCK - frozenset("br caption body head html legend li dd dt option optgroup tbody td tfoot th thead tr summary".split())
#: What is no main text, by tag, by role and by a word of class or id.
NOISE_TAGS = frozenset("aside button datalist dialog footer form head header iframe input label legend menu nav noscript optgroup option output "
    "script select style svg template textarea title".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NOISE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup promo promoted promotion related replies search share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar".split()
)

#: Of these, those that have other meanings at the start of a longer name.
LOOSE_WORDS = frozenset(
    "banner comment header login menu modal navigation notice notices notification pager promotion related replies search "
    "share sharing social subscribe toolbar".split()
)
#: Parts of names that say that a block is an addition to the page.
WIDGET_WORDS = frozenset(
    "area articles bar block body box button buttons container content count entries feed form group icon icons inner item items "
    "link links list media module news panel post posts row section story stories text widget widgets wrap wrapper".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
#: A container that holds this much more text than the best inside wins over it.
MORE = 1.2
#: A sibling belongs to the main text from this share of its score on.
SIBLING = 0.25
DIGITS = re.compile(r"\d+")
NUMBER = re.compile(r"[-_]*\d+")
#: First classes that say nothing about what a block is.
LAYOUT = frozenset("block box cell col column columns container flex grid inner item row section span wrap wrapper".split())
PARTS = re.compile(r"[a-z]+", re.I)
#: Says of a wrapper what it holds or lacks, not what it is.
HOLDS = re.compile(r"(?<![a-z])(?:no|not|has|with|without)[-_]*(?=[A-Z]|(?<=[-_])[a-z])[a-zA-Z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Node:
    __slots__ = ("tag", "parent", "path", "kind", "noise", "named", "loose", "items", "score")

    def __init__(self, tag: str, parent: Node | None, path: str, noise: bool) -> None:
        self.tag, self.parent, self.path, self.noise = tag, parent, path, noise
        self.kind = ""  # the first class without numbers
        self.named = False  # noise by a word of class or id, until `_settle` has looked at the whole page
        self.loose = False  # only the start of a longer name within the main text says that it is noise
        self.items: list = []  # texts and child nodes in page order
        self.score = 0.0


def _attributes(text: str) -> dict[str, str]:
    """Name to value; of a repeated name the first counts."""
    return {m[0].lower(): m[1] or m[2] or m[3] for m in reversed(ATTRIBUTE.findall(text))}


@lru_cache(1024)
def _by_name(names: str) -> tuple[bool, bool]:
    """Whether a word of class or id says noise, and whether only words at the start of longer names do."""
    named, loose = False, True
    for name in HOLDS.sub(" ", names).split():
        words = [w.lower() for w in PARTS.findall(CAMEL.sub(" ", name))]
        for i, word in enumerate(words):
            if word in NOISE_WORDS:
                named = True
                loose &= word in LOOSE_WORDS and i + 1 < len(words) and WIDGET_WORDS.isdisjoint(words)
    return named, named and loose


def _start(tag: str, attributes: str, parent: Node) -> Node:
    wraps = tag == "form" and parent.parent is not None
    noise = parent.noise or tag in NOISE_TAGS and not wraps
    named = loose = False
    label, kind = tag, ""
    if attributes.strip():
        found = _attributes(attributes)
        name = unescape(found.get("class", ""))
        if name:
            label += "." + ".".join(sorted(DIGITS.sub("#", name).split()))
            kind = (NUMBER.sub("", name).split() or [""])[0].lower()
        if not noise and tag not in ("html", "body", "main", "article"):
            named, loose = _by_name(f"{name} {unescape(found.get('id', ''))}")
            noise = found.get("role", "").lower() in NOISE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    node = Node(tag, parent, f"{parent.path}/{label}", noise)
    node.kind = kind
    node.named = (named or wraps) and not noise
    node.loose = loose and not wraps and _within_main(parent)
    return node


def _within_main(node: Node) -> bool:
    while node.parent is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node.parent is not None


def _prose(top: Node) -> bool:
    """Whether a block is neither mostly links nor short: paragraphs and table cells are not short."""
    plain = links = 0
    prose = False
    stack = [(top, False)]
    while stack:
        node, linked = stack.pop()
        prose |= node.tag in ("p", "td", "th", "pre", "blockquote")
        for item in node.items:
            if isinstance(item, str):
                size = len(item) - sum(map(item.count, " \t\r\n"))
                plain, links = (plain, links + size) if linked else (plain + size, links)
            elif item is not None and not item.noise:
                stack.append((item, linked or item.tag == "a"))
    return plain > links and (prose or plain >= 80)


def _settle(root: Node, named: list[Node]) -> None:
    """Make noise of the elements that are noise by name, but for those that hold the page's main text.

    Text belongs to the nearest such element around it.  One with more text than all that is kept is a
    wrapper, if the page has no other main element and either only it has a headline or hardly anything is kept.
    """
    for node in named:
        if node.loose and _prose(node):
            node.named = False
    named = [n for n in named if n.named]
    paragraphs = dict.fromkeys((id(n) for n in named if n.tag == "form"), 0)
    text = dict.fromkeys(map(id, [root, *named]), 0)
    heads: dict[int, set[str]] = {k: set() for k in text}
    marks: list[tuple[Node, int]] = []  # article and main with the element they are kept by
    stack = [(root, root, False)]
    while stack:
        node, owner, linked = stack.pop()
        if node.noise:
            continue
        owner, linked = node if node.named else owner, linked or node.tag == "a"
        if node.tag == "p" and id(owner) in paragraphs:
            paragraphs[id(owner)] += 1
        if node.tag in ("h1", "main", "article"):
            heads[id(owner)].add(node.tag)
            if node.tag != "h1":
                marks.append((node, id(owner)))
        if not linked:
            text[id(owner)] += sum(len(x) - sum(map(x.count, " \t\r\n")) for x in node.items if isinstance(x, str))
        stack.extend((x, owner, linked) for x in node.items if isinstance(x, Node))
    kept, rest = {id(root)}, named
    while True:
        rest = [n for n in rest if n.named]
        # a form is a wrapper only if it has more of a page than controls
        able = [n for n in rest if n.tag != "form" or heads[id(n)] or paragraphs[id(n)] > 1]
        most = max(able, key=lambda n: text[id(n)], default=None)
        have = sum(text[k] for k in kept)
        if most is None or text[id(most)] <= have:
            break
        size, above, up = text[id(most)], set(), most
        while up is not None:
            above.add(id(up))
            up = up.parent
        other = any(k in kept and id(m) not in above and _has_text(m) for m, k in marks)
        headed = any("h1" in heads[k] for k in kept)
        wraps = have * 20 < size or not headed and (have * 4 < size or bool(heads[id(most)]))
        if have and (other or not wraps):
            break
        node = most
        while node is not None:
            if node.named:
                node.named = False
                kept.add(id(node))
            node = node.parent
    for node in rest:
        node.noise = True


def _has_text(top: Node) -> bool:
    """Whether there is text in an element, noise and what may be noise by name apart."""
    stack = [top]
    while stack:
        for item in stack.pop().items:
            if isinstance(item, str):
                if not item.isspace():
                    return True
            elif item is not None and not item.noise and not item.named:
                stack.append(item)
    return False


def parse(html: str) -> Node:
    """The page as a tree; raw elements lose their content, that of xmp is text as it stands."""
    root = at = Node("", None, "", False)
    named: list[Node] = []
    position, size, lower = 0, len(html), None
    search = TOKEN.search
    while position < size:
        found = search(html, position)
        if not found:
            at.items.append(html[position:])
            break
        if found.start() > position:
            at.items.append(html[position : found.start()])
        position = found.end()
        end, tag, attributes = found.groups()
        if end:
            end = end.lower()
            node = at
            while node.parent is not None and node.tag != end:
                node = node.parent
            if node.parent is not None:
                at = node.parent
                if end in BLOCK:
                    at.items.append(None)
            elif end in ("p", "br"):
                at.items.append(None)
        elif tag:
            tag = tag.lower()
            if tag in RAW or tag == "xmp":
                lower = html.lower() if lower is None else lower
                stop = lower.find(f"</{tag}", position) if tag == "xmp" or not attributes.rstrip().endswith("/") else position
                start, position = position, size if stop < 0 else stop
                if tag == "xmp":
                    at = _implied(at, tag)
                    node = _start(tag, attributes, at)
                    node.items.append(escape(html[start:position]))
                    at.items.append(node)
                    if node.named:
                        named.append(node)
                if stop >= 0 and (closing := search(html, position)) and closing.start() == position:
                    position = closing.end()
                continue
            if tag in VOID:
                if tag in BLOCK:
                    at.items.append(None)
                continue
            if tag in CLOSES_P or tag in ENDS:
                at = _implied(at, tag)
            node = _start(tag, attributes, at)
            at.items.append(node)
            at = node
            if node.named:
                named.append(node)
    if named:
        _settle(root, named)
    return root


def _implied(at: Node, tag: str) -> Node:
    """Where a start tag goes once it has ended what it ends."""
    names, stops = ENDS.get(tag, (("p",), ("table", "td", "th", "button")))
    if tag in CLOSES_P:
        names, stops = ("p",), ("table", "td", "th", "button")
    node = at
    while node.parent is not None and node.tag not in stops:
        if node.tag in names:
            return node.parent
        node = node.parent
    return at


def _scored(root: Node) -> list[Node]:
    """Containers in page order, each with the score of the text in and just below it."""
    order: list[Node] = []
    sizes: dict[int, list[int]] = {}  # plain text and link text
    stack = [(root, False)]
    while stack:
        node, linked = stack.pop()
        if node.noise:
            continue
        linked = linked or node.tag == "a"
        order.append(node)
        sizes[id(node)] = size = [0, 0]
        for item in node.items:
            if isinstance(item, str):
                size[linked] += len(item) - item.count(" ")
        stack.extend((x, linked) for x in reversed(node.items) if isinstance(x, Node))
    containers = [n for n in order if n.tag in CONTAINERS or n is root]
    headed: set[int] = set()  # has a headline outside the containers in it
    whole: dict[int, int] = {}  # plain text with that of the containers in it
    inside: dict[int, tuple[float, int]] = {}  # score and plain text of the best container in it
    for node in reversed(order):  # children come before what is around them
        text, links = sizes[id(node)]
        up = node.parent
        if node.tag not in CONTAINERS and node is not root:
            carry = sizes[id(up)]
            carry[0] += text
            carry[1] += links
            up.score += node.score
            whole[id(up)] = whole.get(id(up), 0) + whole.get(id(node), 0)
            if id(node) in inside:
                inside[id(up)] = max(inside.get(id(up), (0.0, 0)), inside[id(node)])
            if node.tag == "h1" and text > links or id(node) in headed:
                headed.add(id(up))
        else:
            own = max(0, text - links)
            node.score += own
            mine = whole.get(id(node), 0) + own
            score, most = inside.get(id(node), (0.0, 0))
            # the body and the table parts hold what is not of one piece: there only text of their own speaks for them
            plain = node.tag in ("div", "section")
            if most and ((mine if plain else most + own) >= MORE * most or plain and id(node) in headed):
                node.score = max(node.score, score)
            if up is not None:  # half of a container's score goes to the one around it
                up.score += node.score / 2
                whole[id(up)] = whole.get(id(up), 0) + mine
                inside[id(up)] = max(inside.get(id(up), (0.0, 0)), (score, most), (node.score, mine))
    for node in containers:
        if node.tag in ("article", "main"):
            node.score *= 3
    return containers


def best_container(root: Node) -> Node:
    containers = _scored(root)
    return max(containers, key=lambda n: n.score)


def text_of(nodes: list[Node]) -> str:
    blocks: list[str] = []
    pieces: list[str] = []

    def close() -> None:
        if pieces:
            if block := " ".join(unescape("".join(pieces)).split()):
                blocks.append(block)
            pieces.clear()

    for top in nodes:
        stack: list = [top]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                pieces.append(item)
            elif item is None:
                close()
            elif not item.noise:
                if item.tag in BLOCK:
                    close()
                    stack.append(None)
                stack.extend(reversed(item.items))
        close()
    return " ".join(blocks)


def extract(html: str, host_path: str | None = None, least: float = 0.3) -> str:
    """Main text of all at the host's path, or at the page's best path if that path has under `least` of its score."""
    root = parse(html)
    containers = _scored(root)
    best = max(containers, key=lambda n: n.score)
    if host_path and host_path != best.path:
        voted = [n for n in containers if n.path == host_path]
        if sum(n.score for n in voted) >= least * best.score:
            return text_of(_with_siblings(voted, containers))
    return text_of(_with_siblings([n for n in containers if n.path == best.path], containers))


def _with_siblings(chosen: list[Node], containers: list[Node]) -> list[Node]:
    """The chosen containers and their siblings of like kind with much text, in page order."""
    marks: dict[tuple, float] = {}
    for node in chosen:
        if node.tag == "article" or node.kind and node.kind not in LAYOUT:
            key = (id(node.parent), node.tag, "" if node.tag == "article" else node.kind)
            marks[key] = max(marks.get(key, 0.0), node.score)
    ids = set(map(id, chosen))

    def like(node: Node) -> bool:
        most = marks.get((id(node.parent), node.tag, "" if node.tag == "article" else node.kind))
        return most is not None and 0 < SIBLING * most <= node.score

    return [n for n in containers if id(n) in ids or marks and like(n)]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def page_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): scores of the best containers, added up by host and path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls = utf8(batch.column(1))
            for part in chunks(htmls):
                best = [best_container(parse(h.decode())) for h in htmls[part.start : part.stop]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, len(part)), pa.array([b.path for b in best]), pa.array([b.score for b in best], pa.float64())],
                    names=["host", "path", "score"],
                )

    votes = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "host string, path string, score double"
    )
    # a page's vote is bounded, so that no long page decides for its host
    return votes.groupBy("host", "path").agg(F.sum(F.log1p("score")).alias("votes"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the winning path of each host; equal votes go to the smaller path."""
    best = F.max(F.struct(F.round("votes", 6).alias("votes"), F.col("path")))
    return page_votes(pages).groupBy("host").agg(best.alias("_best")).select("host", F.col("_best.path").alias("path"))


@shielded("url", "html")
def extract_pages(pages: DataFrame) -> DataFrame:
    """`pages` with text (the main text) and n_chars, its code points."""
    pages = pages.drop("text", "n_chars")
    paths = cut_lineage(host_paths(pages).select(F.col("host").alias("_host"), F.col("path").alias("_path")))
    host = fresh(pages, "_page_host")
    known = join_written(pages.withColumn(host, host_of(F.col("url"))), paths, F.col(host) == F.col("_host"), "left")

    def run(arrays: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for html, path in arrays:
            yield pa.array([extract(h.decode(), p) for h, p in zip(utf8(html), path.to_pylist())], pa.string())

    look = F.arrow_udf(run, "string")
    done = known.withColumn("text", look(F.col("html").cast("string"), F.col("_path")))
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*pages.columns, "text", "n_chars")
