"""Main text of web pages by tree scoring.

A tokenizer walks the tags once and keeps a stack of open elements, with the end tags that HTML
leaves out (a new block ends an open paragraph, a list item the one before). Elements whose tag says
that they aren't the article, and hidden ones, are left out with all they hold. So are those that are marked by
their class, id or role as readers' comments, and, where something unmarked has a paragraph of prose, all other marked ones too, however much they hold. But one whose mark only
names a part of the layout stays if it holds most of the page's prose and all of its articles and headlines of the first level; and if nothing unmarked has prose, one that
holds most of it stays. Such an element has half its points, gives none to what holds it, and is left out only if another container is better.
Every paragraph gives points to its parent, and half as many to its grandparent: one, one for each
comma, and one for each 100 characters up to three; a container's points are discounted by the share
of its text inside links. The best container is the article; a sibling of it stays if its
own points are near the best's, if it is a paragraph of prose, or a headline of the first level before the best. The blocks of what is kept are
joined in page order.

Defined cases: a null or empty page, and one without text outside what its tags leave out, has the text
''; one with text in marked elements only is extracted without regard to marks. Pages cut off inside a tag, comment or reference lose that tag or comment only. Repeated rows are
each extracted. Ties between containers go to the one that begins first. A page is walked once, and what an element inherits or
sums up is passed along the elements in their order, so time is linear in the page however deep it is nested; extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import bound_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)*+)(?:>|\Z)", re.S)
RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg", "title")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that never hold the article's text.
OUT = frozenset("nav header footer aside form script style noscript iframe textarea select button template svg canvas object head title menu dialog map audio video fieldset datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p pre td blockquote dd li h1 h2 h3 h4 h5 h6 figcaption dt".split())
HOLDS = frozenset("article body main section div td blockquote center".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = frozenset("ul ol dl table body html article section div main aside nav footer header".split())
P_BOUNDS = BOUNDS | {"p", "td", "th", "li", "blockquote"}
#: Words in a class, id or role that mark menus, adverts, notices, comments and the like.
NOISE = re.compile(
    r"(?:^|[\s_-])(?<!\bno[_-])(?<!\bhas[_-])(?<!\bnot[_-])(?<!\bnon[_-])(?<!\bwith[_-])(?<!\bwithout[_-])(?!tags?[_-]\w)(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|side-?bar|rail|(?<!elementor-)widget|footer|foot|header|masthead|comments?|comment-?list|disqus|replies|respond|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|toolbar|pagination|pager|skip|hidden|tags?|navigation|contentinfo|complementary|search)(?=$|[\s_-])",
    re.I,
)
#: Of these, what readers wrote, which is never the article; and what names a page's layout, which may hold it.
READERS = re.compile(r"comments?|comment-?list|disqus|replies|respond", re.I)
LAYOUT = re.compile(r"header|foot|footer|masthead|side-?bar|rail|widget|banner|social|toolbar|search|tags?|hidden", re.I)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")
HEADLINES = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "up", "out", "points", "chars", "linked", "order", "marked", "prose", "heads", "holder", "host", "state")

    def __init__(self, tag: str, up: Node | None, out: bool, order: int, marked: str = ""):
        self.tag, self.up, self.out, self.order, self.marked = tag, up, out, order, marked
        self.points, self.chars, self.linked, self.prose, self.heads = 0.0, 0, 0, 0, 0
        # the nearest element, from this one up, that can be a container, and the nearest that isn't prose itself
        self.holder: Node | None = self if tag in HOLDS else up and up.holder
        self.host: Node | None = self if tag in HOLDS and tag not in PROSE else up and up.host
        self.state = ""


def _marked(tag: str, attrs: str) -> tuple[bool, str]:
    """Whether an element is hidden, and how its class, id or role marks it: '', 'layout', 'noise' or 'readers'."""
    if not attrs or tag in ("html", "body", "article", "main"):
        return False, ""
    words: list[str] = []
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            words += (w[0].strip(" \t\n\f\r_-") for w in NOISE.finditer(value))
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and UNSHOWN.search(value):
            return True, ""
    if not words:
        return False, ""
    return False, "readers" if any(map(READERS.fullmatch, words)) else "layout" if all(map(LAYOUT.fullmatch, words)) else "noise"


class Open:
    """The open elements, with the places of each tag and group of tags among them, so that nothing is looked for by walking."""

    def __init__(self, root: Node):
        self.stack, self.at, self.links = [root], {}, 0
        self.groups = {"bounds": [], "p_bounds": [], "block": []}

    def push(self, node: Node) -> None:
        k, tag = len(self.stack), node.tag
        self.stack.append(node)
        self.at.setdefault(tag, []).append(k)
        for name, tags in (("bounds", BOUNDS), ("p_bounds", P_BOUNDS), ("block", BLOCK)):
            if tag in tags:
                self.groups[name].append(k)
        self.links += tag == "a"

    def close(self, k: int) -> None:
        """End the element at place k and all inside it."""
        while len(self.stack) > k:
            tag = self.stack.pop().tag
            self.at[tag].pop()
            self.links -= tag == "a"
        for places in self.groups.values():
            while places and places[-1] >= k:
                places.pop()

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else 0

    def nearest(self, group: str) -> int:
        places = self.groups[group]
        return places[-1] if places else 0


def parsed(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All elements in order, and (element, text, characters in links) of each run of text between block borders, outside hidden elements and those that their tag leaves out."""
    root = Node("#", None, False, 0)
    nodes, out, open_ = [root], [], Open(root)
    stack = open_.stack
    texts: list[str] = []
    linked: list[str] = []
    owner = root

    def flush() -> None:
        if texts:
            text = SPACE.sub(" ", html.unescape("".join(texts))).strip()
            if text:
                out.append((owner, text, len(SPACE.sub(" ", html.unescape("".join(linked))).strip())))
            texts.clear()
            linked.clear()

    def say(text: str) -> None:
        nonlocal owner
        if text and not stack[-1].out:
            if not texts:
                owner = stack[open_.nearest("block")]
            texts.append(text)
            if open_.links:
                linked.append(text)

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            cut = rest.rfind("<")  # an unended tag at the end of a page that was cut off
            say(rest[:cut] if cut >= 0 and re.match(r"<[/!?a-zA-Z]", rest[cut:]) else rest)
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            if m["cdata"]:
                say(html.escape(m["cdata"]))
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag in BLOCK:
                flush()
            if tag == "br":
                say(" ")
            k = open_.last(tag)
            if k and (tag in BOUNDS or open_.nearest("bounds") < k):
                open_.close(k)
            continue
        if tag == "br":
            say(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            end = RAW[tag].search(page, at)
            if tag not in OUT:
                say(page[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        if tag in BLOCK:
            flush()
            k = open_.nearest("p_bounds")  # a new block ends an open paragraph
            if k and stack[k].tag == "p":
                open_.close(k)
        if tag in ENDS:
            k = max(map(open_.last, ENDS[tag]))
            if k > open_.nearest("bounds"):
                flush()
                open_.close(k)
        up = stack[-1]
        hidden, marked = _marked(tag, m["attrs"])
        node = Node(tag, up, up.out or tag in OUT or hidden, len(nodes), marked)
        nodes.append(node)
        if m["attrs"].endswith("/") and tag not in BLOCK:
            continue
        open_.push(node)
    flush()
    return nodes, out


def extract(page: str | None) -> str:
    """The main text of one page."""
    nodes, blocks = parsed(page or "")
    for node, text, linked in blocks:
        node.prose += len(text) - linked
    inside, main = [False] * len(nodes), [False] * len(nodes)  # a marked element, an article
    for x in nodes[1:]:
        inside[x.order] = inside[x.up.order] or bool(x.marked)
        main[x.order] = main[x.up.order] or x.tag in ("article", "main")
        x.heads += x.tag in ("article", "main", "h1") and not x.out
    for x in reversed(nodes[1:]):
        x.up.prose += x.prose
        x.up.heads += x.heads
    # a paragraph of prose, or a sentence of an article, that nothing marks
    plain = any(not inside[b.order] and len(text) > (40 if main[b.order] else 80) and linked < 0.25 * len(text) and b.tag not in HEADLINES for b, text, linked in blocks)

    def may_hold(x: Node) -> bool:
        """Whether a marked element may hold the article all the same."""
        most = 2 * x.prose > nodes[0].prose
        if plain:
            return most and x.marked == "layout" and 0 < x.heads == nodes[0].heads
        return most and x.marked != "readers"

    minor = [False] * len(nodes)
    for x in nodes[1:]:
        minor[x.order] = minor[x.up.order] or bool(x.marked) and not may_hold(x)
    return article(nodes, [b for b in blocks if not minor[b[0].order]], True) or article(nodes, blocks, False)


def article(nodes: list[Node], blocks: list[tuple[Node, str, int]], marks: bool) -> str:
    """The text of the best container of the blocks; with `marks`, marked elements count less."""
    if not blocks:
        return ""

    def border(x: Node) -> bool:
        return marks and x.marked and x.tag in HOLDS and x.tag not in PROSE

    for x in nodes:
        x.points, x.chars, x.linked = 0.0, 0, 0
    held: dict[int, Node] = {}
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += linked
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        near = node.host
        far = near.up.holder if near is not None and near.up is not None and not border(near) else None
        for x, share in ((near, 1.0), (far, 0.5)):
            if x is not None:
                x.points += points * share
                held[x.order] = x
    if not held:
        return " ".join(t for _, t, _ in blocks)
    for x in reversed(nodes[1:]):
        x.up.chars += x.chars
        x.up.linked += x.linked
    under = [False] * len(nodes)
    for x in nodes[1:]:
        under[x.order] = under[x.up.order] or border(x)

    def score(x: Node) -> float:
        return x.points * (1 - x.linked / max(x.chars, 1)) * (0.5 if under[x.order] else 1.0) + (1e-9 if x.tag in ("article", "main") else 0)

    best = max(held.values(), key=lambda x: (score(x), -x.order))
    x, inner = best.up, best
    while x is not None and best.tag not in ("article", "main"):  # sections of one article are read together
        if x.tag in ("article", "main"):
            best = x
        x = x.up
    way = set()  # marks between the best container and its article cut nothing
    while inner is not best:
        way.add(inner.order)
        inner = inner.up
    least = max(10.0, score(best) * 0.2)

    for x in nodes:
        if x is best:
            x.state = "in"
        elif border(x) and x.order not in way:
            x.state = "out"
        elif x.up is not None and x.up is best.up:
            if x.order in held and score(x) >= least or x.tag == "h1" and x.order < best.order and not x.linked:
                x.state = "in"
            else:
                x.state = "prose" if x.tag == "p" else "out"
        else:
            x.state = x.up.state if x.up is not None else "out"

    def kept(node: Node, text: str, linked: int) -> bool:
        if node.state == "prose":  # a paragraph beside the best container
            return len(text) > 80 and linked < 0.25 * len(text) or not linked and bool(re.search(r"\.( |$)", text))
        return node.state == "in"

    return " ".join(t for b, t, n in blocks if kept(b, t, n))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row per page."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
