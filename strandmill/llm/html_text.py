"""Main-text extraction by tag-path ratios.

A page is tokenised once into blocks, each with its root-to-leaf tag path (an
interned number). Per path, text length outside links and punctuation are
aggregated over its blocks and divided by their number; both ratios are
smoothed over the blocks in page order and averaged per path again, fused by
multiplication, and the paths that reach a share of the page's mean are content
paths: a heading or a short line between paragraphs is lifted by its
neighbours, a menu is not. Content nodes are the blocks of content paths, and
the plain (not mostly linked) blocks that lie among them in their container.
An article or main element that holds most of the content text bounds the
selection; elsewhere it plays no part.

Before that, elements that are boilerplate by their tag or role go (navigation,
asides, footers, hidden ones), and those whose class or id says so: a whole
class name, or one made of such words and neutral ones. A class name or form
that wraps nearly all text is ignored. A word for comments counts among any
other words, unless the element holds most of the page's text. Legal notices at
a page's end go; buttons and lists of choices go without ending the sentence
that they stand in; what stands under a heading that stays, stays with it.

Each page is extracted whole, by itself, in a task; nothing is shuffled.

Defined results: null or empty html, or a page without text, gives the empty
text; repeated rows give equal results; unclosed and stray tags follow the
usual implied-end rules; elements nested deeper than MAX_DEPTH count as part of
the one above, their text stays; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandmill.llm.common import text_bytes

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.S)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPACES = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?。、，！？]")

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea xmp noembed noframes".split())
FOREIGN = frozenset("svg math canvas audio video object noscript template noembed noframes".split())
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES = {  # a start tag that ends an open element, up to the given borders
    **{t: ({"p"}, frozenset()) for t in "address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split()},
    "li": ({"p", "li"}, frozenset(("ul", "ol", "menu"))),
    "dt": ({"p", "dt", "dd"}, frozenset(("dl",))),
    "dd": ({"p", "dt", "dd"}, frozenset(("dl",))),
    "tr": ({"p", "tr", "td", "th"}, frozenset(("table",))),
    "td": ({"p", "td", "th"}, frozenset(("table", "tr"))),
    "th": ({"p", "td", "th"}, frozenset(("table", "tr"))),
    "tbody": ({"p", "tr", "td", "th", "thead", "tbody"}, frozenset(("table",))),
    "tfoot": ({"p", "tr", "td", "th", "thead", "tbody"}, frozenset(("table",))),
    "option": ({"option"}, frozenset(("select",))),
    "body": ({"head", "title"}, frozenset()),
}
# What never is main text, by element, by role, and by a word of class or id.
OUT_TAGS = frozenset("nav aside footer form button select option fieldset dialog menu head title".split())
OUT_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar toolbar".split())
OUT_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related reply replies respond share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Words that say nothing in a class name beside those.
NEUTRAL_WORDS = frozenset("area bar block body bottom box buttons container content form group head header holder id inner item items left link links list main module nav outer panel right row section site slot text title top unit wrap wrapper".split())
WORDS = re.compile(r"[a-z]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Width of the smoothing over blocks, share of the mean fused ratio that a content path reaches, share of linked text from which a path is a link list,
#: share of the text that makes an element a wrapper of the page, and levels of nesting that are told apart (browsers stop there as well).
SIGMA, THRESHOLD, LINKED, WRAPPED, MAX_DEPTH = 1.0, 0.2, 0.5, 0.9, 512
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
HARD, SOFT, COMMENTS, MAYBE_COMMENTS = 2, 1, 3, 4
#: Controls that stand within sentences, and how legal notices of a page's end read.
CONTROLS = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("button", "select")}
NOTICE = re.compile(r"(?:\A\W*(?:copyright\b|\(c\)|©)|\ball rights reserved\b)", re.I)
#: Longest text that counts as a notice.
NOTICE_CHARS = 200


class Node:
    """An open element. out: HARD if it or one around it is boilerplate by tag or role; soft: the outermost element around it that is boilerplate by name."""

    __slots__ = ("tag", "parent", "path", "out", "soft", "soft_here", "block")  # soft_here: this one is

    def __init__(self, tag: str, parent: Node | None, attributes: str, paths: dict):
        self.tag, self.parent, self.block = tag, parent, tag not in INLINE
        own = boilerplate(tag, attributes, parent)
        self.out = own == HARD or (parent is not None and parent.out)
        self.soft_here = own if own in (SOFT, COMMENTS, MAYBE_COMMENTS) else 0
        self.soft = (parent.soft if parent else None) or (self if self.soft_here else None)
        self.path = parent.path if parent else 0
        if self.block:
            label = tag
            if attributes and (m := re.search(r"class\s*=\s*[\"']?\s*([\w-]+)", attributes)):
                label += "." + m[1]
            self.path = paths.setdefault((self.path, label), len(paths) + 1)


def out_name(value: str) -> bool:
    """One of the class names or ids is a boilerplate word, or is made of them and neutral words only."""
    for name in value.split():
        words = WORDS.findall(name)
        if not OUT_WORDS.isdisjoint(words) and all(w in OUT_WORDS or w in NEUTRAL_WORDS for w in words):
            return True
    return False


def boilerplate(tag: str, attributes: str, parent: Node | None) -> int:
    """HARD for an element that is no main text by its tag, role or visibility, or a page header outside an article; SOFT or COMMENTS by its name, MAYBE_COMMENTS if a name has a word for comments among others, SOFT for a form."""
    if tag == "form":
        return SOFT
    if tag in OUT_TAGS:
        return HARD
    if tag == "header":
        up = parent
        while up and up.tag not in ("article", "main"):
            up = up.parent
        return 0 if up else HARD
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return 0
    if tag in ("body", "html", "article", "main"):
        return 0
    soft = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in OUT_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return HARD
        if name in ("class", "id"):
            remarks = not COMMENT_WORDS.isdisjoint(WORDS.findall(value))
            if out_name(value):
                soft = SOFT if not remarks and soft != COMMENTS else COMMENTS
            elif remarks and not soft:
                soft = MAYBE_COMMENTS
    return soft


class Block:
    __slots__ = ("node", "text", "link")

    def __init__(self, node: Node, text: str, link: int):
        self.node, self.text, self.link = node, text, link

    @property
    def plain(self) -> int:
        return max(0, len(self.text) - self.link)


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, with their innermost block element and the length of text in links."""
    paths: dict = {}
    root = Node("", None, "", paths)
    stack, open_, out, parts, link, at = [root], Counter(), [], [], 0, 0

    def flush() -> None:
        nonlocal parts, link
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                node = stack[-1]
                while not node.block:
                    node = node.parent
                out.append(Block(node, text, link))
            parts, link = [], 0

    def close(upto: int) -> None:
        """Ends open elements down to that depth."""
        if any(n.block for n in stack[upto:]):
            flush()
        open_.subtract(n.tag for n in stack[upto:])
        del stack[upto:]

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            if open_["a"] > 0 and not text.isspace():
                link += len(text)
            parts.append(text)
        if not m:
            break
        at = m.end()
        if m[1]:
            parts.append(html.escape(m[1]))
        if not m[3]:
            continue
        tag, given = m[3].lower(), m[4] or ""
        if m[2]:  # an end tag: of the innermost open element of that name, if there is one
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0) if open_[tag] > 0 else 0
            if k and not (tag in INLINE and any(n.block for n in stack[k + 1 :])):
                close(k)
            elif tag == "br":
                parts.append(" ")
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            if not (given.endswith("/") and tag in FOREIGN):
                raw_end = RAW_END[tag].search(page, at)
                at = raw_end.end() if raw_end else at if tag in FOREIGN else end
            if tag not in ("svg", "math"):
                parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in CONTROLS and not stack[-1].out and (shut := CONTROLS[tag].search(page, at)):
            at = shut.end()  # a control within a sentence doesn't end it
            parts.append(" ")
            continue
        ends, border = CLOSES.get(tag, ((), ()))
        if ends:
            k = len(stack)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in border:
                    break
                if stack[i].tag in ends:
                    k = i
                elif stack[i].block and stack[i].tag not in ends and not border:
                    break
            if k < len(stack):
                close(k)
        if tag not in INLINE:
            while len(stack) > 1 and not stack[-1].block:  # unclosed formatting ends where a block starts
                if stack[-1].tag == "a":
                    break
                open_[stack.pop().tag] -= 1
            flush()
        if len(stack) <= MAX_DEPTH:
            stack.append(Node(tag, stack[-1], given, paths))
            open_[tag] += 1
    flush()
    return out


def fused_ratios(found: list[Block]) -> dict[int, float]:
    """Fused ratio of each path: mean text length outside links and mean punctuation of its blocks, each smoothed over the blocks in page order."""
    index: dict[int, int] = {}
    at = np.array([index.setdefault(b.node.path, len(index)) for b in found])
    n = np.bincount(at)
    values = np.array([[b.plain for b in found], [len(PUNCTUATION.findall(b.text)) for b in found]], float)
    span = np.arange(-2, 3)
    kernel = np.exp(-(span**2) / (2 * SIGMA**2))
    width = np.convolve(np.ones(len(at)), kernel)[2:-2]
    fused = np.ones(len(n))
    for row, floor in zip(values, (0.0, 0.1), strict=True):
        ratio = np.bincount(at, row) / n
        fused *= np.bincount(at, np.convolve(ratio[at], kernel)[2:-2] / width) / n + floor
    return {p: float(fused[k]) for p, k in index.items()}


def content_paths(found: list[Block]) -> set[int]:
    """Paths whose fused ratio reaches THRESHOLD of the mean over the blocks."""
    fused = fused_ratios(found)
    least = THRESHOLD * sum(fused[b.node.path] for b in found) / len(found)
    return {p for p, x in fused.items() if x >= least and x > 0} or set(fused)


def _outermost(node: Node, unheeded: set) -> Node | None:
    """The outermost element around a node that is boilerplate by name and isn't unheeded."""
    if node.soft is None:
        return None
    out = None
    while node is not None and node.soft is not None:
        if node.soft_here and node not in unheeded:
            out = node
        node = node.parent
    return out


def drop_boilerplate(found: list[Block]) -> list[Block]:
    """Blocks outside boilerplate. While no sentence stands outside, a form, or a name (none of comments) that wraps WRAPPED of the text, goes unheeded."""
    found = [b for b in found if not b.node.out]
    unheeded = _holders(found)
    while True:
        owner = [_outermost(b.node, unheeded) for b in found]
        inside = Counter()
        for b, o in zip(found, owner, strict=True):
            if o is not None and (o.tag == "form" or o.soft_here == SOFT):
                inside[o] += b.plain
        spoken = any(o is None and b.plain >= 25 and PUNCTUATION.search(b.text) for b, o in zip(found, owner, strict=True))
        if spoken or not inside:
            break
        big, n = inside.most_common(1)[0]
        if n < WRAPPED * sum(b.plain for b in found):
            break
        unheeded.add(big)
    return [b for b, o in zip(found, owner, strict=True) if o is None]


def _holders(found: list[Block]) -> set:
    """Elements whose name has a word for comments among others, but which hold most of the page's text: the post's own."""
    inside, total = Counter(), sum(b.plain for b in found)
    for b in found:
        node = b.node if b.node.soft is not None else None
        while node is not None and node.soft is not None:
            if node.soft_here == MAYBE_COMMENTS:
                inside[node] += b.plain
            node = node.parent
    return {n for n, k in inside.items() if 2 * k > total}


def in_article(node: Node) -> bool:
    while node and node.tag not in ("article", "main"):
        node = node.parent
    return node is not None


def within(node: Node, region: Node) -> bool:
    while node and node is not region:
        node = node.parent
    return node is region


def without_notices(found: list[Block]) -> list[Block]:
    """found without the legal notices that end a page outside its heaviest path and any article; a page of nothing else stays."""
    weight = Counter()
    for b in found:
        weight[b.node.path] += b.plain
    path, end = weight.most_common(1)[0][0], len(found)
    while end and len(found[end - 1].text) <= NOTICE_CHARS and NOTICE.search(found[end - 1].text) and found[end - 1].node.path != path and not in_article(found[end - 1].node):
        end -= 1
    return found[:end] or found


def with_sections(found: list[Block], kept: list[Block], is_list) -> list[Block]:
    """kept, and what stands under each heading in it: plain blocks of the heading's element, up to the next heading or link list."""
    chosen, under = set(map(id, kept)), None
    for b in found:
        if b.node.tag in HEADINGS:
            under = b.node.parent if id(b) in chosen else None
        elif under is not None and (is_list(b) or not within(b.node, under)):
            under = None
        elif under is not None:
            chosen.add(id(b))
    return [b for b in found if id(b) in chosen]


def select(found: list[Block]) -> list[Block]:
    """The content nodes among blocks that are no boilerplate."""
    found = without_notices(found)
    chosen = content_paths(found)
    content = [b for b in found if b.node.path in chosen]
    linked, length = Counter(), Counter()
    for b in found:
        linked[b.node.path] += min(b.link, len(b.text))
        length[b.node.path] += len(b.text)
    is_list = lambda b: linked[b.node.path] >= LINKED * length[b.node.path]
    best = max(content, key=lambda b: b.plain)
    region = best.node
    while region and region.tag not in ("article", "main"):
        region = region.parent
    if region and 2 * sum(b.plain for b in content if within(b.node, region)) > sum(b.plain for b in content):
        return [b for b in found if within(b.node, region) and not (is_list(b) and b.node.path not in chosen)]
    # the container of the heaviest path: what lies among its content blocks stays too
    weight = Counter()
    for b in content:
        weight[b.node.path] += b.plain
    path = weight.most_common(1)[0][0]
    own = [b.node for b in content if b.node.path == path]
    container = own[0].parent or own[0]
    while not all(within(n, container) for n in own):
        container = container.parent
    places = [i for i, b in enumerate(found) if b.node.path in chosen and within(b.node, container)]
    lo, hi = (places[0], places[-1]) if places else (0, -1)
    while lo > 0 and found[lo - 1].node.tag in HEADINGS and not is_list(found[lo - 1]):
        lo -= 1
    kept = [b for i, b in enumerate(found) if b.node.path in chosen and not is_list(b) or lo <= i <= hi and not is_list(b)]
    return with_sections(found, kept, is_list)


def extract(page: str | None) -> str:
    """Main text of one page: blocks joined by an empty line."""
    found = drop_boilerplate(blocks(page)) if page else []
    return "\n\n".join(b.text for b in select(found)) if found else ""


OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def task(batches):
        for batch in batches:
            texts = [extract(h.decode("utf-8", "replace")) if h else "" for h in text_bytes(batch.column("html"))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=OUT)

    return pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html").mapInArrow(task, "page_id long, url string, text string, n_chars long")
