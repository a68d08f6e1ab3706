"""Main text of web pages by tree scoring.

A page becomes a tree of containers. Paragraphs pass points for their length and commas to
their ancestors, halved at each level beyond the parent; link density discounts a container's points. The best container
and those of its siblings that score like it, or that are plain paragraphs of prose, are the article; inside an ``article`` or
``main`` element that element is, with like articles beside it.
Navigation, notices, forms and the like go by their tags and by the words in their class and id, unless their content is
prose. All passes are linear in the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
DROPPED = frozenset("head script style template noscript nav header footer aside form button select option datalist textarea input iframe object embed applet canvas svg annotation annotation-xml audio video map menu dialog fieldset label progress meter title xmp noembed noframes plaintext".split())
BLOCKS = frozenset("address article blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
CONTAINERS = frozenset("article body blockquote center dd details div dl figure html main ol section table tbody td tr ul".split())
ROWS = frozenset("ul ol dl table tbody tr".split())
LISTS = frozenset("ul ol dl div section table".split())
PARAGRAPHS = frozenset("p blockquote pre li dd td figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKED = frozenset(("article", "main"))
FIELDS = frozenset(("form", "button", "select", "fieldset"))

#: Words in class, id or role of what isn't the article.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adbox|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|sponsors|promo|promoted|promotion|cookie|cookies|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|signup|"
    r"comment|comments|commentlist|respond|reply|replies|disqus|discussion|reader-comments|menu|menubar|nav|navbar|navigation|breadcrumb|breadcrumbs|pagination|pager|sidebar|side-bar|widget|widgets|footer|foot|header|masthead|topbar|toolbar|"
    r"related|recommended|recommendations|share|sharing|social|login|search|searchbox|form|skip|toc|tags|copyright|colophon|site-info|site-title|logo|prev-next|teaser|contentinfo|complementary|dialog|alert|alertdialog|paywall|outbrain|taboola)(?:$|[\s_-]|\d)",
    re.IGNORECASE,
)
#: Compounds without a separator.
UNLIKELY_PART = re.compile(r"comment|sidebar|cookie|newsletter|advert|sponsor|navbar|breadcrumb|pagination|masthead|popup|consent", re.IGNORECASE)

#: Class names that say what a container has or lacks beside its text.
HAS_PART = re.compile(r"(?<![a-z])(?:has|with|no|without|show|hide)-[a-z-]*", re.IGNORECASE)
#: What an article or the main part may be after all: a reader's comment, or a pointer elsewhere.
NOT_THE_ARTICLE = re.compile(r"comment|reply|respond|related|teaser|promo|sponsor|advert", re.IGNORECASE)

#: Words for the look or the place of a container, which many pages also give to the parts of an article.
LAYOUT = re.compile(r"(?:^|[\s_-])(?:widget|widgets|header|masthead|banner|form|share|sharing|social|tags|notice|toc|foot|skip)(?:$|[\s_-]|\d)", re.IGNORECASE)
#: What stays out whatever its length, unless nothing else is left: readers' comments, notices about cookies, advertisements.
NEVER = re.compile(r"comment|reply|replies|respond|disqus|discussion|cookie|consent|gdpr|newsletter|subscri|advert|adsense|sponsor|outbrain|taboola|breadcrumb|pagination|paywall", re.IGNORECASE)
#: Words that make no name of their own beside those above.
BOXES = frozenset("area bar block body bottom box btn button card cell center col column container content count dark desktop div full grid group head hidden holder id in inline inner item items layout left light line link links list main mobile module more new note outer page panel part post promo region right row section side single site slot small sticky text thread title top unit view wide wrap wrapper".split())
#: Names that the parts of an article have as well.
ALSO_PARTS = frozenset("discussion discussions related header masthead banner form share social tags notice toc foot skip alert dialog search overlay promotion teaser footer copyright".split())
#: Names that are no paragraph's of an article either.
MENUS = frozenset("menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar toolbar topbar cookie cookies consent gdpr login signup subscribe".split())
_PART = re.compile(r"[A-Za-z]+")
#: The part of an article that holds its headline.
ARTICLE_HEAD = re.compile(r"(?:^|[\s_])(?:post|entry|article|story|content|page|blog|news)[_-]*(?:header|head|title|masthead|banner)(?:$|[\s_-])", re.IGNORECASE)
#: Characters of a link up to which a list of nothing but links is a menu, not references.
SHORT_LINK = 20
#: Characters beside links that make a block prose, and a container of a layout name a part of the article.
PROSE_BLOCK, PROSE_PART = 60, 250
#: Part of a page's text beside links from which a container's prose makes it the article's wrapper whatever its name, and the most of its text that may be links.
WRAPPER, LINKED = 2 / 3, 0.3
#: How much more the points of a container count inside what the page marks as its article or main part.
MARKED_WEIGHT = 3

#: A quote opens a value after = only, and if its end isn't that of another tag's value; else it is a character like any other.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?:[^>=]|=\s*\"[^\"<>]*\"|=\s*'[^'<>]*'|=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|=)*)(?:>|\Z)", re.DOTALL)
#: An attribute: its name, then its value, which is never searched for names.
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_SPACE = re.compile(r"[\s\x1c-\x1f]+")


P_SCOPE = frozenset("td th li blockquote div section article main body button table".split())


class Node:
    """An element; ``items`` holds text and child nodes in page order."""

    __slots__ = ("tag", "parent", "items", "dropped", "named", "score", "chars", "linked", "links", "open_p", "marked")

    def __init__(self, tag: str, parent: Node | None, dropped: bool) -> None:
        self.tag, self.parent, self.dropped = tag, parent, dropped
        # the names for which it was dropped, None if for its tag or because it is hidden
        self.named: str | None = None
        self.items: list[str | Node] = []
        self.score = 0.0
        # characters, those in links, and links
        self.chars = self.linked = self.links = 0
        self.marked: bool = tag in MARKED or parent is not None and parent.marked
        # the paragraph that the next block closes
        self.open_p: Node | None = self if tag == "p" else None if parent is None or tag in P_SCOPE else parent.open_p


def _unlikely(tag: str, attrs: str) -> tuple[bool, str | None]:
    """Whether an element's attributes drop it, and the names that do, None if it is hidden."""
    if not attrs or tag in ("body", "html"):
        return False, None
    names = []
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN_STYLE.search(value):
            return True, None
        if name not in ("class", "id", "role") or not value:
            continue
        value = HAS_PART.sub(" ", value)
        if NOT_THE_ARTICLE.search(value) if tag in ("article", "main") else UNLIKELY.search(value) or UNLIKELY_PART.search(value):
            names.append(value)
    return bool(names), " ".join(names) or None


def _only_named(names: str, tag: str) -> bool:
    """Whether nothing but a name speaks against an element inside an article: a paragraph, or a name that isn't made of the words for boxes beside the article alone."""
    if tag in PARAGRAPHS:
        return MENUS.isdisjoint(_PART.findall(names.lower()))
    for name in names.split():
        hard = [x for x in _PART.findall(name.lower()) if x not in BOXES]
        unlikely = [x for x in hard if UNLIKELY.search(x) or UNLIKELY_PART.search(x)]
        if unlikely and len(unlikely) == len(hard) and not set(unlikely) <= ALSO_PARTS:
            return False
    return True


#: An open element of the key closes those of the value that are open inside its container.
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SAME_STOP = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


def parse(page: str, by_name: bool = True) -> Node:
    """The tree of a page; unclosed and stray tags are mended as browsers roughly do. Without ``by_name``, no names and no form drop anything."""
    root = here = Node("html", None, False)
    judged = False
    at, end = 0, len(page)
    holders: dict[str, list[Node]] = {"article": [], "main": []}
    opened: Counter[str] = Counter()
    headers: list[Node] = []

    def leave(node: Node, upto: Node | None) -> Node | None:
        while node is not upto:
            opened[node.tag] -= 1
            node = node.parent
        return upto

    while at < end:
        match = _TAG.search(page, at)
        if match is None:
            here.items.append(page[at:])
            break
        if match.start() > at:
            here.items.append(page[at : match.start()])
        at = match.end()
        close, tag = match.group(1), match.group(2)
        if close:
            close = close.lower()
            node = here if opened[close] > 0 else None
            while node is not None and node.tag != close:
                # an inline end tag does not close blocks
                node = None if close not in BLOCKS and close not in DROPPED and node.tag in BLOCKS else node.parent
            if node is not None and node.parent is not None:
                here = leave(here, node.parent)
        elif tag:
            tag, attrs = tag.lower(), match.group(3)
            if tag == "html":
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at) if tag != "plaintext" else None
                at = stop.end() if stop else end
                continue
            if tag in VOID:
                if tag == "br":
                    here.items.append(" ")
                elif tag == "hr":
                    here = leave(here, here.open_p.parent) if here.open_p else here
                    here.items.append(Node("hr", here, False))
                continue
            if tag in CLOSES_P and here.open_p:
                here = leave(here, here.open_p.parent)
            if tag == "body":
                while here.tag == "head":
                    here = leave(here, here.parent)
            if tag in _SAME:
                node = here
                while any(opened[x] > 0 for x in _SAME[tag]) and node is not None and node.tag not in _SAME_STOP[tag]:
                    if node.tag in _SAME[tag]:
                        here = leave(here, node.parent)
                        if tag != "tr":
                            break
                    node = node.parent
            dropped, named = _unlikely(tag, attrs)
            if tag == "form" and not dropped:
                dropped, named = True, "form"
            elif tag in DROPPED:
                dropped, named = True, None
            child = Node(tag, here, dropped and (by_name or named is None))
            child.named = named
            if tag == "header" and opened["article"] > 0:
                headers.append(child)
            judged = judged or child.dropped and named is not None
            if tag in holders and not child.dropped:
                holders[tag].append(child)
            here.items.append(child)
            if not attrs.rstrip().endswith("/") or tag in BLOCKS:
                here = child
                opened[tag] += 1
    for found in holders.values():
        # whatever a container is called, it isn't a notice if it holds the page's only article
        node = found[0].parent if len(found) == 1 else None
        while node is not None and (node.tag not in DROPPED or node.tag == "form"):
            node.dropped = False
            node = node.parent
    for node in headers:
        _keep_headings(node)
    if judged:
        _judge(root)
    return root


def _keep_headings(header: Node) -> None:
    """Of a header inside an article, the headings and paragraphs of prose stay."""
    found: list[Node | str] = []
    stack: list[Node | str] = list(reversed(header.items))
    while stack:
        x = stack.pop()
        if isinstance(x, str) or x.dropped:
            continue
        if x.tag in HEADINGS or x.tag == "p" and _prose(x) >= PROSE_BLOCK:
            x.parent = header
            found.append(x)
        else:
            stack.extend(reversed(x.items))
    if found:
        header.items, header.dropped = found, False


def _prose(paragraph: Node) -> int:
    """Characters beside links."""
    n = 0
    stack: list[Node | str] = [paragraph]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            n += len(_text(x).strip())
        elif not x.dropped and x.tag != "a":
            stack.extend(x.items)
    return n


def _judge(root: Node) -> None:
    """Take back containers and headings that were dropped for a name or as a form, but hold the page's prose.

    Where the page marks an article that has text, only what is inside or around it is taken back; inside it a name alone drops no prose.
    """
    # per node: characters, characters in links, prose, characters of marked elements, fields to fill in; and the characters beside links that it adds to the block it is part of
    found: dict[int, tuple[int, int, int, int, int]] = {}
    own: dict[int, int] = {}
    named: list[Node] = []
    stack: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while stack:
        node, linked, done = stack.pop()
        if node.dropped and node.named is None:
            if node.tag in FIELDS:
                found[id(node)], own[id(node)] = (0, 0, 0, 0, 1), 0
            continue
        linked = linked or node.tag == "a"
        if not done:
            stack.append((node, linked, True))
            stack.extend((x, linked, False) for x in node.items if isinstance(x, Node))
            continue
        chars = links = prose = plain = marked = 0
        fields = int(node.tag in FIELDS)
        for x in node.items:
            if isinstance(x, str):
                n = len(_text(x).strip())
                chars, links, plain = chars + n, links + n * linked, plain + n * (not linked)
            elif id(x) in found:
                c, k, p, m, f = found[id(x)]
                chars, links, prose, marked, fields = chars + c, links + k, prose + p, marked + m, fields + f
                plain += own[id(x)] if x.tag not in BLOCKS else 0
        if node.tag in BLOCKS or node.parent is None:
            prose += plain if plain >= PROSE_BLOCK else 0
        if node.tag in MARKED and not node.dropped:
            marked = chars - links
        found[id(node)], own[id(node)] = (chars, links, prose, marked, fields), plain
        if node.dropped:
            named.append(node)
    whole, whole_links, _, whole_marked, _ = found[id(root)]
    for node in named:
        chars, links, prose, marked, fields = found[id(node)]
        if node.tag not in MARKED and node.marked and prose >= PROSE_BLOCK and links <= LINKED * chars and not fields and _only_named(node.named, node.tag):
            node.dropped = False
            continue
        if not chars or links > LINKED * chars or NEVER.search(node.named) or whole_marked and not marked and not node.marked:
            continue
        rest = LAYOUT.sub("  ", LAYOUT.sub("  ", node.named))
        layout = node.tag not in ("form", "article", "main") and not UNLIKELY.search(rest) and not UNLIKELY_PART.search(rest)
        block = node.tag in PARAGRAPHS and prose >= PROSE_BLOCK
        if prose >= WRAPPER * (whole - whole_links) > 0 or layout and (prose >= PROSE_PART or node.tag in HEADINGS or block or ARTICLE_HEAD.search(node.named)):
            node.dropped = False


def _text(raw: str) -> str:
    return _SPACE.sub(" ", html.unescape(raw) if "&" in raw else raw)


def _score(root: Node) -> list[Node]:
    """Points of every container; returns the containers that have any.

    A paragraph's points go to the container it is in, half of them to the next one, a quarter to the one after, and so on. On the way
    up each node passes on two sums: points that have not met a container yet, and those that have, halved at each.
    """
    scored: list[Node] = []
    # one walk without recursion: pages may be nested deeply
    stack: list[tuple[Node, bool, bool]] = [(root, False, False)]
    own: dict[int, tuple[int, int]] = {}
    passed: dict[int, tuple[float, float]] = {}
    while stack:
        node, linked, done = stack.pop()
        if node.dropped:
            continue
        linked = linked or node.tag == "a"
        if not done:
            stack.append((node, linked, True))
            stack.extend((x, linked, False) for x in node.items if isinstance(x, Node))
            continue
        chars = commas = direct = 0
        fresh = halved = 0.0
        for x in node.items:
            if isinstance(x, str):
                text = _text(x).strip()
                direct += len(text)
                commas += text.count(",") + text.count("\N{FULLWIDTH COMMA}") + text.count("\N{IDEOGRAPHIC COMMA}")
            elif not x.dropped:
                if x.tag not in BLOCKS:
                    c, k = own.pop(id(x), (0, 0))
                    chars, commas = chars + c, commas + k
                a, b = passed.pop(id(x), (0.0, 0.0))
                fresh, halved = fresh + a, halved + b
                node.chars, node.linked, node.links = node.chars + x.chars, node.linked + x.linked, node.links + x.links
        chars += direct
        own[id(node)] = (chars, commas)
        node.chars += direct
        node.linked += direct if linked else 0
        node.links += node.tag == "a"
        points = 1 + commas + min(3.0, chars / 100) + chars / 2000 if node.tag in BLOCKS and chars and node.tag not in HEADINGS else 0.0
        if node.tag in CONTAINERS or node.parent is None:
            itself = node.tag not in ROWS
            node.score = fresh + halved + points * itself
            passed[id(node)] = (points * (not itself), node.score / 2)
            if node.score and node.chars:
                scored.append(node)
        else:
            passed[id(node)] = (fresh + points, halved)
    for node in scored:
        node.score *= 1 - node.linked / node.chars
    return scored


def _menu(node: Node) -> bool:
    """Whether a list is nothing but short links, as menus and pagers are and references aren't."""
    return node.tag in LISTS and node.linked > 0.8 * node.chars and node.linked <= SHORT_LINK * node.links


def _announced(out: list[list[str]]) -> bool:
    """Whether the last text so far ends in a colon, so that what follows belongs to it."""
    for parts in reversed(out[-8:]):
        text = "".join(parts).rstrip()
        if text:
            return text.endswith(":")
    return False


def _blocks(node: Node, out: list[list[str]], menus: bool) -> None:
    """Text of a node cut at blocks, in page order, with or without menus."""
    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif not x.dropped and (menus or x is node or not _menu(x) or _announced(out)):
            block = x.tag in BLOCKS
            if block:
                out.append([])
                stack.append(None)
            stack.extend(reversed(x.items))


def main_text(page: str | None) -> str:
    """The article's blocks joined by newlines; empty without any. A page that the names of its containers leave nothing of is read without them."""
    if not page:
        return ""
    return _article(parse(page)) or _article(parse(page, by_name=False))


def _article(root: Node) -> str:
    scored = _score(root)
    # a page of headings alone has points nowhere
    best = max(scored, key=lambda n: n.score * (MARKED_WEIGHT if n.marked else 1)) if scored else next((n for n in _elements(root) if n.tag in MARKED), None)
    if best is None:
        return ""
    marked: Node | None = None
    up: Node | None = best
    while up is not None:
        # the outermost article, or else the innermost main part
        if up.tag == "article" or up.tag == "main" and marked is None:
            marked = up
        up = up.parent
    top = best.score
    if marked is not None:
        # the best container's article is taken whole
        best = marked
    else:
        # what the article consists of may sit beside the best container
        while (up := best.parent) is not None and up.parent is not None and up.score >= 0.75 * best.score and up.tag in CONTAINERS and up.tag != "body":
            best = up
    chosen = [best]
    if best.parent is not None and best.tag != "main":
        headed = best.tag == "article" and any(x.tag in HEADINGS for x in _elements(best))
        chosen = [x for x in best.parent.items if isinstance(x, Node) and (x is best or _beside(x, best.tag, top) and not (headed and x.tag in HEADINGS))]
    out: list[list[str]] = [[]]
    for x in chosen:
        _blocks(x, out, menus=x.tag == "article")
        out.append([])
    lines = [_text("".join(parts)).strip() for parts in out if parts]
    return "\n".join(x for x in lines if x)


def _elements(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(y for y in reversed(x.items) if isinstance(y, Node) and not y.dropped)


def _beside(x: Node, tag: str, top: float) -> bool:
    """Whether a sibling of the best container, an element of ``tag`` with ``top`` points, belongs to it. Beside an article only like articles do, and headings if it has none."""
    if x.dropped or not x.chars:
        return False
    density = x.linked / x.chars
    if x.tag in HEADINGS:
        return density < 0.5
    if tag == "article":
        return x.tag == "article" and x.score >= 0.2 * top and density < 0.5
    return x.score >= max(2.0, 0.2 * top) and density < 0.5 or x.tag in ("p", "blockquote", "pre") and density < 0.25


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    Null and empty html give an empty text, as do pages without prose. Ids and urls are passed on, null or
    repeated as they are. An empty table gives an empty result; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
