"""HTML extraction by site template removal.

Every page is parsed leniently into elements. Two things are hashed of each subtree: all of it (tag, class, children and
text), and its skeleton, the tags and classes on the way to it and below it, without text, digits, inline elements other
than links, and repetition. Spark counts for each host on
how many distinct pages (equal html counts once) a hash occurs. A hash is template if it recurs on at least
`LEAST_PAGES` pages that are `SHARE` of the host's distinct pages or `ENOUGH_PAGES`, whatever the host's size; a skeleton,
whose text may differ from page to page, only if it lies outside the page's densest part on `OUTSIDE` of them. The
densest part is found from the root by going down into the block that holds `DENSE` of the text that is no link.

Template subtrees are deleted wherever they stand outside the page's main element, and inside it if they are containers
and not paragraphs, headings or lists of text. What structure or class names mark as no part of an article (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) goes too, which serves hosts with few
pages and what recurs on few pages; `lists=False` turns that off, then only the template decides. If a page has a main
element, or else articles, only these are kept.

Only hashes are counted by host, so a host with a third of all pages is no hot group: counting combines before
the shuffle, and a page meets the few recurring hashes of its own by page, not by host.

Defined results: a null or empty page gives an empty text; a null url is a host of its own; repeated rows and copies
of a page count once and get equal results; of blocks that hold equally much text the first is gone into; a page of any
length is parsed whole; an unclosed element ends with its parent, a page cut off in a tag loses that tag; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, written

LEAST_PAGES = 4
SHARE = 0.5
ENOUGH_PAGES = 32
OUTSIDE = 0.6
DENSE = 0.75
LEFT = 0.25

#: Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br img wbr".split())
DROPPED = frozenset("head script style title textarea xmp iframe noembed noframes noscript template nav aside footer form button select option input dialog menu object embed svg canvas audio video map fieldset".split())
#: Elements whose text is never shown as text.
NEVER = frozenset("head script style title template noscript xmp iframe noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids that mark what is no part of an article.
MARKS = frozenset(
    "nav navbar navigation menu topnav subnav breadcrumb breadcrumbs header masthead footer colophon sidebar aside ad ads advert advertisement adverts adbox sponsor sponsored promo promotion"
    " banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations"
    " comment comments reply replies disqus respond widget toolbar pagination pager skip search form hidden".split()
)
#: Opening one of these ends an open one of those.
CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "option": ("option",),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
}
SCOPES = frozenset("ul ol dl table select body article section div main".split())

_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)", re.S)
_attribute = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(\bhidden\b)", re.S)
_words = re.compile(r"[a-z0-9]+")
_digits = re.compile(r"\d+")
_raw_end: dict[str, re.Pattern] = {}
#: Loose text may stand before or after a tag that is cut off.
_TEXT = 0


class Element:
    __slots__ = ("tag", "key", "parent", "children", "dropped", "hash", "path", "shape", "mass")

    def __init__(self, tag: str, key: str, parent, dropped: bool):
        self.tag, self.key, self.parent, self.dropped = tag, key, parent, dropped
        self.children: list = []  # elements and strings
        self.hash = self.path = self.shape = self.mass = 0  # mass: the letters of text that is no link


def _described(tag: str, source: str) -> tuple[str, bool]:
    """What identifies an element besides its tag, and whether it is marked as no part of an article."""
    names, role, hidden = "", "", False
    if source and not source.isspace():
        for name, a, b, c, bare in _attribute.findall(source):
            name, value = name.lower(), (a or b or c)
            if name in ("class", "id"):
                names += " " + value.lower()
            elif name == "role":
                role = value.lower()
            elif bare or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                hidden = True
    marked = hidden or role in ROLES or (tag not in ("html", "body", "main") and any(w in MARKS for w in _words.findall(names)))
    return names, marked


def parse(html: str) -> Element:
    """The page's elements under one root."""
    root = Element("", "", None, False)
    here, at, size = root, 0, len(html)
    find = _token.search
    while at < size:
        found = find(html, at)
        if found is None:
            if at < size:
                rest = html[at:]
                here.children.append(rest if not re.match(r"<[/!?A-Za-z]", rest) else "")
            break
        if found.start() > at:
            here.children.append(html[at : found.start()])
        at = found.end()
        name = found.group(2)
        if name is None:
            if found.group().startswith("<![CDATA["):
                here.children.append(found.group()[9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if not found.group(4):  # cut off within the tag
            break
        tag = name.lower()
        if found.group(1):
            up = here
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                here = up.parent
            elif tag in ("p", "br"):
                here.children.append(Element("br", "", here, False))
            continue
        if tag in BLOCK and tag != "br":
            up = here  # a block ends an open paragraph and what stands in it
            while up is not root and up.tag not in SCOPES and up.tag not in ("td", "th", "li"):
                if up.tag == "p":
                    here = up.parent
                    break
                up = up.parent
        for ended in (CLOSES.get(tag),):
            if ended:
                up, last = here, None
                while up is not root and up.tag not in ("ul", "ol", "dl", "table", "select", "div", "article", "section", "main", "body"):
                    if up.tag in ended:
                        last = up
                    up = up.parent
                if last is not None:
                    here = last.parent
        key, marked = _described(tag, found.group(3))
        node = Element(tag, key, here, marked or tag in DROPPED)
        here.children.append(node)
        if tag in VOID or found.group(3).endswith("/"):
            continue
        if tag in RAW:
            if tag not in _raw_end:
                _raw_end[tag] = re.compile(rf"</{tag}\b[^>]*>?", re.I)
            end = _raw_end[tag].search(html, at)
            node.children.append(html[at : end.start() if end else size])
            at = end.end() if end else size
            continue
        here = node
    return root


def _in_order(root: Element) -> list[Element]:
    """Parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in node.children if c.__class__ is Element)
    return out


def _hash_all(root: Element) -> list[Element]:
    import xxhash

    nodes = _in_order(root)
    for node in nodes[1:]:
        up = node.parent
        node.path = xxhash.xxh64_intdigest(f"{up.path:x}\x1f{node.tag}\x1f{_digits.sub('', node.key)}".encode("utf-8", "surrogatepass"), 1)
    for node in reversed(nodes):
        parts = [node.tag, node.key]
        mass, below = 0, []
        for c in node.children:
            if c.__class__ is str:
                if text := " ".join(c.split()):
                    parts.append(text)
                    mass += len(text)
            else:
                parts.append(f"\x00{c.hash:x}")
                mass += c.mass
                if (c.tag == "a" or c.tag not in INLINE) and below[-1:] != [c.shape]:
                    below.append(c.shape)
        node.shape = xxhash.xxh64_intdigest(",".join(map(str, (node.path, *below))), 1) - (1 << 63) or 1
        node.mass = 0 if node.tag == "a" or node.tag in NEVER else mass
        node.hash = xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63) or 1
    return nodes


def _densest(root: Element) -> Element:
    node = root
    while True:
        inner = [c for c in node.children if c.__class__ is Element and c.tag not in INLINE and c.tag not in PARAGRAPHS]
        most = max(inner, key=lambda c: c.mass, default=None)
        if most is None or not most.mass or most.mass < DENSE * node.mass:
            return node
        node = most


def _mains(nodes: list[Element]) -> list[Element]:
    """The page's main elements: main, or else the outermost articles; none if it has neither."""

    def allowed(node):
        while node is not None:
            if node.dropped and node.tag != "":
                return False
            node = node.parent
        return True

    for tag in ("main", "article"):
        found = [n for n in nodes if n.tag == tag and allowed(n)]
        inside = set(map(id, found))
        outer = []
        for n in found:
            up = n.parent
            while up is not None and id(up) not in inside:
                up = up.parent
            if up is None:
                outer.append(n)
        if outer:
            return outer
    return []


class Article:
    """The part of a page that is taken for its article: the main elements, or else the densest part."""

    def __init__(self, root: Element, nodes: list[Element]):
        parts = _mains(nodes) or [_densest(root)]
        chosen = set(map(id, parts))
        self.around = set()  # elements that hold a part, and the parts
        for node in parts:
            while node is not None:
                self.around.add(id(node))
                node = node.parent
        self.inside: dict[int, bool] = {}
        for node in nodes:
            above = node.parent
            self.inside[id(node)] = above is not None and (self.inside[id(above)] or id(above) in chosen)


def template_candidates(html: str | None) -> list[tuple[int, int]]:
    """The hashes of the page's subtrees and skeletons that may be template, each once, with 1 for those that the page speaks for."""
    root = parse(html or "")
    nodes = _hash_all(root)
    article = Article(root, nodes)
    found: dict[int, int] = {}
    for node in nodes:
        if node.parent is None or node.tag in INLINE or node.tag in ("html", "body", "head", "main", "article") or not node.children:
            continue
        inside = article.inside[id(node)]
        found[node.shape] = min(found.get(node.shape, 1), int(not inside and id(node) not in article.around))
        if not (inside and node.tag in PARAGRAPHS):
            found[node.hash] = 1
    return sorted(found.items())


def _recurring(nodes: list[Element], article: Article, template: set[int]) -> set[int]:
    """The elements of the article (by id) that are template: none if what would be left of its text besides headings is less than LEFT of what goes."""
    found, gone, left = set(), 0, 0
    under: dict[int, bool] = {}  # in an element that goes, or in a heading
    for node in nodes:
        above = node.parent
        covered = above is not None and under[id(above)]
        goes = not covered and article.inside[id(node)] and node.tag not in INLINE and node.tag not in PARAGRAPHS and node.hash in template
        if goes:
            found.add(id(node))
            gone += node.mass
        under[id(node)] = covered or goes or node.tag in HEADINGS
        if not under[id(node)] and (article.inside[id(node)] or id(node) in article.around) and node.tag not in NEVER and node.tag != "a":
            left += sum(len(" ".join(c.split())) for c in node.children if c.__class__ is str)
    return found if left >= LEFT * gone else set()


def main_text(html: str | None, template: set[int] | None, lists: bool = True) -> str:
    """The page's main text without the template subtrees.

    Around the article only the template decides, and within it class and element names, too, unless `lists` is off. With no
    template (None), on a host of few pages, names decide everywhere and only the main elements are kept.
    """
    if not html:
        return ""
    root = parse(html)
    alone = template is None and lists
    nodes = _in_order(root) if template is None else _hash_all(root)
    mains = _mains(nodes) if alone else []
    chosen = set(map(id, mains))
    article = None if template is None else Article(root, nodes)
    recurring = set() if article is None else _recurring(nodes, article, template)
    out: list[str] = []
    stack: list = [(root, not mains, False)]
    while stack:
        node, kept, inside = stack.pop()
        if node.__class__ is str:
            if kept:
                out.append(unescape(node))
            continue
        if node.tag in NEVER:
            continue
        if alone:
            if id(node) in chosen:
                kept = inside = True
            # a header in the article holds its heading
            elif node.dropped or node.tag == "header" and not inside:
                continue
        elif article is not None and node.parent is not None:
            if article.inside[id(node)]:
                if lists and node.dropped or id(node) in recurring:
                    continue
            elif id(node) not in article.around and node.tag not in INLINE and (node.hash in template or node.shape in template):
                continue
        block = node.tag in BLOCK
        if block:
            stack.append((" ", True, inside))
        stack.extend((c, kept, inside) for c in reversed(node.children))
        if block:
            stack.append((" ", True, inside))
    return " ".join("".join(out).split())


def site_templates(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE, enough: int = ENOUGH_PAGES) -> tuple[DataFrame, DataFrame]:
    """(page, host, hash) of every page's candidates, and the template: (host, hash). pages: (page, host, content, html)."""

    def candidates(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                own = [[(0, 1), *template_candidates(html)] for html in part.column(3).to_pylist()]
                rows = pa.array([k for k, found in enumerate(own) for _ in found], pa.int64())
                made = [pa.array([found[k] for each in own for found in each], t) for k, t in enumerate((pa.int64(), pa.int8()))]
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(rows) for k in range(3)), *made], names=["page", "host", "content", "hash", "vote"])

    hashes = written(pages.select("page", "host", "content", "html").mapInArrow(candidates, "page long, host long, content long, hash long, vote byte"), "html-hashes")
    # rows are counted first, as only what they repeat can recur on distinct pages
    repeated = hashes.groupBy("host", "hash").agg(F.count("*").alias("n"), F.sum("vote").alias("votes")).where((F.col("n") >= least) & (F.col("votes") > 0)).select("host", "hash")
    once = hashes.join(written(repeated, "html-repeated"), ["host", "hash"]).select("host", "content", "hash", "vote").distinct()
    # hash 0 stands once for each page, so its count is the host's number of distinct pages
    counts = written(once.groupBy("host", "hash").agg(F.count("*").alias("n"), F.sum("vote").alias("votes")).where((F.col("n") >= least) & (F.col("votes") >= OUTSIDE * F.col("n"))), "html-counts")
    hosts = counts.where("hash = 0").select("host", F.col("n").alias("pages"))
    template = counts.join(hosts, "host").where((F.col("hash") == 0) | (F.col("n") >= F.least(share * F.col("pages"), F.lit(enough)))).select("host", "hash")
    return hashes.select("page", "host", "hash"), written(template, "html-template")


def extracted(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE, enough: int = ENOUGH_PAGES, lists: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    pages = only(pages, "page_id", "url", "html")
    host = F.xxhash64(F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)), F.lit("\x00")))
    keyed = pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("page_id", "url", "html").alias("page"), F.xxhash64("html").alias("content"))
    hashes, template = site_templates(keyed, least, share, enough)
    of_page = hashes.join(template, ["host", "hash"]).groupBy("page").agg(F.collect_set("hash").alias("template"))

    def texts(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                found = [main_text(html, set(t) if t else None, lists) for html, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.string()), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    joined = keyed.join(of_page, "page", "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(texts, f"page_id {id_type}, url string, text string, n_chars long")
