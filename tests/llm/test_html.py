"""Template removal against a tree of strings made with the standard library's parser, and stories that several pages share."""

import html as entities
import re
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from tomeflow.llm import html

VOID = {"br", "img", "meta", "link", "hr", "input"}
INLINE = {"a", "b", "i", "em", "strong", "span", "br", "img", "small", "u", "sub", "sup", "code"}
PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "tr", "blockquote", "pre"}
NEVER = {"head", "title", "script", "style", "noscript", "template", "iframe"}
#: What is never a part of an article, as far as the tables' pages have it.
UNWANTED = {"nav", "aside", "footer", "form", "button", "select", "input"}
NAMES = {"nav", "menu", "header", "footer", "sidebar", "ad", "ads", "cookie", "notice", "banner", "comment", "comments", "share", "related", "newsletter", "social", "promo", "breadcrumbs", "hidden", "advert", "popup"}


class Node:
    def __init__(self, tag, names, parent):
        self.tag, self.names, self.parent, self.children = tag, names, parent, []

    def all(self):
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.all()

    def full(self):
        return (self.tag, self.names, tuple(c.full() if isinstance(c, Node) else " ".join(c.split()) for c in self.children if isinstance(c, Node) or c.split()))

    def path(self):
        return (*(self.parent.path() if self.parent else ()), (self.tag, re.sub(r"\d", "", self.names)))

    def shape(self):
        below = []
        for c in self.children:
            if isinstance(c, Node) and (c.tag == "a" or c.tag not in INLINE) and below[-1:] != [c.shape()]:
                below.append(c.shape())
        return (self.path(), tuple(below))

    def mass(self):
        if self.tag == "a" or self.tag in NEVER:
            return 0
        return sum(c.mass() if isinstance(c, Node) else len(" ".join(c.split())) for c in self.children)

    def marked(self):
        return self.tag in UNWANTED or self.tag not in ("html", "body", "main") and bool(NAMES & set(re.findall("[a-z0-9]+", self.names)))

    def within(self, parts):
        return self.parent is not None and (self.parent in parts or self.parent.within(parts))


class Tree(HTMLParser):
    def __init__(self, source):
        super().__init__(convert_charrefs=False)
        self.root = self.here = Node("", "", None)
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE and tag not in ("script", "style", "title"):
            up = self.here
            while up.parent and up.tag not in ("ul", "ol", "table", "body", "article", "section", "div", "main", "li", "td"):
                if up.tag == "p":
                    self.here = up.parent
                    break
                up = up.parent
        names = "".join(" " + (v or "").lower() for k, v in attrs if k in ("class", "id"))
        node = Node(tag, names, self.here)
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node

    def handle_endtag(self, tag):
        up = self.here
        while up.parent and up.tag != tag:
            up = up.parent
        if up.parent:
            self.here = up.parent

    def handle_data(self, data):
        self.here.children.append(data)

    def handle_entityref(self, name):
        self.here.children.append(f"&{name};")

    def handle_charref(self, name):
        self.here.children.append(f"&#{name};")


def parts_of(root):
    for tag in ("main", "article"):
        found = [n for n in root.all() if n.tag == tag and not any(u.marked() for u in up(n))]
        outer = [n for n in found if not n.within(found)]
        if outer:
            return outer
    node = root
    while True:
        inner = [c for c in node.children if isinstance(c, Node) and c.tag not in INLINE and c.tag not in PARAGRAPHS]
        most = max(inner, key=Node.mass, default=None)
        if most is None or not most.mass() or most.mass() < 0.75 * node.mass():
            return [node]
        node = most


def up(node):
    while node.parent is not None:
        yield node
        node = node.parent


def subjects(root):
    return [n for n in root.all() if n.parent and n.tag not in INLINE and n.tag not in ("html", "body", "head", "main", "article") and n.children]


def brute(pages):
    """The rule in plain loops: {page_id: text}."""
    trees = {h: Tree(h or "").root for _, _, h in pages}
    host = {i: re.sub(r"^[^/]*//([^/?#]*).*", r"\1", u or "\0", flags=re.S).lower() for i, u, _ in pages}
    out = {}
    for name in set(host.values()):
        distinct = {h for i, _, h in pages if host[i] == name}
        votes = defaultdict(list)
        for h in distinct:
            parts = parts_of(trees[h])
            around = {a for p in parts for a in (p, *up(p))}
            speaks = {}
            for n in subjects(trees[h]):
                inside = n.within(parts)
                speaks["shape", n.shape()] = speaks.get(("shape", n.shape()), True) and not inside and n not in around
                if not (inside and n.tag in PARAGRAPHS):
                    speaks["full", n.full()] = True
            for k, v in speaks.items():
                votes[k].append(v)
        template = {k for k, v in votes.items() if len(v) >= 4 and len(v) >= min(0.5 * len(distinct), 32) and sum(v) >= 0.6 * len(v)}
        for i, _, h in pages:
            if host[i] == name:
                out[i] = text_of(trees[h], template if len(distinct) >= 4 else None)
    return out


def text_of(root, template):
    parts = parts_of(root)
    around = {a for p in parts for a in (p, *up(p))}
    gone = set()
    if template is not None:
        go = [n for n in subjects(root) if n.within(parts) and n.tag not in PARAGRAPHS and ("full", n.full()) in template]
        go = [n for n in go if not n.within(go)]
        left = sum(len(" ".join(c.split())) for n in root.all() if (n.within(parts) or n in around) and not n.within(go) and n not in go and not any(u.tag in {"h1", "h2", "h3", "h4", "h5", "h6"} | NEVER for u in up(n)) and n.tag != "a" for c in n.children if isinstance(c, str))
        if left >= sum(n.mass() for n in go) / 4:
            gone = set(go)
    mains = [n for n in parts if n.tag in ("main", "article")]

    def walk(node, inside):
        if node.tag in NEVER or node in gone:
            return ""
        if template is None:
            if node not in mains and not (mains and node in around) and (node.marked() or node.tag == "header" and not inside):
                return ""
        elif inside:
            if node.marked():
                return ""
        elif node.parent and node not in around and node.tag not in INLINE and (("full", node.full()) in template or ("shape", node.shape()) in template):
            return ""
        now = inside or node in parts
        body = "".join(walk(c, now) if isinstance(c, Node) else entities.unescape(c) if template is not None or not mains or now else "" for c in node.children)
        return f" {body} " if node.tag not in INLINE or node.tag == "br" else body

    return " ".join(walk(root, False).split())


def run(spark, pages, **options):
    return {r.page_id: r.text for r in html.extracted(spark.createDataFrame(pages, "page_id long, url string, html string"), **options).collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_html_equals_an_independent_tree(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    pages += [(100_001, None, None), (100_002, pages[0][1], "")]
    assert run(spark, pages) == brute(pages)


def test_the_template_decides_in_the_query(spark):
    """Without what Spark has counted nearly every text of a host with several pages would be another one."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    found = run(spark, [tuple(r) for r in rows])
    assert sum(found[r.page_id] != html.main_text(r.html, set()) for r in rows) > 0.9 * len(rows)


SHARED = [(6, 4), (8, 4), (8, 5), (40, 32), (40, 40)]
BODIES = ["<div>%s</div>", "%s", "<section>%s</section><section>%s</section>", "<p>By someone %d</p><div><div>%s</div></div>"]


def test_stories_that_pages_share_are_kept(spark):
    """On each host some pages carry one story under several headlines."""
    story = "<p>" + "The same story stands under several headlines of one site. " * 6 + "</p><p>It has two parts.</p>"
    rows, of = [], {}
    for host, (pages, shared, body) in enumerate((p, n, b) for p, n in SHARED for b in BODIES):
        for i in range(pages):
            own = story if i < shared else f"<p>A story of its own number {i}. " + f"It goes on for a while {i}. " * 9 + "</p>"
            inner = body.replace("%s", own).replace("%d", str(i))
            of[len(rows)] = (i, i < shared)
            rows.append((len(rows), f"http://h{host}/{i}", f"<body><nav><a href='/'>Home</a></nav><article><h1>Title {i}</h1>{inner}</article><footer>Foot of {i}</footer></body>"))
    found = run(spark, rows)
    for k, (i, same) in of.items():
        assert found[k].startswith(f"Title {i}") and ("The same story" in found[k] if same else f"number {i}" in found[k]), rows[k]
        assert "Home" not in found[k] and "Foot" not in found[k], rows[k]


def test_few_pages_are_left_to_names(spark):
    page = "<body><div class='menu'>Menu</div><div class='text'><p>Words of page %d</p></div><div id='comments'>No</div></body>"
    assert run(spark, [(i, "http://h/", page % i) for i in range(3)]) == {i: f"Words of page {i}" for i in range(3)}
