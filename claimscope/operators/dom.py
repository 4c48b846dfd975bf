"""Rule-driven extraction for arbitrary sites: selectors over a recovered element tree, in Arrow batches.

The regular expressions of ``functions.html`` suffice for pages of known structure; site rules with nested selectors
need the tree. Pages are joined with their site's rules first, so only url, html and the rules enter Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.urls import registered_domain
from claimscope.operators.paragraphs import by_mode
from claimscope.rules import TITLE_NOTE

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol li table section article header footer nav blockquote form pre".split())
_STEP = re.compile(r"(?P<tag>[a-zA-Z][\w-]*|\*)?(?:#(?P<id>[\w-]+))?(?:\.(?P<cls>[\w-]+))?(?:\[(?P<attr>[\w-]+)=(?:\"(?P<quoted>[^\"]*)\"|(?P<bare>[^\]]*))\])?$")


#: Site rules, and ban lines, that may be sent to every task.
MOST_RULES = 100_000
#: Pages of an Arrow batch that a task holds as trees, paragraphs and results at a time.
PAGES_AT_ONCE = 64


class Element:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in ("script", "style"):
                todo += reversed(node.children)
        return "".join(out)

    def below(self) -> Iterator[Element]:
        todo = list(reversed(self.children))
        while todo:
            node = todo.pop()
            if isinstance(node, Element):
                yield node
                todo += reversed(node.children)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:  # a block ends an open paragraph
            node = self.at
            while node.parent is not None and node.tag not in ("p", "div", "article", "section", "body", "td"):
                node = node.parent
            if node.tag == "p":
                self.at = node.parent
        new = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(new)
        if tag not in _VOID:
            self.at = new

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(page: str) -> Element:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    root, builder.at = builder.root, None
    for node in root.below():
        node.parent = None  # no circles: a tree is freed with its page, not by a later collection
    return root


def _matches(node: Element, step: re.Match) -> bool:
    tag, key, cls, attr = step["tag"], step["id"], step["cls"], step["attr"]
    value = step["quoted"] if step["quoted"] is not None else step["bare"]
    return (
        (tag in (None, "*") or node.tag == tag)
        and (key is None or node.attrs.get("id") == key)
        and (cls is None or cls in node.attrs.get("class", "").split())
        and (attr is None or node.attrs.get(attr) == value)
    )


def select(root: Element, selector: str) -> list[Element]:
    """Elements by a selector of steps (tag, #id, .class, [attr=value]) with descendant and ``>`` combinators, in page order.

    Each step searches below the first match of the one before, as a chain of find calls does.
    """
    # a blank inside brackets belongs to a value
    steps = re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", selector)
    found, child = [root], False
    for k, part in enumerate(steps):
        if part == ">":
            child = True
            continue
        step = _STEP.match(part)
        if step is None:
            raise ValueError(f"unknown selector step: {part}")
        start = found[0]
        pool = (c for c in start.children if isinstance(c, Element)) if child else start.below()
        found, child = [n for n in pool if _matches(n, step)], False
        if not found:
            return []
    return found


def _extracted(page: str, rules: list[tuple[str, str, str, str | None]]) -> tuple[str | None, list[str], str | None, str | None]:
    """Title, paragraphs, stop mode and stop text of the first rule that finds a title."""
    root = tree(page)
    for title_sel, body_sel, mode, text in rules:
        if titles := select(root, title_sel):
            title = titles[0].text().replace(TITLE_NOTE, "").strip()
            return title, [p.text().strip() for p in select(root, body_sel)], mode, text
    return None, [], None, None


def extract(pages: DataFrame, rules: DataFrame, bans: DataFrame) -> DataFrame:
    """(url, domain, title, content) of pages (url, html) whose site has rules; the first rule that finds a title holds.

    ``rules`` and ``bans`` as in ``claimscope.rules``: their sizes are checked before they are sent to all tasks. Pages of
    other sites are left out.
    """
    for name, rows in (("rules", rules), ("ban lines", bans)):
        if rows.limit(MOST_RULES + 1).count() > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} {name}")
    own: dict[str, list] = {}
    for r in rules.where("domain is not null").orderBy("domain", "priority", "title_sel", "body_sel", "stop_mode", "stop_text").collect():
        own.setdefault(r["domain"], []).append((r["title_sel"], r["body_sel"], r["stop_mode"], r["stop_text"]))
    shared = rules.sparkSession.sparkContext.broadcast(own)
    skip, stop = ([r["text"] for r in bans.where((F.col("mode") == m) & F.col("domain").isNull()).collect()] for m in ("skip", "break"))
    site = bans.where("domain is not null").groupBy(F.col("domain").alias("ban_domain")).agg(F.collect_set("text").alias("site_bans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(low, PAGES_AT_ONCE)
                rows = [_extracted(p or "", shared.value[d]) for p, d in zip(part.column(2).to_pylist(), part.column(1).to_pylist(), strict=True)]
                columns = [pa.array([r[k] for r in rows], pa.list_(pa.string()) if k == 1 else pa.string()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["url", "domain", "title", "paragraphs", "mode", "stop_text"])

    sites = rules.select("domain").distinct()
    chosen = pages.select("url", registered_domain(F.col("url")).alias("domain"), "html").join(F.broadcast(sites), "domain", "left_semi")
    read = chosen.select("url", "domain", "html").mapInArrow(run, "url string, domain string, title string, paragraphs array<string>, mode string, stop_text string")
    got = read.join(F.broadcast(site), F.col("domain") == F.col("ban_domain"), "left")
    as_array = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    banned = F.concat(as_array(skip), F.coalesce("site_bans", F.array().cast("array<string>")))
    kept = by_mode(F.col("paragraphs"), F.col("mode"), banned, as_array(stop), F.col("stop_text"))
    return got.where("title is not null").select("url", "domain", "title", F.array_join(kept, "").alias("content"))
