"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with its root-to-leaf path of block tags. Per path the text length and the
punctuation per block, both damped by the share of link text, are smoothed over the paths in page order and fused by
their geometric mean. A path counts with its container's share of the page's text (an element inside a container takes
part in that, less so in boxes of its own), headings with the path that they announce, paths inside an article or main
element ``MARKED`` times, and those whose class or id speaks of menus, sidebars,
footers, adverts, notices or comments a tenth. Paths that reach a
share of the best one are the content; inside a marked article a smaller share is enough, and in the elements that hold
content, tables, listings and lists of links are kept with it. Elements that are never part of an article by the meaning of
their tag or role (menus, footers, sidebars, scripts, styles, a page's header) or that are hidden take no part. Nor do
forms, but for those around a page: a form with little text for each of its controls is left out unless an article stands in
it. A head ends where the first element or text of a body begins, whether or not its end is marked.

Nulls: null html is an empty page with an empty text; null page_id and url are passed through. Each page is read by
itself, whole, whatever its length; repeated rows give equal texts and an empty table no rows. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import row_blocks

#: Of the best path's score, outside and inside of a marked article; half the weight of a path goes to its neighbours.
LEAST_SHARE, LEAST_INSIDE, NEIGHBOURS = 0.3, 0.02, 0.25
MARKED, NAMED, BOXED = 20.0, 0.1, 0.5
DEEPEST = 128

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<raw>script|style|textarea|title|iframe|noscript|noembed|noframes|xmp)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\s++|/|[^\s>\"'=/]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']*+))?+)*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*+)[^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SVG_END = re.compile(r"</svg\s*>", re.I)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow msqrt msub msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_NEVER = frozenset("nav footer aside button dialog menu head fieldset input select object template audio video canvas map".split())
#: Elements that a head may hold (of those that are not read whole or void).
_OF_HEAD = frozenset("head template object".split())
_CONTROLS = frozenset("input select textarea button".split())
_UNSEEN = re.compile(r"""type\s*=\s*["']?hidden""", re.I)
#: Characters of text for each control from which a form is a page, or a part of one, rather than a form.
FORM_TEXT = 100
#: What is kept in an element that holds content, whatever its ratios are.
_KEPT = frozenset("table tbody thead tfoot tr td th caption pre ul ol li dl dt dd blockquote figure figcaption".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_MAIN = frozenset("article main".split())
_CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key ends an open element of these tags first.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names the bare text of an element among what the element holds.
BARE = "#"
#: Boxes that stand apart from what is around them.
_BOXES = frozenset(["div", "section", "td", BARE])
#: What a class or id calls menus, sidebars, footers, adverts, notices and reader comments, and words that say that it
#: stands around them.
_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsored cookie cookies consent notice newsletter nav navigation menu breadcrumbs sidebar footer related share social "
    "comment comments commentlist disqus replies respond".split()
)
_AROUND = frozenset("has with no without wrapper container layout".split())
_PART = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?、。，．；！？…]")
_DIGITS = re.compile(r"\d+")


class Block(NamedTuple):
    path: str
    container: str
    text: str
    linked: int
    heading: bool
    form: int = 0  # the form around it, from 1


def _attributes(attrs: str) -> tuple[str, bool]:
    """What names an element, and whether it is never content."""
    name, never = "", False
    for key, *values in _ATTR.findall(attrs):
        value, key = next((v for v in values if v), ""), key.lower()
        if key in ("class", "id"):
            name += "." + _DIGITS.sub("", value).replace("/", "").replace(" ", ".")
        elif key == "role":
            never = never or value.lower() in _ROLES
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            never = True
        elif key == "style":
            never = never or "display:none" in value.replace(" ", "").lower()
    return name, never


def blocks(page: str) -> list[Block]:
    """The blocks of a page that may be content, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool]] = []  # tag, path, no content
    never = within = 0  # open elements that are no content, or that are an article
    words: list[str] = []
    links = linked = 0
    forms: list[int] = []  # open ones
    controls, whole = [0], [True]  # per form: its controls, whether an article stands in it

    def flush() -> None:
        nonlocal linked
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                path = stack[-1][1] if stack else ""
                # headings and paragraphs belong to the element around them; bare text of an element counts by itself
                container = path.rpartition("/")[0] if stack and stack[-1][0] not in ("div", "section", "article", "main", "body", "td") else f"{path}/{BARE}"
                out.append(Block(path, container, text, linked, bool(stack) and stack[-1][0] in _HEADINGS, forms[-1] if forms else 0))
            words.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal never, within
        flush()
        while len(stack) > upto:
            tag, _, bad = stack.pop()
            never -= bad
            within -= tag in _MAIN
            if tag == "form":
                forms.pop()

    def end_head() -> None:
        at = next((k for k, (tag, _, _) in enumerate(stack) if tag == "head"), None)
        if at is not None and stack[-1][0] == "head":
            close(at)

    after, pictures = 0, True  # the end of the picture that is being left out; whether one can still be closed
    for m in _TOKEN.finditer(page):
        if m.start() < after:
            continue
        text = m["text"]
        if text is not None:
            if never and stack[-1][0] == "head" and not text.isspace():
                end_head()
            if not never:
                words.append(text)
                if links:
                    linked += len(text)
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if forms and (m["raw"] or "").lower() == "textarea":
                controls[forms[-1]] += 1
            continue
        tag, end = tag.lower(), m["end"] or m["end2"]
        if forms and not end and tag in _CONTROLS:
            controls[forms[-1]] += not _UNSEEN.search(m["attrs"] or "")
        if never and not end and stack[-1][0] == "head" and tag not in _OF_HEAD and tag not in _VOID:
            end_head()
        if tag == "svg":  # a picture, left out with all that it holds; one that is never closed holds nothing
            if pictures and not end and not m[0].endswith("/>"):
                closed = _SVG_END.search(page, m.end())
                pictures, after = closed is not None, closed.end() if closed else after
            continue
        if tag in _INLINE:
            if tag == "a":
                links = 0 if end else 1
            continue
        if tag in _VOID:
            if tag != "hr":
                words.append(" ")
            else:
                flush()
            continue
        links = 0
        if end:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if at is not None:
                close(at)
            else:
                flush()
            continue
        while stack and stack[-1][0] in _CLOSED_BY_BLOCK:
            close(len(stack) - 1)
        if siblings := _SIBLINGS.get(tag):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in siblings:
                    close(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        flush()
        name, bad = _attributes(m["attrs"]) if m["attrs"] else ("", False)
        bad = tag not in ("html", "body", *_MAIN) and (bad or tag in _NEVER or tag == "header" and not within)
        above = stack[-1][1] if stack else ""
        # deeper elements share the path of the last named one: paths stay short on runaway nesting
        stack.append((tag, f"{above}/{tag}{name}" if len(stack) < DEEPEST else above, bad))
        never += bad
        within += tag in _MAIN
        if tag == "form":
            controls.append(0)
            whole.append(False)
            forms.append(len(controls) - 1)
        elif tag in _MAIN:
            for form in forms:
                whole[form] = True
    close(0)
    text_of = [0] * len(controls)
    for b in out:
        text_of[b.form] += len(b.text)
    return [b for b in out if whole[b.form] or text_of[b.form] >= FORM_TEXT * controls[b.form]]


def _prior(path: str) -> float:
    """What the path's names say before its text is looked at."""
    parts = path.split("/")
    tags = [x.partition(".")[0] for x in parts]
    words = [{p.lower() for p in _PART.split(name)} for x in parts for name in x.split(".")[1:]]
    named = any(not _NAMES.isdisjoint(w) and _AROUND.isdisjoint(w) for w in words)
    return (MARKED if not _MAIN.isdisjoint(tags) else 1.0) * (NAMED if named else 1.0)


def scores(found: list[Block]) -> dict[str, float]:
    """The score of each path, in page order."""
    paths: dict[str, list[float]] = {}  # length, punctuation, blocks, linked
    own: dict[str, float] = {}  # text that is no link, by container
    announces: dict[str, str] = {}  # the path after a heading's path, in its container
    heading: Block | None = None
    for b in found:
        sums = paths.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        for k, x in enumerate((len(b.text), len(_PUNCTUATION.findall(b.text)), 1, b.linked)):
            sums[k] += x
        own[b.container] = own.get(b.container, 0.0) + max(0, len(b.text) - b.linked)
        if heading and not b.heading and b.path.startswith(heading.container.rpartition("/")[0]):
            announces.setdefault(heading.path, b.path)
        heading = b if b.heading else None
    names, priors = list(paths), {p: _prior(p) for p in paths}
    plain = [max(0.0, 1 - linked / max(length, 1)) for length, _, _, linked in paths.values()]
    ratios = [(p * length / n, p * (1 + marks) / n) for p, (length, marks, n, _) in zip(plain, paths.values(), strict=True)]
    most = max(own.values()) or 1.0

    @lru_cache(maxsize=None)
    def share(container: str) -> float:
        if not container:
            return math.sqrt(own.get(container, 0.0) / most)
        above, _, last = container.rpartition("/")
        inherited = share(above) * (BOXED if last.partition(".")[0] in _BOXES else 1.0) if above else 0.0
        return max(math.sqrt(own.get(container, 0.0) / most), inherited)

    containers = {b.path: b.container for b in found}
    out: dict[str, float] = {}
    for k, name in enumerate(names):
        near = [ratios[j] for j in (k - 1, k + 1) if 0 <= j < len(names)]
        smooth = [(1 - NEIGHBOURS * len(near)) * ratios[k][i] + NEIGHBOURS * sum(x[i] for x in near) for i in (0, 1)]
        out[name] = plain[k] * math.sqrt(smooth[0] * smooth[1]) * share(containers[name]) * priors[name]
    for path, following in announces.items():
        out[path] = max(out[path], min(1.0, priors[path] / priors[following]) * out[following])
    return out


def content(found: list[Block]) -> list[str]:
    """The texts of the content blocks."""
    if not found:
        return []
    by_path = scores(found)
    best = max(by_path.values())
    inside = {p: _prior(p) >= MARKED for p in by_path}
    core = {p for p, x in by_path.items() if x > 0 and x >= (LEAST_INSIDE if inside[p] else LEAST_SHARE) * best}
    chosen = core | {p for p in by_path if inside[p] and not by_path[p]}  # links alone, but in the article
    # tables, listings and lists in a content element go with it, unless they are in a box of their own
    around = {b.container for b in found if b.path in core and not b.heading}
    for b in found:
        if b.path not in chosen and by_path[b.path] > 0 and any(_below(b.path, c) for c in around) and _prior(b.path) >= 1:
            chosen.add(b.path)
    return [b.text for b in found if b.path in chosen]


def _below(path: str, container: str) -> bool:
    """Whether a path leads from a container through nothing but tables, listings and lists."""
    if not container or not path.startswith(container + "/"):
        return False
    return all(step.partition(".")[0] in _KEPT for step in path[len(container) + 1 :].split("/"))


def main_text(page: str) -> str:
    return "\n".join(content(blocks(page)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; one pass, no shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches):
            texts = [main_text(x) for x in block.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return chosen.mapInArrow(scan, "page_id long, url string, text string, n_chars long")
