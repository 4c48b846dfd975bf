import math
import random
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

from claimscope.llm import ctw, decontamination, extraction

DOCS = "doc_id long, text string, score double, item_id string, n_bytes int"


# --- context-tree weighting ---


def test_streams_equal_joined_words():
    draw = random.Random(2)
    for _ in range(400):
        texts = ["".join(draw.choice("abB \n\té\x0b") for _ in range(draw.choice([3, 9, 60]))) for _ in range(draw.randint(1, 5))]
        want = [b" ".join(t.encode().lower().split()) + b"\n" for t in texts]
        reads = [ctw.Stream(g) for g in ctw.pieces(texts, draw.choice([4, 12, 1000]))]
        padded = [b"\n" * ctw.DEPTH + w for w in want]
        grams = [(k, int.from_bytes(bytes(reversed(w[at - ctw.DEPTH : at])) + w[at : at + 1], "big")) for k, w in enumerate(padded) for at in range(ctw.DEPTH, len(w))]
        assert [(k, g) for r in reads for k, g in zip(r.text.tolist(), r.grams().tolist(), strict=True)] == grams
        assert b"".join(r.bytes.tobytes() for r in reads) == b"".join(want) and [k for r in reads for k in r.ends.tolist()] == list(range(len(texts)))
        words = [(k, w) for k, t in enumerate(texts) for w in t.encode().lower().split()]
        found = [(k, h) for r in reads for k, h in zip(r.word_text.tolist(), r.words.tolist(), strict=True)]
        assert [k for k, _ in words] == [k for k, _ in found]
        assert len({(w, h) for (_, w), (_, h) in zip(words, found, strict=True)}) == len({w for _, w in words}) == len({h for _, h in found})


def _kt(zeros: float, ones: float) -> float:
    return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(zeros + ones + 1)


class _Plain:
    """Context-tree weighting node by node."""

    def __init__(self, streams: list[bytes]):
        self.n: dict = defaultdict(lambda: [0, 0])
        self.children: dict = defaultdict(set)
        for s in streams:
            x = b"\n" * ctw.DEPTH + s
            for at in range(ctw.DEPTH, len(x)):
                for depth in range(ctw.DEPTH + 1):
                    for j in range(8):
                        node = (x[at - depth : at], (1 << j) | (x[at] >> (8 - j)))
                        self.n[node][x[at] >> (7 - j) & 1] += 1
                        if depth:
                            self.children[node[0][1:], node[1]].add(node)
        self.known: dict = {}

    def weighted(self, node) -> float:
        if node not in self.known:
            own = _kt(*self.n[node])
            self.known[node] = own if len(node[0]) == ctw.DEPTH else float(np.logaddexp(own, sum(self.weighted(c) for c in self.children[node]))) - math.log(2)
        return self.known[node]

    def log10(self, s: bytes) -> float:
        x, total = b"\n" * ctw.DEPTH + s, 0.0
        for at in range(ctw.DEPTH, len(x)):
            for j in range(8):
                place, bit, q = (1 << j) | (x[at] >> (8 - j)), x[at] >> (7 - j) & 1, None
                for depth in range(ctw.DEPTH, -1, -1):
                    node = (x[at - depth : at], place)
                    if node in self.n:
                        zeros, ones = self.n[node]
                        p = ((zeros, ones)[bit] + 0.5) / (zeros + ones + 1)
                        w = 1.0 if depth == ctw.DEPTH else math.exp(_kt(zeros, ones) - math.log(2) - self.weighted(node))
                        q = p if q is None else w * p + (1 - w) * q
                total += math.log10(0.5 if q is None else q)
        return total


@pytest.mark.parametrize("shard", [4_000_000, 300])
def test_scores_against_plain_context_tree_and_counts(spark, shard, monkeypatch):
    monkeypatch.setattr(ctw, "SHARD_GRAMS", shard)
    draw = random.Random(4)
    rows = [(k, " ".join("".join(draw.choice(["the", "re", "on", "Zü"]) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(0, 25))), 0.0, "x", 1) for k in range(40)]
    rows += [(None, "No id here", 0.0, "x", 1), (50, None, 0.0, "x", 1), (51, "unseen QQ %%", 0.0, "x", 1), (51, "unseen QQ %%", 0.0, "x", 1)]
    words = {t: [*(t or "").encode().lower().split(), b"\n"] for _, t, *_ in rows}
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    training = [t for k, t, *_ in rows if not held(k)]
    c = Counter(w for t in training for w in words[t])
    total, distinct = sum(c.values()), len(c)
    plain = _Plain([b" ".join(words[t][:-1]) + b"\n" for t in training])
    got = sorted(ctw.score(spark.createDataFrame(rows, DOCS)).collect(), key=lambda r: (r["doc_id"] or -1))
    assert len(got) == len(rows)
    for (k, t, *_), r in zip(sorted(rows, key=lambda x: x[0] or -1), got, strict=True):
        if k == 0 or r["doc_id"] == 0:
            continue
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(k), len(words[t]), sum(c[w] > 0 for w in words[t]), total)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in words[t]), rel_tol=1e-9)
        assert math.isclose(r["score"], plain.log10(b" ".join(words[t][:-1]) + b"\n"), rel_tol=2e-3)


def test_a_word_shard_is_one_file(spark, monkeypatch):
    draw = random.Random(8)
    rows = [(k, " ".join("".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(60)), 0.0, "x", 1) for k in range(60)]
    for shard in (400, 100):
        monkeypatch.setattr(ctw, "SHARD_WORDS", shard)
        model = ctw.Trained(spark.createDataFrame(rows, DOCS))
        files = spark.read.parquet(model.words).inputFiles()
        assert model.shards >= 1500 // shard and len(files) <= model.shards
        found = spark.read.parquet(model.words)
        assert (found.count(), found.agg({"n": "sum"}).first()[0]) == (model.distinct, model.total)


def test_scores_of_no_documents(spark):
    assert ctw.score(spark.createDataFrame([], DOCS)).count() == 0


# --- decontamination ---


def _items(draw, n):
    words = ["".join(draw.choice(["ka", "lo", "mi", "te", "su"]) for _ in range(draw.randint(1, 3))) for _ in range(300)]
    return words, [(k, " ".join(draw.choice(words) for _ in range(draw.randint(12, 60))) + ".\nThe answer is " + draw.choice(words)) for k in range(n)]


def test_wand_retrieves_all_above_the_threshold():
    draw = random.Random(1)
    words, items = _items(draw, 60)
    index = decontamination.Index([(k, decontamination.words(t), decontamination.question_words(t)) for k, t in items], decontamination.statistics_of(t for _, t in items))
    for _ in range(200):
        own = [index.vocabulary[w] for w in index.items[draw.randrange(60)][1]]
        terms = [int(np.searchsorted(index.keys, a * index.size + b)) for a, b in zip(own, own[1:], strict=False)]
        terms = list(set(draw.sample(terms, int(len(terms) * draw.random()))) | set(draw.sample(range(len(index.keys)), 30)))
        scores: Counter = Counter()
        for t in terms:
            for at, x in zip(*index.postings(t)[:2], strict=True):
                scores[at] += x
        assert {at for at, _ in index.retrieve(terms)} == {at for at, x in scores.items() if x >= decontamination.THRESHOLD - 1e-9}


def _plain_leaks(items, text):
    """All items by scoring every passage for every item, word by word."""
    split = lambda t: decontamination.words(t)
    known = [(i, split(t), decontamination.question_words(t)) for i, t in items if split(t)]
    terms = [Counter(zip(ws, ws[1:], strict=False)) if len(ws) > 1 else Counter([(ws[0], None)]) for _, ws, _ in known]
    df, mean, n = Counter(t for c in terms for t in c), sum(sum(c.values()) for c in terms) / len(terms), len(terms)
    found = split(text)
    out = set()
    for (item, ws, question), c in zip(known, terms, strict=True):
        impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t, tf in c.items()}
        covered, passage = [False] * len(ws), 128
        while passage < 2 * len(ws):
            passage *= 2
        for start in range(0, max(1, len(found) - passage // 2), passage // 2):
            own = found[start : start + passage + 1]
            there = set(zip(own, own[1:], strict=False)) | {(x, None) for x in own[:passage]}
            if sum(impact[t] for t in impact if t in there) < (0.5 - 1e-9) * sum(impact.values()):
                continue
            near, m = found[max(0, start - passage // 2) : start + passage + passage // 2], min(5, len(ws))
            stands = {tuple(near[k : k + m]) for k in range(len(near) - m + 1)}
            for k in range(len(ws) - m + 1):
                if tuple(ws[k : k + m]) in stands:
                    covered[k : k + m] = [True] * m
        if sum(covered) >= 0.8 * len(ws) or sum(covered[:question]) >= 0.8 * question:
            out.add(item)
    return out


def test_leaks_against_scoring_every_passage():
    draw = random.Random(21)
    words, items = _items(draw, 40)
    items += [(100, "kalo mite su"), (101, words[3]), (102, "日本の首都は東京である"), (103, "what is it " + words[5])]
    index, hits = decontamination.Block(items), 0
    for _ in range(150):
        text = " ".join(draw.choice(words) for _ in range(draw.randint(0, 500)))
        for _, passage in draw.sample(items, draw.randint(0, 3)):
            part = passage.split(" ")
            text += " " + " ".join(part[draw.choice([0, 0, len(part) // 6]) : draw.choice([len(part), len(part), 5 * len(part) // 6])])
        got = {leak.item for leak in index.search(text)}
        assert got == _plain_leaks(items, text)
        hits += len(got)
    assert hits > 100
    assert {leak.item for leak in index.search("昨日、日本の首都は東京であると聞いた")} == {102}


def test_a_leak_is_found_beside_a_passage_that_scores_higher():
    draw = random.Random(22)
    words, items = _items(draw, 20)
    ws = items[4][1].split(" ")
    pairs = [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]
    draw.shuffle(pairs)
    filler = " ".join(f"other{k}" for k in range(400))
    text = " ".join(ws[: int(0.86 * len(ws))]) + " " + filler + " " + " zz ".join(pairs)
    assert [leak.item for leak in decontamination.Block(items).search(text)] == [4]


def test_leaks_in_documents_of_all_kinds(spark):
    draw = random.Random(7)
    words, items = _items(draw, 30)
    filler = lambda n: " ".join(draw.choice(words) for _ in range(n))
    rows, want = [], set()
    for k in range(60):
        text = filler(draw.randint(0, 400))
        if k % 3 == 0:
            item, passage = items[k // 3]
            edited = passage.split(" ")
            if k % 2:
                edited[len(edited) // 2] = "changed"
            text += " " + " ".join(edited).upper() + ", " + filler(draw.randint(0, 300))
            want.add((k, item))
        rows.append((k, text, 0.0, "x", 1))
    rows += [(100, None, 0.0, "x", 1), (None, "### " + items[3][1], 0.0, "x", 1), (101, "", 0.0, "x", 1), (102, "of " * 100000, 0.0, "x", 1), (103, items[4][1][: len(items[4][1]) // 3], 0.0, "x", 1)]
    want.add((None, 3))
    docs = spark.createDataFrame(rows, DOCS)
    benchmark = spark.createDataFrame([*items, (900, None), (901, "two words"), (902, "")], "item_id long, text string")
    got = decontamination.leaks(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and all(r["question_overlap"] >= 0.8 for r in got)
    clean = decontamination.drop_leaked(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == len(rows) - len(want)
    assert decontamination.leaks(docs.limit(0), benchmark).count() == 0 and decontamination.leaks(docs, benchmark.limit(0)).count() == 0


def _scored(docs, benchmark):
    return {(r["doc_id"], r["item_id"]): (r["score"], r["question_overlap"], r["answer_overlap"]) for r in decontamination.leaks(docs, benchmark).collect()}


def _mixed(draw, items, words, n):
    """Texts that hold parts of items, and pairs of theirs scattered in other words."""
    out = []
    for k in range(n):
        parts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 200)))]
        for _, passage in draw.sample(items, draw.randint(0, 3)):
            ws = passage.split(" ")
            low = draw.randint(0, len(ws) // 3)
            parts.append(" ".join(ws[low : low + draw.randint(len(ws) // 2, len(ws))]))
        draw.shuffle(parts)
        out.append((k, " ".join(parts), 0.0, "x", 1))
    return out


@pytest.mark.parametrize("block", [4, 13])
def test_blocks_change_neither_leaks_nor_scores(spark, monkeypatch, block):
    draw = random.Random(9)
    words, items = _items(draw, 40)
    items += [(50, items[3][1]), (None, items[5][1]), (51, "kalo"), (52, None), (53, "")]
    docs = spark.createDataFrame(_mixed(draw, items[:40], words, 80), DOCS)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one = _scored(docs, benchmark)
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", block)
    several = _scored(docs, benchmark)
    assert len(one) > 30 and one.keys() == several.keys()
    assert all(x == y or all(a == b or math.isclose(a, b, rel_tol=1e-12) for a, b in zip(x, y, strict=True)) for x, y in ((one[k], several[k]) for k in one))
    assert decontamination.drop_leaked(docs, benchmark).count() == 80 - len({d for d, _ in one})


def test_a_long_item_changes_no_passage_of_others(spark):
    draw = random.Random(10)
    words, items = _items(draw, 40)
    docs = spark.createDataFrame(_mixed(draw, items, words, 80), DOCS)
    long = (99, " ".join(f"unrelated{k}" for k in range(3000)))
    plain, more = (_scored(docs, spark.createDataFrame(rows, "item_id long, text string")) for rows in (items, [*items, long]))
    assert len(plain) > 30 and plain.keys() == more.keys() and all(plain[k][1:] == more[k][1:] for k in plain)


# --- extraction ---

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<div id="menu"><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div class="cookie-notice">We use cookies, and so on.</div>
<div class="cols"><div class="main-col"><h1>Real title</h1><p>First part, with <a href=x>a link</a> and&nbsp;more. It goes on, for
a while.<p>Second &amp; last <b>bold</b><br>line &lt;x&gt;, and the rest of it.<h2>Sub</h2><ul><li>item one, here</li><li>item two</li></ul></div>
<div class="sidebar"><p>Side text, long enough to be a problem. It goes on, and on.</p></div></div>
<div id="comments"><p>I think that this is great, really. Thanks for it, all.</p></div><form><label>Search</label></form>
<script>var a="<p>x</p>";</script><!-- <p>no</p> --><footer>(c)</footer></body></html>"""
TEXT = "Real title\nFirst part, with a link and more. It goes on, for a while.\nSecond & last bold line <x>, and the rest of it.\nSub\nitem one, here\nitem two"


def test_main_text_without_boilerplate():
    assert extraction.main_text(PAGE) == TEXT
    marked = '<body><div class="ad">Buy, now.</div><article><h1>T</h1><p><b>A, a. Aa.<br><p>B, b. Bb.</p><aside>no</aside><article class="comment"><p>I say so, too. Really.</p></article></article><p>After, it all. Really.</p><footer>f</footer>'
    assert extraction.main_text(marked) == "T\nA, a. Aa.\nB, b. Bb."
    assert extraction.main_text('<div class="has-sidebar"><div class="entry-header"><h1>T</h1></div><p>Text, it is.</p></div><div class="page-footer">f, f.</div>') == "T\nText, it is."
    assert extraction.main_text("<article><p>cut off here <b") == "cut off here"


def test_foreign_elements_end_and_form_controls_hold_no_text():
    assert extraction.main_text("<p>One, one.</p><svg/><p>Two <svg><title>no</title><text>no</text></svg>two, two.</p><select><option>no</select><p>Three<math/> three, <math><mi>x</mi></math>.</p>") == "One, one.\nTwo two, two.\nThree three, x."


def test_ratios_decide_without_marked_articles():
    """Pages of plain div elements: long paragraphs among link lists, an advert and a footer; and a short main beside the text."""
    draw, found, wrong, right = random.Random(11), 0, 0, 0
    prose = lambda n: " ".join("".join(draw.choice(["ka", "lo", "mi", "te"]) for _ in range(draw.randint(1, 4))) + draw.choice(["", "", "", ",", "."]) for _ in range(n)) + "."
    for _ in range(60):
        parts = [prose(draw.randint(20, 120)) for _ in range(draw.randint(3, 12))]
        links = "".join(f"<li><a href=x>{prose(2)}</a></li>" for _ in range(8))
        page = f"<body><div><ul>{links}</ul></div><div>{prose(8)}</div><div class=post><h1>{prose(5)}</h1>{''.join(f'<p>{p}</p>' for p in parts)}<ul>{links}</ul></div><div>&copy; {prose(5)}</div></body>"
        got = extraction.main_text(page).split("\n")
        found, wrong, right = found + len(parts), wrong + sum(x not in parts for x in got[1:]), right + sum(p in got for p in parts)
    assert right == found and wrong <= 0.05 * found
    beside = extraction.main_text(f"<main><p>Short, it is.</p></main><div class=post><p>{parts[0]}</p><p>{parts[1]}</p><p>{parts[2]}</p></div>").split("\n")
    assert parts[0] in beside and parts[2] in beside and "Short, it is." in beside


LONG = "<p>Text it is, and long. With more of it, and more, until it ends here.</p>" * 3
LINES = "\n".join(["Text it is, and long. With more of it, and more, until it ends here."] * 3)


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<html><head><title>x</title><body><article>{LONG}</article>", LINES),
        (f"<html><head><title>x</title><div class=post>{LONG}</div>", LINES),
        ("<html><head><meta charset=a><link rel=x>Plain text, and more of it.", "Plain text, and more of it."),
        ("<head><title>x</title><b>Bold, it is.</b>", "Bold, it is."),
        (f"<head><style>p{{}}</style><script>x</script></head><body>{LONG}", LINES),
        (f"<body><form id=f><input type=hidden><div class=post>{LONG}</div><input type=text></form>", LINES),
        (f"<body><form id=f><select><option>no</select><input><input><input><article><p>Short, it is.</p></article></form>", "Short, it is."),
        (f"<body><div class=post>{LONG}</div><form><p>Subscribe to our news, it is free.</p><input><button>Go</button></form>", LINES),
        (f"<body><div class=post>{LONG}</div><form><textarea>no</textarea><p>Say what you think, please.</p></form>", LINES),
        (f"<article>{LONG}<h2>Sources</h2><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></article>", f"{LINES}\nSources\nOne\nTwo"),
        (f"<body><ul><li><a href=1>no</a></ul><div class=post>{LONG}<table><tr><td>1</td><td>two</td></tr></table><pre>code x</pre></div>", f"{LINES}\n1\ntwo\ncode x"),
    ],
)
def test_no_part_of_a_page_is_lost(page, text):
    assert extraction.main_text(page) == text


def test_bare_boxes_beside_an_article_are_no_content():
    """A page of div elements alone: links, an advert, the article, a footer."""
    links = "".join(f"<li><a href=x>word{k}</a></li>" for k in range(6))
    page = f"<body><div><ul>{links}</ul></div><div>Buy this, now and here. It is cheap.</div><div><h1>The title, it is</h1>{LONG}</div><div>(c) some.example, all of it.</div>"
    assert extraction.main_text(page) == f"The title, it is\n{LINES}"


class _Reader(HTMLParser):
    """Block texts of well-formed pages by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.words, self.never = [], [], 0

    def flush(self):
        text = " ".join("".join(self.words).split())
        if text:
            self.out.append(text)
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "a", "br"):
            if tag not in ("script", "style"):  # they part no text
                self.flush()
            self.never += tag in ("nav", "aside", "footer", "script", "style")
        elif tag == "br":
            self.words.append(" ")

    def handle_endtag(self, tag):
        if tag not in ("b", "a"):
            if tag not in ("script", "style"):
                self.flush()
            self.never -= tag in ("nav", "aside", "footer", "script", "style")

    def handle_data(self, data):
        if not self.never:
            self.words.append(data)


def test_blocks_equal_those_of_another_parser():
    draw = random.Random(31)

    def inline(n):
        return "".join(draw.choice(["word ", "two, ", "x &amp; y ", "&eacute;t&#233; ", "<b>bold</b> ", "<a href='a>b'>link</a> ", "<br>", "1 &lt; 2 ", "\n\t", "<!-- no -->"]) for _ in range(n))

    def nested(depth):
        tag = draw.choice(["div", "section", "p", "ul", "blockquote", "nav", "aside", "footer", "table", "h2", "script"])
        if tag == "script":
            return "<script>if (a < b) { '<p>no</p>' }</script>"
        if tag in ("p", "h2") or not depth:
            return f"<p class='c{draw.randint(1, 9)}'>{inline(4)}</p>"
        inner = [f"<li>{inline(3)}</li>" if tag == "ul" else f"<tr><td>{inline(2)}</td><td>{inline(2)}</td></tr>" if tag == "table" else draw.choice([nested(depth - 1), inline(2)]) for _ in range(draw.randint(1, 4))]
        return f"<{tag}>{''.join(inner)}</{tag}>"

    for _ in range(300):
        page = f"<html><head><title>no</title><style>p {{}}</style></head><body>{''.join(nested(4) for _ in range(4))}</body></html>"
        reader = _Reader()
        reader.feed(page[page.index("<body>") :])
        reader.flush()
        assert [b.text for b in extraction.blocks(page)] == reader.out


def _plain_scores(found):
    """The scores by their definition, path by path."""
    paths = list(dict.fromkeys(b.path for b in found))
    of = {p: [b for b in found if b.path == p] for p in paths}
    texts = {c: sum(max(0, len(b.text) - b.linked) for b in found if b.container == c) for c in {b.container for b in found}}
    plain = {p: max(0.0, 1 - sum(b.linked for b in of[p]) / sum(len(b.text) for b in of[p])) for p in paths}
    ratio = {p: (plain[p] * sum(len(b.text) for b in of[p]) / len(of[p]), plain[p] * (1 + sum(len(extraction._PUNCTUATION.findall(b.text)) for b in of[p])) / len(of[p])) for p in paths}

    def share(container):
        above = container.rpartition("/")[0]
        own = math.sqrt(texts.get(container, 0) / (max(texts.values()) or 1))
        return max(own, share(above) * (0.5 if container.rpartition("/")[2].split(".")[0] in ("div", "section", "td", "#") else 1) if above else 0)

    out = {}
    for k, p in enumerate(paths):
        near = paths[max(0, k - 1) : k] + paths[k + 1 : k + 2]
        length, marks = (ratio[p][i] * (1 - 0.25 * len(near)) + 0.25 * sum(ratio[q][i] for q in near) for i in (0, 1))
        out[p] = plain[p] * math.sqrt(length * marks) * share(of[p][0].container) * extraction._prior(p)
    return out


def test_scores_against_their_definition():
    draw = random.Random(12)
    for _ in range(200):
        page = "".join(draw.choice(["<div>", "</div>", "<p>", "</p>", "<ul><li>", "</ul>", "<a href=x>link, it is</a>", "Some text, with marks. ", "more ", "<div class=ad>", "<main>", "</main>", "<section>", "</section>"]) for _ in range(60))
        found = extraction.blocks(page)
        if found:
            want, got = _plain_scores(found), extraction.scores(found)
            assert want.keys() == got.keys() and all(math.isclose(want[p], got[p], rel_tol=1e-9, abs_tol=1e-12) for p in want)


@pytest.mark.parametrize("page", ["", "<", "<p " + "a" * 50000 + '"', '<p a="' * 5000, "<div>" * 5000 + "<p>x", "<!--" * 5000, "<script>" * 5000, "</p>" * 5000, "&#0;&bogus;" * 100, "<p><p>" * 20000, "<svg>" * 50000])
def test_broken_pages_end(page):
    assert isinstance(extraction.main_text(page), str)


def test_pages_of_all_kinds(spark):
    rows = [(1, "u", PAGE, "x", 1), (2, None, None, "x", 1), (None, "v", "", "x", 1), (3, "w", "<p>" + "long text, " * 90000 + "</p>", "x", 1), (1, "u", PAGE, "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r["page_id"] or -1, r["url"] or "", r["n_chars"]) for r in extraction.extract(pages).collect())
    assert got == [(-1, "v", 0), (1, "u", len(TEXT)), (1, "u", len(TEXT)), (2, "", 0), (3, "w", 11 * 90000 - 1)]
    assert extraction.extract(pages.limit(0)).count() == 0
