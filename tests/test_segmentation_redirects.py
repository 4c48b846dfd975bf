"""Unknown words by states against all state sequences; redirect chains against walking them."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from claimscope.functions.providers import dictionary_segmenter, with_unknown_words
from claimscope.operators import redirects, segmentation


def _model(spark, texts):
    rows = spark.createDataFrame([(t.split(),) for t in texts], "w array<string>")
    return segmentation.fit(segmentation.state_counts(rows, F.col("w")))


def test_counts_of_states(spark):
    rows = spark.createDataFrame([(["ab", "c", "def"],), ([],), (None,), (["", "x"],)], "w array<string>")
    got = {(r.kind, r.state, r.value): r.n for r in segmentation.state_counts(rows, F.col("w")).collect()}
    assert got == {
        ("start", "B", None): 1, ("start", "S", None): 1, ("emission", "B", "a"): 1, ("emission", "E", "b"): 1, ("emission", "S", "c"): 1, ("emission", "B", "d"): 1, ("emission", "M", "e"): 1, ("emission", "E", "f"): 1,
        ("emission", "S", "x"): 1, ("transition", "B", "E"): 1, ("transition", "E", "S"): 1, ("transition", "S", "B"): 1, ("transition", "B", "M"): 1, ("transition", "M", "E"): 1,
    }


def test_words_are_counted_before_their_characters_are_tagged(spark):
    draw = random.Random(2)
    texts = [[draw.choice(["a", "bc", "def", "g", "𠀀h", ""]) for _ in range(draw.randint(0, 12))] for _ in range(60)]
    want: dict = {}
    for t in texts:
        tags = [(c, "S" if len(w) == 1 else "B" if k == 0 else "E" if k == len(w) - 1 else "M") for w in t for k, c in enumerate(w)]
        cells = [("emission", s, c) for c, s in tags] + [("transition", a[1], b[1]) for a, b in zip(tags, tags[1:], strict=False)] + [("start", s, None) for _, s in tags[:1]]
        for cell in cells:
            want[cell] = want.get(cell, 0) + 1
    counts = segmentation.state_counts(spark.createDataFrame([(t,) for t in texts], "w array<string>"), F.col("w"))
    assert {(r.kind, r.state, r.value): r.n for r in counts.collect()} == want
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    aggregates = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert len(aggregates) == 2 and "Aggregate [word" in aggregates[1]


def test_probabilities_sum_to_one(spark):
    model = _model(spark, ["甲乙 丙 甲丁戊", "丙 丙"]).collect()
    e = {}
    for r in model:
        if r.kind != "emission":
            e.setdefault((r.kind, r.state if r.kind == "transition" else ""), []).append(2.718281828459045**r.logp)
    assert all(sum(x) == pytest.approx(1) for x in e.values()) and len(e) == 5


def test_cut_equals_all_state_sequences(spark):
    model = segmentation.tagger(_model(spark, ["ab c abb", "cab a b", "bb abc c", "c c ab"]))
    draw = random.Random(1)
    for _ in range(200):
        run = "".join(draw.choice("abcz") for _ in range(draw.randint(1, 7)))

        def score(states):
            total = model.start[states[0]] + model.emission(states[0], run[0])
            for k in range(1, len(run)):
                total += model.moves[states[k - 1], states[k]] + model.emission(states[k], run[k])
            return total

        legal = [s for s in product(segmentation.STATES, repeat=len(run)) if s[0] in "BS" and s[-1] in "ES" and all(b in segmentation.FOLLOWS[a] for a, b in zip(s, s[1:], strict=False))]
        assert score(model.states(run)) == pytest.approx(max(map(score, legal)), abs=1e-12)
        assert "".join(model.cut(run)) == run


def test_runs_outside_the_dictionary_become_words(spark):
    model = _model(spark, ["杭研 大厦", "网易 杭研", "杭研 来 了", "小明 来 到", "小红 来 了 到"] * 5)
    dictionary = spark.createDataFrame([("网易", 50), ("大厦", 40), ("来到", 30)], "term string, freq int")
    texts = spark.createDataFrame([("小明来到网易杭研大厦 ok",), ("",), (None,), ("abc",)], "t string")
    plain, known = dictionary_segmenter(dictionary), dictionary_segmenter(dictionary, model)
    got = texts.select(plain(F.col("t")).alias("a"), known(F.col("t")).alias("b")).collect()
    assert tuple(got[0]) == ("小 明 来到 网易 杭 研 大厦 ok", "小明 来到 网易 杭研 大厦 ok")
    assert [tuple(r) for r in got[1:]] == [("", ""), (None, None), ("abc", "abc")]


def test_single_characters_that_are_a_term_together_stay(spark):
    model = segmentation.tagger(_model(spark, ["甲乙 甲乙"]))
    assert with_unknown_words(["甲", "乙", "丙丁", "甲"], {"甲乙": 1.0}, model) == ["甲", "乙", "丙丁", "甲"]
    assert with_unknown_words(["甲", "乙"], {}, model) == ["甲乙"]


def test_model_of_no_texts(spark):
    rows = spark.createDataFrame([], "w array<string>")
    assert segmentation.tagger(segmentation.fit(segmentation.state_counts(rows, F.col("w")))).cut("ab") in (["ab"], ["a", "b"])


def _walk(edges):
    to = {}
    for a, b in edges:
        if a is not None and b is not None:
            to[a] = min(b, to.get(a, b))
    out = {}
    for src in to:
        at, hops = src, 0
        while at in to and hops <= len(to):
            at, hops = to[at], hops + 1
        out[src] = (None, None, True) if at in to else (at, hops, False)
    return out


def _followed(spark, edges):
    links = spark.createDataFrame(edges, "src string, dst string")
    return {r.src: (r.final, r.hops, r.loop) for r in redirects.followed(links).collect()}


def test_a_thousand_hops_and_a_loop(spark):
    edges = [(f"a{k:04}", f"a{k + 1:04}") for k in range(1000)] + [(f"l{k}", f"l{(k + 1) % 3}") for k in range(3)] + [("in", "l1"), ("self", "self")]
    got = _followed(spark, edges)
    assert got == _walk(edges) and got["a0000"] == ("a1000", 1000, False) and got["in"] == (None, None, True)


def test_random_redirects(spark):
    draw = random.Random(7)
    for n in (5, 40, 150):
        edges = [(f"u{draw.randrange(n)}", f"u{draw.randrange(n)}") for _ in range(n)] + [(None, "u1"), ("u2", None)]
        assert _followed(spark, edges) == _walk(edges)


def test_many_links_to_one_target_and_none(spark):
    edges = [(f"s{k}", "hub") for k in range(500)] + [("hub", "end")] + [("s1", "hub")] * 3
    assert _followed(spark, edges) == _walk(edges)
    assert _followed(spark, []) == {}


def test_pages_without_redirects_keep_their_address(spark):
    pages = spark.createDataFrame([(1, "a"), (2, "b"), (3, "x"), (4, None), (5, "p")], "page_id long, url string")
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("p", "q"), ("q", "p")], "src string, dst string")
    assert {r.page_id: r.final_url for r in redirects.resolved(pages, links).collect()} == {1: "c", 2: "c", 3: "x", 4: None, 5: None}
