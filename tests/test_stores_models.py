"""The seen-link store, counters by increments, quarantine, models as artefacts, sentiment of strings, report parts."""

import glob
import math
import re

import pytest
from pyspark.sql import functions as F

from claimscope.functions import html
from claimscope.functions import text as texts
from claimscope.operators import classify, keywords, models, sentiment
from claimscope.operators.counters import Counters
from claimscope.plans import render
from claimscope.session import stored
from claimscope.sources import markers, quarantine
from claimscope.sources.seen import SeenLinks


def _links(spark, *urls):
    return spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k long, url string")


@pytest.fixture
def seen(spark, tmp_path):
    name = f"seen_{abs(hash(str(tmp_path)))}"
    yield SeenLinks(spark, name, str(tmp_path / "seen"), buckets=8, bits=1 << 15)
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_seen_and_unseen_equal_sets(spark, seen):
    asked = _links(spark, "a", "b", None, "c", "a", "x" * 3000)
    assert seen.seen(asked).count() == 0 and seen.unseen(asked).count() == 6  # no store yet
    seen.add(_links(spark, *(f"u{k}" for k in range(500)), "a", "a", None))
    seen.add(_links(spark, "a", "c", "u7"))
    assert sorted(r.url for r in seen.store().collect()) == sorted(["a", "c", *(f"u{k}" for k in range(500))])  # each once
    assert sorted(r.k for r in seen.seen(asked).collect()) == [0, 3, 4]
    assert sorted(r.k for r in seen.unseen(asked).collect()) == [1, 2, 5]


def test_a_full_bitmap_is_corrected_by_the_store(spark, tmp_path):
    own = SeenLinks(spark, "seen_full", str(tmp_path / "full"), buckets=4, bits=16)
    try:
        own.add(_links(spark, *(f"u{k}" for k in range(0, 400, 2))))
        asked = _links(spark, *(f"u{k}" for k in range(400)))
        assert {r.k % 2 for r in own.seen(asked).collect()} == {0} and own.unseen(asked).count() == 200
    finally:
        spark.sql("DROP TABLE seen_full")


def _above(plan, text):
    """The operators from the root down to the line that holds a text."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = plan.split("\n")
    at = next(k for k, line in enumerate(lines) if text in line)
    out, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            out.append(line.lstrip(" :+-"))
            level = depth(line)
    return out[::-1]


def test_the_store_is_not_shuffled(spark, seen):
    seen.add(_links(spark, *(f"u{k}" for k in range(100))))
    plan = seen.seen_addresses(_links(spark, "u1", "v"))._jdf.queryExecution().executedPlan().toString()
    above = _above(plan, "Bucketed: true")
    assert any("SortMergeJoin" in x for x in above) and not any("Exchange" in x for x in above)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # which hides it from the plan
    try:
        assert "SelectedBucketsCount: 1 out of 8" in seen.store().where("url = 'u5'")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def _counted(spark, rows):
    return spark.createDataFrame(rows, "k string, n long, first string")


def test_increments_equal_one_run_and_leave_other_parts_alone(spark, tmp_path):
    counters = Counters(str(tmp_path / "c"), ["k"], {"n": "sum", "first": "min"}, parts=16)
    rows = [(f"k{i % 40}", i, f"2024-{i % 9 + 1}") for i in range(300)] + [(None, 1, "2020"), (None, 2, "2021")]
    for at in range(3):
        assert counters.add(f"i{at}", _counted(spark, rows[at::3]))
    assert not counters.add("i1", _counted(spark, rows[1::3]))
    want = {}
    for k, n, first in rows:
        old = want.get(k, (0, "9"))
        want[k] = (old[0] + n, min(old[1], first))
    current = lambda: {r.k: (r.n, r["first"]) for r in counters.current(spark).collect()}
    assert current() == want
    before = counters.versions(spark)
    files = {p: sorted(glob.glob(f"{tmp_path}/c/data/version={v}/part={p}/*.parquet")) for p, v in before.items()}
    counters.add("one", _counted(spark, [("k3", 1000, "2030")]))
    changed = [p for p, v in counters.versions(spark).items() if before[p] != v]
    assert len(changed) == 1 and current()["k3"] == (want["k3"][0] + 1000, want["k3"][1])
    assert all(sorted(glob.glob(f"{tmp_path}/c/data/version={before[p]}/part={p}/*.parquet")) == files[p] for p in before if p not in changed)
    now = current()
    counters.clean(spark)
    assert current() == now and len(glob.glob(f"{tmp_path}/c/data/version=*/part={changed[0]}")) == 1


def test_an_increment_that_died_counts_once(spark, tmp_path, monkeypatch):
    counters = Counters(str(tmp_path / "c"), ["k"], {"n": "sum"}, parts=4)
    counters.add("a", _counted(spark, [("x", 1, ""), ("y", 2, "")]))

    def die(*args):
        raise InterruptedError

    monkeypatch.setattr(counters, "commit", die)
    with pytest.raises(InterruptedError):
        counters.add("b", _counted(spark, [("x", 10, "")]))
    monkeypatch.undo()
    assert {r.k: r.n for r in counters.current(spark).collect()} == {"x": 1, "y": 2}
    counters.add("b", _counted(spark, [("x", 10, "")]))
    assert {r.k: r.n for r in counters.current(spark).collect()} == {"x": 11, "y": 2}


def test_markers_appear_whole(spark, tmp_path):
    path = str(tmp_path / "m" / "one")
    assert markers.names(spark, str(tmp_path / "m")) == []
    assert markers.put(spark, path, '{"a": "é\\n"}') and not markers.put(spark, path, "other")
    assert markers.get(spark, path) == '{"a": "é\\n"}' and markers.names(spark, str(tmp_path / "m")) == ["one"]


def test_broken_csv_is_kept_with_its_reason(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,title,n\n1,"a, ""b""\nc",5\n2,short\n3,long,4,5\nword,t,6\n7,,\n')
    good, bad = quarantine.csv(spark, str(tmp_path / "x.csv"), "id int, title string, n int")
    assert sorted(tuple(r) for r in good.collect()) == [(1, 'a, "b"\nc', 5), (7, None, None)]
    got = sorted((r[quarantine.RECORD], r[quarantine.REASON]) for r in bad.collect())
    assert got == [("2,short", "too few fields"), ("3,long,4,5", "too many fields"), ("word,t,6", "a value of another type")]
    assert all(r[quarantine.PLACE].endswith("x.csv") for r in bad.collect())
    quarantine.append(bad, str(tmp_path / "q"), F.lit("titles"))
    assert spark.read.parquet(str(tmp_path / "q")).where("source = 'titles'").count() == 3


def test_broken_json_is_kept_with_its_reason(spark):
    bodies = ['[{"title":"t","link":"l"},{"title":"u"},7,null]', "[]", "{}", "[{", None, '"x"', '[{"title":null,"link":"l","more":[1]}]']
    rows = spark.createDataFrame(list(enumerate(bodies)), "k long, body string")
    good, bad = quarantine.json_arrays(rows, "body", {"title": "string", "link": "string"})
    assert [tuple(r) for r in good.collect()] == [(0, 0, "t", "l")]
    assert sorted(((r.k, r.pos, r.reason) for r in bad.collect()), key=repr) == sorted(
        [(0, 1, "without link"), (0, 2, "no object"), (0, 3, "no object"), (2, None, "no array"), (3, None, "no JSON"), (5, None, "no array"), (6, 0, "without title")], key=repr
    )


DOCS = [(1, "good great news"), (2, "bad awful news"), (3, "great win"), (4, "awful loss bad"), (5, "news"), (6, ""), (7, None), (8, "unknownword only")]


def _titles(spark):
    docs = spark.createDataFrame(DOCS, "k long, t string")
    return docs, spark.createDataFrame([(1, "up"), (2, "down"), (3, "up"), (4, "down")], "k long, label string"), texts.tokens(F.col("t"))


def test_only_complete_versions_of_a_model_are_read(spark, tmp_path, monkeypatch):
    docs, labels, words = _titles(spark)
    folder = str(tmp_path / "model")
    with pytest.raises(LookupError):
        models.load(spark, folder)
    assert models.train_titles(docs, labels, "k", words, folder) == 1
    first = {r.k: r.label for r in models.predict_titles(docs, "k", words, models.load(spark, folder)).collect()}
    assert {k: first[k] for k in (1, 2, 3, 4)} == {1: "up", 2: "down", 3: "up", 4: "down"} and not {6, 7} & set(first)

    def die(*args):
        raise InterruptedError

    monkeypatch.setattr(models, "publish", die)
    turned = labels.withColumn("label", F.when(F.col("label") == "up", "down").otherwise("up"))
    with pytest.raises(InterruptedError):
        models.train_titles(docs, turned, "k", words, folder)
    monkeypatch.undo()
    assert models.load(spark, folder).number == 1  # half-written
    assert models.train_titles(docs, turned, "k", words, folder) == 2
    by = lambda version: {r.k: r.label for r in models.predict_titles(docs, "k", words, models.load(spark, folder, version)).collect()}
    assert by(None)[1] == "down" and by(1) == first and models.versions(spark, folder) == [1, 2]


def test_stream_is_predicted_by_the_stored_model(spark, tmp_path):
    docs, labels, words = _titles(spark)
    models.train_titles(docs, labels, "k", words, str(tmp_path / "model"))
    want = {r.k: r.label for r in models.predict_titles(docs, "k", words, models.load(spark, str(tmp_path / "model"))).collect()}
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream, got = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), {}
    run = models.predicting("k", words, str(tmp_path / "model"), lambda rows, batch: got.update({r.k: (r.label, r.version) for r in rows.collect()}))
    stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert got == {k: (label, 1) for k, label in want.items()}


def test_counts_equal_plain_counts_and_texts_stay_where_they_are(spark):
    rows = [(1, "b a b"), (2, "a"), (2, "a c"), (None, "x x"), (None, "x"), (3, ""), (4, None), (5, "zz " * 500 + "the")]
    docs = spark.createDataFrame(rows, "k long, t string")
    want = {}
    for k, t in rows:
        for w in (t or "").split():
            if w != "the":
                want[k, w] = want.get((k, w), 0) + 1
    found = keywords.term_counts(docs, "k", F.filter(F.split("t", " "), lambda w: w != ""), ["the"])
    assert {(r.k, r.term): r.tf for r in found.collect()} == want
    above = _above(found._jdf.queryExecution().executedPlan().toString(), "Generate explode")
    assert sum("Exchange" in x for x in above) == 1 and any("HashAggregate" in x and "partial_count" in x for x in above)  # summed up before


def test_sentiment_of_whole_strings(spark):
    docs, labels, words = _titles(spark)
    counts = keywords.term_counts(docs, "k", words)
    model = sentiment.log_odds(counts, labels.select("k", (F.col("label") == "up").cast("int").alias("positive")), "k")
    odds = {r.term: r.odds for r in model.collect()}
    provider = sentiment.SentimentProvider(model, texts.tokens)
    strings = {1: "great great news", 2: "awful", 3: "", 4: None, 5: "nothing known here", 6: "GREAT awful"}
    got = {r.k: r.score for r in provider.scores(spark.createDataFrame(list(strings.items()), "k long, s string"), "k", "s").collect()}
    for k, s in strings.items():
        total = odds[""] + sum(odds.get(w, 0) for w in re.findall(r"\w{2,}", (s or "").lower()))
        assert got[k] == pytest.approx(1 / (1 + math.exp(-total)))
    assert got[3] == got[4] == got[5] == pytest.approx(0.5) and got[1] > 0.5 > got[2]


def test_report_parts_equal_the_report(spark):
    rows = spark.createDataFrame([("a", k, f"<tr>{k}</tr>") for k in range(7)] + [("b", 9, None), ("b", 8, "<tr>8</tr>")], "site string, k long, row string")
    spark.udtf.register("report_parts", render.report_parts())
    call = "SELECT * FROM report_parts(TABLE({rows}) PARTITION BY (site) ORDER BY (k), 'row'%s)"
    got = {(r.site, r.part): (r.html, r.n, r.k) for r in spark.sql(call % ", 3", rows=rows).collect()}
    assert {k: v[1:] for k, v in got.items()} == {("a", 0): (3, 0), ("a", 1): (3, 3), ("a", 2): (1, 6), ("b", 0): (2, 8)}
    cut = rows.where("site = 'a'").withColumn("part", F.expr("k div 3"))
    assert {("a", r.part): r.html for r in render.report_table(cut, ["part"], "k", "row").collect()} == {k: v[0] for k, v in got.items() if k[0] == "a"}
    assert spark.sql(call % "", rows=rows).count() == 2
    for wrong in ("'none'", "'row', 0"):
        with pytest.raises(Exception, match="column|part"):
            spark.sql(f"SELECT * FROM report_parts(TABLE({{rows}}) PARTITION BY (site) ORDER BY (k), {wrong})", rows=rows).count()


def test_references_are_decoded_once(spark):
    cases = {"a &lt;b&gt; &amp;lt; &copy;": "a <b> &lt; ©", "&#38;lt; &amp;": "&lt; &", "&hellip; &amp;amp; &nbsp;": "… &amp;  ", "x & y &unknown; &#39;": "x & y &unknown; '", "": "", "&": "&", "&amp": "&amp"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in rows.select("t", html.decoded(F.col("t"))).collect()} == cases


def test_prediction_equals_that_of_unit_weights_in_two_exchanges(spark, tmp_path):
    texts = [(1, "good clear good"), (2, "bad noise noise"), (3, "good plain text"), (4, "bad text other"), (5, "unseen")]
    docs = spark.createDataFrame([*texts, (6, None)], "k long, t string")
    labels = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (9, "b")], "k long, label string")
    words = F.split("t", " ")
    counts = stored(keywords.term_counts(docs, "k", words), "counts")
    models.train_titles(docs, labels, "k", words, str(tmp_path / "m"), counts=counts)
    model = models.load(spark, str(tmp_path / "m"))
    unit = keywords.l2_normalised(keywords.weighted(counts, keywords.document_frequency(counts), docs.count()), "k").select("k", "term", "w")
    key = lambda r: (r.k, r.label, round(r.score, 6))
    want = sorted(map(key, classify.predict(unit, classify.fit(unit, labels, "k"), "k").collect()))
    got = models.predict_titles(docs, "k", words, model, counts=counts)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(k#") == 1  # beside the join by the term
    assert sorted(map(key, got.collect())) == want and [r[0] for r in want] == [1, 2, 3, 4]
