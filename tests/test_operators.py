import math

import numpy as np
from pyspark.sql import functions as F

from claimscope import rules
from claimscope.operators import classify, dom, domains, feedback, keywords, paragraphs


def arrays(spark, rows, expression):
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, p array<string>")
    return [r["x"] for r in frame.select("k", expression(F.col("p")).alias("x")).orderBy("k").collect()]


def test_skip_and_break_rules(spark):
    ban, stop = F.array(F.lit("ban"), F.lit("both")), F.array(F.lit("stop"), F.lit("both"))
    rows = [["a", "ban", "b", "stop", "c"], ["ban"], [], ["both", "a"], ["a", "xstopx", "b"]]
    assert arrays(spark, rows, lambda p: paragraphs.skipped(p, ban)) == [["a", "b", "stop", "c"], [], [], ["a"], ["a", "xstopx", "b"]]
    assert arrays(spark, rows, lambda p: paragraphs.until_line(p, ban)) == [["a"], [], [], [], ["a", "xstopx", "b"]]
    assert arrays(spark, rows, lambda p: paragraphs.skipped_until(p, ban, stop)) == [["a", "b"], [], [], ["a"], ["a", "xstopx", "b"]]
    assert arrays(spark, rows, lambda p: paragraphs.until_containing(p, F.lit("stop")))[4] == ["a"]


def test_row_forms_agree_with_arrays(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "ban"), (1, 3, "b"), (2, 1, "ban"), (3, 1, "c")], "page_id int, pos int, text string")
    lines = spark.createDataFrame([("ban",)], "text string")
    assert sorted(r["text"] for r in paragraphs.rows_without(rows, lines).collect()) == ["a", "b", "c"]
    assert sorted(r["text"] for r in paragraphs.rows_before(rows, lines).collect()) == ["a", "c"]


def test_tf_idf_and_ties(spark):
    docs = spark.createDataFrame([(1, ["x", "x", "y"]), (2, ["y", "z"]), (3, [])], "d int, w array<string>")
    counts = keywords.term_counts(docs, "d", F.col("w"))
    weights = {(r["d"], r["term"]): r["w"] for r in keywords.tf_idf(counts, 3).collect()}
    assert math.isclose(weights[1, "x"], 2 * (math.log(4 / 2) + 1)) and math.isclose(weights[2, "y"], math.log(4 / 3) + 1)
    tied = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (1, "c", 2.0)], "d int, term string, w double")
    assert [r["keywords"] for r in keywords.joined(keywords.top_terms(tied, "d", 2), "d", ",").collect()] == ["c,a"]
    unit = keywords.l2_normalised(keywords.tf_idf(counts, 3), "d").groupBy("d").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect()
    assert all(math.isclose(r["s"], 1.0) for r in unit)


def test_nearest_vectors(spark):
    q = spark.createDataFrame([(0, 1, [1.0, 0.0])], "query_id int, grp int, qv array<double>")
    c = spark.createDataFrame([(1, 1, [2.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 1, [0.0, 0.0]), (4, 2, [1.0, 0.0])], "cand_id int, grp int, cv array<double>")
    assert [(r["cand_id"], r["similarity"]) for r in keywords.nearest(q, c, 2).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0)]


def test_nearest_of_all_against_every_pair(spark):
    draw = np.random.default_rng(3)
    vectors = {k: draw.integers(-2, 3, 6).astype(float).tolist() for k in range(150)} | {150: [0.0] * 6, 151: None}
    rows = spark.createDataFrame(list(vectors.items()), "cand_id long, cv array<double>").repartition(3)
    asked = rows.where("cand_id % 10 = 0").select(F.col("cand_id").alias("query_id"), F.col("cv").alias("qv"))
    got = {(r["query_id"], r["rank"]): (r["cand_id"], r["similarity"]) for r in keywords.nearest_of_all(asked, rows, 4, block=5).collect()}

    def similarity(a, b):
        if not a or not b or not any(a) or not any(b):
            return None
        return round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 6)

    for q in range(0, 151, 10):
        scored = sorted(((similarity(vectors[q], v), k) for k, v in vectors.items() if k != q), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
        assert [got[q, n + 1] for n in range(4)] == [(k, s) for s, k in scored[:4]]
    assert keywords.nearest_of_all(asked.limit(0), rows, 4).count() == 0


def test_longest_suffix_of_a_table(spark):
    suffixes = spark.createDataFrame([("com",), ("co.uk",), ("uk",), ("*.ck",), ("!www.ck",), ("tw",), ("com.tw",), ("github.example.com",)], "suffix string")
    cases = {
        "http://a.b.co.uk/": ("co.uk", "b.co.uk"), "http://b.uk": ("uk", "b.uk"), "http://co.uk/x": ("co.uk", "co.uk"), "http://x.y.gov.ck/": ("gov.ck", "y.gov.ck"), "http://a.www.ck/": ("ck", "www.ck"),
        "https://www.cna.com.tw/news": ("com.tw", "cna.com.tw"), "https://newtalk.tw/": ("tw", "newtalk.tw"), "http://me.github.example.com/": ("github.example.com", "me.github.example.com"),
        "http://a.b.unlisted": ("unlisted", "b.unlisted"), "http://10.0.0.1/": (None, "10.0.0.1"), "http://localhost": (None, "localhost"), "nothing": (None, None), None: (None, None),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id int, url string")
    got = {r["page_id"]: (r["suffix"], r["domain"]) for r in domains.registered(pages, suffixes).collect()}
    assert got == dict(enumerate(cases.values()))


def test_naive_bayes_against_arithmetic(spark):
    weights = spark.createDataFrame([(1, "good", 1.0), (2, "bad", 1.0), (3, "good", 1.0), (4, "new", 1.0)], "d int, term string, w double")
    labels = spark.createDataFrame([(1, "p"), (2, "n")], "d int, label string")
    model = classify.fit(weights, labels, "d")
    got = {(r["label"], r["term"]): r["loglik"] for r in model.collect()}
    assert math.isclose(got["p", "good"], math.log(2 / 3)) and math.isclose(got["n", "good"], math.log(1 / 3))
    assert {r["d"]: r["label"] for r in classify.predict(weights, model, "d").collect()} == {1: "p", 2: "n", 3: "p"}


def test_labels_are_coded_alphabetically(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",)], "label string")
    assert sorted({(r["label"], r["code"]) for r in classify.encoded(rows, "label").collect()}) == [("a", 0), ("b", 1)]
    back = classify.decoded(classify.encoded(rows, "label").select("code"), classify.codes(rows, "label"), "label")
    assert sorted((r["code"], r["label"]) for r in back.collect()) == [(0, "a"), (1, "b"), (1, "b")]


def test_toggle_counts_each_event_once(spark):
    clicks = spark.createDataFrame([("p", 1), ("p", 2), ("p", 2), ("q", 3)], "post string, event_id int")
    assert sorted(tuple(r) for r in feedback.toggled(clicks, "post").collect()) == [("p", 2, True, False), ("q", 1, True, True)]


def test_overall_is_bounded(spark):
    rows = spark.createDataFrame([(-1.0,), (2.5,), (9.0,)], "m double")
    assert [r[0] for r in rows.select(feedback.overall(F.col("m"))).collect()] == [0, 3, 5]


PAGES = [
    ("https://www.ettoday.net/news/1.htm", "<h1 class='title big'>T1</h1><div class=story><p>one<p>two</p><p>省錢大作戰！超夯優惠等你GO</p><p>three</p></div>", "T1", "onetwo"),
    ("https://www.storm.mg/article/2", '<h1 id="article_title">T2</h1><div id="CMS_wrapper"><p>[啟動LINE推播] 每日重大新聞通知</p><p>a</p><p>看更多風傳媒報導吧</p><p>b</p></div>', "T2", "a"),
    ("https://tw.news.yahoo.com/3", '<header class="caas-header"><h1>T3</h1></header><div class="caas-body"><p>a</p><p>更多 TVBS 報導</p><p>b</p><p>更多風傳媒報導</p><p>c</p></div>', "T3", "ab"),
    ("https://tw.news.yahoo.com/4", '<h1 data-test-locator="headline">T4</h1><div class="caas-body"><p>x</p></div>', "T4", "x"),
    ("https://tw.news.yahoo.com/5", '<h1 class="Fz(24px) Fw(b)">T5</h1><div class="Mt(12px) Fz(16px) Lh(1.5) C(#464e56) Whs(pl)"><span>x</span><span>y</span></div>', "T5", "xy"),
    ("https://news.pts.org.tw/article/6", '<h1 class="article-title">T6</h1><p>a &amp; b</p>', "T6", "a & b"),
    ("https://cn.nytimes.com/7", '<div class="article-header"><h1>T7</h1></div><div class="article-paragraph">p1</div><div class="article-paragraph">p2</div>', "T7", "p1p2"),
    ("https://www.rti.org.tw/8", '<section class="news-detail-box"><h1>T8 用Podcast訂閱本節目 </h1></section><article><p>r</p></article>', "T8", "r"),
    ("https://www.mirrormedia.mg/9", '<h1 class="story__title">T9</h1><p class="g-story-paragraph">a</p><p>no</p><p class="g-story-paragraph">更多內容，歡迎鏡週刊紙本雜誌、鏡週刊數位訂閱、了解內容授權資訊。</p><p class="g-story-paragraph">b</p>', "T9", "a"),
    ("https://www.worldjournal.com/10", '<div class="wrapper-left"><section class="article-content__wrapper"><h1 class="article-content__title">T10</h1><section class="article-content__editor"><p>a</p><p>下一則</p><p>b</p></section></section></div>', "T10", "a"),
    ("https://udn.com/11", '<div class="article-layout-wrapper"><h1>T11</h1></div><section class="article-body__editor"><p>u</p></section>', "T11", "u"),
    ("https://www.bbc.com/12", '<strong class="ewk8wmc0 bbc-uky4hn eglt09e1">T12</strong><p>圖像來源，Reuters</p><p>b</p>', "T12", "b"),
]


def test_site_rules_extract_titles_and_contents(spark):
    pages = spark.createDataFrame([(u, h) for u, h, _, _ in PAGES] + [("https://other.example/", "<h1>x</h1><p>y</p>"), ("https://www.cna.com.tw/x", None)], "url string, html string")
    got = {r["url"]: (r["title"], r["content"]) for r in dom.extract(pages, rules.site_rules(spark), rules.ban_lines(spark)).collect()}
    assert got == {u: (t, c) for u, _, t, c in PAGES}


def test_terms_are_counted_without_an_exchange(spark):
    rows = [(1, "the b a b the c b"), (2, ""), (3, None), (4, "the the"), (None, "x x y"), (6, "é Z é z zz")]
    docs = spark.createDataFrame(rows, "d long, t string")
    words = F.filter(F.split("t", " "), lambda x: x != "")
    got = keywords.term_counts(docs, "d", words, ["the"])
    want = {(d, w, t.split().count(w)) for d, t in rows for w in (t or "").split() if w != "the"}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) and dict(got.dtypes)["tf"] == "bigint"
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_terms_of_repeated_keys_are_added_up(spark):
    rows = [(1, "b a b"), (1, "b c"), (2, "a"), (None, "x"), (None, "x y")]
    got = keywords.term_counts(spark.createDataFrame(rows, "d long, t string"), "d", F.split("t", " "))
    assert sorted((str(r.d), r.term, r.tf) for r in got.collect()) == [("1", "a", 1), ("1", "b", 3), ("1", "c", 1), ("2", "a", 1), ("None", "x", 2), ("None", "y", 1)]


def test_weights_travel_as_whole_numbers(spark):
    counts = spark.createDataFrame([(k, f"t{k * j % 7}{j}", j + 1) for k in range(30) for j in range(4)], "d long, term string, tf long")
    plain, by_key = keywords.tf_idf(counts, 30), keywords.tf_idf(counts, 30, "d")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, by_key.collect()))
    above = keywords.l2_normalised(by_key, "d").select("d", "term", "w")._jdf.queryExecution().executedPlan().toString()
    assert above.index("AS w#") < above.index("REPARTITION_BY_COL")  # plans print from the result down


def test_site_rules_in_small_parts(spark, monkeypatch):
    columns = "domain string, priority int, title_sel string, body_sel string, stop_mode string, stop_text string"
    site = spark.createDataFrame([("a.example", 2, "h2", "p", "none", None), ("a.example", 1, "h1", "p", "none", None), ("b.example", 1, "h1", "div p", "none", None)], columns)
    rows = [(f"https://{'abc'[k % 3]}.example/{k}", f"<h{1 + k % 2}>T{k}</h{1 + k % 2}><div><p>one {k}<p>two</div>" if k else None) for k in range(40)]
    pages = spark.createDataFrame(rows, "url string, html string").coalesce(1)
    monkeypatch.setattr(dom, "registered_domain", lambda url: F.regexp_extract(url, "//([^/]*)/", 1))
    monkeypatch.setattr(dom, "PAGES_AT_ONCE", 3)
    want = {(u, u[8:17], f"T{k}", f"one {k}two") for k, (u, h) in enumerate(rows) if k and (u[8] == "a" or (u[8] == "b" and k % 2 == 0))}
    got = dom.extract(pages, site, rules.ban_lines(spark))
    assert {tuple(r) for r in got.collect()} == want
    assert "html" not in got._jdf.queryExecution().optimizedPlan().schema().toString() and "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()


def test_trees_hold_no_circles():
    root = dom.tree("<div><p>a<p>b<ul><li>c</ul></div>")
    assert [n.tag for n in root.below()] == ["div", "p", "p", "ul", "li"] and {n.parent for n in root.below()} == {None}


def test_report_of_one_title_is_that_part_of_the_whole(spark, monkeypatch):
    from claimscope.plans import article

    bodies = ["storm coast storm wind", "markets rise", "storm markets vote", "", "wind vote vote"]
    pages = spark.createDataFrame([(k, f"https://a.example/{k}", f"<html><title>T{k % 2}</title><article><p>{b}</p></article></html>") for k, b in enumerate(bodies)], "page_id long, url string, html string")
    docs = spark.createDataFrame([(1, "storm wind"), (2, "markets rise vote")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality long")
    claims = spark.createDataFrame([(7, "a storm claim"), (8, "vote claim")], "item_id long, text string")
    kept = []
    real = article.stored
    monkeypatch.setattr(article, "stored", lambda df, name: kept.append((name, real(df, name))) or kept[-1][1])
    every = article.report(pages, docs, labels, claims)
    whole = sorted(tuple(r) for r in every.collect() if r["title"] == "T1")
    kept.clear()
    assert sorted(tuple(r) for r in article.report(pages, docs, labels, claims, title="T1").collect()) == whole and len(whole) == 2
    assert dict(kept)["articles"].count() == 2  # the other pages are not stored


def _title_tables(spark, folder, titles):
    bodies = ["storm coast storm wind", "markets rise", "storm markets vote", "", "wind vote vote"]
    pages = [(k, f"https://a.example/{k}", f"<html><title>{t}</title><article><p>{b}</p></article></html>") for k, (t, b) in enumerate(zip(titles, bodies, strict=True))]
    tables = {
        "pages": (pages, "page_id long, url string, html string"),
        "documents": ([(1, "storm wind"), (2, "markets rise vote"), (3, "calm")], "doc_id long, text string"),
        "labels": ([(1, 0, 0), (2, 1, 0), (3, 1, 0)], "doc_id long, quality long, toxic long"),
        "benchmark": ([(7, "a storm claim: 錯誤"), (8, "vote claim")], "item_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_query_by_title_returns_the_whole_report(spark, tmp_path):
    import duckdb

    from claimscope import queries

    sf = _title_tables(spark, tmp_path, ["T1", "T0", "T1", "T0", "T0"])
    every, got = queries.article_report(spark, sf), queries.article_by_title(spark, sf)
    assert got.columns == every.columns and {"keywords", "sentiment", "item_id", "verdict"} <= set(got.columns)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(tuple(r) for r in every.collect() if r["title"] == "T0") and [r[0] for r in rows] == [1, 3, 4]
    assert [r[3] for r in rows] == ["rise,markets", None, "vote,wind"] and rows[2][5] == 8
    duck = duckdb.connect()
    for name in ("pages", "documents", "labels", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet/*.parquet'")
    want = duck.sql(queries.ORACLES["article_by_title"])
    assert want.columns == got.columns and sorted(want.fetchall()) == rows


def test_query_by_title_without_titles_has_no_rows(spark, tmp_path):
    from claimscope import queries

    assert queries.article_by_title(spark, _title_tables(spark, tmp_path, ["", " ", "", "", ""])).count() == 0
