import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimscope.functions import html, text, urls
from claimscope.operators import factcheck, sentiment


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["x"] for r in rows.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


def test_registered_domain(spark):
    cases = {
        "https://tw.news.yahoo.com/a-b.html": "yahoo.com",
        "https://www.cna.com.tw/news/acn/1.aspx": "cna.com.tw",
        "https://news.pts.org.tw/article/605194": "pts.org.tw",
        "https://money.udn.com/money/story/1?from=x": "udn.com",
        "https://market.ltn.com.tw/article/13375": "ltn.com.tw",
        "https://newtalk.tw/news/view": "newtalk.tw",
        "https://user@M.Example.Co.UK:8080/x": "example.co.uk",
        "https://www.chinatimes.com/realtimenews/20221103002411-260408?chdtv": "chinatimes.com",
        "https://www.bbc.com/zhongwen/trad/world-63314791": "bbc.com",
        "https://www.rfi.fr/tw/國際/20221110-x": "rfi.fr",
        "https://www.storm.mg/article/4575743": "storm.mg",
        "https://cn.nytimes.com/china/20221117/x/zh-hant/": "nytimes.com",
        "https://a.b.gov.au/": "b.gov.au",
        "http://10.0.0.1/x": "10.0.0.1",
        "http://localhost/x": "localhost",
        "no url": None,
        None: None,
    }
    assert column(spark, list(cases), urls.registered_domain) == list(cases.values())


def test_unwrapped(spark):
    prefix = "https://redirect.example/l?u="
    links = [f"{prefix}https%3A%2F%2Fa.example%2Fx%3Fy%3D1&fbclid=abc", f"{prefix}https%3A%2F%2Fa.example%2Fx", "https://a.example/z?fbclid=q&b=1", "https://a.example/"]
    want = ["https://a.example/x?y=1", "https://a.example/x", "https://a.example/z", "https://a.example/"]
    assert column(spark, links, lambda c: urls.unwrapped(c, prefix)) == want


def test_parameters_keep_repeats_and_missing_values(spark):
    got = column(spark, ["http://a.example/?x=1&y=a+b&x=2&z#f?q=1", "http://a.example/", "http://a.example/?#x"], urls.parameter_map)
    assert got == [{"x": ["1", "2"], "y": ["a b"], "z": [None]}, {}, {}]


def test_absolute_replaces_only_the_first_mark(spark):
    assert column(spark, ["./articles/./x", "y"], lambda c: urls.absolute(c, F.lit("https://o.example/"))) == ["https://o.example/articles/./x", "https://o.example/y"]


def test_paragraphs_recover_open_ones(spark):
    page = '<head><script>var t="</p><p>no</p>";</script></head><article><p><b>Open &amp; bold<br><p>Two</p> loose <p> Three <i>x</i> </p></article><footer>foot</footer>'
    assert column(spark, [page, "", "<p>cut off"], lambda c: html.paragraphs(c)) == [["Open & bold", "Two", "Three x"], [], ["cut off"]]


def test_paragraphs_with_attributes(spark):
    page = '<p class="x" id=y>one</p><pre>no</pre><P>two</P ><p\nclass=z>three<param></article><p>after'
    assert column(spark, [page], html.paragraphs) == [["one", "two", "three", "after"]]


def test_character_references_are_decoded_once(spark):
    texts = ["a &amp;lt; b", "&#8217;&#x2019;&hellip;&nbsp;&eacute;&Eacute;", "&bogus; & &#0; &#xD800; &#x1F600; AT&T;", "none", None, "&#39;&apos;&quot;"]
    assert column(spark, texts, html.decoded) == ["a &lt; b", "’’…\u00a0éÉ", "&bogus; & \ufffd \ufffd 😀 AT&T;", "none", None, "''\""]
    assert column(spark, [" a\r\n\u3000b\tc ", None], html.cleaned) == ["abc", None]


def test_post_text_drops_only_a_trailing_marker(spark):
    rows = [["a", "b", "Show More"], ["Show More", "c"], ["x", "さらに表示"]]
    assert column(spark, rows, text.post_text, "array<string>") == ["a\nb", "Show More\nc", "x"]


def test_inline_links_drop_scripts(spark):
    rows = [[{"text": "a", "href": "https://x.example"}, {"text": "", "href": "/y"}, {"text": "b", "href": "javascript:go()"}, {"text": "c", "href": None}]]
    got = column(spark, rows, text.inline_links, "array<struct<text:string,href:string>>")
    assert [tuple(x) for x in got[0]] == [("a", "https://x.example"), ("[連結]", "/y")]


def test_sentiment_labels_at_their_bounds(spark):
    means = [1.0, 0.9, 0.89, 0.7, 0.51, 0.5, 0.49, 0.3, 0.29, 0.1, 0.0, None]
    want = ["絕對正面", "絕對正面", "極度正面", "極度正面", "相對正面", "中立", "相對負面", "相對負面", "極度負面", "絕對負面", "絕對負面", "undefined"]
    assert column(spark, means, sentiment.label, "double") == want
    assert column(spark, [0.8, 0.79], sentiment.label_older, "double") == ["abs positive", "strong positive"]


def test_partial_verdict_is_not_taken_for_the_full_one(spark):
    titles = ["【部份錯誤】x", "【錯誤】x", "事實釐清:x", "none", None]
    assert column(spark, titles, factcheck.verdict) == ["部份錯誤", "錯誤", "事實釐清", "目前查無資料", "目前查無資料"]
    guarded = column(spark, ["tfc-taiwan.org.tw", "other.example", None], lambda c: factcheck.guarded(c, F.lit("錯誤")))
    assert guarded == ["錯誤", "目前查無資料", "目前查無資料"]


@pytest.mark.parametrize("stop", [("the", "of")])
def test_tokens(spark, stop):
    got = column(spark, ["The 7c of A béton_x, of x", "", None], lambda c: text.without(text.tokens(c), stop))
    assert got == [["7c", "béton_x"], [], None]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=20))
def test_labels_are_total_and_monotone(spark, values):
    order = ["絕對負面", "極度負面", "相對負面", "中立", "相對正面", "極度正面", "絕對正面"]
    values = sorted(values)
    ranks = [order.index(x) for x in column(spark, values, sentiment.label, "double")]
    assert ranks == sorted(ranks)
