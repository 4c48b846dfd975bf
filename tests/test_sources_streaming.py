import datetime as dt

from pyspark.sql import functions as F

from claimscope.sources import readers
from claimscope.sources.replay import PageReplay
from claimscope.streaming import posts


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("s", 'say "hi", you', "a", None, "c\nd")], "source string, title string, keyword1 string, keyword2 string, keyword3 string")
    readers.write_csv(rows, str(tmp_path / "x"))
    assert [tuple(r) for r in readers.titles_csv(spark, str(tmp_path / "x")).collect()] == [("s", 'say "hi", you', "a", None, "c\nd")]


def test_positional_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("title one,a,b,c\ntitle two,a,,\n")
    assert [tuple(r) for r in readers.train_csv(spark, str(tmp_path / "t.csv")).orderBy("title").collect()] == [("title one", "a", "b", "c"), ("title two", "a", None, None)]


def test_keyword_log_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "line long, keywords array<string>")
    readers.write_keyword_log(rows, str(tmp_path / "log"))
    assert sorted((r["line"], r["keywords"]) for r in readers.keyword_log(spark, str(tmp_path / "log")).collect()) == [(1, ["a", "b"]), (2, [])]


def test_link_list_and_search_results(spark, tmp_path):
    (tmp_path / "list.txt").write_text("https://a.example\n\nhttps://b.example\nhttps://a.example\n")
    assert sorted(r[0] for r in readers.link_list(spark, str(tmp_path / "list.txt")).collect()) == ["https://a.example", "https://b.example"]
    got = spark.sql("SELECT '[{\"title\":\"t\",\"link\":\"l\"}]' AS j UNION ALL SELECT 'broken'").select(readers.search_results(F.col("j")).alias("r")).collect()
    assert [tuple(x) for r in got if r["r"] for x in r["r"] if x["title"]] == [("t", "l")]


def test_rejected_articles_keep_their_reason(spark, tmp_path):
    rows = spark.createDataFrame([("t", "it's", "l"), (None, "c", "l2")], "news_title string, news_content string, news_link string")
    readers.append_articles(rows, str(tmp_path / "store"))
    readers.append_articles(rows.where("news_title is null"), str(tmp_path / "store"))
    accepted = readers.accepted_articles(spark, str(tmp_path / "store"))
    assert accepted.columns == rows.columns and [r["news_content"] for r in accepted.collect()] == ["it's"]
    assert [r["reason"] for r in readers.rejected_articles(spark, str(tmp_path / "store")).collect()] == ["news_title"] * 2
    assert readers.point_lookup(accepted, "news_link", "l").count() == 1


def test_jdbc_table_round_trip(spark, tmp_path):
    url, options = f"jdbc:derby:{tmp_path / 'db'};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "it's")], "K int, V string").coalesce(1)
    readers.append_jdbc(rows.where("K < 3"), url, "LINKS", createTableColumnTypes="V VARCHAR(100)", **options)
    readers.append_jdbc(rows.where("K = 3"), url, "LINKS", **options)
    stored = readers.jdbc_table(spark, url, "LINKS", **options)
    assert sorted(tuple(r) for r in stored.collect()) == [(1, "a"), (2, "b"), (3, "it's")]
    one = readers.point_lookup(stored, "V", "it's")
    assert [r["K"] for r in one.collect()] == [3]
    assert "PushedFilters: [*IsNotNull(V), *EqualTo(V,it's)]" in one._jdf.queryExecution().toString()


def test_bug_reports_keep_their_image(spark, tmp_path):
    rows = spark.sql("SELECT 1 AS Bug_ID, timestamp'2024-01-01' AS Bug_DATE, 'x' AS COMMENT, X'00FF' AS Bug_IMAGE, 'more' AS other")
    readers.append_bug_reports(rows, str(tmp_path / "bugs"))
    assert [bytes(r["Bug_IMAGE"]) for r in spark.read.parquet(str(tmp_path / "bugs")).collect()] == [b"\x00\xff"]


def test_replay_source(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>"), (2, "v", None)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages"))
    spark.dataSource.register(PageReplay)
    got = spark.read.format("page_replay").option("path", str(tmp_path / "pages")).load()
    assert sorted(tuple(r) for r in got.collect()) == [(1, "u", "<p>"), (2, "v", None)]


def _stream(spark, tmp_path, rows, schema, times=2):
    for k in range(times):  # the same rows are observed again
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_stream_dedupe_equals_batch(spark, tmp_path):
    rows = [(f"p{k % 4}", dt.datetime(2024, 1, 1, 0, k)) for k in range(8)]
    stream = _stream(spark, tmp_path, rows, "post_id string, ts timestamp_ntz")
    got = posts.drained(posts.first_seen(stream, ["post_id"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["post_id"] for r in got.collect()) == ["p0", "p1", "p2", "p3"]


def test_stream_toggles_count_a_repeated_event_once(spark, tmp_path):
    rows, schema = [("p", 1), ("p", 2), ("q", 3), ("q", 3)], "post_id string, event_id long"
    stream = _stream(spark, tmp_path, rows, schema)
    latest = lambda: sorted(tuple(r) for r in posts.latest_states(posts.toggles(stream), ["post_id"], "clicks", str(tmp_path / "out"), str(tmp_path / "ck")).collect())
    assert latest() == [("p", 2, True, False), ("q", 1, True, True)]
    _stream(spark, tmp_path, [("p", 2), ("p", 4)], schema, 1)  # a later run goes on from the state
    assert latest() == [("p", 3, True, True), ("q", 1, True, True)]


def test_polled_reads_new_posts_once(spark, tmp_path):
    stream = _stream(spark, tmp_path, [("a", 1)], "post_id string, n int", 1)
    query = posts.polled(stream, str(tmp_path / "out"), str(tmp_path / "ck"), 1)
    try:
        query.processAllAvailable()
        _stream(spark, tmp_path, [("b", 2)], "post_id string, n int", 1)
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("b", 2)]
