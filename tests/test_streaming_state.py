"""Sinks under repeated batches, the page stream over restarts, toggles whose state ends."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimscope.sources import markers
from claimscope.sources.replay import PageReplay
from claimscope.streaming import posts
from claimscope.streaming.sink import FileSink, JdbcSink

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def _batch(spark, first, n, parts=3):
    rows = [(k, None if k % 5 == 0 else f"t{k}", f"it's {k}") for k in range(first, first + n)]
    return spark.createDataFrame(rows, "k long, news_title string, news_content string").repartition(parts)


def _check(spark, sink, keys):
    got = sink.accepted(spark).collect()
    assert sorted(r["k"] for r in got) == [k for k in keys if k % 5]
    assert sorted(r["ID"] for r in got) == list(range(1, len(got) + 1))  # no gaps, no repeats
    return sorted((r["k"], r["ID"]) for r in got)


class Killed(Exception):
    pass


def _killed(monkeypatch, sink, rows, batch):
    def die(*args):
        raise Killed

    monkeypatch.setattr(sink, "commit", die)
    with pytest.raises(Killed):
        sink(rows, batch)
    monkeypatch.undo()


def test_file_sink_holds_a_killed_and_repeated_batch_once(spark, tmp_path, monkeypatch):
    sink = FileSink(str(tmp_path / "store"), ["news_title"])
    sink(_batch(spark, 0, 20), 0)
    _killed(monkeypatch, sink, _batch(spark, 20, 15), 1)
    before = _check(spark, sink, range(20))  # what was not committed is not read
    sink(_batch(spark, 20, 15, parts=5), 1)
    after = _check(spark, sink, range(35))
    assert after[: len(before)] == before
    for batch in (1, 0):  # batches that are in the ledger
        sink(_batch(spark, 20, 15), batch)
    assert _check(spark, sink, range(35)) == after
    assert sorted(tuple(r) for r in sink.rejected(spark).select("k", "reason").collect()) == [(k, "news_title") for k in range(0, 35, 5)]


def test_file_sink_with_a_batch_of_no_rows(spark, tmp_path):
    sink = FileSink(str(tmp_path / "store"), ["news_title"])
    sink(_batch(spark, 0, 0), 0)
    sink(_batch(spark, 0, 3), 1)
    _check(spark, sink, range(3))


def test_a_batch_takes_one_job_and_no_look_at_earlier_ones(spark, tmp_path, monkeypatch):
    sink, jobs = FileSink(str(tmp_path / "store"), ["news_title"]), []
    sink(_batch(spark, 0, 10), 0)
    monkeypatch.setattr(markers, "names", lambda *args: pytest.fail("the ledger was listed"))
    for batch in range(1, 4):
        rows = spark.range(10 * batch, 10 * batch + 10, 1, 5).selectExpr("id AS k", "IF(id % 5 = 0, NULL, 't') AS news_title", "'c' AS news_content")
        spark.sparkContext.setJobGroup(f"{tmp_path}-{batch}", "")
        sink(rows, batch)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{tmp_path}-{batch}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.undo()
    _check(spark, sink, range(40))
    assert jobs == [1, 1, 1]


def test_file_sink_sees_what_another_object_committed(spark, tmp_path):
    one, other = (FileSink(str(tmp_path / "store"), ["news_title"]) for _ in range(2))
    for sink, batch in ((one, 0), (other, 1), (one, 1), (other, 2), (one, 3), (other, 3), (one, 4)):
        sink(_batch(spark, 7 * batch, 7), batch)
    _check(spark, one, range(35))


def test_file_sink_of_empty_batches_alone_and_of_none_rejected(spark, tmp_path):
    sink = FileSink(str(tmp_path / "store"), ["news_title"])
    sink(_batch(spark, 0, 0), 0)
    assert sink.accepted(spark).count() == sink.rejected(spark).count() == 0
    sink(_batch(spark, 1, 4), 1)
    assert _check(spark, sink, range(1, 5)) and sink.rejected(spark).count() == 0


def test_jdbc_sink_holds_a_killed_and_repeated_batch_once(spark, tmp_path, monkeypatch):
    sink = JdbcSink(f"jdbc:derby:{tmp_path / 'db'};create=true", "ARTICLES", DERBY, str(tmp_path / "bad"), ["news_title"], createTableColumnTypes="news_title VARCHAR(50), news_content VARCHAR(50)")
    sink(_batch(spark, 0, 12), 0)
    _killed(monkeypatch, sink, _batch(spark, 12, 8), 1)
    before = _check(spark, _named(sink), range(12))
    sink(_batch(spark, 12, 8), 1)
    sink(_batch(spark, 12, 8), 1)
    assert _check(spark, _named(sink), range(20))[: len(before)] == before
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 4


def _named(sink):
    """The database's column names are in upper case."""

    class Lower:
        @staticmethod
        def accepted(spark):
            return sink.accepted(spark).withColumnRenamed("K", "k")

    return Lower


def _pages(spark, path, first, n, name):
    rows = spark.createDataFrame([(k, f"u{k}", "<p>" if k % 3 else None) for k in range(first, first + n)], "page_id long, url string, html string").coalesce(1)
    rows.toPandas().to_parquet(path / name, row_group_size=5)


def _run(spark, tmp_path, sink, batches=None, **options):
    spark.dataSource.register(PageReplay)
    stream = spark.readStream.format("page_replay").options(path=str(tmp_path / "pages"), **options).load()
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
    try:
        if batches is None:
            query.processAllAvailable()
        else:
            import time

            end = time.time() + 60
            while time.time() < end and (query.lastProgress is None or query.lastProgress["batchId"] < batches - 1) and query.exception() is None:
                time.sleep(0.05)
    finally:
        query.stop()


def test_page_stream_reads_each_link_once_over_restarts(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    _pages(spark, tmp_path / "pages", 0, 37, "a.parquet")
    sizes, seen = {}, []

    def keep(rows, batch):
        found = [r["page_id"] for r in rows.collect()]
        sizes[batch] = len(found)
        seen.extend(found)

    _run(spark, tmp_path, keep, batches=2)
    stopped = len(sizes)
    _run(spark, tmp_path, keep)
    assert sorted(seen) == list(range(37)) and max(sizes.values()) == 8 and stopped >= 2
    _pages(spark, tmp_path / "pages", 37, 10, "b.parquet")
    _run(spark, tmp_path, keep)
    assert sorted(seen) == list(range(47)) and len(sizes) == 7


def test_page_stream_into_the_sink_after_a_batch_died(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    _pages(spark, tmp_path / "pages", 0, 20, "a.parquet")
    sink, died = FileSink(str(tmp_path / "store"), ["html"]), []

    def flaky(rows, batch):
        if batch == 1 and not died:
            died.append(batch)
            sink.commit, own = (lambda *a: (_ for _ in ()).throw(Killed())), sink.commit
            try:
                sink(rows, batch)
            finally:
                sink.commit = own
        else:
            sink(rows, batch)

    with pytest.raises(Exception, match="Killed"):
        _run(spark, tmp_path, flaky)
    _run(spark, tmp_path, flaky)
    got = sink.accepted(spark).collect()
    assert died and sorted(r["page_id"] for r in got) == [k for k in range(20) if k % 3]
    assert sorted(r["ID"] for r in got) == list(range(1, len(got) + 1))
    assert sorted(r["page_id"] for r in sink.rejected(spark).collect()) == list(range(0, 20, 3))


def test_a_row_group_is_read_by_one_task_and_a_footer_once(tmp_path):
    import pandas as pd

    for at, name in enumerate("ab"):
        rows = pd.DataFrame({"page_id": range(100 * at, 100 * at + 100), "url": "u", "html": "<p>"})
        rows.to_parquet(tmp_path / f"{name}.parquet", row_group_size=40)
    reader = PageReplay({"path": str(tmp_path), "linksPerBatch": "70", "tasksPerBatch": "32"}).streamReader(None)
    start, seen, tasks = reader.initialOffset(), [], []
    while (end := reader.latestOffset()) != start:
        parts = reader.partitions(start, end)
        tasks.append(len(parts))
        seen += [k for part in parts for batch in reader.read(part) for k in batch.column(0).to_pylist()]
        start = end
    assert seen == list(range(200)) and tasks == [2, 3, 2]  # groups of 40, 40 and 20 links in either file
    few = PageReplay({"path": str(tmp_path), "linksPerBatch": "200", "tasksPerBatch": "4"}).streamReader(None)
    parts = few.partitions({"links": 0}, {"links": 200})
    assert len(parts) <= 4 and [k for part in parts for batch in few.read(part) for k in batch.column(0).to_pylist()] == seen
    (tmp_path / "b.parquet").write_bytes(b"")  # its footer is known
    assert reader.latestOffset() == {"links": 200}


def _at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_toggles_expire_and_late_events_come_out_apart(spark, tmp_path):
    schema, source = "post_id string, event_id long, ts timestamp_ntz", tmp_path / "in"
    rows, sizes = [], []

    def run(*events):
        spark.createDataFrame(list(events), schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = posts.expiring_toggles(spark.readStream.schema(schema).parquet(str(source)), late="10 minutes", idle="1 hour")
        out = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck"))
        query = out.foreachBatch(lambda found, batch: rows.extend(found.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        got = sorted((r["post_id"], r["kind"], r["event_id"] or 0, r["clicks"], r["visible"]) for r in rows)
        rows.clear()
        return got

    # one click, two, and a repeated event
    assert run(("a", 1, _at(0)), ("b", 2, _at(1)), ("b", 3, _at(2)), ("b", 3, _at(2))) == [("a", "state", 0, 1, True), ("b", "state", 0, 2, False)]
    # the watermark is past both posts' events: a repetition is late, and so is an event before it; a third click counts
    assert run(("b", 4, _at(12)), ("b", 4, _at(12))) == [("b", "state", 0, 3, True)]
    assert run(("a", 9, _at(1)), ("b", 3, _at(2)), ("c", 5, _at(20))) == [("a", "late", 9, 1, True), ("b", "late", 3, 3, True), ("c", "state", 0, 1, True)]
    # a row without event moves the clock alone: all posts expire with their last states, and none is held any more
    got = run((None, None, _at(600))) + run((None, None, _at(601)))  # a batch's clock holds from the next one on
    assert [r for r in got if r[1] == "expired"] == [("a", "expired", 0, 1, True), ("b", "expired", 0, 3, True), ("c", "expired", 0, 1, True)]
    assert sizes[-1] == 0 and max(sizes) > 0
    # a click after that starts anew
    assert run(("b", 20, _at(700))) == [("b", "state", 0, 1, True)]


def test_ids_of_a_hot_post_are_held_for_the_delay_only(spark, tmp_path):
    schema, source, sizes = "post_id string, event_id long, ts timestamp_ntz", tmp_path / "in", []
    for step in range(4):
        events = [("hot", 100 * step + k, _at(60 * step + k % 5)) for k in range(100)]
        spark.createDataFrame(events, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = posts.expiring_toggles(spark.readStream.schema(schema).parquet(str(source)), late="10 minutes", idle="1 day")
        query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda found, batch: found.count()).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(sizes) <= sizes[0] + 2  # as many ids after 400 events as after 100


class _Calls:
    """State of one post that counts the calls to it, each of which is a round trip to Spark."""

    def __init__(self):
        self.n, self.value, self.held = 0, None, []

    def __getattr__(self, name):
        def call(*args):
            self.n += 1
            if name == "exists":
                return self.value is not None
            if name == "update":
                self.value = args[0]
            elif name == "put":
                self.held = list(args[0])
            return iter(self.held) if self.value is not None and name == "get" and self.held else self.value if name == "get" else []

        return call

    getCurrentWatermarkInMs = staticmethod(lambda: 0)


def test_calls_to_state_do_not_grow_with_a_posts_events():
    import pandas as pd

    def calls(n):
        toggle, clicks, events, handle = posts.ExpiringToggle(1000), _Calls(), _Calls(), _Calls()
        toggle.handle, toggle.clicks, toggle.events = handle, clicks, events
        handle.__dict__["registerTimer"] = lambda at: None
        rows = pd.DataFrame({"event_id": [*range(n), *range(n)], "at": [10] * (2 * n), "known": True})
        out = list(toggle.handleInputRows(("p",), iter([rows]), handle))
        assert out[0]["clicks"].tolist() == [n] and len(events.held) == n
        return clicks.n + events.n + handle.n

    assert calls(200) == calls(2)
