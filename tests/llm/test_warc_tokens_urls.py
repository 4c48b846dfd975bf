import base64
import gzip
import hashlib
import random
import zlib
from datetime import date

import numpy as np
import pytest

from claimscope.llm import token_files, url_filters, warc
from claimscope.llm.tokens import TextEncoder, default_vocabulary
from claimscope.session import shared_path

PAGES = "page_id long, url string, html string, digest string, payload int"


def _pages(spark):
    draw = random.Random(2)
    rows = [(k, f"https://a.example/{k}", "".join(draw.choice("abc <é>") for _ in range(draw.randint(0, 900))), "x", 1) for k in range(120)]
    rows += [(200 + k, None, "<p>copy</p>", "x", 1) for k in range(60)]
    rows += [(300, "https://b.example/\r\nX: y", None, "x", 1), (301, "u", "", "x", 1), (None, "u", "<p>copy</p>", "x", 1), (302, "u", "y" * 900_000, "x", 1), (200, "u", "<p>copy</p>", "x", 1)]
    return spark.createDataFrame(rows, PAGES).repartition(3)


@pytest.mark.parametrize("range_bytes", [700, 5000, 1 << 22])
def test_archives_read_back_whole_at_any_split(spark, range_bytes):
    pages = _pages(spark)
    archives = warc.write_archives(pages, shared_path(spark, "test"))
    got = warc.read_archives(archives, range_bytes).where("error is null").collect()
    rows = [(r["page_id"], r["html"] or "", r["url"]) for r in pages.collect()]
    first: dict[str, int] = {}
    for page_id, html, _ in rows:
        if page_id is not None:
            first[html] = min(page_id, first.get(html, 1 << 60))
    want = sorted(
        (p or -1, "response" if p == first[h] else "revisit", base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), len(h.encode()), None if p == first[h] else first[h], h.encode() if p == first[h] else None)
        for p, h, _ in rows
    )
    key = lambda x: (x[0], x[1], x[4] or 0)
    assert sorted([(r["page_id"] or -1, r["record_type"], r["payload_digest"], r["payload_bytes"], r["refers_to"], bytes(r["payload"]) if r["payload"] is not None else None) for r in got], key=key) == sorted(want, key=key)


def test_archive_is_plain_gzip_and_false_magic_is_passed_over(tmp_path):
    page = gzip.compress(b"no record") + warc.MAGIC + b"junk"
    records = [warc.record_bytes(k, "u", b"<p>%d</p>" % k, None, False) for k in range(3)]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(page + b"".join(gzip.compress(r) for r in records))
    for step in (1, 7, 1000):
        ids = [r.page_id for start in range(0, path.stat().st_size, step) for r in warc.records_in(str(path), start, start + step)]
        assert ids == [0, 1, 2]
    assert gzip.decompress(gzip.compress(records[0])).startswith(b"WARC/1.1\r\nWARC-Type: response")
    path.write_bytes(gzip.compress(records[0])[:-4])
    assert [(r.page_id, r.offset, "ends within" in r.error) for r in warc.records_in(str(path), 0, 10)] == [(None, 0, True)]


def test_damaged_members_are_rows_of_their_own(spark, tmp_path):
    members = [gzip.compress(warc.record_bytes(k, "u", b"<p>%d</p>" % k + random.Random(k).randbytes(9000).hex().encode(), None, False)) for k in range(5)]
    members[1] = members[1][:7000] + b"\x00\x01\x02" + members[1][7003:]  # packed bytes changed
    members[3] = gzip.compress(gzip.decompress(members[3]).replace(b"<p>3", b"<p>x", 1))  # payload changed
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(members))
    archives = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, size long")
    got = sorted((r["offset"], r["page_id"], r["error"] is None) for r in warc.read_archives(archives, 100).collect())
    starts = [sum(map(len, members[:k])) for k in range(5)]
    assert got == [(starts[0], 0, True), (starts[1], None, False), (starts[2], 2, True), (starts[3], None, False), (starts[4], 4, True)]


def test_no_pages_no_records(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17, 1000, 4096, 65537])
def test_slots_are_a_permutation(size):
    slots = token_files.permuted(np.arange(size), size)
    assert sorted(slots.tolist()) == list(range(size))
    assert size < 100 or (np.diff(slots) == 1).mean() < 0.05
    assert np.array_equal(slots[:3], token_files.permuted(np.arange(min(3, size)), size))


def test_shards_hold_every_id_and_resume_anywhere(spark):
    rows = [(k, "some words " * (k % 40), 1, "x") for k in range(60)] + [(None, None, 1, "x"), (7, "again", 1, "x"), (99, "long text " * 20000, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int, shard string").coalesce(1)
    files = token_files.write_shards(docs, shared_path(spark, "test"), length=32, shard_bytes=80 * 60)
    got = token_files.read_shards(files).collect()
    size = len(got)
    assert sorted(r["slot"] for r in got) == list(range(size)) and files.count() > 5
    encoder, ids, begins = TextEncoder(default_vocabulary()), [], []
    for doc, text, *_ in rows:
        own = [*encoder.encode(text or "").tolist(), token_files.END_ID]
        begins += [(doc, k) for k in range(len(own))]
        ids += own
    slots = token_files.permuted(np.arange(size), size)
    by_slot = {r["slot"]: r for r in got}
    for k in range(size):
        r = by_slot[int(slots[k])]
        assert np.frombuffer(r["ids"], "<u2").tolist() == ids[32 * k : 32 * k + 32] and (r["doc_id"], r["start"]) == begins[32 * k]
    part = token_files.read_shards(files, 10, 130, ids=False).collect()
    assert {r["slot"]: r["ids_crc32"] for r in part} == {s: zlib.crc32(by_slot[s]["ids"]) for s in range(10, 130)}
    assert token_files.materialised(docs.limit(0)).count() == 0


def test_every_document_is_found_in_the_sequences(spark):
    rows = [(k if k % 9 else None, "word " * (k % 7)) for k in range(300)] + [(900, "long text " * 30000)] + [(1000 + k, "") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    files = token_files.write_shards(docs, shared_path(spark, "test"), length=32, shard_bytes=80 * 1500)
    encoder, want, at = TextEncoder(default_vocabulary()), [], 0
    for doc, text in rows:
        n, done = len(encoder.encode(text)) + 1, 0
        while done < n:
            share = min(n - done, 32 - at % 32)
            want.append((at // 32, doc, done, at % 32, share))
            done, at = done + share, at + share
    size = -(-at // 32)
    slots = token_files.permuted(np.arange(size), size).tolist()
    assert files.count() > 1 and size > 1100

    def found(first, last):
        return sorted(((r["slot"], d["at"], d["doc_id"], d["start"], d["n"]) for r in token_files.read_shards(files, first, last, ids=False).collect() for d in r["documents"]), key=lambda x: x[:2])

    asked = sorted(((slots[k], a, doc, start, n) for k, doc, start, a, n in want), key=lambda x: x[:2])
    assert found(0, None) == asked
    assert found(1000, 1100) == [x for x in asked if 1000 <= x[0] < 1100]


def test_slots_do_not_depend_on_the_splits(spark, tmp_path):
    draw = random.Random(4)
    rows = [(k, " ".join(draw.choice(["some", "words", "here"]) for _ in range(draw.randint(0, 60)))) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.option("parquet.block.size", 1024).option("maxRecordsPerFile", 90).parquet(str(tmp_path / "docs"))
    found = []
    for most in ("128m", "2k", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            docs = spark.read.parquet(str(tmp_path / "docs"))
            files = token_files.write_shards(docs, shared_path(spark, "test"), length=16)
            found.append(sorted((r["slot"], bytes(r["ids"]), str(r["documents"])) for r in token_files.read_shards(files).collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_url_filters_as_of_fetch_time(spark):
    entries = spark.createDataFrame(
        [
            ("l", "a.example.com", "add", date(2024, 1, 10)), ("l", "a.example.com", "remove", date(2024, 1, 20)), ("l", "A.example.com", "add", date(2024, 2, 1)),
            ("m", "example.com", "add", date(2024, 1, 15)), ("n", "example.com", "add", date(2024, 1, 15)), ("l", "tie.example", "add", date(2024, 1, 1)), ("l", "tie.example", "remove", date(2024, 1, 1)),
            ("l", None, "add", date(2024, 1, 1)), ("l", "x.example", "add", None),
        ],
        "list_name string, pattern string, action string, `on` date",
    )
    asked = [
        (1, "http://x.a.example.com/p", date(2024, 1, 9), None), (2, "http://x.a.example.com/p", date(2024, 1, 10), "a.example.com"), (3, "http://A.example.com", date(2024, 1, 20), "example.com"),
        (4, "http://a.example.com:80/", date(2024, 3, 1), "a.example.com"), (5, "http://bexample.com", date(2024, 3, 1), None), (6, None, date(2024, 3, 1), None), (7, "nothing", date(2024, 3, 1), None),
        (8, "http://example.com", None, None), (9, "http://tie.example", date(2024, 3, 1), None), (3, "http://A.example.com", date(2024, 1, 20), "example.com"),
    ]
    captures = spark.createDataFrame([(*x[:3], "clash", True) for x in asked], "page_id long, url string, fetched_on date, host string, blocked boolean")
    got = sorted((r["page_id"], r["pattern"] or "", r["list_name"] or "", r["blocked"]) for r in url_filters.as_of(captures, entries).collect())
    names = {"a.example.com": "l", "example.com": "n", None: ""}
    assert got == sorted((k, p or "", names[p], p is not None) for k, _, _, p in asked)
    assert not any(r["blocked"] for r in url_filters.as_of(captures, entries.limit(0)).collect())
    assert url_filters.as_of(captures.limit(0), entries).count() == 0


def test_partitions_of_several_shards_write_the_same(spark, monkeypatch):
    rows = [(k, f"words number {k} " * (k % 30)) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    found = []
    for most in (10_000, 4, 1):
        monkeypatch.setattr(token_files, "MOST_PARTITIONS", most)
        files = token_files.write_shards(docs, shared_path(spark, "test"), length=16, shard_bytes=48 * 20)
        rows_of = sorted((r["slot"], r["shard"], bytes(r["ids"]), str(r["documents"])) for r in token_files.read_shards(files).collect())
        found.append((sorted((r["shard"], r["first"], r["slots"]) for r in files.collect()), rows_of))
    assert found[0] == found[1] == found[2] and len(found[0][0]) > 20
