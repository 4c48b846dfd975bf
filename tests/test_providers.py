import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimscope.functions import providers
from claimscope.functions import text as texts
from claimscope.operators import keywords


def test_dictionary_segmenter(spark):
    words = spark.createDataFrame([("研究", 50), ("研究生", 10), ("生命", 40), ("命", 5), ("起源", 30)], "term string, freq int")
    rows = spark.createDataFrame([("研究生命起源 abc 你好",), (None,), ("",)], "t string")
    cut = providers.dictionary_segmenter(words)
    assert [r[0] for r in rows.select(cut(F.col("t"))).collect()] == ["研究 生命 起源 abc 你 好", None, ""]


def test_embedding_keywords_are_distinct_words_of_the_text(spark):
    docs = spark.createDataFrame([(1, "vaccine vaccine study finds a vaccine effect"), (2, "")], "d int, t string")
    top = keywords.by_embedding(docs, "d", F.col("t"), F.split("t", " "), providers.hashed_embedding(), 2).orderBy("rank").collect()
    own = [r["term"] for r in top if r["d"] == 1]
    assert own[0] == "vaccine" and len(set(own)) == 2


def test_links_as_a_table_function(spark):
    spark.udtf.register("extract_links", providers.ExtractLinks)
    got = spark.sql("""SELECT l.* FROM (SELECT '<a href="/x">a<b>b</b></a> <a class="c" href="/y">z</a>' AS html) p, LATERAL extract_links(p.html) l""").collect()
    assert [tuple(r) for r in got] == [(1, "/x", "ab"), (2, "/y", "z")]


def test_keywords_by_embedding_equal_brute_force(spark):
    import math
    import re
    import zlib

    def vector(t):
        v, padded = [0.0] * 64, f" {t.lower()} "
        for k in range(len(padded) - 2):
            h = zlib.crc32(padded[k : k + 3].encode())
            v[h % 64] += 1 if h & 0x10000 else -1
        return v

    def similarity(a, b):
        lengths = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / lengths, 6) if lengths else None

    rows = [(1, "Storm hits the coast, the storm of the year"), (2, "markets rise as markets do"), (3, ""), (4, None), (5, "one")]
    docs = spark.createDataFrame(rows, "k long, t string")
    got = keywords.by_embedding(docs, "k", F.col("t"), texts.tokens(F.col("t")), providers.hashed_embedding(), 3)
    want = []
    for k, t in rows:
        scored = [(similarity(vector(t), vector(w)), w) for w in set(re.findall(r"\w{2,}", (t or "").lower()))]
        scored.sort(key=lambda x: (-x[0] if x[0] is not None else 2, x[1]))
        want += [(k, w, s, r) for r, (s, w) in enumerate(scored[:3], 1)]
    assert sorted((r.k, r.term, r.similarity, r["rank"]) for r in got.collect()) == sorted(want)


def _one_by_one(t):
    v, padded = np.zeros(64), f" {t.lower()} "
    for k in range(len(padded) - 2):
        h = zlib.crc32(padded[k : k + 3].encode("utf-8", "replace"))
        v[h % 64] += 1 if h & 0x10000 else -1
    return v


def test_hashed_vectors_of_many_texts_equal_one_by_one(monkeypatch):
    texts_ = ["", "a", "Ärger über Öl", "研究生命起源", "mixed 研 é 😀 x", "İstanbul", "\x00\ud800", "long " * 50]
    want = [v / (np.linalg.norm(v) or 1.0) for v in map(_one_by_one, texts_)]
    for at_once in (1 << 20, 7):
        monkeypatch.setattr(providers, "HASHED_AT_ONCE", at_once)
        assert np.array_equal(providers.hashed_embedding().vectors(texts_), np.array(want))
    assert providers.hashed_embedding().vectors([]).shape == (0, 64)


def test_keywords_by_embedding_shuffle_no_vectors(spark):
    """Vectors stay in the tasks that make them: no join, and one exchange of each text's best words."""
    docs = spark.createDataFrame([(k, f"word{k} other{k} third") for k in range(20)], "k long, t string")
    got = keywords.by_embedding(docs, "k", F.col("t"), texts.tokens(F.col("t")), providers.hashed_embedding(), 2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "array<double>" not in plan
    assert got.count() == 40
    empty = spark.createDataFrame([(None, "a word"), (1, None), (2, "")], "k long, t string")
    assert keywords.by_embedding(empty, "k", F.col("t"), texts.tokens(F.col("t")), providers.hashed_embedding(), 2).collect() == []


def test_keywords_by_embedding_in_small_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k} other{k % 3} third fourth{k}") for k in range(30)], "k long, t string").coalesce(1)
    found = lambda: sorted(tuple(r) for r in keywords.by_embedding(docs, "k", F.col("t"), texts.tokens(F.col("t")), providers.hashed_embedding(), 2).collect())
    whole = found()
    part = next(iter(keywords._parts(pa.RecordBatch.from_pydict({"k": [1, 2, 3], "c": ["abc", "d", "e"], "w": [["abc"], ["d"], ["e"]]}))))
    assert part.num_rows == 3
    monkeypatch.setattr(keywords, "COMPARED_AT_ONCE", 4)
    parts = list(keywords._parts(pa.RecordBatch.from_pydict({"k": [1, 2, 3], "c": ["abc", "d", "e"], "w": [["abc"], ["d"], ["e"]]})))
    assert [p.num_rows for p in parts] == [1, 2]
    assert found() == whole
