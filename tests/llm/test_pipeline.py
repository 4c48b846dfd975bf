import glob
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
import zstandard

import corpus_pipeline
from claimscope.llm import decontamination, queries, quality, resemblance, toxicity
from claimscope.llm.tokens import TextEncoder, default_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"
_DRAW = random.Random(0)
_WORDS = ["".join(_DRAW.choice("bcdfghjklmnprstvwyz") + _DRAW.choice("aeiouaeio") for _ in range(1 + k % 4)) for k in range(900)]
BAD = ("nastyword", "vilething", "grimfool")


def _prose(draw, n):
    return " ".join(_WORDS[int(len(_WORDS) * draw.random() ** 2)] + draw.choice(["", "", "", "", ",", "."]) for _ in range(n))


def _tables(draw):
    """Documents with every case, labels and benchmark; rows as tuples."""
    items = [(k, _prose(draw, 30) + "\nThe answer is " + _prose(draw, 3)) for k in range(12)]
    texts, labels = [], []
    for k in range(420):
        words, toxic = _prose(draw, draw.randint(40, 160)).split(" "), k % 6 == 0
        for _ in range(1 + len(words) // 20 if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(BAD))
        texts.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    plain = [t for k, t in texts if k % 6]
    copy = plain[5].split(" ")
    copy[len(copy) // 2] = "changed"
    texts += [(500, plain[3]), (501, plain[3].upper()), (502, " ".join(copy)), (None, plain[4]), (None, _prose(draw, 90)), (None, _prose(draw, 90)), (7, _prose(draw, 80)), (7, texts[7][1])]
    texts += [(503, None), (504, ""), (505, "too short"), (506, "again and again " * 200), (507, _prose(draw, 60) + " " + items[2][1] + " " + _prose(draw, 60)), (508, _prose(draw, 3000))]
    texts.append((None, plain[4]))
    return texts, labels, items


def _kept(texts, labels, items):
    """The rows that the four filters keep, document by document; of each group of near-duplicates the first one."""
    known = dict(labels)
    seen = sorted(k for k in known if zlib.crc32(str(k).encode()) % 3 != 1)
    by_id: dict = {}
    for k, t in texts:
        if k in known and t is not None:
            by_id[k] = min(t, by_id.get(k, t))
    rows = sorted({(known[k], by_id[k]): k for k in seen}.items(), key=lambda x: (x[1], x[0]))
    model = toxicity.learn([t for (_, t), _ in rows], [y for (y, _), _ in rows], sum(known[k] for k in seen) / len(seen))
    toxic, packer, index = toxicity.Scorer(model), zstandard.ZstdCompressor(level=3, write_content_size=False), decontamination.Block(items)
    good = [(k, t) for k, t in texts if toxic(t or "") < 0.7 and quality.judge(t or "", packer).kept]
    sets = [set(resemblance.shingles(t).tolist()) for _, t in good]
    root = list(range(len(good)))
    for a in range(len(good)):
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root = [root[b] if x == root[a] else x for x in root]
    first: dict = {}
    for k, r in enumerate(root):
        if r not in first or (good[k][0] is None, good[k][0] or 0) < (good[first[r]][0] is None, good[first[r]][0] or 0):
            first[r] = k
    return [good[k] for k in first.values() if not index.search(good[k][1])]


def test_the_pipeline_against_document_by_document(spark, tmp_path):
    texts, labels, items = _tables(random.Random(3))
    spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, y) for k, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    kept, encoder = _kept(texts, labels, items), TextEncoder(default_vocabulary())
    want = []
    for k, t in kept:
        ids = np.append(encoder.encode(t), np.uint32(2)).astype("<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(k if k is not None else -1, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = [(int(r.doc_id) if r.doc_id == r.doc_id else -1, int(r.piece), int(r.start), int(r.length), int(r.ids_crc32)) for r in rows.itertuples()]
    assert sorted(got) == sorted(want)
    assert {k for k, _ in kept} >= {7, None, 508} and not {k for k, _ in kept} & {500, 501, 502, 503, 504, 505, 506, 507}
    assert sum(k is None for k, _ in kept) == 2 and sum(k == 7 for k, _ in kept) == 2
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 1024


def test_the_stages_keep_the_columns_and_pass_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, empty, str(tmp_path))
        assert got.columns == empty.columns and got.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLES[name]).df()
    plain = lambda frame: sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
