import random

import pytest
import xxhash

from claimscope.llm import graph, resemblance, simhash
from claimscope.llm.common import stored

DOCS = "doc_id long, text string, fp string, component_id int"


def _plain_fingerprint(text: str) -> int:
    w = text.encode().lower().split()
    parts = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def _roots(prints: list[int]) -> dict[int, int]:
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {x: find(x) for x in prints}


def test_fingerprint_against_plain_arithmetic():
    for text in ("", "One", "a B", "a b c", "a b c d a b c d", "Ä ä\x0bß é", "x " * 50):
        assert simhash.fingerprint(text) == _plain_fingerprint(text)


def _prints(spark, values):
    return spark.createDataFrame([(simhash._signed(v), k) for k, v in enumerate(values)], "fp long, first long")


@pytest.mark.parametrize("spread", [1, 3, 6, 12])
def test_links_join_all_close_fingerprints(spark, spread, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_CELL", 6)  # most cells take the way of large ones
    draw = random.Random(spread)
    centres = [draw.getrandbits(64) for _ in range(12)]
    values = {0, (1 << 64) - 1}
    for c in centres:
        for _ in range(40):
            x = c
            for b in draw.sample(range(64), draw.randint(0, spread)):
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    rows = graph.components(simhash.links(_prints(spark, values))).collect()
    got = {r["node"] & ((1 << 64) - 1): r["root"] for r in rows}
    want = _roots(values)
    pairs = lambda roots: {(a, b) for a in values for b in values if a < b and a in roots and b in roots and roots[a] == roots[b]}
    assert pairs(got) == pairs(want)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[100 + k] for k in range(30)} == {100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_of_all_kinds(spark):
    text = " ".join(f"word{k}" for k in range(400))
    rows = [(5, text, "x", 1), (3, text.upper(), "x", 1), (9, None, "x", 1), (8, " \n", "x", 1), (None, "only without id", "x", 1), (7, "long " * 60000, "x", 1), (5, text, "x", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert [(a, c) for a, _, c in got] == [(-1, None), (3, 3), (5, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    assert all(f == f"{_plain_fingerprint(t or ''):016x}" for _, t, *_ in rows[:4] for f in [next(g for i, g, _ in got if i == next(r[0] for r in rows if r[1] == t))])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 3, 7, 8]
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_nothing_that_grows_with_the_documents_is_broadcast(spark, monkeypatch):
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(graph, "stored", kept)
    monkeypatch.setattr(simhash, "stored", kept)
    texts = [" ".join(f"w{k}" for k in range(90)), " ".join(f"w{k}" for k in range(91)), "other", None]
    plans.append(simhash.near_duplicates(spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], DOCS))._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 2 and not any("Broadcast" in p for p in plans)


def _replaced(words, at, mark):
    return " ".join(f"{mark}{k}" if k in at else w for k, w in enumerate(words))


def test_stage_drops_copies_of_five_word_similarity(spark):
    draw = random.Random(4)
    rows, want = [], set()
    for k in range(40):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(200, 600))]
        copy = _replaced(words, set(draw.sample(range(len(words)), 4)), f"new{k}x")
        other = _replaced(words, set(range(0, len(words), 9)), f"far{k}x")
        assert resemblance.similarity(*map(resemblance.shingles, (" ".join(words), copy))) >= 0.8 > resemblance.similarity(*map(resemblance.shingles, (" ".join(words), other)))
        rows += [(3 * k, " ".join(words), "x", 1), (3 * k + 1, copy, "x", 1), (3 * k + 2, other, "x", 1)]
        want |= {3 * k, 3 * k + 2}
    assert {r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(rows, DOCS)).collect()} == want


@pytest.mark.parametrize("centres", [1, 16])
def test_groups_are_the_closure_of_all_similar_pairs(spark, monkeypatch, centres):
    monkeypatch.setattr(resemblance, "CENTRES", centres)
    draw = random.Random(centres)
    texts = []
    for c in range(3):
        words = [f"c{c}w{k}" for k in range(150)]
        texts += [_replaced(words, set(draw.sample(range(150), draw.randint(1, 5))), f"n{len(texts)}x{m}") for m in range(25)]
    sets = [set(resemblance.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root = [root[b] if x == root[a] else x for x in root]
    got = {r["doc_id"]: r["root"] for r in resemblance.groups(spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], DOCS)).collect()}
    assert len(set(root)) > 3
    assert all((got[a] == got[b]) == (root[a] == root[b]) for a in got for b in got)


def test_rows_without_id_or_with_a_repeated_id_stay_unless_they_are_copies(spark):
    draw = random.Random(8)
    text = [" ".join(f"t{k}x{draw.randrange(900)}" for _ in range(60)) for k in range(6)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (None, text[2]), (4, text[2]), (5, text[3]), (5, text[4]), (5, text[4]), (6, text[4]), (5, text[5]), (3, text[5].upper())]
    got = simhash.keep_first(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)).collect()
    key = lambda r: (r[0] or -1, r[1])
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted([(None, text[0]), (None, text[1]), (4, text[2]), (5, text[3]), (5, text[4]), (3, text[5].upper())], key=key)
    one = spark.createDataFrame([(None, text[0], "x", 1), (None, text[2], "x", 1), (4, text[2], "x", 1)], DOCS)
    assert sorted(r["doc_id"] or -1 for r in simhash.keep_first(one).collect()) == [-1, 4]


def test_keep_first_leaves_columns_of_any_name(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, 777, "a", True, "n"), (2, text, 888, "b", False, "m"), (3, "something else entirely", 999, "c", None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id long, __tie string, __many boolean, __KEPT string")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [rows[0], rows[2]]


def test_stage_takes_candidates_from_fingerprints_and_checks_them(spark, monkeypatch):
    signature = resemblance._signature

    def no_bands(own):  # a text shares bands with none but equal ones
        keys, sketch = signature(own)
        return keys + own.sum().view("int64"), sketch

    monkeypatch.setattr(resemblance, "_signature", no_bands)
    draw = random.Random(6)
    rows, dropped, at = [], set(), 0
    while len(dropped) < 5:
        words = [f"v{draw.randrange(9000)}" for _ in range(3000)]
        copy = _replaced(words, {draw.randrange(3000)}, "new")
        if (simhash.fingerprint(" ".join(words)) ^ simhash.fingerprint(copy)).bit_count() <= 2:
            rows, dropped, at = [*rows, (at, " ".join(words), "x", 1), (at + 1, copy, "x", 1)], dropped | {at + 1}, at + 2
    core = " ".join(f"core{k}" for k in range(51))  # a long repeat gives one fingerprint, but the rest differs
    for mark in "pq":
        rows, at = [*rows, (at, " ".join([core] * 60 + [f"{mark}{k}" for k in range(60)]), "x", 1)], at + 1
    assert (simhash.fingerprint(rows[-1][1]) ^ simhash.fingerprint(rows[-2][1])).bit_count() <= 2
    got = {r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {r[0] for r in rows} - dropped
