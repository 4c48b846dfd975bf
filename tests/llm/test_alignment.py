"""Cross-tokenizer alignment against the definition: both tokenizers over whole texts, offsets and sets."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from claimscope.llm import alignment
from claimscope.llm.tokens import default_vocabulary

TEXTS = [
    "Hello world, it's fine.", "", None, " ", "  two  blanks ", "tail ", "line\n next\n\nlast", "\ttab\x1c x  y", "naïve café 東京タワー 🙂🙂 é", "<|endoftext|> <s> </s> <unk> <0x41> A",
    "a▁b", "▁", "x" * 3000, "The the THE  the", "1234567890 12,5 %", "don't  can't\r\nwon't", "Ünïcödé ümlaut straße", "مرحبا بالعالم", "same text", "same text", "\n", "　wide　", "\x00zero", "a\u0085 b",
]


class Whole:
    """Both tokenizers on whole texts."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(default_vocabulary())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=alignment.default_model())
        self.bytes_a, self.bytes_b = alignment.bytes_of_a(default_vocabulary()), alignment.bytes_of_b(self.b)

    def groups(self, text):
        """Groups as (ids of A, ids of B), and the links; None if the text is not spelt."""
        if not text:
            return None
        sides = []
        for ids, table in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.bytes_a), (self.b.encode(text), self.bytes_b)):
            if b"".join(table[i] for i in ids) != (" " + text).encode():
                return None
            at, rows = 0, []
            for i in ids:
                at += len(table[i])
                rows.append((i, at))
            sides.append(rows)
        cuts = sorted({e for _, e in sides[0]} & {e for _, e in sides[1]})
        out, low = [], 0
        for cut in cuts:
            out.append(tuple([i for i, e in rows if low < e <= cut] for rows in sides))
            low = cut
        return out, [(i, j) for i, e in sides[0] for j, f in sides[1] if e == f]


def expected(texts):
    whole = Whole()
    found = [whole.groups(t) for t in texts]
    counts = Counter(x for g in found if g for x in g[1])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for g in found:
        if g is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = g
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(counts[x] == highest[x[1]] for x in links)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), best, sum(counts[x] for x in links), hashlib.sha256(shown.encode()).hexdigest()))
    return out


def _rows(df):
    return sorted(((r.doc_id, tuple(r)[1:]) for r in df.collect()), key=repr)


def test_digest_equals_the_definition(spark):
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(TEXTS)], "doc_id long, text string, n_a int").repartition(5)
    assert _rows(alignment.alignment_digest(docs)) == sorted(((k, x) for k, x in enumerate(expected(TEXTS))), key=repr)


def test_random_texts(spark):
    rng = random.Random(3)
    alphabet = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "é", "東", "🙂", "'s", ".", "<s>", " ", "0x", "<0x0A>", "Q", "-"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert _rows(alignment.alignment_digest(docs)) == sorted(((k, x) for k, x in enumerate(expected(texts))), key=repr)


def test_groups_and_counts_of_pairs(spark):
    docs = spark.createDataFrame([(1, "one two"), (None, "one two")], "doc_id long, text string")
    rows = alignment.aligned(docs)
    groups, links = Whole().groups("one two")
    shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    assert {(r.doc_id, r.groups) for r in rows.collect()} == {(1, shown), (None, shown)}
    kind, shift = alignment.pair_type(50257, 32000)
    found = {(r.pair >> shift, r.pair & ((1 << shift) - 1)): r.n for r in alignment.pair_counts(rows, kind).collect()}
    assert found == {x: 2 * n for x, n in Counter(links).items()}


def test_pairs_are_bounded_by_the_vocabularies():
    a, b = [b"x", b"yx", b"zyx", b""], [b"yx", b"x", b"x", b"q"]
    assert alignment.possible_pairs(a, b) == sum(x.endswith(y) or y.endswith(x) for x in a if x for y in b)
    assert alignment.pair_type(1 << 17, 10)[0] == np.dtype("<u8")


def test_terminals_by_walking():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        ends = [np.unique(np.append(rng.integers(1, n + 1, size=rng.integers(1, n + 1)), n)) for _ in range(2)]
        got = alignment.terminals(*ends)
        common = np.intersect1d(*ends)
        for k, end in enumerate(np.concatenate(ends)):
            cut = common[np.searchsorted(common, end)]
            assert ends[0][got[k]] == cut


def test_table_is_emptied_without_a_change(monkeypatch):
    texts = [t for t in TEXTS if t]
    large, small = alignment.Aligner(default_vocabulary(), alignment.default_model()), alignment.Aligner(default_vocabulary(), alignment.default_model(), most_bytes=1)
    small.AT_ONCE = 10
    assert [next(iter(small.align([t]))) for t in texts] == list(large.align(texts))


def test_empty_table(spark):
    assert alignment.alignment_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the test tables are not here")
def test_query_on_the_smallest_tables(spark):
    from claimscope.llm.queries import QUERIES
    from claimscope.session import table

    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    want = sorted(((r.doc_id, x) for r, x in zip(docs, expected([r.text for r in docs]), strict=True)), key=repr)
    assert _rows(QUERIES["op13_cross_tokenizer_alignment"](spark, "/root/testdata/sf0.001")) == want
