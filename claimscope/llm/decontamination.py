"""Benchmark decontamination: BM25 over test items with block-max WAND, then exact overlap of question and answer.

Each test item is indexed by its word pairs (an item of one word by that word), with BM25 impacts divided by the item's
score for itself, so that a score of 1 means that a passage holds all of the item and one threshold serves items of all
lengths. Every document is cut into overlapping passages of twice an item's length, rounded up to a power of two, so items
of like lengths share passages and no item changes those of others; each passage is a query, and all items above the threshold are retrieved: passages whose terms' greatest impacts do not sum up to the threshold
have no pivot and are left out at once, the others walk the postings with block maxima. A retrieved item is verified
in the surroundings of every passage that retrieved it: a word of the item is held if it lies in a shingle of five words
(or of all words of a shorter item) that stands there. The item is a leak if at least 0.8 of its words are held, or 0.8 of
its question (all but its last line or sentence); both shares are reported.

Words are lower-cased runs of letters and digits, and single characters of scripts that put no blanks between words.
Items without words name no passage. Document frequencies and the mean length are those of all items, summed up by Spark,
so neither scores nor leaks depend on how items are dealt. Items are indexed in blocks of about ``BLOCK_ITEMS``, one pass
over the documents each, so what is broadcast is bounded by a block; each block reads its own part of the stored items.

Nulls: null texts of documents or items are empty; a null ``doc_id`` is passed through, a null ``item_id`` too. Repeated
documents and items give repeated rows. Empty tables give no rows. Extra columns are ignored by ``leaks`` and kept by
``drop_leaked``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import row_blocks, stored, text_or_empty
from claimscope.session import shared_path

THRESHOLD = 0.5
OVERLAP, SHINGLE = 0.8, 5
K1, B = 1.2, 0.75
SHORTEST, POSTING_BLOCK, BLOCK_ITEMS = 64, 8, 20_000
#: Kana, Han, Thai, Lao, Burmese and Khmer.
_UNSPACED = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_UNSPACED}](?<=\w)|[^\W{_UNSPACED}]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


class Leak(NamedTuple):
    item: int
    score: float
    question: float
    answer: float | None


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_words(text: str) -> int:
    """How many of an item's words come before its answer: its last line, or else its last sentence."""
    for parts in (text.strip().rsplit("\n", 1), _SENTENCE.split(text.strip())):
        if len(parts) > 1:
            n = len(words(text)) - len(words(parts[-1]))
            if 0 < n < len(words(text)):
                return n
    return len(words(text))


class Statistics(NamedTuple):
    """Of all items that have words: their number, their mean number of terms, and how many hold each term (1 where it is not named)."""

    items: int
    mean: float
    df: dict[str, int]


def terms_of(ws: list[str]) -> list[str]:
    """The terms of an item: its word pairs, or its only word."""
    return [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)] if len(ws) > 1 else ws


def statistics_of(items: Iterable[str]) -> Statistics:
    own = [t for t in map(terms_of, map(words, items)) if t]
    df = Counter(t for ts in own for t in set(ts))
    return Statistics(len(own), sum(map(len, own)) / max(len(own), 1), {t: n for t, n in df.items() if n > 1})


def length_class(n_words: int) -> int:
    return max(SHORTEST, 1 << (n_words - 1).bit_length())


class Index:
    """Postings of items of like lengths with normalised impacts and block maxima; arrays, as there may be many items."""

    def __init__(self, items: list[tuple[int | None, list[str], int]], statistics: Statistics):
        """items: id, words (at least one), question words."""
        self.items = sorted(items, key=lambda x: len(x[1]))
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws, _ in self.items for w in ws}))}
        self.size = size = len(self.vocabulary) + 1  # the last code stands after an item of one word
        parts = []
        for at, (_, ws, _) in enumerate(self.items):
            w = np.array([self.vocabulary[x] for x in ws] + [size - 1] * (len(ws) == 1), dtype=np.int64)
            terms, tf = np.unique(w[:-1] * size + w[1:], return_counts=True)
            parts.append((terms, np.full(len(terms), at, dtype=np.int32), tf))
        terms, ids, tf = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (list(zip(*parts, strict=True)) or [(), (), ()]))
        order = np.lexsort((ids, terms))
        terms, ids, tf = terms[order], ids[order], tf[order].astype(float)
        #: the postings of term k are those from starts[k] to starts[k + 1]
        self.keys, first, found = np.unique(terms, return_index=True, return_counts=True)
        self.starts = np.append(first, len(terms))
        names, frequency = [*self.vocabulary, ""], statistics.df.get
        every = np.array([frequency(f"{names[k // size]} {names[k % size]}".rstrip(), 1) for k in self.keys.tolist()], dtype=float)
        lengths, n = np.bincount(ids, tf, len(self.items)) if len(self.items) else np.zeros(0), statistics.items
        df = np.repeat(every, found)
        room = K1 * (1 - B + B * lengths[ids] / (statistics.mean or 1))
        impact = np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + room)
        self.ids, self.impacts = ids.astype(np.int32), impact / np.bincount(ids, impact, len(self.items))[ids] if len(self.items) else impact
        self.greatest = np.maximum.reduceat(self.impacts, first) if len(self.items) else np.zeros(0)
        self.passage = 2 * length_class(max((len(ws) for _, ws, _ in self.items), default=1))
        self.single = {ws[0] for _, ws, _ in self.items if len(ws) == 1}

    def postings(self, term: int) -> tuple[list[int], list[float], dict[int, float]]:
        """Items and impacts of a term, and its greatest impact in each block of POSTING_BLOCK items that it occurs in."""
        a, b = self.starts[term], self.starts[term + 1]
        ids, impacts, maxima = self.ids[a:b].tolist(), self.impacts[a:b].tolist(), {}
        for at, x in zip(ids, impacts, strict=True):
            maxima[at // POSTING_BLOCK] = max(x, maxima.get(at // POSTING_BLOCK, 0.0))
        return ids, impacts, maxima

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose impacts over the given distinct terms reach the threshold, by block-max WAND."""
        lists = [self.postings(t) for t in terms]
        greatest = self.greatest[terms].tolist()
        cursors = [[ids[0], 0, k] for k, (ids, _, _) in enumerate(lists)]
        out = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += greatest[t]
                if bound >= THRESHOLD - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // POSTING_BLOCK
            if sum(lists[t][2].get(block, 0.0) for _, _, t in cursors[: pivot + 1]) < THRESHOLD - 1e-9:
                upto = (block + 1) * POSTING_BLOCK  # no item of this block before the next cursor can reach it
                if pivot + 1 < len(cursors):
                    upto = min(upto, cursors[pivot + 1][0])
            else:
                if cursors[0][0] == item:
                    total = sum(lists[t][1][at] for _, at, t in cursors[: pivot + 1])
                    if total >= THRESHOLD - 1e-9:
                        out.append((item, total))
                    upto = item + 1
                else:
                    upto = item
            for c in cursors[: pivot + 1]:
                if c[0] < upto:
                    ids = lists[c[2]][0]
                    c[1] = bisect_left(ids, upto, c[1])
                    c[0] = ids[c[1]] if c[1] < len(ids) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def held(self, at: int, found: list[str]) -> np.ndarray:
        """Which words of the item lie in a shingle that stands in the given words."""
        ws = self.items[at][1]
        n = min(SHINGLE, len(ws))
        there = set(zip(*(found[k:] for k in range(n)), strict=False))
        covered = np.zeros(len(ws), dtype=bool)
        for k, s in enumerate(zip(*(ws[k:] for k in range(n)), strict=False)):
            if s in there:
                covered[k : k + n] = True
        return covered

    def search(self, found: list[str]) -> list[Leak]:
        """The leaks of a document's words, each item once, with its best passage's score."""
        if not found or not len(self.keys):
            return []
        get = self.vocabulary.get
        w = np.array([get(x, -1) for x in found], dtype=np.int64)
        first = np.flatnonzero((w[:-1] >= 0) & (w[1:] >= 0))
        key = w[first] * self.size + w[first + 1]
        if self.single:  # an item of one word stands wherever the word does
            alone = np.array([k for k, x in enumerate(found) if x in self.single], dtype=np.int64)
            first, key = np.concatenate([first, alone]), np.concatenate([key, w[alone] * self.size + self.size - 1])
            order = np.argsort(first, kind="stable")
            first, key = first[order], key[order]
        if not len(first):
            return []
        term = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[term] == key
        first, term = first[hit], term[hit]
        if not len(first):
            return []
        sums = np.concatenate([[0.0], np.cumsum(self.greatest[term])])
        half = self.passage // 2
        starts = np.arange(0, max(1, len(found) - half), half)
        low, high = np.searchsorted(first, starts), np.searchsorted(first, starts + self.passage)
        best: dict[int, float] = {}
        covered: dict[int, np.ndarray] = {}
        for k in np.flatnonzero(sums[high] - sums[low] >= THRESHOLD - 1e-9):
            own = list(dict.fromkeys(term[low[k] : high[k]].tolist()))
            if self.greatest[own].sum() < THRESHOLD - 1e-9:
                continue
            near = found[max(0, int(starts[k]) - half) : int(starts[k]) + self.passage + half]
            for at, score in self.retrieve(own):
                best[at] = max(score, best.get(at, 0.0))
                covered[at] = self.held(at, near) | covered.get(at, False)
        out = []
        for at, score in sorted(best.items()):
            item, ws, question = self.items[at]
            asked, answered = float(covered[at][:question].mean()), float(covered[at][question:].mean()) if question < len(ws) else None
            if covered[at].mean() >= OVERLAP or asked >= OVERLAP:
                out.append(Leak(item, score, asked, answered))
        return out


class Block:
    """The indexes of a block of items, one for each class of lengths."""

    def __init__(self, items: list[tuple[int | None, str]], statistics: Statistics | None = None):
        """``statistics``: of all items, those of the block alone where it is the only one."""
        statistics = statistics or statistics_of(t for _, t in items)
        classes: dict[int, list] = {}
        for item, text in items:
            if ws := words(text):
                classes.setdefault(length_class(len(ws)), []).append((item, ws, question_words(text)))
        self.indexes = [Index(own, statistics) for _, own in sorted(classes.items())]

    def search(self, text: str) -> list[Leak]:
        found = words(text) if self.indexes else []
        return [leak for index in self.indexes for leak in index.search(found)]


def _blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The items in blocks of about ``BLOCK_ITEMS``; one takes about 1 KB an item.

    Of several blocks, each reads its own items, and those of its terms that several items hold, from stored parts.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    if blocks == 1:
        yield Block([(r["item_id"], r["text"]) for r in items.collect()])
        return

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches):
            own = [terms_of(words(t)) for t in block.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(map(len, own), pa.int64()), pa.array([sorted(set(t)) for t in own], pa.list_(pa.string()))], ["block", "length", "terms"])

    spark = benchmark.sparkSession
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    places = [shared_path(spark, name) for name in ("items", "frequencies")]
    dealt.repartition(blocks, "block").write.partitionBy("block").parquet(places[0])
    cuts = stored(dealt.select("block", "item_id", "text").mapInArrow(cut, "block int, length long, terms array<string>"), "terms")
    sums = cuts.where("length > 0").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    terms = cuts.select("block", F.explode("terms").alias("term"))
    shared = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    terms.distinct().join(shared, "term").repartition(blocks, "block").write.partitionBy("block").parquet(places[1])
    known, frequencies = (spark.read.schema(schema).parquet(p) for p, schema in zip(places, ("item_id long, text string, block int", "term string, df long, block int"), strict=True))
    for k in range(blocks):
        df = {r["term"]: r["df"] for r in frequencies.where(F.col("block") == k).collect()}
        yield Block([(r["item_id"], r["text"]) for r in known.where(F.col("block") == k).collect()], Statistics(sums["n"], sums["length"] / max(sums["n"], 1), df))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row per leaked item of a document."""
    spark = docs.sparkSession
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def by_block(index: Block) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in row_blocks(batches):
                rows = [(d, *leak) for d, t in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True) for leak in shared.value.search(t)]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return chosen.mapInArrow(scan, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")

    return reduce(DataFrame.unionByName, map(by_block, _blocks(benchmark)))


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    spark = docs.sparkSession

    def clean(index: Block) -> Column:
        shared = spark.sparkContext.broadcast(index)

        @F.pandas_udf("boolean")
        def holds_none(texts: pd.Series) -> pd.Series:
            return pd.Series([not shared.value.search(t) for t in texts], dtype=bool)

        return holds_none(text_or_empty())

    return reduce(lambda rows, index: rows.where(clean(index)), _blocks(benchmark), docs)
