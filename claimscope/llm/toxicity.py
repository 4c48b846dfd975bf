"""Toxicity by compression distance between a toxic and an ordinary zstandard dictionary.

Both dictionaries are learned from labelled documents: beginnings of words that are found far more often in toxic
documents make the toxic one, frequent ones without such an excess the ordinary one. A window is one word of the
lower-cased text; behind a fixed key, by which every dictionary entry starts too, a word that a dictionary knows
compresses to one match, whatever stands next to it. The difference of the two lengths is the window's distance. A
logistic model, fitted on cross-fitted distances, turns the counts of windows beyond each threshold into a score.

The fit sees at most ``SAMPLE_PER_CLASS`` labelled documents of each class, of at most ``SAMPLE_CHARS`` code points,
chosen by a hash of their ids; everything else reads whole texts of all documents.

Nulls: a null text is empty; a null ``doc_id`` has no fold (held_out false) and no label; null labels are not used. A
document labelled twice counts as toxic if any label says so. Repeated rows get equal scores. Empty documents, labels
or classes: with no document of one class to learn from, every score is 0. Extra columns are ignored by ``score`` and
kept by ``drop_toxic``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import row_blocks, text_or_empty

FOLDS, HELD_OUT = 3, 1
SAMPLE_PER_CLASS, SAMPLE_CHARS = 3000, 16_000
THRESHOLD = 0.7
LEVEL = 13
KEY = b"<0123456789:>"
MOST_ENTRIES = 3000
#: A word beginning is toxic if its excess is so many standard errors, and so many times its ordinary share.
LEAST_Z, LEAST_RATIO, LEAST_DOCS = 5.0, 5.0, 4
SHORTEST, LONGEST = 5, 16
DISTANCES = (2, 3, 4, 5, 6, 7)
_LETTERS = re.compile(rb"[a-z\x80-\xff]+")


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def windows(text: str) -> list[bytes]:
    return [b" " + w + b" " for w in _LETTERS.findall(text.lower().encode("utf-8", "replace"))]


def _beginnings(text: str) -> set[bytes]:
    return {w[:k] for w in set(windows(text)) for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


def dictionaries(texts: Iterable[str], toxic: Iterable[int]) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary."""
    found, n = (Counter(), Counter()), [0, 0]
    for text, label in zip(texts, toxic, strict=True):
        found[label].update(_beginnings(text))
        n[label] += 1
    excess: dict[bytes, float] = {}
    for f, a in found[1].items():
        if a >= LEAST_DOCS:
            b = found[0][f]
            p1, p0, p = a / n[1], (b + 0.5) / max(n[0], 1), min(0.999, (a + b) / sum(n))
            z = (p1 - p0) / math.sqrt(p * (1 - p) * (1 / n[1] + 1 / max(n[0], 1)))
            if z > LEAST_Z and p1 > LEAST_RATIO * p0:
                excess[f] = z
    longer = {f[:k]: max(found[1][f], 0) for f in sorted(excess, key=lambda f: found[1][f]) for k in range(SHORTEST, len(f))}
    own = sorted((f for f in excess if longer.get(f, 0) < 0.8 * found[1][f]), key=lambda f: (excess[f], f))
    common = sorted((f for f, c in found[0].items() if c >= 3 and f not in excess), key=lambda f: (found[0][f] * (len(f) - SHORTEST + 1), f))
    return tuple(b"".join(KEY + f for f in x[-MOST_ENTRIES:]) for x in (own, common))


class Distances:
    """Compression distances of windows; those of words met before are kept, up to ``most_kept``."""

    def __init__(self, toxic: bytes, ordinary: bytes, most_kept: int = 500_000):
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=3, search_log=7, hash_log=17, chain_log=17, window_log=18, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0
        )
        self.by = [
            zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x or KEY, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress
            for x in (toxic, ordinary)
        ]
        self.kept: dict[bytes, int] = {}
        self.most_kept = most_kept

    def of(self, word: bytes) -> int:
        found = self.kept.get(word)
        if found is None:
            by_toxic, by_ordinary = self.by
            found = len(by_ordinary(KEY + word)) - len(by_toxic(KEY + word))
            if len(self.kept) >= self.most_kept:
                self.kept.clear()
            self.kept[word] = found
        return found

    def features(self, text: str) -> list[float]:
        """Constant, greatest distance, windows from each distance on (as logarithms and shares), number of windows."""
        words = windows(text)
        if not words:
            return [1.0] + [0.0] * (2 + 2 * len(DISTANCES))
        found = list(map(self.kept.get, words))
        if None in found:
            found = [self.of(w) if d is None else d for w, d in zip(words, found, strict=True)]
        d = np.array(found)
        hits = [int((d >= k).sum()) for k in DISTANCES]
        return [1.0, float(d.max()), math.log(len(d)), *(math.log1p(h) for h in hits), *(math.sqrt(h / len(d)) for h in hits)]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(texts: list[str], toxic: list[int], share: float) -> Model | None:
    """Dictionaries from all given texts; weights from distances by dictionaries of the other half. ``share``: of toxic texts at large."""
    if not 0 < sum(toxic) < len(toxic):
        return None
    rows: list[list[float]] = [[]] * len(texts)
    for half in (0, 1):
        learned = [k for k in range(len(texts)) if k % 2 == half]
        by = Distances(*dictionaries([texts[k] for k in learned], [toxic[k] for k in learned]))
        for k in range(1 - half, len(texts), 2):
            rows[k] = by.features(texts[k])
    y = np.array(toxic, dtype=float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(*dictionaries(texts, toxic), tuple(_logistic(np.array(rows), y, weight)))


def _fold(column: Column) -> Column:
    return F.crc32(column.cast("string")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learn from a bounded sample of the labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    known = (
        labels.where("toxic is not null and doc_id is not null")
        .where(_fold(F.col("doc_id")) != HELD_OUT)
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("label"))
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    ids = [tuple(r) for label in (0, 1) for r in known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_CLASS).collect()]
    if not ids or not counts.get(0) or not counts.get(1):
        return None
    chosen = spark.createDataFrame(ids, "id long, label int")
    found = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    # of rows that share an id one text is learned, so that what is collected is bounded by the sample
    texts = found.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = sorted({(r["label"], r["text"]): r["id"] for r in texts.collect()}.items(), key=lambda x: (x[1], x[0]))
    return learn([text for (_, text), _ in rows], [label for (label, _), _ in rows], counts[1] / (counts[0] + counts[1]))


class Scorer:
    def __init__(self, model: Model | None):
        self.by = Distances(model.toxic, model.ordinary) if model else None
        self.weights = np.array(model.weights) if model else None

    def __call__(self, text: str) -> float:
        if self.by is None:
            return 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.by.features(text), self.weights))))))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for block in row_blocks(batches):
            found = [scorer(t) for t in block.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(scan, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(_fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    model = fit(docs, labels)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series([scorer(t) for t in texts], dtype=float)

    return docs.where(scores(text_or_empty()) < THRESHOLD)
