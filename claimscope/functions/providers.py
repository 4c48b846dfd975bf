"""What a caller can vary: the tokenizer of texts without blanks, the embedding of words and texts, links as a table function.

Pretrained models and dictionaries are the caller's; the defaults here need none, and keep the operators' semantics.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.operators.segmentation import Tagger, tagger

#: A dictionary of so many terms at most goes to every task.
MOST_TERMS = 1_000_000
_HAN = r"[㐀-鿿]+"


def segment(run: str, costs: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The most probable cut of a run of characters into dictionary terms; single characters where it has none."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        best.append(min((best[start][0] + costs.get(run[start:end], unknown if end - start == 1 else math.inf), start) for start in range(max(0, end - longest), end)))
    out, end = [], len(run)
    while end:
        start = best[end][1]
        out.append(run[start:end])
        end = start
    return out[::-1]


def with_unknown_words(pieces: list[str], costs: dict[str, float], tagger: Tagger) -> list[str]:
    """Neighbouring single characters are cut anew by the tagger, unless together they are a dictionary term."""
    out, run = [], ""
    for piece in [*pieces, ""]:
        if len(piece) == 1:
            run += piece
            continue
        if run:
            out += [run] if len(run) == 1 else list(run) if run in costs else tagger.cut(run)
        run = ""
        if piece:
            out.append(piece)
    return out


def dictionary_segmenter(dictionary: DataFrame, model: DataFrame | None = None, runs: str = _HAN) -> Callable[[Column], Column]:
    """A segmenter from a dictionary (term, freq): runs of characters are cut into words, joined by blanks; the rest stays.

    With ``model``, a table of ``operators.segmentation.fit``, what the dictionary leaves as single characters becomes words
    by the most probable states. ``runs`` is the pattern of a run (Chinese characters by default). The sizes of dictionary and
    model are checked before they are collected.
    """
    if dictionary.limit(MOST_TERMS + 1).count() > MOST_TERMS:
        raise ValueError(f"the dictionary has more than {MOST_TERMS} terms")
    freq = {r["term"]: float(r["freq"]) for r in dictionary.where("term <> '' and freq > 0").collect()}
    total = sum(freq.values()) or 1.0
    costs, longest, unknown = {t: -math.log(f / total) for t, f in freq.items()}, max(map(len, freq), default=1), -math.log(0.5 / (total + 1))
    shared, pattern = dictionary.sparkSession.sparkContext.broadcast((costs, None if model is None else tagger(model))), re.compile(runs)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        own, states = shared.value

        def words(run: str) -> list[str]:
            pieces = segment(run, own, longest, unknown)
            return pieces if states is None else with_unknown_words(pieces, own, states)

        return texts.map(lambda t: " ".join(pattern.sub(lambda m: " " + " ".join(words(m[0])) + " ", t).split()), na_action="ignore")

    return cut


#: Characters whose trigrams are hashed at a time.
HASHED_AT_ONCE = 1 << 20


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _trigram_hashes(points: np.ndarray) -> np.ndarray:
    """zlib.crc32 of the UTF-8 bytes of every three neighbouring code points."""
    n = max(0, len(points) - 2)
    crc = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(3):  # as if all were ASCII
        crc = _CRC[(crc ^ points[at : at + n]) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    wide = points > 0x7F
    rest = np.flatnonzero(wide[:n] | wide[1 : n + 1] | wide[2 : n + 2])
    if len(rest):
        crc[rest] = _wide_hashes([points[rest + at] for at in range(3)])
    return ~crc


def _wide_hashes(trigrams: list[np.ndarray]) -> np.ndarray:
    """The same, before the last inversion, of trigrams of any code points, by the bytes that each has."""
    crc = np.full(len(trigrams[0]), 0xFFFFFFFF, dtype=np.uint32)
    for points in trigrams:
        points = np.where((points >= 0xD800) & (points < 0xE000), np.uint32(0x3F), points)  # no character: a question mark
        n = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        first = np.array([0, 0, 0xC0, 0xE0, 0xF0], dtype=np.uint32)[n]
        for k in range(int(n.max())):
            own = points >> (6 * np.maximum(n - 1 - k, 0)).astype(np.uint32)
            byte = own & np.uint32(0x3F) | np.uint32(0x80) if k else own | first
            crc = np.where(n > k, _CRC[(crc ^ byte) & np.uint32(0xFF)] ^ (crc >> np.uint32(8)), crc)
    return crc


class HashedEmbedding:
    """Unit vectors of character trigrams by hash, standing in for a sentence model; null texts give null.

    As every provider of embeddings: a function of a column, and ``vectors``, the same for texts within a task.
    """

    def __init__(self, size: int = 64):
        self.size = size

    def vectors(self, texts: Sequence[str]) -> np.ndarray:
        """One row a text."""
        sums = np.zeros(len(texts) * self.size)
        at = 0
        while at < len(texts):
            padded, chars, first = [], 0, at
            while at < len(texts) and (not padded or chars < HASHED_AT_ONCE):
                padded.append(f" {texts[at].lower()} ")
                chars, at = chars + len(padded[-1]), at + 1
            lengths = np.array([len(x) for x in padded])
            owner = np.repeat(np.arange(first, at), lengths)
            inside = np.ones(chars, dtype=bool)  # a trigram begins here and ends in the same text
            ends = np.cumsum(lengths)
            inside[ends - 1] = inside[ends - 2] = False
            points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            for low in range(0, chars, HASHED_AT_ONCE):  # a long text in parts
                part = points[low : low + HASHED_AT_ONCE + 2]
                h = _trigram_hashes(part)
                here = inside[low : low + len(h)]
                h, whose = h[here].astype(np.int64), owner[low : low + len(here)][here]
                found = np.bincount((whose - first) * self.size + h % self.size, np.where(h & 0x10000, 1.0, -1.0), (at - first) * self.size)
                sums[first * self.size : at * self.size] += found
        v = sums.reshape(len(texts), self.size)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))  # of whole numbers, so exact in any order
        return np.divide(v, norm, out=v, where=norm > 0)

    def __call__(self, text: Column) -> Column:
        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                vectors = iter(self.vectors([t for t in texts if t is not None]).tolist())
                yield pd.Series([None if t is None else next(vectors) for t in texts], dtype=object)

        return embed(text)


def hashed_embedding(size: int = 64) -> HashedEmbedding:
    return HashedEmbedding(size)


@F.udtf(returnType="pos int, href string, text string")
class ExtractLinks:
    """Links of a page as rows: ``LATERAL extract_links(html)`` once registered."""

    def eval(self, html: str):
        for k, m in enumerate(re.finditer(r'<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', html or "", re.S)):
            yield k + 1, m[1], re.sub(r"<[^>]*>", "", m[2])
