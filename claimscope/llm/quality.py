"""Quality rules: counts of a text, and compression bands.

A text is rejected if it has too few words or too many repeated five-word windows (base rules), or if its zstandard
ratio lies outside the band for its length, or if more than a share of its bytes lie in chunks outside the chunks' band.
The last chunk ends with the text and stands for the bytes that no other chunk holds; a text of less than a chunk is
judged by its whole ratio. Low ratios are repetitive text, high ones incompressible text. Short texts have no band: a few dozen bytes say nothing.

Nulls: a null text has no words, all counts 0, and is not kept; a null ``doc_id`` is passed through. Each row is judged
by itself, so ties and repeated rows get equal verdicts and an empty table gives no rows. Texts are read whole,
whatever their length. Extra columns are ignored by ``assess`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import row_blocks, text_or_empty

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
LEVEL = 3
CHUNK = 4096
#: (bytes from which the band holds, least ratio, most ratio) of whole texts at LEVEL. Set between what repetition does to a
#: text and what ordinary texts of other sources do: half of 255 manuals, notes and licences that pass the base rules put the
#: least ratios (a tenth of them lies below, most of those changelogs and licences of repeated clauses), the other half
#: measured them; texts labelled good in the test tables lie well above. From 65,536 bytes on there were few texts: the limit
#: falls as it does before. The most ratios lie above those of all these texts but for such with encoded bytes in them.
BANDS = (
    (0, 0.0, 9.9), (256, 0.55, 1.0), (512, 0.485, 0.85), (1024, 0.445, 0.76), (2048, 0.42, 0.74), (4096, 0.38, 0.72), (8192, 0.355, 0.71), (16384, 0.335, 0.70), (32768, 0.30, 0.68),
    (65536, 0.28, 0.68), (1 << 18, 0.26, 0.68),
)
#: Of chunks: half of those of the same texts have ratios of 0.43 to 0.47, a twentieth less than 0.34.
CHUNK_BAND = (0.33, 0.74)
MOST_CHUNKS_OUTSIDE = 0.25

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


class Counts(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool


def _repeated(words: list[bytes]) -> int:
    """Words that stand in a five-word window found at least twice."""
    if len(words) < WINDOW:
        return 0
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered = upto = 0
    for at, w in enumerate(windows):
        if seen[w] > 1:
            covered += at + WINDOW - max(at, upto)
            upto = at + WINDOW
    return covered


def _repeated_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def in_bands(data: bytes, compressor: zstandard.ZstdCompressor) -> bool:
    """The method's verdict on a text's UTF-8 bytes."""
    size = len(data)
    least, most = next((low, high) for start, low, high in reversed(BANDS) if size >= start)
    if size >= BANDS[1][0] and not least <= len(compressor.compress(data)) / size <= most:
        return False
    if size < CHUNK:
        return True
    outside = 0
    for at in range(0, size, CHUNK):
        chunk = data[min(at, size - CHUNK) : min(at + CHUNK, size)]  # the last one is anchored at the end
        if not CHUNK_BAND[0] <= len(compressor.compress(chunk)) / CHUNK <= CHUNK_BAND[1]:
            outside += min(CHUNK, size - at)
    return outside <= MOST_CHUNKS_OUTSIDE * size


def judge(text: str, compressor: zstandard.ZstdCompressor) -> Counts:
    data = text.encode("utf-8", "replace")
    words = data.split()  # bytes split at space and U+0009 to U+000D only
    n, repeated = len(words), _repeated(words)
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * n
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(data.count, (bytes([c]) for c in SYMBOLS)))
    return Counts(n, len(text) - blanks, symbols, _repeated_lines(data), repeated, failed, not failed and in_bands(data, compressor))


def assess(docs: DataFrame) -> DataFrame:
    """doc_id with the counts and the verdict of every document; one pass, no shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
        for block in row_blocks(batches):
            found = list(zip(*(judge(t, compressor) for t in block.column(1).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], ["doc_id", *Counts._fields])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(scan, f"doc_id long, {FIELDS}")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""

    @F.pandas_udf("boolean")
    def passes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        for texts in batches:
            yield pd.Series([judge(t, compressor).kept for t in texts], dtype=bool)

    return docs.where(passes(text_or_empty()))
