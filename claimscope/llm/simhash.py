"""SimHash near-duplicates: segment-popcount embedding, grid join under Manhattan distance, exact verification.

A fingerprint is cut into 32 segments of two bits and embedded as the vector of its segments' bit counts. Vectors of
fingerprints that differ in at most two bits have a Manhattan distance of at most two, so they agree in all but two of
eight blocks of coordinates. The grid cells are therefore the blocks' counts with two blocks left out (28 per
fingerprint); fingerprints that share no cell cannot be linked. A cell fixes 24 of the 32 counts, so among 5e10 unlike
fingerprints it holds about three ((3/8) ** 24 of them); only near copies fill larger ones. Members of a small cell are
paired within the join, the Hamming distance being part of its condition. A cell of more than ``SMALL_CELL`` members emits no pairs: its members
meet instead under each pair of bits that varies there, both blanked out, and link to the smallest of those that agree
on all other bits, which holds exactly for fingerprints at most two bits apart.

Nulls: a null text has no words and the fingerprint zero; a null ``doc_id`` never names a component unless all of its
documents have none. Repeated rows come back as often as they occur, in one component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm import resemblance
from claimscope.llm.common import row_blocks, stored, text_or_empty, unused
from claimscope.llm.graph import components

WORDS = 3
MOST_BITS = 2
SMALL_CELL = 32
SEED = 42
#: Blocks of two-bit segments, as (first bit, number of bits).
_BLOCKS = tuple((8 * k, 8) for k in range(8))
_ALL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, words: int = WORDS) -> int:
    """The unsigned 64-bit SimHash of a text; 0 if it has no words."""
    w = text.encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    parts = w if words == 1 else map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(x, SEED) for x in parts], dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches):
            found = [_signed(fingerprint(t, words)) for t in block.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(scan, "doc_id long, fp long")


def _embedded(fp: Column) -> Column:
    """The 32 segments' bit counts, two bits each, in one long."""
    low, other = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(other).bitwiseAND(low), 1).bitwiseOR(fp.bitwiseXOR(other).bitwiseAND(low))


def _cells(prints: DataFrame) -> DataFrame:
    """(fp, cell, key): the 28 grid cells of each distinct fingerprint."""
    masks = []
    for out in combinations(_BLOCKS, MOST_BITS):
        mask = _ALL
        for at, bits in out:
            mask &= ~(((1 << bits) - 1) << at)
        masks.append(_signed(mask))
    keys = F.array(*[F.col("__e").bitwiseAND(F.lit(m)) for m in masks])
    return prints.select("fp", _embedded(F.col("fp")).alias("__e")).select("fp", F.posexplode(keys).alias("cell", "key"))


def _blanked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fp, varying) to (mask, rest, fp): the fingerprint under each blanked pair of its varying bits."""
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for batch in batches:
        fps, varying = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
        for at in range(0, len(fps), 512):
            out = []
            for fp, v in zip(fps[at : at + 512], varying[at : at + 512], strict=True):
                own = bit[(v & bit) != 0]
                i, j = np.triu_indices(len(own), 1)
                mask = own[i] | own[j] if len(own) > 1 else own
                out.append((mask, fp & ~mask, np.full(len(mask), fp)))
            cols = [np.concatenate(x).view(np.int64) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["mask", "rest", "fp"])


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) whose closure joins all distinct fingerprints at most two bits apart. ``prints`` is read repeatedly."""
    cells = _cells(prints)
    shared = cells.groupBy("cell", "key").agg(F.count(F.lit(1)).alias("n"), F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("varying")).where("n > 1")
    members = stored(cells.join(shared.hint("merge"), ["cell", "key"]), "cells")
    small, large = members.where(F.col("n") <= SMALL_CELL), members.where(F.col("n") > SMALL_CELL)
    other = small.select("cell", "key", F.col("fp").alias("b"))
    near = (
        small.select("cell", "key", F.col("fp").alias("a"))
        .join(other.hint("merge"), ["cell", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS))
        .select("a", "b")
    )
    blanked = large.groupBy("fp").agg(F.bit_or("varying").alias("varying")).mapInArrow(_blanked, "mask long, rest long, fp long")
    met = blanked.groupBy("mask", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = met.where("n = 2").select("a", F.col("last").alias("b"))
    more = met.where("n > 2").select("mask", "rest", "a").join(blanked.hint("merge"), ["mask", "rest"]).select("a", F.col("fp").alias("b")).where("a <> b")
    return near.unionByName(pairs).unionByName(more)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    marked = stored(fingerprints(docs), "fingerprints")
    prints = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(links(prints))
    grouped = prints.join(roots.hint("merge"), prints["fp"] == roots["node"]).select("fp", "first", "root")
    named = grouped.groupBy("root").agg(F.min("first").alias("least"))
    joined = grouped.join(named.hint("merge"), "root").select(F.col("fp").alias("node"), "least")
    own = prints.join(joined.hint("merge"), prints["fp"] == joined["node"], "left").select(F.col("fp").alias("print"), F.coalesce("least", "first").alias("component_id"))
    out = marked.join(own.hint("merge"), marked["fp"] == own["print"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = resemblance.WORDS, similarity: float = resemblance.SIMILARITY) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns: the one with the smallest doc_id.

    Fingerprints and their links are those of ``near_duplicates``; an exact check follows: documents are near-duplicates if
    their shingles of ``words`` words have at least this Jaccard similarity. Pairs of that similarity differ in up to ten
    bits and more, beyond any grid of fingerprints, so MinHash bands add theirs to the candidates. Documents without an id come after those with one, and documents with one id are told apart by
    their texts; of rows with the same id and text one stays. No column is changed, whatever it is called.
    """
    found = resemblance.groups(docs, words, similarity, fingerprint, links)
    rows = found.groupBy("root", "doc_id", "tie").agg(F.count(F.lit(1)).alias("rows"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "rows")
    own_id, own_tie, kept_id, kept_tie, several = unused(docs, "__id", "__tie", "__kept", "__text", "__many")
    first = rows.groupBy("root").agg(F.min(order).alias("first"))
    kept = stored(first.select(F.col("first.doc_id").alias(kept_id), F.col("first.tie").alias(kept_tie), (F.col("first.rows") > 1).alias(several)), "kept")
    rows = docs.withColumn(own_id, F.col("doc_id").cast("long")).withColumn(own_tie, F.xxhash64(text_or_empty()))
    # by shuffle: the kept ids grow with the corpus, so a broadcast of them has no bound
    out = rows.join(kept.hint("merge"), F.col(own_id).eqNullSafe(F.col(kept_id)) & (F.col(own_tie) == F.col(kept_tie)))
    # where a kept id and text stand in several rows, one of them stays
    many = out.where(F.col(several)).dropDuplicates([own_id, own_tie])
    return out.where(~F.col(several)).unionByName(many).select(*docs.columns)
