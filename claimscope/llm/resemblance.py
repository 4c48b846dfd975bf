"""Near-duplicates by resemblance: fingerprints and MinHash bands name candidates, the Jaccard similarity of the word shingles decides.

A text's distinct shingles of ``WORDS`` lower-cased words give ``BANDS`` band keys of ``ROWS`` minima each, and a sketch
of ``SKETCH`` bits, one of each further minimum. Texts with equal shingles are one node. A caller's fingerprints name
candidates first: nodes of one fingerprint, and of fingerprints that the caller links. Candidate pairs of bands are compared in
three steps, each over the cells whose members are not all joined by the step before: the members of a cell with one of
them, its centre; with about ``CENTRES`` of them, of different components; and with all of other components. Lengths,
sketches and the shingles themselves are compared within the join, so that only links are ever written, never the pairs
of a group. No cell is capped; the last step deals a large cell's members to chunks of about ``CHUNK``.

A pair at similarity s shares no band with probability (1 - s ** ROWS) ** BANDS, 7e-4 at 0.8 and 2e-5 at 0.85, and is
ruled out by its sketches with probability 1e-4 at 0.8 and less above. Shingles are compared by 64-bit hashes.

Nulls: a null text has no words; texts without words are equal to each other. A text of fewer words than a shingle is
one shingle. Repeated rows come back as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import row_blocks, stored, text_or_empty
from claimscope.llm.graph import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS, SKETCH, SEED = 24, 6, 256, 42
#: Sketches of texts at ``SIMILARITY`` differ in 25.6 bits on average, with a standard deviation of 4.8.
MOST_DIFFERENT = 45
CENTRES, CHUNK = 16, 1000
_HASHES = BANDS * ROWS + SKETCH
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, _HASHES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    w = text.encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    parts = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(x, SEED) for x in parts], dtype=np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two results of ``shingles``."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _signature(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The band keys and the sketch (four longs) of a text's shingles."""
    least = np.full(_HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), 1024):
        np.minimum(least, (own[at : at + 1024] * _FACTORS[:, None]).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least[: BANDS * ROWS].reshape(BANDS, ROWS))]
    bits = (least[BANDS * ROWS :] >> np.uint64(20) & np.uint64(1)).astype(np.uint8)
    return np.array(keys, dtype=np.uint64).view(np.int64), np.packbits(bits).view(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_SKETCHES = [f"s{k}" for k in range(SKETCH // 64)]


def _signatures(docs: DataFrame, words: int, fingerprint: Callable[[str], int] | None) -> DataFrame:
    """(doc_id, tie, node, n, fp, sketch, bands): hashes of the text and of its shingles, their number, the text's
    fingerprint (0 without one), sketch and band keys."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches):
            nodes, sizes, prints, keys, sketches = [], [], [], [], []
            for text in block.column(2).to_pylist():
                own = shingles(text, words)
                nodes.append(_signed(xxhash.xxh64_intdigest(own.tobytes(), SEED)))
                sizes.append(len(own))
                prints.append(_signed(fingerprint(text)) if fingerprint else 0)
                bands, sketch = _signature(own)
                keys.append(bands if len(own) else bands[:0])  # all texts without words are one node
                sketches.append(sketch)
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
            parts = [pa.array(x) for x in np.array(sketches).T]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), *parts, lists], ["doc_id", "tie", "node", "n", "fp", *_SKETCHES, "bands"])

    schema = f"doc_id long, tie long, node long, n long, fp long, {', '.join(f'{s} long' for s in _SKETCHES)}, bands array<long>"
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tie"), text_or_empty().alias("text"))
    return chosen.mapInArrow(scan, schema)


def _near(a: str, b: str, least: float) -> Column:
    """Whether two nodes (structs n, sketch, set) have the similarity: by their lengths, their sketches, their shingles."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    different = sum(F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _SKETCHES)
    both = F.size(F.array_intersect(f"{a}.set", f"{b}.set"))
    return (F.least(na, nb) >= F.lit(least) * F.greatest(na, nb) - 1e-9) & (different <= MOST_DIFFERENT) & (both >= F.lit(least) * (na + nb - both) - 1e-9)


def _ordered(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _profiles(docs: DataFrame, nodes: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(node, look) of the members, stored: length, sketch, bands and shingles. One pass and one shuffle of the documents."""
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("at.doc_id").alias("__doc"), F.col("at.tie").alias("__tie")), "node")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tie"), text_or_empty().alias("text"))
    # by shuffle: the members grow with the corpus, so a broadcast of them has no bound
    found = chosen.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("tie") == F.col("__tie")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches):
            sets = [shingles(t, words).view(np.int64) for t in block.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["node", "set"])

    sets = found.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(cut, "node long, set array<long>")
    return stored(sets.join(nodes, "node").select("node", F.struct("n", *_SKETCHES, "bands", "set").alias("look")), "profiles")


def _renamed(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """``column`` replaced by its root, where it has one."""
    named = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    others = [c for c in rows.columns if c != column]
    return rows.join(named.hint("merge"), F.col(column) == F.col("__node"), "left").select(*others, F.coalesce("__root", column).alias(column))


def _named(prints: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Candidate pairs (a, b) by fingerprints (fp, node): nodes of one fingerprint with the first of them, and the first
    nodes of two fingerprints that ``near`` links."""
    first = stored(prints.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    same = prints.join(first.hint("merge"), "fp").where("node <> first").select(*_ordered("node", "first"))
    side = lambda fp, node: first.select(F.col("fp").alias(fp), F.col("first").alias(node)).hint("merge")
    linked = near(first).join(side("a", "one"), "a").join(side("b", "other"), "b").where("one <> other")
    return stored(same.unionByName(linked.select(*_ordered("one", "other"))).distinct(), "named")


def _links(docs: DataFrame, nodes: DataFrame, named: DataFrame | None, words: int, least: float) -> DataFrame:
    """Components (node, root) of all nodes that have a near-duplicate. ``named``: candidate pairs beside those of the bands."""
    cells = nodes.select("node", F.explode("bands").alias("key"))
    centres = cells.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min_by("node", F.xxhash64("node")).alias("centre")).where("m > 1")
    members = stored(cells.join(centres.hint("merge"), "key"), "members")
    known = members.select("node")
    if named is not None:
        known = known.unionByName(named.select(F.explode(F.array("a", "b")).alias("node")))
    profiles = _profiles(docs, nodes, known, words)
    side = lambda node, look: profiles.select(F.col("node").alias(node), F.col("look").alias(look)).hint("merge")
    pairs = members.where("node <> centre").select(*_ordered("node", "centre"))
    pairs = (pairs if named is None else pairs.unionByName(named)).distinct().join(side("a", "__a"), "a")
    other = side("__node", "__b")
    near = pairs.join(other, (F.col("b") == F.col("__node")) & _near("__a", "__b", least)).select("a", "b")
    roots = stored(components(near), "roots")
    rest = members.where("m > 2").select("key", "node")  # the pair of a cell of two was compared
    for last in (False, True):
        left = _renamed(rest.withColumn("root", F.col("node")), roots, "root")
        # cells whose members are all in one component have nothing left to compare
        sizes = left.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"), F.approx_count_distinct("root").alias("roots"))
        left = stored(left.join(sizes.where("low < high").select("key", "size", "roots"), "key"), "left")
        rest = left.select("key", "node")
        full = left.join(side("node", "look"), "node")
        apart = F.col("root") != F.col("__root")
        chunks = F.ceil(F.col("size") / CHUNK).cast("int")
        if last:  # a pair is compared in the first cell that it shares, one way round
            full = full.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
            other = left.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int"))
            apart = apart & (F.col("node") < F.col("__node")) & (F.array_min(F.array_intersect("look.bands", "__look.bands")) == F.col("key"))
        else:  # about CENTRES components of a cell, by a hash, with one member each
            full = full.withColumn("chunk", F.lit(0))
            other = left.where(F.pmod(F.xxhash64("key", "root"), F.greatest("roots", F.lit(CENTRES))) < CENTRES)
            other = other.groupBy("key", "root").agg(F.min_by("node", F.xxhash64("node")).alias("node")).withColumn("chunk", F.lit(0))
        other = other.select(F.col("key").alias("__key"), F.col("chunk").alias("__chunk"), F.col("root").alias("__root"), F.col("node").alias("__node")).join(side("__node", "__look"), "__node")
        same = (F.col("key") == F.col("__key")) & (F.col("chunk") == F.col("__chunk"))
        near = stored(full.join(other.hint("merge"), same & apart & _near("look", "__look", least)).select(*_ordered("node", "__node")).distinct(), "near")
        if not near.limit(1).count():
            continue
        joined = stored(components(_renamed(_renamed(near, roots, "a"), roots, "b")), "joined")
        # roots of before that were joined, and members that had no root, take the new one
        roots = stored(_renamed(roots, joined, "root").unionByName(joined.join(roots.select("node"), "node", "left_anti")), "roots")
    return roots


def groups(
    docs: DataFrame,
    words: int = WORDS,
    least: float = SIMILARITY,
    fingerprint: Callable[[str], int] | None = None,
    near: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per document: doc_id, tie (a hash of its text), root (the same within a group of near-duplicates).

    ``fingerprint`` of a text (unsigned, 64 bits) and ``near``, which links distinct fingerprints (fp, signed) as rows a, b,
    name candidate pairs before the bands do.
    """
    marked = stored(_signatures(docs, words, fingerprint), "signatures")
    one = [F.first(c).alias(c) for c in ("n", *_SKETCHES, "bands")]
    nodes = stored(marked.groupBy("node").agg(*one, F.first(F.struct("doc_id", "tie")).alias("at")), "nodes")
    rows = marked.select("doc_id", "tie", F.col("node").alias("root"))
    named = _named(marked.select("fp", "node").distinct(), near) if fingerprint and near else None
    return _renamed(rows, _links(docs, nodes, named, words, least), "root")
