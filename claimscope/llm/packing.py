"""Best-fit packing planned on the length histogram.

Documents become pieces of at most ``capacity`` tokens. Best-fit decreasing runs over *counts per length* - at most
``capacity`` numbers, whatever the corpus size - and yields slots: so many pieces of a length, from a rank on, take
an offset in consecutive sequences. Each piece then finds its slot by its rank within its length.

Nulls: a null text is an empty document (one piece holding only the end id); a null ``doc_id`` is a document of its
own like any other. Repeated rows are packed as often as they occur. An empty table gives no rows. Extra columns of
the documents are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import numbered, row_blocks, stored, text_or_empty
from claimscope.llm.tokens import default_vocabulary, worker_encoder

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that a numbering window sees at once, on average.
RANK_GROUP = 1000

PIECES = "doc_id long, piece int, start long, length long, ids binary"


class Slots(NamedTuple):
    """``count`` pieces of ``length``, from rank ``first`` on, lie at ``offset`` in sequences ``sequence``, +1, ..."""

    length: int
    first: int
    count: int
    sequence: int
    offset: int


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: full ones, and a shorter first one for what is left over."""
    rest = total % capacity
    return ([rest] if rest else []) + [capacity] * (total // capacity)


def token_pieces(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, *, checksum: bool = False
) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit), cut into pieces of at most ``capacity``.

    ``checksum=True`` returns ``ids_crc32`` in place of the ids, for callers that only place the pieces.
    """
    vocabulary = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = worker_encoder(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        for block in row_blocks(batches, 4 << 20):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                ids, start = encoder.encode_bytes(text) + end, 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + n)]
                    for column, value in zip(out, (doc, k, start, n, zlib.crc32(own) if checksum else own), strict=True):
                        column.append(value)
                    start += n
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64() if checksum else pa.binary())
            names = ["doc_id", "piece", "start", "length", "ids_crc32" if checksum else "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    schema = PIECES.replace("ids binary", "ids_crc32 long") if checksum else PIECES
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(encode, schema)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Slots], int]:
    """Best-fit decreasing over a length histogram: the slots, and the number of sequences.

    Sequences with the same room left are handled together as intervals of sequence numbers, so the work depends on
    the number of lengths, not on the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> intervals (first sequence, how many)
    open_rooms: list[int] = []  # its keys, ascending
    slots: list[Slots] = []
    used = 0

    def give(left: int, first: int, many: int) -> None:
        if left and many:
            if left not in room:
                room[left] = []
                insort(open_rooms, left)
            room[left].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            at = bisect_left(open_rooms, length)
            if at < len(open_rooms):
                left = open_rooms[at]
                first, many = room[left].pop()
                if not room[left]:
                    del room[left], open_rooms[at]
            else:
                each = capacity // length
                left, first, many = capacity, used, -(-todo // each)
                used += many
            each = left // length
            full = min(many, todo // each)
            for k in range(each if full else 0):
                slots.append(Slots(length, rank, full, first, capacity - left + k * length))
                rank += full
            todo -= full * each
            give(left - each * length, first, full)
            first, many = first + full, many - full
            if many and todo:  # fewer are left than this sequence would hold
                for k in range(todo):
                    slots.append(Slots(length, rank, 1, first, capacity - left + k * length))
                    rank += 1
                give(left - todo * length, first, 1)
                first, many, todo = first + 1, many - 1, 0
            give(left, first, many)
    return slots, used


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place pieces (row, length and any further columns) in sequences: adds sequence_id and offset.

    ``row`` tells pieces apart, also those of repeated documents, so that a document's copies are dealt to many tasks.
    ``pieces`` is read several times and must be a stored table. To the driver go the counts per length only, at most
    ``capacity`` rows; the slots go back to the tasks as a table of a size that likewise depends on ``capacity`` alone.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, _ = best_fit(counts, capacity)
    by_length: dict[int, list[Slots]] = {}
    for s in slots:
        by_length.setdefault(s.length, []).append(s)
    tables = spark.sparkContext.broadcast({n: tuple(np.array(x, dtype=np.int64) for x in zip(*((s.first, s.sequence, s.offset) for s in own), strict=True)) for n, own in by_length.items()})
    sizes = spark.createDataFrame([(n, 1 + c // RANK_GROUP) for n, c in counts.items()], "__length long, __groups long")
    ranked = numbered(
        pieces.join(F.broadcast(sizes), F.col("length") == F.col("__length")).drop("__length"), ["length"], ["row"], salts=F.col("__groups"), name="__rank"
    ).drop("__groups")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: k for k, n in enumerate(batch.schema.names)}
            lengths, ranks = (batch.column(at[n]).to_numpy(zero_copy_only=False) for n in ("length", "__rank"))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                first, base, offsets = tables.value[int(lengths[own[0]])]
                slot = np.searchsorted(first, ranks[own], side="right") - 1
                sequence[own], offset[own] = base[slot] + ranks[own] - first[slot], offsets[slot]
            kept = [k for n, k in at.items() if n != "__rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in kept] + [pa.array(sequence), pa.array(offset)], [batch.schema.names[k] for k in kept] + ["sequence_id", "offset"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Digest of a whole packing: doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row per piece."""
    pieces = stored(token_pieces(docs, capacity, vocabulary=vocabulary, checksum=True).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
