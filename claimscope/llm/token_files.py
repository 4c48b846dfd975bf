"""Token files in training order: a keyed permutation gives every sequence a global slot in fixed-stride shards.

Texts become ids with an end id; the ids of all documents, one after another in the order of the table (files by path,
rows by place), are one stream that is cut into sequences of ``length`` ids, only the last of which is padded. A Feistel
network keyed by ``seed`` permutes the sequences' numbers, walking its cycle until the value falls below the number of
sequences: a slot depends on the table, its order and the seed, not on how the table is split among tasks. Each task
counts the ids of its splits; where a split starts in the stream follows from the counts of the splits before it.
(A table that is not read from files has the order of its partitions.) Slots are cut into ranges, one file each, in which
every record has the same stride, so that a reader finds slot s by arithmetic and resumes anywhere. A record says which
document its first id belongs to, how many of that document's ids come before, how many ids it has, and the ids. Behind
the records of a shard an index lists the documents that begin inside a record, with their place; ``INDEX_STEP`` records
apart it can be entered without reading what is before.

Nulls: a null text is empty (the end id alone); a null ``doc_id`` comes back as null. Repeated rows are written as often
as they occur. An empty table gives no files and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import row_blocks, stored, text_or_empty
from claimscope.llm.files import opened
from claimscope.llm.tokens import default_vocabulary, worker_encoder
from claimscope.session import shared_path

LENGTH, END_ID, SEED = 256, 50256, 20240101
SHARD_BYTES, FLUSH_BYTES, READ_RECORDS = 32 << 20, 16 << 20, 16384
#: Of the shuffle to the shards; where there are more shards, a partition owns consecutive ones and writes one after the other.
MOST_PARTITIONS = 10_000
LEVEL = 6
_NO_ID = -(1 << 63)

#: (shard, path, first slot, number of slots, ids in a record)
FILES = "shard long, path string, first long, slots long, length int"
SEQUENCES = "slot long, shard long, doc_id long, start int, n_tokens int, ids binary, documents array<struct<doc_id: long, start: int, at: int, n: int>>"
INDEX_STEP = 1024


def record_type(length: int) -> np.dtype:
    """Layout of a record: little-endian, ids as unsigned 16-bit integers."""
    return np.dtype([("doc_id", "<i8"), ("start", "<i4"), ("n", "<i4"), ("ids", "<u2", (length,))])


#: A document that begins inside a record; the index is a long per INDEX_STEP records (entries before them) and these.
_BEGIN = np.dtype([("record", "<u4"), ("at", "<u2"), ("doc_id", "<i8")])
#: A document's share of a sequence, on its way to a shard.
_SHARE = np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("start", "<i4"), ("at", "<i4"), ("n", "<i4")])


def _places(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    before = np.cumsum(n) - n
    return np.arange(n.sum()) + np.repeat(first - before, n)


def _steps(slots: int) -> np.ndarray:
    """The records at which the index of a shard can be entered, and its end."""
    return np.append(np.arange(0, slots, INDEX_STEP), slots)


def _documents(source: pa.NativeFile, found: np.ndarray, a: int, b: int, slots: int) -> pa.ListArray:
    """For each of the records a to b of a shard the documents in it: doc_id, start, at and n."""
    base = slots * found.dtype.itemsize
    one, last = a // INDEX_STEP, -(-b // INDEX_STEP)
    low, *_, high = np.frombuffer(source.read_at((last - one + 1) * 8, base + one * 8), dtype="<i8").tolist()
    index = np.frombuffer(source.read_at((high - low) * _BEGIN.itemsize, base + len(_steps(slots)) * 8 + low * _BEGIN.itemsize), dtype=_BEGIN)
    index = index[(index["record"] >= a) & (index["record"] < b)]
    record = np.concatenate([np.arange(b - a), index["record"].astype(np.int64) - a])
    order = np.argsort(record, kind="stable")  # a record's first document comes before those that begin inside
    record = record[order]
    doc = np.concatenate([found["doc_id"], index["doc_id"]])[order]
    start = np.concatenate([found["start"], np.zeros(len(index), "<i4")])[order]
    at = np.concatenate([np.zeros(b - a, "<i4"), index["at"].astype("<i4")])[order]
    ends = np.append(at[1:], 0)
    closing = np.append(np.diff(record) > 0, True)
    ends[closing] = found["n"]
    offsets = np.append(np.searchsorted(record, np.arange(b - a)), len(record)).astype(np.int32)
    fields = [pa.array(doc, mask=doc == _NO_ID), pa.array(start, pa.int32()), pa.array(at, pa.int32()), pa.array(ends - at, pa.int32())]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["doc_id", "start", "at", "n"]))


def _round(half: np.ndarray, key: int) -> np.ndarray:
    x = (half + np.uint64(key & ((1 << 64) - 1))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, size: int, seed: int = SEED, rounds: int = 6) -> np.ndarray:
    """Slots of sequence numbers: a bijection of 0..size-1, the same for the same size and seed."""
    bits = max(1, -(-max(1, (size - 1).bit_length()) // 2))
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    out = np.asarray(index, dtype=np.uint64).copy()
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> shift, out[walking] & mask
        for k in range(rounds):
            left, right = right, left ^ (_round(right, seed * 1_000_003 + k) & mask)
        out[walking] = left << shift | right
        walking = walking[out[walking] >= size]
    return out.astype(np.int64)


def _in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, path, block): the file and the place in it at which a row's split starts; empty and 0 without files."""
    chosen = [F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")]
    try:
        return docs.select(*chosen, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    except AnalysisException:
        return docs.select(*chosen, F.lit("").alias("path"), F.lit(0).cast("long").alias("block"))


def numbered_ids(docs: DataFrame, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """Stored (part, path, block, start, doc_id, ids): ids as 16-bit integers; ``start`` counts the ids before them in their split."""
    vocabulary = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, split, start = worker_encoder(vocabulary), TaskContext.get().partitionId(), None, 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for block in row_blocks(batches, 4 << 20):
            starts, own = [], []
            for text, *own_split in zip(*(block.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if own_split != split:
                    split, start = own_split, 0
                own.append(encoder.encode_bytes(text) + end)
                starts.append(start)
                start += len(own[-1]) // 4
            ids = np.frombuffer(b"".join(own), dtype="<u4")
            if ids.max() > 0xFFFF:
                raise ValueError("the vocabulary has ids of more than 16 bits")
            offsets = np.cumsum([0, *map(len, own)], dtype=np.int64) // 2
            packed = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])
            columns = [pa.array(np.full(len(own), part, np.int32)), block.column(2), block.column(3), pa.array(starts, pa.int64()), block.column(0), packed]
            yield pa.RecordBatch.from_arrays(columns, ["part", "path", "block", "start", "doc_id", "ids"])

    return stored(_in_order(docs).mapInArrow(encode, "part int, path string, block long, start long, doc_id long, ids binary"), "ids")


def write_shards(docs: DataFrame, folder: str, length: int = LENGTH, seed: int = SEED, shard_bytes: int = SHARD_BYTES, vocabulary: str | None = None) -> DataFrame:
    """Write all documents' sequences in training order below ``folder``; returns the stored list of files."""
    spark = docs.sparkSession
    table = numbered_ids(docs, vocabulary=vocabulary)
    # one row per split of the encoding job goes to the driver, and back to the tasks
    counts = table.groupBy("path", "block", "part").agg(F.sum(F.octet_length("ids") / 2).cast("long").alias("n")).collect()
    starts, total = {}, 0
    for path, block, part, n in sorted(map(tuple, counts)):
        starts[path, block, part], total = total, total + n
    size = -(-total // length)
    layout = record_type(length)
    per_shard = max(1, shard_bytes // layout.itemsize)
    base = spark.sparkContext.broadcast(starts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        shares: list[np.ndarray] = []
        tokens: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            share, ids = np.concatenate(shares), np.concatenate(tokens)
            shares.clear(), tokens.clear()
            begins = np.cumsum(share["n"], dtype=np.int64) - share["n"]
            share["slot"] = permuted(share["slot"], size, seed)
            order = np.argsort(share["slot"], kind="stable")
            share, begins = share[order], begins[order]
            shards = share["slot"] // per_shard
            edges = np.append(np.flatnonzero(np.diff(shards, prepend=-1)), len(share))
            parts = [
                (int(shards[a]), packer.compress(share[a:b].tobytes()), packer.compress(ids[_places(begins[a:b], share["n"][a:b])].tobytes()))
                for a, b in zip(edges, edges[1:], strict=False)
            ]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*parts, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "shares", "ids"])

        held = 0
        for block in row_blocks(batches, 4 << 20):
            part, path, place, start = (block.column(k).to_pylist() for k in range(4))
            first = np.array(start, dtype=np.int64) + np.array([base.value[x] for x in zip(path, place, part, strict=True)], dtype=np.int64)
            ids = block.column(5).to_pylist()
            own = np.frombuffer(b"".join(ids), dtype="<u2")
            ends = first + np.array([len(x) // 2 for x in ids], dtype=np.int64)
            # a document's shares: what it has of each sequence from its first id's to its last one's
            many = (ends - 1) // length - first // length + 1
            at = np.repeat(np.arange(len(ids)), many)
            slot = _places(first // length, many)
            begin, end = np.maximum(slot * length, first[at]), np.minimum((slot + 1) * length, ends[at])
            share = np.zeros(len(at), dtype=_SHARE)
            share["slot"], share["doc_id"] = slot, block.column(4).fill_null(_NO_ID).to_numpy()[at]
            share["start"], share["at"], share["n"] = begin - first[at], begin - slot * length, end - begin
            shares.append(share)
            tokens.append(own)
            held += own.nbytes
            if held > FLUSH_BYTES:
                yield flush()
                held = 0
        if shares:
            yield flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition's rows come shard by shard, so what is gathered here is bounded by one shard
        rows = ((shard, shares, ids) for b in batches for shard, shares, ids in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for shard, own in groupby(rows, key=lambda r: r[0]):
            yield write_shard(shard, [r[1:] for r in own])

    def write_shard(shard: int, group: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        first = shard * per_shard
        out = np.zeros(min(per_shard, size - first), dtype=layout)
        placed = np.full(len(out) * length, END_ID, dtype="<u2")
        unpacker = zstandard.ZstdDecompressor()
        inside = [np.zeros(0, dtype=_BEGIN)]
        for shares, ids in group:
            share = np.frombuffer(unpacker.decompress(shares), dtype=_SHARE)
            at = share["slot"] - first
            placed[_places(at * length + share["at"], share["n"])] = np.frombuffer(unpacker.decompress(ids), dtype="<u2")
            np.add.at(out["n"], at, share["n"])
            lead = share["at"] == 0
            out["doc_id"][at[lead]], out["start"][at[lead]] = share["doc_id"][lead], share["start"][lead]
            begin = np.zeros(len(share) - np.count_nonzero(lead), dtype=_BEGIN)
            begin["record"], begin["at"], begin["doc_id"] = at[~lead], share["at"][~lead], share["doc_id"][~lead]
            inside.append(begin)
        out["ids"] = placed.reshape(len(out), length)
        if len(out) and out["n"].min() < 1:
            raise ValueError(f"shard {shard} lacks sequences")
        files, root = opened(folder)
        files.create_dir(root, recursive=True)
        name = f"shard-{shard:08d}-{uuid.uuid4().hex}.bin"
        with files.open_output_stream(f"{root}/{name}", compression=None) as file:
            file.write(out.tobytes())
            index = np.concatenate(inside)
            index = index[np.lexsort((index["at"], index["record"]))]
            file.write(np.searchsorted(index["record"], _steps(len(out))).astype("<i8").tobytes())
            file.write(index.tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array([shard]), pa.array([f"{folder}/{name}"]), pa.array([first]), pa.array([len(out)]), pa.array([length], pa.int32())], ["shard", "path", "first", "slots", "length"]
        )

    dealt = table.mapInArrow(deal, "shard long, shares binary, ids binary")
    shards = max(1, -(-size // per_shard))
    each = -(-shards // MOST_PARTITIONS)  # consecutive shards of a partition
    placed_by_range = dealt.repartitionById(-(-shards // each), (F.col("shard") / each).cast("int"))
    if each > 1:
        placed_by_range = placed_by_range.sortWithinPartitions("shard")
    return stored(placed_by_range.mapInArrow(write, FILES), "shards")


def read_shards(files: DataFrame, first: int = 0, last: int | None = None, ids: bool = True) -> DataFrame:
    """The sequences of slots ``first`` to ``last`` (excluded), read from their places in the shards, in slot order per task."""
    ranges = files.select("shard", "path", "length", F.col("first").alias("begins"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("slots") - 1, F.lit(READ_RECORDS).cast("long"))).alias("slot"), "slots")
    ranges = ranges.select("shard", "path", "length", "begins", "slot", F.least(F.col("slot") + READ_RECORDS, F.col("begins") + F.col("slots")).alias("upto"), "slots").where(F.col("upto") > first)
    if last is not None:
        ranges = ranges.where(F.col("slot") < last)
    tasks = max(1, ranges.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches:
            for shard, path, length, begins, slot, upto, slots in zip(*(c.to_pylist() for c in block.columns), strict=True):
                slot, upto = max(slot, first), upto if last is None else min(upto, last)
                layout = record_type(length)
                store, root = opened(path)
                with store.open_input_file(root) as source:
                    found = np.frombuffer(source.read_at((upto - slot) * layout.itemsize, (slot - begins) * layout.itemsize), dtype=layout)
                    documents = _documents(source, found, slot - begins, upto - begins, slots)
                raw, size, head = memoryview(found).cast("B"), layout.itemsize, layout.fields["ids"][1]
                own = [raw[k * size + head : k * size + head + 2 * n] for k, n in enumerate(found["n"].tolist())]
                doc = pa.array(found["doc_id"], mask=found["doc_id"] == _NO_ID)
                body = pa.array(map(bytes, own), pa.binary()) if ids else pa.array(list(map(zlib.crc32, own)), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(slot, upto)), pa.array(np.full(len(own), shard)), doc, pa.array(found["start"].copy()), pa.array(found["n"].copy()), body, documents],
                    ["slot", "shard", "doc_id", "start", "n_tokens", "ids" if ids else "ids_crc32", "documents"],
                )

    return ranges.repartition(tasks).mapInArrow(read, SEQUENCES if ids else SEQUENCES.replace("ids binary", "ids_crc32 long"))


def materialised(docs: DataFrame) -> DataFrame:
    """Write the documents' shards and read them back: slot, shard, doc_id and start of the first id, n_tokens, ids_crc32, documents."""
    return read_shards(write_shards(docs, shared_path(docs.sparkSession, "tokens")), ids=False)
