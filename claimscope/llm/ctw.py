"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

Training texts become streams of lower-cased words, each followed by a space, the last by a newline. Counts of all
(context of five bytes, next byte) grams are summed by Spark. A byte is eight binary decisions; each decision has a
node in every context of its path, from no byte to five, with a Krichevsky-Trofimov estimate from the node's counts.
A node's weight against the deeper ones is the posterior of context-tree weighting, computed bottom-up from the block
probabilities. A text's score is the sum of log10 of the mixed probabilities of its bytes, with frozen counts.

Subtrees below a context of two bytes are independent: they are built in buckets of such contexts, and the model is
stored in shards of bounded size in the shared folder. A task holds so many blocks of texts, reads one shard at a time
and adds up, for each block, the bytes and words that belong to it: memory is bounded by a shard and the texts held,
whatever the vocabulary is, and the model is read once for all of these texts.
Only the at most 65,536 nodes of contexts of one byte pass the driver.

Nulls: a null text is empty (one end token); a null ``doc_id`` is never held out. Repeated rows count as often as they
occur. An empty table, or one without training texts, gives rows scored by the uniform model. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import row_blocks, stored, text_or_empty
from claimscope.llm.files import opened
from claimscope.session import shared_path

DEPTH = 5
FOLDS, HELD_OUT = 7, 2
#: Most grams, and most words, of a model shard.
SHARD_GRAMS, SHARD_WORDS = 750_000, 2_000_000
#: Text scored at once, and text that a task holds while it goes through the shards.
BLOCK_BYTES, HELD_BYTES = 1 << 20, 32 << 20
#: Stands for the end token among the words' hashes.
_END = -1
_BITS = range(8)

MODEL = "shard int, depth int, key long, a float, b float"


_BLANKS = bytes(32 if 9 <= b <= 13 else b for b in range(256))

Piece = tuple[int, bytes, bytes]


def pieces(texts: list[str], most: int = BLOCK_BYTES) -> Iterator[list[Piece]]:
    """Groups of pieces (text's index, up to DEPTH bytes of its stream before the piece, piece) of about ``most`` bytes.

    A text's stream is its lower-cased words with a space between and a newline behind; long ones are cut behind a space.
    """
    group, size = [], 0
    for k, text in enumerate(texts):
        data = text.encode("utf-8", "replace").lower().translate(_BLANKS).rstrip(b" ")
        at, before, done = 0, b"", False
        while not done:
            done = len(data) - at <= most
            end = len(data) if done else data.rfind(b" ", at, at + most) + 1 or data.find(b" ", at + most) + 1 or len(data)
            done = end == len(data)
            words = data[at:end].split()
            if words or done:
                body = b" ".join(words) + (b"\n" if done else b" ")
                group.append((k, before, body))
                size, before = size + len(body), (before + body)[-DEPTH:]
            at = end
            if size >= most:
                yield group
                group, size = [], 0
    if group:
        yield group


class Stream:
    """A group of pieces as one array. ``text``: each byte's text; ``words``, ``word_text``: the words' 64-bit hashes and
    their texts; ``ends``: the texts that end here."""

    def __init__(self, group: list[Piece]):
        x = np.frombuffer(b"".join(part for _, before, body in group for part in (before, body)), dtype=np.uint8)
        lead, length = (np.array([len(p[k]) for p in group], dtype=np.int64) for k in (1, 2))
        starts, whole = np.cumsum(lead + length) - lead - length, lead + length
        text = np.repeat(np.array([k for k, _, _ in group], dtype=np.int64), whole)
        self.place = np.arange(len(x)) - np.repeat(starts, whole)
        self.own = self.place >= np.repeat(lead, whole)
        self.all, self.bytes, self.text = x, x[self.own], text[self.own]
        self.ends = np.array([k for k, _, body in group if body.endswith(b"\n")], dtype=np.int64)
        parting = (x == 32) | (x == 10) | ~self.own
        first = np.flatnonzero(~parting & np.concatenate([[True], parting[:-1]])) if len(x) else np.empty(0, np.int64)
        self.word_text = text[first]
        if len(first):
            run = np.arange(len(x))
            run[first[0] :] -= np.repeat(first, np.diff(np.append(first, len(x))))
            mixed = np.where(parting, np.uint64(0), (x.astype(np.uint64) + np.uint64(1)) * _weights(int(run.max()) + 1)[run])
            self.words = np.add.reduceat(mixed, first).view(np.int64)
        else:
            self.words = np.empty(0, np.int64)

    def grams(self) -> np.ndarray:
        """For each byte: the bytes before it in its text (newlines before its start), nearest first in the highest place, then the byte."""
        x = self.all.astype(np.int64)
        out = x.copy()
        for back in range(1, DEPTH + 1):
            before = np.concatenate([np.full(min(back, len(x)), 10), x[: max(0, len(x) - back)]])
            out |= np.where(self.place < back, 10, before) << (8 * (DEPTH + 1 - back))
        return out[self.own]


@lru_cache(maxsize=4)
def _odd_numbers(n: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def _weights(n: int) -> np.ndarray:
    """Odd 64-bit factors by place in a word; the multilinear hash of words is the sum of (byte + 1) times its factor."""
    return _odd_numbers(1 << max(8, (n - 1).bit_length()))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x > 0, by Stirling's series above 8."""
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = y < 8
        if not low.any():
            break
        shift[low] += np.log(y[low])
        y[low] += 1
    inv = 1 / y
    sq = inv * inv
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + inv * (1 / 12 - sq * (1 / 360 - sq * (1 / 1260 - sq / 1680))) - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov block probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - 2 * math.lgamma(0.5) - _log_gamma(zeros + ones + 1.0)


def _nodes(gram: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, zeros, ones) of a depth: key = context of ``depth`` bytes, then the decision's place in the byte."""
    context, byte = gram >> (8 * (DEPTH + 1 - depth)), gram & 255
    keys = np.concatenate([context << 8 | (1 << j) | (byte >> (8 - j)) for j in _BITS])
    bits = np.concatenate([(byte >> (7 - j)) & 1 for j in _BITS])
    weight = np.tile(n.astype(float), 8)
    own, at = np.unique(keys, return_inverse=True)
    ones = np.bincount(at, weight * bits, len(own))
    return own, np.bincount(at, weight, len(own)) - ones, ones


def _weighted(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """(log weighted probability, weight of the own estimate) of nodes; ``below``: keys and values of the children."""
    own = _log_kt(zeros, ones)
    if below is None:
        return own, np.ones_like(own)
    parents = (below[0] >> 16 << 8) | (below[0] & 255)
    children = np.bincount(np.searchsorted(keys, parents), below[1], len(keys))
    both = np.logaddexp(own, children) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


def _log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Of the Krichevsky-Trofimov estimate; keeps estimates near 0 and 1 apart from them in few bits."""
    return np.log((ones + 0.5) / (zeros + 0.5))


def subtree(gram: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per depth from ``DEPTH`` down to 2: keys, log odds of a one, weight, log weighted probability."""
    out, below = [], None
    for depth in range(DEPTH, 1, -1):
        keys, zeros, ones = _nodes(gram, n, depth)
        value, weight = _weighted(keys, zeros, ones, below)
        out.append((keys, _log_odds(zeros, ones), weight, value))
        below = keys, value
    return out


class Upper:
    """The nodes of contexts of one byte and of none, as dense tables of (log odds of a one, weight)."""

    def __init__(self, rows: list[tuple[int, float, float, float]]):
        """rows: key, zeros, ones, sum of the children's values, of contexts of one byte."""
        self.tables = [np.full((256 ** (d + 1), 2), np.nan) for d in (0, 1)]
        if not rows:
            return
        keys, zeros, ones, children = (np.array(x) for x in zip(*sorted(rows), strict=True))
        own = _log_kt(zeros, ones)
        value = np.logaddexp(own, children) - math.log(2)
        self.tables[1][keys] = np.stack([_log_odds(zeros, ones), np.exp(own - math.log(2) - value)], 1)
        top, at = np.unique(keys & 255, return_inverse=True)
        zeros, ones = np.bincount(at, zeros), np.bincount(at, ones)
        own, children = _log_kt(zeros, ones), np.bincount(at, value)
        both = np.logaddexp(own, children) - math.log(2)
        self.tables[0][top] = np.stack([_log_odds(zeros, ones), np.exp(own - math.log(2) - both)], 1)


def byte_log10(gram: np.ndarray, levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], upper: Upper) -> np.ndarray:
    """log10 probability of each gram's byte: per decision, estimates mixed along its path's nodes that were trained."""
    byte, total = gram & 255, np.zeros(len(gram))
    for j in _BITS:
        place = (1 << j) | (byte >> (8 - j))
        q = np.full(len(gram), np.nan)  # of the byte's own decision
        sign = 1 - 2.0 * ((byte >> (7 - j)) & 1)
        for depth in range(DEPTH, -1, -1):
            key = (gram >> (8 * (DEPTH + 1 - depth))) << 8 | place
            if depth < 2:
                p, w = upper.tables[depth][key].T
            else:
                keys, ps, ws = levels[depth]
                if not len(keys):
                    continue
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                there = keys[at] == key
                p, w = np.where(there, ps[at], np.nan).astype(float), ws[at].astype(float)
            p = 1 / (1 + np.exp(sign * p))
            q = np.where(np.isnan(p), q, np.where(np.isnan(q), p, w * p + (1 - w) * q))
        total += np.log10(np.where(np.isnan(q), 0.5, q))
    return total


class Table:
    """Values by 64-bit keys, looked up in ascending order."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], [v[order] for v in values]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The first values of ascending keys; NaN where a key is absent."""
        if not len(self.keys):
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[0][at], np.nan)


def _read(folder: str, columns: dict[str, type]) -> Table:
    """A stored table below ``folder`` by its key column; empty if no task had rows for it."""
    files, path = opened(folder)
    if files.get_file_info(path).type.name == "NotFound":
        return Table(*(np.empty(0, kind) for kind in columns.values()))
    found = ds.dataset(path, filesystem=files, format="parquet", partitioning=None).to_table(columns=list(columns))
    out = Table(*(found.column(c).to_numpy().astype(kind) for c, kind in columns.items()))
    del found
    pa.default_memory_pool().release_unused()
    return out


def _gram_shard(folder: str, shard: int) -> tuple[Table, dict]:
    """The bytes' log10 probabilities by gram, and per depth the nodes (key, log odds of a one, weight)."""
    node = {"key": np.int64, "a": np.float16, "b": np.float16}
    levels = {d: _read(f"{folder}/shard={shard}/depth={d}", node) for d in range(2, DEPTH + 1)}
    return _read(f"{folder}/shard={shard}/depth={DEPTH + 1}", {"key": np.int64, "a": np.float32}), {d: (t.keys, *t.values) for d, t in levels.items()}


def _word_shard(folder: str, shard: int) -> Table:
    return _read(f"{folder}/shard={shard}", {"word": np.int64, "n": np.float64})


#: The shard that this worker process read last.
_SHARD: dict[tuple[str, str, int], tuple] = {}


def _shard(words: str, grams: str, k: int) -> tuple[Table, tuple[Table, dict]]:
    """Shard k of the model; the one read before is let go first, so that a worker never holds two."""
    if (words, grams, k) not in _SHARD:
        _SHARD.clear()
        _SHARD[words, grams, k] = _word_shard(words, k), _gram_shard(grams, k)
    return _SHARD[words, grams, k]


def _held(blocks: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[pa.Array, pa.Array, list[list[Piece]]]]]:
    """Successive blocks together as (doc_id, held_out, groups of pieces), at most ``HELD_BYTES`` unless one alone is larger.

    Of their texts only the pieces stay in memory.
    """
    held, size = [], 0
    for block in blocks:
        if held and size + block.nbytes > HELD_BYTES:
            yield held
            held, size = [], 0
        ids, out = (pa.array(block.column(k).to_pylist(), block.column(k).type) for k in (0, 1))  # a slice would keep the batch's texts
        held.append((ids, out, list(pieces(block.column(2).to_pylist()))))
        size += block.nbytes
    if held:
        yield held


def _texts(docs: DataFrame) -> DataFrame:
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("held_out"), text_or_empty().alias("text"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def gathered(training: DataFrame) -> DataFrame:
    """(kind, key, n) of all training texts, summed per task: grams of the streams (0), words by hash, ends among them (1)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: tuple[list, list] = ([], [])
        for block in row_blocks(batches, BLOCK_BYTES):
            for group in pieces(block.column(0).to_pylist()):
                read = Stream(group)
                for own, keys in zip(parts, (read.grams(), np.concatenate([read.words, np.full(len(read.ends), _END)])), strict=True):
                    own.append(np.unique(keys, return_counts=True))
                    if sum(len(k) for k, _ in own[1:]) > max(1 << 20, 2 * len(own[0][0])):
                        own[:] = [_merged(own)]
        for kind, own in enumerate(parts):
            keys, n = _merged(own) if own else (np.empty(0, np.int64),) * 2
            for at in range(0, len(keys), 1 << 17):
                k = keys[at : at + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[at : at + (1 << 17)])], ["kind", "key", "n"])

    return training.select("text").mapInArrow(scan, "kind int, key long, n long")


class Trained:
    """Places of the stored model: word shards, gram shards, and the figures of the base."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        counts = stored(gathered(_texts(docs).where("not held_out")).groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
        sizes = {r["kind"]: (r["rows"], r["n"]) for r in counts.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()}
        self.distinct, self.total = sizes.get(1, (0, 0))
        self.shards = max(1, -(-sizes.get(0, (0, 0))[0] // SHARD_GRAMS), -(-self.distinct // SHARD_WORDS))
        self.words, self.grams = shared_path(spark, "words"), shared_path(spark, "grams")
        # dealt by shard: a shard of bounded size is one file, so files grow with the shards, not with their square
        counts.where("kind = 1").select(F.pmod("key", F.lit(self.shards)).cast("int").alias("shard"), F.col("key").alias("word"), "n").repartition(
            self.shards, "shard"
        ).write.partitionBy("shard").parquet(self.words)
        shards, buckets = self.shards, 32 * self.shards
        found = counts.where("kind = 0").select(
            F.col("key").alias("gram"), "n", F.pmod(F.xxhash64(F.shiftright("key", 8 * (DEPTH - 1))), F.lit(buckets)).cast("int").alias("bucket")
        )

        def lowest(pdf: pd.DataFrame) -> pd.DataFrame:
            gram, n = pdf["gram"].to_numpy(), pdf["n"].to_numpy()
            keys, _, _, value = subtree(gram, n)[-1]
            own, zeros, ones = _nodes(gram, n, 1)
            children = np.bincount(np.searchsorted(own, (keys >> 16 << 8) | (keys & 255)), value, len(own))
            return pd.DataFrame({"key": own, "zeros": zeros, "ones": ones, "children": children})

        sums = found.groupBy("bucket").applyInPandas(lowest, "key long, zeros double, ones double, children double")
        rows = sums.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "children"))).collect()
        self.upper = upper = Upper([(r["key"], r["zeros"], r["ones"], r["children"]) for r in rows])

        def finished(pdf: pd.DataFrame) -> pd.DataFrame:
            gram, n = pdf["gram"].to_numpy(), pdf["n"].to_numpy()
            tree = {DEPTH - k: x for k, x in enumerate(subtree(gram, n))}
            value = byte_log10(gram, {d: x[:3] for d, x in tree.items()}, upper)
            parts = [(DEPTH + 1, gram, value, value), *((d, x[0], x[1], x[2]) for d, x in tree.items())]
            shard = int(pdf["bucket"].iloc[0]) % shards
            return pd.concat([pd.DataFrame({"shard": np.int32(shard), "depth": np.int32(d), "key": k, "a": a.astype(np.float32), "b": b.astype(np.float32)}) for d, k, a, b in parts])

        found.groupBy("bucket").applyInPandas(finished, MODEL).write.partitionBy("shard", "depth").parquet(self.grams)
        self.buckets = buckets

    def pairs(self, spark) -> np.ndarray:
        """The shard of each context of two bytes, by the hash that dealt the buckets."""
        both = spark.range(1 << 16).select("id", (F.pmod(F.xxhash64("id"), F.lit(self.buckets)) % self.shards).cast("int").alias("shard"))
        out = np.zeros(1 << 16, dtype=np.int32)
        for r in both.collect() if self.shards > 1 else ():
            out[r["id"]] = r["shard"]
        return out


def score(docs: DataFrame) -> DataFrame:
    """Base and model scores of every document: see the columns at the end."""
    spark, model = docs.sparkSession, Trained(docs)
    shards, words_at, grams_at, upper, pairs = model.shards, model.words, model.grams, model.upper, model.pairs(spark)
    floor = math.log10(model.total + model.distinct + 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _held(row_blocks(batches, BLOCK_BYTES)):
            sums = [np.zeros((5, len(ids))) for ids, _, _ in blocks]  # tokens, known, base, score, bytes
            for k in range(shards):
                counted = table = levels = None  # else they would outlive the shard while the next one is read
                counted, (table, levels) = _shard(words_at, grams_at, k)
                for group, total in ((g, total) for (_, _, groups), total in zip(blocks, sums, strict=True) for g in groups):
                    texts, read = total.shape[1], Stream(group)
                    words, owner = np.concatenate([read.words, np.full(len(read.ends), _END)]), np.concatenate([read.word_text, read.ends])
                    if not k:
                        total[0] += np.bincount(owner, minlength=texts)
                        total[4] += np.bincount(read.text, minlength=texts)
                    order = np.argsort(words) if shards == 1 else (own := np.flatnonzero(words % shards == k))[np.argsort(words[own])]
                    found, owner = np.nan_to_num(counted.get(words[order])), owner[order]
                    total[1] += np.bincount(owner, found > 0, texts)
                    total[2] += np.bincount(owner, np.log10(found + 1), texts)
                    gram, owner = read.grams(), read.text
                    if shards > 1:
                        own = pairs[gram >> (8 * (DEPTH - 1))] == k
                        gram, owner = gram[own], owner[own]
                    # sorted by gram, then text: each distinct gram is looked up once, in the order of the table
                    both = np.sort(gram.view(np.uint64) << np.uint64(16) | owner.astype(np.uint64))
                    gram, owner = (both >> np.uint64(16)).view(np.int64), (both & np.uint64(0xFFFF)).astype(np.int64)
                    fresh = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.empty(0, np.int64)
                    distinct = gram[fresh]
                    value = table.get(distinct)
                    lost = np.flatnonzero(np.isnan(value))
                    for low in range(0, len(lost), 1 << 16):
                        part = lost[low : low + (1 << 16)]
                        value[part] = byte_log10(distinct[part], levels, upper)
                    total[3] += np.bincount(owner, np.repeat(value, np.diff(np.append(fresh, len(gram)))), texts)
            for (ids, out, _), (tokens, known, base, scores, n_bytes) in zip(blocks, sums, strict=True):
                counts = [pa.array(x.astype(np.int64)) for x in (tokens, known, n_bytes)]
                yield pa.RecordBatch.from_arrays(
                    [ids, out, counts[0], counts[1], pa.array(base - tokens * floor), pa.array(scores), counts[2]],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"],
                )

    out = _texts(docs).mapInArrow(scan, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model.total)).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
