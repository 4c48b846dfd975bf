"""Cross-tokenizer alignment: groups of tokens by pointer jumping, links of tokens that end together, their corpus counts.

A text with a space before it is encoded by two tokenizers: A by a byte-level BPE file, B by a sentencepiece model that
adds the space itself. Every token points to the token of the other side that reaches farthest right among those that
overlap it; a token that none outreaches points to itself. Successor doubling (``succ = succ[succ]``, vectorised over all
parts of a block at once) ends at each component's terminal token, which labels its group. The tokens of A and B that end a
group end together: they are linked.

Neither tokenizer has a token that runs from a character that is no white space into a space behind it, so texts are cut
there, each distinct part is encoded and aligned once per worker process, and a text's alignment is that of its parts, one
after the other. Parts are kept in a table of bounded size that is emptied between blocks; the texts are not bounded.

Two linked tokens end at the same byte, so the shorter one's bytes are a suffix of the longer one's. The number of
different pairs is therefore bounded by the two vocabularies (``possible_pairs``), whatever the corpus is: the table of
pair counts goes to every task as two arrays of that size at most. It is summed up per task before it is shuffled.

Nulls and empty texts have no tokens, nor have texts whose tokens do not spell them in either tokenizer (a character that
stands for the space in B's vocabulary): all figures are zero and the groups empty. A null ``doc_id`` is passed through.
Repeated rows are aligned and counted as often as they occur. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import row_blocks, stored, text_or_empty
from claimscope.llm.tokens import _byte_of_letter, default_vocabulary, worker_encoder

#: Cut before a space behind a character that is no white space, unless the text ends there.
_CUT = re.compile(r"(?<=\S)(?= .)", re.S)
_IRREGULAR = re.compile(r"\s | \Z")
_SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups string, links binary"


def default_model() -> str:
    """Place of the 32,000-piece sentencepiece model of the installed ``public_tokenizers``."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def bytes_of_a(vocabulary: str) -> list[bytes]:
    """Each id's bytes in a byte-level BPE file."""
    with open(vocabulary, encoding="utf-8") as file:
        spec = json.load(file)
    letters = _byte_of_letter()
    special = {x["id"]: x["content"].encode() for x in spec.get("added_tokens", [])}
    found = {i: special.get(i) or bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items()} | special
    return [found.get(i, b"") for i in range(max(found) + 1)]


def bytes_of_b(model) -> list[bytes]:
    """Each id's bytes in a sentencepiece model: pieces in UTF-8 with their spaces, byte pieces as their byte."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        byte = _BYTE.match(piece) if model.is_byte(i) else None
        out.append(bytes([int(byte[1], 16)]) if byte else piece.replace(_SPACE, " ").encode())
    return out


def possible_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of ids can be linked at all: pairs of which one's bytes are a suffix of the other's."""

    def times(tokens: list[bytes]) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        for t in filter(None, tokens):
            out[t] = out.get(t, 0) + 1
        return out

    of_a, of_b = times(a), times(b)
    inside = lambda longer, other, least: sum(n * other.get(t[k:], 0) for t, n in longer.items() for k in range(least, len(t)))
    return inside(of_a, of_b, 0) + inside(of_b, of_a, 1)


def pair_type(a: int, b: int) -> tuple[np.dtype, int]:
    """How a pair of ids below ``a`` and ``b`` is packed: the type, and the bits of the id of B."""
    return (np.dtype("<u4"), 16) if max(a, b) <= 1 << 16 else (np.dtype("<u8"), 32)


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """The terminal token of every token, tokens of A first; ``end_*``: where tokens end, ascending, both up to the same byte.

    A token of A that no token of B outreaches is its own terminal, so every terminal is one of A.
    """
    n = len(end_a)
    over = np.searchsorted(end_b, end_a)  # the token of B that holds the last byte
    to_b = np.where(end_b[over] > end_a, n + over, np.arange(n)) if n else np.empty(0, np.int64)
    succ = np.concatenate([to_b, np.searchsorted(end_a, end_b)])
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            return succ
        succ = further


class Aligner:
    """Alignments of parts of texts, kept by part."""

    #: What a kept part takes besides its characters: table entries and objects.
    ENTRY_BYTES = 400
    #: Bytes of new parts that are encoded at once.
    AT_ONCE = 1 << 20

    def __init__(self, vocabulary: str, model: str, most_bytes: int = 112 << 20):
        import sentencepiece

        self.encode_a = worker_encoder(vocabulary).encoding.encode_ordinary  # strings of special tokens are plain text
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes_b = bytes_of_b(self.model)
        bytes_a = bytes_of_a(vocabulary)
        self.length_a, self.length_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (bytes_a, self.bytes_b))
        self.kind, self.shift = pair_type(len(bytes_a), len(self.bytes_b))
        self.most_bytes = most_bytes
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.groups: list[str] = []
        self.links: list[bytes] = []
        self.sizes = np.zeros((1 << 12, 3), dtype=np.int64)  # tokens of A, of B, groups; -1: the part is not spelt
        self.held = 0

    @staticmethod
    def parts(text: str) -> list[str]:
        """The parts of a text, each without the space that leads it."""
        if text[:1].isspace() or _IRREGULAR.search(text):
            return [p[1:] for p in _CUT.split(" " + text)]
        return text.split(" ")

    def _keep(self, part: str, sizes: tuple[int, int, int], groups: str, links: bytes) -> None:
        at = len(self.groups)
        if at == len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.slots[part], self.sizes[at] = at, sizes
        self.groups.append(groups)
        self.links.append(links)
        self.held += self.ENTRY_BYTES + 4 * len(part) + len(groups) + len(links)

    def _learn(self, parts: list[str]) -> None:
        """Encode and align parts that were not met before."""
        ids_a, ids_b, good = [], [], []
        for part, b in zip(parts, self.model.encode(parts, num_threads=1), strict=True):
            if b"".join(map(self.bytes_b.__getitem__, b)) == (" " + part).encode("utf-8", "replace"):
                ids_a.append(self.encode_a(" " + part))
                ids_b.append(b)
                good.append(part)
            else:
                self._keep(part, (-1, -1, -1), "", b"")
        if not good:
            return
        own_a, own_b = (np.array([len(x) for x in y]) for y in (ids_a, ids_b))
        all_a, all_b = (np.fromiter((i for x in y for i in x), np.int64, int(n.sum())) for y, n in ((ids_a, own_a), (ids_b, own_b)))
        end_a, end_b = np.cumsum(self.length_a[all_a]), np.cumsum(self.length_b[all_b])
        label = terminals(end_a, end_b)
        # both sides' labels ascend; a group ends with its terminal token of A and the token of B that ends there
        last_a, upto_b = np.unique(label[: len(all_a)]), np.searchsorted(label[len(all_a) :], np.unique(label[: len(all_a)]), side="right")
        keys = (all_a[last_a].astype(np.uint64) << np.uint64(self.shift) | all_b[upto_b - 1].astype(np.uint64)).astype(self.kind).tobytes()
        step, names_a, names_b = self.kind.itemsize, list(map(str, all_a.tolist())), list(map(str, all_b.tolist()))
        stop_a, stop_b = (last_a + 1).tolist(), upto_b.tolist()
        text, at_a, at_b = [], 0, 0
        for a, b in zip(stop_a, stop_b, strict=True):
            text.append(",".join(names_a[at_a:a]) + "|" + ",".join(names_b[at_b:b]))
            at_a, at_b = a, b
        ends = np.searchsorted(last_a, np.cumsum(own_a)).tolist()  # groups before a part's end
        first = 0
        for part, a, b, end in zip(good, own_a.tolist(), own_b.tolist(), ends, strict=True):
            self._keep(part, (a, b, end - first), ";".join(text[first:end]), keys[first * step : end * step])
            first = end

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, bytes]]:
        """Per text: tokens of A and B, groups, the groups' ids as text, and the packed links in ascending order."""
        if self.held > self.most_bytes:
            self._clear()
        cut = [self.parts(t) if t else [] for t in texts]
        new: dict[str, None] = {}
        for parts in cut:
            new.update(dict.fromkeys(p for p in parts if p not in self.slots))
        batch, size = [], 0
        for part in new:
            batch.append(part)
            size += len(part)
            if size >= self.AT_ONCE:
                self._learn(batch)
                batch, size = [], 0
        if batch:
            self._learn(batch)
        for parts in cut:
            at = list(map(self.slots.__getitem__, parts))
            a, b, n = self.sizes[at].sum(axis=0).tolist() if at else (0, 0, 0)
            if not at or self.sizes[at, 0].min() < 0:
                yield 0, 0, 0, "", b""
                continue
            links = np.sort(np.frombuffer(b"".join(map(self.links.__getitem__, at)), self.kind))
            yield a, b, n, ";".join(map(self.groups.__getitem__, at)), links.tobytes()


@lru_cache(maxsize=1)
def worker_aligner(vocabulary: str, model: str) -> Aligner:
    return Aligner(vocabulary, model)


def aligned(docs: DataFrame, vocabulary: str | None = None, model: str | None = None, *, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups, links of every document; one pass, no shuffle.

    ``groups``: ids in order, ``a1,a2|b1;a3|b2,b3``; ``links``: packed pairs (``pair_type``), ascending. ``digest=True``
    has the lower-case hex SHA-256 of the groups in their place (empty without tokens).
    """
    vocabulary, model = vocabulary or default_vocabulary(), model or default_model()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_aligner(vocabulary, model)
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        for block in row_blocks(batches, 4 << 20):
            rows = aligner.align(block.column(1).to_pylist())
            if digest:
                rows = ((a, b, n, hashlib.sha256(g.encode()).hexdigest() if n else "", x) for a, b, n, g, x in rows)
            found = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(scan, ALIGNED)


def pair_counts(links: DataFrame, kind: np.dtype) -> DataFrame:
    """(pair, n): how many links hold each packed pair, summed up in every task before the shuffle. ``links``: links."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for block in row_blocks(batches):
            own, n = np.unique(np.frombuffer(b"".join(block.column(0).to_pylist()), kind).astype(np.int64), return_counts=True)
            merged, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
            total = np.zeros(len(merged), np.int64)
            np.add.at(total, at, np.concatenate([counts, n]))
            keys, counts = merged, total
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(counts[at : at + (1 << 16)])], ["pair", "n"])

    return links.select("links").mapInArrow(scan, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def alignment_digest(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    vocabulary, model = vocabulary or default_vocabulary(), model or default_model()
    a, b = bytes_of_a(vocabulary), bytes_of_b(sentencepiece.SentencePieceProcessor(model_file=model))
    kind, shift = pair_type(len(a), len(b))
    rows = stored(aligned(docs, vocabulary, model, digest=True), "aligned")
    most = possible_pairs(a, b)
    counted = pair_counts(rows, kind).limit(most + 1).toPandas().sort_values("pair")  # bounded by the vocabularies, see above
    if len(counted) > most:
        raise AssertionError("more pairs than the vocabularies allow")
    pairs, counts = counted["pair"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)
    highest = np.zeros(len(b), np.int64)
    np.maximum.at(highest, pairs & ((1 << shift) - 1), counts)
    best = (counts == highest[pairs & ((1 << shift) - 1)]).astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((pairs, counts, best))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = shared.value
        for block in row_blocks(batches):
            links = block.column(5).to_pylist()
            sizes = np.array([len(x) for x in links]) // kind.itemsize
            at = np.searchsorted(pairs, np.frombuffer(b"".join(links), kind).astype(np.int64))
            upto = np.cumsum(sizes)
            within = lambda x: (total := np.concatenate([[0], np.cumsum(x[at])]))[upto] - total[upto - sizes]  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*(block.column(k) for k in range(4)), pa.array(sizes), pa.array(within(best)), pa.array(within(counts)), block.column(4)], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(scan, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
