"""Token ids of whole texts by a public byte-level BPE file, inside Spark tasks."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np

#: A space before a non-space character always starts a new pre-token of the byte-level pattern, so a text may be
#: cut before each such space and the parts encoded apart without changing an id. So may a part at a line end between
#: non-space characters, and between letters and the marks that follow them.
_CUT = re.compile(r" (?=\S)")
_IRREGULAR = re.compile(r" \s| $")
_MARKED = re.compile(r"([^\W\d_]+)([^\w\s]+)\Z")
_LINES = re.compile(r"\S+(?:\n\S+)+\Z")
#: Fixed value: the published split pattern of byte-level BPE.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    """Place of the 50,257-entry byte-level BPE file of the installed ``public_tokenizers``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_letter() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable bytes stand for themselves, others follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(other)}


class TextEncoder:
    """Ids by a ``tokenizers`` byte-level BPE file, as ``encode(text, add_special_tokens=False)`` gives them.

    Strings of the file's special tokens inside a text become those tokens' ids, as in the library. The file's
    vocabulary is loaded as merge ranks, which encode a new part several times faster; ids of parts met before are kept,
    in two generations of at most ``most_bytes`` each. Only that memory is bounded, never the text.
    """

    #: What an entry takes besides its part and ids: two objects and a place in the table.
    ENTRY_BYTES = 200

    def __init__(self, vocabulary: str, most_bytes: int = 96 << 20, longest_kept: int = 48):
        import tiktoken

        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        letters, added = _byte_of_letter(), spec.get("added_tokens", [])
        if any(x[flag] for x in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.special = {x["content"]: array("I", [x["id"]]).tobytes() for x in added}
        self.parting = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        ranks = {bytes(letters[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in self.special}
        self.encoding = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.single = self.encoding._core_bpe.encode_single_piece
        self.most_bytes, self.longest_kept = most_bytes, longest_kept
        # by part, apart for parts with and without a leading space (which is not part of the key)
        self.kept: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.held = 0

    def _part(self, word: str, spaced: bool) -> bytes:
        """Ids of a part: what a text holds from one cut to the next, behind the space that leads it, if any."""
        ids = self.kept[spaced].get(word)
        return self._new(word, spaced) if ids is None else ids

    def _new(self, word: str, spaced: bool) -> bytes:
        ids = self.older[spaced].get(word)
        if ids is None:
            if word.isalpha():  # a run of letters is one pre-token: no pattern needed
                ids = array("I", self.single((" " + word if spaced else word).encode())).tobytes()
            elif marked := _MARKED.match(word):
                ids = self._part(marked[1], spaced) + self._part(marked[2], False)
            elif _LINES.match(word):
                first, *lines = word.split("\n")
                return self._part("\n", False).join([self._part(first, spaced), *[self._part(x, False) for x in lines]])
            else:
                ids = array("I", self.encoding.encode_ordinary(" " + word if spaced else word)).tobytes()
        if len(word) <= self.longest_kept:
            self.held += self.ENTRY_BYTES + len(word) + len(ids)
            if self.held >= self.most_bytes:
                self.older, self.kept, self.held = self.kept, ({}, {}), 0
            self.kept[spaced][word] = ids
        return ids

    def _ordinary(self, text: str) -> bytes:
        first, *parts = _CUT.split(text) if _IRREGULAR.search(text) else text.split(" ")
        ids = list(map(self.kept[True].get, parts))
        if None in ids:
            new = self._new
            ids = [new(p, True) if x is None else x for p, x in zip(parts, ids)]  # noqa: B905  same length
        return self._part(first, False) + b"".join(ids)

    def encode_bytes(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if self.parting is None or not any(x in text for x in self.special):
            return self._ordinary(text)
        return b"".join(self.special[x] if k % 2 else self._ordinary(x) for k, x in enumerate(self.parting.split(text)))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")


@lru_cache(maxsize=1)
def worker_encoder(vocabulary: str) -> TextEncoder:
    """The encoder of this worker process: read once, whatever the number of tasks that it runs."""
    return TextEncoder(vocabulary)
