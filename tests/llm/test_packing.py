import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from claimscope.llm import packing, tokens

DOCS = "doc_id long, text string, piece string, length int"


def test_encoder_equals_the_tokenizers_library():
    library = Tokenizer.from_file(tokens.default_vocabulary())
    encoder, draw = tokens.TextEncoder(tokens.default_vocabulary(), most_bytes=20_000), random.Random(1)
    texts = ["", " ", "a  b", "a   b \n c\n\n  d", " \n \nx  ", "<|endoftext|> a", "it's  'll", " é  x ", "The quick, brown fox."]
    texts += ["<|endoftext|>", "a <|endoftext|>", "a  <|endoftext|><|endoftext|>  b\n", "x<|endoftext|", "it <|endoftext|>'s <|ENDOFTEXT|>"]
    texts += ["".join(draw.choice(["a ", " b", "<|endoftext|>", " ", "\n"]) for _ in range(draw.randint(0, 9))) for _ in range(500)]
    texts += ["".join(draw.choice(" \n\t ab1.'é\r sß%") for _ in range(draw.randint(0, 14))) for _ in range(3000)]
    for text in texts:
        assert library.encode(text, add_special_tokens=False).ids == encoder.encode(text).tolist(), repr(text)


def test_only_long_documents_are_cut_and_the_first_piece_is_short():
    assert [packing.cut_lengths(n, 4) for n in (1, 4, 5, 8, 11)] == [[1], [4], [1, 4], [4, 4], [3, 4, 4]]


def _one_by_one(lengths: list[int], capacity: int) -> int:
    """Best-fit decreasing, document by document."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_planning_on_counts_equals_best_fit_decreasing(seed):
    draw, capacity = random.Random(seed), random.Random(seed).choice([7, 16, 64, 1024])
    lengths = [draw.randint(1, capacity) for _ in range(draw.randint(0, 300))]
    lengths += [draw.randint(1, capacity)] * draw.choice([0, 50])
    counts = {n: lengths.count(n) for n in set(lengths)}
    slots, used = packing.best_fit(counts, capacity)
    assert used == _one_by_one(lengths, capacity)
    filled: dict[int, list[tuple[int, int]]] = {}
    taken: dict[int, list[int]] = {}
    for s in slots:
        taken.setdefault(s.length, []).extend(range(s.first, s.first + s.count))
        for k in range(s.count):
            filled.setdefault(s.sequence + k, []).append((s.offset, s.length))
    assert {n: sorted(r) for n, r in taken.items()} == {n: list(range(c)) for n, c in counts.items()}
    for pieces in filled.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= capacity


def test_documents_of_all_kinds_are_packed_whole(spark):
    rows = [(1, None, "x", 9), (None, "no id", "x", 9), (2, "", "x", 9), (3, "word " * 3000, "x", 9), (4, "same", "x", 9), (4, "same", "x", 9)]
    rows += [(10 + k, "copy of a text", "x", 9) for k in range(1200)] + [(None, "no id", "x", 9)] * 1300
    got = packing.packed_documents(spark.createDataFrame(rows, DOCS)).toPandas()
    assert len(got) == len(rows) - 1 + len(got[got.doc_id == 3]) and sorted(got[got.doc_id.isin([1, 2])].length) == [1, 1] and len(got[got.doc_id == 4]) == 2
    long = got[got.doc_id == 3].sort_values("piece")
    assert long.length.tolist()[1:] == [1024] * (len(long) - 1) and long.start.tolist() == [0, *np.cumsum(long.length)[:-1]]
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 1024
    assert packing.packed_documents(spark.createDataFrame([], DOCS)).count() == 0
