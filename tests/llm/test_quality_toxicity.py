import base64
import math
import random
import re
import zlib

import zstandard

from claimscope.llm import quality, toxicity

DOCS = "doc_id long, text string, score double, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plain(text: str) -> tuple:
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_counts_against_plain_python():
    draw, compressor = random.Random(3), zstandard.ZstdCompressor(level=3, write_content_size=False)
    texts = ["", "\n\n", "a b c", "x\x1cy z"] + ["".join(draw.choice(["a ", "b ", "c#\n", "\t", "ß|", "d\x0b", "e "]) for _ in range(draw.randint(0, 60))) for _ in range(300)]
    for text in texts:
        assert tuple(quality.judge(text, compressor))[:6] == _plain(text), repr(text)


_LETTERS = random.Random(0)
_WORDS = ["".join(_LETTERS.choice("bcdfghjklmnprstvwyz") + _LETTERS.choice("aeiouaeio") for _ in range(1 + k % 4)) for k in range(900)]


def _prose(draw, n):
    """Words of a vocabulary, common ones more often, with marks."""
    return " ".join(_WORDS[int(len(_WORDS) * draw.random() ** 2)] + draw.choice(["", "", "", "", "", ",", ".", "s"]) for _ in range(n))


def test_bands_reject_repetition_and_noise_but_not_prose():
    draw, compressor = random.Random(5), zstandard.ZstdCompressor(level=3, write_content_size=False)
    judged = lambda t: quality.judge(t, compressor).kept
    assert all(judged(_prose(draw, n)) for n in (10, 60, 300, 3000))
    assert not judged("spam and eggs " * 400)
    assert not judged(" ".join(base64.b64encode(draw.randbytes(12)).decode() for _ in range(400)))
    assert not judged(_prose(draw, 1000) + " ".join(f"{k % 7} x{k % 3} same same" for k in range(6000)))


def test_junk_is_found_at_head_and_tail_alike():
    draw, compressor = random.Random(6), zstandard.ZstdCompressor(level=3, write_content_size=False)
    kept = lambda t: quality.judge(t, compressor).kept
    for _ in range(10):
        prose = _prose(draw, 2000)[:4200]
        junk = " ".join(base64.b64encode(draw.randbytes(12)).decode() for _ in range(400))[:3900]
        whole = len(compressor.compress(f"{prose} {junk}".encode())) / 8101
        assert whole <= 0.70 and kept(_prose(draw, 3000)[:8101])
        assert not kept(f"{prose} {junk}") and not kept(f"{junk} {prose}")


def _plain_kept(text: str) -> bool:
    """The whole verdict by its rules: base, the band of the text's length, the share of bytes in chunks outside theirs."""
    data, pack = text.encode(), zstandard.ZstdCompressor(level=3, write_content_size=False).compress
    if _plain(text)[5]:
        return False
    band = [b for b in quality.BANDS if b[0] <= len(data)][-1]
    if len(data) >= 256 and (len(pack(data)) < band[1] * len(data) or len(pack(data)) > band[2] * len(data)):
        return False
    outside = 0
    for k in range(0, len(data) if len(data) >= 4096 else 0, 4096):
        chunk = data[k : k + 4096] if k + 4096 <= len(data) else data[-4096:]
        if len(pack(chunk)) < quality.CHUNK_BAND[0] * 4096 or len(pack(chunk)) > quality.CHUNK_BAND[1] * 4096:
            outside += min(4096, len(data) - k)
    return 4 * outside <= len(data)


def test_verdicts_against_their_rules():
    draw, compressor, kept = random.Random(15), zstandard.ZstdCompressor(level=3, write_content_size=False), 0
    for _ in range(150):
        parts = [_prose(draw, draw.choice([20, 100, 700])), base64.b64encode(draw.randbytes(draw.choice([30, 900, 4000]))).decode(), "same line again " * draw.choice([1, 3, 300])]
        text = " ".join([parts[0], *draw.choices([_prose(draw, 200), *parts[1:]], [8, 1, 1], k=draw.randint(0, 4))])
        assert quality.judge(text, compressor).kept == _plain_kept(text)
        kept += _plain_kept(text)
    assert 20 < kept < 130


def test_quality_of_documents_of_all_kinds(spark):
    good = _prose(random.Random(1), 80)
    rows = [(1, None, 0.0, "x"), (None, good, 0.0, "x"), (2, "", 0.0, "x"), (3, good, 0.0, "x"), (3, good, 0.0, "x"), (4, "long word " * 50000, 0.0, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((r["doc_id"] or -1, r["n_words"], r["kept"]) for r in quality.assess(docs).collect())
    assert got == [(-1, 80, True), (1, 0, False), (2, 0, False), (3, 80, True), (3, 80, True), (4, 100000, False)]
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    assert quality.assess(spark.createDataFrame([], DOCS)).count() == 0


def _labelled(n: int, seed: int) -> list[tuple[int, str, int]]:
    draw = random.Random(seed)
    bad = ("nastyword", "vilething", "grimfool", "dreadful1")
    rows = []
    for k in range(n):
        toxic = k % 5 == 0
        words = _prose(draw, draw.randint(30, 200)).split()
        for _ in range(1 + len(words) // 25 if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(bad).upper() if draw.random() < 0.3 else draw.choice(bad))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_scores_of_texts_against_their_definition():
    rows = _labelled(400, 7)
    model = toxicity.learn([t for _, t, _ in rows], [y for _, _, y in rows], 0.2)
    params = zstandard.ZstdCompressionParameters.from_level(13, min_match=3, search_log=7, hash_log=17, chain_log=17, window_log=18, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0)

    def length(content: bytes, window: bytes) -> int:
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=own, compression_params=params).compress(b"<0123456789:>" + window))

    scorer, flagged = toxicity.Scorer(model), 0
    for _, text, _ in [*rows[::23], (0, "", 0), (0, "123 ?!", 0)]:
        words = [f" {w} ".encode() for w in re.findall(r"[a-z\u0080-\U0010ffff]+", text.lower())]
        d = [length(model.ordinary, w) - length(model.toxic, w) for w in words]
        hits = [sum(x >= k for x in d) for k in (2, 3, 4, 5, 6, 7)]
        x = [1.0, max(d), math.log(len(d)), *map(math.log1p, hits), *(math.sqrt(h / len(d)) for h in hits)] if d else [1.0] + [0.0] * 14
        z = sum(a * b for a, b in zip(x, model.weights, strict=True))
        assert math.isclose(scorer(text), 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9)
        flagged += scorer(text) >= 0.7
    assert 0 < flagged < 10


def test_toxicity_on_the_held_out_fold(spark):
    rows = _labelled(1500, 1)
    docs = spark.createDataFrame([(k, t, 0.0, "x") for k, t, _ in rows] + [(None, "no id", 0.0, "x"), (9999, None, 0.0, "x")], DOCS)
    labels = spark.createDataFrame([(k, y, 1) for k, _, y in rows] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, text int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == 1502 and all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["held_out"] is False
    held = [(got[k]["predicted"], y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, _, _ in rows)
    hits = sum(p and y for p, y in held)
    assert hits >= 0.9 * sum(y for _, y in held) and hits >= 0.95 * sum(p for p, _ in held)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in got.values())


def test_toxicity_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "text", 0.0, "x")], DOCS)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score(docs, labels).collect()] == [0.0]
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_common_licences_are_kept():
    """Ordinary texts of other sources than the test tables, where the machine has them."""
    from pathlib import Path

    compressor = zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False)
    for name in ("GPL-3", "GPL-2", "Apache-2.0", "Artistic", "BSD"):
        path = Path("/usr/share/common-licenses") / name
        if path.exists():
            assert quality.judge(path.read_text(), compressor).kept, name
