import random

import pytest

from nodeloom.llm import packing

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def spec():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def known(spec):
    t = tokenizers.Tokenizer.from_str(spec)
    t.encode_special_tokens = True
    return t


def ids(data: bytes) -> list[int]:
    return memoryview(data).cast("I").tolist()


def test_words_as_the_library(spec, known):
    draw = random.Random(2)
    alphabet = "aab  \n\t\r\x0b\x0c\x1c\x1f\x85  　éßñİΣς漢字🙂'sTll09_.-=<>|é̸​\x00"
    texts = ["", " ", "a" * 3000, "it's we'LL 're", "<|endoftext|> <|startoftext|>", " ́x", "ΑΣ ΑΣ", "Å̇ 가"]
    texts += ["".join(draw.choice(alphabet) for _ in range(draw.randrange(200))) for _ in range(400)]
    latin = "".join(map(chr, [*range(33, 127), *range(0xA1, 0x180)]))
    texts += ["".join(draw.choice(latin + "  abcdef") for _ in range(draw.randrange(80))) for _ in range(400)] + [" ".join(latin), latin]
    words = packing.Words(spec)
    assert words.cut and words.cut("Ab1é's".encode()) == ["ab", "1", "Ã©", "'s"] and words.cut(b"\x1c") is None and packing.latin_pieces("{}") is None
    for text in texts:
        assert ids(words.encode(text.encode())) == known.encode(text, add_special_tokens=False).ids
        assert ids(words.encode(text.encode(), 5)) == known.encode(text, add_special_tokens=False).ids
    words.keep_bytes = 10  # forgets all the time
    assert ids(words.encode(texts[-1].encode())) == known.encode(texts[-1], add_special_tokens=False).ids


def check(rows, want, length):
    """Every token in one piece, sequences without gaps, full but for the powers of two at the end."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append((r.start, ids(r.token_ids), r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, len(r.token_ids) // 4))
    for doc, pieces in docs.items():
        pieces.sort()
        assert [x for _, p, _ in pieces for x in p] == want[doc] and {t for *_, t in pieces} == {len(want[doc])} and all(p for _, p, _ in pieces)
        assert [s for s, *_ in pieces] == [sum(len(p) for _, p, _ in pieces[:i]) for i in range(len(pieces))]
    assert docs.keys() == {d for d, x in want.items() if x}
    sizes = []
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        sizes.append(sum(n for _, n in places))
    rest = [s for s in sizes if s != length]
    assert all(s < length and s & (s - 1) == 0 for s in rest) and len(set(rest)) == len(rest)


@pytest.mark.parametrize("parts,windows,fan", [(1, 16, 32), (7, 3, 2), (5, 1, 32)])
def test_round_trip(spark, spec, known, monkeypatch, parts, windows, fan):
    monkeypatch.setattr(packing, "FAN_IN", fan)
    draw = random.Random(parts)
    texts = [None, "", " \n", "x" * 5000, "word " * 700, *(" ".join(draw.choice("some of these words it's".split()) for _ in range(draw.randrange(90))) for _ in range(150))]
    rows = [(i, x, 1, "s", 2) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, window string, origin int").repartition(parts)
    got = packing.pack(docs, spec, 64, windows=windows)
    assert got.columns == ["doc_id", "start", "token_ids", "doc_tokens", "sequence_id", "offset"]
    check(got.collect(), {i: known.encode(x or "", add_special_tokens=False).ids + [2] for i, x, *_ in rows}, 64)


def test_odd_tables(spark, spec):
    schema = "doc_id string, text string"
    assert packing.pack(spark.createDataFrame([], schema), spec).count() == 0
    assert packing.pack(spark.createDataFrame([("a", None)], schema), spec, end_id=None).count() == 0
    same = packing.pack(spark.createDataFrame([(None, "a b"), ("x", "a b"), ("x", "a b")], schema), spec).collect()
    assert sum(len(r.token_ids) // 4 for r in same) == 9 and {r.doc_id for r in same} == {None, "x"}
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], schema), spec, 100)


def test_places():
    """The smallest gap that holds a piece takes it; if none does, the fullest window is topped up and given out."""
    packer = packing.Packer(8, 2)
    piece = lambda d, n: [(d, 0, bytes(4 * n), n)]
    for d, n in (("a", 5), ("b", 6), ("c", 2)):
        packer.place(piece(d, n))
    assert [[p[0] for p in s] for s in packer.out] == [["b", "c"]]
    packer.place(piece("d", 4))
    packer.place(piece("e", 7))
    assert [[(p[0], p[1], len(p[2]) // 4) for p in s] for s in packer.out[1:]] == [[("a", 0, 5), ("e", 0, 3)], [("d", 0, 4), ("e", 3, 4)]] and not packer.open
    packer.place(piece("f", 19))
    packer.place(piece("g", 6))
    packer.close()
    assert [sum(len(p[2]) for p in s) // 4 for s in packer.out[3:]] == [8, 8, 8, 1]
