import hashlib
import random
import time

import pytest

from nodeloom.llm import bpe, queries

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def coder():
    return bpe.encoder(*queries.tokenizer())


@pytest.fixture(scope="module")
def known(coder):
    return tiktoken.Encoding("own", pat_str=queries.tokenizer()[1], mergeable_ranks=coder.ranks, special_tokens={})


def ids(data: bytes) -> list[int]:
    return memoryview(data).cast("I").tolist()


def test_as_the_library(coder, known):
    draw = random.Random(7)
    alphabet = "aab  \n\t\r\x1c\x1f\x85   éßñ漢字🙂'sTll09_.-=\x00​"
    texts = ["", " ", "a" * 300, "ab" * 200, "\n" * 20 + "x", "it's we'LL 're", "é 가"]
    texts += ["".join(draw.choice(alphabet) for _ in range(draw.randrange(200))) for _ in range(300)]
    for text in texts:
        assert ids(coder.encode(text)) == known.encode_ordinary(text)
        assert coder.decode(coder.encode(text)) == text.encode()


def test_long_piece_in_time(coder, known):
    draw = random.Random(3)
    piece = "".join(draw.choice("abcdefghij") for _ in range(100_000))
    began = time.time()
    got = ids(coder.encode(piece))
    assert time.time() - began < 10
    assert b"".join(coder.vocabulary[i] for i in got) == piece.encode()
    assert ids(coder.encode(piece[:3000])) == known.encode_ordinary(piece[:3000])


def test_frames(spark, known):
    ranks, pattern = queries.tokenizer()
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "Ab cd", None), (3, "Ab cd", None), (None, "é" * 5000, "z")], "doc_id long, text string, token string")
    rows = bpe.decode(bpe.encode(docs, ranks, pattern), ranks, pattern).collect()
    assert len(rows) == 5
    for r, text in zip(sorted(rows, key=lambda r: bytes(r.decoded)), ["", "", "Ab cd", "Ab cd", "é" * 5000]):
        assert bytes(r.decoded) == text.encode() and ids(bytes(r.token_ids)) == known.encode_ordinary(text)
    assert sorted(map(tuple, bpe.round_trip(docs, ranks, pattern).collect()), key=str) == sorted(map(tuple, rows), key=str)
    out = {r.doc_id: r for r in queries.bpe_digests(docs).collect()}
    assert out[3].ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in known.encode_ordinary("Ab cd"))).hexdigest()
    assert out[1].n_tokens == 0
    assert queries.bpe_digests(docs.limit(0)).count() == 0


def test_ranks_of_any_size():
    """The same merges under ranks that are far above 65,535, and with gaps, give the same tokens under these ranks."""
    import base64

    content, pattern = queries.tokenizer()
    ranks = bpe.load_ranks(content)
    moved = {t: r if r < 256 else 70_000 + 3 * r for t, r in ranks.items()}
    coder = bpe.Encoder(moved, pattern)
    own = tiktoken.Encoding("moved", pat_str=pattern, mergeable_ranks=moved, special_tokens={})
    draw = random.Random(5)
    texts = ["tokenization of extraordinarily long compound words", "zz" * 500, "".join(draw.choice("abcdeé 🙂") for _ in range(4000))]
    for text in texts:
        assert ids(coder.encode(text)) == own.encode_ordinary(text) and max(ids(coder.encode(text)), default=0) > 65_535
        assert coder.decode(coder.encode(text)) == text.encode()
    few = {bytes([b]): b for b in range(256)} | {b"ab": 70_000}
    assert ids(bpe.Encoder(few, pattern).encode("abc")) == [70_000, 99]
    last = few | {b"cd": (1 << 32) - 1, b"abcd": 1 << 31}
    assert ids(bpe.Encoder(last, pattern).encode("abcdcd")) == [1 << 31, (1 << 32) - 1] and bpe.Encoder(last, pattern).decode(bpe.Encoder(last, pattern).encode("abcdcd")) == b"abcdcd"
    # More tokens than two levels of 256 hold, so that merges lie in several stems.
    wide = {t: r if r < 256 else 400_000 + r for t, r in ranks.items()} | {b"\xff\xfe" + i.to_bytes(3, "big"): 256 + i for i in range(140_000)}
    coder = bpe.Encoder(wide, pattern)
    own = tiktoken.Encoding("wide", pat_str=pattern, mergeable_ranks=wide, special_tokens={})
    assert len(coder.stems) == 3
    for text in texts:
        assert ids(coder.encode(text)) == own.encode_ordinary(text) and coder.decode(coder.encode(text)) == text.encode()
        assert not any(coder.leaves) and not any(coder.stems)
    assert bpe.load_ranks(base64.b64encode(b"a") + b" 5\n") == {b"a": 5}
    for bad in ({b"a": 0}, few | {b"cd": 70_000}, few | {b"cd": 1 << 32}):
        with pytest.raises(ValueError):
            bpe.Encoder(bad, pattern)


def test_clashing_names(spark):
    ranks, pattern = queries.tokenizer()
    rows = bpe.encode(spark.createDataFrame([(1, "a b", "mine", 7)], "doc_id long, text string, __ids string, ids int"), ranks, pattern)
    r = bpe.decode(rows, ranks, pattern).first()
    assert (r["__ids"], r.ids, bytes(r.decoded)) == ("mine", 7, b"a b")
