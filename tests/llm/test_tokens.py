import random

import numpy as np

from nodeloom.llm import tokens


def test_equal_hashes_for_equal_words_alone(monkeypatch):
    draw = random.Random(2)
    texts = ["", " ", "\t\n", "one", " one\x0btwo\x0c Two\r\n", "é 漢字 x y", "x" * 500, "a b " * 300]
    texts += ["".join(draw.choice("abAB é \t\n🙂") for _ in range(draw.randrange(60))) for _ in range(300)]
    for chunk in (1 << 20, 64, 3):
        monkeypatch.setattr(tokens, "CHUNK", chunk)
        for lower in (False, True):
            words = [t.encode().lower().split() if lower else t.encode().split() for t in texts]
            got = tokens.hashed(texts, lower)
            assert [len(h) for h in got] == [len(w) for w in words]
            seen = {}
            for w, h in zip(words, got):
                for x, y in zip(w, h.tolist()):
                    assert seen.setdefault(x, y) == y
            assert len(set(seen.values())) == len(seen)
    assert tokens.hashed([]) == []


def test_windows():
    hashes = np.random.default_rng(1).integers(0, 5, 400).astype(np.uint64)
    for k in (1, 2, 3, 4, 13):
        got = tokens.windows(hashes, k)
        keys = [tuple(hashes[i : i + k]) for i in range(len(hashes) - k + 1)]
        assert len(got) == len(keys) and len(set(got.tolist())) == len(set(keys)) == len(set(zip(keys, got.tolist())))
        assert len(tokens.windows(hashes[: k - 1], k)) == 0
