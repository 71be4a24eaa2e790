import random
import re
from collections import Counter

import pytest

from nodeloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, shard long, n long"


def expected(docs, least=30, longest=4, top=2000):
    f, total = {}, Counter()
    for text, lang in docs:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found, most = [], Counter()
        for p, a in counts.items():
            if a >= least:
                for k in range(2, len(p)):
                    for i in range(len(p) - k + 1):
                        most[p[i : i + k]] = max(most[p[i : i + k]], a)
        for p, a in counts.items():
            if len(p) > 1 and a >= least and not 100 * most[p] >= 80 * a:
                score, cut = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def made(draw, n):
    common = ["New  York city", "of the,", "of\tthe end", "in a b c d e", "ÄB é", "x\x0by", "a a a a a", "wort.", "kick the bucket list", "!", "\x1cq r"]
    return [(" ".join(draw.choice(common) for _ in range(draw.randrange(40))), draw.choice(["en", "en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("shard,parts,longest,top", [(1 << 20, 3, 4, 2000), (50, 2, 4, 5), (2, 1, 4, 2000), (1, 1, 3, 2000), (7, 2, 2, None), (11, 2, 5, None)])
def test_against_brute_force(spark, shard, parts, longest, top):
    docs = made(random.Random(shard), 60) + [(None, "en"), ("", None), ("a b", "xx")]
    rows = spark.createDataFrame([(i, *d, 1, 2) for i, d in enumerate(docs)], SCHEMA).repartition(parts)
    got = phrases.collocations(rows, least=12, longest=longest, top=top, shard_words=shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = expected(docs, 12, longest, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_chunks(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 5)
    text = "One, two three;four five-six\nsevenandmore eight".encode()
    assert [w for c in phrases.word_chunks(text) for w in c] == b"one \xff two three \xff four five-six \xff sevenandmore eight".split()


def test_one_long_piece(spark):
    """Two million words without an end of a piece, over several shards."""
    docs = [("a b c d " * 500_000, "en")]
    got = phrases.collocations(spark.createDataFrame([(1, *docs[0], 0, 0)], SCHEMA)).collect()
    assert {r.phrase for r in got} == {"a b c d", "b c d a", "c d a b", "d a b c"}
    for r in got:
        assert r.a == (500_000 if r.phrase == "a b c d" else 499_999) and r.n == 2_000_000


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "a b. c d", "en", 0, 0)], SCHEMA)).count() == 0
