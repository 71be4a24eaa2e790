import itertools
import random

from nodeloom.llm import audit

DOCS = "doc_id long, text string, source string, part string, failed int, digest string, n int"
LABELS = "doc_id long, quality int, toxic int"


def expected(docs, labels):
    """Every order applied to the documents, one filter after the other."""
    good, toxic = ({d for d, *marks in labels if d is not None and marks[i] == 1} for i in (0, 1))
    ids = {}
    for d, text, _ in docs:
        if d is not None:
            ids[text or ""] = min(d, ids.get(text or "", d))
    fails = []
    for d, text, _ in docs:
        text = text or ""
        words = [w for w in text.translate({ord(c): " " for c in "\t\n\v\f\r"}).split(" ") if w]
        fails.append({"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text), "E": d is not None and d > ids[text]})
    out = {}
    for part in {s or "" for _, _, s in docs}:
        own = [i for i, x in enumerate(docs) if (x[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [i for i in left if fails[i][f]]
                earlier = [i for i in own if i not in left and fails[i][f]]
                left = [i for i in left if not fails[i][f]]
                alone = [i for i in own if fails[i][f] and sum(fails[i].values()) == 1]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(earlier), len(alone), sum(docs[i][0] in good for i in gone), sum(docs[i][0] in toxic for i in gone), f]
        for (p, _, _), row in out.items():
            if p == part:
                row[6] = shapley[row[6]]
    return {k: tuple(v) for k, v in out.items()}


def test_against_every_order(spark):
    draw = random.Random(5)
    texts = ["", None, "a b", "#", "AAAA bbbb", "wort " * 60, " ".join(f"w{i}" for i in range(70)), " ".join(f"w{i}" for i in range(70)) + " %", "x\x0b y\x1cz é ü", "ABC " * 55, "two words"]
    docs = [(draw.choice([None, *range(30)]), draw.choice(texts), draw.choice(["a", "b", "", None, "ü"])) for _ in range(60)]
    docs += [(7, "the same", "a")] * 3 + [(8, "the same", "b")] * 2
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 30, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (99, 1, 1)]
    rows = spark.createDataFrame([(*d, "x", 1, "y", 2) for d in docs], DOCS).repartition(3)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in audit.audit(rows, spark.createDataFrame(labels, LABELS)).collect()}
    assert got == expected(docs, labels) and len(got) == 600 * 4


def test_a_group_of_copies(spark):
    """A text that most rows share, in two parts: all but the first are repeats, whatever part they are in."""
    docs = [(i, "the very same text", "a" if i % 3 else "b") for i in range(3000)] + [(10_000, "another", "a")]
    got = audit.audit(spark.createDataFrame([(*d, None, None, None, None) for d in docs], DOCS), spark.createDataFrame([], LABELS)).where("filter_order = 'EABCD' AND step = 1").collect()
    assert {r.part: (r.kept, r.removed) for r in got} == {"a": (1, 2000), "b": (1, 999)}


def test_long_texts_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(audit, "CHUNK", 7)
    for text in (b"abc abcdefghij abc", b" " * 40, b"x" * 40, b"ab " * 51, b"\n".join(b"%d" % (i % 70) for i in range(100))):
        words = text.split()
        assert audit.failed_by_text(text, len(text)) & 3 == (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1
    empty = spark.createDataFrame([], DOCS)
    assert audit.audit(empty, spark.createDataFrame([], LABELS)).count() == 0


def test_table():
    table = audit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    assert table[0b00101, audit.ORDERS.index("BCADE")] == 1 and table[0b10000, audit.ORDERS.index("BCADE")] == 4
