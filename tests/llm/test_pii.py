import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from nodeloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, kind in enumerate(PLAIN):
        for m in re.finditer(PLAIN[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def texts():
    draw = random.Random(9)
    parts = ["a@b.cd", "%x@y.z", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "007.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-2671", "+12", "+123456789)", "é🙂", " ", "\n", "-", "12", "a.b-c_d", "+", "378282246310005", "0" * 12, "+49 30 1234 567 ", "me (at) host dot com", "call 415-555-2671 now"]
    return ["".join(draw.choices(parts, k=draw.randrange(1, 12))) for _ in range(400)] + ["", None, "x" * 50_000, "1" * 50_000, "a." * 20_000 + "@", "é 4111111111111111"]


def test_base_against_python(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [rows[3], (None, "a@b.c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1)).repartition(4)
    began = time.time()
    got = pii.find_spans(docs).select("doc_id", "base", "spans", pii.written(F.col("base")).alias("w")).collect()
    assert time.time() - began < 120 and len(got) == len(rows)
    by_id = dict(rows)
    for r in got:
        want = brute(by_id[r.doc_id])
        assert [tuple(s) for s in r.base] == want, by_id[r.doc_id]
        assert set(want) <= {tuple(s) for s in r.spans}
        assert r.w == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
    assert any(len(r.spans) > len(r.base) for r in got)


def planted(n=600, seed=4):
    """(texts, spans that are personal data, decoys of the same looks) besides what the base patterns settle."""
    draw = random.Random(seed)
    d = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    name = lambda: "".join(draw.choice("abcdefghilmnorst") for _ in range(6))
    rows, good, bad = [], set(), set()
    for i in range(n):
        text = " ".join(name() for _ in range(draw.randrange(5, 40)))
        for _ in range(draw.randrange(3)):
            kind = draw.randrange(6)
            lead, span, where = {
                0: (" mail me: ", f"{name()} (at) {name()} (dot) com", good), 1: (" phone: ", f"({draw.randrange(2, 9)}{draw.randrange(9)}{d(1)}) {draw.randrange(2, 9)}{d(2)}-{d(4)}", good),
                2: (" call ", f"{draw.randrange(2, 9)}{draw.randrange(9)}{d(1)}-{draw.randrange(2, 9)}{d(2)}-{d(4)}", good), 3: (" invoice no", f"1{d(2)}-0{d(2)}-{d(4)}x", bad),
                4: (" version=", f"{draw.randrange(256, 999)}.{d(3)}.{d(3)}.{d(3)}", bad), 5: (" reach " + name() + "@" + name() + draw.choice((".com", ".org")), "", None),
            }[kind]
            if where is not None:
                where.add((i, len(text) + len(lead), len(text) + len(lead) + len(span)))
            text += lead + span + " " + name()
        rows.append((i, text))
    return rows, good, bad


def test_precision_and_recall_of_what_is_added(spark):
    rows, good, bad = planted()
    got = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {(r.doc_id, s.start, s.end) for r in got for s in r.spans} - {(r.doc_id, s.start, s.end) for r in got for s in r.base}
    assert len(good) > 200 and len(bad) > 100
    assert len(added & good) / len(good) >= 0.9 and len(added & good) / len(added) >= 0.9


def test_very_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@h{i}.com 10.0.{i % 250}.{i % 199}" for i in range(20_000))
    began = time.time()
    r = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(s) for s in r.base] == brute(text) and len(r.base) == 40_000 and time.time() - began < 60


def test_reliabilities_find_the_noisy_labeler():
    draw = random.Random(2)
    counts = {}
    for _ in range(20_000):
        y = draw.random() < 0.4
        v = tuple((1 if y else -1) if draw.random() < a else (-1 if y else 1) for a in (0.95, 0.9, 0.5, 0.85, 0.9, 0.8))
        counts[0, v] = counts.get((0, v), 0) + 1
    patterns = [(k, v, n) for (k, v), n in counts.items()]
    posterior, tables = pii.reliabilities(patterns)
    for (right, t) in zip((0.95, 0.9, 0.5, 0.85, 0.9, 0.8), tables):
        assert abs(t[1][1] - right) < 0.04
    assert sum(n for p, (_, v, n) in zip(posterior, patterns) if (p > 0.5)) / 20_000 - 0.4 < 0.03


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_spans(docs).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.createDataFrame([(1, "no")], "doc_id long, text string").transform(pii.find_spans).select(F.sha2(pii.written(F.col("base")).cast("binary"), 256)).first()[0]
