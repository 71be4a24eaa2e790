"""The queries on the driver's smallest tables against brute force."""

import hashlib
import math
import os
import re
import zlib

import pytest
from pyspark.sql import functions as F

from nodeloom.llm import oracles, queries, toxicity
from test_minmax import brute as components
from test_minmax import shingles
from test_pii import brute as spans_of
from test_rlz import brute as kept_of
from test_warc import expected

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_op2(spark, docs):
    got = {r.doc_id: r for r in queries.op2_rlz_substrings(spark, SF).collect()}
    assert len(got) == len(docs)
    for d, n, gone, text in kept_of(docs):
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (n, gone, hashlib.sha256(text.encode()).hexdigest())


def test_op5(spark, docs):
    want, texts = components(docs, 2), dict(docs)
    for r in queries.op5_minmax_near_duplicates(spark, SF).collect():
        assert r.component_id == want[r.doc_id] and r.n_shingles == len(shingles(texts[r.doc_id], 2))


def test_op7(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries.op7_warc_revisits(spark, SF).collect()), key=str) == expected(pages)


def test_op10(spark, docs):
    got = {r.doc_id: r for r in queries.op10_pii_spans(spark, SF).collect()}
    for d, text in docs:
        want = spans_of(text)
        written = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in want)
        assert got[d].base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]
        assert set(filter(None, written.split(","))) <= set(filter(None, got[d].spans.split(",")))


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql_gives_the_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for table in ("documents", "pages"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = c.sql(f"SELECT {', '.join(columns)} FROM ({oracles.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want, key=repr) and want


def test_op9(spark):
    got = queries.op9_source_mix(spark, SF).collect()
    for source in {r.source for r in got}:
        rows = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1 and all(r.taken <= 2 * r.size for r in rows)


def test_op3(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    from nodeloom.llm import bpe

    ranks, pattern = queries.tokenizer()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(ranks), special_tokens={})
    got = {r.doc_id: r for r in queries.op3_byte_bpe(spark, SF).collect()}
    for d, text in docs:
        ids = known.encode_ordinary(text or "")
        assert (got[d].n_tokens, got[d].decoded_sha256) == (len(ids), hashlib.sha256((text or "").encode()).hexdigest())
        assert got[d].ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def test_op1(spark):
    """Every offset of every query and every clip of the table, one by one: no false links, and few missed."""
    import numpy as np

    from nodeloom.llm import chroma

    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    prints = {i: chroma.fingerprint(chroma.sonify(v)) for i, v in vectors.items()}
    classes: dict = {}
    for i in sorted(prints):
        classes.setdefault(prints[i].tobytes(), []).append(i)
    named = {ids[0]: np.frombuffer(k, np.uint32) for k, ids in classes.items()}
    asking = [ids[0] for ids in classes.values() if any(i % 50 == 0 for i in ids)]
    got = {r.vec_id: r for r in queries.op1_chroma_fingerprints(spark, SF).collect()}
    assert set(got) == set(vectors)
    links = found = 0
    for c, a in named.items():
        best = {}
        for q in asking:
            b, errors = named[q], {}
            for d in range(3 - len(b), len(a) - 2):
                x, y = (a[d:], b) if d >= 0 else (a, b[-d:])
                n = min(len(x), len(y))
                errors[d] = np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n)
            if q != c and errors and min(errors.values()) <= chroma.MOST_ERROR:
                best[q] = errors
        r = got[c]
        links, found = links + len(best), found + min(r.n_links, len(best))
        assert r.n_frames == len(a) and r.n_links <= len(best)
        if r.n_links:
            assert abs(best[r.best_query][r.offset] - r.bit_error) < 1e-6
    assert links > 100 and found >= 0.9 * links
    for ids in classes.values():
        assert len({(got[i].class_id, got[i].n_links, got[i].best_query) for i in ids}) == 1 and got[ids[0]].class_id == ids[0]


def test_op4(spark, docs):
    """Scores by hand from the fitted model, and how well they do on the held-out labels."""
    scores = {r.doc_id: r for r in queries.op4_toxicity(spark, SF).collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(table, labels)
    assert len(scores) == len(docs)
    for d, text in docs:
        found = {w for w in re.findall(r"[^\W\d_]+", (text or "").lower())}
        z = model.bias + sum(w for e, w in zip(model.lexicon, model.weights) if (any(x.startswith(e[:-1]) and len(x) >= len(e) for x in found) if e.endswith("*") else e in found))
        r = scores[d]
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
    known = [(scores[r.doc_id], r.toxic) for r in labels.collect() if r.doc_id in scores]
    right = [s.predicted == t for s, t in known if s.held_out]
    assert sum(right) >= 0.9 * len(right)


def test_op8(spark, docs):
    from test_pipeline import line_dedup_all

    got = {r.doc_id: r for r in queries.op8_line_edit_join(spark, SF).collect()}
    for d, text in line_dedup_all(docs):
        assert got[d].kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
    for d, text in docs:
        assert got[d].n_lines == len(text.split("\n"))


def test_mixing_edge_cases(spark):
    from nodeloom.llm import mixing

    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", None), (4, "x y", None), (None, "p q", "t"), (5, "long " * 5000, "t"), (6, "z", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 and all(0 <= r.taken <= 2 * r.size for r in own)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.apply_mix(docs.limit(0)).count() == 0
    assert mixing.apply_mix(docs).columns == docs.columns
