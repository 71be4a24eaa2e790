import hashlib
import math
from collections import defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tiktoken = pytest.importorskip("tiktoken")
from pyspark.sql import functions as F  # noqa: E402

from nodeloom.llm import bpe, lines, queries, toxicity  # noqa: E402
from test_minmax import brute as components  # noqa: E402

SF = "/root/testdata/sf0.001"


def line_dedup(rows):
    """What line_dedup_all leaves, without texts that lost all of their lines."""
    before = dict(rows)
    return [(d, t) for d, t in line_dedup_all(rows) if t == before[d] or t.strip()]


def line_dedup_all(rows):
    """Equal lines by a dictionary, near ones by comparing all pairs of about the same length."""
    first, by_length = {}, defaultdict(list)
    for d, t in sorted(rows):
        for i, x in enumerate(t.split("\n")):
            if x.strip() and x not in first:
                first[x] = (d, i)
                by_length[len(x)].append(x)
    near = {}
    for x, at in first.items():
        near[x] = at
        for n in range(len(x) - 2, len(x) + 3):
            for y in by_length[n]:
                if first[y] < near[x] and lines.within(x, y, lines.allowed(min(len(x), n))):
                    near[x] = first[y]
    out = []
    for d, t in rows:
        out.append((d, "\n".join(x for i, x in enumerate(t.split("\n")) if not (x.strip() and near[x] < (d, i)))))
    return out


def mixed(rows, source):
    size = {d: len(t.encode().split()) for d, t in rows}
    by = defaultdict(list)
    for d, _ in rows:
        by[source[d]].append(d)
    names = sorted(by)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(size[d] for d in by[s]) for s in names}
    goal, open_, left = {}, set(names), 1.5 * sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * total[s]}
        if not full:
            goal.update(share)
            break
        for s in full:
            goal[s] = 2.0 * total[s]
            left -= goal[s]
        open_ -= full
    times = {}
    for s in names:
        turns = math.floor(goal[s] / total[s] + 1e-12) if total[s] else 0
        rest = round(goal[s] - turns * total[s])
        place = {d: hashlib.md5(f"mix:{d}".encode()).hexdigest()[:15] for d in by[s]}
        for d in sorted(by[s], key=place.get):
            more = rest >= size[d] or (rest > 0 and 2 * rest >= size[d])
            times[d] = turns + more if size[d] else 0
            rest = rest - size[d] if rest >= size[d] else 0
            if rest == 0:
                rest = -1
    return [(d, t) for d, t in rows for _ in range(times[d])]


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    source = {d: s for d, _, s in rows}
    kept = [(d, t) for d, t, _ in rows if model.score(t) < 0.5]
    kept = line_dedup(kept)
    of = components(kept, corpus_pipeline.SHINGLE_WORDS)
    kept = [(d, t) for d, t in kept if of[d] == d]
    kept = mixed(kept, source)
    ranks, pattern = queries.tokenizer()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(ranks), special_tokens={})
    want = sorted((d, len(i := known.encode_ordinary(t)), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in i)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in kept)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_columns_and_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), SF)
        assert out.columns == docs.columns and out.count() == 0


def hard(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and names that the operators use themselves."""
    long_text = "\n".join(f"line {i} of a very long text with its own number {i * i}" for i in range(6000))
    rows = [
        (1, "a first text of some words that stands twice\nand a line", "en", "web", 10), (1, "a first text of some words that stands twice\nand a line", "en", "web", 10),
        (2, None, None, None, None), (3, "", "de", "web", 0), (4, " \n\t", "de", None, 3), (None, "no id but words enough to count", "fr", "web", 5), (5, long_text, "en", "books", len(long_text)),
        (6, long_text.replace("line 17 ", "line seventeen "), "en", "books", 1), (7, "other", "en", "web", 5), (7, "another", "en", "web", 7), (8, "tie of equal length A", "en", "x", 1), (9, "tie of equal length B", "en", "x", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("score", "n_lines", "n_removed", "number", "size", "place", "turn", "turns", "rest", "id", "gone", "key", "component_id", "kept", "n", "__size", "tag", "first", "late", "block")
    return docs.select("*", *(F.lit(f"my {c}").alias(c) for c in names))


def test_hard_rows_in_every_stage(spark):
    docs = hard(spark)
    want = docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert all(r[c] == f"my {c}" for r in rows for c in docs.columns[5:])
        kept[name] = sorted((r.doc_id is None, r.doc_id or 0, r.text) if r.text is not None else (r.doc_id is None, r.doc_id or 0, "") for r in rows)
    assert len(kept["toxicity"]) == want
    lines = [r[1] for r in kept["line_dedup"]]
    assert lines.count(1) == 2 and lines.count(7) == 2 and {2, 3, 4, 5} <= set(lines) and len(next(r[2] for r in kept["line_dedup"] if r[1] == 6)) < 100
    near = [r[1] for r in kept["near_duplicates"]]
    assert near.count(1) == 1 and near.count(7) == 1 and 6 not in near and {0, 2, 3, 4, 5, 8, 9} <= set(near) and [r[2] for r in kept["near_duplicates"] if r[1] == 7] == ["another"]
    assert not {2, 3, 4} & {r[1] for r in kept["mixing"]}
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(tokens) == want and {r.n_tokens for r in tokens if r.doc_id in (2, 3)} == {0}
