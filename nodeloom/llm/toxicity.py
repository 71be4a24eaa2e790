"""Toxicity by weak supervision.

1. Lexicon: in labelled training rows, words and word beginnings that almost
   only toxic documents hold, counted so that near copies count once.
2. Voters: each looks at one kind of evidence. Six look for entries: whole
   words that are frequent among toxic texts, rarer whole words, beginnings of
   four, five and six letters, and any entry within three words of an address
   in the second person. Six look at how the entries stand: several roots, many
   roots, close together, with an address anywhere, in capitals or with
   exclamation marks, or that there is none.
3. Label model: from the counts of all vote patterns in the whole table, at
   most 2^12, expectation-maximisation fits a generative model: in either class
   a distribution over all patterns with a term for each voter, its accuracy,
   and a term for each pair of voters that still agree within a class, their
   correlation. With 2^12 patterns its sums are exact.
4. A logistic regression over the lexicon's entries learns the posterior
   labels and gives the scores.

Labels are used in step 1 and for the share of toxic rows only, and only those
outside the held-out fold.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, slices, stored

FOLDS, HELD_OUT = 5, 0
#: At most about so many labelled rows are learnt from, and as many documents by the regression.
SAMPLE = 30_000
BEGINNINGS = (4, 5, 6)
VOTER_NAMES = ("frequent word", "rare word", "beginning of 4", "beginning of 5", "beginning of 6", "addressed", "two roots", "four roots", "dense", "address", "loud", "none")
GROUPS, VOTERS = 6, len(VOTER_NAMES)
_words = re.compile(r"[^\W\d_]+").findall
ADDRESS = frozenset("you your youre du dich ihr sie tu toi vous usted eres ti".split())


def fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def is_held_out(doc_id):
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def entries(words: set[str]) -> set[str]:
    """The words, and the beginnings of longer ones, marked by a star."""
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}


@dataclass
class Model:
    lexicon: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -3.0
    frequent: frozenset[str] = frozenset()
    accuracies: np.ndarray | None = None
    correlations: np.ndarray | None = None

    def __post_init__(self):
        self.number = {e: i for i, e in enumerate(self.lexicon)}
        self.begin = {n: {e[:-1] for e in self.lexicon if e.endswith("*") and len(e) == n + 1} for n in BEGINNINGS}
        self.whole = {e for e in self.lexicon if not e.endswith("*")}

    def hits(self, words: list[str]) -> list[int]:
        """Numbers of the lexicon's entries that the words hold."""
        distinct = set(words)
        found = distinct & self.whole
        for n, starts in self.begin.items():
            if starts:
                found |= {b + "*" for b in starts & {w[:n] for w in distinct if len(w) > n}}
        return sorted(self.number[e] for e in found)

    def votes(self, text: str) -> tuple[int, list[int]]:
        """Votes as the bits of an integer, in the order of VOTER_NAMES, and the entries hit."""
        words = _words(text.lower())
        hit = self.hits(words)
        if not hit:
            return 1 << VOTERS - 1, hit
        found = [self.lexicon[i] for i in hit]
        whole = [e for e in found if not e.endswith("*")]
        lengths = {len(e) - 1 for e in found if e.endswith("*")}
        addressed = [i for i, w in enumerate(words) if w in ADDRESS]
        near = {words[j] for i in addressed for j in range(max(0, i - 3), min(len(words), i + 4))}
        roots = {e[:4] for e in found}
        on = (
            any(e in self.frequent for e in whole), any(e not in self.frequent for e in whole), *(n in lengths for n in BEGINNINGS), bool(near) and bool(self.hits(list(near))),
            len(roots) >= 2, len(roots) >= 4, len(hit) * 60 >= len(words), bool(addressed), "!!" in text or text.isupper(),
        )
        return sum(b << j for j, b in enumerate(on)), hit

    def score(self, text: str | None) -> float:
        hit = self.hits(_words(text.lower())) if text else []
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[hit].sum(), -30, 30))))


def fitted_terms(moments: np.ndarray, features: np.ndarray, terms: np.ndarray, decay: float = 1e-2, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(terms, log-probability of every pattern) of the log-linear model over all patterns whose features have these means, by Newton's steps."""
    for _ in range(steps):
        z = features @ terms
        p = np.exp(z - z.max())
        p /= p.sum()
        mean = p @ features
        slope = moments - mean - decay * terms
        bend = (features * p[:, None]).T @ features - np.outer(mean, mean) + decay * np.eye(len(terms))
        change = np.linalg.solve(bend, slope)
        terms = terms + change * min(1.0, 2.0 / np.abs(change).max()) if np.abs(change).max() > 0 else terms
        if np.abs(change).max() < 1e-6:
            break
    z = features @ terms
    return terms, z - z.max() - np.log(np.exp(z - z.max()).sum())


def label_model(patterns: np.ndarray, counts: np.ndarray, share: float, rounds: int = 40, dependent: float = 0.35) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each pattern, accuracies[class, voter], correlations[class, voter, voter]).

    accuracies are P(bit set | class), correlations the terms of the pairs of
    voters, 0 for pairs that the model leaves independent. It starts from the
    share of toxic rows and from the votes, toxic where a lexicon voter speaks.
    Voters first count as independent; pairs of which the residuals correlate
    by more than dependent within a class get a term of their own.
    """
    bits = (patterns[:, None] >> np.arange(VOTERS)) & 1
    every = (np.arange(1 << VOTERS)[:, None] >> np.arange(VOTERS)) & 1
    posterior = np.where(bits[:, :GROUPS].any(1), 0.9, 0.02)
    rate, correlations = np.zeros((2, VOTERS)), np.zeros((2, VOTERS, VOTERS))
    pairs = np.zeros((0, 2), int)
    terms = [np.zeros(VOTERS)] * 2
    prior = np.log(share / (1 - share))
    for r in range(rounds):
        logs = []
        if r == rounds // 4:
            strong = np.zeros((VOTERS, VOTERS), bool)
            for c, p in ((0, 1 - posterior), (1, posterior)):
                off = bits - rate[c]
                covariance = (off * (counts * p)[:, None]).T @ off
                scale = np.sqrt(np.maximum(np.diag(covariance), 0))
                moving = scale > 1  # voters that say the same nearly everywhere correlate with nothing
                scale = np.where(moving, scale, np.inf)
                strong |= np.abs(covariance / np.outer(scale, scale)) > dependent
            pairs = np.argwhere(np.triu(strong, 1))
            terms = [np.append(t, np.zeros(len(pairs))) for t in terms]
        widen = lambda x: np.hstack([x, x[:, pairs[:, 0]] * x[:, pairs[:, 1]]]).astype(float)
        own, features = widen(bits), widen(every)
        for c, p in ((0, 1 - posterior), (1, posterior)):
            w = counts * p
            moments = (w @ own + 0.5 * features.mean(0)) / (w.sum() + 0.5)
            rate[c] = moments[:VOTERS]
            terms[c], log = fitted_terms(moments, features, terms[c])
            logs.append(log[patterns])
        posterior = 1 / (1 + np.exp(-np.clip(prior + logs[1] - logs[0], -30, 30)))
    for c in (0, 1):
        correlations[c][pairs[:, 0], pairs[:, 1]] = correlations[c][pairs[:, 1], pairs[:, 0]] = terms[c][VOTERS:]
    return posterior, rate, correlations


def regress(rows: list[tuple[list[int], int, float]], size: int, rounds: int = 400, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on rows (entries, count, soft label), by gradient steps with momentum."""
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    entry = np.fromiter((e for r in rows for e in r[0]), np.int64, len(at))
    n, y = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    n /= n.sum()
    w, b, vw, vb = np.zeros(size), -1.0, np.zeros(size), 0.0
    held = np.maximum(np.bincount(entry, n[at], size), 1e-4)  # each entry's own step, for its frequency
    for _ in range(rounds):
        z = b + np.bincount(at, w[entry], len(rows))
        g = n * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        vw = 0.9 * vw - 0.2 * (np.bincount(entry, g[at], size) + decay * w) / held ** 0.5
        vb = 0.9 * vb - 0.5 * g.sum()
        w, b = w + vw, b + vb
    return w, float(b)


def _emitted(df: DataFrame, run, ddl: list[tuple[str, T.DataType]]) -> DataFrame:
    return df.mapInArrow(run, T.StructType([T.StructField(*f) for f in ddl]))


def learn_lexicon(labelled: DataFrame, support: float = 4.0, precision: float = 0.9) -> tuple[list[str], frozenset[str], float]:
    """(entries, the more frequent half of the whole words, share of toxic rows) from labelled (text, toxic).

    An entry needs toxic texts worth support, where texts that share the
    smallest hash of their words share one vote, and toxic texts among those
    that hold it of at least precision. Two passes: what toxic texts hold,
    then how many clean ones hold it.
    """

    def toxic_counts(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = set(_words(text.lower()))
                rows.append((min((zlib.crc32(w.encode()) for w in words), default=0), sorted(entries(words))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[], []], (pa.int64(), pa.list_(pa.string())))], names=["kin", "held"])

    toxic = labelled.where("toxic = 1").select("text")
    held = _emitted(toxic, toxic_counts, [("kin", T.LongType()), ("held", T.ArrayType(T.StringType()))])
    by_kin = held.select("kin", F.explode("held").alias("entry")).groupBy("entry", "kin").count().groupBy("entry").agg(F.sum("count").alias("t"), F.count("*").cast("double").alias("kinds"))
    found = {r["entry"]: r["t"] for r in by_kin.where(F.col("kinds") >= support).collect()}  # of at most SAMPLE texts
    if not found:
        return [], frozenset(), 0.1

    def clean_counts(batches):
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(found.keys() & entries(set(_words(text.lower()))))
                seen[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["entry", "n"])

    clean = labelled.where("toxic = 0").select("text")
    against = {r["entry"]: r["n"] for r in _emitted(clean, clean_counts, [("entry", T.StringType()), ("n", T.LongType())]).groupBy("entry").agg(F.sum("n").alias("n")).collect()}
    total_clean, total_toxic = against.get("", 0), toxic.count()
    good = sorted(e for e, t in found.items() if t / (t + against.get(e, 0)) >= precision)
    whole = sorted((e for e in good if not e.endswith("*")), key=lambda e: (-found[e], e))
    return good, frozenset(whole[: (len(whole) + 1) // 2]), max(0.001, min(0.999, total_toxic / max(1, total_toxic + total_clean)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic).

    sample bounds what is learnt from, whatever the input: about so many
    labelled rows, for the lexicon, and about as many documents, for the
    regression, both chosen by a hash of the id. The label model counts the
    votes of all documents. Rows without a label are left out, of several
    labels for one id the largest counts; null texts are empty, texts may be of
    any length, repeated rows count as often as they are there. Without any
    toxic training row, or without rows at all, the lexicon is empty and all
    scores are low. Ties: entries of equal support go by their spelling.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id")) != HELD_OUT).groupBy(F.col("doc_id").alias("l")).agg(F.max("toxic").alias("toxic"))
    part = lambda column, rows: F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int(min(1.0, sample / max(1, rows)) * (1 << 30))
    chosen = usable.where(part("l", usable.count()))
    labelled = stored(docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("l")).select("text", "toxic"), "toxicity")  # about sample rows at most
    lexicon, frequent, share = learn_lexicon(labelled)
    model = Model(lexicon, frequent=frequent)

    def all_votes(batches):
        import pyarrow as pa

        claim("toxicity", int)
        patterns: Counter = Counter()
        learnt: Counter = Counter()
        for batch in slices(batches):
            for text, into in zip(batch.column("text").to_pylist(), batch.column("into").to_pylist()):
                pattern, hit = model.votes(text)
                patterns[pattern] += 1
                if into:
                    learnt[pattern, tuple(hit)] += 1
        rows = [(p, None, n) for p, n in patterns.items()] + [(p, list(h), n) for (p, h), n in learnt.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, (pa.int32(), pa.list_(pa.int32()), pa.int64()))], names=["pattern", "hits", "n"])

    into = F.coalesce((fold(F.col("doc_id")) != HELD_OUT) & part("doc_id", docs.count()), F.lit(False)).alias("into")
    votes = _emitted(docs.select("text", into), all_votes, [("pattern", T.IntegerType()), ("hits", T.ArrayType(T.IntegerType())), ("n", T.LongType())])
    got = votes.groupBy("pattern", "hits").agg(F.sum("n").alias("n")).collect()  # at most 2^12 patterns and sample documents
    counted = sorted((r["pattern"], r["n"]) for r in got if r["hits"] is None)
    if not counted or not lexicon:
        return model
    patterns, counts = np.array([p for p, _ in counted]), np.array([float(n) for _, n in counted])
    posterior, model.accuracies, model.correlations = label_model(patterns, counts, share)
    of = dict(zip(patterns.tolist(), posterior.tolist()))
    rows = sorted((list(r["hits"]), r["n"], of[r["pattern"]]) for r in got if r["hits"] is not None)
    if rows:
        model.weights, model.bias = regress(rows, len(lexicon))
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with out_col: how likely the whole text is toxic, 0 to 1. Null and empty texts score as texts without an entry."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != out_col] + [T.StructField(out_col, T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        claim("toxicity", int)
        for batch in slices(batches):
            scores = pa.array([model.score(x) for x in batch.column(text_col).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in schema.fields[:-1]] + [scores], names=schema.names)

    return docs.select(*schema.names[:-1]).mapInArrow(run, schema)
