"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans.

Candidates are what the four base patterns match, valid or not, and what two
looser patterns add (addresses with the signs spelled out, local phone
numbers). Six labelers vote for, against or abstain on each. The gazetteers
are public numbering plans (issuers of cards, country and area codes, blocks
of addresses for special use) and, for email, the last parts of domains that
the table's own addresses have in some number. Counts of the vote patterns
over the whole table, at most 3^6 for each kind, are what
expectation-maximisation needs to estimate each labeler's reliability without
any truth; its posteriors train a logistic span classifier on the votes, the
kind and the shape of the span: its length, its parts, what stands beside it.
Valid base matches always stay; the classifier decides on the others.

Everything that touches a text is an expression over its row. Positions come
from splitting the text at the pattern: the pieces and the matches alternate,
and their lengths in characters add up, some hundred matches at a time; what
stands before a match is carried along. Possessive quantifiers, and looking
behind where only the start of a run can begin a match, keep the patterns
linear in the text; they match what the plain patterns match.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{LOCAL}){LOCAL}++ ?(?:\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\bdot\b) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+"}
CUES = {
    "email": ("mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "address", "host", "server", "client", "peer", "adresse"),
    "card": ("card", "visa", "credit", "debit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact", "anruf", "llam", "appel"),
}
AGAINST = ("version", "release", "isbn", "order", "invoice", "serial", "part no", "ticket", "build", "token", "password", "key", "sha", "md5", "example")
#: Fixed values of public plans. First digits of card issuers.
ISSUERS = r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3[0689]|35|6(?:011|4[4-9]|5))"
#: Country codes of telephone numbers: one, two, or three digits.
COUNTRIES = r"^\+ ?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[7-9]|8[0578]|9[679])[0-9])"
#: Area codes and exchanges of ten-digit numbers.
AREAS = r"^\(?[2-9][0-8][0-9]\)?[ .-]?[2-9][0-9]{2}"
#: Blocks of addresses that no host on the open net has.
RESERVED = r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
#: The last part of a domain is known if so many addresses in the table have it, and so large a share of them.
LEAST_KNOWN, KNOWN_SHARE = 3, 0.001
CHUNK = 256
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
VOTERS = ("regex", "cue", "against", "edges", "form", "gazetteer")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes; the last digit counts once, the one before it doubled, and so on."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return x.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    n = F.length(digits(x))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(digits(x))).otherwise(False)
    return (n >= 9) & (n <= 15)


SPAN = "struct<start:int,kind:int,end:int,match:string,before:string,after:string>"


def matches(text: Column, pattern: str, kind: str, needs: Column | None) -> Column:
    """array<SPAN> of the leftmost non-overlapping matches, in characters from 0, end exclusive; before are up to 40 characters, after is one."""
    number = KINDS.index(kind)
    none = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, x: Column) -> Column:
        before = F.right(F.concat(state["tail"], x["piece"]), F.lit(40))
        start = state["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), x["match"].alias("match"), before.alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.right(F.concat(before, x["match"]), F.lit(40)).alias("tail"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def some(state: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(state["at"].alias("at"), state["tail"].alias("tail"), none.alias("spans")), step)
        return let(inner, lambda i: F.struct(i["at"].alias("at"), i["tail"].alias("tail"), F.concat(state["spans"], F.array(i["spans"])).alias("spans")))

    def located(both: Column) -> Column:
        found, pieces = both["found"], both["pieces"]
        after = lambda i: F.left(F.concat(F.get(pieces, i + 1), F.coalesce(F.get(found, i + 1), F.lit(""))), F.lit(1))
        pairs = F.transform(found, lambda m, i: F.struct(F.get(pieces, i).alias("piece"), m.alias("match"), after(i).alias("after")))
        chunks = let(pairs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda c: F.slice(p, c * CHUNK + 1, F.lit(CHUNK))))
        return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<array<{SPAN}>>").alias("spans")), some, lambda s: F.flatten(s["spans"]))

    spans = let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces")), located)
    there = text.rlike(pattern) if needs is None else needs & text.rlike(pattern)
    return F.when(there, spans).otherwise(none)


def any_of(x: Column, words: tuple[str, ...], left: str = r"\b") -> Column:
    return F.lower(x).rlike(left + "(?:" + "|".join(words) + ")")


def votes(span: Column, base: bool) -> Column:
    """One vote in (-1, 0, 1) per labeler of VOTERS; that of the gazetteer for email is taken once the table's domains are known."""
    x, before, after = span["match"], span["before"], span["after"]
    by_kind = lambda f: F.when(span["kind"] == 0, f("email")).when(span["kind"] == 1, f("ip")).when(span["kind"] == 2, f("card")).otherwise(f("phone"))
    sign = lambda c: F.when(c, 1).otherwise(-1)
    shape = {"email": x.rlike(r"^[A-Za-z0-9]"), "ip": ~x.rlike(r"(?:^|\.)0[0-9]|^0\."), "card": x.rlike("^[3-6]") & F.length(digits(x)).between(13, 16), "phone": F.length(digits(x)).between(10, 13)}
    known = {"email": F.lit(0), "ip": sign(~x.rlike(RESERVED)), "card": sign(digits(x).rlike(ISSUERS)), "phone": sign(x.rlike(COUNTRIES) | x.rlike(AREAS))}
    return F.struct(
        (sign(by_kind(lambda k: valid(k, x))) if base else F.lit(0)).alias("regex"),
        F.when(by_kind(lambda k: any_of(before, CUES[k])), 1).otherwise(0).alias("cue"),
        F.when(any_of(before, AGAINST), -1).otherwise(0).alias("against"),
        sign(before.rlike(r"(?:^|[\s(\[<\"':,;])$") & after.rlike(r"^(?:$|[\s)\]>\"':,;.!?])")).alias("edges"),
        sign(by_kind(lambda k: shape[k])).alias("form"),
        by_kind(known.get).alias("gazetteer"),
    )


def shape_of(span: Column) -> Column:
    """What the classifier sees of a span beside the votes, as the digits of a number: its length in eighths, the number of its parts, whether it starts and ends a line, whether a colon stands before."""
    x = span["match"]
    parts = F.regexp_count(x, F.lit(r"[^A-Za-z0-9]+"))
    flag = lambda c: F.when(c, 1).otherwise(0)
    return (
        F.least(F.floor(F.length(x) / 8), F.lit(3)) + 4 * F.least(parts, F.lit(3)) + 16 * flag(span["before"].rlike(r"(?:^|\n)$")) + 32 * flag(span["after"].rlike(r"^(?:$|\n)")) + 64 * flag(span["before"].rlike(r":\s*$"))
    ).cast("int")


def shape_features(shape: int) -> list[float]:
    return [*(float(shape % 4 == k) for k in range(1, 4)), *(float(shape // 4 % 4 == k) for k in range(1, 4)), *(float(shape >> b & 1) for b in (4, 5, 6))]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base and more of docs (doc_id, text): arrays of spans with their votes, shape, and for email the last part of the domain."""
    text, digit = F.col("text"), F.col("text").rlike("[0-9]")
    needs = {k: F.col("text").contains(v) if k in NEEDS else digit for k, v in ((k, NEEDS.get(k)) for k in KINDS)}
    spans = F.concat(*(matches(text, BASE[k], k, needs[k]) for k in KINDS))
    # Only what has the digits of a card, or the parts of an address, is worth a vote if it isn't valid.
    likely = lambda s: (s["kind"] != 2) | F.length(digits(s["match"])).between(12, 19)
    looser = F.concat(matches(text, LOOSE["email"], "email", text.contains("dot")), matches(text, LOOSE["phone"], "phone", digit))
    found = docs.withColumn("base", F.filter(spans, likely)).withColumn("loose", looser)
    apart = F.when(F.size("loose") == 0, F.col("loose")).otherwise(F.filter("loose", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    found = found.withColumn("loose", apart)
    last = lambda s: F.when(s["kind"] == 0, F.lower(F.regexp_extract(s["match"], r"([A-Za-z0-9-]+)$", 1)))
    voted = lambda c, base: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), votes(s, base).alias("votes"), shape_of(s).alias("shape"), last(s).alias("last")))
    return found.select("doc_id", voted("base", True).alias("base"), voted("loose", False).alias("more"))


def known_domains(voted: DataFrame) -> list[str]:
    """Last parts of domains that enough addresses of the table have; at most one in KNOWN_SHARE, sorted."""
    seen = voted.select(F.explode("base").alias("c")).where("c.kind = 0").groupBy("c.last").count()
    total = seen.agg(F.sum("count")).first()[0] or 0
    return sorted(r["last"] for r in seen.where(F.col("count") >= max(LEAST_KNOWN, KNOWN_SHARE * total)).collect())


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> tuple[list[float], list]:
    """Posterior of each (kind, votes, count), and P(vote | class) per labeler, by expectation-maximisation from the majority vote."""
    posterior = [1 / (1 + math.exp(-sum(v))) for _, v, _ in patterns]
    tables: list = []
    for _ in range(rounds):
        mass = [sum(p * n for p, (_, _, n) in zip(posterior, patterns)), sum((1 - p) * n for p, (_, _, n) in zip(posterior, patterns))]
        tables = []
        for j in range(len(VOTERS)):
            counts = [{-1: 1.0, 0: 1.0, 1: 1.0} for _ in range(2)]
            for p, (_, v, n) in zip(posterior, patterns):
                counts[1][v[j]] += p * n
                counts[0][v[j]] += (1 - p) * n
            tables.append([{k: x / sum(c.values()) for k, x in c.items()} for c in counts])
        prior = math.log((mass[0] + 1) / (mass[1] + 1))
        odds = [prior + sum(math.log(t[1][x] / t[0][x]) for t, x in zip(tables, v)) for _, v, _ in patterns]
        posterior = [1 / (1 + math.exp(-max(-30, min(30, o)))) for o in odds]
    return posterior, tables


def features(kind: int, v: tuple[int, ...], shape: int) -> list[float]:
    return [1.0, *map(float, v), *(float(kind == k) for k in range(1, len(KINDS))), *shape_features(shape)]


def fit(patterns: list, posterior: dict, rounds: int = 400, decay: float = 1e-3) -> list[float]:
    """Weights of a logistic regression on the soft labels of (kind, votes), by gradient steps on rows (kind, votes, shape, count), weighed by the root of their counts."""
    import numpy as np

    if not patterns:
        return [0.0] * len(features(0, (0,) * len(VOTERS), 0))
    x = np.array([features(k, v, s) for k, v, s, _ in patterns])
    y, n = np.array([posterior[k, v] for k, v, _, _ in patterns]), np.sqrt(np.array([float(c) for *_, c in patterns]))
    n /= n.sum()
    weight = np.zeros(x.shape[1])
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30))) - y
        weight = weight - 2.0 * (decay * weight + (n * off) @ x)
    return weight.tolist()


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans of every row: arrays of (start, kind, end), sorted; kind is a place in KINDS.

    base are the valid matches of the four patterns; spans has them and what
    the classifier adds. Positions count characters of the whole text, of any
    length. Null and empty texts have no spans; repeated rows give repeated
    results, null ids stay; an empty table gives an empty result. Other columns
    are ignored.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    voted = stored(candidates(chosen), "pii")
    domains = known_domains(voted)
    gazetteer = lambda c: F.when(c["kind"] == 0, F.when(c["last"].isin(domains), 1).otherwise(-1)).otherwise(c["votes"]["gazetteer"])
    vote = lambda c, v: gazetteer(c) if v == "gazetteer" else c["votes"][v]
    each = voted.select(F.explode(F.concat("base", "more")).alias("c"))
    counted = each.select("c.kind", *(vote(F.col("c"), v).alias(v) for v in VOTERS), "c.shape").groupBy("kind", *VOTERS, "shape").count()
    patterns = sorted((r["kind"], tuple(r[v] for v in VOTERS), r["shape"], r["count"]) for r in counted.collect())  # at most 4 * 3^6 * 128
    by_votes: dict = {}
    for k, v, _, n in patterns:
        by_votes[k, v] = by_votes.get((k, v), 0) + n
    rows = [(k, v, n) for (k, v), n in sorted(by_votes.items())]
    posterior = dict(zip(((k, v) for k, v, _ in rows), reliabilities(rows)[0]))
    weight = fit(patterns, posterior)
    base_features = 1 + len(VOTERS) + len(KINDS) - 1

    def accepted(c: Column) -> Column:
        score = F.lit(weight[0])
        for w, v in zip(weight[1:], VOTERS):
            score = score + F.lit(w) * vote(c, v)
        for w, k in zip(weight[1 + len(VOTERS) :], range(1, len(KINDS))):
            score = score + F.when(c["kind"] == k, F.lit(w)).otherwise(0.0)
        table = [sum(w * f for w, f in zip(weight[base_features:], shape_features(shape))) for shape in range(128)]
        return score + F.get(F.array(*map(F.lit, table)), c["shape"]) >= 0

    is_valid = lambda c: c["votes"]["regex"] == 1
    plain = lambda a: F.array_sort(F.transform(a, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))
    spans = F.concat(F.filter("base", lambda c: is_valid(c) | accepted(c)), F.filter("more", accepted))
    return voted.select("doc_id", plain(F.filter("base", is_valid)).alias("base"), plain(spans).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
