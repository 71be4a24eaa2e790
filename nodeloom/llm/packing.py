"""Packing documents into sequences of a fixed length, in bounded space.

Each partition keeps a fixed number of open windows. A document goes where it
fits best; if it fits nowhere and all windows are open, the fullest is topped
up with its beginning and given out, and the rest is placed anew. What is left
open at the end of a partition is merged with what other partitions left, some
of them at a time, by the same rule. The last windows fill one another up, and
the very last is cut into sequences whose lengths are powers of two.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

#: Partitions whose open windows meet in one task.
FAN_IN = 32
_SCHEMA = "doc_id {id}, start long, token_ids binary, doc_tokens long, sequence_id long, offset long, origin long, window int"


#: Letters beyond ASCII that are one character in NFC, and whose lower case is one character whatever stands around them.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"


def latin_pieces(spec: str):
    """A function that cuts a word of printable ASCII and LATIN as the tokenizer does before its merges, into pieces as its model takes them; for other words it gives None. None itself if the tokenizer isn't of the kind whose rules are known here: NFC and lower case, the matches of one pattern, bytes as characters."""
    parts = json.loads(spec)
    normal, before = parts.get("normalizer") or {}, parts.get("pre_tokenizer") or {}
    split, *rest = before.get("pretokenizers") or [{}]
    plain = [x.get("type") for x in normal.get("normalizers") or []] == ["NFC", "Replace", "Lowercase"] and normal["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    cut = split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in rest] == [("ByteLevel", False, False)]
    pattern = (split.get("pattern") or {}).get("Regex", "") if plain and cut else ""
    if not pattern or not pattern.isascii() or re.search(r"\\(?!p\{[LN]\}|s)", pattern):
        return None
    find = re.compile(pattern.replace(r"\p{L}", f"a-z{LATIN}").replace(r"\p{N}", "0-9")).findall
    known = re.compile(f"[!-~{LATIN}]+").fullmatch
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow after them
    table = {chr(b): chr(b) for b in shown} | {chr(b): chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    table = str.maketrans(table)

    def pieces(word: bytes) -> list[str] | None:
        text = word.decode()
        if not known(text):
            return None
        found = find(text.lower())
        return found if text.isascii() else [p.encode().decode("latin-1").translate(table) for p in found]

    return pieces


class Words(dict):
    """Stretch of text without ASCII white space, as UTF-8 -> the ids of its tokens as little-endian unsigned 32-bit integers.

    For tokenizers whose tokens never span white space: a text's ids are then
    those of its stretches, and frequent stretches are tokenized once. Most
    others are cut into pieces, which repeat more often, and given straight to
    the library's model; it is the whole tokenizer that takes the rest.
    """

    def __init__(self, spec: str, keep_bytes: int = 50_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cut, self.model = latin_pieces(spec), self.tokenizer.model
        letters = "abcdefghijklmnopqrstuvwxyz" * 4
        self.whole = self.cut is not None and self.cut(letters.encode()) == [letters]  # letters stay together
        self.pieces: dict[str, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # what was remembered before, so that frequent words outlast a full memory
        self.keep_bytes, self.held = keep_bytes, 0

    def piece(self, p: str) -> bytes:
        found = self.pieces.get(p)
        if found is None:
            found = self.pieces[p] = array("I", [t.id for t in self.model.tokenize(p)]).tobytes()
            self.held += 150
        return found

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            if self.whole and word.isalpha():  # ASCII letters
                found = self.piece(word.lower().decode())
            else:
                pieces = self.cut(word) if self.cut else None
                found = array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes() if pieces is None else b"".join(map(self.piece, pieces))
        if self.held > self.keep_bytes:
            self.older = dict(self)
            self.clear()
            self.pieces.clear()
            self.held = 0
        self[word] = found
        self.held += 180
        return found

    def encode(self, text: bytes, chunk: int = 1 << 20) -> bytes:
        out, at = [], 0
        while at < len(text):
            to = at + chunk
            while 0 < to < len(text) and text[to] not in b" \t\n\v\f\r":
                to += 1
            out.append(b"".join(map(self.__getitem__, text[at:to].split())))
            at = to
        return b"".join(out)


_words: dict[bytes, Words] = {}


def words_of(spec: str) -> Words:
    """One per Python worker, so that what it has learnt is kept from task to task."""
    key = hashlib.sha256(spec.encode()).digest()
    if key not in _words:
        _words.clear()
        _words[key] = Words(spec)
    return _words[key]


class Packer:
    """Windows that are open in one partition. Pieces are (doc_id, start, ids, doc_tokens), ids as bytes; what is full goes to out as (pieces)."""

    def __init__(self, length: int, windows: int):
        self.size, self.most = 4 * length, windows
        self.open: list[list] = []  # [bytes used, pieces]
        self.out: list[list[tuple]] = []

    def place(self, pieces: list[tuple]) -> None:
        """Places the pieces together where they fit best."""
        need = sum(len(p[2]) for p in pieces)
        while need:
            if need >= self.size:  # a window of its own
                head, pieces = cut_at(pieces, self.size)
                self.out.append(head)
                need -= self.size
                continue
            fits = [w for w in self.open if self.size - w[0] >= need]
            if fits:
                self.put(max(fits, key=lambda w: w[0]), pieces, need)
                return
            if len(self.open) < self.most:
                self.open.append([need, list(pieces)])
                return
            fullest = max(self.open, key=lambda w: w[0])
            gap = self.size - fullest[0]
            head, pieces = cut_at(pieces, gap)
            need -= gap
            self.put(fullest, head, gap)

    def put(self, window: list, pieces: list[tuple], n: int) -> None:
        window[0] += n
        window[1] += pieces
        if window[0] == self.size:
            self.out.append(window[1])
            self.open = [w for w in self.open if w is not window]

    def close(self) -> None:
        """Fills the fullest windows from the emptiest; the last is cut into powers of two."""
        while len(self.open) > 1:
            emptiest = min(self.open, key=lambda w: w[0])
            self.open = [w for w in self.open if w is not emptiest]
            fullest = max(self.open, key=lambda w: w[0])
            head, rest = cut_at(emptiest[1], min(self.size - fullest[0], emptiest[0]))
            self.put(fullest, head, sum(len(p[2]) for p in head))
            if rest:
                self.open.append([sum(len(p[2]) for p in rest), rest])
        for used, pieces in self.open:
            for bit in reversed(range((used // 4).bit_length())):
                if used // 4 >> bit & 1:
                    head, pieces = cut_at(pieces, 4 << bit)
                    self.out.append(head)
        self.open = []


def cut_at(pieces: list[tuple], n: int) -> tuple[list[tuple], list[tuple]]:
    """The first n bytes of the pieces, and the rest."""
    head: list[tuple] = []
    for i, (doc, start, ids, total) in enumerate(pieces):
        if len(ids) > n:
            return [*head, *([(doc, start, ids[:n], total)] if n else [])], [(doc, start + n // 4, ids[n:], total), *pieces[i + 1 :]]
        head.append((doc, start, ids, total))
        n -= len(ids)
    return head, []


def _rows(packer: Packer, origin: int, round_: int, given: int, last: bool):
    """Rows of what the packer has given out, numbered from given on, and if last those of its open windows."""
    rows = []
    for number, pieces in enumerate(packer.out, given):
        at = 0
        for doc, start, ids, total in pieces:
            rows.append((doc, start, ids, total, round_ << 58 | origin << 32 | number, at // 4, origin, None))
            at += len(ids)
    packer.out = []
    if last:
        for number, (_, pieces) in enumerate(packer.open):
            at = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, ids, total, None, at // 4, origin, number))
                at += len(ids)
    return rows


def _table(rows: list[tuple], schema):
    import pyarrow as pa

    columns = zip(*rows) if rows else [[]] * len(schema)
    return [pa.array(c, f.type) for c, f in zip(columns, schema)]


def _arrow(id_type):
    import pyarrow as pa

    return pa.schema([("doc_id", id_type), ("start", pa.int64()), ("token_ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("origin", pa.int64()), ("window", pa.int32())])


def pack(docs: DataFrame, spec: str, length: int = 4096, end_id: int | None = 2, windows: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of the documents in sequences of length tokens: doc_id, start, token_ids, doc_tokens, sequence_id, offset.

    spec: the JSON of a tokenizer whose tokens never span white space; end_id
    ends every document. Each token lies in one piece, token_ids as
    little-endian unsigned 32-bit integers, start tokens after the beginning
    of its document of doc_tokens. Pieces of a sequence follow one another
    from offset 0 on. All sequences have length tokens, but for the last of
    all, which have as many as the powers of two that add up to what is left:
    nothing is padded. length must be a power of two.

    A null or empty text is the end alone, or nothing without end_id. Rows
    with null or repeated ids are documents of their own. Texts may be of any
    length; an empty table gives an empty result; other columns are left out.
    Which documents share a sequence depends on how the table is cut into
    partitions.
    """
    if length & (length - 1) or length < 1:
        raise ValueError("length must be a power of two")
    shipped = docs.sparkSession.sparkContext.broadcast(spec)  # a vocabulary file, some megabytes whatever the input
    end = b"" if end_id is None else end_id.to_bytes(4, "little")
    schema = _SCHEMA.format(id=docs.schema[id_col].dataType.simpleString())

    def first(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        words, packer, origin, given = words_of(shipped.value), Packer(length, windows), TaskContext.get().partitionId(), 0
        kind = None
        for batch in slices(batches):
            kind = _arrow(batch.column("doc_id").type)
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = words.encode((text or "").encode()) + end
                packer.place([(doc, 0, ids, len(ids) // 4)])
            n = len(packer.out)
            yield pa.RecordBatch.from_arrays(_table(_rows(packer, origin, 0, given, False), kind), schema=kind)
            given += n
        if kind is not None:
            yield pa.RecordBatch.from_arrays(_table(_rows(packer, origin, 0, given, True), kind), schema=kind)

    def merged(round_: int, last: bool):
        def merge(table):
            import pyarrow as pa

            kind, held = _arrow(table.column("doc_id").type), {}
            rows = zip(*(table.column(c).to_pylist() for c in ("origin", "window", "offset", "doc_id", "start", "token_ids", "doc_tokens")))
            for origin, window, _, *piece in sorted(rows, key=lambda r: r[:3]):
                held.setdefault((origin, window), []).append(tuple(piece))
            packer, group = Packer(length, windows), min(held)[0] // FAN_IN
            for pieces in sorted(held.values(), key=lambda p: -sum(len(x[2]) for x in p)):
                packer.place(pieces)
            if last:
                packer.close()
            return pa.Table.from_arrays(_table(_rows(packer, group, round_, 0, True), kind), schema=kind)

        return merge

    packed = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(first, schema), "packed")
    done, open_ = packed.where("window IS NULL"), packed.where("window IS NOT NULL")
    origins, round_ = (open_.agg(F.max("origin")).first()[0] or 0) + 1, 0
    while round_ == 0 or origins > 1:
        origins, round_ = -(-origins // FAN_IN), round_ + 1
        met = stored(open_.groupBy(F.floor(F.col("origin") / FAN_IN)).applyInArrow(merged(round_, origins == 1), schema), "packed")
        done, open_ = done.unionByName(met.where("window IS NULL")), met.where("window IS NOT NULL")
    return done.select("doc_id", "start", "token_ids", "doc_tokens", "sequence_id", "offset")
