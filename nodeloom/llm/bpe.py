"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The merges that are possible in a piece of text wait in a queue: one bucket
per merge rank, with the positions of the pair's left token in a linked list.
Three levels of bitmaps of 256 bits tell which buckets are filled: leaves of
256 ranks, a bit for each leaf above them, and a bit for each 256 leaves on
top. Ranks count by their order among the tokens, whatever their size. So the
lowest rank is found by three find-first-set steps, whatever the length of the
piece. Entries whose pair has changed since are skipped when they come up.
A piece of n bytes takes O(n log n) at worst, which keeps very long pieces
(a base64 blob, a line of one character) from taking quadratic time.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, fresh, slices


def load_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks from a file with a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


_after, _before = list(range(1, 257)), list(range(-1, 256))  # to be copied by short pieces


class Encoder(dict):
    """Piece of text -> its ids as little-endian unsigned 32-bit integers; remembers keep to 2 * keep pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 250_000):
        import regex

        super().__init__()
        self.older: dict[str, bytes] = {}  # what was remembered before, so that frequent pieces outlast a full memory
        self.keep, self.vocabulary = keep, dict(zip(ranks.values(), ranks.keys()))
        if any(bytes([b]) not in ranks for b in range(256)) or len(self.vocabulary) < len(ranks) or min(self.vocabulary) < 0 or max(self.vocabulary) >= 1 << 32 or len(ranks) > 1 << 24:
            raise ValueError("ranks must name every single byte, each of at most 2^24 tokens by a number of its own below 2^32")
        self.names = sorted(self.vocabulary)  # what a place in the order stands for
        plain = self.names[-1] == len(self.names) - 1
        self.ranks = ranks = ranks if plain else {self.vocabulary[r]: i for i, r in enumerate(self.names)}
        self.names = None if plain else self.names
        #: Two ids -> the rank of what they make together, for each way to cut a token in two.
        self.pairs = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.first = [[ranks.get(bytes([a, b])) for b in range(256)] for a in range(256)]  # the ranks of two bytes
        self.leaves = [0] * ((len(ranks) >> 8) + 1)  # all 0 between pieces
        self.stems = [0] * ((len(ranks) >> 16) + 1)
        self.bits = [1 << i for i in range(256)]
        # White space as Unicode has it: the module's own \s takes in four more control characters.
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            ids = self.merge(piece.encode())
            found = array("I", ids if self.names is None else map(self.names.__getitem__, ids)).tobytes()
        if len(self) >= self.keep:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = found
        return found

    def merge(self, piece: bytes) -> list[int]:
        """The places in the order of ranks of one piece's tokens: always the pair of lowest rank, of equal ones the leftmost, becomes one token."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n, get, leaves, stems, bits, first = len(piece), self.pairs.get, self.leaves, self.stems, self.bits, self.first
        ids = list(map(self.single.__getitem__, piece))
        waiting = [first[a][b] for a, b in zip(piece, piece[1:])]  # the rank of the pair that starts here
        waiting.append(None)
        after, before = (_after[:n], _before[: n + 1]) if n <= len(_after) else (list(range(1, n + 1)), list(range(-1, n)))
        buckets: dict = {}  # a position, or a heap of several
        top = 0
        for i, rank in enumerate(waiting):
            if rank is not None:
                if rank in buckets:
                    held = buckets[rank]
                    if held.__class__ is list:
                        held.append(i)
                    else:
                        buckets[rank] = [held, i]
                else:
                    buckets[rank] = i
                    leaf = rank >> 8
                    leaves[leaf] |= bits[rank & 255]
                    stems[leaf >> 8] |= bits[leaf & 255]
                    top |= bits[leaf >> 8]
        while top:
            stem = (top & -top).bit_length() - 1
            filled = stems[stem]
            leaf = (stem << 8) + (filled & -filled).bit_length() - 1
            word = leaves[leaf]
            low = word & -word
            rank = (leaf << 8) + low.bit_length() - 1
            i = buckets[rank]
            if i.__class__ is list:
                held, i = i, heappop(i)
                if len(held) == 1:
                    buckets[rank] = held[0]
            else:
                del buckets[rank]
                leaves[leaf] = word = word ^ low
                if not word:
                    stems[stem] = filled = filled & (filled - 1)
                    if not filled:
                        top &= top - 1
            if waiting[i] != rank:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            ids[i], waiting[j], before[k] = rank, None, i
            p = before[i]
            new = get(rank << 32 | ids[k]) if k < n else None
            waiting[i] = new
            if p >= 0:
                waiting[p] = left = get(ids[p] << 32 | rank)
                if left is not None:
                    if left in buckets:
                        held = buckets[left]
                        if held.__class__ is list:
                            heappush(held, p)
                        else:
                            buckets[left] = [held, p] if held < p else [p, held]
                    else:
                        buckets[left] = p
                        leaf = left >> 8
                        leaves[leaf] |= bits[left & 255]
                        stems[leaf >> 8] |= bits[leaf & 255]
                        top |= bits[leaf >> 8]
            if new is not None:
                if new in buckets:
                    held = buckets[new]
                    if held.__class__ is list:
                        heappush(held, i)
                    else:
                        buckets[new] = [held, i] if held < i else [i, held]
                else:
                    buckets[new] = i
                    leaf = new >> 8
                    leaves[leaf] |= bits[new & 255]
                    stems[leaf >> 8] |= bits[leaf & 255]
                    top |= bits[leaf >> 8]
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, memoryview(ids).cast("I").tolist()))


_encoders: dict[tuple, Encoder] = {}


def encoder(content: bytes, pattern: str) -> Encoder:
    """One per Python worker, so that what it has learnt is kept from task to task."""
    claim("bpe", _encoders.clear)
    key = (hashlib.sha256(content).digest(), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(load_ranks(content), pattern)
    return _encoders[key]


def _mapped(df: DataFrame, dropped: str, made: list[str], content: bytes, pattern: str, work) -> DataFrame:
    """df without the column dropped and with binary columns made, of which work(coder, value of dropped) gives one each."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in (*made, dropped)] + [T.StructField(m, T.BinaryType()) for m in made])
    shipped = df.sparkSession.sparkContext.broadcast(content)  # a vocabulary file, about a megabyte whatever the input

    def run(batches):
        import pyarrow as pa

        coder = encoder(shipped.value, pattern)
        for batch in slices(batches):
            out = zip(*(work(coder, x) for x in batch.column(dropped).to_pylist())) if batch.num_rows else [[]] * len(made)
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in schema.fields[: -len(made)]] + [pa.array(c, pa.binary()) for c in out], names=schema.names)

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """docs with text_col replaced by out_col: the ids of its whole text as little-endian unsigned 32-bit integers.

    ranks: the content of a rank file, with ranks of any size below 2^32;
    pattern: cuts a text into the pieces that are merged apart. A null or empty
    text has no ids; texts and pieces may be of any length; an empty table
    gives an empty result. Rows stay as they are otherwise, repeated ones and
    other columns too.
    """
    return _mapped(docs, text_col, [out_col], ranks, pattern, lambda coder, text: (coder.encode(text or ""),))


def decode(tokens: DataFrame, ranks: bytes, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """tokens with out_col added: the bytes that the ids stand for; null ids give none."""
    (copy,) = fresh([*tokens.columns, out_col], "ids")
    return _mapped(tokens.withColumn(copy, F.col(ids_col)), copy, [out_col], ranks, pattern, lambda coder, ids: (coder.decode(ids or b""),))


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """docs with text_col replaced by ids_col and out_col: encode() and then decode() of its ids, in one worker, so that a vocabulary is held once for each task."""

    def both(coder, text):
        ids = coder.encode(text or "")
        return ids, coder.decode(ids)

    return _mapped(docs, text_col, [ids_col, out_col], ranks, pattern, both)
