"""Byte-level BPE encoding in linear time, and decoding.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton finds, in one pass,
the longest vocabulary token that starts at each byte. The encoder walks from longest match to
longest match and backtracks to shorter prefixes when two neighbours could not have come out of the merges
next to each other. That test undoes the merges of both tokens in reverse order of rank and depends on
the two ids only, so it is memoised.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import cache
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import append_columns, position

#: Entries of a memo table, and bytes of the pieces in one, before it starts afresh; they affect speed only.
MEMO_ENTRIES, MEMO_BYTES, MEMO_PIECE = 150_000, 5_000_000, 256


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_plainly(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Textbook merging: join the neighbours of lowest rank, leftmost first, until none can be joined."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    top = len(ranks) + 1 << 8 if below is None else below
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], top), i) for i in range(len(parts) - 1))
        if rank >= top:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class _Memo(dict):
    """A dict that computes missing values and forgets everything when full."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, key):
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        value = self[key] = self._make(key)
        return value


class _PieceMemo(_Memo):
    """Bounded in bytes as well; long pieces, which hardly ever come twice, are not kept."""

    size = 0

    def __missing__(self, key):
        if len(key) > MEMO_PIECE:
            return self._make(key)
        if self.size > MEMO_BYTES:
            self.clear()
            self.size = 0
        value = super().__missing__(key)
        self.size += len(key) + len(value)
        return value


class MergeTables:
    """What the encoder needs of a vocabulary: each token's last merge and its longest proper prefix.

    Built once on the driver and sent to the executors; its size is that of the vocabulary file.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"vocabulary lacks the single bytes {missing[:5]}")
        self.ranks = ranks
        top = max(ranks.values()) + 1
        #: Flat arrays by id, -1 where there is nothing: the two halves, and the longest proper prefix that is a token.
        self.left, self.right, self.shorter = (array("i", [-1]) * top for _ in range(3))
        self.unreachable: set[int] = set()
        for token, rank in ranks.items():
            if len(token) == 1:
                self.left[rank] = self.right[rank] = rank
                continue
            parts = merge_plainly(token, ranks, rank)
            if len(parts) == 2:
                self.left[rank], self.right[rank] = ranks[parts[0]], ranks[parts[1]]
            elif len(merge_plainly(token, ranks)) == 1:
                raise ValueError(f"token {rank} is merged from tokens of higher rank")
            else:
                self.unreachable.add(rank)
        reachable = {t for t, r in ranks.items() if r not in self.unreachable}
        for token in reachable:
            for n in range(len(token) - 1, 0, -1):
                if token[:n] in reachable:
                    self.shorter[ranks[token]] = ranks[token[:n]]
                    break

    def by_id(self) -> list[bytes]:
        out = [b""] * len(self.left)
        for token, rank in self.ranks.items():
            out[rank] = token
        return out


@cache
def _plane_ranges(prop: str) -> str:
    """The characters of a Unicode property in the basic plane, as ranges for a character class."""
    have = regex.compile(rf"\p{{{prop}}}")
    inside = [bool(have.match(chr(c))) for c in range(0x10000)] + [False]
    edges = [c for c in range(0x10001) if inside[min(c, 0x10000)] != (c > 0 and inside[c - 1])]
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


class Splitter:
    """Finds the matches of a splitting pattern as the library does.

    Its ``\\s`` is the Unicode property White_Space, to which Python adds four control characters. Texts
    of the basic plane, nearly all, go through a pattern in which the properties are spelled out as character
    classes: the plain engine finds those two to three times faster.
    """

    def __init__(self, pattern: str):
        full = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self._full = regex.compile(full).findall
        plane = re.sub(r"\[[^\]]*\]", lambda m: re.sub(r"\\p\{(\w+)\}", lambda p: _plane_ranges(p[1]), m[0]), full)
        plane = re.sub(r"\\(p|P)\{(\w+)\}", lambda m: f"[{'^' * (m[1] == 'P')}{_plane_ranges(m[2])}]", plane)
        self._plane = re.compile(plane).findall
        self._beyond = re.compile("[\U00010000-\U0010ffff]").search

    def __call__(self, text: str) -> list[str]:
        return self._full(text) if not text.isascii() and self._beyond(text) else self._plane(text)


class ByteBpe:
    """Encoder and decoder of one vocabulary and one splitting pattern."""

    def __init__(self, tables: MergeTables, pattern: str):
        self._t = tables
        self._split = Splitter(pattern)
        self._bytes = tables.by_id()
        # the two halves in one integer
        self._pairs = {tables.left[r] << 32 | tables.right[r]: r for r, t in enumerate(self._bytes) if len(t) > 1 and tables.left[r] >= 0}
        self._length = array("i", map(len, self._bytes))
        self._shorter = tables.shorter
        self._widest = max(self._length)
        self._machine = ahocorasick.Automaton()
        for token, rank in tables.ranks.items():
            if rank not in tables.unreachable:
                self._machine.add_word(token.decode("latin-1"), (len(token), rank))
        self._machine.make_automaton()
        self._fits = _Memo(self._compatible)
        self._pieces = _PieceMemo(lambda piece: array("i", self.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes())

    def _compatible(self, pair: int) -> bool:
        """Whether merging the bytes of both tokens leaves exactly these two: undo the later merge
        on either side of the border, step by step; no merge across the border may come before it."""
        first, second, pairs = self._t.left, self._t.right, self._pairs
        left, right = pair >> 32, pair & 0xFFFFFFFF
        bound = 1 << 60
        while True:
            if pairs.get(left << 32 | right, bound) < bound:
                return False
            open_left, open_right = first[left] != left, first[right] != right
            if not open_left and not open_right:
                return True
            # of equal ranks the left one was merged first, so the right one is undone first
            if open_left and (left > right or not open_right):
                bound, left = left, second[left]
            else:
                bound, right = right + 1, first[right]

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern, as merging by rank gives them."""
        whole = self._t.ranks.get(piece)
        if whole is not None:
            return [whole]
        latin = piece.decode("latin-1")
        out = [hit[1][1] for hit in self._machine.iter_long(latin)]
        fits = self._fits
        for left, right in pairwise(out):
            if not fits[left << 32 | right]:
                return self._backtrack(latin)
        return out

    def _backtrack(self, latin: str) -> list[int]:
        """The walk with backtracking; ``dead`` marks the ends from which no walk reaches the end of the piece."""
        fits, shorter, length, widest = self._fits, self._shorter, self._length, self._widest
        longest, known = self._machine.iter_long, {}
        n, at, out, last = len(latin), 0, [], -1
        dead = bytearray(n + 1)
        token = known[0] = next(longest(latin[:widest]))[1][1]
        while True:
            end = at + length[token]
            if not dead[end] and (last < 0 or fits[last << 32 | token]):
                out.append(token)
                if end == n:
                    return out
                at, last = end, token
                token = known.get(at, -1)
                if token < 0:
                    token = known[at] = next(longest(latin[at : at + widest]))[1][1]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._pieces.__getitem__, self._split(text))), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return join_tokens(self._bytes, ids)


def join_tokens(tokens: list[bytes], ids: np.ndarray) -> bytes:
    if len(ids) and (ids.min() < 0 or ids.max() >= len(tokens)):
        raise ValueError("an id is outside the vocabulary")
    return b"".join(map(tokens.__getitem__, ids.tolist()))


_ready: dict[tuple, ByteBpe] = {}


def _codec(key: tuple, tables, pattern: str) -> ByteBpe:
    """One codec for each worker process and vocabulary."""
    if key not in _ready:
        _ready.clear()
        _ready[key] = ByteBpe(tables.value, pattern)
    return _ready[key]


def share(df: DataFrame, vocabulary: str):
    """Reads the vocabulary on the driver and broadcasts its tables (bounded by the file)."""
    return df.sparkSession.sparkContext.broadcast(MergeTables(read_ranks(vocabulary)))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))


def encode(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None, tables=None) -> DataFrame:
    """Adds ``out_col`` (array of int): the ids of the whole text; and with ``decoded_col`` (binary) the bytes that
    decoding those ids gives, by the same worker in the same pass.

    Null and empty texts give an empty array. Rows are independent, so repeated rows, ties, empty tables and
    any further columns need no rule; an existing column of an added name is replaced. A worker takes a few
    megabytes of text at a time, and a very long text whole.
    """
    shared = tables or share(df, vocabulary)
    at, key = position(df, text_col), (vocabulary, pattern)

    def make():
        codec = _codec(key, shared, pattern)

        def step(batch: pa.RecordBatch) -> list:
            rows = [codec.encode(t.as_py() or "") for t in batch.column(at)]
            back = [] if decoded_col is None else [pa.array(map(codec.decode, rows), pa.binary())]
            return [_lists(rows), *back]

        return step

    fields = [T.StructField(out_col, T.ArrayType(T.IntegerType()))]
    if decoded_col is not None:
        fields.append(T.StructField(decoded_col, T.BinaryType()))
    return append_columns(df, fields, make)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col`` (binary): the bytes of the ids. A null array gives null; an unknown id fails the task."""
    ranks = read_ranks(vocabulary)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    shared = df.sparkSession.sparkContext.broadcast(tokens)
    at = position(df, ids_col)

    def make():
        known = shared.value

        def step(batch: pa.RecordBatch) -> list:
            return [pa.array([join_tokens(known, r.values.to_numpy(zero_copy_only=False)) if r.is_valid else None for r in batch.column(at)], pa.binary())]

        return step

    return append_columns(df, [T.StructField(out_col, T.BinaryType())], make)


def digests(df: DataFrame) -> DataFrame:
    """The digest columns of a frame with ``ids`` and ``decoded``."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
