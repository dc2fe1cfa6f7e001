"""Line deduplication that returns keep bitmaps.

Lines go out as 128-bit hashes of their keys, range-partitioned by hash and document and sorted by
position, so a hot line spreads over as many partitions as its occurrences need. One streaming pass over
each partition sees the occurrences of a hash one after another. A run that lies within a partition is decided on
the spot; the runs at a partition's edges, two as a rule, leave a partial count of documents, which are added up and
broadcast. What comes back is a compressed bitmap per document, never text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import SPACES, append_columns, ascii_lower, fresh, materialise, position, quoted


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_hashes(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``doc_id, text_hash, pos, h1, h2``: a row for each line whose key has ``min_chars`` code points or more."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    lines = df.select(F.col(quoted(id_col)).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    return keyed.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


_OCCURRENCE = ["doc_id", "text_hash", "pos", "h1", "h2"]
#: What a row of the pass says: a line to drop, one that the totals decide, a partial count with its first occurrence.
DROPPED, PENDING, COUNT = 0, 1, 2
#: Rows of an undecided run that are held; a longer one is left to the totals.
HELD_ROWS = 100_000


class _Run:
    """The run of one hash that is still open while a sorted partition goes by."""

    def __init__(self, min_docs: int, keep_first: bool):
        self.min_docs, self.keep_first = min_docs, keep_first
        self.key = self.last = self.first = None
        self.docs = self.rows = 0
        self.torn = True  # may have begun in another partition, as the first run does
        self.held: list[pa.RecordBatch] = []

    def open(self, key: tuple, torn: bool) -> None:
        self.key, self.torn, self.docs, self.rows, self.first, self.held = key, torn, 0, 0, None, []

    def add(self, rows: pa.RecordBatch, docs: int) -> Iterator[pa.RecordBatch]:
        if self.first is None:
            self.first = rows.slice(0, 1)
            if self.keep_first and not self.torn:
                rows = rows.slice(1)
        self.docs += docs
        self.held.append(rows)
        self.rows += len(rows)
        if self.torn:
            yield from self._flush(PENDING)
        elif self.docs >= self.min_docs:
            yield from self._flush(DROPPED)
        elif self.rows > HELD_ROWS:
            self.torn = True
            yield from self._flush(PENDING)

    def _flush(self, kind: int) -> Iterator[pa.RecordBatch]:
        yield from (_told(b, kind) for b in self.held if len(b))
        self.held, self.rows = [], 0

    def close(self, at_end: bool) -> Iterator[pa.RecordBatch]:
        if self.key is not None and (at_end or self.torn):
            yield from self._flush(PENDING)
            yield _told(self.first, COUNT, self.docs)


def _told(b: pa.RecordBatch, kind: int, docs: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), kind, np.int8)), pa.array(np.full(len(b), docs, np.int64))], names=[*_OCCURRENCE, "told", "docs"])


def _stream(min_docs: int, keep_first: bool):
    """Over one sorted partition: lines to drop, rows of runs at its edges, and those runs' counts of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Run(min_docs, keep_first)
        for b in batches:
            if not len(b):
                continue
            h1, h2, th = (b.column(n).to_numpy() for n in ("h1", "h2", "text_hash"))
            ids = b.column("doc_id").dictionary_encode()
            ident = ids.indices.fill_null(-1).to_numpy()
            new_run = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            new_doc = new_run | np.r_[True, (th[1:] != th[:-1]) | (ident[1:] != ident[:-1])]
            head = (h1[0], h2[0]), (b.column("doc_id")[0].as_py(), th[0])
            if state.key == head[0]:
                new_run[0] = False
                new_doc[0] = state.last != head[1]
            starts = np.flatnonzero(new_run)
            # what continues the open run
            upto = int(starts[0]) if len(starts) else len(b)
            if upto:
                yield from state.add(b.slice(0, upto), int(new_doc[:upto].sum()))
            if len(starts):
                yield from state.close(False)
                # runs that begin and end here, save the partition's first: decided at once
                lone = starts[:-1]
                if len(lone):
                    docs = np.add.reduceat(new_doc[: starts[-1]].astype(np.int64), lone)
                    if state.key is None:
                        state.open((h1[lone[0]], h2[lone[0]]), True)
                        end = int(starts[1])
                        yield from state.add(b.slice(int(lone[0]), end - int(lone[0])), int(docs[0]))
                        yield from state.close(False)
                        docs[0] = 0
                    drop = np.repeat(docs >= min_docs, np.diff(starts))
                    if keep_first:
                        drop[lone - lone[0]] = False
                    if drop.any():
                        yield _told(b.take(pa.array(np.flatnonzero(drop) + lone[0])), DROPPED)
                at = int(starts[-1])
                state.open((h1[at], h2[at]), state.key is None)
                yield from state.add(b.slice(at), int(new_doc[at:].sum()))
            state.last = (b.column("doc_id")[len(b) - 1].as_py(), th[-1])
        yield from state.close(True)

    return run


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``doc_id, text_hash, pos``: the lines to drop, those whose key is in ``min_docs`` documents or more.

    With ``keep_first`` the first occurrence in order of document and position stays. Documents are told apart by
    id and text, so rows that repeat both count as one document and lose the same lines, while rows that share an id, or have
    none, and differ in their texts are documents of their own. Null texts are one empty line; lines with an empty key
    stay where ``min_chars`` is 1 or more. An empty table gives none.
    """
    lines = materialise(line_hashes(df, id_col, text_col, min_chars), "line-hashes")
    # equal hash, document and text never lie in two partitions, so counts of documents add up
    spread = lines.repartitionByRange(F.col("h1"), F.col("h2"), F.col("doc_id"), F.col("text_hash")).sortWithinPartitions("h1", "h2", "doc_id", "text_hash", "pos")
    schema = T.StructType([lines.schema[c] for c in _OCCURRENCE] + [T.StructField("told", T.ByteType()), T.StructField("docs", T.LongType())])
    seen = materialise(spread.select(*_OCCURRENCE).mapInArrow(_stream(min_docs, keep_first), schema), "line-runs")
    # two rows a partition or a little more
    totals = seen.filter(F.col("told") == COUNT).groupBy("h1", "h2").agg(F.sum("docs").alias("total"), F.min(F.struct("doc_id", "text_hash", "pos")).alias("first"))
    decided = seen.filter(F.col("told") == PENDING).join(F.broadcast(totals.filter(F.col("total") >= min_docs)), ["h1", "h2"])
    if keep_first:
        decided = decided.filter(~F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("first")))
    return seen.filter(F.col("told") == DROPPED).select("doc_id", "text_hash", "pos").unionAll(decided.select("doc_id", "text_hash", "pos"))


def keep_bitmaps(drops: DataFrame) -> DataFrame:
    """``doc_id, text_hash, bitmap``: for each document that loses lines, its zlib-compressed keep bits up to the last lost line.

    Rows that repeat count once. No row for documents that lose nothing; none at all for an empty table.
    """

    def pack(positions: list[int]) -> bytes:
        keep = np.ones((max(positions) // 8 + 1) * 8, bool)
        keep[positions] = False
        return zlib.compress(np.packbits(keep).tobytes())

    def make():
        return lambda b: [pa.array([pack(p) for p in b.column(2).to_pylist()], pa.binary())]

    gathered = drops.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("positions"))
    return append_columns(gathered, [T.StructField("bitmap", T.BinaryType())], make).drop("positions")


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with ``text_col`` cut to the kept lines, and ``n_lines``, ``n_dropped`` (long). Null texts stay null, with one line."""
    own_id, own_hash, bits, text_hash = fresh(df, "line_id", "line_hash", "line_bitmap", "line_text")
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    named = bitmaps.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("bitmap").alias(bits))
    joined = df.withColumn(text_hash, F.xxhash64(text)).join(named, F.col(quoted(id_col)).eqNullSafe(F.col(own_id)) & (F.col(text_hash) == F.col(own_hash)), "left")
    wide = joined.select(*(F.col(quoted(c)) for c in df.columns), bits)
    at = position(df, text_col)

    def cut(t: str | None, bitmap: bytes | None):
        if bitmap is None:
            return t, (t or "").count("\n") + 1, 0
        lines = (t or "").split("\n")
        keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)].astype(bool)
        keep = np.r_[keep, np.ones(len(lines) - len(keep), bool)]
        return "\n".join(x for x, k in zip(lines, keep.tolist(), strict=True) if k), len(lines), int((~keep).sum())

    def make():
        def step(b: pa.RecordBatch) -> list:
            rows = [cut(t, m) for t, m in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]

        return step

    fields = [T.StructField(df.columns[at], T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    return append_columns(wide, fields, make).drop(bits)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` without the lines that ``dropped_lines`` names, and ``n_lines``, ``n_dropped``, which replace columns of those names.

    Every row stays, those with null or empty texts unchanged; repeated rows lose the same lines; an empty table stays empty.
    """
    drops = dropped_lines(df, id_col, text_col, **options)
    return apply_bitmaps(df, keep_bitmaps(drops), id_col, text_col)


def digests(df: DataFrame) -> DataFrame:
    """The digest columns of ``deduplicate``: a row per row, a null text counting as one empty line."""
    out = deduplicate(df.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: A document is an id and a text; every row gives a row.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, doc_id, md5(text) AS h, string_split(text, chr(10)) AS ls FROM d),
l AS (SELECT r, doc_id, h, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM s),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || h) >= 10)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE f.key IS NOT NULL) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY r
"""
