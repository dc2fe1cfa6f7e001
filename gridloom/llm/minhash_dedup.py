"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is the multiset of its five-word shingles, each weighted by its count and by an idf between 1 and 2.
Document frequencies are counted over all documents in a count-min sketch whose width follows the number of
documents; it is summed over partitions and broadcast. Improved consistent weighted sampling (Ioffe 2010) draws
``BANDS * ROWS`` samples, such that two documents agree in a sample with probability equal to their weighted Jaccard
similarity; bands of samples make buckets, and pairs from a bucket are verified on all their shingles.

Exact copies are gathered first, so a text counts once however often it is repeated. Of all texts only the samples are
stored; those in a bucket with others are read and shingled a second time. A bucket's members come to a task with their shingles, and all pairs of them are verified that are not connected yet; a pair counts in the first
band that it shares. Buckets of equal members are searched once. Buckets of more than a block are cut into parts:
members of a part meet each other and the bucket's two leaders, which joins what a large group of copies consists of;
then every part meets every other, save that members of the largest component do not meet each other. No
number of members, partners or candidates is cut off anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import fresh, materialise, quoted, release, slices, temporary
from gridloom.operators.components import connected_components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
#: Rows of the sketch; least and most binary digits of its width; entries of the tables that random variables are drawn from.
DEPTH, WIDTH_BITS, TABLE = 2, (20, 23), 1 << 16
#: Members, and shingles, of a part of a bucket; least share of agreeing samples of a pair that is read in full, more than
#: five standard deviations below what a linked pair shows.
BLOCK, BLOCK_SHINGLES, PROMISING = 2048, 2_000_000, 0.5
#: Pieces that the sketch is summed and read in.
PIECES = 64
#: Binary digits of the places of a bitmap of rows, bits of all bitmaps for each document, and bits at most.
PLACE_BITS, ROW_BITS, MOST_BITS = 16, 16, 1 << 28
#: Bytes of text shingled at once.
CHUNK = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts with A-Z lower-cased: document index and 64-bit hash of each five-word shingle, by document and hash,
    with repeats; and a 128-bit hash of each document's word sequence as two columns.

    A text of one to four words is one shingle; a text without words has none.
    """
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = _SPACE[raw]
    first = ~gap
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    content = np.zeros((len(texts), 2), _U)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, _U), content[:, 0], content[:, 1]
    ends = np.flatnonzero(gap & np.r_[False, ~gap[:-1]])
    length = ends - starts
    inside = np.arange(len(raw)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(raw)]))
    value = np.where(gap, _U(0), raw.astype(_U) + _U(1)) * _powers(int(np.diff(np.r_[0, starts, len(raw)]).max()) + 1, 0x9E3779B97F4A7C15)[inside]
    word = _mix(np.add.reduceat(value, starts) + length.astype(_U))
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(begin, starts, side="right") - 1
    n = np.bincount(doc, minlength=len(texts))
    place = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    for k, base in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
        np.add.at(content[:, k], doc, _mix(word + _U(k)) * _powers(int(n.max()), base)[place])
    content = _mix(content + n.astype(_U)[:, None])
    joined = np.zeros(len(word), _U)
    for k in range(WORDS):
        part = word[k:] * _U((0x9FB21C651E98DF25 * (2 * k + 1)) & (2**64 - 1))
        same = doc[k:] == doc[: len(word) - k]
        joined[: len(word) - k] += np.where(same, part, _U(0))
    full = place + WORDS <= n[doc]
    whole = (place == 0) & (n[doc] < WORDS)
    keep = np.flatnonzero(full | whole)
    doc, h = doc[keep], _mix(joined[keep])
    bits = len(texts).bit_length()
    order = np.argsort((doc.astype(_U) << _U(64 - bits)) | (h >> _U(bits)))
    return doc[order], h[order], content[:, 0], content[:, 1]


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of each distinct shingle of sorted input."""
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    return doc[new], h[new], np.diff(np.r_[new, len(h)])


def _cells(h: np.ndarray, width: int) -> list[np.ndarray]:
    mixed = _mix(h + _U(0x5851F42D4C957F2D))
    return [(mixed >> _U(24 * k)).astype(np.int64) & (width - 1) for k in range(DEPTH)]


class Weights:
    """idf of shingles by the sketch: 1 for one in every document, 2 for a rare one, in steps of 1/255.

    A cell holds its shingle's documents and its share of all others. What does not stand out from that share by three
    deviations cannot be told from a rare shingle and counts as one.
    """

    def __init__(self, sketch: np.ndarray, docs: int):
        self.table = np.empty(sketch.shape, np.uint8)
        for row, steps in zip(sketch, self.table, strict=True):
            mean, spread = row.mean(), np.sqrt(np.median(row) + 1)
            # in pieces, as the driver has little room beside the sketch
            for cells, out in zip(np.array_split(row, PIECES), np.array_split(steps, PIECES), strict=True):
                df = np.where(cells > mean + 3 * spread, cells - mean, np.float32(1)).clip(1, max(docs, 1))
                out[:] = np.round(255 * (1 - np.log(df) / np.log(max(docs, 2))))

    def idf(self, h: np.ndarray) -> np.ndarray:
        steps = np.maximum.reduce([row[c] for row, c in zip(self.table, _cells(h, self.table.shape[1]), strict=True)])
        return np.float32(1) + steps * np.float32(1 / 255)


def _random_tables() -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(20100)
    r, log_c, beta = rng.gamma(2, 1, TABLE), np.log(rng.gamma(2, 1, TABLE)), rng.random(TABLE)
    return tuple(x.astype(np.float32) for x in (r, 1 / r, beta, log_c - r))


_MULTIPLIERS = _mix(np.arange(1, BANDS * ROWS + 1).astype(_U)) | _U(1)


def samples(doc: np.ndarray, h: np.ndarray, log_weight: np.ndarray, n: int, tables: tuple[np.ndarray, ...]) -> np.ndarray:
    """``n x (BANDS * ROWS)`` samples as 32-bit identities; documents without shingles get zeros.

    Random variables of a shingle and sample come from tables, at a place that their hash gives. The shingle that
    minimises ln a = ln c - ln y - r is drawn, y being the weight rounded down on a random grid (r, beta). Its
    identity is 32 bits of its hash.
    """
    r, inverse, beta, rest = tables
    out = np.zeros((n, len(_MULTIPLIERS)), np.uint32)
    if not len(h):
        return out
    wide, short = _mix(h), h & _U(0xFFFFFFFF)
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    who = doc[begin]
    for k, m in enumerate(_MULTIPLIERS):
        at = ((wide * m) >> _U(48)).astype(np.intp)
        rk, bk = r[at], beta[at]
        log_a = rest[at] - rk * (np.floor(log_weight * inverse[at] + bk) - bk)
        bits = log_a.view(np.uint32)
        order = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
        key = (order.astype(_U) << _U(32)) | short
        out[who, k] = (_mix(np.minimum.reduceat(key, begin)) >> _U(32)).astype(np.uint32)
    return out


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as lower-cased UTF-8 in groups of about ``CHUNK`` bytes, with the place of the first."""
    some, size, begin = [], 0, 0
    for i, t in enumerate(column):
        b = (t.as_py() or "").encode("utf-8", "surrogatepass").lower()
        some.append(b)
        size += len(b)
        if size >= CHUNK:
            yield begin, some
            some, size, begin = [], 0, i + 1
    if some:
        yield begin, some


def _node(c1: np.ndarray, c2: np.ndarray) -> pa.Array:
    both = np.ascontiguousarray(np.stack([c1, c2], 1)).tobytes()
    return pa.array([both[16 * i : 16 * i + 16] for i in range(len(c1))], pa.binary())


def _width(docs: int) -> int:
    """Cells of a sketch row: eight for each document, within bounds."""
    low, high = WIDTH_BITS
    return 1 << min(high, max(low, (8 * max(docs, 1) - 1).bit_length()))


def _sketch(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequencies of all shingles in the sketch's cells, and the number of documents."""
    n_docs = docs.count()
    width = _width(n_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((DEPTH, width), np.uint32), 0
        for b in batches:
            for _, some in _chunks(b.column(0)):
                doc, h, _, _ = shingles(some)
                _, h, _ = distinct(doc, h)
                n += len(some)
                for row, c in zip(sums, _cells(h, width), strict=True):
                    np.add.at(row, c, np.uint32(1))
        if n:
            for k, piece in enumerate(np.array_split(sums.ravel(), PIECES)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(piece)], pa.binary())], names=["piece", "sums"])

    schema = "piece int, sums binary"
    salted = docs.select("text").mapInArrow(count, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    summed = materialise(salted.groupBy("piece", "salt").applyInArrow(_add_pieces, schema).groupBy("piece").applyInArrow(_add_pieces, schema), "icws-sketch")
    sketch = np.zeros((DEPTH, width), np.float32)
    pieces = np.array_split(sketch.reshape(-1), PIECES)
    # a partition at a time: the driver never holds the whole sketch twice
    for r in summed.toLocalIterator():
        pieces[r["piece"]][:] = _unpack(r["sums"])
    release(summed)
    return sketch, n_docs


def _pack(counts: np.ndarray) -> bytes:
    """Counts as planes of bytes, the lowest first and as many as the largest count needs, compressed."""
    n = max(1, (int(counts.max(initial=0)).bit_length() + 7) // 8)
    planes = counts.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T
    return bytes([n]) + zlib.compress(planes.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed[1:]), np.uint8).reshape(packed[0], -1)
    counts = np.zeros(planes.shape[1], _U)
    for k, plane in enumerate(planes):
        counts |= plane.astype(_U) << _U(8 * k)
    return counts


def _add_pieces(key, table):
    total = None
    for x in table.column("sums"):
        piece = _unpack(x.as_py())
        total = piece if total is None else total + piece
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([_pack(total)], pa.binary())})


def weighted_jaccard(h1, w1, h2, w2) -> float:
    """Of two sorted sets of hashes with weights."""
    both, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    low = np.minimum(w1[i], w2[j]).sum()
    return float(low / (w1.sum() + w2.sum() - low))


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of each signature (texts x BANDS)."""
    sig = sig.reshape(len(sig), BANDS, ROWS).astype(_U)
    h = np.broadcast_to(np.arange(1, BANDS + 1).astype(_U)[None, :] * _U(0x9E3779B97F4A7C15), sig.shape[:2])
    for k in range(ROWS):
        h = _mix(h ^ sig[:, :, k]) + _U(k + 1)
    return h


class _Members:
    """Texts of one group with their shingles: finds links between texts of different components."""

    def __init__(self, t: pa.Table, weights: Weights, similarity: float, plain: bool):
        self.similarity = similarity - 1e-9
        self.node = t.column("node").combine_chunks()
        self.sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(t), -1)
        self.bands = band_hashes(self.sig)
        packed = t.column("h").to_pylist()
        self.n = np.array([len(x) // 8 for x in packed])
        h = np.frombuffer(b"".join(packed), _U)
        times = np.concatenate([np.frombuffer(x, np.uint32) if x else np.ones(k, np.uint32) for x, k in zip(t.column("tf").to_pylist(), self.n, strict=True)])
        self.begin = np.cumsum(self.n) - self.n
        self.vocabulary, self.at = np.unique(h, return_inverse=True)
        idf = weights.idf(self.vocabulary).astype(np.float64)
        #: Weights by place: with idf, and plain counts if those may link as well.
        self.weights = [times * idf[self.at], *([times.astype(np.float64)] if plain else [])]
        self.sums = [np.add.reduceat(w, self.begin) for w in self.weights]
        self.dense = np.zeros(len(self.vocabulary))

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` reach the similarity to text ``i``, on all their shingles."""
        own = slice(self.begin[i], self.begin[i] + self.n[i])
        n = self.n[others]
        edge = np.cumsum(n) - n
        flat = np.arange(n.sum()) - np.repeat(edge - self.begin[others], n)
        good = np.zeros(len(others), bool)
        for w, sums in zip(self.weights, self.sums, strict=True):
            self.dense[self.at[own]] = w[own]
            low = np.add.reduceat(np.minimum(w[flat], self.dense[self.at[flat]]), edge)
            good |= low >= self.similarity * (sums[others] + sums[i] - low)
        self.dense[self.at[own]] = 0
        return good

    def links(self, band: int, comp: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        """Links between ``left`` and ``right`` rows of different components, as many as it takes to connect what they connect."""
        out: list[tuple[int, int]] = []
        both = left & right
        for i in np.flatnonzero(left):
            others = np.flatnonzero(right & (comp != comp[i]))
            if both[i]:
                others = others[(others > i) | ~both[others]]
            if not len(others):
                continue
            fits = np.zeros(len(others), bool)
            for sums in self.sums:
                fits |= np.minimum(sums[others], sums[i]) >= self.similarity * np.maximum(sums[others], sums[i])
            others = others[fits]
            shared = self.bands[others] == self.bands[i]
            # in the first band that the two share
            others = others[shared[:, band] & (shared.argmax(1) == band)]
            others = others[(self.sig[others] == self.sig[i]).mean(1) >= PROMISING]
            if len(others):
                for j in others[self.similar(i, others)]:
                    if comp[j] != comp[i]:
                        out.append((i, j))
                        comp[comp == comp[j]] = comp[i]
        return out


_GROUP = ["bucket", "low", "high", "large"]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal ``keys``, which lie together, as one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(b)], strict=True):
            key = tuple(c[s] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _searched(shared, similarity: float, plain: bool):
    """Over sorted groups of members: the links of each, as rows ``a, b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value[0]
        for t in _runs(batches, _GROUP):
            if len(t) < 2:
                continue
            members = _Members(t, weights, similarity, plain)
            comp = t.column("component").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
            part, big = (t.column(c).to_numpy(zero_copy_only=False) for c in ("part", "big"))
            low, high, large = (t.column(c)[0].as_py() for c in ("low", "high", "large"))
            if large:
                left, right = ~big, big
            elif low < high:
                left, right = part == low, part == high
            else:
                left = right = np.ones(len(t), bool)
            found = members.links(t.column("band")[0].as_py(), comp, left, right)
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([members.node.take(pa.array(i)), members.node.take(pa.array(j))], names=["a", "b"])

    return run


def _id_key(least: Column, node: Column, kind: T.DataType) -> Column:
    """Binary names of texts that sort by their least id, null last, and end with the 16 bytes of the text's hash."""
    if isinstance(kind, T.IntegralType):
        body = F.unhex(F.lpad(F.hex(least.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    else:
        body = least.cast("string").cast("binary")
    return F.when(least.isNull(), F.concat(F.unhex(F.lit("01")), node)).otherwise(F.concat(F.unhex(F.lit("00")), body, node))


def _key_id(key: Column, kind: T.DataType) -> Column:
    """The id that a name starts with."""
    if isinstance(kind, T.IntegralType):
        h = F.hex(F.substring(key, 2, 8))
        word = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
        found = F.shiftleft(word(1), 32).bitwiseOR(word(9)).bitwiseXOR(F.lit(-(1 << 63))).cast(kind)
    else:
        found = key.substr(F.lit(2), F.length(key) - 17).cast("string").cast(kind)
    return F.when(F.hex(F.substring(key, 1, 1)) == "00", found)


def _bits(key, table):
    """A bit for each of a bitmap's places, from the lowest of the first byte."""
    flags = np.zeros(1 << PLACE_BITS, bool)
    flags[table.column("place").to_numpy()] = True
    return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})


def _among(rows: DataFrame, wanted: DataFrame, n_rows: int) -> DataFrame:
    """Rows whose ``row_key`` may be an ``of_key`` of ``wanted``: all that are, and a small share of others. Rows are not shuffled, however many
    are wanted; what is broadcast has ``ROW_BITS`` bits for each of ``n_rows``, ``MOST_BITS`` at most."""
    maps = max(1, min(ROW_BITS * n_rows, MOST_BITS) >> PLACE_BITS)
    apart = lambda c: (F.pmod(F.shiftright(c, PLACE_BITS), F.lit(maps)), F.col(c).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))
    at, place = apart("of_key")
    bits = materialise(wanted.select(at.alias("at"), place.alias("place")).groupBy("at").applyInArrow(_bits, "at long, bits binary"), "icws-bits")
    at, place = apart("row_key")
    byte = F.col("bits").substr(F.shiftright(place, 3) + 1, F.lit(1))
    named = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(place, F.lit(8))) == 1
    return rows.join(F.broadcast(bits), (at == F.col("at")) & named).drop("at", "bits")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, plain: bool = True) -> DataFrame:
    """``doc_id, row_key, class_id, kept``: one row per row of ``df``.

    Documents are linked if their Jaccard similarity by TF-IDF weights reaches ``similarity``, or with ``plain`` that by counts
    alone: in very large groups of copies what they share weighs little, and the weights alone would lose links that
    plain shingles have. Classes are what links connect, and ``class_id`` is the smallest id in it (null if all are). A row is
    kept if it has that id. Case of A-Z and white space make no difference. Null, empty and blank texts have
    no shingles and are classes of their own. ``df`` is read several times and has to have the same rows each time. ``row_key`` is a hash of id and text; rows that repeat both share a class.
    Ids are integers or strings; nulls come last. An empty table gives an empty result; further columns are not looked at.
    """
    docs = df.select(F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    spark = df.sparkSession
    with temporary(spark) as keep:
        return keep(_classes(docs, similarity, plain), "icws-classes")


def _classes(docs: DataFrame, similarity: float, plain: bool) -> DataFrame:
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    sketch, n_docs = _sketch(docs)
    shared = spark.sparkContext.broadcast((Weights(sketch, n_docs), _random_tables()))
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, tables = shared.value
        for whole in batches:
            for b in slices(whole):
                for at, some in _chunks(b.column("text")):
                    doc, h, c1, c2 = shingles(some)
                    doc, h, tf = distinct(doc, h)
                    sig = samples(doc, h, np.log(tf.astype(np.float32) * weights.idf(h)), len(some), tables)
                    yield pa.RecordBatch.from_arrays(
                        [*(b.column(c).slice(at, len(some)) for c in ("doc_id", "row_key")), _node(c1, c2), pa.array(np.bincount(doc, minlength=len(some))), pa.array([s.tobytes() for s in sig], pa.binary())],
                        names=["doc_id", "row_key", "node", "n", "sig"],
                    )

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                for at, some in _chunks(b.column("text")):
                    doc, h, c1, c2 = shingles(some)
                    doc, h, tf = distinct(doc, h)
                    edge = np.searchsorted(doc, np.arange(len(some) + 1)).tolist()
                    cuts = list(zip(edge[:-1], edge[1:], strict=True))
                    counts = pa.array([tf[x:y].astype(np.uint32).tobytes() if (tf[x:y] > 1).any() else b"" for x, y in cuts], pa.binary())
                    yield pa.RecordBatch.from_arrays([b.column("row_key").slice(at, len(some)), _node(c1, c2), pa.array([h[x:y].tobytes() for x, y in cuts], pa.binary()), counts], names=["row_key", "node", "h", "tf"])

    signed = keyed.select("doc_id", "row_key", "text").mapInArrow(sign, f"doc_id {kind.simpleString()}, row_key long, node binary, n long, sig binary")
    signed = materialise(signed, "icws-signed")
    rows = materialise(signed.select("doc_id", "row_key", "node", "n"), "icws-rows")
    # a text is read again in the rows of one key that have it, whichever
    texts = signed.filter(F.col("n") > 0).groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row_key").alias("of_key"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    texts = materialise(texts, "icws-texts")
    release(signed)
    names = materialise(texts.select("node", _id_key(F.col("least"), F.col("node"), kind).alias("name")), "icws-names")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                h = band_hashes(np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(len(b), -1))
                at = pa.array(np.repeat(np.arange(len(b)), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(b))), b.column("node").take(at), b.column("n").take(at)], names=["bucket", "band", "node", "n"])

    banded = materialise(texts.select("node", "n", "sig").mapInArrow(bands, "bucket long, band int, node binary, n long"), "icws-bands")
    a_set = [F.xxhash64("node").alias("x"), F.xxhash64(F.lit("second"), "node").alias("y")]
    buckets = banded.select("*", *a_set).groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.min("node").alias("lead"), F.max("node").alias("other"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).filter(F.col("size") > 1)
    # of buckets with the same members the first; what two texts share first is always among these
    buckets = buckets.groupBy("size", "lead", "other", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("first"), F.max("shingles").alias("shingles"))
    pieces = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    buckets = materialise(buckets.select("first.bucket", "size", "lead", "other", pieces.alias("pieces")), "icws-buckets")
    members = materialise(banded.select("bucket", "band", "node").join(buckets, "bucket"), "icws-members")
    release(banded)
    wanted = members.select("node").distinct().join(texts, "node").select("node", "of_key", _id_key(F.col("least"), F.col("node"), kind).alias("name"), "sig")
    wanted = materialise(wanted, "icws-wanted")
    release(texts)
    spelled = _among(keyed.select("row_key", "text"), wanted, n_docs).mapInArrow(spell, "row_key long, node binary, h binary, tf binary")
    # rows that repeat both id and text are alike
    packed = spelled.join(wanted.withColumnRenamed("of_key", "row_key"), ["node", "row_key"]).dropDuplicates(["node"])
    packed = materialise(packed.select("node", "name", "sig", "h", "tf"), "icws-shingles")

    def search(groups: DataFrame) -> DataFrame:
        """``a, b``: links within each group, by names."""
        rows = groups.join(packed, "node").select(*_GROUP, "band", "component", "part", "big", F.col("name").alias("node"), "sig", "h", "tf")
        return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_searched(shared, similarity, plain), "a binary, b binary")

    no = F.lit(False)
    part = F.pmod(F.xxhash64("node", "bucket"), F.col("pieces")).cast("int")
    is_lead = (F.col("node") == F.col("lead")) | (F.col("node") == F.col("other"))
    # the leaders are in every part
    where = F.when((F.col("pieces") > 1) & is_lead, F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array(part))
    inside = members.withColumn("low", F.explode(where)).select("bucket", "band", "node", "low", F.col("low").alias("high"), no.alias("large"), F.col("node").alias("component"), F.col("low").alias("part"), no.alias("big"))
    links = materialise(search(inside), "icws-links")
    found = connected_components(links)
    cut = members.filter("pieces > 1").select("bucket", "band", "node", "pieces")
    if not cut.isEmpty():
        label = wanted.join(found.withColumnRenamed("id", "name"), "name", "left").select("node", F.coalesce("component", "name").alias("component"))
        links = materialise(links.union(search(_groups(cut.join(label, "node")))), "icws-links")
        found = connected_components(links)
    by_node = names.join(found.withColumnRenamed("id", "name"), "name", "left").select("node", _key_id(F.coalesce("component", "name"), kind).alias("of_class"))
    out = rows.join(by_node, "node", "left")
    out = out.select("doc_id", "row_key", F.when(F.col("n") > 0, F.col("of_class")).otherwise(F.col("doc_id")).alias("class_id"))
    return out.select("doc_id", "row_key", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def _groups(members: DataFrame) -> DataFrame:
    """Members of buckets with more than one component, dealt to groups in which each two of them meet, save two of the largest.

    ``members`` has ``bucket, band, node, component, pieces``; added are whether a member is of the largest component (``big``),
    its ``part``, and the parts (``low``, ``high``) that meet in the group, ``high`` being one of the largest component if ``large``.
    """
    sizes = members.groupBy("bucket", "component", "pieces").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("components"), F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("of"), F.max("pieces").alias("cut"))
    sizes = sizes.filter("components > 1").select("bucket", F.col("largest.component").alias("top"), *(F.greatest(F.ceil(F.col("cut") * n / F.col("of")), F.lit(1)).cast("int").alias(name) for name, n in (("small", F.col("of") - F.col("largest.n")), ("wide", F.col("largest.n")))))
    out = members.join(sizes, "bucket").withColumn("big", F.col("component") == F.col("top"))
    out = out.withColumn("part", F.pmod(F.xxhash64("node", "bucket"), F.when(F.col("big"), F.col("wide")).otherwise(F.col("small"))).cast("int"))
    group = lambda low, high, big: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), F.lit(big).alias("large"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    own = F.col("part")
    asking = F.concat(each("small", lambda q: group(F.least(own, q), F.greatest(own, q), False)), each("wide", lambda q: group(own, q, True)))
    where = F.when(F.col("big"), each("small", lambda q: group(q, own, True))).otherwise(asking)
    return out.withColumn("g", F.explode(where)).select("bucket", "band", "node", "component", "big", "part", "g.low", "g.high", "g.large")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with one document of each class, that of smallest id; of rows that repeat the kept id and text, one.

    Texts that differ but share the kept id all stay. Null, empty and blank texts stay, as classes of their own. Column
    names are free; an empty table stays empty.
    """
    named = classes(df, id_col, text_col, **options).filter("kept")
    own_id, own_key, rows, row_key = fresh(df, "kept_id", "kept_key", "kept_rows", "row_key")
    named = named.groupBy(F.col("doc_id").alias(own_id), F.col("row_key").alias(own_key)).agg(F.count(F.lit(1)).alias(rows))
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    joined = df.withColumn(row_key, F.xxhash64(F.col(quoted(id_col)), text)).join(named, F.col(quoted(id_col)).eqNullSafe(F.col(own_id)) & (F.col(row_key) == F.col(own_key)))
    if not named.filter(F.col(rows) > 1).isEmpty():
        joined = joined.dropDuplicates([own_id, own_key])
    return joined.select(*(F.col(quoted(c)) for c in df.columns))


def digests(df: DataFrame) -> DataFrame:
    return classes(df.select("doc_id", "text")).select("doc_id", "class_id", "kept")
