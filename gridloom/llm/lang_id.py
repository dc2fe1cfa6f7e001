"""Language identification by interpolated Kneser-Ney character models.

One model per language over characters, order ``ORDER``. All languages share one sorted array of n-gram hashes per
order; next to each hash stand the interpolated log-probabilities of all languages, so scoring a character takes one
binary search for all of them, and shorter n-grams only where the longest was never seen. A text gets the
language of lowest cross-entropy per character. It is rejected where that lies further above what its language's held-back
texts show than all but a stated share of them do, times a margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import append_columns, crc_mod, position, quoted, slices

#: Characters of an n-gram; absolute discount; rows that a language's model and its calibration are fitted on, at most about.
ORDER, DISCOUNT, SAMPLE_ROWS = 4, 0.75, 1200
#: Share of held-back texts of a language that may be rejected, and the allowance in bits per character on top of what they show.
#: Share of held-back texts beyond the rejection limit before ``MARGIN`` widens it; the least limit, in deviations.
REJECT_RATE, MARGIN, LEAST_LIMIT = 0.001, 1.5, 6.0
UNKNOWN = "und"
#: Characters scored at once.
CHUNK = 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 21  # of a code point


def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


_letters: list[np.ndarray] = []


def letter_codes(text: str) -> np.ndarray:
    """Code points of the letters in lower case, other characters as single spaces, a space at either end.

    Empty if the text has no letter.
    """
    if not _letters:
        _letters.append(_is_letter())
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = _letters[0][np.minimum(raw, 0x10FFFF)]
    if not keep.any():
        return raw[:0]
    code = np.where(keep, raw, np.uint32(32))
    gap = code == 32
    stay = ~gap
    stay[1:] |= gap[1:] & ~gap[:-1]
    code = code[stay]
    if code[0] != 32:
        code = np.r_[np.uint32(32), code]
    return code if code[-1] == 32 else np.r_[code, np.uint32(32)]


def gram_hashes(codes: np.ndarray, local: np.ndarray, at: np.ndarray, first: int, n: int) -> np.ndarray:
    """Hashes of the characters ``first`` to ``n - 1`` back from each position of ``at``.

    ``codes`` are code points plus one of texts laid end to end, ``local`` the positions within their texts; what would
    lie before a text counts as 0. With ``first`` 0 that is the n-gram that ends there, with 1 its context.
    """
    out = np.zeros(len(at), np.uint64)
    for k in range(first, n):
        out += np.where(local[at] >= k, codes[np.maximum(at - k, 0)], np.uint64(0)) * _power(k)
    return _mixed(out)


def _power(k: int) -> np.uint64:
    return np.uint64(pow(0x100000001B3, 3 * k, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


@dataclass
class Model:
    """``tables[n]``: sorted hashes of n-grams and a row of log2-probabilities per hash, a column per language.
    ``contexts[n]``: sorted hashes of (n-1)-character contexts and their log2 back-off weights."""

    languages: list[str]
    tables: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float
    mean: np.ndarray
    spread: np.ndarray
    per_char: np.ndarray
    sharpness: float = 1.0
    limit: float = LEAST_LIMIT

    def excess(self, least: np.ndarray, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many deviations a text's lowest cross-entropy lies above its language's; shorter texts vary more."""
        return (least - self.mean[best]) / np.sqrt(self.spread[best] ** 2 + self.per_char[best] / np.maximum(n, 1))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits per character (texts x languages), and characters scored, 0 without a letter.

        Works on ``CHUNK`` characters at a time: short texts are laid end to end, longer ones cut into pieces that
        start with the characters their first n-gram looks back on.
        """
        n, bits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)))
        group, owner, skip, size = [], [], [], 0

        def flush() -> None:
            nonlocal group, owner, skip, size
            if group:
                np.add.at(bits, owner, self._sum(group, np.array([len(p) for p in group]) - 1, np.array(skip)))
            group, owner, skip, size = [], [], [], 0

        for i, t in enumerate(texts):
            codes = letter_codes(t) if t else np.zeros(0, np.uint32)
            n[i] = max(0, len(codes) - 1)
            for begin in range(1, len(codes), CHUNK):
                back = min(begin, len(self.tables))
                group.append(codes[begin - back : begin + CHUNK])
                owner.append(i)
                skip.append(back)
                size += len(group[-1])
                if size >= CHUNK:
                    flush()
        flush()
        return bits / np.maximum(n, 1)[:, None], n

    def _sum(self, parts: list[np.ndarray], n: np.ndarray, skip: np.ndarray | int = 1) -> np.ndarray:
        """Bits of each part's characters from the ``skip``-th on; those before are context only."""
        order = len(self.tables)
        codes = np.concatenate(parts).astype(np.uint64) + np.uint64(1)
        sizes = n + 1
        local = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        skip = np.broadcast_to(skip, len(parts))
        at = np.flatnonzero(local >= np.repeat(skip, sizes))
        n = sizes - skip
        logs, miss = _look(self.tables[-1], gram_hashes(codes, local, at, 0, order))
        todo = np.flatnonzero(miss)
        extra = np.zeros((len(todo), logs.shape[1]), np.float32)
        for m in range(order - 1, -1, -1):
            if not len(todo):
                break
            # the context that was backed off from, and then the shorter n-gram
            weight, none = _look(self.contexts[m], gram_hashes(codes, local, at[todo], 1, m + 1))
            extra += np.where(none[:, None], np.float32(0), weight)
            if m == 0:
                logs[todo] = extra + np.float32(self.floor)
                break
            got, none = _look(self.tables[m - 1], gram_hashes(codes, local, at[todo], 0, m))
            logs[todo[~none]] = got[~none] + extra[~none]
            todo, extra = todo[none], extra[none]
        return -np.add.reduceat(logs, np.r_[0, np.cumsum(n)[:-1]], axis=0, dtype=np.float64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score in 0 to 1 and whether the text is accepted. Without a letter: ``und``, 0, rejected."""
        bits, n = self.entropies(texts)
        best = bits.argmin(1)
        least = bits[np.arange(len(texts)), best]
        # the sharpness is fitted on held-back rows; a character too many must not make a certainty of it
        odds = np.exp2(-self.sharpness * np.sqrt(np.maximum(n, 1))[:, None] * (bits - least[:, None]))
        score = 1 / odds.sum(1)
        named = [self.languages[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)]
        return named, np.where(n > 0, score, 0.0), (n > 0) & (self.excess(least, best, n) <= self.limit)


def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, rows = table
    at = np.searchsorted(hashes, keys)
    at[at == len(hashes)] = 0
    return rows[at], hashes[at] != keys


def fit(languages: list[str], grams: np.ndarray, counts: np.ndarray) -> Model:
    """``grams``: distinct n-grams of order ``ORDER`` as rows of code points plus one (0 before a text);
    ``counts``: how often each occurs in each language."""
    held, kept = grams.astype(np.int64), counts.astype(np.float64)
    levels: list[tuple] = []
    for n in range(ORDER, 0, -1):
        contexts, in_context = np.unique(held[:, :-1], axis=0, return_inverse=True) if n > 1 else (np.zeros((1, 0), np.int64), np.zeros(len(held), np.int64))
        in_context = in_context.ravel()
        total, kinds = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
        np.add.at(total, in_context, kept)
        np.add.at(kinds, in_context, kept > 0)
        back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        own = np.where(total > 0, 1, 0)[in_context] * np.maximum(kept - DISCOUNT, 0) / np.maximum(total, 1)[in_context]
        if n > 1:
            # below the top order a gram counts by its distinct left extensions; at a text's start it has none and keeps its count
            shorter, inverse = np.unique(held[:, 1:], axis=0, return_inverse=True)
            inverse = inverse.ravel()
            fewer = np.zeros((len(shorter), len(languages)))
            np.add.at(fewer, inverse, np.where(((held[:, 0] == 0) & (held[:, 1] == 0))[:, None], kept, kept > 0))
        else:
            shorter, inverse, fewer = held[:0], np.zeros(len(held), np.int64), kept[:0]
        levels.append((held, own, contexts, back, in_context, inverse))
        held, kept = shorter, fewer
    uniform = 1.0 / (len(levels[-1][0]) + 1000)
    tables, backs, lower = [], [], np.full((1, len(languages)), uniform)
    for held, own, contexts, back, in_context, inverse in reversed(levels):
        prob = own + back[in_context] * lower[inverse]
        tables.append(_packed(held, prob, 0))
        backs.append(_packed(contexts, back, 1))
        lower = prob
    return Model(languages, tables, backs, float(np.log2(uniform)), *(np.full(len(languages), v) for v in (8.0, 1.0, 25.0)))


def _packed(rows: np.ndarray, values: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, as ``gram_hashes`` computes them, and log2 of the values."""
    keys = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        keys += rows[:, -1 - k].astype(np.uint64) * _power(k + first)
    keys = _mixed(keys)
    order = np.argsort(keys)
    return keys[order], np.log2(values).astype(np.float32)[order]


def calibrate(model: Model, names: np.ndarray, bits: np.ndarray, n: np.ndarray) -> None:
    """Fits means, spreads, the sharpness of scores and the rejection limit.

    ``names``: languages by number of held-back texts, ``bits`` their cross-entropies (texts x languages), ``n`` their characters.
    """
    names, bits, n = names[n > 0], bits[n > 0], n[n > 0]
    if not len(n):
        return
    for k in range(len(model.languages)):
        own, chars = bits[names == k, k], n[names == k]
        if len(own):
            model.mean[k] = np.median(own)
            # median absolute deviation: a few mislabelled rows do not widen the margin
            model.spread[k] = 1.4826 * np.median(np.abs(own[chars >= np.median(chars)] - model.mean[k])) + 0.05
            model.per_char[k] = np.median((own - model.mean[k]) ** 2 * chars) / 0.455 + 4.0
    best = bits.argmin(1)
    over = model.excess(bits.min(1), best, n)
    model.limit = max(LEAST_LIMIT, MARGIN * float(np.quantile(over, 1 - REJECT_RATE)))
    least = np.inf
    for sharp in np.geomspace(0.05, 8, 16):
        z = -sharp * np.sqrt(n)[:, None] * (bits - bits.min(1, keepdims=True)) * np.log(2)
        loss = (np.log(np.exp(z).sum(1)) - z[np.arange(len(n)), names]).mean()
        if loss < least and len(model.languages) > 1:
            least, model.sharpness = loss, float(sharp)


def train(df: DataFrame, usable: Column | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits the models on a sample of about ``sample_rows`` rows of each language, whole texts, drawn by a hash
    of the id; every fifth is held back for calibration. Rows without language or text are not used; without any
    row the only language is ``und``. What reaches the driver are the distinct n-grams of the sample and a row of numbers
    for each held-back text.
    """
    lang, text, doc_id = F.col(quoted(lang_col)), F.col(quoted(text_col)), F.col(quoted(id_col))
    labelled = df.filter(lang.isNotNull() & text.isNotNull() & (usable if usable is not None else F.lit(True)))
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang.alias("lang")).count().collect()}
    if not sizes:
        return fit([UNKNOWN], np.zeros((0, ORDER)), np.zeros((0, 1)))
    # a rate for each language; the hash decides row by row, so no sorting and no shuffle of texts
    rates = F.create_map(*(F.lit(v) for name, rows in sizes.items() for v in (name, min(1.0, sample_rows / rows))))
    draw = F.pmod(F.xxhash64(doc_id, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    back = F.pmod(F.xxhash64(doc_id, F.lit("fold")), F.lit(5)) == 0
    chosen = labelled.filter(draw < F.try_element_at(rates, lang)).select(lang.alias("lang"), text.alias("text"), back.alias("back"))

    def rows_of(name: str, parts: list[np.ndarray]) -> pa.RecordBatch:
        kinds, times = _distinct(np.vstack([np.lib.stride_tricks.sliding_window_view(c, ORDER) for c in parts]))
        names = [k.tobytes().decode("utf-32-le", "surrogatepass") for k in kinds]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(kinds)), pa.array(names, pa.string()), pa.array(times, pa.int64())], names=["lang", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list[np.ndarray]] = {}
        for whole in batches:
            for b in slices(whole):
                for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    codes = letter_codes(t)
                    if len(codes) > 1:
                        padded = np.r_[np.zeros(ORDER - 2, np.uint32), codes + 1]
                        # a long text in pieces that overlap by what an n-gram looks back on
                        for at in range(0, len(padded) - ORDER + 1, CHUNK):
                            by.setdefault(name, []).append(padded[at : at + CHUNK + ORDER - 1])
                            if sum(map(len, by[name])) > CHUNK:
                                yield rows_of(name, by.pop(name))
        for name, parts in by.items():
            yield rows_of(name, parts)

    got = chosen.filter(~F.col("back")).mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(sizes)
    index: dict[str, int] = {}
    at = np.array([index.setdefault(g, len(index)) for g in got.column("gram").to_pylist()], np.int64)
    counts = np.zeros((len(index), len(languages)))
    place = {name: k for k, name in enumerate(languages)}
    np.add.at(counts, (at, np.array([place[x] for x in got.column("lang").to_pylist()], np.int64)), got.column("n").to_numpy())
    grams = np.frombuffer("".join(index).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
    model = fit(languages, grams, counts)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                bits, n = shared.value.entropies(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(list(bits), pa.list_(pa.float64()))], names=["lang", "n", "bits"])

    held = chosen.filter("back").mapInArrow(measure, "lang string, n long, bits array<double>").toArrow()
    if len(held):
        calibrate(model, np.array([place[x] for x in held.column("lang").to_pylist()]), np.array(held.column("bits").to_pylist()), held.column("n").to_numpy())
    shared.unpersist()
    return model


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and their counts; four indices into the alphabet in use make one integer."""
    alphabet, index = np.unique(rows, return_inverse=True)
    if len(alphabet) > 1 << 64 // ORDER:
        return np.unique(rows, axis=0, return_counts=True)
    index = index.reshape(rows.shape).astype(np.uint64)
    step = np.uint64(64 // ORDER)
    packed = np.zeros(len(rows), np.uint64)
    for k in range(ORDER):
        packed = (packed << step) | index[:, k]
    _, first, times = np.unique(packed, return_index=True, return_counts=True)
    return rows[first], times


def classify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``lang_score``, ``lang_accepted``. Null texts and texts without a letter: ``und``, 0, false.

    Rows are independent; the model, bounded by its training sample, is broadcast. Clashing columns are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = position(df, text_col)

    def make():
        m = shared.value

        def step(b: pa.RecordBatch) -> list:
            named, score, fine = m.predict(b.column(at).to_pylist())
            return [pa.array(named, pa.string()), pa.array(score, pa.float64()), pa.array(fine, pa.bool_())]

        return step

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_accepted", T.BooleanType())]
    return append_columns(df, fields, make)


def digests(df: DataFrame) -> DataFrame:
    """Prediction for every row of ``documents``, learned from the rows that are not held out.

    ``accepted`` is the calibrated decision; the language is given either way. Rows that repeat an id are predicted each on
    its own; a null id counts as the empty text where folds are dealt; an empty table gives an empty result.
    """
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = train(df, ~held)
    out = classify(df.select("doc_id", "text", held.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))
