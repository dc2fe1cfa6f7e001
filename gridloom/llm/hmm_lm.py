"""A hidden Markov language model over words, and exact scores of whole texts.

A word belongs to a class: the commonest training words are a class each, the others share classes by the sum of their
bytes. Latent states emit classes, and a class emits its words by their smoothed counts, so every training word has its own
probability while what Baum-Welch has to estimate stays small enough to send around. Each class of other words leaves a
share to words never seen, by Good and Turing's estimate; among those, words are as probable as a model of their
spelling makes them. The share of each class in all spellings is known exactly, since sums of independent bytes
are a convolution, and what known words take of it is added up: so the probabilities of all words sum to 1.

Each round of Baum-Welch adds up expected counts in every partition over all training texts and combines them across
partitions. Texts go through it in windows that begin and end some words before and after the words they count, so
that the states at either end are those that the text leads to.

Scoring is exact: the forward recursion runs over the whole text. Texts are cut into segments whose transfer
matrices are computed side by side and then chained, which is the same product in another order.
Exact counts of the commonest words are broadcast; those of the rest, whose number grows with the corpus, are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import crc_mod, materialise, position, quoted, slices, temporary, words_of

#: Words whose counts are broadcast, at most; of those, words with a class of their own (the first class is that of the end);
#: classes of the other words, by the sum of their bytes.
HEAD_WORDS, OWN_CLASSES, SHARED_CLASSES = 131_072, 2048, 256
STATES, ROUNDS, SMOOTH = 6, 3, 0.1
#: Words that a training window counts and that it takes in before and after those; words of a scoring segment; distinct words
#: that a counting task holds before it hands them on.
WINDOW, LEAD, SEGMENT, HELD_WORDS = 64, 16, 32, 200_000
END = b""  # no word is empty
#: Bytes that words are made of: all but white space and the capitals, which are lower-cased.
LETTERS = np.array([b for b in range(256) if b not in b" \t\n\x0b\x0c\rABCDEFGHIJKLMNOPQRSTUVWXYZ"])


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """``token, c``: occurrences of every word, and of the end that closes each text."""
    at = position(df, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "c"])

        held: Counter = Counter()
        for whole in batches:
            for b in slices(whole):
                for t in b.column(at):
                    held.update(words_of(t.as_py()))
                    held[END] += 1
                    if len(held) > HELD_WORDS:
                        yield out()
                        held.clear()
        yield out()

    return df.mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Spelling:
    """Independent bytes and a chance to stop after each: log10-probabilities by byte, of going on and of stopping."""

    letters: np.ndarray
    on: float
    stop: float

    @staticmethod
    def fit(bytes_seen: np.ndarray, words: int) -> Spelling:
        p = np.zeros(256)
        p[LETTERS] = bytes_seen[LETTERS] + 1
        stop = (words + 1) / (bytes_seen.sum() + 2)
        return Spelling(np.log10(p / p.sum(), where=p > 0, out=np.full(256, -np.inf)), float(np.log10(1 - stop)), float(np.log10(stop)))

    def log(self, word: bytes) -> float:
        return sum(map(self.letters.__getitem__, word)) + (len(word) - 1) * self.on + self.stop

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of many words the shared classes, counted from 0, and ``log``."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        k = np.add.reduceat(flat, begin, dtype=np.int64) % SHARED_CLASSES
        return k, np.add.reduceat(self.letters[flat], begin) + (size - 1) * self.on + self.stop

    def class_shares(self) -> np.ndarray:
        """Probability that a spelling belongs to each shared class: a geometric series of convolutions, by Fourier transform."""
        one = np.bincount(np.arange(256) % SHARED_CLASSES, 10.0**self.letters, SHARED_CLASSES)
        f = np.fft.fft(one)
        return np.fft.ifft(10**self.stop * f / (1 - 10**self.on * f)).real.clip(0, 1)


@dataclass
class Vocabulary:
    """What scoring knows without a join. ``n`` and ``v``: tokens and distinct tokens in training."""

    n: int
    v: int
    head: dict[bytes, tuple[int, int]]  # word -> class, count
    class_mass: np.ndarray  # share of a class in the training tokens
    seen_log: np.ndarray  # by class: log10 of what (count + SMOOTH) of a known word is multiplied with
    unseen_log: np.ndarray  # by class: log10 of what the spelling probability of an unseen word is multiplied with
    spelling: Spelling

    @property
    def denominator(self) -> float:
        return self.n + SMOOTH * (self.v + 1)

    def within(self, word: bytes, count: int) -> tuple[int, float]:
        """Class of a word, and the log10-probability of the word in its class; ``count`` is 0 for unseen words."""
        k = self.head[word][0] if word in self.head else class_of(word)
        if k < OWN_CLASSES:
            return k, 0.0
        return k, float(self.seen_log[k] + np.log10(count + SMOOTH) if count else self.unseen_log[k] + self.spelling.log(word))


def class_of(word: bytes) -> int:
    """The shared class of a word that has none of its own."""
    return OWN_CLASSES + sum(word) % SHARED_CLASSES


def _head(counts: DataFrame) -> tuple[list[bytes], list[int]]:
    """The commonest words, as many as fit in ``HEAD_WORDS``, by count and word. The count to cut at comes from a histogram, so
    that no task sorts the vocabulary."""
    level = F.floor(F.log2("c") * 64)
    bins = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    cut, total = None, 0
    for k, n in bins:
        total += n
        if total > HEAD_WORDS:
            break
        cut = k
    if cut is None:
        return [], []
    top = counts.filter(level >= cut).toArrow()
    pairs = sorted(zip(top.column("c").to_pylist(), top.column("token").to_pylist(), strict=True), key=lambda p: (-p[0], p[1]))
    return [w for _, w in pairs], [c for c, _ in pairs]


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From ``token, c``. Everything is counted over all words; only sums by class and the head reach the driver."""
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.length("token") == 0, F.col("c"))), F.lit(0))).first()
    spelled = counts.filter(F.length("token") > 0)
    words, c = _head(spelled)

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(256, np.int64)
        rows = 0
        for b in batches:
            seen += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8), minlength=256)
            rows += len(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 256)), pa.array(np.r_[rows, seen])], names=["k", "n"])

    sums = np.zeros(257)
    for r in spelled.select("token").mapInArrow(letters, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        sums[r["k"] + 1] = r["n"]
    spelling = Spelling.fit(sums[1:], int(sums[0]))

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, SHARED_CLASSES))
        for b in batches:
            tokens, m = b.column(0).to_pylist(), b.column(1).to_numpy()
            k, spelt = spelling.of(tokens)
            spelt = 10.0**spelt
            for row, x in zip(sums, (m, np.ones(len(b)), m == 1, spelt), strict=True):
                row += np.bincount(k, x, SHARED_CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHARED_CLASSES)), *map(pa.array, sums)], names=["k", "c", "n", "once", "spelt"])

    every = OWN_CLASSES + SHARED_CLASSES
    total, kinds, once, spelt = (np.zeros(every) for _ in range(4))
    for r in spelled.mapInArrow(by_class, "k long, c double, n double, once double, spelt double").groupBy("k").agg(*(F.sum(x).alias(x) for x in ("c", "n", "once", "spelt"))).collect():
        at = OWN_CLASSES + r["k"]
        total[at], kinds[at], once[at], spelt[at] = r["c"], r["n"], r["once"], r["spelt"]
    head = {END: (0, int(ends))}
    total[0] = ends
    for k, (w, m) in enumerate(zip(words, c, strict=True), 1):
        head[w] = (k if k < OWN_CLASSES else class_of(w), m)
        if k < OWN_CLASSES:
            total[k] = m
            for sums, less in ((total, m), (kinds, 1), (once, m == 1)):
                sums[class_of(w)] -= less
    shared = np.arange(every) >= OWN_CLASSES
    # Good and Turing: words seen once tell how often an unseen one comes up
    unseen = np.where(shared, np.where(kinds > 0, (once + 1) / (total + once + 2), 1.0), 0.0)
    left = np.maximum(np.r_[np.ones(OWN_CLASSES), spelling.class_shares()] - spelt, 1e-12)
    with np.errstate(divide="ignore"):
        seen_log = np.where(shared & (kinds > 0), np.log10(1 - unseen) - np.log10(np.maximum(total + SMOOTH * kinds, SMOOTH)), 0.0)
        unseen_log = np.where(shared, np.log10(np.maximum(unseen, 1e-300)) - np.log10(left), 0.0)
    # classes of their own that no word uses emit nothing
    used = shared | (np.arange(every) <= len(words))
    mass = np.where(used, total + 1, 0.0)
    return Vocabulary(int(n), int(v), head, mass / mass.sum(), seen_log, unseen_log, spelling)


_TAIL = pa.struct([("token", pa.binary()), ("times", pa.int32()), ("k", pa.int32()), ("spelt", pa.float64())])


def coded(df: DataFrame, known: Vocabulary, text_col: str) -> DataFrame:
    """Adds to each row its classes, its distinct words that need a join, and sums over the words that do not."""
    shared = df.sparkSession.sparkContext.broadcast(known)
    at = position(df, text_col)
    keep = [i for i in range(len(df.columns)) if i != at]
    fields = [T.StructField("classes", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("head_known", T.LongType()), T.StructField("head_log", T.DoubleType()), T.StructField("head_within", T.DoubleType())]
    tail_type = T.StructType([T.StructField("token", T.BinaryType()), T.StructField("times", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("spelt", T.DoubleType())])
    schema = T.StructType([df.schema[i] for i in keep] + fields + [T.StructField("tail", T.ArrayType(tail_type))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, spelling = shared.value.head, shared.value.spelling
        # one more element for words that are not in the head, at place -1
        kinds = np.array([*(k for k, _ in head.values()), OWN_CLASSES], np.int64)
        count = np.array([m for _, m in head.values()])
        log = np.r_[np.log10(count + SMOOTH), 0.0]
        within = np.where(kinds < OWN_CLASSES, 0.0, log + shared.value.seen_log[kinds])
        within[-1] = 0.0
        seen = np.r_[count > 0, False].astype(np.int64)
        number = dict(zip(head, range(len(head)), strict=True)).get
        for whole in batches:
            for some in slices(whole):
                words: list[bytes] = []
                size = []
                for t in some.column(at):
                    own = words_of(t.as_py())
                    words += own
                    words.append(END)
                    size.append(len(own) + 1)
                place = np.fromiter(map(number, words, repeat(-1)), np.int64, len(words))
                ends = np.cumsum(size)
                begin = ends - size
                classes = kinds[place].astype(np.int16)
                missing = np.flatnonzero(place < 0)
                rest = [words[i] for i in missing.tolist()]
                classes[missing] = OWN_CLASSES + spelling.of(rest)[0]
                cuts = np.searchsorted(missing, np.r_[0, ends]).tolist()
                tails = [Counter(rest[a:b]) for a, b in pairwise(cuts)]
                flat = [w for c in tails for w in c]
                k, spelt = spelling.of(flat)
                struct = pa.StructArray.from_arrays([pa.array(flat, pa.binary()), pa.array([n for c in tails for n in c.values()], pa.int32()), pa.array(k.astype(np.int32)), pa.array(spelt)], fields=list(_TAIL))
                offsets = pa.array(np.cumsum([0, *map(len, tails)]), pa.int32())
                sums = [np.add.reduceat(x[place], begin) for x in (seen, log, within)]
                packed = [classes[a:b].tobytes() for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in keep), pa.array(packed, pa.binary()), pa.array(size, pa.int64()), *map(pa.array, sums), pa.ListArray.from_arrays(offsets, struct)], names=schema.names)

    return df.mapInArrow(run, schema)


@dataclass
class Hmm:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states

    @staticmethod
    def initial(mass: np.ndarray, states: int) -> Hmm:
        rng = np.random.default_rng(7)
        emit = mass[:, None] * (0.5 + rng.random((len(mass), states)))
        move = np.full((states, states), 0.5 / states) + 0.5 * np.eye(states)
        return Hmm(np.full(states, 1 / states), move, emit / emit.sum(0))

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves, emissions and the log-likelihood, over windows of the texts.

        A window counts ``WINDOW`` words and takes in ``LEAD`` words before and after them, which lead from the stationary
        distribution to the states of the text at its ends; a text's first window begins with the start.
        """
        s = len(self.start)
        still = np.linalg.matrix_power(self.move, 64)[0]
        starts, moves, emits, total = np.zeros(s), np.zeros((s, s)), np.zeros_like(self.emit), 0.0
        cut = [(x[max(0, i - LEAD) : i + WINDOW + LEAD], i <= LEAD, min(i, LEAD), min(i, LEAD) + min(WINDOW, len(x) - i)) for x in texts for i in range(0, len(x), WINDOW)]
        cut.sort(key=lambda w: -len(w[0]))
        for at in range(0, len(cut), 2048):
            group = cut[at : at + 2048]
            sizes = np.array([len(w[0]) for w in group])
            grid = np.zeros((len(group), sizes[0]), np.int64)
            for k, (w, *_) in enumerate(group):
                grid[k, : len(w)] = w
            first, begin, end = (np.array([w[k] for w in group]) for k in (1, 2, 3))
            live = [int((sizes > t).sum()) for t in range(sizes[0])]
            counts = [((begin[:m] <= t) & (t < end[:m])).astype(float) for t, m in enumerate(live)]
            b = [self.emit[grid[:m, t]] for t, m in enumerate(live)]
            alpha = [np.where(first[:, None], self.start, still) * b[0]]
            scale = [alpha[0].sum(1)]
            alpha[0] /= scale[0][:, None]
            for t in range(1, len(live)):
                a = (alpha[-1][: live[t]] @ self.move) * b[t]
                scale.append(a.sum(1))
                alpha.append(a / scale[-1][:, None])
            total += sum((np.log10(x) * n).sum() for x, n in zip(scale, counts, strict=True))
            beta = np.ones((live[-1], s))
            for t in range(len(live) - 1, -1, -1):
                counted = counts[t]
                if counted.any():
                    gamma = alpha[t] * beta * counted[:, None]
                    for k in range(s):
                        emits[:, k] += np.bincount(grid[: live[t], t], gamma[:, k], len(emits))
                if t:
                    weighted = b[t] * beta / scale[t][:, None]
                    if counted.any():
                        moves += (alpha[t - 1][: live[t]].T @ (weighted * counted[:, None])) * self.move
                    wider = np.ones((live[t - 1], s))
                    wider[: live[t]] = weighted @ self.move.T
                    beta = wider
                else:
                    starts += gamma[first & (begin == 0)].sum(0) if counted.any() else 0
        return starts, moves, emits, total

    def update(self, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, mass: np.ndarray, prior: float = 50.0) -> Hmm:
        emit = emits + prior * mass[:, None]
        start, move = starts + 1.0, moves + 1.0
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def log10_likelihoods(self, texts: list[np.ndarray]) -> np.ndarray:
        """Exact log10 probability of each text's classes, by the scaled forward recursion. No text is empty."""
        s = len(self.start)
        n = np.array([len(x) for x in texts])
        flat, begin = np.concatenate(texts).astype(np.int64), np.cumsum(n) - n
        segments = -(-(n - 1) // SEGMENT)
        owner = np.repeat(np.arange(len(n)), segments)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)
        at = begin[owner] + 1 + part * SEGMENT
        size = np.minimum(SEGMENT, begin[owner] + n[owner] - at)
        order = np.argsort(-size, kind="stable")
        m = np.broadcast_to(np.eye(s), (len(owner), s, s)).copy()
        logs = np.zeros(len(owner))
        live = [int((size > t).sum()) for t in range(SEGMENT)]
        for t, k in enumerate(live):
            if k:
                step = (m[:k].reshape(-1, s) @ self.move).reshape(k, s, s)
                m[:k] = step * self.emit[flat[at[order[:k]] + t]][:, None, :]
            if k and t % 8 == 7:
                scale = m[:k].sum((1, 2))
                m[:k] /= scale[:, None, None]
                logs[order[:k]] += np.log10(scale)
        by_segment = np.empty_like(m)
        by_segment[order] = m
        alpha = self.start * self.emit[flat[begin]]
        out = np.log10(alpha.sum(1))
        alpha /= alpha.sum(1, keepdims=True)
        first = np.cumsum(segments) - segments
        for step in range(int(segments.max(initial=0))):
            who = np.flatnonzero(segments > step)
            seg = first[who] + step
            nxt = np.einsum("ds,dst->dt", alpha[who], by_segment[seg])
            scale = nxt.sum(1)
            alpha[who] = nxt / scale[:, None]
            out[who] += np.log10(scale) + logs[seg]
        return out


def _texts(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.int16) for x in column]


def _grouped(texts: list[np.ndarray], most: int = 400_000) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of texts of bounded size, with the place of the first."""
    at, size, begin = 0, 0, 0
    for at, x in enumerate(texts):
        size += len(x)
        if size >= most:
            yield begin, texts[begin : at + 1]
            begin, size = at + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def baum_welch(training: DataFrame, mass: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[Hmm, list[float]]:
    """Trains on the ``classes`` of all rows; also returns the log-likelihood that each round started from.

    ``mass`` is the share of each class, which the emissions begin with and are smoothed by. Rows that repeat count each; no
    row has an empty text, as all have an end. Without any row the model stays as it begins.
    """
    model, seen = Hmm.initial(mass, states), []
    sc = training.sparkSession.sparkContext
    width = states * (1 + states + len(mass))

    for _ in range(rounds):
        shared = sc.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums, likely, model = np.zeros(width), 0.0, shared.value
            for b in batches:
                for _, some in _grouped(_texts(b.column(0))):
                    *parts, total = model.expected(some)
                    sums += np.concatenate([p.ravel() for p in parts])
                    likely += total
            # slices of the counts, so that no task has to hold all partitions' counts whole
            for k, piece in enumerate(np.array_split(np.r_[sums, likely], 8)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([piece.tobytes()], pa.binary())], names=["slice", "sums"])

        sums = training.select("classes").mapInArrow(expect, "slice int, sums binary")
        # first within 64 groups, then over them
        part = sums.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("slice", "g").applyInArrow(_add, "slice int, sums binary")
        rows = part.groupBy("slice").applyInArrow(_add, "slice int, sums binary").collect()
        if not rows:
            break
        flat = np.concatenate([np.frombuffer(r["sums"]) for r in sorted(rows, key=lambda r: r["slice"])])
        starts, moves, emits = np.split(flat[:-1], [states, states + states * states])
        seen.append(float(flat[-1]))
        model = model.update(starts, moves.reshape(states, states), emits.reshape(len(mass), states), mass)
    return model, seen


def _add(key, table):
    total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def score(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: a row per row of ``df``.

    ``training`` marks the rows to learn from. Null and empty texts consist of their end alone. Rows that repeat id and
    text get the same scores. Without training rows all words are unseen and all latent parameters stay as they began.
    An empty table gives an empty result. Scores are log10 probabilities.
    """
    with temporary(df.sparkSession) as keep:
        return keep(_score(df, training, id_col, text_col, rounds), "lm-scores")


def _score(df: DataFrame, training: Column, id_col: str, text_col: str, rounds: int) -> DataFrame:
    ident, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    docs = df.select(ident.alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), (~training).alias("held_out")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    counts = materialise(word_counts(docs.filter(~F.col("held_out")).select("text"), "text"), "lm-counts")
    known = vocabulary(counts)
    codes = materialise(coded(docs, known, "text"), "lm-coded")
    model, _ = baum_welch(codes.filter(~F.col("held_out")), known.class_mass, rounds=rounds)
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "row_key", "held_out", "n_tokens", "head_known", "head_log", "head_within"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = shared.value
        for b in batches:
            texts = _texts(b.column("classes"))
            out = np.zeros(len(texts))
            for at, some in _grouped(texts):
                out[at : at + len(some)] = hmm.log10_likelihoods(some)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(out)], names=[*names, "latent"])

    latent = codes.select(*names, "classes").mapInArrow(run, T.StructType([*(codes.schema[n] for n in names), T.StructField("latent", T.DoubleType())]))
    words = codes.select("doc_id", "row_key", F.explode("tail").alias("w")).select("doc_id", "row_key", "w.*")
    at = F.col("k") + 1
    log_c = F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))
    of_class = lambda x: F.element_at(F.lit(x[OWN_CLASSES:].tolist()), at)
    within = F.when(F.col("c").isNull(), F.col("spelt") + of_class(known.unseen_log)).otherwise(log_c + of_class(known.seen_log))
    joined = words.join(counts, "token", "left").groupBy("doc_id", "row_key").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("seen"), F.sum(log_c * F.col("times")).alias("logs"), F.sum(within * F.col("times")).alias("within"))
    # equal rows add their words up here; dividing by their number undoes that
    same = codes.groupBy("doc_id", "row_key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
    sums = joined.select(F.col("doc_id").alias("s_id"), F.col("row_key").alias("s_key"), "seen", "logs", "within")
    same = same.select(F.col("doc_id").alias("r_id"), F.col("row_key").alias("r_key"), "rows")
    of = lambda c: F.coalesce(F.col(c) / F.coalesce("rows", F.lit(1)), F.lit(0.0))
    base = F.col("head_log") + of("logs") - F.col("n_tokens") * F.lit(float(np.log10(known.denominator)))
    return (
        latent.join(sums, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("row_key") == F.col("s_key")), "left")
        .join(same, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("row_key") == F.col("r_key")), "left")
        .withColumn("n_known", F.col("head_known") + F.round(of("seen")).cast("long"))
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known.n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("latent") + F.col("head_within") + of("within")).alias("score"))
    )


def digests(df: DataFrame) -> DataFrame:
    """The digest columns, which are those of ``score`` with its rules."""
    return score(df, crc_mod(F.col("doc_id"), 10) != 0)
