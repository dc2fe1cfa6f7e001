"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in halves, each half has a codebook, and the pairs of nearest codewords form a product grid.
From a query, the multi-sequence algorithm visits cells nearest first: by the sum of what each half would have to
move, squared, to fall to the cell's codeword. That distance to the border between two codewords is exact, so
visiting all cells within 2 - 2 cos finds every link. Far fewer will do: a sample of queries is compared with
all vectors first, and the visits stop at the cost within which the target share of the sample's links lies, times a
margin. Members of the visited cells are verified by their cosine in double precision. A link that either end finds counts
for both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import materialise, quoted, slices, temporary
from gridloom.operators.components import connected_components, smallest_reached

#: Rows that the codebooks are fitted on, at most about; queries of the recall sample; vectors to a cell on average; rows of a block.
SAMPLE_ROWS, PROBES, CELL_ROWS, BLOCK_ROWS = 20_000, 1024, 32, 4096
#: Codewords of a half at most; bins that costs are counted in; what the measured cost is multiplied with.
CODEWORDS, BINS, MARGIN = 4096, 4096, 2.0


def codebook(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly drawn points; an empty codeword keeps its place."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def squared_distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :]


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return squared_distances(points, centres).argmin(1)


def moves(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance that each point lies from the border between its own and each other codeword."""
    d = squared_distances(points, centres)
    own = d.argmin(1)
    apart = np.sqrt(np.maximum(squared_distances(centres, centres), 1e-300))[own]
    step = (d - d[np.arange(len(d)), own][:, None]) / (2 * apart)
    step[np.arange(len(d)), own] = 0
    return np.maximum(step, 0) ** 2


def traverse(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The multi-sequence order of cells, for many queries in step: the n-th round yields the n-th nearest cell of each
    query, as (queries, rows, columns). A query leaves when its next cell costs more than ``limit``.

    Every row of the grid keeps a pointer to its next column; the least of the rows' next costs is the next cell.
    """
    a, b = np.argsort(first, axis=1, kind="stable"), np.argsort(second, axis=1, kind="stable")
    row, column = np.take_along_axis(first, a, 1), np.take_along_axis(second, b, 1)
    wide = max(1, int((row <= limit).sum(1).max(initial=0)))
    live, head = np.arange(len(first)), np.zeros((len(first), wide), np.int64)
    cost = row[:, :wide] + column[:, :1]
    while len(live):
        i = cost.argmin(1)
        at = np.arange(len(live))
        stay = cost[at, i] <= limit
        live, head, cost, i = live[stay], head[stay], cost[stay], i[stay]
        at = np.arange(len(live))
        j = head[at, i]
        if len(live):
            yield live, a[live, i], b[live, j]
        more = j + 1 < column.shape[1]
        head[at, i] = j + 1
        cost[at, i] = np.where(more, row[live, i] + column[live, np.minimum(j + 1, column.shape[1] - 1)], np.inf)


def units(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, dim, u``: the bytes of each unit vector in doubles, null where a vector links with nothing."""
    rows = df.select(F.col(quoted(id_col)).alias("vec_id"), F.col(quoted(vec_col)).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                ids, column = b.column("vec_id"), b.column("v")
                size = pa.compute.list_value_length(column).fill_null(0).to_numpy()
                flat = pa.compute.list_flatten(column).to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
                begin = np.cumsum(size) - size
                out: list[bytes | None] = [None] * len(b)
                for d in np.unique(size[size > 0]).tolist():
                    at = np.flatnonzero(size == d)
                    v = flat[begin[at][:, None] + np.arange(d)]
                    good = np.isfinite(v).all(1) & (v != 0).any(1)
                    at, v = at[good], v[good]
                    # a power of two makes tiny and huge vectors safe to square, and changes no digit
                    v = np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])
                    v = v / np.sqrt((v * v).sum(1))[:, None] + 0.0
                    for k, x in zip(at.tolist(), v, strict=True):
                        out[k] = x.tobytes()
                null = ids.is_null().to_pylist()
                yield pa.RecordBatch.from_arrays([ids, pa.array(size.astype(np.int32)), pa.array([None if n else x for n, x in zip(null, out, strict=True)], pa.binary())], names=["vec_id", "dim", "u"])

    return rows.mapInArrow(run, T.StructType([rows.schema["vec_id"], T.StructField("dim", T.IntegerType()), T.StructField("u", T.BinaryType())]))


def links(df: DataFrame, cosine: float = 0.95, target_recall: float = 0.9999, id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``df``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and neither do
    vectors of different dimensions. Equal vectors are gathered first and searched once, so a vector that a third of
    the rows repeat costs one search. Rows that repeat an id each count as a vector. A null id has no links
    and a null component. An empty table gives an empty result; further columns are not looked at. Blocks of members meet
    blocks of queries; each block pair returns a few rows per vertex.
    """
    with temporary(df.sparkSession) as keep:
        return keep(_links(df, cosine, target_recall, id_col, vec_col, sample_rows), "imi-result")


def _links(df: DataFrame, cosine: float, target_recall: float, id_col: str, vec_col: str, sample_rows: int) -> DataFrame:
    rows = materialise(units(df, id_col, vec_col), "imi-units")
    reps = materialise(rows.filter(F.col("u").isNotNull()).groupBy("dim", "u").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "imi-reps")
    found = [_search(reps.filter(F.col("dim") == d).select("rep", "copies", "u"), d, n, cosine, target_recall, sample_rows) for d, n in reps.groupBy("dim").count().collect()]
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionAll(more)
    pairs = materialise(pairs, "imi-links")
    counts = pairs.groupBy("vec_id").agg(F.sum("links").alias("far")).withColumnRenamed("vec_id", "rep")
    comps = connected_components(pairs.filter(F.col("other") != F.col("vec_id")), "vec_id", "other").select(F.col("id").alias("rep"), "component")
    # only vectors that are repeated need to look up their representative
    twice = reps.filter(F.col("copies") > 1).select(F.col("u").alias("tu"), F.col("rep").alias("of"), "copies")
    named = rows.join(twice, F.col("u") == F.col("tu"), "left").select("vec_id", F.col("u").isNotNull().alias("fine"), F.coalesce("of", "vec_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    about = counts.join(comps, "rep", "full")
    out = named.join(about, "rep", "left")
    links_of = F.when(F.col("fine"), F.coalesce("far", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long")
    component = F.when(F.col("fine"), F.coalesce("component", "rep")).otherwise(F.col("vec_id"))
    return out.select("vec_id", links_of.alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


class _Index:
    """Codebooks of both halves."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = max(1, sample.shape[1] // 2)
        k = max(1, min(k, len(sample)))
        self.books = (codebook(self._halves(sample)[0], k), codebook(self._halves(sample)[1], k if sample.shape[1] > self.half else 1))

    def _halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v[:, : self.half], v[:, self.half :] if v.shape[1] > self.half else np.zeros((len(v), 1))

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(nearest(h, b) for h, b in zip(self._halves(v), self.books, strict=True))

    def moves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(moves(h, b) for h, b in zip(self._halves(v), self.books, strict=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def visit_limit(reps: DataFrame, index: _Index, probes: np.ndarray, probe_ids: np.ndarray, dim: int, cosine: float, target_recall: float) -> float:
    """The cost at which visits stop, measured: all links of the ``probes`` are counted by what finding them costs.

    Without any link to measure, or with a target of 1, all that is within 2 - 2 cos.
    """
    whole = 2 - 2 * cosine
    if target_recall >= 1 or not len(probes):
        return whole + 1e-9
    shared = reps.sparkSession.sparkContext.broadcast((index, probes, probe_ids, index.moves(probes)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, probes, ids, (first, second) = shared.value
        sums = np.zeros(BINS + 1, np.int64)
        for whole_batch in batches:
            for b in slices(whole_batch):
                v = _matrix(b.column("u"), dim)
                own = b.column("rep").to_numpy()
                one, two = index.cells(v)
                p, m = np.nonzero((probes @ v.T >= cosine) & (ids[:, None] != own[None, :]))
                cost = first[p, one[m]] + second[p, two[m]]
                sums += np.bincount(np.ceil(np.minimum(cost / whole, 1) * BINS).astype(int), minlength=BINS + 1)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["bin", "n"])

    bins = np.zeros(BINS + 1)
    for r in reps.select("rep", "u").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        bins[r["bin"]] = r["n"]
    if not bins.sum():
        return whole + 1e-9
    upto = int(np.flatnonzero(np.cumsum(bins) >= target_recall * bins.sum() - 1e-9)[0])
    return min(1.0, MARGIN * max(upto, 1) / BINS) * whole + 1e-9


def _search(reps: DataFrame, dim: int, n: int, cosine: float, target_recall: float, sample_rows: int) -> DataFrame:
    """``vec_id, other, links``: partial link counts, and for each vertex of a block pair the smallest it reaches there."""
    spark = reps.sparkSession
    draw = F.pmod(F.xxhash64("rep"), F.lit(1 << 20))
    drawn = reps.filter(draw < F.lit(min(1.0, sample_rows / n) * (1 << 20))).select("rep", "u", draw.alias("draw")).orderBy("draw", "rep").limit(2 * sample_rows).toArrow()
    sample = _matrix(drawn.column("u"), dim) if len(drawn) else np.zeros((1, dim))
    index = _Index(sample, int(min(CODEWORDS, max(1, math.sqrt(n / CELL_ROWS)))))
    limit = visit_limit(reps, index, sample[:PROBES] if len(drawn) else sample[:0], drawn.column("rep").to_numpy()[:PROBES], dim, cosine, target_recall)
    shared = spark.sparkContext.broadcast(index)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each row of the grid that a vector visits, with the columns it visits there; its own cell comes first of all."""
        for whole in batches:
            for b in slices(whole):
                v = _matrix(b.column("u"), dim)
                one, two = shared.value.cells(v)
                seen = [np.stack(x, 1) for x in traverse(*shared.value.moves(v), limit)]
                seen = np.concatenate(seen)[:, [0, 1, 2]]
                seen = seen[np.lexsort((seen[:, 1], seen[:, 0]))]
                new = np.flatnonzero(np.r_[True, (np.diff(seen[:, :2], axis=0) != 0).any(1)])
                q, row = seen[new, 0], seen[new, 1]
                columns = [x.astype(np.uint16).tobytes() for x in np.split(seen[:, 2], new[1:])]
                pick = pa.array(q)
                yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), *(b.column(c).take(pick) for c in ("rep", "copies", "u")), pa.array(columns, pa.binary()), pa.array(row == one[q]), pa.array(two[q].astype(np.int32))], names=["row", "rep", "copies", "u", "columns", "own", "cell"])

    placed = materialise(reps.mapInArrow(cells, "row int, rep long, copies long, u binary, columns binary, own boolean, cell int"), "imi-cells")
    sizes = placed.groupBy("row").agg(F.ceil(F.sum(F.col("own").cast("int")) / BLOCK_ROWS).alias("m_blocks"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("q_blocks")).filter(F.col("m_blocks") > 0)
    sided = placed.join(sizes, "row")
    part = lambda name: F.pmod(F.xxhash64("rep"), F.col(name)).cast("int")
    inside = sided.filter("own").select("row", part("m_blocks").alias("mb"), F.explode(F.sequence(F.lit(0), (F.col("q_blocks") - 1).cast("int"))).alias("qb"), "rep", "copies", "u", "cell")
    asking = sided.select(F.col("row").alias("q_row"), F.explode(F.sequence(F.lit(0), (F.col("m_blocks") - 1).cast("int"))).alias("q_mb"), part("q_blocks").alias("q_qb"), F.col("rep").alias("q_rep"), F.col("copies").alias("q_copies"), F.col("u").alias("q_u"), F.col("columns").alias("q_columns"))

    def meet(key, left, right):
        none = pa.table({"vec_id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        if not len(left) or not len(right):
            return none
        ids, q_ids = left.column("rep").to_numpy(), right.column("q_rep").to_numpy()
        m, q = _matrix(left.column("u"), dim), _matrix(right.column("q_u"), dim)
        cell = left.column("cell").to_numpy()
        allowed = np.zeros((len(q), len(shared.value.books[1])), bool)
        for i, c in enumerate(right.column("q_columns").to_pylist()):
            allowed[i, np.frombuffer(c, np.uint16)] = True
        hits_q, hits_m = [], []
        for j in np.unique(cell):
            who, where = np.flatnonzero(allowed[:, j]), np.flatnonzero(cell == j)
            if len(who):
                a, b = np.nonzero((q[who] @ m[where].T >= cosine) & (q_ids[who][:, None] != ids[where][None, :]))
                hits_q.append(who[a])
                hits_m.append(where[b])
        a, b = (np.concatenate(h) if h else np.zeros(0, np.int64) for h in (hits_q, hits_m))
        if not len(a):
            return none
        every, place = np.unique(np.concatenate([q_ids, ids]), return_inverse=True)
        count = np.zeros(len(every), np.int64)
        np.add.at(count, place[a], left.column("copies").to_numpy()[b])
        # the member counts the link here if its own visits do not lead to the query
        used, of = np.unique(b, return_inverse=True)
        first, second = shared.value.moves(m[used])
        one, two = shared.value.cells(q)
        deaf = first[of, one[a]] + second[of, two[a]] > limit
        np.add.at(count, place[len(q_ids) + b[deaf]], right.column("q_copies").to_numpy()[a[deaf]])
        label = smallest_reached(len(every), place[a], place[len(q_ids) + b])
        told, some = np.flatnonzero(label != np.arange(len(every))), np.flatnonzero(count)
        return pa.table({"vec_id": np.concatenate([every[some], every[told]]), "other": np.concatenate([every[some], every[label[told]]]), "links": np.concatenate([count[some], np.zeros(len(told), np.int64)])})

    return inside.groupBy("row", "mb", "qb").cogroup(asking.groupBy("q_row", "q_mb", "q_qb")).applyInArrow(meet, "vec_id long, other long, links long")


def digests(df: DataFrame) -> DataFrame:
    """The digest columns, which are those of ``links`` with its rules."""
    return links(df.select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(id, l) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.l FROM r JOIN p ON r.id = p.a WHERE p.b > r.l),
c AS (SELECT id, min(l) AS component_id FROM r GROUP BY id)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.id LEFT JOIN (SELECT a, count(*) AS n_links FROM p GROUP BY a) n ON v.vec_id = n.a
"""
