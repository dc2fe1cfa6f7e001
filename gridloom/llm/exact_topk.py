"""Exact top-k search by inner product with a vector-approximation file.

Components become integers, floor(scale * x). The approximation file keeps, next to each exact vector, one small
cell number per component; a table of cell borders turns those into an upper and a lower bound of the inner product
with any query. A first scan reads the approximations alone: the k-th highest lower bound over all blocks is a
floor for the k-th result. The second scan, of the approximations too, names the vectors whose upper bound reaches that
floor; exact vectors are read for those block pairs alone, in order of the bound, until the k-th result is certain.

Queries and candidates travel in blocks of bounded size, and every query block meets every candidate block once;
a block pair returns k rows a query at most. That is work in proportion to queries times candidates, as an exact search
against a stated query set is; blocks spread it evenly over any number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm.common import materialise, quoted, temporary

#: Rows of a candidate block and of a query block, bits of a cell number, and copies of a query block that share its candidates.
CANDIDATES, QUERIES, CELL_BITS, SALTS = 4096, 512, 4, 16
_LONG = (-(1 << 63), (1 << 63) - 1)


def scaled(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """``vec_id, v``: scale * x as array<double>, of which the floor is taken where blocks are packed.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids.
    """
    x = F.col(quoted(vec_col)).cast("array<double>")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.filter(fine & F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.transform(x, lambda c: c * F.lit(float(scale))).alias("v"))


def blocks(vectors: DataFrame, rows: int, label: str) -> tuple[DataFrame, int]:
    """``block, n, dim, ids, data``: the vectors of each dimension packed in blocks of about ``rows`` rows; and the number of blocks."""
    count = vectors.count()
    cut = max(1, -(-count // rows))
    dealt = vectors.select(F.pmod(F.xxhash64("vec_id", F.lit(label)), F.lit(cut)).alias("block"), F.size("v").alias("dim"), "vec_id", "v")
    schema = "block long, dim int, n int, ids binary, data binary"

    def pack(key, t):
        ids = t.column("vec_id").combine_chunks().to_numpy()
        data = np.floor(np.nan_to_num(pa.compute.list_flatten(t.column("v")).to_numpy())).reshape(len(ids), -1)
        order = np.lexsort((data.T[0], ids))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "data": pa.array([np.ascontiguousarray(data[order]).tobytes()], pa.binary())})

    return dealt.groupBy("block", "dim").applyInArrow(pack, schema), cut


def approximate(data: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers (uint8, n x d) and borders ((2^bits + 1) x d): equally filled cells, each closed by its extremes."""
    cells = 1 << bits
    cut = np.quantile(data, np.linspace(0, 1, cells + 1)[1:-1], axis=0, method="lower")
    codes = np.empty(data.shape, np.uint8)
    for j in range(data.shape[1]):
        codes[:, j] = np.searchsorted(cut[:, j], data[:, j], side="right")
    borders = np.vstack([data.min(0), cut, data.max(0)])
    return codes, borders


def bounds(codes: np.ndarray, borders: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of the coded vectors with ``query`` rows (q x n each).

    A vector's product lies within (half widths) . |query| of the product with its cells' middles.
    """
    at = np.arange(codes.shape[1])
    low, high = borders[codes, at], borders[codes + 1, at]
    mid, half = low / 2 + high / 2, high / 2 - low / 2
    with np.errstate(over="ignore", invalid="ignore"):
        centre, slack = query @ mid.T, np.abs(query) @ half.T
        # sums of doubles: leave room for rounding, by the size of what is added up
        slack += 1e-9 * (np.abs(query) @ np.abs(mid).T + slack) + 1e-6
        lower, upper = centre - slack, centre + slack
    # beyond what doubles hold, nothing is known
    unknown = ~(np.isfinite(lower) & np.isfinite(upper))
    return np.where(unknown, -np.inf, lower), np.where(unknown, np.inf, upper)


def _unpack(b: bytes, n: int, kind, dim: int | None = None) -> np.ndarray:
    a = np.frombuffer(b, kind, n * (dim or 1))
    return a.reshape(n, dim) if dim else a


def _products(data: np.ndarray, query: np.ndarray) -> list[int]:
    """Exact integer inner products, by doubles while those are exact, else by Python's integers; what a long cannot hold
    counts as the nearest that it can."""
    if np.abs(data).max(initial=0) * np.abs(query).max(initial=0) * max(1, data.shape[-1]) < 2.0**53:
        return (data @ query).astype(np.int64).tolist()
    whole = [int(x) for x in query]
    return [min(max(sum(int(a) * b for a, b in zip(row, whole, strict=True)), _LONG[0]), _LONG[1]) for row in data]


def search(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the ``k`` highest scores among rows of ``df``
    with another id, all if there are fewer; ties go to the smaller id.

    Rows that repeat an id are candidates each for themselves, and a repeated query id gives one result, that of
    its smallest vector. Vectors of another dimension than the query's are no candidates. Scores that a long cannot hold
    count as the nearest that it can. Empty tables give none; further columns are not looked at.
    """
    with temporary(df.sparkSession) as keep:
        return keep(_search(df, queries, k, id_col, vec_col, scale), "va-result")


def _search(df: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, scale: float) -> DataFrame:
    cand = scaled(df, id_col, vec_col, scale)
    quer = scaled(queries, id_col, vec_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    file_schema = T.StructType([T.StructField(n, t) for n, t in (("block", T.LongType()), ("dim", T.IntegerType()), ("n", T.IntegerType()), ("ids", T.BinaryType()), ("codes", T.BinaryType()), ("borders", T.BinaryType()), ("data", T.BinaryType()))])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                codes, borders = approximate(_unpack(r["data"], r["n"], np.float64, r["dim"]), CELL_BITS)
                row = [[r["block"]], [r["dim"]], [r["n"]], [r["ids"]], [codes.tobytes()], [borders.tobytes()], [r["data"]]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=file_schema.names)

    va = materialise(blocks(cand, CANDIDATES, "candidates")[0].mapInArrow(coded, file_schema), "va-file")
    packed, q_cut = blocks(quer, QUERIES, "queries")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    q = materialise(packed.select(F.col("block").alias("q_block"), F.col("dim").alias("q_dim"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "va-queries")
    met = va.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_cut - 1).cast("long"))))

    def meet(left: DataFrame) -> DataFrame:
        """Every row of ``left`` with its block of queries; a block's partners are spread over ``SALTS`` tasks."""
        right = q.select(F.col("q_block").alias("r_block"), F.col("q_dim").alias("r_dim"), "q_n", "q_ids", "q_data", salt.alias("r_salt"))
        return left.join(right, (F.col("q_block") == F.col("r_block")) & (F.col("dim") == F.col("r_dim")) & (F.pmod("block", F.lit(SALTS)) == F.col("r_salt"))).drop("r_block", "r_dim", "r_salt")

    def bounded(r: dict) -> tuple[np.ndarray, ...]:
        ids, q_ids = _unpack(r["ids"], r["n"], np.int64), _unpack(r["q_ids"], r["q_n"], np.int64)
        codes, borders = np.frombuffer(r["codes"], np.uint8).reshape(r["n"], r["dim"]), np.frombuffer(r["borders"]).reshape(-1, r["dim"])
        return ids, q_ids, *bounds(codes, borders, _unpack(r["q_data"], r["q_n"], np.float64, r["dim"]))

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k highest lower bounds of each query within a block."""
        for b in batches:
            for r in b.to_pylist():
                ids, q_ids, low, _ = bounded(r)
                low[q_ids[:, None] == ids[None, :]] = -np.inf
                top = -np.sort(-low, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, top.shape[1])), pa.array(np.full(top.size, r["dim"], np.int32)), pa.array(np.full(top.size, r["q_block"], np.int64)), pa.array(top.ravel())], names=["query_id", "dim", "q_block", "low"])

    scan = met.select("block", "dim", "n", "q_block", "ids", "codes", "borders")
    lows = meet(scan).mapInArrow(lower, "query_id long, dim int, q_block long, low double")
    # the window keeps k rows a query and task before the shuffle
    best = Window.partitionBy("query_id", "dim", "q_block").orderBy(F.desc("low"))
    floors = lows.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).groupBy("query_id", "dim", "q_block").agg(F.min("low").alias("floor"), (F.count(F.lit(1)) >= k).alias("full"))
    floors = floors.groupBy("q_block", "dim").agg(F.map_from_entries(F.collect_list(F.struct("query_id", F.when(F.col("full"), F.col("floor")).otherwise(F.lit(float("-inf"))).alias("floor")))).alias("floors"))
    floors = materialise(floors, "va-floors")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block pair the vectors whose upper bound reaches the floor, highest bound first; none if there is none."""
        for b in batches:
            for r in b.to_pylist():
                ids, q_ids, _, high = bounded(r)
                floor = dict(r["floors"])
                who, rows, bound = [], [], []
                for i, q_id in enumerate(q_ids.tolist()):
                    near = np.flatnonzero((high[i] >= floor.get(q_id, -np.inf)) & (ids != q_id))
                    near = near[np.argsort(-high[i][near], kind="stable")]
                    who.append(np.full(len(near), i, np.int32))
                    rows.append(near.astype(np.int32))
                    bound.append(high[i][near])
                if sum(map(len, rows)):
                    packed = [np.concatenate(x).tobytes() for x in (who, rows, bound)]
                    yield pa.RecordBatch.from_arrays([pa.array([r["block"]]), pa.array([r["dim"]], pa.int32()), pa.array([r["q_block"]]), *(pa.array([x], pa.binary()) for x in packed)], names=["block", "dim", "q_block", "who", "rows", "high"])

    near = meet(scan).join(floors, ["q_block", "dim"]).mapInArrow(passing, "block long, dim int, q_block long, who binary, rows binary, high binary")

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact products of what passed, highest bound first, until no bound reaches the k-th of them."""
        for b in batches:
            for r in b.to_pylist():
                ids, q_ids = _unpack(r["ids"], r["n"], np.int64), _unpack(r["q_ids"], r["q_n"], np.int64)
                query, data = _unpack(r["q_data"], r["q_n"], np.float64, r["dim"]), _unpack(r["data"], r["n"], np.float64, r["dim"])
                who, rows, high = np.frombuffer(r["who"], np.int32), np.frombuffer(r["rows"], np.int32), np.frombuffer(r["high"])
                cuts = np.searchsorted(who, np.arange(r["q_n"] + 1))
                out: list[tuple] = []
                for i, q_id in enumerate(q_ids.tolist()):
                    some, bound = rows[cuts[i] : cuts[i + 1]], high[cuts[i] : cuts[i + 1]]
                    best: list[tuple] = []
                    for at in range(0, len(some), 64):  # exact vectors in order of the bound
                        if len(best) == k and bound[at] < -best[-1][0]:
                            break
                        few = some[at : at + 64]
                        best = sorted([*best, *((-s, int(v)) for s, v in zip(_products(data[few], query[i]), ids[few], strict=True))])[:k]
                    out += ((q_id, v, -s) for s, v in best)
                cols = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    exact = near.join(va.select(F.col("block").alias("e_block"), F.col("dim").alias("e_dim"), "n", "ids", "data"), (F.col("block") == F.col("e_block")) & (F.col("dim") == F.col("e_dim"))).drop("e_block", "e_dim")
    found = meet(exact).mapInArrow(refine, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digests(df: DataFrame) -> DataFrame:
    """The digest columns: the search for every row whose id is divisible by 50, against all rows."""
    return search(df, df.filter(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
