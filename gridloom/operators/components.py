"""Connected components of an edge table, by local forests and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.scratch import materialise, temporary

#: Edges that a task holds at once.
HELD_EDGES = 500_000


def smallest_reached(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` vertices reaches along the edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        for at in (left, right, label[left], label[right]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _distinct(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Position of one of each distinct value, in order of the values, and every element's place in that order."""
    if pa.types.is_struct(ids.type):
        columns = [ids.field(k).to_numpy(zero_copy_only=False) for k in range(ids.type.num_fields)]
        order = np.lexsort(columns[::-1])
        new = np.r_[True, np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return order[new], place
    coded = ids.dictionary_encode()
    order = pa.compute.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = rank[coded.indices.to_numpy()]
    first = np.empty(len(order), np.int64)
    first[place[::-1]] = np.arange(len(place))[::-1]
    return first, place


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vertex, smallest vertex that it reaches within this task's edges)."""
    held, rows = [], 0

    def out() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        ids = pa.concat_arrays([t.column(k).chunk(0) for k in (0, 1)])
        first, place = _distinct(ids)
        root = smallest_reached(len(first), place[: len(t)], place[len(t) :])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), ids.take(pa.array(first[root]))], names=["id", "root"])

    for b in batches:
        if len(b):
            held.append(b)
            rows += len(b)
        if rows >= HELD_EDGES:
            yield out()
            held, rows = [], 0
    if held:
        yield out()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component``: every id that an edge names, and the smallest id it can reach.

    Every task first replaces its edges by a forest of stars, which leaves one row a vertex and task however many
    edges a hub has; graphs whose parts lie together, as those of one image do, are done then. Where a vertex
    has different roots in different tasks, those roots are joined and contracted in rounds: each round points every
    vertex at its smallest neighbour, jumps pointers twice and contracts the edges, so that the graph shrinks
    geometrically. Minima are combined before each shuffle; the join of a hub's rows is left to the
    skew handling of adaptive execution, as the other side has one row for each vertex.

    Edges with a null end are ignored; loops name their vertex. Repeated edges count once. Ids are integers, strings, binary,
    or structs of integers. An empty table gives an empty result.
    """
    spark = edges.sparkSession
    named = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    kind = named.schema["a"].dataType
    star_type = T.StructType([T.StructField("id", kind), T.StructField("root", kind)])
    with temporary(spark) as keep:
        stars = materialise(named.mapInArrow(_forest, star_type), "cc-stars")
        lowest = stars.groupBy("id").agg(F.min("root").alias("component"), F.max("root").alias("highest"))
        lowest = materialise(lowest.select("id", "component", (F.col("component") != F.col("highest")).alias("torn")), "cc-lowest")
        torn = lowest.filter("torn").select("id", F.col("component").alias("p"))
        live = materialise(stars.join(torn, "id").filter(F.col("root") != F.col("p")).select(F.col("p").alias("a"), F.col("root").alias("b")).distinct(), "cc-live")
        labels = lowest.select("id", "component")
        while True:
            both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
            up = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")), "cc-up")
            if up.isEmpty():
                return keep(labels, "cc-labels")
            for _ in range(2):
                above = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
                up = up.join(above, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
            up = materialise(up, "cc-up")
            # the maps of all rounds are applied one after another in a single job at the end
            labels = labels.join(up.select(F.col("a").alias("component"), "p"), "component", "left").select("id", F.coalesce("p", "component").alias("component"))
            ends = live.join(up, "a").select(F.col("p").alias("x"), F.col("b").alias("a")).join(up, "a").select(F.col("x").alias("a"), F.col("p").alias("b"))
            live = materialise(ends.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-live")
