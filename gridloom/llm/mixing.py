"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order (by MD5 of seed and id), repeated up to ``epochs``
times. A document's virtual finish time is its source's cumulative words divided by the source's target.
Sorting all documents by finish time interleaves the sources in proportion to their targets; the mix is
the prefix that the budget holds.

Neither the queues nor the global order passes through one task: hashes cut a queue into as many ranges as the
root of its length, and finish times, along which words are spread evenly by construction, cut the global order
likewise. Sums over ranges come first, then only positions within a range are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import fresh, materialise, quoted, word_count

#: Weights of the sources by code point of their names, repeating.
WEIGHTS = (5, 2, 1)


def source_targets(sized: DataFrame, budget: float, weights: tuple[int, ...] = WEIGHTS, most: int = 2) -> DataFrame:
    """One row per source: ``source, n, source_size, target``.

    ``sized`` has ``source`` and ``size``. Targets share ``budget`` times all words by weight; none exceeds ``most``
    times its source's words, and what that cuts off is shared again. The level is found without iterating:
    with sources in order of cap by weight, it is the share that remains per weight at the first source
    that it does not fill. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_cap = Window.orderBy((F.lit(float(most)) * F.col("source_size")) / F.col("weight"), "pos")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.lit(float(most)) * F.col("source_size")
    rest = F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return (
        sized.groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
        .withColumn("pos", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("pos") % len(weights) + 1).cast("double"))
        .withColumn("level", rest / F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("place", F.when(F.col("level") * F.col("weight") <= cap, F.row_number().over(by_cap)))
        .withColumn("level", F.min_by("level", F.coalesce(F.col("place"), F.lit(1 << 30))).over(everything))
        .select("source", "n", "source_size", F.least(cap, F.col("level") * F.col("weight")).alias("target"))
    )


def allocate(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget: float = 1.5, weights: tuple[int, ...] = WEIGHTS, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """One row per row of ``df``: ``doc_id, source, text_hash, size, source_size, target, taken``.

    ``size`` is the number of words, 0 for null and empty texts, of which nothing is taken. ``taken`` counts
    words with repeats: a document is taken whole, up to ``epochs`` times. A null source is a source of
    its own, last in order. Ties in shuffle order go by id, then text hash; rows that repeat both are queued
    one after another. Rows without an id are shuffled by their texts. An empty table gives an empty result. Other columns of ``df`` are not looked at.
    """
    doc_id, source, text = (F.col(quoted(c)) for c in (id_col, source_col, text_col))
    sized = materialise(
        df.select(doc_id.alias("doc_id"), source.alias("source"), F.xxhash64(text).alias("text_hash"), word_count(text).alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), text, F.lit(""))).cast("binary")).alias("shuffle")),
        "mix-sized",
    )
    targets = materialise(source_targets(sized, budget, weights, epochs), "mix-targets")
    rows, words = targets.agg(F.sum("n"), F.sum("source_size")).first()
    named = targets.withColumnRenamed("source", "named")
    cut = F.ceil(F.sqrt("n"))
    ranged = sized.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named").withColumn("range", F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long") * cut / F.lit(1 << 32)))
    # words before each range of each queue; the sums are as many as roots of queue lengths
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    before = sums.select(F.col("source").alias("named"), F.col("range").alias("ranged"), (F.sum("in_range").over(Window.partitionBy("source").orderBy("range")) - F.col("in_range")).alias("before"))
    within = Window.partitionBy("source", "range").orderBy("shuffle", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("upto", F.sum("size").over(within)).join(before, F.col("source").eqNullSafe(F.col("named")) & (F.col("range") == F.col("ranged")))
    finishes = F.transform(
        F.sequence(F.lit(0), F.lit(epochs - 1)),
        lambda e: (F.col("before") + F.col("upto") + e * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target")),
    )
    queued = materialise(placed.withColumn("finish", F.when(F.col("size") > 0, finishes)).drop("named", "ranged", "before", "upto", "range", "n"), "mix-queued")
    return _truncate(queued, int(rows or 0), int(words or 0), budget).drop("finish", "shuffle")


def _truncate(queued: DataFrame, rows: int, words: int, budget: float) -> DataFrame:
    """Adds ``taken``: the words of the entries whose global cumulative words stay within the budget."""
    cuts = max(1, int((2 * rows) ** 0.5))
    entry = queued.filter(F.col("size") > 0).select("source", "doc_id", "text_hash", "shuffle", "size", F.explode("finish").alias("at")).filter(F.col("at").isNotNull()).withColumn("range", F.floor(F.col("at") * cuts))
    per_range = entry.groupBy("range").agg(F.sum("size").alias("in_range"))
    # as many rows as the root of the table's length
    upto = per_range.withColumn("upto", F.sum("in_range").over(Window.orderBy("range")))
    crossing = upto.filter(F.col("upto") > budget * words).orderBy("range").select("range", (F.col("upto") - F.col("in_range")).alias("before")).first()
    if crossing is None:
        share = F.size(F.filter("finish", lambda x: x.isNotNull()))
    else:
        order = F.struct("at", F.col("source").isNull().alias("no_source"), "source", "shuffle", "doc_id", "text_hash")
        last = (
            entry.filter(F.col("range") == crossing["range"])
            .withColumn("key", order)
            .withColumn("upto", F.sum("size").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.lit(crossing["before"]))
            .filter(F.col("upto") > budget * words)
            .orderBy("key")
            .select("key")
            .limit(1)
        )
        first_out = last.first()["key"]
        held = F.struct(*(F.lit(v).cast(t).alias(n) for n, v, t in zip(("at", "no_source", "source", "shuffle", "doc_id", "text_hash"), first_out, ("double", "boolean", "string", "string", queued.schema["doc_id"].dataType.simpleString(), "long"), strict=True)))

        def inside(x):
            return x.isNotNull() & (F.struct(x.alias("at"), F.col("source").isNull().alias("no_source"), "source", "shuffle", "doc_id", "text_hash") < held)

        share = F.size(F.filter("finish", inside))
    return queued.withColumn("taken", F.when(F.col("size") > 0, share * F.col("size")).otherwise(F.lit(0)).cast("long"))


#: The same mix in DuckDB SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), text, '')) AS shuffle,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS pos FROM s),
w AS (SELECT *, CAST(CASE pos % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM p),
l AS (SELECT *, row_number() OVER (ORDER BY cap / weight, pos) AS rn,
        (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, rn) FROM l WHERE level * weight <= cap)) AS target FROM l),
q AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT doc_id, source, shuffle, size, CAST(upto + k * source_size AS DOUBLE) / target AS finish
      FROM q, (SELECT unnest([0, 1]) AS k) WHERE size > 0 AND target > 0),
g AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source IS NULL, source, shuffle, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM e),
k AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM g WHERE total <= 1.5::DOUBLE * (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0) AS taken FROM q LEFT JOIN k ON q.doc_id = k.doc_id
"""


def digests(df: DataFrame) -> DataFrame:
    """The digest columns of ``allocate``: one row per row, with its rules for nulls, ties and repeated rows."""
    return allocate(df).select("doc_id", "size", "source_size", "target", "taken")


def mix(df: DataFrame, **options) -> DataFrame:
    """``df`` with every document as often as the mix takes it: not at all, once or up to ``epochs`` times.

    Of rows that repeat id, source and text, those come more often whose other columns hash lower, so that together they
    come as often as ``allocate`` takes them. Nulls are ids, sources and texts like others; a null or empty text is not taken.
    Column names are free; an empty table stays empty.
    """
    own_id, own_source, own_hash, total, rows, text_hash, nth, copy = fresh(df, "mix_id", "mix_source", "mix_hash", "mix_total", "mix_rows", "mix_text", "mix_nth", "mix_copy")
    times = allocate(df, **options).withColumn("times", F.coalesce(F.expr("taken div nullif(size, 0)"), F.lit(0)))
    times = times.groupBy(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("text_hash").alias(own_hash)).agg(F.sum("times").alias(total), F.count(F.lit(1)).alias(rows))
    times = materialise(times.filter(F.col(total) > 0), "mix-times")
    source, ident, text = (F.col(quoted(options.get(k, v))) for k, v in (("source_col", "source"), ("id_col", "doc_id"), ("text_col", "text")))
    joined = df.withColumn(text_hash, F.xxhash64(text)).join(times, ident.eqNullSafe(F.col(own_id)) & source.eqNullSafe(F.col(own_source)) & (F.col(text_hash) == F.col(own_hash)))
    each = F.floor(F.col(total) / F.col(rows)).cast("int")
    if not times.filter(F.col(total) % F.col(rows) != 0).isEmpty():
        # a few of the repeated rows come once more than the others
        plain = [F.col(quoted(f.name)) for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
        by = Window.partitionBy(own_id, own_source, own_hash).orderBy(F.xxhash64(*plain))
        joined = joined.withColumn(nth, F.row_number().over(by))
        each = each + (F.col(nth) <= F.col(total) % F.col(rows)).cast("int")
    taken = joined.withColumn(copy, each).filter(F.col(copy) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(*(F.col(quoted(c)) for c in df.columns))
