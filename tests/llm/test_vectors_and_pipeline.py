"""Vector operators and the pipeline."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import exact_topk, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def odd_vectors(spark):
    rows = [(0, None, 1), (50, [0.0, 0.0], 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (100, [1.0, 0.0], 1), (6, [1.0, 0.0], 1), (7, [2.0, 0.0], 1), (8, [0.0, 1.0], None), (8, [0.0, 1.0], None), (9, [1.0, 0.0, 0.0], 1)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("rep", F.lit(1)).withColumn("N_LINKS", F.lit(1))


def test_links_of_odd_vectors(spark):
    got = sorted((r.vec_id, r["n_links"], r.component_id) for r in vector_dedup.links(odd_vectors(spark)).collect())
    assert got == [(0, 0, 0), (2, 0, 2), (3, 0, 3), (4, 0, 4), (6, 2, 6), (7, 2, 6), (8, 1, 8), (8, 1, 8), (9, 0, 9), (50, 0, 50), (100, 2, 6)]
    assert vector_dedup.links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_recall(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(150, 32))
    v = np.vstack([base, *(base + rng.normal(size=base.shape) * s for s in (0.05, 0.2, 0.3))])
    u = v / np.linalg.norm(v, axis=1)[:, None]
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    rows = [(k, [float(x) for x in r], 0) for k, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    exact = {r.vec_id: r["n_links"] for r in vector_dedup.links(df, target_recall=1.0).collect()}
    assert [exact[k] for k in range(len(v))] == close.sum(1).tolist()
    fast = vector_dedup.links(df, target_recall=0.999).agg(F.sum("n_links")).first()[0]
    assert fast >= 0.9 * close.sum()


def test_multi_sequence_order():
    rng = np.random.default_rng(4)
    first, second = rng.random((20, 5)), rng.random((20, 7))
    seen = {q: [] for q in range(20)}
    for who, row, column in vector_dedup.traverse(first, second, 0.75):
        for q, i, j in zip(who.tolist(), row.tolist(), column.tolist(), strict=True):
            seen[q].append((i, j))
    for q, cells in seen.items():
        cost = [first[q, i] + second[q, j] for i, j in cells]
        assert cost == sorted(cost) and len(set(cells)) == len(cells) == sum(a + b <= 0.75 for a in first[q] for b in second[q])


def test_measured_stop_keeps_recall_and_symmetry(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(700, 16))
    v = np.vstack([base, base + 0.12 * rng.normal(size=base.shape), base[:200] + 0.2 * rng.normal(size=(200, 16))])
    u = v / np.linalg.norm(v, axis=1)[:, None]
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r["n_links"] for r in vector_dedup.links(df).collect()}
    assert sum(got.values()) >= 0.99 * close.sum() and all(got[k] <= n for k, n in enumerate(close.sum(1)))
    assert sum(got.values()) % 2 == 0


def test_topk_of_huge_components(spark):
    df = spark.createDataFrame([(0, [1e20, 1e20]), (1, [1e20, 1e20]), (2, [-1e300, 1.0]), (3, [1.0, 2.0]), (4, [5e17, -5e17])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, exact_topk.search(df, df.filter("vec_id = 0"), k=4).collect()))
    top = (1 << 63) - 1
    assert got == [(0, 1, 1, top), (0, 2, 3, top), (0, 3, 4, 0), (0, 4, 2, -top - 1)]


def test_topk_of_odd_vectors(spark):
    df = odd_vectors(spark)
    got = sorted(map(tuple, exact_topk.search(df, df.filter("vec_id % 50 = 0"), k=2).collect()))
    assert [g for g in got if g[0] == 100] == [(100, 1, 7, 512 * 256), (100, 2, 6, 256 * 256)]
    assert [g[2] for g in got if g[0] == 50] == [6, 7]
    assert exact_topk.search(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA)).count() == 0


def test_topk_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(16)], 0) for k in range(400)] + [(k, [0.5] * 16, 0) for k in range(400, 420)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, exact_topk.digests(df).collect()))
    whole = {k: [math.floor(256 * x) for x in v] for k, v, _ in rows}
    want = []
    for q in sorted(k for k in whole if k % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[k], strict=True)), k) for k in whole if k != q)[:5]
        want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(best)]
    assert got == want


def test_bounds_hold():
    rng = np.random.default_rng(5)
    data, query = np.floor(rng.normal(size=(300, 8)) * 256), np.floor(rng.normal(size=(20, 8)) * 256)
    codes, borders = exact_topk.approximate(data, 4)
    low, high = exact_topk.bounds(codes, borders, query)
    exact = query @ data.T
    assert (low <= exact).all() and (exact <= high).all()


def test_pipeline(spark):
    import corpus_pipeline
    import public_tokenizers

    from gridloom.llm import byte_bpe

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_dedup", "mixing", "byte_bpe"]
    junk = docs.limit(1).select(F.lit(10**9).cast("long").alias("doc_id"), F.lit("xqzjv kqxzw vvkjq zzxqj " * 60).alias("text"), F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    kept = corpus_pipeline.identify_language(spark, docs.union(junk), sf)
    assert kept.columns == docs.columns
    assert kept.filter(F.col("doc_id") == 10**9).count() == 0 and kept.count() >= 0.99 * docs.count()
    out = corpus_pipeline.run(spark, sf)
    assert out.filter(~F.col("round_trip")).count() == 0
    assert 0 < out.count()
    row = out.orderBy("doc_id").first()
    codec = byte_bpe.ByteBpe(byte_bpe.MergeTables(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))), public_tokenizers.PATTERN)
    assert codec.encode(codec.decode(np.array(row.ids)).decode()).tolist() == row.ids
