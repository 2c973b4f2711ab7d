"""Cosine search: ties, zero vectors, and more vectors than one slice."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.operators.vectors import BATCH_BYTES, VECTOR_SLICE, _ranked, cosine_topk, placed


def cosine_native(queries, vectors, k=3):
    """The same as `cosine_topk` in plain expressions, for small tables."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    q = queries.select("query_id", F.col("embedding").alias("q"))
    pairs = vectors.select("id", "embedding").join(F.broadcast(q))
    cosine = dot(F.col("q"), F.col("embedding")) / F.nullif(norm(F.col("q")) * norm(F.col("embedding")), F.lit(0.0))
    return _ranked(pairs.select("query_id", "id", F.round(cosine, 6).alias("similarity")), k)


def test_ties_go_to_the_smaller_id_across_slices_and_partitions(spark):
    n = 3 * VECTOR_SLICE
    rows = [(i, [0.0, 0.0] if i == 0 else [1.0, float(i == n - 1)]) for i in reversed(range(n))]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [1.0, 1.0])], "query_id long, embedding array<double>")
    for parts in (1, 3):
        got = cosine_topk(queries, vectors.repartition(parts)).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.id) for r in got] == [(7, 1), (7, 2), (7, 3), (8, n - 1), (8, 1), (8, 2)]


def test_fewer_vectors_than_asked_for_and_zero_ones_last(spark):
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<double>")
    got = cosine_topk(queries, vectors).orderBy("rank").collect()
    assert [(r.id, r.similarity) for r in got] == [(2, 0.0), (1, None)]


def test_many_blocks_of_queries_and_groups_of_vectors(spark):
    rng = random.Random(1)
    row = lambda: [round(rng.gauss(0, 1), 2) for _ in range(6)]
    stored = {f"v{i:04}": row() for i in range(700)} | {f"w{i:04}": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0] for i in range(300)}
    asked = {i: row() for i in range(1500)} | {9999: [2.0, 4.0, 6.0, 8.0, 10.0, 12.0]}
    vectors = spark.createDataFrame(list(stored.items()), "id string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame(list(asked.items()), "query_id long, embedding array<float>").repartition(3)
    want = {(r.query_id, r.rank): (r.id, r.similarity) for r in cosine_native(queries.where("query_id % 31 = 0 or query_id = 9999"), vectors, 5).collect()}
    for groups in (1, 7, None):
        got = {(r.query_id, r.rank): (r.id, r.similarity) for r in cosine_topk(queries, vectors, 5, groups).collect()}
        assert len(got) == 5 * len(asked)
        assert all(math.isclose(got[x][1], w[1], abs_tol=2e-6) for x, w in want.items())
        assert [got[9999, r][0] for r in range(1, 6)] == [f"w{i:04}" for i in range(5)]


def test_the_search_plans_without_reading_queries(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(rows):
        for x in rows:
            calls.add(len(x))
            yield x

    queries = spark.range(1000).selectExpr("id query_id", "array(1.0D, double(id)) embedding").mapInPandas(seen, "query_id long, embedding array<double>")
    vectors = spark.range(50).selectExpr("id", "array(1.0D, double(id)) embedding")
    plan = cosine_topk(queries, vectors)
    assert calls.value == 0
    assert plan.count() == 3000 and calls.value == 1000


def test_vectors_of_several_lengths_are_an_error(spark):
    vectors = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    with pytest.raises(Exception, match="of one length"):
        cosine_topk(queries, vectors).collect()


def test_blocks_are_handed_over_a_few_at_a_time(spark):
    """Blocks of queries of 128 MB in all reach a task in batches near BATCH_BYTES; 64 MB before."""
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    was = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        cosine_topk(vectors.withColumnRenamed("id", "query_id"), vectors)
        blocks = spark.range(0, 256, 1, 1).select(F.expr("cast(repeat('x', 512 * 1024) as binary)").alias("data"))
        sizes = blocks.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", was)
    assert sum(r.n for r in sizes) >= 128 << 20 and max(r.n for r in sizes) <= BATCH_BYTES + (1 << 20)


def test_rows_of_held_blocks_are_placed_in_order():
    rng = np.random.default_rng(3)
    blocks = [rng.random((n, 4)) for n in (3, 1, 5)]
    order = rng.permutation(9)
    want = np.concatenate(blocks)[order]
    assert (placed(blocks, order) == want).all() and not blocks
