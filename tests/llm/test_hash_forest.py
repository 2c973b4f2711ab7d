import math
from collections import defaultdict

import numpy as np
import pytest

from leafmill.llm.hash_forest import Forest, hash_strings, op10_hash_forest, prefix_ranges, search


def exact(rows, queries, k=20):
    out = {}
    for q, v in queries:
        scored = sorted(((-float(np.dot(np.array(v, float), np.array(x, float))), i) for i, x in rows if i != q))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def recall(got, want):
    found = defaultdict(list)
    for r in got:
        found[r.query_id].append((r.rank, r.vec_id))
    hits = [len({i for _, i in found[q]} & {i for i, _ in w}) / len(w) for q, w in want.items() if w]
    return sum(hits) / len(hits)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_order(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    vectors = {i: np.array(v, float) for i, v in rows}
    got = op10_hash_forest(spark, f"/root/testdata/{sf}").collect()
    queries = [r for r in rows if r[0] % 20 == 0]
    assert len(got) == 20 * len(queries)
    assert recall(got, exact(rows, queries)) >= 0.9
    by = defaultdict(list)
    for r in got:
        assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), abs=1e-12)
        by[r.query_id].append(r)
    for rs in by.values():
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)


def test_recall_without_exhausting_blocks(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    f = Forest(block=3000)
    got = search(df, df.where("vec_id % 100 = 0"), f=f).collect()
    rows = [(i, np.array(v, np.float32)) for i, v in rows]
    assert recall(got, exact(rows, [r for r in rows if r[0] % 100 == 0])) >= 0.9


def test_prefix_ranges_are_the_longest_that_give_enough():
    rng = np.random.default_rng(2)
    strings = np.sort(rng.integers(0, 1 << 32, (4, 300), dtype=np.uint32), axis=1)
    queries = rng.integers(0, 1 << 32, (25, 4), dtype=np.uint32)
    queries[:5] = strings[:, :5].T
    lo, hi = prefix_ranges(strings, queries, 40)
    for q in range(25):
        counts = [sum(int((strings[t] >> (32 - d) == queries[q, t] >> (32 - d)).sum()) for t in range(4)) if d else 1200 for d in range(33)]
        depth = max(d for d in range(33) if counts[d] >= 40)
        assert (hi[q] - lo[q]).sum() == counts[depth]


def test_awkward_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (40, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    got = search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank", "vec_id").collect()
    assert [(r.rank, r.vec_id) for r in got if r.query_id == 0] == [(1, 20), (2, 20), (3, 1), (4, 2)]
    assert [(r.rank, r.vec_id) for r in got if r.query_id == 20] == [(1, 0), (1, 0), (2, 1), (2, 1), (3, 2), (3, 2)]
    assert {r.query_id for r in got} == {0, 20}
    assert search(df.limit(0), df.limit(0)).count() == 0


def test_many_equal_vectors_go_by_id(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(3000)] + [(5000 + i, [float(i), 1.0, 0.0, 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = search(df, df.where("vec_id = 40"), f=Forest(block=2048)).collect()
    want = exact(rows, [(40, rows[40][1])])[40]
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [i for i, _ in want]


def test_same_strings_for_same_vectors():
    x = np.random.default_rng(1).standard_normal((10, 8))
    assert (hash_strings(x, 4) == hash_strings(np.vstack([x, x]), 4)[10:]).all()
