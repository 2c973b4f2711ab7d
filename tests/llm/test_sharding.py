import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.llm.sharding import ORACLE_SQL, moved, op13_sharding, shard_of, sharded, slotted, write_shards

from ..oracle import connect, same
from . import awkward


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    same(op13_sharding(spark, sf), connect(sf), ORACLE_SQL)


def holds(rows, docs):
    """The contract, by brute force."""
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    for shard in range(8):
        mine = sorted(rows_of := [r for r in rows if r.shard == shard], key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(rows_of)))
        assert [r.doc_id if r.doc_id is not None else -1 for r in mine] == sorted(r.doc_id if r.doc_id is not None else -1 for r in mine)
    by_key = {}
    for r in rows:
        assert by_key.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.law == "key" and 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)


def test_whole_table_and_slots(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op13_sharding(spark, sf).collect()
    holds(rows, docs)
    counts = Counter(r.shard for r in rows)
    assert all(abs(counts[s] - len(docs) / 8) < 5 * math.sqrt(len(docs) / 8) for s in range(8))
    assert 0 < sum(r.grown_shard == 8 for r in rows) < 2 * len(docs) / 9


def test_awkward_rows(spark, tmp_path):
    for k, docs in enumerate((awkward.frame(spark), awkward.empty(spark), awkward.frame(spark).union(awkward.frame(spark)))):
        sf = awkward.sf_dir(spark, tmp_path / str(k), documents=docs)
        holds(op13_sharding(spark, sf).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_a_key_repeated_in_most_rows_is_numbered_in_many_tasks(spark):
    rows = spark.range(30_000, numPartitions=6).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"))
    placed = slotted(sharded(rows, ["doc_id"], (1.0,) * 4), ["doc_id"])
    sums = placed.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert all(r.n == r.slots == r.last + 1 for r in sums) and sum(r.n for r in sums) == 30_000


def test_weights_and_few_moves(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "key")
    before, after = (1.0, 2.0, 1.0), (1.0, 2.0, 1.0, 4.0)
    counts = {r.shard: r["count"] for r in sharded(rows, ["key"], before).groupBy("shard").count().collect()}
    assert all(abs(counts[i] / 20_000 - w / 4) < 0.02 for i, w in enumerate(before))
    moves = {(r.from_shard, r.to_shard): r.rows for r in moved(rows, ["key"], before, after).collect()}
    assert {t for f, t in moves if f != t} == {3} and abs(sum(n for (f, t), n in moves.items() if t == 3) / 20_000 - 0.5) < 0.02
    closed = {(r.from_shard, r.to_shard) for r in moved(rows, ["key"], after, (1.0, 0.0, 1.0, 4.0)).collect()}
    assert {f for f, t in closed if f != t} == {1} and not any(t == 1 for _, t in closed)
    heavier = {(r.from_shard, r.to_shard) for r in moved(rows, ["key"], before, (1.0, 3.0, 1.0)).collect()}
    assert {t for f, t in heavier if f != t} == {1}
    for wrong in ((), (0.0,), (1.0, -1.0), (float("nan"),)):
        with pytest.raises(ValueError):
            shard_of(F.lit("k"), wrong)


def test_written_shards_hold_all_rows_in_bounded_files(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = spark.range(5_000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("text").alias("text"))
    counts = {r.shard: r.rows for r in write_shards(rows, path, ["doc_id"], (1.0, 1.0), 500).collect()}
    back = spark.read.parquet(path)
    assert sum(counts.values()) == back.count() == 5_000
    assert {(r.doc_id, r.shard) for r in back.select("doc_id", "shard").distinct().collect()} == {(r.doc_id, r.shard) for r in sharded(rows, ["doc_id"], (1.0, 1.0)).select("doc_id", "shard").distinct().collect()}
    assert back.groupBy(F.input_file_name()).count().agg({"count": "max"}).first()[0] <= 1000


def test_no_python_on_the_path(spark):
    plan = op13_sharding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
