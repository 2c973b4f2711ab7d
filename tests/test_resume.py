"""Builds that break off: no text is embedded twice, and the table stays whole."""

import os
import signal

import pytest

from leafmill.operators import checks
from leafmill.operators.vectors import bucket_embedder, embed_resumably
from leafmill.plans.corpus import resume_build
from leafmill.sources import tables


def logged(path, fail_after=None, how=None):
    """An embedder that writes down what it is paid for; after so many calls it breaks off, once."""

    def embed(texts):
        mark = path + ".failed"
        calls = len(open(path).readlines()) if os.path.exists(path) else 0
        if fail_after is not None and calls >= fail_after and not os.path.exists(mark):
            open(mark, "w").close()
            if how == "kill":
                os.kill(os.getpid(), signal.SIGKILL)
            raise RuntimeError("the service went away")
        with open(path, "a") as f:
            f.write("\t".join(texts) + "\n")
        return bucket_embedder(texts)

    return embed


def paid(path):
    return [t for line in open(path).read().splitlines() for t in line.split("\t")]


@pytest.mark.parametrize("how", ["raise", "kill"])
def test_a_task_that_dies_midway_is_not_paid_for_again(spark, tmp_path, how):
    rows = spark.range(203).selectExpr("id", "concat('passage number ', id % 199) text").repartition(3)
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    with pytest.raises(Exception):
        embed_resumably(rows, logged(log, 9, how), store)
    assert 0 < len(paid(log)) < 199
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")  # other tasks, other batches
    try:
        got = {r.id: (r.text, r.embedding) for r in embed_resumably(rows, logged(log), store).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert sorted(paid(log)) == sorted({f"passage number {i}" for i in range(199)})
    assert len(got) == 203 and all(v == bucket_embedder([t])[0] for t, v in got.values())
    embed_resumably(rows.union(spark.createDataFrame([(900, "a new one")], "id long, text string")), logged(log), store).count()
    assert len(paid(log)) == 200 and not os.listdir(f"{store}/batches")


def test_resumed_builds(spark, tmp_path):
    root, log = str(tmp_path / "table"), str(tmp_path / "log")
    records = spark.range(60).selectExpr("cast(id as string) id", "concat('text ', id % 50) text")
    first = resume_build(records.where("id < 30"), root, logged(log), "bucket").first()
    assert (first.chunk_count, first.ids, first.dimension) == (30, 30, 64)
    with pytest.raises(Exception):
        resume_build(records, root, logged(log, 5, "raise"), "bucket")
    assert tables.current_snapshot(spark, root).count() == 30
    last = resume_build(records, root, logged(log), "bucket").first()
    assert (last.chunk_count, last.ids) == (60, 60) and sorted(paid(log)) == sorted({f"text {i}" for i in range(50)})
    with pytest.raises(checks.CorpusError, match="no longer"):
        resume_build(records.where("id < 50"), root, logged(log), "bucket")
    with pytest.raises(checks.CorpusError, match="figures"):
        resume_build(records.union(spark.createDataFrame([("x", "of another length")], "id string, text string")), root, lambda texts: [[1.0]] * len(texts), "bucket")
    with pytest.raises(checks.CorpusError, match="blank"):
        resume_build(records.union(spark.createDataFrame([("y", " ")], "id string, text string")), root, logged(log), "bucket")
    assert tables.current_snapshot(spark, root).count() == 60 and len(paid(log)) == 50


def test_an_empty_build(spark, tmp_path):
    assert resume_build(spark.createDataFrame([], "id string, text string"), str(tmp_path / "t"), bucket_embedder, "bucket").first().chunk_count == 0


def test_the_manifest_tells_swapped_texts_and_ids(spark):
    made = lambda rows: tables.build_manifest(spark.createDataFrame([(i, t, [1.0]) for i, t in rows], "id string, text string, embedding array<double>"), "m", timed=False).first().source_hash
    rows = [("a", "one"), ("b", "two"), ("c", "three")]
    assert made(rows) == made(rows[::-1])
    others = ([("a", "two"), ("b", "one"), ("c", "three")], [("b", "one"), ("a", "two"), ("c", "three")], rows[:2], [*rows, rows[0]], [("a", "one"), ("b", "two"), ("c", "Three")])
    assert len({made(x) for x in others} | {made(rows)}) == 5  # the first two are the same rows
