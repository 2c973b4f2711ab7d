"""Passages as JSON lines or Parquet, the id-keyed vector table as snapshots, and manifests."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import is_blank
from ..operators.checks import CorpusError, check_corpus, duplicate_ids
from ..operators.passages import METADATA, RECORD_SCHEMA


def read_passages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records, and broken lines as file, line (from 1) and value, from files of JSON lines; blank lines are skipped.

    A line is broken if it isn't one JSON object with the records' types, or has no id. Lines are counted without gathering
    them: a block of a file says how many it holds, blocks are added up, and a line's place in its block is that of its row. Files must
    stay as they are while they are read: both readings of a file deal its blocks alike."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    parsed = F.from_json("value", f"{RECORD_SCHEMA}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = rows.withColumn("r", parsed)
    # from_json stops at the end of the first value; the whole line must be one object.
    whole = F.get_json_object("value", "$").isNotNull() & F.ltrim("value").startswith("{") & F.rtrim("value").endswith("}")
    fits = F.coalesce(F.col("r._broken").isNull() & F.col("r.id").isNotNull() & whole, F.lit(False))
    blank = is_blank(F.col("value"))
    good = rows.where(~blank & fits).select("r.*").drop("_broken")
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first_row"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", "first_row", before.alias("before"))
    broken = rows.where(~blank & ~fits).select("file", "block", "row", "value").join(blocks, ["file", "block"])
    return good, broken.select("file", (F.col("before") + F.col("row") - F.col("first_row") + 1).alias("line"), "value")


def load_passages(spark: SparkSession, path: str) -> DataFrame:
    """Records from files of JSON lines. A broken line, an empty input and repeated ids are errors."""
    found, broken = read_passages(spark, path)
    if wrong := broken.orderBy("file", "line").limit(5).collect():
        raise CorpusError(f"lines that aren't passages: {[(r.file, r.line) for r in wrong]}")
    return _distinct(found)


def parsed_passages(lines: DataFrame) -> DataFrame:
    """Records from JSON lines in `value`, blank lines skipped. An empty input and repeated ids are errors."""
    return _distinct(lines.where(~is_blank(F.col("value"))).select(F.from_json("value", RECORD_SCHEMA, {"mode": "FAILFAST"}).alias("r")).select("r.*"))


def _distinct(found: DataFrame) -> DataFrame:
    if found.isEmpty():
        raise CorpusError("no passages")
    again = duplicate_ids(found).limit(10).collect()
    if again:
        raise CorpusError(f"ids found more than once: {[r.id for r in again]}")
    return found


def passages_as_json(records: DataFrame) -> DataFrame:
    """id and the wire form: one JSON object with id, text and flat metadata."""
    return records.select("id", F.to_json(F.struct("id", "text", F.struct(*[F.col(f"metadata.{k}").alias(k) for k in METADATA]).alias("metadata"))).alias("json"))


def write_passages(records: DataFrame, path: str, kind: str = "parquet") -> None:
    """Checked records, one folder a document. kind: parquet or json."""
    checked = check_corpus(records).withColumn("document", F.col("metadata.document"))
    checked.write.mode("overwrite").partitionBy("document").format(kind).save(path)


def combined_records(handlers: list[Callable[[], DataFrame]]) -> DataFrame:
    """Records of all registered handlers, by name of column."""
    return reduce(DataFrame.unionByName, [h() for h in handlers])


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """The vector table after a batch: rows of `new` replace those with their id."""
    return old.join(new.select("id"), "id", "left_anti").select(new.columns).unionByName(new)


def write_snapshot(spark: SparkSession, table: DataFrame, root: str, number: int) -> str:
    """Write a new snapshot and then point to it; what is being read is never overwritten."""
    path = f"{root}/snapshot={number:08d}"
    table.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(number, path)], "number long, path string").coalesce(1).write.mode("append").json(f"{root}/_pointer")
    return path


def current_snapshot(spark: SparkSession, root: str) -> DataFrame:
    path = spark.read.schema("number long, path string").json(f"{root}/_pointer").orderBy(F.desc("number")).first().path
    return spark.read.parquet(path)


def last_snapshot(spark: SparkSession, root: str) -> tuple[int, DataFrame] | None:
    """Number and rows of the newest snapshot; None if there is none yet."""
    try:
        newest = spark.read.schema("number long, path string").json(f"{root}/_pointer").orderBy(F.desc("number")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if newest is None else (newest.number, spark.read.parquet(newest.path))


def build_manifest(vectors: DataFrame, model: str, batch: int = 8, timed: bool = True) -> DataFrame:
    """One row: counts, dimension, model, input fields, a hash over all ids and texts, and (if asked) the time."""
    pair = F.sha2(F.concat_ws("\x1f", F.col("id").cast("string"), "text"), 256)
    # Hashes are added up in four lanes of 64 bits, so no order and no gathering is needed.
    lane = lambda i: F.sum(F.conv(F.substring(pair, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)"))
    lanes = [F.pmod(F.coalesce(lane(i), F.lit(0)), F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string") for i in range(4)]
    out = vectors.agg(
        F.count("*").alias("chunk_count"), F.countDistinct("id").alias("ids"), F.max(F.size("embedding")).alias("dimension"), F.concat_ws("-", *lanes).alias("source_hash")
    ).select(F.lit(model).alias("model"), F.lit("section,parent_titles,text").alias("input_fields"), "chunk_count", "ids", "dimension", F.lit(batch).alias("batch_size"), "source_hash")
    return out.withColumn("built_at_utc", F.current_timestamp()) if timed else out


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is named, a folder of our own will do only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            where = tempfile.mkdtemp(prefix="leafmill-snapshot-")
        context.setCheckpointDir(where)
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A path of a new folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def snapshot(df: DataFrame) -> DataFrame:
    """The rows as they are now, in the shared folder: what stands behind them isn't run again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
