"""Sharding by rendezvous hashing over weighted shards, in DataFrame functions alone.

Each shard gives each key a score of its own, -weight / ln(u), with u in (0, 1) from the md5 of shard and key; the shard with
the greatest score holds the key. A shard's scores hang on nothing but itself and the key, so a shard that joins takes rows
only into itself, one that leaves gives away only its own, and a changed weight moves rows only to or from its shard: in each
case about the share that the shard gains or loses. No table of shards is kept, nothing is shuffled to find them.

Slots number the rows of a shard without gaps; they are found from counts of parts (see `numbering`), so that no shard, however
large, is one task. Written shards are cut into files by slot.

Defined results: a null key is a key like any other; rows that share a key, repeated ones too, share a shard and have a slot
each, numbered in any order. A null text has no bytes: size 1, and the CRC-32 of nothing, 0. Equal scores go to the lower
shard. An empty table gives an empty result. Extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .crc_sql import crc32_sql
from .numbering import in_parts, numbered
from .textops import quoted, table

SHARDS = 8
#: Hex digits of the md5 that make u: 48 bits, exact in a double.
DIGITS = 12


def key_of(*columns: str) -> Column:
    """The record key: each value's length and text, so that no two lists of values look alike; `-` for null."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(*[one(quoted(c).cast("string")) for c in columns])


def score(key: Column, shard: int, weight: float) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{shard}/"), key)), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return F.lit(-float(weight)) / F.ln(u)


def shard_of(key: Column, weights: tuple[float, ...]) -> Column:
    """Number of the shard with the greatest score. A weight of 0 closes a shard; its number stays taken."""
    if not weights or any(not math.isfinite(w) or w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be finite and not negative, and one above 0")
    scored = [F.struct(score(key, i, w).alias("score"), F.lit(-i).alias("place")) for i, w in enumerate(weights) if w]
    return (-F.array_max(F.array(*scored))["place"]).cast("int")


def sharded(rows: DataFrame, keys: list[str], weights: tuple[float, ...], names: tuple[str, ...] = ("shard",), others: tuple[tuple[float, ...], ...] = ()) -> DataFrame:
    """Add the shard of each row, and under further names those that other lists of weights would give."""
    key = key_of(*keys)
    return rows.withColumns({name: shard_of(key, w) for name, w in zip(names, (weights, *others), strict=True)})


def moved(rows: DataFrame, keys: list[str], before: tuple[float, ...], after: tuple[float, ...]) -> DataFrame:
    """from_shard, to_shard, rows: what a change of shards or weights moves, and what stays."""
    both = sharded(rows, keys, before, ("from_shard", "to_shard"), (after,))
    return both.groupBy("from_shard", "to_shard").agg(F.count("*").alias("rows"))


def slotted(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add `slot`, from 0 without gaps in each `shard`, ascending by `order`. The rows given should be narrow: they are
    checkpointed, dealt by ranges of `order` and shuffled once more by part and shard."""
    by = [quoted(c) for c in order]
    return numbered(in_parts(rows, by), "shard", by, "slot")


def write_shards(rows: DataFrame, path: str, keys: list[str], weights: tuple[float, ...], rows_a_file: int = 1 << 20) -> DataFrame:
    """Write the rows by shard, in files of about `rows_a_file` rows however large a shard is, and give back each shard's
    count. A hot key's rows go to one shard, but are dealt over its files by a hash of the whole row and their place."""
    placed = sharded(rows, keys, weights)
    sizes = placed.groupBy("shard").agg(F.count("*").alias("rows"))
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) / float(1 << 30)
    files = sizes.select("shard", F.ceil(F.col("rows") / rows_a_file).alias("_files"))
    dealt = placed.join(F.broadcast(files), "shard").withColumn("_file", F.floor(spread * F.col("_files")).cast("long"))  # a row a shard
    dealt.repartition("shard", "_file").drop("_files", "_file").write.partitionBy("shard").option("maxRecordsPerFile", 2 * rows_a_file).parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy("shard").agg(F.count("*").alias("rows"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(quoted("text").cast("string"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    equal = (1.0,) * SHARDS
    placed = sharded(narrow, ["doc_id"], equal, ("shard", "grown_shard"), ((*equal, 1.0),))
    out = slotted(placed, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


_SCORE = f"-1.0::double / ln((('0x' || md5(S || '/' || key)[1:{DIGITS}])::bigint::double + 0.5) / {16**DIGITS}::double)"
ORACLE_SQL = f"""with keyed as (select doc_id, strlen(coalesce(text, ''))::bigint + 1 size, {crc32_sql("coalesce(text, '')")} text_crc32, coalesce(strlen(doc_id::varchar)::varchar || ':' || doc_id::varchar, '-') as key from documents),
scored as (select doc_id, size, text_crc32, list_transform(range({SHARDS + 1}), lambda s: {_SCORE.replace("S", "s::varchar")}) scores from keyed),
placed as (select *, (list_position(scores[1:{SHARDS}], list_max(scores[1:{SHARDS}])) - 1)::int shard, (list_position(scores, list_max(scores)) - 1)::int grown_shard from scored)
select doc_id, size, text_crc32, 'key' law, shard, row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 slot, grown_shard from placed"""
