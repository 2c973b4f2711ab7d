"""Embedding and vector tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import WORD, is_blank
from .checks import CorpusError

BATCH = 8
BUCKETS = 64
#: Query vectors in a block, which is compared with VECTOR_SLICE vectors at a time: matrices of 2 MB.
QUERY_BLOCK = 1024
VECTOR_SLICE = 256
#: Bytes of the vectors that a search task holds.
HELD_BYTES = 64 << 20
#: Bytes of an Arrow batch: blocks of queries that pass are handed to a search task so many at a time.
BATCH_BYTES = 8 << 20


def embedding_inputs(records: DataFrame) -> DataFrame:
    """What is embedded: section, parent titles and text; provenance stays metadata."""
    body = F.regexp_extract("text", r"(?s)\nText: (.*)$", 1)
    return records.select("id", F.concat_ws("\n", F.concat(F.lit("Section: "), F.col("metadata.section")), F.concat(F.lit("Parent sections: "), F.col("metadata.parent_titles")), F.concat(F.lit("Text: "), body)).alias("input"))


def bucket_embedder(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding service: words counted in hashed buckets, to unit length."""
    import re

    out = []
    for text in texts:
        v = np.zeros(BUCKETS)
        for w in re.findall(WORD, text.lower()):
            v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % BUCKETS] += 1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def reply_vectors(reply: list, n: int) -> list[list[float]]:
    """The vectors of a reply for n texts, in their order. Pairs must be numbered 0 to n - 1, each once."""
    if reply and isinstance(reply[0], tuple):
        numbered = dict(reply)
        if len(reply) != n or sorted(numbered) != list(range(n)):
            raise ValueError("the reply's numbers don't match the texts")
        reply = [numbered[i] for i in range(n)]
    if len(reply) != n or any(len(v) == 0 for v in reply):
        raise ValueError("the embedder must give one non-empty vector for each text")
    return reply


def embed_passages(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "input", batch: int = BATCH) -> DataFrame:
    """Add `embedding`, asking `embed` for at most `batch` texts at a time; blank texts are an error before any call.
    It gives vectors in the order of the texts, or pairs (number of the text, vector) in any order.

    Each distinct text is embedded once and joined back by its hash."""
    if not rows.where(is_blank(F.col(text))).isEmpty():
        raise CorpusError("blank text to embed")
    keyed = rows.withColumn("_key", F.sha2(F.col(text), 256))
    distinct = keyed.groupBy("_key").agg(F.first(text).alias("text"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors: list[list[float]] = []
            texts = part["text"].tolist()
            for i in range(0, len(texts), batch):
                vectors += reply_vectors(embed(texts[i : i + batch]), len(texts[i : i + batch]))
            yield pd.DataFrame({"_key": part["_key"], "embedding": vectors})

    made = distinct.mapInPandas(run, "_key string, embedding array<double>")
    return keyed.join(made, "_key").drop("_key")


def embed_resumably(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], store: str, text: str = "text", batch: int = BATCH) -> DataFrame:
    """As `embed_passages`, but no text is paid for twice, whatever fails: vectors are kept in `store`, a folder that all
    executors share (a path, or an address that Arrow's file systems open), by the hash of their text.

    Each batch is committed by itself as soon as its reply is there: its file, named by the hash of its texts' hashes, is
    written aside and then moved. Texts are in order of their hashes within a task, so a task that is tried again makes the
    same batches, and finds those that it had committed. After a job that broke off, the next one takes over what its tasks
    had committed, in whatever batches, before it asks for the rest. At the end of a job batches become one Parquet table."""
    if not rows.where(is_blank(F.col(text))).isEmpty():
        raise CorpusError("blank text to embed")
    spark, (files, root) = rows.sparkSession, fs.FileSystem.from_uri(store)
    for name in ("batches", "vectors"):
        files.create_dir(f"{root}/{name}", recursive=True)
    schema = "_key string, embedding array<double>"

    def table() -> DataFrame:
        return spark.read.schema(schema).parquet(f"{store}/vectors")

    def opened(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column("content"):
                yield from pa.ipc.open_stream(content.as_buffer())

    left = spark.read.format("binaryFile").load(f"{store}/batches").select("content").mapInArrow(opened, schema)
    # Of a batch that a broken job had already put into the table, nothing is added again.
    left.dropDuplicates(["_key"]).join(table().select("_key"), "_key", "left_anti").write.mode("append").parquet(f"{store}/vectors")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, place = fs.FileSystem.from_uri(store)
        for part in parts:
            for at in range(0, part.num_rows, batch):
                keys, texts = (part.column(c).slice(at, batch).to_pylist() for c in ("_key", "text"))
                path = f"{place}/batches/{hashlib.sha256(','.join(keys).encode()).hexdigest()}.arrow"
                if here.get_file_info(path).type == fs.FileType.File:
                    with here.open_input_stream(path) as f:
                        yield from pa.ipc.open_stream(f.read())
                    continue
                vectors = reply_vectors(embed(texts), len(texts))
                made = pa.RecordBatch.from_arrays([pa.array(keys), pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float64()))], names=["_key", "embedding"])
                aside = f"{place}/batches/_{uuid.uuid4().hex}"
                with here.open_output_stream(aside) as f, pa.ipc.new_stream(f, made.schema) as out:
                    out.write_batch(made)
                here.move(aside, path)
                yield made

    keyed = rows.withColumn("_key", F.sha2(F.col(text), 256))
    asked = keyed.groupBy("_key").agg(F.first(text).alias("text")).join(table().select("_key"), "_key", "left_anti")
    asked.sortWithinPartitions("_key").mapInArrow(run, schema).write.mode("append").parquet(f"{store}/vectors")
    files.delete_dir_contents(f"{root}/batches")
    return keyed.join(table(), "_key").drop("_key")


def vector_dimensions(vectors: DataFrame) -> DataFrame:
    """One row: least and most length, rows without a vector, and whether all fit."""
    size = F.coalesce(F.size("embedding"), F.lit(0))
    out = vectors.agg(F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.count(F.when(size <= 0, 1)).alias("empty"))
    return out.withColumn("fits", (F.col("least") == F.col("most")) & (F.col("empty") == 0))


def remaining_passages(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Records whose id isn't stored yet; only ids are compared."""
    return records.join(stored.select("id"), "id", "left_anti")


def unexpected_ids(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored ids that the input no longer has: an error for a resumed build."""
    return stored.select("id").join(records.select("id"), "id", "left_anti").distinct()


def build_counts(records: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: input and stored counts, and whether they agree."""
    both = records.select(F.lit(1).alias("i"), F.lit(0).alias("s")).union(stored.select(F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("i"), F.lit(0)).alias("input_count"), F.coalesce(F.sum("s"), F.lit(0)).alias("stored_count")).withColumn("agrees", F.col("input_count") == F.col("stored_count"))


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "similarity", F.round(1 - F.col("similarity"), 6).alias("distance"))


def packed_vectors(rows: DataFrame, key: str, size: int) -> DataFrame:
    """keys, data, dim, number: blocks of at most `size` unit vectors, a row each, made where the vectors lie. `data` holds doubles,
    row after row; zero vectors become nan. `number` tells blocks apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                dims = set(pc.list_value_length(piece.column("vector")).to_pylist())
                if len(dims) != 1 or not dims - {0, None}:
                    raise ValueError("vectors must be non-empty and of one length")
                matrix = piece.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(piece.num_rows, -1)
                keys = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column("key"))
                yield pa.RecordBatch.from_arrays([keys, pa.array([_unit(matrix).tobytes()]), pa.array([matrix.shape[1]]), pa.array([number])], names=["keys", "data", "dim", "number"])
                number += 1

    schema = T.StructType([T.StructField("keys", T.ArrayType(rows.schema[key].dataType)), T.StructField("data", T.BinaryType()), T.StructField("dim", T.LongType()), T.StructField("number", T.LongType())])
    return rows.select(F.col(key).alias("key"), F.col("embedding").cast("array<double>").alias("vector")).mapInArrow(run, schema)


def nearest(asked: np.ndarray, stored: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `stored` nearest to each of `asked`, and their cosines, both k (or fewer) x len(asked): most similar first, of
    equal ones the upper row, nan last. A slice of VECTOR_SLICE rows at a time, so memory follows the number asked."""
    columns = np.arange(len(asked))
    found, best = np.zeros((0, len(asked)), np.int64), np.zeros((0, len(asked)))
    for at in range(0, len(stored), VECTOR_SLICE):
        similar = np.nan_to_num(np.round(stored[at : at + VECTOR_SLICE] @ asked.T, 6) + 0.0, nan=-2)
        rows = np.concatenate([found, np.broadcast_to(np.arange(at, at + len(similar))[:, None], similar.shape)])
        pool = np.concatenate([best, similar])
        places = []
        for _ in range(min(k, len(pool))):  # the first of the largest, k times
            place = pool.argmax(axis=0)
            places.append(place)
            pool[place, columns] = -np.inf
        pool = np.concatenate([best, similar])
        found, best = rows[places, columns], pool[places, columns]
    return found, np.where(best == -2, np.nan, best)


def bounded_batches(spark: SparkSession) -> None:
    """Blocks of vectors are long rows: unless the session says otherwise, hand them to Python BATCH_BYTES at a time, so that
    memory doesn't follow the number of queries up to Arrow's usual 64 MB, two of which a task holds while it reads."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(BATCH_BYTES))


def placed(blocks: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """The rows of all blocks in `order`. Each block is let go as soon as its rows are placed, so nothing is held thrice."""
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    whole, end = np.empty((len(order), blocks[0].shape[1])), len(order)
    while blocks:
        block = blocks.pop()
        whole[place[end - len(block) : end]] = block
        end -= len(block)
    return whole


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = 3, groups: int | None = None) -> DataFrame:
    """The k nearest passages of each query by cosine, most similar first, ties by id: query_id, rank, id, similarity, distance.

    One plan for any number of queries; nothing goes through the driver. Both sides are packed into blocks, a row each. Blocks
    of vectors are dealt into groups of about HELD_BYTES, and each block of queries is sent to every group. A group's task
    holds its vectors and lets the queries pass, so a vector is shuffled once and a query once a group; out come k rows for each
    query and group, and the k best of them remain. Zero vectors rank last.

    groups: how many; by default the vectors' bytes over HELD_BYTES, and no fewer than there are shuffle partitions."""
    if not isinstance(k, int) or isinstance(k, bool) or k < 1:
        raise ValueError("k must be a positive whole number")
    bounded_batches(vectors.sparkSession)
    if groups is None:
        size = vectors.agg((F.count("*") * F.coalesce(F.max(F.size("embedding")), F.lit(0)) * 8).alias("bytes")).first().bytes
        groups = max(-(-size // HELD_BYTES), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    id_type, query_type = vectors.schema["id"].dataType, queries.schema["query_id"].dataType
    stored = packed_vectors(vectors.select("id", "embedding"), "id", VECTOR_SLICE)
    stored = stored.select(F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int").alias("grp"), F.col("keys").alias("ids"), F.lit(None).cast(T.ArrayType(query_type)).alias("asked"), "data", "dim")
    asked = packed_vectors(queries.select("query_id", "embedding"), "query_id", QUERY_BLOCK)
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(None).cast(T.ArrayType(id_type)).alias("ids"), F.col("keys").alias("asked"), "data", "dim")
    rows = stored.unionByName(asked).repartition(groups, "grp").sortWithinPartitions("grp", F.col("asked").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each group first the vectors' blocks, which are held, then the queries', which pass."""
        grp, ids, blocks, whole = None, [], [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                matrix = np.frombuffer(row.column("data")[0].as_buffer(), float).reshape(-1, row.column("dim")[0].as_py())
                if row.column("grp")[0].as_py() != grp:
                    grp, ids, blocks, whole = row.column("grp")[0].as_py(), [], [], None
                if row.column("ids")[0].is_valid:
                    ids.append(row.column("ids").flatten())
                    blocks.append(matrix.copy())
                    continue
                if not ids:
                    continue
                if whole is None:  # in the order of ids, so that ties go to the smaller one
                    names = pa.concat_arrays(ids)
                    order = pc.sort_indices(names)
                    names, whole = names.take(order), placed(blocks, order.to_numpy())
                found, similar = nearest(matrix, whole, k)
                similar = pa.array(similar.T.ravel(), from_pandas=True)
                asked = row.column("asked").flatten().take(pa.array(np.repeat(np.arange(len(matrix)), len(found))))
                yield pa.RecordBatch.from_arrays([asked, names.take(pa.array(found.T.ravel())), similar], names=["query_id", "id", "similarity"])

    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("similarity", T.DoubleType())])
    return _ranked(rows.mapInArrow(run, schema), k)


def _unit(matrix: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def topk_with_provenance(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Hits with their section, titles, pages and text. Hits are few and narrow; records are shuffled by id only once."""
    m = lambda c: F.col(f"metadata.{c}").alias(c)
    return hits.join(records, "id").select("query_id", "rank", "id", m("document"), m("version"), m("section"), m("parent_titles"), m("pdf_page_start"), m("printed_page_start"), "similarity", "distance", "text")
