"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are packed into blocks. Each block keeps, for every tree, its vectors' hash strings (signs of random projections,
as one 32-bit number) as a sorted array. A query goes down each tree to the string that shares its longest prefix, by
binary search, and then up again, one bit at a time in all trees at once, until enough candidates share a prefix with it;
every vector under these prefixes is scored exactly, and the best of each block are merged.

All rows are indexed. A stated set of queries is searched: query blocks meet index blocks in groups of at most WAVE query
blocks and a few index blocks, so no task holds all queries or all vectors. How many candidates to gather from a block
(counted with repeats over trees) is the same rule for every block: WANTED for each vector and EXTRA for each neighbour
asked for; both are chosen for vectors without any structure. Recall against brute force is in the README and the tests.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id. Vectors of other lengths than the query's are no candidates. Rows with the query's id count as the query's own. If an id is
repeated among queries, each row has its own 20 results. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .textops import checkpoint, quoted, table

BITS = 32


@dataclass(frozen=True)
class Forest:
    trees: int = 128
    wanted: float = 0.45
    extra: float = 30.0
    block: int = 8192
    query_block: int = 512
    wave: int = 16
    neighbours: int = 20


def _projections(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng(dim * 1000 + trees).standard_normal((dim, trees * BITS)).astype(np.float32)


def hash_strings(vectors: np.ndarray, trees: int) -> np.ndarray:
    """A row of 32-bit hash strings for each vector."""
    projections, plain = _projections(vectors.shape[1], trees), vectors.astype(np.float32)
    out = np.empty((len(vectors), trees), np.uint32)
    for t in range(trees):  # bits of one tree at a time: memory follows the vectors, not vectors x trees x bits
        signs = plain @ projections[:, t * BITS : (t + 1) * BITS] > 0
        out[:, t] = np.packbits(signs, axis=1).view(">u4")[:, 0]
    return out


def lifted(vectors: np.ndarray, longest: float | None) -> np.ndarray:
    """One more component, that makes all of a block equally long (0 for queries): then the least angle to a query
    belongs to the largest inner product."""
    more = np.zeros(len(vectors)) if longest is None else np.sqrt(np.maximum(longest**2 - (vectors * vectors).sum(axis=1), 0))
    return np.concatenate([vectors, more[:, None]], axis=1)


def _clean(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the rows that take part, by vector length."""
    column = batch.column("vector").cast(pa.list_(pa.float64()))
    ids = batch.column("id")
    sizes = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), bool)
    for dim in np.unique(sizes[known & (sizes > 0)]).tolist():
        at = np.flatnonzero(known & (sizes == dim))
        part = column.take(pa.array(at))
        values = part.flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)  # nulls become NaN
        good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
        if good.any():
            yield ids.take(pa.array(at[good])).to_numpy().astype(np.int64), np.ascontiguousarray(values[good])


def packed(df: DataFrame, id_column: str, vector: str, size: int) -> DataFrame:
    """dim, ids, vectors: at most `size` vectors a row, as bytes of int64 and float64."""
    source = df.select(quoted(id_column).cast("long").alias("id"), quoted(vector).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def row(dim: int, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], names=["dim", "ids", "vectors"])

        for batch in batches:
            for ids, vectors in _clean(batch):
                dim = vectors.shape[1]
                waiting.setdefault(dim, []).append((ids, vectors))
                if sum(len(x) for x, _ in waiting[dim]) >= size:
                    ids, vectors = (np.concatenate(x) for x in zip(*waiting.pop(dim), strict=True))
                    whole = len(ids) // size * size
                    for a in range(0, whole, size):
                        yield row(dim, ids[a : a + size], vectors[a : a + size])
                    if whole < len(ids):
                        waiting[dim] = [(ids[whole:], vectors[whole:])]
        for dim, parts in waiting.items():
            yield row(dim, *(np.concatenate(x) for x in zip(*parts, strict=True)))

    return source.mapInArrow(run, "dim int, ids binary, vectors binary")


def grown(blocks: DataFrame, f: Forest) -> DataFrame:
    """Add to each block its trees: sorted hash strings, and which vector each belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                dim = one.column("dim")[0].as_py()
                vectors = np.frombuffer(one.column("vectors")[0].as_py(), np.float64).reshape(-1, dim)
                strings = hash_strings(lifted(vectors, np.sqrt((vectors * vectors).sum(axis=1).max())), f.trees).T
                order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
                ordered = np.take_along_axis(strings, order, axis=1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([ordered.tobytes()], pa.binary()), pa.array([order.tobytes()], pa.binary())], names=[*one.schema.names, "strings", "places"])

    return blocks.mapInArrow(run, "dim int, ids binary, vectors binary, strings binary, places binary")


def longest_prefixes(strings: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """For each query the most leading bits that it shares with any string of any tree."""
    differ = np.full(len(queries), 0xFFFFFFFF, np.uint32)
    for t, ordered in enumerate(strings):
        q = queries[:, t]
        at = np.searchsorted(ordered, q)
        for neighbour in (np.minimum(at, len(ordered) - 1), np.maximum(at - 1, 0)):
            differ = np.minimum(differ, ordered[neighbour] ^ q)
    return BITS - np.ceil(np.log2(differ.astype(np.float64) + 1)).astype(np.int64)


def prefix_ranges(strings: np.ndarray, queries: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query and tree the range of sorted strings under the query's prefix, as long as leaves `wanted` in all."""
    lo, hi = np.zeros(queries.shape, np.int64), np.full(queries.shape, strings.shape[1], np.int64)
    longest = longest_prefixes(strings, queries)
    left = np.arange(len(queries))
    for depth in range(int(longest.max(initial=0)), 0, -1):
        now = left[longest[left] >= depth]
        if not len(now):
            continue
        rest = np.uint32((1 << (BITS - depth)) - 1)
        low, high = queries[now] & ~rest, queries[now] | rest
        a, b = np.empty(low.shape, np.int64), np.empty(low.shape, np.int64)
        for t, ordered in enumerate(strings):
            a[:, t] = np.searchsorted(ordered, low[:, t], side="left")
            b[:, t] = np.searchsorted(ordered, high[:, t], side="right")
        enough = (b - a).sum(axis=1) >= wanted
        lo[now[enough]], hi[now[enough]] = a[enough], b[enough]
        left = np.setdiff1d(left, now[enough], assume_unique=True)
        if not len(left):
            break
    return lo, hi


def search_block(ids: np.ndarray, vectors: np.ndarray, strings: np.ndarray, places: np.ndarray, q_ids: np.ndarray, q_vectors: np.ndarray, f: Forest) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its position, and the ids and scores of the best candidates found in the block."""
    n = len(ids)
    lo, hi = prefix_ranges(strings, hash_strings(lifted(q_vectors, None), f.trees), int(f.wanted * n + f.extra * f.neighbours))
    base = np.arange(f.trees) * n
    flat = places.ravel()
    for q in range(len(q_ids)):
        size = hi[q] - lo[q]
        if size.sum() >= n * f.trees:
            near = np.arange(n)
        else:
            ends = np.cumsum(size)
            at = np.arange(int(ends[-1])) + np.repeat(base + lo[q] - (ends - size), size)
            met = np.zeros(n, bool)
            met[flat[at]] = True
            near = np.flatnonzero(met)
        near = near[ids[near] != q_ids[q]]
        scores = vectors[near] @ q_vectors[q]
        if len(near) > f.neighbours:
            least = np.partition(scores, len(near) - f.neighbours)[len(near) - f.neighbours]
            keep = scores >= least
            near, scores = near[keep], scores[keep]
        order = np.lexsort((ids[near], -scores))[: f.neighbours]
        yield q, ids[near[order]], scores[order]


def search(df: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector: str = "embedding", f: Forest = Forest()) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of all rows of `df` for each row of `queries`."""
    index = checkpoint(grown(packed(df, id_column, vector, f.block), f).withColumn("block", F.monotonically_increasing_id()))
    asked = checkpoint(packed(queries, id_column, vector, f.query_block).withColumn("asked", F.monotonically_increasing_id()))
    slots = max(index.count(), 1)
    waves = max(-(-asked.count() // f.wave), 1)
    left = index.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots).cast("long"))).withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))))
    right = asked.withColumn("wave", F.pmod(F.xxhash64("asked"), F.lit(waves)).cast("int")).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))

    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        for block in blocks.to_pylist():
            dim = block["dim"]
            ids = np.frombuffer(block["ids"], np.int64)
            vectors = np.frombuffer(block["vectors"], np.float64).reshape(-1, dim)
            strings = np.frombuffer(block["strings"], np.uint32).reshape(f.trees, -1)
            places = np.frombuffer(block["places"], np.int32).reshape(f.trees, -1)
            for query in queries.to_pylist():
                if query["dim"] == dim:
                    q_ids = np.frombuffer(query["ids"], np.int64)
                    for q, found, scores in search_block(ids, vectors, strings, places, q_ids, np.frombuffer(query["vectors"], np.float64).reshape(-1, dim), f):
                        k = len(found)
                        out.append((np.full(k, query["asked"]), np.full(k, q), np.full(k, q_ids[q]), found, scores))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
        return pa.table(dict(zip(("asked", "place", "query_id", "vec_id", "score"), columns, strict=True)))

    found = left.groupBy("slot", "wave").cogroup(right.groupBy("slot", "wave")).applyInArrow(run, "asked long, place long, query_id long, vec_id long, score double")
    best = W.partitionBy("asked", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= f.neighbours).select("query_id", "rank", "vec_id", "score")


def op10_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
