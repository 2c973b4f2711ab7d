"""Numpy kernels over Arrow string columns, and the plumbing that runs them inside Spark tasks.

Texts are looked at as one byte array with offsets, a bounded slice of documents at a time,
so memory follows SLICE_BYTES (or one document, if that is longer), not the Arrow batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 19
BATCH_ROWS = 1000

#: Bytes that end a word: space and tab to carriage return.
DELIMITER = np.zeros(256, bool)
DELIMITER[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Keeps the first 0 to 8 bytes of a little-endian number.
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_ODD = np.random.default_rng(20240607).integers(1, 1 << 62, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 64


def mix64(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the whole 64-bit word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Texts:
    """Some documents' UTF-8 bytes end to end; null texts count as empty."""

    def __init__(self, column: pa.Array) -> None:
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        whole = column.buffers()[2]
        data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.data = data[offsets[0] : offsets[-1]]
        self.n = len(column)

    def span_hash(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each span of bytes (with A-Z lower-cased, if asked for).

        Eight bytes of all spans at a time are mixed in by a bijection, so two spans of up to eight bytes never share a hash;
        longer than LONG_SPAN, a span's hash is taken from BLAKE2."""
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[:-8] = LOWER[self.data] if lower else self.data
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
        size = end - start
        h = mix64(size.astype(np.uint64) * _ODD[0] + _ODD[1])
        left, at = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
        while len(left):
            rest = size[left] - at
            h[left] = mix64((h[left] ^ (eight[start[left] + at] & _FIRST_BYTES[np.minimum(rest, 8)])) * _ODD[2])
            left, at = left[rest > 8], at + 8
        for i in np.flatnonzero(size > LONG_SPAN).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(padded[start[i] : end[i]], digest_size=8).digest(), "little")
        return h

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and for each document where its words begin (one more entry than documents)."""
        inside = ~DELIMITER[self.data]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        firsts = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        before[firsts] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        lasts = firsts[1:] - 1
        after[lasts] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part hold at most `limit` bytes, or are one document."""
    column = batch.column(text)
    lengths = _lengths(column)
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def short_batches(df: DataFrame) -> DataFrame:
    """Rows of whole texts are long: unless the session says otherwise, hand them to Python BATCH_ROWS at a time, so that
    memory follows a few MB and not Arrow's usual 10,000 rows."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def map_texts(
    df: DataFrame,
    kernel: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    fields: Iterable[T.StructField],
    carry: list[str],
    extra: dict[str, Column] | None = None,
    text: str = "text",
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Run `kernel` over slices of the text column. The columns named in `carry` come back untouched in the struct `row`,
    so that no name of theirs can clash with a result. The kernel sees the columns `text` and those of `extra`."""
    source = df.select(
        F.struct(*[quoted(c).alias(c) for c in carry]).alias("row"),
        quoted(text).cast("string").alias("text"),
        *[c.alias(k) for k, c in (extra or {}).items()],
    )
    fields = list(fields)
    schema = T.StructType([source.schema["row"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", limit):
                made = kernel(part)
                yield pa.RecordBatch.from_arrays([part.column("row"), *[made[f.name] for f in fields]], names=["row", *[f.name for f in fields]])

    return short_batches(source).mapInArrow(run, schema)


def crc_remainder(doc_id: str, by: int) -> Column:
    """crc32 of an id as text, modulo `by`; null for a null id."""
    return F.crc32(quoted(doc_id).cast("string")) % by


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the session names (spark.checkpoint.dir). Where none is named, a folder of
    our own will do only in local mode: executors on other machines couldn't read it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            where = tempfile.mkdtemp(prefix="leafmill-checkpoint-")
        context.setCheckpointDir(where)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
