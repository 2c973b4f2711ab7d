"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams are added up by Spark over all training documents; the matrix of log probabilities (buckets x
languages) is broadcast in blocks of languages, each of bounded size; batches are scored in numpy by adding the rows of
each document's n-grams, block by block, so any number of languages gets the same buckets. The driver holds the whole
matrix: 128 KB a language.

Defined results: a null text, or one without any letter, is `und` with score 0, and so is every text if there is nothing
to learn from. Rows with a null language, text or id are never learned from. Equal scores go to the language that sorts
first. Repeated rows are each learned from and each predicted. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import checkpoint, crc_remainder, map_texts, quoted, slices, table

UNDETERMINED = "und"
#: Most bytes of one broadcast block of the matrix (512 languages at 15 bits).
MODEL_BYTES = 64 << 20
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    smoothing: float = 0.5


def grams(texts: list[str], s: Settings) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of the n-gram that starts at each character, for each order; and each text's first position, with the end.

    Two line feeds stand before every text and after the last, so no n-gram holds letters of two texts."""
    lowered = [t.lower() for t in texts]
    starts = np.cumsum([0, *(len(t) + 2 for t in lowered)])
    joined = "\n\n" + "\n\n".join(lowered) + "\n\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where((points < 33) | ((points >= 48) & (points < 58)), np.uint32(10), points)  # white space and digits are all alike
    n = int(starts[-1])
    shift = np.uint32(32 - s.bits)
    out, h = [], np.zeros(n, np.uint32)
    for k in range(max(s.orders)):
        h = (h ^ points[k : k + n]) * _MULTIPLIERS[k % 3]
        h ^= h >> np.uint32(15)
        if k + 1 in s.orders:
            out.append(((h * np.uint32(0x2545F491)) >> shift).astype(np.int32))
    return out, starts


def _texts(batch: pa.RecordBatch) -> list[str]:
    return batch.column("text").fill_null("").to_pylist()


def count_grams(df: DataFrame, label: Column, text: str, s: Settings) -> DataFrame:
    """label, bucket, n: how often each bucket occurs in the texts of each label. Tasks add up before they shuffle."""
    source = df.select(label.alias("label"), quoted(text).cast("string").alias("text")).where("label is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, c in counts.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["label", "bucket", "n"])
            counts.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                labels = part.column("label").to_pylist()
                found, starts = grams(_texts(part), s)
                codes = {name: i for i, name in enumerate(dict.fromkeys(labels))}
                of = np.repeat(np.array([codes[x] for x in labels], np.int32), np.diff(starts))
                total = sum(np.bincount((of << s.bits) + g, minlength=len(codes) << s.bits) for g in found)
                for name, i in codes.items():
                    c = total[i << s.bits : (i + 1) << s.bits]
                    counts[name] = counts[name] + c if name in counts else c.copy()
                if len(counts) > 64:
                    yield from flush()
        yield from flush()

    parts = source.mapInArrow(run, "label string, bucket int, n long")
    return parts.groupBy("label", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    labels: list[str]
    blocks: list[np.ndarray]  # buckets x labels, a block of labels each
    prior: np.ndarray
    settings: Settings


def fit(df: DataFrame, label: str, text: str = "text", s: Settings = Settings()) -> Model:
    """Learn from every row of `df` with a label and a text."""
    label_column = quoted(label).cast("string")
    documents = dict(df.where(label_column.isNotNull() & quoted(text).isNotNull()).groupBy(label_column.alias("label")).agg(F.count("*").alias("n")).collect())
    labels = sorted(documents)
    width = max(MODEL_BYTES // (4 << s.bits), 1)
    names = [labels[a : a + width] for a in range(0, len(labels), width)]
    grams_of = count_grams(df, label_column, text, s)
    if len(names) > 1:
        grams_of = checkpoint(grams_of)
    blocks = []
    for block in names:
        # At most buckets x width rows.
        rows = (grams_of.where(F.col("label").isin(block)) if len(names) > 1 else grams_of).toArrow()
        column = {name: i for i, name in enumerate(block)}
        codes = np.array([column[x] for x in rows.column("label").to_pylist()], np.int64)
        counts = np.full((1 << s.bits, len(block)), s.smoothing)
        counts[rows.column("bucket").to_numpy(), codes] += rows.column("n").to_numpy()
        blocks.append(np.log(counts / counts.sum(axis=0)).astype(np.float32))
    prior = np.log([documents[x] for x in labels]) if labels else np.zeros(1)
    return Model(labels, blocks, prior - np.logaddexp.reduce(prior), s)


def posteriors(texts: list[str], model: Model, blocks: Iterator[np.ndarray] | None = None) -> np.ndarray:
    """Rows of label probabilities. blocks: the model's, where it was broadcast without them."""
    found, starts = grams(texts, model.settings)
    total = np.tile(model.prior, (len(texts), 1))
    done = 0
    for log_p in model.blocks if blocks is None else blocks:
        own = total[:, done : done + log_p.shape[1]]
        done += log_p.shape[1]
        for g in found:
            # In pieces, so that a very long text doesn't need its whole n-gram matrix at once.
            step = max((1 << 20) // log_p.shape[1], 1)
            for a in range(0, len(g), step):
                b = min(a + step, len(g))
                rows = log_p[g[a:b]]
                first = int(np.searchsorted(starts, a, side="right")) - 1
                last = int(np.searchsorted(starts, b, side="left"))
                cuts = np.maximum(starts[first:last] - a, 0)
                own[first:last] += np.add.reduceat(rows, cuts, axis=0, dtype=np.float64)
    total -= total.max(axis=1, keepdims=True)
    np.exp(total, out=total)
    return total / total.sum(axis=1, keepdims=True)


def predict(df: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns in `carry` (all, by default) in the struct `row`, lang_pred and score. No shuffle."""
    context = df.sparkSession.sparkContext
    shared, blocks = context.broadcast(replace(model, blocks=[])), [context.broadcast(b) for b in model.blocks]

    def kernel(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        m = shared.value
        letters = batch.column("letters").fill_null(False).to_numpy(zero_copy_only=False)
        if not m.labels:
            letters = np.zeros(len(letters), bool)
        p = posteriors(_texts(batch), m, (b.value for b in blocks))
        best = p.argmax(axis=1)
        names = np.array([*m.labels, UNDETERMINED], object)[np.where(letters, best, len(m.labels))]
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(np.where(letters, p[np.arange(len(best)), best], 0.0))}

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_texts(df, kernel, fields, df.columns if carry is None else carry, {"letters": quoted(text).rlike(r"\p{L}")}, text)


def fit_on_training_rows(docs: DataFrame) -> Model:
    """Learn from documents whose crc32(doc_id) modulo 4 is 0, 1 or 3."""
    return fit(docs.where(crc_remainder("doc_id", 4) != 2), "lang")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit_on_training_rows(docs), carry=["doc_id"]).select("row.doc_id", "lang_pred", "score")
    return out.withColumn("held_out", F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)))
