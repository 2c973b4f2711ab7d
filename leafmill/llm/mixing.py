"""Mixing to target weights with soft membership.

A softmax regression learns domains from the labelled table: clean, poor (quality 0) and toxic. Its inputs are the text
figures of the quality classifier and the presence of the words that tell domains apart best. It predicts every document's
domain posteriors. A document's rate says how often its tokens count in the mixture; rates start at 1 and move by projected
gradient steps of a least squares problem: the expected tokens of each domain (rate x tokens x posterior, summed by Spark
over all documents) shall equal the domain's target share of the budget. The gradient is scaled by the inverse second moment
of the documents that are free to move (not held at 0 or at `max_rate`), found anew in each round; the whole step, its
halves down to 2**-11 and the same of the plain gradient are tried in one pass, and the one with the least loss is taken, so
the loss always falls. A projection keeps rates nonnegative (and, if asked, at most `max_rate`). Rounds end when each domain is
within `tolerance` of its own target, or no step lowers the loss by `least_gain` any more; there is no other limit. Where
the targets can't all be met, the gap left is logged. A pass gives the driver a few dozen sums.

The classifier learns from at most `sample` labelled rows, by least hash of their id; which words it looks at is settled by
counts over the same rows. The largest budget at which no domain needs repeating is taken by default.

Defined results: a null or empty text has 0 tokens; it keeps the rate that its posteriors give, and adds to no total. With
no labels all posteriors are equal shares. With no tokens at all, every rate is 1. Repeated rows count each. A null id has
a rate like any other and is drawn by the hash of null. Extra columns are carried along or ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality_classifier import FEATURES, features
from .textops import Texts, checkpoint, map_texts, slices, table

DOMAINS = ("clean", "poor", "toxic")
TARGETS = (0.95, 0.04, 0.01)
BUCKETS = 1 << 16
#: Parts of a step that are tried.
PARTS = 0.5 ** np.arange(12)


@dataclass(frozen=True)
class Settings:
    sample: int = 8000
    words: int = 256
    steps: int = 400
    decay: float = 1e-3
    tolerance: float = 1e-4
    least_gain: float = 1e-3


def domain_of(quality: Column, toxic: Column) -> Column:
    """Place in DOMAINS; null where quality and toxic are both unknown."""
    return F.when(toxic == 1, 2).when(quality == 0, 1).when(quality.isNotNull() | toxic.isNotNull(), 0)


def _word_buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of each distinct word of each text."""
    starts, ends, first = texts.words()
    # Marks at the end belong to the sentence, not to the word.
    last = ends - 1
    trim = np.isin(texts.data[last], np.frombuffer(b".,;:!?", np.uint8)) & (ends - starts > 1) if len(ends) else np.zeros(0, bool)
    buckets = texts.span_hash(starts, ends - trim, lower=True) & np.uint64(BUCKETS - 1)
    owner = np.repeat(np.arange(texts.n), np.diff(first))
    pairs = np.unique(owner.astype(np.int64) * BUCKETS + buckets.astype(np.int64))
    return pairs // BUCKETS, pairs % BUCKETS


@dataclass
class Model:
    chosen: np.ndarray  # bucket -> place among the words looked at, or -1
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # (1 + figures + words) x domains

    def inputs(self, texts: Texts) -> np.ndarray:
        figures = np.clip((features(texts) - self.mean) / self.spread, -6, 6)
        words = np.zeros((texts.n, len(self.weights) - 1 - len(FEATURES)), np.float32)
        owner, bucket = _word_buckets(texts)
        at = self.chosen[bucket]
        words[owner[at >= 0], at[at >= 0]] = 1
        return np.concatenate([np.ones((texts.n, 1), np.float32), figures.astype(np.float32), words], axis=1)

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, k: int, s: Settings) -> np.ndarray:
    """Weights by accelerated gradient steps."""
    w = np.zeros((x.shape[1], k))
    if not len(y):
        return w
    goal = np.eye(k)[y]
    moved, rate = w, 4.0 / max(float((x * x).sum(axis=1).mean()), 1)
    for t in range(s.steps):
        z = x @ moved
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        after = moved - rate * (x.T @ (p - goal) / len(y) + s.decay * moved)
        moved = after + t / (t + 3) * (after - w)
        w = after
    return w


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """docs: doc_id, text; labels: doc_id, domain (place in DOMAINS)."""
    chosen = labels.where("doc_id is not null and domain is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(s.sample)
    sample = checkpoint(docs.where("doc_id is not null and text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("_row", F.monotonically_increasing_id()))  # at most s.sample ids
    if sample.count() > s.sample:
        # Ids repeat: by row, then.
        rows = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "domain", F.xxhash64("text"), "_row").limit(s.sample).select("_row")
        sample = checkpoint(sample.join(F.broadcast(rows), "_row", "left_semi"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(DOMAINS), BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                owner, bucket = _word_buckets(Texts(part.column("text")))
                np.add.at(total, (part.column("domain").to_numpy()[owner], bucket), 1)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[k, b])], names=["domain", "bucket", "n"])

    # At most domains x buckets rows.
    counts = sample.select("domain", "text").mapInArrow(count, "domain int, bucket int, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((len(DOMAINS), BUCKETS))
    seen[counts.column("domain").to_numpy(), counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    sizes = np.zeros(len(DOMAINS))
    for domain, n in sample.groupBy("domain").count().collect():
        sizes[domain] = n
    # Standard scores of each word's share in one domain against the rest.
    rest = np.maximum(sizes.sum() - sizes, 1)[:, None]
    share, other = seen / np.maximum(sizes, 1)[:, None], (seen.sum(axis=0) - seen) / rest
    pooled = (seen.sum(axis=0) + 0.5) / (sizes.sum() + 1)
    score = np.abs(share - other) / np.sqrt(pooled * (1 - pooled).clip(1e-3) * (1 / np.maximum(sizes, 1)[:, None] + 1 / rest))
    best = np.unique(np.concatenate([np.argsort(-row, kind="stable")[: s.words // len(DOMAINS)] for row in score]))
    place = np.full(BUCKETS, -1, np.int32)
    place[best] = np.arange(len(best))
    model = Model(place, np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros((1 + len(FEATURES) + len(best), len(DOMAINS))))
    kernel = lambda batch: {"x": pa.array(model.inputs(Texts(batch.column("text"))).tolist(), pa.list_(pa.float32()))}
    # At most s.sample rows of fixed length. Figures are capped at 6 by `inputs`, so they are taken unscaled here.
    plain = lambda batch: {"x": pa.array(features(Texts(batch.column("text"))).tolist(), pa.list_(pa.float32()))}
    field = [T.StructField("x", T.ArrayType(T.FloatType()))]
    figures = map_texts(sample, plain, field, ["doc_id"]).toPandas()
    if len(figures):
        raw = np.stack(figures["x"].to_numpy())
        raw = raw[np.lexsort(raw.T)]  # sums must not hang on the order in which rows arrive
        model.mean, model.spread = raw.mean(axis=0), np.maximum(raw.std(axis=0), 1e-6)
    got = map_texts(sample, kernel, field, ["doc_id", "domain"]).select("row.doc_id", "row.domain", "x").toPandas()
    if len(got):
        x, y = np.stack(got["x"].to_numpy()).astype(np.float64), got["domain"].to_numpy(int)
        order = np.lexsort([*x.T, y])
        model.weights = fit_softmax(x[order], y[order], len(DOMAINS), s)
    return model


def memberships(docs: DataFrame, model: Model, carry: list[str], text: str = "text") -> DataFrame:
    """`row` (the columns in carry), n_tokens, posterior (array of double)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred figures and a table of BUCKETS places

    def kernel(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = Texts(batch.column("text"))
        p = shared.value.posteriors(shared.value.inputs(texts))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(texts.n + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
        return {"n_tokens": pa.array(np.diff(texts.words()[2]).astype(np.int64)), "posterior": lists}

    return map_texts(docs, kernel, [T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))], carry, text=text)


def _summed(members: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of what `kernel` makes of tokens (n) and posteriors (n x domains): `size` figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                n = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
                total += kernel(n, batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "x"])

    out = np.zeros(size)
    for at, x in members.select("n_tokens", "posterior").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x")).collect():
        out[at] = x
    return out


def _moved(rates: np.ndarray, p: np.ndarray, move: np.ndarray, max_rate: float | None) -> np.ndarray:
    return np.clip(rates - p @ move, 0, max_rate)


def fitted_rates(members: DataFrame, targets: tuple[float, ...], s: Settings = Settings(), max_rate: float | None = None, whole: int | None = None) -> tuple[Column, list[float]]:
    """A column of rates over `members` (n_tokens, posterior), and each domain's expected share of the budget at these.

    The budget is the largest that needs no repeats, and gaps count relative to each domain's own target; or, with `whole`,
    the budget is the one that this domain fills by itself, and gaps count as shares of it: domains with less than their
    target then are left as they are, as the shares tell, and shrink nothing else."""
    k = len(targets)
    have = _summed(members, lambda n, p: n @ p, k)
    goal = np.array(targets, float) / sum(targets)
    if not have.sum():
        return F.lit(1.0), have.tolist()
    budget = min(have[i] / goal[i] for i in range(k) if goal[i] > 0) if whole is None else have[whole] / goal[whole]
    budget = budget or have.sum()
    used = [i for i in range(k) if whole is None or i == whole or have[i] > goal[i] * budget]
    unit = np.zeros((k, len(used)))  # from posteriors to what a token adds to each domain's loss
    unit[used, range(len(used))] = 1 / (budget * np.maximum(goal[used], 1e-9)) if whole is None else 1 / budget
    aim = goal[used] * budget * unit[used, range(len(used))]
    moves: list[np.ndarray] = []

    def rates(p: np.ndarray) -> np.ndarray:
        r = np.ones(len(p))
        for m in moves:
            r = _moved(r, p, m, max_rate)
        return r

    def moment_of(toward: np.ndarray | None) -> np.ndarray:
        """The second moment of all documents, or of those that are free to move `toward` there."""

        def kernel(n: np.ndarray, p: np.ndarray) -> np.ndarray:
            a = p @ unit
            if toward is None:
                return (a * n[:, None]).T @ a
            r, d = rates(p), p @ toward
            free = ~((r <= 0) & (d >= 0)) & ~((r >= (np.inf if max_rate is None else max_rate)) & (d <= 0))
            return (a[free] * n[free, None]).T @ a[free]

        return _summed(members, kernel, len(used) ** 2).reshape(len(used), -1)

    plain = np.eye(len(used))
    gap, metric, largest = have @ unit - aim, plain, np.linalg.eigvalsh(moment_of(None))[-1]
    while np.abs(gap / np.where(aim > 0, aim, 1)).max() > s.tolerance:
        m = moment_of(unit @ metric @ gap)
        scale = np.sqrt(np.maximum(np.diag(m), 1e-12 * largest))
        metric = np.linalg.inv(m / np.outer(scale, scale) + 1e-9 * plain) / np.outer(scale, scale)
        # By a step of the plain gradient over the largest second moment, the loss falls unless nothing can lower it.
        steps = [unit @ x * t for x in (metric @ gap, gap / largest) for t in PARTS]

        def tried(n: np.ndarray, p: np.ndarray) -> np.ndarray:
            r, a = rates(p), p @ unit
            return np.stack([(n * _moved(r, p, x, max_rate)) @ a for x in steps])

        gaps = _summed(members, tried, len(steps) * len(used)).reshape(len(steps), -1) - aim
        losses = (gaps**2).sum(axis=1)
        best = int(losses.argmin())
        if losses[best] > (1 - s.least_gain) * (gap @ gap):
            logging.getLogger(__name__).warning("mixing: targets can't all be met; shares of the budget off by at most %.5f", np.abs(gap * (goal[used] if whole is None else 1)).max())
            break
        moves.append(steps[best])
        gap, metric = gaps[best], metric if best < len(PARTS) else plain

    def step(acc: Column, m: Column) -> Column:
        moved = F.greatest(F.lit(0.0), acc - sum(F.col("posterior")[i] * m[i] for i in range(k)))
        return F.least(F.lit(float(max_rate)), moved) if max_rate is not None else moved

    rate = F.aggregate(F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in moves]), F.lit(1.0), step) if moves else F.lit(1.0)
    return rate, (_summed(members, lambda n, p: (n * rates(p)) @ p, k) / budget).tolist()


def copies(rate: Column, id_column: Column, seed: int = 0) -> Column:
    """Whole copies whose expectation is the rate, drawn by a hash of the id."""
    u = F.pmod(F.xxhash64(id_column.cast("string"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + u).cast("int")


def labelled_domains(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, labelled_domains(table(spark, sf_dir, "labels")))
    members = checkpoint(memberships(docs, model, ["doc_id"]))
    rate, _ = fitted_rates(members, TARGETS)
    out = members.select("row.doc_id", "n_tokens", *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], rate.alias("rate"))
    return out.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))
