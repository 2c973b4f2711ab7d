"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after another and adds a small tree (up to three leaves) over that feature's bins to
the feature's lookup table; then the pairs that explain most of what is left get tables over coarse bins in the same way.
A text's score is a sum of table entries, taken for a whole batch by adding looked-up bins.

The model learns from at most SAMPLE labelled rows (those with the least hash of their id), which bounds the broadcast of
their ids and what reaches the driver: SAMPLE rows of a few figures each. Scoring covers all rows and doesn't shuffle.

Defined results: a null text counts as empty and has a score like any other. Rows with a null label, text or id aren't
learned from. With no labelled rows at all, or labels of one kind only, every score is that kind's smoothed share.
Repeated labelled rows each count. Extra columns are carried along or ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality_rules import Rules, judge
from .textops import Texts, crc_remainder, map_texts, quoted, table

SAMPLE = 12_000


@dataclass(frozen=True)
class Settings:
    bins: int = 48
    coarse: int = 8
    pairs: int = 6
    rounds: int = 150
    pair_rounds: int = 60
    rate: float = 0.15
    min_rows: int = 8
    sample: int = SAMPLE


FEATURES = (
    "log_words", "word_length", "symbols", "capitals", "digits", "marks", "shouts", "distinct_words", "repeat_lines",
    "repeat_words", "kept_words", "words_a_line", "short_words", "wide_characters", "long_words",
)


def _flags(characters: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_UPPER, _DIGIT, _MARK, _SHOUT = _flags(range(65, 91)), _flags(range(48, 58)), _flags(b".,;:?"), _flags(b"!")


def features(texts: Texts) -> np.ndarray:
    """One row of FEATURES for each text."""
    figures, (line_start, _, _) = judge(texts, Rules())
    n_words, chars = figures["n_words"], np.maximum(figures["word_chars"], 1)
    some = np.maximum(n_words, 1)
    starts, ends, first = texts.words()
    owner = np.repeat(np.arange(texts.n), n_words)
    size = ends - starts
    keys = texts.span_hash(starts, ends, lower=True) ^ (owner.astype(np.uint64) << np.uint64(40))
    order = np.lexsort((keys, owner)) if len(keys) else np.zeros(0, np.int64)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (owner[order][1:] != owner[order][:-1])

    def of_bytes(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(texts.data) + 1, np.int64)
        np.cumsum(flags[texts.data], out=sums[1:])
        return np.diff(sums[texts.offsets])

    count = lambda weight, at=owner: np.bincount(at, weight, texts.n)
    lines = np.bincount(np.searchsorted(texts.offsets, line_start, side="right") - 1, minlength=texts.n)
    wide = _flags(range(0xC0, 0x100))
    columns = [
        np.log1p(n_words), chars / some, figures["n_symbols"] / chars, of_bytes(_UPPER) / chars, of_bytes(_DIGIT) / chars,
        of_bytes(_MARK) / some, of_bytes(_SHOUT) / some, count(fresh, owner[order]) / some, figures["n_dup_lines"] / np.maximum(lines, 1),
        figures["n_repeat_words"] / some, figures["kept_words"] / some, np.log1p(n_words / np.maximum(lines, 1)),
        count(size <= 2) / some, of_bytes(wide) / chars, count(size > 20) / some,
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def _tree(gradient: np.ndarray, weight: np.ndarray, min_rows: int) -> np.ndarray:
    """Leaf values over ordered bins: the best cut, then the best second cut. gradient, weight: sums a bin."""

    def best(a: int, b: int) -> tuple[float, int]:
        g, w = np.cumsum(gradient[a:b]), np.cumsum(weight[a:b])
        if b - a < 2 or not w[-1]:
            return 0.0, -1
        left_g, left_w = g[:-1], w[:-1]
        right_g, right_w = g[-1] - left_g, w[-1] - left_w
        ok = (left_w >= min_rows) & (right_w >= min_rows)
        gain = np.where(ok, left_g**2 / np.maximum(left_w, 1) + right_g**2 / np.maximum(right_w, 1) - g[-1] ** 2 / w[-1], 0)
        k = int(gain.argmax())
        return float(gain[k]), a + k + 1

    n = len(gradient)
    gain, cut = best(0, n)
    if gain <= 0:
        return np.full(n, gradient.sum() / max(weight.sum(), 1))
    second = max(best(0, cut), best(cut, n))
    bounds = sorted({0, cut, n, *([second[1]] if second[0] > 0 else [])})
    out = np.empty(n)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out[a:b] = gradient[a:b].sum() / max(weight[a:b].sum(), 1)
    return out


def _grid_tree(gradient: np.ndarray, weight: np.ndarray, min_rows: int) -> tuple[float, np.ndarray]:
    """Gain and leaf values over a grid: the best cut of each axis together, four leaves."""
    g, w = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    top_g, top_w = g[:-1, :-1], w[:-1, :-1]
    parts = [
        (top_g, top_w),
        (g[:-1, -1:] - top_g, w[:-1, -1:] - top_w),
        (g[-1:, :-1] - top_g, w[-1:, :-1] - top_w),
        (g[-1, -1] - g[:-1, -1:] - g[-1:, :-1] + top_g, w[-1, -1] - w[:-1, -1:] - w[-1:, :-1] + top_w),
    ]
    gain = sum(np.where(x >= min_rows, y**2 / np.maximum(x, 1), 0) for y, x in parts)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(gradient)
    spans = (slice(0, i + 1), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None))
    for (a, b), (y, x) in zip(((0, 0), (0, 1), (1, 0), (1, 1)), parts, strict=True):
        if x[i, j] >= min_rows:
            out[spans[0][a], spans[1][b]] = y[i, j] / x[i, j]
    return float(gain[i, j] - g[-1, -1] ** 2 / max(w[-1, -1], 1)), out


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: sums of looked-up bins."""
        total = np.full(len(x), self.intercept)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, f])]
        for a, b, values in self.pairs:
            total += values[np.searchsorted(self.coarse_edges[a], x[:, a]), np.searchsorted(self.coarse_edges[b], x[:, b])]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Model:
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    model.edges = [_edges(c, s.bins) for c in x.T]
    model.coarse_edges = [_edges(c, s.coarse) for c in x.T]
    binned = [np.searchsorted(e, c) for e, c in zip(model.edges, x.T, strict=True)]
    coarse = [np.searchsorted(e, c) for e, c in zip(model.coarse_edges, x.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)
    push = lambda: (lambda p: (y - p, p * (1 - p)))(1 / (1 + np.exp(-total)))  # noqa: E731  gradient and weight of each row
    for _ in range(s.rounds):
        for f, bins in enumerate(binned):
            g, w = push()
            n = len(model.tables[f])
            step = s.rate * _newton(_tree(np.bincount(bins, g, n), np.bincount(bins, minlength=n).astype(float), s.min_rows), np.bincount(bins, w, n), np.bincount(bins, minlength=n))
            model.tables[f] += step
            total += step[bins]
    g, _ = push()

    def grid(a: int, b: int, value: np.ndarray | None) -> np.ndarray:
        na, nb = len(model.coarse_edges[a]) + 1, len(model.coarse_edges[b]) + 1
        return np.bincount(coarse[a] * nb + coarse[b], value, na * nb).reshape(na, nb).astype(float)

    gains = sorted(((_grid_tree(grid(a, b, g), grid(a, b, None), s.min_rows)[0], a, b) for a, b in combinations(range(x.shape[1]), 2) if len(model.coarse_edges[a]) and len(model.coarse_edges[b])), reverse=True)
    model.pairs = [(a, b, np.zeros_like(grid(a, b, None))) for gain, a, b in gains[: s.pairs] if gain > 0]
    for _ in range(s.pair_rounds):
        for a, b, values in model.pairs:
            g, w = push()
            rows = grid(a, b, None)
            step = s.rate * _newton(_grid_tree(grid(a, b, g), rows, s.min_rows)[1], grid(a, b, w), rows)
            values += step
            total += step[coarse[a], coarse[b]]
    return model


def _newton(leaf: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Turn mean gradients into damped Newton steps, with the mean curvature of all rows in the tree."""
    curvature = weight.sum() / max(rows.sum(), 1)
    return np.clip(leaf / max(curvature, 0.02), -4, 4)


def labelled_features(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Features and label of at most s.sample labelled documents, repeated ids included. docs: doc_id, text; labels: doc_id, label (0 or 1)."""
    chosen = labels.where("doc_id is not null and label is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(s.sample)
    joined = docs.where("doc_id is not null and text is not null").join(F.broadcast(chosen), "doc_id")  # at most s.sample ids
    kernel = lambda batch: {"x": pa.array(features(Texts(batch.column("text"))).tolist(), pa.list_(pa.float32()))}
    got = map_texts(joined, kernel, [T.StructField("x", T.ArrayType(T.FloatType()))], ["doc_id", "label"]).select("row.doc_id", "row.label", "x")
    # Repeated ids bring more rows than were chosen: the bound holds for rows as well.
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "x").limit(s.sample).toPandas()
    got = got.sort_values(["doc_id", "label"], kind="stable")
    if got.empty:
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0)
    return np.stack(got["x"].to_numpy()), got["label"].to_numpy(float)


def score(df: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns in `carry` (all, by default) in the struct `row`, score and predicted."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few tables of fixed size

    def kernel(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        p = shared.value.score(features(Texts(batch.column("text"))))
        return {"score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))}

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_texts(df, kernel, fields, df.columns if carry is None else carry, text=text)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_remainder("doc_id", 3) != 1).select("doc_id", quoted("quality").alias("label"))
    model = fit(*labelled_features(docs.select("doc_id", "text"), labels))
    out = score(docs, model, carry=["doc_id"]).select("row.doc_id", "score", "predicted")
    return out.withColumn("held_out", F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False)))
