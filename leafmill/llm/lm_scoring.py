"""Language-model scoring: word frequencies, and a causal self-attention model over subword ids.

Base: how often each word occurs in all training texts is counted by Spark. The HOT_WORDS most frequent words (a bound that
doesn't grow) are broadcast; a text's other words are joined with the whole count table by shuffle, so every word gets its
exact count.

Model: a word is cut into the subwords of a public tokenizer. A layer of causal self-attention over the embeddings of the
last CONTEXT subword ids, with a bias for each distance, gives a context vector. The next id is predicted by a two-level
softmax: first its group, then the id within the group, and both levels depend on the context. Groups are cut from the ids
in order of frequency, so often met groups are small. The weights start as the frequencies of groups and ids in all
training texts (smoothed) and are trained in numpy inside Spark tasks on every id of every training text, in one round;
Spark averages the tasks' weights by the ids they saw. So the last digits of `score` hang on how rows are dealt to tasks.

The score of a text lies between that model and the frequencies of whole words: at each token the model counts by a share, and
a text's probability is the mean over Settings.shares, so each text has the share that suits it. Words outside the broadcast get
their share of the frequencies' remaining mass as the model spells them.

Scoring goes over overlapping windows: each part of a line of ids is led by the CONTEXT - 1 ids before it, so every id is
scored once and with its whole context, and attention for a whole part is masked at texts' starts. A text ends with one
end symbol, which is scored too.

Defined results: a null text counts as empty: only its end is scored. With no training texts nothing is known, and all
probabilities are the smoothed uniform ones. Rows with a null id are scored and learned from as not held out (their
remainder isn't 0). Repeated rows count each. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sentencepiece_codec import public_model
from .textops import LOWER, Texts, checkpoint, crc_remainder, quoted, short_batches, slices, table

HOT_WORDS = 1 << 18
HOT_BYTES = 64  # longer words are never broadcast
CONTEXT = 8
WIDTH = 8
WINDOW = 1 << 14  # ids scored together
FIRST_GROUP, GROWTH = 12, 1.35  # ids in the first group of the softmax, and how much larger each next one is
LOGITS = 1 << 20  # of one group, held at once
END = 2  # the tokenizer's own end symbol
_END_WORD = np.uint64(0)
SHARES = (0.05, 0.2, 0.4, 0.6, 0.8, 0.95)  # of the attention model in op9's score


@dataclass(frozen=True)
class Settings:
    rounds: int = 1
    rate: float = 0.2
    batch: int = 3 << 12  # ids of a step
    smoothing: float = 0.1
    shares: tuple[float, ...] = (1.0,)  # of the attention model, beside frequencies of words; 1: that model alone


# ---- words -------------------------------------------------------------------------------------------------------


def _words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of each text, and where each text's words begin."""
    starts, ends, first = texts.words()
    return texts.span_hash(starts, ends, lower=True), starts, ends, first


def _strings(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    raw = texts.data.tobytes().lower()  # bytes: A-Z only
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _spelled(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """As `_strings`, as an Arrow column and without a Python object a word."""
    size = ends - starts
    cuts = np.concatenate([[0], np.cumsum(size)])
    data = LOWER[texts.data[np.arange(cuts[-1]) + np.repeat(starts - cuts[:-1], size)]]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data))


def word_counts(texts_only: DataFrame) -> DataFrame:
    """word (hash; the end symbol is 0), n, spelling over a column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list] = {"word": [], "n": [], "spelling": []}

        def flush() -> Iterator[pa.RecordBatch]:
            words, at, place = np.unique(np.concatenate(waiting["word"]), return_index=True, return_inverse=True)
            n = np.bincount(place, np.concatenate(waiting["n"])).astype(np.int64)
            spelling = pa.chunked_array(waiting["spelling"], pa.string()).combine_chunks().take(pa.array(at))
            for part in waiting.values():
                part.clear()
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n), spelling], names=["word", "n", "spelling"])

        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column("text"))
                hashes, starts, ends, _ = _words(texts)
                words, at, n = np.unique(hashes, return_index=True, return_counts=True)
                waiting["word"].append(np.append(words, _END_WORD))
                waiting["n"].append(np.append(n, texts.n))
                waiting["spelling"] += [_spelled(texts, starts[at], ends[at]), pa.nulls(1, pa.string())]
                if sum(map(len, waiting["word"])) > 1 << 21:
                    yield from flush()
        if waiting["word"]:
            yield from flush()

    counts = short_batches(texts_only).mapInArrow(run, "word long, n long, spelling string").groupBy("word")
    return counts.agg(F.sum("n").alias("n"), F.max("spelling").alias("spelling"))


def most_frequent(counts: DataFrame, limit: int = HOT_WORDS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Sorted words, their counts and spellings: all short words over the least count that keeps them within `limit`."""
    counts = counts.where(F.octet_length("spelling") <= HOT_BYTES)
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)
    total, least = 0, 0
    for value, rows in levels:
        if total + rows > limit:
            least = value + 1
            break
        total += rows
    rows = counts.where(level >= least).toArrow()
    words = rows.column("word").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], rows.column("n").to_numpy()[order], rows.column("spelling").take(pa.array(order)).to_pylist()


# ---- subwords ----------------------------------------------------------------------------------------------------


_processors: dict[str, object] = {}


def processor(model_file: str):
    """One for each Python worker and model."""
    if model_file not in _processors:
        import sentencepiece

        _processors[model_file] = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return _processors[model_file]


def subwords(model_file: str, words: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words' subwords end to end, and how many each word has; None is the end symbol."""
    ids = processor(model_file).encode([w or "" for w in words], num_threads=1)
    ids = [x or [END] for x in ids]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes


def subword_counts(counts: DataFrame, model_file: str) -> np.ndarray:
    """How often each subword occurs in all training texts: at most one row for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(processor(model_file).get_piece_size())
        for batch in batches:
            ids, sizes = subwords(model_file, batch.column("spelling").to_pylist())
            total += np.bincount(ids, np.repeat(batch.column("n").to_numpy(), sizes), len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = counts.select("spelling", "n").mapInArrow(run, "id long, n double").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(processor(model_file).get_piece_size())
    total[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return total


# ---- the attention model -----------------------------------------------------------------------------------------
#
# All arrays of activations are laid out by component, then position: each step is a few passes over long rows.


def group_bounds(ids: int) -> np.ndarray:
    """Where the groups of the softmax begin, over ids in order of frequency, and the end of the last."""
    out, size = [0], float(FIRST_GROUP)
    while out[-1] < ids:
        out.append(min(out[-1] + int(size), ids))
        size *= GROWTH
    return np.array(out)


def _shapes(ids: int) -> dict[str, tuple[int, ...]]:
    square, groups = (WIDTH, WIDTH), len(group_bounds(ids)) - 1
    return {"embed": (WIDTH, ids + 1), "query": square, "key": square, "value": square, "skip": square, "distance": (CONTEXT,), "out": (groups, WIDTH), "level": (groups,), "inner": (ids, WIDTH), "bias": (ids,)}


def _size(ids: int) -> int:
    return sum(int(np.prod(shape)) for shape in _shapes(ids).values())


def unpack(weights: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the flat weights, by name."""
    out, at = {}, 0
    for name, shape in _shapes(bisect_left(range(1 << 24), len(weights), lo=1, key=_size)).items():
        size = int(np.prod(shape))
        out[name] = weights[at : at + size].reshape(shape)
        at += size
    return out


def pack(parts: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([parts[name].ravel() for name in _shapes(len(parts["bias"]))])


def first_weights(counts: np.ndarray) -> np.ndarray:
    """counts: of each id, by place. The last layers begin at 0, so that before any training the frequencies are predicted."""
    rng = np.random.default_rng(11)
    parts = {name: rng.standard_normal(shape) * 0.3 for name, shape in _shapes(len(counts)).items()}
    for name in ("distance", "out", "inner"):
        parts[name][:] = 0
    parts["level"] = np.log(np.add.reduceat(counts, group_bounds(len(counts))[:-1]))
    parts["bias"] = np.log(counts)
    return pack(parts)


@dataclass
class Line:
    """Texts' ids end to end: what is to be predicted, the id ahead of it (`nothing` at a text's start), and how many
    ids of its text stand ahead."""

    target: np.ndarray
    ahead: np.ndarray
    pos: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, cuts: np.ndarray, nothing: int) -> Line:
        starts = np.repeat(cuts[:-1], np.diff(cuts))
        pos = np.arange(len(ids)) - starts
        ahead = np.empty_like(ids)
        ahead[1:] = ids[:-1]
        ahead[pos == 0] = nothing
        return cls(ids, ahead, pos.astype(np.int32))

    def windows(self, size: int) -> Iterator[tuple[Line, int]]:
        """Parts that predict at most `size` ids each, and how many ids ahead of these are there as context only: so every
        id is predicted once, with its whole context."""
        for at in range(0, len(self.target), size):
            begin = max(at - CONTEXT + 1, 0)
            part = slice(begin, at + size)
            yield Line(self.target[part], self.ahead[part], self.pos[part]), at - begin


def _projections(w: dict[str, np.ndarray]) -> np.ndarray:
    """The four matrices that an embedding meets, one below the other, so that it is read once."""
    return np.concatenate([w["query"] * w["query"].dtype.type(WIDTH**-0.5), w["key"], w["value"], w["skip"]])


def _attend(w: dict[str, np.ndarray], x: Line) -> tuple[np.ndarray, ...]:
    """The context vector of each position, and what the gradient needs. A position sees itself and up to CONTEXT - 1
    positions before it in its own text; the others are masked."""
    n = len(x.ahead)
    e = np.take(w["embed"], x.ahead, axis=1)
    q, k, v, h = (_projections(w) @ e).reshape(4, WIDTH, n)
    a = np.full((CONTEXT, n), -1e9, e.dtype)
    early = np.flatnonzero(x.pos < CONTEXT - 1)  # only these see fewer positions than CONTEXT
    for d in range(min(CONTEXT, n)):
        np.einsum("ij,ij->j", q[:, d:], k[:, : n - d], out=a[d, d:])
        a[d, d:] += w["distance"][d]
        a[d, early[x.pos[early] < d]] = -1e9
    a -= a.max(axis=0)
    np.exp(a, out=a)
    a /= a.sum(axis=0)
    for d in range(min(CONTEXT, n)):
        h[:, d:] += a[d, d:] * v[:, : n - d]
    return h, e, q, k, v, a


@lru_cache(maxsize=4)
def _groups_of_ids(ids: int) -> np.ndarray:
    sizes = np.diff(group_bounds(ids))
    return np.repeat(np.arange(len(sizes), dtype=np.int16), sizes)


def _in_groups(target: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, slice]]]:
    """Group of each target; an order of the targets by group; and first id, end and part of that order of each group met,
    LOGITS figures at most at a time."""
    group = _groups_of_ids(int(bounds[-1]))[target]
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(len(bounds))).tolist()
    parts = []
    for a, b, i, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), cuts[:-1], cuts[1:], strict=True):
        step = max(LOGITS // (b - a), 1)
        parts += [(a, b, slice(j, min(j + step, stop))) for j in range(i, stop, step)]
    return group, order, parts


def _with_bias(matrix: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The bias as one more column: it meets the row of ones that `_with_ones` adds."""
    return np.concatenate([matrix, bias[:, None]], axis=1)


def _with_ones(h: np.ndarray) -> np.ndarray:
    return np.concatenate([h, np.ones((1, h.shape[1]), h.dtype)])


def _softmax(z: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """z: choices x positions, changed to its exponentials; their sums; the log probability of the right choice; and where in z,
    row after row, that choice lies."""
    if z.max(initial=0) > 60:
        z -= z.max(axis=0)
    at = right.astype(np.int64) * len(right) + np.arange(len(right))
    log_p = z.reshape(-1)[at]
    np.exp(z, out=z)
    total = np.ones(len(z), z.dtype) @ z
    log_p -= np.log(total)
    return z, total, log_p, at


def all_log_p(w: dict[str, np.ndarray], x: Line) -> np.ndarray:
    """ids x positions, log probabilities: the definition of the model, for few ids only."""
    h = _attend(w, x)[0]
    log_softmax = lambda z: z - np.log(np.exp(z).sum(axis=0))
    bounds = group_bounds(len(w["bias"]))
    level = log_softmax(w["out"] @ h + w["level"][:, None])
    return np.concatenate([level[g] + log_softmax(w["inner"][a:b] @ h + w["bias"][a:b, None]) for g, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))])


def target_log_p(w: dict[str, np.ndarray], line: Line) -> np.ndarray:
    """Log probability of each target: the same as `all_log_p`, but only a target's own group is looked at."""
    out, bounds = [np.zeros(0, np.float32)], group_bounds(len(w["bias"]))
    for x, skip in line.windows(WINDOW):
        h, target = _with_ones(_attend(w, x)[0][:, skip:]), x.target[skip:]
        group, order, parts = _in_groups(target, bounds)
        log_p = _softmax(_with_bias(w["out"], w["level"]) @ h, group)[2]
        h, target, inner = np.take(h, order, axis=1), target[order], np.empty_like(log_p)
        for a, b, at in parts:
            inner[at] = _softmax(_with_bias(w["inner"][a:b], w["bias"][a:b]) @ h[:, at], target[at] - a)[2]
        log_p[order] += inner
        out.append(log_p)
    return np.concatenate(out)


def _met(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of n ids occur, in order; and for each id its number among these."""
    there = np.zeros(n, bool)
    there[ids] = True
    return np.flatnonzero(there), np.cumsum(there) - 1


def gradient(w: dict[str, np.ndarray], x: Line, skip: int, g: dict[str, np.ndarray]) -> float:
    """Mean log loss over the targets (the first `skip` are context only); its gradient is put into `g`, which holds zeros."""
    whole, e, q, k, v, a = _attend(w, x)
    n, size = len(x.target), max(len(x.target) - skip, 1)
    h, target = _with_ones(whole[:, skip:]), x.target[skip:]
    group, order, parts = _in_groups(target, group_bounds(len(w["bias"])))

    def last_layer(rows: np.ndarray, h: np.ndarray, right: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss; its gradients by `rows` (the last column is the bias) and by `h`, without the row of ones."""
        p, total, log_p, at = _softmax(rows @ h, right)
        p.reshape(-1)[at] -= total
        total *= size  # few figures beside p's, which are left undivided
        dh = rows[:, :-1].T @ p
        dh /= total
        return -float(log_p.sum(dtype=np.float64)) / size, p @ (h / total).T, dh

    loss, slope, dh = last_layer(_with_bias(w["out"], w["level"]), h, group)
    g["out"][:], g["level"][:] = slope[:, :-1], slope[:, -1]
    ordered, right, inner = np.take(h, order, axis=1), target[order], np.empty_like(dh)
    for first, end, at in parts:
        more, slope, inner[:, at] = last_layer(_with_bias(w["inner"][first:end], w["bias"][first:end]), ordered[:, at], right[at] - first)
        loss += more
        g["inner"][first:end] += slope[:, :-1]
        g["bias"][first:end] += slope[:, -1]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    dh += np.take(inner, back, axis=1)
    moved = np.zeros((4, WIDTH, n), whole.dtype)
    dq, dk, dv, d = moved
    d[:, skip:] = dh
    ds = np.zeros_like(a)
    for i in range(min(CONTEXT, n)):
        np.einsum("ij,ij->j", d[:, i:], v[:, : n - i], out=ds[i, i:])
        dv[:, : n - i] += a[i, i:] * d[:, i:]
    ds -= np.einsum("ij,ij->j", a, ds)
    ds *= a
    g["distance"][:] = ds.sum(axis=1)
    for i in range(min(CONTEXT, n)):
        dq[:, i:] += ds[i, i:] * k[:, : n - i]
        dk[:, : n - i] += ds[i, i:] * q[:, i:]
    moved = moved.reshape(4 * WIDTH, n)
    slopes = (moved @ e.T).reshape(4, WIDTH, WIDTH)
    slopes[0] *= WIDTH**-0.5
    g["query"][:], g["key"][:], g["value"][:], g["skip"][:] = slopes
    de = _projections(w).T @ moved
    met, number = _met(x.ahead, len(g["embed"][0]))
    number = number[x.ahead]
    for row, to in zip(de, g["embed"], strict=True):
        to[met] = np.bincount(number, row, len(met))
    return loss


BLOCK = 1024  # weights that Spark adds up together
LEVEL = 256  # groups that the tasks' differences of a block are dealt into before they are added up


class Learner:
    """Steps scaled by each weight's own past gradients (Adagrad); changes the flat weights in place.

    Only weights that have a gradient are gone over: embeddings of ids met, groups with a target, and all small matrices. The
    others would stay as they are."""

    def __init__(self, weights: np.ndarray, s: Settings) -> None:
        self.flat, self.w, self.s = weights, unpack(weights), s
        self.square = np.full_like(weights, 1e-10)
        self.slope = np.zeros_like(weights)  # zeros between steps
        self.g, self.squares = unpack(self.slope), unpack(self.square)
        self.bounds = group_bounds(len(self.w["bias"]))
        self.small = slice(self.w["embed"].size, len(weights) - self.w["inner"].size - self.w["bias"].size)

    def _step(self, weights: np.ndarray, slope: np.ndarray, square: np.ndarray) -> None:
        square += slope * slope
        slope /= np.sqrt(square)
        slope *= np.float32(self.s.rate)
        weights -= slope

    def learn(self, line: Line) -> None:
        for x, skip in line.windows(self.s.batch):
            gradient(self.w, x, skip, self.g)
            groups = np.flatnonzero(np.bincount(_groups_of_ids(int(self.bounds[-1]))[x.target[skip:]]))
            runs = np.split(groups, np.flatnonzero(np.diff(groups) > 1) + 1) if len(groups) else []
            views = [(self.flat[self.small], self.slope[self.small], self.square[self.small])]
            for run in runs:
                rows = slice(self.bounds[run[0]], self.bounds[run[-1] + 1])
                views += [(self.w[name][rows], self.g[name][rows], self.squares[name][rows]) for name in ("inner", "bias")]
            for view in views:
                self._step(*view)
                view[1].fill(0)
            met, _ = _met(x.ahead, self.bounds[-1] + 1)
            taken = [np.take(part["embed"], met, axis=1) for part in (self.w, self.g, self.squares)]
            self._step(*taken)
            self.w["embed"][:, met], self.squares["embed"][:, met], self.g["embed"][:, met] = taken[0], taken[2], 0


def trained(texts_only: DataFrame, weights: np.ndarray, lexicons, place: np.ndarray, model_file: str, s: Settings) -> np.ndarray:
    """One round: every task learns from all of its texts from the same weights; the results are averaged by ids seen.

    texts_only: a column `text`; lexicons: broadcast, of frequent words. Each task returns the blocks of weights that it
    changed, as differences; Spark adds them up before anything reaches the driver."""
    shared = texts_only.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        learner, seen = Learner(start.copy(), s), 0
        reader = Reader(lexicons.value, place, model_file)
        for batch in batches:
            for part in slices(batch, "text"):
                line, _ = reader.line(Texts(part.column("text")))
                learner.learn(line)
                seen += len(line.target)
        if seen:
            moved = learner.flat - start
            moved = np.append(moved, np.zeros(-len(moved) % BLOCK, np.float32)).reshape(-1, BLOCK)
            at = np.flatnonzero(moved.any(axis=1))
            # Block -1 only tells how many ids there were.
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(at, -1).astype(np.int32)), pa.array([*[(moved[i] * float(seen)).astype(np.float64).tobytes() for i in at], b""], pa.binary()), pa.array(np.full(len(at) + 1, float(seen)))],
                names=["i", "w", "n"],
            )

    def total(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.float64) for x in rows.column("w").to_pylist()]
        return pa.table({"i": rows.column("i").slice(0, 1), "w": pa.array([np.sum(parts, axis=0).tobytes()], pa.binary()), "n": pa.array([float(sum(rows.column("n").to_pylist()))])})

    # In two levels: with many tasks, a block's rows of all of them would be too many for one group.
    moved = texts_only.mapInArrow(run, "i int, w binary, n double").withColumn("part", F.spark_partition_id() % LEVEL)
    half = moved.groupBy("i", "part").applyInArrow(total, "i int, w binary, n double")
    rows = half.groupBy("i").applyInArrow(total, "i int, w binary, n double").toArrow().to_pylist()
    seen = sum(r["n"] for r in rows if r["i"] < 0)
    out = np.append(weights, np.zeros(-len(weights) % BLOCK)).reshape(-1, BLOCK)
    for r in rows:
        if r["i"] >= 0:
            out[r["i"]] += np.frombuffer(r["w"], np.float64) / seen
    return out.ravel()[: len(weights)]


class Lexicon:
    """Words (sorted hashes) and the places of their subwords, end to end."""

    def __init__(self, words: np.ndarray, spellings: list[str | None], place: np.ndarray, model_file: str) -> None:
        self.words = words
        ids, self.sizes = subwords(model_file, spellings)
        self.places = place[ids]


class Reader:
    """Turns texts into lines of places, with a lexicon of frequent words; others are cut slice by slice."""

    def __init__(self, frequent: Lexicon, place: np.ndarray, model_file: str) -> None:
        self.frequent, self.place, self.model_file = frequent, place, model_file
        end = Lexicon(np.zeros(1, np.uint64), [None], place, model_file)
        # The frequent words, the end, and room for a slice's own words.
        self.sizes, self.places = np.append(frequent.sizes, end.sizes), np.append(frequent.places, end.places)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.fixed = len(self.sizes), len(self.places)
        # Hashes are spread evenly: the first bits nearly tell a word's place.
        bits = max(len(frequent.words).bit_length(), 1) + 1
        self.shift = np.uint64(64 - bits)
        heads = np.bincount((frequent.words >> self.shift).astype(np.int64), minlength=1 << bits)
        self.starts = (np.cumsum(heads) - heads).astype(np.int32)
        self.padded = np.append(frequent.words, np.uint64((1 << 64) - 1))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The first place in the frequent words, which are sorted, whose word isn't less: as np.searchsorted has it."""
        at = self.starts[(hashes >> self.shift).astype(np.int64)].astype(np.int64)
        left = np.flatnonzero(self.padded[at] < hashes)
        while len(left):
            at[left] += 1
            left = left[self.padded[at[left]] < hashes[left]]
        return at

    def _add(self, own: Lexicon) -> None:
        """Put a slice's own words behind the fixed ones, in place of the last slice's."""
        words, places = self.fixed
        if words + len(own.sizes) > len(self.sizes):
            self.sizes, self.begin = (np.append(x[:words], np.zeros(2 * len(own.sizes), x.dtype)) for x in (self.sizes, self.begin))
        if places + len(own.places) > len(self.places):
            self.places = np.append(self.places[:places], np.zeros(2 * len(own.places), self.places.dtype))
        self.sizes[words : words + len(own.sizes)] = own.sizes
        self.begin[words : words + len(own.sizes)] = places + np.cumsum(own.sizes) - own.sizes
        self.places[places : places + len(own.places)] = own.places

    def line(self, texts: Texts) -> tuple[Line, dict[str, np.ndarray]]:
        """The texts' line, each with its end symbol; and hashes, at (place in the lexicon), known (whether it is there),
        first (where each text's words begin), cuts (where its ids do), token_cuts (where each word's or end's ids do)."""
        hashes, starts, ends, first = _words(texts)
        words = self.frequent.words
        at = np.minimum(self.find(hashes), max(len(words) - 1, 0))
        known = words[at] == hashes if len(words) else np.zeros(len(hashes), bool)
        rest = np.flatnonzero(~known)
        found, where, which = np.unique(hashes[rest], return_index=True, return_inverse=True)
        own = Lexicon(found, _strings(texts, starts[rest[where]], ends[rest[where]]), self.place, self.model_file)
        number = at.astype(np.int64)
        number[rest] = len(words) + 1 + which
        number = np.insert(number, first[1:], len(words))
        self._add(own)
        size = self.sizes[number]
        stop = np.cumsum(size)
        ids = self.places[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.begin[number] - (stop - size), size)]
        cuts = np.concatenate([[0], stop])[first + np.arange(len(first))]
        return Line.of(ids, cuts, len(self.place)), {"hashes": hashes, "at": at, "known": known, "first": first, "cuts": cuts, "token_cuts": np.concatenate([[0], stop])}


@dataclass
class Model:
    weights: np.ndarray
    place: np.ndarray  # of each subword id in the order of frequency
    model_file: str

    def log10_p(self, line: Line, cuts: np.ndarray) -> np.ndarray:
        """Of the ids between each two cuts."""
        sums = np.concatenate([[0.0], np.cumsum(target_log_p(unpack(self.weights), line).astype(np.float64))])
        return np.diff(sums[cuts]) / np.log(10)


def fit(docs: DataFrame, counts: DataFrame, text: str, model_file: str | None = None, s: Settings = Settings()):
    """Learn from all rows of `docs`, whose word counts are given; also gives the frequent words' broadcast lexicon."""
    model_file = model_file or public_model()
    pieces = subword_counts(counts, model_file)
    order = np.argsort(-pieces, kind="stable")
    place = np.empty(len(pieces), np.int32)
    place[order] = np.arange(len(pieces))
    words, n, spellings = most_frequent(counts)
    frequent = docs.sparkSession.sparkContext.broadcast(Lexicon(words, spellings, place, model_file))  # HOT_WORDS short words at most
    weights = first_weights(pieces[order] + s.smoothing)
    for _ in range(s.rounds):
        weights = trained(docs.select(quoted(text).cast("string").alias("text")), weights, frequent, place, model_file, s)
    return Model(weights.astype(np.float32), place, model_file), frequent, n


# ---- scoring -----------------------------------------------------------------------------------------------------


def interpolated(attention: np.ndarray, word: np.ndarray, first: np.ndarray, shares: tuple[float, ...], other: float) -> np.ndarray:
    """log10 probability of each text between the attention model and frequencies of whole words: at each token, the former
    counts by a share that is the text's own; each of `shares` is as likely beforehand.

    attention: the model's log10 probability of a token's ids; word: log10 frequency of frequent words and the end, nan for
    others. Those share the mass `other`, which the frequencies leave, as the attention model spells them: so the
    probabilities of all texts still add up to one at most. first: where each text's tokens begin, and the end."""
    with np.errstate(divide="ignore"):
        by_count = np.where(np.isnan(word), np.log10(other) + attention, word)
        larger = np.maximum(attention, by_count)
        least = np.power(10.0, np.minimum(attention, by_count) - larger)  # the other one, as a part of the larger
        ahead = attention >= by_count
        parts = np.where(ahead, 1.0, least), np.where(ahead, least, 1.0)  # of the model and of the frequencies
        texts = np.full(len(first) - 1, -np.inf)
        largest = np.concatenate([[0.0], np.cumsum(larger)])
        for share in shares:
            if share == 1:
                sums = np.diff(np.concatenate([[0.0], np.cumsum(attention)])[first])
            else:
                # A logarithm for a run of tokens: their product is no less than 1e-300.
                run = max(int(300 / -np.log10(min(share, 1 - share))), 1) if 0 < share < 1 else 1
                cuts = np.union1d(first, np.arange(0, len(ahead) + 1, run))
                logs = np.log10(np.multiply.reduceat(share * parts[0] + (1 - share) * parts[1], cuts[:-1])) if len(ahead) else np.zeros(0)
                logs = np.concatenate([[0.0], np.cumsum(logs)])
                sums = np.diff(largest[first] + logs[np.searchsorted(cuts, first)])
            texts = np.logaddexp(texts, sums * np.log(10))
    return (texts - np.log(len(shares))) / np.log(10)


def score(docs: DataFrame, training: DataFrame, id_column: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every row of `docs`, learning from `training`."""
    context = docs.sparkSession.sparkContext
    counts = checkpoint(word_counts(training.select(quoted(text).cast("string").alias("text"))))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    fitted, lexicon, frequent_counts = fit(training, counts, text, s=s)
    model, hot_counts = context.broadcast(fitted), context.broadcast(frequent_counts)
    end_count = int(counts.where(F.col("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    floor = np.log10(total + 0.1 * (distinct + 1))
    end_log = float(np.log10(end_count + 0.1) - floor)
    other = max(1 - float(10.0 ** -floor * (frequent_counts + 0.1).sum()) - 10.0**end_log, 0.0)
    source = docs.select(quoted(id_column).alias("id"), quoted(text).cast("string").alias("text"))
    rare_type = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.append(np.log10(hot_counts.value + 0.1), 0.0)  # the last one is nobody's
        reader = Reader(lexicon.value, model.value.place, model.value.model_file)
        for batch in batches:
            for part in slices(batch, "text"):
                line, x = reader.line(Texts(part.column("text")))
                hashes, known, first = x["hashes"], x["known"], x["first"]
                sizes = np.diff(first)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                base = np.bincount(owner[known], logs[x["at"][known]], len(sizes)) + np.log10(end_count + 0.1)
                attention = model.value.log10_p(line, x["token_cuts"])
                word = np.insert(np.where(known, logs[x["at"]] - floor, np.nan), first[1:], end_log)
                scores = interpolated(attention, word, first + np.arange(len(first)), s.shares, other)
                rest = np.flatnonzero(~known)
                order = rest[np.lexsort((hashes[rest], owner[rest]))]
                new = np.ones(len(order), bool)
                new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                cut = np.flatnonzero(new)
                times = np.diff(np.append(cut, len(order)))
                rare = pa.StructArray.from_arrays([pa.array(hashes[order[cut]].view(np.int64)), pa.array(times.astype(np.int32))], names=["word", "n"])
                bounds = np.searchsorted(owner[order[cut]], np.arange(len(sizes) + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(sizes.astype(np.int64) + 1),
                        pa.array(np.bincount(owner[known], minlength=len(sizes)).astype(np.int64) + (end_count > 0)),
                        pa.array(base),
                        pa.array(scores),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rare).cast(rare_type),
                    ],
                    names=["id", "n_tokens", "known", "base", "score", "rare"],
                )

    id_type = source.schema["id"].dataType.simpleString()
    rows = source.mapInArrow(run, f"id {id_type}, n_tokens long, known long, base double, score double, rare array<struct<word:long,n:int>>")
    rows = checkpoint(rows.withColumn("row_id", F.monotonically_increasing_id()))
    # Rare words only: those the broadcast left out. One with many askers (as no training text knows it) is a skewed key of
    # a left join, which Spark splits.
    asked = rows.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.word", "r.n")
    told = asked.join(counts.select("word", F.col("n").alias("c")), "word", "left")
    per_row = told.groupBy("row_id").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"))
    out = rows.drop("rare").join(per_row, "row_id", "left")
    return out.select(
        "id",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(floor)).alias("base_score"),
        "score",
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_remainder("doc_id", 10) == 0, F.lit(False))
    out = score(docs, docs.where(~held), s=Settings(shares=SHARES))
    return out.withColumnRenamed("id", "doc_id").withColumn("held_out", held)
