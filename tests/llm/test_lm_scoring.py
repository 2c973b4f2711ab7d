import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import lm_scoring as lm
from leafmill.llm.lm_scoring import CONTEXT, Line, all_log_p, first_weights, gradient, op9_lm_scoring, score, target_log_p, unpack
from leafmill.llm.textops import Texts

from . import awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def check_base(got, texts, train):
    counts = Counter(t for x in train for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    for r, text in zip(got, texts):
        ts = tokens(text)
        want = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(counts[t] > 0 for t in ts), n)
        assert r.base_score == pytest.approx(want, rel=1e-9)
        assert r.score < 0


@pytest.mark.parametrize("hot", [1 << 18, 50])
def test_base_against_brute_force(spark, sf, monkeypatch, hot):
    monkeypatch.setattr(lm, "most_frequent", lambda counts, f=lm.most_frequent: f(counts, hot))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op9_lm_scoring(spark, sf).orderBy("doc_id").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    assert [r.held_out for r in got] == [held(r.doc_id) for r in got] and len(got) == len(docs)
    check_base(got, [docs[r.doc_id] for r in got], [t for i, t in docs.items() if not held(i)])


IDS = 40


def some_line(rng, *sizes, ids=None):
    ids = rng.integers(0, IDS, sum(sizes)).astype(np.int32) if ids is None else ids
    return Line.of(ids, np.cumsum([0, *sizes]), IDS)


def some_weights(rng):
    flat = first_weights(rng.random(IDS))
    return flat + rng.standard_normal(len(flat)) * 0.3


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_windows_score_each_position_once(size):
    line = some_line(np.random.default_rng(1), 1, 15, 0, 17, 100)
    parts = list(line.windows(size))
    assert (np.concatenate([x.target[skip:] for x, skip in parts]) == line.target).all()
    assert all(skip == CONTEXT - 1 for x, skip in parts[8:])
    assert line.ahead[0] == line.ahead[16] == IDS and line.pos[15] == 14


def test_scores_are_the_model_in_any_window_and_sum_to_one(monkeypatch):
    rng = np.random.default_rng(5)
    w, line = unpack(some_weights(rng)), some_line(rng, 1, 5, 40, 70)
    log_p = all_log_p(w, line)
    assert np.allclose(np.exp(log_p).sum(axis=0), 1)
    for window in (3, 50, 1 << 14):
        monkeypatch.setattr(lm, "WINDOW", window)
        assert np.allclose(target_log_p(w, line), log_p[line.target, np.arange(116)], atol=1e-6)


def test_attention_is_causal_and_ends_with_the_text_and_the_context():
    rng = np.random.default_rng(2)
    w, line = unpack(some_weights(rng)), some_line(rng, 30, 60)
    before = target_log_p(w, line)
    for at, changed in ((10, range(10, 20)), (28, range(28, 30)), (50, range(50, 60))):
        ids = line.target.copy()
        ids[at] = (ids[at] + 3) % IDS
        moved = np.flatnonzero(np.abs(target_log_p(w, some_line(rng, 30, 60, ids=ids)) - before) > 1e-9)
        # The id itself, and those that have it among the CONTEXT ids ahead of them in the same text.
        assert set(moved.tolist()) == {i for i in changed if i <= at + CONTEXT}


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    flat, line = some_weights(rng), some_line(rng, 5, 40, 70)
    x, skip = list(line.windows(60))[1]

    def loss(flat):
        slope = np.zeros_like(flat)
        return gradient(unpack(flat), x, skip, unpack(slope)), slope

    g = loss(flat)[1]
    for i in rng.choice(len(flat), 80, replace=False):
        step = np.zeros_like(flat)
        step[i] = 1e-5
        assert g[i] == pytest.approx((loss(flat + step)[0] - loss(flat - step)[0]) / 2e-5, abs=1e-6)


def test_training_beats_frequencies_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'")
    train, held = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    mean = lambda rounds: held.sparkSession.createDataFrame(score(held, train, s=lm.Settings(rounds=rounds)).select("score").toPandas()).groupBy().sum("score").first()[0]
    assert mean(1) > 0.93 * mean(0)


def test_held_out_texts_are_likelier_than_by_frequencies_alone(spark):
    held = lm.op9_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) score", "sum(base_score) base").first()
    assert held.score > held.base


def test_interpolation_against_each_share_in_turn_and_sums_to_one():
    attention, other, shares = np.log10([0.5, 0.2, 0.1, 0.15, 0.05]), 0.2, (0.1, 0.5, 0.9)
    word = np.log10([0.4, 0.3, 0.1, 1, 1])
    word[3:] = np.nan  # words that the frequencies don't know: their model's probabilities are 0.2 together
    first = np.array([0, 2, 2, 5])
    by_count = np.where(np.isnan(word), other * 10**attention, 10.0 ** np.nan_to_num(word))
    p = [[np.prod([share * 10 ** attention[i] + (1 - share) * by_count[i] for i in range(a, b)]) for share in shares] for a, b in zip(first, first[1:])]
    assert np.allclose(lm.interpolated(attention, word, first, shares, other), np.log10(np.mean(p, axis=1)))
    one = 10 ** lm.interpolated(attention, word, np.arange(6), shares, other)
    assert one.sum() <= 1
    assert np.isfinite(lm.interpolated(attention, word, first, shares, 0.0)).all()


def test_awkward_rows(spark):
    docs = awkward.frame(spark)
    got = score(docs, docs, s=lm.Settings()).collect()
    assert len(got) == len(awkward.rows()) and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)
    train = [r[1] for r in awkward.rows()]
    by = {r.id: r for r in got}
    ids = [i for i in range(len(awkward.TEXTS))]
    check_base([by[i] for i in ids], [awkward.TEXTS[i] for i in ids], train)
    nothing = score(docs, awkward.empty(spark)).collect()
    assert len(nothing) == len(got) and {(r.n_known, r.train_tokens) for r in nothing} == {(0, 0)}
    assert score(awkward.empty(spark), docs).count() == 0


def test_order_of_words_and_their_identity_count(spark):
    """Three words of one shape take turns: their order tells what comes next, the frequencies don't."""
    rng = np.random.default_rng(6)
    train = spark.createDataFrame([(i, " ".join(["bad", "cat", "dig"][k % 3] for k in range(j, j + 200))) for i, j in enumerate(rng.integers(0, 3, 3000).tolist())], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "bad cat dig " * 20), (1, "cat bad dig " * 20)], "doc_id long, text string")
    right, wrong = (r.score for r in score(asked, train).orderBy("id").collect())
    assert right > wrong + 5


def test_every_training_row_is_learned_from(spark, monkeypatch):
    rows = spark.range(300).selectExpr("id doc_id", "concat('word', id, ' and more') text")
    met = []
    monkeypatch.setattr(lm, "trained", lambda texts, weights, *more: met.append(texts.count()) or weights)
    lm.fit(rows, lm.word_counts(rows.select("text")), "text")
    assert met == [300] * lm.Settings().rounds


def dense_steps(flat, line, s):
    """What a learner does, over all weights at each step."""
    square = np.full_like(flat, 1e-10)
    for x, skip in line.windows(s.batch):
        slope = np.zeros_like(flat)
        gradient(unpack(flat), x, skip, unpack(slope))
        square += slope * slope
        flat = flat - np.float32(s.rate) * (slope / np.sqrt(square))
    return flat


def test_a_step_goes_over_the_weights_met_only_and_changes_them_as_a_dense_one(monkeypatch):
    rng, ids = np.random.default_rng(4), 3000
    start = first_weights(rng.random(ids) + 0.1).astype(np.float32)
    some = np.r_[0:40, 900:1000, 2950:3000].astype(np.int32)  # some groups are never met
    line = Line.of(rng.choice(some, 400), np.array([0, 150, 400]), ids)
    s = lm.Settings(batch=100)
    learner, gone_over = lm.Learner(start.copy(), s), []
    step = learner._step
    monkeypatch.setattr(learner, "_step", lambda w, *more: gone_over.append(w.size) or step(w, *more), raising=False)
    learner.learn(line)
    assert np.allclose(learner.flat, dense_steps(start, line, s), atol=1e-6) and not learner.slope.any()
    assert len(gone_over) >= 4 and sum(gone_over) < 0.6 * 4 * len(start)  # all of them at each step, before


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_places_of_words_are_those_of_a_binary_search(monkeypatch, n):
    rng = np.random.default_rng(n)
    words = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    words[: n // 3] >>= np.uint64(20)  # not spread evenly
    words = np.unique(np.append(words, np.array([(1 << 64) - 1] * (n > 4), np.uint64)))
    frequent = lm.Lexicon.__new__(lm.Lexicon)
    frequent.words, frequent.sizes, frequent.places = words, np.ones(len(words), np.int64), np.zeros(len(words), np.int32)
    monkeypatch.setattr(lm, "Lexicon", lambda *_: frequent)  # no tokenizer is needed here
    reader = lm.Reader(frequent, np.zeros(1, np.int32), "")
    asked = np.concatenate([words, words - np.uint64(1), words + np.uint64(1), rng.integers(0, 1 << 64, 500, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
    assert (reader.find(asked) == np.searchsorted(words, asked)).all()


def test_interpolation_of_long_texts_by_runs_of_tokens():
    rng, shares, other = np.random.default_rng(8), (0.05, 0.6, 1.0), 0.2
    attention = -rng.random(5000) * 6
    word = np.where(rng.random(5000) < 0.1, np.nan, -rng.random(5000) * 6)
    first = np.array([0, 1, 4000, 5000])
    by_count = np.where(np.isnan(word), np.log10(other) + attention, word)
    tokens = [np.log(share * 10**attention + (1 - share) * 10**by_count) for share in shares]
    want = [(np.logaddexp.reduce([x[a:b].sum() for x in tokens]) - np.log(3)) / np.log(10) for a, b in zip(first, first[1:])]
    assert np.allclose(lm.interpolated(attention, word, first, shares, other), want, rtol=1e-9)


def test_spellings_without_python_strings():
    texts = Texts(pa.array(["ABC d\u00e9F  x", None, "\u00c4 Z"]))
    starts, ends, _ = texts.words()
    assert lm._spelled(texts, starts, ends).to_pylist() == lm._strings(texts, starts, ends) == ["abc", "d\u00e9f", "x", "\u00c4", "z"]
    assert lm._spelled(texts, starts[:0], ends[:0]).to_pylist() == []
