import math
import zlib

import numpy as np
import pytest

from leafmill.llm import language_id
from leafmill.llm.language_id import Settings, fit, grams, op2_language_id, posteriors, predict

from . import awkward


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op2_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_prediction_does_not_depend_on_neighbours(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(docs, "lang")
    texts = [r.text for r in docs.limit(30).collect()]
    alone = np.vstack([posteriors([t], model) for t in texts])
    assert np.allclose(alone, posteriors(texts, model), atol=1e-9)


def test_against_brute_force(spark):
    rows = [("en", "the cat"), ("en", "a dog"), ("de", "der hund"), ("de", "eine katze")]
    s = Settings(bits=12)
    model = fit(spark.createDataFrame(rows, "lang string, text string"), "lang", s=s)
    counts = {"de": [s.smoothing] * (1 << s.bits), "en": [s.smoothing] * (1 << s.bits)}
    for lang, text in rows:
        for g in grams([text], s)[0]:
            for b in g:
                counts[lang][b] += 1
    text = "die katze und the dog"
    want = {}
    for lang, c in counts.items():
        want[lang] = math.log(0.5) + sum(math.log(c[b] / sum(c)) for g in grams([text], s)[0] for b in g)
    p = posteriors([text], model)[0]
    assert p[0] == pytest.approx(1 / (1 + math.exp(want["en"] - want["de"])), rel=1e-3)


def test_blocks_of_languages_change_nothing(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r.text for r in docs.limit(30).collect()]
    whole = fit(docs, "lang")
    monkeypatch.setattr(language_id, "MODEL_BYTES", 4 << whole.settings.bits)
    model = fit(docs, "lang")
    assert (len(whole.blocks), len(model.blocks)) == (1, len(whole.labels))
    assert np.allclose(posteriors(texts, model), posteriors(texts, whole), atol=1e-12)
    got, want = (predict(docs, m, carry=["doc_id"]).orderBy("row.doc_id").collect() for m in (model, whole))
    assert [(r.row, r.lang_pred) for r in got] == [(r.row, r.lang_pred) for r in want]


def test_awkward_rows(spark):
    docs = awkward.frame(spark)
    got = predict(docs, fit(docs, "lang")).collect()
    assert len(got) == len(awkward.rows())
    for r in got:
        letters = any(c.isalpha() for c in r.row.text or "")
        assert (r.lang_pred, r.score > 0) == (("en", True) if letters else ("und", False))
    nothing = predict(docs, fit(awkward.empty(spark), "lang")).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert predict(awkward.empty(spark), fit(docs, "lang")).count() == 0
