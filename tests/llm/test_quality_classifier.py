import zlib

import numpy as np

from leafmill.llm.quality_classifier import FEATURES, features, fit, labelled_features, op3_quality_classifier, score
from leafmill.llm.textops import Texts

from . import awkward


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op3_quality_classifier(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.93 * len(held)


def test_learns_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no feature tells anything alone
    model = fit(x[:3000], y[:3000])
    assert (0, 1) in {(a, b) for a, b, _ in model.pairs}
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_score_is_a_sum_of_lookups():
    rng = np.random.default_rng(2)
    x = rng.random((500, 2)).astype(np.float32)
    model = fit(x, (x[:, 0] > 0.3).astype(float))
    for row in x[:20]:
        total = model.intercept + sum(t[np.searchsorted(e, v)] for e, t, v in zip(model.edges, model.tables, row))
        total += sum(t[np.searchsorted(model.coarse_edges[a], row[a]), np.searchsorted(model.coarse_edges[b], row[b])] for a, b, t in model.pairs)
        assert np.isclose(model.score(row[None])[0], 1 / (1 + np.exp(-total)))


def test_awkward_rows(spark):
    docs = awkward.frame(spark)
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) label")
    x, y = labelled_features(docs, labels)
    assert x.shape[1] == len(FEATURES) and np.isfinite(x).all()
    got = score(docs, fit(x, y)).collect()
    assert len(got) == len(awkward.rows()) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in score(docs, fit(*labelled_features(docs, labels.limit(0)))).collect()} == {0.5}
    assert score(awkward.empty(spark), fit(x, y)).count() == 0


def test_features_do_not_depend_on_neighbours(spark, sf):
    import pyarrow as pa

    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    together = features(Texts(pa.array(texts)))
    assert np.allclose(together, np.vstack([features(Texts(pa.array([t]))) for t in texts]))


def test_repeated_ids_stay_within_the_sample(spark):
    from leafmill.llm.quality_classifier import Settings, labelled_features

    docs = spark.range(300).selectExpr("id % 3 doc_id", "concat('text number ', id) text")
    labels = spark.range(3).selectExpr("id doc_id", "cast(id % 2 as int) label")
    x, y = labelled_features(docs, labels, Settings(sample=40))
    assert len(x) == len(y) == 40
