import numpy as np
import pytest

from leafmill.llm import mixing
from leafmill.llm.mixing import DOMAINS, Settings, TARGETS, copies, fit, fit_softmax, fitted_rates, labelled_domains, memberships, op6_mixing

from . import awkward


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_expected_totals_match_each_target_and_posteriors_are_right(spark, sf):
    got = op6_mixing(spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (got["rate"] >= 0).all()
    totals = np.array([(got["rate"] * got["n_tokens"] * got[f"p_{d}"]).sum() for d in DOMAINS])
    assert np.abs(totals / totals.sum() / TARGETS - 1).max() < 0.01  # of each target
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got, on="doc_id")
    truth = np.where(labels["toxic"] == 1, 2, np.where(labels["quality"] == 0, 1, 0))
    best = labels[[f"p_{d}" for d in DOMAINS]].to_numpy().argmax(axis=1)
    assert (best == truth).mean() > 0.9
    assert labels["rate"][truth == 2].mean() < 0.25 < labels["rate"][truth == 0].mean()


def brute(tokens, p, targets, max_rate=None, steps=20000):
    """Plain projected gradient on the unweighted problem."""
    goal = np.array(targets) / sum(targets)
    have = tokens @ p
    budget = min(h / g for h, g in zip(have, goal) if g > 0)
    r = np.ones(len(tokens))
    a = tokens[:, None] * p / budget
    rate = 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(steps):
        r = np.clip(r - rate * a @ (r @ a - goal), 0, max_rate)
    return r @ a - goal


def test_against_plain_projected_gradient(spark):
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 500, 300).astype(float)
    p = rng.dirichlet([0.2, 0.2, 0.2], 300)
    df = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "n_tokens long, posterior array<double>")
    targets = (0.6, 0.3, 0.1)
    rate, expected = fitted_rates(df, targets, Settings(tolerance=1e-6))
    r = np.array([x.r for x in df.select(rate.alias("r")).collect()])
    assert (r >= 0).all() and np.abs(np.array(expected) - targets).max() < 1e-3
    assert np.abs(brute(tokens, p, targets)).max() < 1e-3


def test_scarce_and_soft_domains_with_rates_up_to_one(spark):
    """Most documents clean, the others clear-cut, as in a corpus: every step brings the loss down to its least."""
    rng = np.random.default_rng(4)
    kind = rng.choice(3, 3000, p=[0.76, 0.14, 0.10])
    p = np.array([rng.dirichlet(np.eye(3)[k] * 20 + 0.05) for k in kind])
    tokens = rng.integers(1, 500, 3000).astype(float)
    df = spark.createDataFrame([(int(t), x.tolist(), int(k)) for t, x, k in zip(tokens, p, kind)], "n_tokens long, posterior array<double>, kind int")
    rate, expected = fitted_rates(df, TARGETS, max_rate=1.0, whole=0)
    means = {r.kind: r.r for r in df.groupBy("kind").agg({"n_tokens": "count"}).join(df.withColumn("r", rate).groupBy("kind").avg("r").withColumnRenamed("avg(r)", "r"), "kind").collect()}
    assert means[0] > 0.97 and means[1] < 0.35 and means[2] < 0.2
    assert np.abs(np.array(expected) - TARGETS).max() < 0.02


def test_copies_have_the_rate_as_mean(spark):
    df = spark.range(20000)
    for rate in (0.0, 0.25, 1.0, 1.7):
        mean = df.selectExpr("id").select(copies(__import__("pyspark").sql.functions.lit(rate), df.id).alias("c")).groupBy().avg("c").first()[0]
        assert mean == pytest.approx(rate, abs=0.02)


def test_awkward_rows(spark):
    docs = awkward.frame(spark)
    labels = labelled_domains(docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality", "cast(null as int) toxic"))
    for given in (labels, labels.limit(0)):
        members = memberships(docs, fit(docs, given), docs.columns)
        rate, _ = fitted_rates(members, TARGETS)
        got = members.select("n_tokens", rate.alias("rate"), "posterior").collect()
        assert len(got) == len(awkward.rows()) and all(r.rate >= 0 and sum(r.posterior) == pytest.approx(1) for r in got)
    none = memberships(awkward.empty(spark), fit(awkward.empty(spark), labels), ["doc_id"])
    assert none.select(fitted_rates(none, TARGETS)[0]).count() == 0


@pytest.mark.parametrize("toxic", [0.0, 0.001])
def test_a_scarce_domain_does_not_shrink_the_clean_one(spark, toxic):
    rng = np.random.default_rng(4)
    kind = rng.choice(3, 4000, p=[0.9 - toxic, 0.1, toxic])
    p = np.full((4000, 3), 0.0005)
    p[np.arange(4000), kind] = 0.999
    df = spark.createDataFrame([(100, x.tolist()) for x in p], "n_tokens long, posterior array<double>")
    rate, expected = fitted_rates(df, TARGETS, max_rate=1.0, whole=0)
    r = np.array([x.r for x in df.select(rate.alias("r")).collect()])
    assert r[kind == 0].mean() > 0.97
    assert r[kind == 1].mean() < 0.75  # still thinned to its target
    assert expected[2] <= TARGETS[2]  # the shortfall is told


@pytest.mark.parametrize("toxic", [0.0, 0.001, 0.12])
def test_targets_are_met_however_scarce_a_domain_is(spark, toxic):
    rng = np.random.default_rng(5)
    kind = rng.choice(3, 4000, p=[0.8 - toxic, 0.2, toxic])
    p = np.array([rng.dirichlet(np.eye(3)[k] * 30 + 0.02) for k in kind])
    df = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(rng.integers(1, 900, 4000), p)], "n_tokens long, posterior array<double>")
    rate, expected = fitted_rates(df, TARGETS)
    assert np.abs(np.array(expected) / TARGETS - 1).max() < 0.01
    got = df.select("n_tokens", "posterior", rate.alias("r")).toPandas()
    assert np.allclose((got["n_tokens"] * got["r"]).to_numpy() @ np.stack(got["posterior"]) * expected[0] / ((got["n_tokens"] * got["r"]).to_numpy() @ np.stack(got["posterior"]))[0], expected)


def test_repeated_ids_bring_no_more_rows_than_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 2, f"word{i % 7} text of row {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, domain int")
    seen = []
    monkeypatch.setattr(mixing, "fit_softmax", lambda x, y, k, s: seen.append(len(y)) or fit_softmax(x, y, k, s))
    model = fit(docs, labels, Settings(sample=20))
    assert seen == [20]
    assert np.array_equal(model.weights, fit(docs.repartition(5), labels, Settings(sample=20)).weights)


def test_long_texts_have_their_tokens_and_a_rate(spark):
    text = "word " * 60_000
    docs = spark.createDataFrame([(1, text), (2, "short text here"), (1, text)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (1, 0)], "doc_id long, domain int")
    members = memberships(docs, fit(docs, labels), ["doc_id"])
    got = members.withColumn("rate", fitted_rates(members, TARGETS)[0]).collect()
    assert sorted(r.n_tokens for r in got) == [3, 60_000, 60_000] and all(r.rate >= 0 for r in got)
