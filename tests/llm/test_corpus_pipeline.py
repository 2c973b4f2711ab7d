import hashlib

import corpus_pipeline as cp
import pytest
import sentencepiece

from leafmill.llm.sentencepiece_codec import public_model

from . import awkward
from .test_jaccard_join import brute as components
from .test_secret_scan import brute as secrets


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for _, stage in cp.STAGES[:-1]:
        steps.append(spark.createDataFrame(stage(spark, steps[-1], sf).collect(), docs.schema))
        assert steps[-1].columns == docs.columns
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    assert [r for r in rows[1].values()] and all(rows[0][i] == r for i, r in rows[1].items())
    lost = [r.text for i, r in rows[0].items() if i not in rows[1]]
    assert len(lost) < 0.02 * len(rows[0])
    want = components({i: r.text for i, r in rows[1].items()}, k=5, percent=80)
    assert set(rows[2]) == {c for _, c in want.values()}
    assert all(rows[1][i] == r for i, r in rows[2].items())
    assert set(rows[3]) == set(rows[2]) and not any(secrets(r.text) for r in rows[3].values())
    assert all(r == rows[2][i] for i, r in rows[3].items() if not secrets(rows[2][i].text) and cp.REDACTED not in r.text)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [i for i in rows[3] if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
    toxic = [i for i in rows[3] if i in labels and labels[i].toxic == 1]
    assert sum(i in rows[4] for i in clean) >= 0.97 * len(clean)
    assert sum(i in rows[4] for i in toxic) <= 0.3 * len(toxic)
    p = sentencepiece.SentencePieceProcessor(model_file=public_model())
    last = cp.STAGES[-1][1](spark, steps[-1], sf).collect()
    assert {r.doc_id for r in last} == set(rows[4])
    assert all(r.ids == p.encode(rows[4][r.doc_id].text) and r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(rows[4][r.doc_id].text.encode()).hexdigest() for r in last)


def test_awkward_rows(spark, tmp_path):
    labels = spark.createDataFrame([(5, 1, 0), (8, 0, 0), (9, None, 1)], "doc_id long, quality int, toxic int")
    for k, docs in enumerate((awkward.frame(spark), awkward.empty(spark))):
        sf = awkward.sf_dir(spark, tmp_path / str(k), labels=labels, documents=docs)
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        cp.STAGES[-1][1](spark, docs, sf).collect()
        assert k or sum(r.text == "One two three." for r in docs.collect()) <= 1


@pytest.mark.parametrize("one_in", [None, 1000])
def test_clean_documents_stay_where_labels_tell_of_few_toxic_ones(spark, tmp_path, one_in):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    toxic = labels.where("toxic = 1").orderBy("doc_id").limit(max(labels.count() // one_in, 1) if one_in else 0)
    few = labels.where("toxic = 0").union(toxic)
    docs = docs.join(labels.where("toxic = 1"), "doc_id", "left_anti").union(docs.join(toxic, "doc_id", "left_semi")).select(docs.columns)
    kept = {r.doc_id for r in cp.mix_to_targets(spark, docs, awkward.sf_dir(spark, tmp_path, labels=few)).select("doc_id").collect()}
    clean = [r.doc_id for r in docs.join(few.where("quality = 1 and toxic = 0"), "doc_id", "left_semi").collect()]
    assert clean and sum(i in kept for i in clean) >= 0.97 * len(clean)


def test_decisions_go_by_row(spark):
    text = "one two three four five six seven eight"
    rows = [(3, text), (5, text), (5, "a text of its own that no other row has"), (None, text), (None, "my password=abcd1234efgh is here"), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.drop_near_copies(spark, docs, "")
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in (rows[0], rows[2], *rows[4:]))
    redacted = {r.text: r.n_chars for r in cp.redact_secrets(spark, docs, "").collect()}
    assert redacted[f"my {cp.REDACTED} is here"] == len(f"my {cp.REDACTED} is here") and len(redacted) == 5
    again = spark.createDataFrame(docs.collect() * 2, docs.schema)
    assert sum(r.text == text for r in cp.drop_near_copies(spark, again, "").collect()) == 1


def test_clean_documents_stay_in_larger_tables_too(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = cp.mix_to_targets(spark, docs, sf).join(labels, "doc_id").groupBy("quality", "toxic").count().collect()
    have = {(r.quality, r.toxic): r["count"] for r in docs.join(labels, "doc_id").groupBy("quality", "toxic").count().collect()}
    share = {(r.quality, r.toxic): r["count"] / have[r.quality, r.toxic] for r in kept}
    assert share[1, 0] > 0.97 and share.get((0, 0), 0) < 0.5 and share.get((1, 1), 0) < 0.3
