import hashlib

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm.sentencepiece_codec import chunk_table, crosses_markers, encode_decode, op4_sentencepiece, public_model

from . import awkward


def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_model())


def test_pieces_do_not_cross_markers():
    assert not crosses_markers(library())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab the▁ \n\t\réß日👍🏽\x00.,1")) | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_same_ids_as_the_library(text):
    p = library_once[0]
    ids, decoded = chunk_table(public_model()).run([text])
    assert np.frombuffer(ids[0], np.int32).tolist() == p.encode(text)
    assert decoded[0] == p.decode(p.encode(text))


library_once = [library()]


def test_query_against_the_library(spark, sf):
    p = library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op4_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = p.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(p.decode(ids).encode()).hexdigest()


def test_awkward_rows(spark):
    p = library()
    got = encode_decode(awkward.frame(spark)).collect()
    assert len(got) == len(awkward.rows())
    for r in got:
        assert r.ids == p.encode(r.row.text or "") and r.decoded == p.decode(r.ids)
    assert encode_decode(awkward.empty(spark)).count() == 0
