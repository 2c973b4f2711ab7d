"""A training corpus from `documents`: each stage calls one operator and acts on what it says."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import jaccard_join, language_id, mixing, secret_scan, sentencepiece_codec
from leafmill.llm.textops import checkpoint, quoted, table

#: The least score of a language that a document needs to stay.
LEAST_SCORE = 0.5
#: Near copies: five words a shingle, a similarity of 0.8 or more.
NEAR = jaccard_join.Similarity(5, 80)
REDACTED = "[secret]"
#: Bounds of what may be broadcast; beyond them, tables are joined by shuffle.
SMALL_ROWS, SMALL_BYTES = 1 << 18, 16 << 20


def _small(df: DataFrame, *columns: str) -> DataFrame:
    """Mark a checkpointed table for broadcast if it is small: that is looked up, not assumed."""
    size = sum((F.coalesce(F.length(F.concat_ws("", c)), F.lit(0)) for c in columns), F.lit(16))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= SMALL_ROWS and size <= SMALL_BYTES else df


def _columns(df: DataFrame) -> list:
    return [quoted(c) for c in df.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language go: null texts, texts without a letter, and those whose best language
    reaches less than LEAST_SCORE. Other rows stay as they are, repeated ones each. An empty table stays empty."""
    out = language_id.predict(docs, language_id.fit_on_training_rows(docs))
    return out.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays, with the least id (rows without an id come last). Decisions are made
    by id and text together, so rows that share an id with a copy but have another text stay, and so do texts without words."""
    linked = checkpoint(jaccard_join.link(docs, s=NEAR).where("n_shingles > 0"))
    key = lambda d: d.select(F.col("id").alias("_id"), F.col("fp").alias("_fp"))
    gone = checkpoint(key(linked.where(~F.col("keeper"))).distinct())
    again = checkpoint(key(linked.where("keeper").groupBy("id", "fp").count().where("count > 1")))
    marked = jaccard_join.fingerprints(docs, s=NEAR)
    same = lambda d: d["row.doc_id"].eqNullSafe(F.col("_id")) & (d["fp"] == F.col("_fp"))
    kept = marked.join(_small(gone), same(marked), "left_anti")
    if again.isEmpty():
        return kept.select("row.*")
    again = _small(again)
    repeated = kept.join(again, same(kept), "left_semi").groupBy("row.doc_id", "fp").agg(F.first("row").alias("row"))
    return kept.join(again, same(kept), "left_anti").select("row.*").union(repeated.select("row.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; the secrets in its text are replaced, with or without an id, and n_chars follows. What is a secret
    hangs on the text alone, so texts are told apart by their hash. Null and empty texts stay as they are."""
    keyed = docs.select(F.xxhash64("text").alias("_text"), "text")
    found = secret_scan.scan(keyed, id_column="_text").where("size(spans) > 0")
    values = found.select("doc_id", F.explode("spans.value").alias("value")).groupBy("doc_id").agg(F.collect_set("value").alias("values"))
    longest_first = F.array_sort("values", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    values = checkpoint(values.select(F.col("doc_id").alias("_secret_of"), longest_first.alias("_secrets")))
    text = F.when(F.col("_secrets").isNull(), F.col("text")).otherwise(F.aggregate("_secrets", F.col("text"), lambda t, v: F.replace(t, v, F.lit(REDACTED))))
    joined = docs.join(_small(values, "_secrets"), F.xxhash64("text") == F.col("_secret_of"), "left")
    changed = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("_secrets").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return changed.select(_columns(docs))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn with their fitted rates, which go from 0 to 1 here: no document is repeated. The budget is
    what the clean domain fills at rate 1: the others are thinned to their targets, or stay whole and fall short. Rows that share an id
    go or stay together; rows without one stay. A domain that falls short is logged. An empty table stays empty."""
    model = mixing.fit(docs, mixing.labelled_domains(table(spark, sf_dir, "labels")))
    members = checkpoint(mixing.memberships(docs, model, ["doc_id"]))
    rate, shares = mixing.fitted_rates(members, mixing.TARGETS, max_rate=1.0, whole=0)
    if short := [f"{d} {x:.4f} of {t}" for d, x, t in zip(mixing.DOMAINS, shares, mixing.TARGETS, strict=True) if x < 0.99 * t]:
        logging.getLogger(__name__).warning("mixing: short of target shares: %s", ", ".join(short))
    drawn = members.select("row.doc_id", mixing.copies(rate, F.col("row.doc_id")).alias("copies"))
    gone = checkpoint(drawn.where("copies = 0 and doc_id is not null").select("doc_id").distinct())
    return docs.join(_small(gone, "doc_id"), "doc_id", "left_anti").select(_columns(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text, how many, and the hash of what they decode to, of every row. A null text
    counts as empty: no ids. Repeated rows are each encoded. An empty table gives an empty result."""
    out = sentencepiece_codec.encode_decode(docs, carry=["doc_id", "lang", "source"])
    return out.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_to_targets),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Trained models and tokenizers can't be said in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
