"""Building the corpus and asking it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators import checks, conversations, lines, passages, structure, vectors
from ..profiles import Profile, STANDARD
from ..sources import tables


def body_of(pages: DataFrame, profile: Profile = STANDARD) -> DataFrame:
    return lines.body_lines(lines.kept_lines(pages, profile), profile)


def build_records(pages: DataFrame, profile: Profile = STANDARD, place: bool = False) -> DataFrame:
    """Pages to records: one shuffle by document carries lines, headings, chunks and passages."""
    kept = lines.kept_lines(pages, profile)
    toc = structure.toc_titles(kept, profile) if profile.lettered else None
    return passages.records(structure.structural_chunks(lines.body_lines(kept, profile), profile, toc), profile, place)


def checked_records(pages: DataFrame, profile: Profile = STANDARD) -> DataFrame:
    """The same, with every check that comes before paid work; breaks of a rule are errors."""
    wrong = lines.label_mismatches(lines.without_header_block(pages, profile), profile).limit(1).collect()
    if wrong:
        raise checks.CorpusError(f"a page label names another document: {wrong[0]}")
    records = checks.check_corpus(build_records(pages, profile))
    large = checks.oversized_records(records).limit(5).collect()
    if large:
        raise checks.CorpusError(f"passages beyond the hard word limit: {[r.id for r in large]}")
    return records


def corpus_report(pages: DataFrame, profile: Profile = STANDARD) -> tuple[DataFrame, DataFrame]:
    """The report and the coverage audit of a build, from one snapshot of its chunks: headings are found once."""
    kept = lines.kept_lines(pages, profile)
    toc = structure.toc_titles(kept, profile) if profile.lettered else None
    chunks = tables.snapshot(structure.structural_chunks(lines.body_lines(kept, profile), profile, toc))
    records = passages.records(chunks, profile)
    return checks.chunk_report(records, pages, chunks), checks.coverage_audit(chunks.withColumn("text", passages.chunk_text(F.col("lines"))), records)


def resume_build(records: DataFrame, root: str, embed: Callable[[list[str]], list[list[float]]], model: str) -> DataFrame:
    """The vector table under `root` brought up to `records` (id, text): what is stored stays, what is new is embedded and
    upserted. Gives the manifest's row.

    Stored ids that the input no longer has, vectors of several lengths and counts that don't agree are errors, and the table
    stays as it was: a snapshot is pointed to only after its checks. Whatever fails, no text is embedded twice."""
    spark = records.sparkSession
    last = tables.last_snapshot(spark, root)
    number, stored = last if last else (0, None)
    todo = records.select("id", "text")
    if stored is not None:
        stale = vectors.unexpected_ids(records, stored).limit(5).collect()
        if stale:
            raise checks.CorpusError(f"stored ids that the input no longer has: {[r.id for r in stale]}")
        todo = vectors.remaining_passages(todo, stored)
    made = vectors.embed_resumably(todo, embed, f"{root}/_texts").select("id", "text", "embedding")
    table = tables.snapshot(made if stored is None else tables.upserted(stored, made))
    size = vectors.vector_dimensions(table).first()
    if size.n and not size.fits:
        raise checks.CorpusError(f"vectors of {size.least} to {size.most} figures, {size.empty} without any")
    counts = vectors.build_counts(records, table).first()
    if not counts.agrees:
        raise checks.CorpusError(f"{counts.input_count} passages, {counts.stored_count} stored")
    tables.write_snapshot(spark, table, root, number + 1)
    return tables.build_manifest(table, model)


def answer_questions(records: DataFrame, questions: DataFrame, embed: Callable[[list[str]], list[list[float]]], k: int = 3) -> DataFrame:
    """query_id, evidence: the k nearest passages' texts for each question. Blank questions are an error before any call.

    Pages are turned into records once, and each text is embedded once: both are kept as snapshots, since the search reads
    them several times."""
    if not questions.where(is_blank(F.col("query"))).isEmpty():
        raise checks.CorpusError("blank question")
    records = tables.snapshot(records.select("id", "text"))
    stored = tables.snapshot(vectors.embed_passages(records, embed, text="text").select("id", "text", "embedding"))
    asked = tables.snapshot(vectors.embed_passages(questions, embed, text="query").select("query_id", "query", "embedding"))
    hits = vectors.cosine_topk(asked, stored, k)
    return conversations.evidence_messages(asked, conversations.retrieve_texts(hits, records))
