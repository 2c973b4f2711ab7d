"""Very large documents: the same rows as document by document, from pages dealt by page."""

import pytest
from pyspark.sql import functions as F

from leafmill.operators import lines as ln, structure as st
from leafmill.operators.segments import BLOCK_PAGES, before, segmented_chunks
from leafmill.profiles import GUIDELINE, OLDER, STANDARD
from leafmill.sources.pages import derived_pages


def whole(pages, profile):
    kept = ln.kept_lines(pages, profile)
    return st.structural_chunks(ln.body_lines(kept, profile), profile, st.toc_titles(kept, profile) if profile.lettered else None)


def rows_of(df):
    return sorted((r.document, r.seg, r.id, r.kind, r.section, tuple(r.parent_titles), r.pdf_page_start, r.printed_page_start, tuple((x.line, x.blank_before) for x in r.lines)) for r in df.collect())


@pytest.mark.parametrize("profile", [STANDARD, GUIDELINE, OLDER], ids=["standard", "guideline", "older"])
@pytest.mark.parametrize("merged", [False, True])
def test_the_same_chunks_as_document_by_document(spark, sf, profile, merged):
    pages = derived_pages(spark, sf, profile, contents=profile.lettered)
    if merged:  # a few documents of very many pages
        pages = pages.withColumn("pdf_page", (F.col("document") * 100 + F.col("pdf_page")).cast("int")).withColumn("document", F.col("document") % 2)
    got = rows_of(segmented_chunks(pages, profile))
    assert (got or profile is OLDER and not merged) and got == rows_of(whole(pages, profile))


def test_context_is_carried_over_pages_and_blocks(spark):
    pages = ["Ref. No.: S17 1\n1. TOP\n1.1. First Part", "2.1. Foreign Part\nstill under the first", "1.1.1 A control\nand text", "2. OTHER TOP\nan overview", "1.2. Foreign Again\n2.2. Second Part", "plain", "2.2.7 Last control"]
    far = [1, 2, BLOCK_PAGES - 1, BLOCK_PAGES, 3 * BLOCK_PAGES, 3 * BLOCK_PAGES + 1, 9 * BLOCK_PAGES]
    df = spark.createDataFrame(list(zip(["D"] * 7, far, pages)), "document string, pdf_page int, page_text string")
    got = rows_of(segmented_chunks(df))
    assert got == rows_of(whole(df, STANDARD))
    assert [(r[4], r[5]) for r in got] == [("1.1", ("1. TOP", "1.1. First Part")), ("1.1.1", ("1. TOP", "1.1. First Part")), ("2", ("2. OTHER TOP",)), ("2.2", ("2. OTHER TOP", "2.2. Second Part")), ("2.2.7", ("2. OTHER TOP", "2.2. Second Part"))]


def test_values_before_a_page(spark):
    n = 3 * BLOCK_PAGES
    df = spark.range(n).select(F.lit("d").alias("document"), F.col("id").cast("int").alias("pdf_page"), F.when(F.col("id") % 700 == 5, F.col("id")).alias("x"), F.lit(1).alias("n"))
    for r in before(df, ("x",), ("n",)).collect():
        seen = [i for i in range(r.pdf_page) if i % 700 == 5]
        assert r.before_x == (seen[-1] if seen else None) and r.before_n == r.pdf_page


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "document string, pdf_page int, page_text string")
    assert segmented_chunks(df).count() == 0 and segmented_chunks(df, GUIDELINE).count() == 0
