"""Work that grew with the table beyond need: lists made twice, pages moved line by line, texts searched again for white space."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions.text import LINE_BREAK, ODD_BREAKS, ODD_SPACES, SPACE, normalise_line, split_lines, strip
from leafmill.operators.lines import kept_lines
from leafmill.operators.passages import sized
from leafmill.operators.structure import structural_chunks
from leafmill.plans.corpus import body_of
from leafmill.sources.pages import derived_pages


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_split_into_lines_once(spark, sf):
    plan = optimized(kept_lines(derived_pages(spark, sf)))
    assert not [line for line in plan.splitlines() if "Filter" in line and "size(" in line], plan


def test_pages_are_made_in_the_documents_row(spark, sf):
    plan = optimized(derived_pages(spark, sf))
    assert plan.count("Aggregate") == 1 and plan.count("Generate") == 1 and "Union" not in plan, plan


def test_a_filter_on_words_does_not_count_again(spark, sf):
    plan = optimized(sized(structural_chunks(body_of(derived_pages(spark, sf)))).where("words > 220"))
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_extract_all" in line], plan


def test_a_document_in_several_rows_is_one(spark, tmp_path):
    rows = [(1, "\n".join(f"a{i:02}" for i in range(14))), (1, "\n".join(f"b{i:02}" for i in range(13))), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    pages = {(r.document, r.pdf_page): r.page_text for r in derived_pages(spark, str(tmp_path)).collect()}
    assert sorted(pages) == [(1, 1), (1, 2), (1, 3)]
    assert [x.split()[-1] for x in pages[1, 3].splitlines() if x[-3:-2] in ("a", "b")] == ["a12", "b12", "a13"]


SPACES = [chr(i) for i in range(0x3001)]


@pytest.mark.parametrize("frame", ["x{}y", "{}xy", "xy{}", "x {} y", "é{}y•"])
def test_short_ways_agree_with_the_patterns(spark, frame):
    d = spark.createDataFrame([(i, frame.format(c)) for i, c in enumerate(SPACES) if not 0xD800 <= i < 0xE000], "i int, t string").withColumn("t", F.coalesce("t", F.lit("")))
    t = F.col("t")
    slow_strip = lambda c: F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")
    slow_lines = F.split(t, LINE_BREAK, -1)
    slow_lines = F.when(F.element_at(slow_lines, -1) == "", F.slice(slow_lines, 1, F.size(slow_lines) - 1)).otherwise(slow_lines)
    differ = (strip(t) != slow_strip(t)) | (normalise_line(t) != slow_strip(F.regexp_replace(t, rf"{SPACE}+", " "))) | (split_lines(t) != slow_lines)
    assert d.where(differ).collect() == []
    assert set(ODD_BREAKS) < set(ODD_SPACES)
