"""From page text to body lines (R06-R12). One shuffle, by document, which every later window and grouping reuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from ..functions.text import TEXT, is_blank, normalise_line, split_lines, strip
from ..profiles import PAGE_LABEL, Profile, STANDARD


def page_window() -> WindowSpec:
    return W.partitionBy("document", "pdf_page").orderBy("line_no")


def page_lines(pages: DataFrame) -> DataFrame:
    """document, pdf_page, line_no, line: every line, normalised; blank ones are empty."""
    lines = F.transform(split_lines(F.col("page_text")), normalise_line)
    return pages.select("document", "pdf_page", F.posexplode_outer(lines).alias("line_no", "line")).where("line_no is not null")


def _starts(line: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | line.startswith(p)
    return out


def without_header_block(pages: DataFrame, profile: Profile = STANDARD) -> DataFrame:
    """Lines without the running header: if the page's first text is a header, all before the first page label goes, and
    so does any line that starts with a header prefix. Done on the page's own array, so nothing moves."""
    # The outer form of posexplode throughout: with the plain one Spark makes each list once more to filter out empty ones.
    staged = pages.select("document", "pdf_page", split_lines(F.col("page_text")).alias("raw"))
    first = strip(F.get(F.filter("raw", lambda x: x.rlike(TEXT)), F.lit(0)))
    staged = staged.select("document", "pdf_page", F.transform("raw", normalise_line).alias("lines"), first.alias("first"))
    label_at = F.array_position(F.transform("lines", lambda x: x.rlike(PAGE_LABEL)), True)
    at = F.when(_starts(F.col("first"), profile.header_prefixes) & (label_at > 0), label_at - 1).otherwise(0) if profile.header_block else F.lit(0)
    staged = staged.withColumn("at", at.cast("int"))
    rows = staged.select("document", "pdf_page", "at", F.posexplode_outer("lines").alias("line_no", "line")).where("line_no >= at").drop("at")
    return rows.where(~_starts(F.col("line"), profile.header_prefixes) & ~F.col("line").isin(*profile.header_lines) if profile.header_lines else ~_starts(F.col("line"), profile.header_prefixes))


def page_labels(rows: DataFrame) -> DataFrame:
    """document, pdf_page, printed_page (the last label of the page), names (all documents that labels name)."""
    named = rows.where(F.col("line").rlike(PAGE_LABEL)).select("document", "pdf_page", "line_no", F.regexp_extract("line", PAGE_LABEL, 1).alias("name"), strip(F.regexp_extract("line", PAGE_LABEL, 2)).alias("label"))
    return named.groupBy("document", "pdf_page").agg(F.max_by("label", "line_no").alias("printed_page"), F.array_sort(F.collect_set("name")).alias("names"))


def label_mismatches(rows: DataFrame, profile: Profile = STANDARD) -> DataFrame:
    """Pages with a label that names another document: an error for the build."""
    return page_labels(rows).where(F.exists("names", lambda n: n != profile.document)).select("document", "pdf_page", "names")


def kept_lines(pages: DataFrame, profile: Profile = STANDARD, together: tuple[str, ...] = ("document",)) -> DataFrame:
    """document, pdf_page, line_no, line, blank_before, printed_page: text lines with their paragraph breaks.

    A break stands before a line if a blank one lies between it and the text line before it on the same page. Lines are
    dealt by the columns `together`: by document, or by document and page where one document may be very large."""
    rows = without_header_block(pages.repartition(*together), profile)
    ordered = page_window()
    label = F.when(F.col("line").rlike(PAGE_LABEL), strip(F.regexp_extract("line", PAGE_LABEL, 2)))
    # Labels are looked at once per page: the last one holds for all its lines.
    rows = rows.withColumn("label", label).withColumn("blanks", F.sum(F.when(F.col("line") == "", 1).otherwise(0)).over(ordered))
    rows = rows.withColumn("printed_page", F.last("label", ignorenulls=True).over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    text = rows.where((F.col("line") != "") & F.col("label").isNull())
    text = text.withColumn("blank_before", F.coalesce(F.col("blanks") > F.lag("blanks").over(ordered), F.lit(False)))
    return text.select("document", "pdf_page", "line_no", "line", "blank_before", "printed_page")


def body_lines(lines: DataFrame, profile: Profile = STANDARD) -> DataFrame:
    """Lines from the first page of the body on; documents without one give nothing."""
    if profile.first_page is not None:
        return lines.where(F.col("pdf_page") >= profile.first_page)
    first = F.min(F.when(F.col("printed_page") == profile.first_label, F.col("pdf_page"))).over(W.partitionBy("document"))
    return lines.withColumn("first", first).where(F.col("pdf_page") >= F.col("first")).drop("first")


def blank_pages(pages: DataFrame) -> DataFrame:
    """Pages without any text."""
    return pages.where(is_blank(F.col("page_text"))).select("document", "pdf_page")
