"""Headings and chunks of very large documents (R06-R16): no step holds a document.

Lines are dealt by page. What a page takes over from those before it (the first page of the body, the top heading, the
subsection, the number of headings so far) is found from summaries, a short row a page: a scan over blocks of pages and over
the blocks of a document. Then every page is worked on by itself, and lines meet again only in their chunk.

The summaries know what a page does to the context before it is known: a page's subsections count only if their number fits
the top heading above them, which may stand on an earlier page, so they are kept with the page's own top heading, and
looked at again when the one carried in is known. The rows are those of `structure`, document by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import strip
from ..profiles import Profile, STANDARD
from ..sources.tables import snapshot
from .lines import kept_lines, page_window
from .structure import chunks_of, contents_of, toc_titles, with_line_class, with_titles, wrapped_titles

#: Pages of a block of the scan.
BLOCK_PAGES = 512
PAGE = ["document", "pdf_page"]


def before(pages: DataFrame, lasts: tuple[str, ...] = (), sums: tuple[str, ...] = ()) -> DataFrame:
    """Add, for a row a page, `before_x`: the last value of x that isn't null, or the sum of x, over the document's pages before
    this one. Pages are scanned in blocks, then blocks in their document."""
    d = pages.withColumn("_block", F.floor(F.col("pdf_page") / BLOCK_PAGES))
    last_of = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pdf_page"))).alias(c)
    blocks = d.groupBy("document", "_block").agg(*[last_of(c) for c in lasts], *[F.sum(c).alias(c) for c in sums], F.count("*").alias("_pages"))

    def scanned(rows: DataFrame, by: list[str], order: str, prefix: str) -> DataFrame:
        ahead = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        lately = {prefix + c: F.last(c, ignorenulls=True).over(ahead) for c in lasts}
        return rows.withColumns(lately | {prefix + c: F.coalesce(F.sum(c).over(ahead), F.lit(0)) for c in sums})

    carried = scanned(blocks, ["document"], "_block", "_far_").drop(*lasts, *sums, "_pages")
    d = scanned(d, ["document", "_block"], "pdf_page", "_near_").join(carried, ["document", "_block"])
    d = d.withColumns({f"before_{c}": F.coalesce(f"_near_{c}", f"_far_{c}") for c in lasts} | {f"before_{c}": F.col(f"_near_{c}") + F.col(f"_far_{c}") for c in sums})
    return d.drop("_block", *[f"_{k}_{c}" for k in ("near", "far") for c in (*lasts, *sums)])


def _page_summaries(lines: DataFrame, profile: Profile) -> DataFrame:
    """document, pdf_page, starts (the body may begin here), top (the last heading of its kind, with its line), subs (its subsections)."""
    top = F.struct("line_no", F.col("top_section").alias("section"), F.col("top_title").alias("title"))
    is_sub = F.col("line").rlike(profile.subsection) & F.col("top_section").isNull()
    sub = F.struct("line_no", F.col("page_top.section").alias("under"), F.regexp_extract("line", profile.subsection, 1).alias("section"), strip(F.regexp_extract("line", profile.subsection, 2)).alias("title"))
    return lines.groupBy(*PAGE).agg(
        F.max(F.coalesce(F.col("printed_page") == F.lit(profile.first_label), F.lit(False))).alias("starts"),
        F.max_by(top, F.when(F.col("top_section").isNotNull(), F.col("line_no"))).alias("top"),
        F.array_sort(F.collect_list(F.when(is_sub, sub))).alias("subs"),
    )


def _body_pages(pages: DataFrame, profile: Profile) -> DataFrame:
    if profile.first_page is not None:
        return pages.where(F.col("pdf_page") >= profile.first_page)
    first = pages.where("starts").groupBy("document").agg(F.min("pdf_page").alias("_first"))
    return pages.join(first, "document").where("pdf_page >= _first").drop("_first")


def _sub_at_end(profile: Profile) -> Column:
    """What a page makes of the subsection: null leaves it, a struct sets it, and one of nulls ends it."""
    fits = lambda s: F.coalesce(F.split_part(s["section"], F.lit("."), F.lit(1)) == F.coalesce(s["under"], F.col("before_top.section")), F.lit(False)) if profile.guarded else F.lit(True)
    own = F.filter("subs", lambda s: fits(s) & (s["line_no"] > F.coalesce(F.col("top.line_no"), F.lit(-1))))
    last = F.try_element_at(own, F.lit(-1))
    return F.when(F.col("top").isNotNull() | (F.size(own) > 0), F.struct(last["section"].alias("section"), last["title"].alias("title")))


def segmented_lines(pages: DataFrame, profile: Profile = STANDARD) -> DataFrame:
    """Classed body lines with their context and `seg`, as `structure.classified` gives them, page by page."""
    kept = kept_lines(pages, profile, tuple(PAGE))
    so_far = page_window().rowsBetween(W.unboundedPreceding, 0)
    heading = F.when(F.col("top_section").isNotNull(), F.struct(F.col("top_section").alias("section"), F.col("top_title").alias("title")))
    lines = snapshot(wrapped_titles(kept, profile).withColumn("page_top", F.last(heading, ignorenulls=True).over(so_far)))
    summaries = snapshot(_body_pages(_page_summaries(lines, profile), profile))
    summaries = snapshot(before(summaries, ("top",)).withColumn("sub", _sub_at_end(profile)))
    carried = before(summaries, ("sub",)).select(*PAGE, "before_top", "before_sub")
    if profile.lettered:  # the contents: pages of their own, a map a document
        carried = carried.join(contents_of(toc_titles(kept, profile)), "document", "left")
    rows = lines.join(carried, PAGE)
    rows = rows.withColumn("cur_top", F.coalesce("page_top.section", "before_top.section")).withColumn("cur_top_title", F.coalesce("page_top.title", "before_top.title"))
    rows = with_line_class(rows, profile)
    sets = F.when(F.col("line_class") == "top", F.struct(F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("title"))).when(
        F.col("line_class") == "subsection", F.struct(F.regexp_extract("line", profile.subsection, 1).alias("section"), strip(F.regexp_extract("line", profile.subsection, 2)).alias("title"))
    )
    rows = rows.withColumn("_sub", F.coalesce(F.last(sets, ignorenulls=True).over(so_far), "before_sub"))
    rows = rows.withColumn("cur_sub", F.col("_sub.section")).withColumn("cur_sub_title", F.col("_sub.title")).drop("_sub", "page_top", "before_top", "before_sub")
    rows = snapshot(with_titles(rows, profile, None).where("cur_top is not null"))
    is_heading = F.when(F.col("line_class") != "body", 1).otherwise(0)
    numbers = before(snapshot(rows.groupBy(*PAGE).agg(F.sum(is_heading).alias("headings"))), sums=("headings",)).select(*PAGE, "before_headings")
    return rows.join(numbers, PAGE).withColumn("seg", F.col("before_headings") + F.sum(is_heading).over(so_far)).drop("before_headings")


def segmented_chunks(pages: DataFrame, profile: Profile = STANDARD) -> DataFrame:
    """What `structure.structural_chunks` gives, from pages, for documents of any size. A chunk, though, is a row."""
    return chunks_of(segmented_lines(pages, profile), profile)
