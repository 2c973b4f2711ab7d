"""Headings and structural chunks (R11-R18). All windows share the document partitioning of the lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from ..functions.text import TEXT, clean_text, is_title_line, is_upper, strip
from ..profiles import APPENDIX, LETTER, Profile, STANDARD, TOC_LEADER
from .lines import page_window


def so_far() -> WindowSpec:
    """The document's lines up to this one."""
    return W.partitionBy("document").orderBy("pdf_page", "line_no").rowsBetween(W.unboundedPreceding, 0)


def wrapped_titles(lines: DataFrame, profile: Profile = STANDARD) -> DataFrame:
    """Find top headings and join the upper-case lines that continue their titles; these leave the lines.

    Adds top_section and top_title (null on other lines)."""
    line = F.col("line")
    is_top = line.rlike(profile.top)
    is_appendix = line.rlike(APPENDIX) if profile.appendix else F.lit(False)
    other = line.rlike(profile.subsection) | line.rlike(profile.control)
    can_go_on = is_upper(line) & ~F.col("blank_before") & ~is_top & ~is_appendix & ~other if profile.wrapped_titles else F.lit(False)
    rows = lines.withColumn("goes_on", can_go_on).withColumn("head", is_top | is_appendix)
    # Islands: a line that can't go on, and those after it that can.
    rows = rows.withColumn("island", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(page_window().rowsBetween(W.unboundedPreceding, 0)))
    island = W.partitionBy("document", "pdf_page", "island").orderBy("line_no")
    rows = rows.withColumn("under_head", F.first("head").over(island))
    rest = F.collect_list(F.when(F.col("goes_on"), line)).over(island.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    title = F.when(is_appendix, F.regexp_extract(line, APPENDIX, 2)).otherwise(F.regexp_extract(line, profile.top, 2))
    section = F.when(is_appendix, F.concat(F.lit("APPENDIX-"), F.regexp_extract(line, APPENDIX, 1))).otherwise(F.regexp_extract(line, profile.top, 1))
    rows = rows.withColumn("rest", rest)
    rows = rows.withColumn("top_section", F.when(F.col("head"), section)).withColumn("top_title", F.when(F.col("head"), F.concat_ws(" ", strip(title), F.array_join("rest", " "))))
    rows = rows.withColumn("top_title", F.when(F.size("rest") == 0, F.when(F.col("head"), strip(title))).otherwise(F.col("top_title")))
    return rows.where(~(F.col("goes_on") & F.col("under_head"))).drop("goes_on", "head", "island", "under_head", "rest")


def with_line_class(rows: DataFrame, profile: Profile) -> DataFrame:
    """Add line_class (without letters) to lines that know their top heading."""
    line = F.col("line")

    def numbered(pattern: str) -> Column:
        fits = line.rlike(pattern) & F.col("top_section").isNull()
        if profile.guarded:
            fits = fits & (F.split_part(F.regexp_extract(line, pattern, 1), F.lit("."), F.lit(1)) == F.col("cur_top"))
        return F.coalesce(fits, F.lit(False))

    control = numbered(profile.control)
    sub = ~control & numbered(profile.subsection)
    rows = rows.withColumn("line_class", F.when(F.col("top_section").isNotNull(), "top").when(control, "control").when(sub, "subsection").otherwise("body"))
    return rows


def with_titles(rows: DataFrame, profile: Profile, toc: DataFrame | None) -> DataFrame:
    """Add number, title and parent_titles to lines that know their class and headings; letters are found here."""
    line, is_sub = F.col("line"), F.col("line_class") == "subsection"
    number = F.when(F.col("line_class") == "top", F.col("top_section")).when(F.col("line_class") == "control", F.regexp_extract(line, profile.control, 1)).when(is_sub, F.regexp_extract(line, profile.subsection, 1))
    title = F.when(F.col("line_class") == "top", F.col("top_title")).when(F.col("line_class") == "control", strip(F.regexp_extract(line, profile.control, 2))).when(is_sub, strip(F.regexp_extract(line, profile.subsection, 2)))
    rows = rows.withColumn("number", number).withColumn("title", title)
    if profile.lettered:
        rows = lettered(rows, toc)
    top_text = F.when(F.col("cur_top").isNotNull(), F.concat("cur_top", F.lit(". "), "cur_top_title"))
    sub_text = F.when(F.col("cur_sub").isNotNull(), F.concat("cur_sub", F.lit(". "), "cur_sub_title"))
    return rows.withColumn("parent_titles", F.array_compact(F.array(top_text, sub_text))).drop("top_section", "top_title")


def classified(lines: DataFrame, profile: Profile = STANDARD, toc: DataFrame | None = None) -> DataFrame:
    """Add line_class (top, control, subsection, letter, body), number and title; heading context top and sub (structs).

    toc: document, key, toc_title of lettered headings in the contents."""
    line = F.col("line")
    rows = wrapped_titles(lines, profile)
    rows = rows.withColumn("cur_top", F.last("top_section", ignorenulls=True).over(so_far())).withColumn("cur_top_title", F.last("top_title", ignorenulls=True).over(so_far()))
    rows = rows.withColumn("top_seq", F.count("top_section").over(so_far()))

    rows = with_line_class(rows, profile)
    is_sub = F.col("line_class") == "subsection"
    under_top = W.partitionBy("document", "top_seq").orderBy("pdf_page", "line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("cur_sub", F.last(F.when(is_sub, F.regexp_extract(line, profile.subsection, 1)), ignorenulls=True).over(under_top))
    rows = rows.withColumn("cur_sub_title", F.last(F.when(is_sub, strip(F.regexp_extract(line, profile.subsection, 2))), ignorenulls=True).over(under_top))
    return with_titles(rows, profile, toc)


def toc_titles(lines: DataFrame, profile: Profile) -> DataFrame:
    """document, key, toc_title: lettered titles of the contents pages, wrapped entries joined up to the dot leader.

    An entry begins at a letter and ends with the first line that holds a leader; the last entry of a key wins."""
    rows = lines.where(F.col("printed_page").startswith("iii-"))
    line = F.col("line")
    is_sub = line.rlike(profile.subsection)
    rows = rows.withColumn("sub", F.last(F.when(is_sub, F.regexp_extract(line, profile.subsection, 1)), ignorenulls=True).over(so_far()))
    rows = rows.withColumn("letter", F.when(~is_sub & line.rlike(LETTER) & F.col("sub").isNotNull(), F.regexp_extract(line, LETTER, 1)))
    opens = F.col("letter").isNotNull() | is_sub
    rows = rows.withColumn("entry", F.sum(F.when(opens, 1).otherwise(0)).over(so_far())).withColumn("leads", line.rlike(TOC_LEADER) & ~is_sub)
    entry = W.partitionBy("document", "entry").orderBy("pdf_page", "line_no")
    rows = rows.withColumn("ended", F.sum(F.when(F.col("leads"), 1).otherwise(0)).over(entry.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.where(F.coalesce("ended", F.lit(0)) == 0)
    text = strip(F.regexp_replace(F.when(F.col("letter").isNotNull(), F.regexp_extract(line, LETTER, 2)).otherwise(line), TOC_LEADER, ""))
    parts = F.array_sort(F.collect_list(F.struct("pdf_page", "line_no", text.alias("text"))))
    entries = rows.groupBy("document", "entry").agg(F.first("sub").alias("sub"), F.max("letter").alias("letter"), F.max("leads").alias("ended"), parts.alias("parts")).where("letter is not null and ended")
    titled = entries.select("document", F.format_string("%s(%s)", "sub", "letter").alias("key"), "entry", clean_text(F.array_join("parts.text", " ")).alias("toc_title"))
    return titled.groupBy("document", "key").agg(F.max_by("toc_title", "entry").alias("toc_title"))


def contents_of(toc: DataFrame) -> DataFrame:
    """document, contents: the lettered titles of a document as one map."""
    return toc.groupBy("document").agg(F.map_from_entries(F.collect_list(F.struct("key", "toc_title"))).alias("contents"))


def with_wrapped_letters(rows: DataFrame) -> DataFrame:
    """Add joined and taken: a lettered heading's title with the lines that carry it on in the contents, and how many.

    The lines of a paragraph are gathered once. Each line that a title takes makes it longer by two characters at least, so a
    heading looks at as many lines as its title in the contents can hold: the work is in proportion to the paragraph and its titles."""
    columns = [c for c in rows.columns if c not in ("document", "pdf_page", "paragraph")]
    whole = rows.groupBy("document", "pdf_page", "paragraph").agg(F.array_sort(F.collect_list(F.struct("line_no", *[c for c in columns if c != "line_no"]))).alias("rows"))
    whole = whole.withColumn("lines", F.transform("rows", lambda r: r["line"]))

    def carried(r: Column, i: Column) -> Column:
        toc = F.lower(r["toc_title"])
        state = F.struct(r["own"].alias("title"), F.lit(0).alias("taken"), F.lit(False).alias("done"))

        def step(acc: Column, x: Column) -> Column:
            longer = F.concat_ws(" ", acc["title"], x)
            fits = F.coalesce(~acc["done"] & (F.lower(acc["title"]) != toc) & toc.startswith(F.lower(longer)), F.lit(False))
            return F.struct(F.when(fits, longer).otherwise(acc["title"]).alias("title"), (acc["taken"] + fits.cast("int")).alias("taken"), (acc["done"] | ~fits).alias("done"))

        return F.aggregate(F.slice(F.col("lines"), i + 2, F.length(r["toc_title"])), state, step)

    alone_in = lambda r: F.struct(r["own"].alias("title"), F.lit(0).alias("taken"), F.lit(True).alias("done"))
    found = F.transform("rows", lambda r, i: F.when(r["is_letter"], F.when(r["toc_title"].isNull(), alone_in(r)).otherwise(carried(r, i))))
    whole = whole.select("document", "pdf_page", "paragraph", F.inline_outer(F.arrays_zip(F.col("rows").alias("r"), found.alias("f"))))
    return whole.select("document", "pdf_page", "paragraph", *[F.col(f"r.{c}").alias(c) for c in columns], F.col("f.title").alias("joined"), F.col("f.taken").alias("taken"))


def lettered(rows: DataFrame, toc: DataFrame | None) -> DataFrame:
    """Resolve `(a) ...` lines: headings by the contents (or by their looks, where there are none), with wrapped titles
    joined from the lines of the same paragraph and page that carry on the title in the contents.

    The contents come as one map a document, so that lines keep their partitioning."""
    line = F.col("line")
    letter = F.when((F.col("line_class") == "body") & F.col("cur_sub").isNotNull() & line.rlike(LETTER), F.regexp_extract(line, LETTER, 1))
    rows = rows.withColumn("key", F.when(letter.isNotNull(), F.format_string("%s(%s)", F.col("cur_sub"), letter)))
    own = strip(F.regexp_extract(line, LETTER, 2))
    if toc is None and "contents" not in rows.columns:
        rows = rows.withColumn("toc_title", F.lit(None).cast("string")).withColumn("has_toc", F.lit(False))
    else:
        rows = rows if toc is None else rows.join(contents_of(toc), "document", "left")
        rows = rows.withColumn("toc_title", F.try_element_at("contents", F.col("key"))).withColumn("has_toc", F.col("contents").isNotNull()).drop("contents")
    by_contents = F.col("toc_title").isNotNull() & (F.lower("toc_title").startswith(F.lower(own)) | is_title_line(own))
    is_heading = F.col("key").isNotNull() & F.when(F.col("has_toc"), by_contents).otherwise(is_title_line(own))
    rows = rows.withColumn("is_letter", F.coalesce(is_heading, F.lit(False)))
    # A blank line ends a title: a heading that the contents name looks at the lines of its paragraph on its page.
    rows = rows.withColumn("paragraph", F.sum(F.col("blank_before").cast("int")).over(page_window().rowsBetween(W.unboundedPreceding, 0)))
    rows = with_wrapped_letters(rows.withColumn("own", own))
    # Lines that a heading has taken leave the body.
    at = F.row_number().over(page_window())
    rows = rows.withColumn("at", at).withColumn("covers", F.max(F.when(F.col("is_letter"), F.col("at") + F.col("taken"))).over(page_window().rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.where(F.coalesce("covers", F.lit(0)) < F.col("at"))
    rows = rows.withColumn("line_class", F.when(F.col("is_letter"), "letter").otherwise(F.col("line_class")))
    rows = rows.withColumn("number", F.when(F.col("is_letter"), F.col("key")).otherwise(F.col("number"))).withColumn("title", F.when(F.col("is_letter"), F.col("joined")).otherwise(F.col("title")))
    return rows.drop("key", "toc_title", "has_toc", "is_letter", "paragraph", "own", "joined", "taken", "at", "covers")


def structural_chunks(lines: DataFrame, profile: Profile = STANDARD, toc: DataFrame | None = None) -> DataFrame:
    """document, seg, id, kind, section, parent_titles, pdf_page_start, printed_page_start, lines (array of line, blank_before).

    Every heading closes the open chunk; clauses begin with their title, overviews with their first body line."""
    rows = classified(lines, profile, toc).where("cur_top is not null")
    heading = F.col("line_class") != "body"
    rows = rows.withColumn("seg", F.sum(F.when(heading, 1).otherwise(0)).over(so_far()))
    return chunks_of(rows, profile)


def chunks_of(rows: DataFrame, profile: Profile) -> DataFrame:
    """The chunks of classed lines that know their `seg`."""
    clause = F.col("line_class").isin("control", "letter")
    rows = rows.where(clause | (F.col("line_class") == "body"))
    text = F.when(clause, F.col("title")).otherwise(F.col("line"))
    place = F.struct("pdf_page", "line_no")
    entry = F.struct("pdf_page", "line_no", text.alias("line"), F.col("blank_before"))
    chunks = rows.groupBy("document", "seg").agg(
        F.coalesce(F.max(F.when(F.col("line_class") == "control", "numbered_clause").when(F.col("line_class") == "letter", "lettered_clause")), F.lit("overview")).alias("kind"),
        F.coalesce(F.max(F.when(clause, F.col("number"))), F.min_by(F.coalesce("cur_sub", "cur_top"), place)).alias("section"),
        F.min_by("parent_titles", place).alias("parent_titles"),
        F.min_by("pdf_page", place).alias("pdf_page_start"),
        F.min_by(F.coalesce("printed_page", F.lit("")), place).alias("printed_page_start"),
        F.array_sort(F.collect_list(entry)).alias("parts"),
    )
    chunks = chunks.where(F.exists("parts", lambda x: x["line"].rlike(TEXT)))
    lines_of = F.transform("parts", lambda x, i: F.struct(x["line"].alias("line"), (x["blank_before"] & (i > 0)).alias("blank_before")))
    chunks = chunks.withColumn("lines", lines_of).drop("parts")
    suffix = F.when(F.col("kind") == "overview", "overview").otherwise("clause")
    base = F.concat(F.col("document").cast("string"), F.lit(f"-v{profile.version}-"), "section", F.lit("-"), suffix)
    chunks = chunks.withColumn("base_id", base)
    repeat = F.row_number().over(W.partitionBy("document", "base_id").orderBy("seg"))
    chunks = chunks.withColumn("repeat", repeat).withColumn("id", F.when(F.col("repeat") == 1, F.col("base_id")).otherwise(F.concat("base_id", F.lit("-"), F.col("repeat").cast("string"))))
    return chunks.select("document", "seg", "id", "kind", "section", "parent_titles", "pdf_page_start", "printed_page_start", "lines")
