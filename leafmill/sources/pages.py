"""Page text: readers, and the page table derived from `documents` that the queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..profiles import Profile, STANDARD


def read_pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """document, pdf_page, page_text. kind: parquet, json, or text (one dump a document, pages parted by form feeds)."""
    if kind == "text":
        whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("document"), F.split("value", "\f", -1).alias("pages"))
        return whole.select("document", F.posexplode("pages").alias("pos", "page_text")).select("document", (F.col("pos") + 1).cast("int").alias("pdf_page"), "page_text")
    schema = "document string, pdf_page int, page_text string"
    found = spark.read.schema(schema).json(path) if kind == "json" else spark.read.parquet(path)
    return found.select("document", "pdf_page", F.coalesce("page_text", F.lit("")).alias("page_text"))


def derived_pages(spark: SparkSession, sf_dir: str, profile: Profile = STANDARD, contents: bool = False) -> DataFrame:
    """Headings, controls, bullets and enumerators laid over the lines of `documents` by position: document, pdf_page, page_text.

    `contents`: with lettered headings instead of controls, and a contents page that lists them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select(F.col("doc_id").alias("document"), "text")

    def laid(line: Column, i: Column) -> Column:
        top = F.floor(i / 24) + 1
        number = F.concat_ws(".", top.cast("string"), (F.floor((i % 24) / 8) + 1).cast("string"))
        half = (F.floor((i % 8) / 4) + 1).cast("int")
        heading = F.when(i % 24 == 0, F.concat(top.cast("string"), F.lit(". SECTION "), F.substring(F.lit("ABCDEFGH"), top.cast("int"), F.lit(1)), F.lit("X\n"))).otherwise("")
        topic = F.when(i % 8 == 0, F.concat(number, F.lit(". Topic Heading\n"))).otherwise("")
        letter = F.concat(F.lit("("), F.substring(F.lit("ab"), half, F.lit(1)), F.lit(") Common\nTopic Title\n"))
        control = letter if contents else F.concat(number, F.lit("."), half.cast("string"), F.lit(" "))
        mark = F.when(i % 4 == 1, control).when(i % 5 == 2, "• ").when(i % 7 == 3, "a) ").otherwise("")
        return F.concat(heading, topic, mark, line, F.when(i % 3 == 2, "\n").otherwise(""))

    # Twelve lines a page, all in the document's row; lines of rows with one id stand together by position, as one document.
    bodies = lambda text: F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("i"), laid(line, i).alias("body")))
    docs = docs.groupBy("document").agg(F.collect_list("text").alias("texts"))
    docs = docs.select("document", (F.size("texts") == 1).alias("alone"), F.flatten(F.transform("texts", bodies)).alias("rows"))
    docs = docs.select("document", "alone", F.when(F.col("alone"), F.col("rows")).otherwise(F.array_sort("rows")).alias("rows"))
    of_page = lambda p: F.when(F.col("alone"), F.slice(F.col("rows"), p * 12 + 1, 12)).otherwise(F.filter("rows", lambda r: F.floor(r["i"] / 12) == p))
    label = F.lit(f"Ref. No. : {profile.document} ")
    made = lambda p: F.concat(F.lit("BASELINE IT SECURITY POLICY BODY\n"), label, (p + 1).cast("string"), F.lit("\n"), F.array_join(of_page(p)["body"], "\n"))
    front = F.concat(F.lit("BASELINE IT SECURITY POLICY CONTENTS\n"), label, F.lit("iii-1\n1. SECTION AX\nContents text"))
    if contents:
        entries = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda s: F.concat(F.lit("1."), s.cast("string"), F.lit(". Topic Heading\n(a) Common\nTopic Title ..... 3\n(b) Common Topic Title .... 4")))
        front = F.concat(front, F.lit("\n"), F.array_join(entries, "\n"))
    last = F.floor(F.element_at("rows", -1)["i"] / 12).cast("int")
    pages = F.concat(F.array(front), F.transform(F.sequence(F.lit(0), last), made))
    return docs.select("document", F.posexplode_outer(pages).alias("page", "page_text")).select("document", (F.col("page") + 1).alias("pdf_page"), "page_text")
