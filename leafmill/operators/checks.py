"""Checks, audits and reports of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import SPACE, SPARK_WORD, is_blank
from ..profiles import BULLETS, HARD_MAX_WORDS

REQUIRED = ("document", "version", "language", "section", "parent_titles", "source_file", "printed_page_start")
RESERVED = ("id", "text")


class CorpusError(ValueError):
    """A table breaks a rule that the build depends on."""


def record_violations(records: DataFrame, mode: str = "report") -> DataFrame:
    """Add `violations` (array of rule names). mode: report (all rows), quarantine (broken rows only), fail (raise if any)."""
    rule = lambda broken, name: F.when(F.coalesce(broken, F.lit(True)), F.lit(name))
    present = {f.name for f in records.schema["metadata"].dataType.fields}
    rules = [rule(is_blank(F.col("id")), "blank id"), rule(is_blank(F.col("text")), "blank text")]
    for name in REQUIRED:
        if name not in present:
            rules.append(F.lit(f"missing {name}"))
        elif name == "printed_page_start":
            rules.append(rule(F.col(f"metadata.{name}").isNull(), f"missing {name}"))
        else:
            rules.append(rule(is_blank(F.col(f"metadata.{name}")), f"blank {name}"))
    rules.append(rule(F.col("metadata.pdf_page_start") < 1, "pdf_page_start below 1") if "pdf_page_start" in present else F.lit("missing pdf_page_start"))
    if "extra" in records.columns:
        keys = F.coalesce(F.map_keys("extra"), F.array().cast("array<string>"))
        rules.append(F.when(F.exists(keys, lambda k: k.isin(*RESERVED)), "reserved key"))
        rules.append(F.when(F.exists(keys, is_blank), "blank key"))
        rules.append(F.when(F.exists(F.coalesce(F.map_values("extra"), F.array().cast("array<string>")), lambda v: v.isNull()), "null value"))
    out = records.withColumn("violations", F.array_compact(F.array(*rules)))
    if mode == "report":
        return out
    broken = out.where(F.size("violations") > 0)
    if mode == "fail" and not broken.isEmpty():
        raise CorpusError(f"records break rules, such as {broken.select('id', 'violations').first()}")
    return broken if mode == "quarantine" else records


def duplicate_ids(records: DataFrame) -> DataFrame:
    """Ids found more than once, sorted."""
    return records.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").orderBy("id")


def check_corpus(records: DataFrame) -> DataFrame:
    """Before paid work: an empty corpus, broken records or repeated ids are errors."""
    if records.isEmpty():
        raise CorpusError("the corpus is empty")
    record_violations(records, "fail")
    again = duplicate_ids(records).limit(10).collect()
    if again:
        raise CorpusError(f"ids found more than once: {[r.id for r in again]}")
    return records


def oversized_records(records: DataFrame) -> DataFrame:
    return records.where(F.col("metadata.word_count") > HARD_MAX_WORDS).select("id", F.col("metadata.word_count").alias("word_count"))


#: Two primes below 2^31 and a base for each: products of remainders stay within a long.
_MODULI = ((2147483647, 1103515245), (2147483629, 1664525011))
#: Words as passages count them, and every other character but white space and bullets: no cut falls inside one of these.
_TOKEN = rf"{SPARK_WORD}|(?! )[^{SPACE[1:-1]}{BULLETS[1:-1]}]"


def sequence_hash(text: Column) -> Column:
    """A hash of a text's tokens in their order, as (hashes, powers): those of two texts in a row follow from each one's own,
    by `hash_of_parts`. White space and bullets don't count."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(f"(?s){_TOKEN}"), F.lit(0)), lambda t: F.xxhash64(t))
    start = F.struct(*[F.lit(v).cast("long").alias(n) for n, v in (("h0", 0), ("h1", 0), ("p0", 1), ("p1", 1))])
    step = lambda acc, t: F.struct(
        *[F.pmod(acc[f"h{i}"] * base + F.pmod(t, F.lit(m)), F.lit(m)).alias(f"h{i}") for i, (m, base) in enumerate(_MODULI)],
        *[F.pmod(acc[f"p{i}"] * base, F.lit(m)).alias(f"p{i}") for i, (m, base) in enumerate(_MODULI)],
    )
    return F.aggregate(tokens, start, step)


def hash_of_parts(parts: Column) -> Column:
    """The hashes h0 and h1 of texts in a row. parts: an array of their `sequence_hash`, in order."""
    start = F.struct(F.lit(0).cast("long").alias("h0"), F.lit(0).cast("long").alias("h1"))
    return F.aggregate(parts, start, lambda acc, x: F.struct(*[F.pmod(acc[f"h{i}"] * x[f"p{i}"] + x[f"h{i}"], F.lit(m)).alias(f"h{i}") for i, (m, _) in enumerate(_MODULI)]))


def coverage_audit(parents: DataFrame, records: DataFrame) -> DataFrame:
    """Chunks that their passages don't cover: `problem` says why. Each text is hashed in its own row, and the passages'
    hashes combine to the chunk's: only figures are shuffled.

    Texts count as equal if their words and other characters are so, in order, without white space and bullet glyphs: a cut
    may fall between two words that no space parts, and a bullet without text is lost on purpose.

    parents: id, section, parent_titles (array), text. records: with the piece in `piece` or as the text's third line."""
    body = F.regexp_extract("text", r"(?s)\nText: (.*)$", 1)
    m = lambda k: F.col(f"metadata.{k}")
    children = records.select(m("parent_chunk_id").alias("id"), m("part_number").alias("n"), m("section").alias("section"), m("parent_titles").alias("titles"), sequence_hash(body).alias("hash"))
    grouped = children.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("n", "hash"))).alias("parts"), F.array_sort(F.collect_set("section")).alias("sections"), F.array_sort(F.collect_set("titles")).alias("child_titles"), F.count("*").alias("n_children")
    )
    grouped = grouped.select("id", "sections", "child_titles", "n_children", hash_of_parts(F.transform("parts", lambda x: x["hash"])).alias("child_hash"))
    own = parents.select("id", "section", F.array_join("parent_titles", " > ").alias("titles"), hash_of_parts(F.array(sequence_hash(F.col("text")))).alias("hash"))
    problem = (
        F.when(F.col("n_children").isNull(), "no passages")
        .when(F.col("sections") != F.array("section"), "section differs")
        .when(F.col("child_titles") != F.array("titles"), "parent titles differ")
        .when(F.col("child_hash") != F.col("hash"), "text differs")
    )
    return own.join(grouped, "id", "left").select("id", F.coalesce("n_children", F.lit(0)).alias("n_children"), problem.alias("problem"))


def chunk_report(records: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Passages, their parents and words by kind and split method, with subtotals (null: all); the total has also the
    counts of pages and structural chunks.

    Each parent is counted once: passages are first added up by parent and method, and one row of a parent stands for it."""
    m = lambda k: F.col(f"metadata.{k}").alias(k)
    r = records.select(m("source_kind"), m("split_method"), m("parent_chunk_id"), m("word_count"), m("part_count"))
    r = r.groupBy("parent_chunk_id", "source_kind", "split_method").agg(F.count("*").alias("n"), F.min("word_count").alias("least"), F.max("word_count").alias("most"), (F.max("part_count") > 1).cast("int").alias("split"))
    first = (F.row_number().over(W.partitionBy("parent_chunk_id").orderBy("split_method")) == 1).cast("int")
    once = lambda each, one: F.when(F.grouping_id() == 0, each).otherwise(one)
    out = r.withColumn("first", first).rollup("source_kind", "split_method").agg(
        F.sum("n").alias("passages"),
        once(F.count("*"), F.sum("first")).alias("parents"),
        once(F.sum("split"), F.sum(F.col("first") * F.col("split"))).alias("split_parents"),
        F.min("least").alias("least_words"),
        F.max("most").alias("most_words"),
        F.grouping_id().alias("level"),
    )
    both = pages.select(F.lit(1).alias("p"), F.lit(0).alias("c")).union(chunks.select(F.lit(0), F.lit(1)))
    counts = both.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pages"), F.coalesce(F.sum("c"), F.lit(0)).alias("structural_chunks")).withColumn("level", F.lit(3).cast("long"))
    return out.join(F.broadcast(counts), "level", "left").drop("level")  # counts: one row


def review_rows(records: DataFrame) -> DataFrame:
    """The audit view of passages, numbered in the order of their document. records: with `seg`."""
    m = lambda k: F.col(f"metadata.{k}")
    order = W.partitionBy(m("document")).orderBy("seg", m("part_number"))
    titles = F.when(m("parent_titles") == "", "—").otherwise(F.replace(m("parent_titles"), F.lit(" > "), F.lit(" → ")))
    return records.select(
        m("document").alias("document"), F.row_number().over(order).alias("position"), "id", m("parent_chunk_id").alias("parent_chunk_id"), m("section").alias("section"), m("source_kind").alias("source_kind"), m("split_method").alias("split_method"),
        F.concat(m("part_number").cast("string"), F.lit(" / "), m("part_count").cast("string")).alias("part"), titles.alias("parent_titles"), m("pdf_page_start").alias("pdf_page_start"), m("printed_page_start").alias("printed_page_start"),
        m("word_count").alias("word_count"), m("text_sha256").alias("text_sha256"), "text",
    )
