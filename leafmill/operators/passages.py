"""From structural chunks to size-bounded passages and records (R21-R28). All inside a chunk's own row: nothing is shuffled.

Counting words is additive over parts joined by spaces, so packing is a fold over whole numbers. A fold copies the list that it
adds to; `folded` folds block by block, so a chunk costs in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import SENTENCE_BREAK, clean_text, is_title_line, once, strip, word_count
from ..profiles import BULLET, BULLETS, HARD_MAX_WORDS, HEADING_WORDS, TARGET_WORDS, Profile, STANDARD

_WORD_CUT = rf"(?:^[^A-Za-z0-9]*+)?(?:[A-Za-z0-9]++(?:[/-][A-Za-z0-9]++)*+[^A-Za-z0-9]*+){{1,{TARGET_WORDS}}}"
_STRUCT = "struct<text:string,words:int,kind:string>"
_ITEM = f"array<{_STRUCT}>"


#: Items of a block of a fold.
BLOCK_ITEMS = 128


def folded(items: Column, kind: str, state: dict[str, Column], step: Callable[[Column, Column], Column], finish: Callable[[Column], Column]) -> Column:
    """A fold over `items` that makes a list of `kind`. States are structs of the list `done` and the fields of `state`; `finish`
    gives the list from the last one. Each block of items adds to a list of its own; the lists are put together at the end."""
    none = F.array().cast(f"array<{kind}>").alias("done")
    last_block = F.greatest(F.ceil(F.size(items) / BLOCK_ITEMS).cast("int") - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last_block), lambda b: F.slice(items, b * BLOCK_ITEMS + 1, BLOCK_ITEMS))
    start = F.struct(F.array().cast(f"array<array<{kind}>>").alias("lists"), F.struct(none, *[v.alias(n) for n, v in state.items()]).alias("last"))

    def block_step(acc: Column, block: Column) -> Column:
        opened = F.struct(none, *[acc["last"][n].alias(n) for n in state])
        return F.struct(F.concat(acc["lists"], F.array(acc["last"]["done"])).alias("lists"), F.aggregate(block, opened, step).alias("last"))

    return F.aggregate(blocks, start, block_step, lambda acc: F.flatten(F.concat(acc["lists"], F.array(finish(acc["last"])))))


def chunk_text(lines: Column) -> Column:
    """A chunk's text on one line."""
    return clean_text(F.array_join(lines["line"], " "))


def sized(chunks: DataFrame) -> DataFrame:
    """Add `words`. The figure stands in a row of its own, so that a filter on it doesn't count once more."""
    return chunks.select("*", F.explode_outer(F.array(word_count(chunk_text(F.col("lines"))))).alias("words"))


def _fragments(x: Column, enumerated: str) -> Column:
    """What a line adds to the units: parts as (text, starts a unit, kind it sets)."""
    part = lambda text, starts, kind: F.struct(text.alias("text"), F.lit(starts).alias("starts"), F.lit(kind).cast("string").alias("kind"))
    line = x["line"]
    bullets = lambda pieces: F.transform(F.filter(F.slice(pieces, 2, F.size(pieces)), lambda p: p != ""), lambda p: part(F.concat(F.lit(BULLET + " "), p), True, "bullet_item"))
    cut = lambda pieces: F.concat(F.array(part(F.get(pieces, F.lit(0)), False, None), part(F.lit(""), True, None)), bullets(pieces))
    with_bullets = once(F.transform(F.split(line, BULLETS, -1), strip), cut)
    plain = F.when(line.rlike(enumerated), F.array(part(line, True, "enumerated_item"))).when(is_title_line(line), F.array(part(line, True, "internal_heading"))).otherwise(F.array(part(line, False, None)))
    own = F.when(line.rlike(BULLETS), with_bullets).otherwise(plain)
    return F.when(x["blank_before"], F.concat(F.array(part(F.lit(""), True, "paragraph")), own)).otherwise(own)


def semantic_units(chunks: DataFrame, profile: Profile = STANDARD) -> DataFrame:
    """Add `units`: array of (text, words, kind). A fragment that starts a unit closes the one before; others go on in the
    open unit, whatever its kind."""
    d = chunks.withColumn("_parts", F.flatten(F.transform("lines", lambda x: _fragments(x, profile.enumerated))))
    starts = F.concat(F.array(F.lit(0)), F.array_compact(F.transform("_parts", lambda p, i: F.when(p["starts"], i))))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size("_parts")))
    set_by = F.transform(F.filter("_parts", lambda p: p["starts"]), lambda p: p["kind"])
    add = lambda acc, kind: F.struct(F.concat(acc["done"], F.array(F.coalesce(kind, acc["kind"]))).alias("done"), F.coalesce(kind, acc["kind"]).alias("kind"))
    kinds = F.concat(F.array(F.lit("paragraph")), folded(set_by, "string", {"kind": F.lit("paragraph")}, add, lambda acc: acc["done"]))
    spans = F.arrays_zip(starts.alias("at"), ends.alias("to"), kinds.alias("kind"))
    own = lambda u: F.filter(F.transform(F.slice("_parts", u["at"] + 1, u["to"] - u["at"]), lambda p: p["text"]), lambda t: t != "")
    d = d.withColumn("_spans", F.when(F.col("_parts").isNotNull(), spans)).withColumn("_units", F.transform("_spans", lambda u: F.struct(own(u).alias("texts"), u["kind"].alias("kind"))))
    d = d.withColumn("_units", F.transform("_units", lambda u: F.struct(clean_text(F.array_join(u["texts"], " ")).alias("text"), u["kind"].alias("kind"))))
    d = d.withColumn("units", F.transform(F.filter("_units", lambda u: u["text"] != ""), lambda u: F.struct(u["text"].alias("text"), word_count(u["text"]).alias("words"), u["kind"].alias("kind"))))
    return d.drop("_parts", "_spans", "_units")


def merge_leading_heading(units: Column) -> Column:
    """A short heading at the start joins the next unit, which keeps its kind."""
    first, second = F.get(units, F.lit(0)), F.get(units, F.lit(1))
    joined = F.struct(F.concat_ws(" ", first["text"], second["text"]).alias("text"), (first["words"] + second["words"]).alias("words"), second["kind"].alias("kind"))
    merges = (F.size(units) > 1) & (first["kind"] == "internal_heading") & (first["words"] <= HEADING_WORDS)
    return F.when(merges, F.concat(F.array(joined), F.slice(units, 3, F.greatest(F.size(units), F.lit(1))))).otherwise(units)


def packed(items: Column, joins: str, name: str) -> Column:
    """Pack neighbouring items of kind `joins` while their words stay within the target; others stand alone.

    items: array of (text, words, kind); gives the same, with packs named `name`."""
    closed = lambda acc: F.when(acc["kind"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["text"].alias("text"), acc["words"].alias("words"), acc["kind"].alias("kind")))))

    def step(acc: Column, x: Column) -> Column:
        goes_on = F.coalesce((x["kind"] == joins) & (acc["kind"] == name) & (acc["words"] + x["words"] <= TARGET_WORDS), F.lit(False))
        return F.struct(
            F.when(goes_on, acc["done"]).otherwise(closed(acc)).alias("done"),
            F.when(goes_on, F.concat_ws(" ", acc["text"], x["text"])).otherwise(x["text"]).alias("text"),
            (x["words"] + F.when(goes_on, acc["words"]).otherwise(0)).alias("words"),
            F.when(x["kind"] == joins, name).otherwise(x["kind"]).alias("kind"),
        )

    return F.when(items.isNotNull(), folded(items, _STRUCT, {"text": F.lit(""), "words": F.lit(0), "kind": F.lit(None).cast("string")}, step, closed))


def sentence_items(text: Column, profile: Profile = STANDARD) -> Column:
    """Sentences of a text as items; ones beyond the hard limit are cut at every 220th word, losing no characters."""
    sentences = F.filter(F.transform(F.split(text, SENTENCE_BREAK, -1), strip), lambda s: s != "")
    item = lambda s, kind: F.struct(s.alias("text"), word_count(s).alias("words"), F.lit(kind).alias("kind"))
    if not profile.word_cut:
        return F.transform(sentences, lambda s: item(s, "sentence"))
    cut = lambda s: F.transform(F.regexp_extract_all(s, F.lit(_WORD_CUT), F.lit(0)), lambda p: item(strip(p), "word_boundary"))
    return F.flatten(F.transform(sentences, lambda s: F.when(word_count(s) > HARD_MAX_WORDS, cut(s)).otherwise(F.array(item(s, "sentence")))))


def split_to_target(items: DataFrame, profile: Profile = STANDARD) -> DataFrame:
    """items: columns text, words, kind and others; adds `pieces`: as it is, marked for review, or split by sentences and words."""
    large = F.col("words") > TARGET_WORDS
    d = items.withColumn("_sentences", F.when(large, sentence_items(F.col("text"), profile)))
    one = lambda kind: F.array(F.struct("text", "words", kind.alias("kind")))
    lone = (F.size("_sentences") <= 1) & ((F.col("words") <= HARD_MAX_WORDS) | F.lit(not profile.word_cut))
    split = packed(F.col("_sentences"), "sentence", "sentence_boundary")
    return d.withColumn("pieces", F.when(~large, one(F.col("kind"))).when(lone, one(F.concat("kind", F.lit("_needs_review")))).otherwise(split)).drop("_sentences")


def retrieval_pieces(chunks: DataFrame, profile: Profile = STANDARD) -> DataFrame:
    """One row a piece: the chunk's columns, piece (text, words, kind = split method), part_number and part_count.

    The steps stand in rows of their own, still within the chunk's partition. No list is ever empty, and the outer form of
    explode says so: with the plain one, Spark would make each list once more to filter out empty ones."""
    d = chunks.withColumnRenamed("kind", "source_kind").withColumn("_text", chunk_text(F.col("lines"))).withColumn("_words", word_count(F.col("_text")))
    d = d.withColumn("lines", F.when(F.col("_words") > TARGET_WORDS, F.col("lines")))  # only large chunks are looked at line by line
    d = semantic_units(d, profile)
    d = d.withColumn("units", merge_leading_heading(F.coalesce("units", F.array().cast(_ITEM))))
    whole = lambda kind: F.array(F.struct(F.col("_text").alias("text"), F.col("_words").alias("words"), F.lit(kind).alias("kind")))
    packs = F.when(F.col("_words") <= TARGET_WORDS, whole("unchanged")).when(F.size("units") > 0, packed(F.col("units"), "paragraph", "paragraph_group")).otherwise(whole("sentence_boundary"))
    d = d.withColumn("_packs", packs).drop("lines", "units", "_text", "_words")
    d = d.select("*", F.posexplode_outer("_packs").alias("_pack", "_item")).drop("_packs").select("*", "_item.*").drop("_item")
    d = split_to_target(d, profile).drop("text", "words", "kind")
    d = d.select("*", F.posexplode_outer("pieces").alias("_piece", "piece")).drop("pieces")
    own = W.partitionBy("document", "seg")
    return d.withColumn("part_number", F.row_number().over(own.orderBy("_pack", "_piece"))).withColumn("part_count", F.count("*").over(own).cast("int")).drop("_pack", "_piece")


METADATA = (
    "document", "version", "language", "section", "parent_titles", "parent_chunk_id", "source_kind", "split_method", "part_number",
    "part_count", "pdf_page_start", "printed_page_start", "word_count", "text_sha256", "source_file",
)


def record_text(section: Column, parents: Column, body: Column) -> Column:
    return F.concat(F.lit("Section: "), section, F.lit("\nParent sections: "), F.array_join(parents, " > "), F.lit("\nText: "), body)


def records(chunks: DataFrame, profile: Profile = STANDARD, place: bool = False) -> DataFrame:
    """id, text and metadata of every passage. chunks: structural chunks with `lines`. place: with `seg`, the chunk's place
    in its document."""
    parts = retrieval_pieces(chunks, profile)
    text = record_text(F.col("section"), F.col("parent_titles"), F.col("piece.text")) if profile.context_text else F.col("piece.text")
    d = parts.withColumn("text", text)
    values = {
        "document": F.col("document").cast("string"),
        "version": F.lit(profile.version),
        "language": F.lit(profile.language),
        "section": F.col("section"),
        "parent_titles": F.array_join("parent_titles", " > "),
        "parent_chunk_id": F.col("id"),
        "source_kind": F.col("source_kind"),
        "split_method": F.col("piece.kind"),
        "part_number": F.col("part_number"),
        "part_count": F.col("part_count"),
        "pdf_page_start": F.col("pdf_page_start").cast("int"),
        "printed_page_start": F.coalesce("printed_page_start", F.lit("")),
        "word_count": F.col("piece.words"),
        "text_sha256": F.sha2("text", 256),
        "source_file": F.lit(profile.source_file),
    }
    return d.select(F.format_string("%s-part-%02d", "id", "part_number").alias("id"), "text", F.struct(*[values[k].alias(k) for k in METADATA]).alias("metadata"), *(["seg"] if place else []))


RECORD_SCHEMA = (
    "id string, text string, metadata struct<document:string,version:string,language:string,section:string,parent_titles:string,parent_chunk_id:string,"
    "source_kind:string,split_method:string,part_number:int,part_count:int,pdf_page_start:int,printed_page_start:string,word_count:int,text_sha256:string,source_file:string>"
)
