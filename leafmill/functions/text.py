"""Line and text expressions. White space is Unicode's, as in the documents' own definition."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profiles import BULLET, BULLETS, CONNECTORS, MODALS

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
#: A character that isn't white space.
TEXT = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
WORD = r"[A-Za-z0-9]+(?:[/-][A-Za-z0-9]+)*"
#: The same for Spark's patterns: one look-up a character, and nothing is tried twice.
SPARK_WORD = r"\p{Alnum}++(?:[/-]\p{Alnum}++)*+"
#: White space but for the plain space, and what breaks lines but for the line feed, as characters: looking for each one goes
#: over bytes, which costs far less than a class of them in a pattern.
ODD_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ODD_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
SENTENCE_BREAK = rf"(?<=[.!?]){SPACE}+(?=[A-Z0-9])"


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it: within lambdas Spark makes an expression again at each mention."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def holds_any(c: Column, characters: str) -> Column:
    """Whether the text holds one of the characters; those beyond ASCII are only looked for in texts that go beyond it."""
    some = lambda xs: reduce(or_, [c.contains(x) for x in xs], F.lit(False))
    return some([x for x in characters if x.isascii()]) | ((F.octet_length(c) != F.length(c)) & some([x for x in characters if not x.isascii()]))


def strip(c: Column) -> Column:
    """Only texts with white space at an end are searched for it."""
    ends = lambda x: F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1))
    return once(c, lambda x: F.when(ends(x).rlike(SPACE), F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")).otherwise(x))


def normalise_line(c: Column) -> Column:
    """Runs of white space to one space, none at the ends. Texts that are so already, nearly all, are only looked at."""
    uneven = c.contains("  ") | c.startswith(" ") | c.endswith(" ") | holds_any(c, ODD_SPACES)
    return F.when(uneven, strip(F.regexp_replace(c, rf"{SPACE}+", " "))).otherwise(c)


def split_lines(c: Column) -> Column:
    """Lines of a text; one empty line at the end doesn't count."""
    text = F.coalesce(c, F.lit(""))
    lines = F.when(holds_any(text, ODD_BREAKS), F.split(text, LINE_BREAK, -1)).otherwise(F.split(text, "\n", -1))
    return once(lines, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def clean_text(c: Column) -> Column:
    """One bullet glyph for all, runs of white space to one space."""
    for glyph in BULLETS[1:-1]:
        c = c if glyph == BULLET else F.replace(c, F.lit(glyph), F.lit(BULLET))
    return once(c, normalise_line)


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(SPARK_WORD), F.lit(0)))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def is_title_line(c: Column) -> Column:
    """Short, without sentence marks, two to twelve words, nearly all capitalised, none that obliges."""
    fits = lambda t: t.rlike("^[A-Z]") | F.lower(t).isin(*CONNECTORS)
    worded = lambda ts: F.size(ts).between(2, 12) & ~F.exists(ts, lambda t: F.lower(t).isin(*MODALS)) & (10 * F.size(F.filter(ts, fits)) >= 8 * F.size(ts))
    short = lambda t: (t != "") & (F.length(t) <= 90) & ~F.lower(t).contains("http")
    looks = lambda t: short(t) & once(F.regexp_extract_all(t, F.lit("[A-Za-z]+"), F.lit(0)), worded)
    return F.coalesce(~c.rlike("[.;:,]") & once(strip(F.regexp_replace(c, BULLETS, "")), looks), F.lit(False))


def is_upper(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")
