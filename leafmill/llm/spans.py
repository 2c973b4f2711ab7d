"""Match positions with DataFrame functions only.

The pieces between the matches (split) and the matches (regexp_extract_all) come from the same leftmost, non-overlapping
search; their running lengths give every start and end in code points. Running values over long arrays are made CHUNK
items at a time, so the time for a text grows with its matches and not with their square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,stop:int,value:string,before:string>>"
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, state: Column, state_type: str, step: Callable, emit: Callable, out_type: str) -> Column:
    """emit(state before the item, item) for each item of an array that isn't empty; step gives the next state."""
    states, outs = F.array().cast(f"array<{state_type}>"), F.array().cast(out_type)

    def chunks(it: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(it) - 1) / CHUNK).cast("int"))
        part = lambda i: F.slice(it, i * CHUNK + 1, CHUNK)
        # The state at each chunk's start, then each chunk by itself.
        begin = F.struct(state.cast(state_type).alias("s"), states.alias("all"))
        more = lambda acc, i: F.struct(F.aggregate(part(i), acc["s"], step).cast(state_type).alias("s"), F.concat(acc["all"], F.array(acc["s"])).alias("all"))
        begins = F.aggregate(numbers, begin, more, lambda acc: acc["all"])
        one = lambda acc, x: F.struct(step(acc["s"], x).cast(state_type).alias("s"), F.concat(acc["out"], F.array(emit(acc["s"], x))).cast(out_type).alias("out"))
        inside = lambda z: F.aggregate(part(z["i"]), F.struct(z["s"].alias("s"), outs.alias("out")), one, lambda acc: acc["out"])
        return F.flatten(F.transform(F.arrays_zip(numbers.alias("i"), begins.alias("s")), inside))

    return let(items, chunks)


def matches(text: Column, pattern: str, guard: Column, context: int = 0) -> Column:
    """Array of (start, stop, value, before): `before` is what stands ahead in the text, `context` code points at most,
    earlier matches included. Texts without a match, and null texts, give an empty array."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value"))
    last = lambda *parts: F.substring(F.concat(*parts), -context, context) if context else F.lit("")

    def step(acc: Column, pair: Column) -> Column:
        return F.struct((acc["at"] + F.length(pair["gap"]) + F.length(pair["value"])).alias("at"), last(acc["tail"], pair["gap"], pair["value"]).alias("tail"))

    def emit(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        return F.struct(start.alias("start"), (start + F.length(pair["value"])).alias("stop"), pair["value"].alias("value"), last(acc["tail"], pair["gap"]).alias("before"))

    spans = running(pairs, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), "struct<at:int,tail:string>", step, emit, SPAN)
    return F.coalesce(F.when(guard & text.rlike(pattern), spans), F.array().cast(SPAN))


def uncovered(spans: Column, others: Column) -> Column:
    """Those of `spans` that share no place with any of `others` (both hold start and stop)."""
    whole = "array<struct<start:int,stop:int,other:boolean,value:string,before:string>>"
    row = lambda x, other: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.lit(other).alias("other"), x["value"].alias("value"), x["before"].alias("before"))
    merged = F.array_sort(F.concat(F.transform(spans, lambda x: row(x, False)).cast(whole), F.transform(others, lambda x: row(x, True)).cast(whole)))
    # Forwards against the farthest stop of the others so far, backwards against the nearest start.
    open_ended, far = F.lit(0), F.lit(2147483647)
    stop = lambda acc, x: F.when(x["other"], F.greatest(acc, x["stop"])).otherwise(acc)
    start = lambda acc, x: F.when(x["other"], F.least(acc, x["start"])).otherwise(acc)
    blocked = lambda x, hit: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), (x["other"] | hit).alias("other"), x["value"].alias("value"), x["before"].alias("before"))
    free = lambda items: F.transform(F.filter(items, lambda x: ~x["other"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"), x["before"].alias("before")))
    # A span that is blocked going forwards becomes one of the others going backwards: it may only block what it overlaps,
    # and spans don't overlap each other.
    forwards = running(merged, open_ended, "int", stop, lambda acc, x: blocked(x, acc > x["start"]), whole)
    backwards = running(F.reverse(forwards), far, "int", start, lambda acc, x: blocked(x, acc < x["stop"]), whole)
    kept = F.when((F.size(spans) > 0) & (F.size(others) > 0), F.reverse(free(backwards))).otherwise(spans)
    return kept.cast(SPAN)


def rendered(spans: Column) -> Column:
    """kind:start:stop of each span, in their order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def of_kind(spans: Column, order: int, kind: str) -> Column:
    """Spans as (order, kind, start, stop, value, before)."""
    return F.transform(spans, lambda s: F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), s["before"].alias("before")))
