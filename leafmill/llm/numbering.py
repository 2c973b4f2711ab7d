"""Gapless numbers inside groups of any size, in DataFrame functions alone.

No group is ever one task: rows are numbered inside each part (a partition of a checkpointed table, so bounded by what one
task reads), parts are counted, and the counts before a part are added up. What meets in one window is a row of a part, or a
row for each part of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .textops import checkpoint, quoted

PART = "_part"


def in_parts(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """The rows, checkpointed, with `_part`: the partition that holds them. With `order`, parts are ranges of that order:
    rows of a lower part stand before those of a higher one. Equal rows may lie in several parts: a place of their own
    parts them, so that a row repeated without end fills no single task."""
    if order is not None:
        rows = checkpoint(df)  # finding the ranges reads the rows once more
        df = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").drop("_tie")
    return checkpoint(df.withColumn(PART, F.spark_partition_id()))


def running(parts: DataFrame, group: str, order: list[Column], sums: dict[str, Column], size: str | None = None) -> DataFrame:
    """Add to rows with `_part` running sums over their group, each row's own value included, and, if asked for, the group's
    number of rows. `order` holds within a part, and over the whole group if parts are ranges of (group, order). A null
    group is a group of its own."""
    own = [PART, "_group"]
    parts = parts.withColumn("_group", F.coalesce(F.concat(F.lit("="), quoted(group).cast("string")), F.lit("")))
    added = {f"_v{i}": v for i, v in enumerate([*sums.values(), F.lit(1)])}
    counts = parts.groupBy(*own).agg(*[F.sum(v).alias(c) for c, v in added.items()])
    # Parts of a hot group are many: first a thousand of them together, then within these.
    counts = counts.withColumn("_block", F.floor(F.col(PART) / 1024))
    blocks = counts.groupBy("_group", "_block").agg(*[F.sum(c).alias(c) for c in added])
    ahead = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before, inside = W.partitionBy("_group").orderBy("_block"), W.partitionBy("_group", "_block").orderBy(PART)
    whole = F.sum(f"_v{len(sums)}").over(W.partitionBy("_group"))
    blocks = blocks.select("_group", "_block", *[ahead(c, before).alias(f"_b{c}") for c in added], whole.alias("_size"))
    starts = counts.select(*own, "_block", *[ahead(c, inside).alias(f"_a{c}") for c in added]).join(blocks, ["_group", "_block"])
    starts = starts.select(*own, *[(F.col(f"_a{c}") + F.col(f"_b{c}")).alias(f"_s{c}") for c in added], "_size")
    here = W.partitionBy(*own).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = parts.withColumns({c: F.sum(v).over(here) for c, v in added.items()}).join(starts, own)
    out = out.withColumns({name: F.col(f"_s_v{i}") + F.col(f"_v{i}") for i, name in enumerate(sums)} | ({size: F.col("_size")} if size else {}))
    return out.drop(*own, "_size", *added, *[f"_s{c}" for c in added])


def numbered(parts: DataFrame, group: str, order: list[Column], number: str, size: str | None = None) -> DataFrame:
    """Add `number` (long, from 0 in each group); ties are numbered in any order. For the rest, see `running`."""
    out = running(parts, group, order, {number: F.lit(1)}, size)
    return out.withColumn(number, F.col(number) - 1)
