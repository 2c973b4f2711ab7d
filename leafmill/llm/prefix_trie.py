"""Prefix trie of conversations: which openings are shared, by how many, and what sharing them saves.

A prefix's digest is the sum of a hash of each of its turns with its place, in two lanes of 60 bits; sums are found by ranges
(see `numbering`), so one very long conversation is many tasks. A count-min sketch of all prefix digests, two rows wide enough
for eight cells a prefix, is made by tasks and merged by blocks of cells; what is broadcast is a bit a cell (seen once, or more often).
An estimate of one proves that a prefix has a single member, and so has all that follows in its conversation: these tails are
emitted where they stand. Only prefixes that may be shared are shuffled, without texts, and grouped exactly: the sketch never
changes a result. Beyond CELLS cells a row the sketch stops growing, and more prefixes are grouped exactly.

Figures over subtrees need no walk from level to level: every node has a representative, its smallest member, and a node's
subtree is what the representatives among its members stand for from its depth on; that is a running sum in each conversation.

Lists of members that end at a node are hashed in pieces: ranges of (node, conversation) give texts of PIECE ids, which the last
task of a node reads one after the other, holding one at a time.

Defined results: rows without a conversation's id belong to none and take no part. Null roles and texts are empty. Turns go by
number, null first; those with one number by the hash of role and text. A turnless conversation is a member of the root alone.
An empty table gives an empty result. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .crc_sql import crc32_sql
from .numbering import in_parts, numbered, running
from .textops import checkpoint, mix64, quoted, table

#: Every FAMILY-th conversation lends its first turns to those after it.
FAMILY, MOST_HEAD = 20, 3
#: Cells of a row of the sketch at most: the bits that are broadcast are two rows of this, 32 MB.
CELLS = 1 << 27
BLOCK = 1 << 16
PIECE = 4096
LANE = 1 << 60
WORD = r"[^\x20\x09-\x0D]+"


def _lanes(text: Column) -> tuple[Column, Column]:
    digest = F.sha2(text, 256)
    return tuple(F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16))


def narrow_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, x and y (hash of role and text), words: all that is shuffled of a turn."""
    role, text = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in ("role", "text"))
    x, y = _lanes(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return turns.where("conv_id is not null").select("conv_id", "turn", x.alias("x"), y.alias("y"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of their family's first: turns (conv_id, depth from 1, x, y, words) and
    lengths (conv_id, length, also of turnless ones)."""
    by = [F.col(c) for c in ("conv_id", "turn", "x", "y")]
    own = checkpoint(numbered(in_parts(narrow_turns(turns), by), "conv_id", by[1:], "rank", "size"))
    head = F.crc32(F.col("conv_id").cast("string")) % (MOST_HEAD + 1)
    convs = own.where("rank = 0").select("conv_id", "size", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    firsts = convs.where("conv_id = base").select("base", F.col("size").alias("base_size"))
    convs = convs.join(firsts, "base", "left").withColumn("lent", F.least("head", F.coalesce("base_size", F.lit(0))))
    convs = checkpoint(convs.select("conv_id", "base", "head", "lent", (F.col("lent") + F.greatest(F.col("size") - F.col("head"), F.lit(0))).alias("length")))
    # Few turns each, for at most two families of conversations.
    heads = own.where(f"conv_id % {FAMILY} = 0 and rank < {MOST_HEAD}").select(F.col("conv_id").alias("base"), "rank", "x", "y", "words")
    lent = convs.join(heads, "base").where("rank < head").select("conv_id", (F.col("rank") + 1).alias("depth"), "x", "y", "words")
    rest = own.join(convs, "conv_id").where("rank >= head").select("conv_id", (F.col("lent") + F.col("rank") - F.col("head") + 1).alias("depth"), "x", "y", "words")
    return lent.union(rest), convs.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, a and b (digest), pa and pb (its parent's), words: a row for each turn."""
    x, y = _lanes(F.concat_ws(":", "depth", "x", "y"))
    placed = turns.select("conv_id", "depth", x.alias("x"), y.alias("y"), "words")
    sums = {"a": F.col("x").cast("decimal(20,0)"), "b": F.col("y").cast("decimal(20,0)")}
    found = running(in_parts(placed, [F.col("conv_id"), F.col("depth")]), "conv_id", [F.col("depth")], sums)
    lane = lambda c: F.pmod(c, F.lit(LANE).cast("decimal(20,0)")).cast("long")
    return found.select("conv_id", "depth", lane(F.col("a")).alias("a"), lane(F.col("b")).alias("b"), lane(F.col("a") - F.col("x")).alias("pa"), lane(F.col("b") - F.col("y")).alias("pb"), "words")


def _cells(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Cell of each digest in both rows of the sketch; the second row's come after the first's."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    return np.stack([mix64(a ^ mix64(b)) & np.uint64(width - 1), (mix64(b ^ mix64(a + np.uint64(1))) & np.uint64(width - 1)) + np.uint64(width)]).astype(np.int64)


def repeated_cells(found: DataFrame, width: int) -> np.ndarray:
    """A bit for each cell of the sketch over (a, b): more than one digest was counted there. At most 2 x CELLS bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [_cells(x.column("a").to_numpy(), x.column("b").to_numpy(), width).ravel() for x in batches if x.num_rows]
        if not cells:
            return
        cell, n = np.unique(np.concatenate(cells), return_counts=True)
        cuts = np.flatnonzero(np.diff(cell // BLOCK)) + 1
        for one, many in zip(np.split(cell, cuts), np.split(n, cuts), strict=True):
            place = (one % BLOCK).astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array([int(one[0] // BLOCK)]), pa.array([place[many == 1].tobytes()]), pa.array([place[many > 1].tobytes()])], names=["block", "once", "more"])

    def merged(rows: pa.Table) -> pa.Table:
        n = np.zeros(BLOCK, np.int64)
        for once, more in zip(rows.column("once").to_pylist(), rows.column("more").to_pylist(), strict=True):
            n[np.frombuffer(once, "<u2")] += 1
            n[np.frombuffer(more, "<u2")] += 2
        return pa.table({"block": rows.column("block")[:1], "bits": [np.packbits(n > 1).tobytes()]})

    blocks = found.select("a", "b").mapInArrow(count, "block long, once binary, more binary").groupBy("block").applyInArrow(merged, "block long, bits binary")
    out = np.zeros(max(2 * width // BLOCK, 1) * BLOCK // 8, np.uint8)
    for block, bits in blocks.collect():
        out[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(bits, np.uint8)
    return out


def screened(found: DataFrame, most_cells: int = CELLS) -> DataFrame:
    """Add `since` to prefixes: the depth from which on their conversation is proven alone, null where it isn't yet."""
    width, rows = min(BLOCK, most_cells), found.count()
    while width < min(8 * rows, most_cells):
        width *= 2
    shared = found.sparkSession.sparkContext.broadcast(repeated_cells(found, width))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, last, since, whole = None, 0, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = _cells(batch.column("a").to_numpy(), batch.column("b").to_numpy(), width)
            maybe = ((shared.value[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(axis=0)
            marks, opens = [], []
            for c, d, m in zip(batch.column("conv_id").to_pylist(), batch.column("depth").to_pylist(), maybe.tolist(), strict=True):
                if c != conv:
                    conv, last, since, whole = c, 0, None, True
                whole, last = whole and d == last + 1, d
                if since is None and not m:
                    since = d
                marks.append(since)
                opens.append(not whole)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64()), pa.array(opens)], names=[*batch.schema.names, "since", "open"])

    schema = found.schema.add("since", "long").add("open", "boolean")
    out = checkpoint(found.sortWithinPartitions("conv_id", "depth").mapInArrow(screen, schema))
    # Conversations that lie in several parts, at most one a part: what was found in one holds in the later ones.
    cut = checkpoint(out.where("open").select("conv_id").distinct())
    known = out.join(cut, "conv_id", "left_semi").groupBy("conv_id").agg(F.min("since").alias("_since"))
    out = out.join(known, "conv_id", "left") if not cut.isEmpty() else out.withColumn("_since", F.lit(None).cast("long"))
    first = F.least("since", F.when(F.col("_since") <= F.col("depth"), F.col("_since")))
    return out.withColumn("since", first).drop("open", "_since")


def hashed_ends(ends: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256 from (depth, a, b, conv_id): the ids of each node, ascending and joined by commas."""
    keys = ["depth", "a", "b"]
    parts = in_parts(ends.select(*keys, "conv_id"), [F.col(c) for c in (*keys, "conv_id")]).sortWithinPartitions(*keys, "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node: tuple | None = None
        ids: list[str] = []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (*node, int(ids[0]))] + [pa.array([",".join(ids)])], names=[*keys, "first", "ids"])

        for batch in batches:
            for *key, c in zip(*[batch.column(n).to_pylist() for n in (*keys, "conv_id")], strict=True):
                if ids and (tuple(key) != node or len(ids) == PIECE):
                    yield row()
                    ids = []
                node = tuple(key)
                ids.append(str(c))
        if ids:
            yield row()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*[batch.column(n).to_pylist() for n in (*keys, "ids")], strict=True):
                if tuple(key) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = tuple(key), hashlib.sha256(ids.encode())
            if out:
                yield _rows(out)
        if node is not None:
            yield _rows([(*node, state.hexdigest())])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], names=[*keys, "ends_sha256"])

    cut = parts.mapInArrow(pieces, "depth long, a long, b long, first long, ids string")
    return cut.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame, most_cells: int = CELLS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    turns: conv_id, depth (1, 2, ... in each conversation), x, y (hash of the turn), words; lengths: conv_id, length, of all
    conversations. most_cells: the widest row of the sketch, a power of two."""
    key, parent = ["depth", "a", "b"], [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    ended = lengths.select("conv_id", F.col("length").alias("_length"))
    marked = screened(checkpoint(prefixes(turns)), most_cells).join(ended, "conv_id").withColumn("last", F.col("depth") == F.col("_length")).drop("_length")
    marked = checkpoint(marked)
    zero = F.lit(0).cast("long")
    root = lengths.select("conv_id", *[zero.alias(c) for c in ("depth", "a", "b", "pa", "pb", "words")], (F.col("length") == 0).alias("last"))
    shared = marked.where("since is null").select(root.columns).union(root)  # what may be shared, and the root
    tails = marked.where("since is not null")
    tops = tails.where("depth = since")

    nodes = checkpoint(shared.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("words").alias("words")))
    below = nodes.where("depth > 0").select(*parent).union(tops.select(*parent)).groupBy(*key).agg(F.count("*").alias("n_children"))
    nodes = checkpoint(nodes.join(below, key, "left").withColumn("n_children", F.coalesce("n_children", zero)))

    # What each representative stands for, and the nodes that it lies in: added up from the end of its conversation.
    stands = nodes.select("conv_id", *key, ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"), F.lit(1).alias("stands"))
    stands = stands.union(tops.select("conv_id", *key, zero, F.lit(1).cast("long"), F.lit(1)))
    rows = stands.union(shared.select("conv_id", *key, zero, zero, F.lit(0)))
    order = [F.col("conv_id"), F.desc("depth"), F.desc("stands")]
    added = running(in_parts(rows, order), "conv_id", order[1:], {"saved": F.col("saved"), "leaves": F.col("leaves")}).where("stands = 0")
    totals = added.groupBy(*key).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    of = nodes.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("conv_id").alias("parent_conv_id"))
    under = lambda d: d.join(of, (d["depth"] - 1 == of["_depth"]) & (d["pa"] == of["_a"]) & (d["pb"] == of["_b"])).drop("_depth", "_a", "_b")
    smallest = nodes.where("depth = 0").select("conv_id").first()
    first = F.lit(smallest.conv_id if smallest else None).cast("long")
    # Under the root the parent is known; so the join has no key that all conversations share.
    named = lambda d: under(d.where("depth > 1")).unionByName(d.where("depth = 1").withColumn("parent_conv_id", first))
    with_parents = named(nodes).unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))

    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = with_parents.join(totals, key).join(hashed_ends(shared.where("last")), key, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
    alone = lambda d: d.select(
        "conv_id", "depth", "parent_conv_id", F.lit(1).cast("long").alias("n_convs"), F.when(F.col("last"), zero).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        zero.alias("saved_tokens"), F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256"),
    )
    return out.union(alone(named(tops))).union(alone(tails.where("depth > since").withColumn("parent_conv_id", F.col("conv_id"))))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(table(spark, sf_dir, "conversations")))


ORACLE_SQL = f"""with t as (select conv_id c, row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 r,
  sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) unit, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) words from conversations where conv_id is not null),
sizes as (select c, count(*) n, {crc32_sql('c::varchar')} % {MOST_HEAD + 1} h, c - c % {FAMILY} base from t group by c),
convs as (select s.*, least(s.h, coalesce(b.n, 0)) lent from sizes s left join sizes b on b.c = s.base),
re as (select c, lent + r - h as pos, unit, words from t join convs using (c) where r >= h union all select v.c, r, unit, words from convs v join t on t.c = v.base where r < v.h),
pre as (select c, pos + 1 as depth, string_agg(unit, '') over (partition by c order by pos) k, words, pos + 1 = max(pos + 1) over (partition by c) last from re
  union all select v.c, 0, '', 0, not exists (select 1 from re where re.c = v.c) from convs v),
nodes as (select k, depth, min(c) conv_id, count(*) n_convs, max(words) words, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (last), '')) ends_sha256 from pre group by 1, 2),
kids as (select left(k, length(k) - 64) k, count(*) n_children from nodes where depth > 0 group by 1),
full_nodes as (select n.*, coalesce(n_children, 0) n_children from nodes n left join kids using (k)),
sums as (select p.k, sum((y.n_convs - 1) * y.words)::bigint saved_tokens, count(*) filter (y.n_children = 0) n_leaves from full_nodes y join pre p on p.c = y.conv_id and p.depth <= y.depth group by 1)
select n.conv_id, n.depth::bigint as depth, p.conv_id parent_conv_id, n.n_convs, n.n_children::bigint n_children, n_leaves, saved_tokens, n.ends_sha256
from full_nodes n join sums using (k) left join nodes p on n.depth > 0 and p.k = left(n.k, length(n.k) - 64)"""
