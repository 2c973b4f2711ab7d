"""Merkle manifest of a dataset, with a version of the tree for every tampered leaf.

Every row becomes a leaf: a hash of its columns, each with its length. The leaves of a group stand in order; runs of FANOUT
become their parent's hash until one node remains, the group's subroot; the subroots make a tree of their own up to the root.

Trees are cut into aligned blocks of FANOUT ** LEVELS nodes. A block is one small group in Spark: its subtree is built there,
and only its top goes on, as a node of the next block up, so each pass deals with a 4096th of the nodes before it. On the way
back each block gets the path of its top to the root (the siblings on the left and right, level by level: a few KB), and then
knows the whole path of each of its leaves.

Versions are persistent: a tampered leaf makes a version of its block's tree that copies the leaf and its ancestors and
shares every other node with the untouched tree; above the block the version goes on along the path, in the task that holds
it, again copying ancestors only. No version is a copy of a tree, and none gathers others.

Leaves are put in order by ranges (see `numbering`), so a group that holds most rows is many tasks. Only hashes and ids are
shuffled, never texts.

Defined results: each null value is `-`. A null group is a group of its own, the first. Rows with one id stand in the order of
their leaves; equal rows are leaves each. A row without an id is never tampered with. A lone leaf is its group's
subroot and a lone group's subroot is the root. An empty table gives an empty result. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .crc_sql import crc32_sql
from .numbering import in_parts, numbered
from .textops import checkpoint, quoted, table

FANOUT = 8
#: Levels inside a block of at most FANOUT ** LEVELS nodes.
LEVELS = 4
BLOCK = FANOUT**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "path array<struct<left:string,right:string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(*values: Column) -> Column:
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(v.cast("string")) for v in values]), 256)


class Tree:
    """The nodes of a block, untouched and copied, each with its hash and its children's numbers."""

    def __init__(self, leaves: list[str], levels: int) -> None:
        self.hashes: list[str] = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        row = list(range(len(leaves)))
        for _ in range(levels):
            row = [self._node(tuple(row[i : i + FANOUT])) for i in range(0, len(row), FANOUT)]
        self.levels = levels
        (self.root,) = row

    def _node(self, children: tuple[int, ...]) -> int:
        self.hashes.append(digest(*[self.hashes[c] for c in children]))
        self.children.append(children)
        return len(self.hashes) - 1

    def way(self, at: int) -> list[tuple[int, int]]:
        """From the root down to leaf `at`: each ancestor and which child comes next."""
        node, out = self.root, []
        for level in reversed(range(self.levels)):
            turn = at // FANOUT**level % FANOUT
            out.append((node, turn))
            node = self.children[node][turn]
        return out

    def changed(self, at: int, leaf: str) -> int:
        """The root of a version in which leaf `at` is another: it and its ancestors are new nodes, all others are shared."""
        self.hashes.append(leaf)
        self.children.append(())
        new = len(self.hashes) - 1
        for node, turn in reversed(self.way(at)):
            old = self.children[node]
            new = self._node((*old[:turn], new, *old[turn + 1 :]))
        return new

    def path(self, at: int) -> list[dict[str, str]]:
        """The siblings of leaf `at` and of its ancestors, from the bottom up."""
        out = []
        for node, turn in reversed(self.way(at)):
            run = [self.hashes[c] for c in self.children[node]]
            out.append({"left": "".join(run[:turn]), "right": "".join(run[turn + 1 :])})
        return out


def climbed(top: str, path: list[dict[str, str]]) -> str:
    """What a block's top becomes along its path: one copied ancestor a level."""
    for step in path:
        top = digest(step["left"], top, step["right"])
    return top


def levels_of(total: int) -> int:
    """Levels of a block in a tree whose level holds `total` nodes: as many as are left, LEVELS at most."""
    out = 0
    while total > 1 and out < LEVELS:
        total, out = -(-total // FANOUT), out + 1
    return out


def _block_tops(nodes: DataFrame) -> DataFrame:
    """grp, rank, total, hash of the tops of all blocks."""

    def top(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        total = rows.column("total")[0].as_py()
        tree = Tree(rows.column("hash").to_pylist(), levels_of(total))
        return pa.table({"grp": rows.column("grp")[:1], "rank": rows.column("block")[:1], "total": [-(-total // BLOCK)], "hash": [tree.hashes[tree.root]]})

    blocks = nodes.select("grp", F.floor(F.col("rank") / BLOCK).alias("block"), "rank", "total", "hash")
    return blocks.groupBy("grp", "block").applyInArrow(top, "grp string, rank long, total long, hash string")


def _node_paths(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """grp, rank, path to the root of each node; tops: grp, rank and path of their blocks."""

    def paths(rows: pa.Table, above: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"grp": pa.array([], pa.string()), "rank": pa.array([], pa.int64()), "path": pa.array([], above.schema.field("path").type)})
        rows = rows.sort_by("rank")
        tree = Tree(rows.column("hash").to_pylist(), levels_of(rows.column("total")[0].as_py()))
        up = above.column("path")[0].as_py()
        return pa.table({"grp": rows.column("grp"), "rank": rows.column("rank"), "path": pa.array([tree.path(i) + up for i in range(rows.num_rows)], above.schema.field("path").type)})

    blocks = nodes.select("grp", F.floor(F.col("rank") / BLOCK).alias("block"), "rank", "total", "hash")
    above = tops.select(F.col("grp").alias("of"), F.col("rank").alias("block"), "path")
    return blocks.groupBy("grp", "block").cogroup(above.groupBy("of", "block")).applyInArrow(paths, f"grp string, rank long, {_PATH}")


@dataclass
class Manifest:
    """subroots: grp, hash, path to the root; blocks: grp, rank, path and subroot of every block of leaves; root: hash of the whole.
    leaves: grp (the group with `=` ahead, empty for null), rank, total, hash, and the columns they came with."""

    leaves: DataFrame
    blocks: DataFrame
    subroots: DataFrame
    root: str | None


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of blocks of each group's tree, leaves first, and the subroots: grp, hash."""
    levels, done = [nodes], None
    while True:
        tops = checkpoint(_block_tops(levels[-1]))
        ended = tops.where("total = 1").select("grp", "hash")
        done = ended if done is None else done.union(ended)
        rest = tops.where("total > 1")
        if rest.isEmpty():
            return levels, checkpoint(done)
        levels.append(rest)


def _descend(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """grp, rank and path of the blocks of the lowest level. ends: grp and path of each subroot."""
    found = None
    for nodes in reversed(levels):
        # A group with one block at this level has its subroot for a top.
        last = nodes.where(F.col("total") <= BLOCK).select("grp").distinct().join(ends, "grp").select("grp", F.lit(0).cast("long").alias("rank"), "path")
        tops = last if found is None else found.unionByName(last)
        if nodes is levels[0]:
            return checkpoint(tops)
        found = checkpoint(_node_paths(nodes, tops))
    raise AssertionError("no levels")


def build(rows: DataFrame, group: str, order: list[str]) -> Manifest:
    """The manifest of `rows`, which hold the group, the columns of the order, `hash` (the leaf) and others."""
    name = F.coalesce(F.concat(F.lit("="), quoted(group).cast("string")), F.lit(""))
    by = [F.col("grp"), *[quoted(c) for c in order], F.col("hash")]
    leaves = checkpoint(numbered(in_parts(rows.withColumn("grp", name), by), "grp", by[1:], "rank", "total"))
    if leaves.isEmpty():
        none = rows.sparkSession.createDataFrame([], f"grp string, rank long, hash string, {_PATH}")
        return Manifest(leaves, none.withColumnRenamed("hash", "subroot"), none.drop("rank"), None)
    levels, subroots = _climb(leaves.select("grp", "rank", "total", "hash"))
    # The subroots are the leaves of one more tree.
    upper = numbered(in_parts(subroots.select(F.col("grp").alias("own"), F.lit("").alias("grp"), "hash"), [F.col("own")]), "grp", [F.col("own")], "rank", "total")
    upper = checkpoint(upper)
    tree, top = _climb(upper.select("grp", "rank", "total", "hash"))
    end = top.select("grp", F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    ends = checkpoint(_node_paths(upper.select("grp", "rank", "total", "hash"), _descend(tree, end)))
    subroots = checkpoint(upper.drop("grp").join(ends, "rank").select(F.col("own").alias("grp"), "hash", "path"))
    blocks = _descend(levels, subroots.select("grp", "path")).join(subroots.select("grp", F.col("hash").alias("subroot")), "grp")
    return Manifest(leaves, checkpoint(blocks), subroots, top.first()["hash"])


def versions(m: Manifest, changed: str, carry: list[str]) -> DataFrame:
    """For every leaf: the columns in `carry`, grp, hash, subroot, proof_sha256, folded_root and copied. `changed` names the column of
    the tampered leaf (null: untampered). folded_root is the root of the leaf's own version, which has `copied` new nodes; an
    untampered leaf's is that of the version without changes, made anew from the leaves."""
    fields = m.leaves.select("grp", "rank", "total", "hash", changed, *carry)
    blocks = fields.withColumn("block", F.floor(F.col("rank") / BLOCK))
    schema = "grp string, hash string, subroot string, proof_sha256 string, folded_root string, copied int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.select(*carry).schema)

    def folded(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        tree = Tree(rows.column("hash").to_pylist(), levels_of(rows.column("total")[0].as_py()))
        up = above.column("path")[0].as_py()
        rest = "".join(x["left"] + x["right"] for x in up)
        whole = climbed(tree.hashes[tree.root], up)
        proofs, roots, copied = [], [], []
        for at, new in enumerate(rows.column(changed).to_pylist()):
            proofs.append(digest(*[x["left"] + x["right"] for x in tree.path(at)], rest))
            if new is None:
                roots.append(whole)
                copied.append(0)
            else:
                before = len(tree.hashes)
                version = tree.changed(at, new)
                roots.append(climbed(tree.hashes[version], up))
                copied.append(len(tree.hashes) - before + len(up))
        made = {"grp": rows.column("grp"), "hash": rows.column("hash"), "subroot": pa.array(above.column("subroot").to_pylist() * rows.num_rows), "proof_sha256": pa.array(proofs), "folded_root": pa.array(roots), "copied": pa.array(copied, pa.int32())}
        return pa.table(made | {c: rows.column(c) for c in carry})

    above = m.blocks.select(F.col("grp").alias("of"), F.col("rank").alias("block"), "path", "subroot")
    return blocks.groupBy("grp", "block").cogroup(above.groupBy("of", "block")).applyInArrow(folded, schema)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    value = {c: quoted(c) for c in COLUMNS}
    lowered = F.translate(value["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(value["doc_id"].cast("string")) % 3 == 0  # null for a null id
    leaves = docs.select("doc_id", "lang", leaf_hash(*value.values()).alias("hash"), F.when(hit, leaf_hash(*(value | {"text": lowered}).values())).alias("tampered"))
    m = build(leaves, "lang", ["doc_id"])
    out = versions(m, "tampered", ["doc_id"])
    root = F.lit(m.root).cast("string")
    return out.select("doc_id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def _levels_sql(name: str, group: str, most: int) -> str:
    """Common tables `name`0 .. `name``most` of (grp, pos, n, h): the levels of each group's tree, from `name`0."""
    out = []
    for k in range(most):
        out.append(
            f"{name}{k + 1} as (select grp, pos // {FANOUT} pos, (n + {FANOUT - 1}) // {FANOUT} n, sha256(string_agg(h, '' order by pos)) h from {name}{k} where n > 1 group by grp, pos // {FANOUT}, n)"
        )
    return ",\n".join(out)


def _siblings_sql(name: str, k: int) -> str:
    """Siblings of each node of level k, and the hash around it when it changes."""
    run = f"(partition by grp, pos // {FANOUT} order by pos rows between unbounded preceding and {{}})"
    return (
        f"{name}s{k} as (select grp, pos, n, coalesce(string_agg(h, '') over {run.format('1 preceding')}, '') l, "
        f"coalesce(string_agg(h, '') over (partition by grp, pos // {FANOUT} order by pos rows between 1 following and unbounded following), '') r from {name}{k} where n > 1)"
    )


def _folded_sql(name: str, source: str, k: int) -> str:
    """One more level of the proofs and folds of all rows: (row, grp, pos, proof, fold)."""
    return (
        f"{name}f{k + 1} as (select f.row, f.grp, f.pos // {FANOUT} pos, f.proof || coalesce(s.l || s.r, '') proof, case when s.pos is null then f.fold else sha256(s.l || f.fold || s.r) end fold "
        f"from {source} f left join {name}s{k} s on s.grp is not distinct from f.grp and s.pos = f.pos)"
    )


def _oracle(most: int = 7, groups: int = 4) -> str:
    """For at most 8 ** most rows a group and 8 ** groups groups."""
    value = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in COLUMNS) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"d as (select row_number() over () as row, doc_id, coalesce('=' || lang, '') grp, {leaf('text')} h, case when {crc32_sql('doc_id::varchar')} % 3 = 0 then {leaf(lowered)} end bad from documents)",
        "a0 as (select row, grp, row_number() over (partition by grp order by doc_id nulls first, h) - 1 pos, count(*) over (partition by grp) n, h, bad from d)",
        _levels_sql("a", "grp", most),
        "subroots as (" + " union all ".join(f"select grp own, h from a{k} where n = 1" for k in range(most + 1)) + ")",
        "b0 as (select own, '' grp, row_number() over (order by own) - 1 pos, count(*) over () n, h from subroots)",
        _levels_sql("b", "grp", groups),
        "roots as (" + " union all ".join(f"select h from b{k} where n = 1" for k in range(groups + 1)) + ")",
        "af0 as (select row, grp, pos, '' proof, coalesce(bad, h) fold from a0)",
    ]
    for k in range(most):
        parts += [_siblings_sql("a", k), _folded_sql("a", f"af{k}", k)]
    parts.append(f"bf0 as (select f.row, '' grp, b.pos, f.proof, f.fold from af{most} f join b0 b on b.own = f.grp)")
    for k in range(groups):
        parts += [_siblings_sql("b", k), _folded_sql("b", f"bf{k}", k)]
    return "with " + ",\n".join(parts) + (
        f"\nselect d.doc_id, d.h leaf, s.h subroot, r.h root, sha256(f.proof) proof_sha256, f.fold folded_root, f.fold = r.h verified from bf{groups} f join d using (row) join subroots s on s.own = d.grp, roots r"
    )


ORACLE_SQL = _oracle()
