"""N-gram Jaccard join through a token-group matrix; gives each document the class of documents that links reach.

Documents with the same shingle set are one class. All classes use one order of shingles, rare ones first; a class's prefix
are the shingles that may be the first one it shares with a similar class.

1. Open classes. Of two similar classes, several of the first shingles are in both (a longer prefix asks for more of them).
   Classes whose first shingles are met in too few other classes can't be linked with anything; no more is done with them.
2. Exact order. The open classes' whole sets are read once, and shingles that no other open class has are dropped:
   what is left of a set bounds its overlap with any other. Sets that can't reach the threshold go, and the rest are
   ordered by exact frequency.
3. Similar documents into groups. Classes that share a min-hash value are compared with the one of them that can reach
   farthest; the links found put classes into components. A group is at most about GROUP classes of one component and size.
4. Token-group matrix. For each shingle the matrix holds the groups in whose prefixes it is, with their least size and the
   most shingles a member has from there on. A query class meets the groups of other components that these bounds allow;
   then the query's overlap with the union of all of a group's shingles is added up (over a bitmap of the union, which
   may only overstate it), and only groups that can reach the threshold are opened: their members are compared exactly.

Pairs inside one component are never made, so the work for a large group of copies grows with its size, and no bound drops
a pair that may be linked. How many links a document has isn't counted: that would need all pairs of a group.

Frequent shingles are broadcast, HOT_TOKENS at most; they stand last in the order and are never shuffled to find open
classes. They are those met often in a task, and those found often in a sample of all tasks' shingles (one in SAMPLED of
those that a task meets too seldom to report), so a shingle of many texts is found even where no task meets it twice: a
key of that shuffle holds about 1/HOT_TOKENS of all shingles at most. Which shingles are sampled changes only the order,
never the links. Keys of other joins that hold more than 1/HOT_KEYS of the rows (equal texts, min-hash values of many
classes) are joined by broadcast: there are fewer than HOT_KEYS of them. Ids to read again are broadcast if there are at
most BROADCAST_IDS of them (more are joined by shuffle). Links, components and sets never meet on the driver. Shingles are compared by
64-bit hashes that mix each word; two different ones share a hash with odds of about 2**-64.

Defined results: a null text, or one without words, has 0 shingles, is linked with nothing and is its own component.
Rows that repeat a text are linked, whatever their ids; the component's id is the least id among its rows (null if all
are null). A text with fewer words than a shingle has one shingle, all its words. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .textops import Texts, checkpoint, map_texts, mix64, quoted, short_batches, slices, table

KEYS = 8
GROUP = 128
UNION_BITS = 1 << 15  # of a group's bitmap: what Spark's own bitmap functions use
HOT_TOKENS = 1 << 20
BROADCAST_IDS = 1 << 20
HOT_KEYS = 4096
SAMPLED = 64
_HOT_IN_TASK = 3
_HOT_IN_SAMPLE = 8
_FLUSH_TOKENS = 1 << 21
_odd = np.random.default_rng(77).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Similarity:
    """Linked when 100 * intersection >= percent * union, over distinct shingles of `words` words."""

    words: int = 4
    percent: int = 85

    def least_overlap(self, sizes: Column) -> Column:
        """Of two sets whose sizes add up to `sizes`: percent/(100+percent) of it, rounded up."""
        return F.ceil(sizes * self.percent / F.lit(100.0 + self.percent) - 1e-9)

    def least_size(self, n: Column) -> Column:
        """Of a set that can be similar to one of n: also the least overlap with any."""
        return F.ceil(n * self.percent / F.lit(100.0) - 1e-9)


def shingle_sets(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted; and where each text's begin (one more entry than texts)."""
    starts, ends, first = texts.words()
    counts = np.diff(first)
    hashes = texts.span_hash(starts, ends, lower=True)
    whole = np.maximum(counts - words + 1, 0)
    owner = np.repeat(np.arange(texts.n), whole)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole) + np.repeat(first[:-1], whole)
    value = np.zeros(len(at), np.uint64)
    for k in range(words):
        value = mix64(value * _odd[0] + hashes[at + k] * _odd[1 + k])
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        extra = counts[short].astype(np.uint64)
        for k in range(words - 1):
            has = counts[short] > k
            extra[has] = mix64(extra[has] * _odd[40] + hashes[first[short[has]] + k])
        owner, value = np.concatenate([owner, short]), np.concatenate([value, extra])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[fresh], value[fresh]
    return value, np.searchsorted(owner, np.arange(texts.n + 1))


def set_prints(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A fingerprint of each set, 0 for an empty one."""
    n = np.diff(bounds)
    some = np.flatnonzero(n)
    out = np.zeros(len(n), np.uint64)
    if len(some):
        out[some] = mix64(np.add.reduceat(mix64(tokens ^ _odd[60]), bounds[some]) + n[some].astype(np.uint64))
    return out.view(np.int64)


def fingerprints(docs: DataFrame, text: str = "text", s: Similarity = Similarity()) -> DataFrame:
    """`row` (the columns of docs), fp and n: the fingerprint and size of each row's shingle set."""

    def kernel(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        tokens, bounds = shingle_sets(Texts(batch.column("text")), s.words)
        return {"fp": pa.array(set_prints(tokens, bounds)), "n": pa.array(np.diff(bounds).astype(np.int64))}

    return map_texts(docs, kernel, [T.StructField("fp", T.LongType()), T.StructField("n", T.LongType())], docs.columns, text=text)


def sketches(docs: DataFrame, id_column: str, text: str, s: Similarity) -> DataFrame:
    """id, n, fp (fingerprint of the set); and rows with only `hot`: shingles frequent in a task, with their count n, and
    shingles sampled from all others of the task, with their count in the sample, hits."""
    source = docs.select(quoted(id_column).alias("id"), quoted(text).cast("string").alias("text"))
    fields = [
        source.schema["id"],
        T.StructField("n", T.LongType()),
        T.StructField("fp", T.LongType()),
        T.StructField("hot", T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("token", "n", "hits")]))),
    ]
    names = [f.name for f in fields]
    arrow_hot = pa.list_(pa.struct([(k, pa.int64()) for k in ("token", "n", "hits")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[np.ndarray] = []
        id_type = pa.null()

        def frequent() -> Iterator[pa.RecordBatch]:
            if not met:
                return
            tokens, counts = np.unique(np.concatenate(met), return_counts=True)
            # What is sampled differs between tasks, and is the same again if a task is run again.
            drawn = mix64(tokens ^ mix64(np.bitwise_xor.reduce(tokens, keepdims=True) + np.uint64(len(tokens)))) % np.uint64(SAMPLED) == 0
            met.clear()
            often = counts >= _HOT_IN_TASK
            at = np.flatnonzero(often | drawn)
            for part in np.array_split(at, len(at) // 20_000 + 1):
                columns = [tokens[part].view(np.int64), np.where(often[part], counts[part], 0), np.where(often[part], 0, counts[part])]
                rows = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["token", "n", "hits"])
                hot = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), hot], names=names)

        for batch in batches:
            id_type = batch.column("id").type
            for part in slices(batch, "text"):
                tokens, bounds = shingle_sets(Texts(part.column("text")), s.words)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(set_prints(tokens, bounds)), pa.nulls(part.num_rows, arrow_hot)], names=names)
                met.append(tokens)
                if sum(map(len, met)) > _FLUSH_TOKENS:
                    yield from frequent()
        yield from frequent()

    return short_batches(source).mapInArrow(run, T.StructType(fields))


def frequent_tokens(sketch: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that are frequent, and their level (the logarithm of their count); HOT_TOKENS at most.

    Only the order of shingles hangs on this, and any one order that all use gives the same links."""
    counts = sketch.where("hot is not null").select(F.explode("hot").alias("h")).groupBy("h.token").agg(F.sum("h.n").alias("n"), F.sum("h.hits").alias("hits"))
    # A few hits of the sample tell nothing: most shingles are in one text.
    counts = counts.withColumn("n", F.col("n") + F.when(F.col("hits") >= _HOT_IN_SAMPLE, SAMPLED * F.col("hits")).otherwise(0))
    counts = checkpoint(counts.where("n > 0").withColumn("level", F.floor(F.log2("n")).cast("int")))
    levels = sorted(counts.groupBy("level").count().collect(), reverse=True)
    total, least = 0, 0
    for level, rows in levels:
        if total + rows > HOT_TOKENS:
            least = level + 1
            break
        total += rows
    found = counts.where(F.col("level") >= least).select("token", "level").toArrow()
    tokens = found.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found.column("level").to_numpy()[order].astype(np.uint8)


def _levels(tokens: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Level of each shingle: 0 unless it is frequent."""
    if not len(hot[0]):
        return np.zeros(len(tokens), np.uint8)
    at = np.minimum(np.searchsorted(hot[0], tokens), len(hot[0]) - 1)
    return np.where(hot[0][at] == tokens, hot[1][at], 0).astype(np.uint8)


def join_hot(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int) -> DataFrame:
    """Inner join with `right`, which has each key once, with the number of `rows` that `left` has for it, of `total`.

    Keys of more than 1/HOT_KEYS of all rows of `left` are joined by broadcast, fewer than HOT_KEYS rows; others by shuffle."""
    many = F.col(rows) * HOT_KEYS > total
    hot = right.where(many)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(~many), on)
    return left.join(F.broadcast(hot), on).unionByName(rest)


def asked(n: Column) -> Column:
    """How many of its first shingles a set of n asks for in other sets: 1 in 20, 1 at least."""
    return F.greatest(F.lit(1), F.floor(n / F.lit(20)))


def open_classes(docs: DataFrame, text: str, s: Similarity, hot) -> DataFrame:
    """fp of the classes that may be linked with another one.

    A set's first n - least + asked(n) shingles hold at least asked(n) of those it shares with a similar set, and the first
    of these, as many as the smaller set asks for, are among the first of both. Frequent ones count as shared right away."""
    source = docs.select(quoted(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, bounds = shingle_sets(Texts(part.column("text")), s.words)
                n = np.diff(bounds)
                fps = set_prints(tokens, bounds)
                # A class that this task has met needn't be listed again.
                fresh = np.zeros(len(n), bool)
                for d in np.flatnonzero(n).tolist():
                    fresh[d] = fps[d] not in seen
                    seen.add(fps[d])
                if len(seen) > 1_000_000:
                    seen.clear()
                level = _levels(tokens, hot.value)
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((mix64(tokens), level, owner))
                pos = np.arange(len(tokens)) - np.repeat(bounds[:-1], n)
                first = n - -(-n * s.percent // 100) + np.maximum(1, n // 20)
                inside = (pos < np.repeat(first, n)) & np.repeat(fresh, n)
                frequent = level[order] > 0
                met = np.bincount(owner[inside & frequent], minlength=len(n))
                keep = inside & ~frequent
                # One row that stands for the frequent ones, under the class's own fingerprint.
                own = np.flatnonzero(met)
                whose = np.concatenate([owner[keep], own])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([tokens[order][keep].view(np.int64), fps[own]])),
                        pa.array(fps[whose]),
                        pa.array(n[whose].astype(np.int32)),
                        pa.array(np.concatenate([np.zeros(int(keep.sum()), np.int32), met[own].astype(np.int32)])),
                    ],
                    names=["token", "fp", "n", "hot"],
                )

    by_token = W.partitionBy("token")
    rows = source.mapInArrow(run, "token long, fp long, n int, hot int")
    rows = rows.withColumn("lo", F.min("fp").over(by_token)).withColumn("hi", F.max("fp").over(by_token)).where("lo <> hi or hot > 0")
    met = rows.groupBy("fp").agg(F.first("n").alias("n"), F.max("hot").alias("hot"), F.sum(F.when(F.col("hot") > 0, 0).otherwise(1)).alias("rare"))
    return met.where(F.col("hot") + F.col("rare") >= asked(s.least_size(F.col("n")))).select("fp")


def whole_sets(docs: DataFrame, wanted: DataFrame, rows: DataFrame, id_column: str, text: str, s: Similarity, hot) -> DataFrame:
    """fp, n, rare, frequent (the set's shingles, the frequent ones in order) and keys (min-hashes) of the wanted classes."""
    # Rows of one class are added up before they meet: joined first, a class of many copies would be one task's rows.
    needed = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("id")).join(wanted, "fp", "left_semi"))
    few = needed.count() <= BROADCAST_IDS
    small = F.broadcast if few else (lambda d: d)
    source = docs.select(quoted(id_column).alias("id"), quoted(text).cast("string").alias("text"))
    ids = needed.select(F.col("id").alias("_id")).distinct()
    source = source.join(small(ids), F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, bounds = shingle_sets(Texts(part.column("text")), s.words)
                n = np.diff(bounds)
                level = _levels(tokens, hot.value)
                owner = np.repeat(np.arange(len(n)), n)
                keys = np.zeros((len(n), KEYS), np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    for k in range(KEYS):
                        keys[some, k] = np.minimum.reduceat(mix64(tokens * _odd[50 + k]), bounds[some])
                order = np.lexsort((mix64(tokens), level, owner))
                ordered, frequent = tokens[order], level[order] > 0
                cuts = lambda flags: pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[flags], minlength=len(n)))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(set_prints(tokens, bounds)),
                        pa.array(n.astype(np.int64)),
                        pa.ListArray.from_arrays(cuts(~frequent), pa.array(ordered[~frequent].view(np.int64))),
                        pa.ListArray.from_arrays(cuts(frequent), pa.array(ordered[frequent].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * KEYS, pa.int32()), pa.array(keys.ravel().view(np.int64))),
                    ],
                    names=["fp", "n", "rare", "frequent", "keys"],
                )

    # Rows may share an id with rows of other classes: the set's own fingerprint decides.
    sets = source.mapInArrow(run, "fp long, n long, rare array<long>, frequent array<long>, keys array<long>")
    sets = checkpoint(sets.join(small(needed.select("fp")), "fp", "left_semi"))
    # Only rows that repeat both id and text give a set twice: then, and only then, sets are shuffled to keep one.
    return sets if sets.groupBy("fp").count().where("count > 1").isEmpty() else sets.dropDuplicates(["fp"])


def survivors(sets: DataFrame, s: Similarity) -> DataFrame:
    """fp, n, tokens (those that others have too, rare ones first) and keys of the classes that can still reach the threshold."""
    by_token = W.partitionBy("token")
    shared = lambda d: d.withColumn("met", F.count("*").over(by_token)).where("met > 1")
    rows = checkpoint(shared(sets.select("fp", F.explode("rare").alias("token"))))
    room = sets.select("fp", "n", F.size("frequent").alias("frequent")).join(rows.groupBy("fp").agg(F.count("*").alias("rare")), "fp", "left")
    alive = checkpoint(room.where(F.col("frequent") + F.coalesce("rare", F.lit(0)) >= s.least_size(F.col("n"))).select("fp"))
    # Once more: what only sets that went had in common is no longer shared.
    rows = shared(rows.join(alive, "fp", "left_semi").select("fp", "token"))
    ordered = rows.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("met", "token"))).alias("rare"))  # of one set: bounded by its text
    out = sets.join(alive, "fp", "left_semi").drop("rare").join(ordered, "fp", "left")
    tokens = F.concat(F.coalesce(F.col("rare.token"), F.array().cast("array<long>")), F.col("frequent"))
    return out.select("fp", "n", tokens.alias("tokens"), "keys").where(F.size("tokens") >= s.least_size(F.col("n")))


def verified(pairs: DataFrame, sets: DataFrame, s: Similarity) -> DataFrame:
    """Pairs (a, b) of classes that are linked, by their whole sets."""
    side = lambda fp, n, tokens: sets.select(F.col("fp").alias(fp), F.col("n").alias(n), F.col("tokens").alias(tokens))
    joined = pairs.join(side("a", "n_a", "x"), "a").join(side("b", "n_b", "y"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            for i in range(batch.num_rows):
                x, y = batch.column("x")[i].values.to_numpy(), batch.column("y")[i].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= s.percent * (sizes[i] - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """fp, comp for every class that has an edge: comp is the least fp that can be reached.

    Large stars and small stars in turn (Kiveris and others, 2014): both keep what is connected, and the rounds grow with
    the logarithm of the classes, however long a chain is. Edges go from the larger fp (u) to the smaller (v)."""
    least = lambda d: d.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    edges = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.union(edges.select("v", "u"))
        # Large star: the larger neighbours of each class are linked with its least one.
        large = checkpoint(both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: so are the class and its smaller neighbours.
        near = large.join(least(large), "u")
        edges = near.select("u", F.col("m").alias("v")).union(near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = checkpoint(edges.distinct())
        # Done when every class has one edge, and that leads to a class that has none.
        if edges.groupBy("u").count().where("count > 1").isEmpty() and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("fp"), F.col("v").alias("comp")).union(edges.select("v", "v").distinct())


def star_pairs(sets: DataFrame, s: Similarity) -> DataFrame:
    """Each class with the class of each of its min-hash values that can be linked with the largest ones."""
    keys = sets.select("fp", F.floor(F.size("tokens") * (100.0 + s.percent) / s.percent - F.col("n")).alias("reach"), F.posexplode("keys").alias("k", "key"))
    leaders = keys.groupBy("k", "key").agg(F.max_by("fp", F.struct("reach", "fp")).alias("leader"), F.count("*").alias("size")).where("size > 1")
    pairs = join_hot(keys, checkpoint(leaders), ["k", "key"], "size", KEYS * sets.count()).where("fp <> leader")
    return pairs.select(F.least("fp", "leader").alias("a"), F.greatest("fp", "leader").alias("b")).distinct()


def unions(members: DataFrame) -> DataFrame:
    """group, bits: a bitmap of all shingles of each group's members. Tasks make bitmaps, and Spark merges them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, which = np.unique(batch.column("group").to_numpy(), return_inverse=True)
            column = batch.column("tokens")
            sizes = column.value_lengths().to_numpy()
            bit = column.flatten().to_numpy() & (UNION_BITS - 1)
            owner = np.repeat(which, sizes)
            for g, place in enumerate(places.tolist()):
                flags = np.zeros(UNION_BITS, bool)
                flags[bit[owner == g]] = True
                yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["group", "bits"])

    return members.select("group", "tokens").mapInArrow(run, "group long, bits binary").groupBy("group").agg(F.bitmap_or_agg("bits").alias("bits"))


def qualifying(asking: DataFrame, sets: DataFrame, members: DataFrame, s: Similarity) -> DataFrame:
    """Of (fp, group, g_least): those whose overlap with the union of the group can reach the threshold."""
    wanted = members.join(asking.select("group").distinct(), "group", "left_semi")
    joined = asking.join(sets.select("fp", "n", "tokens"), "fp").join(unions(wanted), "group")
    least = s.least_overlap(F.col("n") + F.greatest("g_least", s.least_size(F.col("n"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, least in enumerate(batch.column("least").to_numpy().tolist()):
                flags = np.unpackbits(np.frombuffer(batch.column("bits")[i].as_py(), np.uint8), bitorder="little")
                keep[i] = flags[batch.column("tokens")[i].values.to_numpy() & (UNION_BITS - 1)].sum(dtype=np.int64) >= least
            yield pa.RecordBatch.from_arrays([batch.column("fp"), batch.column("group")], names=["fp", "group"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("fp", "group", least.alias("least"), "tokens", "bits").mapInArrow(run, "fp long, group long")


def matrix_pairs(sets: DataFrame, comp: DataFrame, s: Similarity) -> DataFrame:
    """Pairs of classes of different components which the token-group matrix can't rule out."""
    placed = sets.join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")).withColumn("size", F.floor(16 * F.log2("n")))
    many = placed.groupBy("comp", "size").agg(F.ceil(F.count("*") / F.lit(GROUP)).alias("blocks"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    members = checkpoint(placed.join(many, ["comp", "size"]).select("fp", "n", "comp", "size", F.xxhash64("comp", "size", block).alias("group"), "tokens"))
    # The i-th token from the end has room for i shared ones.
    prefix = F.slice("tokens", 1, F.greatest(F.lit(0), F.size("tokens") - s.least_size(F.col("n")) + 1).cast("int"))
    rows = members.select("fp", "n", "comp", "size", "group", F.size("tokens").alias("whole"), F.posexplode(prefix).alias("pos", "token")).withColumn("room", F.col("whole") - F.col("pos")).drop("whole", "pos")
    # First by token and size alone: is there any row of another component that a row could be linked with?
    reachable = lambda n, room, least, most: F.least(room, most) >= s.least_overlap(n + F.greatest(least, s.least_size(n)))
    sizes = rows.groupBy("token", "size").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("room").alias("room"))
    seen = sizes.groupBy("token").agg(F.collect_list(F.struct("lo", "hi", "least", "most", "room")).alias("sizes"))  # a few hundred sizes at most
    other = lambda x: ((x["lo"] != F.col("comp")) | (x["hi"] != F.col("comp"))) & (100 * x["most"] >= s.percent * F.col("n")) & (s.percent * x["least"] <= 100 * F.col("n")) & reachable(F.col("n"), F.col("room"), x["least"], x["room"])
    matrix = checkpoint(rows.join(seen, "token").where(F.exists("sizes", other)).drop("sizes"))
    groups = matrix.groupBy("token", "comp", "group").agg(F.min("n").alias("g_least"), F.max("n").alias("g_most"), F.max("room").alias("g_room"))
    query = matrix.select("token", "fp", F.col("comp").alias("q_comp"), F.col("n").alias("q_n"), F.col("room").alias("q_room"))
    meets = (
        (F.col("q_comp") != F.col("comp"))
        & (100 * F.col("g_most") >= s.percent * F.col("q_n"))
        & (s.percent * F.col("g_least") <= 100 * F.col("q_n"))
        & reachable(F.col("q_n"), F.col("q_room"), F.col("g_least"), F.col("g_room"))
    )
    met = checkpoint(query.join(groups.withColumnRenamed("token", "t"), (F.col("token") == F.col("t")) & meets).select("token", "fp", "q_n", "q_room", "group", "g_least"))
    opened = qualifying(met.groupBy("fp", "group").agg(F.min("g_least").alias("g_least")), sets, members, s)
    inside = matrix.select(F.col("token").alias("t"), F.col("group").alias("g"), F.col("fp").alias("b"), "n", "room")
    fits = (F.col("fp") < F.col("b")) & (F.least("q_room", "room") >= s.least_overlap(F.col("q_n") + F.col("n")))
    pairs = met.join(opened, ["fp", "group"]).join(inside, (F.col("token") == F.col("t")) & (F.col("group") == F.col("g")) & fits)
    return pairs.select(F.col("fp").alias("a"), "b").distinct()


def link(docs: DataFrame, id_column: str = "doc_id", text: str = "text", s: Similarity = Similarity()) -> DataFrame:
    """id, fp (of its shingle set; 0 if it is empty), n_shingles, component_id (least id of the documents that links reach)
    and keeper (whether a row with this id and set is the component's first: least id, then least fp)."""
    sketch = checkpoint(sketches(docs, id_column, text, s))
    rows = sketch.where("hot is null").select("id", "n", "fp")
    some = rows.where("n > 0")
    hot = docs.sparkSession.sparkContext.broadcast(frequent_tokens(sketch))
    wanted = checkpoint(open_classes(docs, text, s, hot))
    sets = checkpoint(survivors(whole_sets(docs, wanted, some, id_column, text, s, hot), s))
    edges = checkpoint(verified(star_pairs(sets, s), sets, s))
    comp = components(edges)
    late = checkpoint(verified(checkpoint(matrix_pairs(sets, comp, s)), sets, s))
    if not late.isEmpty():
        comp = components(edges.union(late))
    # The least id of each component, then of each class. Most classes have no link: those meet no component.
    classes = some.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("first"), F.count("*").alias("rows")).join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    classes = checkpoint(classes)
    heads = classes.groupBy("comp").agg(F.min("first").alias("head"))
    named = checkpoint(classes.join(heads, "comp").select("fp", "head", "rows"))
    keeper = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("fp") == F.col("head.fp"))
    total = named.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    out = join_hot(some, named, ["fp"], "rows", total).select("id", "fp", F.col("n").alias("n_shingles"), F.col("head.id").alias("component_id"), keeper.alias("keeper"))
    alone = rows.where("n = 0").select("id", "fp", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("keeper"))
    return out.unionByName(alone)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


#: The same by brute force: all pairs of classes that share a shingle, and all classes that links reach.
ORACLE_SQL = """with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') ws from documents),
sets as (select doc_id, list_sort(list_distinct(case when len(ws) = 0 then []::varchar[] when len(ws) < 4 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end)) shingles from words),
keyed as (select doc_id, len(shingles) n, case when len(shingles) > 0 then md5(array_to_string(shingles, chr(10))) end class, shingles from sets),
classes as (select class, any_value(n) n, any_value(shingles) shingles, min(doc_id) least from keyed where n > 0 group by 1),
tokens as (select class, n, unnest(shingles) t from classes),
shared as (select a.class x, b.class y, a.n + b.n both_n, count(*) common from tokens a join tokens b on a.t = b.t and a.class < b.class and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by all),
links as (select x, y from shared where 100 * common >= 85 * (both_n - common)),
edges as (select x, y from links union all select y, x from links),
reach as (select class x, class y from classes union select reach.x, edges.y from reach join edges on reach.y = edges.x),
comp as (select x class, min(least) component_id from reach join classes on reach.y = classes.class group by 1)
select doc_id, n::bigint n_shingles, coalesce(component_id, doc_id) component_id from keyed left join comp using (class)"""
