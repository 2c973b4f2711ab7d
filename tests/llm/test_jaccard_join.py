import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import jaccard_join
from leafmill.llm.jaccard_join import ORACLE_SQL, Similarity, components, link, op5_jaccard_join, shingle_sets, unions
from leafmill.llm.textops import Texts

from ..oracle import connect, same
from . import awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(texts, k=4, percent=85):
    """texts: id -> text; gives id -> (n_shingles, component)."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    done = set()
    for ids in by.values():
        for x in ids:
            for y in ids:
                if x < y and (x, y) not in done:
                    done.add((x, y))
                    both = len(sets[x] & sets[y])
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        a, b = sorted((find(x), find(y)))
                        parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in texts}


def check(got, texts, **more):
    want = brute(texts, **more)
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(got) == len(texts)


def near_copies(rng, groups=12, copies=14):
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 120, 200]))
        if g % 3 == 0:
            base += passage
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words += rng.choices(vocabulary, k=rng.randint(1, 12))
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_jaccard_join(spark, sf).withColumnRenamed("doc_id", "id").collect()
    check(got, texts)
    assert len({r.component_id for r in got}) < len(got)


@pytest.mark.parametrize("seed, s", [(1, Similarity()), (2, Similarity(5, 80))])
def test_near_copies(spark, seed, s):
    texts = near_copies(random.Random(seed))
    got = link(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), s=s).collect()
    check(got, texts, k=s.words, percent=s.percent)


def test_awkward_rows(spark):
    got = link(awkward.frame(spark)).collect()
    assert len(got) == len(awkward.rows())
    want = brute({i: t for i, t in enumerate(awkward.TEXTS)})
    for r in got:
        if r.id is not None and r.id < 100:
            assert (r.n_shingles, r.component_id) == want[r.id]
    assert link(awkward.empty(spark)).count() == 0


def test_shingles_met_seldom_in_each_task_are_found_by_the_sample(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(400))) for i in range(40)], "doc_id long, text string")
    hot = jaccard_join.sketches(docs, "doc_id", "text", Similarity()).select(F.explode("hot").alias("h")).select("h.*").toPandas()
    # One in SAMPLED of 40 x 397 shingles, none of them often in a task.
    assert hot["n"].max() == 0 and 150 < hot["hits"].sum() < 350
    rows = [(7, 0, 1), (8, 2000, 0)] + [(9, 0, 1)] * 30 + [(6, 3, 2)]
    sketch = spark.createDataFrame([([r],) for r in rows], "hot array<struct<token: long, n: long, hits: long>>").repartition(5)
    tokens, levels = jaccard_join.frequent_tokens(sketch)
    assert dict(zip(tokens.tolist(), levels.tolist())) == {6: 1, 8: 10, 9: 10}


@pytest.mark.parametrize("keys", [1, 8, 4096])
def test_hot_keys_are_joined_as_others_are(spark, monkeypatch, keys):
    monkeypatch.setattr(jaccard_join, "HOT_KEYS", keys)
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(90)], "k long, i long")
    right = left.groupBy("k").agg(F.count("*").alias("rows"), F.min("i").alias("least"))
    got = jaccard_join.join_hot(left, right, ["k"], "rows", 90).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in left.join(right, "k").collect())


def test_unions_hold_every_token(spark):
    rng = np.random.default_rng(3)
    sets = [(int(g), [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 50)]) for g in (1, 1, 2, 3, 3, 3)]
    for r in unions(spark.createDataFrame(sets, "group long, tokens array<long>")).collect():
        flags = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
        tokens = {x & 32767 for g, row in sets if g == r.group for x in row}
        assert set(np.flatnonzero(flags).tolist()) == tokens


def test_words_alike_in_a_polynomial_hash_differ():
    # A Thue-Morse word and its complement collide modulo 2**64 whatever the base.
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    tokens, _ = shingle_sets(Texts(pa.array([one, other, one[:64], other[:64], one[:9], other[:9]])), 4)
    assert len(set(tokens.tolist())) == 6


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    texts = {}
    for i in range(400):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(40)}"
        texts[i] = " ".join(words)
    check(link(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)


def test_rows_without_an_id_carry_links(spark):
    words = [f"w{i}" for i in range(60)]
    far = lambda *cut: " ".join(f"x{i}" if i in cut else w for i, w in enumerate(words))
    rows = [(1, far(0)), (None, far()), (2, far(59)), (2, "another text of the same id"), (7, "another text of the same id")]
    got = link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id or 0, r.n_shingles, r.component_id, r.keeper) for r in got) == [(0, 57, 1, False), (1, 57, 1, True), (2, 3, 2, True), (2, 57, 1, False), (7, 3, 2, False)]


def test_sets_count_distinct_shingles():
    texts = ["a b c d e", "A b C d e", "a b", "", "a b c d a b c d", "x " * 50]
    tokens, bounds = shingle_sets(Texts(pa.array(texts)), 4)
    assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts]
    assert set(tokens[: bounds[1]]) == set(tokens[bounds[1] : bounds[2]])


def test_components_of_a_long_chain(spark):
    ids = list(range(1, 8))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])] + [(100, 101)], "a long, b long")
    assert {(r.fp, r.comp) for r in components(edges).collect()} == {(i, 1) for i in ids} | {(100, 100), (101, 100)}


@pytest.mark.parametrize("links", [59, 500])
def test_components_of_chains_of_any_length(spark, links):
    ids = list(range(-5, links - 4))
    random.Random(2).shuffle(ids)
    edges = spark.createDataFrame([(min(p), max(p)) for p in zip(ids, ids[1:])] + [(1000, 1001), (1000, 1002)], "a long, b long")
    assert sorted((r.fp, r.comp) for r in components(edges).collect()) == [(i, -5) for i in sorted(ids)] + [(i, 1000) for i in (1000, 1001, 1002)]


def test_against_sql(spark, sf):
    same(op5_jaccard_join(spark, sf), connect(sf), ORACLE_SQL)
