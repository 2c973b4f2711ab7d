import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from leafmill.llm.prefix_trie import ORACLE_SQL, narrow_turns, op12_prefix_trie, rebuilt, screened, prefixes, trie

from ..oracle import connect, same

SCHEMA = "conv_id long, turn long, role string, text string, depth string, `a.b` long"


def unit(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def rebuild(rows):
    """conv_id -> list of (role, text), as the contract has it."""
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(r)
    order = lambda r: (r[1] is not None, r[1] or 0, unit(r[2] or "", r[3] or ""))
    own = {c: [(r[2] or "", r[3] or "") for r in sorted(t, key=order)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, children, ends = defaultdict(set), defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    saved, leaves = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved[k] = own + sum(saved[x] for x in children[k])
        leaves[k] = sum(leaves[x] for x in children[k]) if children[k] else 1
    return Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items()
    )


def got(df):
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def table(spark, tmp_path, rows, parts=3):
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def test_against_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op12_prefix_trie(spark, sf)) == brute(rebuild(rows))
    same(op12_prefix_trie(spark, sf), connect(sf), ORACLE_SQL)


def awkward_rows():
    rng = random.Random(3)
    texts = [None, "", " ", "hi", "Hi", "two words", "tab\tnbsp\u00a0here", "日本語 テキスト", "word " * 20_000]
    rows = [(c, t, rng.choice([None, "user", "assistant", ""]), rng.choice(texts)) for c in [*range(-45, 60, 3), 0, 20, 40] for t in range(rng.randrange(1, 6))]
    rows += [(7, None, "user", "no number"), (7, 1, "user", "twice"), (7, 1, "user", "twice"), (7, 1, "assistant", None), (None, 0, "user", "no id"), (None, None, None, None)]
    rows += [(1000, 0, None, None), (2**62, 0, "user", "far"), (-(2**62), 5, "user", "far")]
    rows += [(c, t, "user", f"copy {t}") for c in range(2000, 2040) for t in range(4)]
    return [(*r, "clash", 1) for r in rows]


def test_awkward_rows(spark, tmp_path):
    rows = awkward_rows()
    assert got(op12_prefix_trie(spark, table(spark, tmp_path / "a", rows))) == brute(rebuild(rows))
    (tmp_path / "b").mkdir()
    assert not got(op12_prefix_trie(spark, table(spark, tmp_path / "b", [], 1)))


@pytest.mark.parametrize("most_cells", [16, 1 << 27])
def test_the_sketch_changes_no_result(spark, most_cells):
    rows = awkward_rows()
    turns, lengths = rebuilt(spark.createDataFrame(rows, SCHEMA))
    assert got(trie(turns, lengths, most_cells)) == brute(rebuild(rows))
    marked = screened(prefixes(turns), most_cells).collect()
    seen = Counter((r.a, r.b) for r in marked)
    for r in marked:  # what is emitted alone has one member
        assert r.since is None or seen[r.a, r.b] == 1
    if most_cells > 16:
        assert sum(r.since is None for r in marked) <= sum(n > 1 for n in seen.values() for _ in range(n)) + 2


def test_one_long_conversation_and_a_copy_of_it_lie_in_many_parts(spark):
    rows = [(c, t, "user", f"turn {t % 50}") for c in (101, 102) for t in range(3000)] + [(c, t, "user", f"{c} {t}") for c in range(200, 300) for t in range(3)]
    rows += [(500, t, "user", f"turn {t % 50}" if t < 2500 else f"own {t}") for t in range(2600)]
    turns, lengths = rebuilt(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA).repartition(8))
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(trie(turns, lengths)) == brute(rebuild(rows))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def test_ends_of_many_conversations_are_hashed_in_pieces(spark):
    rows = [(c, 0, "user", "same") for c in range(100_000, 109_999)]
    df = trie(*rebuilt(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)))
    assert got(df) == brute(rebuild(rows))


def test_no_text_is_shuffled(spark):
    turns = spark.createDataFrame([(1, 0, "user", "some words here", "", 0)], SCHEMA)
    assert narrow_turns(turns).dtypes == [("conv_id", "bigint"), ("turn", "bigint"), ("x", "bigint"), ("y", "bigint"), ("words", "bigint")]
