import hashlib
import random
import zlib

from pyspark.sql import functions as F

from leafmill.llm.merkle import BLOCK, ORACLE_SQL, Tree, build, op11_merkle_manifest, versions

from ..oracle import connect, same
from . import awkward


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def proof(nodes, at):
    """Lists of (left, right) up to the one node that remains, and that node."""
    way = []
    while len(nodes) > 1:
        run = at // 8 * 8
        way.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 8])))
        nodes, at = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], at // 8
    return way, nodes[0]


def brute(rows):
    """rows: (group, id, leaf, tampered) -> sorted (id, leaf, subroot, root, proof, folded)."""
    groups = {}
    for g, i, leaf, bad in rows:
        groups.setdefault("" if g is None else "=" + g, []).append((-1 if i is None else i, leaf, bad, i))
    names = sorted(groups, key=lambda g: g.encode())
    groups = {g: sorted(groups[g], key=lambda r: (r[0], r[1])) for g in names}
    tops = [proof([r[1] for r in groups[g]], 0)[1] for g in names]
    out = []
    for k, g in enumerate(names):
        upper, root = proof(tops, k)
        leaves = [r[1] for r in groups[g]]
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        for at, (_, leaf, bad, i) in enumerate(groups[g]):
            way, place = [], at
            for nodes in levels[:-1]:
                run = place // 8 * 8
                way.append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 8])))
                place //= 8
            way += upper
            fold = leaf if bad is None else bad
            for left, right in way:
                fold = h(left, fold, right)
            out.append((-1 if i is None else i, leaf, tops[k], root, h(*[a + b for a, b in way]), fold))
    return sorted(out)


def leaves_of(docs):
    for r in docs:
        leaf = lambda text, r=r: h(*[field(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        lowered = None if r["text"] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
        yield r["lang"], r["doc_id"], leaf(r["text"]), leaf(lowered) if hit else None


def got(df):
    rows = df.collect()
    assert all(r.verified == (r.folded_root == r.root) for r in rows)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in rows)


def test_against_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got(op11_merkle_manifest(spark, sf)) == brute(leaves_of(docs))
    same(op11_merkle_manifest(spark, sf), connect(sf), ORACLE_SQL)


def test_awkward_rows(spark, tmp_path):
    for k, docs in enumerate((awkward.frame(spark), awkward.empty(spark), awkward.frame(spark).limit(1))):
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sf = awkward.sf_dir(spark, tmp_path / str(k), documents=docs)
        assert got(op11_merkle_manifest(spark, sf)) == brute(leaves_of(docs.collect()))


def test_groups_of_one_to_several_blocks(spark):
    sizes = {None: 1, "a": 4 * BLOCK + 1, "b": BLOCK, "c": BLOCK + 1, "d": 9, "é": 8}
    rows = [(g, i, h(f"{g}{i}"), h("bad", str(i)) if i % 97 == 0 else None) for g, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "lang string, doc_id long, hash string, bad string").repartition(7)
    m = build(df, "lang", ["doc_id"])
    out = versions(m, "bad", ["doc_id"])
    assert sorted((r.doc_id, r.hash, r.subroot, m.root, r.proof_sha256, r.folded_root) for r in out.collect()) == brute(rows)
    copied = {r.grp: r.n for r in out.where("copied > 0").groupBy("grp").agg(F.max("copied").alias("n")).collect()}
    assert copied == {"": 2, "=a": 7, "=b": 6, "=c": 7, "=d": 4, "=é": 3}  # leaf, ancestors and root, nothing else


def test_a_version_shares_all_untouched_nodes():
    leaves = [h(str(i)) for i in range(70)]
    tree = Tree(leaves, 3)
    before = len(tree.hashes)
    roots = {at: tree.changed(at, h("x", str(at))) for at in (0, 35, 69)}
    assert len(tree.hashes) == before + 3 * 4
    for at, root in roots.items():
        assert tree.hashes[root] == proof([h("x", str(at)) if i == at else leaf for i, leaf in enumerate(leaves)], 0)[1]

        def reached(node):
            return {node}.union(*[reached(c) for c in tree.children[node]])

        assert sum(n >= before for n in reached(root)) == 4 and len(reached(root)) == before  # all others are the untouched tree's


def test_equal_rows_without_end(spark):
    rows = [("a", 7, h("same"), None)] * 300 + [("a", i, h(str(i)), None) for i in range(20)]
    m = build(spark.createDataFrame(rows, "lang string, doc_id long, hash string, bad string").repartition(5), "lang", ["doc_id"])
    assert sorted((r.doc_id, r.hash, r.subroot, m.root, r.proof_sha256, r.folded_root) for r in versions(m, "bad", ["doc_id"]).collect()) == brute(rows)
