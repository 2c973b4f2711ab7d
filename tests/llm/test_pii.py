import hashlib
import random
import re

from leafmill.llm.pii import KINDS, op8_pii, scan

from . import awkward


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= len(digits(s)) <= 15),
)


def brute(text):
    return [(name, m.start(), m.end()) for name, p, fits in PATTERNS for m in p.finditer(text or "") if fits(m[0])]


def base_of(row):
    return [(s.kind, s.start, s.stop) for s in row.spans if s.order < len(KINDS)]


def test_base_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op8_pii(spark, sf).collect()
    assert len(got) == len(docs) and all(sum(r[f"n_{k}"] for r in got) for k in ("email", "ip", "phone"))
    for r in got:
        want = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(w[0] == k for w in want) for k in KINDS]


def test_made_up_texts(spark):
    rng = random.Random(7)
    parts = ["a", "b.c", "_", "@", "@x.io", ".", "..", "-", " ", "  ", "+", "+1", "(", ")", "12", "4111 1111 1111 1111", "378282246310005", "0", "255", "256", "1.2.3.4", "007", "000000", "é", "\n", "😀", "5", "%"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(600)]
    got = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, text in zip(got, texts):
        assert base_of(r) == brute(text), text


def test_awkward_rows(spark):
    assert scan(awkward.frame(spark)).count() == len(awkward.rows())
    long = "a" * 40_000 + " " + "1" * 30_000 + " " + "2 " * 10_000 + "+1" + "(" * 20_000 + " a@b" + ".c" * 5_000 + " " + "1." * 5_000
    got = scan(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert base_of(got) == brute(long)
    assert scan(awkward.empty(spark)).count() == 0


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rng = random.Random(8)
    texts = [f"Please call me on +1 (217) 555-{1000 + i} after noon." for i in range(8)]
    texts += ["Please call me on 217-555-8888 after noon."] * 3  # no plus sign: only the context tells
    texts += [f"The order had number {rng.randint(10**7, 10**8)} today." for _ in range(8)]
    got = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    found = [[(s.kind, s.value) for s in r.spans if s.order == len(KINDS)] for r in got]
    assert found[8:11] == [[("context_phone", "217-555-8888")]] * 3
    assert not any(found[:8]) and not any(found[11:])


def test_proven_identifiers_are_found_wherever_they_stand(spark):
    seeds = [f"Please call me on +1 (217) 555-{1000 + i} after noon." for i in range(8)] + [f"Ring +1 (217) 555-{2000 + i} now." for i in range(8)]
    texts = ["Please call me on 217-555-8888 after noon.", "217-555-8888", "Tel 217-555-8888", "in 2024 call 217-555-8888", "order 12345678 217-555-8888", "Ring 217-555-9999 now."]
    got = scan(spark.createDataFrame(list(enumerate(texts + seeds)), "doc_id long, text string")).orderBy("doc_id").collect()
    found = [[(s.kind, s.value) for s in r.spans if s.order == len(KINDS)] for r in got]
    assert found[:6] == [[("context_phone", "217-555-8888")]] * 5 + [[("context_phone", "217-555-9999")]]
    assert not any(found[6:])
