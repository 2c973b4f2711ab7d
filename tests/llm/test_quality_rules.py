import re
from collections import Counter

import pytest

from leafmill.llm.quality_rules import clean_lines, op7_quality_rules

from . import awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op7_quality_rules(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == brute(texts[r.doc_id]), r
        assert not (r.kept and r.base_failed)


def test_awkward_rows(spark):
    got = clean_lines(awkward.frame(spark)).collect()
    assert len(got) == len(awkward.rows())
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == brute(r.row.text), r.row
    assert clean_lines(awkward.empty(spark)).count() == 0


@pytest.mark.parametrize(
    "line, stays",
    [
        ("This line has a full sentence in it.", True),
        ("No end here", False),
        ("a line of many words that has no end mark at all but is long", True),
        ("Home | About | Contact | Help", False),
        ("This work is licensed under some license.", False),
        ("thus*** that*** more### so%%% it&&& goes*** on***", False),
        ("SHOUTING WITHOUT END IN CAPITALS ONLY.", False),
        ("«Une ligne finit ainsi»", True),
    ],
)
def test_lines(spark, line, stays):
    text = f"A first sentence stands here.\n{line}\nA last sentence stands here."
    clean = clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().clean_text
    assert (line in clean) == stays
    assert clean.startswith("A first") and clean.endswith("stands here.")


def test_document_that_loses_too_much_is_rejected(spark):
    good = "\n".join(f"Sentence{i} number{i} says{i} something{i} new{i} and{i}." for i in range(20))
    bad = "\n".join(f"Item {i} | Link {i} | More {i} | Again {i}" for i in range(20))
    got = {r.row.doc_id: r.kept for r in clean_lines(spark.createDataFrame([(1, good), (2, good + "\n" + bad), (3, bad)], "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False}
