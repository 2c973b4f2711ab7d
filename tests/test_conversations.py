import pytest

from leafmill.operators import checks, conversations as conv, vectors as vec
from leafmill.sources import tables

from .test_vectors import cosine_native

FIRST, SECOND = conv.PHASES


@pytest.mark.parametrize(
    "output, phase, kind",
    [
        (None, FIRST, "non_text"),
        (" ", FIRST, "empty"),
        ("plain", FIRST, "invalid_json"),
        ("```json\n{}\n```", FIRST, "code_fence"),
        ('{"type":"answer","content":"x"} tail', FIRST, "invalid_json"),
        ("[1]", FIRST, "non_object"),
        ('{"type":"answer","content":"x"}', FIRST, "answer"),
        ('{"type":"answer","content":" "}', FIRST, "empty_answer"),
        ('{"type":"answer","content":3}', SECOND, "empty_answer"),
        ('{"type":"other"}', FIRST, "unknown_type"),
        ('{"type":"tool_call","tool":"web"}', FIRST, "unknown_tool"),
        ('{"type":"tool_call","tool":"retrieve_regulations","arguments":{"text":" "}}', FIRST, "bad_search_text"),
        ('{"type":"tool_call","tool":"retrieve_regulations","arguments":{"text":"q"}}', FIRST, "tool_call"),
        ('{"type":"tool_call","tool":"retrieve_regulations","arguments":{"text":"q"}}', SECOND, "not_an_answer"),
        ('{"type":"other","type":"answer","content":"last wins"}', FIRST, "answer"),
    ],
)
def test_reply_classes(output, phase, kind):
    got = conv.classify_reply(output, phase)
    assert got[0] == kind and (got[3] is None) == (kind in ("answer", "tool_call"))


def test_validation(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "robot", "x"), (3, 1, "user", " "), (4, 0, "system", "s")]
    got = {r.conv_id: r.violations for r in conv.conversation_violations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: "", 2: "last turn is not the user's", 3: "role not allowed; blank content", 4: "last turn is not the user's"}


def test_order_of_similar_passages_and_bad_k(spark):
    v = spark.createDataFrame([("encryption", [1.0, 0.0]), ("logging", [0.0, 1.0]), ("access", [0.9, 0.1]), ("zero", [0.0, 0.0])], "id string, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    assert [r.id for r in vec.cosine_topk(q, v).orderBy("rank").collect()] == ["encryption", "access", "logging"]
    assert [(r.id, r.similarity) for r in vec.cosine_topk(q, v, 9).orderBy("rank").collect()] == [(r.id, r.similarity) for r in cosine_native(q, v, 9).orderBy("rank").collect()]
    assert vec.cosine_topk(q, v.limit(0)).count() == 0
    for k in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            vec.cosine_topk(q, v, k)


def test_embedding_in_batches_of_eight_and_blank_texts(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        assert len(texts) <= 8
        calls.add(1)
        return [[float(len(t))] for t in texts]

    d = spark.createDataFrame([(i, f"text-{'x' * i}") for i in range(9)], "pos int, input string").coalesce(1)
    assert {r.pos: r.embedding for r in vec.embed_passages(d, embed).collect()} == {i: [5.0 + i] for i in range(9)}
    for blank in ("", "   ", "\n\t", " "):
        with pytest.raises(checks.CorpusError):
            vec.embed_passages(spark.createDataFrame([(1, blank)], "pos int, input string"), embed)


def test_upsert_and_snapshots(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id long, text string")
    root = str(tmp_path / "vectors")
    tables.write_snapshot(spark, old, root, 1)
    tables.write_snapshot(spark, tables.upserted(tables.current_snapshot(spark, root), new), root, 2)
    assert sorted(tuple(r) for r in tables.current_snapshot(spark, root).collect()) == [(1, "a"), (2, "B"), (3, "c")]


def test_round_trip_and_bad_passages(spark, tmp_path):
    from leafmill.plans.corpus import build_records

    pages = spark.createDataFrame([("D", 1, "Ref. No.: S17 1\n1. TOP\nSome text.")], "document string, pdf_page int, page_text string")
    records = build_records(pages)
    path = str(tmp_path / "json")
    tables.passages_as_json(records).select("json").write.text(path)
    back = tables.load_passages(spark, path)
    assert [r.asDict(True) for r in back.collect()] == [r.asDict(True) for r in records.collect()]
    with pytest.raises(checks.CorpusError):
        checks.check_corpus(records.union(records))
    with pytest.raises(checks.CorpusError):
        checks.check_corpus(records.limit(0))
    tables.write_passages(records, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_whole_conversations_turn_by_turn(spark):
    questions = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x"), (3, 5, "never answered")], "conv_id long, turn long, text string")
    replies = spark.createDataFrame([(1, 0, 0, "assistant", "A"), (1, 2, 0, "system", "found"), (1, 2, 1, "assistant", "C"), (2, 0, 0, "assistant", "X")], "conv_id long, turn long, turn_order int, role string, text string")
    got = sorted((tuple(r) for r in conv.run_conversations(questions, replies).collect()))
    assert got == [
        (1, 0, 0, "user", "a", 1), (1, 1, 0, "assistant", "A", 1), (1, 2, 2, "user", "c", 3), (1, 3, 2, "system", "found", 3), (1, 4, 2, "assistant", "C", 3),
        (2, 0, 0, "user", "x", 1), (2, 1, 0, "assistant", "X", 1),
    ]
    short = sorted(tuple(r)[:5] for r in conv.run_conversations(questions, replies, assistant_only=True).where("conv_id = 1").collect())
    assert short == [(1, 0, 0, "user", "a"), (1, 1, 0, "assistant", "A"), (1, 2, 2, "user", "c"), (1, 3, 2, "assistant", "C")]
    assert conv.run_conversations(questions.limit(0), replies.limit(0)).count() == 0


def test_broken_lines_are_told_by_file_and_line(spark, tmp_path):
    good = '{"id": "%s", "text": "words", "metadata": {"document": "D", "part_number": 1}}'
    lines = [good % "a", "", '{"id": "cut', good % "b", "[1]", "null", '{"text": "no id"}', '{"id": "c", "text": "x", "metadata": {"part_number": "one"}}', "   ", good % "d"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "in" / "two.jsonl").write_text("\n".join([good % f"t{i}" if i % 50 else f"broken {i}" for i in range(2_000)]) + "\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)  # several blocks a file
        found, broken = tables.read_passages(spark, str(tmp_path / "in"))
        assert found.rdd.getNumPartitions() > 3
        told = sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in broken.collect())
        ids = sorted(r.id for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert told == [("one.jsonl", n, lines[n - 1]) for n in (3, 5, 6, 7, 8)] + sorted(("two.jsonl", i + 1, f"broken {i}") for i in range(0, 2_000, 50))
    assert ids == sorted(["a", "b", "d", *(f"t{i}" for i in range(2_000) if i % 50)])
    with pytest.raises(checks.CorpusError, match="one.jsonl', 3"):
        tables.load_passages(spark, str(tmp_path / "in"))
    (tmp_path / "none.jsonl").write_text("\n \n")
    with pytest.raises(checks.CorpusError, match="no passages"):
        tables.load_passages(spark, str(tmp_path / "none.jsonl"))


def test_a_filter_on_the_reply_does_not_classify_twice(spark):
    replies = conv.reply_classes(spark.createDataFrame([(1, '{"type":"answer","content":"x"}'), (2, "[1]")], "conv_id long, output string"))
    found = replies.where("reply.kind = 'answer'").select("conv_id", "reply.content")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # two, and two workers a task, before
    assert [tuple(r) for r in found.collect()] == [(1, "x")]
