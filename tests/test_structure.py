"""Hand-made pages and texts with known chunks and passages."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions.text import is_title_line, word_count
from leafmill.operators import checks, lines as ln, passages as ps, structure as st
from leafmill.plans.corpus import build_records, checked_records
from leafmill.profiles import GUIDELINE, OLDER, STANDARD


def pages(spark, *texts, document="D"):
    return spark.createDataFrame([(document, i, t) for i, t in enumerate(texts, 1)], "document string, pdf_page int, page_text string")


def chunks(spark, *texts, profile=STANDARD):
    kept = ln.kept_lines(pages(spark, *texts), profile)
    toc = st.toc_titles(kept, profile) if profile.lettered else None
    found = st.structural_chunks(ln.body_lines(kept, profile), profile, toc).orderBy("seg").collect()
    return [(r.section, r.kind, r.parent_titles, r.pdf_page_start, " ".join(x.line for x in r.lines)) for r in found]


def test_front_matter_and_headers_go_and_clauses_carry_their_parents(spark):
    got = chunks(
        spark,
        "BASELINE IT SECURITY POLICY CONTENTS\nRef. No.: S17 iii-1\n1. PURPOSE\nNot body.",
        "BASELINE IT SECURITY POLICY PURPOSE\n| border |\nRef. No.: S17 1\n1. PURPOSE\nBody starts here.\nIt goes on.",
        "BASELINE IT SECURITY POLICY PURPOSE\nRef. No.: S17 2\nNext page belongs to it.\n1.1. Scope\n1.1.1 First control text\nmore of it\n2.9.9 Not under this top",
    )
    assert got == [
        ("1", "overview", ["1. PURPOSE"], 2, "Body starts here. It goes on. Next page belongs to it."),
        ("1.1.1", "numbered_clause", ["1. PURPOSE", "1.1. Scope"], 3, "First control text more of it 2.9.9 Not under this top"),
    ]


def test_wrapped_titles_appendices_and_unlabelled_pages(spark):
    got = chunks(spark, "Ref. No.: S17 1\n1. VERY LONG\nTITLE LINE\nBody one.", "APPENDIX D INFORMATION SECURITY\nCOMPLIANCE\nBody two.")
    assert got == [("1", "overview", ["1. VERY LONG TITLE LINE"], 1, "Body one."), ("APPENDIX-D", "overview", ["APPENDIX-D. INFORMATION SECURITY COMPLIANCE"], 2, "Body two.")]


def test_lettered_headings_follow_the_contents(spark):
    got = chunks(
        spark,
        "IT SECURITY GUIDELINES\nRef. No.: G3 iii-1\n14.2 Development\n(a) Secure Coding ..... 30\n(b) Source\nCode Scanning ..... 31\n(c) Training ..... 32",
        "Ref. No.: G3 1\n14. DEVELOPMENT\n14.2 Development\n(a) Secure Coding\nWrite safe code.\n(b) Source Code\nScanning\nScan it.\n(c) Training\nTeach.\n(d) a list item of the body\n13.1 cross reference stays",
        profile=GUIDELINE,
    )
    parents = ["14. DEVELOPMENT", "14.2. Development"]
    assert got == [
        ("14.2(a)", "lettered_clause", parents, 2, "Secure Coding Write safe code."),
        ("14.2(b)", "lettered_clause", parents, 2, "Source Code Scanning Scan it."),
        ("14.2(c)", "lettered_clause", parents, 2, "Training Teach. (d) a list item of the body 13.1 cross reference stays"),
    ]


def test_lettered_titles_wrap_over_any_number_of_lines_but_no_blank_one(spark):
    words = [f"Word{chr(65 + i)}" for i in range(14)]
    contents = "IT SECURITY GUIDELINES\nRef. No.: G3 iii-1\n14.2 Development\n(a) " + "\n".join(words) + " ..... 30\n(b) Source Code ..... 31"
    got = chunks(spark, contents, "Ref. No.: G3 1\n14. DEVELOPMENT\n14.2 Development\n(a) " + "\n".join(words) + "\nBody.\n(b) Source\n\nCode", profile=GUIDELINE)
    assert [(r[0], r[4]) for r in got] == [("14.2(a)", " ".join(words) + " Body."), ("14.2(b)", "Source Code")]


def test_repeated_sections_are_numbered_and_labels_checked(spark):
    p = pages(spark, "Ref. No.: S17 1\n1. TOP\n1.1.1 One\n1.1.1 Again\n\nA new paragraph")
    ids = [r.id for r in st.structural_chunks(ln.body_lines(ln.kept_lines(p))).orderBy("seg").collect()]
    assert ids == ["D-v8.2-1.1.1-clause", "D-v8.2-1.1.1-clause-2"]
    with pytest.raises(checks.CorpusError):
        checked_records(pages(spark, "Ref. No.: G3 1\n1. TOP\nText."))
    with pytest.raises(checks.CorpusError):
        checked_records(pages(spark, "Only a cover"))


def test_breaks_stand_where_blank_lines_lie_between_text(spark):
    got = ln.kept_lines(pages(spark, "\n\nRef. No.: S17 1\none\n\nRef. No.: S17 2\ntwo\nthree\n\n", "four")).orderBy("pdf_page", "line_no").collect()
    assert [(r.line, r.blank_before, r.printed_page) for r in got] == [("one", False, "2"), ("two", True, "2"), ("three", False, "2"), ("four", False, None)]


def test_older_profile_starts_by_page_and_guards_nothing(spark):
    got = chunks(spark, *["front"] * 6, "INFORMATION SECURITY\n1. TOP\n9.9.9 Foreign number\ntext", profile=OLDER)
    assert got == [("9.9.9", "numbered_clause", ["1. TOP"], 7, "Foreign number text")]


def test_long_text_without_sentences_is_cut_by_words_and_loses_none(spark):
    words = [f"word{i}" for i in range(700)]
    got = build_records(pages(spark, "Ref. No.: S17 1\n1. TOP\n" + "\n".join(" ".join(words[i : i + 10]) for i in range(0, 700, 10)))).orderBy("metadata.part_number").collect()
    assert [r.metadata.word_count for r in got] == [220, 220, 220, 40]
    assert {r.metadata.split_method for r in got} == {"word_boundary"}
    assert " ".join(r.text.split("\nText: ")[1] for r in got).split() == words
    assert got[0].text.startswith("Section: 1\nParent sections: 1. TOP\nText: word0 ") and got[0].id == "D-v8.2-1-overview-part-01"


def test_units_packs_and_sentences(spark):
    line = lambda n, c: " ".join([c] * n) + "."
    page = "\n".join(["Ref. No.: S17 1", "1. TOP", "1.1.1 General Rule Heading", "", line(100, "p"), "", line(100, "q"), "", line(90, "r"), "• " + line(30, "b") + " • " + line(40, "c"), "and more", "a) " + line(20, "e"), "", line(150, "s") + " " + line(120, "T")])
    got = build_records(pages(spark, page)).orderBy("metadata.part_number").collect()
    assert [(r.metadata.split_method, r.metadata.word_count) for r in got] == [
        ("paragraph_group", 203), ("paragraph_group", 90), ("bullet_item", 30), ("bullet_item", 42), ("enumerated_item", 21), ("sentence_boundary", 150), ("sentence_boundary", 120),
    ]
    assert [r.metadata.part_count for r in got] == [7] * 7


def test_title_lines_and_word_counts(spark):
    rows = [("Access Control Policy", True), ("Users must Log In", False), ("One", False), ("A sentence. Here", False), ("Roles and Duties of the Board", True), ("see the table below now", False)]
    d = spark.createDataFrame(rows, "t string, w boolean").withColumn("g", is_title_line(F.col("t")))
    assert all(r.g == r.w for r in d.collect())
    assert spark.createDataFrame([("a/b c-d e_f 1.2",)], "t string").select(word_count(F.col("t"))).first()[0] == 6


def test_coverage_and_partition_independence(spark):
    sf = "/root/testdata/sf0.001"
    from leafmill.sources.pages import derived_pages

    chunk = st.structural_chunks(ln.body_lines(ln.kept_lines(derived_pages(spark, sf))))
    records = ps.records(chunk)
    audit = checks.coverage_audit(chunk.withColumn("text", ps.chunk_text(F.col("lines"))), records)
    assert audit.where("problem is not null").isEmpty() and checks.duplicate_ids(records).isEmpty() and checks.oversized_records(records).isEmpty()
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = set()
        for n in (1, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.add(build_records(derived_pages(spark, sf)).agg(F.sum(F.xxhash64("id", "text").cast("decimal(38,0)")), F.count("*")).first())
        assert len(seen) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_one_shuffle_carries_pages_to_records(spark):
    p = pages(spark, "Ref. No.: S17 1\n1. TOP\nText.")
    plan = build_records(p)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_the_contents_come_without_shuffling_lines_again(spark):
    p = pages(spark, "Ref. No.: G3 1\n1. TOP\nText.")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        plan = build_records(p, GUIDELINE)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    # The lines by document, once for the body and once for the contents; the join itself shuffles nothing.
    assert plan.count("Exchange hashpartitioning(document") == plan.count("Exchange ") == 2 and plan.count("SortMergeJoin") == 1


def test_reviews_are_in_document_order(spark):
    page = "Ref. No.: S17 1\n1. TOP\n1.2.1 Two\ntext\n1.10.1 Ten\ntext"
    got = checks.review_rows(build_records(pages(spark, page), place=True)).orderBy("position").collect()
    assert [r.section for r in got] == ["1.2.1", "1.10.1"]


def test_replies_are_put_in_order_by_their_numbers():
    from leafmill.operators.vectors import reply_vectors

    assert reply_vectors([(1, [2.0]), (0, [1.0])], 2) == [[1.0], [2.0]]
    for wrong in ([(0, [1.0]), (0, [1.0])], [(1, [1.0]), (2, [1.0])], [(0, [1.0])], [[1.0]], [[1.0], []]):
        with pytest.raises(ValueError):
            reply_vectors(wrong, 2)


def test_each_text_is_embedded_once(spark, tmp_path):
    from leafmill.operators.vectors import bucket_embedder
    from leafmill.plans.corpus import answer_questions

    log = str(tmp_path / "calls")

    def embed(texts):
        with open(log, "a") as f:
            f.write("x" * len(texts))
        return bucket_embedder(texts)

    records = spark.range(40).selectExpr("cast(id as string) id", "concat('passage number ', id) text")
    questions = spark.range(10).selectExpr("id query_id", "concat('question number ', id) query")
    assert len(answer_questions(records, questions, embed).collect()) == 10
    assert len(open(log).read()) == 50


def test_units_and_packs_cost_in_proportion_to_a_chunk(spark):
    import time

    def seconds(n):
        line = F.when(F.col("id") % 3 == 0, F.concat(F.lit("• bullet words "), F.col("id").cast("string"))).otherwise(F.lit("Plain body words here."))
        d = spark.range(n).coalesce(1).select("id", F.struct(line.alias("line"), (F.col("id") % 2 == 0).alias("blank_before")).alias("x")).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "x"))), lambda y: y["x"]).alias("lines"))
        d = d.select("lines", F.lit("D").alias("document"), F.lit(1).alias("seg")).cache()
        d.count()
        began = time.time()
        units = ps.semantic_units(d)
        got = units.select(F.size("units").alias("u"), F.size(ps.packed(F.col("units"), "paragraph", "paragraph_group")).alias("p")).first()
        d.unpersist()
        assert got.u > n // 2 and got.p > n // 3
        return time.time() - began

    seconds(1_000)
    assert seconds(40_000) < 8 * seconds(10_000)


def test_wrapped_letters_cost_in_proportion_to_a_paragraph(spark):
    import time

    from leafmill.operators.structure import lettered

    def seconds(n):
        i = F.col("id")
        line = F.when(i % 3 == 0, F.concat(F.lit("(b) Title "), i.cast("string"))).when(i % 3 == 1, F.lit("Goes On")).otherwise(F.lit("Then Ends"))
        rows = spark.range(n).coalesce(1).select(F.lit("D").alias("document"), F.lit(1).alias("pdf_page"), i.alias("line_no"), line.alias("line"), F.lit(False).alias("blank_before"), F.lit("body").alias("line_class"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("title"))
        rows = rows.withColumn("cur_sub", F.concat(F.lit("1."), (F.col("line_no") - F.col("line_no") % 3).cast("string"))).cache()
        toc = rows.where("line_no % 3 = 0").select("document", F.format_string("%s(b)", "cur_sub").alias("key"), F.concat(F.lit("title "), F.col("line_no").cast("string"), F.lit(" goes on then")).alias("toc_title"))
        rows.count()
        began = time.time()
        got = lettered(rows, toc).orderBy("line_no").limit(4).collect(), lettered(rows, toc).agg(F.count("*")).first()[0]
        rows.unpersist()
        assert [(r.line_class, r.title, r.line) for r in got[0][:3]] == [("letter", "Title 0 Goes On", "(b) Title 0"), ("body", None, "Then Ends"), ("letter", "Title 3 Goes On", "(b) Title 3")]
        assert got[1] == n // 3 * 2
        return time.time() - began

    seconds(999)
    assert seconds(12_000) < 8 * seconds(3_000)


def test_hashes_of_parts_combine_to_the_whole(spark):
    from leafmill.operators.checks import hash_of_parts, sequence_hash

    cases = [("one two • three", ["one two", "• three"], True), ("a(b c", ["a", "(b", "c"], True), ("é-x 1/2.", ["é-", "x", "1/2."], True), ("", [], True), ("one two", ["two", "one"], False), ("one", ["one", "one"], False), ("a b", ["a"], False), ("a\nb", ["a b"], True), ("ab", ["a", "b"], False)]
    d = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, whole string, parts array<string>, same boolean")
    got = d.select("i", "same", (hash_of_parts(F.array(sequence_hash(F.col("whole")))) == hash_of_parts(F.transform("parts", sequence_hash))).alias("equal")).collect()
    assert all(r.same == r.equal for r in got), got
