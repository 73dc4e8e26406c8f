"""Golden values and small frames for the library's own operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpuslake.functions import metadata as md
from corpuslake.functions import text
from corpuslake.operators import bm25, chunk, classify, context, coverage, dense, fuse, generate, graph, history, metrics, route
from corpuslake.sources import chunks as chunk_table
from corpuslake.sources import html, intake
from corpuslake.streaming import stream


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


def test_clean_pages(spark):
    rows = [(1, "A ​B​C"), (2, "a\r\n\r\n\r\n\r\nb  \tc \n d"), (3, None), (4, "ﬁne"), (5, "")]
    out = {r["i"]: r["text"] for r in text.clean_pages(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert out == {1: "A BC", 2: "a\n\nb c\nd", 3: "", 4: "fine", 5: ""}


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (text.tokens, "Regulation 12 says CSIT 325 on 2024-05-01", ["regulation", "12", "says", "csit", "325", "2024", "05", "01"]),
        (text.tokens, None, []),
        (text.clean_title, "  - A  b:  ", "A b"),
        (text.clean_title, " .:", None),
        (text.session_title, "   ", "New conversation"),
        (text.session_title, "word " * 30, "word " * 10 + "word..."),
        (text.expand_aliases, "books for DBMS and dsa", "books for Database Management System and Data Structures and Algorithms"),
        (text.name_key, "  Data   Base ", "data base"),
        (text.loose_name_key, "Data-Base, X", "data base x"),
        (text.mask_sensitive, "my Password is", "***"),
        (lambda c: text.redirect_target(c, "r.example", "uddg"), "//r.example/l/?uddg=https%3A%2F%2Fwww.python.org%2Fdownloads%2F&amp;rut=1", "https://www.python.org/downloads/"),
        (lambda c: text.redirect_target(c, "r.example", "uddg"), "https://other.org/?uddg=x", "https://other.org/?uddg=x"),
        (md.roman_to_int, "XIV", 14),
        (md.roman_to_int, "ABC", None),
        (md.semester, "Semester IV and 5th semester, Fifth Semester", 5),
        (md.semester, "none", None),
        (md.year, "in 1850 and 2023", 2023),
        (md.academic_year, "for 2080/2081", "2080/2081"),
        (md.academic_year, "on 2024-05-01", None),
        (md.subject_code, "code BCS-502", "BCS-502"),
        (md.subject_code, "CSC301", "CSC-301"),
        (md.marks, "Q (10 marks)", 10),
        (md.university, "at Hill Top University now", "at Hill Top University"),
        (md.program, "Bachelor of Computer Science", "Bachelor of Computer Science"),
        (md.author, "x\nby Jane Doe", "Jane Doe"),
        (md.syllabus_subject, "Database Management System Syllabus", "Database Management System"),
        (md.past_paper_subject, "Full Marks: 60\nOperating Systems", "Operating Systems"),
        (md.first_substantial_line, "\n12.3\nA title here", "A title here"),
        (md.notice_subject, "x\nSubject: Holiday on Friday.", "Holiday on Friday"),
        (md.question_topic, "Explain normalization with examples.", "normalization"),
        (generate.syllabus_topics, "Unit 1: Sets\nUnit II - Maps\nUnit 1: Sets", ["Sets", "Maps"]),
        (generate.syllabus_topics, "Normalization\nsmall\nTransaction Processing", ["Normalization", "Transaction Processing"]),
        (html.plain_text, "<p>a &amp; <b>b</b></p><script>x</script>", "a & b"),
        (lambda c: classify.pick_type(classify.scores(c)), "Database Syllabus Unit 1", "syllabus"),
        (lambda c: classify.pick_type(classify.scores(c)), "nothing", "unknown"),
        (lambda c: classify.pick_type(classify.scores(c)), None, "unknown"),
    ],
)
def test_text_functions(spark, fn, value, want):
    assert one(spark, fn, value) == want


def test_questions_and_chapters(spark):
    docs = spark.createDataFrame([("d", "intro\nQ1. Explain sets\nwith care (5 marks)\n2) Define maps. Marks: 3")], "document_id string, text string")
    out = [tuple(r) for r in generate.questions(docs).orderBy("pos").collect()]
    assert out == [("d", 1, 1, "Explain sets with care", 5), ("d", 2, 2, "Define maps.", 3)]
    book = spark.createDataFrame([("b", "Chapter 1: Sets\n1.1 Unions\n1.2 Cuts\nChapter I: Sets\n2. Maps ..... 7")], "document_id string, text string")
    rows = generate.chapter_subtopics(generate.chapters(book), generate.subtopics(book)).orderBy("pos").collect()
    assert [(r["chapter_number"], r["title"], r["subtopics"]) for r in rows] == [(1, "Sets", ["Unions", "Cuts"]), (2, "Maps", [])]


META = "document_id string, document_type string, title string, author string, semester int, subject string, subject_code string, academic_year string, marks int, question_number int"


def test_chunks_overlap_and_headings(spark):
    page = "Unit 1: A\nsome text about A\nUnit 2: B\nsome text about B\nUnit 3: C\nsome text about C"
    pages = spark.createDataFrame([("s", "syllabus", 1, page)], "document_id string, document_type string, page int, text string")
    topics = spark.createDataFrame([], "document_id string, topic string")
    meta = spark.createDataFrame([("s", "syllabus", "T", None, 3, "S", "X-1", None, None, None)], META)
    out = chunk.chunk(chunk.blocks(pages, topics), meta, 50, 30).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in out] == ["s:0000", "s:0001", "s:0002"]
    assert [("some text about B" in r["text"]) for r in out] == [False, True, True]
    assert out[0]["text"].startswith("A\n\nUnit 1: A\nsome text about A") and out[0]["semester"] == 3


def test_long_blocks_are_split_without_loss(spark):
    body = " ".join(f"Sentence number {i} ends here." for i in range(200))
    pages = spark.createDataFrame([("d", "unknown", 1, body), ("e", "unknown", 1, ""), ("f", "unknown", 1, None)], "document_id string, document_type string, page int, text string")
    meta = spark.createDataFrame([("d", "unknown", *[None] * 8)], META)
    out = chunk.chunk(chunk.blocks(pages, spark.createDataFrame([], "document_id string, topic string")), meta, 300, 0).orderBy("chunk_id").collect()
    assert {r["document_id"] for r in out} == {"d"} and " ".join(r["text"] for r in out) == body
    assert max(len(r["text"]) for r in out) <= 300


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha gamma"), (3, None), (4, "alpha beta")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "beta"), (2, "zeta"), (3, " "), (4, None)], "query_id int, text string")
    out = bm25.bm25_topk(asked, docs, 5).collect()
    assert [(r["query_id"], r["rank"], r["doc_id"]) for r in sorted(out)] == [(1, 1, 1), (1, 2, 4)]
    with pytest.raises(ValueError):
        bm25.bm25_topk(asked, docs, 0)


def test_dense_and_fusion(spark):
    rows = spark.createDataFrame([(i, [float(i == 0), float(i == 1), 1.0], "a" if i % 2 else "b") for i in range(6)] + [(9, None, "a"), (8, [0.0] * 3, "a")], "vec_id int, embedding array<double>, collection string")
    asked = spark.createDataFrame([(7, [1.0, 0.0, 1.0])], "query_id int, vector array<double>")
    out = dense.merged_topk(dense.dense_topk(asked, rows, 2, groups=("collection",)), 3).orderBy("rank").collect()
    assert [r["id"] for r in out] == [0, 2, 3] and out[0]["score"] == 1.0
    d = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.5)], "query_id int, doc_id int, rank int, score double")
    s = spark.createDataFrame([(1, 11, 1, 7.0), (1, 12, 2, 3.0)], "query_id int, doc_id int, rank int, score double")
    fused = {r["doc_id"]: r["rrf"] for r in fuse.fuse(d, s).collect()}
    assert fused[11] == pytest.approx(1 / 61 + 1 / 62) and fused[11] > fused[10] > fused[12]
    assert [r["doc_id"] for r in fuse.rerank(fuse.fuse(d, s), 2).orderBy("rank").collect()] == [11, 10]
    docs = spark.createDataFrame([(1, "same words"), (2, "same words"), (3, "")], "doc_id int, text string")
    pairs = dense.cosine_pairs(docs, docs, 1e-9).where("left_id = 1").collect()
    assert {r["right_id"]: round(r["cosine"], 9) for r in pairs} == {1: 1.0, 2: 1.0}


def test_routing(spark):
    cases = [
        ("Which subjects are in semester 5?", "GRAPH"), ("topics of Database Systems", "GRAPH"), ("subtopics of Normalization", "GRAPH"),
        ("past questions about normalization", "GRAPH"), ("which subjects cover normalization", "GRAPH"), ("explain regulation 12", "HYBRID"),
        ("CSIT 325 details", "HYBRID"), ("exam on 2024-05-01", "HYBRID"), ("topics of 5", "NORMAL"), ("latest python release", "WEB"),
        ("latest exam dates", "WEB"), ("how does hashing work", "NORMAL"), (" ", "NORMAL"), (None, "NORMAL"),
    ]
    asked = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "query_id int, text string")
    out = route.plan(asked).orderBy("query_id").collect()
    assert [r["strategy"] for r in out] == [s for _, s in cases]
    assert [r["fallback"] for r in out] == [False] * 12 + [True] * 2 and out[10]["mixed"] and not out[9]["mixed"]
    replies = spark.createDataFrame([(11, '{"strategy": "hybrid", "confidence": 0.9}'), (12, '{"strategy": "odd"}'), (13, "x")], "query_id int, raw string")
    again = {r["query_id"]: r["strategy"] for r in route.plan(asked, route.model_verdicts(replies)).collect()}
    assert again[11] == "HYBRID" and again[12] == "NORMAL"
    hits = spark.createDataFrame([(5, 1, "rules_regulations"), (5, 2, "notice"), (11, 1, "notice")], "query_id int, rank int, document_type string")
    kept = route.filter_by_type(hits, route.plan(asked)).collect()
    assert sorted((r["query_id"], r["rank"]) for r in kept) == [(5, 1), (11, 1)]
    web = spark.createDataFrame([(9, 1, "u", 1.0), (10, 1, "u", 1.0)], "query_id int, rank int, doc_id string, score double")
    inner = spark.createDataFrame([(9, 1, "d", 0.5), (10, 1, "d", 0.5)], "query_id int, rank int, doc_id string, score double")
    status = spark.createDataFrame([(9, True), (10, True)], "query_id int, ok boolean")
    plans = route.plan(asked).where("strategy = 'WEB'")
    both = route.web_branch(plans, status, web, inner).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in both] == [(9, "u"), (10, "d"), (10, "u")]
    failed = route.web_branch(plans, status.where("query_id = 10"), web, inner).where("query_id = 9").collect()
    assert [(r["doc_id"], r["fallback"]) for r in failed] == [("d", True)]


def test_graph_drops_edges_without_ends(spark):
    nodes = spark.createDataFrame([("Subject", "s", "S", "d1", 1, 0), ("Topic", "t", "T", "d2", 5, 0)], "label string, key string, name string, document_id string, ingest_seq int, pos int")
    edge = "type string, start_label string, start_key string, end_label string, end_key string, document_id string, ingest_seq int, pos int"
    edges = spark.createDataFrame([("HAS_TOPIC", "Subject", "s", "Topic", "t", "d1", 1, 0), ("HAS_TOPIC", "Subject", "s", "Topic", "x", "d1", 9, 0), ("ODD", "Subject", "s", "Topic", "t", "d3", 9, 0)], edge)
    assert graph.merge(nodes, edges)[1].count() == 0
    late = edges.withColumn("ingest_seq", F.lit(9))
    kept = graph.merge(nodes, late)
    assert [r["end_key"] for r in kept[1].collect()] == ["t"]
    asked = spark.createDataFrame([(1, " S ")], "query_id int, value string")
    assert [tuple(r) for r in graph.hop("topics_of_subject", asked, *kept).collect()] == [(1, "t", "T")]
    counts = {(r["kind"], r["name"]): r["n"] for r in graph.summary(*kept).collect()}
    assert counts["node", "Topic"] == 1 and counts["edge", "ABOUT"] == 0 and len(counts) == 14


def test_coverage_weights_and_near_names(spark):
    required = spark.createDataFrame([(1, "topic", "Normalization", 1), (1, "topic", "Sets", 2), (1, "topic", "Maps", 3), (1, "topic", "Locks", 4), (1, "subtopic", "A b", 1), (1, "subtopic", "C d", 2)], "query_id int, kind string, name string, pos int")
    books = spark.createDataFrame([("b", "topic", "Database Normalization"), ("b", "topic", "sets"), ("b", "topic", "Maps!"), ("b", "subtopic", "a b"), ("b", "subtopic", "c d"), ("c", "topic", "Other")], "document_id string, kind string, name string")
    out = coverage.coverage(required, coverage.matches(required, books)).collect()
    assert [(r["document_id"], r["score"], r["matched"], r["missing"]) for r in out] == [("b", 0.7875, ["Normalization", "Sets", "Maps"], ["Locks"])]
    titles = spark.createDataFrame([("b", "Book")], "document_id string, title string")
    ranked = coverage.rank_books(coverage.coverage(required, coverage.matches(required, books)), titles)
    assert ranked.first()["rank"] == 1 and coverage.violations(ranked).count() == 0 and "79%" in coverage.summary_text(ranked).first()["summary"]


def test_history_and_context_budgets(spark):
    said = spark.createDataFrame([("s", i, "user", "x" * n) for i, n in enumerate((5, 50, 10, 500))], "session_id string, turn int, role string, text string")
    assert history.history_within(said, 100).first()["n_lines"] == 1
    assert history.history_within(said.where("turn < 3"), 80).first()["history"] == "user: " + "x" * 50 + "\nuser: " + "x" * 10
    hits = spark.createDataFrame([(1, i + 1, "b" * n) for i, n in enumerate((30, 30, 100, 5))], "query_id int, rank int, block string")
    asked = spark.createDataFrame([(1, "q"), (2, "r")], "query_id int, text string")
    out = {r["query_id"]: r for r in context.contexts(hits, asked, 70).collect()}
    assert out[1]["n_sources"] == 2 and out[2]["context"] == context.EMPTY_NOTE
    sessions = spark.createDataFrame([("s", "t", dt.datetime(2024, 1, 1))], "session_id string, title string, updated_at timestamp")
    new = spark.createDataFrame([("s", "user", dt.datetime(2024, 1, 2)), ("s", "odd", dt.datetime(2024, 1, 3)), ("z", "user", dt.datetime(2024, 1, 3))], "session_id string, role string, created_at timestamp")
    accepted, rejected, moved = history.append_messages(sessions, new)
    assert (accepted.count(), rejected.count(), moved.first()["updated_at"]) == (1, 2, dt.datetime(2024, 1, 2))


def test_measures(spark):
    hits = spark.createDataFrame([(1, 1, 9), (1, 2, 5), (1, 3, 5)], "query_id int, rank int, doc_id int")
    qrels = spark.createDataFrame([(1, 5), (1, 6), (2, 1)], "query_id int, doc_id int")
    out = {r["query_id"]: tuple(r)[1:] for r in metrics.retrieval_metrics(hits, qrels, 3).collect()}
    assert out == {1: (0.5, pytest.approx(1 / 3), 0.5), 2: (0.0, 0.0, 0.0)}
    assert one(spark, lambda c: metrics.citations_valid(c, F.lit(2)), "a [Source 2]") is True
    assert one(spark, lambda c: metrics.citations_valid(c, F.lit(2)), "a [Source 3]") is False
    assert one(spark, lambda c: metrics.faithfulness(c, F.lit("one two three four five")), "two three four five six") == 0.5


def test_intake_and_replies(spark):
    files = spark.createDataFrame([("a.pdf", 4, b"%PDF"), ("b.txt", 4, b"%PDF"), ("c.pdf", 0, b""), ("d.pdf", 9, b"%PDF"), ("e.pdf", 4, b"nope")], "path string, length long, content binary")
    assert [r["reject_reason"] for r in intake.checked(files, max_bytes=8).orderBy("path").collect()] == [None, "unsupported extension", "empty file", "too large", "not a PDF"]
    replies = spark.createDataFrame([("a", '```json\n{"title": "T", "semester": 3}\n```'), ("b", "no"), ("c", '{"semester": "x"}'), ("d", None)], "document_id string, raw string")
    out = {r["document_id"]: r for r in intake.parse_replies(replies).collect()}
    assert out["a"]["reply"]["title"] == "T" and out["a"]["error"] is None
    assert all(out[k]["error"] for k in "bcd")
    pages = spark.createDataFrame([("d", 2, None, "bad"), ("d", 1, "x", None)], "document_id string, page_number int, text string, error string")
    row = intake.build_documents(pages).first()
    assert (row["page_count"], row["text"], row["page_errors"][0]["error"]) == (2, "x\n", "bad")


def test_throttle_and_upsert(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("k", at + dt.timedelta(seconds=s), i) for i, s in enumerate((0, 1, 2, 10, 11))]
    events = spark.createDataFrame(rows, "key string, ts timestamp, event_id long")
    out = [(r["allowed"], r["retry_after"]) for r in stream.throttle(events, 2, 10.0).orderBy("event_id").collect()]
    assert out == [(True, 0.0), (True, 0.0), (False, 8.0), (True, 0.0), (True, 0.0)]
    new = spark.createDataFrame([("a:0", "x", "one two"), ("a:1", "y", "two")], "chunk_id string, collection string, text string")
    path = str(tmp_path / "index")
    nodes = spark.createDataFrame([("Topic", "a")], "label string, key string")
    for _ in range(2):  # run again, nothing changes
        stream.index_batch(new, path, 5, nodes)
    assert stream.read_index(spark, path).count() == 2 and stream.read_index(spark, path, "nodes").count() == 1
    stream.index_batch(spark.createDataFrame([("a:0", "x", "three")], new.schema), path)  # a newer text in place of the older
    kept = stream.read_index(spark, path)
    assert {r["chunk_id"]: r["text"] for r in kept.collect()} == {"a:0": "three", "a:1": "two"}
    assert {(r["doc_id"], r["term"]) for r in stream.read_index(spark, path, "postings").collect()} == {("a:0", "three"), ("a:1", "two")}
    assert sorted(r["version"] for r in stream.versions(spark, path).collect()) == [5, 6]
    assert {r["collection"]: r["n"] for r in chunk_table.collection_counts(kept).collect()} == {"x": 1, "y": 1}


def test_no_cartesian_product_and_no_python_in_search(spark):
    docs = spark.createDataFrame([(1, "alpha beta")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "beta")], "query_id int, text string")
    plan = bm25.bm25_topk(asked, docs)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan


def test_vectors_without_direction_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [0.0, 0.0]), (5, [1.0, 1.0]), (6, None), (7, [1.0]), (8, [-1.0, 0.0])], "vec_id int, embedding array<double>")
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [nan, 0.0]), ("c", [0.0, -inf])], "query_id string, vector array<double>")
    out = [(r["query_id"], r["rank"], r["id"], r["score"]) for r in dense.dense_topk(asked, rows, 5).orderBy("rank").collect()]
    assert out == [("a", 1, 1, 1.0), ("a", 2, 5, 0.707107), ("a", 3, 8, -1.0)]
    assert dense.dense_topk(asked.where("query_id = 'b'"), rows, 5).count() == 0
    assert dense.dense_topk(asked, rows.where("vec_id = 2"), 5).count() == 0


def test_question_and_book_blocks(spark):
    pages = [("q", "past_question", 1, "Full Marks: 60\nQ1. Explain trees. (5 marks)\nwith figures\n2) Define heaps, briefly\n(3) State a law"), ("q", "past_question", 2, "   \n"), ("b", "library_book", 1, "A Book\nChapter 2: Trees\nText.\n2.1 Heaps\nMore.\nChapter III\nLast.")]
    df = spark.createDataFrame(pages, "document_id string, document_type string, page int, text string")
    topics = spark.createDataFrame([], "document_id string, topic string")
    out = {(r["document_id"], r["pos"]): r for r in chunk.blocks(df, topics).collect()}
    q = [out["q", i] for i in range(4)]
    assert [(r["question_number"], r["topic"], r["marks"], r["section"]) for r in q] == [(None, None, None, None), (1, "trees", 5, "question"), (2, "heaps", None, "question"), (3, "a law", None, "question")]
    assert q[1]["text"] == "Q1. Explain trees. (5 marks)\nwith figures" and ("q", 4) not in out
    b = [out["b", i] for i in range(4)]
    assert [(r["topic"], r["subtopic"]) for r in b] == [(None, None), ("Trees", None), ("Trees", "Heaps"), (None, None)]


def test_long_blocks_are_cut_at_sentences(spark):
    text = "One two three. Four five! " + "x" * 50 + " Six? Seven."
    pages = spark.createDataFrame([("d", "unknown", 1, text), ("e", "unknown", 1, None), ("f", "unknown", 1, "short\n\nalso short")], "document_id string, document_type string, page int, text string")
    out = [(r["document_id"], r["text"]) for r in chunk.chunk_pages(pages, 30, 0).orderBy("chunk_id").collect()]
    assert out == [("d", "One two three. Four five!"), ("d", "x" * 50 + " Six?"), ("d", "Seven."), ("f", "short\n\nalso short")]
    with pytest.raises(ValueError):
        chunk.chunk_pages(pages, 0, 0)


def test_answers_that_cite_or_invent(spark):
    rows = [
        (1, "According to [Source 1]: alpha beta gamma delta epsilon", ["alpha beta gamma delta epsilon zeta"]),
        (2, "alpha beta gamma delta nothing of it [Source 2]", ["alpha beta gamma delta"]),
        (3, "There is not sufficient information.", []),
        (4, "Surely so it is, and ever was.", []),
        (5, "too short", ["too short"]),
    ]
    out = {r["query_id"]: tuple(r)[1:] for r in metrics.answer_checks(spark.createDataFrame(rows, "query_id int, answer string, sources array<string>")).collect()}
    assert out == {1: (1, 1.0, True, False), 2: (1, 0.25, False, True), 3: (0, 0.0, False, False), 4: (0, 0.0, False, True), 5: (1, 0.0, False, False)}


def test_rules_and_web_blocks(spark):
    rules = spark.createDataFrame([(2, ["Python", "version"]), (1, ["version", "java"]), (3, [])], "rule_no int, words array<string>")
    asked = spark.createDataFrame([(1, "which Python version?"), (2, "java version of python"), (3, "pythonversion"), (4, None)], "query_id int, text string")
    assert {tuple(r) for r in route.first_rule(asked, rules).collect()} == {(1, 2), (2, 1)}
    web = spark.createDataFrame([(1, 1, "T", "http://u", "now", "x" * 30), (1, 2, None, "http://v", None, "y" * 30), (1, 3, "Z", "http://w", None, "z" * 30)], "query_id int, rank int, title string, url string, retrieved_at string, text string")
    out = {r["query_id"]: (r["n_sources"], r["context"]) for r in context.web_contexts(web, asked, 130).collect()}
    assert out[1] == (2, "[Web 1] T (http://u), retrieved now\n" + "x" * 30 + "\n\n[Web 2] Web result (http://v)\n" + "y" * 30)
    assert out[2] == (0, context.EMPTY_NOTE)
    titles = spark.createDataFrame([("d1", "T"), ("d0", "T")], "id string, known_title string")
    hits = spark.createDataFrame([(1, "own", "T", "c"), (2, None, "T", "c"), (3, "", "U", "c"), (4, None, None, "c")], "n int, document_id string, title string, collection string")
    assert {r["n"]: r["doc"] for r in metrics.hit_documents(hits, titles).collect()} == {1: "own", 2: "d0", 3: "U", 4: "c"}


def test_recommendation_from_question_to_books(spark):
    asked = spark.createDataFrame([(1, "books for dbms"), (2, "cooking"), (3, " ")], "query_id int, text string")
    hits = [(1, 1, 0.9, "Database Management System tables", "syllabus", "DB", "Normalization", None), (1, 2, 0.5, "joins", "syllabus", "DB", "Joins", None), (1, 3, 0.4, "a book", "library_book", None, "x", None), (2, 1, 0.001, "nothing shared", "syllabus", "DB", "Joins", None)]
    found = spark.createDataFrame(hits, "query_id int, rank int, score double, text string, document_type string, subject string, topic string, subtopic string")
    drawn = spark.createDataFrame([("db", "topic", "Indexes", 1), ("db", "topic", "Joins", 2), ("other", "topic", "Zoo", 1)], "subject_key string, kind string, name string, pos int")
    profiles = spark.createDataFrame([("b1", "topic", "Database Normalization"), ("b1", "topic", "joins!"), ("b2", "topic", "Joins"), ("b3", "topic", "Zoo")], "document_id string, kind string, name string")
    titles = spark.createDataFrame([("b1", "First"), ("b2", "Second"), ("b3", "Third")], "document_id string, title string")
    out = coverage.recommend(asked, found, drawn, profiles, titles).collect()
    rows = sorted((r["query_id"], r["rank"] or 0, r["title"], r["no_syllabus_evidence"], r["score"], r["matched"], r["missing"]) for r in out)
    assert rows == [
        (1, 1, "First", False, round(0.85 * 2 / 3, 4), ["Normalization", "Joins"], ["Indexes"]),
        (1, 2, "Second", False, round(0.85 / 3, 4), ["Joins"], ["Normalization", "Indexes"]),
        (2, 0, None, True, None, None, None),
        (3, 0, None, True, None, None, None),
    ]


def test_dense_search_of_extreme_vectors_and_other_dimensions(spark):
    asked = spark.createDataFrame([(1, [1e-170, 0.0]), (2, [1e200, 1e200]), (3, [0.0, 3.0]), (4, [1.0, 2.0, 3.0])], "query_id long, vector array<double>")
    rows = spark.createDataFrame([(10, [1.0, 0.0]), (11, [1e250, 1e250]), (12, [0.0, 1e-300]), (13, [1.0]), (14, [1.0, 0.0, 0.0]), (15, [-1e-200, 0.0])], "vec_id long, embedding array<double>")
    out = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in dense.dense_topk(asked, rows, 1).collect()}
    assert out == {(1, 1): (10, 1.0), (2, 1): (11, 1.0), (3, 1): (12, 1.0)}  # the question of another dimension has no hits, as rows of one take no part
