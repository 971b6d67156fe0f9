"""Rules by case: grading, submissions, mastery, busy sessions, recovered pages, citations; with nulls, ties, two owners of one id, and empty tables."""

from datetime import datetime

import pytest

from lectern.operators import grading, learning, records, retrieval

GRADED = "n int, type string, selected array<string>, accepted array<array<string>>"


def test_grading_by_type(spark):
    cases = [
        ("matching", ["x", "y"], [["y"], ["x"]], False), ("matching", [" y", "X"], [["y"], ["x"]], True), ("matching", ["", None], [["a"], ["b"]], False),
        ("single_choice", ["a"], [["A"]], True), ("single_choice", [], [["A"]], False), ("single_choice", None, [["A"]], False), ("single_choice", ["B"], [["A"]], False),
        ("multi_select", ["c", "A", "c"], [["A", "C"]], True), ("multi_select", ["A"], [["A", "C"]], False),
        ("fill_blank", ['  "The  Kernel". '], [["kernel", "the kernel"]], True), ("fill_blank", ["ﬁle"], [["FILE"]], True), ("fill_blank", ["..."], [["..."]], False), ("fill_blank", ["STRASSE"], [["straße"]], True),
        ("short_answer", ["(Paging)"], [["paging"]], True), ("short_answer", [None], [["paging"]], False),
        ("multi_blank", ["One", "two."], [["one"], ["deux", "TWO"]], True), ("multi_blank", ["One", ""], [["one"], ["two"]], False), ("multi_blank", ["One"], [["one"], ["two"]], False), ("multi_blank", ["two", "one"], [["one"], ["two"]], False),
    ]
    df = spark.createDataFrame([(k, t, s, a) for k, (t, s, a, _) in enumerate(cases)], GRADED)
    assert {r.n: r.is_correct for r in grading.grade(df).collect()} == {k: want for k, (*_, want) in enumerate(cases)}
    assert grading.grade(df.limit(0)).collect() == []


def test_submission_rules(spark):
    attempts = spark.createDataFrame([(1, "q", False), (2, "q", True)], "attempt_id long, quiz_id string, allow_unanswered boolean")
    types = [("single_choice", 2), ("multi_select", 4), ("fill_blank", 1), ("matching", 2), ("multi_blank", 2), ("short_answer", 1)]
    questions = spark.createDataFrame([("q", k, t, n) for k, (t, n) in enumerate(types)], "quiz_id string, question_id int, type string, parts int")

    def faults(*given, attempt=1):
        df = spark.createDataFrame([(attempt, k, v) for k, v in given], "attempt_id long, question_id int, selected array<string>")
        return {r.question_id: r.fault for r in grading.submission_faults(attempts.where(f"attempt_id = {attempt}"), questions, df).collect()}

    whole = [(0, ["a"]), (1, ["A", "D"]), (2, ["x"]), (3, ["b", "A"]), (4, ["x", ""]), (5, ["y" * 1000])]
    assert faults(*whole) == {} == faults(attempt=2, *whole)
    assert faults(attempt=2) == {} and set(faults().values()) == {"unanswered"}
    assert faults(*whole[1:], (0, ["C"]), (9, ["A"])) == {0: "unknown_option", 9: "not_in_quiz"}
    assert faults(*whole[1:], (0, ["A", "B"])) == {0: "one_answer_needed"}
    assert faults(*whole[:2], (2, ["x" * 201]), (3, ["A"]), (4, ["a", "b", "c"]), (5, ["a", "b"])) == {2: "too_long", 3: "not_all_pairs", 4: "not_all_blanks", 5: "not_one_text"}


ANSWER = "attempt_id long, question_id int, topic_id long, is_correct boolean, question_difficulty string, validation_outcome string, concept_id string, assessment_capacity int, concept_origin string, concept_plan_id string"
ATTEMPT = "attempt_id long, student_id long, document_id string, quiz_id string, submitted_at timestamp, completed boolean"


def mastery(spark, answers, attempts=((1, 7, "d", "q", datetime(2026, 1, 1), True),)):
    return {(r.student_id, r.document_id, r.topic_id): r for r in learning.topic_mastery(spark.createDataFrame(answers, ANSWER), spark.createDataFrame(list(attempts), ATTEMPT)).collect()}


def test_mastery_weights_and_concepts(spark):
    rows = [(1, 1, 1, True, "Difficult", "accepted", "c", 0, None, None), (1, 2, 1, True, "easy", None, " ", 0, None, None), (1, 3, 1, False, "EASY", "accepted", None, 0, "", "")]
    r = mastery(spark, rows)[7, "d", 1]
    assert (r.score, r.level, r.concepts, r.sufficient, r.required, r.coverage) == (75.0, "Proficient", 1, True, 0, 0.0)
    rows = [(1, k, 1, True, "medium", "accepted_quality_warning", f"c{k % 2}", 4, None, None) for k in range(6)]
    r = mastery(spark, rows)[7, "d", 1]
    assert (r.concepts, r.required, r.coverage, r.level) == (2, 3, 0.5, "Insufficient evidence")


def test_mastery_evidence(spark):
    attempts = [(k, 7, "d", "q", datetime(2026, 1, k), True) for k in (1, 2, 3)] + [(4, 7, "d", "q", None, True), (5, 7, "d", "q", datetime(2026, 1, 5), False), (6, 8, "d", "q", datetime(2026, 1, 1), True)]
    row = lambda a, q, ok, plan=None, origin=None: (a, q, 1, ok, "easy", "accepted", f"c{q}", 0, origin, plan)
    # The newest response to a question counts; open and unsubmitted attempts don't, nor does practice on cards.
    r = mastery(spark, [row(1, 1, False), row(2, 1, True), row(4, 1, False), row(5, 1, False), row(3, 2, False, origin="flashcard"), row(6, 1, False)], attempts)
    assert (r[7, "d", 1].answered, r[7, "d", 1].correct, r[8, "d", 1].correct) == (1, 1, 0)
    # Under plans, only the newest plan's answers count.
    r = mastery(spark, [row(1, 1, False, "old"), row(2, 2, True, "new"), row(3, 3, False, " ")], attempts)[7, "d", 1]
    assert (r.answered, r.correct) == (1, 1)
    assert mastery(spark, []) == {}


def test_busy_by_plan(spark):
    sessions = spark.createDataFrame([(1, "a", 1, "scheduled"), (1, "b", 2, "scheduled"), (1, "b", 3, "completed"), (2, "a", 4, "scheduled"), (1, "c", 5, "in_progress"), (1, "a", 6, "skipped")], "owner_id int, plan_id string, session_id int, status string")
    plans = spark.createDataFrame([(1, "a", "active"), (1, "b", "paused"), (2, "a", "paused"), (1, "c", "archived")], "owner_id int, plan_id string, plan_status string")
    assert sorted(r.session_id for r in records.busy(sessions, plans).collect()) == [1, 3, 5]


def test_recovered_pages(spark):
    pages = spark.createDataFrame([(1, 0, "a longer layer"), (1, 2, "x"), (1, 4, "")], "document_id int, page int, content string")
    found = spark.createDataFrame([(1, 0, "short"), (1, 1, "scanned"), (1, 2, "xy"), (1, 3, ""), (2, 0, None)], "document_id int, page int, recovered string")
    assert sorted((r.document_id, r.page, r.replaced) for r in records.merged_pages(pages, found).collect()) == [(1, 0, False), (1, 1, True), (1, 2, True), (1, 4, False)]


def test_citations_one_for_each_hit(spark):
    hits = spark.createDataFrame([("q", 1, 10), ("q", 2, 11), ("q", 3, 12)], "query_id string, rank int, vec_id int")
    texts = spark.createDataFrame([(10, "a/b/Book.pdf", 3, "one"), (11, "a/b/Book.pdf", None, "two"), (12, None, 1, None)], "vec_id int, source string, page int, content string")
    got = retrieval.citations(hits, texts).orderBy("source_id").collect()
    assert [(r.source_id, r.title, r.page, r.content) for r in got] == [(1, "Book.pdf", "3", "one"), (2, "Book.pdf", "Unknown page", "two"), (3, "Unknown source", "1", "")]
    assert len({r.context_hash for r in got}) == 1


@pytest.mark.parametrize("text,form", [(None, ""), ("  A  b.", "a b"), ("“Ünï”", "ünï"), ("(x)", "x"), ("½", "1⁄2")])
def test_answer_form(text, form):
    from lectern.functions.text import answer_form

    assert answer_form(text) == form


def test_quiz_documents_round_trip(spark):
    from lectern.operators import quizdocs

    q = lambda i, text, options, answer, kind=None: (i, text, options, answer, None, kind, None, None, None, None, None)
    rows = [("a", "d", "easy", "", None, [q(5, "one", ["x", "y"], "b"), q(None, "two", None, " Text ", "fill_blank"), q(9, None, [str(k) for k in range(6)], None)]), ("b", "d", "easy", "T", "t", []), ("c", "d", "easy", "T", "t", None)]
    df = spark.createDataFrame(rows, f"quiz_id string, document_id string, difficulty string, title string, topic_id string, questions array<{quizdocs.QUESTION}>")
    tables = quizdocs.shred(df)
    assert sorted((r.quiz_id, r.question_count) for r in tables[0].collect()) == [("a", 3), ("b", 0), ("c", 0)]
    once = quizdocs.assemble(*tables)
    twice = quizdocs.assemble(*quizdocs.shred(once))
    assert sorted(once.collect(), key=lambda r: r.quiz_id) == sorted(twice.collect(), key=lambda r: r.quiz_id)
    a = once.where("quiz_id = 'a'").first()
    assert [(x.id, x.question, x.options, x.correct_answer, x.topic_id, x.difficulty) for x in a.questions] == [(5, "one", ["x", "y"], "B", "document", "easy"), (2, "two", [], "Text", "document", "easy"), (9, "", ["0", "1", "2", "3"], "", "document", "easy")]
    assert a.title == "d" and once.where("quiz_id = 'c'").first().questions == []


def test_import_of_old_files_once(spark):
    from lectern.operators import quizdocs

    content = '{"x::y::hard": {"questions": [{"id": 1}], "quiz_id": "k"}, "doc": {"easy": {"questions": []}, "medium": {"no": 1}, "difficult": {"questions": [{}], "difficulty": "z"}}, "n": 3, "plain": {"questions": [], "difficulty": "own"}}'
    files = spark.createDataFrame([("o", content), ("p", None), ("q", "not json"), ("o2", '{"again": {"quiz_id": "k", "questions": []}}')], "owner_id string, content string")
    none = spark.createDataFrame([], "quiz_id string")
    first = quizdocs.to_import(files, none)
    assert sorted((r.document_id, r.difficulty) for r in first.collect()) == [("doc", "difficult"), ("doc", "easy"), ("plain", "own"), ("x::y", "hard")]
    assert quizdocs.to_import(files, first).collect() == []


def test_regrade_and_topics_without_evidence(spark):
    answers = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, False)], "attempt_id int, question_id int, is_correct boolean")
    marks = spark.createDataFrame([(1, 2, False, 1), (1, 2, True, 2), (1, 9, True, 3)], "attempt_id int, question_id int, is_correct boolean, at int")
    assert [(r.attempt_id, r.score, r.total, r.percentage) for r in learning.regraded(answers, marks).collect()] == [(1, 2, 2, 100.0)]
    row = (1, 1, 1, True, "easy", "accepted", "c", 0, "flashcard", None)
    attempts = spark.createDataFrame([(1, 7, "d", "q", datetime(2026, 1, 1), True)], ATTEMPT)
    r = learning.recomputed_mastery(spark.createDataFrame([row], ANSWER), attempts).first()
    assert (r.level, r.answered, r.sufficient) == ("Not assessed", 0, False)


def test_nearest_vectors_with_salted_scopes(spark, data, monkeypatch):
    few = retrieval._top_k(spark, data).collect()
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 0)
    assert sorted(few) == sorted(retrieval._top_k(spark, data).collect()) and few
