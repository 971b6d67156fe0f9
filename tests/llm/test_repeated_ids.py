"""Rows of one id with unlike texts are judged each on its own; changed questions are found by the hundred."""

import random

import pytest

pytest.importorskip("lectern.llm")
from lectern.llm import decontamination, licenses, ngram_join, toxicity  # noqa: E402

DOC, ITEM = "doc_id long, text string", "item_id long, text string"
QUESTION = "A farmer keeps brown hens in a wooden barn near the river and sells their eggs at the market every week"


def test_halves_of_an_item_in_two_rows_are_no_leak(spark):
    words = QUESTION.split()
    docs = spark.createDataFrame([(1, " ".join(words[:11]) + " and so on"), (1, "they said " + " ".join(words[9:]))], DOC)
    items = spark.createDataFrame([(1, QUESTION)], ITEM)
    assert decontamination.find_leaks(docs, items).collect() == []
    assert decontamination.drop_leaked(docs, items).count() == 2


def test_only_the_leaked_row_goes(spark):
    docs = spark.createDataFrame([(1, QUESTION, 5), (1, "a clean text of its own that has nothing to do with any of it", 6), (1, QUESTION, 7), (None, None, 8)], DOC + ", doc_key long")
    items = spark.createDataFrame([(1, QUESTION)], ITEM)
    assert sorted(r.doc_key for r in decontamination.drop_leaked(docs, items).collect()) == [6, 8]
    assert [(r.doc_id, r.item_id, r.coverage) for r in decontamination.find_leaks(docs, items).collect()] == [(1, 1, 1.0)]


def test_two_texts_of_one_item_id(spark):
    other = "Every morning the baker carries fresh bread to the old school on the hill before the children arrive there"
    items = spark.createDataFrame([(1, QUESTION), (1, other), (1, other)], ITEM)
    docs = spark.createDataFrame([(1, f"so {QUESTION} it went"), (2, f"so {other} it went"), (3, "neither of them")], DOC)
    assert sorted((r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items).collect()) == [(1, 1), (2, 1)]


NAMES = "Anna Tom Lucy Mark Petra Hans Natalia Weng Carlos Ines Peter Olga Yusuf Marta".split()
NOUNS = "apples tickets marbles pencils stamps books oranges coins bottles letters".split()
UNITS = ["kg", "dollars", "hours", "miles", "euros"]
FORMS = [
    "{a} has {x} {n} and gives {y} of them to {b}. How many {n} does {a} have left after that?",
    "At the shop {a} pays {x} {u} for some {n} while {b} pays {y} {u} more than {a} did. What did they pay together?",
    "{a} and {b} collect {n} every day for {x} days. If {a} finds {y} each day, how many does {b} need to reach the same sum?",
    "The teacher tells {a} that {x} {n} weigh {y} {u}, so {a} asks {b} how much a single one of them weighs in the end.",
]


def question(rng, form, **fixed):
    a, b = rng.sample(NAMES, 2)
    return form.format(**({"a": a, "b": b, "x": rng.randint(2, 99), "y": rng.randint(100, 999)} | fixed))


def test_two_hundred_changed_questions(spark):
    rng, items, docs = random.Random(2), [], []
    for k in range(200):
        form, noun, unit = FORMS[k % 4], NOUNS[k % 10], UNITS[k % 5]
        tag = f"This is story number {''.join(rng.choices('abcdefghij', k=6))} of the {noun} book."
        items.append((k, f"{tag} {question(rng, form, n=noun, u=unit)}"))
        docs.append((k, f"Some words before it. {tag} {question(rng, form, n=noun, u=unit)} And some after it."))
    docs += [(1000 + k, " ".join(rng.choices("the of a river stone light under over green and with quiet road".split(), k=60))) for k in range(200)]
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()}
    assert len({k for k in range(200) if (k, k) in found}) >= 180
    assert not {d for d, _ in found if d >= 1000}


def test_groups_on_a_table_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, QUESTION, 1, 2, 3), (2, QUESTION, 1, 2, 3), (3, "another text of some words here", 1, 2, 3)], DOC + ", _key int, doc_key int, keys int")
    assert sorted(r.doc_id for r in ngram_join.keep_first(docs).collect()) == [1, 3]


def test_labels_that_contradict_count_as_toxic(spark):
    docs = spark.createDataFrame([(k, "some words") for k in range(40)], DOC)
    labels = spark.createDataFrame([(k, 0, t) for k in range(40) for t in (0, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.toxic for r in toxicity.training_rows(docs, labels, 100).collect()} == {1}


def test_with_more_than_one_exception():
    reading = licenses.parse_expression("GPL-2.0 WITH (Classpath-exception-2.0 OR Bison-exception-2.2)")
    assert len(reading.labels) == 3 and not reading.whole and {x for x in reading.labels if x.startswith("with-")} == {"with-classpath-exception-2.0", "with-bison-exception-2.2"}
    assert licenses.parse_expression("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT").whole


def test_many_near_copies_of_each_other_meet_once(spark):
    """Copies with a few words changed each: components as brute force has them."""
    rng, words = random.Random(4), [f"w{i}" for i in range(60)]
    docs = []
    for k in range(60):
        own = list(words)
        for _ in range(rng.choice([0, 1, 2, 3])):
            own[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        docs.append((k, " ".join(own)))
    sets = {k: {tuple(t.split()[i : i + 4]) for i in range(57)} for k, t in docs}
    near = {k: {j for j in sets if 100 * len(sets[k] & sets[j]) >= 85 * len(sets[k] | sets[j])} for k in sets}
    want = {}
    for k in sets:
        seen, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        want[k] = min(seen)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(spark.createDataFrame(docs, DOC)).collect()}
    assert got == want and len(set(want.values())) > 1
