"""Ranked search against its SQL and against scores of all documents; reading stops early, but never short of a tie."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("lectern.llm")
from lectern.llm import ranked_search, registry  # noqa: E402

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k=20):
    terms = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    terms = [(i, c, sum(c.values())) for i, c in terms if c]
    count, total, df = len(terms), sum(n for _, _, n in terms), Counter(t for _, c, _ in terms for t in c)
    asked = {}
    for i, t in dict.fromkeys(items):
        asked.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, query in asked.items():
        found = []
        for doc, c, n in terms:
            m = 100 - 25 + 25 * n * count // total
            score = sum(q * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in query.items() if t in c)
            if score > 0:
                found.append((-score, doc is not None, doc or 0))
        out += [(item, rank, d if some else None, -s) for rank, (s, some, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_query_gives_the_rows_of_its_sql_and_of_all_scores(spark, data, duck):
    got = registry.queries()["op12_best_position_search"](spark, data)
    assert dict(got.dtypes)["rank"] == "int"
    want = duck.execute(registry.oracle_sql()["op12_best_position_search"])
    assert rows_of(got) == sorted(want.fetchall(), key=repr)
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{data}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert rows_of(got) == plain(docs, items)


@pytest.mark.parametrize("postings,limit", [(50, 500_000), (1_000_000, 20)])
def test_segments_ties_and_blocks_of_items(spark, postings, limit):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["É", "日本", "A1"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(200)] + [(i, "w1 w2-w3") for i in range(200, 260)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(12)] + [(90, "w1 w2 W3"), (91, "nowhere")]
    got = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 20, postings, limit)
    assert rows_of(got) == plain(docs, items)


def test_odd_tables(spark):
    docs = [(1, None), (2, ""), (3, "same WORDS here"), (3, "same WORDS here"), (None, "same words here"), (4, "--- ..."), (5, "words " * 60_000), (6, "é😀é words\x7fsame")]
    items = [(1, "words same words"), (1, "words same words"), (1, "here"), (None, "é😀é"), (2, None), (3, "")]
    d, q = spark.createDataFrame([(*r, "k", 1) for r in docs], "doc_id long, text string, term string, n int"), spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    assert rows_of(ranked_search.search(d, q)) == plain(docs, items)
    assert ranked_search.search(d.limit(0), q).collect() == []
    assert ranked_search.search(d, q.limit(0)).collect() == []


def test_reading_stops_by_best_positions():
    """One list falls steeply: few documents are looked up; with all impacts equal, every tie is met."""
    n = 5000
    doc = np.tile(np.arange(n), 2)
    term = np.repeat([1, 2], n)
    steep = np.where(doc < 25, 10_000 - doc, 10)
    segment = ranked_search.Segment(np.arange(n)[::-1].copy(), term, doc, steep, 2)
    empty = np.zeros(0, np.int64)
    scores, ids, looked = segment.best([(1, 1), (2, 1)], 20, empty, empty)
    assert scores.tolist() == [2 * (10_000 - k) for k in range(20)] and ids.tolist() == [n - 1 - k for k in range(20)]
    assert looked < 200
    flat = ranked_search.Segment(np.arange(n)[::-1].copy(), term, doc, np.full(2 * n, 7), 2)
    scores, ids, looked = flat.best([(1, 1), (2, 2)], 20, empty, empty)
    assert ids.tolist() == list(range(20)) and set(scores) == {21} and looked == n
