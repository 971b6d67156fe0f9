"""What moves between tasks stays in proportion to the input; results by brute force."""

import random
from datetime import date

from pyspark.sql import functions as F

from lectern.operators import evidence, intervals, placement, seeds, structure, upkeep


def shuffled(spark, df):
    """The rows of `df`, and the bytes that tasks wrote for others on the way."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sum(x.totalShuffleWrite() for x in (found.apply(k) for found in [sc.statusStore().executorList(False)] for k in range(found.size())))

    before, limit = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        return (df().collect(), written() - before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_overlap_moves_the_ends_of_chunks_alone(spark):
    rng, rows = random.Random(2), []
    for document in range(40):
        before = ""
        for k in range(12):
            some = rng.choice(["ab", "a", "abc\n", "xyzé0123456789"])
            text = "".join(rng.choices(some, k=rng.choice([0, 20, 29, 30, 31, 150, 299, 300, 301, 5000])))
            before = (before[-rng.randrange(1, 330) :] if rng.random() < 0.7 else "") + text
            rows.append((document, k, before if rng.random() < 0.95 else None))
    df = spark.createDataFrame(rows, "document_id long, chunk_index long, content string").cache()
    got, moved = shuffled(spark, lambda: upkeep.trim_overlap(df))
    text = {(d, k): t for d, k, t in rows}
    want = {(d, k): max((n for n in range(30, 301) if t and (b := text.get((d, k - 1))) and n <= min(len(t), len(b)) and b[-n:] == t[:n]), default=0) for (d, k), t in text.items()}
    assert {(r.document_id, r.chunk_index): r.overlap for r in got} == want and len(set(want.values())) > 20
    rng = random.Random(3)
    rows = [(d, k, "".join(chr(rng.randrange(33, 1000)) for _ in range(3000))) for d in range(20) for k in range(10)]
    df = spark.createDataFrame(rows, "document_id long, chunk_index long, content string").cache()
    _, moved = shuffled(spark, lambda: upkeep.trim_overlap(df))
    assert moved < 0.3 * sum(len(t.encode()) for *_, t in rows)


def test_located_quotes_move_no_shingles(spark):
    rng = random.Random(5)
    texts = {d: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKL", k=6000)) for d in range(30)}
    units = [(d, f"{d}-{k}", k, t[600 * k : 600 * k + 600]) for d, t in texts.items() for k in range(10)]
    quotes = [(d, k, t[at : at + 90]) for d, t in texts.items() for k, at in enumerate((40, 560, 3000))]
    units, quotes = spark.createDataFrame(units, "document_id long, unit_id string, place int, text string").cache(), spark.createDataFrame(quotes, "document_id long, quote_id int, quote string").cache()
    rows, moved = shuffled(spark, lambda: evidence.locate(quotes, units))
    assert len(rows) == 30 * 4 and moved < 4 * sum(map(len, texts.values()))


def test_runs_of_an_alignment_equal_those_of_difflib():
    import difflib

    rng = random.Random(6)
    for n in range(1500):
        text = "".join(rng.choices("ab" if n % 2 else "abcdefgh", k=rng.randrange(5, 200)))
        at = rng.randrange(len(text))
        quote = text[at : at + rng.randrange(20, 120)]
        for _ in range(rng.choice([1, 2, 4])):
            p = rng.randrange(len(quote) + 1)
            quote = quote[:p] + rng.choice(["xq", "", "a"]) + quote[p + rng.randrange(3) :]
        blocks = difflib.SequenceMatcher(None, text, quote, autojunk=False).get_matching_blocks()
        assert list(evidence.runs_of(text, quote, 0, len(text), 0, len(quote))) == [(b.a, b.size) for b in blocks if b.size >= evidence.RUN_CHARS]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_free_time_is_dealt_once(spark):
    rows = [(n % 7, date(2024, 1, 1 + n % 5), n * 37 % 900, n * 37 % 900 + 60 + n % 50) for n in range(400)]
    df = spark.createDataFrame(rows, "owner_id int, day date, s int, e int")
    free, busy = df.where("s % 2 = 0"), df.where("s % 2 = 1")
    found = intervals.subtract(free, busy)
    assert plan_of(found).count("Exchange hashpartitioning") == 1
    minutes = lambda odd: {(o, d, m) for o, d, s, e in rows if s % 2 == odd for m in range(s, e)}
    assert {(r.owner_id, r.day, m) for r in found.collect() for m in range(r.s, r.e)} == minutes(0) - minutes(1)


def test_placements_read_the_schedule_once(spark):
    day = date(2024, 1, 1)
    scheduled = spark.createDataFrame([(1, "a", 0, "quiz", "r", 30, day, day, 540, 570, 1.0)], "owner_id int, document_id string, step_no int, activity string, reason string, minutes int, deadline date, day date, s int, e int, priority double")
    wished = spark.createDataFrame([(1, "a|quiz|0", 0, day, 600)], "owner_id int, key string, seq int, day date, s int")
    own = spark.createDataFrame([(1, day, 480, 1200)], "owner_id int, day date, s int, e int")
    found = placement.apply_placements(scheduled.withColumn("reason", F.concat("reason", F.rand(7).cast("string"))).where("reason > 'r'"), wished, own, own.limit(0), own.limit(0), str(day), 0)
    assert "rand(7)" not in plan_of(found)
    assert [(r.key, r.s, r.placed, r.fault) for r in found.collect()] == [("a|quiz|0", 600, True, None)]


def test_headings_are_found_once(spark, data):
    for query in (structure.QUERIES["topic_chunks"], seeds.QUERIES["topic_evidence"], seeds.QUERIES["usable_topics"]):
        assert "ofthe Rest" not in plan_of(query(spark, data))  # text that only pages and their headings are made of
