"""Placements equal the loop over entries and leave no clash; what is still wanted and covered, by case."""

import random
from collections import defaultdict
from datetime import date, timedelta

from lectern.operators import placement as pl

TODAY = date(2026, 3, 2)
day = lambda n: TODAY + timedelta(days=n)
SCHEDULED = "owner_id int, document_id string, step_no int, activity string, reason string, minutes int, deadline date, day date, s int, e int, priority double"
SPANS = "owner_id int, day date, s int, e int"
WISHED = "owner_id int, key string, seq int, day date, s int"


def loop(entries, wishes):
    """entries: [(key, minutes, at or None)] in order; wishes: {key: at} that are valid; returns {key: at}, undone."""
    was, now, placed, undone = {k: a for k, _, a in entries}, {k: a for k, _, a in entries}, set(wishes), []
    now.update(wishes)
    length = {k: m for k, m, _ in entries}
    changed = True
    while changed:
        changed = False
        for key, minutes, _ in entries:
            if key in placed and any(o != key and now[o] is not None and now[o] < now[key] + minutes and now[key] < now[o] + length[o] for o in now):
                now[key] = was[key]
                placed.discard(key)
                undone.append(key)
                changed = True
    return now, undone


def test_apply_equals_the_loop(spark):
    rng, rows, wishes, own = random.Random(3), [], [], []
    for owner in range(120):
        own += [(owner, day(d), 480, 1200) for d in range(3)]
        at = {d: 480 for d in range(3)}
        for doc in "ab":
            for step in range(rng.randint(1, 5)):
                minutes, d = rng.choice([20, 30, 45]), rng.randrange(3)
                activity = rng.choice(["summary", "quiz", "review"])
                if rng.random() < 0.25:
                    rows.append((owner, doc, step, activity, "r", minutes, day(2), None, None, None, None))
                else:
                    rows.append((owner, doc, step, activity, "r", minutes, day(2), day(d), at[d], at[d] + minutes, 1.0))
                    at[d] += minutes + rng.choice([0, 20])
        for n in range(rng.randint(0, 6)):
            wishes.append((owner, f"{rng.choice('ab')}|{rng.choice(['summary', 'quiz', 'review'])}|{rng.randrange(3)}", n, day(rng.randrange(3)), rng.choice([480, 495, 510, 525, 540, 600, 1190])))
    df, wished, spans = spark.createDataFrame(rows, SCHEDULED), spark.createDataFrame(wishes, WISHED), spark.createDataFrame(own, SPANS)
    none = spans.limit(0)
    got = defaultdict(dict)
    for r in pl.apply_placements(df, wished, spans, none, none, str(TODAY), 0).collect():
        got[r.owner_id][r.key] = r
    undone_in_all = 0
    for owner in range(120):
        mine = sorted((r for r in rows if r[0] == owner), key=lambda r: (r[7] is None, r[7] or TODAY, r[8] or 0, r[1], r[2]))
        seen, entries = defaultdict(int), []
        for r in mine:
            key = f"{r[1]}|{r[3]}|{seen[r[1], r[3]]}"
            seen[r[1], r[3]] += 1
            entries.append((key, r[5], None if r[7] is None else (r[7] - TODAY).days * 1440 + r[8]))
        last = {k: (d, s) for o, k, n, d, s in sorted(wishes, key=lambda w: w[2]) if o == owner}
        length = {k: m for k, m, _ in entries}
        valid = {k: (d - TODAY).days * 1440 + s for k, (d, s) in last.items() if k in length and s % 15 == 0 and s + length[k] <= 1200}
        now, undone = loop(entries, valid)
        undone_in_all += len(undone)
        for key, minutes, _ in entries:
            r = got[owner][key]
            assert (None if r.day is None else (r.day - TODAY).days * 1440 + r.s) == now[key] and r.placed == (key in valid and key not in undone)
            assert (r.fault == "slot_taken") == (key in undone)
        assert {k for k, r in got[owner].items() if r.fault == "candidate_stale"} == {k for k in last if k not in length}
        times = [(now[k], now[k] + m, got[owner][k].placed) for k, m, _ in entries if now[k] is not None]
        assert not any(p and a < d and c < b for i, (a, b, p) in enumerate(times) for j, (c, d, _) in enumerate(times) if i != j)
    assert undone_in_all > 20


def test_rules_of_a_window(spark):
    own = spark.createDataFrame([(1, day(0), 540, 600), (1, day(0), 600, 720), (1, day(1), 540, 720), (1, day(9), 540, 1440), (2, day(1), 0, 1440)], SPANS)
    external, taken = spark.createDataFrame([(1, day(1), 600, 630)], SPANS), spark.createDataFrame([(1, day(0), 660, 700), (1, day(9), 700, 700)], SPANS)
    cases = [("ok", 0, 585, 30, None), ("odd", 0, 586, 30, "invalid_time"), ("none", 0, None, 30, "invalid_time"), ("past", 0, 540, 30, "slot_in_past"), ("long", 9, 1425, 30, "outside_availability"), ("midnight", 9, 1410, 30, "after_deadline"), ("busy", 1, 585, 30, "calendar_busy"), ("out", 1, 705, 30, "outside_availability"), ("taken", 0, 645, 30, "slot_taken"), ("touch", 0, 630, 30, None), ("other", 2, 540, 30, "outside_availability")]
    rows = [(1, k, None if s is None and k != "none" else day(d), s, m, day(5)) for k, d, s, m, _ in cases]
    df = spark.createDataFrame(rows, "owner_id int, key string, day date, s int, minutes int, deadline date")
    assert {r.key: r.fault for r in pl.placement_faults(df, own, external, taken, str(TODAY), 575).collect()} == {k: want for k, *_, want in cases}


def test_wanted_covered_and_reasons(spark):
    steps = spark.createDataFrame([(1, "d", k, a, r, 30, day(9)) for k, (a, r) in enumerate([("flashcards", "x"), ("summary+quiz", "x"), ("flashcards", "x"), ("quiz", "x"), ("review", "final_review")])], "owner_id int, document_id string, step_no int, activity string, reason string, minutes int, deadline date")
    sessions = spark.createDataFrame([(1, "d", 1, day(1), 0, "written_quiz", "scheduled", None), (1, "d", 2, day(2), 0, "summary+quiz", "in_progress", "quiz"), (1, "d", 3, day(8), 0, "quiz", "completed", None), (2, "d", 4, day(8), 0, "flashcards", "scheduled", None)], "owner_id int, document_id string, session_id int, day date, s int, activity string, status string, pending string")
    own = spark.createDataFrame([(1, day(n), 0, 60) for n in range(8)], SPANS)
    materials = spark.createDataFrame([(1, "d", day(9)), (1, "e", None)], "owner_id int, document_id string, deadline date")
    # The window starts two days before the deadline; the quiz on the day before is its last session.
    covered = pl.final_covered(materials, sessions, own)
    assert [(r.owner_id, r.document_id) for r in covered.collect()] == [(1, "d")]
    live = pl.live_candidates(steps, sessions, covered)
    assert sorted(r.key for r in live.collect()) == ["d|flashcards|1", "d|summary+quiz|0"]
    assert pl.final_window(materials, spark.createDataFrame([(1, day(5), 0, 20), (1, day(6), 0, 19)], SPANS)).first().window_start == day(5)
    assert pl.final_window(materials, spark.createDataFrame([(1, day(4), 0, 20)], SPANS)).first().window_start == day(7)
    none = own.limit(0)
    assert {r.reason for r in pl.queue_reasons(live, own, none, none, str(TODAY), 0, 14).collect()} == {"held_by_pacing"}
    assert {r.reason for r in pl.queue_reasons(live, own.where("day = date'2026-03-02'"), none, none, str(TODAY), 35, 14).collect()} == {"no_room_before_deadline"}
    assert {r.reason for r in pl.queue_reasons(live.drop("deadline").selectExpr("*", "cast(null as date) AS deadline"), none, none, none, str(TODAY), 0, 14).collect()} == {"no_room"}
