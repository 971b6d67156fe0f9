"""A learner's own placements over the schedule: which are valid, which clash, what is still wanted and why it has no time.

Times are (day, minute). `own` is the learner's availability, `external` what their calendar blocks, `sessions` what is planned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lectern.functions.staging import cut
from lectern.operators import intervals, scheduling
from lectern.sources.tables import table

# The grid of placements, states that take time, states that cover a wanted activity.
GRID = 15
TAKES_TIME, COVERS = ("scheduled", "in_progress", "completed"), ("scheduled", "in_progress")


def held_by(placements: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """`placements` with a flag: one of the spans (owner_id, day, s, e) of the day holds it whole."""
    days = intervals.merge(spans).groupBy("owner_id", "day").agg(F.collect_list(F.struct("s", "e")).alias("_spans"))
    rows = placements.join(days, ["owner_id", "day"], "left")
    return rows.withColumn(name, F.coalesce(F.exists("_spans", lambda x: (x["s"] <= F.col("s")) & (F.col("e") <= x["e"])), F.lit(False))).drop("_spans")


def placement_faults(placements: DataFrame, own: DataFrame, external: DataFrame, taken: DataFrame, today: str, now: int) -> DataFrame:
    """`placements` (owner_id, key, day, s, minutes, deadline; a null start is no time) with the first rule that each breaks, null for valid ones.

    taken: owner_id, day, s, e of sessions; now: the minute of the day `today`.
    """
    placements = cut(placements)
    asked = placements.select(*intervals.KEY).distinct()
    own, external, taken = (x.join(asked, intervals.KEY, "left_semi") for x in (own, external, taken))  # other days decide nothing
    rows = placements.withColumn("e", F.col("s") + F.col("minutes"))
    rows = held_by(held_by(rows, own, "_own"), intervals.subtract(own, external), "_free")
    busy = taken.where("s < e").groupBy("owner_id", "day").agg(F.collect_list(F.struct("s", "e")).alias("_taken"))
    rows = rows.join(busy, ["owner_id", "day"], "left")
    clash = F.coalesce(F.exists("_taken", lambda x: (x["s"] < F.col("e")) & (x["e"] > F.col("s"))), F.lit(False))
    start = F.datediff("day", F.lit(today).cast("date")) * 1440 + F.col("s")
    fault = (
        F.when(start.isNull() | (F.col("s") % GRID != 0), "invalid_time")
        .when(F.col("e") > 1440, "outside_availability")
        .when(start < now, "slot_in_past")
        .when(F.col("day") > F.col("deadline"), "after_deadline")
        .when(~F.col("_free"), F.when(F.col("_own"), "calendar_busy").otherwise("outside_availability"))
        .when(clash, "slot_taken")
    )
    return rows.withColumn("fault", fault).drop("_own", "_free", "_taken")


def keyed(scheduled: DataFrame) -> DataFrame:
    """The schedule's activities with their order and a key that lasts: document, activity and its number, placed ones first."""
    own = W.partitionBy("owner_id").orderBy(F.col("day").isNull(), "day", "s", "document_id", "step_no")
    same = W.partitionBy("owner_id", "document_id", "activity").orderBy(F.col("day").isNull(), "day", "s", "step_no")
    key = F.concat_ws("|", "document_id", "activity", (F.row_number().over(same) - 1).cast("string"))
    return scheduled.withColumn("key", key).withColumn("place", F.row_number().over(own))


def settle(entries: list[dict]) -> list[str]:
    """Undo placements that overlap anything else, in the order of the entries, until none does; returns the keys undone. Each turn undoes one at least, so there are no more turns than placements."""
    undone = []
    for _ in range(len(entries) + 1):
        before = len(undone)
        for x in entries:
            if x["placed"] and any(y is not x and y["at"] is not None and y["at"] < x["at"] + x["minutes"] and y["at"] + y["minutes"] > x["at"] for y in entries):
                x["at"], x["placed"] = x["was"], False
                undone.append(x["key"])
        if len(undone) == before:
            break
    return undone


def apply_placements(scheduled: DataFrame, wished: DataFrame, own: DataFrame, external: DataFrame, taken: DataFrame, today: str, now: int) -> DataFrame:
    """The schedule after a learner's wishes (owner_id, key, seq, day, s): the last one for a key counts. One row for each activity and each wish that names none: owner_id, key, day, s, e, minutes, placed, fault."""
    last = wished.groupBy("owner_id", "key").agg(F.max_by(F.struct("day", "s"), "seq").alias("w")).select("owner_id", "key", "w.day", "w.s")
    entries = cut(keyed(scheduled).select("owner_id", "key", "place", "minutes", "deadline", F.col("day").alias("was_day"), F.col("s").alias("was_s")))
    named = placement_faults(last.join(entries.select("owner_id", "key", "minutes", "deadline"), ["owner_id", "key"]), own, external, taken, today, now).select("owner_id", "key", F.col("day").alias("to_day"), F.col("s").alias("to_s"), "fault", F.lit(True).alias("wish"))
    at = lambda day, s: F.datediff(day, F.lit(today).cast("date")) * 1440 + F.col(s)
    rows = entries.join(named, ["owner_id", "key"], "left").withColumn("placed", F.coalesce(F.col("wish") & F.col("fault").isNull(), F.lit(False)))
    entry = F.struct("place", "key", "minutes", at("was_day", "was_s").alias("was"), F.when(F.col("placed"), at("to_day", "to_s")).otherwise(at("was_day", "was_s")).alias("at"), "placed", "fault")
    learners = rows.select("owner_id", entry.alias("x")).groupBy("owner_id").agg(F.sort_array(F.collect_list("x")).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for owner, found in zip(*(c.to_pylist() for c in batch.columns)):
                undone = set(settle(found))
                out += [(owner, x["key"], x["at"], x["minutes"], x["placed"], "slot_taken" if x["key"] in undone else x["fault"]) for x in found]
            kinds = (batch.column(0).type, pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["owner_id", "key", "at", "minutes", "placed", "fault"])

    settled = learners.mapInArrow(run, f"owner_id {dict(rows.dtypes)['owner_id']}, key string, at int, minutes int, placed boolean, fault string")
    start = F.col("at") % 1440
    settled = settled.select("owner_id", "key", F.date_add(F.lit(today).cast("date"), F.floor(F.col("at") / 1440).cast("int")).alias("day"), start.alias("s"), (start + F.col("minutes")).alias("e"), "minutes", "placed", "fault")
    nothing = lambda kind: F.lit(None).cast(kind)
    stale = last.join(entries, ["owner_id", "key"], "left_anti").select("owner_id", "key", nothing("date").alias("day"), nothing("int").alias("s"), nothing("int").alias("e"), nothing("int").alias("minutes"), F.lit(False).alias("placed"), F.lit("candidate_stale").alias("fault"))
    return settled.unionByName(stale)


def final_window(materials: DataFrame, own: DataFrame) -> DataFrame:
    """The first day of a deadline's final review window, moved to the last usable day before it where the window has none."""
    usable = intervals.daily_capacity(intervals.merge(own)).where(F.col("capacity") >= scheduling.SHORTEST).select("owner_id", "day")
    start, floor = F.date_sub("deadline", scheduling.FINAL_WINDOW), F.date_sub("deadline", scheduling.FINAL_FALLBACK)
    rows = materials.where("deadline IS NOT NULL").select("owner_id", "document_id", "deadline").join(usable, "owner_id", "left")
    inside = F.max((F.col("day") >= start) & (F.col("day") < F.col("deadline")))
    before = F.max(F.when((F.col("day") >= floor) & (F.col("day") < start), F.col("day")))
    g = rows.groupBy("owner_id", "document_id", "deadline").agg(inside.alias("inside"), before.alias("before"))
    return g.select("owner_id", "document_id", "deadline", F.when(F.coalesce("inside", F.lit(False)) | F.col("before").isNull(), F.date_sub("deadline", scheduling.FINAL_WINDOW)).otherwise(F.col("before")).alias("window_start"))


def final_covered(materials: DataFrame, sessions: DataFrame, own: DataFrame) -> DataFrame:
    """Materials whose last session before the deadline is a quiz within the final review window, which then is the final review."""
    windows = final_window(materials, own)
    kept = sessions.where(F.col("status").isin(*TAKES_TIME)).join(windows, ["owner_id", "document_id"]).where("day < deadline")
    last = kept.groupBy("owner_id", "document_id", "window_start").agg(F.max(F.struct("day", "s", "session_id", "activity")).alias("l"))
    quiz = F.element_at(F.split("l.activity", r"\+"), -1).isin(*scheduling.RETRIEVAL)
    return last.where(quiz & (F.col("l.day") >= F.col("window_start"))).select("owner_id", "document_id")


def live_candidates(steps: DataFrame, sessions: DataFrame, covered_finals: DataFrame) -> DataFrame:
    """Activities that are wanted and that no session covers, one session covering one of its document and activity; a final review that a quiz covers is left out.

    A session of the older kind of written quiz covers flashcards; a combined one under way covers what is left of it (`pending`, joined by +).
    """
    key = F.when(F.col("activity") == "written_quiz", "flashcards").otherwise(F.col("activity"))
    parts = F.when((F.col("status") == "in_progress") & F.col("activity").contains("+"), F.filter(F.split(F.coalesce("pending", F.lit("")), r"\+"), lambda x: x != "")).otherwise(F.array(key))
    covered = sessions.where(F.col("status").isin(*COVERS)).select("owner_id", "document_id", F.explode(parts).alias("activity")).groupBy("owner_id", "document_id", "activity").agg(F.count(F.lit(1)).alias("covered"))
    finals = covered_finals.select("owner_id", "document_id", F.lit("final_review").alias("reason"))
    rows = steps.join(finals, ["owner_id", "document_id", "reason"], "left_anti")
    nth = F.row_number().over(W.partitionBy("owner_id", "document_id", "activity").orderBy("step_no")) - 1
    rows = rows.withColumn("ordinal", nth).join(covered, ["owner_id", "document_id", "activity"], "left").where(F.col("ordinal") >= F.coalesce("covered", F.lit(0)))
    return rows.select("owner_id", "document_id", F.concat_ws("|", "document_id", "activity", F.col("ordinal").cast("string")).alias("key"), "activity", "reason", "minutes", "deadline")


def queue_reasons(wanted: DataFrame, own: DataFrame, external: DataFrame, taken: DataFrame, today: str, now: int, horizon: int) -> DataFrame:
    """Why a wanted activity has no session: held back by pacing where some valid window exists, else no room before the deadline or the horizon."""
    day0 = F.lit(today).cast("date")
    free = intervals.subtract(intervals.subtract(own, external), taken).where(F.col("day") >= day0)
    free = free.withColumn("s", F.when(F.col("day") == day0, F.greatest("s", F.lit(now))).otherwise(F.col("s"))).withColumn("room", F.col("e") - intervals.align_up(F.col("s"), GRID)).where("room > 0")
    days = free.groupBy("owner_id", "day").agg(F.max("room").alias("room"))
    # For each learner and length one join with days, not with intervals: the largest room of a day decides.
    rows = wanted.withColumn("last", F.coalesce("deadline", F.date_add(day0, horizon)))
    fits = rows.join(days, "owner_id").where((F.col("day") <= F.col("last")) & (F.col("room") >= F.col("minutes"))).select("owner_id", "key").distinct().withColumn("fits", F.lit(True))
    reason = F.when(F.col("fits"), "held_by_pacing").when(F.col("deadline").isNotNull(), "no_room_before_deadline").otherwise("no_room")
    return rows.join(fits, ["owner_id", "key"], "left").select("owner_id", "key", "minutes", reason.alias("reason"))


TODAY, NOW = scheduling.TODAY, 600
ACTIVITIES = ("summary", "flashcards", "quiz", "summary+flashcards", "review", "written_quiz")
STATES = ("scheduled", "in_progress", "completed", "cancelled", "scheduled")


def _pick(values: tuple, k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    k, start = F.col("o_orderkey"), F.col("o_orderkey") % 40 * 15 + 480
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("owner_id"), F.col("o_orderpriority").alias("document_id"), k.alias("session_id"), F.date_add(F.lit(TODAY).cast("date"), (k % 20 - 3).cast("int")).alias("day"), start.cast("int").alias("s"), (start + 30 + k % 4 * 15).cast("int").alias("e"),
        _pick(ACTIVITIES, k).alias("activity"), _pick(STATES, k).alias("status"), F.when(k % 2 == 0, "flashcards").alias("pending"),
    )


def _taken(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).where(F.col("status").isin(*TAKES_TIME)).select("owner_id", "day", "s", "e")


def _own(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "orders").select(F.col("o_custkey").alias("owner_id")).distinct().select("owner_id", F.explode(F.sequence(F.date_sub(F.lit(TODAY).cast("date"), 5), F.date_add(F.lit(TODAY).cast("date"), 42))).alias("day"))
    windows = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in intervals.FREE_WINDOWS))
    return days.where((F.col("owner_id") + F.weekday("day")) % 3 != 0).select("owner_id", "day", F.explode(windows).alias("w")).select("owner_id", "day", "w.s", "w.e")


def _external(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").where(k % 3 == 0).select(F.col("o_custkey").alias("owner_id"), F.date_add(F.lit(TODAY).cast("date"), (k % 23 - 1).cast("int")).alias("day"), (k % 50 * 10 + 540).cast("int").alias("s"), (k % 50 * 10 + 660).cast("int").alias("e"))


def _wishes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("owner_id"), F.col("o_orderpriority").alias("document_id"), k.cast("string").alias("key"), F.date_add(F.lit(TODAY).cast("date"), (k % 23 - 1).cast("int")).alias("day"), F.when(k % 19 != 0, k % 40 * 15 + 480 + F.when(k % 17 == 0, 7).otherwise(0)).cast("int").alias("s"), (k % 5 * 15 + 20).cast("int").alias("minutes"))
    return rows.join(scheduling._materials(spark, d).select("owner_id", "document_id", "deadline"), ["owner_id", "document_id"])


def _faults(spark: SparkSession, d: str) -> DataFrame:
    return placement_faults(_wishes(spark, d), _own(spark, d), _external(spark, d), _taken(spark, d), TODAY, NOW).select("owner_id", "key", "fault")


def _applied(spark: SparkSession, d: str) -> DataFrame:
    """Wishes for the first summary, flashcards, quiz or review of a document, at the times of its orders."""
    k = F.col("key").cast("long")
    wished = _wishes(spark, d).select("owner_id", F.concat_ws("|", "document_id", _pick(ACTIVITIES[:5], k), F.lit("0")).alias("key"), k.alias("seq"), "day", "s")
    return apply_placements(scheduling._scheduled(spark, d), wished, _own(spark, d), _external(spark, d), _taken(spark, d), TODAY, NOW)


def _covered(spark: SparkSession, d: str) -> DataFrame:
    return final_covered(scheduling._materials(spark, d), _sessions(spark, d), _own(spark, d))


def _live(spark: SparkSession, d: str) -> DataFrame:
    materials = scheduling._materials(spark, d)
    steps = scheduling.combine(scheduling.step_rows(scheduling.study_steps(materials)))
    return live_candidates(steps.join(materials.select("owner_id", "document_id", "deadline"), ["owner_id", "document_id"]), _sessions(spark, d), _covered(spark, d))


QUERIES = {
    "placement_faults": _faults,
    "applied_placements": _applied,
    "final_review_covered": _covered,
    "live_candidates": _live,
    "queue_reasons": lambda s, d: queue_reasons(_live(s, d), _own(s, d), _external(s, d), _taken(s, d), TODAY, NOW, scheduling.HORIZON),
}
_TIMES = f"""sess AS (SELECT o_custkey AS owner_id, o_orderpriority AS document_id, o_orderkey AS session_id, DATE '{TODAY}' + CAST(o_orderkey % 20 - 3 AS INT) AS day, o_orderkey % 40 * 15 + 480 AS s, o_orderkey % 40 * 15 + 510 + o_orderkey % 4 * 15 AS e,
    ['summary', 'flashcards', 'quiz', 'summary+flashcards', 'review', 'written_quiz'][o_orderkey % 6 + 1] AS activity, ['scheduled', 'in_progress', 'completed', 'cancelled', 'scheduled'][o_orderkey % 5 + 1] AS status FROM orders),
  taken AS (SELECT * FROM sess WHERE status <> 'cancelled'), dd AS (SELECT DISTINCT o_custkey AS owner_id, DATE '{TODAY}' + CAST(n AS INT) AS day FROM orders, range(-5, 43) AS r(n)),
  own AS (SELECT owner_id, day, w.s, w.e FROM dd, (VALUES (540, 720), (840, 1080)) AS w(s, e) WHERE (owner_id + isodow(day) - 1) % 3 <> 0),
  ext AS (SELECT o_custkey AS owner_id, DATE '{TODAY}' + CAST(o_orderkey % 23 - 1 AS INT) AS day, o_orderkey % 50 * 10 + 540 AS s, o_orderkey % 50 * 10 + 660 AS e FROM orders WHERE o_orderkey % 3 = 0)"""
_COVERED = """us AS (SELECT DISTINCT owner_id, day FROM own), fw AS (SELECT c.owner_id, document_id, deadline, CASE WHEN coalesce(bool_or(day >= deadline - 2 AND day < deadline), false) OR max(day) FILTER (day >= deadline - 4 AND day < deadline - 2) IS NULL THEN deadline - 2 ELSE max(day) FILTER (day >= deadline - 4 AND day < deadline - 2) END AS start FROM c LEFT JOIN us USING (owner_id) WHERE deadline IS NOT NULL GROUP BY 1, 2, 3),
  cov AS (SELECT owner_id, document_id FROM (SELECT fw.owner_id, fw.document_id, start, taken.day, activity, row_number() OVER (PARTITION BY fw.owner_id, fw.document_id ORDER BY taken.day DESC, s DESC, session_id DESC) AS rn FROM fw JOIN taken ON taken.owner_id = fw.owner_id AND taken.document_id = fw.document_id AND taken.day < deadline) WHERE rn = 1 AND day >= start AND activity = 'quiz')"""
_LIVE = f"""{scheduling.COMBINED_SQL}, {_TIMES}, {_COVERED}, cs AS (SELECT owner_id, document_id, unnest(CASE WHEN status = 'in_progress' AND contains(activity, '+') THEN CASE WHEN session_id % 2 = 0 THEN ['flashcards'] ELSE [] END WHEN activity = 'written_quiz' THEN ['flashcards'] ELSE [activity] END) AS activity FROM sess WHERE status IN ('scheduled', 'in_progress')),
  cc AS (SELECT owner_id, document_id, activity, count(*) AS n FROM cs GROUP BY ALL), w0 AS (SELECT combined.*, c.deadline FROM combined JOIN c USING (owner_id, document_id) WHERE reason <> 'final_review' OR NOT EXISTS (SELECT 1 FROM cov WHERE cov.owner_id = combined.owner_id AND cov.document_id = combined.document_id)),
  w1 AS (SELECT *, row_number() OVER (PARTITION BY owner_id, document_id, activity ORDER BY step_no) - 1 AS ordinal FROM w0), live AS (SELECT w1.owner_id, w1.document_id, w1.document_id || '|' || w1.activity || '|' || ordinal AS key, w1.activity, reason, minutes, deadline FROM w1 LEFT JOIN cc USING (owner_id, document_id, activity) WHERE ordinal >= coalesce(n, 0))"""
# Minutes from start to end of what is free on a day, cut at every bound: a stretch between two bounds is free or not.
_FREE = """bd AS (SELECT owner_id, day, s AS b FROM own UNION SELECT owner_id, day, e FROM own UNION SELECT owner_id, day, s FROM ext UNION SELECT owner_id, day, e FROM ext UNION SELECT owner_id, day, s FROM taken UNION SELECT owner_id, day, e FROM taken),
  st AS (SELECT owner_id, day, b AS s, lead(b) OVER (PARTITION BY owner_id, day ORDER BY b) AS e FROM bd), ff AS (SELECT st.* FROM st JOIN own o ON o.owner_id = st.owner_id AND o.day = st.day AND o.s <= st.s AND st.e <= o.e WHERE NOT EXISTS (SELECT 1 FROM ext x WHERE x.owner_id = st.owner_id AND x.day = st.day AND x.s < st.e AND x.e > st.s) AND NOT EXISTS (SELECT 1 FROM taken x WHERE x.owner_id = st.owner_id AND x.day = st.day AND x.s < st.e AND x.e > st.s)),
  gi AS (SELECT *, sum(fresh) OVER (PARTITION BY owner_id, day ORDER BY s) AS island FROM (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY owner_id, day ORDER BY s) = s THEN 0 ELSE 1 END AS fresh FROM ff)), gaps AS (SELECT owner_id, day, min(s) AS s, max(e) AS e FROM gi GROUP BY owner_id, day, island)"""
ORACLES = {
    "placement_faults": f"""WITH {scheduling.STEPS_SQL}, {_TIMES}, w AS (SELECT o_custkey AS owner_id, CAST(o_orderkey AS VARCHAR) AS key, DATE '{TODAY}' + CAST(o_orderkey % 23 - 1 AS INT) AS day, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderkey % 40 * 15 + 480 + CASE WHEN o_orderkey % 17 = 0 THEN 7 ELSE 0 END END AS s, o_orderkey % 5 * 15 + 20 AS m, deadline FROM orders JOIN c ON c.owner_id = o_custkey AND document_id = o_orderpriority)
      SELECT owner_id, key, CASE WHEN s IS NULL OR s % 15 <> 0 THEN 'invalid_time' WHEN s + m > 1440 THEN 'outside_availability' WHEN (day - DATE '{TODAY}') * 1440 + s < 600 THEN 'slot_in_past' WHEN day > deadline THEN 'after_deadline'
        WHEN NOT EXISTS (SELECT 1 FROM own o WHERE o.owner_id = w.owner_id AND o.day = w.day AND o.s <= w.s AND w.s + m <= o.e) THEN 'outside_availability' WHEN EXISTS (SELECT 1 FROM ext x WHERE x.owner_id = w.owner_id AND x.day = w.day AND x.s < w.s + m AND x.e > w.s) THEN 'calendar_busy'
        WHEN EXISTS (SELECT 1 FROM taken t WHERE t.owner_id = w.owner_id AND t.day = w.day AND t.s < w.s + m AND t.e > w.s) THEN 'slot_taken' END AS fault FROM w""",
    "final_review_covered": f"WITH {scheduling.STEPS_SQL}, {_TIMES}, {_COVERED} SELECT * FROM cov",
    "live_candidates": f"WITH {_LIVE} SELECT * FROM live",
    "queue_reasons": f"""WITH {_LIVE}, {_FREE}, rm AS (SELECT owner_id, day, e - CAST(ceil(CASE WHEN day = DATE '{TODAY}' THEN greatest(s, 600) ELSE s END / 15.0) * 15 AS INT) AS room FROM gaps WHERE day >= DATE '{TODAY}')
      SELECT owner_id, key, minutes, CASE WHEN EXISTS (SELECT 1 FROM rm WHERE rm.owner_id = live.owner_id AND rm.day <= coalesce(deadline, DATE '{TODAY}' + 14) AND room >= minutes) THEN 'held_by_pacing' WHEN deadline IS NOT NULL THEN 'no_room_before_deadline' ELSE 'no_room' END AS reason FROM live""",
}
