"""Calendar algebra over every learner at once: half-open minute intervals keyed by (owner, day), never by one global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lectern.sources.tables import table

KEY = ["owner_id", "day"]
GRID = 30
# The weekday windows in which learners are free, in minutes of the day.
FREE_WINDOWS = ((9 * 60, 12 * 60), (14 * 60, 18 * 60))
DAILY_TARGET = 90


def merge(intervals: DataFrame) -> DataFrame:
    """Overlapping or touching intervals become one. An island starts where the running end of all before is passed."""
    order = W.partitionBy(*KEY).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = intervals.where("s < e").withColumn("starts", (before.isNull() | (F.col("s") > before)).cast("int"))
    rows = rows.withColumn("island", F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*KEY, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).select(*KEY, "s", "e")


def subtract(free: DataFrame, busy: DataFrame) -> DataFrame:
    """What is free and not busy, by a sweep over the bounds: each stretch between two bounds is one or the other. Bounds are dealt once, by learner and day."""
    bounds = lambda df, f, b: df.where("s < e").select(*KEY, F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(f).alias("f"), F.lit(b).alias("b")), F.struct(F.col("e").alias("at"), F.lit(-f).alias("f"), F.lit(-b).alias("b")))).alias("x"))
    events = bounds(free, 1, 0).unionByName(bounds(busy, 0, 1)).select(*KEY, "x.*").repartition(*KEY).groupBy(*KEY, "at").agg(F.sum("f").alias("f"), F.sum("b").alias("b"))
    order = W.partitionBy(*KEY).orderBy("at")
    running = order.rowsBetween(W.unboundedPreceding, 0)
    rows = events.select(*KEY, F.col("at").alias("s"), F.lead("at").over(order).alias("e"), F.sum("f").over(running).alias("free"), F.sum("b").over(running).alias("busy"))
    return merge(rows.where("free > 0 AND busy = 0 AND e IS NOT NULL").select(*KEY, "s", "e"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Busy sessions from events: 20 minutes and a part of the value, clipped to the day; errors count as missed."""
    e = table(spark, d, "events")
    start = F.hour("ts") * 60 + F.minute("ts")
    length = 20 + F.pmod(F.floor("value").cast("int"), F.lit(90))
    return e.select(F.col("event_id").alias("session_id"), F.col("user_id").alias("owner_id"), F.to_date("ts").alias("day"), start.alias("s"), F.least(start + length, F.lit(1440)).alias("e"), length.alias("minutes"), F.col("event_type").alias("status"), "ts")


def availability(busy: DataFrame) -> DataFrame:
    """The weekly windows on each day that a learner has sessions, weekdays only."""
    days = busy.select(*KEY).distinct().where(F.weekday("day") < 5)
    return days.select(*KEY, F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in FREE_WINDOWS))).alias("w")).select(*KEY, "w.s", "w.e")


def pad(busy: DataFrame, gap: int) -> DataFrame:
    """Busy time with a pause on both sides, within the day."""
    return busy.withColumn("s", F.greatest(F.col("s") - gap, F.lit(0))).withColumn("e", F.least(F.col("e") + gap, F.lit(1440)))


def align_up(minute: F.Column, grid: int = GRID) -> F.Column:
    """The next minute on the grid."""
    return (F.ceil(minute / grid) * grid).cast("int")


def daily_capacity(free: DataFrame, target: int = DAILY_TARGET) -> DataFrame:
    """What a day can hold: the free minutes, at most the target."""
    return free.groupBy(*KEY).agg(F.sum(F.col("e") - F.col("s")).cast("long").alias("free_minutes")).withColumn("capacity", F.least("free_minutes", F.lit(target).cast("long")))


def first_slot(free: DataFrame, minutes: int, grid: int = 5) -> DataFrame:
    """The first free start on the grid that fits `minutes`, for each learner."""
    rows = free.withColumn("at", align_up(F.col("s"), grid)).where(F.col("at") + minutes <= F.col("e"))
    return rows.groupBy("owner_id").agg(F.min(F.struct("day", "at")).alias("slot")).select("owner_id", "slot.day", "slot.at")


def session_totals(rows: DataFrame) -> DataFrame:
    """planned and completed sessions and minutes by learner; purchases stand for completed, errors for cancelled."""
    planned, done = F.col("status") != "error", F.col("status") == "purchase"
    return rows.groupBy("owner_id").agg(F.sum(planned.cast("long")).alias("planned"), F.sum(done.cast("long")).alias("completed"), F.sum(F.when(done, F.col("minutes")).otherwise(0)).cast("long").alias("minutes_done"), F.sum(F.when(planned & ~done, F.col("minutes")).otherwise(0)).cast("long").alias("minutes_left"))


def split_midnight(rows: DataFrame) -> DataFrame:
    """Sessions from their start over `minutes`, cut at midnight: one row for each day they touch."""
    days = F.sequence(F.to_date("ts"), F.to_date(F.col("ts") + F.make_dt_interval(mins=F.col("minutes"))))
    out = rows.select("session_id", "owner_id", "ts", "minutes", F.explode(days).alias("day"), F.to_date("ts").alias("first"), (F.hour("ts") * 60 + F.minute("ts")).alias("at"))
    offset = F.datediff("day", "first") * 1440
    s, e = F.greatest(F.col("at") - offset, F.lit(0)), F.least(F.col("at") + F.col("minutes") - offset, F.lit(1440))
    return out.select("session_id", "owner_id", "day", s.alias("s"), e.alias("e")).where("s < e")


def _free(spark: SparkSession, d: str, gap: int = 0) -> DataFrame:
    busy = sessions(spark, d).select(*KEY, "s", "e")
    return subtract(availability(busy), pad(busy, gap) if gap else busy)


SESSIONS_SQL = """sessions AS (SELECT event_id AS session_id, user_id AS owner_id, CAST(ts AS DATE) AS day, CAST(hour(ts) * 60 + minute(ts) AS INT) AS s, CAST(least(hour(ts) * 60 + minute(ts) + 20 + CAST(floor(value) AS INT) % 90, 1440) AS INT) AS e,
  CAST(20 + CAST(floor(value) AS INT) % 90 AS INT) AS minutes, event_type AS status, ts FROM events)"""


def merge_sql(name: str, source: str) -> str:
    return f"""{name} AS (SELECT owner_id, day, CAST(min(s) AS INT) AS s, CAST(max(e) AS INT) AS e FROM (SELECT *, sum(starts) OVER (PARTITION BY owner_id, day ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM
  (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY owner_id, day ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS starts FROM {source} WHERE s < e)) GROUP BY owner_id, day, island)"""


def free_sql(gap: int) -> str:
    return f"""{SESSIONS_SQL}, avail AS (SELECT DISTINCT owner_id, day, w.s, w.e FROM sessions, (VALUES (540, 720), (840, 1080)) AS w(s, e) WHERE isodow(day) < 6),
  padded AS (SELECT owner_id, day, greatest(s - {gap}, 0) AS s, least(e + {gap}, 1440) AS e FROM sessions), {merge_sql("busy", "padded")},
  gaps AS (SELECT a.owner_id, a.day, greatest(a.s, coalesce(b.lo, 0)) AS s, least(a.e, coalesce(b.hi, 1440)) AS e FROM avail a JOIN
    (SELECT owner_id, day, lag(e, 1, 0) OVER w AS lo, s AS hi FROM busy WINDOW w AS (PARTITION BY owner_id, day ORDER BY s) UNION ALL SELECT owner_id, day, max(e), 1440 FROM busy GROUP BY ALL) b ON a.owner_id = b.owner_id AND a.day = b.day),
  free AS (SELECT owner_id, day, CAST(s AS INT) AS s, CAST(e AS INT) AS e FROM gaps WHERE s < e)"""


QUERIES = {
    "interval_merge": lambda s, d: merge(sessions(s, d).select(*KEY, "s", "e")),
    "free_time": lambda s, d: _free(s, d),
    "free_time_padded": lambda s, d: _free(s, d, 20),
    "daily_capacity": lambda s, d: daily_capacity(_free(s, d)),
    "first_free_slot": lambda s, d: first_slot(_free(s, d), 45),
    "session_totals": lambda s, d: session_totals(sessions(s, d)),
    "split_at_midnight": lambda s, d: split_midnight(sessions(s, d)),
}
ORACLES = {
    "interval_merge": f"WITH {SESSIONS_SQL}, {merge_sql('merged', 'sessions')} SELECT * FROM merged",
    "free_time": f"WITH {free_sql(0)} SELECT * FROM free",
    "free_time_padded": f"WITH {free_sql(20)} SELECT * FROM free",
    "daily_capacity": f"WITH {free_sql(0)} SELECT owner_id, day, CAST(sum(e - s) AS BIGINT) AS free_minutes, CAST(least(sum(e - s), 90) AS BIGINT) AS capacity FROM free GROUP BY 1, 2",
    "first_free_slot": f"""WITH {free_sql(0)}, fits AS (SELECT *, CAST(ceil(s / 5.0) * 5 AS INT) AS "at" FROM free) SELECT owner_id, day, "at" FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY day, "at") AS rn FROM fits WHERE "at" + 45 <= e) WHERE rn = 1""",
    "session_totals": f"WITH {SESSIONS_SQL} SELECT owner_id, count(*) FILTER (status <> 'error') AS planned, count(*) FILTER (status = 'purchase') AS completed, CAST(coalesce(sum(minutes) FILTER (status = 'purchase'), 0) AS BIGINT) AS minutes_done, CAST(coalesce(sum(minutes) FILTER (status NOT IN ('error', 'purchase')), 0) AS BIGINT) AS minutes_left FROM sessions GROUP BY 1",
    "split_at_midnight": f"""WITH {SESSIONS_SQL}, x AS (SELECT *, CAST(hour(ts) * 60 + minute(ts) AS INT) AS "at" FROM sessions), y AS (SELECT session_id, owner_id, CAST(CAST(ts AS DATE) + k AS DATE) AS day, CAST(greatest("at" - 1440 * k, 0) AS INT) AS s, CAST(least("at" + minutes - 1440 * k, 1440) AS INT) AS e FROM x, (VALUES (0), (1)) AS v(k)) SELECT * FROM y WHERE s < e""",
}
