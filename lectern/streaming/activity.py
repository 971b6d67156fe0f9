"""Streaming twins of the batch operators: mastery of touched topics, session states, messages kept once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators import learning

KEYS = ["student_id", "document_id", "topic_id"]


def touched(new_answers: DataFrame, attempts: DataFrame) -> DataFrame:
    """The topics of a micro-batch of answers."""
    return new_answers.join(attempts, "attempt_id").select(*KEYS).distinct()


def refresh_mastery(answers: DataFrame, attempts: DataFrame, topics: DataFrame) -> DataFrame:
    """Mastery of the given topics only; every other topic keeps its row."""
    rows = answers.join(attempts.select("attempt_id", "student_id", "document_id"), "attempt_id").join(topics, KEYS, "left_semi")
    return learning.topic_mastery(rows.drop("student_id", "document_id"), attempts)


#: Parts of a stream's history by key, so that a micro-batch reads what it touches.
BUCKETS = 64


def bucket(*keys: str) -> F.Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def touched_history(spark: SparkSession, history: str, rows: DataFrame, number: int) -> DataFrame:
    """The history up to a batch, of the buckets that `rows` fall into alone: other parts are pruned from the scan."""
    buckets = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS
    return spark.read.parquet(history).where(F.col("batch") <= number).where(F.col("bucket").isin(buckets)).drop("batch", "bucket")


def mastery_stream(spark: SparkSession, new_answers: DataFrame, history: str, attempts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is appended to the history, in buckets of its topics; these are computed anew from their buckets and written under the batch's number, so a repeated batch overwrites itself."""

    def batch(frame: DataFrame, number: int) -> None:
        keyed = frame.join(attempts.select("attempt_id", "student_id", "document_id"), "attempt_id").withColumn("bucket", bucket(*KEYS)).drop("student_id", "document_id")
        keyed.write.mode("overwrite").partitionBy("bucket").parquet(f"{history}/batch={number}")
        new = spark.read.parquet(f"{history}/batch={number}")
        whole = touched_history(spark, history, new, number).distinct()
        refresh_mastery(whole, attempts, touched(new, attempts)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return new_answers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_mastery(spark: SparkSession, out: str) -> DataFrame:
    """The newest row of each topic over all batches."""
    rows = spark.read.parquet(out)
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (*KEYS, "batch"))), "batch").alias("r")).select(*KEYS, "r.*")


def messages_once(messages: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each message once, if its repetition comes within `late` (our choice)."""
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["message_id"])


def exchange_stream(spark: SparkSession, exchanges: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Exchanges (exchange_id, conv_id, ts, question, answer, citations: array of texts) kept once each, however late they repeat: the first by time of a micro-batch, if no earlier one holds its id. A batch that is repeated overwrites itself."""

    def batch(frame: DataFrame, number: int) -> None:
        rest = [c for c in frame.columns if c != "exchange_id"]
        first = frame.groupBy("exchange_id").agg(F.min(F.struct("ts", *(c for c in rest if c != "ts"))).alias("x")).select("exchange_id", "x.*").withColumn("bucket", bucket("exchange_id"))
        if number:
            known = touched_history(spark, out, first, number - 1).select("exchange_id")
            first = first.join(known, "exchange_id", "left_anti")
        first.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/batch={number}")

    return exchanges.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exchange_messages(kept: DataFrame) -> DataFrame:
    """The kept exchanges as numbered messages of their conversation, question before answer, in order of time; the answer with its citations."""
    order = W.partitionBy("conv_id").orderBy("ts", "exchange_id")
    rows = kept.withColumn("n", F.row_number().over(order) - 1)
    none = F.array().cast("array<string>")
    sides = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("text"), none.alias("citations")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text"), F.coalesce("citations", none).alias("citations")))
    return rows.select("conv_id", "exchange_id", "n", F.posexplode(sides).alias("side", "m")).select("conv_id", (F.col("n") * 2 + F.col("side")).alias("turn"), "exchange_id", "m.role", "m.text", "m.citations")


# The moves of a session; anything else is refused.
MOVES = {("scheduled", "start"): "in_progress", ("in_progress", "complete"): "completed", ("scheduled", "skip"): "skipped", ("in_progress", "skip"): "skipped"}
OUTPUT = "session_id long, action string, state string, outcome string"


def step(state: str, action: str) -> tuple[str, str]:
    """The state after an action, and what became of it: done, a repeated action is a no-op, else refused."""
    if (state, action) in MOVES:
        return MOVES[state, action], "done"
    return state, "no_op" if state in {after for (_, a), after in MOVES.items() if a == action} else "refused"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get[0] if state.exists else "scheduled"
    rows = []
    for action in pd.concat(frames).sort_values(["ts", "event_id"])["action"]:
        now, outcome = step(now, action)
        rows.append((key[0], action, now, outcome))
    state.update((now,))
    yield pd.DataFrame(rows, columns=["session_id", "action", "state", "outcome"])


def session_states(actions: DataFrame) -> DataFrame:
    """A state for each session over a stream of (session_id, event_id, ts, action)."""
    return actions.groupBy("session_id").applyInPandasWithState(_fold, OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout)


def session_states_batch(actions: DataFrame) -> DataFrame:
    """S02's batch twin: the last state of each session, by a fold over its actions in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "action"))), lambda x: x["action"])
    moved = lambda s, a: F.coalesce(*(F.when((s == before) & (a == action), F.lit(after)) for (before, action), after in MOVES.items()), s)
    return actions.groupBy("session_id").agg(F.aggregate(ordered, F.lit("scheduled"), moved).alias("state"))


def overdue(sessions: DataFrame, now: str) -> DataFrame:
    """Sessions that were due before the clock and are neither completed nor skipped."""
    return sessions.where((F.col("scheduled_end") <= F.to_timestamp(F.lit(now))) & F.col("state").isin("scheduled", "in_progress"))


def actions_of(events: DataFrame) -> DataFrame:
    """Session actions from events: a learner's day is a session; views start it, purchases complete it, errors skip it."""
    action = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "skip")
    return events.select((F.col("user_id") * 100_000 + F.datediff(F.to_date("ts"), F.lit("2000-01-01"))).alias("session_id"), "event_id", "ts", action.alias("action")).where("action IS NOT NULL")


QUERIES = {
    "session_states": lambda s, d: session_states_batch(actions_of(s.read.parquet(f"{d}/events.parquet"))),
    "overdue_sessions": lambda s, d: overdue(session_states_batch(actions_of(s.read.parquet(f"{d}/events.parquet"))).withColumn("scheduled_end", F.timestamp_seconds((F.col("session_id") % 100_000) * 86_400 + 946_771_200)), "2024-01-20 00:00:00").select("session_id", "state"),
}
STATES_SQL = """a AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS rn FROM (SELECT user_id * 100000 + date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS session_id, event_id, ts,
  CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'skip' END AS action FROM events) WHERE action IS NOT NULL),
f AS (SELECT session_id, min(rn) AS r1, arg_min(action, rn) AS a1 FROM a WHERE action IN ('start', 'skip') GROUP BY 1), g AS (SELECT session_id, arg_min(action, rn) AS a2 FROM a JOIN f USING (session_id) WHERE a1 = 'start' AND rn > r1 AND action IN ('complete', 'skip') GROUP BY 1),
states AS (SELECT session_id, CASE WHEN a1 IS NULL THEN 'scheduled' WHEN a1 = 'skip' THEN 'skipped' WHEN a2 IS NULL THEN 'in_progress' WHEN a2 = 'complete' THEN 'completed' ELSE 'skipped' END AS state FROM (SELECT DISTINCT session_id FROM a) LEFT JOIN f USING (session_id) LEFT JOIN g USING (session_id))"""
ORACLES = {
    "session_states": f"WITH {STATES_SQL} SELECT * FROM states",
    "overdue_sessions": f"WITH {STATES_SQL} SELECT * FROM states WHERE state IN ('scheduled', 'in_progress') AND DATE '2000-01-01' + CAST(session_id % 100000 AS INT) <= DATE '2024-01-19'",
}
