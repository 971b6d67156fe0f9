"""Streams end where their batch twins do."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import learning
from lectern.sources import adapters
from lectern.streaming import activity


def test_session_states_equal_their_batch_twin(spark, data, tmp_path):
    actions = activity.actions_of(spark.read.parquet(f"{data}/events.parquet"))
    source = f"{tmp_path}/in"
    for k in range(3):
        actions.where(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(source)
    # One batch holds all rows: order between batches is arrival order, which the batch twin does not know.
    stream = spark.readStream.schema(actions.schema).parquet(source)
    q = activity.session_states(stream).writeStream.format("memory").queryName("states").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(300)
    got = {r.session_id: r.state for r in spark.sql("SELECT session_id, max_by(state, n) AS state FROM (SELECT *, monotonically_increasing_id() AS n FROM states) GROUP BY 1").collect()}
    assert got == {r.session_id: r.state for r in activity.session_states_batch(actions).collect()}
    assert activity.step("scheduled", "complete") == ("scheduled", "refused") and activity.step("completed", "complete") == ("completed", "no_op")


def test_mastery_stream_equals_batch(spark, data, tmp_path):
    answers, attempts = adapters.answers(spark, data), adapters.attempts(spark, data)
    source = f"{tmp_path}/answers"
    for k in range(2):
        answers.where(f"attempt_id % 2 = {k}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(answers.schema).option("maxFilesPerTrigger", 1).parquet(source)
    activity.mastery_stream(spark, stream, f"{tmp_path}/history", attempts, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(300)
    key = lambda df: sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    assert key(activity.latest_mastery(spark, f"{tmp_path}/out")) == key(learning.topic_mastery(answers, attempts))


@pytest.mark.parametrize("name", sorted(activity.QUERIES))
def test_queries_run(spark, data, name):
    assert activity.QUERIES[name](spark, data).where(F.col("session_id").isNull()).count() == 0


def test_exchanges_are_kept_once_and_in_order(spark, tmp_path):
    kind = "exchange_id string, conv_id int, ts timestamp, question string, answer string, citations array<string>"
    from datetime import datetime

    at = lambda m: datetime(2026, 1, 1, 0, m)
    batches = [
        [("a", 1, at(5), "q2", "a2", ["s1", "s2"]), ("b", 1, at(1), "q1", "a1", None), ("a", 1, at(6), "again", "again", [])],
        [("b", 1, at(0), "late", "late", []), ("c", 2, at(3), "q", None, []), ("d", 1, at(5), "q3", "a3", ["s3"])],
        [("a", 1, at(9), "again", "again", []), ("c", 2, at(3), "q", None, [])],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in/*")
        activity.exchange_stream(spark, stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(300)
    kept = spark.read.parquet(f"{tmp_path}/out").drop("batch", "bucket")
    assert sorted((r.exchange_id, r.question) for r in kept.collect()) == [("a", "q2"), ("b", "q1"), ("c", "q"), ("d", "q3")]
    turns = activity.exchange_messages(kept).where("conv_id = 1").orderBy("turn").collect()
    assert [(r.turn, r.role, r.text, r.citations) for r in turns] == [(0, "user", "q1", []), (1, "assistant", "a1", []), (2, "user", "q2", []), (3, "assistant", "a2", ["s1", "s2"]), (4, "user", "q3", []), (5, "assistant", "a3", ["s3"])]


def test_messages_once_within_the_watermark(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:01:00"), (2, "2026-01-01 00:02:00")], "message_id int, t string").select("message_id", F.to_timestamp("t").alias("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = activity.messages_once(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start().awaitTermination(300)
    assert sorted(r.message_id for r in spark.sql("SELECT message_id FROM once").collect()) == [1, 2]
