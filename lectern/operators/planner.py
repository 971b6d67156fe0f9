"""Study planning for all learners at once: priorities, apportionment, risks, diffs and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lectern.functions.staging import cut
from lectern.operators import intervals
from lectern.sources.tables import table

# Weights of urgency, review, performance and workload, and the cap of questions for a document.
PRIORITY = (0.35, 0.35, 0.20, 0.10)
DOCUMENT_CAP = 40


def base_priority(rows: DataFrame) -> DataFrame:
    """The weighted sum of four needs between 0 and 1, as ten-thousandths."""
    names = ("urgency", "review", "performance", "workload")
    total = sum((F.lit(int(w * 100)) * F.col(n) for w, n in zip(PRIORITY, names)), F.lit(0))
    return rows.select("owner_id", "document_id", total.cast("long").alias("priority"))


def needs(spark: SparkSession, d: str) -> DataFrame:
    """Needs in hundredths from orders: age, price and status of a customer's orders at a priority."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("owner_id"), F.col("o_orderpriority").alias("document_id"))
    return o.agg(F.pmod(F.datediff(F.lit("2002-01-01"), F.to_date(F.max("o_orderdate"))), F.lit(101)).alias("urgency"), F.pmod(F.count(F.lit(1)) * 17, F.lit(101)).alias("review"), F.pmod(F.floor(F.max("o_totalprice")), F.lit(101)).alias("performance"), F.pmod(F.max("o_orderkey"), F.lit(101)).alias("workload"))


def largest_remainder(scores: DataFrame, total: int) -> DataFrame:
    """Whole minutes in proportion to scores that sum to the total: floors first, the rest to the largest remainders. Scores that are all zero count alike."""
    own = W.partitionBy("owner_id")
    rows = scores.withColumn("score", F.when(F.sum("score").over(own) == 0, F.lit(1)).otherwise(F.col("score")))
    rows = rows.withColumn("sum", F.sum("score").over(own)).withColumn("floor", F.expr(f"score * {total} div sum")).withColumn("rest", F.col("score") * total - F.col("floor") * F.col("sum"))
    rows = rows.withColumn("left", F.lit(total) - F.sum("floor").over(own)).withColumn("rank", F.row_number().over(own.orderBy(F.desc("rest"), "topic_id")))
    return rows.select("owner_id", "topic_id", (F.col("floor") + (F.col("rank") <= F.col("left")).cast("long")).alias("minutes"))


def allocate(topics: DataFrame, cap: int = DOCUMENT_CAP) -> DataFrame:
    """Questions over a document's topics: one each (the largest, where there are more topics than questions), then always to the
    topic with most capacity left, then repeats in turn. The greedy loop is a ranking of (capacity left, topic) slots."""
    own = W.partitionBy("document_id")
    valid = topics.where("capacity > 0").withColumn("place", F.row_number().over(own.orderBy(F.desc("capacity"), "topic_id"))).where(F.col("place") <= cap)
    valid = valid.withColumn("extra", F.greatest(F.lit(cap) - F.sum("capacity").over(own), F.lit(0))).withColumn("topics", F.count(F.lit(1)).over(own))
    repeats = F.expr("extra div topics") + (F.col("place") <= F.col("extra") % F.col("topics")).cast("long")
    slots = valid.withColumn("repeats", repeats).withColumn("n", F.explode(F.sequence(F.lit(1), F.least("capacity", F.lit(cap)).cast("int")))).withColumn("left", F.col("capacity") - F.col("n") + 1)
    order = own.orderBy(F.when(F.col("n") == 1, 0).otherwise(1), F.when(F.col("n") > 1, -F.col("left")), "topic_id")
    taken = slots.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)
    return taken.groupBy("document_id", "topic_id").agg((F.count(F.lit(1)) + F.max("repeats")).alias("questions"))


def calendar_diff(wanted: DataFrame, linked: DataFrame) -> DataFrame:
    """What to create, update, delete or leave, by a hash of the payload."""
    rows = wanted.join(linked, "session_id", "full_outer")
    action = F.when(F.col("known_hash").isNull(), "create").when(F.col("payload_hash").isNull(), "delete").when(F.col("known_hash") != F.col("payload_hash"), "update").otherwise("unchanged")
    return rows.select("session_id", action.alias("action"))


def lineage(rows: DataFrame) -> DataFrame:
    """The first session of each chain of reschedulings, by pointer jumping: each round doubles the length it covers, until nothing
    changes. Chains that end in a circle have no first session; they stop after the rounds that the longest chain could need."""
    current = rows.select("session_id", F.coalesce("rescheduled_from", "session_id").alias("origin"))
    for _ in range(rows.count().bit_length() + 1):
        jump = current.select(F.col("session_id").alias("origin"), F.col("origin").alias("next"))
        current = current.join(jump, "origin", "left").select("session_id", F.coalesce("next", "origin").alias("origin"), (F.col("next") != F.col("origin")).alias("moved"))
        current = cut(current)
        moved = not current.where("moved").isEmpty()
        current = current.select("session_id", "origin")
        if not moved:
            break
    return current


def _wanted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = intervals.sessions(spark, d)
    payload = F.sha2(F.concat_ws("|", F.col("owner_id").cast("string"), F.col("day").cast("string"), F.col("s").cast("string"), F.col("e").cast("string")), 256)
    wanted = s.where("session_id % 11 <> 0").select("session_id", payload.alias("payload_hash"))
    linked = s.where("session_id % 7 <> 0").select("session_id", F.when(F.col("session_id") % 5 == 0, F.lit("old")).otherwise(payload).alias("known_hash"))
    return wanted, linked


def _chains(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a learner on a day, each moved from the one before."""
    s = intervals.sessions(spark, d)
    return s.select("session_id", F.lag("session_id").over(W.partitionBy("owner_id", "day").orderBy("s", "session_id")).alias("rescheduled_from"))


def _topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_type").alias("document_id"), F.col("p_brand").alias("topic_id")).agg(F.count(F.lit(1)).alias("capacity"))


PAYLOAD = "sha256(concat_ws('|', CAST(owner_id AS VARCHAR), CAST(day AS VARCHAR), CAST(s AS VARCHAR), CAST(e AS VARCHAR)))"
QUERIES = {
    "base_priority": lambda s, d: base_priority(needs(s, d)),
    "largest_remainder": lambda s, d: largest_remainder(table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("owner_id"), F.pmod("l_partkey", F.lit(7)).alias("topic_id")).agg(F.count(F.lit(1)).alias("score")), 600),
    "topic_allocation": lambda s, d: allocate(_topics(s, d)),
    "calendar_diff": lambda s, d: calendar_diff(*_wanted(s, d)),
    "session_lineage": lambda s, d: lineage(_chains(s, d)),
}
ORACLES = {
    "base_priority": """SELECT owner_id, document_id, CAST(35 * urgency + 35 * review + 20 * performance + 10 * workload AS BIGINT) AS priority FROM (SELECT o_custkey AS owner_id, o_orderpriority AS document_id, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2002-01-01') % 101 AS urgency, (count(*) * 17) % 101 AS review,
      CAST(floor(max(o_totalprice)) AS BIGINT) % 101 AS performance, max(o_orderkey) % 101 AS workload FROM orders GROUP BY 1, 2)""",
    "largest_remainder": """WITH s AS (SELECT l_suppkey AS owner_id, l_partkey % 7 AS topic_id, count(*) AS score FROM lineitem GROUP BY 1, 2), a AS (SELECT *, sum(score) OVER (PARTITION BY owner_id) AS total FROM s), f AS (SELECT *, score * 600 // total AS fl, score * 600 % total AS rest FROM a),
      r AS (SELECT *, 600 - sum(fl) OVER (PARTITION BY owner_id) AS room, row_number() OVER (PARTITION BY owner_id ORDER BY rest DESC, topic_id) AS rank FROM f) SELECT owner_id, topic_id, CAST(fl + CASE WHEN rank <= room THEN 1 ELSE 0 END AS BIGINT) AS minutes FROM r""",
    "topic_allocation": """WITH t AS (SELECT p_type AS document_id, p_brand AS topic_id, count(*) AS cap FROM part GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY cap DESC, topic_id) AS place FROM t),
      v AS (SELECT *, greatest(40 - sum(cap) OVER (PARTITION BY document_id), 0) AS extra, count(*) OVER (PARTITION BY document_id) AS topics FROM p WHERE place <= 40),
      s AS (SELECT *, unnest(range(1, least(cap, 40) + 1)) AS n FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN n = 1 THEN 0 ELSE 1 END, CASE WHEN n > 1 THEN n - cap - 1 END NULLS FIRST, topic_id) AS rank FROM s)
      SELECT document_id, topic_id, CAST(count(*) + max(extra // topics + CASE WHEN place <= extra % topics THEN 1 ELSE 0 END) AS BIGINT) AS questions FROM r WHERE rank <= 40 GROUP BY 1, 2""",
    "calendar_diff": f"""WITH {intervals.SESSIONS_SQL}, w AS (SELECT session_id, {PAYLOAD} AS p FROM sessions WHERE session_id % 11 <> 0), l AS (SELECT session_id, CASE WHEN session_id % 5 = 0 THEN 'old' ELSE {PAYLOAD} END AS k FROM sessions WHERE session_id % 7 <> 0)
      SELECT session_id, CASE WHEN k IS NULL THEN 'create' WHEN p IS NULL THEN 'delete' WHEN k <> p THEN 'update' ELSE 'unchanged' END AS action FROM w FULL OUTER JOIN l USING (session_id)""",
    "session_lineage": f"WITH {intervals.SESSIONS_SQL} SELECT session_id, first_value(session_id) OVER (PARTITION BY owner_id, day ORDER BY s, session_id) AS origin FROM sessions",
}
