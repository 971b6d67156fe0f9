
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.tables import table


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("attempt_id"), F.col("o_custkey").alias("student_id"), F.col("o_orderpriority").alias("document_id"),
        F.concat_ws("-", F.col("o_custkey").cast("string"), F.col("o_orderpriority")).alias("quiz_id"),
        F.col("o_orderdate").alias("submitted_at"), (F.col("o_orderstatus") != "P").alias("completed"),
    )


def answers(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """(attempt_id, question_id) isn't unique in the source; the `tie` columns complete the order. Readers that rank the answers need no
    `distinct` rows, which cost a shuffle."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    rows = li.select(
        F.col("l_orderkey").alias("attempt_id"), F.col("l_linenumber").alias("question_id"), F.col("l_partkey").alias("concept_id"),
        F.pmod(F.col("l_partkey"), F.lit(7)).alias("topic_id"), (F.col("l_returnflag") != "R").alias("is_correct"),
        F.when(F.col("l_linestatus") == "F", "accepted_quality_warning").otherwise("accepted").alias("validation_outcome"),
        F.when(q <= 17, "easy").when(q <= 34, "medium").otherwise("difficult").alias("question_difficulty"),
        F.pmod(F.col("l_partkey"), F.lit(7)).alias("assessment_capacity"),
        F.col("l_suppkey").alias("tie1"), F.col("l_shipdate").alias("tie2"), F.col("l_extendedprice").alias("tie3"),
    )
    return rows.distinct() if distinct else rows


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as mastery reads them: difficulty in either case or missing, some concepts blank, some answers of flashcard practice, some under a concept plan."""
    k, concept = F.col("tie1"), F.col("concept_id")
    return answers(spark, sf_dir, distinct=False).withColumns({
        "question_difficulty": F.when(k % 4 == 0, F.upper("question_difficulty")).when(k % 13 != 1, F.col("question_difficulty")),
        "concept_origin": F.when(k % 9 == 0, "flashcard"),
        "concept_plan_id": F.when(F.col("attempt_id") % 3 == 0, F.concat(F.lit("plan-"), (F.col("attempt_id") % 2).cast("string"))).when(F.col("attempt_id") % 3 == 1, " "),
        "concept_id": F.when(concept % 10 == 0, " ").otherwise(concept.cast("string")),
    })


#: The same tables as DuckDB CTEs.
ATTEMPTS_SQL = """attempts AS (SELECT o_orderkey AS attempt_id, o_custkey AS student_id, o_orderpriority AS document_id,
  concat_ws('-', CAST(o_custkey AS VARCHAR), o_orderpriority) AS quiz_id, o_orderdate AS submitted_at, o_orderstatus <> 'P' AS completed FROM orders)"""
ANSWERS_SQL = """answers AS (SELECT DISTINCT l_orderkey AS attempt_id, l_linenumber AS question_id, l_partkey AS concept_id, l_partkey % 7 AS topic_id, l_partkey % 7 AS assessment_capacity,
  l_returnflag <> 'R' AS is_correct, CASE WHEN l_linestatus = 'F' THEN 'accepted_quality_warning' ELSE 'accepted' END AS validation_outcome,
  CASE WHEN l_quantity <= 17 THEN 'easy' WHEN l_quantity <= 34 THEN 'medium' ELSE 'difficult' END AS question_difficulty,
  l_suppkey AS tie1, l_shipdate AS tie2, l_extendedprice AS tie3 FROM lineitem)"""
EVIDENCE_SQL = """evidence AS (SELECT * REPLACE (CASE WHEN tie1 % 4 = 0 THEN upper(question_difficulty) WHEN tie1 % 13 <> 1 THEN question_difficulty END AS question_difficulty, CASE WHEN concept_id % 10 = 0 THEN ' ' ELSE CAST(concept_id AS VARCHAR) END AS concept_id),
  CASE WHEN tie1 % 9 = 0 THEN 'flashcard' END AS concept_origin, CASE WHEN attempt_id % 3 = 0 THEN 'plan-' || (attempt_id % 2) WHEN attempt_id % 3 = 1 THEN ' ' END AS concept_plan_id FROM answers)"""
