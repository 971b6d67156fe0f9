"""Grading, mastery, gaps, recommendations and progress, for every learner at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lectern.sources import adapters as A

# Weights of difficulty and validation outcome, and the level bounds.
DIFFICULTY = {"easy": 1.0, "medium": 1.5, "difficult": 2.0}
OUTCOME = {"accepted": 1.0, "accepted_quality_warning": 0.75}
LEVELS = ((85, "Mastered"), (70, "Proficient"), (50, "Developing"))
# Answers that suffice without a concept plan, and the share of a plan's capacity that must be met.
LEAST_ANSWERS, COVERAGE = 3, 0.6


def weight_of(column: F.Column, weights: dict[str, float], blank: str) -> F.Column:
    """Weight by value, 1.0 for unknown ones; a missing or empty value counts as `blank`."""
    value = F.when(F.coalesce(column, F.lit("")) == "", blank).otherwise(column)
    return F.coalesce(*(F.when(value == k, F.lit(v)) for k, v in weights.items()), F.lit(1.0))


TOPIC = ["student_id", "document_id", "topic_id"]


def latest_answers(answers: DataFrame, attempts: DataFrame) -> DataFrame:
    """the newest response to each question of a quiz and topic, submitted attempts only, without practice on flashcards.

    The rows are dealt out by topic once; what ranks and adds them up needs no other partitioning."""
    for name in ("concept_origin", "concept_plan_id"):
        if name not in answers.columns:
            answers = answers.withColumn(name, F.lit(None).cast("string"))
    rows = answers.where(~F.col("concept_origin").eqNullSafe("flashcard")).join(attempts.where("submitted_at IS NOT NULL AND completed"), "attempt_id").repartition(*TOPIC)
    ties = [F.desc(c) for c in ("concept_id", "tie1", "tie2", "tie3", "question_difficulty", "validation_outcome", "is_correct") if c in rows.columns]
    newest = W.partitionBy(*TOPIC, "quiz_id", "question_id").orderBy(F.desc("submitted_at"), F.desc("attempt_id"), *ties)
    return rows.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")


def newest_plan(snapshots: DataFrame) -> DataFrame:
    """of a learner's answers to a topic, those under its newest concept plan; all of them where none was planned."""
    planned = F.when(F.trim(F.coalesce("concept_plan_id", F.lit(""))) != "", F.struct("submitted_at", "attempt_id", "concept_plan_id"))
    rows = snapshots.withColumn("newest", F.max(planned).over(W.partitionBy(*TOPIC))["concept_plan_id"])
    return rows.where("newest IS NULL OR concept_plan_id = newest").drop("newest")


def topic_mastery(answers: DataFrame, attempts: DataFrame) -> DataFrame:
    """weighted score, coverage and level of each learner's topics. With a concept plan (capacity > 0) enough of its concepts must be met, else three answers do."""
    weight = weight_of(F.lower("question_difficulty"), DIFFICULTY, "easy") * weight_of(F.col("validation_outcome"), OUTCOME, "accepted")
    concept = F.when(F.trim(F.col("concept_id").cast("string")) != "", F.col("concept_id").cast("string"))
    g = newest_plan(latest_answers(answers, attempts)).groupBy(*TOPIC).agg(
        F.sum(F.when(F.col("is_correct"), weight).otherwise(0.0)).alias("earned"), F.sum(weight).alias("possible"), F.count(F.lit(1)).alias("answered"),
        F.sum(F.col("is_correct").cast("long")).alias("correct"), F.size(F.collect_set(concept)).cast("long").alias("concepts"), F.size(F.collect_set("quiz_id")).cast("long").alias("quizzes"), F.max("submitted_at").alias("last_evidence_at"), F.coalesce(F.max("assessment_capacity"), F.lit(0)).cast("long").alias("capacity"))
    score = F.when(F.col("possible") > 0, two_places(100 * F.col("earned") / F.col("possible"))).otherwise(0.0)
    planned = F.col("capacity") > 0
    required = F.when(planned, F.least("capacity", F.greatest(F.lit(1), F.ceil(F.col("capacity") * COVERAGE)))).otherwise(0)
    ratio = F.when(planned, F.floor(F.least(F.lit(1.0), F.col("concepts") / F.col("capacity")) * 10000 + 0.5) / 10000).otherwise(0.0)
    enough = F.when(planned, F.col("concepts") >= F.col("required")).otherwise(F.col("answered") >= LEAST_ANSWERS)
    level = F.lit("Weak")
    for bound, name in reversed(LEVELS):
        level = F.when(F.col("score") >= bound, name).otherwise(level)
    g = g.withColumn("score", score).withColumn("required", required).withColumn("coverage", ratio).withColumn("sufficient", enough)
    return g.withColumn("level", F.when(~F.col("sufficient"), "Insufficient evidence").otherwise(level)).select(
        *TOPIC, "answered", "correct", "concepts", "quizzes", "capacity", F.col("required").cast("long").alias("required"), "coverage", "score", "sufficient", "level", "last_evidence_at")


def recomputed_mastery(answers: DataFrame, attempts: DataFrame) -> DataFrame:
    """mastery of every topic that a submitted attempt has touched; without any evidence left (practice alone) it is not assessed."""
    done = attempts.where("submitted_at IS NOT NULL AND completed").select("attempt_id", "student_id", "document_id")
    touched = answers.select("attempt_id", "topic_id").join(done, "attempt_id").select(*TOPIC).distinct()
    rows = touched.join(topic_mastery(answers, attempts), TOPIC, "left")
    numbers = ["answered", "correct", "concepts", "quizzes", "capacity", "required", "coverage", "score"]
    return rows.na.fill(0, numbers).withColumn("sufficient", F.coalesce("sufficient", F.lit(False))).withColumn("level", F.coalesce("level", F.lit("Not assessed")))


def named_mastery(mastery: DataFrame, answers: DataFrame, attempts: DataFrame) -> DataFrame:
    """mastery with the topic's name as the newest answers give it, its id where none does. Of one attempt the first question counts; practice doesn't."""
    named = answers.where(~F.col("concept_origin").eqNullSafe("flashcard") & (F.coalesce("topic_name", F.lit("")) != "")).join(attempts, "attempt_id")
    newest = F.max(F.struct("submitted_at", (-F.col("question_id")).alias("early"), "attempt_id", "topic_name"))["topic_name"]
    return mastery.join(named.groupBy(*TOPIC).agg(newest.alias("topic_name")), TOPIC, "left").withColumn("topic_name", F.coalesce("topic_name", F.col("topic_id").cast("string")))


def regraded(answers: DataFrame, marks: DataFrame) -> DataFrame:
    """answers after a learner's own marks (attempt_id, question_id, is_correct, at), of which the newest counts; then score and percentage of each attempt that was marked."""
    last = marks.groupBy("attempt_id", "question_id").agg(F.max(F.struct("at", "is_correct"))["is_correct"].alias("mark"))
    rows = answers.join(last.select("attempt_id").distinct(), "attempt_id", "left_semi").join(last, ["attempt_id", "question_id"], "left").withColumn("is_correct", F.coalesce("mark", "is_correct"))
    counts = rows.groupBy("attempt_id").agg(F.sum(F.col("is_correct").cast("long")).alias("score"), F.count(F.lit(1)).alias("total"))
    return counts.withColumn("percentage", two_places(100 * F.col("score") / F.col("total")))


def _named(spark: SparkSession, d: str) -> DataFrame:
    answers, attempts = A.evidence(spark, d), A.attempts(spark, d)
    named = answers.withColumn("topic_name", F.when(F.col("attempt_id") % 3 != 0, F.concat(F.lit("Topic "), (F.col("attempt_id") % 5).cast("string"))))
    rows = named_mastery(recomputed_mastery(answers, attempts), named, attempts.where("completed AND submitted_at IS NOT NULL"))
    return rows.select(*TOPIC, "topic_name", "answered", "score", "level")


def _regraded(spark: SparkSession, d: str) -> DataFrame:
    """Marks by two suppliers' line items of a question: the one with the larger key is the newer."""
    rows = A.answers(spark, d)
    return regraded(rows, rows.where("tie1 % 4 = 0").select("attempt_id", "question_id", (F.col("concept_id") % 2 == 0).alias("is_correct"), F.struct("tie1", "concept_id").alias("at")))


def _topic_mastery(spark: SparkSession, d: str) -> DataFrame:
    return topic_mastery(A.evidence(spark, d), A.attempts(spark, d))


LATEST_SQL = """latest AS (SELECT * FROM (SELECT a.*, t.student_id, t.document_id, t.quiz_id, t.submitted_at, row_number() OVER (PARTITION BY student_id, document_id, topic_id, quiz_id, question_id
  ORDER BY submitted_at DESC, a.attempt_id DESC, concept_id DESC, tie1 DESC, tie2 DESC, tie3 DESC, question_difficulty DESC, validation_outcome DESC, is_correct DESC) AS rn
  FROM evidence a JOIN attempts t ON a.attempt_id = t.attempt_id WHERE t.completed AND t.submitted_at IS NOT NULL AND concept_origin IS DISTINCT FROM 'flashcard') WHERE rn = 1),
  plans AS (SELECT student_id, document_id, topic_id, concept_plan_id AS newest FROM latest WHERE trim(concept_plan_id) <> '' QUALIFY row_number() OVER (PARTITION BY student_id, document_id, topic_id ORDER BY submitted_at DESC, attempt_id DESC, concept_plan_id DESC) = 1)"""
MASTERY_SQL = """weighted AS (SELECT latest.*, CASE lower(question_difficulty) WHEN 'medium' THEN 1.5 WHEN 'difficult' THEN 2.0 ELSE 1.0 END * CASE validation_outcome WHEN 'accepted_quality_warning' THEN 0.75 ELSE 1.0 END AS weight
  FROM latest LEFT JOIN plans USING (student_id, document_id, topic_id) WHERE newest IS NULL OR concept_plan_id = newest),
grouped AS (SELECT student_id, document_id, topic_id, CAST(sum(CASE WHEN is_correct THEN weight ELSE 0 END) AS DOUBLE) AS earned, CAST(sum(weight) AS DOUBLE) AS possible, count(*) AS answered,
  CAST(sum(CAST(is_correct AS INT)) AS BIGINT) AS correct, count(DISTINCT nullif(trim(concept_id), '')) AS concepts, count(DISTINCT quiz_id) AS quizzes, max(submitted_at) AS last_evidence_at, coalesce(max(assessment_capacity), 0) AS capacity FROM weighted GROUP BY ALL),
scored AS (SELECT *, CAST(CASE WHEN capacity > 0 THEN least(capacity, greatest(1, ceil(capacity * CAST(0.6 AS DOUBLE)))) ELSE 0 END AS BIGINT) AS required, CASE WHEN capacity > 0 THEN floor(least(1.0, concepts / capacity) * 10000 + 0.5) / 10000 ELSE 0.0 END AS coverage, CASE WHEN possible > 0 THEN floor(100 * earned / possible * 100 + 0.5) / 100 ELSE 0.0 END AS score FROM grouped),
judged AS (SELECT *, CASE WHEN capacity > 0 THEN concepts >= required ELSE answered >= 3 END AS enough FROM scored),
mastery AS (SELECT student_id, document_id, topic_id, answered, correct, concepts, quizzes, CAST(capacity AS BIGINT) AS capacity, required, CAST(coverage AS DOUBLE) AS coverage, score, enough AS sufficient, CASE WHEN NOT enough THEN 'Insufficient evidence' WHEN score >= 85 THEN 'Mastered'
  WHEN score >= 70 THEN 'Proficient' WHEN score >= 50 THEN 'Developing' ELSE 'Weak' END AS level, last_evidence_at FROM judged)"""
BASE_SQL = f"WITH {A.ATTEMPTS_SQL}, {A.ANSWERS_SQL}, {A.EVIDENCE_SQL}, {LATEST_SQL}, {MASTERY_SQL}"


def attempt_scores(answers: DataFrame, attempts: DataFrame) -> DataFrame:
    """score, total, percentage to two places and number of each submitted attempt."""
    counts = answers.groupBy("attempt_id").agg(F.sum(F.col("is_correct").cast("long")).alias("score"), F.count(F.lit(1)).alias("total"))
    order = W.partitionBy("student_id", "quiz_id").orderBy("submitted_at", "attempt_id")
    done = attempts.where("completed").withColumn("attempt_number", F.row_number().over(order).cast("long"))
    return done.join(counts, "attempt_id").select("attempt_id", "student_id", "document_id", "quiz_id", "submitted_at", "score", "total", two_places(100 * F.col("score") / F.col("total")).alias("percentage"), "attempt_number")


def two_places(value: F.Column) -> F.Column:
    """Half up at two places."""
    return F.floor(value * 100 + 0.5) / 100


def mean_places(column: str) -> F.Column:
    """Mean of two-place values, half up at two places: summed as whole hundredths, so that the order of rows can't matter."""
    return F.floor(F.sum(F.round(F.col(column) * 100).cast("long")) / F.count(column) + 0.5) / 100


def latest_attempts(scores: DataFrame) -> DataFrame:
    """the newest attempt of each student's quiz."""
    newest = W.partitionBy("student_id", "quiz_id").orderBy(F.desc("submitted_at"), F.desc("attempt_id"))
    return scores.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")


def attempt_summary(scores: DataFrame) -> DataFrame:
    """number, latest, best and average percentage of each student's quiz; one aggregate, no window."""
    return scores.groupBy("student_id", "quiz_id").agg(F.count(F.lit(1)).alias("attempts"), F.max_by("percentage", F.struct("submitted_at", "attempt_id")).alias("latest"), F.max("percentage").alias("best"), mean_places("percentage").alias("average"))


def attempt_trend(scores: DataFrame) -> DataFrame:
    """change of the last two gradable attempts at a document; five points either way count."""
    order = W.partitionBy("student_id", "document_id").orderBy("submitted_at", "attempt_id")
    last = W.partitionBy("student_id", "document_id").orderBy(F.desc("submitted_at"), F.desc("attempt_id"))
    rows = scores.where("total > 0").withColumn("before", F.lag("percentage").over(order)).withColumn("rn", F.row_number().over(last)).where("rn = 1")
    change = F.col("percentage") - F.col("before")
    return rows.select("student_id", "document_id", "percentage", "before", F.when(change >= 5, "improving").when(change <= -5, "declining").when(change.isNotNull(), "steady").alias("trend"))


def current_performance(scores: DataFrame) -> DataFrame:
    """mean of the latest percentage over the documents that a student was assessed on."""
    latest = scores.groupBy("student_id", "document_id").agg(F.max_by("percentage", F.struct("submitted_at", "attempt_id")).alias("latest"))
    return latest.groupBy("student_id").agg(mean_places("latest").alias("performance"), F.count(F.lit(1)).alias("documents"))


def knowledge_gaps(mastery: DataFrame) -> DataFrame:
    """weak topics are severe, developing ones moderate; ranked for each student."""
    severity = F.when(F.col("level") == "Weak", "high").when(F.col("level") == "Developing", "moderate")
    rows = mastery.where("sufficient AND level IN ('Weak', 'Developing')").withColumn("severity", severity)
    order = W.partitionBy("student_id").orderBy(F.when(F.col("severity") == "high", 0).otherwise(1), "score", "concepts", "document_id", "topic_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).select("student_id", "document_id", "topic_id", "score", "severity", "rank")


def recommendations(mastery: DataFrame, topics: DataFrame) -> DataFrame:
    """what to do next in every topic of the documents that a student has touched, untouched topics included."""
    wanted = mastery.select("student_id", "document_id").distinct().join(topics, "document_id")
    rows = wanted.join(mastery.drop("last_evidence_at"), ["student_id", "document_id", "topic_id"], "left")
    action = (F.when(F.col("level").isNull(), "start_assessment").when(F.col("level") == "Weak", "review_topic").when(F.col("level") == "Developing", "practice_topic").when(F.col("level") == "Insufficient evidence", "continue_assessment"))
    order = F.create_map(*(F.lit(x) for pair in (("review_topic", 0), ("practice_topic", 1), ("continue_assessment", 2), ("start_assessment", 3)) for x in pair))
    rows = rows.withColumn("action", action).where("action IS NOT NULL").withColumn("score", F.coalesce("score", F.lit(0.0)))
    ranked = W.partitionBy("student_id").orderBy(order[F.col("action")], "score", F.coalesce("concepts", F.lit(0)), "document_id", "topic_id")
    return rows.withColumn("rank", F.row_number().over(ranked).cast("long")).select("student_id", "document_id", "topic_id", "action", "score", "rank")


def dashboard(mastery: DataFrame, scores: DataFrame) -> DataFrame:
    """counts of a student's topics by level, with attempts and quizzes."""
    count = lambda level: F.sum((F.col("level") == level).cast("long"))
    topics = mastery.groupBy("student_id").agg(F.count(F.lit(1)).alias("topics"), count("Mastered").alias("mastered"), count("Proficient").alias("proficient"), count("Developing").alias("developing"), count("Weak").alias("weak"), F.sum("answered").alias("answered"))
    tries = scores.groupBy("student_id").agg(F.count(F.lit(1)).alias("attempts"), F.countDistinct("quiz_id").alias("quizzes"), F.max("submitted_at").alias("last_attempt_at"))
    return topics.join(tries, "student_id", "left")


def quiz_history(scores: DataFrame, excluded: DataFrame) -> DataFrame:
    """F16: attempts outside the excluded quizzes, newest first."""
    newest = W.partitionBy("student_id").orderBy(F.desc("submitted_at"), F.desc("attempt_id"))
    return scores.join(excluded, "quiz_id", "left_anti").withColumn("position", F.row_number().over(newest).cast("long")).select("student_id", "position", "attempt_id", "quiz_id", "percentage")


def attempt_history(scores: DataFrame) -> DataFrame:
    """a quiz's attempts as one list, latest first."""
    items = F.sort_array(F.collect_list(F.struct("submitted_at", "attempt_id")), asc=False)
    return scores.groupBy("student_id", "quiz_id").agg(F.array_join(F.transform(items, lambda x: x["attempt_id"].cast("string")), ",").alias("attempt_ids"), F.count(F.lit(1)).alias("attempts"))


def autosaved(answers: DataFrame) -> DataFrame:
    """the last value saved for each question of an attempt, and how many questions are answered."""
    last = answers.groupBy("attempt_id", "question_id").agg(F.max_by("is_correct", F.struct("tie2", "concept_id", "tie1", "tie3", "question_difficulty", "validation_outcome", "is_correct")).alias("value"))
    return last.groupBy("attempt_id").agg(F.count("value").alias("answered"), F.sum(F.col("value").cast("long")).alias("right"))


def learning_state(scores: DataFrame) -> DataFrame:
    """the first rule that fits: under 60 needs review, from 80 on track, else learning."""
    latest = scores.groupBy("student_id", "document_id").agg(F.max_by("percentage", F.struct("submitted_at", "attempt_id")).alias("latest"), F.max("submitted_at").alias("at"))
    return latest.select("student_id", "document_id", "latest", F.when(F.col("latest") < 60, "needs_review").when(F.col("latest") >= 80, "on_track").otherwise("learning").alias("state"))


def state_counts(states: DataFrame) -> DataFrame:
    """students' documents by state, in a fixed order."""
    order = F.create_map(*(F.lit(x) for pair in (("needs_review", 0), ("learning", 1), ("on_track", 2)) for x in pair))
    return states.groupBy("document_id", "state").agg(F.count(F.lit(1)).alias("students")).withColumn("position", order[F.col("state")].cast("long"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return attempt_scores(A.answers(spark, d), A.attempts(spark, d))


def _topics(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue of topics: the remainders that `answers` makes its topics of, for each document."""
    return A.attempts(spark, d).select("document_id").distinct().select("document_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("topic_id"))


SCORES_SQL = """counts AS (SELECT attempt_id, CAST(sum(CAST(is_correct AS INT)) AS BIGINT) AS score, count(*) AS total FROM answers GROUP BY 1),
scores AS (SELECT t.attempt_id, student_id, document_id, quiz_id, submitted_at, score, total, floor(100 * score / CAST(total AS DOUBLE) * 100 + 0.5) / 100 AS percentage, attempt_number
  FROM (SELECT *, row_number() OVER (PARTITION BY student_id, quiz_id ORDER BY submitted_at, attempt_id) AS attempt_number FROM attempts WHERE completed) t JOIN counts c ON t.attempt_id = c.attempt_id)"""
SCORED_SQL = f"WITH {A.ATTEMPTS_SQL}, {A.ANSWERS_SQL}, {SCORES_SQL}"
LAST = "row_number() OVER (PARTITION BY {} ORDER BY submitted_at DESC, attempt_id DESC) AS rn"

QUERIES = {
    "topic_mastery": _topic_mastery,
    "named_mastery": _named,
    "regraded_attempts": _regraded,
    "attempt_scores": _scores,
    "latest_attempt_per_quiz": lambda s, d: latest_attempts(_scores(s, d)),
    "attempt_summary": lambda s, d: attempt_summary(_scores(s, d)),
    "attempt_trend": lambda s, d: attempt_trend(_scores(s, d)),
    "current_performance": lambda s, d: current_performance(_scores(s, d)),
    "knowledge_gaps": lambda s, d: knowledge_gaps(_topic_mastery(s, d)),
    "recommendations": lambda s, d: recommendations(_topic_mastery(s, d), _topics(s, d)),
    "dashboard_counts": lambda s, d: dashboard(_topic_mastery(s, d), _scores(s, d)),
    "quiz_history_excluding": lambda s, d: quiz_history(_scores(s, d), A.attempts(s, d).where("document_id = '5-LOW'").select("quiz_id").distinct()),
    "attempt_history": lambda s, d: attempt_history(_scores(s, d)),
    "autosave_merge": lambda s, d: autosaved(A.answers(s, d)),
    "learning_state": lambda s, d: learning_state(_scores(s, d)),
    "learning_state_counts": lambda s, d: state_counts(learning_state(_scores(s, d))),
}
ORACLES = {
    "named_mastery": f"""{BASE_SQL}, done AS (SELECT e.*, student_id, document_id, submitted_at FROM evidence e JOIN attempts t ON t.attempt_id = e.attempt_id WHERE completed AND submitted_at IS NOT NULL), ids AS (SELECT DISTINCT student_id, document_id, topic_id FROM done),
      nm AS (SELECT student_id, document_id, topic_id, 'Topic ' || (attempt_id % 5) AS topic_name FROM done WHERE attempt_id % 3 <> 0 AND concept_origin IS DISTINCT FROM 'flashcard' QUALIFY row_number() OVER (PARTITION BY student_id, document_id, topic_id ORDER BY submitted_at DESC, question_id, attempt_id DESC) = 1)
      SELECT student_id, document_id, topic_id, coalesce(topic_name, CAST(topic_id AS VARCHAR)) AS topic_name, coalesce(answered, 0) AS answered, coalesce(score, 0.0) AS score, coalesce(level, 'Not assessed') AS level FROM ids LEFT JOIN mastery USING (student_id, document_id, topic_id) LEFT JOIN nm USING (student_id, document_id, topic_id)""",
    "regraded_attempts": f"""WITH {A.ANSWERS_SQL}, m AS (SELECT attempt_id, question_id, concept_id % 2 = 0 AS mark FROM answers WHERE tie1 % 4 = 0 QUALIFY row_number() OVER (PARTITION BY attempt_id, question_id ORDER BY tie1 DESC, concept_id DESC) = 1),
      r AS (SELECT a.attempt_id, CAST(coalesce(mark, is_correct) AS INT) AS ok FROM answers a LEFT JOIN m USING (attempt_id, question_id) WHERE a.attempt_id IN (SELECT attempt_id FROM m)) SELECT attempt_id, CAST(sum(ok) AS BIGINT) AS score, count(*) AS total, floor(100 * sum(ok) / CAST(count(*) AS DOUBLE) * 100 + 0.5) / 100 AS percentage FROM r GROUP BY 1""",
    "topic_mastery": f"{BASE_SQL} SELECT * FROM mastery",
    "attempt_scores": f"{SCORED_SQL} SELECT * FROM scores",
    "latest_attempt_per_quiz": f"{SCORED_SQL} SELECT * EXCLUDE (rn) FROM (SELECT *, {LAST.format('student_id, quiz_id')} FROM scores) WHERE rn = 1",
    "attempt_summary": f"{SCORED_SQL} SELECT student_id, quiz_id, count(*) AS attempts, max(CASE WHEN rn = 1 THEN percentage END) AS latest, max(percentage) AS best, floor(sum(CAST(round(percentage * 100) AS BIGINT)) / CAST(count(percentage) AS DOUBLE) + 0.5) / 100 AS average FROM (SELECT *, {LAST.format('student_id, quiz_id')} FROM scores) GROUP BY 1, 2",
    "attempt_trend": f"""{SCORED_SQL} SELECT student_id, document_id, percentage, before, CASE WHEN percentage - before >= 5 THEN 'improving' WHEN percentage - before <= -5 THEN 'declining' WHEN before IS NOT NULL THEN 'steady' END AS trend
      FROM (SELECT *, lag(percentage) OVER (PARTITION BY student_id, document_id ORDER BY submitted_at, attempt_id) AS before, {LAST.format('student_id, document_id')} FROM scores WHERE total > 0) WHERE rn = 1""",
    "current_performance": f"{SCORED_SQL} SELECT student_id, floor(sum(CAST(round(percentage * 100) AS BIGINT)) / CAST(count(percentage) AS DOUBLE) + 0.5) / 100 AS performance, count(*) AS documents FROM (SELECT *, {LAST.format('student_id, document_id')} FROM scores) WHERE rn = 1 GROUP BY 1",
    "knowledge_gaps": f"""{BASE_SQL} SELECT student_id, document_id, topic_id, score, severity, row_number() OVER (PARTITION BY student_id ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 1 END, score, concepts, document_id, topic_id) AS rank
      FROM (SELECT *, CASE level WHEN 'Weak' THEN 'high' ELSE 'moderate' END AS severity FROM mastery WHERE sufficient AND level IN ('Weak', 'Developing'))""",
    "recommendations": f"""{BASE_SQL}, topics AS (SELECT DISTINCT document_id, topic_id FROM (SELECT DISTINCT document_id FROM attempts), (SELECT DISTINCT topic_id FROM answers)),
      wanted AS (SELECT t.student_id, t.document_id, topics.topic_id FROM (SELECT DISTINCT student_id, document_id FROM mastery) t JOIN topics USING (document_id)),
      acted AS (SELECT w.*, m.concepts, coalesce(m.score, 0.0) AS score, CASE WHEN m.level IS NULL THEN 'start_assessment' WHEN m.level = 'Weak' THEN 'review_topic' WHEN m.level = 'Developing' THEN 'practice_topic' WHEN m.level = 'Insufficient evidence' THEN 'continue_assessment' END AS action
        FROM wanted w LEFT JOIN mastery m USING (student_id, document_id, topic_id))
      SELECT student_id, document_id, topic_id, action, score, row_number() OVER (PARTITION BY student_id ORDER BY CASE action WHEN 'review_topic' THEN 0 WHEN 'practice_topic' THEN 1 WHEN 'continue_assessment' THEN 2 ELSE 3 END, score, coalesce(concepts, 0), document_id, topic_id) AS rank FROM acted WHERE action IS NOT NULL""",
    "dashboard_counts": f"""{BASE_SQL}, {SCORES_SQL}, t AS (SELECT student_id, count(*) AS topics, count(*) FILTER (level = 'Mastered') AS mastered, count(*) FILTER (level = 'Proficient') AS proficient, count(*) FILTER (level = 'Developing') AS developing, count(*) FILTER (level = 'Weak') AS weak, CAST(sum(answered) AS BIGINT) AS answered FROM mastery GROUP BY 1),
      a AS (SELECT student_id, count(*) AS attempts, count(DISTINCT quiz_id) AS quizzes, max(submitted_at) AS last_attempt_at FROM scores GROUP BY 1) SELECT t.*, attempts, quizzes, last_attempt_at FROM t LEFT JOIN a USING (student_id)""",
    "quiz_history_excluding": f"{SCORED_SQL} SELECT student_id, row_number() OVER (PARTITION BY student_id ORDER BY submitted_at DESC, attempt_id DESC) AS position, attempt_id, quiz_id, percentage FROM scores WHERE quiz_id NOT IN (SELECT quiz_id FROM attempts WHERE document_id = '5-LOW')",
    "attempt_history": f"{SCORED_SQL} SELECT student_id, quiz_id, string_agg(CAST(attempt_id AS VARCHAR), ',' ORDER BY submitted_at DESC, attempt_id DESC) AS attempt_ids, count(*) AS attempts FROM scores GROUP BY 1, 2",
    "autosave_merge": f"""WITH {A.ANSWERS_SQL} SELECT attempt_id, count(value) AS answered, CAST(sum(CAST(value AS INT)) AS BIGINT) AS "right" FROM (SELECT attempt_id, is_correct AS value, row_number() OVER (PARTITION BY attempt_id, question_id ORDER BY tie2 DESC, concept_id DESC, tie1 DESC, tie3 DESC, question_difficulty DESC, validation_outcome DESC, is_correct DESC) AS rn FROM answers) WHERE rn = 1 GROUP BY 1""",
    "learning_state": f"{SCORED_SQL} SELECT student_id, document_id, percentage AS latest, CASE WHEN percentage < 60 THEN 'needs_review' WHEN percentage >= 80 THEN 'on_track' ELSE 'learning' END AS state FROM (SELECT *, {LAST.format('student_id, document_id')} FROM scores) WHERE rn = 1",
    "learning_state_counts": f"{SCORED_SQL} SELECT document_id, state, count(*) AS students, CASE state WHEN 'needs_review' THEN CAST(0 AS BIGINT) WHEN 'learning' THEN 1 ELSE 2 END AS position FROM (SELECT *, CASE WHEN percentage < 60 THEN 'needs_review' WHEN percentage >= 80 THEN 'on_track' ELSE 'learning' END AS state FROM (SELECT *, {LAST.format('student_id, document_id')} FROM scores) WHERE rn = 1) GROUP BY 1, 2",
}
