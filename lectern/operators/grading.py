"""Grading of submitted answers by type of question, and the rules a submission has to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import answer_forms
from lectern.sources.tables import table

# Types that are written, and the most characters of each.
WRITTEN = {"fill_blank": 200, "short_answer": 1000}
LETTERS = "ABCD"


def texts(column: Column) -> Column:
    """An answer's parts, nulls as blanks."""
    return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")))


def letters(column: Column) -> Column:
    return F.transform(texts(column), lambda x: F.upper(F.trim(x)))


def as_set(column: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(letters(column), lambda x: x != "")))


def grade(answers: DataFrame) -> DataFrame:
    """`answers` with is_correct. Needs type, selected (array) and accepted (array of arrays: one for each blank or pair, else one in all).

    Matching is right pair by pair, several blanks blank by blank, one blank if its form is accepted, options as an exact set.
    Nothing is right where nothing was answered.
    """
    kind = F.col("type")
    text, several = kind.isin(*WRITTEN), kind == "multi_blank"
    rows = answers.withColumn("_given", answer_forms(F.when(text | several, F.array(texts(F.col("selected")))))).withColumn("_forms", answer_forms(F.when(text | several, F.col("accepted"))))
    given, forms = F.col("_given")[0], F.col("_forms")
    any_given = F.exists(texts(F.col("selected")), lambda x: F.trim(x) != "")
    holds = lambda accepted, x: (x != "") & F.array_contains(accepted, x)
    written = holds(F.get(forms, F.lit(0)), F.get(given, F.lit(0)))
    blanks = (F.size(given) == F.size(forms)) & F.forall(F.zip_with(forms, given, holds), lambda x: F.coalesce(x, F.lit(False)))
    pairs = letters(F.col("selected")) == F.transform("accepted", lambda a: F.upper(F.trim(a[0])))
    options = as_set(F.col("selected")) == as_set(F.get("accepted", F.lit(0)))
    right = F.when(~any_given, F.lit(False)).when(text, written).when(several, blanks).when(kind == "matching", pairs).otherwise(options)
    return rows.withColumn("is_correct", F.coalesce(right, F.lit(False))).drop("_given", "_forms")


def submission_faults(attempts: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """attempt_id, question_id and the first rule that an answer breaks. An attempt without rows here may be graded.

    attempts: attempt_id, quiz_id, allow_unanswered; questions: quiz_id, question_id, type, parts (options, pairs or blanks);
    answers: attempt_id, question_id, selected.
    """
    expected = attempts.join(questions, "quiz_id").select("attempt_id", "question_id", "allow_unanswered", "type", "parts")
    rows = expected.join(answers.join(attempts.select("attempt_id"), "attempt_id", "left_semi"), ["attempt_id", "question_id"], "full_outer")
    kind, given, few = F.col("type"), texts(F.col("selected")), F.size(F.coalesce("selected", F.array().cast("array<string>")))
    blank = F.forall(given, lambda x: F.trim(x) == "")
    longest = F.coalesce(*(F.when(kind == k, n) for k, n in WRITTEN.items()))
    stray = lambda xs: F.exists(xs, lambda x: (x != "") & (~F.array_contains(F.slice(F.split(F.lit(",".join(LETTERS)), ","), F.lit(1), F.col("parts")), x)))
    fault = (
        F.when(kind.isNull(), "not_in_quiz")
        .when(blank & F.col("allow_unanswered"), F.lit(None))
        .when(blank, "unanswered")
        .when(longest.isNotNull() & (few > 1), "not_one_text")
        .when(F.length(F.regexp_replace(F.trim(F.get(given, F.lit(0))), r"\s+", " ")) > longest, "too_long")
        .when((kind == "matching") & (few != F.col("parts")), "not_all_pairs")
        .when((kind == "multi_blank") & (few != F.col("parts")), "not_all_blanks")
        .when(~kind.isin(*WRITTEN, "multi_blank") & stray(letters(F.col("selected"))), "unknown_option")
        .when(~kind.isin(*WRITTEN, "multi_blank", "matching", "multi_select") & (F.size(as_set(F.col("selected"))) != 1), "one_answer_needed")
    )
    return rows.withColumn("fault", fault).where("fault IS NOT NULL").select("attempt_id", "question_id", "fault")


MODES, INSTRUCTIONS = ("REG AIR", "Fob", "Truck", "ship", "RAIL"), ("Deliver in Person", "none", "COLLECT COD")
TYPES = ("single_choice", "multi_select", "fill_blank", "matching", "multi_blank", "short_answer")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of each type from flags, modes and instructions that go by the keys of line items; some are left out."""
    c, pick = F.col, lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    li = table(spark, d, "lineitem").withColumn("l_shipmode", pick(MODES, c("l_suppkey"))).withColumn("l_shipinstruct", pick(INSTRUCTIONS, c("l_partkey")))
    one, two, mode = F.translate("l_returnflag", "ANR", "ABC"), F.translate("l_linestatus", "FO", "AB"), c("l_shipmode")
    kind = pick(TYPES, c("l_linenumber"))
    lists = lambda *rows: F.array(*(F.array(*(F.lit(x) if isinstance(x, str) else x for x in row)) for row in rows))
    by = lambda *values: F.coalesce(*(F.when(kind == k, v) for k, v in zip(TYPES, values)))
    selected = by(F.array(F.lower(one)), F.array(one, two), F.array(F.concat(F.lit(' "'), mode, F.lit('". '))), F.array(one, two), F.array(mode, F.when(c("l_suppkey") % 3 == 0, "").otherwise(c("l_returnflag"))), F.array("l_shipinstruct"))
    accepted = by(lists((two,)), lists((two, " a")), lists((F.when(c("l_partkey") % 2 == 0, F.lower(mode)).otherwise("x"), "REG  AIR")), lists((two,), (one,)), lists((F.upper(mode),), ("r", "n")), lists(("deliver in person",)))
    return li.select(c("l_orderkey").alias("attempt_id"), c("l_linenumber").alias("question_id"), c("l_partkey").alias("row"), kind.alias("type"), F.when(c("l_suppkey") % 11 != 0, selected).alias("selected"), accepted.alias("accepted"))


def _submissions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders stand for attempts at a quiz of their priority: questions 1 to 6, answers from the first line item of a number."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("attempt_id"), F.col("o_orderpriority").alias("quiz_id"), (F.col("o_orderstatus") == "P").alias("allow_unanswered"))
    q = o.select("quiz_id").distinct().select("quiz_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("question_id"))
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("question_id") % 6 + 1).cast("int"))
    parts = F.when(kind.isin("matching", "multi_blank"), 2).when(kind == "multi_select", 3).otherwise(4)
    first = _answers(spark, d).groupBy("attempt_id", "question_id").agg(F.min(F.struct("row", "selected")).alias("a"))
    return o, q.select("quiz_id", "question_id", kind.alias("type"), parts.alias("parts")), first.select("attempt_id", F.col("question_id").cast("int").alias("question_id"), "a.selected")


QUERIES = {
    "graded_answers": lambda s, d: grade(_answers(s, d)).select("attempt_id", "question_id", "row", "type", "is_correct"),
    "submission_faults": lambda s, d: submission_faults(*_submissions(s, d)),
}
_PUNCT = r"[\s.,;:!?\"''`“”‘’«»()\[\]{}<>…]+"


def form_sql(text: str) -> str:
    return f"regexp_replace(trim(regexp_replace(lower({text}), '\\s+', ' ', 'g')), '^{_PUNCT}|{_PUNCT}$', '', 'g')"


ANSWERS_SQL = """a AS (SELECT *, ['single_choice', 'multi_select', 'fill_blank', 'matching', 'multi_blank', 'short_answer'][l_linenumber % 6 + 1] AS type, translate(l_returnflag, 'ANR', 'ABC') AS one, translate(l_linestatus, 'FO', 'AB') AS two, ['REG AIR', 'Fob', 'Truck', 'ship', 'RAIL'][l_suppkey % 5 + 1] AS l_shipmode, ['Deliver in Person', 'none', 'COLLECT COD'][l_partkey % 3 + 1] AS l_shipinstruct FROM lineitem),
  s AS (SELECT *, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE CASE type WHEN 'single_choice' THEN [lower(one)] WHEN 'multi_select' THEN [one, two] WHEN 'fill_blank' THEN [' "' || l_shipmode || '". '] WHEN 'matching' THEN [one, two]
    WHEN 'multi_blank' THEN [l_shipmode, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE l_returnflag END] ELSE [l_shipinstruct] END END AS selected FROM a)"""
ORACLES = {
    "graded_answers": f"""WITH {ANSWERS_SQL} SELECT l_orderkey AS attempt_id, l_linenumber AS question_id, l_partkey AS row, type, selected IS NOT NULL AND coalesce(CASE type WHEN 'single_choice' THEN upper(selected[1]) = two WHEN 'multi_select' THEN list_sort(list_distinct([one, two])) = list_sort(list_distinct([two, 'A']))
      WHEN 'fill_blank' THEN {form_sql('selected[1]')} IN (CASE WHEN l_partkey % 2 = 0 THEN {form_sql('l_shipmode')} ELSE 'x' END, 'reg air') WHEN 'matching' THEN one = two
      WHEN 'multi_blank' THEN selected[2] <> '' AND lower(selected[2]) IN ('r', 'n') ELSE {form_sql('selected[1]')} = 'deliver in person' END, false) AS is_correct FROM s""",
    "submission_faults": f"""WITH {ANSWERS_SQL}, q AS (SELECT o_orderkey AS attempt_id, o_orderstatus = 'P' AS allow_unanswered, unnest(range(1, 7)) AS question_id FROM orders),
  f AS (SELECT l_orderkey AS attempt_id, l_linenumber AS question_id, type, one, selected FROM s WHERE l_orderkey IN (SELECT o_orderkey FROM orders) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, selected NULLS FIRST) = 1),
  r AS (SELECT coalesce(q.attempt_id, f.attempt_id) AS attempt_id, CAST(coalesce(q.question_id, f.question_id) AS INT) AS question_id, CASE WHEN q.attempt_id IS NULL THEN 'not_in_quiz' WHEN f.selected IS NULL AND allow_unanswered THEN NULL WHEN f.selected IS NULL THEN 'unanswered'
    WHEN type = 'matching' AND one = 'C' THEN 'unknown_option' END AS fault FROM q FULL OUTER JOIN f ON q.attempt_id = f.attempt_id AND q.question_id = f.question_id) SELECT * FROM r WHERE fault IS NOT NULL""",
}
