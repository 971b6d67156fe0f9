"""Nested quiz documents to tables and back, and the import of old quiz files, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lectern.sources.tables import table

# Letters of options, types whose answers are kept as written, defaults of missing fields.
LETTERS = "ABCD"
WRITTEN = ("fill_blank", "short_answer", "multi_blank")
DIFFICULTIES = ("easy", "medium", "difficult")
NO_TOPIC, SINGLE, ACCEPTED = "document", "single_choice", "accepted"
QUESTION = "struct<id:int,question:string,options:array<string>,correct_answer:string,correct_answers:array<string>,question_type:string,topic_id:string,difficulty:string,explanation:string,validation_outcome:string,concept_id:string>"
QUIZ = f"quiz_id:string,title:string,difficulty:string,topic_id:string,questions:array<{QUESTION}>"


def shred(quizzes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quizzes (quiz_id, document_id, difficulty, title, topic_id, questions), to rows of quizzes, of questions and of options. Missing fields get the quiz's or the default; letters are kept in capitals, written answers as they are."""
    c = F.col
    heads = quizzes.select("quiz_id", "document_id", "difficulty", F.coalesce(F.nullif("title", F.lit("")), "document_id").alias("title"), F.coalesce(F.nullif("topic_id", F.lit("")), F.lit(NO_TOPIC)).alias("topic_id"), F.size(F.coalesce("questions", F.array().cast(f"array<{QUESTION}>"))).alias("question_count"))
    rows = quizzes.select("quiz_id", c("difficulty").alias("quiz_difficulty"), F.coalesce(F.nullif("topic_id", F.lit("")), F.lit(NO_TOPIC)).alias("quiz_topic"), F.posexplode("questions").alias("at", "q"))
    kind = F.coalesce(F.nullif("q.question_type", F.lit("")), F.lit(SINGLE))
    answer = F.coalesce("q.correct_answer", F.lit(""))
    or_else = lambda field, other: F.coalesce(F.nullif(f"q.{field}", F.lit("")), other)
    question_id = F.coalesce("q.id", c("at") + 1)
    questions = rows.select(
        "quiz_id", question_id.alias("question_id"), (c("at") + 1).alias("position"), F.coalesce("q.question", F.lit("")).alias("question"), F.when(kind.isin(*WRITTEN), F.trim(answer)).otherwise(F.upper(answer)).alias("correct_answer"),
        F.when(F.size("q.correct_answers") > 0, c("q.correct_answers")).otherwise(F.array(answer)).alias("correct_answers"), kind.alias("question_type"), or_else("topic_id", c("quiz_topic")).alias("topic_id"), or_else("difficulty", c("quiz_difficulty")).alias("difficulty"),
        F.coalesce("q.explanation", F.lit("")).alias("explanation"), or_else("validation_outcome", F.lit(ACCEPTED)).alias("validation_outcome"), F.coalesce("q.concept_id", F.lit("")).alias("concept_id"),
    )
    options = rows.select("quiz_id", question_id.alias("question_id"), F.posexplode(F.slice("q.options", 1, len(LETTERS))).alias("k", "option_text")).select("quiz_id", "question_id", F.substring(F.lit(LETTERS), c("k") + 1, F.lit(1)).alias("option_letter"), "option_text")
    return heads, questions, options


def assemble(heads: DataFrame, questions: DataFrame, options: DataFrame) -> DataFrame:
    """The tables back to one row for each quiz, with its questions in order of position and their options in order of letter."""
    listed = options.groupBy("quiz_id", "question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("option_letter", "option_text"))), lambda x: x["option_text"]).alias("options"))
    empty = F.array().cast("array<string>")
    rows = questions.join(listed, ["quiz_id", "question_id"], "left").withColumn("options", F.coalesce("options", empty))
    q = F.struct(F.col("question_id").alias("id"), "question", "options", "correct_answer", "correct_answers", "question_type", "topic_id", "difficulty", "explanation", "validation_outcome", "concept_id")
    nested = rows.groupBy("quiz_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", q.alias("q")))), lambda x: x["q"]).alias("questions"))
    out = heads.drop("question_count").join(nested, "quiz_id", "left")
    return out.withColumn("questions", F.coalesce("questions", F.array().cast(f"array<{QUESTION}>")))


def legacy_quizzes(files: DataFrame) -> DataFrame:
    """Quizzes of old files (owner_id, content: one JSON object). A key names a document, or document and difficulty with :: between; its value is a quiz, or holds one for each difficulty. What is no quiz is left out. A quiz without id gets one from its owner, key and difficulty."""
    entries = files.select("owner_id", F.explode(F.from_json("content", "map<string,string>")).alias("key", "value"))
    parts = ",".join(f"{d}:struct<{QUIZ}>" for d in DIFFICULTIES)
    entries = entries.withColumn("v", F.from_json("value", f"struct<{QUIZ},{parts}>"))
    split = F.col("key").contains("::")
    document, named = F.when(split, F.regexp_extract("key", "(?s)^(.*)::", 1)).otherwise(F.col("key")), F.when(split, F.regexp_extract("key", "(?s)^.*::(.*)$", 1)).otherwise("medium")
    fields = ("quiz_id", "title", "topic_id", "questions")
    one = entries.where("v.questions IS NOT NULL").select("owner_id", "key", document.alias("document_id"), F.coalesce("v.difficulty", named).alias("difficulty"), *(F.col(f"v.{f}") for f in fields))
    each = F.array(*(F.struct(F.lit(d).alias("difficulty"), *(F.col(f"v.{d}.{f}").alias(f) for f in fields)) for d in DIFFICULTIES))
    more = entries.where("v.questions IS NULL").select("owner_id", "key", F.explode(each).alias("x")).where("x.questions IS NOT NULL").select("owner_id", "key", F.col("key").alias("document_id"), "x.difficulty", *(F.col(f"x.{f}") for f in fields))
    rows = one.union(more)
    made = F.concat(F.lit("legacy-"), F.substring(F.sha1(F.concat_ws("|", F.col("owner_id").cast("string"), "key", "difficulty")), 1, 16))
    return rows.withColumn("quiz_id", F.coalesce(F.nullif("quiz_id", F.lit("")), made)).drop("key")


def to_import(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Old quizzes that the store (quiz_id) doesn't hold, one row for each id; a second import finds none."""
    own = W.partitionBy("quiz_id").orderBy("owner_id", "document_id", "difficulty")
    return legacy_quizzes(files).withColumn("rn", F.row_number().over(own)).where("rn = 1").drop("rn").join(stored.select("quiz_id"), "quiz_id", "left_anti")


def _quizzes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as quizzes, line items as their questions; some fields are missing."""
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    null = F.lit(None).cast("string")
    q = F.struct(
        F.lit(None).cast("int").alias("id"), text("What is ", k, "?").alias("question"), F.when(k % 3 != 0, F.transform(F.sequence(F.lit(1), (n % 5 + 1).cast("int")), lambda i: F.concat(F.lit("option "), i.cast("string")))).alias("options"), F.when(k % 7 != 0, F.lower(F.translate("l_returnflag", "ANR", "ABC"))).alias("correct_answer"),
        F.when(k % 5 == 0, F.array("l_returnflag", "l_linestatus")).alias("correct_answers"), F.when(k % 3 == 0, "fill_blank").alias("question_type"), null.alias("topic_id"), F.when(k % 2 == 0, "hard").alias("difficulty"), F.when(k % 11 == 0, "why").alias("explanation"), null.alias("validation_outcome"), F.when(k % 10 != 0, text("c", k % 6)).alias("concept_id"),
    ).cast(QUESTION)
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", q.alias("q")))), lambda x, i: x["q"].withField("id", F.when(x["l_partkey"] % 4 != 0, i * 100 + 57))).alias("questions"))
    o = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    return o.select(F.concat(F.lit("quiz-"), k.cast("string")).alias("quiz_id"), F.col("o_orderpriority").alias("document_id"), F.element_at(F.array(*map(F.lit, DIFFICULTIES)), (k % 3 + 1).cast("int")).alias("difficulty"), F.when(k % 2 == 0, F.concat(F.lit("Quiz "), k.cast("string"))).alias("title"), F.when(k % 5 != 0, F.concat(F.lit("t"), (k % 4).cast("string"))).alias("topic_id"), "questions", F.col("o_custkey").alias("owner_id"))


def _assembled(spark: SparkSession, d: str) -> DataFrame:
    out = assemble(*shred(_quizzes(spark, d)))
    line = lambda q: F.concat_ws("|", q["id"].cast("string"), q["question"], F.array_join(q["options"], "/"), q["correct_answer"], F.array_join(q["correct_answers"], "/"), q["question_type"], q["topic_id"], q["difficulty"], q["explanation"], q["validation_outcome"], q["concept_id"])
    return out.select("quiz_id", "title", "topic_id", F.size("questions").alias("n"), F.array_join(F.transform("questions", line), "\n").alias("text"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """A customer's quizzes as an old file: keyed by document and difficulty, or by document, or one for each difficulty; every third has no id."""
    q = _quizzes(spark, d)
    k = F.substring_index("quiz_id", "-", -1).cast("long")
    quiz = F.struct(F.when(k % 3 != 0, F.col("quiz_id")).alias("quiz_id"), "title", F.when(k % 4 == 0, F.col("difficulty")).alias("difficulty"), "topic_id", F.coalesce("questions", F.array().cast(f"array<{QUESTION}>")).alias("questions"))
    body = F.when(k % 5 == 0, F.concat(F.lit('{"easy": 3, "difficult": '), F.to_json(quiz), F.lit("}"))).otherwise(F.to_json(quiz))
    key = F.when(k % 5 < 3, F.concat(F.lit("d::"), k.cast("string"), F.when(k % 5 == 0, "").otherwise(F.lit("::hard")))).otherwise(F.concat(F.lit("d"), k.cast("string")))
    entry = F.concat(F.lit('"'), key, F.lit('": '), body)
    return q.groupBy("owner_id").agg(F.concat(F.lit('{"note": "old", '), F.array_join(F.sort_array(F.collect_list(entry)), ", "), F.lit("}")).alias("content"))


def _imported(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "orders").where("o_orderkey % 6 = 1").select(F.concat(F.lit("quiz-"), F.col("o_orderkey").cast("string")).alias("quiz_id"))
    return to_import(_files(spark, d), stored).select("owner_id", "quiz_id", "document_id", "difficulty", "topic_id", F.size("questions").alias("n"))


QUERIES = {
    "shredded_options": lambda s, d: shred(_quizzes(s, d))[2],
    "assembled_quizzes": _assembled,
    "imported_quizzes": _imported,
}
_Q_SQL = """q AS (SELECT l_orderkey AS k, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS position, l_linenumber AS n, l_returnflag AS rf, l_linestatus AS ls FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
  r AS (SELECT *, CASE WHEN p % 4 <> 0 THEN position * 100 - 43 ELSE position END AS question_id, CASE WHEN p % 3 <> 0 THEN list_transform(range(1, n % 5 + 2), lambda i: 'option ' || i) ELSE [] END AS options, CASE WHEN p % 7 <> 0 THEN lower(translate(rf, 'ANR', 'ABC')) ELSE '' END AS answer FROM q)"""
ORACLES = {
    "shredded_options": f"WITH {_Q_SQL}, e AS (SELECT k, question_id, unnest(range(1, len(options[1:4]) + 1)) AS i, options FROM r) SELECT 'quiz-' || k AS quiz_id, CAST(question_id AS INT) AS question_id, substring('ABCD', i, 1) AS option_letter, options[i] AS option_text FROM e",
    "assembled_quizzes": f"""WITH {_Q_SQL}, o AS (SELECT o_orderkey AS k, o_orderpriority AS document_id, ['easy', 'medium', 'difficult'][o_orderkey % 3 + 1] AS df, CASE WHEN o_orderkey % 5 <> 0 THEN 't' || (o_orderkey % 4) ELSE 'document' END AS topic_id FROM orders),
  t AS (SELECT o.k, string_agg(question_id || '|What is ' || p || '?|' || array_to_string(options[1:4], '/') || '|' || CASE WHEN p % 3 = 0 THEN answer ELSE upper(answer) END || '|' || CASE WHEN p % 5 = 0 THEN rf || '/' || ls ELSE answer END || '|' || CASE WHEN p % 3 = 0 THEN 'fill_blank' ELSE 'single_choice' END || '|' || topic_id || '|' || CASE WHEN p % 2 = 0 THEN 'hard' ELSE df END || '|' || CASE WHEN p % 11 = 0 THEN 'why' ELSE '' END || '|accepted|' || CASE WHEN p % 10 <> 0 THEN 'c' || (p % 6) ELSE '' END, chr(10) ORDER BY position) AS text, count(*) AS n FROM o JOIN r ON r.k = o.k GROUP BY 1)
  SELECT 'quiz-' || o.k AS quiz_id, CASE WHEN o.k % 2 = 0 THEN 'Quiz ' || o.k ELSE document_id END AS title, topic_id, CAST(coalesce(n, 0) AS INT) AS n, coalesce(text, '') AS text FROM o LEFT JOIN t ON t.k = o.k""",
    "imported_quizzes": """WITH n AS (SELECT o_orderkey AS k, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
  b AS (SELECT o_custkey AS owner_id, o_orderkey AS k, n, ['easy', 'medium', 'difficult'][o_orderkey % 3 + 1] AS df, CASE WHEN o_orderkey % 5 <> 0 THEN 't' || (o_orderkey % 4) END AS topic_id, CASE WHEN o_orderkey % 5 < 3 THEN 'd::' || o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '::hard' END ELSE 'd' || o_orderkey END AS key FROM orders JOIN n ON k = o_orderkey),
  c AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'difficult' WHEN k % 4 = 0 THEN df WHEN k % 5 < 3 THEN 'hard' ELSE 'medium' END AS difficulty, CASE WHEN k % 5 IN (1, 2) THEN 'd::' || k ELSE key END AS document_id FROM b),
  i AS (SELECT *, CASE WHEN k % 3 <> 0 THEN 'quiz-' || k ELSE 'legacy-' || substring(sha1(owner_id || '|' || key || '|' || difficulty), 1, 16) END AS quiz_id FROM c)
  SELECT owner_id, quiz_id, document_id, difficulty, topic_id, CAST(n AS INT) AS n FROM i WHERE quiz_id NOT IN (SELECT 'quiz-' || o_orderkey FROM orders WHERE o_orderkey % 6 = 1)""",
}
