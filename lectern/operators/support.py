"""How much of a question and its answer the excerpts of its document back: distinctive words, found as they are or inflected.

Each distinct word of a document's questions is held against its excerpts once; what is common among them tells nothing and is
left out. Words meet excerpts by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import content_words, squash
from lectern.operators import evidence

# Length of words, share of excerpts that makes a word common and excerpts that takes, inflections, words that an answer needs.
WORD_CHARS, COMMON_SHARE, COMMON_UNITS, LONG, PIECE, PIECES, PREFIX, DROPPED, ANSWER_WORDS = 5, 0.4, 5, 10, 5, 0.7, 6, 3, 2


def supported(key: Column, text: Column) -> Column:
    """A squashed word stands in a squashed text, whole or, if it is long enough, without its ending or in most of its pieces."""
    n = F.length(key)
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - PIECE + 1, F.lit(1))), lambda k: F.substring(key, k, F.lit(PIECE))))
    most = F.size(F.filter(pieces, lambda p: F.contains(text, p))) / F.size(pieces) >= PIECES
    prefix = F.substring(key, F.lit(1), F.greatest(F.lit(PREFIX), n - DROPPED))
    return (n > 0) & (F.contains(text, key) | F.when(n > LONG, most).when(n > PREFIX, F.contains(text, prefix)).otherwise(F.lit(False)))


def context_support(questions: DataFrame, excerpts: DataFrame) -> DataFrame:
    """For each question (document_id, question_id, unit_id, stem, answer): joint, the share of the distinctive words of both that its own excerpt backs, and answer, the share of the answer's that any excerpt of the document backs (0 if fewer than it needs). Null where nothing is distinctive.

    excerpts: document_id, unit_id, text.
    """
    units = excerpts.select("document_id", "unit_id", squash(F.col("text")).alias("t"))
    sides = questions.select("document_id", "question_id", "unit_id", content_words(F.col("stem"), WORD_CHARS).alias("s"), content_words(F.col("answer"), WORD_CHARS).alias("a"))
    words = sides.select("document_id", "question_id", "unit_id", F.explode(F.array_union("s", "a")).alias("w"), "a").select("document_id", "question_id", F.col("unit_id").alias("own"), "w.word", "w.key", F.array_contains(F.transform("a", lambda x: x["word"]), F.col("w.word")).alias("of_answer"))
    total = units.groupBy("document_id").agg(F.count(F.lit(1)).alias("units"))
    keys = words.select("document_id", "key").distinct()
    links = keys.join(units, "document_id").select("document_id", "key", "unit_id", F.contains("t", "key").alias("found"), supported(F.col("key"), F.col("t")).alias("backed"))
    known = links.groupBy("document_id", "key").agg(F.sum(F.col("found").cast("int")).alias("df"), F.max("backed").alias("anywhere"), F.collect_set(F.when(F.col("backed"), F.col("unit_id"))).alias("backing"))
    rows = words.join(known, ["document_id", "key"]).join(total, "document_id").where((F.col("units") < COMMON_UNITS) | (F.col("df") <= COMMON_SHARE * F.col("units")))
    count = lambda when: F.sum(when.cast("int"))
    g = rows.groupBy("document_id", "question_id").agg(F.count(F.lit(1)).alias("n"), count(F.array_contains("backing", F.col("own"))).alias("here"), count(F.col("of_answer")).alias("m"), count(F.col("of_answer") & F.col("anywhere")).alias("there"))
    answer = F.when(F.col("m") > 0, F.when(F.col("there") < F.least("m", F.lit(ANSWER_WORDS)), 0.0).otherwise(F.col("there") / F.col("m")))
    return questions.select("document_id", "question_id").join(g, ["document_id", "question_id"], "left").select("document_id", "question_id", (F.col("here") / F.col("n")).alias("joint"), answer.alias("answer"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """A question of each document: parts of its text and of the document before it, about its first excerpt."""
    docs = evidence.corpus.documents(spark, d).select("document_id", F.coalesce("content", F.lit("")).alias("c"))
    other = docs.select((F.col("document_id") + 1).alias("document_id"), F.substring("c", 1, 60).alias("o"))
    rows = docs.join(other, "document_id", "left")
    return rows.select("document_id", F.lit(0).alias("question_id"), F.concat(F.col("document_id").cast("string"), F.lit("-0")).alias("unit_id"), F.concat(F.substring("c", 100, 120), F.lit(" "), F.coalesce("o", F.lit(""))).alias("stem"), F.concat(F.substring("c", 650, 60), F.lit(" however")).alias("answer"))


QUERIES = {"context_support": lambda s, d: context_support(_questions(s, d), evidence._excerpts(s, d)).select("document_id", "question_id", F.round("joint", 6).alias("joint"), F.round("answer", 6).alias("answer"))}


def _squash_sql(text: str) -> str:
    return f"regexp_replace(strip_accents(replace(lower({text}), 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def _words_sql(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(replace(lower({text}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]{{{WORD_CHARS},}}'), lambda w: w NOT IN ('however', 'their', 'which', 'these', 'those', 'there', 'about', 'where', 'other', 'every', 'would', 'could', 'should', 'because', 'during', 'using')))"


ORACLES = {
    "context_support": f"""WITH x AS (SELECT doc_id AS document_id, coalesce(text, '') AS c FROM documents), q AS (SELECT x.document_id, substring(x.c, 100, 120) || ' ' || coalesce(substring(o.c, 1, 60), '') AS stem, substring(x.c, 650, 60) || ' however' AS answer FROM x LEFT JOIN x o ON o.document_id + 1 = x.document_id),
  u AS (SELECT document_id, k, {_squash_sql('substring(c, CAST(k * 600 + 1 AS INT), 600)')} AS t FROM (SELECT *, unnest(range(0, CAST(greatest(ceil(length(c) / 600), 1) AS BIGINT))) AS k FROM x)), n AS (SELECT document_id, count(*) AS units FROM u GROUP BY 1),
  s AS (SELECT document_id, {_words_sql('stem')} AS s, {_words_sql('answer')} AS a FROM q), w AS (SELECT document_id, unnest(list_distinct(s || a)) AS word, a FROM s), k AS (SELECT document_id, word, list_contains(a, word) AS of_answer, {_squash_sql('word')} AS key FROM w),
  l AS (SELECT k.document_id, word, of_answer, u.k, contains(t, key) AS found, length(key) > 0 AND (contains(t, key) OR CASE WHEN length(key) > 10 THEN len(list_filter(list_distinct(list_transform(range(1, length(key) - 3), lambda i: substring(key, i, 5))), lambda p: contains(t, p))) / len(list_distinct(list_transform(range(1, length(key) - 3), lambda i: substring(key, i, 5)))) >= 0.7
    WHEN length(key) > 6 THEN contains(t, substring(key, 1, greatest(6, length(key) - 3))) ELSE false END) AS backed FROM k JOIN u ON u.document_id = k.document_id),
  d AS (SELECT document_id, word, any_value(of_answer) AS of_answer, count(*) FILTER (found) AS df, bool_or(backed) AS anywhere, bool_or(backed AND k = 0) AS here FROM l GROUP BY 1, 2), f AS (SELECT d.* FROM d JOIN n USING (document_id) WHERE units < 5 OR df <= 0.4 * units),
  g AS (SELECT document_id, count(*) AS n, count(*) FILTER (here) AS here, count(*) FILTER (of_answer) AS m, count(*) FILTER (of_answer AND anywhere) AS there FROM f GROUP BY 1)
  SELECT q.document_id, 0 AS question_id, round(here / n, 6) AS joint, round(CASE WHEN m > 0 THEN CASE WHEN there < least(m, 2) THEN 0.0 ELSE there / m END END, 6) AS answer FROM q LEFT JOIN g ON g.document_id = q.document_id""",
}
