"""The primary language of a document that may hold its own translation, and questions that are not in the language of their quiz.

A sentence's language is judged on its letters: one language uses letters that the other never does. What tells a source from
its translation is which of the two begins a line or a block of lines, so languages are kept as runs in their order. All of it
is column expressions and windows by document; only the composition of accents needs Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lectern.functions.staging import cut
from lectern.functions.text import composed
from lectern.operators import corpus
from lectern.sources.tables import table

# Letters of the second language, and the bounds of each judgement.
SECOND_LETTERS = "[ăâđêôơưàáãèéìíòóõùúýĂÂĐÊÔƠƯÀÁÃÈÉÌÍÒÓÕÙÚÝẠ-ỹ]"
FIRST, SECOND = "english", "vietnamese"
IDENTIFIER_CHARS, SEGMENT_LETTERS, LABEL_LETTERS, SECOND_SHARE, FIRST_SHARE = 15, 12, 6, 0.05, 0.01
LABELS, LABEL_WIN, PAIRS, PAIR_WIN = 2, 2 / 3, 3, 0.6
FIELD_WORDS, TEXT_WORDS, WORDS_SECOND, WORDS_FIRST, TEXT_SECOND, STRAY_WORDS = 4, 6, 0.3, 0.1, 0.2, 1
BULLETS = " \t○●•▪◦■□◆◇▶►➢✓✔-"
LETTER_RUN = r"[\p{L}\p{Nl}\p{No}]{2,}"
#: Texts of which WORD_OR_NOT knows all letters, and what else may be in one; the first is the quicker test.
LATIN, UNCOMMON = r"\A[\x00-ž]*+\z", r"[^\x00-žƠơƯừ-ͯẠ-ỹ -⁯←-⇿■-◿]"
#: Their letters, those of most texts first; letters without case.
LETTERS, CASELESS = "ß-öø-žÀ-ÖØ-Þª²³µ¹º¼½¾ƠơƯưẠ-ỹ", "[ªº²³¹¼½¾ĸ]"
LETTER = f"[a-z[A-Z{LETTERS}]]"
#: Words in small letters and what is between words first; then letters alone, names, and other words that count.
WORD_OR_NOT = rf"([a-zß-öø-ÿ]{{2,}}+(?!{LETTER}))|[^a-zA-Z{LETTERS}]++|{LETTER}(?!{LETTER})|(?={LETTER}{{2,{IDENTIFIER_CHARS}}}+(?!{LETTER})){LETTER}+?\p{{Lu}}{LETTER}*+|\p{{Lu}}{CASELESS}{{1,{IDENTIFIER_CHARS - 1}}}+(?!{LETTER})|({LETTER}++)"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({LETTER_RUN})"), F.lit(1))


def kept_letters(text: Column) -> Column:
    """The letters of the words of two letters or more that are no names. Short words in capitals, or with one inside, are names.

    One regular expression finds what goes in texts of common letters; texts with any other are taken apart word by word.
    """
    name = lambda t: (F.length(t) <= IDENTIFIER_CHARS) & (((F.upper(t) == t) & (F.lower(t) != t)) | F.substring(t, 2, 100).rlike(r"\p{Lu}"))
    by_word = F.array_join(F.filter(letter_words(text), lambda t: ~name(t)), "")
    return F.when(~text.rlike(LATIN) & text.rlike(UNCOMMON), by_word).otherwise(F.regexp_replace(text, WORD_OR_NOT, "$1$2"))


def language_of(kept: Column, least: int = SEGMENT_LETTERS) -> Column:
    """One of the two languages by the letters that `kept_letters` gives, or null where there are too few letters or both kinds."""
    letters, second = F.length(kept), F.length(F.regexp_replace(F.regexp_replace(kept, "[a-zA-Z]+", ""), f"[^{SECOND_LETTERS[1:]}+", ""))
    share = second / F.nullif(letters, F.lit(0))
    return F.when(letters < least, None).when(share >= SECOND_SHARE, SECOND).when(share <= FIRST_SHARE, FIRST)


def text_language(text: Column, least: int = SEGMENT_LETTERS) -> Column:
    return language_of(kept_letters(text), least)


def segments(texts: DataFrame) -> DataFrame:
    """document_id, place, line_no, segment_no, text, body, language: sentences in order, lines without any as one row of nulls; a text without lines is one such row of line -1."""
    texts = texts.select("document_id", "place", composed(F.col("text")).alias("text"))
    lines = F.when(F.col("text") != "", F.split(F.regexp_replace("text", rf"(?:{LINE_END})\z", ""), LINE_END))
    lines = texts.select("document_id", "place", F.posexplode_outer(lines).alias("line_no", "line")).na.fill(-1, ["line_no"])
    parts = F.filter(F.transform(F.split(F.regexp_replace("line", "([.!?])", "$1→"), "→"), lambda x: F.btrim(x, F.lit(BULLETS))), lambda x: x != "")
    rows = lines.select("document_id", "place", "line_no", F.posexplode_outer(parts).alias("segment_no", "text"))
    rows = rows.withColumn("body", F.right("text", F.lit(1)).isin(*".!?")).withColumn("kept", kept_letters(F.col("text")))
    return rows.withColumn("language", language_of(F.col("kept"))).drop("kept")


def spoken_lines(found: DataFrame) -> DataFrame:
    """One row for each line of `segments`: whether it is blank, like a heading, or of both languages; the languages of its sentences in order, how many segments are in each, and the first that is in one."""
    spoken, count = F.when(F.col("body"), F.col("language")), lambda language: F.sum(F.coalesce(F.col("language") == language, F.lit(False)).cast("long"))
    number = F.when(F.col("language").isNotNull(), F.col("segment_no"))
    return found.groupBy("document_id", "place", "line_no").agg(
        (F.max(F.col("text").isNotNull()) == F.lit(False)).alias("blank"), F.coalesce(F.max(~F.col("body") & F.col("language").isNotNull()), F.lit(False)).alias("heading"), F.coalesce(F.min(spoken) != F.max(spoken), F.lit(False)).alias("mixed"),
        F.transform(F.sort_array(F.collect_list(F.when(spoken.isNotNull(), F.struct("segment_no", spoken.alias("l"))))), lambda x: x["l"]).alias("said"),
        count(FIRST).alias("in_first"), count(SECOND).alias("in_second"), F.min_by("language", number).alias("one"),
    )


def bilingual_pairs(lines: DataFrame) -> DataFrame:
    """document_id, first_to_second, second_to_first: how often a run of sentences in one language is followed by one in the other.

    A line with sentences of both languages is paired by itself; other lines form blocks, which end at blank and heading-like lines.
    """
    line = W.partitionBy("document_id").orderBy("place", "line_no")
    lines = lines.where("line_no >= 0")
    begins = F.col("blank") | F.col("heading") | F.col("mixed") | F.coalesce(F.lag("mixed").over(line), F.lit(False))
    blocks = lines.withColumn("block", F.sum(begins.cast("int")).over(line.rowsBetween(W.unboundedPreceding, 0)))
    said = blocks.select("document_id", "block", "place", "line_no", F.posexplode("said").alias("k", "l"))
    order = W.partitionBy("document_id", "block").orderBy("place", "line_no", "k")
    runs = said.withColumn("starts", F.coalesce(F.lag("l").over(order) != F.col("l"), F.lit(True)))
    by_block = runs.groupBy("document_id", "block").agg(F.min_by("l", F.struct("place", "line_no", "k")).alias("first"), F.floor(F.sum(F.col("starts").cast("int")) / 2).alias("pairs"))
    of = lambda language: F.sum(F.when(F.col("first") == language, F.col("pairs")).otherwise(0)).cast("long")
    return by_block.groupBy("document_id").agg(of(FIRST).alias("first_to_second"), of(SECOND).alias("second_to_first"))


def winner(a: Column, b: Column, least: int, share: float) -> Column:
    most = F.greatest(a, b)
    return F.when((most >= least) & (most / F.nullif(a + b, F.lit(0)) >= share), F.when(a > b, FIRST).otherwise(SECOND))


def primary_language(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: language, basis and the votes. Labels (headings) decide if they are clear, else the order of translations, else the number of sentences, else the first one; without any the default.

    texts: document_id, place, text; labels: document_id, label.
    """
    lines = cut(spoken_lines(segments(texts)))
    count = lambda column, language: F.sum((F.coalesce(column == language, F.lit(False))).cast("long"))
    own = text_language(composed(F.col("label")), LABEL_LETTERS)
    titles = labels.withColumn("l", own).groupBy("document_id").agg(count(F.col("l"), FIRST).alias("label_first"), count(F.col("l"), SECOND).alias("label_second"))
    at = F.when(F.col("one").isNotNull(), F.struct("place", "line_no"))
    body = lines.groupBy("document_id").agg(F.sum("in_first").alias("body_first"), F.sum("in_second").alias("body_second"), F.min_by("one", at).alias("one"))
    rows = body.join(titles, "document_id", "left").join(bilingual_pairs(lines), "document_id", "left").na.fill(0)
    c = F.col
    by_label = F.when(c("label_first") + c("label_second") >= LABELS, winner(c("label_first"), c("label_second"), LABELS, LABEL_WIN))
    by_order = winner(c("first_to_second"), c("second_to_first"), PAIRS, PAIR_WIN)
    by_body = F.when(c("body_first") > c("body_second"), FIRST).when(c("body_first") < c("body_second"), SECOND).otherwise(F.coalesce("one", F.lit(FIRST)))
    basis = F.when(by_label.isNotNull(), "structural").when(by_order.isNotNull(), "bilingual_order").otherwise("body_fallback")
    return rows.select("document_id", F.coalesce(by_label, by_order, by_body).alias("language"), basis.alias("basis"), "label_first", "label_second", "first_to_second", "second_to_first", "body_first", "body_second")


def mismatched(questions: DataFrame) -> DataFrame:
    """`questions` (stem, options, explanation, language) with `mismatch`: the text as a whole, or one field of enough words, is in the other language. Words with a capital inside don't count."""
    fields = F.concat(F.array(F.coalesce("stem", F.lit("")), F.coalesce("explanation", F.lit(""))), F.coalesce("options", F.array().cast("array<string>")))
    words = lambda t: F.filter(letter_words(t), lambda w: ~F.substring(w, 2, 1000).rlike(r"\p{Lu}"))
    counted = F.transform(F.transform(fields, words), lambda ws: F.struct(F.size(ws).alias("n"), F.size(F.filter(ws, lambda w: w.rlike(SECOND_LETTERS))).alias("v")))
    rows = questions.withColumn("_f", counted)
    total = lambda name: F.aggregate("_f", F.lit(0), lambda a, x: a + x[name])
    judged = lambda test: F.exists("_f", lambda x: (x["n"] >= FIELD_WORDS) & test(x["v"] / x["n"]))
    n, v = total("n"), total("v")
    first = ((v > STRAY_WORDS) & (v / F.greatest(n, F.lit(1)) > WORDS_FIRST)) | judged(lambda s: s >= WORDS_SECOND)
    second = ((n >= TEXT_WORDS) & (v / F.greatest(n, F.lit(1)) < TEXT_SECOND)) | judged(lambda s: s < WORDS_FIRST)
    return rows.withColumn("mismatch", F.when(F.col("language") == FIRST, first).when(F.col("language") == SECOND, second).otherwise(F.lit(False))).drop("_f")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a made-up translation of each line behind it on the line, or on a line of its own, or none; some lines are left blank."""
    docs = corpus.documents(spark, d)
    other = lambda x: F.translate(F.lower(x), "aeo", "àéô")
    k = F.col("document_id")
    beside, below = (F.array_join(F.transform(F.split("content", "\n", -1), lambda x: F.concat(x, F.lit(s), other(x))), "\n") for s in (" ", "\n"))
    return docs.select("document_id", F.lit(0).alias("place"), F.when(k % 3 == 0, beside).when(k % 3 == 1, below).otherwise(F.replace("content", F.lit(". "), F.lit(".\n\n"))).alias("text"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """The beginnings of two lines of every second document."""
    docs = corpus.documents(spark, d).where("document_id % 2 = 0")
    return docs.select("document_id", F.explode(F.slice(F.transform(F.split("content", "\n", -1), lambda x: F.substring(x, 1, 30)), 1, 2)).alias("label"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    t, k = F.coalesce("text", F.lit("")), F.col("doc_id")
    cut = lambda a, n: F.substring(t, a, n)
    return table(spark, d, "documents").select(k.alias("question_id"), cut(1, 60).alias("stem"), F.array(cut(61, 12), F.translate(cut(80, 40), "ao", "àô"), cut(130, 30)).alias("options"), F.when(k % 5 != 0, cut(200, 80)).alias("explanation"), F.when(k % 7 == 0, "french").when(k % 2 == 0, FIRST).otherwise(SECOND).alias("language"))


QUERIES = {
    "primary_language": lambda s, d: primary_language(_texts(s, d), _labels(s, d)),
    "language_mismatch": lambda s, d: mismatched(_questions(s, d)).select("question_id", "language", "mismatch"),
}
_RUN = LETTER_RUN


def _language_sql(text: str, least: int) -> str:
    kept = f"array_to_string(list_filter(regexp_extract_all({text}, '{_RUN}'), lambda t: NOT (length(t) <= 15 AND ((upper(t) = t AND lower(t) <> t) OR regexp_matches(substr(t, 2), '\\p{{Lu}}')))), '')"
    second = f"length(regexp_replace({kept}, '[^{SECOND_LETTERS[1:]}', '', 'g'))"
    return f"CASE WHEN length({kept}) < {least} THEN NULL WHEN {second} / length({kept}) >= 0.05 THEN 'vietnamese' WHEN {second} / length({kept}) <= 0.01 THEN 'english' END"


def _win_sql(a: str, b: str, least: int, share: str) -> str:
    return f"CASE WHEN greatest({a}, {b}) >= {least} AND greatest({a}, {b}) / CAST({a} + {b} AS DOUBLE) >= {share} THEN CASE WHEN {a} > {b} THEN 'english' ELSE 'vietnamese' END END"


ORACLES = {
    "primary_language": f"""WITH x AS (SELECT doc_id AS document_id, coalesce(text, '') AS c, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
  t AS (SELECT document_id, CASE document_id % 3 WHEN 0 THEN list_transform(l, lambda v: v || ' ' || translate(lower(v), 'aeo', 'àéô')) WHEN 1 THEN flatten(list_transform(l, lambda v: [v, translate(lower(v), 'aeo', 'àéô')])) ELSE string_split(replace(c, '. ', '.' || chr(10) || chr(10)), chr(10)) END AS l FROM x),
  li AS (SELECT document_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM t), pa AS (SELECT document_id, line_no, list_filter(list_transform(string_split(regexp_replace(line, '([.!?])', '\\1→', 'g'), '→'), lambda v: trim(v, '{BULLETS}')), lambda v: v <> '') AS p FROM li),
  sg AS (SELECT document_id, line_no, unnest(p) AS text, generate_subscripts(p, 1) AS k FROM pa), sl AS (SELECT *, regexp_matches(text, '[.!?]$') AS body, {_language_sql('text', 12)} AS language FROM sg),
  ln AS (SELECT pa.document_id, pa.line_no, count(text) = 0 AS blank, coalesce(bool_or(NOT body AND language IS NOT NULL), false) AS heading, count(DISTINCT CASE WHEN body THEN language END) = 2 AS mixed FROM pa LEFT JOIN sl ON sl.document_id = pa.document_id AND sl.line_no = pa.line_no GROUP BY 1, 2),
  bl AS (SELECT document_id, line_no, sum(CAST(b AS INT)) OVER (PARTITION BY document_id ORDER BY line_no) AS block FROM (SELECT *, blank OR heading OR mixed OR coalesce(lag(mixed) OVER (PARTITION BY document_id ORDER BY line_no), false) AS b FROM ln)),
  rn AS (SELECT sl.document_id, block, sl.line_no, k, language AS l, lag(language) OVER (PARTITION BY sl.document_id, block ORDER BY sl.line_no, k) AS before FROM sl JOIN bl ON bl.document_id = sl.document_id AND bl.line_no = sl.line_no WHERE body AND language IS NOT NULL),
  bk AS (SELECT document_id, block, arg_min(l, line_no * 100000 + k) AS first, count(*) FILTER (before IS DISTINCT FROM l) // 2 AS pairs FROM rn GROUP BY 1, 2),
  pr AS (SELECT document_id, sum(CASE WHEN first = 'english' THEN pairs ELSE 0 END) AS ab, sum(CASE WHEN first = 'vietnamese' THEN pairs ELSE 0 END) AS ba FROM bk GROUP BY 1),
  lb AS (SELECT document_id, unnest(l[1:2]) AS label FROM x WHERE document_id % 2 = 0), lv AS (SELECT document_id, {_language_sql('substring(label, 1, 30)', 6)} AS language FROM lb), lc AS (SELECT document_id, count(*) FILTER (language = 'english') AS le, count(*) FILTER (language = 'vietnamese') AS lw FROM lv GROUP BY 1),
  vb AS (SELECT document_id, count(*) FILTER (language = 'english') AS be, count(*) FILTER (language = 'vietnamese') AS bv, arg_min(language, line_no * 100000 + k) FILTER (language IS NOT NULL) AS one FROM sl GROUP BY 1),
  j AS (SELECT x.document_id, coalesce(le, 0) AS le, coalesce(lw, 0) AS lw, CAST(coalesce(ab, 0) AS BIGINT) AS ab, CAST(coalesce(ba, 0) AS BIGINT) AS ba, coalesce(be, 0) AS be, coalesce(bv, 0) AS bv, one FROM x LEFT JOIN lc USING (document_id) LEFT JOIN pr USING (document_id) LEFT JOIN vb USING (document_id)),
  w AS (SELECT *, CASE WHEN le + lw >= 2 THEN {_win_sql('le', 'lw', 2, '2 / 3')} END AS a, {_win_sql('ab', 'ba', 3, '0.6')} AS b, CASE WHEN be > bv THEN 'english' WHEN be < bv THEN 'vietnamese' ELSE coalesce(one, 'english') END AS d FROM j)
  SELECT document_id, coalesce(a, b, d) AS language, CASE WHEN a IS NOT NULL THEN 'structural' WHEN b IS NOT NULL THEN 'bilingual_order' ELSE 'body_fallback' END AS basis, le AS label_first, lw AS label_second, ab AS first_to_second, ba AS second_to_first, be AS body_first, bv AS body_second FROM w""",
    "language_mismatch": f"""WITH q AS (SELECT doc_id AS question_id, coalesce(text, '') AS t, CASE WHEN doc_id % 7 = 0 THEN 'french' WHEN doc_id % 2 = 0 THEN 'english' ELSE 'vietnamese' END AS language FROM documents),
  f AS (SELECT *, [substring(t, 1, 60), CASE WHEN question_id % 5 <> 0 THEN substring(t, 200, 80) ELSE '' END, substring(t, 61, 12), translate(substring(t, 80, 40), 'ao', 'àô'), substring(t, 130, 30)] AS fields FROM q),
  w AS (SELECT *, list_transform(fields, lambda x: list_filter(regexp_extract_all(x, '{_RUN}'), lambda t: NOT regexp_matches(substr(t, 2), '\\p{{Lu}}'))) AS ws FROM f), c AS (SELECT *, list_transform(ws, lambda x: [len(x), len(list_filter(x, lambda t: regexp_matches(t, '{SECOND_LETTERS}')))]) AS c FROM w),
  s AS (SELECT *, list_sum(list_transform(c, lambda x: x[1])) AS n, list_sum(list_transform(c, lambda x: x[2])) AS v FROM c)
  SELECT question_id, language, CASE language WHEN 'english' THEN (v > 1 AND v / greatest(n, 1) > 0.1) OR len(list_filter(c, lambda x: x[1] >= 4 AND x[2] / x[1] >= 0.3)) > 0 WHEN 'vietnamese' THEN (n >= 6 AND v / greatest(n, 1) < 0.2) OR len(list_filter(c, lambda x: x[1] >= 4 AND x[2] / x[1] < 0.1)) > 0 ELSE false END AS mismatch FROM s""",
}
