"""Scoped vector retrieval and conversation context, for all queries and conversations at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lectern.sources.tables import table

# Limits of the conversation context, in characters, words and messages.
RECENT, STUDENT_CHARS, TUTOR_CHARS, TOTAL_CHARS, FOLLOW_UP_WORDS, PREVIOUS_CHARS, TITLE_CHARS, TOP_K = 6, 300, 400, 1800, 12, 200, 60, 4
# The phrase of an answer that declines, and the beginning of a request to explain a quiz question.
REFUSAL = "don't know based on the provided documents"
EXPLAIN = "Explain more about this quiz question"


#: Queries that are broadcast at most (64 numbers each: 16 MB), and the parts of a scope beyond that.
BROADCAST_QUERIES, SALTS = 50_000, 32


def scope(filters: dict) -> Column:
    """A metadata filter as a column: {"$and": [...]}, {col: value}, {col: {"$eq": v}}, {col: {"$in": [...]}}; an empty $in is false, other operators are refused."""

    def one(name: str, value) -> Column:
        if name == "$and":
            return reduce(lambda a, b: a & b, map(scope, value))
        if not isinstance(value, dict):
            return F.col(name) == value
        (op, operand), = value.items()
        if op == "$eq":
            return F.col(name) == operand
        if op == "$in":
            return F.col(name).isin(list(operand)) if operand else F.lit(False)
        raise ValueError(f"unsupported operator {op}")

    return reduce(lambda a, b: a & b, (one(k, v) for k, v in filters.items()))


def unit(vector: str) -> Column:
    return F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def top_k(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, dimension: int = 64) -> DataFrame:
    """The k nearest vectors by cosine distance in each query's scope, ties by id; other dimensions are left out.

    Norms are computed once for each vector. Few queries (their number is checked) are broadcast, so that vectors stay where they
    are read; more meet them by scope and a salt, so that a scope of many vectors is split. Only distances are ranked, k of each
    task leaving it."""
    q = queries.where(F.size("embedding") == dimension).select(F.col("vec_id").alias("query_id"), F.col("scope"), F.col("embedding").alias("q"), unit("embedding").alias("qn"))
    c = corpus.where(F.size("embedding") == dimension).select(F.col("vec_id"), F.col("scope"), F.col("embedding").alias("c"), unit("embedding").alias("cn"))
    dot = F.aggregate(F.zip_with("q", "c", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    if q.count() <= BROADCAST_QUERIES:
        pairs = c.join(F.broadcast(q), "scope")
    else:
        pairs = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).join(c.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")), ["scope", "salt"])
    near = pairs.where("query_id <> vec_id").select("query_id", "vec_id", F.round(1 - dot / (F.col("qn") * F.col("cn")), 6).alias("distance"))
    order = W.partitionBy("query_id").orderBy("distance", "vec_id")
    return near.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role <> 'system'")


def recent(rows: DataFrame, n: int = RECENT) -> DataFrame:
    """The last n messages; if no user message is among them, the latest user message besides."""
    order = W.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    users = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(W.partitionBy("conv_id"))
    ranked = rows.withColumn("rn", F.row_number().over(order)).withColumn("last_user", users)
    within = F.max(F.when(F.col("rn") <= n, F.col("role") == "user").cast("int")).over(W.partitionBy("conv_id"))
    return ranked.withColumn("has_user", within).where((F.col("rn") <= n) | ((F.col("has_user") == 0) & (F.col("turn") == F.col("last_user")) & (F.col("role") == "user"))).select("conv_id", "turn", "role", "text")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def shorten(text: Column, limit: int) -> Column:
    """White space collapsed; a longer text is cut at its last sentence end in the second half of the limit, else at a word."""
    whole = collapsed(text)
    head = F.substring(whole, 1, limit)
    sentence = F.regexp_extract(head, r"^(.*[.?!]) ", 1)
    word = F.regexp_replace(F.regexp_replace(head, " [^ ]*$", ""), "[ ,;:-]+$", "")
    return F.when(F.length(whole) <= limit, whole).when(F.length(sentence) > limit // 2, F.concat(sentence, F.lit(" …"))).otherwise(F.concat(word, F.lit(" …")))


def student_text(text: Column, limit: int) -> Column:
    """A student's message for later turns; a request to explain a quiz question becomes that question."""
    question = F.regexp_extract(text, r"(?m)^[ \t]*Question:[ \t]*(.*?)[ \t\r]*$", 1)
    asks = F.ltrim(text).startswith(EXPLAIN) & (question != "")
    return shorten(F.when(asks, F.concat(F.lit("Explain more about the quiz question: "), question)).otherwise(text), limit)


def history(rows: DataFrame) -> DataFrame:
    """Messages shortened by role, tutor answers without their citations, the oldest dropped until all lines fit the budget."""
    tutor = shorten(F.regexp_replace("text", r"(?i)\s*\(source:[^)]*\)", ""), TUTOR_CHARS)
    line = F.when(F.col("role") == "user", F.concat(F.lit("Student: "), student_text(F.col("text"), STUDENT_CHARS))).otherwise(F.concat(F.lit("Tutor: "), tutor))
    newest = W.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")).rowsBetween(W.unboundedPreceding, 0)
    marked = rows.withColumn("line", line).withColumn("fits", F.sum(F.length("line") + 1).over(newest) <= TOTAL_CHARS)
    lines = F.sort_array(F.collect_list(F.when(F.col("fits"), F.struct("turn", "role", "text", "line"))))
    text = F.array_join(F.transform(lines, lambda m: m["line"]), "\n")
    kept = marked.groupBy("conv_id").agg(F.sum(F.col("fits").cast("long")).alias("messages"), text.alias("history"))
    return kept.withColumn("history", F.when(F.col("messages") == 0, "No previous messages.").otherwise(F.col("history")))


def followups(rows: DataFrame) -> DataFrame:
    """C11: a short question takes the previous user text, shortened, before it."""
    order = W.partitionBy("conv_id").orderBy("turn", "text")
    users = rows.where("role = 'user'").withColumn("previous", F.lag("text").over(order)).withColumn("text", F.trim("text"))
    short = (F.size(F.split("text", r"\s+")) <= FOLLOW_UP_WORDS) & (F.col("previous") != "")
    return users.select("conv_id", "turn", F.when(short, F.concat(student_text(F.col("previous"), PREVIOUS_CHARS), F.lit("\n"), F.col("text"))).otherwise(F.col("text")).alias("query"))


def titles(rows: DataFrame) -> DataFrame:
    """A title from the first question: white space collapsed, cut at a word; a default where there is none."""
    first = rows.groupBy("conv_id").agg(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.struct("turn", "text"))).alias("text"))
    clean = F.coalesce(collapsed(F.col("text")), F.lit(""))
    word = F.regexp_replace(F.regexp_replace(F.substring(clean, 1, TITLE_CHARS), " [^ ]*$", ""), "[ ,.;:-]+$", "")
    return first.select("conv_id", F.when(clean == "", "New conversation").when(F.length(clean) > TITLE_CHARS, F.concat(word, F.lit("…"))).otherwise(clean).alias("title"))


def listing(rows: DataFrame) -> DataFrame:
    """C14: conversations with their size and last turn, longest first by last turn."""
    g = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn"))
    return g


def grounding(rows: DataFrame) -> DataFrame:
    """Whether an answer declines for want of context, by its refusal phrase."""
    status = F.when(F.lower("text").contains(REFUSAL), "insufficient_context").otherwise("supported")
    return rows.where("role = 'assistant'").select("conv_id", "turn", status.alias("grounding_status"))


UNKNOWN_SOURCE, UNKNOWN_PAGE = "Unknown source", "Unknown page"


def citations(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Each query's hits in order of rank as numbered citations: title (the source's last part), page and content; with the hash of the context block made of all of them."""
    rows = hits.join(texts, "vec_id")
    source, page, content = F.coalesce("source", F.lit(UNKNOWN_SOURCE)), F.coalesce(F.col("page").cast("string"), F.lit(UNKNOWN_PAGE)), F.coalesce("content", F.lit(""))
    rows = rows.select("query_id", F.struct("rank", "vec_id", source.alias("source"), page.alias("page"), content.alias("content")).alias("hit"))
    rows = rows.groupBy("query_id").agg(F.sort_array(F.collect_list("hit")).alias("hits"))  # k hits at most
    part = lambda h, i: F.concat(F.lit("[Document "), (i + 1).cast("string"), F.lit("]\nSource: "), h["source"], F.lit("\nPage: "), h["page"], F.lit("\nContent:\n"), h["content"])
    rows = rows.select("query_id", F.sha2(F.array_join(F.transform("hits", part), "\n\n"), 256).alias("context_hash"), F.posexplode("hits").alias("at", "h"))
    title = F.regexp_extract(F.regexp_replace("h.source", "/+$", ""), "[^/]*$", 0)
    return rows.select("query_id", "context_hash", (F.col("at") + 1).cast("int").alias("source_id"), title.alias("title"), "h.page", "h.content")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumn("scope", F.col("label"))


def _top_k(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return top_k(v.where("vec_id % 50 = 0"), v)


def _scoped(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).where(scope({"$and": [{"label": {"$in": [1, 2, 3]}}]}))
    return top_k(v.where("vec_id % 50 = 0"), v, 2)


def _context(spark: SparkSession, d: str) -> DataFrame:
    """Vectors stand for documents of their number: the text, a source on a shelf, some without, and a page, some without."""
    k = F.col("doc_id")
    texts = table(spark, d, "documents").select(k.alias("vec_id"), F.when(k % 7 != 0, F.concat(F.lit("shelf/"), "source", F.lit(".pdf"))).alias("source"), F.when(k % 5 != 0, k % 5).alias("page"), F.substring("text", 1, 800).alias("content"))
    return citations(_top_k(spark, d), texts)


def collapsed_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'), ' ')"


def shorten_sql(whole: str, limit: int) -> str:
    head = f"substring({whole}, 1, {limit})"
    sentence = f"regexp_extract({head}, '^(.*[.?!]) ', 1)"
    return f"""CASE WHEN length({whole}) <= {limit} THEN {whole} WHEN length({sentence}) > {limit // 2} THEN {sentence} || ' …' ELSE regexp_replace(regexp_replace({head}, ' [^ ]*$', ''), '[ ,;:-]+$', '') || ' …' END"""


def student_sql(text: str, limit: int) -> str:
    question = f"regexp_extract({text}, '(?m)^[ \\t]*Question:[ \\t]*(.*?)[ \\t\\r]*$', 1)"
    said = f"CASE WHEN starts_with(ltrim({text}), '{EXPLAIN}') AND {question} <> '' THEN 'Explain more about the quiz question: ' || {question} ELSE {text} END"
    return shorten_sql(collapsed_sql(said), limit)


MESSAGES_SQL = "messages AS (SELECT * FROM conversations WHERE role <> 'system')"
DOT = "list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"
NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


def top_k_sql(where: str, k: int) -> str:
    return f"""WITH v AS (SELECT * FROM embeddings WHERE {where}), near AS (SELECT q.vec_id AS query_id, c.vec_id, round(1 - {DOT} / ({NORM.format('q')} * {NORM.format('c')}), 6) AS distance FROM v q JOIN v c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM near) WHERE rank <= {k}"""


QUERIES = {
    "vector_topk": _top_k,
    "scoped_topk": _scoped,
    "recent_messages": lambda s, d: recent(messages(s, d)),
    "history_budget": lambda s, d: history(recent(messages(s, d))),
    "followup_query": lambda s, d: followups(messages(s, d)),
    "conversation_titles": lambda s, d: titles(messages(s, d)),
    "conversation_listing": lambda s, d: listing(messages(s, d)),
    "grounding_status": lambda s, d: grounding(messages(s, d)),
    "context_citations": _context,
}
RECENT_SQL = f"""{MESSAGES_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS rn, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last_user FROM messages),
  recent AS (SELECT conv_id, turn, role, text FROM (SELECT *, max(CAST(role = 'user' AS INT)) FILTER (rn <= 6) OVER (PARTITION BY conv_id) AS has_user FROM ranked) WHERE rn <= 6 OR (has_user = 0 AND turn = last_user AND role = 'user'))"""
ORACLES = {
    "vector_topk": top_k_sql("len(embedding) = 64", 4),
    "scoped_topk": top_k_sql("len(embedding) = 64 AND label IN (1, 2, 3)", 2),
    "recent_messages": f"WITH {RECENT_SQL} SELECT * FROM recent",
    "history_budget": f"""WITH {RECENT_SQL}, said AS (SELECT *, CASE WHEN role = 'user' THEN 'Student: ' || {student_sql('text', 300)} ELSE 'Tutor: ' || {shorten_sql(collapsed_sql("regexp_replace(text, '(?i)\\s*\\(source:[^)]*\\)', '', 'g')"), 400)} END AS line FROM recent),
      kept AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC ROWS UNBOUNDED PRECEDING) <= 1800 AS fits FROM said)
      SELECT conv_id, count(*) FILTER (fits) AS messages, coalesce(string_agg(line, chr(10) ORDER BY turn, role, text) FILTER (fits), 'No previous messages.') AS history FROM kept GROUP BY 1""",
    "followup_query": f"""WITH {MESSAGES_SQL}, users AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS previous FROM messages WHERE role = 'user')
      SELECT conv_id, turn, CASE WHEN len(regexp_split_to_array(trim(text), '\\s+')) <= 12 AND previous <> '' THEN {student_sql('previous', 200)} || chr(10) || trim(text) ELSE trim(text) END AS query FROM users""",
    "conversation_titles": f"""WITH {MESSAGES_SQL}, firsts AS (SELECT conv_id, {collapsed_sql('text')} AS c FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rn FROM messages WHERE role = 'user') WHERE rn = 1)
      SELECT conv_id, CASE WHEN coalesce(c, '') = '' THEN 'New conversation' WHEN length(c) > 60 THEN regexp_replace(regexp_replace(substring(c, 1, 60), ' [^ ]*$', ''), '[ ,.;:-]+$', '') || '…' ELSE c END AS title FROM (SELECT DISTINCT conv_id FROM messages) LEFT JOIN firsts USING (conv_id)""",
    "conversation_listing": f"WITH {MESSAGES_SQL} SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM messages GROUP BY 1",
    "grounding_status": f"""WITH {MESSAGES_SQL} SELECT conv_id, turn, CASE WHEN contains(lower(text), 'don''t know based on the provided documents') THEN 'insufficient_context' ELSE 'supported' END AS grounding_status FROM messages WHERE role = 'assistant'""",
    "context_citations": f"""WITH hits AS ({top_k_sql("len(embedding) = 64", 4)}), j AS (SELECT query_id, rank, CASE WHEN doc_id % 7 <> 0 THEN 'shelf/' || source || '.pdf' END AS s, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 5 AS VARCHAR) ELSE 'Unknown page' END AS page, substring(coalesce(text, ''), 1, 800) AS content FROM hits JOIN documents ON doc_id = vec_id),
      n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS source_id FROM j),
      b AS (SELECT query_id, sha256(string_agg('[Document ' || source_id || ']' || chr(10) || 'Source: ' || coalesce(s, 'Unknown source') || chr(10) || 'Page: ' || page || chr(10) || 'Content:' || chr(10) || content, chr(10) || chr(10) ORDER BY source_id)) AS context_hash FROM n GROUP BY 1)
      SELECT query_id, context_hash, source_id, CASE WHEN s IS NULL THEN 'Unknown source' ELSE source || '' END AS title, page, content FROM (SELECT *, replace(s, 'shelf/', '') AS source FROM n) JOIN b USING (query_id)""",
}
