"""Upkeep of registries, chunks, pages and sessions: upserts, cascades, references, validity and read models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lectern.operators import corpus, intervals, learning, retrieval
from lectern.sources import adapters
from lectern.sources.tables import table


def upsert(known: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """New values over known ones; a null new value keeps the known one."""
    both = known.alias("k").join(new.alias("n"), keys, "full_outer")
    return both.select(*keys, *(F.coalesce(F.col(f"n.{v}"), F.col(f"k.{v}")).alias(v) for v in values))


def upsert_latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A10: the latest row of each id, if its owner is the first row's owner."""
    own = W.partitionBy(key)
    first = F.first("owner_id").over(own.orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.withColumn("first_owner", first).where("owner_id = first_owner").withColumn("rn", F.row_number().over(own.orderBy(F.desc(order)))).where("rn = 1").drop("rn", "first_owner")


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> DataFrame:
    """Rows left in each table after the documents in `gone` are deleted, as counts."""
    left = [df.join(gone, key, "left_anti").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    out = left[0]
    for df in left[1:]:
        out = out.unionByName(df)
    return out


def missing_pages(pages: DataFrame, least: int = 50) -> DataFrame:
    """Pages that are expected up to the last one but missing, or with too little visible text."""
    visible = F.length(F.translate("content", " \t\n\r\x0b\x0c", ""))
    span = pages.groupBy("document_id").agg(F.max("page").alias("last"))
    wanted = span.select("document_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("page"))
    rows = wanted.join(pages.withColumn("visible", visible), ["document_id", "page"], "left")
    return rows.where((F.coalesce("visible", F.lit(0)) < least)).select("document_id", "page", F.col("visible").isNull().alias("missing"))


def template_elements(pages: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """First lines found on at least `least` pages and a share of a document's pages."""
    first = pages.select("document_id", "page", F.md5(F.get(F.split("content", "\n"), F.lit(0))).alias("digest"))
    total = pages.groupBy("document_id").agg(F.countDistinct("page").alias("pages"))
    return first.groupBy("document_id", "digest").agg(F.countDistinct("page").alias("on_pages")).join(total, "document_id").where((F.col("on_pages") >= least) & (F.col("on_pages") >= F.ceil(F.col("pages") * share))).select("document_id", "digest", "on_pages")


def trim_overlap(chunks: DataFrame, least: int = 30, most: int = 300) -> DataFrame:
    """How many characters of a chunk's start repeat the end of the one before; the longest such piece.

    Only the ends of chunks move. Where the first `least` characters are first found in the end before, the longest piece may begin;
    lengths are tried one by one only if it doesn't.
    """
    order = W.partitionBy("document_id").orderBy("chunk_index")
    ends = chunks.select("document_id", "chunk_index", F.left("content", F.lit(most)).alias("head"), F.right("content", F.lit(most)).alias("tail"))
    rows = ends.withColumn("before", F.lag("tail").over(order)).drop("tail")
    rows = rows.withColumn("at", F.when(F.length("head") >= least, F.position(F.left("head", F.lit(least)), F.col("before"))))
    rows = rows.withColumn("n", F.length("before") - F.col("at") + 1)
    same = lambda n: F.right("before", n) == F.left("head", n)
    # From the start at `at` on, the piece can't be longer than the chunk.
    sizes = F.filter(F.sequence(F.lit(least), F.least("n", F.length("head"))), same)
    longest = F.when(F.col("at") == 0, 0).when((F.col("n") <= F.length("head")) & same(F.col("n")), F.col("n")).otherwise(F.array_max(sizes))
    return rows.select("document_id", "chunk_index", F.coalesce(F.when(F.col("at").isNotNull(), longest), F.lit(0)).cast("long").alias("overlap"))


def batches(items: DataFrame, count_cap: int, size_cap: int) -> DataFrame:
    """Items in order into batches that hold at most `count_cap` items and `size_cap` characters; a larger item is a batch of its own. A fold over each document's ordered items."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", F.length("content").cast("long").alias("size"))))
    start = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("size"), F.array().cast("array<struct<chunk_index:bigint,batch:bigint>>").alias("out"))

    def step(acc, x):
        full = (acc["n"] > 0) & ((acc["n"] >= count_cap) | (acc["size"] + x["size"] > size_cap))
        batch = F.when(full, acc["batch"] + 1).otherwise(acc["batch"])
        put = F.array_append(acc["out"], F.struct(x["chunk_index"].alias("chunk_index"), batch.alias("batch")))
        return F.struct(batch.alias("batch"), F.when(full, F.lit(1).cast("long")).otherwise(acc["n"] + 1).alias("n"), F.when(full, x["size"]).otherwise(acc["size"] + x["size"]).alias("size"), put.alias("out"))

    return items.groupBy("document_id").agg(F.aggregate(ordered, start, step)["out"].alias("out")).select("document_id", F.inline("out"))


def listed_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks by the number at the end of their id."""
    return chunks.select("document_id", "vector_id", F.regexp_extract("vector_id", r"_(\d+)$", 1).cast("long").alias("number"))


def numbered_sources(docs: DataFrame) -> DataFrame:
    """Each owner's documents with a running number."""
    return docs.select("owner_id", "document_id", F.row_number().over(W.partitionBy("owner_id").orderBy("document_id")).cast("long").alias("number"))


def rank_merge(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Two ranked lists of a query as one: the best rank of each item, cut to k."""
    rows = first.unionByName(second).groupBy("query_id", "vec_id").agg(F.min("rank").alias("best"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("best", "vec_id")).cast("long")).where(F.col("rank") <= k).select("query_id", "vec_id", "rank")


def quiz_status(attempts: DataFrame) -> DataFrame:
    """each student's quiz is complete if an attempt was finished, else partial; with the newest attempt."""
    return attempts.groupBy("student_id", "quiz_id").agg(F.when(F.max(F.col("completed").cast("int")) == 1, "complete").otherwise("partial").alias("status"), F.max_by("attempt_id", F.struct("submitted_at", "attempt_id")).alias("newest_attempt"))


def stale_documents(orders: DataFrame, customers: DataFrame, version: int) -> DataFrame:
    """keys that any of three branches names, with another version than the current one."""
    a = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    b = orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))
    c = customers.where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    return a.union(b).union(c).distinct().join(customers.select(F.col("c_custkey").alias("k"), F.pmod("c_nationkey", F.lit(3)).alias("version")), "k").where(~F.col("version").eqNullSafe(version))


def agenda(rows: DataFrame, today: str) -> DataFrame:
    """sessions by their place against today, for each learner."""
    day = F.lit(today).cast("date")
    bucket = F.when(F.col("day") < day, F.when(F.col("status").isin("purchase", "error"), "done").otherwise("overdue")).when(F.col("day") == day, "today").when(F.col("day") <= F.date_add(day, 7), "upcoming").otherwise("later")
    return rows.groupBy("owner_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("minutes").cast("long").alias("minutes"))


def session_rejects(rows: DataFrame) -> DataFrame:
    """Sessions that break a rule, with the first rule they break."""
    code = F.when(F.col("minutes") > 100, "too_long").when(F.col("minutes") < 25, "too_short").when(F.col("s") + F.col("minutes") > 1440, "past_midnight")
    return rows.select("session_id", code.alias("code")).where("code IS NOT NULL")


def topic_progress(rows: DataFrame, planned: int = 600) -> DataFrame:
    """Minutes done, capped at what was planned, and what is left."""
    done = F.least(F.sum(F.when(F.col("status") == "purchase", F.col("minutes")).otherwise(0)), F.lit(planned)).cast("long")
    return rows.groupBy("owner_id").agg(done.alias("completed")).withColumn("remaining", F.greatest(F.lit(planned) - F.col("completed"), F.lit(0)).cast("long")).withColumn("finished", F.col("remaining") == 0)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a document: its lines in the order of the text, without every fourth."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("page", "content")).withColumn("page", F.col("page").cast("long")).where("page % 4 <> 2")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return corpus.fixed_chunks(corpus.documents(spark, d))


def _upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    known = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("path"))
    new = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("indexed").alias("status"), F.when(F.col("o_orderkey") % 4 == 0, F.lit("new")).alias("path"))
    return upsert(known, new, ["o_orderkey"], ["status", "path"])


def _latest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.pmod("event_id", F.lit(997)).alias("vector_id"), F.col("event_id").alias("n"), F.pmod("user_id", F.lit(2)).alias("owner_id"))
    return upsert_latest(e, "vector_id", "n")


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    attempts = adapters.attempts(spark, d)
    gone = attempts.where("student_id % 10 = 3").select("quiz_id").distinct()
    return cascade({"attempts": attempts, "scores": learning._scores(spark, d)}, gone, "quiz_id")


def _merged(spark: SparkSession, d: str) -> DataFrame:
    v = retrieval._vectors(spark, d)
    q = v.where("vec_id % 50 = 0")
    return rank_merge(retrieval.top_k(q, v).select("query_id", "vec_id", "rank"), retrieval.top_k(q, v.where("vec_id % 2 = 0")).select("query_id", "vec_id", "rank"), 4)


PAGES_SQL = "pages_ AS (SELECT * FROM (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS content, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS page FROM documents) WHERE page % 4 <> 2)"
CHUNK_SQL = f"{corpus.DOCS_SQL}, chunks AS ({corpus.CHUNKS_SQL.format('docs')})"
SESSIONS = intervals.SESSIONS_SQL
QUERIES = {
    "registry_upsert": _upsert,
    "chunk_upsert": _latest,
    "delete_cascade": _cascade,
    "missing_pages": lambda s, d: missing_pages(_pages(s, d)),
    "template_elements": lambda s, d: template_elements(_pages(s, d), 2, 0.05),
    "overlap_trim": lambda s, d: trim_overlap(_chunks(s, d)),
    "topic_batches": lambda s, d: batches(_chunks(s, d), 4, 2500),
    "chunk_listing": lambda s, d: listed_chunks(_chunks(s, d)),
    "source_listing": lambda s, d: numbered_sources(corpus.documents(s, d)),
    "rank_merge": _merged,
    "quiz_status": lambda s, d: quiz_status(adapters.attempts(s, d)),
    "schema_stale_union": lambda s, d: stale_documents(table(s, d, "orders"), table(s, d, "customer"), 2),
    "agenda": lambda s, d: agenda(intervals.sessions(s, d), "2024-01-15"),
    "session_rejects": lambda s, d: session_rejects(intervals.sessions(s, d)),
    "topic_progress": lambda s, d: topic_progress(intervals.sessions(s, d)),
}
ORACLES = {
    "registry_upsert": "WITH k AS (SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS path FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, 'indexed' AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'new' END AS path FROM orders WHERE o_orderkey % 2 = 0) SELECT o_orderkey, coalesce(n.status, k.status) AS status, coalesce(n.path, k.path) AS path FROM k FULL OUTER JOIN n USING (o_orderkey)",
    "chunk_upsert": "WITH e AS (SELECT event_id % 997 AS vector_id, event_id AS n, user_id % 2 AS owner_id FROM events), f AS (SELECT *, first_value(owner_id) OVER (PARTITION BY vector_id ORDER BY n) AS fo FROM e) SELECT vector_id, n, owner_id FROM (SELECT *, row_number() OVER (PARTITION BY vector_id ORDER BY n DESC) AS rn FROM f WHERE owner_id = fo) WHERE rn = 1",
    "delete_cascade": f"{learning.SCORED_SQL}, gone AS (SELECT DISTINCT quiz_id FROM attempts WHERE student_id % 10 = 3) SELECT 'attempts' AS table_name, count(*) AS rows FROM attempts WHERE quiz_id NOT IN (SELECT quiz_id FROM gone) UNION ALL SELECT 'scores', count(*) FROM scores WHERE quiz_id NOT IN (SELECT quiz_id FROM gone)",
    "missing_pages": f"WITH {PAGES_SQL}, w AS (SELECT document_id, unnest(range(0, max(page) + 1)) AS page FROM pages_ GROUP BY 1), j AS (SELECT w.document_id, w.page, {corpus.VISIBLE.replace('text', 'content')} AS visible FROM w LEFT JOIN pages_ p ON w.document_id = p.document_id AND w.page = p.page) SELECT document_id, page, visible IS NULL AS missing FROM j WHERE coalesce(visible, 0) < 50",
    "template_elements": f"WITH {PAGES_SQL}, f AS (SELECT document_id, md5(content) AS digest, count(DISTINCT page) AS on_pages FROM pages_ GROUP BY 1, 2), t AS (SELECT document_id, count(DISTINCT page) AS pages FROM pages_ GROUP BY 1) SELECT document_id, digest, on_pages FROM f JOIN t USING (document_id) WHERE on_pages >= 2 AND on_pages >= ceil(pages * CAST(0.05 AS DOUBLE))",
    "overlap_trim": f"WITH {CHUNK_SQL}, l AS (SELECT document_id, chunk_index, content, lag(content) OVER (PARTITION BY document_id ORDER BY chunk_index) AS before FROM chunks) SELECT document_id, chunk_index, CAST(coalesce(list_max(list_filter(range(30, 301), lambda n: n <= length(content) AND n <= length(before) AND right(before, n) = left(content, n))), 0) AS BIGINT) AS overlap FROM l",
    "topic_batches": f"""WITH RECURSIVE {CHUNK_SQL}, z AS (SELECT document_id, chunk_index, length(content) AS size FROM chunks),
      f AS (SELECT document_id, chunk_index, CAST(0 AS BIGINT) AS batch, 1 AS n, size FROM z WHERE chunk_index = 0 UNION ALL SELECT z.document_id, z.chunk_index, CASE WHEN f.n >= 4 OR f.size + z.size > 2500 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.n >= 4 OR f.size + z.size > 2500 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 4 OR f.size + z.size > 2500 THEN z.size ELSE f.size + z.size END
        FROM f JOIN z ON z.document_id = f.document_id AND z.chunk_index = f.chunk_index + 1) SELECT document_id, chunk_index, batch FROM f""",
    "chunk_listing": f"WITH {CHUNK_SQL} SELECT document_id, vector_id, chunk_index AS number FROM chunks",
    "source_listing": "SELECT source AS owner_id, doc_id AS document_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number FROM documents",
    "rank_merge": f"SELECT query_id, vec_id, rank FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), vec_id) AS rank FROM (SELECT query_id, vec_id, rank FROM ({retrieval.top_k_sql('len(embedding) = 64', 4)}) UNION ALL SELECT query_id, vec_id, rank FROM ({retrieval.top_k_sql('len(embedding) = 64 AND vec_id % 2 = 0', 4)})) GROUP BY 1, 2) WHERE rank <= 4",
    "quiz_status": f"WITH {adapters.ATTEMPTS_SQL} SELECT student_id, quiz_id, CASE WHEN bool_or(completed) THEN 'complete' ELSE 'partial' END AS status, max(CASE WHEN rn = 1 THEN attempt_id END) AS newest_attempt FROM (SELECT *, row_number() OVER (PARTITION BY student_id, quiz_id ORDER BY submitted_at DESC, attempt_id DESC) AS rn FROM attempts) GROUP BY 1, 2",
    "schema_stale_union": "SELECT k, c_nationkey % 3 AS version FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_custkey FROM orders WHERE o_totalprice > 300000 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0) JOIN customer ON k = c_custkey WHERE c_nationkey % 3 IS DISTINCT FROM 2",
    "agenda": f"WITH {SESSIONS} SELECT owner_id, CASE WHEN day < DATE '2024-01-15' THEN CASE WHEN status IN ('purchase', 'error') THEN 'done' ELSE 'overdue' END WHEN day = DATE '2024-01-15' THEN 'today' WHEN day <= DATE '2024-01-22' THEN 'upcoming' ELSE 'later' END AS bucket, count(*) AS sessions, CAST(sum(minutes) AS BIGINT) AS minutes FROM sessions GROUP BY 1, 2",
    "session_rejects": f"WITH {SESSIONS} SELECT * FROM (SELECT session_id, CASE WHEN minutes > 100 THEN 'too_long' WHEN minutes < 25 THEN 'too_short' WHEN s + minutes > 1440 THEN 'past_midnight' END AS code FROM sessions) WHERE code IS NOT NULL",
    "topic_progress": f"WITH {SESSIONS}, p AS (SELECT owner_id, CAST(least(coalesce(sum(minutes) FILTER (status = 'purchase'), 0), 600) AS BIGINT) AS completed FROM sessions GROUP BY 1) SELECT *, greatest(600 - completed, 0) AS remaining, 600 - completed <= 0 AS finished FROM p",
}
