"""Records of documents, plans and answers: ownership, references, refresh checks, grading, goals and horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import corpus, learning
from lectern.sources import adapters as A
from lectern.sources.tables import table

# Days planned without deadlines, and at most.
DEFAULT_DAYS, MOST_DAYS = 14, 42
TODAY = "1998-06-01"


def owner_ids(chunks: DataFrame, legacy: str) -> DataFrame:
    """Chunk ids with their owner before them; the legacy owner keeps bare ids."""
    return chunks.select("owner_id", "document_id", F.when(F.col("owner_id") == legacy, F.col("vector_id")).otherwise(F.concat_ws("_", "owner_id", "vector_id")).alias("vector_id"))


def kept_pages(docs: DataFrame) -> DataFrame:
    """Pages (parts between blank lines) that are not blank, numbered as they stand."""
    pages = docs.select("owner_id", "document_id", F.posexplode(F.split("content", "\n\n", -1)).alias("page", "content"))
    return pages.where(F.trim(F.translate("content", "\t\n\r\x0b\x0c", "     ")) != "").select("owner_id", "document_id", F.col("page").cast("long").alias("page"), F.length("content").cast("long").alias("chars"))


def refresh_eligible(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Whether the stored chunks of a document are those of a fresh split, ids and texts; else it is indexed anew."""
    a = stored.select("owner_id", "document_id", "vector_id", F.col("content").alias("old"))
    b = fresh.select("owner_id", "document_id", "vector_id", F.col("content").alias("new"))
    rows = a.join(b, ["owner_id", "document_id", "vector_id"], "full_outer")
    return rows.groupBy("owner_id", "document_id").agg(F.when(F.bool_and(F.coalesce(F.col("old") == F.col("new"), F.lit(False))), "refresh").otherwise("reindex").alias("route"))


def with_owner(rows: DataFrame, legacy: str) -> DataFrame:
    """Rows without an owner go to the legacy one; without a document id the source stands for it."""
    return rows.select(F.coalesce("owner_id", F.lit(legacy)).alias("owner_id"), F.coalesce(F.col("document_id").cast("string"), "source").alias("document_id"))


def vanished(known: DataFrame, chunks: DataFrame) -> DataFrame:
    """Registered documents that have no chunk left."""
    return known.select("owner_id", "document_id").join(chunks, ["owner_id", "document_id"], "left_anti")


def unreferenced(objects: DataFrame, known: DataFrame) -> DataFrame:
    """Stored objects that no registry row names."""
    return objects.join(known.select("owner_id", "object_path"), ["owner_id", "object_path"], "left_anti")


def merged_pages(pages: DataFrame, recovered: DataFrame) -> DataFrame:
    """Recovered text takes the place of a page's text layer where it is longer; pages without a text layer are added. Pages keep their numbers."""
    rows = pages.join(recovered, ["document_id", "page"], "full_outer")
    layer, found = F.coalesce("content", F.lit("")), F.coalesce("recovered", F.lit(""))
    longer = F.length(found) > F.length(layer)
    rows = rows.where(F.col("content").isNotNull() | longer)
    return rows.select("document_id", "page", longer.alias("replaced"), F.sha2(F.when(longer, found).otherwise(layer), 256).alias("page_hash"))


def majority_language(cards: DataFrame) -> DataFrame:
    """A set keeps the cards of its commonest language, and those without one; ties go to the first by name."""
    votes = cards.where("lang IS NOT NULL").groupBy("owner_id", "lang").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("owner_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang")).alias("best")).select("owner_id", F.col("best.lang").alias("majority"))
    return cards.join(best, "owner_id", "left").where("lang IS NULL OR lang = majority").select("owner_id", "document_id", "lang")


def busy(sessions: DataFrame, plans: DataFrame) -> DataFrame:
    """Sessions that take time: under way or done, or scheduled while their own plan is active."""
    rows = sessions.join(plans, ["owner_id", "plan_id"])
    return rows.where("status IN ('in_progress', 'completed') OR (status = 'scheduled' AND plan_status = 'active')").select("owner_id", "plan_id", "session_id", "status")


def horizon(materials: DataFrame, today: str = TODAY) -> DataFrame:
    """The last day to plan for: the day before the last deadline, or the default where a material has none; never beyond the most."""
    now = F.to_date(F.lit(today))
    g = materials.groupBy("owner_id").agg(F.max("deadline").alias("last"), F.bool_or(F.col("deadline").isNull()).alias("open"))
    default = F.date_add(now, DEFAULT_DAYS)
    dated = F.greatest(F.date_sub("last", 1), now)
    end = F.when(F.col("last").isNull(), default).when(F.col("open"), F.greatest(dated, default)).otherwise(dated)
    return g.select("owner_id", F.least(end, F.date_add(now, MOST_DAYS)).alias("horizon_end"))


def goal_faults(goals: DataFrame) -> DataFrame:
    """Goals that break a rule, with the first one broken."""
    fault = (F.when(~F.col("goal_type").isin("deadline", "flexible"), "unknown_type").when((F.col("goal_type") == "deadline") & F.col("deadline").isNull(), "deadline_missing")
        .when((F.col("goal_type") == "flexible") & F.col("deadline").isNotNull(), "deadline_not_allowed").when(F.col("target_date") > F.col("deadline"), "target_after_deadline"))
    return goals.withColumn("fault", fault).where("fault IS NOT NULL").select("goal_id", "fault")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return corpus.documents(s, d)


def _refresh(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    stored = docs.withColumn("content", F.when(F.col("document_id") % 4 == 0, F.concat("content", F.lit(" old"))).otherwise(F.col("content")))
    bare = lambda x: corpus.fixed_chunks(x).withColumn("vector_id", F.concat_ws("_", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")))
    return refresh_eligible(bare(stored), bare(docs))


def _merged(s: SparkSession, d: str) -> DataFrame:
    """Two pages a document: some have no text layer, some no recovered text, some neither."""
    docs = _docs(s, d).select("document_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("page"), F.coalesce("content", F.lit("")).alias("content"))
    n = F.col("document_id") + F.col("page")
    layer = docs.where(n % 3 != 1).withColumn("content", F.substring(F.col("content"), 1, 300))
    return merged_pages(layer, docs.where(n % 5 != 2).select("document_id", "page", F.when(n % 7 == 0, "").otherwise(F.regexp_replace("content", "[ \t]+", " ")).alias("recovered")))


def _newest(s: SparkSession, d: str) -> DataFrame:
    answers = table(s, d, "lineitem").select(F.col("l_orderkey").alias("attempt_id"), F.pmod("l_partkey", F.lit(7)).alias("topic_id"), F.when(F.col("l_suppkey") % 5 != 0, (F.col("l_suppkey") % 5).cast("string")).alias("concept_plan_id"))
    kept = learning.newest_plan(answers.join(A.attempts(s, d), "attempt_id"))
    return kept.groupBy("student_id", "document_id", "topic_id").agg(F.max("concept_plan_id").alias("plan"), F.count(F.lit(1)).alias("answers"))


def _busy(s: SparkSession, d: str) -> DataFrame:
    """A customer's orders of one priority are the sessions of one plan; every third plan is active."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("owner_id"), F.substring("o_orderpriority", 1, 1).alias("plan_id"), F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderstatus") == "O", "scheduled").when(F.col("o_orderstatus") == "F", "completed").otherwise("in_progress").alias("status"))
    plans = table(s, d, "customer").select(F.col("c_custkey").alias("owner_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n"))
    return busy(o, plans.select("owner_id", F.col("n").cast("string").alias("plan_id"), F.when((F.col("owner_id") + F.col("n")) % 3 == 0, "active").otherwise("paused").alias("plan_status")))


def _materials(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_custkey").alias("owner_id"), F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("deadline"))


def _goals(s: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("goal_id"), F.when(F.col("o_orderstatus") == "O", "deadline").when(F.col("o_orderstatus") == "F", "flexible").alias("goal_type"),
        F.when(F.col("o_orderpriority") < "4", day).alias("deadline"), F.date_add(day, (F.pmod("o_custkey", F.lit(5)) - 2).cast("int")).alias("target_date"))


LEGACY = "web"
DOCS_SQL, CHUNKS_SQL = corpus.DOCS_SQL, corpus.CHUNKS_SQL
QUERIES = {
    "owner_chunk_ids": lambda s, d: owner_ids(corpus.fixed_chunks(_docs(s, d)), LEGACY),
    "kept_pages": lambda s, d: kept_pages(_docs(s, d)),
    "refresh_eligible": _refresh,
    "ownership_backfill": lambda s, d: with_owner(table(s, d, "documents").select(F.when(F.col("lang") != "en", F.col("source")).alias("owner_id"), F.when(F.col("n_chars") > 100, F.col("doc_id")).alias("document_id"), "source"), LEGACY),
    "vanished_documents": lambda s, d: vanished(_docs(s, d), corpus.fixed_chunks(_docs(s, d).where("length(content) > 200")).select("owner_id", "document_id")),
    "unreferenced_objects": lambda s, d: unreferenced(_docs(s, d).select("owner_id", F.concat_ws("/", "owner_id", F.col("document_id").cast("string")).alias("object_path")), table(s, d, "documents").where("lang = 'en'").select(F.col("source").alias("owner_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("object_path"))),
    "recovered_pages": _merged,
    "majority_language": lambda s, d: majority_language(table(s, d, "documents").select(F.col("source").alias("owner_id"), F.col("doc_id").alias("document_id"), F.when(F.col("n_chars") > 100, F.col("lang")).alias("lang"))),
    "newest_plan": _newest,
    "busy_sessions": _busy,
    "plan_horizon": lambda s, d: horizon(_materials(s, d)),
    "goal_faults": lambda s, d: goal_faults(_goals(s, d)),
}
ORACLES = {
    "owner_chunk_ids": f"WITH {DOCS_SQL}, c AS ({CHUNKS_SQL.format('docs')}) SELECT owner_id, document_id, CASE WHEN owner_id = 'web' THEN vector_id ELSE owner_id || '_' || vector_id END AS vector_id FROM c",
    "kept_pages": f"WITH {DOCS_SQL}, p AS (SELECT owner_id, document_id, string_split(content, chr(10) || chr(10)) AS l FROM docs), e AS (SELECT owner_id, document_id, unnest(range(len(l))) AS page, unnest(l) AS content FROM p) SELECT owner_id, document_id, page, length(content) AS chars FROM e WHERE trim(content, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) <> ''",
    "refresh_eligible": f"""WITH {DOCS_SQL}, olds AS (SELECT owner_id, document_id, CASE WHEN document_id % 4 = 0 THEN content || ' old' ELSE content END AS content FROM docs), a AS ({CHUNKS_SQL.format('olds')}), b AS ({CHUNKS_SQL.format('docs')})
      SELECT owner_id, document_id, CASE WHEN bool_and(coalesce(a.content = b.content, false)) THEN 'refresh' ELSE 'reindex' END AS route FROM a FULL OUTER JOIN b USING (owner_id, document_id, chunk_index) GROUP BY 1, 2""",
    "ownership_backfill": "SELECT coalesce(CASE WHEN lang <> 'en' THEN source END, 'web') AS owner_id, coalesce(CASE WHEN n_chars > 100 THEN CAST(doc_id AS VARCHAR) END, source) AS document_id FROM documents",
    "vanished_documents": "SELECT source AS owner_id, doc_id AS document_id FROM documents WHERE coalesce(length(text), 0) <= 200",
    "unreferenced_objects": "SELECT source AS owner_id, source || '/' || doc_id AS object_path FROM documents WHERE NOT EXISTS (SELECT 1 FROM documents k WHERE k.lang = 'en' AND k.source = documents.source AND k.doc_id = documents.doc_id)",
    "recovered_pages": """WITH p AS (SELECT doc_id AS document_id, unnest([0, 1]) AS page, coalesce(text, '') AS t FROM documents), l AS (SELECT document_id, page, substring(t, 1, 300) AS c FROM p WHERE (document_id + page) % 3 <> 1),
      r AS (SELECT document_id, page, CASE WHEN (document_id + page) % 7 = 0 THEN '' ELSE regexp_replace(t, '[ \\t]+', ' ', 'g') END AS r FROM p WHERE (document_id + page) % 5 <> 2),
      j AS (SELECT document_id, page, c, coalesce(c, '') AS a, coalesce(r, '') AS b FROM l FULL OUTER JOIN r USING (document_id, page)) SELECT document_id, page, length(b) > length(a) AS replaced, sha256(CASE WHEN length(b) > length(a) THEN b ELSE a END) AS page_hash FROM j WHERE c IS NOT NULL OR length(b) > length(a)""",
    "majority_language": """WITH c AS (SELECT source AS owner_id, doc_id AS document_id, CASE WHEN n_chars > 100 THEN lang END AS lang FROM documents), v AS (SELECT owner_id, lang, row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, lang) AS rn FROM c WHERE lang IS NOT NULL GROUP BY 1, 2)
      SELECT c.* FROM c LEFT JOIN v ON v.owner_id = c.owner_id AND rn = 1 WHERE c.lang IS NULL OR c.lang = v.lang""",
    "newest_plan": f"""WITH {A.ATTEMPTS_SQL}, a AS (SELECT t.*, l_partkey % 7 AS topic_id, CASE WHEN l_suppkey % 5 <> 0 THEN CAST(l_suppkey % 5 AS VARCHAR) END AS plan FROM lineitem JOIN attempts t ON attempt_id = l_orderkey),
      n AS (SELECT student_id, document_id, topic_id, plan AS newest FROM (SELECT *, row_number() OVER (PARTITION BY student_id, document_id, topic_id ORDER BY submitted_at DESC, attempt_id DESC, plan DESC) AS rn FROM a WHERE plan IS NOT NULL) WHERE rn = 1)
      SELECT student_id, document_id, topic_id, max(plan) AS plan, count(*) AS answers FROM a LEFT JOIN n USING (student_id, document_id, topic_id) WHERE newest IS NULL OR plan = newest GROUP BY 1, 2, 3""",
    "busy_sessions": "SELECT o_custkey AS owner_id, left(o_orderpriority, 1) AS plan_id, o_orderkey AS session_id, CASE o_orderstatus WHEN 'O' THEN 'scheduled' WHEN 'F' THEN 'completed' ELSE 'in_progress' END AS status FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'O' OR (o_custkey + CAST(left(o_orderpriority, 1) AS INT)) % 3 = 0",
    "plan_horizon": f"""WITH g AS (SELECT o_custkey AS owner_id, max(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END) AS last, bool_or(o_orderstatus = 'P') AS open FROM orders GROUP BY 1)
      SELECT owner_id, CAST(least(CASE WHEN last IS NULL THEN DATE '{TODAY}' + 14 WHEN open THEN greatest(last - 1, DATE '{TODAY}', DATE '{TODAY}' + 14) ELSE greatest(last - 1, DATE '{TODAY}') END, DATE '{TODAY}' + 42) AS DATE) AS horizon_end FROM g""",
    "goal_faults": """WITH g AS (SELECT o_orderkey AS goal_id, CASE o_orderstatus WHEN 'O' THEN 'deadline' WHEN 'F' THEN 'flexible' END AS kind, CASE WHEN o_orderpriority < '4' THEN CAST(o_orderdate AS DATE) END AS deadline, CAST(o_orderdate AS DATE) + CAST(o_custkey % 5 - 2 AS INT) AS target FROM orders),
      f AS (SELECT goal_id, CASE WHEN kind = 'deadline' AND deadline IS NULL THEN 'deadline_missing' WHEN kind = 'flexible' AND deadline IS NOT NULL THEN 'deadline_not_allowed' WHEN target > deadline THEN 'target_after_deadline' END AS fault FROM g) SELECT * FROM f WHERE fault IS NOT NULL""",
}
