"""Incremental corpus indexing: fingerprints, chunks, status and cleaning of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.tables import table

# Chunk size and overlap, and the limits of repeated lines and overlaps.
CHUNK, OVERLAP, LINE_CHARS, LINE_SHARE, LINE_LEAST = 800, 150, 120, 0.2, 3


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("owner_id"), F.col("doc_id").alias("document_id"), F.col("text").alias("content"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Hash of the content, and its visible length."""
    return docs.select("owner_id", "document_id", F.sha2("content", 256).alias("file_hash"), F.length(F.translate("content", " \t\n\r\x0b\x0c", "")).cast("long").alias("visible"))


def layout(docs: DataFrame) -> DataFrame:
    """Spaces and tabs collapsed in each line, empty lines dropped."""
    lines = F.filter(F.transform(F.split("content", "\n", -1), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " "))), lambda x: x != "")
    return docs.select("document_id", F.size(lines).cast("long").alias("lines"), F.sha2(F.array_join(lines, "\n"), 256).alias("layout_hash"))


def registry(docs: DataFrame) -> DataFrame:
    """A registry as it was before: every third document is missing, every fifth has another hash."""
    old = fingerprints(docs).where("document_id % 3 <> 0")
    return old.select("owner_id", "document_id", F.when(F.col("document_id") % 5 == 0, F.lit("old")).otherwise(F.col("file_hash")).alias("known_hash"), F.when(F.col("document_id") % 7 == 0, 1).otherwise(2).alias("topic_schema_version"))


def incremental_status(incoming: DataFrame, known: DataFrame, schema_version: int = 2) -> DataFrame:
    """What to do with each incoming document."""
    rows = incoming.join(known, ["owner_id", "document_id"], "left")
    status = F.when(F.col("visible") == 0, "empty").when(F.col("known_hash").isNull(), "indexed").when(F.col("known_hash") != F.col("file_hash"), "reindexed").when(F.col("topic_schema_version") < schema_version, "topic_refreshed").otherwise("skipped")
    return rows.select("owner_id", "document_id", status.alias("status"))


def fixed_chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Windows of `size` characters, each starting `overlap` before the last one's end; ids by hash and number (A06's plain form, A07)."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length("content") - overlap) / step), F.lit(1)).cast("int")
    # Pieces are cut before they are spread, so that no chunk carries the whole content.
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(F.col("content"), k * step + 1, F.lit(size)))
    rows = docs.select("owner_id", "document_id", F.sha2("content", 256).alias("file_hash"), F.posexplode(pieces).alias("chunk_index", "content"))
    text = F.col("content")
    return rows.select("owner_id", "document_id", F.concat_ws("_", "file_hash", F.col("chunk_index").cast("string")).alias("vector_id"), F.col("chunk_index").cast("long").alias("chunk_index"), (F.col("chunk_index") * step).cast("long").alias("start_index"), text.alias("content"))


def chunk_ids(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The ids of the chunks that `fixed_chunks` makes, without cutting any text."""
    n = F.greatest(F.ceil((F.length("content") - overlap) / (size - overlap)), F.lit(1)).cast("int")
    rows = docs.select("owner_id", "document_id", F.sha2("content", 256).alias("file_hash"), n.alias("n"))
    return rows.select("owner_id", "document_id", "file_hash", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).select("owner_id", "document_id", F.concat_ws("_", "file_hash", F.col("k").cast("string")).alias("vector_id"))


def stale_chunks(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored chunk ids that a document no longer has."""
    return stored.join(current, ["owner_id", "document_id", "vector_id"], "left_anti")


def repeated_lines(docs: DataFrame, share: float = LINE_SHARE) -> DataFrame:
    """Short lines found in at least three and a share (a fifth, unless said otherwise) of an owner's documents."""
    lines = docs.select("owner_id", "document_id", F.explode(F.split("content", "\n", -1)).alias("line")).withColumn("line", F.trim("line")).where((F.length("line") > 0) & (F.length("line") <= LINE_CHARS)).distinct()
    total = docs.groupBy("owner_id").agg(F.countDistinct("document_id").alias("documents"))
    found = lines.groupBy("owner_id", "line").agg(F.count(F.lit(1)).alias("in_documents"))
    return found.join(total, "owner_id").where(F.col("in_documents") >= F.greatest(F.lit(LINE_LEAST), F.ceil(F.col("documents") * share))).select("owner_id", "line", "in_documents")


def text_flags(docs: DataFrame) -> DataFrame:
    """Signs of unsafe or raw text."""
    t = F.col("content")
    return docs.select("document_id", t.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}").alias("has_email"), t.rlike(r"(?i)https?://").alias("has_url"), (F.size(F.split(F.trim(t), r"\s+")) > 60).alias("over_long"), F.lower(t).contains("licensed under").alias("has_notice"))


def language_share(docs: DataFrame) -> DataFrame:
    """Share of letters that belong to one language alone, by document."""
    letters = F.length(F.regexp_replace("content", "[^A-Za-zÀ-ÖØ-öø-ÿ]", ""))
    special = F.length(F.regexp_replace("content", "[^éèêàçùâîôûëïÉÈÊÀÇ]", ""))
    german = F.length(F.regexp_replace("content", "[^äöüßÄÖÜ]", ""))
    return docs.select("document_id", letters.cast("long").alias("letters"), F.when(letters < 12, None).when(20 * special >= letters, "fr").when(20 * german >= letters, "de").otherwise("other").alias("language"))


def _status(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return incremental_status(fingerprints(docs), registry(docs))


def _stale(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    stored = chunk_ids(docs)
    shorter = docs.withColumn("content", F.when(F.col("document_id") % 4 == 0, F.substring("content", 1, 1000)).otherwise(F.col("content")))
    return stale_chunks(stored, chunk_ids(shorter))


VISIBLE = "length(translate(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12), ''))"
CHUNKS_SQL = """SELECT owner_id, document_id, sha256(content) || '_' || k AS vector_id, k AS chunk_index, k * 650 AS start_index, substring(content, k * 650 + 1, 800) AS content
  FROM (SELECT *, unnest(range(CAST(greatest(ceil((length(content) - 150) / 650.0), 1) AS BIGINT))) AS k FROM {})"""
DOCS_SQL = "docs AS (SELECT source AS owner_id, doc_id AS document_id, text AS content FROM documents)"
QUERIES = {
    "doc_fingerprint": lambda s, d: fingerprints(documents(s, d)),
    "layout_normalised": lambda s, d: layout(documents(s, d)),
    "incremental_status": _status,
    "fixed_chunks": lambda s, d: fixed_chunks(documents(s, d)),
    "stale_chunks": _stale,
    "repeated_lines": lambda s, d: repeated_lines(documents(s, d), 0.05),  # owners here are sources of unlike documents
    "text_flags": lambda s, d: text_flags(documents(s, d)),
    "language_share": lambda s, d: language_share(documents(s, d)),
}
ORACLES = {
    "doc_fingerprint": f"SELECT source AS owner_id, doc_id AS document_id, sha256(text) AS file_hash, {VISIBLE} AS visible FROM documents",
    "layout_normalised": "SELECT document_id, len(l) AS lines, sha256(array_to_string(l, chr(10))) AS layout_hash FROM (SELECT doc_id AS document_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ')), lambda x: x <> '') AS l FROM documents)",
    "incremental_status": f"""WITH i AS (SELECT source AS owner_id, doc_id AS document_id, sha256(text) AS file_hash, {VISIBLE} AS visible FROM documents), k AS (SELECT owner_id, document_id, CASE WHEN document_id % 5 = 0 THEN 'old' ELSE file_hash END AS known_hash, CASE WHEN document_id % 7 = 0 THEN 1 ELSE 2 END AS v FROM i WHERE document_id % 3 <> 0)
      SELECT owner_id, document_id, CASE WHEN visible = 0 THEN 'empty' WHEN known_hash IS NULL THEN 'indexed' WHEN known_hash <> file_hash THEN 'reindexed' WHEN v < 2 THEN 'topic_refreshed' ELSE 'skipped' END AS status FROM i LEFT JOIN k USING (owner_id, document_id)""",
    "fixed_chunks": f"WITH {DOCS_SQL} {CHUNKS_SQL.format('docs')}",
    "stale_chunks": f"WITH {DOCS_SQL}, shorter AS (SELECT owner_id, document_id, CASE WHEN document_id % 4 = 0 THEN substring(content, 1, 1000) ELSE content END AS content FROM docs), a AS ({CHUNKS_SQL.format('docs')}), b AS ({CHUNKS_SQL.format('shorter')}) SELECT owner_id, document_id, vector_id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.owner_id = b.owner_id AND a.document_id = b.document_id AND a.vector_id = b.vector_id)",
    "repeated_lines": """WITH l AS (SELECT DISTINCT source AS owner_id, doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents), n AS (SELECT source AS owner_id, count(DISTINCT doc_id) AS documents FROM documents GROUP BY 1),
      f AS (SELECT owner_id, line, count(*) AS in_documents FROM l WHERE length(line) BETWEEN 1 AND 120 GROUP BY 1, 2) SELECT owner_id, line, in_documents FROM f JOIN n USING (owner_id) WHERE in_documents >= greatest(3, ceil(documents * CAST(0.05 AS DOUBLE)))""",
    "text_flags": r"SELECT doc_id AS document_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}') AS has_email, regexp_matches(text, '(?i)https?://') AS has_url, len(regexp_split_to_array(trim(text), '\s+')) > 60 AS over_long, contains(lower(text), 'licensed under') AS has_notice FROM documents",
    "language_share": "SELECT document_id, letters, CASE WHEN letters < 12 THEN NULL WHEN 20 * fr >= letters THEN 'fr' WHEN 20 * de >= letters THEN 'de' ELSE 'other' END AS language FROM (SELECT doc_id AS document_id, length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')) AS letters, length(regexp_replace(text, '[^éèêàçùâîôûëïÉÈÊÀÇ]', '', 'g')) AS fr, length(regexp_replace(text, '[^äöüßÄÖÜ]', '', 'g')) AS de FROM documents)",
}
