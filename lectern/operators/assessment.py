"""Assessment building: vocabulary, distractors, selection and ordering of items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lectern.sources.tables import table


def cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards from parts: the name on the front, the type on the back, the brand as the topic."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("card_id"), F.col("p_name").alias("front"), F.col("p_type").alias("back"), F.col("p_brand").alias("topic_id"), F.col("p_size").cast("long").alias("size"))


def interleave(items: DataFrame, kind: str, key: str) -> DataFrame:
    """Items of n of a kind stand at (k + 0.5) / n, so every kind spreads over the whole list of its topic."""
    own = W.partitionBy("topic_id", kind)
    place = (F.row_number().over(own.orderBy(key)) - 0.5) / F.count(F.lit(1)).over(own)
    ordered = W.partitionBy("topic_id").orderBy("place", kind, key)
    return items.withColumn("place", place).select("topic_id", key, kind, F.row_number().over(ordered).cast("long").alias("position"))


def round_robin(items: DataFrame, group: str, key: str) -> DataFrame:
    """The first of each group, then the second of each; groups by their first key. Ranks stay within `part`, a split of the items."""
    own = W.partitionBy("part", group).orderBy(key)
    rows = items.withColumn("turn", F.row_number().over(own)).withColumn("first", F.min(key).over(W.partitionBy("part", group)))
    return rows.select("part", group, key, F.row_number().over(W.partitionBy("part").orderBy("turn", "first", key)).cast("long").alias("position"))


def duplicate_keys(items: DataFrame, text: str, key: str) -> DataFrame:
    """E18 (its key form): items whose letters and digits are those of an earlier item."""
    norm = F.lower(F.regexp_replace(F.col(text), "[^A-Za-z0-9]+", ""))
    rows = items.select(F.col(key).alias("item"), norm.alias("norm"))
    first = rows.groupBy("norm").agg(F.min("item").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return rows.join(first, "norm").where("item <> first").select("item", "first", "copies")


def vocabulary(rows: DataFrame, text: str) -> DataFrame:
    """Words with their counts and the form met most often, ties to the smallest form."""
    words = rows.select(F.explode(F.split(F.col(text), "[^A-Za-z0-9]+")).alias("form")).where(F.length("form") >= 3)
    forms = words.groupBy(F.lower("form").alias("word"), "form").agg(F.count(F.lit(1)).alias("n"))
    return forms.groupBy("word").agg(F.sum("n").alias("count"), F.min_by("form", F.struct(-F.col("n"), F.col("form"))).alias("preferred"))


def distractors(items: DataFrame, k: int = 3) -> DataFrame:
    """For each card the k other backs of its topic that are closest in length, distinct, ties by text. A topic's distinct backs are few, so the join is by topic and back, not by pairs of cards."""
    backs = items.select("topic_id", F.col("back").alias("other")).distinct()
    own = items.select("topic_id", "back").distinct()
    near = own.join(backs, "topic_id").where("back <> other").withColumn("gap", F.abs(F.length("back") - F.length("other")))
    order = W.partitionBy("topic_id", "back").orderBy("gap", "other")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("topic_id", "back").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]), "|").alias("choices"))
    return items.join(best, ["topic_id", "back"]).select("card_id", "topic_id", "choices")


def canonical_options(rows: DataFrame, option: str) -> DataFrame:
    """One given label is stripped and the canonical letter put before."""
    bare = F.regexp_replace(F.trim(F.col(option)), r"^[A-Da-d][.):]\s+", "")
    letter = F.substring(F.lit("ABCD"), F.pmod(F.col("card_id"), F.lit(4)).cast("int") + 1, F.lit(1))
    return rows.select("card_id", F.concat(letter, F.lit(". "), bare).alias("option"))


def select_best(rows: DataFrame, n: int = 5) -> DataFrame:
    """The n best of each topic by size, ties by id, returned in document order."""
    best = rows.withColumn("rank", F.row_number().over(W.partitionBy("topic_id").orderBy(F.desc("size"), "card_id"))).where(F.col("rank") <= n)
    return best.select("topic_id", "card_id", "size", F.row_number().over(W.partitionBy("topic_id").orderBy("card_id")).cast("long").alias("position"))


def rejections(rows: DataFrame) -> DataFrame:
    """Rule checks on the fronts and how many of each topic fail each; the first failing rule counts."""
    t = F.col("front")
    code = F.when(F.length(t) < 8, "too_short").when(F.size(F.split(t, " ")) < 2, "one_word").when(F.col("size") > 45, "too_large").otherwise("accepted")
    return rows.withColumn("code", code).groupBy("topic_id").pivot("code", ["too_short", "one_word", "too_large", "accepted"]).agg(F.count(F.lit(1))).na.fill(0)


def versions(rows: DataFrame) -> DataFrame:
    """Number each owner's artifacts of a document in time order, and mark the newest."""
    own = W.partitionBy("owner_id", "document_id")
    return rows.withColumn("version", F.row_number().over(own.orderBy("created_at", "artifact_id")).cast("long")).withColumn("newest", F.col("version") == F.count(F.lit(1)).over(own)).select("artifact_id", "owner_id", "document_id", "version", "newest")


def _artifacts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("artifact_id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderpriority").alias("document_id"), F.col("o_orderdate").alias("created_at"))


CARDS_SQL = "cards AS (SELECT p_partkey AS card_id, p_name AS front, p_type AS back, p_brand AS topic_id, CAST(p_size AS BIGINT) AS size FROM part)"
QUERIES = {
    "type_interleave": lambda s, d: interleave(cards(s, d), "back", "card_id"),
    "round_robin": lambda s, d: round_robin(cards(s, d).withColumn("part", F.col("back")), "topic_id", "card_id"),
    "duplicate_keys": lambda s, d: duplicate_keys(cards(s, d).withColumn("q", F.concat("front", "topic_id")), "front", "card_id"),
    "keyword_vocabulary": lambda s, d: vocabulary(table(s, d, "documents"), "text"),
    "card_choice": lambda s, d: distractors(cards(s, d)),
    "canonical_options": lambda s, d: canonical_options(cards(s, d), "back"),
    "select_best": lambda s, d: select_best(cards(s, d)),
    "rejection_counts": lambda s, d: rejections(cards(s, d)),
    "artifact_versions": lambda s, d: versions(_artifacts(s, d)),
}
ORACLES = {
    "type_interleave": f"WITH {CARDS_SQL} SELECT topic_id, card_id, back, row_number() OVER (PARTITION BY topic_id ORDER BY place, back, card_id) AS position FROM (SELECT *, (row_number() OVER (PARTITION BY topic_id, back ORDER BY card_id) - CAST(0.5 AS DOUBLE)) / count(*) OVER (PARTITION BY topic_id, back) AS place FROM cards)",
    "round_robin": f"WITH {CARDS_SQL} SELECT back AS part, topic_id, card_id, row_number() OVER (PARTITION BY back ORDER BY turn, first, card_id) AS position FROM (SELECT *, row_number() OVER (PARTITION BY back, topic_id ORDER BY card_id) AS turn, min(card_id) OVER (PARTITION BY back, topic_id) AS first FROM cards)",
    "duplicate_keys": f"WITH {CARDS_SQL}, n AS (SELECT card_id AS item, lower(regexp_replace(front, '[^A-Za-z0-9]+', '', 'g')) AS norm FROM cards), f AS (SELECT norm, min(item) AS first, count(*) AS copies FROM n GROUP BY 1 HAVING count(*) > 1) SELECT item, first, copies FROM n JOIN f USING (norm) WHERE item <> first",
    "keyword_vocabulary": "WITH w AS (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z0-9]+')) AS form FROM documents), f AS (SELECT lower(form) AS word, form, count(*) AS n FROM w WHERE length(form) >= 3 GROUP BY 1, 2) SELECT word, CAST(sum(n) AS BIGINT) AS count, arg_max(form, (n, -rk)) AS preferred FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY form COLLATE C) AS rk FROM f) GROUP BY 1",
    "card_choice": f"""WITH {CARDS_SQL}, b AS (SELECT DISTINCT topic_id, back FROM cards), r AS (SELECT b.topic_id, b.back, o.back AS other, row_number() OVER (PARTITION BY b.topic_id, b.back ORDER BY abs(length(b.back) - length(o.back)), o.back) AS rank FROM b JOIN b o ON b.topic_id = o.topic_id AND b.back <> o.back),
      best AS (SELECT topic_id, back, string_agg(other, '|' ORDER BY rank) AS choices FROM r WHERE rank <= 3 GROUP BY 1, 2) SELECT card_id, topic_id, choices FROM cards JOIN best USING (topic_id, back)""",
    "canonical_options": f"WITH {CARDS_SQL} SELECT card_id, substring('ABCD', CAST(card_id % 4 AS INT) + 1, 1) || '. ' || regexp_replace(trim(back), '^[A-Da-d][.):]\\s+', '') AS option FROM cards",
    "select_best": f"WITH {CARDS_SQL} SELECT topic_id, card_id, size, row_number() OVER (PARTITION BY topic_id ORDER BY card_id) AS position FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY size DESC, card_id) AS rank FROM cards) WHERE rank <= 5",
    "rejection_counts": f"""WITH {CARDS_SQL}, c AS (SELECT topic_id, CASE WHEN length(front) < 8 THEN 'too_short' WHEN len(string_split(front, ' ')) < 2 THEN 'one_word' WHEN size > 45 THEN 'too_large' ELSE 'accepted' END AS code FROM cards)
      SELECT topic_id, count(*) FILTER (code = 'too_short') AS too_short, count(*) FILTER (code = 'one_word') AS one_word, count(*) FILTER (code = 'too_large') AS too_large, count(*) FILTER (code = 'accepted') AS accepted FROM c GROUP BY 1""",
    "artifact_versions": "SELECT artifact_id, owner_id, document_id, version, version = count(*) OVER (PARTITION BY owner_id, document_id) AS newest FROM (SELECT o_orderkey AS artifact_id, o_custkey AS owner_id, o_orderpriority AS document_id, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS version FROM orders)",
}
