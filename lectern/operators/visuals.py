"""Figures and scanned pages from tables of objects: first-seen suppression of near duplicates, page classes, lines of text boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lectern.functions.staging import cut
from lectern.sources.tables import table

# Bits by which near duplicates differ, pages that repeat an image, coverage and paths of scanned pages, tolerance of a line.
NEAR_BITS, REPEAT_PAGES, REPEAT_SHARE, SCAN_COVERAGE, SCAN_PATHS, LINE_SHARE = 6, 3, 0.3, 0.5, 400, 0.6
WORDS = 4


def first_seen(figures: DataFrame) -> DataFrame:
    """document_id, place, kept. In order of place a figure is kept if no figure kept before it differs in at most `NEAR_BITS` of its 256 bits (`fp`, four longs).

    Equal fingerprints stand and fall with their first. Near ones meet by one of eight 32-bit blocks, of which at least two are
    equal. The order is settled in rounds: a figure whose earlier neighbours are all dropped is kept, its later neighbours are
    dropped; a round settles at least one figure of each group, and mostly the whole group.
    """
    first = figures.groupBy("document_id", "fp").agg(F.min("place").alias("place"))
    blocks = F.array(*(F.struct(F.lit(2 * k + h).alias("n"), F.shiftrightunsigned(F.col("fp")[k], 32 * h).bitwiseAND(0xFFFFFFFF).alias("v")) for k in range(WORDS) for h in (0, 1)))
    keyed = first.select("document_id", "fp", "place", F.explode(blocks).alias("b"))
    side = lambda name: keyed.select("document_id", "b", F.col("place").alias(name), F.col("fp").alias(f"fp_{name}"))
    distance = reduce(Column.__add__, (F.bit_count(F.col("fp_a")[k].bitwiseXOR(F.col("fp_b")[k])) for k in range(WORDS)))
    near = side("a").join(side("b_"), ["document_id", "b"]).withColumnRenamed("fp_b_", "fp_b").where((F.col("a") < F.col("b_")) & (distance <= NEAR_BITS))
    open_edges = cut(near.select("document_id", F.col("a").alias("before"), F.col("b_").alias("place")).distinct())
    dropped = None
    while not open_edges.isEmpty():
        waiting = open_edges.select("document_id", "place").distinct()
        heads = open_edges.select("document_id", F.col("before").alias("place")).distinct().join(waiting, ["document_id", "place"], "left_anti")
        out = cut(open_edges.join(heads.withColumnRenamed("place", "before"), ["document_id", "before"], "left_semi").select("document_id", "place").distinct())
        dropped = out if dropped is None else dropped.union(out)
        open_edges = open_edges.join(out, ["document_id", "place"], "left_anti").join(out.withColumnRenamed("place", "before"), ["document_id", "before"], "left_anti")
        open_edges = cut(open_edges)
    kept = first if dropped is None else first.join(dropped, ["document_id", "place"], "left_anti")
    marks = kept.select("document_id", "place", F.lit(True).alias("kept"))
    return figures.select("document_id", "place").join(marks, ["document_id", "place"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def page_classes(pages: DataFrame, objects: DataFrame) -> DataFrame:
    """Whether a page is a picture of a page: its images, but for those repeated through the document, span half of it or more (coverage is in ten-thousandths), or it is drawn of many paths.

    pages: document_id, page, width, height; objects: document_id, page, kind (image or path), digest, x0, y0, x1, y1.
    """
    images = objects.where("kind = 'image'")
    total = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"))
    on = images.select("document_id", "page", "digest").distinct().groupBy("document_id", "digest").agg(F.count(F.lit(1)).alias("on"))
    repeated = on.join(total, "document_id").where(F.col("on") >= F.greatest(F.lit(float(REPEAT_PAGES)), F.lit(REPEAT_SHARE) * F.col("pages"))).select("document_id", "digest")
    boxes = images.join(repeated, ["document_id", "digest"], "left_anti").groupBy("document_id", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    paths = objects.where("kind = 'path'").groupBy("document_id", "page").agg(F.count(F.lit(1)).alias("paths"))
    rows = pages.join(boxes, ["document_id", "page"], "left").join(paths, ["document_id", "page"], "left")
    area = F.when((F.col("width") > 0) & (F.col("height") > 0), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("width") * F.col("height")))
    coverage = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(area, F.lit(0.0))))
    rows = rows.withColumn("coverage", F.floor(coverage * 10000)).withColumn("paths", F.coalesce("paths", F.lit(0)))
    return rows.select("document_id", "page", "coverage", "paths", ((coverage >= SCAN_COVERAGE) | (F.col("paths") >= SCAN_PATHS)).alias("scanned"))


def box_lines(boxes: DataFrame) -> DataFrame:
    """Text boxes (document_id, page, x0, y0, x1, y1, text) to lines from top to bottom, words from left to right. A box whose middle is lower than that of the one before by more than a share of the median height begins a line."""
    page = W.partitionBy("document_id", "page")
    rows = boxes.select("document_id", "page", ((F.col("y0") + F.col("y1")) / 2).alias("middle"), "x0", (F.col("y1") - F.col("y0")).alias("height"), "text")
    order = ["middle", "x0", "height", "text"]
    heights = F.sort_array(F.collect_list("height").over(page))
    rows = rows.withColumn("tolerance", F.greatest(F.lit(1.0), F.element_at(heights, (F.floor(F.size(heights) / 2) + 1).cast("int")) * LINE_SHARE))
    down = page.orderBy(*order)
    begins = F.coalesce(F.col("middle") - F.lag("middle").over(down) > F.col("tolerance"), F.lit(True))
    rows = rows.withColumn("begins", begins.cast("int")).withColumn("line_no", F.sum("begins").over(down.rowsBetween(W.unboundedPreceding, 0)) - 1)
    words = F.sort_array(F.collect_list(F.struct("x0", "middle", "height", "text")))
    return rows.groupBy("document_id", "page", "line_no").agg(F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("line"))


def _figures(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints from the signs of vectors, each beside versions of it with a few bits changed; scopes stand for documents."""
    bits = F.aggregate(F.transform("embedding", lambda x: (x > 0).cast("long")), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1) + b)
    v = table(spark, d, "embeddings").select(F.col("label").alias("document_id"), "vec_id", bits.alias("w"))
    copies = v.select("document_id", "vec_id", "w", F.explode(F.sequence(F.lit(0), (F.col("vec_id") % 4).cast("int"))).alias("c"))
    change = lambda k: F.call_function("shiftleft", F.lit(7).cast("long"), (F.col("c") * 5 + k).cast("int"))
    fp = F.array(F.col("w").bitwiseXOR(F.when(F.col("c") > 0, change(0)).otherwise(0)), F.col("w"), F.lit(0).cast("long"), F.col("w").bitwiseXOR(F.when(F.col("c") == 3, change(9)).otherwise(0)))
    return copies.select("document_id", (F.col("vec_id") * 4 + F.col("c")).alias("place"), fp.alias("fp"))


def _objects(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Line items stand for objects on the pages (orders) of a customer's document."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    pages = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("page"), F.lit(600.0).alias("width"), (F.lit(700.0) + F.col("o_orderkey") % 3 * 50).alias("height"))
    x, y = F.col("l_partkey") % 300, F.col("l_suppkey") % 10 * 30
    rows = li.select(F.col("l_orderkey").alias("page"), F.when(F.col("l_linenumber") <= 5, "image").otherwise("path").alias("kind"), (F.col("l_partkey") % 40).cast("string").alias("digest"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + F.col("l_quantity") * 10).cast("double").alias("x1"), (y + F.col("l_quantity") * 8).cast("double").alias("y1"))
    return pages, rows.join(pages.select("document_id", "page"), "page")


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_partkey") % 500, F.col("l_linenumber") * 9 + F.col("l_partkey") % 7
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("document_id"), F.col("l_orderkey").alias("page"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 40).cast("double").alias("x1"), (y + 8 + F.col("l_suppkey") % 7).cast("double").alias("y1"), F.concat("l_returnflag", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("text"))


QUERIES = {
    "kept_figures": lambda s, d: first_seen(_figures(s, d)),
    "scanned_pages": lambda s, d: page_classes(*_objects(s, d)),
    "box_lines": lambda s, d: box_lines(_boxes(s, d)),
}
ORACLES = {
    "scanned_pages": """WITH p AS (SELECT o_custkey AS document_id, o_orderkey AS page, 600.0 AS w, 700.0 + o_orderkey % 3 * 50 AS h FROM orders),
      o AS (SELECT document_id, page, l_linenumber <= 5 AS image, l_partkey % 40 AS digest, l_partkey % 300 AS x0, l_suppkey % 10 * 30 AS y0, l_partkey % 300 + l_quantity * 10 AS x1, l_suppkey % 10 * 30 + l_quantity * 8 AS y1 FROM lineitem JOIN p ON page = l_orderkey),
      t AS (SELECT document_id, count(*) AS n FROM p GROUP BY 1), r AS (SELECT document_id, digest FROM o JOIN t USING (document_id) WHERE image GROUP BY document_id, digest, n HAVING count(DISTINCT page) >= greatest(3.0, 0.3 * n)),
      b AS (SELECT document_id, page, (max(x1) - min(x0)) * (max(y1) - min(y0)) AS area FROM o WHERE image AND NOT EXISTS (SELECT 1 FROM r WHERE r.document_id = o.document_id AND r.digest = o.digest) GROUP BY 1, 2),
      q AS (SELECT document_id, page, count(*) AS paths FROM o WHERE NOT image GROUP BY 1, 2), c AS (SELECT p.document_id, p.page, CAST(least(1.0, greatest(0.0, coalesce(CAST(area AS DOUBLE) / CAST(w * h AS DOUBLE), 0.0))) AS DOUBLE) AS cov, coalesce(paths, 0) AS paths FROM p LEFT JOIN b USING (document_id, page) LEFT JOIN q USING (document_id, page))
      SELECT document_id, page, CAST(floor(cov * 10000) AS BIGINT) AS coverage, paths, cov >= 0.5 OR paths >= 400 AS scanned FROM c""",
    "box_lines": """WITH b AS (SELECT l_orderkey % 50 AS document_id, l_orderkey AS page, l_linenumber * 9 + l_partkey % 7 + (8 + l_suppkey % 7) / 2.0 AS middle, CAST(l_partkey % 500 AS DOUBLE) AS x0, 8 + l_suppkey % 7 AS height, l_returnflag || l_linenumber || l_partkey AS text FROM lineitem),
      h AS (SELECT document_id, page, greatest(1.0, list_sort(list(height))[len(list(height)) // 2 + 1] * 0.6) AS tolerance FROM b GROUP BY 1, 2), g AS (SELECT b.*, CASE WHEN middle - lag(middle) OVER w <= tolerance THEN 0 ELSE 1 END AS begins FROM b JOIN h USING (document_id, page) WINDOW w AS (PARTITION BY document_id, page ORDER BY middle, x0, height, text)),
      n AS (SELECT *, CAST(sum(begins) OVER (PARTITION BY document_id, page ORDER BY middle, x0, height, text ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS line_no FROM g) SELECT document_id, page, line_no, string_agg(text, ' ' ORDER BY x0, middle, height, text) AS line FROM n GROUP BY 1, 2, 3""",
}
