"""Where a quote stands in a document's excerpts: shared shingles find a short list, an ordered alignment decides.

Quotes and excerpts are compared squashed (letters and digits, without case and accents). An excerpt meets the quotes of its
document once, in one row, and leaves only the numbers of the shingles that it shares with each; ranks, short lists and neighbours
are worked out on those. Texts move a second time for short-listed excerpts of quotes that none holds as they stand. Quotes that no
excerpt holds are looked for in neighbouring excerpts read as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lectern.functions.staging import cut
from lectern.functions.text import squash
from lectern.operators import corpus

# Least length of a quote, shingles, the short list, runs of an alignment.
QUOTE_CHARS, SHINGLE, SHORT_LIST, LEAST_SHARED = 20, 8, 3, 0.25
LEAST_ALIGNED, RUN_CHARS, RUNS, SLACK_SHARE, SLACK_CHARS = 0.85, 5, 8, 1.3, 20
KEY = ["document_id", "quote_id"]


def longest_run(text: str, quote: str, a: int, b: int, c: int, d: int) -> tuple[int, int, int]:
    """(start in the text, start in the quote, size) of the longest run of at least `RUN_CHARS` that text[a:b] and quote[c:d] share, the earliest in the text and then in the quote; size 0 if there is none."""
    size, best = RUN_CHARS - 1, (0, 0, 0)
    for k in range(c, d - RUN_CHARS + 1):
        if k + size > d:
            break
        at = text.find(quote[k : k + size], a, b)
        if at < 0:
            continue
        longer = text.find(quote[k : k + size + 1], a, b) if k + size < d else -1
        while longer >= 0:
            at, size = longer, size + 1
            best = at, k, size
            longer = text.find(quote[k : k + size + 1], a, b) if k + size < d else -1
        if size >= RUN_CHARS and best[1] != k and at < best[0]:
            best = at, k, size
    return best


def runs_of(text: str, quote: str, a: int, b: int, c: int, d: int) -> Iterator[tuple[int, int]]:
    """(start in the text, size) of the runs in order: the longest, and those on its left and right on both sides alike."""
    at, k, size = longest_run(text, quote, a, b, c, d)
    if size:
        yield from runs_of(text, quote, a, at, c, k)
        yield at, size
        yield from runs_of(text, quote, at + size, b, k + size, d)


def align(quote: str, text: str) -> tuple[float, int, int]:
    """The share of the quote that lines up in order within one stretch of the text, and that stretch."""
    at = text.find(quote)
    if at >= 0:
        return 1.0, at, at + len(quote)
    runs = list(runs_of(text, quote, 0, len(text), 0, len(quote)))
    if not runs or len(runs) > RUNS:
        return 0.0, 0, 0
    start, end = runs[0][0], sum(runs[-1])
    if end - start > len(quote) * SLACK_SHARE + SLACK_CHARS:
        return 0.0, 0, 0
    return sum(size for _, size in runs) / len(quote), start, end


def aligned(quote: str, text: str) -> Column:
    def run(quotes: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align(q, t) for q, t in zip(quotes, texts)], columns=["score", "start", "end"])

    run.__annotations__ = {"quotes": pd.Series, "texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "score double, start int, end int")(quote, text)


@lru_cache(maxsize=256)
def shingles(quote: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(quote[k : k + SHINGLE] for k in range(len(quote) - SHINGLE + 1)))


def shared_with(text: str, quotes: list[str]) -> list[list[int]]:
    """For each quote the numbers of its distinct shingles that the text has."""
    own = [shingles(q) for q in quotes]
    # A few are looked for in the text; for more, the text's own are gathered once.
    there = text if 2 * sum(map(len, own)) <= len(text) else {text[k : k + SHINGLE] for k in range(len(text) - SHINGLE + 1)}
    return [[k for k, s in enumerate(x) if s in there] for x in own]


def shared_shingles(units: DataFrame, asked: DataFrame) -> DataFrame:
    """document_id, unit_id, place, quote_id, n (the quote's shingles), at, end (if the unit holds the quote as it stands, else -1), shared (numbers of the quote's shingles that the unit has), for units that have any. Where a unit of a document holds a quote as it stands, others may be left out."""
    kinds = dict(units.dtypes) | dict(asked.dtypes)
    of = asked.groupBy("document_id").agg(F.collect_list(F.struct("quote_id", "q")).alias("quotes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quotes = batch.column(4)
            texts, offsets, own = batch.column(3).to_pylist(), quotes.offsets.to_pylist(), quotes.values.field("q").to_pylist()
            out: list[tuple] = []
            # Units of one document that follow each other go together: a quote that one of them holds is counted in no other.
            by_document = zip(batch.column(0).to_pylist(), (tuple(own[a:b]) for a, b in pairwise(offsets)), range(batch.num_rows), strict=True)
            for (_, mine), group in groupby(by_document, key=lambda x: x[:2]):
                rows = [x[2] for x in group]
                at = [[texts[row].find(q) for q in mine] for row in rows]
                rest = [j for j in range(len(mine)) if all(x[j] < 0 for x in at)]
                for row, starts in zip(rows, at):
                    out += [(row, offsets[row] + j, len(shingles(mine[j])), start, start + len(mine[j]), []) for j, start in enumerate(starts) if start >= 0]
                    found = shared_with(texts[row], [mine[j] for j in rest]) if rest else ()
                    out += [(row, offsets[row] + j, len(shingles(mine[j])), -1, -1, numbers) for j, numbers in zip(rest, found) if numbers]
            row, of_quote, *values = ([x[k] for x in out] for k in range(6))
            row, of_quote = pa.array(row, pa.int64()), pa.array(of_quote, pa.int64())
            columns = [*(batch.column(k).take(row) for k in range(3)), quotes.values.field("quote_id").take(of_quote), *map(pa.array, values, (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, ["document_id", "unit_id", "place", "quote_id", "n", "at", "end", "shared"])

    rows = units.join(of, "document_id").select("document_id", "unit_id", "place", "t", "quotes")
    return rows.mapInArrow(run, f"document_id {kinds['document_id']}, unit_id {kinds['unit_id']}, place {kinds['place']}, quote_id {kinds['quote_id']}, n int, at int, end int, shared array<int>")


def short_list(rows: DataFrame, missing: int) -> DataFrame:
    """Targets (n, shared: a number, place) of each quote with `rank` and `listed`: those that share most of its shingles, and those that share all but `missing`, which may hold the quote as it stands."""
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("shared"), "place")))
    listed = (F.col("rank") <= SHORT_LIST) & (F.col("shared") >= LEAST_SHARED * F.col("n"))
    return rows.where(listed | (F.col("shared") >= F.col("n") - missing)).withColumn("listed", listed)


def best_of(pairs: DataFrame, target: str) -> DataFrame:
    """document_id, quote_id, target, score, start, end of the best alignment of each quote with its targets (t, place, whole, rank): those that hold it as it stands first."""
    pairs = pairs.withColumn("a", aligned("q", "t")).where(F.col("a.score") >= LEAST_ALIGNED)
    order = W.partitionBy(*KEY).orderBy(F.desc("whole"), F.when(F.col("whole"), F.col("place")), F.desc("a.score"), "rank")
    return pairs.withColumn("best", F.row_number().over(order)).where("best = 1").select(*KEY, target, "a.score", "a.start", "a.end")


def locate(quotes: DataFrame, excerpts: DataFrame) -> DataFrame:
    """One row for each excerpt that a quote was found in, two where it runs over from one into its neighbour.

    quotes: document_id, quote_id, quote; excerpts: document_id, unit_id, place (numbers; neighbours are one apart), text.
    Returns document_id, quote_id, unit_id, score, start, end (of the squashed excerpt). Null texts are empty; quotes too short to prove anything have no rows.
    """
    unit = ["document_id", "unit_id"]
    units = excerpts.select(*unit, "place", squash(F.col("text")).alias("t"))
    asked = cut(quotes.select(*KEY, squash(F.col("quote")).alias("q")).where(F.length("q") >= QUOTE_CHARS))
    hits = cut(shared_shingles(units, asked))
    first = W.partitionBy(*KEY).orderBy("place")
    whole = hits.where("at >= 0").withColumn("nth", F.row_number().over(first)).where("nth = 1").select(*KEY, "unit_id", F.lit(1.0).alias("score"), F.col("at").alias("start"), "end")
    rest = hits.join(whole, KEY, "left_anti")
    single = short_list(rest.select(*KEY, "n", "unit_id", "place", F.size("shared").alias("shared")), 0).where("listed").select(*KEY, "unit_id", "place", "rank")
    # Shingles of either neighbour count once for both.
    near = excerpts.select("document_id", F.col("unit_id").alias("first"), "place").join(excerpts.select("document_id", F.col("unit_id").alias("second"), (F.col("place") - 1).alias("place")), ["document_id", "place"])
    of = rest.select(*KEY, "n", "unit_id", "shared")
    sides = [of.withColumnRenamed("unit_id", side).join(near, ["document_id", side]).select(*KEY, "n", "first", "second", "place", "shared") for side in ("first", "second")]
    joined = sides[0].unionByName(sides[1]).groupBy(*KEY, "n", "first", "second", "place").agg(F.size(F.array_distinct(F.flatten(F.collect_list("shared")))).alias("shared"))
    double = cut(short_list(joined, SHINGLE - 1).select(*KEY, "first", "second", "place", "rank", "listed"))
    needed = single.select(*unit).union(double.select("document_id", "first")).union(double.select("document_id", "second")).distinct()
    texts = cut(units.select(*unit, "t").join(needed, unit, "left_semi"))
    close = best_of(single.join(texts, unit).join(asked, KEY).withColumn("whole", F.lit(False)), "unit_id")
    found = cut(whole.union(close))
    side = lambda name, t: texts.select("document_id", F.col("unit_id").alias(name), F.col("t").alias(t))
    pairs = double.join(found, KEY, "left_anti").join(asked, KEY).join(side("first", "a"), ["document_id", "first"]).join(side("second", "b"), ["document_id", "second"])
    pairs = pairs.withColumn("target", F.struct("first", "second", F.length("a").alias("chars"))).withColumn("t", F.concat("a", "b")).drop("a", "b")
    over = best_of(pairs.withColumn("whole", F.contains("t", "q")).where("listed OR whole"), "target")
    sides = F.array(
        F.struct(F.col("target.first").alias("unit_id"), F.col("start").alias("start"), F.least("end", "target.chars").alias("end")),
        F.struct(F.col("target.second").alias("unit_id"), F.greatest(F.col("start") - F.col("target.chars"), F.lit(0)).alias("start"), (F.col("end") - F.col("target.chars")).alias("end")),
    )
    over = over.select(*KEY, "score", F.explode(F.filter(sides, lambda x: x["end"] > x["start"])).alias("x")).select(*KEY, "x.unit_id", "score", "x.start", "x.end")
    return found.select(*over.columns).union(over)


def _excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut every 600 characters."""
    docs = corpus.documents(spark, d)
    pieces = F.regexp_extract_all("content", F.lit("(?s).{1,600}"), F.lit(0))  # in one pass, however long the text
    rows = docs.select("document_id", F.posexplode(F.when(F.length("content") > 0, pieces).otherwise(F.array("content"))).alias("place", "text"))
    return rows.select("document_id", F.concat_ws("-", F.col("document_id").cast("string"), F.col("place").cast("string")).alias("unit_id"), "place", "text")


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    """Three pieces of each document, one of them over a bound, with some letters changed in some."""
    docs = corpus.documents(spark, d)
    starts = F.array(F.lit(40), F.lit(560), F.floor(F.length("content") / 2).cast("int"))
    rows = docs.select("document_id", "content", F.posexplode(starts).alias("k", "at")).where(F.col("at") < F.length("content"))
    quote = F.substring(F.col("content"), F.col("at") + 1, F.lit(90))
    changed = F.when(F.col("document_id") % 3 == 1, F.concat(F.substring(quote, 1, 30), F.lit("xq"), F.substring(quote, 33, 60))).when(F.col("document_id") % 11 == 2, F.reverse(quote)).otherwise(F.upper(quote))
    return rows.select("document_id", F.concat_ws("-", F.col("document_id").cast("string"), F.col("k").cast("string")).alias("quote_id"), changed.alias("quote"))


QUERIES = {"located_quotes": lambda s, d: locate(_quotes(s, d), _excerpts(s, d))}
ORACLES: dict[str, str] = {}
