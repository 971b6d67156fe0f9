"""Ranked lexical search by the best position algorithm, over segments of the documents.

Terms are counted once, in a scan that keeps only those the items ask for. With the corpus' counts known, the documents are
taken in segments of at most `POSTINGS` postings. In a segment each asked term has an impact list: its documents in falling
order of what they add to a score. For an item, the lists are read downwards side by side; each document met is looked up
in the other lists (direct access by document), which gives its whole score and its position in each list. The best
position of a list is the end of the unbroken run of seen positions from its top, which direct accesses push on beyond the
last position read; the sum of the impacts there bounds every document that was not seen. Reading stops once that bound is
strictly below the score of the kth document so far, so that ties at the kth place are still met; the kth score goes from
segment to segment within a task. What each task keeps, at most k documents an item, is merged by item, in two steps.

Items go through in blocks whose terms fit a lookup table in each task (`TERMS_LIMIT` pairs of item and term); there is one
block for as long as they do.

Defined results: a null or empty text has no terms and is no document for the counts; each row counts as a document, also a
repeated one; repeated rows of an item count once, and unlike texts of one item_id are one item with the terms of all; items
without terms, or met by no document, have no rows; equal scores stand by doc_id, null first.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import bounded, documents, stage

POSTINGS = 1_000_000
TERMS_LIMIT = 500_000
#: Positions of each list that are read before the first look at the bound; each further step reads as many as all before.
STEP = 32
#: Merges of the first step for each item.
SALTS = 64
#: Bytes of terms: letters and digits of ASCII, A-Z in lower case, and all beyond ASCII; others part terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
NULL_ID = np.iinfo(np.int64).min


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            rows = [(i, t, n) for i, text in zip(*(c.to_pylist() for c in batch.columns)) for t, n in Counter(terms_of(text)).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.binary(), pa.int64()))], ["item_id", "term", "times"])

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    return texts.mapInArrow(run, "item_id long, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def profiles(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs: the numbers (from 1) of the asked terms that a document holds, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = numbers.get
        for batch in bounded(batches):
            ns, sizes, terms, tfs = [], [0], [], []
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                found = Counter(filter(None, map(get, words)))
                ns.append(len(words))
                sizes.append(len(found))
                terms.extend(found.keys())
                tfs.extend(found.values())
            offsets = pa.array(np.cumsum(sizes), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Segment:
    """The impact lists of some documents: doc_ids, and of each posting term, doc (its place in doc_ids) and impact."""

    def __init__(self, doc_ids: np.ndarray, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int):
        self.doc_ids = doc_ids
        by_doc = np.lexsort((doc, term))
        by_impact = np.lexsort((doc, -impact, term))
        self.starts = np.searchsorted(term[by_doc], np.arange(n_terms + 2))
        rank = np.empty(len(term), np.int64)
        rank[by_impact] = np.arange(len(term))
        self.docs, self.impacts, self.places = doc[by_doc], impact[by_doc], rank[by_doc] - self.starts[term[by_doc]]
        self.listed, self.falling = doc[by_impact], impact[by_impact]

    def best(self, query: list[tuple[int, int]], k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best of (scores, ids) and this segment's documents for a query of (term, times); and how many documents were looked up."""
        lists = [(slice(self.starts[t], self.starts[t + 1]), times) for t, times in query if self.starts[t] < self.starts[t + 1]]
        known = np.zeros(len(self.doc_ids), bool)
        seen = [np.zeros(s.stop - s.start, bool) for s, _ in lists]
        best = [0] * len(lists)
        read, to = 0, STEP
        while lists:
            met = np.concatenate([self.listed[s][read:to] for s, _ in lists])
            fresh = np.unique(met[~known[met]])
            known[fresh] = True
            total = np.zeros(len(fresh), np.int64)
            for (s, times), marks in zip(lists, seen):
                docs = self.docs[s]
                at = np.minimum(np.searchsorted(docs, fresh), len(docs) - 1)
                hit = docs[at] == fresh
                at = at[hit]
                total[hit] += times * self.impacts[s][at]
                marks[self.places[s][at]] = True
            some = total > 0
            scores, ids = top(np.concatenate([scores, total[some]]), np.concatenate([ids, self.doc_ids[fresh[some]]]), k)
            bound = 0
            for i, ((s, times), marks) in enumerate(zip(lists, seen)):
                run = marks[best[i] :]
                best[i] += len(run) if run.all() else int(run.argmin())
                if best[i] < len(marks):  # a list seen to its end adds nothing to an unseen document
                    bound += times * int(self.falling[s][best[i] - 1])
            if len(scores) == k and bound < scores[-1] or all(b == len(m) for b, m in zip(best, seen)):
                break
            read, to = to, 2 * to
        return scores, ids, int(known.sum())


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def best_of_segments(queries: list[tuple[int | None, list[tuple[int, int]]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, postings: int):
    """A task's work: from profiles, the k best documents of each query."""

    def segment(parts: list[pa.RecordBatch]) -> Segment:
        table = pa.Table.from_batches(parts).combine_chunks()
        terms, tfs = (table.column(c).combine_chunks() for c in ("terms", "tfs"))
        ids = table.column("doc_id").fill_null(int(NULL_ID)).to_numpy()
        sizes = np.diff(terms.offsets.to_numpy())
        doc = np.repeat(np.arange(len(ids)), sizes)
        term, tf = terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
        m = 75 + 25 * table.column("n").to_numpy() * n_docs // n_terms
        return Segment(ids, term, doc, weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc])), len(weights) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        held, size = [], 0
        for batch in chain(_slices(batches, postings), [None]):
            if held and (batch is None or size + len(batch.column("terms").flatten()) > postings):
                own = segment(held)
                best = [own.best(query, k, *b)[:2] for (_, query), b in zip(queries, best)]
                held, size = [], 0
            if batch is not None:
                held.append(batch)
                size += len(batch.column("terms").flatten())
        rows = [(item, None if i == NULL_ID else i, s) for (item, _), (scores, ids) in zip(queries, best) for s, i in zip(scores.tolist(), ids.tolist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["item_id", "doc_id", "score"])

    return run


def _slices(batches: Iterator[pa.RecordBatch], postings: int) -> Iterator[pa.RecordBatch]:
    """Pieces of at most `postings` postings, or one row."""
    for batch in batches:
        ends, at = batch.column("terms").offsets.to_numpy().astype(np.int64), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + postings, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def search(docs: DataFrame, items: DataFrame, k: int = 20, postings: int = POSTINGS, terms_limit: int = TERMS_LIMIT) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    asked = stage(item_terms(items), "items")
    blocks = max(1, -(-asked.count() // terms_limit))
    out = []
    for block in range(blocks):
        queries, numbers = defaultdict(list), {}
        for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():  # about terms_limit rows
            queries[r["item_id"]].append((numbers.setdefault(bytes(r["term"]), len(numbers) + 1), r["times"]))
        found = stage(profiles(docs, numbers).where("n > 0"), "profiles", "zstd")
        n_docs, n_terms = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(numbers) + 1, np.int64)
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row for each asked term at most
            weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
        task = best_of_segments(list(queries.items()), weights, n_docs, max(n_terms, 1), k, postings)
        out.append(found.mapInArrow(task, "item_id long, doc_id long, score long"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    best = reduce(DataFrame.union, out).withColumn("salt", F.spark_partition_id() % SALTS)
    for keys in (["item_id", "salt"], ["item_id"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def op12_best_position_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
e AS (SELECT * FROM d WHERE len(terms) > 0),
s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM e),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
p AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM e)
  WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term, n_docs),
x AS (
  SELECT q.item_id, p.doc_id, p.r, sum(q.times * w.weight * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * s.n_docs) // s.n_terms))))::BIGINT AS score
  FROM p JOIN q USING (term) JOIN w USING (term) CROSS JOIN s GROUP BY q.item_id, p.doc_id, p.r)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM x WHERE score > 0)
WHERE rank <= 20
"""
