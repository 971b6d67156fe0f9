"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Whether a set of documents fits a sequence depends only on their lengths, so the whole instance is the number of pieces of
each length: at most `capacity` numbers, whatever the size of the corpus. The plan is made on that histogram, for all pieces
of a length at a time:

- Reduction: for the longest piece left, a set that provably dominates every other choice is fixed for good. The piece
  alone, if nothing fits beside it; with the longest piece that fits, if that fills the sequence, or if only one piece can
  stand beside it, or if at most two can and that one is at least as long as any two. Each rule stays true while pieces
  are taken away, so it is applied to as many pieces as there are.
- Best fit, by decreasing length, packs the rest.

Spark then numbers the pieces of each length (in hash buckets, so that no common length meets in one task) and reads each
piece's place from the plan.

Defined results: a null or empty text is one piece of one token, the closing id; repeated rows are packed one by one; an
empty table packs to no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.common import documents, id_text, map_batches, stage

CAPACITY = 2048


@dataclass
class Bins:
    """`many` sequences with the same content: (length, how many of it) in order."""

    content: list[tuple[int, int]]
    many: int


def reduce_instance(left: np.ndarray, capacity: int) -> list[Bins]:
    """Fix dominating sets; `left` (count by length) shrinks in place."""
    fixed: list[Bins] = []

    def smallest(skip: int, k: int) -> list[int]:
        """The k shortest pieces left beside one piece of length `skip`."""
        out: list[int] = []
        for v in np.flatnonzero(left):
            out += [int(v)] * min(k - len(out), int(left[v]) - (v == skip))
            if len(out) == k:
                break
        return out

    def longest(limit: int, skip: int) -> int:
        found = np.flatnonzero(left[: limit + 1])
        for v in found[::-1][:2]:
            if left[v] > (v == skip):
                return int(v)
        return 0

    def best_pair(limit: int, skip: int) -> int:
        """The largest sum of two pieces left, at most `limit`."""
        values, best = np.flatnonzero(left[: limit + 1]), 0
        for v in values:
            room = limit - int(v)
            spare = [int(w) for w in values[: bisect_right(values.tolist(), room)] if left[w] > (w == v) + (w == skip)]
            if spare and left[v] > (v == skip):
                best = max(best, int(v) + spare[-1])
        return best

    changed = True
    while changed:
        changed = False
        for length in map(int, np.flatnonzero(left)[::-1]):
            while left[length]:
                few = smallest(length, 3)
                room = capacity - length
                if not few or few[0] > room:
                    fixed.append(Bins([(length, 1)], int(left[length])))
                    left[length] = 0
                else:
                    mate = longest(room, length)
                    alone = len(few) < 2 or few[0] + few[1] > room
                    pairs = len(few) < 3 or sum(few) > room
                    if not (mate == room or alone or pairs and mate >= best_pair(room, length)):
                        break
                    many = int(left[length] // 2 if mate == length else min(left[length], left[mate]))
                    fixed.append(Bins([(length, 2)] if mate == length else [(length, 1), (mate, 1)], many))
                    left[length] -= many
                    left[mate] -= many
                changed = True
    return fixed


def best_fit(left: np.ndarray, capacity: int) -> list[Bins]:
    """Best fit by decreasing length, for all pieces of a length at a time."""
    by_room: dict[int, list[Bins]] = {}

    def put(bins: Bins, room: int) -> None:
        if bins.many:
            by_room.setdefault(room, []).append(bins)

    for length in map(int, np.flatnonzero(left)[::-1]):
        count = int(left[length])
        for room in sorted(r for r in by_room if r >= length):
            each = room // length
            for bins in by_room.pop(room):
                whole = min(bins.many, count // each)
                rest = count - whole * each if whole < bins.many else 0
                put(Bins([*bins.content, (length, each)], whole), room - each * length)
                if rest:
                    put(Bins([*bins.content, (length, rest)], 1), room - rest * length)
                put(Bins(bins.content, bins.many - whole - (rest > 0)), room)
                count -= whole * each + rest
        each = capacity // length
        put(Bins([(length, each)], count // each), capacity - each * length)
        put(Bins([(length, count % each)], int(count % each > 0)), capacity - count % each * length)
    return [b for bins in by_room.values() for b in bins]


@dataclass
class Plan:
    """Ranges of piece numbers by length: key = length << 44 | first number, and what such a range is given."""

    key: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    fixed: int


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    fixed = reduce_instance(left, capacity)
    rows, used, sequence = [], {}, 0
    for bins in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for length, each in bins.content:
            at = used.get(length, 0)
            rows.append((length << 44 | at, at, each, sequence, offset))
            used[length] = at + each * bins.many
            offset += each * length
        sequence += bins.many
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=sequence, fixed=sum(b.many for b in fixed))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, close: int | None = 0, with_ids: bool = False) -> DataFrame:
    """Each document's ids and the closing id, cut into pieces of at most `capacity`: doc_id, piece, start, length, ids_crc32 (and ids)."""
    end = b"" if close is None else np.array([close], "<u4").tobytes()

    def run(batch: pa.RecordBatch):
        out: list[list] = [[] for _ in range(5 + with_ids)]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = tokens.encode(text, tokenizer) + end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[at : at + 4 * capacity]
                for column, v in zip(out, (doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), own)):
                    column.append(v)
        return out

    return map_batches(id_text(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row of `cut` (doc_id, piece, length, ...) a sequence_id and an offset in it."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = make_plan(counts, capacity)
    buckets = max(256, sum(counts.values()) // 50_000)
    rows = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    own = W.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = rows.withColumn("own", F.row_number().over(own)).join(starts, ["length", "bucket"]).withColumn("number", F.col("base") + F.col("own") - 1).select(*cut.columns, "number")
    names = [c for c in cut.columns]

    def place(batch: pa.RecordBatch):
        length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "number"))
        k = np.searchsorted(plan.key, length << 44 | number, "right") - 1
        nth = number - plan.first[k]
        return [*(batch.column(batch.schema.get_field_index(c)) for c in names), plan.sequence[k] + nth // plan.each[k], plan.offset[k] + nth % plan.each[k] * length]

    schema = cut.schema
    return map_batches(numbered, place, type(schema)([*schema.fields]).add("sequence_id", "long").add("offset", "long"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stage(pieces(documents(spark, sf_dir), tokens.default_path()), "pieces"))
