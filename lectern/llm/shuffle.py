"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

The law is `rows`: of N rows, shard s gets N // shards, and one more if s < N % shards. A uniform shuffle, seen as a table
of how many rows go from each source partition to each shard, has a multivariate hypergeometric law: that table is drawn
first, exactly. Then each partition permutes its rows and deals them out by its row of the table, the rows are exchanged,
and each shard permutes what it received. No row needs to know of any other, so nothing is sorted or ranked across tasks.

The rows are written once, with their partition and their place in it, so that a repeated task deals them alike. The table
is drawn in two steps: the driver draws how many rows go from each block of `BLOCK` partitions to each shard (one row of
`shards` numbers for each block), and Spark draws each block's partitions in a task of its own. The join of rows and table
is left to Spark: it broadcasts the table only while it is small (autoBroadcastJoinThreshold). The place in a shard is a
keyed Feistel permutation of the order of arrival, so a shard of any size is permuted without holding it; a shard's slots
are cut into ranges, one task each.

Groups play no part: equal texts are rows like others, and a shuffle that keeps them together could not be uniform.

Defined results: a null text has 0 bytes (and the crc32 of no bytes); repeated rows are rows of their own; an empty table
gives no rows, fewer rows than shards leave shards empty. Columns of the input that are named like the two that are added
(`shard`, `slot`) are replaced by them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, documents, shuffle_partitions
from lectern.llm.shards import mix

#: Partitions whose rows of the table one task draws.
BLOCK = 1024
ROUNDS = 8
MASK = (1 << 64) - 1


def generator(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([k & MASK for k in key])))


def hypergeometric(rng: np.random.Generator, good: int, total: int, draws: int) -> int:
    """How many of `draws` rows, taken from `total` without putting back, are among the `good`: inversion of the exact law, at any size.

    Probabilities are built up from the mode by their ratios, 12 standard deviations and 40 values to each side; less than 1e-30 lies beyond.
    """
    low, high = max(0, draws - (total - good)), min(draws, good)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    share = good / total
    reach = 40 + int(12 * math.sqrt(draws * share * (1 - share) * (total - draws) / max(total - 1, 1)))
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    step = np.log((good - k[:-1]) * (draws - k[:-1]) / ((k[1:]) * (total - good - draws + k[1:])))
    weight = np.concatenate([[0.0], np.cumsum(step)])
    sums = np.cumsum(np.exp(weight - weight.max()))
    return int(k[min(np.searchsorted(sums, rng.random() * sums[-1], "right"), len(k) - 1)])


def deal(rng: np.random.Generator, room: list[int], draws: int) -> list[int]:
    """How many of `draws` rows go to each shard of which `room` places are left: multivariate hypergeometric, one shard after the other."""
    out, total = [], sum(room)
    for places in room:
        n = hypergeometric(rng, places, total, draws)
        out.append(n)
        total -= places
        draws -= n
    return out


def sizes_of(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> tuple[DataFrame, int]:
    """From (part, n): part, n, upto (rows for shards 0 to s), before (rows of shard s from earlier partitions); and the number of all rows."""
    spark = counts.sparkSession
    counts = counts.withColumn("block", F.floor(F.col("part") / BLOCK))
    totals = sorted((r["block"], r["n"]) for r in counts.groupBy("block").agg(F.sum("n").alias("n")).collect())  # one row for each BLOCK partitions
    rows = sum(n for _, n in totals)
    room, before, quotas = sizes_of(rows, shards), [0] * shards, []
    for block, n in totals:
        own = deal(generator(seed, 0, block), room, n)
        quotas.append((block, own, before))
        room, before = [a - b for a, b in zip(room, own)], [a + b for a, b in zip(before, own)]

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        rng = generator(seed, 1, int(group["block"].iloc[0]))
        room, before, out = [int(x) for x in group["quota"].iloc[0]], [int(x) for x in group["first"].iloc[0]], []
        for part, n in zip(group["part"].tolist(), group["n"].tolist()):
            own = deal(rng, room, n)
            out.append((part, n, np.cumsum(own).tolist(), before))
            room, before = [a - b for a, b in zip(room, own)], [a + b for a, b in zip(before, own)]
        return pd.DataFrame(out, columns=["part", "n", "upto", "before"])

    quota = spark.createDataFrame(quotas, "block long, quota array<long>, first array<long>")
    return counts.join(quota, "block").groupBy("block").applyInPandas(draw, "part long, n long, upto array<long>, before array<long>"), rows


def local_permutation(seed: int) -> Column:
    """The new place of a row in its partition: a uniform permutation of the partition's rows, drawn again alike in each batch."""

    @F.pandas_udf("long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held, order = None, np.zeros(0, np.int64)
        for part, n, pos in batches:
            out, parts, counts, places = np.empty(len(part), np.int64), part.to_numpy(), n.to_numpy(), pos.to_numpy()
            for p in np.unique(parts):
                own = parts == p
                if p != held:
                    held, order = p, generator(seed, 2, int(p)).permutation(int(counts[own][0]))
                out[own] = order[places[own]]
            yield pd.Series(out)

    return place("part", "n", "pos")


def permute(numbers: np.ndarray, count: int, key: int) -> np.ndarray:
    """A keyed permutation of range(count): Feistel rounds over at least 2^8 values, walking along the cycle until below count."""
    half = max(4, -(-max(count - 1, 1).bit_length() // 2))
    low, out, todo = np.uint64((1 << half) - 1), numbers.astype(np.uint64), np.ones(len(numbers), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & low
        for r in range(ROUNDS):
            left, right = right, left ^ (mix(right, key * 131 + r) & low)
        out[todo] = left << np.uint64(half) | right
        todo = out >= np.uint64(count)
    return out.astype(np.int64)


def shard_permutation(rows: int, shards: int, seed: int) -> Column:
    """The slot of a row in its shard, from the order of arrival."""
    base, more = divmod(rows, shards)

    @F.pandas_udf("long")
    def slot(shard: pd.Series, arrival: pd.Series) -> pd.Series:
        out, where, at = np.empty(len(shard), np.int64), shard.to_numpy(), arrival.to_numpy()
        for s in np.unique(where):
            own = where == s
            out[own] = permute(at[own], base + int(s < more), (seed * 1_000_003 + int(s)) & MASK)
        return pd.Series(out)

    return slot("shard", "arrival")


def shuffle_into_shards(docs: DataFrame, shards: int = 24, seed: int = 11, scratch: Scratch | None = None) -> DataFrame:
    """All rows and columns of `docs`, with shard and slot, laid out by shard and in slot order within ranges of a shard's slots."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    own = docs.drop("shard", "slot")
    number = F.monotonically_increasing_id()  # the partition in the upper bits, the place in it in the lower 33
    rows = scratch.stage(own.select(F.struct(*[own[f"`{c}`"] for c in own.columns]).alias("row"), number.alias("number")).select("row", F.shiftright("number", 33).alias("part"), F.col("number").bitwiseAND((1 << 33) - 1).alias("pos")), "rows", "zstd")
    matrix, total = communication_matrix(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")), shards, seed)
    matrix = scratch.stage(matrix, "matrix")
    dealt = rows.join(matrix, "part").withColumn("place", local_permutation(seed))
    dealt = dealt.withColumn("shard", F.size(F.filter("upto", lambda u: u <= F.col("place"))))
    first = F.when(F.col("shard") > 0, F.get("upto", F.col("shard") - 1)).otherwise(0)
    dealt = dealt.withColumn("arrival", F.get("before", F.col("shard")) + F.col("place") - first)
    dealt = dealt.withColumn("slot", shard_permutation(total, shards, seed))
    ranges = max(1, -(-shuffle_partitions(spark) // shards))
    span = max(1, -(-(total // shards + 1) // ranges))
    task = F.col("shard") * ranges + F.floor(F.col("slot") / span)
    out = dealt.select("row", "shard", "slot").repartitionById(shards * ranges, task.cast("int")).sortWithinPartitions("shard", "slot")
    return out.select("row.*", "shard", "slot")


def write_shards(docs: DataFrame, folder: str, shards: int = 24, seed: int = 11) -> DataFrame:
    """Write the shuffled rows as Parquet under folder/shard=s, each file a range of slots in order; returns them as read back."""
    scratch = Scratch(docs.sparkSession)
    out = shuffle_into_shards(docs, shards, seed, scratch)
    out.write.partitionBy("shard").mode("overwrite").parquet(folder)
    scratch.drop_all_but()
    return docs.sparkSession.read.schema(out.schema).parquet(folder)


def op11_hypergeometric_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, as the shuffled rows have them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return shuffle_into_shards(documents(spark, sf_dir).select("doc_id", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
