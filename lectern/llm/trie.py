"""Conversation prefix trie: padded turn-id matrices over range shards, whose boundary nodes are recombined.

A turn's id is 126 bits of hash of its role and text, a conversation the array of its ids. The conversations are range
partitioned and sorted by that array, then by conv_id, so that a shard is a run of the trie's order, copies of one
conversation can be split between shards, and the members of every node stand in a row. A task reads its shard as blocks of
at most `CELLS` matrix cells (one row at least). In a block the ids are a matrix, one row a conversation, padded behind;
numpy's lexsort orders it; the mask of rows that differ from the row before in a column, OR-accumulated over the columns,
marks where the nodes of each depth start; reduceat over those starts gives members, smallest member, children, leaves and
saved tokens of all nodes of a depth. Leaves and saved tokens go bottom up: a node leaves its own share at its first row.

A node on the path of a block's first or last row may go on in the neighbour. Such boundary nodes leave as partial sums
under a hash of their prefix, made so that sums over blocks are right: a node counts as new in its first block, and as a
leaf in its last. Within a shard the neighbouring rows are at hand. Between two shards they are not: both sides' paths are
partial sums, and the prefix that they share gives correction rows, depth by depth. The partial sums are added up by
prefix hash; nodes whose parent is a boundary node get its conv_id by a join. Conversations that end at a boundary node
leave as text chunks, which one task for each such node hashes in order, as a stream.

One conversation's ids have to fit into a task (20 bytes a turn); nodes, members and copies are not bounded.

Defined results: a null role or text reads as empty; rows without conv_id belong to no conversation; turns of one number
stand in the order of role, then of a hash of the text; repeated rows are turns of their own; an empty table has no root
and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lectern.llm.common import Scratch, shuffle_partitions

#: Matrix cells of a block: 16 bytes of ids and some of masks each.
CELLS = 400_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: A whole node, a part of a boundary node, the path of a shard's first row, of its last row.
WHOLE, PART, FIRST, LAST = range(4)
SCHEMA = "kind int, shard int, block int, depth long, key binary, parent_key binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends string, path_keys array<binary>, path_sizes array<long>"
SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def turn_sequences(conversations: DataFrame, keys: list[str]) -> DataFrame:
    """For each group of `keys`: turns, an array of (a, b: the turn's id; size: UTF-8 bytes of its text) in order of turn, null first."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), _id(role, text).alias("a"), _id(text, F.lit(7), role).alias("b"), F.octet_length(text).cast("long").alias("size"))
    found = conversations.select(*keys, turn.alias("t")).groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return found.withColumn("turns", F.transform("turns", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["size"].alias("size"))))


def _id(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)  # never negative: -1 is what fills a matrix


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and turns of each conversation c: the first h turns of conversation c - c % 5, then its own after the first h; h = crc32(c) % 9."""
    base = (F.col("conv_id") - F.col("conv_id") % 5).alias("base")
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    own = turn_sequences(rows.select(base, "*").repartition("base"), ["base", "conv_id"])  # what follows needs no other partitioning
    heads = own.where("conv_id = base").select("base", F.slice("turns", 1, 8).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    tail = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, tail).alias("turns"))


def lcp(a: np.ndarray, b: np.ndarray) -> int:
    """Turns that two rows of ids share at the beginning."""
    n = min(len(a), len(b)) // 2
    differ = np.flatnonzero((a[: 2 * n] != b[: 2 * n]).reshape(n, 2).any(1))
    return int(differ[0]) if len(differ) else n


def path_keys(ids: np.ndarray) -> list[bytes]:
    """The hash of each prefix of a row, the empty one first."""
    state, out = hashlib.blake2b(digest_size=16), []
    out.append(state.digest())
    for at in range(0, len(ids), 2):
        state.update(ids[at : at + 2].tobytes())
        out.append(state.digest())
    return out


class Block:
    """The nodes of some neighbouring conversations: convs, lens, and ids (two a turn) and sizes behind each other."""

    def __init__(self, convs: np.ndarray, lens: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        n, depth = len(convs), int(lens.max())
        starts = np.cumsum(lens) - lens
        row, column = np.repeat(np.arange(n), lens), np.arange(len(sizes)) - np.repeat(starts, lens)
        matrix, size = np.full((2 * depth, n), -1, np.int64), np.zeros((depth + 1, n), np.int64)
        matrix[2 * column, row], matrix[2 * column + 1, row], size[column + 1, row] = ids[::2], ids[1::2], sizes
        order = np.lexsort(np.vstack([convs[None], matrix[::-1]]))
        self.matrix, self.size, self.convs, self.lens = matrix[:, order], size[:, order], convs[order], lens[order]
        self.first, self.last = (self.matrix[: 2 * self.lens[k], k] for k in (0, -1))

    def nodes(self, before: np.ndarray | None, after: np.ndarray | None) -> Iterator[list]:
        """The columns of SCHEMA from depth to ends, for each depth; before, after: the neighbouring rows' ids, None at the shard's ends."""
        n, depth = len(self.convs), len(self.size) - 1
        shared_before, shared_after = (-1 if x is None else lcp(x, own) for x, own in ((before, self.first), (after, self.last)))
        open_first, open_last = len(self.first) // 2 if before is None else shared_before, len(self.last) // 2 if after is None else shared_after
        first_keys, last_keys = path_keys(self.first), path_keys(self.last)
        changed = np.zeros(n, bool)
        changed[0] = True
        masks = [changed.copy()]
        for d in range(depth):
            changed[1:] |= (self.matrix[2 * d : 2 * d + 2, 1:] != self.matrix[2 * d : 2 * d + 2, :-1]).any(0)
            masks.append(changed.copy())
        saved_at, leaves_at, new_at = (np.zeros(n, np.int64) for _ in range(3))
        found: list[tuple] = []
        for d in range(depth, -1, -1):
            every = np.flatnonzero(masks[d])
            alive = self.lens[every] >= d  # other starts are of padding
            starts = every[alive]
            on_first, on_last = self.lens[0] >= d, self.lens[-1] >= d
            members = np.diff(np.append(every, n))[alive]
            ends = np.add.reduceat((self.lens == d).astype(np.int64), every)[alive]
            least = np.minimum.reduceat(self.convs, every)[alive]
            children = np.add.reduceat(new_at, every)[alive]
            new, leaf, part = np.ones(len(starts), np.int64), (members == ends).astype(np.int64), np.zeros(len(starts), np.int8)
            if on_first and d <= shared_before:
                new[0] = 0
            if on_last and d <= shared_after:
                leaf[-1] = 0
            if on_last and d <= open_last:
                part[-1] = 2
            if on_first and d <= open_first:
                part[0] = 1
            size = self.size[d, starts]
            saved_at[starts] += (members - new) * size
            leaves_at[starts] += leaf
            saved, leaves = (np.add.reduceat(x, every)[alive] for x in (saved_at, leaves_at))
            new_at[:] = 0
            new_at[starts] = new
            found.append((d, starts, members, ends, least, children, leaves, saved, part))
        above = None
        for d, starts, members, ends, least, children, leaves, saved, part in found[::-1]:
            key_of = lambda at, p: (None, first_keys[at] if at < len(first_keys) else None, last_keys[at] if at < len(last_keys) else None)[p]
            if above is None:
                parent_keys, parents = [None] * len(starts), [None] * len(starts)
            else:
                up = np.searchsorted(above[0], starts, "right") - 1
                ups = above[2][up].tolist()
                parent_keys = [key_of(d - 1, p) for p in ups]
                parents = [c if not p else None for c, p in zip(above[1][up].tolist(), ups)]
            above = (starts, least, part)
            digests: list = [NO_ENDS] * len(starts)
            chunks: list = [None] * len(starts)
            for k in np.flatnonzero(ends).tolist():
                text = ",".join(map(str, self.convs[starts[k] : starts[k] + ends[k]].tolist()))
                if part[k]:
                    chunks[k] = text
                else:
                    digests[k] = hashlib.sha256(text.encode()).hexdigest()
            parts = part.tolist()
            yield [[PART if p else WHOLE for p in parts], [d] * len(starts), [key_of(d, p) for p in parts], parent_keys, least, parents, members, children, leaves, saved, digests, chunks]

    def edge(self, kind: int) -> tuple[list[bytes], list[int]]:
        row = 0 if kind == FIRST else -1
        return path_keys(self.first if kind == FIRST else self.last), self.size[: self.lens[row] + 1, row].tolist()


def blocks(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[Block]:
    """The rows (conv_id, ids, sizes) of a sorted shard as blocks of at most `cells` rows times turns, or one row."""
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
    for batch in batches:
        ids, sizes = batch.column(1), batch.column(2)
        new = [batch.column(0).to_numpy(), np.diff(sizes.offsets.to_numpy()).astype(np.int64), ids.flatten().to_numpy(), sizes.flatten().to_numpy()]
        held = [np.concatenate(pair) for pair in zip(held, new)]
        while len(held[0]):
            area = np.maximum.accumulate(np.maximum(held[1], 1)) * np.arange(1, len(held[1]) + 1)
            cut = max(1, int(np.searchsorted(area, cells, "right")))
            if cut >= len(held[0]):
                break
            turns = int(held[1][:cut].sum())
            yield Block(held[0][:cut], held[1][:cut], held[2][: 2 * turns], held[3][:turns])
            held = [held[0][cut:], held[1][cut:], held[2][2 * turns :], held[3][turns:]]
    if len(held[0]):
        yield Block(*held)


def shard_nodes(cells: int):
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        names = ["kind", *schema.names[schema.names.index("depth") : schema.names.index("ends") + 1]]

        def emit(number: int, columns: list) -> pa.RecordBatch:
            rows = len(columns[0])
            own = dict(zip(names, columns)) | {"shard": [shard] * rows, "block": [number] * rows}
            return pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own else pa.nulls(rows, f.type) for f in schema], schema=schema)

        def edge(kind: int, block: Block) -> pa.RecordBatch:
            own = dict(zip(("path_keys", "path_sizes"), ([x] for x in block.edge(kind)))) | {"kind": [kind], "shard": [shard]}
            return pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own else pa.nulls(1, f.type) for f in schema], schema=schema)

        held, before, number = None, None, 0
        for block in blocks(batches, cells):
            if held is None:
                yield edge(FIRST, block)
            else:
                yield from (emit(number, c) for c in held.nodes(before, block.first))
                before, number = held.last, number + 1
            held = block
        if held is not None:
            yield from (emit(number, c) for c in held.nodes(before, None))
            yield edge(LAST, held)

    return run


def corrections(nodes: DataFrame) -> DataFrame:
    """Partial sums that set right what two neighbouring shards both count, from the paths of their edge rows (two rows for each shard)."""
    firsts = nodes.where(F.col("kind") == FIRST).select("shard", "path_keys", "path_sizes")
    lasts = nodes.where(F.col("kind") == LAST).select("shard", F.col("path_keys").alias("end_keys"))
    pairs = firsts.join(lasts, "shard").withColumn("end_keys", F.lag("end_keys").over(Window.orderBy("shard"))).where("end_keys IS NOT NULL")
    pairs = pairs.withColumn("top", F.size(F.filter(F.zip_with("path_keys", "end_keys", lambda a, b: a == b), lambda same: same)) - 1)
    pairs = pairs.select("*", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("depth"))
    sizes = F.slice("path_sizes", F.col("depth") + 1, F.col("top") - F.col("depth") + 1)
    return pairs.select(
        F.get("path_keys", F.col("depth")).alias("key"),
        F.col("depth").cast("long").alias("depth"),
        F.lit(None).cast("binary").alias("parent_key"),
        F.lit(None).cast("long").alias("conv_id"),
        F.lit(0).cast("long").alias("n_convs"),
        F.when(F.col("depth") < F.col("top"), -1).otherwise(0).cast("long").alias("n_children"),
        F.when(F.col("top") == F.size("end_keys") - 1, -1).otherwise(0).cast("long").alias("n_leaves"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b).alias("saved_tokens"),
    )


def hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, ends), chunks of a key one after the other: key and the hash of all."""
    key, state, out = None, None, []
    for batch in batches:
        for k, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if k != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(text.encode())
            else:
                state.update(f",{text}".encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["key", "ends_sha256"])
            out = []
    if key is not None:
        out.append((key, state.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["key", "ends_sha256"])


def prefix_trie(sequences: DataFrame, cells: int = CELLS, shards: int | None = None) -> DataFrame:
    """The nodes of the trie over (conv_id, turns), conv_id unique: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = sequences.sparkSession
    scratch = Scratch(spark)
    flat = sequences.select("conv_id", F.flatten(F.transform("turns", lambda t: F.array(t["a"], t["b"]))).alias("ids"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    flat = scratch.stage(flat, "sequences", "zstd")  # read twice: for the bounds, and to be dealt out
    dealt = flat.repartitionByRange(shards or shuffle_partitions(spark), "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    nodes = scratch.stage(dealt.mapInArrow(shard_nodes(cells), SCHEMA), "nodes")
    parts = nodes.where(F.col("kind") == PART)
    sums = parts.select("key", "depth", "parent_key", "conv_id", *SUMS).union(corrections(nodes))
    sums = sums.groupBy("key", "depth").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in SUMS))
    ends = parts.where("ends IS NOT NULL").select("key", "shard", "block", "ends").repartition("key").sortWithinPartitions("key", "shard", "block")
    ends = ends.select("key", "ends").mapInArrow(hash_ends, "key binary, ends_sha256 string")
    boundary = scratch.stage(sums.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))), "boundary")
    columns = ["conv_id", "depth", "parent_conv_id", *SUMS, "ends_sha256"]
    whole = nodes.where(F.col("kind") == WHOLE)
    parents = boundary.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    rest = whole.where("parent_key IS NOT NULL").drop("parent_conv_id").select("parent_key", *(c for c in columns if c != "parent_conv_id"))
    rest = rest.union(boundary.select(*rest.columns)).join(parents, "parent_key", "left")
    return whole.where("parent_key IS NULL").select(*columns).union(rest.select(*columns))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: The same by prefixes as text; crc32 is worked out bit by bit.
ORACLE = """
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(4294967295, list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT),
           lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, y: xor(b // 2, (b % 2) * 3988292384)))) % 9 AS h,
         count(*) AS n
  FROM o GROUP BY conv_id),
r AS (
  SELECT c.conv_id, o.k AS d, o.role, o.text FROM c JOIN o ON o.conv_id = c.base AND o.k <= c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + o.k - c.h, o.role, o.text
  FROM c JOIN o ON o.conv_id = c.conv_id AND o.k > c.h LEFT JOIN c b ON b.conv_id = c.base),
p AS (
  SELECT conv_id, d, strlen(text) AS size, string_agg(md5(md5(role) || md5(text)), ',') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(d) AS len FROM p GROUP BY conv_id),
n AS (
  SELECT p.d, p.key, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(p.size) AS saved, bool_and(l.len = p.d) AS leaf,
         sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE l.len = p.d), '')) AS ends_sha256
  FROM p JOIN l USING (conv_id) GROUP BY p.d, p.key),
s AS (
  SELECT p.d, p.key, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE n.leaf) AS n_leaves, count(*) FILTER (WHERE n.d = p.d + 1) AS n_children
  FROM n JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.d, p.key)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.d = n.d AND s.key = n.key
LEFT JOIN p q ON q.conv_id = n.conv_id AND q.d = n.d - 1
LEFT JOIN n u ON u.d = q.d AND u.key = q.key
"""
