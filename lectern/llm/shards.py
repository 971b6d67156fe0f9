"""Training-order materialisation: token sequences of one length, written in a keyed random order as fixed-stride shards.

The documents' ids, each closed by an id, form one stream that is cut into sequences of `length` ids; the last one is
filled up. A keyed Feistel permutation over the number of sequences, with cycle-walking, gives each its global slot: the
order is a function of key and count alone, needs no sort key to be stored, and can be inverted. Slots are dealt to shards
in ranges; each shard is a file of ids in slot order, so slot s lies at a byte that follows from s: reads are sequential
and can resume anywhere.

The ids are written once, with each document's place in its input partition; the partitions' totals, one number each, then
give every document its place in the stream, and the written ids are cut and sent to their shards. A shard is written beside its
place and then renamed, so a repeated task leaves one whole file.

Defined results: a null or empty text adds the closing id only; repeated rows add their ids again; an empty table writes
no shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.common import bounded, documents, id_text, shared_folder, shuffle_partitions, stage

ROUNDS = 6
MASK = (1 << 64) - 1


def mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mixing function."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & MASK)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _feistel(x: np.ndarray, half: int, key: int, back: bool) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & low
    for r in range(ROUNDS)[:: -1 if back else 1]:
        if back:
            left, right = right ^ (mix(left, key * 31 + r) & low), left
        else:
            left, right = right, left ^ (mix(right, key * 31 + r) & low)
    return left << np.uint64(half) | right


def permute(numbers: np.ndarray, count: int, key: int, back: bool = False) -> np.ndarray:
    """The slot of each number below `count` (or, back, the number at each slot): a permutation of range(count)."""
    half = max(1, -(-max(count - 1, 1).bit_length() // 2))
    out = np.asarray(numbers).astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():  # a value beyond the count walks on along its cycle
        out[todo] = _feistel(out[todo], half, key, back)
        todo = out >= np.uint64(count)
    return out.astype(np.int64)


def materialise(docs: DataFrame, folder: str, tokenizer: str, length: int = 2048, key: int = 20, sequences_per_shard: int | None = None, close: int = 0, fill: int = 0, dtype: str = "<u2") -> DataFrame:
    """Write the shards under `folder` (by default 64 of them, or as many as 65,536 sequences each make), and return one row for each sequence: slot, sequence, shard, n_ids (without filling), crc32 of its bytes."""
    spark, width = docs.sparkSession, np.dtype(dtype).itemsize
    end = np.array([close], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in bounded(batches):
            ids = [tokens.encode(t, tokenizer) + end for t in batch.column(0).to_pylist()]
            wide = np.frombuffer(b"".join(ids), "<u4")
            if len(wide) and wide.max() > np.iinfo(dtype).max:
                raise ValueError(f"id {wide.max()} does not fit {dtype}")
            own = wide.astype(dtype).tobytes()
            bounds = np.cumsum([0, *(len(v) // 4 for v in ids)])
            places = (bounds * width).tolist()
            starts, at = at + bounds[:-1], at + int(bounds[-1])
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array([own[a:b] for a, b in zip(places, places[1:])], pa.binary())], ["part", "start", "ids"])

    coded = stage(id_text(docs).select("text").mapInArrow(encode, "part int, start long, ids binary"), "ids", "zstd")
    counted = {r["part"]: r["n"] for r in coded.groupBy("part").agg(F.sum(F.length("ids") / width).cast("long").alias("n")).collect()}  # one row for each input partition
    starts, total = {}, 0
    for part in sorted(counted):
        starts[part] = total
        total += counted[part]
    sequences = -(-total // length)
    sequences_per_shard = sequences_per_shard or min(65_536, max(1, -(-sequences // 64)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, bytes]] = []
            for part, start, ids in zip(*(c.to_pylist() for c in batch.columns)):
                at, done = starts[part] + start, 0
                while done < len(ids):
                    own = ids[done : done + (length - at % length) * width]
                    # Neighbouring documents of one sequence travel as one piece.
                    if found and found[-1][0] == at // length and found[-1][1] + len(found[-1][2]) // width == at % length:
                        found[-1] = (*found[-1][:2], found[-1][2] + own)
                    else:
                        found.append((at // length, at % length, own))
                    at += len(own) // width
                    done += len(own)
            sequence = np.array([f[0] for f in found], np.int64)
            slot = permute(sequence, sequences, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot // sequences_per_shard), pa.array(slot), pa.array(sequence), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary())], ["shard", "slot", "sequence", "offset", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        out, shard, temp = None, None, ""
        open_slot, parts, number = None, [], 0
        report: list[tuple[int, int, int, int, int]] = []

        def flush() -> None:
            if open_slot is not None:
                body = b"".join(parts)
                n = len(body) // width
                body += np.full(length - n, fill, dtype).tobytes()
                out.write(body)
                report.append((open_slot, number, shard, n, zlib.crc32(body)))

        def close_shard() -> None:
            if out is not None:
                out.close()
                if store.get_file_info(shard_path(root, shard)).type != fs.FileType.NotFound:
                    store.delete_file(shard_path(root, shard))
                store.move(temp, shard_path(root, shard))

        for batch in batches:
            for k, slot, sequence, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if slot != open_slot:
                    flush()
                    if k != shard:
                        close_shard()
                        temp = f"{shard_path(root, k)}.{TaskContext.get().taskAttemptId()}.part"
                        out = store.open_output_stream(temp)
                    shard, open_slot, number, parts = k, slot, sequence, []
                parts.append(ids)
            if len(report) > 1000:
                yield _report(report)
                report = []
        flush()
        close_shard()
        if report:
            yield _report(report)

    def _report(report: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*report)], ["slot", "sequence", "shard", "n_ids", "crc32"])

    spark.createDataFrame([(length, width, sequences_per_shard, sequences, key)], "length int, width int, sequences_per_shard int, sequences long, key long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/layout")
    shards = -(-sequences // sequences_per_shard)
    tasks = max(1, min(shards, 4 * shuffle_partitions(spark)))
    dealt = coded.mapInArrow(cut, "shard long, slot long, sequence long, offset int, ids binary").repartitionById(tasks, (F.col("shard") % tasks).cast("int")).sortWithinPartitions("slot", "offset")
    manifest = f"{folder}/manifest"
    dealt.mapInArrow(write, "slot long, sequence long, shard long, n_ids long, crc32 long").write.mode("overwrite").parquet(manifest)
    return spark.read.schema("slot long, sequence long, shard long, n_ids long, crc32 long").parquet(manifest)


def shard_path(root: str, shard: int) -> str:
    return f"{root}/shard-{shard:08d}.bin"


def read_slots(folder: str, first: int, count: int) -> Iterator[np.ndarray]:
    """Sequences at slots first, first + 1, ...: each shard is opened once and read in order from the first slot asked for. The layout is read from the folder."""
    from pyarrow import dataset, fs

    store, root = fs.FileSystem.from_uri(folder)
    layout = dataset.dataset(f"{root}/layout", filesystem=store, format="parquet").to_table().to_pylist()[0]
    stride, per_shard = layout["length"] * layout["width"], layout["sequences_per_shard"]
    while count:
        shard, at = divmod(first, per_shard)
        some = min(count, per_shard - at)
        with store.open_input_file(shard_path(root, shard)) as f:
            f.seek(at * stride)
            for _ in range(some):
                yield np.frombuffer(f.read(stride), f"<u{layout['width']}")
        first, count = first + some, count - some


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(documents(spark, sf_dir), f"{shared_folder(spark)}/shards", tokens.default_path())
