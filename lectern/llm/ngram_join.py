"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

A document's set is its distinct `WIDTH`-word shingles. Equal sets are one class, joined through its smallest id. Classes are
then linked through signatures that any two similar sets share:

- Small sets emit every subset of the size that two sets of such sizes must have in common: equal subsets are links.
- Large sets go into inverted lists, under the shortest prefix (rare shingles first) in which similar sets must meet; the
  places in it bound the possible overlap before any set is read.

The boundary between small and large is the size at which all subsets cost less than the lists, both counted from the
sizes and list lengths at hand. Shingles found in many lists are moved to the end of the order; their number is bounded by
construction (at least `rows / MOST_COMMON` lists each). Links and components come from `linking.connect`.

Documents are told apart by a hash of id and text (`row_key`), so rows of one id with unlike texts are documents of their own.
Filters inside the scans are sized by the number of their members, up to FILTER_LIMIT; beyond it a scan passes everything and the
join that follows does the work.

Defined results: a null or empty text has an empty set and links with nothing; under `WIDTH` words the whole sequence is the
one shingle; repeated rows are equal sets. Counts hold up to collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import Scratch, documents, map_batches, row_key, window_hashes, word_hashes
from lectern.llm.linking import connect

WIDTH = 4
#: Similar: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Shingles that may be moved to the end of the order, 8 bytes each, and the least number of lists for one.
MOST_COMMON = 1_000_000
LEAST_LISTS = 16
#: Sets above this size always go into lists.
SMALL_LIMIT = 20
#: Bits of a set's parity sketch: two sets differ in as many shingles at least as their sketches in bits.
SKETCH = 1024
SKETCHES = [f"s{k}" for k in range(SKETCH // 64)]
#: Bits of a filter for each of its members, and the most bits of one (32 MB).
BITS_PER_MEMBER = 8
FILTER_LIMIT = 1 << 28


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of the shingles of one text."""
    return np.unique(window_hashes(word_hashes(words), min(width, len(words)))) if words else np.zeros(0, np.uint64)


def batch_shingles(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The shingle set of each text; all texts of the batch are hashed at once. bytes.lower() and split() are the contract's: A-Z and six separators."""
    words = [t.lower().split() for t in texts.cast(pa.binary()).to_pylist()]
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    hashes = window_hashes(word_hashes([w for own in words for w in own]), width)
    for own, n, end in zip(words, sizes.tolist(), ends.tolist()):
        yield np.unique(hashes[end - n : end - width + 1]) if n >= width else shingles(own, width)


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """The least overlap of similar sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def partners(size: int, percent: int = PERCENT) -> range:
    """The sizes that a similar set can have."""
    return range(-(-percent * size // 100), 100 * size // percent + 1)


def only_equal(size: int, percent: int = PERCENT) -> bool:
    """Whether a set of this size is similar to equal sets alone: no other size fits, and its own needs a whole overlap."""
    return all(t == size for t in partners(size, percent)) and needed(size, size, percent) == size


def prefix_length(size: int, percent: int = PERCENT) -> int:
    return size - -(-percent * size // 100) + 1


def subsets(size: int, limit: int, percent: int = PERCENT) -> int:
    return sum(comb(size, needed(size, t, percent)) for t in partners(size, percent) if t <= limit)


def choose_boundary(sizes: dict[int, int], per_list: float, percent: int = PERCENT) -> int:
    """The largest size of a small set, by cost: subsets emitted against list entries and the pairs they lead to."""
    best, cheapest = 0, float("inf")
    for limit in range(SMALL_LIMIT + 1):
        cost = sum(n * subsets(s, limit, percent) for s, n in sizes.items() if s <= limit)
        cost += sum(n * prefix_length(s, percent) * (1 + per_list) for s, n in sizes.items() if 100 * s >= percent * (limit + 1))
        if cost < cheapest:
            best, cheapest = limit, cost
    return best


def _signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.int64)


def keyed_text(docs: DataFrame) -> DataFrame:
    """doc_key and text; a null text reads as empty."""
    return docs.select(row_key().alias("doc_key"), F.coalesce("text", F.lit("")).alias("text"))


def sets_of(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, doc_key, n_shingles, set_key (128 bits), and the beginning of the set in hash order: a prefix and a little more."""

    def run(batch: pa.RecordBatch):
        sizes, keys, heads = [], [], []
        for s in batch_shingles(batch.column(1), width):
            sizes.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()))
            heads.append([] if only_equal(len(s), percent) else _signed(s[: prefix_length(len(s), percent) + 4]))
        return [batch.column(2), batch.column(0), sizes, keys, heads]

    texts = docs.select(row_key().alias("doc_key"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return map_batches(texts, run, "doc_id long, doc_key long, n_shingles long, set_key binary, head array<long>")


def signatures(docs: DataFrame, firsts: Filter, common: np.ndarray, boundary: int, shared: Filter | None = None, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """id, n, rank and the (key, pos) of each signature of the documents in the filter `firsts`; rank: how many shingles are
    rare (the fewer, the more central). With `shared`, only keys that this filter holds."""

    def small(s: np.ndarray) -> list[int]:
        with np.errstate(over="ignore"):
            mixed = [int(v) for v in (s ^ (s >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)]
        whole, out = sum(mixed), []
        for t in partners(len(s), percent):
            if t <= boundary:
                low, high = sorted((len(s), t))
                salt = xxhash.xxh3_64_intdigest(f"{low},{high}".encode())
                for gone in combinations(mixed, len(s) - needed(len(s), t, percent)):
                    out.append((whole - sum(gone) ^ salt) & (1 << 64) - 1)
        return out

    def run(batch: pa.RecordBatch):
        out: list[list] = [[] for _ in range(5)]
        picked = pa.array(np.flatnonzero(firsts.holds(batch.column(0).to_numpy())), pa.int64())
        for doc_id, s in zip(batch.column(0).take(picked).to_pylist(), batch_shingles(batch.column(1).take(picked), width)):
            n = len(s)
            if only_equal(n, percent):
                continue
            keys: list[np.ndarray] = []
            places: list[np.ndarray] = []
            rare = n
            if 100 * n >= percent * (boundary + 1):
                p = prefix_length(n, percent)
                often = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(n, bool)
                rare = int(n - often.sum())
                order = np.concatenate([s[~often][:p], s[often][: max(0, p - rare)]])
                keys.append(order)
                places.append(np.arange(len(order)))
            if n <= boundary:
                keys.append(np.array(small(s), np.uint64))
                places.append(np.zeros(len(keys[-1]), np.int64))
            key, place = np.concatenate(keys), np.concatenate(places).astype(np.int32)
            if shared is not None:
                both = shared.holds(_signed(key))
                key, place = key[both], place[both]
            if len(key):
                for column, v in zip(out, (doc_id, n, rare, _signed(key), place)):
                    column.append(v)
        return out

    return map_batches(keyed_text(docs), run, "id long, n long, rank long, keys array<long>, places array<int>")


class Filter:
    """A bitmap of numbers: holds() may be true of a few that were not put in, never false of one that was. None of them is kept beyond FILTER_LIMIT."""

    def __init__(self, numbers: DataFrame, column: str):
        count = numbers.count()
        self.bits = max(1 << 15, 1 << (BITS_PER_MEMBER * count - 1).bit_length())
        self.table: np.ndarray | None = None
        if self.bits > FILTER_LIMIT:
            return
        at = F.col(column).bitwiseAND(F.lit(self.bits - 1).cast("long")) + 1  # the bitmap functions number values from one
        parts = numbers.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
        self.table = np.zeros(self.bits // 8, np.uint8)
        for r in parts:
            self.table[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)

    def holds(self, numbers: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.ones(len(numbers), bool)
        at = numbers & np.int64(self.bits - 1)
        return (self.table[at >> 3] >> (at & 7)) & 1 == 1


def sketch(s: np.ndarray) -> np.ndarray:
    """Bit k: whether an odd number of shingles falls on it."""
    return np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)


def wanted_sets(docs: DataFrame, ids: DataFrame, width: int = WIDTH, sketches: bool = False) -> DataFrame:
    """id and the shingles, or n and the sketch (s0, s1, ...), of the documents in `ids` (id): the filter picks them inside the scan, a join drops its few errors."""
    wanted = Filter(ids, "id")

    def run(batch: pa.RecordBatch):
        picked = pa.array(np.flatnonzero(wanted.holds(batch.column(0).to_numpy())), pa.int64())
        sets = [*batch_shingles(batch.column(1).take(picked), width)]
        if not sketches:
            return [batch.column(0).take(picked), [_signed(s) for s in sets]]
        table = np.array([sketch(s) for s in sets], np.int64).reshape(-1, len(SKETCHES))
        return [batch.column(0).take(picked), [len(s) for s in sets], *table.T]

    columns = f"n long, {', '.join(f'{s} long' for s in SKETCHES)}" if sketches else "shingles array<long>"
    return map_batches(keyed_text(docs), run, f"id long, {columns}").join(ids, "id", "left_semi").dropDuplicates(["id"])


def grouped_rows(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, doc_key, n_shingles and `first` (doc_id, doc_key), the least of the rows reachable by links, the row itself included."""
    scratch = Scratch(docs.sparkSession)
    sets = scratch.stage(sets_of(docs, width, percent), "sets")
    classes = scratch.stage(sets.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_key").alias("id")), "classes")

    heads = sets.select(F.explode("head").alias("h"))
    lists = scratch.stage(heads.groupBy("h").agg(F.count(F.lit(1)).alias("lists")).where("lists > 1"), "lists")
    whole = sets.agg(F.sum(F.size("head"))).collect()[0][0] or 0
    shared = lists.agg(F.sum(F.least("lists", F.lit(LEAST_LISTS)))).collect()[0][0] or 0
    least = max(LEAST_LISTS, whole // MOST_COMMON)
    common = np.sort(lists.where(F.col("lists") >= least).select("h").toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64))  # at most MOST_COMMON
    sizes = {r["n_shingles"]: r["n"] for r in sets.where(f"n_shingles BETWEEN 1 AND {SMALL_LIMIT * 2}").groupBy("n_shingles").agg(F.count(F.lit(1)).alias("n")).collect()}
    boundary = choose_boundary(sizes, shared / max(whole, 1), percent)
    scratch.drop(lists)

    # Keys of one document alone make nearly all signatures: they are counted by hash, and only shared ones are kept.
    firsts = Filter(classes, "id")
    alone = signatures(docs, firsts, common, boundary, None, width, percent)
    several = scratch.stage(alone.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "several_keys")
    signed = signatures(docs, firsts, common, boundary, Filter(several, "key"), width, percent).join(classes.select("id"), "id", "left_semi").dropDuplicates(["id"])
    postings = signed.select("id", "n", "rank", F.explode(F.arrays_zip("keys", "places")).alias("s")).select(F.col("s.keys").alias("key"), "id", "n", "rank", F.col("s.places").alias("pos"))
    kept = scratch.stage(postings.join(several, "key", "left_semi"), "postings")
    scratch.drop(several)

    def fits(left, right):
        overlap = F.ceil(F.lit(percent) * (left("n") + right("n")) / (100 + percent))
        return (100 * F.least(left("n"), right("n")) >= percent * F.greatest(left("n"), right("n"))) & (F.least(left("n") - left("pos"), right("n") - right("pos")) >= overlap)

    sketches = scratch.stage(wanted_sets(docs, scratch.stage(kept.select("id").distinct(), "sharing"), width, True), "sketches")

    def close(left, right):
        """Sets that differ in d shingles share (n + n - d) / 2, and have (n + n + d) / 2 together."""
        d = sum((F.bit_count(left(s).bitwiseXOR(right(s))) for s in SKETCHES), F.lit(0))
        both = left("n") + right("n")
        return 100 * (both - d) >= percent * (both + d)

    def verify(pairs: DataFrame) -> DataFrame:
        """First by the sketches; the sets of what is left are made anew from the texts, so that only they move."""
        side = lambda to: sketches.select(*(F.col(c).alias(f"{to}_{c}") for c in sketches.columns))
        maybe = pairs.join(side("l"), F.col("a") == F.col("l_id")).join(side("r"), (F.col("b") == F.col("r_id")) & close(lambda c: F.col(f"l_{c}"), lambda c: F.col(f"r_{c}")))
        maybe = scratch.stage(maybe.select("a", "b"), "maybe")
        ids = scratch.stage(maybe.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        sets_ = scratch.stage(wanted_sets(docs, ids, width), "sets_wanted")
        one = lambda to, column: sets_.select(F.col("id").alias(to), F.col("shingles").alias(column))
        both = maybe.join(one("a", "x"), "a").join(one("b", "y"), "b")
        common_size = F.size(F.array_intersect("x", "y"))
        return both.where(100 * common_size >= percent * (F.size("x") + F.size("y") - common_size)).select("a", "b")

    labels = connect(kept, verify, fits, sketches.drop("n"), close, scratch=scratch, order="pos")
    found = classes.join(labels, "id", "left").select("set_key", F.coalesce("component", "id").alias("class"))
    rows = scratch.stage(sets.select("doc_id", "doc_key", "n_shingles", "set_key").join(found, "set_key", "left").select("doc_id", "doc_key", "n_shingles", "class"), "rows")
    firsts_ = rows.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc_id", "doc_key")).alias("first"))
    out = rows.join(firsts_, "class", "left").select("doc_id", "doc_key", "n_shingles", F.coalesce("first", F.struct("doc_id", "doc_key")).alias("first"))
    out = scratch.stage(out, "groups")
    scratch.drop_all_but(out)
    return out


def similar_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    return grouped_rows(docs, width, percent).select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one of smallest id (rows that repeat it stay with it); documents without words stay. All columns as they are."""
    groups = grouped_rows(docs, width, percent)
    gone = groups.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("doc_key") != F.col("first.doc_key"))).select("doc_key").distinct()
    return docs.join(gone, row_key(docs["doc_id"], docs["text"]) == gone["doc_key"], "left_anti")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON reach.r = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""
