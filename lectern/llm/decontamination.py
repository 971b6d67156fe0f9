"""Benchmark decontamination by template canonicalisation.

A text becomes a template: its words in lower case, with numbers, names and units replaced by typed placeholders. Windows of
`WINDOW` template words are hash-joined with those of the benchmark items, so a question whose numbers or names were
changed still meets its source. A capitalised word that begins a sentence or a line may be a name or not: both readings of
its windows are looked up, on both sides. Every window is looked up by its raw words too, so that exact copies are always
found, also where too few words are literal for a template. Windows that lie on one alignment (document position less item position) then have to agree
on their slots: what stands for one value of the item must be the same throughout (a window that meets only by a possible
name is left out alone if it does not agree). An item is leaked into a document when windows of agreeing alignments cover at
least `COVERAGE` of the item's windows with enough literal words, or of all its windows.

The benchmark's window hashes are looked up inside the scan where they are few (their number is checked); beyond that bound
every window of the corpus is joined by hash.

Defined results: null and empty texts match nothing; items without a window of enough literal words match exact copies; a
shorter item is one window of its own length; repeated rows of a document or an item count as one. Rows of one id with unlike
texts are judged each on its own, of documents as of items; find_leaks then reports the best covered of a (doc_id, item_id).
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import documents, id_text, map_batches, row_key, stage, window_hashes, word_hashes

WINDOW = 5
COVERAGE = 0.8
#: Literal words that a window needs.
LITERALS = 3
#: Benchmark windows that may be looked up inside the scan: 8 bytes each.
LOOKUP_LIMIT = 2_000_000

#: A capital letter and small ones, not within a word.
NAME = re.compile(r"[A-ZÀ-ÖØ-Þ](?<![^\W_][A-ZÀ-ÖØ-Þ])[a-zß-öø-ÿ]+")
#: A point or comma between digits is part of the number.
POINT = re.compile(r"([0-9])[.,](?=[0-9])")
#: Signs beyond ASCII that are no part of a word.
SIGNS = re.compile(r"[\u00a0-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u2000-\u206f\u3000-\u303f]")
ASCII_SIGNS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
# Number words and units.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion eins zwei drei vier fünf sechs sieben acht neun zehn deux trois quatre cinq sept huit neuf dix dos tres cuatro cinco seis siete ocho nueve diez".split())
UNITS = frozenset("kg g mg km m cm mm mi ft yd lb oz l ml s ms min h hr hrs hour hours minute minutes second seconds day days week weeks year years dollar dollars usd eur euro euros pound pounds percent meter meters metre metres mile miles gram grams kilogram kilograms liter liters litre litres celsius fahrenheit".split())
#: Marks before a name, before a possible name, and for the point of a number: letters that no text is expected to hold.
SURE, MAYBE, DOT = "\ue000", "\ue001", "\ue002"
LITERAL, NUMBER, PERSON, UNIT, POSSIBLE = range(5)
MARKS = {SURE.encode(): PERSON, MAYBE.encode(): POSSIBLE}
SLOT_WORDS = {w.encode(): NUMBER for w in NUMBER_WORDS} | {w.encode(): UNIT for w in UNITS}
DIGITS = frozenset(b"0123456789")
#: Hashes of the placeholders, by kind, and what tells raw windows from templates.
SLOT_HASHES = np.array([0, 0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xFF51AFD7ED558CCD], np.uint64)
RAW = np.uint64(0xC4CEB9FE1A85EC53)


def words_of(text: str) -> list[bytes]:
    """The lower-case words of a text."""
    text = POINT.sub(rf"\1{DOT}", text)
    return (text if text.isascii() else SIGNS.sub(" ", text)).lower().encode().translate(ASCII_SIGNS).split()


def read_words(text: str) -> tuple[list[bytes], list[int]]:
    """The words of a text and the kind of each."""

    def mark(m: re.Match) -> str:
        at = m.start()
        before = text[at - 2 : at - 1] if at > 1 and text[at - 1] == " " else ""
        return (SURE if before.isalnum() or before == "," else MAYBE) + m[0]

    words, kinds = words_of(NAME.sub(mark, text)), []
    for k, w in enumerate(words):
        kind = MARKS.get(w[:3], LITERAL) if w[0] == 0xEE else NUMBER if w[0] in DIGITS else SLOT_WORDS.get(w, LITERAL)
        if kind >= PERSON and w[0] == 0xEE:
            words[k] = w = w[3:]
            if kind == POSSIBLE:  # a number or a unit is one at the beginning, too
                kind = SLOT_WORDS.get(w, POSSIBLE)
        kinds.append(kind)
    return words, kinds


def readings(words: list[bytes], kinds: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray, tuple[int, ...] | None]]:
    """(positions, hashes, places of possible names that are read as names) for each reading of the windows; None for the raw words."""
    n = len(words) - size + 1
    if n < 1:
        return []
    codes = word_hashes(words)
    out = [(np.arange(n), window_hashes(codes ^ RAW, size), None)]
    slots = (kinds > LITERAL) & (kinds < POSSIBLE)
    codes = np.where(slots, SLOT_HASHES[np.where(slots, kinds, 0)], codes)
    literal, least = np.convolve(~slots, np.ones(size, int), "valid"), min(LITERALS, size)
    possible = kinds == POSSIBLE
    for names in range(size - least + 1):
        for places in combinations(range(size), names):
            at = np.flatnonzero((literal - names >= least) & np.logical_and.reduce([possible[k : k + n] for k in places] or [np.ones(n, bool)]))
            # Each window's codes lie behind each other, so that every `size`-th hash is a window's own.
            own = np.stack([np.full(len(at), SLOT_HASHES[PERSON]) if k in places else codes[at + k] for k in range(size)], 1).ravel()
            if len(at):
                out.append((at, window_hashes(own, size)[::size], places))
    return out


def values(words: list[bytes], kinds: list[int], at: int, size: int, places: tuple[int, ...] | None) -> list[str]:
    """What stands at the placeholders of a window, in a reading of it."""
    return [words[at + k].decode() for k in range(size) if LITERAL < kinds[at + k] < POSSIBLE or places and k in places]


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """The readings of the item's windows, raw ones included; n_windows of them have enough literal words (typed), n_all there are; a short item has one window of its own length."""

    def run(batch: pa.RecordBatch):
        out: list[list] = [[] for _ in range(11)]
        for item, text, key in zip(*(c.to_pylist() for c in batch.columns)):
            words, kinds = read_words(text)
            width = min(size, len(words))
            found = readings(words, np.array(kinds), width) if width else []
            typed = {at for ats, _, places in found if places == () for at in ats.tolist()}
            for ats, hashes, places in found:
                for at, h in zip(ats.tolist(), hashes.astype(np.int64).tolist()):
                    for column, v in zip(out, (item, key, at, width, h, values(words, kinds, at, width, places), places is None, len(places or ()), at in typed, len(typed), len(words) - width + 1)):
                        column.append(v)
        return out

    items = id_text(benchmark, "item_id").distinct()
    return map_batches(items.withColumn("key", row_key()), run, "item_id long, item_key long, item_at int, width int, h long, item_values array<string>, raw boolean, item_names int, typed boolean, n_windows int, n_all int")


def document_windows(docs: DataFrame, widths: list[int], lookup: np.ndarray | None) -> DataFrame:
    """doc_id, doc_key, doc_at, h, doc_values, doc_names (possible names read as names) of the windows in `lookup`, or of all."""
    # One byte for each of 4M hash values answers for nearly all windows that match nothing.
    table = np.full(1 << 22, lookup is None)
    if lookup is not None:
        table[(lookup & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def run(batch: pa.RecordBatch):
        out: list[list] = [[] for _ in range(6)]
        found = [read_words(t) for t in batch.column(1).to_pylist()]
        starts = np.cumsum([0, *(len(words) for words, _ in found)])
        every = [w for words, _ in found for w in words]
        kinds = np.array([k for _, own in found for k in own], np.int64)
        ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for width in widths:
            for ats, h, places in readings(every, kinds, width):
                among = table[(h & np.uint64((1 << 22) - 1)).astype(np.int64)]
                ats, h = ats[among], h[among]
                if lookup is not None:
                    among = np.isin(h, lookup)
                    ats, h = ats[among], h[among]
                row = np.searchsorted(starts, ats, "right") - 1
                inside = ats + width <= starts[row + 1]  # not across two texts
                for k, r, code in zip(ats[inside].tolist(), row[inside].tolist(), h[inside].astype(np.int64).tolist()):
                    own = k - int(starts[r])
                    for column, v in zip(out, (ids[r], keys[r], own, code, values(*found[r], own, width, places) if places is not None else [], len(places or ()))):
                        column.append(v)
        return out

    return map_batches(id_text(docs).withColumn("key", row_key()), run, "doc_id long, doc_key long, doc_at int, h long, doc_values array<string>, doc_names int")


def leaks_by_row(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, coverage: float = COVERAGE, lookup_limit: int = LOOKUP_LIMIT) -> DataFrame:
    """One row for each distinct text of a doc_id (doc_key) and of an item_id that is leaked into it: windows covered, windows of the item, coverage, and whether slots differ from the item's."""
    items = stage(item_windows(benchmark, size), "benchmark_windows")
    widths = [r["width"] for r in items.select("width").distinct().collect()]  # at most `size` numbers
    lookup = None
    if items.count() <= lookup_limit:
        lookup = np.array(sorted({r["h"] for r in items.select("h").distinct().collect()}), np.int64).astype(np.uint64)
        lookup.sort()
    hits = stage(document_windows(docs, widths, lookup).join(items, "h").withColumn("shift", F.col("doc_at") - F.col("item_at")), "hits")
    pair = ["doc_id", "doc_key", "item_id", "item_key"]
    # A raw window holds the item's own words. Of a window's readings the one with the fewest possible names counts.
    reading = F.struct(F.greatest("item_names", "doc_names").alias("names"), "item_values", F.when(F.col("raw"), F.col("item_values")).otherwise(F.col("doc_values")).alias("doc_values"))
    rows = hits.groupBy(*pair, "shift", "item_at", "typed", "n_windows", "n_all").agg(F.min(reading).alias("r")).select(*pair, "shift", "item_at", "typed", "n_windows", "n_all", "r.*")
    slots = rows.where(F.size("item_values") > 0).select(*pair, "shift", "names", F.explode(F.arrays_zip("item_values", "doc_values")).alias("s"))
    sure = F.when(F.col("names") == 0, F.col("s.doc_values"))
    tears = slots.groupBy(*pair, "shift", F.col("s.item_values").alias("value")).agg((F.min("s.doc_values") != F.max("s.doc_values")).alias("any"), F.coalesce(F.min(sure) != F.max(sure), F.lit(False)).alias("sure")).where("any")
    # Alignments on which one item value stands against two document values are out; if only possible names say so, their windows are.
    torn = tears.groupBy(*pair, "shift").agg(F.max("sure").alias("out"), F.collect_set("value").alias("torn"))
    good = rows.join(torn, [*pair, "shift"], "left").where("torn IS NULL OR NOT out AND (names = 0 OR NOT arrays_overlap(torn, item_values))")
    changed = F.max((F.col("item_values") != F.col("doc_values")).cast("int")) == 1
    per_window = good.groupBy(*pair, "n_windows", "n_all", "item_at", "typed").agg(changed.alias("changed"))
    out = per_window.groupBy(*pair, "n_windows", "n_all").agg(F.sum(F.col("typed").cast("long")).alias("typed"), F.count(F.lit(1)).alias("found"), F.max("changed").alias("reparameterised"))
    enough = (F.col("n_windows") > 0) & (F.col("typed") >= coverage * F.col("n_windows"))
    out = out.where(enough | (F.col("found") >= coverage * F.col("n_all")))
    out = out.select(*pair, F.when(enough, F.col("typed")).otherwise(F.col("found")).alias("covered"), F.when(enough, F.col("n_windows")).otherwise(F.col("n_all")).cast("long").alias("n_windows"), "reparameterised")
    return out.select(*pair, "covered", "n_windows", (F.col("covered") / F.col("n_windows")).alias("coverage"), "reparameterised")


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, coverage: float = COVERAGE, lookup_limit: int = LOOKUP_LIMIT) -> DataFrame:
    """One row for each (doc_id, item_id) that is leaked: covered, n_windows, coverage, reparameterised."""
    found = leaks_by_row(docs, benchmark, size, coverage, lookup_limit)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "covered", "n_windows", "reparameterised")).alias("b"))
    return best.select("doc_id", "item_id", "b.covered", "b.n_windows", "b.coverage", "b.reparameterised")


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows into whose text no item is leaked, all columns as they are."""
    leaked = stage(leaks_by_row(docs, benchmark).select("doc_key").distinct(), "leaked")
    return docs.join(leaked, row_key(docs["doc_id"], docs["text"]) == leaked["doc_key"], "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
