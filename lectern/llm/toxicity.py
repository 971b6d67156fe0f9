"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, drops accents and zero-width characters, joins letters that signs keep apart, and reads look-alike letters
of other scripts (homoglyphs), digits and signs that stand for letters as those letters. The lexicon holds whole words and word beginnings; its weights are the log odds of a
term in toxic against other labelled rows. Each word counts once, with its heaviest term; words inside an exception phrase
don't count. The sum, and the sum over the length, go through a logistic curve that is fitted on the same labelled rows.

Defined results: a null or empty text has no words and gets the curve's value at zero; repeated rows are scored one by one;
labels of one doc_id that contradict each other count as toxic; with no labelled rows of one of the two classes the fixed
lexicon and a fixed curve are used.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import documents, id_text, map_batches

# Letters of other scripts, digits and signs, and the Latin letter each is read as.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "к": "k", "м": "m", "т": "t", "α": "a", "ο": "o", "ρ": "p", "υ": "u", "ν": "v", "ι": "i", "κ": "k", "ε": "e", "τ": "t"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
# Words that start the lexicon with weight 3, before any label is seen.
BASE_WORDS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "worthless", "pathetic", "disgusting", "clown")
# Phrases in which the words of the lexicon are harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "sore loser board", "pond scum", "soap scum", "not stupid", "not worthless")


@dataclass
class Folding(dict):
    """Code point to folded string; what isn't a letter becomes a space."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        # Letters without their marks; marks and zero-width characters alone leave nothing.
        parts = [p for p in unicodedata.normalize("NFKD", c.lower()) if unicodedata.category(p) not in ("Mn", "Me", "Cf")]
        letters = "".join(HOMOGLYPHS.get(p) or SUBSTITUTES.get(p) or p.lower() for p in parts)
        out = letters if not letters or letters.isalpha() else " "
        self[code] = out
        return out


#: Single letters that one sign each keeps apart.
SPELLED = re.compile(r"(?<!\w)(?:\w[.\-_*]){2,}\w(?!\w)")
BETWEEN = re.compile(r"[.\-_*]")
#: Signs that no letter follows end a word.
LOOSE_SIGNS = re.compile(r"[@$!]+(?!\w)")


def folded(text: str, table: Folding) -> str:
    """Letters in single-spaced words, with a space at both ends."""
    text = SPELLED.sub(lambda m: BETWEEN.sub("", m[0]), text)
    return f" {' '.join(LOOSE_SIGNS.sub(' ', text).translate(table).split())} "


@dataclass
class ToxicityModel:
    """term: weight (a term that ends with '*' matches word beginnings), and the logistic curve over `features`."""

    terms: dict[str, float] = field(default_factory=lambda: {w: 3.0 for w in BASE_WORDS})
    curve: tuple[float, ...] = (-3.0, 1.0, 20.0, 0.0)
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        keys: dict[str, float | None] = {}
        for term, weight in self.terms.items():
            keys[f" {term[:-1]}" if term.endswith("*") else f" {term} "] = weight
        for phrase in self.exceptions:
            keys[f" {phrase} "] = None
        out = ahocorasick.Automaton()
        for key, weight in keys.items():
            out.add_word(key, (len(key), weight))
        out.make_automaton()
        return out

    def score(self, feature_rows: np.ndarray) -> np.ndarray:
        z = self.curve[0] + feature_rows @ np.array(self.curve[1:])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(text: str, automaton: ahocorasick.Automaton, table: Folding) -> tuple[float, float, float]:
    """Weighted sum (dampened), weighted sum per square root of the words, and dampened length."""
    line = folded(text, table)
    hits: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(line):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif weight > hits.get(start, 0):
            hits[start] = weight
    total = sum(w for at, w in hits.items() if not any(a <= at < b for a, b in spared)) if spared else sum(hits.values())
    words = max(line.count(" ") - 1, 0)
    return math.log1p(total), total / math.sqrt(words + 1), math.log1p(words) / 10


#: Word beginnings of these lengths are terms beside whole words.
STEMS = (4, 5, 6, 7, 8)


def terms_of(text: str, table: Folding) -> set[str]:
    out: set[str] = set()
    for w in set(folded(text, table).split()):
        if len(w) <= 30:
            out.add(w)
            out.update(f"{w[:k]}*" for k in STEMS if len(w) > k)
    return out


def in_fold(doc_id: int | None) -> bool:
    """Rows that labels are never learned from."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """At most about `max_rows` labelled rows outside the held-out fold, chosen by a hash of the id. The bound makes the label side small enough to broadcast."""
    usable = labels.where(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    share = min(1.0, max_rows / max(1, usable.count()))
    few = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return id_text(docs).join(F.broadcast(few), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, max_terms: int = 400, min_weight: float = 1.5) -> ToxicityModel:
    """Lexicon weights and curve from at most about `max_rows` labelled rows; the lexicon has at most `max_terms` terms.

    Term counts are summed by Spark; only the chosen terms and a few numbers for each training row reach the driver."""
    rows = training_rows(docs, labels, max_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, n = Folding(), (Counter(), Counter()), [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seen[toxic == 1].update(terms_of(text, table))
                n[toxic == 1] += 1
        both = [*(seen[0] | seen[1])]
        yield pa.RecordBatch.from_arrays([pa.array(["", *both]), pa.array([n[1], *(seen[1][t] for t in both)], pa.int64()), pa.array([n[0], *(seen[0][t] for t in both)], pa.int64())], ["term", "toxic", "other"])

    counts = rows.mapInArrow(count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = counts.where((F.col("toxic") >= 3) | (F.col("term") == "")).persist()
    try:
        whole = counts.where("term = ''").collect()
        n_toxic, n_other = (whole[0]["toxic"], whole[0]["other"]) if whole else (0, 0)
        if not n_toxic or not n_other:
            return ToxicityModel()
        weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("other") + 0.5) / (n_other + 1.0))
        # Share of toxic rows times weight, so that neither rare nor weak terms crowd the lexicon.
        rank = F.col("toxic") / n_toxic * weight
        best = counts.where("term <> ''").select("term", weight.alias("weight"), rank.alias("rank")).where((F.col("weight") >= min_weight)).orderBy(F.desc("rank"), "term").limit(max_terms).collect()
    finally:
        counts.unpersist()
    model = ToxicityModel(terms={w: 3.0 for w in BASE_WORDS} | {r["term"]: float(r["weight"]) for r in best})
    found = rows.select("doc_id", "text", "toxic").mapInArrow(_feature_batches(model), "f0 double, f1 double, f2 double, toxic int").collect()
    x, y = np.array([r[:3] for r in found], float).reshape(-1, 3), np.array([r[3] == 1 for r in found], float)
    model.curve = tuple(float(v) for v in logistic(x, y))
    return model


def _feature_batches(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, table = model.automaton(), Folding()
        for batch in batches:
            x = [features(t, automaton, table) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in x], pa.float64()) for k in range(3)] + [batch.column(2).cast(pa.int32())], ["f0", "f1", "f2", "toxic"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method; bias first."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(a.T @ (a * s[:, None]) + ridge * np.eye(a.shape[1]), a.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1), predicted, held_out: one row for each input row, in one pass without a shuffle."""
    state: dict = {}

    def run(batch: pa.RecordBatch):
        if not state:
            state.update(automaton=model.automaton(), table=Folding())
        ids = batch.column(0).to_pylist()
        p = model.score(np.array([features(t, **state) for t in batch.column(1).to_pylist()], float).reshape(-1, 3))
        return [batch.column(0), [in_fold(i) for i in ids], p.tolist(), [int(v >= threshold) for v in p]]

    return map_batches(id_text(docs), run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose score is below `threshold`, all columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, table = model.automaton(), Folding()
        for batch in batches:
            x = np.array([features(t or "", automaton, table) for t in batch.column(at).to_pylist()], float).reshape(-1, 3)
            yield batch.filter(pa.array(model.score(x) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
