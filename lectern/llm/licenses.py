"""License scan: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates licence expressions.

A text is cut into words of lower-case letters, digits and other non-ASCII characters. The words, joined by single spaces,
run through one automaton that holds every phrase, so places are word numbers. Where the tag phrase is found, the raw text
behind the tag, up to the end of its line or the next tag, is read as a licence expression with AND, OR, WITH and parentheses.

An expression's value: an identifier is a set of labels with a restriction rank; OR and AND unite the labels of their
sides, OR takes the lower rank and AND the higher; WITH adds its exception to the licence on its left. `restriction` is the
highest rank among all that a text states. A malformed
expression gives the identifiers that were read up to the fault, at a lower score.

Defined results: null and empty texts have no words and no labels; repeated rows are scanned one by one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import ASCII_LOWER, documents, id_text, map_batches

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# The base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Further notice phrases and their labels.
NOTICE_PHRASES = {
    "gnu general public license version 3": "gpl-3", "gnu general public license version 2": "gpl-2", "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2", "mozilla public license v 2": "mpl-2", "eclipse public license": "epl", "bsd 3 clause": "bsd-3-clause", "bsd 2 clause": "bsd-2-clause",
    "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0 1 0": "cc0", "creative commons attribution": "cc-by",
    "all rights reserved": "proprietary", "isc license": "isc", "the unlicense": "unlicense", "boost software license": "bsl-1",
}
TAG = "spdx license identifier"
# Identifiers that expressions use, without version suffixes such as -only, -or-later and +.
IDENTIFIERS = {
    "mit": "mit", "apache-2.0": "apache-2", "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3", "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "agpl-3.0": "agpl-3", "mpl-2.0": "mpl-2", "epl-2.0": "epl", "bsd-2-clause": "bsd-2-clause",
    "bsd-3-clause": "bsd-3-clause", "isc": "isc", "unlicense": "unlicense", "bsl-1.0": "bsl-1", "cc0-1.0": "cc0", "cc-by-4.0": "cc-by", "cc-by-sa-4.0": "cc-by-sa", "cc-by-nc-4.0": "cc-by-nc", "cc-by-nd-4.0": "cc-by-nd",
}
#: Rank of a label in a choice: OR takes the smallest, AND the largest.
RESTRICTION = {"cc0": 0, "unlicense": 0, "mit": 1, "isc": 1, "bsd": 1, "bsd-2-clause": 1, "bsd-3-clause": 1, "bsl-1": 1, "cc-by": 1, "apache-2": 2, "mpl-2": 3, "epl": 3, "lgpl": 4, "cc-by-sa": 5, "gpl-2": 6, "gpl-3": 6, "agpl-3": 7, "cc-by-nd": 8, "cc-by-nc": 8, "proprietary": 9}
#: Confidence by kind of evidence.
CONFIDENCE = {"expression": 1.0, "base": 0.9, "notice": 0.8, "broken": 0.5}

TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+-]+)")
TAG_START = re.compile(r"spdx[\s_-]*license[\s_-]*identifier\s*:?[ \t]*", re.I)
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Reading:
    """All labels named, and the restriction rank that the whole expression asks for."""

    labels: set[str]
    rank: int
    whole: bool = True


def identifier(token: str) -> str:
    base = re.sub(r"(-only|-or-later|\+)$", "", token.lower())
    return IDENTIFIERS.get(base, base)


def parse_expression(text: str) -> Reading | None:
    """Shunting-yard over the longest readable beginning of `text`; None if it starts with no identifier."""
    output: list[Reading] = []
    operators: list[str] = []
    expect_operand, at, whole = True, 0, True

    def apply(op: str) -> None:
        nonlocal whole
        b, a = output.pop(), output.pop()
        if op == "with":
            # More than one exception is no valid expression: all that it names is kept, each name for itself.
            if len(b.labels) == 1:
                output.append(Reading({f"{x}-with-{y}" for x in a.labels for y in b.labels}, a.rank))
            else:
                output.append(Reading(a.labels | {f"with-{y}" for y in b.labels}, a.rank))
                whole = False
        else:
            # The smaller set goes into the larger one, so that long expressions do not copy their labels at each operator.
            few, many = sorted((a.labels, b.labels), key=len)
            many |= few
            output.append(Reading(many, min(a.rank, b.rank) if op == "or" else max(a.rank, b.rank)))

    while m := TOKEN.match(text, at):
        token = m[1].lower().rstrip(".") if m[1] not in "()" else m[1]
        if expect_operand:
            if token == "(":
                operators.append(token)
            elif token in PRECEDENCE or token == ")" or not token:
                break
            else:
                name = identifier(token)
                output.append(Reading({name}, RESTRICTION.get(name, 9)))
                expect_operand = False
        elif token in PRECEDENCE:
            while operators and operators[-1] != "(" and PRECEDENCE[operators[-1]] >= PRECEDENCE[token]:
                apply(operators.pop())
            operators.append(token)
            expect_operand = True
        elif token == ")" and "(" in operators:
            while operators[-1] != "(":
                apply(operators.pop())
            operators.pop()
        else:
            break
        at = m.end()
    if expect_operand and operators and operators[-1] in PRECEDENCE:
        operators.pop()
        whole = False
    while operators:
        op = operators.pop()
        if op == "(":
            whole = False
        elif len(output) > 1:
            apply(op)
    return Reading(output[0].labels, output[0].rank, whole) if output else None


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, phrases in (("notice", NOTICE_PHRASES), ("base", BASE_PHRASES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            out.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    out.make_automaton()
    return out


def scan(text: str, phrases: ahocorasick.Automaton) -> tuple[int, int, int | None, int | None, str, str, float, int | None, list[str]]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, restriction, expressions."""
    words = WORDS.findall(text.translate(ASCII_LOWER))
    line = f" {' '.join(words)} "
    base: set[str] = set()
    labels: set[str] = set()
    kinds: set[str] = set()
    starts: list[int] = []
    ranks: list[int] = []
    expressions: list[str] = []
    for end, (kind, label, size) in phrases.iter(line):
        kinds.add(kind)
        if kind == "tag":
            continue
        labels.add(label)
        ranks.append(RESTRICTION[label])
        if kind == "base":
            base.add(label)
            starts.append(end - size + 1)
    # Word numbers only where something was found: spaces before the phrase, less the leading one.
    first, last = ((line.count(" ", 0, f) for f in (min(starts), max(starts))) if starts else (None, None))
    if "tag" in kinds:
        kinds.discard("tag")
        tags = [m.span() for m in TAG_START.finditer(text)]
        for (_, start), (following, _) in zip(tags, [*tags[1:], (len(text), 0)]):
            value = text[start:following].split("\n", 1)[0]
            if reading := parse_expression(value):
                labels |= reading.labels
                ranks.append(reading.rank)
                expressions.append(value.strip())
                kinds.add("expression" if reading.whole else "broken")
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), max((CONFIDENCE[k] for k in kinds), default=0.0), max(ranks, default=None), expressions


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each input row, in one pass without a shuffle; `expressions` are the tag values as written."""
    state: list = []

    def run(batch: pa.RecordBatch):
        if not state:
            state.append(automaton())
        return [batch.column(0), *zip(*(scan(t, state[0]) for t in batch.column(1).to_pylist()))]

    return map_batches(id_text(docs), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, restriction int, expressions array<string>")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("expressions")
