"""Secret scan with a trigram inverted index. DataFrame operations only on the data.

From the parse tree of each rule's pattern a Boolean trigram query is derived: the alternatives of literal text that a match
must hold, each as a set of trigrams in lower case (an OR of ANDs). The index holds (trigram, document) postings of the
trigrams that some query asks for. A rule's candidates are the documents whose postings intersect to one of its sets; only
their texts are read again, and only for the rules that ask, to verify the pattern. Rules without mandatory trigrams, such
as runs of hex digits, scan every text.

Postings and masks are aggregated by document before they move. The candidates' texts are picked by a broadcast of hash
buckets whose number is fixed, then by an exact join.

Defined results: null and empty texts have no spans; rows that repeat a doc_id are told apart by a hash of their text, and
equal rows get equal results. Matches of one rule never overlap; spans of different rules may.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import documents, stage


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and how long the match (or one group of it) has to be."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False


# The base rules in the order they are listed, then further rules for tokens of well-known forms.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]{24,}", 24, 0, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: Stands for text of unknown content inside an alternative.
GAP = "\0"
#: Alternatives kept for a pattern, and characters of a class that are told apart.
MOST_ALTERNATIVES, MOST_CHARACTERS = 64, 6
#: Rows of the broadcast that picks candidate texts.
BUCKETS = 1 << 20


def alternatives(pattern: str) -> set[str]:
    """What every match holds, as alternatives of literal text in lower case with gaps."""
    return _sequence(_parser.parse(pattern))


def _sequence(nodes) -> set[str]:
    out = {""}
    for node in nodes:
        step = _node(*node)
        out = {a + b for a in out for b in step} if len(out) * len(step) <= MOST_ALTERNATIVES else {a + GAP for a in out}
    return out


def _node(op, value) -> set[str]:
    if op is sre.LITERAL:
        return {chr(value).lower()}
    if op is sre.IN:
        chars: set[str] = set()
        for kind, v in value:
            if kind is sre.LITERAL:
                chars.add(chr(v).lower())
            elif kind is sre.RANGE and v[1] - v[0] < MOST_CHARACTERS:
                chars.update(chr(c).lower() for c in range(v[0], v[1] + 1))
            else:
                return {GAP}
        return chars if 0 < len(chars) <= MOST_CHARACTERS else {GAP}
    if op is sre.SUBPATTERN:
        return _sequence(value[3])
    if op is sre.BRANCH:
        return set().union(*(_sequence(v) for v in value[1]))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = value
        if most == 1:
            return {"", *_sequence(inner)} if least == 0 else _sequence(inner)
        return {a + GAP for a in _sequence(inner)} if least else {GAP}
    return {""} if op is sre.AT else {GAP}


def trigram_query(pattern: str) -> frozenset[frozenset[str]] | None:
    """An OR of ANDs of trigrams that every match fulfils; None if some match needs no trigram."""
    clauses = {frozenset(part[i : i + 3] for part in text.split(GAP) for i in range(len(part) - 2)) for text in alternatives(pattern)}
    if frozenset() in clauses:
        return None
    return frozenset(c for c in clauses if not any(other < c for other in clauses))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram number, row) for the given trigrams."""
    low = docs.select("doc_id", "text_hash", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams))))
    return low.select("doc_id", "text_hash", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, frozenset[frozenset[str]]], trigrams: list[str]) -> DataFrame:
    """doc_id, text_hash and the mask of rules of which a clause's postings all meet there."""
    number = {t: k for k, t in enumerate(trigrams)}
    wanted = [(number[t], clause_no, rule, 1 << k, (1 << len(clause)) - 1) for clause_no, (rule, clause) in enumerate((r, c) for r, q in sorted(queries.items()) for c in sorted(map(sorted, q))) for k, t in enumerate(clause)]
    lookup = index.sparkSession.createDataFrame(wanted, "trigram int, clause int, rule int, bit long, full long")  # a row for each trigram of a rule
    met = index.join(F.broadcast(lookup), "trigram").groupBy("doc_id", "text_hash", "clause", "rule", "full").agg(F.bit_or("bit").alias("bits")).where("bits = full")
    return met.groupBy("doc_id", "text_hash").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def spans(rule: Rule, number: int, text: Column) -> Column:
    """array<struct<start, rule, end>> of a rule's matches, leftmost and without overlap, in code points. What lies between matches tells where they are."""
    pattern = F.lit(rule.pattern)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rule:int,end:int>>").alias("out"))
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["gap"])
        end = begin + F.coalesce(F.length(p["found"]), F.lit(0))
        own = F.struct(begin.alias("start"), F.lit(number).alias("rule"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(p["part"]) >= max(rule.least, 1), F.array_append(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    # Most texts have no match: the cheap test comes first.
    return F.when(text.rlike(rule.pattern), F.aggregate(parts, start, step)["out"]).otherwise(F.array().cast("array<struct<start:int,rule:int,end:int>>"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, array<struct<start, rule, end>> by start, then rule; one row for each input row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    asked = {k: trigram_query(r.pattern) for k, r in enumerate(rules)}
    queries = {k: q for k, q in asked.items() if q is not None}
    trigrams = sorted({t for q in queries.values() for clause in q for t in clause})
    index = stage(postings(rows, trigrams), "postings")
    masks = stage(candidates(index, queries, trigrams), "masks")
    bucket = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(BUCKETS))
    few = masks.select(bucket.alias("bucket")).distinct()  # at most BUCKETS rows
    some = rows.withColumn("bucket", bucket).join(F.broadcast(few), "bucket", "left_semi").select("doc_id", "text_hash", "text")
    verified = F.concat(*(F.when(F.col("rules").bitwiseAND(F.lit(1 << k).cast("long")) != 0, spans(rules[k], k, F.col("text"))).otherwise(F.array().cast("array<struct<start:int,rule:int,end:int>>")) for k in queries))
    checked = some.dropDuplicates(["doc_id", "text_hash"]).join(masks, ["doc_id", "text_hash"]).select("doc_id", "text_hash", verified.alias("verified")).where(F.size("verified") > 0)
    scanned = rows.select("doc_id", "text_hash", F.concat(*(spans(r, k, F.col("text")) for k, r in enumerate(rules) if k not in queries)).alias("scanned"))
    both = scanned.join(stage(checked, "verified"), ["doc_id", "text_hash"], "left")
    return both.select("doc_id", F.sort_array(F.when(F.col("verified").isNull(), F.col("scanned")).otherwise(F.concat("scanned", "verified"))).alias("spans"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.lit(r.kind) for r in RULES))
    base = len([r for r in RULES if r.base])
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["rule"] == k)).cast("long").alias(f"n_{RULES[k].kind}")
    return find_secrets(documents(spark, sf_dir)).select("doc_id", *(count(k) for k in range(base)), F.sha2(text(F.filter("spans", lambda s: s["rule"] < base)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def oracle() -> str:
    """The same spans in SQL: every rule scans every text."""
    quoted = lambda t: t.replace("'", "''")
    one = "SELECT doc_id, {k} AS rule, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {g}) AS part, regexp_split_to_array(t, '{p}') AS gap, {least} AS least FROM d"
    rules = " UNION ALL ".join(one.format(k=k, kind=r.kind, p=quoted(r.pattern), g=r.group, least=max(r.least, 1)) for k, r in enumerate(RULES))
    base = len([r for r in RULES if r.base])
    counts = ", ".join(f"count(*) FILTER (rule = {k}) AS n_{RULES[k].kind}" for k in range(base))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), r AS ({rules}), i AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM r),
s AS (SELECT doc_id, rule, kind, CAST(list_sum(list_transform(gap[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[k]) AS n FROM i WHERE length(part[k]) >= least),
g AS (SELECT doc_id, {counts}, coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rule) FILTER (rule < {base}), '') AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rule) AS spans FROM s GROUP BY 1)
SELECT d.doc_id, {", ".join(f"coalesce(n_{RULES[k].kind}, 0) AS n_{RULES[k].kind}" for k in range(base))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""
