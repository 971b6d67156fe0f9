"""Personal data: high-recall generators propose overlapping spans, boosted trees judge them by format and context.

Base rules (e-mail, IP, card, phone) always stand. The generators propose far more: any digit chain, defanged or spelled-out
address, account number. No labelled spans exist, so the trees learn forms that the base rules can't give: the base spans of a
bounded sample of documents are rewritten in place (`perturb`: "[at]" and "[dot]", defanged IPs, other separators, phones
without "+"), and the candidate that covers such a span is an example of personal data. Other candidates of these documents
are counter-examples, and so are rewritten spans whose digits no longer pass the check of a card; candidates after a cue word
are unclear and left out. Probabilities are calibrated on a held-out part; for each kind the lowest bound with the asked
precision is chosen, and candidates above it that touch no chosen span are added, best first.

Defined results: null and empty texts have no spans; repeated rows are scanned one by one; with no examples of one of the
two classes nothing is added to the base spans.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import boosting
from lectern.llm.common import documents, id_text, map_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where its run of digits starts; saying so keeps very long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The generators' patterns by the kind they propose.
GENERATORS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+[\x20]?(?:\[at\]|\(at\)|@)[\x20]?[A-Za-z0-9-]+(?:[\x20]?(?:\[dot\]|\(dot\)|\.)[\x20]?[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9.])[0-9]+(?:(?:\.|\[\.\]|\(\.\))[0-9]+){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])[+(]?[0-9](?:[\x20().-]{0,3}[0-9]){6,15}(?![0-9])"),
}
# Words before a span that speak for personal data.
CUES = re.compile(r"(?i)\b(phone|tel|call|mobile|fax|card|visa|account|konto|iban|mail|contact|ip|addr|host|server|telefon|correo|courriel)")
#: Rewritten forms of each base span.
FORMS = 8
FEATURES = ("spelled", "length", "digits", "groups", "longest_group", "separators", "plus", "parens", "luhn", "parts_ok", "at_sign", "cue", "digits_around", "letters_touching", "hex_touching", "is_email", "is_ip", "is_card", "is_phone")


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[-1::-2]]
    even = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(odd) + sum(v - 9 if v > 9 else v for v in even)) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the e-mail pattern matches, leftmost and without overlap, in linear time: each '@' with the run before it."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    out["email"] = [*emails(text)]
    out["ip"] = [m.span() for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the generators propose; spans of different kinds may overlap."""
    return [(kind, *m.span()) for kind, pattern in GENERATORS.items() if kind != "email" or "@" in text or "at" in text for m in pattern.finditer(text)]


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 24]
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    touch = before[-1:] + after[:1]
    return [
        sum(span.count(t) for t in ("[at]", "(at)", "[dot]", "(dot)", "[.]", "(.)")), end - start, len(digits), len(groups), max(map(len, groups), default=0), sum(not c.isalnum() for c in span), span.startswith("+"), "(" in span, len(digits) > 1 and luhn(digits),
        len(groups) == 4 and all(map(_small, groups)), "@" in span, bool(CUES.search(before)), sum(c.isdigit() for c in before + after), sum(c.isalpha() for c in touch), sum(c in "abcdef0123456789" for c in touch), *(kind == k for k in KINDS),
    ]


@dataclass
class PiiModel:
    """The trees, the calibration line over their margin, and the least probability for each kind (over 1: none is added)."""

    trees: boosting.Booster = field(default_factory=boosting.Booster)
    line: tuple[float, float] = (0.0, 1.0)
    least: dict[str, float] = field(default_factory=lambda: {k: 2.0 for k in KINDS})

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.line[0] + self.line[1] * self.trees.margin(x), -30, 30)))


def perturb(kind: str, span: str, pick: int) -> str:
    """A base span in a form that the base rules don't take; `pick` chooses among the forms."""
    if kind == "email":
        name, _, domain = span.partition("@")
        at, dot = ((" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" @ ", "."), ("@", " [dot] "))[pick % 5]
        return name + at + domain.replace(".", dot)
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return span.replace(".", ("[.]", "(.)")[pick % 2])
    if kind == "card":
        return ("./"[pick % 2]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    local = digits[-10:]
    return (f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"00{digits[:2]} {digits[2:5]} {digits[5:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}")[pick % 4]


def examples(text: str, salt: int) -> Iterator[tuple[int, list[float], bool]]:
    """A hash, the features and the class of each example that a text gives."""
    base = base_spans(text)
    every = [span for spans in base.values() for span in spans]
    for kind, a, b in candidates(text):
        if not CUES.search(text[max(0, a - 24) : a]) and not any(a < e and s < b for s, e in every):
            yield zlib.crc32(f"{salt}:{kind}:{a}".encode()), describe(text, kind, a, b), False
    for kind, spans in base.items():
        for a, b in spans:
            for pick in range(FORMS):
                new = perturb(kind, text[a:b], pick)
                before = text[max(0, a - 60) : a] if pick < FORMS // 2 else text[max(0, a - 60) : a] + ("", "and ", "see ", "from ")[pick % 4]
                changed = before + new + text[b : b + 60]
                start, end = len(before), len(before) + len(new)
                found = (kind, start, end) in candidates(changed)
                h = zlib.crc32(f"{salt}:{kind}:{a}:{pick}".encode())
                if found:
                    yield h, describe(changed, kind, start, end), True
                if found and kind == "card":  # one digit off: the check fails
                    wrong = new[:-1] + str((int(new[-1]) + 1 + pick) % 10)
                    yield h ^ 1, describe(before + wrong + text[b : b + 60], kind, start, end), luhn(re.sub("[^0-9]", "", wrong))


def fit(docs: DataFrame, max_docs: int = 5_000, max_examples: int = 20_000, precision: float = 0.98) -> PiiModel:
    """Learn from examples of about `max_docs` documents, chosen by a hash of the id, and at most `max_examples` of each class."""
    share = min(1.0, max_docs / max(1, docs.count()))
    rows = id_text(docs).where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) < int(share * 1_000_000))

    def run(batch: pa.RecordBatch):
        found = [e for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for e in examples(text, doc_id)]
        return [*zip(*found)] if found else [[], [], []]

    some = map_batches(rows, run, "h long, x array<double>, y boolean")
    got = [r for y in ("y", "NOT y") for r in some.where(y).orderBy("h").limit(max_examples).collect()]
    y = np.array([r["y"] for r in got], float)
    if not got or y.min() == y.max():
        return PiiModel()
    x, h = np.array([r["x"] for r in got]), np.array([r["h"] for r in got])
    held = h // 2 % 10 < 3
    if len({*y[~held]}) < 2 or len({*y[held]}) < 2:
        return PiiModel()
    model = PiiModel(boosting.train(x[~held], y[~held]))
    from lectern.llm.toxicity import logistic

    margin = model.trees.margin(x[held])
    model.line = tuple(float(v) for v in logistic(margin[:, None], y[held]))
    p = model.probability(x[held])
    for kind in KINDS:
        own = x[held][:, FEATURES.index(f"is_{kind}")] == 1
        order = np.argsort(-p[own], kind="stable")
        ranked, truth, steps = p[own][order], y[held][own][order], margin[own][order]
        right = np.cumsum(truth) / (np.arange(len(truth)) + 1)
        # A bound lets all ties through, and needs a real example at it.
        whole = np.append(ranked[1:] < ranked[:-1], True) if len(ranked) else np.zeros(0, bool)
        good = np.flatnonzero((right >= precision) & whole)
        if len(good) and truth[: good[-1] + 1].any():
            # Half way to the next example below, as the trees' margin has it; without one below, an even chance.
            if good[-1] + 1 == len(steps):
                model.least[kind] = 0.5
                continue
            at = (steps[good[-1]] + steps[good[-1] + 1]) / 2
            model.least[kind] = max(0.5, float(1 / (1 + np.exp(-np.clip(model.line[0] + model.line[1] * at, -30, 30)))))
    return model


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, model: PiiModel) -> DataFrame:
    """doc_id, base and all spans as array<struct<kind,start,end>>, in one pass without a shuffle. Code points, end exclusive; by kind as listed, then start."""

    def run(batch: pa.RecordBatch):
        base_out, found, x = [], [], []
        texts = batch.column(1).to_pylist()
        for row, text in enumerate(texts):
            base = base_spans(text)
            base_out.append([(k, a, b) for k in KINDS for a, b in base[k]])
            for kind, a, b in candidates(text) if any(v <= 1 for v in model.least.values()) else ():
                if not any(a < e and s < b for _, s, e in base_out[-1]):
                    found.append((row, kind, a, b))
                    x.append(describe(text, kind, a, b))
        p = model.probability(np.array(x, float).reshape(-1, len(FEATURES)))
        every = [list(v) for v in base_out]
        for k in np.argsort(-p, kind="stable"):
            row, kind, a, b = found[k]
            if p[k] >= model.least[kind] and not any(a < e and s < b for _, s, e in every[row]):
                every[row].append((kind, a, b))
        rank = {k: i for i, k in enumerate(KINDS)}
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        return [batch.column(0), [as_rows(v) for v in base_out], [as_rows(sorted(v, key=lambda s: (rank[s[0]], s[1]))) for v in every]]

    span = "array<struct<kind:string,start:int,end:int>>"
    return map_batches(id_text(docs), run, f"doc_id long, base {span}, spans {span}")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """`text` with each span replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_pii(docs, fit(docs)).select("doc_id", *(count(k) for k in KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
