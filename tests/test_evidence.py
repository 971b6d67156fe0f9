"""Located quotes equal those of an aligner that tries every excerpt."""

import difflib
import random
import re
import unicodedata

from lectern.operators import evidence


def squash(t):
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKD", t or "").casefold().replace("đ", "d"))


def score_of(q, t):
    if q in t:
        return 1.0, t.index(q), t.index(q) + len(q)
    runs = [(b.a, b.size) for b in difflib.SequenceMatcher(None, t, q, autojunk=False).get_matching_blocks() if b.size >= 5]
    if not 1 <= len(runs) <= 8 or runs[-1][0] + runs[-1][1] - runs[0][0] > 1.3 * len(q) + 20:
        return 0.0, 0, 0
    return sum(n for _, n in runs) / len(q), runs[0][0], runs[-1][0] + runs[-1][1]


def exhaustive(quote, units):
    """units: [(place, unit_id, text)] of one document."""
    q = squash(quote)
    if len(q) < 20:
        return []
    parts = {q[k : k + 8] for k in range(len(q) - 7)}
    units = [(p, u, squash(t)) for p, u, t in sorted(units)]
    grams = lambda t: {t[k : k + 8] for k in range(len(t) - 7)}
    single = [([(u, 0, len(t))], t, grams(t)) for _, u, t in units]
    double = [([(u, 0, len(t)), (v, len(t), len(t) + len(s))], t + s, grams(t) | grams(s)) for (p, u, t), (o, v, s) in zip(units, units[1:]) if o == p + 1]
    for level in (single, double):
        hits = [x for x in level if q in x[1]]
        if not hits:
            close = sorted(level, key=lambda x: -len(parts & x[2]))[:3]
            hits = sorted((x for x in close if len(parts & x[2]) >= 0.25 * len(parts)), key=lambda x: -score_of(q, x[1])[0])
        if hits and score_of(q, hits[0][1])[0] >= 0.85:
            score, a, b = score_of(q, hits[0][1])
            return [(u, score, max(a, lo) - lo, min(b, hi) - lo) for u, lo, hi in hits[0][0] if min(b, hi) > max(a, lo)]
    return []


def test_locate_equals_the_exhaustive_aligner(spark):
    rng, units, quotes = random.Random(8), [], []
    words = ["scheduling", "Đường", "process", "kernel", "the", "of", "résumé", "page", "table", "miss", "cache", "virtual", "phố", "memory", "x86", "thread", "lock"]
    for doc in range(40):
        text = " ".join(rng.choices(words, k=400))
        places = rng.sample(range(14), 9)
        for k, place in enumerate(sorted(places)):
            units.append((doc, f"{doc}-{place}", place, text[k * 300 : (k + 1) * 300]))
        for n in range(12):
            at = rng.choice([rng.randrange(0, 2500), 300 * rng.randrange(1, 8) - 40])
            quote = text[at : at + rng.choice([15, 30, 60, 120, 250])]
            for _ in range(rng.choice([0, 0, 1, 3, 12])):
                p = rng.randrange(max(len(quote), 1))
                quote = quote[:p] + rng.choice(["q", "", " ", "ZZ"]) + quote[p + 1 :]
            quotes.append((doc, n, rng.choice([quote, quote.upper(), quote.replace(" ", "")])))
    quotes += [(0, 100, None), (0, 101, ""), (77, 1, "a quote of a document that has no excerpts"), (1, 102, " ".join(words * 2))]
    units += [(0, "null", 40, None), (0, "same a", 50, "one sentence that stands twice in it"), (0, "same b", 51, "one sentence that stands twice in it")]
    quotes.append((0, 103, "One sentence that stands twice in it!"))
    got = {}
    for r in evidence.locate(spark.createDataFrame(quotes, "document_id long, quote_id int, quote string"), spark.createDataFrame(units, "document_id long, unit_id string, place int, text string")).collect():
        got.setdefault((r.document_id, r.quote_id), []).append((r.unit_id, r.score, r.start, r.end))
    over = 0
    for doc, n, quote in quotes:
        want = exhaustive(quote, [(p, u, t) for d, u, p, t in units if d == doc])
        assert sorted(got.get((doc, n), [])) == sorted(want), (doc, n, quote)
        over += len(want) == 2
    assert over > 20 and got[0, 103][0][0] == "same a"
    none = spark.createDataFrame([], "document_id long, quote_id int, quote string")
    assert evidence.locate(none, spark.createDataFrame(units, "document_id long, unit_id string, place int, text string")).collect() == []
