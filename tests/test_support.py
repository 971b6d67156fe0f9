"""Support of questions by excerpts equals the rules in plain Python."""

import random
import re
import unicodedata

from lectern.functions.text import STOPWORDS
from lectern.operators import support


def squash(t):
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKD", t or "").casefold().replace("đ", "d"))


def words(t):
    return {w for w in re.findall(r"\w{5,}", unicodedata.normalize("NFKC", t or "").casefold()) if w not in STOPWORDS}


def backed(word, text):
    w = squash(word)
    if not w:
        return False
    if w in text:
        return True
    if len(w) > 10:
        pieces = {w[k : k + 5] for k in range(len(w) - 4)}
        return sum(p in text for p in pieces) / len(pieces) >= 0.7
    return len(w) > 6 and w[: max(6, len(w) - 3)] in text


def plain(stem, answer, own, units):
    texts = {u: squash(t) for u, t in units}

    def distinctive(t):
        return words(t) if len(texts) < 5 else {w for w in words(t) if sum(squash(w) in x for x in texts.values()) <= 0.4 * len(texts)}

    a = distinctive(answer)
    both = distinctive(stem) | a
    joint = sum(backed(w, texts.get(own, "")) for w in both) / len(both) if both else None
    found = [w for w in a if any(backed(w, x) for x in texts.values())]
    return joint, None if not a else 0.0 if len(found) < min(len(a), 2) else len(found) / len(a)


def test_support_equals_the_plain_rules(spark):
    rng, units, questions = random.Random(3), [], []
    pool = "scheduling scheduler schedule preemption preemptive kernel kernels virtualisation virtualization memory straße résumé however because interrupt ___underscore x86assembler paging".split()
    for doc in range(40):
        for k in range(rng.choice([1, 4, 5, 9])):
            units.append((doc, f"u{k}", rng.choice([None, " ".join(rng.choices(pool, k=rng.randint(0, 8)))])))
        for q in range(5):
            questions.append((doc, q, rng.choice(["u0", "u3", "none"]), " ".join(rng.choices(pool, k=rng.randint(0, 5))), rng.choice([None, "", " ".join(rng.choices(pool, k=rng.randint(1, 3)))])))
    got = {(r.document_id, r.question_id): (r.joint, r.answer) for r in support.context_support(spark.createDataFrame(questions, "document_id int, question_id int, unit_id string, stem string, answer string"), spark.createDataFrame(units, "document_id int, unit_id string, text string")).collect()}
    assert len(got) == len(questions)
    for doc, q, own, stem, answer in questions:
        want = plain(stem, answer, own, [(u, t) for d, u, t in units if d == doc])
        for a, b in zip(got[doc, q], want):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9), (doc, q, got[doc, q], want)
