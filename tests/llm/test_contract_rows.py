"""The registered queries over a small folder of planted documents: base columns, digests and pieces as plain Python has them."""

import hashlib
import random
import re
import shutil
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("lectern.llm")
from lectern.llm import registry, tokens  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    """Documents of the small tables, with planted lines in some, and odd ones."""
    root = tmp_path_factory.mktemp("planted")
    rng = random.Random(7)
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    planted = [
        "password = hunter2hunter2 and token: 'abc.def-123' é", "API_KEY=short SECRET=longenough_1", "AKIA" + "A1B2C3D4E5F6G7H8 and AKIASHORT", "deadbeef" * 4 + " 0123456789abcdef", 'apikey" : "Zm9vYmFy+/=" passwd=',
        "mail bob.smith+x@mail.example.org, no@dot and a@b.c", "from 192.168.0.1 to 256.1.1.1 or 1.2.3.4.5", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +1 (555) 010-9999 or +49 30 1234567 or +12",
        "Under the MIT License, Apache License, version 2.0 and CC-BY-NC here", "under the mit license\nunder the mit license", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0",
        "same line\nsame line\n\n\nsame line", " ".join(["one two three four five"] * 3), "a # b $ c |", "😀 " * 40,
    ]
    out = []
    for k, (doc, text, *rest) in enumerate(rows):
        for _ in range(rng.randint(0, 2)):
            cut = rng.randint(0, len(text or ""))
            text = f"{(text or '')[:cut]}\n{rng.choice(planted)}\n{(text or '')[cut:]}"
        out.append((doc, text, *rest))
    out += [(10_000 + k, t, "en", "planted", len(t)) for k, t in enumerate(planted)] + [(20_000, None, None, None, None), (20_001, "", "en", "s", 0), (20_002, "x" * 60_000, "en", "s", 60_000), (20_003, " ".join(f"w{i % 3000}" for i in range(9000)), "en", "s", 1)]
    spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{root}/documents.parquet")
    for t in ("benchmark", "labels"):
        shutil.copy(f"{data}/{t}.parquet", f"{root}/{t}.parquet")
    return str(root), {r[0]: r[1] or "" for r in out}


def rows_of(spark, folder, name):
    rows = registry.queries()[name](spark, folder[0]).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(got) == len(folder[1])
    return got


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def found(pattern, text, fits):
    return [m.span() for m in re.finditer(pattern, text) if fits(m)]


def test_quality_base(spark, folder):
    got = rows_of(spark, folder, "op1_quality_rules")
    for doc, text in folder[1].items():
        words = WORD.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        inside = set()
        for i in range(len(words) - 4):
            if windows[tuple(words[i : i + 5])] > 1:
                inside.update(range(i, i + 5))
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)), doc
        assert r.base_failed == (len(words) < 10 or 100 * len(inside) > 20 * len(words)) and not (r.base_failed and r.kept)


def test_secrets_base(spark, folder):
    got, hits = rows_of(spark, folder, "op2_secret_scan"), 0
    assign = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    order = ["assign", "access", "hex"]
    for doc, text in folder[1].items():
        spans = [("assign", *s) for s in found(assign, text, lambda m: len(m[2]) >= 6)] + [("access", *s) for s in found(r"AKIA[A-Z0-9]+", text, lambda m: len(m[0]) >= 20)] + [("hex", *s) for s in found(r"[0-9a-f]+", text, lambda m: len(m[0]) >= 24)]
        spans.sort(key=lambda x: (x[1], order.index(x[0])))
        r, counts = got[doc], Counter(k for k, *_ in spans)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (counts["assign"], counts["access"], counts["hex"], digest(spans)), doc
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(r.spans.split(","))
        hits += len(spans)
    assert hits > 20


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_pii_base(spark, folder):
    got, hits = rows_of(spark, folder, "op8_pii"), Counter()
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    for doc, text in folder[1].items():
        spans = [("email", *s) for s in found(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text, lambda m: True)]
        spans += [("ip", *s) for s in found(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text, lambda m: all(int(p) <= 255 for p in m[0].split(".")))]
        spans += [("card", *s) for s in found(r"[0-9]([\x20-]?[0-9])+", text, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m)))]
        spans += [("phone", *s) for s in found(r"\+[0-9][\x20().0-9-]+[0-9]", text, lambda m: 8 <= len(digits(m)) <= 15)]
        r, counts = got[doc], Counter(k for k, *_ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (counts["email"], counts["ip"], counts["card"], counts["phone"], digest(spans)), doc
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(r.spans.split(","))
        hits += counts
    assert min(hits[k] for k in ("email", "ip", "card", "phone")) > 2


def test_licenses_base(spark, folder):
    got, hits = rows_of(spark, folder, "op10_license_scan"), 0
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for doc, text in folder[1].items():
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        at = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r, starts = got[doc], [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(starts, default=None), max(starts, default=None)), doc
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        hits += len(at)
    assert hits > 5


def test_packing_pieces(spark, folder):
    from tokenizers import Tokenizer

    tokenizer, pieces = Tokenizer.from_file(tokens.default_path()), {}
    rows = registry.queries()["op3_best_fit_packing"](spark, folder[0]).collect()
    for doc, text in folder[1].items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            pieces[doc, k] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == pieces and len(rows) == len(pieces)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(n for _, n, _ in pieces.values()) // 2048) * 1.05 + 1
