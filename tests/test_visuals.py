"""Suppression equals the loop in order; page classes, lines of boxes and salvaged objects equal brute force."""

import json
import random
from collections import defaultdict

from lectern.operators import candidates, visuals

FIGURES = "document_id int, place int, fp array<long>"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def words(bits):
    return [signed(bits >> 64 * k & (1 << 64) - 1) for k in range(4)]


def test_first_seen_equals_the_loop(spark):
    rng, rows, plain = random.Random(6), [], defaultdict(list)
    for doc in range(30):
        seeds = [rng.getrandbits(256) for _ in range(4)] + [0]
        for place in range(40):
            bits = rng.choice(seeds)
            for _ in range(rng.choice([0, 0, 1, 3, 4, 6, 7, 9])):
                bits ^= 1 << rng.randrange(256)
            if rng.random() < 0.2:
                seeds.append(bits)  # figures drift, so that chains arise
            rows.append((doc, place, words(bits)))
            plain[doc].append(bits)
    drift = 0
    for place in range(30):  # each is near the one before alone
        rows.append((99, place, words(drift)))
        plain[99].append(drift)
        drift ^= 0b111111 << 6 * place
    got = {(r.document_id, r.place): r.kept for r in visuals.first_seen(spark.createDataFrame(rows, FIGURES)).collect()}
    assert len(got) == len(rows)
    for doc, all_bits in plain.items():
        seen = []
        for place, bits in enumerate(all_bits):
            keep = all((bits ^ s).bit_count() > 6 for s in seen)
            if keep:
                seen.append(bits)
            assert got[doc, place] == keep, (doc, place)
    assert visuals.first_seen(spark.createDataFrame([], FIGURES)).collect() == []


def test_page_classes(spark):
    rng, objects = random.Random(2), []
    pages = [(d, p, 100.0, 200.0) for d in range(6) for p in range(8)] + [(9, 0, 0.0, 5.0)]
    for d, p, *_ in pages:
        for _ in range(rng.randint(0, 4)):
            x, y = rng.uniform(0, 80), rng.uniform(0, 150)
            objects.append((d, p, "image", rng.choice("abcdefghijklmnopqrst"), x, y, x + rng.uniform(0, 60), y + rng.uniform(0, 90)))
    objects += [(0, 0, "path", None, 0.0, 0.0, 1.0, 1.0)] * 400 + [(0, 1, "path", None, 0.0, 0.0, 1.0, 1.0)] * 399
    kinds = "document_id int, page int, kind string, digest string, x0 double, y0 double, x1 double, y1 double"
    got = {(r.document_id, r.page): r.scanned for r in visuals.page_classes(spark.createDataFrame(pages, "document_id int, page int, width double, height double"), spark.createDataFrame(objects, kinds)).collect()}
    for d, p, w, h in pages:
        own = [o for o in objects if o[0] == d and o[2] == "image"]
        n = sum(x[0] == d for x in pages)
        repeated = {o[3] for o in own if len({q[1] for q in own if q[3] == o[3]}) >= max(3, 0.3 * n)}
        boxes = [o[4:] for o in own if o[1] == p and o[3] not in repeated]
        share = (max(b[2] for b in boxes) - min(b[0] for b in boxes)) * (max(b[3] for b in boxes) - min(b[1] for b in boxes)) / (w * h) if boxes and w > 0 and h > 0 else 0
        assert got[d, p] == (share >= 0.5 or (d, p) == (0, 0)), (d, p)
    assert True in got.values() and False in got.values()


def test_lines_of_boxes(spark):
    rng, rows = random.Random(9), []
    for p in range(60):
        for k in range(rng.randint(0, 25)):
            x, y, h = rng.randrange(300), rng.randrange(100), rng.choice([0.5, 6, 8, 10, 30])
            rows.append((1, p, float(x), float(y), x + 20.0, y + float(h), f"w{k}"))
    got = defaultdict(list)
    for r in visuals.box_lines(spark.createDataFrame(rows, "document_id int, page int, x0 double, y0 double, x1 double, y1 double, text string")).orderBy("line_no").collect():
        got[r.page].append(r.line)
    for p in range(60):
        items = sorted(((r[3] + r[5]) / 2, r[2], r[5] - r[3], r[6]) for r in rows if r[1] == p)
        heights = sorted(i[2] for i in items)
        lines = []
        for i in items:
            if lines and i[0] - lines[-1][-1][0] <= max(1.0, heights[len(heights) // 2] * 0.6):
                lines[-1].append(i)
            else:
                lines.append([i])
        assert got[p] == [" ".join(w[3] for w in sorted(line, key=lambda w: w[1])) for line in lines], p


def by_brackets(text):
    """Whole top-level objects behind "questions": [, by counting brackets outside of strings."""
    begin = text.find('"questions": [')
    if begin < 0:
        return []
    out, depth, start, inside, skip = [], 0, 0, False, False
    for k in range(begin + len('"questions": ['), len(text)):
        c = text[k]
        if skip:
            skip = False
        elif inside:
            inside, skip = c != '"', c == "\\"
        elif c == '"':
            inside = True
        elif c in "{[":
            start = k if not depth else start
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth < 0:
                break
            if not depth:
                out.append(json.loads(text[start : k + 1]))
    return out


def test_every_prefix_gives_the_whole_objects(spark):
    rng, texts = random.Random(1), []
    for _ in range(200):
        questions = [{"question": rng.choice(['a "b" {', "c }] \\", "é\n", ""]), "n": [rng.randrange(9), {"x": None}], "evidence_quote": "q"} for _ in range(rng.randint(0, 3))]
        texts.append(json.dumps({"questions": questions}, ensure_ascii=rng.random() < 0.5))
    prefixes = sorted({t[:k] for t in texts for k in range(0, len(t) + 1, 1 if len(t) < 120 else 3)} | set(texts))
    for t in prefixes:
        found, salvaged, status = candidates.objects_of(t)
        assert [json.loads(x) for x in found] == by_brackets(t), t
        assert salvaged == (t not in texts) or json.loads(t) is not None
    odd = [None, "", "[1, {}]", '{"questions": 3}', "```json\n{\"questions\": [{\"a\": 1}]}\n```", "nonsense"]
    got = candidates.parse(spark.createDataFrame([(k, t, 1) for k, t in enumerate(odd)], "n int, output string, status int").drop("status")).orderBy("n").collect()
    assert [(r.status, r.questions) for r in got] == [("no_list", []), ("no_list", []), ("ok", ["1", "{}"]), ("no_list", []), ("ok", ['{"a": 1}']), ("no_list", [])]
