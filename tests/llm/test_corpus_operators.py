"""The corpus operators against brute force on small tables, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("lectern.llm")
from lectern.llm import boosting, decontamination, licenses, line_dedup, ngram_join, packing, pii, quality, secrets, shards, tokens, toxicity  # noqa: E402

ODD = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, score double, bucket int, component string"


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    long_text = " ".join(f"word{i % 977} part" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "same text of some few words here"), (3, "same text of some few words here"), (4, "\n\n \t"), (5, long_text), (6, "x" * 50_000), (7, "é😀 token = abcdef9 a@b.co +1 (555) 555-5555"), (8, "same text of some few words here")]
    return spark.createDataFrame([(i, t, None, None, None, "k", 7, 0.5, 1, "c") for i, t in rows], ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="module")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")


@pytest.fixture(scope="module")
def benchmark(spark, data):
    return spark.read.parquet(f"{data}/benchmark.parquet")


def test_one_row_for_each_row_also_of_odd_tables(odd, none, benchmark, labels):
    per_row = [quality.judge, secrets.find_secrets, ngram_join.similar_groups, lambda d: pii.find_pii(d, pii.fit(d)), lambda d: toxicity.score(d, toxicity.fit(d, labels)), licenses.scan_licenses]
    for f in per_row:
        assert sorted(r.doc_id for r in f(odd).collect()) == [1, 2, 3, 3, 4, 5, 6, 7, 8]
        assert f(none).collect() == []
    for f in (line_dedup.grouped_lines, lambda d: decontamination.find_leaks(d, benchmark), lambda d: packing.pack(packing.pieces(d, tokens.default_path()))):
        f(odd).collect()
        assert f(none).collect() == []


def test_filters_keep_all_columns(odd, none, benchmark):
    model = toxicity.ToxicityModel()
    for f in (lambda d: toxicity.drop_toxic(d, model), line_dedup.drop_repeated_lines, ngram_join.keep_first, lambda d: decontamination.drop_leaked(d, benchmark)):
        assert f(odd).columns == odd.columns and f(odd).count() >= 5
        assert f(none).count() == 0
    assert {r.doc_id for r in ngram_join.keep_first(odd).collect()} == {1, 2, 3, 4, 5, 6, 7}


def test_quality_counts(docs, texts):
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def brute(t):
        w = word.findall(t)
        seen, cover = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
        for i in range(len(w) - 4):
            if seen[tuple(w[i : i + 5])] > 1:
                cover.update(range(i, i + 5))
        lines = [x for x in t.split("\n") if word.search(x)]
        return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(cover)

    got = quality.judge(docs).collect()
    for r in got:
        b = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0]) and not (r.base_failed and r.kept)


def test_quality_estimate_agrees_with_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, quality.DIMENSION))
    df = spark.createDataFrame([(0, "a", "b", *map(float, r)) for r in x], ["g_level", "g_lang", "g_source", *quality.NAMES])
    from pyspark.sql import functions as F

    row = quality.estimate(df, F.lit(True)).collect()[0]
    cov = np.cov(x.T, bias=True) + np.diag([v**2 for v in quality.FLOORS.values()])
    assert np.allclose(np.array(row.precision).reshape(quality.DIMENSION, -1), np.linalg.inv(cov), rtol=1e-6)
    assert np.allclose(row.mean, x.mean(0)) and abs(quality.chi_square(0.975, 7) - 16.0128) < 1e-3


def test_secrets(docs, texts):
    rules = secrets.RULES

    def brute(t):
        return sorted((m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.pattern, t) if len(m[r.group]) >= r.least)

    for r in secrets.find_secrets(docs).collect():
        assert [tuple(s) for s in r.spans] == brute(texts[r.doc_id])
    assert secrets.trigram_query(r"[0-9a-f]{24,}") is None
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})}


def test_packing_plan_and_places(docs):
    random.seed(1)
    for _ in range(100):
        capacity = random.choice([10, 20, 50])
        lengths = [random.randint(1, capacity) for _ in range(random.randint(0, 60))]
        plan, bins = packing.make_plan(Counter(lengths), capacity), defaultdict(list)
        for length, n in Counter(lengths).items():
            for number in range(n):
                k = np.searchsorted(plan.key, length << 44 | number, "right") - 1
                nth = number - plan.first[k]
                bins[int(plan.sequence[k] + nth // plan.each[k])].append((int(plan.offset[k] + nth % plan.each[k] * length), length))
        assert len(bins) == plan.sequences
        for content in bins.values():
            at = 0
            for offset, length in sorted(content):
                assert offset == at
                at += length
            assert at <= capacity
    cut = packing.pieces(docs, tokens.default_path()).cache()
    rows = packing.pack(cut).collect()
    assert len(rows) == cut.count()
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(ends.values()) // 2048) + 2


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokens.default_path()
    tok = Tokenizer.from_file(path)
    random.seed(3)
    alphabet = "ab'\".,!$ \n\t1é́Σ|<>😀 -İ²"
    for _ in range(3000):
        t = "".join(random.choice(alphabet) for _ in range(random.randint(0, 30)))
        assert np.frombuffer(tokens.encode(t, path), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    for special in ("<|startoftext|>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|EndOfText|>", "<|X", "|> <|"):
        for t in (special, f"Ab {special} Cd", f"Ab{special}Cd.", f"{special}{special.upper()}"):
            assert np.frombuffer(tokens.encode(t, path), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_rows_of_one_doc_id_with_unlike_texts(spark):
    same = "this very line of some words stands in both rows"
    rows = [(1, f"{same}\nunique words that nobody else has at all"), (1, f"{same}\nquite another text with its own words in it"), (1, f"{same}\nunique words that nobody else has at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [r.text for r in line_dedup.drop_repeated_lines(df).collect()]
    assert sorted(t.count(same) for t in left) in ([0, 1, 1], [0, 0, 1]) and sum("unique words" in t for t in left) == 2 and sum("quite another" in t for t in left) == 1
    assert sorted(r.text for r in ngram_join.keep_first(df).collect()) == sorted(t for _, t in rows)


def brute_groups(texts, width=4, percent=85):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent, index = {i: i for i in sets}, defaultdict(list)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in index[s])
        for j, k in shared.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            index[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join(docs, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs).collect()} == brute_groups(texts)


def test_ngram_join_on_one_large_near_group(spark):
    random.seed(2)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(150):
        w = list(base)
        for _ in range(i % 4):
            w[random.randrange(120)] = f"x{random.randrange(50)}"
        texts[i] = " ".join(w)
    texts |= {200 + i: " ".join(f"s{j}" for j in range(9 + i % 3)) for i in range(20)}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df).collect()} == brute_groups(texts)


def test_line_dedup(spark, docs, texts):
    from pyspark.sql import functions as F

    words = spark.createDataFrame([(["a", "b", "c"] * 200,), (["x"],)], "w array<string>")
    for r in words.select(line_dedup.simhash(F.col("w")).alias("s"), F.transform("w", lambda w: F.xxhash64(w)).alias("h")).collect():
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r.h) > len(r.h))
        assert r.s == (want - (1 << 64) if want >> 63 else want)
    got = {(r.doc_id, r.line_no): (r.line_group, r.kept) for r in line_dedup.grouped_lines(docs).collect()}
    equal = defaultdict(set)
    for i, t in texts.items():
        for k, line in enumerate(t.split("\n")):
            n = re.sub(r"[\W_]+", " ", line.lower()).strip()
            if len(n.split(" ")) >= line_dedup.MIN_WORDS:
                equal[n].add((i, k))
    for places in equal.values():
        if len(places) > 1:
            assert len({got[p][0] for p in places}) == 1 and sum(got[p][1] for p in places) <= 1
    by = defaultdict(list)
    for place, (group, kept) in got.items():
        by[group].append((place, kept))
    assert all([k for _, k in sorted(v)] == [True] + [False] * (len(v) - 1) for v in by.values())
    near = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(200))), (2, " ".join(f"w{i}" for i in range(199)) + " zz")], "doc_id long, text string")
    assert [r.kept for r in line_dedup.grouped_lines(near).orderBy("doc_id").collect()] == [True, False]


def test_decontamination(spark, docs, texts, benchmark):
    norm = lambda t: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} "
    items = {r.item_id: norm(r.text) for r in benchmark.collect()}
    want = {(i, k) for i, t in texts.items() for k, b in items.items() if b in norm(t)}
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, benchmark).collect()} == want
    item = spark.createDataFrame([(1, "If Tom buys 12 apples and Ann eats 3 apples how many kg are left for Tom today")], "item_id long, text string")
    changed = spark.createDataFrame([(1, "zz. If Bob buys 55 apples and Eve eats 7 apples how many kg are left for Bob today ok"), (2, "zz If Bob buys 55 apples and Eve eats 7 apples how many kg are left for Sam today"), (3, None)], "doc_id long, text string")
    for limit in (0, 10**6):
        assert [(r.doc_id, r.reparameterised) for r in decontamination.find_leaks(changed, item, lookup_limit=limit).collect()] == [(1, True)]


def test_training_order_round_trip(spark, docs, tmp_path):
    for n in (1, 2, 5, 1000):
        p = shards.permute(np.arange(n), n, 7)
        assert sorted(p) == list(range(n)) and (shards.permute(p, n, 7, back=True) == np.arange(n)).all()
    folder = f"file://{tmp_path}/out"
    rows = {r.slot: r for r in shards.materialise(docs, folder, tokens.default_path(), length=256, sequences_per_shard=100).collect()}
    found = [*shards.read_slots(folder, 0, len(rows))]
    assert all(zlib.crc32(s.tobytes()) == rows[k].crc32 for k, s in enumerate(found))
    order = shards.permute(np.arange(len(rows)), len(rows), 20)
    stream = np.concatenate([found[k] for k in order])[: sum(r.n_ids for r in rows.values())]
    want = sorted(tokens.encode(t, tokens.default_path()) for t in [r.text for r in docs.collect()])
    ids, own = stream.astype("<u4"), []
    for part in np.split(ids, np.flatnonzero(ids == 0) + 1):
        own.append(part[:-1].tobytes())
    assert sorted(own[:-1]) == want
    assert [s.tolist() for s in shards.read_slots(folder, 95, 10)] == [s.tolist() for s in found[95:105]]


def test_pii_base_spans(texts):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(t):
        out = {}
        for kind, p in patterns.items():
            out[kind] = []
            for m in re.finditer(p, t):
                d = [c for c in m[0] if c.isdigit()]
                if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and pii.luhn("".join(d)) or kind == "phone" and 8 <= len(d) <= 15:
                    out[kind].append(m.span())
        return out

    random.seed(4)
    mixed = ["".join(random.choice("ab@.@-_ 1234 .+()") for _ in range(40)) for _ in range(3000)]
    for t in [*texts.values(), *mixed, "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "0001.2.3.255"]:
        assert pii.base_spans(t) == brute(t)
    assert pii.redact("call +1 555 now", [("phone", 5, 11)]) == "call [PHONE] now"


def test_pii_finds_forms_that_the_base_rules_do_not(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.fit(big)
    rng = random.Random(9)
    words = "the meeting was moved again and nobody wrote down why it happened so late in that long week of rain".split()
    rows, want = [], {}
    for i in range(300):
        kind = pii.KINDS[i % 4]
        if kind == "email":
            span = f"{rng.choice(words)}.{rng.choice(words)}{rng.randrange(99)}@{rng.choice(words)}.{rng.choice(('org', 'com', 'net'))}"
        elif kind == "ip":
            span = ".".join(str(rng.randrange(256)) for _ in range(4))
        elif kind == "card":
            head = "".join(str(rng.randrange(10)) for _ in range(15))
            span = next(head + d for d in "0123456789" if pii.luhn(head + d))
        else:
            span = f"+{rng.randrange(1, 90)} ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        before = " ".join(rng.choices(words, k=8)) + " "
        new = pii.perturb(kind, span, rng.randrange(100))
        rows.append((i, f"{before}{new} " + " ".join(rng.choices(words, k=8))))
        want[i] = (kind, len(before), len(before) + len(new))
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    caught = Counter(want[i][0] for i in want if any(a < want[i][2] and want[i][1] < b for _, a, b in got[i]))
    print(caught, model.least)
    assert sum(caught.values()) >= 0.9 * len(rows)


def test_boosting_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = boosting.train(x[:600], y[:600])
    assert ((model.probability(x[600:]) > 0.5) == (y[600:] == 1)).mean() > 0.93


def test_toxicity_on_held_out_rows(spark, labels):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.score(big, toxicity.fit(big, marks)).join(marks, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.93 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    table, machine = toxicity.Folding(), toxicity.ToxicityModel().automaton()
    assert toxicity.folded("You 1d10t, m0r0n! іdiоt", table) == " you idiot moron idiot "
    assert toxicity.folded("\u00eddiot idi\u200bot i.d.i.o.t i\u0301diot e.g. A_b", table) == " idiot idiot idiot idiot e g a b "
    assert toxicity.features("the trash can", machine, table)[0] == 0 < toxicity.features("you trash", machine, table)[0]


def test_licenses(texts):
    machine = licenses.automaton()

    def brute(t):
        w, starts, found = licenses.WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)), [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    starts.append(i)
                    found.add(label)
        return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(found))

    for t in texts.values():
        assert licenses.scan(t, machine)[:5] == brute(t)
    r = licenses.parse_expression("(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0")
    assert r.whole and r.rank == 6 and r.labels == {"mit", "apache-2", "gpl-2-with-classpath-exception-2.0"}
    assert not licenses.parse_expression("MIT OR").whole and licenses.parse_expression("") is None


def test_digests_of_queries(spark, data, texts):
    from lectern.llm import registry

    for name in ("op2_secret_scan", "op8_pii"):
        for r in registry.queries()[name](spark, data).limit(50).collect():
            if not r.spans:
                assert r.base_sha256 == hashlib.sha256(b"").hexdigest()


def test_components_of_a_shuffled_chain(spark):
    from lectern.llm import linking

    ids = list(range(2000))
    random.Random(0).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (5000, 5001)], "a long, b long")
    assert {r.id: r.component for r in linking.components(edges).collect()} == dict.fromkeys(ids, 0) | {5000: 5000, 5001: 5000}


def test_keep_first_of_short_texts(spark):
    random.seed(6)
    texts = {}
    for i in range(120):
        n, start = random.randint(1, 14), random.randrange(3)
        texts[i] = " ".join(f"g{i % 8}w{k}" for k in range(start, start + n))
    texts |= {200: "a b c d e f g h i", 201: "a b c d e f g h i j", 202: "l m n o p q r s", 203: "l m n o p q r s t"}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    want = brute_groups(texts, 5, 80)
    assert want[201][1] == 200 and want[203][1] == 202
    assert {r.doc_id for r in ngram_join.keep_first(df).collect()} == {i for i, (_, c) in want.items() if i == c}


def test_license_expression_of_a_long_line():
    machine = licenses.automaton()
    names = [f"LicenseRef-{i:03}" for i in range(120)]
    line = f"SPDX-License-Identifier: MIT AND ({' OR '.join(names)}) AND AGPL-3.0-only"
    assert len(line) > 2000
    n = licenses.scan(f"{line} */\nMIT AND GPL-2.0-only", machine)
    assert n[5].split(",") == sorted(["agpl-3", "mit", *(x.lower() for x in names)])
    assert n[6:8] == (1.0, 9) and n[8] == [line.split(": ", 1)[1] + " */"]
    simple = " AND ".join(["MIT"] * 100 + ["AGPL-3.0-only"])
    # A later tag of the same line is read too.
    n = licenses.scan(f"SPDX-License-Identifier: {simple} // SPDX-License-Identifier: ISC", machine)
    assert n[5:8] == ("agpl-3,isc,mit", 1.0, 7)


def test_line_dedup_finds_all_similar_lines(spark):
    random.seed(8)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    lines = []
    for n in (5, 6, 9, 10, 14, 15, 20, 27, 40, 80):
        for _ in range(6):
            base = [random.choice(("the", "of", f"v{random.randrange(400)}", f"v{random.randrange(400)}")) for _ in range(n)]
            lines.append(base)
            for edits in (1, n // 10, n // 5, n // 5 + 1):
                w = list(base)
                for at in random.sample(range(n), min(n, edits)):
                    w[at] = random.choice((f"x{random.randrange(99)}", f"x{random.randrange(99)}", f"x{random.randrange(99)} y", ""))
                lines.append(" ".join(w).split())
    lines = [w for w in lines if len(w) >= line_dedup.MIN_WORDS]
    parent = list(range(len(lines)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            most = max(len(a), len(b))
            if 10 * min(len(a), len(b)) >= 8 * most and 10 * distance(a, b) <= 2 * most:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    sizes = Counter(find(i) for i in range(len(lines)))
    got = line_dedup.grouped_lines(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")).collect()
    first = {r.line_group: r.doc_id for r in got if r.kept}
    assert {r.doc_id: first[r.line_group] for r in got} == {i: find(i) for i in range(len(lines)) if sizes[find(i)] > 1}


def test_cached_words_of_a_text_are_not_learned_again(monkeypatch):
    """Only a text's unknown words go through the cache's slow path, also when the cache turns over between two texts."""
    from tokenizers import Tokenizer

    path = tokens.default_path()
    tok, learn, asked = Tokenizer.from_file(path), tokens.WordEncoder.learn, []
    monkeypatch.setattr(tokens, "_encoders", {})
    monkeypatch.setattr(tokens, "CACHE_WORDS", 60)
    monkeypatch.setattr(tokens.WordEncoder, "learn", lambda self, words: (asked.append(set(words)), learn(self, words))[1])
    texts = ["one two three", "one two four", *(" ".join(f"w{(7 * k + j) % 90}q{j}." for j in range(25)) for k in range(20)), "one, w1q1. two"]
    for t in texts:
        assert np.frombuffer(tokens.encode(t, path), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    assert asked[:2] == [{b"one", b"two", b"three"}, {b"four"}]


def test_line_dedup_keys_of_common_words_do_not_multiply(spark, monkeypatch):
    """Lines of common words alone: what they share by chance gives few keys a line, and the similar ones are still found."""
    rng = random.Random(5)
    common = [f"c{k}" for k in range(150)]
    lines = [[rng.choice(common) for _ in range(40)] for _ in range(6000)]
    for i in range(0, 200, 2):
        lines[i + 1] = [w if rng.random() > 0.1 else "new" for w in lines[i]]
    seen, plain = [], line_dedup.candidates

    def counted(keys, *args):
        seen.append(keys.count())
        return plain(keys, *args)

    monkeypatch.setattr(line_dedup, "candidates", counted)
    got = line_dedup.grouped_lines(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")).collect()
    want = {i for i in range(200) if sum(a != b for a, b in zip(lines[i - i % 2], lines[i - i % 2 + 1])) <= 8}
    assert {r.doc_id for r in got} == want and seen[0] < 3 * len(lines)


def test_line_dedup_keys_of_all_lengths_meet(spark):
    """Each line of 4 to 64 words, with as many edits as its length allows, shares a key with the line it was made from."""
    rng = random.Random(6)
    order = np.ones(line_dedup.ORDER_BUCKETS, np.uint8)
    for n in range(4, 65):
        for _ in range(30):
            line = [rng.randrange(1, 9 if n % 2 else 10**6) for _ in range(n)]
            longest = int(n / 0.8)
            kind = rng.choice(("insert", "replace", "delete"))
            other = list(line)
            for _ in range(longest // 5 if kind == "insert" else n // 5):
                at = rng.randrange(len(other))
                other[at : at + (kind != "insert")] = [] if kind == "delete" else [rng.randrange(10**6, 10**9)]
            if max(len(line), len(other)) * 0.2 + 1e-9 < (longest // 5 if kind == "insert" else n // 5):
                continue
            keys, own = line_dedup.runs_of(np.array(line + other, np.uint32), np.array([n, len(other)]), order)
            assert line == other or set(keys[own == 0]) & set(keys[own == 1]), (line, other)


def test_decontamination_of_names_at_sentence_starts_numbers_and_few_literals(spark):
    items = [
        (1, "Anna has 3 apples. Tom has 5 apples. How many apples do they have in total?"),
        (2, "A class sold 900 tickets and then 90 dollars came in for each of the 900 seats."),
        (3, "Tom 3 kg, Ann 5 kg, Bob 7 kg"),
        (4, "Natalia sold clips to her friends in April. Natalia then sold half as many clips in May. Weng earns more than both of them together."),
    ]
    texts = [
        (1, "zz. Lucy has 4 apples. Mark has 7 apples. How many apples do they have in total? ok"),
        (2, "zz a class sold 1,200 tickets and then 120.50 dollars came in for each of the 1,200 seats."),
        (3, "The list: Tom 3 kg, Ann 5 kg, Bob 7 kg"),
        (4, "zz. Petra sold clips to her friends in April. Petra then sold half as many clips in May. Hans earns more than both of them together."),
        (5, "The list: Tom 4 kg, Ann 6 kg, Bob 8 kg"),
    ]
    items = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for limit in (0, 10**6):
        got = decontamination.find_leaks(docs, items, lookup_limit=limit).collect()
        assert sorted((r.doc_id, r.item_id, r.reparameterised) for r in got) == [(1, 1, True), (2, 2, True), (3, 3, False), (4, 4, True)]
