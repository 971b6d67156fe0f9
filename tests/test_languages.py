"""Primary language against the rules restated in plain Python, on random bilingual texts; mismatches by case."""

import random
import re
from collections import Counter

from lectern.operators import languages as lang

EN = ["The kernel schedules every thread fairly.", "Memory pages are mapped lazily here.", "Interrupts wake the sleeping driver.", "No.", "eCos HAL FIFO.", "Short ones."]
VI = ["Nhân hệ điều hành lập lịch cho từng luồng.", "Các trang bộ nhớ được ánh xạ dần dần.", "Ngắt đánh thức trình điều khiển đang ngủ.", "Vâng."]
MIXED = "The naïve approach fails quickly on café."


def language(text, least=12):
    words = [w for w in re.findall(r"[^\W\d_]{2,}", text) if not (len(w) <= 15 and (w.isupper() or any(c.isupper() for c in w[1:])))]
    letters = "".join(words)
    if len(letters) < least:
        return None
    share = len(re.findall(lang.SECOND_LETTERS, letters)) / len(letters)
    return "vietnamese" if share >= 0.05 else "english" if share <= 0.01 else None


def plain(texts, labels):
    votes, pairs, first, block = Counter(), Counter(), None, []

    def close(block):
        runs = [x for k, x in enumerate(block) if not k or x != block[k - 1]]
        for k in range(0, len(runs) - 1, 2):
            pairs[runs[k]] += 1
        block.clear()

    for text in texts:
        for line in text.splitlines():
            parts = [p.strip(lang.BULLETS) for p in re.split(r"(?<=[.!?])|→", line)]
            parts = [(p, p[-1] in ".!?", language(p)) for p in parts if p]
            for _, _, x in parts:
                if x:
                    votes[x] += 1
                    first = first or x
            said = [x for _, body, x in parts if body and x]
            if not parts or any(x and not body for _, body, x in parts):
                close(block)
            if len(set(said)) == 2:
                close(block)
                close(said)
            else:
                block.extend(said)
    close(block)
    titles = Counter(language(x, 6) for x in labels)

    def clear(a, b, least, share):
        return ("english" if a > b else "vietnamese") if max(a, b) >= least and max(a, b) / (a + b) >= share else None

    by_title = clear(titles["english"], titles["vietnamese"], 2, 2 / 3) if titles["english"] + titles["vietnamese"] >= 2 else None
    by_pairs = clear(pairs["english"], pairs["vietnamese"], 3, 0.6)
    by_body = "english" if votes["english"] > votes["vietnamese"] else "vietnamese" if votes["english"] < votes["vietnamese"] else first or "english"
    return by_title or by_pairs or by_body, "structural" if by_title else "bilingual_order" if by_pairs else "body_fallback", pairs["english"], pairs["vietnamese"], votes["english"], votes["vietnamese"]


def test_primary_language_equals_the_plain_rules(spark):
    rng, texts, labels = random.Random(5), {}, {}
    for doc in range(150):
        style, parts = rng.randrange(5), []
        for _ in range(rng.randint(0, 2)):
            lines = []
            for _ in range(rng.randint(0, 9)):
                a, b = rng.choice(EN), rng.choice(VI)
                a, b = (a, b) if rng.random() < (0.1, 0.9, 0.5, 0.9, 0.9)[style] else (b, a)
                lines += [f"{a}{b}"] if style < 2 else [a, b] if style < 4 else [a]
                if rng.random() < 0.3:
                    lines.append(rng.choice(["", "Thread Scheduling Basics", "• Lập lịch luồng", "Overview → " + a, MIXED, "CPU"]))
            parts.append(rng.choice(["\n", "\r\n"]).join(lines))
        texts[doc] = parts
        labels[doc] = [rng.choice(["Thread scheduling", "Lập lịch luồng", "HAL", "Memory"]) for _ in range(rng.choice([0, 0, 0, 1, 3]))]
    t = spark.createDataFrame([(d, k, p) for d, parts in texts.items() for k, p in enumerate(parts)] + [(999, 0, None)], "document_id int, place int, text string")
    found = spark.createDataFrame([(d, x) for d, own in labels.items() for x in own] + [(5, None)], "document_id int, label string")
    got = {r.document_id: (r.language, r.basis, r.first_to_second, r.second_to_first, r.body_first, r.body_second) for r in lang.primary_language(t, found).collect()}
    bases = Counter()
    for doc, parts in texts.items():
        if parts:
            assert got[doc] == plain(parts, labels[doc]), doc
            bases[got[doc][1]] += 1
    assert got[999] == ("english", "body_fallback", 0, 0, 0, 0) and min(bases.values()) > 5 and len(bases) == 3
    assert lang.primary_language(t.limit(0), found).collect() == []


def test_mismatch(spark):
    cases = [
        ("What does the HAL of eCos abstract away?", ["Phần", "memory"], "It hides the hardware.", "english", False),
        ("Lớp trừu tượng phần cứng làm gì?", ["a"], None, "english", True),
        ("What does it do here today?", ["Nó che giấu phần cứng khỏi ứng dụng"], "", "english", True),
        ("Lớp trừu tượng phần cứng làm gì?", ["It hides the hardware fully"], "", "vietnamese", True),
        ("Lớp trừu tượng phần cứng làm gì?", ["HAL", "FIFO"], "Nó che giấu phần cứng.", "vietnamese", False),
        ("What does the layer hide from us?", None, None, "vietnamese", True),
        ("Lớp trừu tượng phần cứng làm gì?", None, None, "german", False),
        (None, None, None, "english", False),
    ]
    df = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "n int, stem string, options array<string>, explanation string, language string")
    assert {r.n: r.mismatch for r in lang.mismatched(df).collect()} == {k: c[4] for k, c in enumerate(cases)}


def test_kept_letters_in_one_pass_equal_those_word_by_word(spark):
    from pyspark.sql import functions as F

    rng, rows = random.Random(9), []
    common = "abcdeXYZ  .-1²ªĸßŉıİÿŸéÉơƠưƯẠạỹ→•●\u0301\u00b5"
    for n in range(3000):
        rows.append((n, "".join(rng.choices(common if n % 3 else common + "ǅⅧⅷ中Ω𝐀ſ", k=rng.randrange(0, 60)))))
        rows.append((n, " ".join("".join(rng.choices("aB²é", k=rng.choice([1, 2, 3, 14, 15, 16, 17]))) for _ in range(4))))
    words = re.compile(r"[^\W\d_]")  # only to see that the texts say something
    name = lambda t: (F.length(t) <= lang.IDENTIFIER_CHARS) & (((F.upper(t) == t) & (F.lower(t) != t)) | F.substring(t, 2, 100).rlike(r"\p{Lu}"))
    text = F.col("text")
    df = spark.createDataFrame(rows, "n int, text string").select("text", lang.kept_letters(text).alias("got"), F.array_join(F.filter(lang.letter_words(text), lambda t: ~name(t)), "").alias("want"))
    found = df.collect()
    assert [r for r in found if r.got != r.want] == [] and sum(bool(words.search(r.want)) for r in found) > 3000
