"""Quality rules: minimum-covariance-determinant estimates for each language and source, and Mahalanobis distances.

DataFrame operations only. Each text gives a vector of transformed statistics. For each group of language and source the
determinant's subset is sought by concentration steps: from medians and mean absolute deviations, each step keeps the half
of the rows that lie nearest, and takes their mean and covariance. The last estimate is scaled to a median distance of the
chi-square law, rows within its 97.5 % point are used once more (reweighting), and rows beyond `CUT` are rejected.

A statistic that is the same for most rows (most texts repeat no line) would make a covariance singular, so each variance
has a floor: the spread below which differences of that statistic are no sign of poor quality. Groups of fewer than
`LEAST_ROWS` rows are judged together with the small groups of their language, and these, if still too few, with all such.

Rows never leave their place: group sums are aggregated first, and come back by a broadcast of which the number of groups
is checked; beyond `GROUP_LIMIT` they come by a join on salted keys. A group's median is approximate (percentile_approx),
so a row that ties with it may fall on either side.

Defined results: a null or empty text has no words, so it fails the base rule; a null language or source is a group of its
own; repeated rows are judged one by one; groups that stay too small reject nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import SPACE_CLASS, documents, stage

#: Texts that the base rule fails: too few words, or more than a fifth of them in repeated windows.
BASE_WORDS, BASE_REPEAT_PERCENT = 10, 20
WINDOW = 5
LEAST_ROWS = 60
STEPS = 4
GROUP_LIMIT = 20_000
SALTS = 32

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÆÇÈÉÊËÍÌÎÏÑÓÒÔÖÚÙÛÜŒ"
MARKS = "!?"

#: Statistic: the least spread (standard deviation) that counts.
FLOORS = {"size": 0.5, "word_length": 0.08, "symbols": 0.02, "repeated_lines": 0.1, "repeated_words": 0.1, "capitals": 0.04, "marks": 0.02}
DIMENSION = len(FLOORS)


def chi_square(p: float, k: int) -> float:
    """The quantile `p` of the chi-square law with `k` degrees, by bisection of the series of its distribution function."""

    def below(x: float) -> float:
        term = total = 1 / math.gamma(k / 2 + 1)
        for n in range(1, 400):
            term *= x / 2 / (k / 2 + n)
            total += term
        return total * math.exp(-x / 2) * (x / 2) ** (k / 2)

    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return (lo + hi) / 2


#: Squared distance beyond which a row is rejected. The statistics have longer tails than a normal law, hence far out.
CUT = 10 * chi_square(0.999, DIMENSION)


def let(value: Column, body) -> Column:
    """`body` of `value`, with the value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in a WINDOW-word window that occurs at least twice."""

    def covered(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"])))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"))
        return F.aggregate(places, start, step)["n"]

    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    count = let(hashes, lambda h: let(windows(h), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(count)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("text"), F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "").alias("words"), F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, SPACES, "")) > 0).alias("lines"))
    lost = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")
    return base.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"), lost(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), lost(CAPITALS).alias("n_capitals"), lost(MARKS).alias("n_marks"),
    ).withColumn("base_failed", (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words")))


def vector() -> dict[str, Column]:
    """The transformed statistics."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "size": F.log1p("n_words"), "word_length": F.log1p(share("word_chars", "n_words")), "symbols": F.sqrt(share("n_symbols", "word_chars")) / 2, "repeated_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": F.sqrt(share("n_repeat_words", "n_words")), "capitals": F.sqrt(share("n_capitals", "word_chars")) / 2, "marks": F.sqrt(share("n_marks", "word_chars")) / 2,
    }


def grouped(rows: DataFrame) -> DataFrame:
    """Adds g_lang, g_source, g_level: each row's group, large enough where that is possible. Null keys are a group of their own."""
    keyed = rows.withColumn("k_lang", F.coalesce(F.col("lang").cast("string"), F.lit("\x00"))).withColumn("k_source", F.coalesce(F.col("source").cast("string"), F.lit("\x00")))
    sizes = keyed.where("NOT base_failed").groupBy("k_lang", "k_source").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window as W

    small = F.col("n") < LEAST_ROWS
    pool = F.sum(F.when(small, F.col("n")).otherwise(0)).over(W.partitionBy("k_lang"))
    level = F.when(~small, 0).when(pool >= LEAST_ROWS, 1).otherwise(2)
    sizes = stage(sizes.withColumn("g_level", level).select("k_lang", "k_source", "g_level"), "group_sizes")
    out = with_groups(keyed, sizes, ["k_lang", "k_source"]).withColumn("g_level", F.coalesce("g_level", F.lit(2)))
    return out.withColumn("g_lang", F.when(F.col("g_level") < 2, F.col("k_lang")).otherwise("")).withColumn("g_source", F.when(F.col("g_level") == 0, F.col("k_source")).otherwise("")).drop("k_lang", "k_source")


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with their group's columns: by broadcast while the groups are few, else on keys salted over SALTS."""
    if groups.count() <= GROUP_LIMIT:
        return rows.join(F.broadcast(groups), keys, "left")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], "left").drop("salt")


KEYS = ["g_level", "g_lang", "g_source"]
NAMES = [*FLOORS]


def estimate(rows: DataFrame, used: Column) -> DataFrame:
    """Mean and precision matrix of each group's rows for which `used` holds. The matrix is inverted by sweeping out each pivot."""
    p = DIMENSION
    pick = lambda c: F.sum(F.when(used, c))
    sums = rows.groupBy(*KEYS).agg(F.sum(used.cast("long")).alias("n"), *(pick(F.col(a)).alias(f"s{i}") for i, a in enumerate(NAMES)), *(pick(F.col(a) * F.col(b)).alias(f"q{i}_{j}") for i, a in enumerate(NAMES) for j, b in enumerate(NAMES) if j <= i))
    mean = [F.col(f"s{i}") / F.col("n") for i in range(p)]
    covariance = [F.col(f"q{max(i, j)}_{min(i, j)}") / F.col("n") - mean[i] * mean[j] + (FLOORS[NAMES[i]] ** 2 if i == j else 0.0) for i in range(p) for j in range(p)]

    def sweep(m: Column, k: Column) -> Column:
        at = lambda i, j: F.get(m, (i * p + j).cast("int"))

        def cell(t: Column) -> Column:
            i, j, d = F.floor(t / p), t % p, at(k, k)
            return F.when((i == k) & (j == k), -1 / d).when(i == k, at(k, j) / d).when(j == k, at(i, k) / d).otherwise(at(i, j) - at(i, k) * at(k, j) / d)

        return F.transform(F.sequence(F.lit(0), F.lit(p * p - 1)), cell)

    swept = F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), F.col("covariance"), sweep)
    return sums.where("n > 0").select(*KEYS, "n", F.array(*mean).alias("mean"), F.array(*covariance).alias("covariance")).select(*KEYS, "n", "mean", F.transform(swept, lambda v: -v).alias("precision"))


def distance() -> Column:
    """Squared Mahalanobis distance of a row with its group's mean and precision."""
    d = [F.col(a) - F.col("mean")[i] for i, a in enumerate(NAMES)]
    out = F.lit(0.0)
    for i in range(DIMENSION):
        for j in range(i + 1):
            out = out + (1.0 if i == j else 2.0) * d[i] * d[j] * F.col("precision")[i * DIMENSION + j]
    return out


def judge(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """The counts, base_failed, distance (squared, scaled) and kept of each row."""
    rows = stage(grouped(statistics(docs)).withColumns(vector()), "statistics")
    fair = rows.where("NOT base_failed").select("doc_id", *KEYS, *NAMES)

    def quantile(frame: DataFrame, of: list[tuple[str, Column]], p: float = 0.5) -> DataFrame:
        return frame.groupBy(*KEYS).agg(*(F.percentile_approx(c, p, 2000).alias(name) for name, c in of))

    def settled(groups: DataFrame, name: str) -> DataFrame:
        return stage(groups, name)

    medians = settled(quantile(fair, [(f"m{i}", F.col(a)) for i, a in enumerate(NAMES)]), "medians")
    near = with_groups(fair, medians, KEYS)
    spread = settled(near.groupBy(*KEYS).agg(F.array(*(F.first(f"m{i}") for i in range(DIMENSION))).alias("mean"), *(F.avg(F.abs(F.col(a) - F.col(f"m{i}"))).alias(f"d{i}") for i, a in enumerate(NAMES))), "spread")
    diagonal = F.array(*(1 / (F.col(f"d{i // DIMENSION}") ** 2 + FLOORS[NAMES[i // DIMENSION]] ** 2) if i % (DIMENSION + 1) == 0 else F.lit(0.0) for i in range(DIMENSION**2)))
    groups = settled(spread.select(*KEYS, "mean", diagonal.alias("precision")), "start")
    for step in range(STEPS + 1):
        placed = with_groups(fair, groups, KEYS).withColumn("d", distance())
        middle = settled(quantile(placed, [("middle", F.col("d"))]), "middle")
        # The last round reweights: all rows that the scaled estimate finds ordinary, not the nearest half alone.
        most = F.col("middle") if step < STEPS else F.col("middle") * (chi_square(0.975, DIMENSION) / chi_square(0.5, DIMENSION))
        groups = settled(estimate(with_groups(placed, middle, KEYS), F.col("d") <= most), "estimate")
    middle = settled(quantile(with_groups(fair, groups, KEYS).withColumn("d", distance()), [("middle", F.col("d"))]), "middle")
    scale = F.greatest(F.col("middle") / chi_square(0.5, DIMENSION), F.lit(1e-9))
    final = settled(groups.where(F.col("n") >= LEAST_ROWS // 2).join(middle, KEYS).select(*KEYS, "mean", "precision", scale.alias("scale")), "final")
    judged = with_groups(rows, final, KEYS).withColumn("distance", distance() / F.col("scale"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cut)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
