"""Study scheduling for all learners at once: the steps each material still needs, their pairing, and their placement day by day.

A material is one row (owner, document, study state, deadline, target); its steps follow from a table of rules in column
expressions. Placement is greedy over a learner's days, each choice depending on those before, so it runs as a fold: Spark
brings a learner's materials and free intervals together as one row (some materials, at most 43 days), and Arrow batches of
such rows are worked off in tasks. Reports and risks are aggregates of what comes out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lectern.functions.staging import cut
from lectern.operators import intervals
from lectern.sources.tables import table

# Lengths in minutes, days, weights and limits of planning.
MINUTES = {"summary": 45, "flashcards": 20, "quiz": 35, "quiz_retry": 35, "review": 30, "final_review": 45, "light_review": 20}
REVIEW_DAYS = ((50.0, 1), (75.0, 2), (85.0, 3))
LAST_REVIEW_DAYS = 5
RELEARN_BELOW = 40.0
CLOSE_DAYS, FINAL_WINDOW, FINAL_FALLBACK, SPREAD_DAYS, HORIZON, LONGEST_HORIZON = 3, 2, 4, 7, 14, 42
WEIGHTS = {"deadline": 0.35, "review": 0.35, "performance": 0.20, "workload": 0.10}
REVIEW_NEED = {"learn": 0.3, "finish": 0.9, "review": 0.7, "final": 1.0}
PERFORMANCE_NEED = {"low_quiz_score": 1.0, "moderate_quiz_score": 0.6, "quiz_in_progress": 0.5, "study_started": 0.5, "no_study_activity": 0.5, "strong_quiz_score": 0.2, "marked_completed": 0.1}
OVERDUE_NEED, TARGET_SHARE = 0.1, 0.5
SAME_DAY, STARVED_DAYS, STARVED, PRESSURE_SHARE, PRESSURE, CRITICAL, LAST_CHANCE = -0.15, 3, 0.15, 0.5, 0.5, 1.0, 1.0
DAILY_TARGET, SHORTEST, GAP, HEAVY_GAP, HEAVY_A_DAY, DOCUMENT_A_DAY, GRID = 90, 20, 20, 30, 2, 2, 5
HEAVY, RETRIEVAL = ("summary", "quiz", "quiz_retry"), ("quiz", "quiz_retry")
SPLITS = {"summary+flashcards": (20, 15), "summary+quiz": (15, 20), "flashcards+quiz": (15, 20)}
SHORT_TARGET, WEAK_BELOW, STRONG_FROM, TIGHT_DAYS = 60, 60.0, 80.0, 1.5

STEP = "struct<activity:string,reason:string,preparation:string,kind:string,minutes:int,earliest:date,latest:date,gap_days:int,artifact:string>"


def review_days(percentage: Column) -> Column:
    out = F.when(percentage < REVIEW_DAYS[0][0], REVIEW_DAYS[0][1])
    for below, days in REVIEW_DAYS[1:]:
        out = out.when(percentage < below, days)
    return out.otherwise(LAST_REVIEW_DAYS)


def study_steps(materials: DataFrame) -> DataFrame:
    """Each material with `steps`, an array in order, empty where nothing is to be planned.

    Needs owner_id, document_id, code, summary_available, summary_done, cards, cards_done, quizzes, quiz_status, quiz_id,
    percentage, completed_on, weak (a topic is clearly weak), deadline, target, today, horizon_end.
    """
    c, today, deadline = F.col, F.col("today"), F.col("deadline")
    rows = materials.withColumn("latest", F.when(deadline.isNotNull(), F.greatest(today, F.date_sub(deadline, 1))).otherwise(c("horizon_end")))
    rows = rows.withColumn("final_start", F.when(deadline.isNotNull(), F.greatest(today, F.date_sub(deadline, FINAL_WINDOW))))
    rows = rows.withColumn("due", F.date_add(F.coalesce("completed_on", today), review_days(c("percentage"))))
    learn = F.when(F.datediff(deadline, today) <= CLOSE_DAYS, "deadline_approaching").otherwise("new_material")

    def step(when: Column, activity: str, reason: Column | str, kind: str, earliest: Column = today, gap: Column | int = 0, preparation: Column | str | None = None, artifact: Column | None = None, length: str | None = None, clip: bool = True) -> Column:
        first = F.least(F.greatest(earliest, today), c("latest")) if clip else earliest
        value = F.struct(F.lit(activity), reason if isinstance(reason, Column) else F.lit(reason), preparation if isinstance(preparation, Column) else F.lit(preparation).cast("string"), F.lit(kind), F.lit(MINUTES[length or activity]), first, c("latest"), (gap if isinstance(gap, Column) else F.lit(gap)).cast("int"), F.lit(None).cast("string") if artifact is None else artifact)
        return F.when(when, value.cast(STEP))

    code, cards, due, quiz = c("code"), c("cards") > 0, c("due"), c("quiz_id")
    new = code.isin("no_study_activity", "study_started")
    waiting = new & (c("quizzes") > 0) & (c("quiz_status") == "not_started")
    read, practise = new & ~(c("summary_available") & c("summary_done")), F.when(cards, ~c("cards_done")).otherwise(~waiting) & new
    low, moderate, strong = code == "low_quiz_score", code == "moderate_quiz_score", code == "strong_quiz_score"
    very_low = low & (c("percentage") < RELEARN_BELOW)
    slow = low & ~very_low
    early = c("final_start").isNull() | (due < c("final_start"))
    again = F.date_add(due, review_days(c("percentage")) * 2)
    generate = F.when(~c("summary_available"), "generate_summary")
    practice_gap = F.when(cards, 1).otherwise(0)
    steps = [
        step((code == "quiz_in_progress"), "quiz", "quiz_in_progress", "finish", artifact=F.when(c("quiz_status") == "in_progress", quiz)),
        step(read, "summary", learn, "learn", preparation=generate),
        step(practise, "flashcards", learn, "learn", preparation=F.when(~cards, "create_flashcards")),
        step(new, "quiz", learn, "learn", gap=F.when(read | practise, 1).otherwise(0), preparation=F.when(~waiting, "create_quiz"), artifact=F.when(waiting, quiz)),
        step(new & deadline.isNull(), "review", "review_due", "review", gap=2),
        step(very_low, "summary", "low_quiz_score", "review", due, preparation=generate),
        step(very_low & cards, "review", "low_quiz_score", "review"),
        step(very_low & cards, "flashcards", "retrieval_practice", "review"),
        step(very_low & ~cards, "flashcards", "low_quiz_score", "review", preparation="create_flashcards"),
        step(slow, "review", "low_quiz_score", "review", due),
        step(slow & cards, "flashcards", "retrieval_practice", "review"),
        step(low, "quiz_retry", "low_quiz_score", "review", gap=1, artifact=quiz),
        step(moderate & early, "review", "review_due", "review", due),
        step(moderate & cards, "flashcards", "retrieval_practice", "review", due, practice_gap),
        step(moderate, "quiz_retry", "review_due", "review", due, F.lit(2) - practice_gap, artifact=quiz),
        step(strong & early & c("weak"), "review", "review_due", "review", due),
        step(strong & early & ~c("weak"), "review", "review_due", "review", due, length="light_review"),
        step(strong & early & ~c("weak") & (again <= c("latest")) & (c("final_start").isNull() | (again < c("final_start"))), "review", "review_due", "review", again, length="light_review"),
        step(deadline.isNotNull(), "review", "final_review", "final", c("final_start"), length="final_review", clip=False),
    ]
    found = F.array_compact(F.array(*steps))
    return rows.withColumn("steps", F.when(F.coalesce(deadline < today, F.lit(False)), F.slice(found, 1, 0)).otherwise(found)).drop("latest", "final_start", "due")


def step_rows(planned: DataFrame) -> DataFrame:
    """One row for each step, numbered from 0."""
    keep = ["owner_id", "document_id", "deadline", "today", "horizon_end", "percentage"]
    return planned.select(*keep, F.posexplode("steps").alias("step_no", "s")).select(*keep, "step_no", "s.*")


def combine(rows: DataFrame, daily_target: int = DAILY_TARGET) -> DataFrame:
    """Neighbouring steps that make one session. In a run of steps that could each pair with the next, every other one does."""
    own = W.partitionBy("owner_id", "document_id")
    order, c = own.orderBy("step_no"), F.col
    kind = lambda a: F.when(a == "quiz_retry", "quiz").otherwise(a)
    names = ["activity", "preparation", "kind", "minutes", "earliest", "latest", "gap_days", "artifact"]
    rows = rows.withColumn("n", F.lead(F.struct(*names)).over(order)).withColumn("steps", F.count(F.lit(1)).over(own))
    close = F.coalesce(F.datediff("deadline", "today") <= CLOSE_DAYS, F.lit(False))
    end = F.when(c("deadline").isNotNull(), F.date_sub("deadline", 1)).otherwise(F.least("horizon_end", F.date_add("today", SPREAD_DAYS - 1)))
    tight = close | ((c("steps") > 1) & (F.greatest(F.lit(1), F.datediff(end, "today") + 1) / c("steps") < TIGHT_DAYS))
    pair = F.concat(kind(c("activity")), F.lit("+"), kind(c("n.activity")))
    both_new = F.coalesce((c("preparation") == "create_flashcards") & (c("n.preparation") == "create_quiz"), F.lit(False))
    fits = pair.isin(*SPLITS) & ~c("kind").isin("finish", "final") & ~c("n.kind").isin("finish", "final") & ((c("n.gap_days") == 0) | tight) & ~both_new & (F.greatest("earliest", "n.earliest") <= F.least("latest", "n.latest"))
    rows = rows.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("pair", pair)
    begins = F.when(c("fits") & ~F.coalesce(F.lag("fits").over(order), F.lit(False)), c("step_no"))
    first = c("fits") & ((c("step_no") - F.last(begins, True).over(order.rowsBetween(W.unboundedPreceding, 0))) % 2 == 0)
    rows = rows.withColumn("first", F.coalesce(first, F.lit(False))).withColumn("second", F.coalesce(F.lag("first").over(order), F.lit(False))).where("NOT second")
    shift = F.when(c("percentage") < WEAK_BELOW, 5).when(F.lit(daily_target <= SHORT_TARGET) | F.coalesce(c("percentage") >= STRONG_FROM, F.lit(False)), -5).otherwise(0)
    part = lambda k: F.coalesce(*(F.when(c("pair") == p, m[k]) for p, m in SPLITS.items()))
    pick = lambda joined, single: F.when(c("first"), joined).otherwise(single)
    return rows.select(
        "owner_id", "document_id", "step_no", pick(F.concat("activity", F.lit("+"), "n.activity"), c("activity")).alias("activity"), "reason",
        pick(F.concat_ws("+", "preparation", "n.preparation"), F.coalesce("preparation", F.lit(""))).alias("preparation"), "kind",
        pick(part(0) + shift + part(1), c("minutes")).alias("minutes"), pick(F.greatest("earliest", "n.earliest"), c("earliest")).alias("earliest"), pick(F.least("latest", "n.latest"), c("latest")).alias("latest"), "gap_days",
        pick(F.coalesce("n.artifact", "artifact"), c("artifact")).alias("artifact"),
    )


class Days:
    """A learner's days from today (0) to the horizon: free intervals, what each day can hold, and sums over days to come."""

    def __init__(self, free: dict[int, list[tuple[int, int]]], end: int):
        self.free = {d: sorted(v) for d, v in free.items() if 0 <= d <= end}
        self.end, self.room = end, [0] * (end + 1)
        for d, spans in self.free.items():
            self.room[d] = min(DAILY_TARGET, sum(e - s for s, e in spans))
        self.usable = [d for d, m in enumerate(self.room) if m >= SHORTEST]
        self.minutes, self.open = [0], [0]
        for m in self.room:
            self.minutes.append(self.minutes[-1] + m)
            self.open.append(self.open[-1] + (m > 0))

    def left(self, day: int, last: int, used: int) -> tuple[int, int]:
        """Minutes, and days with any, from `day` (of which `used` are gone) to `last`."""
        if last < day:
            return 0, 0
        now, a, b = self.room[day] - used, day + 1, min(last, self.end) + 1
        return now + self.minutes[b] - self.minutes[a], (now > 0) + self.open[b] - self.open[a]

    def fits_later(self, day: int, last: int, minutes: int) -> bool:
        return any(self.room[d] >= minutes for d in range(day + 1, min(last, self.end) + 1))

    def between(self, first: int, last: int) -> list[int]:
        return self.usable[bisect_left(self.usable, first) : bisect_right(self.usable, last)]

    def slot(self, day: int, after: int, minutes: int) -> int | None:
        for s, e in self.free.get(day, ()):
            at = -(-max(s, after) // GRID) * GRID
            if at + minutes <= e:
                return at
        return None


class Material:
    """A material's steps and how far they are placed; days count from today."""

    def __init__(self, row: dict, days: Days):
        self.id, self.deadline, self.target, self.need = row["document_id"], row["deadline"], row["target"], row["need"]
        self.steps = [dict(s) for s in row["steps"]]
        self.at, self.last, self.last_retrieval, self.by_day, self.pace = 0, None, False, {}, {}
        n = len(self.steps)
        self.minutes_from, self.gaps_from, self.empty_from = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            s = self.steps[i]
            self.minutes_from[i] = self.minutes_from[i + 1] + s["minutes"]
            self.gaps_from[i] = self.gaps_from[i + 1] + s["gap_days"]
            self.empty_from[i] = self.empty_from[i + 1] + max(0, s["gap_days"] - 1)
        self.final = self.steps[-1] if n and self.steps[-1]["kind"] == "final" else None
        if self.final and not days.between(self.final["earliest"], self.final["latest"]):
            earlier = days.between(max(0, self.deadline - FINAL_FALLBACK), self.final["earliest"] - 1)
            if earlier:  # a final review without a usable day in its window moves before it
                self.final["earliest"] = earlier[-1]
        if self.deadline is not None:
            end = self.final["earliest"] - 1 if self.final else self.steps[-1]["latest"] if n else 0
        else:
            end = min(days.end, SPREAD_DAYS - 1)
        end = end if self.target is None else min(end, self.target)
        self.spread_end = end if end >= 0 else None

    @property
    def step(self) -> dict | None:
        return self.steps[self.at] if self.at < len(self.steps) else None

    def spread(self, rank: int, of: int, days: Days) -> None:
        """Preferred days of the steps, evenly over the usable days, materials one after the other."""
        paced = [i for i, s in enumerate(self.steps) if s["kind"] in ("learn", "review")]
        if self.spread_end is None or not paced:
            return
        first = self.steps[paced[0]]
        start = max(0, first["earliest"])
        over = days.between(start, self.spread_end)
        if self.deadline is None and self.target is None and len(over) < len(paced):
            over = days.between(start, days.end)[: len(paced)]
            self.spread_end = max([self.spread_end, *over[-1:]])
        if len(over) < 2:
            return
        stride = len(over) / len(paced)
        shift = 0 if first["reason"] in ("low_quiz_score", "review_due") else min(rank / of * stride, rank)
        for k, i in enumerate(paced):
            self.pace[i] = max(over[min(len(over) - 1, int(k * stride + shift + 0.5))], self.steps[i]["earliest"])

    def ready(self) -> int:
        if self.last is None:
            return self.step["earliest"]
        wait = max(self.step["gap_days"], int(self.step["kind"] == "final" and self.last_retrieval))
        return max(self.step["earliest"], self.last + wait)

    def covered(self) -> bool:
        """The final review that stands next is covered by a quiz within its window."""
        return self.step["kind"] == "final" and self.last_retrieval and self.last is not None and self.last >= self.step["earliest"]

    def short_of_time(self, day: int, days: Days, used: int) -> bool:
        end = self.deadline - 1 if self.deadline is not None else self.target
        if end is None:
            return False
        minutes, left = days.left(day, end, used)
        return not minutes or self.minutes_from[self.at] / minutes >= PRESSURE_SHARE or left < len(self.steps) - self.at + self.empty_from[self.at + 1]

    def second_today(self, day: int, days: Days) -> bool:
        """Nothing is placed that day yet, or the days to come are fewer than the steps."""
        if not self.by_day.get(day):
            return True
        end = self.steps[-1]["latest"] if self.spread_end is None else self.spread_end
        return len(days.between(day + 1, end)) < len(self.steps) - self.at

    def priority(self, day: int, most: int, days: Days, used: int) -> float:
        """G13 with the guardrails of G14."""
        near = lambda d: max(0.0, min(1.0, 1 - (d - day) / HORIZON))
        step = self.step
        urgency = near(self.deadline) if self.deadline is not None else 0.0
        if self.target is not None:
            urgency = max(urgency, TARGET_SHARE * near(self.target))
        review = REVIEW_NEED[step["kind"]]
        if step["kind"] == "review":
            review = min(1.0, review + OVERDUE_NEED * max(0, day - step["earliest"]))
        base = WEIGHTS["deadline"] * urgency + WEIGHTS["review"] * review + WEIGHTS["performance"] * self.need + WEIGHTS["workload"] * (self.minutes_from[self.at] / most if most else 0.0)
        more = SAME_DAY * self.by_day.get(day, 0)
        if self.last is None or day - self.last >= STARVED_DAYS:
            more += STARVED
        if self.deadline is not None:
            minutes, left = days.left(day, self.steps[-1]["latest"], used)
            if not minutes or self.minutes_from[self.at] / minutes >= PRESSURE_SHARE:
                more += PRESSURE
            if left <= 1 + self.gaps_from[self.at + 1]:
                more += CRITICAL
            if not days.fits_later(day, step["latest"], step["minutes"]):
                more += LAST_CHANCE
        return base + more


def place(rows: list[dict], days: Days, spread: bool, pace_deadlines: bool) -> tuple[list[tuple], int]:
    """G17 for one learner: (document, step_no, day or None, start minute, priority) of every step that isn't covered, and the minutes not placed."""
    materials = [Material(r, days) for r in rows]
    key = lambda m: (m.deadline if m.deadline is not None else 1 << 30, m.id)
    balanced = {m.id: pace_deadlines or m.deadline is None for m in materials}
    if spread:
        ranked = sorted(materials, key=lambda m: (key(m)[0], m.target if m.target is not None else 1 << 30, m.id))
        for rank, m in enumerate(ranked):
            if balanced[m.id]:
                m.spread(rank, len(ranked), days)
    placed: list[tuple] = []
    missed = 0

    def skip(m: Material) -> None:
        nonlocal missed
        if not m.covered():
            placed.append((m.id, m.step["step_no"], None, None, None))
            missed += m.step["minutes"]
        m.at += 1

    for day in range(days.end + 1):
        for m in materials:
            while m.step and m.step["latest"] < day:
                skip(m)
        end, used, heavy, after_heavy = None, 0, 0, False
        while True:
            ready = [m for m in materials if m.step and m.ready() <= day and m.by_day.get(day, 0) < DOCUMENT_A_DAY]
            if spread:
                ready = [m for m in ready if not balanced[m.id] or m.short_of_time(day, days, used) or day >= m.pace.get(m.at, day) and m.second_today(day, days)]
            most = max((m.minutes_from[m.at] for m in materials), default=0)
            for score, m in sorted(((m.priority(day, most, days, used), m) for m in ready), key=lambda x: (-x[0], *key(x[1]))):
                step = m.step
                if used + step["minutes"] > DAILY_TARGET or step["heavy"] and heavy >= HEAVY_A_DAY:
                    continue
                at = days.slot(day, 0 if end is None else end + (HEAVY_GAP if step["heavy"] and after_heavy else GAP), step["minutes"])
                if at is None:
                    continue
                placed.append((m.id, step["step_no"], day, at, round(score, 4)))
                end, used, after_heavy = at + step["minutes"], used + step["minutes"], step["heavy"]
                heavy += step["heavy"]
                m.by_day[day] = m.by_day.get(day, 0) + 1
                m.last, m.last_retrieval, m.at = day, step["retrieval"], m.at + 1
                break
            else:
                break
    for m in materials:
        while m.step:
            skip(m)
    return placed, missed


def schedule(materials: DataFrame, free: DataFrame, spread: bool = True, pace_deadlines: bool = True) -> DataFrame:
    """Every step of every material, with its day and minutes, or without where it found no place; steps that a quiz covers are left out.

    materials: owner_id, document_id, code, deadline, target, today, horizon_end (one of each a learner), and their steps as rows
    in `steps` (step_no and the columns of `combine`); free: owner_id, day, s, e. Spread placement is kept unless it leaves out
    more minutes than placing early.
    """
    days = lambda d: F.datediff(d, "today")
    steps = F.transform("steps", lambda s: F.struct(s["step_no"].alias("step_no"), s["minutes"].alias("minutes"), s["kind"].alias("kind"), s["reason"].alias("reason"), days(s["earliest"]).alias("earliest"), days(s["latest"]).alias("latest"), s["gap_days"].alias("gap_days"), F.arrays_overlap(F.split(s["activity"], r"\+"), F.array(*map(F.lit, HEAVY))).alias("heavy"), F.element_at(F.split(s["activity"], r"\+"), -1).isin(*RETRIEVAL).alias("retrieval")))
    need = F.coalesce(*(F.when(F.col("code") == k, v) for k, v in PERFORMANCE_NEED.items()), F.lit(0.5))
    row = F.struct("document_id", days("deadline").alias("deadline"), F.when(F.col("target") >= F.col("today"), days("target")).alias("target"), need.alias("need"), steps.alias("steps"))
    learners = materials.select("owner_id", "today", "horizon_end", row.alias("row")).groupBy("owner_id", "today", "horizon_end").agg(F.sort_array(F.collect_list("row")).alias("materials"))
    spans = free.groupBy("owner_id").agg(F.collect_list(F.struct("day", "s", "e")).alias("free"))
    rows = learners.join(spans, "owner_id", "left").select("owner_id", days("horizon_end").alias("end"), "materials", F.transform("free", lambda x: F.struct(days(x["day"]).alias("day"), x["s"].alias("s"), x["e"].alias("e"))).alias("free"), "today")
    id_types = {f: t for f, t in materials.dtypes if f in ("owner_id", "document_id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                free_of: dict[int, list] = {}
                for x in r["free"] or ():
                    free_of.setdefault(x["day"], []).append((x["s"], x["e"]))
                span = Days(free_of, r["end"])
                placed, missed = place(r["materials"], span, spread, pace_deadlines)
                if spread and missed:
                    early, less = place(r["materials"], span, False, pace_deadlines)
                    if less < missed:
                        placed = early
                out += [(r["owner_id"], d, n, day, at, score) for d, n, day, at, score in placed]
            arrays = [batch.column("owner_id").slice(0, 0)] if not out else [pa.array([x[0] for x in out], batch.column("owner_id").type)]
            kinds = (batch.column("materials").type.value_type.field("document_id").type, pa.int32(), pa.int32(), pa.int32(), pa.float64())
            arrays += [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds, 1)]
            yield pa.RecordBatch.from_arrays(arrays, ["owner_id", "document_id", "step_no", "offset", "s", "priority"])

    found = rows.mapInArrow(run, f"owner_id {id_types['owner_id']}, document_id {id_types['document_id']}, step_no int, offset int, s int, priority double")
    known = materials.select("owner_id", "document_id", "deadline", "today", F.explode("steps").alias("x")).select("owner_id", "document_id", "deadline", "today", "x.*")
    out = known.join(found, ["owner_id", "document_id", "step_no"])
    return out.select("owner_id", "document_id", "step_no", "activity", "reason", "minutes", "deadline", F.date_add("today", F.col("offset")).alias("day"), "s", (F.col("s") + F.col("minutes")).alias("e"), "priority")


def with_steps(planned: DataFrame, rows: DataFrame) -> DataFrame:
    """The materials with their step rows as the array that `schedule` takes."""
    names = ["step_no", "activity", "reason", "kind", "minutes", "earliest", "latest", "gap_days"]
    found = rows.groupBy("owner_id", "document_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("found"))
    out = planned.drop("steps").join(found, ["owner_id", "document_id"], "left")
    return out.withColumn("steps", F.coalesce("found", F.array().cast(found.schema["found"].dataType))).drop("found")


def capacity_report(materials: DataFrame, scheduled: DataFrame, free: DataFrame) -> DataFrame:
    """Minutes asked for, placed and missing, against what a learner's days up to the horizon hold; on_track if nothing is missing."""
    minutes = lambda when: F.sum(F.when(when, F.col("minutes")).otherwise(0)).cast("long")
    asked = scheduled.groupBy("owner_id").agg(minutes(F.col("day").isNotNull()).alias("scheduled_minutes"), minutes(F.col("day").isNull()).alias("shortfall_minutes"))
    learners = materials.groupBy("owner_id").agg(F.first("today").alias("today"), F.first("horizon_end").alias("horizon_end"))
    days = intervals.daily_capacity(free.join(learners, "owner_id").where("day BETWEEN today AND horizon_end"), DAILY_TARGET)
    held = days.groupBy("owner_id").agg(F.sum("capacity").alias("schedulable_minutes"), F.sum("free_minutes").alias("available_minutes"))
    rows = learners.select("owner_id").join(asked, "owner_id", "left").join(held, "owner_id", "left").na.fill(0)
    return rows.select("owner_id", (F.col("scheduled_minutes") + F.col("shortfall_minutes")).alias("required_minutes"), "scheduled_minutes", "shortfall_minutes", "schedulable_minutes", "available_minutes", F.when(F.col("shortfall_minutes") == 0, "on_track").otherwise("at_risk").alias("status"))


def deadline_risks(scheduled: DataFrame) -> DataFrame:
    """Materials of which some step found no place: how many and how long, whether the final review is among them, and the last that did."""
    missing, count = F.col("day").isNull(), lambda when: F.sum(when.cast("long"))
    last = F.max(F.when(~missing, F.struct("day", "s")))
    rows = scheduled.groupBy("owner_id", "document_id", "deadline").agg(count(missing).alias("unscheduled_count"), F.sum(F.when(missing, F.col("minutes"))).cast("long").alias("shortfall_minutes"), F.max(missing & (F.col("reason") == "final_review")).alias("final_review_missing"), count(~missing).alias("scheduled_count"), last.alias("last"))
    return rows.where("unscheduled_count > 0").select("owner_id", "document_id", "deadline", "unscheduled_count", "shortfall_minutes", "final_review_missing", "scheduled_count", F.col("last.day").alias("last_day"), F.col("last.s").alias("last_start"))


TODAY = "2002-01-01"


def _materials(spark: SparkSession, d: str) -> DataFrame:
    """Study states of a customer's orders of one priority, from their keys, number and price."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("owner_id"), F.col("o_orderpriority").alias("document_id"))
    m = o.agg(F.max("o_orderkey").alias("k"), F.count(F.lit(1)).alias("n"), F.floor(F.max("o_totalprice")).cast("long").alias("p"))
    k, p, today = F.col("k"), F.col("p"), F.lit(TODAY).cast("date")
    code = F.element_at(F.array(*map(F.lit, ("no_study_activity", "study_started", "quiz_in_progress", "low_quiz_score", "moderate_quiz_score", "strong_quiz_score", "marked_completed"))), (k % 7 + 1).cast("int"))
    plus = lambda days: F.date_add(today, days.cast("int"))
    m = m.select(
        "owner_id", "document_id", code.alias("code"), F.when(code == "low_quiz_score", p % 60).when(code == "moderate_quiz_score", p % 20 + 60).when(code == "strong_quiz_score", p % 21 + 80).cast("double").alias("percentage"),
        (k % 2 == 0).alias("summary_available"), (k % 5 == 0).alias("summary_done"), (k % 3 * 5).alias("cards"), (k % 11 == 0).alias("cards_done"), (k % 4).alias("quizzes"),
        F.when(code == "quiz_in_progress", F.when(k % 2 == 0, "in_progress").otherwise("completed")).when(k % 4 == 1, "not_started").otherwise("completed").alias("quiz_status"),
        F.concat(F.lit("quiz-"), k.cast("string")).alias("quiz_id"), plus(-(k % 9)).alias("completed_on"), (k % 13 == 0).alias("weak"),
        F.when(F.col("n") % 3 != 0, plus(p % 25 - 2)).alias("deadline"), F.when(k % 6 == 0, plus(p % 12 - 1)).alias("target"), today.alias("today"),
    )
    own = W.partitionBy("owner_id")
    last, open_ended = F.max("deadline").over(own), F.max(F.col("deadline").isNull()).over(own)
    default = F.date_add("today", HORIZON)
    end = F.when(last.isNull(), default).when(open_ended, F.greatest(F.date_sub(last, 1), "today", default)).otherwise(F.greatest(F.date_sub(last, 1), "today"))
    return m.withColumn("horizon_end", F.least(end, F.date_add("today", LONGEST_HORIZON)))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Free time of each customer over the longest horizon: windows on two days of three, less the time around sessions that orders stand for."""
    o, today = table(spark, d, "orders"), F.lit(TODAY).cast("date")
    days = o.select(F.col("o_custkey").alias("owner_id")).distinct().select("owner_id", F.explode(F.sequence(today, F.date_add(today, LONGEST_HORIZON))).alias("day"))
    days = days.where((F.col("owner_id") + F.weekday("day")) % 3 != 0)
    windows = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in (*intervals.FREE_WINDOWS, (1200, 1215))))
    free = days.select("owner_id", "day", F.explode(windows).alias("w")).select("owner_id", "day", "w.s", "w.e")
    k = F.col("o_orderkey")
    busy = o.select(F.col("o_custkey").alias("owner_id"), F.date_add(today, (k % 43).cast("int")).alias("day"), (k % 40 * 15 + 480).cast("int").alias("s"), (k % 40 * 15 + 510 + k % 75).cast("int").alias("e"))
    return intervals.subtract(free, intervals.pad(busy, GAP))


STEP_COLUMNS = ["owner_id", "document_id", "step_no", "activity", "reason", "preparation", "kind", "minutes", "earliest", "latest", "gap_days", "artifact"]


def _planned(spark: SparkSession, d: str) -> DataFrame:
    """Staged, since a schedule reads it twice."""
    planned = study_steps(_materials(spark, d))
    return cut(with_steps(planned, combine(step_rows(planned))))


def _scheduled(spark: SparkSession, d: str) -> DataFrame:
    return schedule(_planned(spark, d), _spans(spark, d))


def _capacity(spark: SparkSession, d: str) -> DataFrame:
    planned, spans = _planned(spark, d), cut(_spans(spark, d))
    return capacity_report(planned, schedule(planned, spans), spans)


QUERIES = {
    "study_steps": lambda s, d: step_rows(study_steps(_materials(s, d))).select(*STEP_COLUMNS),
    "combined_steps": lambda s, d: combine(step_rows(study_steps(_materials(s, d)))).select(*STEP_COLUMNS),
    "plan_schedule": lambda s, d: _scheduled(s, d),
    "capacity_report": _capacity,
    "deadline_risks": lambda s, d: deadline_risks(_scheduled(s, d)),
}

_RULES = [
    # condition, activity, reason, preparation, kind, minutes, earliest (null: today), gap, artifact
    ("code = 'quiz_in_progress'", "quiz", "'quiz_in_progress'", "NULL", "finish", 35, "NULL", "0", "CASE WHEN quiz_status = 'in_progress' THEN quiz_id END"),
    ("reads", "summary", "learn", "generate", "learn", 45, "NULL", "0", "NULL"),
    ("practises", "flashcards", "learn", "CASE WHEN cards = 0 THEN 'create_flashcards' END", "learn", 20, "NULL", "0", "NULL"),
    ("fresh", "quiz", "learn", "CASE WHEN NOT waiting THEN 'create_quiz' END", "learn", 35, "NULL", "CASE WHEN reads OR practises THEN 1 ELSE 0 END", "CASE WHEN waiting THEN quiz_id END"),
    ("fresh AND deadline IS NULL", "review", "'review_due'", "NULL", "review", 30, "NULL", "2", "NULL"),
    ("lowest", "summary", "'low_quiz_score'", "generate", "review", 45, "due", "0", "NULL"),
    ("lowest AND cards > 0", "review", "'low_quiz_score'", "NULL", "review", 30, "NULL", "0", "NULL"),
    ("lowest AND cards > 0", "flashcards", "'retrieval_practice'", "NULL", "review", 20, "NULL", "0", "NULL"),
    ("lowest AND cards = 0", "flashcards", "'low_quiz_score'", "'create_flashcards'", "review", 20, "NULL", "0", "NULL"),
    ("low AND NOT lowest", "review", "'low_quiz_score'", "NULL", "review", 30, "due", "0", "NULL"),
    ("low AND NOT lowest AND cards > 0", "flashcards", "'retrieval_practice'", "NULL", "review", 20, "NULL", "0", "NULL"),
    ("low", "quiz_retry", "'low_quiz_score'", "NULL", "review", 35, "NULL", "1", "quiz_id"),
    ("moderate AND early", "review", "'review_due'", "NULL", "review", 30, "due", "0", "NULL"),
    ("moderate AND cards > 0", "flashcards", "'retrieval_practice'", "NULL", "review", 20, "due", "1", "NULL"),
    ("moderate", "quiz_retry", "'review_due'", "NULL", "review", 35, "due", "CASE WHEN cards > 0 THEN 1 ELSE 2 END", "quiz_id"),
    ("strong AND early AND weak", "review", "'review_due'", "NULL", "review", 30, "due", "0", "NULL"),
    ("strong AND early AND NOT weak", "review", "'review_due'", "NULL", "review", 20, "due", "0", "NULL"),
    ("strong AND early AND NOT weak AND again <= latest AND (final_start IS NULL OR again < final_start)", "review", "'review_due'", "NULL", "review", 20, "again", "0", "NULL"),
    ("deadline IS NOT NULL", "review", "'final_review'", "NULL", "final", 45, "final_start", "0", "NULL"),
]
_DAYS = "CASE WHEN percentage < 50 THEN 1 WHEN percentage < 75 THEN 2 WHEN percentage < 85 THEN 3 ELSE 5 END"
STEPS_SQL = f"""m AS (SELECT o_custkey AS owner_id, o_orderpriority AS document_id, max(o_orderkey) AS k, count(*) AS n, CAST(floor(max(o_totalprice)) AS BIGINT) AS p, DATE '{TODAY}' AS today FROM orders GROUP BY 1, 2),
  c AS (SELECT *, ['no_study_activity', 'study_started', 'quiz_in_progress', 'low_quiz_score', 'moderate_quiz_score', 'strong_quiz_score', 'marked_completed'][k % 7 + 1] AS code, CASE WHEN n % 3 <> 0 THEN today + CAST(p % 25 - 2 AS INT) END AS deadline,
    k % 3 * 5 AS cards, k % 13 = 0 AS weak, 'quiz-' || k AS quiz_id, CASE WHEN k % 7 = 2 THEN CASE WHEN k % 2 = 0 THEN 'in_progress' ELSE 'completed' END WHEN k % 4 = 1 THEN 'not_started' ELSE 'completed' END AS quiz_status,
    CASE k % 7 WHEN 3 THEN p % 60 WHEN 4 THEN p % 20 + 60 WHEN 5 THEN p % 21 + 80 END AS percentage FROM m),
  h AS (SELECT owner_id, least(CASE WHEN max(deadline) IS NULL THEN today + 14 WHEN count(*) > count(deadline) THEN greatest(max(deadline) - 1, today + 14) ELSE greatest(max(deadline) - 1, today) END, today + 42) AS horizon_end FROM c GROUP BY owner_id, today),
  e AS (SELECT c.*, horizon_end, CASE WHEN deadline IS NULL THEN horizon_end ELSE greatest(today, deadline - 1) END AS latest, CASE WHEN deadline IS NOT NULL THEN greatest(today, deadline - 2) END AS final_start,
    today - CAST(k % 9 AS INT) + {_DAYS} AS due, code IN ('no_study_activity', 'study_started') AS fresh, CASE WHEN k % 2 <> 0 THEN 'generate_summary' END AS generate, CASE WHEN deadline - today <= 3 THEN 'deadline_approaching' ELSE 'new_material' END AS learn FROM c JOIN h USING (owner_id)),
  f AS (SELECT *, due + 2 * {_DAYS} AS again, final_start IS NULL OR due < final_start AS early, fresh AND k % 4 = 1 AS waiting, fresh AND NOT (k % 2 = 0 AND k % 5 = 0) AS reads,
    code = 'low_quiz_score' AS low, code = 'low_quiz_score' AND percentage < 40 AS lowest, code = 'moderate_quiz_score' AS moderate, code = 'strong_quiz_score' AS strong FROM e WHERE deadline IS NULL OR deadline >= today),
  g AS (SELECT *, fresh AND CASE WHEN cards > 0 THEN k % 11 <> 0 ELSE NOT waiting END AS practises FROM f),
  r AS ({" UNION ALL ".join(f"SELECT {i} AS rule, owner_id, document_id, '{a}' AS activity, {reason} AS reason, {prep} AS preparation, '{kind}' AS kind, {mins} AS minutes, {'final_start' if kind == 'final' else f'least(greatest(coalesce({first}, today), today), latest)'} AS earliest, latest, {gap} AS gap_days, {art} AS artifact, deadline, today, horizon_end, percentage FROM g WHERE {when}" for i, (when, a, reason, prep, kind, mins, first, gap, art) in enumerate(_RULES))}),
  steps AS (SELECT * EXCLUDE (rule), CAST(row_number() OVER (PARTITION BY owner_id, document_id ORDER BY rule) - 1 AS INT) AS step_no FROM r)"""
COMBINED_SQL = f"""{STEPS_SQL}, x AS (SELECT *, lead(step_no) OVER w AS nno, lead(activity) OVER w AS a2, lead(preparation) OVER w AS p2, lead(kind) OVER w AS k2, lead(minutes) OVER w AS m2, lead(earliest) OVER w AS e2, lead(latest) OVER w AS l2, lead(gap_days) OVER w AS g2, lead(artifact) OVER w AS r2,
    count(*) OVER (PARTITION BY owner_id, document_id) AS n FROM steps WINDOW w AS (PARTITION BY owner_id, document_id ORDER BY step_no)),
  t AS (SELECT *, replace(activity, '_retry', '') || '+' || replace(a2, '_retry', '') AS pair, coalesce(deadline - today <= 3, false) OR (n > 1 AND greatest(1, (CASE WHEN deadline IS NULL THEN least(horizon_end, today + 6) ELSE deadline - 1 END) - today + 1) / n < 1.5) AS tight FROM x),
  y AS (SELECT *, coalesce(pair IN ('summary+flashcards', 'summary+quiz', 'flashcards+quiz') AND kind NOT IN ('finish', 'final') AND k2 NOT IN ('finish', 'final') AND (g2 = 0 OR tight) AND NOT coalesce(preparation = 'create_flashcards' AND p2 = 'create_quiz', false) AND greatest(earliest, e2) <= least(latest, l2), false) AS fits FROM t),
  i AS (SELECT *, step_no - row_number() OVER (PARTITION BY owner_id, document_id, fits ORDER BY step_no) AS island FROM y),
  z AS (SELECT *, fits AND (row_number() OVER (PARTITION BY owner_id, document_id, fits, island ORDER BY step_no)) % 2 = 1 AS first FROM i),
  q AS (SELECT *, coalesce(lag(first) OVER (PARTITION BY owner_id, document_id ORDER BY step_no), false) AS second, CASE WHEN percentage < 60 THEN 5 WHEN percentage >= 80 THEN -5 ELSE 0 END AS shift FROM z),
  combined AS (SELECT owner_id, document_id, step_no, CASE WHEN first THEN activity || '+' || a2 ELSE activity END AS activity, reason, CASE WHEN first THEN concat_ws('+', preparation, p2) ELSE coalesce(preparation, '') END AS preparation, kind,
    CASE WHEN first THEN 35 + shift ELSE minutes END AS minutes, CASE WHEN first THEN greatest(earliest, e2) ELSE earliest END AS earliest, CASE WHEN first THEN least(latest, l2) ELSE latest END AS latest, gap_days, CASE WHEN first THEN coalesce(r2, artifact) ELSE artifact END AS artifact FROM q WHERE NOT second)"""
ORACLES = {
    "study_steps": f"WITH {STEPS_SQL} SELECT {', '.join(STEP_COLUMNS)} FROM steps",
    "combined_steps": f"WITH {COMBINED_SQL} SELECT * FROM combined",
}
