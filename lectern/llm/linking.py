"""Connected groups from shared signatures, without emitting all pairs of a group. DataFrame operations only.

Rows that could be linked share a key. Pairs are verified in rounds:

- Star rounds compare each member of a key with one pivot, so a key of m members gives m - 1 pairs. The first pivot is the
  member of least rank, and in the first round a row meets only the pivot that it shares most keys with; later pivots are
  taken at random from the first pivot's component, against members outside it.
- Members that are by then in one component need no more pairs, and no pair is verified twice. The last round covers what
  is left of a key: members of different components meet under a condition on their sketches (`close`), which the join
  itself evaluates, so that only pairs that are near enough leave it. Where the keys of a row have an order (`order`), a pair
  that shares one of the two keys before leaves there, and not again. No link between two components is lost.

Components are the smallest id reachable, by hooking whole trees to the smallest label next to them and pointer jumping, each step a
written table, until nothing changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import Scratch

#: Columns for the keys of an id before the present one.
EARLIER = ("before1", "before2")
Verify = Callable[[DataFrame], DataFrame]
Fits = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def components(edges: DataFrame) -> DataFrame:
    """id, component for each end of an edge (a, b): the smallest id reachable. Rounds go on until no label changes."""
    scratch = Scratch(edges.sparkSession)
    both = scratch.stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    after = scratch.stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        labels = after.select("id", "component")
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        seen = scratch.stage(labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("component").alias("was"), F.least("component", "m").alias("m")), "seen")
        # A tree, its root included, takes the least label next to any of its members.
        trees = seen.groupBy("was").agg(F.min("m").alias("component"))
        hooked = scratch.stage(seen.select("id", "was").join(trees, "was").select("id", "was", "component"), "hooked")
        jump = hooked.select(F.col("id").alias("component"), F.col("component").alias("next"))
        # A component's label is itself an end of an edge, so the jump always finds it.
        after = scratch.stage(hooked.join(jump, "component").select("id", "was", F.least("component", "next").alias("component")), "jumped")
        if after.where("component <> was").isEmpty():
            scratch.drop_all_but(after)
            return after.select("id", "component")
        scratch.drop_all_but(both, after)


def connect(postings: DataFrame, verify: Verify, fits: Fits, sketches: DataFrame | None = None, close: Fits | None = None, star_rounds: int = 2, links: DataFrame | None = None, scratch: Scratch | None = None, order: str | None = None) -> DataFrame:
    """id, component of every id that has a link; `postings` has key, id, rank and what `fits` reads. It is a written table, best
    without the keys of one row alone.

    verify(pairs with a, b) returns those that are links; fits(left, right) is a cheap condition on two rows of one key, and
    close(left, right) one on two rows of `sketches` (id and what it reads). `order` names a column that orders the keys of an id;
    what `fits` says of the first key that two rows share then holds for the pair. `links` (a, b) are known already. The result
    is staged in `scratch`."""
    outer, scratch = scratch, Scratch(postings.sparkSession)
    extra = [c for c in postings.columns if c != "key"]
    first = postings.groupBy("key").agg(F.min(F.struct("rank", "id")).alias("first"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    active = scratch.stage(postings.join(first.select("key", F.col("first.id").alias("base")), "key"), "active")
    labels = None if links is None or links.isEmpty() else components(links)
    links = None if labels is None else links
    tested: DataFrame | None = None
    left, right = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))
    for turn in range(star_rounds + 1):
        if active.isEmpty():
            break
        if labels is None:
            with_comp = active.withColumn("component", F.col("id")).withColumn("base_component", F.col("base"))
        else:
            named = lambda c, to: labels.select(F.col("id").alias(c), F.col("component").alias(to))
            with_comp = active.join(named("id", "component"), "id", "left").join(named("base", "base_component"), "base", "left")
            with_comp = with_comp.withColumn("component", F.coalesce("component", "id")).withColumn("base_component", F.coalesce("base_component", "base"))
            all_of = scratch.stage(with_comp, "with_component")
            mixed = all_of.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
            with_comp = scratch.stage(all_of.join(mixed, "key", "left_semi"), "mixed_keys")
            scratch.drop(all_of, active)
            active = with_comp.select("key", *extra, "base")
        if turn < star_rounds:
            rows = with_comp.select("key", "component", *(F.col(c).alias(f"r_{c}") for c in extra))
            order = F.col("rank") if turn == 0 else F.xxhash64("id", F.lit(turn))
            pivots = with_comp.where("component = base_component").groupBy("key").agg(F.min(F.struct(order.alias("o"), *extra, "component")).alias("p"))
            pivots = pivots.select("key", F.col("p.component").alias("l_component"), *(F.col(f"p.{c}").alias(f"l_{c}") for c in extra))
            pairs = rows.join(pivots, "key").where("component <> l_component").where(fits(left, right))
        else:
            rows, seen = with_comp.select("key", "component", *extra), extra
            if order is not None:
                own = Window.partitionBy("id").orderBy(order, "key")
                rows, seen = rows.select("*", *(F.lag("key", k).over(own).alias(c) for k, c in enumerate(EARLIER, 1))), [*seen, *EARLIER]
            if sketches is not None:
                rows = rows.join(sketches, "id")
                seen = [c for c in rows.columns if c not in ("key", "component")]
            rows = scratch.stage(rows, "rows_left")
            side = lambda to: rows.select("key", *(F.col(c).alias(f"{to}_{c}") for c in ("component", *seen)))
            near = fits(left, right) if close is None else fits(left, right) & close(left, right)
            if order is not None:
                for a, b in ((a, b) for a in EARLIER for b in EARLIER):
                    near = near & ~F.coalesce(left(a) == right(b), F.lit(False))
            pairs = side("l").join(side("r"), "key").where((F.col("l_component") != F.col("r_component")) & (F.col("l_id") < F.col("r_id")) & near)
        if turn == 0:
            shared = pairs.groupBy("l_id", "r_id").agg(F.count(F.lit(1)).alias("n"))
            pairs = shared.groupBy("r_id").agg(F.max(F.struct("n", "l_id")).alias("best")).select(F.col("best.l_id").alias("l_id"), "r_id")
        pairs = pairs.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b")).distinct()
        pairs = scratch.stage(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = scratch.stage(verify(pairs).select("a", "b"), "links")
        if found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        labels = components(links)
    if labels is None:
        labels = postings.select("id", F.col("id").alias("component")).limit(0)
    kept = (outer or scratch).stage(labels, "components")
    scratch.drop_all_but(kept)
    return kept
