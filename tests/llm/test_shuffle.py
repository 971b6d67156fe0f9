"""The shuffle: the table's law against its exact probabilities, shard sizes, slots, and rows kept whole."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("lectern.llm")
from lectern.llm import registry, shuffle  # noqa: E402


def chi_square(counts, expected):
    return sum((counts.get(k, 0) - e) ** 2 / e for k, e in expected.items())


def test_one_draw_has_the_exact_law():
    rng, good, total, draws, n = shuffle.generator(3), 7, 19, 9, 20_000
    seen = Counter(shuffle.hypergeometric(rng, good, total, draws) for _ in range(n))
    law = {k: n * math.comb(good, k) * math.comb(total - good, draws - k) / math.comb(total, draws) for k in range(0, good + 1)}
    assert set(seen) <= set(law)
    assert chi_square(seen, law) < 24.3  # 7 degrees of freedom, 0.1 %


@pytest.mark.parametrize("good,total,draws", [(0, 5, 3), (5, 5, 3), (3, 5, 0), (3, 5, 5), (1, 1, 1), (2 * 10**9, 48 * 10**9, 10**6)])
def test_edges_and_large_numbers(good, total, draws):
    x = shuffle.hypergeometric(shuffle.generator(1), good, total, draws)
    assert max(0, draws - (total - good)) <= x <= min(good, draws)
    if total > 10**9:
        assert abs(x - draws / 24) < 6 * math.sqrt(draws / 24)


def test_rows_of_the_table_add_up():
    rng, room = shuffle.generator(5), shuffle.sizes_of(1000, 24)
    for n in (0, 1, 30, 400, 569):
        own = shuffle.deal(rng, room, n)
        assert sum(own) == n and all(0 <= a <= b for a, b in zip(own, room))
        room = [b - a for a, b in zip(own, room)]
    assert sum(room) == 0


@pytest.mark.parametrize("count", [1, 2, 10, 255, 256, 257, 5000])
def test_slots_are_a_permutation(count):
    assert sorted(shuffle.permute(np.arange(count), count, 9).tolist()) == list(range(count))


def test_each_place_is_equally_likely(spark):
    """Where one row of twelve, in three partitions, ends up in four shards, over seeds."""
    df = spark.range(0, 12, 1, 3)
    seen = Counter()
    for seed in range(12):
        for r in shuffle.shuffle_into_shards(df, 4, seed).collect():
            seen[r.id, r.shard, r.slot] += 1
    assert chi_square(seen, {(i, s, k): 1 for i in range(12) for s in range(4) for k in range(3)}) < 190  # 121 degrees of freedom
    seen = Counter()
    for seed in range(3000):  # the slots alone, without Spark
        seen.update(enumerate(shuffle.permute(np.arange(5), 5, seed).tolist()))
    assert chi_square(seen, {(i, k): 600 for i in range(5) for k in range(5)}) < 40  # 16 degrees of freedom


def test_blocks_of_partitions(spark, monkeypatch):
    monkeypatch.setattr(shuffle, "BLOCK", 3)
    counts = spark.createDataFrame([(p, 5 + p % 4) for p in range(20) if p != 7], "part long, n long")
    matrix, total = shuffle.communication_matrix(counts, 6, 1)
    rows = {r.part: r for r in matrix.collect()}
    assert total == sum(r.n for r in rows.values()) and len(rows) == 19
    before = [0] * 6
    for _, r in sorted(rows.items()):
        own = np.diff([0, *r.upto]).tolist()
        assert r.before == before and sum(own) == r.n and min(own) >= 0
        before = [a + b for a, b in zip(before, own)]
    assert before == shuffle.sizes_of(total, 6)


def test_query_keeps_all_rows(spark, data):
    rows = registry.queries()["op11_hypergeometric_shuffle"](spark, data).collect()
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    want = Counter((d.doc_id, len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    shards = Counter(r.shard for r in rows)
    assert set(shards) == set(range(24)) and max(shards.values()) - min(shards.values()) <= 1
    for s, n in shards.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_odd_tables_and_written_shards(spark, tmp_path):
    schema = "doc_id long, text string, row string, part int, `a.b` int, pos int, shard string, SLOT int"
    rows = [(1, None, "r", 1, 2, 3, "x", 1), (1, None, "r", 1, 2, 3, "x", 1), (None, "", None, None, None, None, None, None), (2, "é" * 70_000, "r", 1, 2, 3, "x", 1)]
    odd = spark.createDataFrame(rows, schema)
    out = shuffle.shuffle_into_shards(odd)
    assert out.columns == ["doc_id", "text", "row", "part", "a.b", "pos", "shard", "slot"]
    assert Counter((r.doc_id, r.text, r["a.b"]) for r in out.collect()) == Counter((r[0], r[1], r[4]) for r in rows)
    assert Counter(r.shard for r in out.collect()) == Counter(range(4))
    assert shuffle.shuffle_into_shards(odd.limit(0)).collect() == []
    same = [(r.doc_id, r.shard, r.slot) for r in shuffle.shuffle_into_shards(odd.coalesce(1)).collect()]
    assert same == [(r.doc_id, r.shard, r.slot) for r in shuffle.shuffle_into_shards(odd.coalesce(1)).collect()]
    back = shuffle.write_shards(spark.range(1000), f"file://{tmp_path}/out", 3)
    assert sorted(r.id for r in back.collect()) == list(range(1000))
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {0: 334, 1: 333, 2: 333}
