"""The prefix trie against its SQL and against a plain dictionary of prefixes, over small blocks and shards."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("lectern.llm")
from lectern.llm import registry, trie  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(sequences):
    """{conv_id: [(role, text), ...]} to the node rows."""
    members, own = defaultdict(list), {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        own[c] = tuple(turns)
    below = {p: [0, 0, 0] for p in members}  # children, leaves, saved
    parents = {p[:-1] for p in members if p}
    for p, ids in members.items():
        if p:
            below[p[:-1]][0] += 1
        saved = (len(ids) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            below[p[:d]][1] += p not in parents
            below[p[:d]][2] += saved
    return sorted(
        (min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), *below[p], hashlib.sha256(",".join(map(str, sorted(c for c in ids if own[c] == p))).encode()).hexdigest())
        for p, ids in members.items()
    )


def rebuild(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return out


def rows_of(df):
    assert df.columns == NAMES and {t for _, t in df.dtypes} == {"bigint", "string"}
    return sorted(tuple(r) for r in df.collect())


def test_query_gives_the_rows_of_its_sql(spark, data, duck):
    got = registry.queries()["op13_prefix_trie"](spark, data)
    want = duck.execute(registry.oracle_sql()["op13_prefix_trie"])
    assert [c[0] for c in want.description] == NAMES
    assert rows_of(got) == sorted(want.fetchall())


def test_query_gives_the_rows_of_a_dictionary(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(registry.queries()["op13_prefix_trie"](spark, data)) == plain(rebuild(rows))


@pytest.mark.parametrize("cells,shards", [(1, 7), (12, 3), (40, 1), (10**6, 5)])
def test_blocks_and_shards_are_recombined(spark, cells, shards):
    rng = random.Random(cells)
    rows = []
    for c in range(300):  # a third are copies; few words make deep sharing
        turns = [("u", "hello"), ("a", "hé"), ("u", "")] if c % 3 == 0 else [(rng.choice("ua"), rng.choice(["", "x", "long text"])) for _ in range(rng.choice([0, 1, 2, 3, 5, 9]))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    sequences = {c: [] for c in range(300)}
    for c, _, role, text in rows:
        sequences[c].append((role, text))
    sequences = {c: t for c, t in sequences.items() if t}
    df = trie.turn_sequences(spark.createDataFrame(rows, SCHEMA), ["conv_id"])
    assert rows_of(trie.prefix_trie(df, cells, shards)) == plain(sequences)


def test_rebuilt_and_odd_rows(spark):
    rows = [(0, k, "u", f"base {k}") for k in range(10)] + [(c, k, "u", f"own {c} {k % 3}") for c in range(1, 12) for k in range(c % 4 * 3)]
    rows += [(20, None, "u", "null first"), (20, 1, "a", "one"), (20, 1, "b", None), (20, 1, "b", None), (21, 0, None, None), (None, 0, "u", "nobody"), (-3, 0, "u", "x" * 40_000), (23, 5, "u", "alone"), *((c, 5, None, "alone") for c in range(31, 35))]
    odd = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA + ", key string, depth int, base int")
    want = rebuild([r for r in rows if r[0] is None or r[0] >= 0])
    h = zlib.crc32(b"-3") % 9
    want[-3] = [("u", f"base {k}") for k in range(h)] + [("u", "x" * 40_000)][h:]  # the sign of c % 5 is that of c
    assert [] in want.values()
    assert rows_of(trie.prefix_trie(trie.rebuilt(odd))) == plain(want)
    assert trie.prefix_trie(trie.rebuilt(odd.limit(0))).collect() == []
