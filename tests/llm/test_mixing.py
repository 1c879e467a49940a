"""Source mixing against literal filling, highest quotients and block by block selection."""

import collections
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from timberline.llm import mixing
from timberline.llm.queries import ORACLE

SCHEMA = "doc_id long, source string, text string"


def literal_targets(sizes, weights=mixing.WEIGHTS, most=mixing.MOST):
    """Share by weight; stop sources above ``most`` times their size; share the excess anew until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, open_ = total - sum(most * sizes[s] for s in full), [s for s in names if s not in full]
        of = sum(weight[s] for s in open_)
        out = {s: most * sizes[s] if s in full else rest * weight[s] / of for s in names}
        above = {s for s in open_ if out[s] > most * sizes[s] * (1 + 1e-12)}
        if not above:
            return out
        full |= above


def highest_quotients(votes, seats, caps):
    got = collections.Counter()
    for _ in range(seats):
        free = [p for p in votes if got[p] < caps[p]]
        got[max(free, key=lambda p: (votes[p] / (2 * got[p] + 1), -p))] += 1
    return got


def check(rows, result):
    """What must hold of any mix."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for _, source, text in rows:
        sizes[source] += size(text)
    want = literal_targets(sizes)
    assert sorted((r.doc_id, r.size) for r in result if r.doc_id is not None) == sorted((d, size(t)) for d, _, t in rows if d is not None)
    assert len(result) == len(rows)
    assert all(0 <= r.taken <= mixing.MOST * r.size for r in result)
    by_target = collections.Counter()
    for r in result:
        by_target[round(r.target, 6), r.source_size] += r.taken
    goal = collections.Counter()
    for s, t in want.items():
        goal[round(t, 6), sizes[s]] += t
    block = max(1, min(mixing.BLOCK, sum(sizes.values()) // mixing.LEAST_BLOCKS))
    assert set(by_target) == {(round(t, 6), sizes[s]) for s, t in want.items()}
    for k, t in goal.items():
        sharing = sum(1 for s, x in want.items() if (round(x, 6), sizes[s]) == k)
        assert abs(by_target[k] - t) <= sharing * (mixing.MOST + 1) * block, (k, t, by_target[k])


def documents(n, seed, sources):
    rng = random.Random(seed)
    return [(k, rng.choice(sources), " ".join(["w"] * int(rng.paretovariate(0.8)))) for k in range(n)]


@pytest.mark.parametrize("least_blocks", [1 << 16, 500])
def test_targets_are_met(spark, monkeypatch, least_blocks):
    monkeypatch.setattr(mixing, "LEAST_BLOCKS", least_blocks)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)  # several ranges
    rows = documents(700, 1, ["a"] * 200 + ["b", "b", "é", "z", None, "", "c", "d"])
    docs = spark.createDataFrame(rows, SCHEMA)
    result = mixing.mix_sources(docs).collect()
    check(rows, result)
    again = mixing.mix_sources(docs.repartition(7).orderBy(F.desc("doc_id"))).collect()
    assert sorted(map(str, map(tuple, result))) == sorted(map(str, map(tuple, again)))


def test_odd_rows(spark):
    rows = [(1, "a", None), (2, "a", ""), (None, "a", "x y"), (None, None, "x y z"), (3, None, " \t\n "), (4, "b", "one two"), (4, "b", "one two"), (4, "b", "one two"), (5, "c", "w\x0b " * 4000), (6, "d", None)]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("taken"), F.lit(2).alias("size"), F.lit("x").alias("shard"))
    check(rows, mixing.mix_sources(docs).collect())


def test_no_words_and_no_rows(spark):
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a", None), (2, "b", "")]
    assert sorted(map(tuple, mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_seats_are_those_of_highest_quotients(spark):
    rng = random.Random(5)
    rows = [(f"s{k:02}", min(int(rng.paretovariate(0.5)), 4000) + 1) for k in range(60)]
    sources = mixing.targets(spark.createDataFrame(rows, "source string, source_size long"), mixing.WEIGHTS, mixing.MOST)
    out = mixing.seats_of_sources(sources, 2, mixing.MOST).collect()
    seats = sum(n for _, n in rows) // 2
    want = highest_quotients({r.idx: r.target for r in out}, seats, {r.idx: r.blocks * mixing.MOST for r in out})
    assert {r.idx: r.seats for r in out if r.seats} == want


def test_quotas_of_a_source(spark):
    sizes = [5, 0, 1, 40, 3, 3, 17]
    block, seats = 4, 29
    cells = [(0, seats, -(-sum(sizes) // block), k, n) for k, n in enumerate(sizes)]
    out = mixing.quotas_of_shards(spark.createDataFrame(cells, "idx long, seats long, blocks long, shard long, size long"), block, 3, "t").orderBy("shard").collect()
    starts = [r.base for r in out]
    owner = [max(k for k, b in enumerate(starts) if b <= at and (sizes[k] or b < at)) for at in range(0, sum(sizes), block)]
    assert [r.n for r in out] == [owner.count(k) for k in range(len(sizes))]
    want = highest_quotients({k: r.n for k, r in enumerate(out) if r.n}, seats, {k: 3 * r.n for k, r in enumerate(out)})
    assert [r.quota for r in out] == [want[k] for k in range(len(sizes))]


def test_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    from timberline.llm.queries import op12_source_mixing

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    result = op12_source_mixing(spark, data).collect()
    assert sorted(map(tuple, result)) == sorted(c.execute(ORACLE["op12_source_mixing"]).fetchall())
