from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from conftest_llm import Union, fold, words
from pyspark.sql import functions as F

from scorebook.llm import linking, simhash


def plain_print(text) -> int:
    w = words(fold(text))
    runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints: dict) -> dict:
    union, ids = Union(), sorted(prints)
    for x, a in enumerate(ids):
        union.root(a)
        for b in ids[:x]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                union.link(a, b)
    return {i: union.root(i) for i in ids}


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


def test_components_equal_a_comparison_of_all_pairs(docs, rows):
    prints = {i: plain_print(t) for i, t, *_ in rows}
    roots = plain_groups(prints)
    assert got(simhash.find(docs)) == sorted(((i, f"{prints[i]:016x}", roots[i]) for i, *_ in rows), key=repr)
    assert len(set(roots.values())) < len(roots) - 5


def longs(values):
    return [(int(np.array(v, np.uint64).view(np.int64)),) for v in values]


@pytest.mark.parametrize("distance, crowded", [(1, 5), (3, 1024), (3, 0)])
def test_links_of_fingerprints_around_centres(spark, distance, crowded):
    r = random.Random(5)
    values = set()
    for centre in [r.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]:
        for _ in range(60):
            v = centre
            for b in r.sample(range(64), r.randint(0, 7)):
                v ^= 1 << b
            values.add(v)
    values |= {(r.getrandbits(32) << 32) | 7 for _ in range(40)}  # one crowded segment
    nodes = longs(values)
    union = Union()
    ids = [n for (n,) in nodes]
    unsigned = {n: n % (1 << 64) for n in ids}
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if (unsigned[a] ^ unsigned[b]).bit_count() <= distance:
                union.link(a, b)
    want = {n: union.root(n) for n in list(union.up)}
    df = spark.createDataFrame(nodes, "node long")
    assert {x.node: x.component for x in simhash.linked(df, distance, crowded).collect()} == want


def test_every_pair_within_three_bits_meets(spark):
    r = random.Random(8)
    pairs = []
    for flips in range(4):
        for _ in range(200):
            a = r.getrandbits(64)
            b = a
            for bit in r.sample(range(64), flips):
                b ^= 1 << bit
            pairs.append((longs([a])[0][0], longs([b])[0][0]))
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("i", F.monotonically_increasing_id())
    held = simhash.tables(df.select("i", F.col("a").alias("node")))
    asked = simhash.probes(df.select("i", F.col("b").alias("node")))
    held_b = simhash.tables(df.select("i", F.col("b").alias("node")))
    asked_a = simhash.probes(df.select("i", F.col("a").alias("node")))
    met = held.join(asked, ["i", "key"]).select("i").union(held_b.join(asked_a, ["i", "key"]).select("i")).distinct()
    assert met.count() == len(pairs)
    with pytest.raises(ValueError):
        simhash.linked(df.select(F.col("a").alias("node")), 4)


def test_majority_over_blocks_of_hashes(monkeypatch):
    monkeypatch.setattr(simhash, "_VOTES", 7)
    r = np.random.default_rng(3)
    sizes = [0, 3, 0, 20, 1, 0, 7, 0]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    hashes = r.integers(0, 1 << 63, int(ends[-1]), dtype=np.int64).view(np.uint64) * np.uint64(3)
    want = []
    for a, b in zip(ends[:-1], ends[1:]):
        row = [int(h) for h in hashes[a:b]]
        want.append(sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in row) > len(row)))
    assert simhash.majority(hashes, ends).tolist() == want


def test_a_crowded_group_of_near_copies(spark):
    r = random.Random(2)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(300):
        w = list(base)
        w[r.randrange(400)] = f"x{r.randint(0, 200)}"
        rows.append((i, " ".join(w)))
    roots = plain_groups({i: plain_print(t) for i, t in rows})
    found = simhash.find(spark.createDataFrame(rows, "doc_id long, text string"), crowded=8)
    assert {r.doc_id: r.component_id for r in found.collect()} == roots


def test_nulls_empty_long_repeated_and_clashing(spark, empty, clashing, docs):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(None, "a b c"), (4, "A  B\tc"), (4, "a b c"), (9, None), (8, ""), (7, " \n"), (3, long), (2, long), (None, "lone one here")]
    out = got(simhash.find(spark.createDataFrame(rows, "doc_id long, text string")))
    prints = {t: f"{plain_print(t):016x}" for _, t in rows}
    want = [(None, prints["a b c"], 4), (4, prints["a b c"], 4), (4, prints["a b c"], 4), (9, "0" * 16, 7), (8, "0" * 16, 7),
            (7, "0" * 16, 7), (3, prints[long], 2), (2, prints[long], 2), (None, prints["lone one here"], None)]
    assert out == sorted(want, key=repr)
    assert simhash.find(empty).count() == 0
    assert got(simhash.find(clashing)) == got(simhash.find(docs))


def test_what_comes_out_of_an_explode_is_not_broadcast(spark):
    nodes = spark.createDataFrame(longs(range(0, 4000, 7)), "node long").withColumn("component", F.col("node"))
    for df in (simhash.cross_links(nodes, 3), linking.star_pairs(simhash.tables(nodes.select("node")))):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
