from __future__ import annotations

import random

import numpy as np
import pytest
from conftest_llm import Union, corpus, fold, words

from scorebook.llm import components, linking, minhash, neardup


def shingles(text):
    ws = words(fold(text))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def plain(rows, percent=85):
    sets = {}
    for i, text, *_ in rows:
        if i is not None:
            sets[i] = shingles(text)
    union, ids = Union(), sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                union.link(a, b)
    out = []
    for i, text, *_ in rows:
        root = None if i is None else union.root(i)
        out.append((i, len(shingles(text)), root, i == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("percent", [85, 80])
def test_components_equal_a_comparison_of_all_pairs(docs, rows, percent):
    got = sorted((tuple(r) for r in neardup.find(docs, percent=percent).collect()), key=repr)
    assert got == plain(rows, percent)
    assert sum(1 for r in got if not r[3]) > 5


def test_a_group_of_near_copies_that_are_mostly_no_links_of_each_other(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(150):
        w = list(base)
        for at in r.sample(range(0, 90, 5), 3):
            w[at] = f"x{r.randint(0, 3)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(x) for x in neardup.find(docs).collect()), key=repr) == plain(rows)


def test_nulls_empty_tables_and_repeated_ids(spark, empty, clashing, docs):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, text), (2, text), (1, text), (1, text), (3, None), (4, "")]
    got = neardup.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=repr) == sorted(
        [(None, None, True)] * 2 + [(2, 1, False)] + [(1, 1, True)] * 2 + [(3, 3, True), (4, 4, True)], key=repr
    )
    assert neardup.find(empty).count() == 0 and neardup.representatives(empty).count() == 0
    out = neardup.representatives(clashing)
    kept = {r.doc_id for r in neardup.find(docs).where("kept").collect()}
    assert set(out.columns) == set(clashing.columns) and sorted(r.doc_id for r in out.collect()) == sorted(kept)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        both = r.integers(0, 1 << 63, 4000).astype(np.uint64)
        n = int(4000 * share)
        a, b = both[: n + (4000 - n) // 2], np.concatenate([both[:n], both[n + (4000 - n) // 2 :]])
        same = (minhash.signature(a, 320) == minhash.signature(b, 320)).mean()
        assert abs(same - share) < 0.1


def test_components_of_random_links_chains_and_stars(spark):
    r = random.Random(3)
    links = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(230)]
    links += [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(300)] + [(7, 7), (None, 3)]
    union = Union()
    for a, b in links:
        if a is not None and a != b:
            union.link(a, b)
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert sorted(tuple(x) for x in got) == sorted((x, union.root(x)) for x in nodes)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmaps_hold_every_member(spark):
    hashes = [int(x) for x in np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 3000)]
    bits = linking.bitmap(spark.createDataFrame([(h,) for h in hashes], "h long"), "h")
    assert linking.contains(bits, np.array(hashes, np.int64).view(np.uint64)).all()
    others = np.random.default_rng(3).integers(0, 1 << 62, 20000).astype(np.uint64)
    assert linking.contains(bits, others).mean() < 0.01
    assert corpus(1) == corpus(1)
