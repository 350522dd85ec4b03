from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from conftest_llm import words

from scorebook.llm import hashing, repetition
from scorebook.llm.repetition import Rules


def plain_reach(ws):
    n, out = len(ws), [0] * len(ws)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and ws[i + k] == ws[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_longest_repeats_by_comparing_all_pairs():
    r = random.Random(2)
    for _ in range(80):
        texts = [[r.choice("abc") for _ in range(r.randint(0, 25))] for _ in range(r.randint(1, 5))]
        data, offsets = hashing.utf8(pa.array([" ".join(t) for t in texts]))
        got = repetition.longest_repeats(*hashing.word_hashes(data, offsets, hashing.WHITESPACE, False))
        assert got.tolist() == [x for t in texts for x in plain_reach(t)]


def plain(text, rules):
    ws = words(text)
    n, reach = len(ws), plain_reach(ws)
    covered = lambda least: len({j for i, k in enumerate(reach) if k >= least for j in range(i, i + k)})
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = n < rules.min_words or 100 * covered(3) > rules.max_repeat_percent * n
    ok = covered(rules.min_repeat) <= rules.max_covered * n and max(reach, default=0) <= rules.max_longest
    return (
        n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), covered(3),
        covered(rules.min_repeat), max(reach, default=0), failed, not failed and ok,
    )


def test_measures_equal_a_plain_version(docs, rows):
    some = [r for r in rows if r[1] is None or len(r[1]) < 3000]
    got = sorted(tuple(r) for r in repetition.measure(docs).collect() if r.doc_id in {s[0] for s in some})
    assert got == sorted((r[0], *plain(r[1], Rules())) for r in some)


def test_long_repeats_reject_a_text_the_base_rule_accepts(spark):
    r = random.Random(5)
    fresh = " ".join(f"w{i}" for i in range(400))
    again = " ".join(f"v{r.random()}" for _ in range(230))
    rows = [(1, fresh), (2, f"{again} {fresh} {fresh.replace('w', 'x')} {again}"), (3, f"{again} {fresh}")]
    got = {x.doc_id: x for x in repetition.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].longest_repeat == 230 and not got[2].base_failed and not got[2].kept
    assert got[1].kept and got[3].kept


def test_passing_keeps_all_columns_and_the_kept_rows(docs, clashing, empty):
    kept = {r.doc_id for r in repetition.measure(docs).where("kept").collect()}
    out = repetition.passing(clashing)
    assert out.columns == clashing.columns
    assert {r.doc_id for r in out.collect()} == kept
    assert repetition.measure(empty).count() == 0 and repetition.passing(empty).count() == 0


def test_a_null_text_has_no_words_and_a_null_id_passes(spark):
    out = repetition.measure(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")).collect()
    assert [(r.n_words, r.base_failed, r.kept) for r in out] == [(0, True, False)] * 2


def test_blocks_of_one_row_and_of_many_agree():
    texts = pa.array(["a b a b a b", None, "x", "", "long " * 50])
    data, offsets = hashing.utf8(texts)
    whole = repetition._block(data, offsets, Rules())
    parts = [repetition._block(d, o, Rules()) for _, _, d, o in hashing.blocks(data, offsets, 1)]
    assert all(np.array_equal(w, np.concatenate([p[i] for p in parts])) for i, w in enumerate(whole))
