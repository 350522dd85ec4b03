from __future__ import annotations

import hashlib
import random
import re

from conftest_llm import fold, prose

from scorebook.llm import decontaminate

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain(text, items):
    ws = re.findall(WORD, fold(text))
    hit, found = set(), set()
    for item, item_text in items:
        own = re.findall(WORD, fold(item_text))
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(max(1, len(own) - 9))} if own else set()
        for p in range(len(ws) - n + 1):
            if n and tuple(ws[p : p + n]) in windows:
                hit.update(range(p, p + n))
                found |= {str(item)} if item is not None else set()
    ids = ",".join(sorted(found))
    return len(ws), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def tables(spark, docs, rows):
    r = random.Random(4)
    items = [(i, prose(r, r.randint(1, 25))) for i in range(20)]
    whole = [x[1] for x in rows if x[1] and 12 < len(x[1].split()) < 80]
    items += [(20, whole[0].upper()), (21, "»" + "; ".join(whole[1].split())), (22, None), (23, "--"), (None, whole[2]), (24, whole[0].lower())]
    items += [(25, "window"), (25, "Silver"), (3, items[3][1])]
    return items, spark.createDataFrame(items, "item_id long, text string")


def test_find_equals_a_plain_version_with_one_automaton_or_many(spark, docs, rows):
    items, table = tables(spark, docs, rows)
    want = sorted((x[0], *plain(x[1], items)) for x in rows)
    assert sorted(tuple(r) for r in decontaminate.find(docs, table).collect()) == want
    assert sorted(tuple(r) for r in decontaminate.find(docs, table, max_windows=40).collect()) == want


def test_spans_lie_in_the_original_text(spark, docs, rows):
    items, table = tables(spark, docs, rows)
    text = {x[0]: x[1] for x in rows}
    found = decontaminate.spans(docs, table).collect()
    assert found and all(text[s.doc_id][s.start : s.end] == s.passage for s in found)
    hits = {r.doc_id: r.n_hit for r in decontaminate.find(docs, table).collect() if r.n_hit}
    total = {}
    for s in {(s.doc_id, s.start, s.passage) for s in found}:
        total[s[0]] = total.get(s[0], 0) + len(re.findall(WORD, fold(s[2])))
    assert total == hits


def test_passing_empty_tables_and_clashing_columns(spark, docs, clashing, empty, rows):
    items, table = tables(spark, docs, rows)
    clean = {r.doc_id for r in decontaminate.find(docs, table).where("NOT contaminated").collect()}
    out = decontaminate.passing(clashing, table)
    assert out.columns == clashing.columns and {r.doc_id for r in out.collect()} == clean
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(empty, table).count() == 0
    assert decontaminate.find(docs, none).where("contaminated OR n_items > 0").count() == 0
    assert decontaminate.passing(docs, none).count() == docs.count()
