from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from scorebook.sources.generations import Conflict, Generations
from scorebook.streaming.store import KeyedStore


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v string, _part string")


def got(df):
    return sorted((r.id, r.v, r._part) for r in df.collect())


def test_parts_are_replaced_under_a_manifest(spark, tmp_path):
    table = Generations(spark, str(tmp_path / "t"))
    assert table.versions() == [] and table.manifest().parts == {}
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(frame(spark, [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]), notes={"n": 1})
    table.replace(frame(spark, [(4, "d", "y"), (5, "e", "y")]), emptied=["z"])
    now = table.manifest()
    assert got(table.read()) == [(1, "a", "x"), (4, "d", "y"), (5, "e", "y")]
    assert got(table.read(["y"])) == [(4, "d", "y"), (5, "e", "y")] and table.read(["none"]).count() == 0
    assert got(table.read(version=1)) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]
    assert now.version == 2 and now.notes == {"n": 1} and len(set(now.parts.values())) == 2
    assert all("_part=x" in f for f in table.read(["x"]).inputFiles())


def test_a_crash_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    table = Generations(spark, str(tmp_path / "t"))
    table.replace(frame(spark, [(1, "a", "x")]))

    def crash(self, manifest):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(Generations, "_publish", crash)
        with pytest.raises(RuntimeError):
            table.replace(frame(spark, [(9, "z", "x")]))
    assert got(table.read()) == [(1, "a", "x")]
    table.replace(frame(spark, [(2, "b", "x")]))
    assert got(table.read()) == [(2, "b", "x")] and len(table._names("data")) == 3
    table.replace(frame(spark, [(3, "c", "w")]))
    assert table.sweep() == 2 and got(table.read()) == [(2, "b", "x"), (3, "c", "w")]


def test_two_writers_from_one_state(spark, tmp_path):
    table = Generations(spark, str(tmp_path / "t"))
    start = table.manifest()
    table.replace(frame(spark, [(1, "a", "x")]), before=start)
    with pytest.raises(Conflict):
        table.replace(frame(spark, [(2, "b", "x")]), before=start)
    assert got(table.read()) == [(1, "a", "x")]


def test_part_names_are_plain(spark, tmp_path):
    with pytest.raises(ValueError, match="parts are named"):
        Generations(spark, str(tmp_path / "t")).replace(frame(spark, [(1, "a", "x y/z")]))


def rows_of(store):
    return {r.k: r.v for r in store.read().collect()}


def test_fifty_batches_with_overwritten_keys_end_in_one_generation(spark, tmp_path):
    r, want = random.Random(3), {}
    store = KeyedStore(spark, str(tmp_path / "s"), ["k"], buckets=4)
    write = store.writer(every=10)
    for b in range(50):
        batch = {r.randint(0, 60): b * 100 + i for i in range(5)}
        want |= batch
        write(spark.createDataFrame(list(batch.items()), "k long, v long").coalesce(1), b)
    assert store.landed() == [] and store.merged_upto() == 49
    assert rows_of(store) == want
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and not any("/batches/" in f for f in store.read().inputFiles())
    assert store.read().count() == len(want)  # the rows read are the live ones
    write(spark.createDataFrame([(7, -1)], "k long, v long"), 50)
    assert store.landed() == [50] and rows_of(store) == want | {7: -1}


def test_compaction_rewrites_the_buckets_it_touches(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), ["k"], buckets=8)
    store.append(spark.range(40).select(F.col("id").alias("k"), F.lit("old").alias("v")), 0)
    assert store.compact() and not store.compact()
    first = store.table.manifest()
    store.append(spark.createDataFrame([(3, "new")], "k long, v string"), 1)
    store.compact()
    second = store.table.manifest()
    moved = [p for p in second.parts if second.parts[p] != first.parts[p]]
    assert len(moved) == 1 and len(second.parts) == len(first.parts)
    assert rows_of(store) == {i: "old" for i in range(40)} | {3: "new"}


def test_replayed_batches_and_crashes_lose_nothing(spark, tmp_path, monkeypatch):
    store = KeyedStore(spark, str(tmp_path / "s"), ["k"])
    one, two = (spark.createDataFrame([(i, n)], "k long, v string") for i, n in ((1, "a"), (2, "b")))
    store.append(one, 0)
    store.append(one, 0)
    with monkeypatch.context() as m:
        m.setattr(Generations, "_publish", lambda self, manifest: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            store.compact()
    assert rows_of(store) == {1: "a"} and store.landed() == [0]
    with monkeypatch.context() as m:
        m.setattr(KeyedStore, "clean", lambda self: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            store.compact()
    assert rows_of(store) == {1: "a"} and store.landed() == []
    store.append(spark.createDataFrame([(1, "late")], "k long, v string"), 0)  # merged already: a replay of an old batch
    store.append(two, 1)
    assert rows_of(store) == {1: "a", 2: "b"}
    store.compact()
    assert rows_of(store) == {1: "a", 2: "b"}


def test_the_order_of_rows_in_a_batch_does_not_matter(spark, tmp_path):
    both = [(1, "x"), (1, "y")]
    out = []
    for name, rows in (("s", both), ("t", both[::-1])):
        store = KeyedStore(spark, str(tmp_path / name), ["k"])
        store.append(spark.createDataFrame(rows, "k long, v string"), 0)
        out.append(rows_of(store))
    assert out[0] == out[1]


def test_an_empty_store(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), ["k"])
    assert not store.compact()
    with pytest.raises(FileNotFoundError):
        store.read()
