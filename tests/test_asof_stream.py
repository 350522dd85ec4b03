from __future__ import annotations

import random

import pytest
from test_running import frames, make_log, replay

from scorebook.functions.classify import MEASURES
from scorebook.operators import running
from scorebook.streaming import asof, ingest
from scorebook.streaming.store import KeyedStore

KIND = "event_id long, game_id string, visitor string, home string, is_top boolean, name string, result string"


class Log:
    """A folder that a stream reads, one file per micro-batch."""

    def __init__(self, spark, tmp_path, initial=None):
        self.spark, self.inbox, self.n = spark, tmp_path / "inbox", 0
        self.inbox.mkdir()
        self.store = KeyedStore(spark, str(tmp_path / "store"), ["game_id", "team", "name"])
        self.check, self.initial = str(tmp_path / "check"), initial

    def add(self, plays=(), asked=()):
        kinds = KIND + ", team string"
        rows = [(*p, None) for p in plays] + [(None, g, None, None, None, n, None, t) for g, t, n in asked]
        self.spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(self.inbox / f"f{self.n}"))
        self.n += 1

    def run(self):
        stream = self.spark.readStream.schema(KIND + ", team string").option("maxFilesPerTrigger", 1).parquet(f"{self.inbox}/*")
        rows = asof.events(stream.where("event_id IS NOT NULL").drop("team"), stream.where("event_id IS NULL").select("game_id", "team", "name"))
        with asof.map_state(self.spark):
            ingest.store_totals(asof.figures_before(rows, self.initial), self.store, self.check).awaitTermination()
        return {(r.game_id, r.team, r.name): tuple(r[m] for m in MEASURES) for r in self.store.read().collect()}


def test_shuffled_batches_with_repeats_equal_the_replay(spark, tmp_path):
    log = make_log(5)
    plays, asked, initial = log
    numbered = [(i, *p) for i, p in enumerate(plays)]
    rng = random.Random(1)
    deal = [[[], []] for _ in range(3)]
    for p in numbered:
        deal[rng.randrange(3)][0].append(p)
        if rng.random() < 0.3:
            deal[rng.randrange(3)][0].append(p)
    for a in asked:
        deal[rng.randrange(3)][1].append(a)
    stream = Log(spark, tmp_path, frames(spark, log)[2])
    for part in deal:
        stream.add(*part)
    assert stream.run() == replay(plays, asked, initial, "batting", "date")


def test_late_and_corrected_games_change_what_follows_only(spark, tmp_path):
    stream = Log(spark, tmp_path)
    day = "cl202504{:02d}01".format

    def play(i, d, result):
        return (i, day(d), "V", "H", True, "n", result)

    asked = [(day(d), "V", "n") for d in (1, 5, 9)]
    stream.add([play(1, 1, "左安"), play(2, 5, "左安")], asked)
    first = stream.run()
    assert [first[(day(d), "V", "n")][:2] for d in (1, 5, 9)] == [(0, 0), (1, 1), (2, 2)]
    stream.add([play(3, 3, "中飛")])  # a late game between the first and the second
    late = stream.run()
    assert [late[(day(d), "V", "n")][:2] for d in (1, 5, 9)] == [(0, 0), (2, 1), (3, 2)]
    stream.add([play(2, 5, "中飛"), play(3, 3, "中飛")])  # one play corrected, one delivered again
    corrected = stream.run()
    assert [corrected[(day(d), "V", "n")][:2] for d in (1, 5, 9)] == [(0, 0), (2, 1), (3, 1)]
    batches = {r._batch: r.n for r in spark.read.parquet(str(tmp_path / "store" / "batches")).groupBy("_batch").count().withColumnRenamed("count", "n").collect()}
    assert batches == {0: 3, 1: 2, 2: 1}  # only the games behind the change come out again


def test_only_new_or_different_plays_count():
    class Play(dict):
        __getattr__ = dict.get

    def row(i, ab):
        return Play(event_id=i, **{m: ab for m in MEASURES})

    plays = {}
    assert asof.changed(plays, [row(1, 1)]) and not asof.changed(plays, [row(1, 1)])
    assert asof.changed(plays, [row(1, 0)]) and plays == {1: [0] * len(MEASURES)}


def test_the_session_keeps_its_state_store_setting(spark):
    before = spark.conf.get(asof._PROVIDER, None)
    with pytest.raises(RuntimeError), asof.map_state(spark):
        assert "RocksDB" in spark.conf.get(asof._PROVIDER)
        raise RuntimeError
    assert spark.conf.get(asof._PROVIDER, None) == before
    assert running.START == ""


class State:
    """Map and value state of one player, and how often it was asked."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getMapState(self, name, *kinds):
        return Part(self, name)

    def getValueState(self, name, *kinds):
        return Part(self, name)


class Part:
    def __init__(self, state, name):
        self.state, self.held = state, state.held.setdefault(name, {})

    def _called(self, out=None):
        self.state.calls += 1
        return out

    def iterator(self):
        return self._called(iter(list(self.held.items())))

    def getValue(self, key):
        return self._called(self.held.get(key))

    def updateValue(self, key, value):
        self._called(self.held.update({key: value}))

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)


def test_a_batch_asks_the_state_once_per_chunk_not_per_game(spark):
    days = [f"2025{m:02d}{d:02d}" for m in (3, 4) for d in range(1, 31)]
    kind = KIND + ", team string"
    plays = [(i, f"cl{day}01", "V", "H", True, "n", "左安", None) for i, day in enumerate(days)]
    asked = spark.createDataFrame([(f"cl{day}01", "V", "n") for day in days], "game_id string, team string, name string")
    state = State()

    def batch(some, requests=None):
        rows = asof.events(spark.createDataFrame(some, kind).drop("team"), requests).collect()
        processor = asof.FiguresBefore()
        processor.init(state)
        before = state.calls
        out = {r.game_id: r.h for r in processor.handleInputRows(("V", "n"), iter(rows), None)}
        return out, state.calls - before

    first, calls = batch(plays[::2], asked)
    assert first == {f"cl{day}01": (i + 1) // 2 for i, day in enumerate(days)} and calls <= 6  # games and two months
    second, calls = batch(plays[1::2] + plays[:4])
    assert second == {f"cl{day}01": i for i, day in enumerate(days) if i > 1} and calls <= 6
    assert batch(plays) == ({}, 3)  # all of them delivered again: read, and nothing to write
