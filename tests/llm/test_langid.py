from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from scorebook.llm import langid

SYLLABLES = {"de": "sch ung keit ein ver ge über".split(), "en": "th ing the wh ea ou tion".split(), "fr": "eau é que ment oi les è".split()}


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(2)
    rows = [(i, text(r, lang, r.randint(5, 120)), lang) for i, lang in enumerate(r.choice(["de", "en", "fr"]) for _ in range(500))]
    rows += [(900, None, "de"), (901, "12 34 !?", "en"), (902, "", "fr"), (903, text(r, "en", 9000), None), (None, text(r, "de", 30), "de"), (3, rows[3][1], rows[3][2])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_held_out_accuracy_and_edge_cases(labelled):
    rows, docs = labelled
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [(i, lang) for i, t, lang in rows if i is not None and zlib.crc32(str(i).encode()) % 3 == 1 and i < 500]
    assert {i for i, r in got.items() if r.held_out and i < 500} == {i for i, _ in held}
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert got[903].lang_pred == "en" and got[None].lang_pred == "de" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values()) and langid.identify(docs).count() == len(rows)


def test_label_source_and_id_do_not_enter_a_prediction(spark, labelled):
    rows, docs = labelled
    before = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    held = {i for i, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    changed = spark.createDataFrame([(i, t, "zz" if i in held else lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(changed).collect()} == before


def test_training_sees_every_label_whatever_the_number_of_documents(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 100, raising=False)
    rows = [(i, f"text {i}", "fr" if i % 200 == 0 else "en") for i in range(2000)] + [(1, "other text", "en"), (1, "text 1", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    free = sorted((lang, t) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1)
    assert ("en", "other text") in free
    assert sorted(zip(*langid._training(docs, "doc_id", "text", "lang", 5000, 5000))) == free
    labels, _ = langid._training(docs, "doc_id", "text", "lang", 20, 5000)
    assert labels.count("en") == 20 and labels.count("fr") == sum(lang == "fr" for lang, _ in free)
    assert langid._training(docs.repartition(2), "doc_id", "text", "lang", 20, 25)[0].count("en") <= 20


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(docs).collect()] == [("und", 0.0)]
    assert langid.identify(docs.limit(0)).count() == 0


def test_gradients():
    r = np.random.default_rng(0)
    net = langid.Network.new(["a", "b", "c"], 4)
    x, y = r.integers(0, 256, (6, 40)).astype(np.uint8), r.integers(0, 3, 6)
    loss = lambda: -np.log(net.probabilities(x)[np.arange(6), y]).mean()
    for w, g in zip(net.weights(), net.gradients(x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = w[at], 1e-2
        w[at] = old + step
        up = loss()
        w[at] = old - step
        down = loss()
        w[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.05, abs=1e-4)


def test_every_byte_of_a_text_lies_in_one_window():
    column = pa.array(["a" * 500, "", None, "é" * 200])
    data, offsets = langid.H.utf8(column)
    starts, row = langid.windows_of(data, offsets)
    assert starts.tolist() == [0, 192, 384, 500, 692, 884] and row.tolist() == [0, 0, 0, 3, 3, 3]
