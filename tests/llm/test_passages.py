"""Lines, sentence spans and repeated passages against plain versions."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import Union, fold, prose, words

from scorebook.llm import lines, linking, minhash, passages, sentences, suffixes

LAST = float("inf")


def later_windows(units_of, rows, size):
    """Per row: units, units in repeated windows, units in later ones, ids of the first.

    `size` is the length of all windows, or gives the end of the window at a place (None: no window).
    """
    seen, out = {}, {}
    end_of = size if callable(size) else lambda us, p: p + size if p + size <= len(us) else None
    units = {}
    for i, text, *_ in rows:
        units.setdefault(i, units_of(text))
    for i, us in units.items():
        for p in range(len(us)):
            if (end := end_of(us, p)) is not None:
                seen.setdefault(tuple(us[p:end]), []).append((LAST if i is None else i, p))
    repeated, removed, firsts = {}, {}, {}
    for w, at in seen.items():
        first = min(at)
        if len(at) > 1:
            for i, p in at:
                repeated.setdefault(i, set()).update(range(p, p + len(w)))
                if (i, p) != first:
                    removed.setdefault(i, set()).update(range(p, p + len(w)))
                    if first[0] != LAST:
                        firsts.setdefault(i, set()).add(first[0])
    for i, us in units.items():
        k = LAST if i is None else i
        out[i] = (len(us), len(repeated.get(k, ())), len(removed.get(k, ())), sorted(firsts.get(k, ())))
    return out, removed


def sentence_list(text):
    out = []
    for s in re.findall(r"[^.!?\n]+", fold(text)):
        ws, cut = words(s), [[]]
        for w in ws:
            cut[-1].append(w)
            if len(ws) > 30 and sum(b for b in w.encode() if b < 128) % 3 == 0:
                cut.append([])
        out += [" ".join(u) for u in cut if u]
    return out


def run_end(us, p):
    """Two sentences or more, lengthened to 36 words; a shorter document is one run."""
    for end in range(p + 2, len(us) + 1):
        if len(" ".join(us[p:end]).split(" ")) >= 36:
            return end
    return len(us) if p == 0 and len(us) >= 2 else None


def unique(rows):
    return list({r[0]: r for r in rows}.values())


def test_sentence_spans_equal_a_plain_version(spark, rows):
    rows = unique(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want, removed = later_windows(sentence_list, rows, run_end)
    got = {r.doc_id: (r.n_sentences, r.n_repeated, r.n_removed, r.first_docs) for r in sentences.find(docs).collect()}
    assert got == want and sum(w[2] > 0 for w in want.values()) > 5
    cleaned = {r.doc_id: r.text for r in sentences.clean(docs).collect()}
    for i, text, *_ in rows:
        kept = [s for p, s in enumerate(sentence_list(text)) if p not in removed.get(i, ())]
        assert " ".join(sentence_list(cleaned[i])) == " ".join(kept)
        if not removed.get(i):
            assert cleaned[i] == text


def test_passages_equal_a_plain_version(spark, rows):
    rows = unique(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for length, seed in ((50, 16), (12, 4)):
        want, removed = later_windows(lambda t: words(fold(t)), rows, length)
        found = suffixes.find(docs, length=length, seed=seed).collect()
        assert {r.doc_id: (r.n_words, r.n_repeated, r.n_removed, r.first_docs) for r in found} == want
    cleaned = {r.doc_id: r.text for r in suffixes.clean(docs, length=12, seed=4).collect()}
    for i, text, *_ in rows:
        assert words(cleaned[i]) == [w for p, w in enumerate(words(text)) if p not in removed.get(i, ())]


def test_periodic_and_nested_repeats(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("ab" if i % 3 else "abcdefgh") for _ in range(r.randint(0, 90)))) for i in range(60)]
    want, _ = later_windows(lambda t: words(fold(t)), rows, 10)
    found = suffixes.find(spark.createDataFrame(rows, "doc_id long, text string"), length=10, seed=4).collect()
    assert {x.doc_id: (x.n_words, x.n_repeated, x.n_removed, x.first_docs) for x in found} == want


def line_list(text):
    return [x.strip(" \t\n\r\x0b\x0c") for x in fold(text).split("\n")]


def test_lines_equal_a_comparison_of_all_pairs(spark):
    r = random.Random(12)
    base = ["".join(r.choice("abcdefghij kl") for _ in range(r.randint(1, 90))) for _ in range(120)]
    rows = []
    for i in range(80):
        some = []
        for _ in range(r.randint(0, 8)):
            line = list(r.choice(base))
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                line[r.randrange(len(line))] = r.choice("xyzÄ")
            some.append(r.choice(["", "  "]) + "".join(line).replace("a", r.choice("aA")))
        rows.append((i, "\n".join(some) if some else r.choice([None, "", "\n"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    places = {}
    for i, text in rows:
        for p, x in enumerate(line_list(text)):
            if x:
                places.setdefault(x, []).append((i, p))
    union, all_ = Union(), sorted(places)
    for n, a in enumerate(all_):
        for b in all_[:n]:
            if lines.similar(a, b):
                union.link(a, b)
    groups = {}
    for x, at in places.items():
        groups.setdefault(union.root(x), []).extend(at)
    repeated, removed, firsts = {}, {}, {}
    for at in groups.values():
        for i, p in at if len(at) > 1 else []:
            repeated.setdefault(i, set()).add(p)
            if (i, p) != min(at):
                removed.setdefault(i, set()).add(p)
                firsts.setdefault(i, set()).add(min(at)[0])
    got = {x.doc_id: (x.n_lines, x.n_repeated, x.n_removed, x.first_docs) for x in lines.find(docs, bands=30, rows=4).collect()}
    assert got == {
        i: (sum(map(bool, line_list(t))), len(repeated.get(i, ())), len(removed.get(i, ())), sorted(firsts.get(i, ())))
        for i, t in rows
    }
    cleaned = {x.doc_id: x.text for x in lines.clean(docs, bands=30, rows=4).collect()}
    for i, text in rows:
        if text:
            kept = [x for p, x in enumerate(text.split("\n")) if p not in removed.get(i, ())]
            assert [x for x in cleaned[i].split("\n") if x.strip()] == [x for x in kept if x.strip()]
    gone = {i for i, t in rows if removed.get(i) and len(removed[i]) == sum(map(bool, line_list(t)))}
    assert gone and {x.doc_id for x in lines.clean(docs, bands=30, rows=4, drop_emptied=True).collect()} == {i for i, _ in rows} - gone


@pytest.mark.parametrize(("union", "shared"), [(5, 4), (10, 8), (15, 12), (50, 40)])
def test_default_bands_of_lines_meet_at_the_threshold(union, shared):
    n = 20_000
    drawn = np.random.default_rng(3).integers(0, 1 << 63, (n, union)).astype(np.uint64)
    one = (union - shared) // 2
    keys = [
        minhash.bin_keys(minhash.binned(s.ravel(), np.repeat(np.arange(n), s.shape[1]), n, lines.BANDS, lines.ROWS))
        for s in (drawn[:, : shared + one], np.delete(drawn, range(shared, shared + one), axis=1))
    ]
    assert (~(keys[0] == keys[1]).any(axis=1)).sum() <= 2


@pytest.mark.parametrize(("union", "shared"), [(5, 4), (10, 8), (50, 40), (300, 240)])
def test_sketches_of_lines_keep_links_at_the_threshold(union, shared):
    r, one, differing = np.random.default_rng(5), (union - shared) // 2, []
    for _ in range(2000):
        drawn = r.integers(0, 1 << 63, union).astype(np.uint64)
        pair = drawn[: shared + one], np.delete(drawn, range(shared, shared + one))
        a, b = (minhash.sketch(s, lines.SKETCH_BITS) for s in pair)
        differing.append(sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)))
    # a tenth of the bits differ, independently: then a pair is beyond the bound with 2e-8
    assert np.isclose(np.mean(differing), 25.6, atol=0.5) and np.isclose(np.std(differing), 4.8, atol=0.3)
    assert max(differing) <= linking.most_differing(80, lines.SIGMAS, lines.SKETCH_BITS) == 55


@pytest.mark.parametrize("n", [9, 60, 400])
def test_odd_sketches_of_lines_keep_every_link_and_refuse_what_is_far_from_one(n):
    r = random.Random(41)
    base = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n + 4)).replace(" ", "_")
    texts = ["".join(r.choice("0123456789") if r.random() < r.choice((0.002, 0.02, 0.06)) else c for c in base) for _ in range(120)]
    texts += [base, base * 2, base + base[: n // 4]]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    sizes, odd, bits = lines._sketches(data, np.concatenate([[0], np.cumsum([len(x) for x in texts])]), 5)
    odd = odd.view(np.uint64).reshape(len(texts), -1)
    sets = [lines.shingle_set(x) for x in texts]
    assert sizes.tolist() == [len(x) for x in sets] and [b is not None for b in bits] == [len(x) > lines.ODD_BITS for x in sets]
    far = ruled_out = links = 0
    for i, p in enumerate(sets):
        for j, q in enumerate(sets[:i]):
            differing = int(np.bitwise_count(odd[i] ^ odd[j]).sum())
            assert differing <= len(p ^ q)
            refused = differing * 180 > (len(p) + len(q)) * 20
            linked = lines.similar(texts[i], texts[j])
            assert not (linked and refused)
            links += linked
            if len(p & q) < 0.65 * len(p | q):
                far, ruled_out = far + 1, ruled_out + refused
    assert links and far and ruled_out > 0.95 * far


def test_variants_of_a_line_that_are_no_links_are_refused_before_their_texts_meet(spark, monkeypatch):
    met, confirmed = [], lines.confirmed

    def counted(pairs, *rest):
        met.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(lines, "confirmed", counted)
    r = random.Random(43)
    base = "the river bends at the old mill and turns to the wide and silent harbour of stone"
    texts = ["".join(r.choice("0123456789") if p in at else c for p, c in enumerate(base)) for at in (r.sample(range(80), 2) for _ in range(150))]
    assert sum(lines.similar(x, y) for x in texts for y in texts) < 0.02 * len(texts) ** 2
    lines.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    assert len(met) == 2 and met[1] < 0.05 * len(texts) ** 2 / 2


def test_default_parameters_link_short_lines(spark):
    r = random.Random(21)
    short = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(600)]
    rows = [(i, x[:8]) for i, x in enumerate(short)] + [(1000 + i, x) for i, x in enumerate(short)]
    assert all(lines.similar(x[:8], x) for x in short) and lines.SIGMAS >= 5
    got = {x.doc_id: (x.n_removed, x.first_docs) for x in lines.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (0, []) if i < 1000 else (1, [i - 1000]) for i, _ in rows}


def test_lines_that_repeat_themselves_are_linked_without_a_lead(spark, monkeypatch):
    drawn = linking.star_pairs
    monkeypatch.setattr(linking, "star_pairs", lambda members: drawn(members).limit(0))
    once = "the river bends at the old mill and turns to the wide and silent harbour of stone. "
    rows = [(1, once.strip()), (2, (once * 3).strip()), (3, "ha " * 5 + "ha"), (4, "ha " * 40 + "ha")]
    assert lines.similar(rows[0][1], rows[1][1]) and lines.similar(rows[2][1], rows[3][1])
    got = {x.doc_id: (x.n_removed, x.first_docs) for x in lines.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, []), 2: (1, [1]), 3: (0, []), 4: (1, [3])}


def test_keys_meet_in_small_runs_slots_and_chunks_as_in_a_plain_grouping(spark, monkeypatch):
    for name, value in {"RUN_ENTRIES": 500, "CHUNK_ENTRIES": 300, "SLOT_ENTRIES": 40}.items():
        monkeypatch.setattr(lines, name, value)
    r = random.Random(31)
    near = ["".join(r.choice("abcdefgh ") for _ in range(50)) for _ in range(30)]
    hot = "one line that very many documents hold in almost the same words"
    rows = [(i, "\n".join([r.choice(near) + r.choice("xyz"), f"{hot} {i:04d}", hot])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashed = lines._hashed(docs, "doc_id", "text")
    got = {}
    for x in lines._members(docs, hashed, "text", 5, 8, 3).collect():
        got.setdefault(x.key, []).append(x.node)
    want = {}
    for d, hashes, a, b in lines._once(pa.array([t for _, t in rows])):
        shingles, owner, _ = lines._shingled(d, a, b, 5)
        keys = minhash.bin_keys(minhash.binned(shingles, owner, len(a), 8, 3))
        for node, some in zip(hashes.view(np.int64).tolist(), keys.tolist()):
            for key in some:
                want.setdefault(key, set()).add(node)
    want = sorted(sorted(x) for x in want.values() if len(x) > 1)
    assert len(want) > 50 and max(map(len, want)) > 100
    assert sorted(sorted(x) for x in got.values()) == want


@pytest.mark.parametrize("operator", [sentences, suffixes, lines])
def test_nulls_repeated_rows_empty_tables_and_clashing_columns(spark, empty, clashing, operator):
    text = ".\n".join(" ".join(f"w{i}{j}" for i in range(10)) for j in range(8))
    rows = [(None, text), (2, text), (1, text), (1, text), (3, None), (4, ""), (5, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = operator.find(docs).collect()
    assert sorted(((r.doc_id, r.n_removed > 0, r.first_docs) for r in got), key=repr) == sorted(
        [(None, True, [1]), (2, True, [1]), (1, False, []), (1, False, []), (3, False, []), (4, False, []), (5, False, [])], key=repr
    )
    cleaned = {(r.doc_id, r.text) for r in operator.clean(docs).collect()}
    assert {(1, text), (3, None), (4, ""), (5, " \n ")} <= cleaned and (2, text) not in cleaned
    assert operator.find(empty).count() == 0 and operator.clean(empty).count() == 0
    out = operator.clean(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()


def test_units_are_cut_from_their_start_to_the_next():
    raw = b"one. two! three? four"
    starts = np.array([0, 5, 10, 17])
    assert passages.keep_rest(raw, starts, [(1, 3)]) == b"one. four"
    assert passages.keep_rest(raw, starts, [(0, 9)]) == b""
    assert passages.keep_rest(b"  " + raw, starts + 2, [(0, 1), (0, 2)]) == b"  three? four"


def clean_all(df):
    return {
        "lines": lines.clean(df), "sentences": sentences.clean(df), "suffixes": suffixes.clean(df, length=12, seed=4)
    }


@pytest.mark.parametrize("ids", [(1, None, None), (1, 7, 7), (7, 7, None)])
def test_a_text_is_never_cut_for_another_row_of_its_id(spark, ids):
    a = prose(random.Random(1), 90) + "."
    b = "Quite unlike the others. " + " ".join(f"only{i}" for i in range(60)) + ". And nothing of it stands elsewhere."
    rows = [(ids[0], a), (ids[1], a), (ids[2], b)]
    for name, out in clean_all(spark.createDataFrame(rows, "doc_id long, text string")).items():
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert (ids[2], b) in got and len(got) == 3, name
        texts = sorted(len(t.strip()) for i, t in got if t != b)
        assert texts[1] == len(a) and (texts[0] < 20 or ids[0] == ids[1]), name


def test_long_texts_without_end_marks_share_spans(spark):
    r = random.Random(4)
    shared = " ".join(f"w{r.randint(0, 400)}" for _ in range(90))
    rows = [(i, f"{' '.join(f'x{i}y{k}' for k in range(20 + i))} {shared} {' '.join(f'z{i}y{k}' for k in range(30))}") for i in range(3)]
    got = {x.doc_id: x for x in sentences.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(x.n_repeated > 3 for x in got.values()) and got[0].n_removed == 0 and got[1].n_removed > 3


def test_very_long_texts(spark):
    long = prose(random.Random(5), 150_000)
    rows = [(1, long), (2, "short one. here it is."), (3, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in sentences.find(df).collect()}
    assert got[1].n_removed < got[1].n_sentences / 10 and got[3].n_removed > got[3].n_sentences * 0.99 and got[2].n_repeated == 0
