"""Repeated passages by a sparse suffix array.

Only suffixes that start at minimisers are retained: among the `seed`-word runs
of any window of `length` words, the one with the smallest hash is chosen by
content alone, so equal windows choose equal places and no repeated passage of
`length` words or more goes unseen. The suffixes meet by the hash of their first
`seed` words, so neighbours in their order share that much at least.

A match is then extended left and right to all windows of `length` words that
chose this suffix. As a rule all neighbours agree on that whole stretch, and one
hash of it settles the group. Where they do not (at the rims of a passage, at
edits), every window of the stretch is compared by its own hash, over all
neighbours and not next ones only: extending just the next neighbour in suffix
order can miss a longer match to the left. So a word is found if and only if
some window of `length` words around it occurs twice.

A stretch that holds its own seed twice (periodic text) is always compared window
by window, as it can repeat itself.

A word goes when a window that is not the first of its kind, by id and place,
covers it. Words are split at whitespace and compare with A-Z as a-z.

Defined results: a null or empty text has no words; documents shorter than
`length` words are never cut; a null id sorts last; rows that share an id are
one document. Extra columns are ignored by `find` and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.llm import hashing as H
from scorebook.llm import linking, passages
from scorebook.session import materialized

LENGTH = 50
SEED = 16


def smallest_in_window(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w neighbouring values."""
    n, size, out = len(x) - w + 1, 1, x
    if n <= 0:
        return x[:0]
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:n], out[w - size : w - size + n])


def _chosen(data: np.ndarray, offsets: np.ndarray, length: int, seed: int):
    """Word and seed-run hashes, word offsets, and for every window of `length` words its seed and whether it lies in one row."""
    words, rows = H.word_hashes(data, offsets, H.WHITESPACE, fold=True)
    grams = H.window_hashes(words, seed)
    seeds = smallest_in_window(grams, length - seed + 1)
    return words, grams, rows, seeds, H.whole_windows(rows, length, len(seeds))


def _stretches(column: pa.Array, length: int, seed: int) -> tuple[np.ndarray, pa.ListArray]:
    """Words of every row, and its retained suffixes: first window, number of windows, seed, hash of the stretch, and whether the seed stands in it twice."""
    counts, lists = [], []
    data, offsets = H.utf8(column)
    for _, _, d, o in H.blocks(data, offsets):
        words, grams, rows, seeds, whole = _chosen(d, o, length, seed)
        n = len(seeds)
        row_of = np.searchsorted(rows, np.arange(n), side="right") - 1
        fresh = np.ones(n, bool)
        fresh[1:] = (seeds[1:] != seeds[:-1]) | (row_of[1:] != row_of[:-1]) | ~whole[:-1]
        at = np.flatnonzero(fresh & whole)
        bounds = np.append(np.flatnonzero(fresh | ~whole), n)
        size = bounds[np.searchsorted(bounds, at, side="right")] - at if n else at
        stretch = _run_hashes(words, at, size + length - 1)
        tied = _run_counts(grams, at, size + length - seed, seeds[at]) > 1
        row = row_of[at]
        counts.append(np.diff(rows))
        lists.append(passages.windows_array(
            row, len(o) - 1, pos=(at - rows[row]).astype(np.int32), n=size.astype(np.int32), key=seeds[at], stretch=stretch,
            again=passages.seen_before(row, stretch), tied=tied,
        ))
    return np.concatenate(counts), pa.concat_arrays(lists)


def _run_hashes(words: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the run of size[i] words that starts at word at[i]."""
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    flat = words[np.repeat(at, size) + place]
    sums = np.add.reduceat(H.mix(flat + H.stream(19, int(size.max()))[place]), first)
    return H.mix(sums + size.astype(np.uint64))


def _run_counts(values: np.ndarray, at: np.ndarray, size: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How often wanted[i] stands among the size[i] values from at[i] on."""
    if not len(at):
        return np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) + np.repeat(at - first, size)
    return np.add.reduceat((values[place] == np.repeat(wanted, size)).astype(np.int64), first)


def _drawn(docs: DataFrame, id_col: str, text_col: str, length: int, seed: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, found = _stretches(batch.column(1), length, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), found], ["id", "n_words", "suffixes"])

    kind = "id long, n_words long, suffixes array<struct<pos:int,n:int,key:long,stretch:long,again:boolean,tied:boolean>>"
    return materialized(docs.select(id_col, text_col).mapInArrow(run, kind), "suffixes")


def _windows(docs: DataFrame, id_col: str, text_col: str, keys: DataFrame, length: int, seed: int) -> DataFrame:
    """Every window whose seed is among the keys (id, keys) of its document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = H.utf8(batch.column(1))
            flat = batch.column(2).flatten().to_numpy().view(np.uint64)
            ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
            for first, end, d, o in H.blocks(data, offsets):
                words, _, rows, seeds, whole = _chosen(d, o, length, seed)
                row_of = np.searchsorted(rows, np.arange(len(seeds)), side="right") - 1
                salt = H.stream(23, end - first)
                wanted = H.mix(flat[ends[first] : ends[end]] ^ np.repeat(salt, np.diff(ends[first : end + 1])))
                at = np.flatnonzero(whole & np.isin(H.mix(seeds ^ salt[row_of]), wanted))
                hi, lo = H.window_hashes(words, length)[at], H.window_hashes(H.mix(words), length)[at]
                row = row_of[at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + first)), pa.array((at - rows[row]).astype(np.int32)),
                     pa.array(H.as_long(hi)), pa.array(H.as_long(lo)), pa.array(passages.seen_before(row, hi))],
                    ["id", "pos", "hi", "lo", "again"],
                )

    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("_text"))
    texts = linking.possible(texts, F.xxhash64("_doc"), keys, F.xxhash64("id"))
    rows = texts.join(keys, texts["_doc"].eqNullSafe(keys["id"])).select("id", "_text", "keys")
    return rows.mapInArrow(run, "id long, pos int, hi long, lo long, again boolean")


def _repeats(docs: DataFrame, drawn: DataFrame, id_col: str, text_col: str, length: int, seed: int) -> DataFrame:
    """Ranges of words in repeated windows: id, start, end, first_id, later."""
    id_ = F.coalesce("id", F.lit(passages.LAST_ID))
    suffixes = drawn.select("id", F.inline("suffixes"))
    groups = suffixes.groupBy("key").agg(
        F.count(F.lit(1)).alias("_n"), F.min(id_).alias("first_id"), F.min("stretch").alias("_a"),
        F.max("stretch").alias("_b"), F.max("tied").alias("_tied"),
    ).where("_n > 1 OR _tied")
    groups = groups.select("key", "first_id", (F.expr("_a = _b AND NOT _tied")).alias("agreed"))
    met = materialized(suffixes.join(groups, "key"), "neighbours")
    settled = met.where("agreed").select(
        "id", F.col("pos").alias("start"), (F.col("pos") + F.col("n") + (length - 1)).alias("end"), "first_id",
        (F.col("again") | (id_ > F.col("first_id"))).alias("later"),
    )
    keys = materialized(met.where("NOT agreed").groupBy("id").agg(F.collect_set("key").alias("keys")), "open-keys")
    found = passages.repeated(_windows(docs, id_col, text_col, keys, length, seed))
    extended = found.select("id", F.col("pos").alias("start"), (F.col("pos") + length).alias("end"), "first_id", "later")
    return settled.unionByName(extended)


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED
) -> DataFrame:
    """Per document: words, those in repeated passages, those to remove, and the ids that hold the first occurrences."""
    drawn = _drawn(docs, id_col, text_col, length, seed)
    found = passages.per_document(_repeats(docs, drawn, id_col, text_col, length, seed))
    rows = drawn.select("id", "n_words").alias("d").join(found.alias("f"), F.col("d.id").eqNullSafe(F.col("f.id")), "left")
    return rows.select(
        F.col("d.id").alias(id_col), "n_words", passages.covered(F.col("every")).alias("n_repeated"),
        passages.covered(F.col("gone")).alias("n_removed"),
        F.coalesce("first_docs", F.array().cast("array<bigint>")).alias("first_docs"),
    )


def _starts(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    return H.word_bounds(data, np.array([0, len(data)]), H.WHITESPACE)[0]


def clean(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED
) -> DataFrame:
    """The documents without the words of later passages, with all their columns."""

    def cut(docs: DataFrame, key: str) -> DataFrame:
        drawn = _drawn(docs, key, text_col, length, seed)
        found = _repeats(docs, drawn, key, text_col, length, seed).where("later")
        return passages.cut(docs, found, key, text_col, _starts)

    return passages.by_text(docs, id_col, text_col, cut)
