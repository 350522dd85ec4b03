"""Quality rules on repetition: a suffix array per document, its common prefixes, and limits on what they cover.

The words of a document are the symbols. Prefix doubling sorts all suffixes of
a batch of documents at once (a suffix meets only suffixes of its own
document), the common prefix of neighbours in that order gives the longest
repeat that starts at each word, and the union of these repeats gives the share
of the document that is repetition.

Defined results: a null or empty text has no words and fails the base rule; a
null id is passed through; repeated rows are judged one by one; extra columns
are ignored by `measure` and kept by `passing`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.llm import hashing as H

SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict.

    Base: at least `min_words` words, and at most `max_repeat_percent` of them
    in 3-word windows that occur twice. Method: repeats of `min_repeat` words or
    more may cover at most `max_covered` of the words, and none may be longer
    than `max_longest` words.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    min_repeat: int = 10
    max_covered: float = 0.3
    max_longest: int = 200


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


def longest_repeats(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For every word, the length of the longest run starting there that occurs again in its document."""
    n = len(words)
    reach = np.zeros(n, np.int64)
    if n < 2:
        return reach
    counts = np.diff(rows)
    row_of = np.repeat(np.arange(len(counts)), counts)
    end_of = np.repeat(rows[1:], counts)
    key = H.mix(words ^ H.stream(11, len(counts))[row_of])
    order = np.argsort(key)
    rank, active = _regroup(np.zeros(n, np.int64), order, key[order], np.zeros(n, np.int64))
    levels, step = [rank], 1
    while len(active):
        after = active + step
        following = np.where(after < end_of[active], rank[np.minimum(after, n - 1)] + 1, 0)
        pair = rank[active] * (n + 1) + following
        by_pair = np.argsort(pair)
        positions = active[by_pair]
        rank, active = _regroup(rank, positions, pair[by_pair], rank[positions])
        levels.append(rank)
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    left, right = suffixes[:-1], suffixes[1:]
    same = levels[0][left] == levels[0][right]
    left, right = left[same], right[same]
    common = np.zeros(len(left), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        inside = (a < n) & (b < n)
        equal = inside & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)])
        common += equal.astype(np.int64) << level
    np.maximum.at(reach, left, common)
    np.maximum.at(reach, right, common)
    return reach


def _regroup(rank: np.ndarray, positions: np.ndarray, keys: np.ndarray, base: np.ndarray):
    """New ranks of suffixes sorted by key inside their old groups, and those that still share one."""
    n = len(positions)
    new_key = np.empty(n, bool)
    new_key[0] = True
    np.not_equal(keys[1:], keys[:-1], out=new_key[1:])
    new_base = np.empty(n, bool)
    new_base[0] = True
    np.not_equal(base[1:], base[:-1], out=new_base[1:])
    at = np.arange(n)
    key_start = np.maximum.accumulate(np.where(new_key, at, 0))
    base_start = np.maximum.accumulate(np.where(new_base, at, 0))
    out = rank.copy()
    out[positions] = base + key_start - base_start
    alone = new_key & np.append(new_key[1:], True)
    return out, positions[~alone]


def covered(reach: np.ndarray, least: int) -> np.ndarray:
    """True for the words inside a repeat of at least `least` words."""
    at = np.flatnonzero(reach >= least)
    change = np.zeros(len(reach) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + reach[at], -1)
    return np.cumsum(change[:-1]) > 0


def _repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw, out = data.tobytes(), np.zeros(len(offsets) - 1, np.int64)
    for i in range(len(out)):
        lines = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
        out[i] = len(lines) - len(set(lines))
    return out


def _block(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> list[np.ndarray]:
    words, rows = H.word_hashes(data, offsets, H.WHITESPACE, fold=False)
    n_words = np.diff(rows)
    not_counted = H.byte_flags(H.WHITESPACE + _CONTINUATION)
    word_chars = H.row_sums(~not_counted[data], offsets)
    n_symbols = H.row_sums(H.byte_flags(SYMBOLS)[data], offsets)
    reach = longest_repeats(words, rows)
    n_repeat = H.row_sums(covered(reach, 3), rows)
    n_covered = H.row_sums(covered(reach, rules.min_repeat), rows)
    longest = np.zeros(len(n_words), np.int64)
    some = n_words > 0
    if some.any():
        longest[some] = np.maximum.reduceat(reach, rows[:-1][some])
    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
    method_ok = (n_covered <= rules.max_covered * n_words) & (longest <= rules.max_longest)
    lines = _repeated_lines(data, offsets)
    return [n_words, word_chars, n_symbols, lines, n_repeat, n_covered, longest, base_failed, ~base_failed & method_ok]


def _judged(column: pa.Array, rules: Rules) -> list[np.ndarray]:
    data, offsets = H.utf8(column)
    parts = [_block(d, o, rules) for _, _, d, o in H.blocks(data, offsets)]
    return [np.concatenate(x) for x in zip(*parts)]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The id, the measures and the verdict of every document; one map, no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [pa.array(x) for x in _judged(batch.column(1), rules)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *found], [id_col, *names])

    names = [x.split()[0] for x in MEASURES.split(", ")]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {MEASURES}")


def passing(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that keep to the rules, with all their columns; one map, no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_judged(batch.column(at), rules)[-1]))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, **options) -> DataFrame:
    """Documents, words and rejected documents by outcome, for a look at the limits."""
    return measure(docs, **options).groupBy("base_failed", "kept").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words")
    )
