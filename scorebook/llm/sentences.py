"""Substring dedup by sliding sentence spans.

A sentence is a stretch between [.!?] and line ends that holds a word; it
compares by its words (split at whitespace, A-Z as a-z). A sentence of more than
LONG words is cut after every word whose ASCII bytes add up to a multiple of
CUT, so text without end marks has spans too, and equal passages are cut alike
wherever they stand. From every sentence on, the run of at least `span`
sentences is hashed that holds `min_words` words: a run of short sentences is
lengthened sentence by sentence. A document of fewer words is one run, if it has
`span` sentences. Runs that occur more than once in the corpus are joined
globally, and a sentence goes when a run that is not the first of its kind
covers it. The first occurrence, by id and place, stays whole.

Defined results: a null or empty text has no sentences and comes out as it
went in; a null id sorts last; for `find` and `spans` rows that share an id are
one document, while `clean` takes every different text for itself and never
cuts one for what another row of its id holds. A document with fewer sentences
than a span is never cut. Very long texts are read whole, in blocks of their
own. Repeated rows are cut alike; an empty table gives an empty result. Extra
columns are ignored by `find` and `spans` and kept by `clean`, whatever their names.
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

SPAN = 2
MIN_WORDS = 36
LONG, CUT = 30, 3
_ENDS = b".!?\n"
_SEPARATORS = H.WHITESPACE + b".!?"


def _letter_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the ASCII bytes of every word, A-Z as a-z."""
    values = np.arange(256)
    values[128:] = 0
    values[list(H.UPPER)] = list(H.LOWER)
    total = np.concatenate([[0], np.cumsum(values[data])])
    return total[ends] - total[starts]


def run_ends(rows: np.ndarray, n_words: np.ndarray, span: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end sentence of every run; `rows` are the sentence offsets of the documents."""
    total = np.concatenate([[0], np.cumsum(n_words)])
    starts = np.arange(len(n_words))
    ends = np.maximum(starts + span, np.searchsorted(total, total[:-1] + min_words))
    last = np.repeat(rows[1:], np.diff(rows))
    opens = np.isin(starts, rows[:-1]) & (starts + span <= last)
    ends = np.where(opens, np.minimum(ends, last), ends)
    whole = ends <= last
    return starts[whole], ends[whole]


def sentences_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, hash and number of words of every sentence, and the sentence offsets of the rows."""
    starts, ends, rows = H.word_bounds(data, offsets, _SEPARATORS)
    words = H.span_hashes(data, starts, ends, H.byte_values(_SEPARATORS, True))
    if not len(words):
        return starts, words, starts, np.zeros(len(offsets), np.int64)
    before = np.cumsum(H.byte_flags(_ENDS)[data])[starts]
    first = np.ones(len(words), bool)
    np.not_equal(before[1:], before[:-1], out=first[1:])
    first[rows[:-1][rows[:-1] < len(words)]] = True
    at = np.flatnonzero(first)
    n_words = np.diff(np.append(at, len(words)))
    long = np.repeat(n_words > LONG, n_words)
    cut = long & (_letter_sums(data, starts, ends) % CUT == 0)
    first[1:] |= cut[:-1]
    at = np.flatnonzero(first)
    n_words = np.diff(np.append(at, len(words)))
    place = np.arange(len(words)) - np.repeat(at, n_words)
    sums = np.add.reduceat(H.mix(words + H.stream(17, int(n_words.max()))[place]), at)
    return starts[at], H.mix(sums), n_words, np.searchsorted(at, rows)


def _runs(column: pa.Array, span: int, min_words: int) -> tuple[np.ndarray, pa.ListArray]:
    counts, lists = [], []
    data, offsets = H.utf8(column)
    for _, _, d, o in H.blocks(data, offsets):
        _, hashes, n_words, rows = sentences_of(d, o)
        at, end = run_ends(rows, n_words, span, min_words)
        hi, lo = H.run_hashes(hashes, at, end), H.run_hashes(H.mix(hashes), at, end)
        row = np.searchsorted(rows, at, side="right") - 1
        counts.append(np.diff(rows))
        lists.append(passages.windows_array(
            row, len(o) - 1, pos=(at - rows[row]).astype(np.int32), size=(end - at).astype(np.int32), hi=hi, lo=lo,
            again=passages.seen_before(row, hi),
        ))
    return np.concatenate(counts), pa.concat_arrays(lists)


def _drawn(docs: DataFrame, id_col: str, text_col: str, span: int, min_words: int) -> DataFrame:
    """Per document its id, number of sentences and hashed runs; a written table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, runs = _runs(batch.column(1), span, min_words)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), runs], ["id", "n_sentences", "runs"])

    kind = "id long, n_sentences long, runs array<struct<pos:int,size:int,hi:long,lo:long,again:boolean>>"
    return materialized(docs.select(id_col, text_col).mapInArrow(run, kind), "sentence-runs")


def _repeats(drawn: DataFrame) -> DataFrame:
    found = passages.repeated(
        drawn.select("id", F.inline("runs")), lambda windows, groups: linking.possible(windows, F.col("hi"), groups, F.col("hi"))
    )
    return found.select("id", F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("end"), "first_id", "later")


def spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, min_words: int = MIN_WORDS
) -> DataFrame:
    """The repeated runs: id, first and end sentence, id of the first occurrence, and whether they come later."""
    return _repeats(_drawn(docs, id_col, text_col, span, min_words)).withColumnRenamed("id", id_col)


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, min_words: int = MIN_WORDS
) -> DataFrame:
    """Per document: sentences, those in repeated runs, those to remove, and the ids that hold the first occurrences."""
    drawn = _drawn(docs, id_col, text_col, span, min_words)
    found = passages.per_document(_repeats(drawn))
    rows = drawn.select("id", "n_sentences").alias("d").join(found.alias("f"), F.col("d.id").eqNullSafe(F.col("f.id")), "left")
    return rows.select(
        F.col("d.id").alias(id_col), "n_sentences", passages.covered(F.col("every")).alias("n_repeated"),
        passages.covered(F.col("gone")).alias("n_removed"),
        F.coalesce("first_docs", F.array().cast("array<bigint>")).alias("first_docs"),
    )


def _starts(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    return sentences_of(data, np.array([0, len(data)]))[0]


def clean(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, min_words: int = MIN_WORDS
) -> DataFrame:
    """The documents without the sentences of later runs, with all their columns."""

    def cut(rows: DataFrame, key: str) -> DataFrame:
        found = _repeats(_drawn(rows, key, text_col, span, min_words)).where("later")
        return passages.cut(rows, found, key, text_col, _starts)

    return passages.by_text(docs, id_col, text_col, cut)
