"""Benchmark decontamination: one Aho-Corasick automaton over all item windows, one scan of every text.

Text is normalised byte for byte: A-Z become a-z, every other byte outside
[0-9a-z] and non-ASCII becomes a blank, runs of blanks become one. A window is
`width` neighbouring words of an item (the whole item if it has fewer words,
but at least one). A document word inside any occurrence of a window is hit.

The item table must fit a task as an automaton. Its windows are measured on the
cluster first: up to MAX_WINDOWS they form one automaton; beyond that the items
are dealt into several of that size, which scan the documents one after the
other in the same stage. Only the item table ever reaches the driver, one deal
at a time.

Defined results: a null or empty document has no words; a null or wordless item
has no windows; an item without an id marks words but is not listed; equal
items are listed under each of their ids; extra columns of either table are
ignored by `find` and kept by `passing`.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from scorebook.llm import hashing as H

WIDTH = 10
MAX_WINDOWS = 2_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

_NORMAL = bytearray(range(256))
for _b in H.NOT_ALNUM:
    _NORMAL[_b] = 0x20
for _a, _b in zip(H.UPPER, H.LOWER):
    _NORMAL[_a] = _b
_NORMAL = bytes(_NORMAL)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_NORMAL).split()


def automaton(items: Iterable[tuple[str | None, str]], width: int = WIDTH) -> ahocorasick.Automaton | None:
    """The automaton of all windows; each leads to its number of words and its item ids."""
    ids: dict[str, set[str | None]] = {}
    for item, text in items:
        words = words_of(text.encode())
        for i in range(max(1, len(words) - width + 1) if words else 0):
            window = b" " + b" ".join(words[i : i + width]) + b" "
            ids.setdefault(window.decode("latin-1"), set()).add(item)
    if not ids:
        return None
    made = ahocorasick.Automaton()
    for window, of in ids.items():
        made.add_word(window, (window.count(" ") - 1, frozenset(of)))
    made.make_automaton()
    return made


def scan(made: ahocorasick.Automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
    """Hit word ranges (first, end), merged and in order, and the items found."""
    ends = None
    ranges: list[tuple[int, int]] = []
    items: set[str | None] = set()
    for last, (n, of) in made.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
        if ends is None:  # where the blank behind each word stands
            ends = list(accumulate((len(w) + 1 for w in words), initial=0))[1:]
        end = bisect_left(ends, last) + 1
        items |= of
        while ranges and ranges[-1][0] >= end - n:
            ranges.pop()
        if ranges and ranges[-1][1] >= end - n:
            ranges[-1] = (ranges[-1][0], end)
        else:
            ranges.append((end - n, end))
    return ranges, items


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _deals(items: DataFrame, id_col: str, text_col: str, width: int, most: int) -> Iterator[list[Row]]:
    """The item rows in runs of at most about `most` windows, each run small enough for the driver and a task."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where(
        F.col("text").isNotNull()
    )
    weighed = rows.withColumn("n", F.regexp_count("text", F.lit(WORD)).cast("long")).where("n > 0")
    total = weighed.agg(F.sum("n")).first()[0] or 0
    parts = -(-total // most) or 1
    for part in range(parts):
        chosen = weighed if parts == 1 else weighed.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        yield chosen.collect()


def _scanners(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, width: int, most: int) -> list:
    """One broadcast automaton per deal."""
    context = docs.sparkSession.sparkContext
    made = (automaton(((r.item, r.text) for r in deal), width) for deal in _deals(items, item_id, item_text, width, most))
    return [context.broadcast(x) for x in made if x is not None]


def _judge(raw: bytes, scanners: list) -> tuple[int, list[tuple[int, int]], list[str]]:
    words = words_of(raw)
    found = [scan(s.value, words) for s in scanners] if words else []
    ranges = found[0][0] if len(found) == 1 else merged(r for f in found for r in f[0])
    return len(words), ranges, sorted({i for f in found for i in f[1] if i is not None})


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = H.utf8(column)
    raw = data.tobytes()
    for i in range(len(offsets) - 1):
        yield raw[offsets[i] : offsets[i + 1]]


def find(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", width: int = WIDTH, max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """For every document its words, hit words and the items found; one map, no shuffle."""
    scanners = _scanners(docs, items, item_id, item_text, width, max_windows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, n_items, sha = [], [], [], []
            for raw in _texts(batch.column(1)):
                n, ranges, found = _judge(raw, scanners)
                n_words.append(n)
                n_hit.append(sum(b - a for a, b in ranges))
                n_items.append(len(found))
                sha.append(hashlib.sha256(",".join(found).encode()).hexdigest())
            hit = pa.array(n_hit, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), hit, pa.array(n_items, pa.int64()), pa.array(sha, pa.string()),
                 pa.array([x > 0 for x in n_hit], pa.bool_())],
                [id_col, *(x.split()[0] for x in FOUND.split(", "))],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {FOUND}")


def _offsets(raw: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code point ranges of the original text; normalising keeps every byte in its place."""
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = H.word_bounds(data, np.array([0, len(data)]), H.NOT_ALNUM)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in ranges]


def spans(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", width: int = WIDTH, max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """The contaminated stretches of the original texts: id, start and end in code points, and the passage."""
    scanners = _scanners(docs, items, item_id, item_text, width, max_windows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, start, end, passage = [], [], [], []
            for i, raw in enumerate(_texts(batch.column(1))):
                _, ranges, _ = _judge(raw, scanners)
                for a, b in _offsets(raw, ranges) if ranges else []:
                    at.append(i)
                    start.append(a)
                    end.append(b)
                    passage.append(raw.decode()[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                 pa.array(passage, pa.string())],
                [id_col, "start", "end", "passage"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, end long, passage string")


def passing(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = WIDTH, max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """The documents without a hit word, with all their columns; one map, no shuffle."""
    scanners = _scanners(docs, items, item_id, item_text, width, max_windows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array([not _judge(raw, scanners)[1] for raw in _texts(batch.column(at))]))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)
