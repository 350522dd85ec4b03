"""What the passage operators share: which windows of a corpus repeat, and cutting units out of texts.

A window is a run of units (words, sentences) of one document, named by the
document's id, the place of its first unit and a 128-bit hash of its content.
Windows are ordered by id, then place; the first of equal windows is the one
that stays. A null id counts as the largest; rows with equal ids are one
document, unless `by_text` tells them apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.llm import hashing as H
from scorebook.operators.ordering import dense_index
from scorebook.session import materialized

LAST_ID = (1 << 63) - 1


def seen_before(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where the same hash stands earlier in the same row."""
    key = H.mix(hashes ^ H.stream(13, int(rows.max(initial=-1)) + 1)[rows]) if len(rows) else hashes
    _, first = np.unique(key, return_index=True)
    out = np.ones(len(key), bool)
    out[first] = False
    return out


def repeated(windows: DataFrame, thinned: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """The windows (id, pos, hi, lo, again, …) that occur more than once, with the id of the first and whether they come later.

    `again` says that the window stands earlier in its own document, so the
    first one can be found from the smallest id alone. The aggregate sums before
    it shuffles; the join partition of a very frequent window can be split.
    `thinned(windows, groups)` may leave out windows without a group before the join shuffles them.
    """
    id_ = F.coalesce("id", F.lit(LAST_ID))
    groups = windows.groupBy("hi", "lo").agg(F.min(id_).alias("first_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if thinned is not None:
        groups = materialized(groups, "repeated")
        windows = thinned(windows, groups)
    return windows.join(groups.drop("_n"), ["hi", "lo"]).withColumn("later", F.col("again") | (id_ > F.col("first_id")))


def covered(ranges: Column) -> Column:
    """Number of units in an array of (start, end) ranges, overlaps counted once."""
    step = lambda acc, r: F.struct(
        (acc["total"] + F.greatest(F.lit(0).cast("long"), r["end"] - F.greatest(acc["end"], r["start"]))).alias("total"),
        F.greatest(acc["end"], r["end"]).alias("end"),
    )
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end"))
    return F.coalesce(F.aggregate(F.array_sort(ranges), start, step)["total"], F.lit(0).cast("long"))


def per_document(ranges: DataFrame) -> DataFrame:
    """Ranges (id, start, end, first_id, later) as one row per document: all of them, the later ones, and the first ids of those."""
    at = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    other = F.when(F.col("later") & (F.col("first_id") != F.lit(LAST_ID)), F.col("first_id"))
    return ranges.groupBy("id").agg(
        F.collect_list(at).alias("every"), F.collect_list(F.when(F.col("later"), at)).alias("gone"),
        F.array_sort(F.collect_set(other)).alias("first_docs"),
    )


def keep_rest(raw: bytes, starts: np.ndarray, ranges: Iterable[tuple[int, int]]) -> bytes:
    """The text without the units of the given ranges; a unit goes up to the start of the next one."""
    gone = np.zeros(len(starts) + 1, np.int64)
    for a, b in ranges:
        gone[a] += 1
        gone[min(b, len(starts))] -= 1
    out = np.cumsum(gone)[:-1] > 0
    edges = np.append(starts, len(raw))
    kept = [raw[: edges[0]]] + [raw[edges[i] : edges[i + 1]] for i in np.flatnonzero(~out)]
    return b"".join(kept)


def cut(
    docs: DataFrame, ranges: DataFrame, id_col: str, text_col: str, starts_of: Callable[[bytes], np.ndarray],
    drop_emptied: bool = False,
) -> DataFrame:
    """The documents with the units of `ranges` (id, start, end) removed from their texts, all other columns as they are.

    `starts_of(bytes)` gives the byte where each unit of a text starts. With
    `drop_emptied`, documents of which only blanks are left go.
    """
    at = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    extra = "_gone"
    while extra in docs.columns:
        extra += "_"
    gone = ranges.groupBy(F.col("id").alias(f"{extra}id")).agg(F.collect_list(at).alias(extra))
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone[f"{extra}id"]), "left").select(docs["*"], gone[extra])
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            texts = batch.column(place)
            at = [i for i in range(batch.num_rows) if lists[i].is_valid and texts[i].is_valid]
            columns = batch.columns[:-1]
            if at:
                fresh = texts.to_pylist()
                for i in at:
                    raw = fresh[i].encode()
                    fresh[i] = keep_rest(raw, starts_of(raw), [(r["start"], r["end"]) for r in lists[i].as_py()]).decode()
                columns[place] = pa.array(fresh, texts.type)
            out = pa.RecordBatch.from_arrays(columns, names)
            emptied = {i for i in at if drop_emptied and not fresh[i].strip()}
            yield out.filter(pa.array([i not in emptied for i in range(out.num_rows)])) if emptied else out

    names = docs.columns
    return joined.mapInArrow(run, T.StructType(docs.schema.fields))


def by_text(docs: DataFrame, id_col: str, text_col: str, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """`cut(rows, key)` with a key that no two different texts share, in the order of the ids, null last.

    Where every id has one text, the id is the key. Otherwise (id, text) pairs are
    numbered; rows that repeat one keep sharing a number, and so does what is cut out of them.
    """
    key, mark = "_key", "_mark"
    while {key, mark, f"{key}id", f"{mark}of"} & set(docs.columns):
        key, mark = key + "_", mark + "_"
    text = F.xxhash64(F.col(text_col).isNull(), text_col)
    pairs = docs.select(F.col(id_col).alias("id"), text.alias(mark)).distinct()
    if not pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").take(1):
        return cut(docs, id_col)
    at = F.struct(F.col("id").isNull().alias("none"), "id").alias("at")
    numbered = dense_index(pairs.select(at, mark), ["at", mark], key)
    numbered = numbered.select(F.col("at.id").alias(f"{key}id"), F.col(mark).alias(f"{mark}of"), key)
    marked = docs.withColumn(mark, text)
    met = marked[id_col].eqNullSafe(numbered[f"{key}id"]) & (marked[mark] == numbered[f"{mark}of"])
    rows = materialized(marked.join(numbered, met).select(*[marked[c] for c in docs.columns], numbered[key]), "numbered")
    return cut(rows, key).select(*docs.columns)


def windows_array(rows: np.ndarray, n_rows: int, **columns: np.ndarray) -> pa.ListArray:
    """Values grouped by row (sorted) as one list of structs per row."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))]).astype(np.int32)
    kinds = {np.dtype(np.uint64): np.int64}
    values = [pa.array(c.view(kinds.get(c.dtype, c.dtype))) for c in columns.values()]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(values, list(columns)))
