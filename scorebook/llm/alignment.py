"""Alignment of two tokenizers over a corpus, by inverted bitmaps of token pairs.

A is a byte-level BPE, B a SentencePiece model; both spell the same bytes, a
space and the text. An A and a B token are linked where their byte ranges
overlap. Between two neighbouring ends of tokens there is exactly one link, so
all links of a block of texts are read off the merged ends.

1. One map encodes every text. Per block of texts it writes a row per document
   and, for every pair of ids, the documents of the block that hold it, as a
   compressed bitmap: 16-bit positions or plain bits, whichever is shorter. Plane
   0 has the documents of the pair; planes 1, 2, 3 … have the bits of its
   multiplicity less one, so nearly all pairs of a block are one short row.
2. A pair's bitmap over the corpus is the OR of its blocks' bitmaps, which lie
   side by side. Popcounts of plane 0 give its documents, those of all planes by
   their weights its links; they are summed before the shuffle, so a pair that
   is in every document costs a row per task.
3. The counts, and whether a pair is the best of its B id, go back along the
   postings: each bitmap takes its pair's scores to its block, and the block's
   documents add up what their bits collect. A block is bounded in characters and rows.

Vocabularies reach the workers as a broadcast of the two files, a few megabytes.

Defined results: a text that is null or empty, or that one of the tokenizers
does not spell byte by byte (a model that rewrites or cannot write some
character), has no tokens: zeros and an empty digest. Ties for the best count
all count. Very long texts are encoded whole, in a block of their own. Repeated
rows and repeated or null ids each get a row and count each time. Extra columns
are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.session import materialized

FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_CHARS, BLOCK_ROWS = 4 << 20, 1 << 16
_B_BITS = 16
# Fixed value: how byte-level BPE cuts a text before it merges.
CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Vocabulary(NamedTuple):
    """A tokenizer: text to ids, and the bytes of every id."""

    encode: Callable[[str], list[int]]
    tokens: list[bytes]
    lengths: np.ndarray


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(0x100 + i): b for i, b in enumerate(others)}


def byte_level(file: bytes) -> Vocabulary:
    """A byte-level BPE from its JSON; special tokens are left out, so their strings are plain text."""
    model, letters = json.loads(file)["model"], _byte_letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in merges]
    if any(x >= y for x, y in zip(ids, ids[1:])):
        raise ValueError("the ids of the vocabulary do not follow the order of its merges")
    merged = {a + b for a, b in merges} | set(letters)
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t in merged}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    coder = tiktoken.Encoding("byte-level", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})
    return Vocabulary(lambda text: coder.encode_ordinary(" " + text), tokens, np.array([len(t) for t in tokens]))


def pieces(file: bytes) -> Vocabulary:
    """A SentencePiece model, which puts the space before a text itself."""
    model = sentencepiece.SentencePieceProcessor(model_proto=file)

    def token(i: int) -> bytes:
        if model.is_byte(i):
            return bytes([int(model.id_to_piece(i)[3:-1], 16)])
        return model.id_to_piece(i).replace("▁", " ").encode()

    tokens = [token(i) for i in range(model.get_piece_size())]
    return Vocabulary(lambda text: model.encode(text, num_threads=1), tokens, np.array([len(t) for t in tokens]))


@lru_cache(maxsize=2)
def vocabularies(a: bytes, b: bytes) -> tuple[Vocabulary, Vocabulary]:
    found = byte_level(a), pieces(b)
    if any(len(v.tokens) > 1 << _B_BITS for v in found):
        raise ValueError("a pair of ids holds 16 bits for each")
    return found


@lru_cache(maxsize=2)
def _spelled(size: int) -> np.ndarray:
    """Ids as decimals with what may follow: a comma, the bar after A's ids, the semicolon after a group, nothing."""
    return np.array([f"{i}{mark}" for i in range(size) for mark in (",", "|", ";", "")], dtype=object)


class Encoded(NamedTuple):
    """The tokens of a block of texts: ids, their ends in bytes counted through the block, and their document."""

    ids: np.ndarray
    ends: np.ndarray
    rows: np.ndarray


def _encoded(ids: list[list[int]], vocabulary: Vocabulary) -> Encoded:
    flat = np.array([i for row in ids for i in row], np.int64)
    return Encoded(flat, np.cumsum(vocabulary.lengths[flat]), np.repeat(np.arange(len(ids)), [len(row) for row in ids]))


def encode(texts: list[str | None], a: Vocabulary, b: Vocabulary) -> tuple[Encoded, Encoded]:
    """Both encodings of every text that both spell in full; none of the others."""
    ids: tuple[list, list] = ([], [])
    for text in texts:
        found: list[list[int]] = [[], []]
        if text:
            whole = b" " + text.encode()
            tried = [v.encode(text) for v in (a, b)]
            if all(b"".join(map(v.tokens.__getitem__, t)) == whole for v, t in zip((a, b), tried)):
                found = tried
        for side, row in zip(ids, found):
            side.append(row)
    return _encoded(ids[0], a), _encoded(ids[1], b)


class Aligned(NamedTuple):
    """Links of a block (document and pair) and the ends that both sides share."""

    rows: np.ndarray
    pairs: np.ndarray
    common: np.ndarray
    common_rows: np.ndarray


def align(a: Encoded, b: Encoded) -> Aligned:
    """One link for every stretch between neighbouring ends: the tokens of both sides that cover it."""
    ends = np.concatenate([a.ends, b.ends])
    order = np.argsort(ends, kind="stable")
    ends, of_a = ends[order], order < len(a.ends)
    first = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]])) if len(ends) else np.zeros(0, np.int64)
    at_a = (np.cumsum(of_a) - of_a)[first]
    at_b = first - at_a
    shared = np.diff(np.append(first, len(ends))) == 2
    pairs = a.ids[at_a] << _B_BITS | b.ids[at_b]
    return Aligned(a.rows[at_a], pairs, ends[first][shared], a.rows[at_a][shared])


def _group_digests(a: Encoded, b: Encoded, common: np.ndarray, n: int) -> list[str]:
    """Digest of every document's groups, written as `a1,a2|b1;a3|b2,b3`."""
    place = np.concatenate([np.searchsorted(common, a.ends) * 2, np.searchsorted(common, b.ends) * 2 + 1])
    order = np.argsort(place, kind="stable")
    place, ids, rows = place[order], np.concatenate([a.ids, b.ids])[order], np.concatenate([a.rows, b.rows])[order]
    mark = np.where(place % 2 == 0, 1, 2)
    if len(place):
        mark[:-1][place[1:] == place[:-1]] = 0
        mark[:-1][rows[1:] != rows[:-1]] = 3
        mark[-1] = 3
    spelled = _spelled(1 << _B_BITS)[ids * 4 + mark].tolist()
    ends = np.searchsorted(rows, np.arange(n + 1))
    return [sha256("".join(spelled[x:y]).encode()).hexdigest() if y > x else "" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _packed(pairs: np.ndarray, rows: np.ndarray, n_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Bitmaps of sorted (pair, row) entries: pair, popcount and bytes, of positions or, where these are longer, of plain bits."""
    if not len(pairs):
        return
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    counts = np.diff(np.append(first, len(pairs)))
    width = (n_rows + 7) // 8
    dense = counts * 2 > width
    sparse_rows = rows[np.repeat(~dense, counts)].astype("<u2")
    offsets = np.concatenate([[0], np.cumsum(counts[~dense] * 2)]).astype(np.int32)
    bits = pa.Array.from_buffers(pa.binary(), int((~dense).sum()), [None, pa.py_buffer(offsets), pa.py_buffer(sparse_rows)])
    yield pairs[first[~dense]], counts[~dense], bits
    if dense.any():
        full = []
        for k in np.flatnonzero(dense):
            flags = np.zeros(width * 8, np.uint8)
            flags[rows[first[k] : first[k] + counts[k]]] = 1
            full.append(np.packbits(flags, bitorder="little").tobytes())
        yield pairs[first[dense]], counts[dense], pa.array(full, pa.binary())


def postings(rows: np.ndarray, pairs: np.ndarray, n_rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """(plane, pairs, popcounts, bitmaps) of a block's links."""
    entries, times = np.unique(pairs << _B_BITS | rows, return_counts=True)
    pair, row, more = entries >> _B_BITS, entries & ((1 << _B_BITS) - 1), times - 1
    for found in _packed(pair, row, n_rows):
        yield 0, *found
    for bit in range(int(more.max(initial=0)).bit_length()):
        some = (more >> bit) & 1 == 1
        for found in _packed(pair[some], row[some], n_rows):
            yield bit + 1, *found


def unpacked(bits: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of bitmaps: which bitmap, which row."""
    if isinstance(bits, pa.ChunkedArray):
        bits = bits.combine_chunks()
    bits = bits.cast(pa.large_binary())
    if not len(bits):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(bits.buffers()[1], np.int64)[bits.offset : bits.offset + len(bits) + 1]
    data = np.frombuffer(bits.buffers()[2], np.uint8)
    sizes = np.diff(offsets)
    sparse = sizes == counts * 2
    kept = np.repeat(sparse, sizes)
    at, rows = [np.repeat(np.flatnonzero(sparse), counts[sparse])], [data[offsets[0] : offsets[-1]][kept].view("<u2").astype(np.int64)]
    for k in np.flatnonzero(~sparse):
        found = np.flatnonzero(np.unpackbits(data[offsets[k] : offsets[k + 1]], bitorder="little"))
        at.append(np.full(len(found), k))
        rows.append(found)
    return np.concatenate(at), np.concatenate(rows)


def _blocks(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about so many characters of text; a longer text is a run of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        more = len(text or "")
        if i > start and (size + more > limit or i - start >= BLOCK_ROWS):
            yield start, i
            start, size = i, 0
        size += more
    if len(texts) > start:
        yield start, len(texts)


def _longs(n: int, value: int | np.ndarray) -> pa.Array:
    return pa.array(np.broadcast_to(np.asarray(value, np.int64), n))


def encoded(docs: DataFrame, id_col: str, text_col: str, folder: str, block_chars: int) -> DataFrame:
    """One pass over the texts: a row per document (pair is null) and a row per bitmap (n bits) of a block."""
    files = []
    for name in (BYTE_LEVEL, PIECES):
        with open(f"{folder}/{name}", "rb") as file:
            files.append(file.read())
    shared = docs.sparkSession.sparkContext.broadcast(tuple(files))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["block", "row", "id", *COUNTS, "groups_sha256", "pair", "plane", "n", "bits"]
    schema = (
        f"block long, row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pair long, plane long, n long, bits binary"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = vocabularies(*shared.value)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, end in _blocks(texts, block_chars):
                n = end - start
                left, right = encode(texts[start:end], a, b)
                found = align(left, right)
                per_row = [np.bincount(x, minlength=n) for x in (left.rows, right.rows, found.common_rows, found.rows)]
                digests = _group_digests(left, right, found.common, n)
                yield pa.RecordBatch.from_arrays(
                    [_longs(n, block), _longs(n, np.arange(n)), ids.slice(start, n), *(_longs(n, x) for x in per_row), pa.array(digests),
                     *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names
                )
                for plane, pairs, counts, bits in postings(found.rows, found.pairs, n):
                    m = len(pairs)
                    none = [pa.nulls(m, t) for t in (pa.int64(), ids.type, *[pa.int64()] * 4, pa.string())]
                    yield pa.RecordBatch.from_arrays(
                        [_longs(m, block), *none, _longs(m, pairs), _longs(m, plane), _longs(m, counts), bits], names
                    )
                block += 1

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _weight() -> F.Column:
    return F.when(F.col("plane") == 0, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, cast(plane - 1 AS int))"))


def scores(stored: DataFrame) -> DataFrame:
    """Per pair of ids: pair, a, b, n_docs, n_links and whether no other pair of that b has more links."""
    counts = stored.where("pair IS NOT NULL").groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("n_docs"), F.sum(F.col("n") * _weight()).alias("n_links")
    )
    pairs = materialized(
        counts.select("pair", F.shiftright("pair", _B_BITS).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1)).alias("b"), "n_docs", "n_links"),
        "pairs",
    )
    most = pairs.groupBy("b").agg(F.max("n_links").alias("_most"))
    return pairs.join(most, "b").select("pair", "a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("_most")).alias("best"))


def pairs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Per linked pair of ids: a, b, n_docs, n_links and best."""
    return scores(materialized(encoded(docs, id_col, text_col, folder, block_chars), "encoded")).drop("pair")


def _collected(documents: pa.Table, bitmaps: pa.Table) -> pa.Table:
    """A block's documents with the scores that the bits of the block's bitmaps bring them."""
    n = documents.num_rows
    place = documents.column("row").to_numpy()
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at, rows = unpacked(bitmaps.column("bits"), bitmaps.column("n").to_numpy())
    weight = bitmaps.column("weight").to_numpy()
    np.add.at(best, rows, (weight * bitmaps.column("best").to_numpy())[at])
    np.add.at(total, rows, (weight * bitmaps.column("score").to_numpy())[at])
    kept = documents.drop_columns(["block", "row"])
    return kept.append_column("n_best", pa.array(best[place])).append_column("count_sum", pa.array(total[place]))


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum."""
    stored = materialized(encoded(docs, id_col, text_col, folder, block_chars), "encoded")
    scored = scores(stored).select("pair", F.col("n_links").alias("score"), F.col("best").cast("long").alias("best"))
    back = stored.where("pair IS NOT NULL").join(scored, "pair").select(F.col("block").alias("held_by"), _weight().alias("weight"), "n", "bits", "score", "best")
    rows = stored.where("pair IS NULL").select("block", "row", "id", *COUNTS, "groups_sha256")
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    out = rows.groupBy("block").cogroup(back.groupBy("held_by")).applyInArrow(
        _collected, f"id {kind}, {counts}, groups_sha256 string, n_best long, count_sum long"
    )
    return out.withColumnRenamed("id", id_col)
