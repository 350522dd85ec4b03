"""Language identification by a convolutional network on bytes, trained in numpy.

Every text is cut into windows of WINDOW bytes, all of them, none overlapping;
the last is filled up with zeros. A window's bytes (A-Z as a-z) are embedded,
filters of several widths slide over them, each filter keeps its largest
response, and a softmax over the languages follows. A document's language is
the one with the largest mean probability over its windows, weighted by their
letters; equal ones go to the first in order.

Training takes at most TRAIN_DOCS labelled documents of each language, those
with the smallest hash of their id, and SAMPLES windows of each at places drawn
by hash; at most TRAIN_ROWS documents in all. They are chosen by id among all
labelled documents, then their passages are fetched. Held-out documents, those
with crc32(id) mod 3 = 1, never train. Only text and label enter the fit, only text
the prediction. The network has some ten thousand weights.

Defined results: a null text, or one without a letter, is `und` with score 0; a
document with a null id is judged but never trains and is not held out; without
any labelled document every prediction is `und`; repeated rows are judged one by
one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorebook.llm import hashing as H

UNKNOWN = "und"
WINDOW = 192
WIDTHS = (3, 4, 5)
FILTERS, EMBEDDING = 16, 8
TRAIN_DOCS, TRAIN_ROWS, SAMPLES = 400, 40_000, 4
EPOCHS, BATCH, RATE = 4, 128, 0.005
_CHUNK = 256

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[list(H.UPPER)] = list(H.LOWER)
_LETTER = np.zeros(256, np.int64)
_LETTER[[*H.UPPER, *H.LOWER, *range(0x80, 0x100)]] = 1


@dataclass
class Network:
    """Languages and weights: byte embedding, filters and biases of each width, and the last layer."""

    langs: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    last: np.ndarray
    last_bias: np.ndarray

    @classmethod
    def new(cls, langs: list[str], seed: int = 1) -> Network:
        r = np.random.default_rng(seed)
        some = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        return cls(
            langs, some(256, EMBEDDING) * 8, [some(w * EMBEDDING, FILTERS) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS], some(len(WIDTHS) * FILTERS, len(langs)),
            np.zeros(len(langs), np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.last, self.last_bias]

    def _responses(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Per width: the stacked embeddings, the largest response of every filter, and its place."""
        embedded = self.embedding[x]
        stacked, best, place = [], [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases):
            n = x.shape[1] - w + 1
            columns = np.concatenate([embedded[:, j : j + n] for j in range(w)], axis=2)
            out = columns.reshape(-1, w * EMBEDDING) @ f
            out = out.reshape(len(x), n, FILTERS)
            at = out.argmax(axis=1)
            stacked.append(columns)
            place.append(at)
            best.append(np.maximum(np.take_along_axis(out, at[:, None], 1)[:, 0] + b, 0))
        return stacked, best, place

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Probability of every language for every window of bytes."""
        embedded = self.embedding[x]
        best = []
        for w, f, b in zip(WIDTHS, self.filters, self.biases):
            n = x.shape[1] - w + 1
            columns = np.concatenate([embedded[:, j : j + n] for j in range(w)], axis=2)
            out = (columns.reshape(-1, w * EMBEDDING) @ f).reshape(len(x), n, FILTERS)
            best.append(np.maximum(out.max(axis=1) + b, 0))
        return _softmax(np.concatenate(best, axis=1) @ self.last + self.last_bias)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy, in the order of `weights`."""
        stacked, best, place = self._responses(x)
        hidden = np.concatenate(best, axis=1)
        d = _softmax(hidden @ self.last + self.last_bias)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        d_hidden = (d @ self.last.T) * (hidden > 0)
        d_embedding = np.zeros_like(self.embedding)
        d_filters, d_biases = [], []
        rows = np.arange(len(x))[:, None]
        for i, w in enumerate(WIDTHS):
            part = d_hidden[:, i * FILTERS : (i + 1) * FILTERS]
            chosen = stacked[i][rows, place[i]]
            d_filters.append(np.einsum("bfd,bf->df", chosen, part))
            d_biases.append(part.sum(axis=0))
            back = np.einsum("bf,df->bfd", part, self.filters[i]).reshape(len(x), FILTERS, w, EMBEDDING)
            for j in range(w):
                np.add.at(d_embedding, x[rows, place[i] + j], back[:, :, j])
        return [d_embedding, *d_filters, *d_biases, hidden.T @ d, d.sum(axis=0)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 1) -> Network:
    """A network fitted to folded windows and their language numbers (Adam)."""
    net, r = Network.new(langs, seed), np.random.default_rng(seed)
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(windows))
        rate = RATE * (1 - epoch / epochs)
        for i in range(0, len(order), BATCH):
            step += 1
            at = order[i : i + BATCH]
            for w, g, m, v in zip(net.weights(), net.gradients(windows[at], labels[at]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(3)) == 1, F.lit(False))


def _training(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, most: int) -> tuple[list[str], list[str]]:
    """Labels and passages of the bounded training sample, in a fixed order."""
    id_, text = F.col(id_col), F.col(text_col)
    usable = docs.where(~_held_out(id_) & id_.isNotNull() & F.col(lang_col).isNotNull() & text.rlike(r"\p{L}"))
    places = [F.pmod(F.xxhash64(id_, F.lit(k)), F.greatest(F.length(text) - WINDOW, F.lit(1))) + 1 for k in range(SAMPLES)]
    cut = F.array(*[text.substr(p.cast("int"), F.lit(WINDOW)) for p in places])
    named = usable.select(F.col(lang_col).alias("lang"), id_.alias("id"), F.xxhash64(id_).alias("h"), cut.alias("passages"))
    by_hash, by_text = Window.partitionBy("lang").orderBy("h", "id"), Window.partitionBy("lang", "id").orderBy("passages")
    ranked = named.select("lang", "id", "h").withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= per_lang)
    picked = ranked.orderBy("r", "h", "id", "lang").limit(most)  # no texts in it; a repeated id stands once for each of its rows
    chosen = picked.groupBy("lang", "id").agg(F.min("r").alias("first"), F.count(F.lit(1)).alias("n"))
    met = named.join(F.broadcast(chosen), ["lang", "id"]).withColumn("k", F.row_number().over(by_text))
    some = met.where((F.col("k") <= per_lang) & (F.col("k") <= F.col("n"))).withColumn("r", F.col("first") + F.col("k") - 1)
    rows = some.orderBy("r", "h", "id", "lang").collect()
    pairs = [(r.lang, p) for r in rows for p in dict.fromkeys(r.passages)]
    return [x for x, _ in pairs], [x for _, x in pairs]


def windows_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and row of every window."""
    n = -(-np.diff(offsets) // WINDOW)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return offsets[row] + place * WINDOW, row


def _bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < ends[:, None], raw[np.minimum(at, len(raw) - 1)], 0).astype(np.uint8)


def mean_probabilities(net: Network, column: pa.Array) -> np.ndarray:
    """Per text the mean probability of every language over its windows, weighted by their letters."""
    data, offsets = H.utf8(column)
    total = np.zeros((len(offsets) - 1, len(net.langs)))
    weight = np.zeros(len(offsets) - 1)
    for first, _, d, o in H.blocks(data, offsets):
        starts, row = windows_of(d, o)
        for i in range(0, len(starts), _CHUNK):
            x = _bytes(d, starts[i : i + _CHUNK], o[1:][row[i : i + _CHUNK]])
            letters = _LETTER[x].sum(axis=1)
            at = first + row[i : i + _CHUNK]
            np.add.at(total, at, net.probabilities(_FOLD[x]) * letters[:, None])
            np.add.at(weight, at, letters)
    return total / np.maximum(weight, 1)[:, None]


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS,
    train_rows: int = TRAIN_ROWS, seed: int = 1,
) -> DataFrame:
    """Per document: id, held_out, lang_pred and score."""
    labels, passages = _training(docs, id_col, text_col, lang_col, train_docs, train_rows)
    langs = sorted(set(labels))
    net = None
    if langs:
        raw = [p.encode()[:WINDOW] for p in passages]
        x = np.frombuffer(b"".join(p.ljust(WINDOW, b"\0") for p in raw), np.uint8).reshape(-1, WINDOW)
        net = train(_FOLD[x], np.searchsorted(langs, labels), langs, seed=seed)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, has_letter = batch.num_rows, batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            names, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if shared.value is not None and n:
                p = mean_probabilities(shared.value, batch.column(1))
                best = p.argmax(axis=1)
                names = np.where(has_letter, np.array(shared.value.langs, object)[best], UNKNOWN)
                score = np.where(has_letter, np.minimum(p[np.arange(n), best], 1.0), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                [id_col, "held_out", "lang_pred", "score"],
            )

    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(id_col, text_col, has_letter.alias("_letter"), _held_out(F.col(id_col)).alias("held_out"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
