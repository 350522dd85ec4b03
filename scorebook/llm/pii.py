"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The patterns (email, ip, card, phone) give the base spans; those that fail a
check on their digits are dropped. The network reads every text whole, in
windows of CORE characters with CONTEXT more on each side; every window is
decoded with the CRF, a character takes its tag from the window in whose core it
lies, and runs of a tag, which may cross windows, are the spans of the document.
A run that touches no base span and still looks like its kind is added.

The network learns from labelled spans: passages around what the patterns find
before the checks on digits, so it learns the shape and its surroundings, and
passages of other documents, where nothing is marked. Training takes at most
TRAIN_SPANS passages of each kind and as many others, those with the smallest
hash, out of about SAMPLE_DOCS documents drawn by the hash of their id. Gates are piecewise linear, which keeps the scan of all characters cheap.

Defined results: a null or empty text has no spans; a null id is passed
through; repeated rows are judged one by one; without a labelled span in the
corpus the network adds nothing; extra columns are ignored. Offsets are code
points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorebook.llm import hashing as H

# The kinds in the order of the result, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

CORE, CONTEXT = 128, 16
UNITS = 10
SAMPLE_DOCS = 400_000
TRAIN_SPANS, PASSAGE, EPOCHS, BATCH, RATE = 600, 96, 8, 96, 0.02
_OTHER, _PAD, _SYMBOLS = 128, 129, 130
_WINDOWS = 2048

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, found from every @ so that long runs cost no rescans."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", at + 1)


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def _is_card(text: str) -> bool:
    digits = [int(c) for c in _DIGITS.findall(text)]
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return 13 <= len(digits) <= 19 and (sum(digits[::-2]) + sum(doubled)) % 10 == 0


def shapes(text: str) -> list[Span]:
    """The matches of all patterns before any check on their digits, by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return out


def base_spans(text: str) -> list[Span]:
    """The base spans, by kind and start."""
    out = []
    for kind, a, b in shapes(text):
        piece = text[a:b]
        if (
            kind == "email"
            or (kind == "ip" and _is_ip(piece))
            or (kind == "card" and _is_card(piece))
            or (kind == "phone" and 9 <= len(_DIGITS.findall(piece)) <= 15)
        ):
            out.append((kind, a, b))
    return out


def _learnable(text: str) -> list[Span]:
    """What the network is taught: shapes of a usual length, the check digits aside."""
    out = []
    for kind, a, b in shapes(text):
        n = len(_DIGITS.findall(text[a:b]))
        usual = {"email": b - a <= 64, "ip": 4 <= n <= 12, "card": 13 <= n <= 19, "phone": 9 <= n <= 15}
        if usual[kind] and not (kind == "card" and any(k in ("ip", "phone") and x <= a < y for k, x, y in out)):
            out.append((kind, a, b))
    return [s for s in out if not (s[0] == "card" and any(k == "phone" and x <= s[1] < y for k, x, y in out))]


def _written(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _ordered(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _gate(z: np.ndarray) -> np.ndarray:
    return np.clip(z * np.float32(0.25) + np.float32(0.5), 0, 1)


@dataclass
class Tagger:
    """Weights: per direction the input table and the recurrent matrix, then the tag layer and the transitions."""

    into: list[np.ndarray]
    again: list[np.ndarray]
    tags: np.ndarray
    tag_bias: np.ndarray
    moves: np.ndarray

    @classmethod
    def new(cls, seed: int = 1) -> Tagger:
        r, k = np.random.default_rng(seed), len(KINDS) + 1
        some = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        into = [some(0.5, 4 * UNITS, _SYMBOLS) for _ in range(2)]
        for table in into:
            table[UNITS : 2 * UNITS] += 2  # forget gates start open
        return cls(into, [some(0.3, 4 * UNITS, UNITS) for _ in range(2)], some(0.3, k, 2 * UNITS), np.zeros((k, 1), np.float32),
                   np.zeros((k, k), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.into, *self.again, self.tags, self.tag_bias, self.moves]

    def _states(self, x: np.ndarray, side: int, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, unit, window) of one direction for symbols (time, window)."""
        n, width = x.shape
        out = np.empty((n, UNITS, width), np.float32)
        h, c = np.zeros((UNITS, width), np.float32), np.zeros((UNITS, width), np.float32)
        u = UNITS
        for t in range(n) if side == 0 else range(n - 1, -1, -1):
            z = np.take(self.into[side], x[t], axis=1)
            z += self.again[side] @ h
            gates, g = _gate(z[: 3 * u]), np.clip(z[3 * u :], -1, 1)
            before, c = c, gates[u : 2 * u] * c + gates[:u] * g
            if keep is not None:
                keep.append((t, z, gates, g, before, c, h))
            h = gates[2 * u :] * np.clip(c, -1, 1)
            out[t] = h
        return out

    def _scan(self, x: np.ndarray, side: int) -> np.ndarray:
        """The hidden states as `_states` gives them, with scaled weights and without what training keeps."""
        u, (n, width) = UNITS, x.shape
        into, again = self.into[side].copy(), self.again[side].copy()
        into[: 3 * u] = into[: 3 * u] * np.float32(0.25) + np.float32(0.5)
        again[: 3 * u] *= np.float32(0.25)
        out = np.empty((n, u, width), np.float32)
        h, c = np.zeros((u, width), np.float32), np.zeros((u, width), np.float32)
        z, part, low = np.empty((4 * u, width), np.float32), np.empty((u, width), np.float32), np.zeros((4 * u, 1), np.float32)
        low[3 * u :] = -1
        for t in range(n) if side == 0 else range(n - 1, -1, -1):
            np.take(into, x[t], axis=1, out=z, mode="clip")
            z += again @ h
            np.minimum(z, 1, out=z)
            np.maximum(z, low, out=z)
            np.multiply(z[:u], z[3 * u :], out=part)
            c *= z[u : 2 * u]
            c += part
            np.minimum(c, 1, out=part)
            np.maximum(part, -1, out=part)
            h = out[t]
            np.multiply(z[2 * u : 3 * u], part, out=h)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (time, tag, window)."""
        a, b = self.tags[:, :UNITS], self.tags[:, UNITS:]
        return np.matmul(a, self._scan(x, 0)) + np.matmul(b, self._scan(x, 1)) + self.tag_bias

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequence of every window (time, window), by Viterbi."""
        best = self.scores(x)
        moves = self.moves[:, :, None]
        for t in range(1, len(best)):
            best[t] += (best[t - 1][:, None] + moves).max(axis=0)
        out = np.empty(x.shape, np.uint8)
        out[-1] = best[-1].argmax(axis=0)
        for t in range(len(best) - 1, 0, -1):
            out[t - 1] = (best[t - 1] + self.moves[:, out[t]]).argmax(axis=0)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean negative log-likelihood of tags y (time, window), in the order of `weights`."""
        kept: list[list] = [[], []]
        states = [self._states(x, s, kept[s]) for s in (0, 1)]
        both = np.concatenate(states, axis=1)
        scores = np.matmul(self.tags, both) + self.tag_bias
        d_scores, d_moves = self._crf(scores, y)
        d_tags = np.einsum("tkw,tuw->ku", d_scores, both)
        d_both = np.matmul(self.tags.T, d_scores)
        d_into, d_again = [], []
        flat = np.zeros((_SYMBOLS, x.size), np.float32)
        flat[x.ravel(), np.arange(x.size)] = 1
        for side in (0, 1):
            dz = self._back(side, kept[side], d_both[:, side * UNITS : (side + 1) * UNITS])
            d_into.append(dz.transpose(1, 0, 2).reshape(4 * UNITS, -1) @ flat.T)
            previous = np.zeros_like(states[side])
            previous[1:] = states[side][:-1] if side == 0 else 0
            if side == 1:
                previous[:-1] = states[side][1:]
                previous[-1] = 0
            d_again.append(np.einsum("tzw,tuw->zu", dz, previous))
        return [*d_into, *d_again, d_tags, d_scores.sum(axis=(0, 2))[:, None], d_moves]

    def _back(self, side: int, kept: list, d_states: np.ndarray) -> np.ndarray:
        u = UNITS
        dz_all = np.empty((d_states.shape[0], 4 * u, d_states.shape[2]), np.float32)
        dh, dc = 0, 0
        for t, z, gates, g, before, c, _ in reversed(kept):
            d = d_states[t] + dh
            i, f, o = gates[:u], gates[u : 2 * u], gates[2 * u :]
            dc = dc + d * o * (np.abs(c) < 1)
            d_gates = np.concatenate([dc * g, dc * before, d * np.clip(c, -1, 1)])
            dz = dz_all[t]
            dz[: 3 * u] = d_gates * (np.abs(z[: 3 * u]) < 2) * np.float32(0.25)
            dz[3 * u :] = dc * i * (np.abs(z[3 * u :]) < 1)
            dc = dc * f
            dh = self.again[side].T @ dz
        return dz_all

    def _crf(self, scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals minus truth, for the scores and for the transitions (forward and backward sums)."""
        n, k, width = scores.shape
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0]
        for t in range(1, n):
            ahead[t] = _log_sum(ahead[t - 1][:, None] + self.moves[:, :, None], 0) + scores[t]
        for t in range(n - 2, -1, -1):
            behind[t] = _log_sum(self.moves[:, :, None] + (scores[t + 1] + behind[t + 1])[None], 1)
        total = _log_sum(ahead[-1], 0)
        d = np.exp(ahead + behind - total)
        pairs = np.exp(ahead[:-1, :, None] + self.moves[None, :, :, None] + (scores[1:] + behind[1:])[:, None] - total)
        d_moves = pairs.sum(axis=(0, 3))
        every = np.arange(width)
        for t in range(n):
            d[t, y[t], every] -= 1
        np.add.at(d_moves, (y[:-1].ravel(), y[1:].ravel()), -1)
        return (d / width).astype(np.float32), (d_moves / width).astype(np.float32)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def symbols(text: bytes | np.ndarray) -> np.ndarray:
    """One symbol per code point: its ASCII code, or one symbol for all others."""
    data = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    return np.minimum(data[(data & 0xC0) != 0x80], _OTHER)


def train(passages: list[tuple[str, list[Span]]], epochs: int = EPOCHS, seed: int = 1) -> Tagger:
    """A tagger fitted to passages with their spans (Adam)."""
    x = np.full((PASSAGE, len(passages)), _PAD, np.uint8)
    y = np.zeros((PASSAGE, len(passages)), np.uint8)
    for i, (text, spans) in enumerate(passages):
        found = symbols(text.encode())[:PASSAGE]
        x[: len(found), i] = found
        for kind, a, b in spans:
            y[a:b, i] = KINDS.index(kind) + 1
    tagger, r, step = Tagger.new(seed), np.random.default_rng(seed), 0
    first = [np.zeros_like(w) for w in tagger.weights()]
    second = [np.zeros_like(w) for w in tagger.weights()]
    for epoch in range(epochs):
        order = r.permutation(x.shape[1])
        rate = RATE * (1 - epoch / epochs)
        for i in range(0, len(order), BATCH):
            step += 1
            at = order[i : i + BATCH]
            for w, g, m, v in zip(tagger.weights(), tagger.gradients(x[:, at], y[:, at]), first, second):
                np.clip(g, -5, 5, out=g)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return tagger


def tagged(tagger: Tagger, marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tag of every symbol of the texts that stand one after the other, with these end offsets."""
    out = np.zeros(len(marks), np.uint8)
    sizes = np.diff(ends)
    n = -(-sizes // CORE)
    row = np.repeat(np.arange(len(n)), n)
    core = ends[row] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * CORE
    first, last = ends[row], ends[row + 1]
    steps = np.arange(-CONTEXT, CORE + CONTEXT)
    for i in range(0, len(core), _WINDOWS):
        part = slice(i, i + _WINDOWS)
        at = core[part] + steps[:, None]
        inside = (at >= first[part]) & (at < last[part])
        x = np.where(inside, marks[np.clip(at, 0, len(marks) - 1)], _PAD).astype(np.uint8)
        tags = tagger.decode(x)
        own = inside & (steps >= 0)[:, None] & (steps < CORE)[:, None]
        out[at[own]] = tags[own]
    return out


def _runs(tags: np.ndarray, ends: np.ndarray) -> list[list[Span]]:
    """The runs of a tag in every text."""
    edge = np.ones(len(tags) + 1, bool)
    np.not_equal(tags[1:], tags[:-1], out=edge[1:-1])
    edge[ends] = True
    bounds = np.flatnonzero(edge)
    out: list[list[Span]] = [[] for _ in range(len(ends) - 1)]
    starts = bounds[:-1][tags[bounds[:-1]] > 0] if len(tags) else bounds[:0]
    for a in starts.tolist():
        b = int(bounds[np.searchsorted(bounds, a, side="right")])
        row = int(np.searchsorted(ends, a, side="right")) - 1
        out[row].append((KINDS[tags[a] - 1], a - int(ends[row]), b - int(ends[row])))
    return out


_LOOKS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), "ip": re.compile(r"[0-9]+(?:\.[0-9]+){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9]){12,18}"), "phone": re.compile(r"[+(]?[0-9](?:[\x20().-]*[0-9]){8,14}"),
}


def added(text: str, base: list[Span], runs: list[Span]) -> list[Span]:
    """The runs of the network that touch no base span, look like their kind, and stand free of other letters and digits."""
    out = []
    for kind, a, b in runs:
        piece = text[a:b]
        a, b = a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())
        free = not (text[max(0, a - 1) : a].isalnum() or text[b : b + 1].isalnum())
        if free and _LOOKS[kind].fullmatch(text[a:b]) and not any(a < y and x < b for _, x, y in base):
            out.append((kind, a, b))
    return out


def _passages(docs: DataFrame, id_col: str, text_col: str, most: int) -> list[tuple[str, list[Span]]]:
    """The bounded training sample: passages around spans of every kind, and passages of other documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, str, str, str]] = []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = _learnable(text)
                for n, (kind, a, b) in enumerate(spans):
                    key = int(H.mix(np.array([h + n], np.int64).view(np.uint64))[0] >> np.uint64(1))
                    start = max(0, a - key % max(1, PASSAGE - (b - a)))
                    piece = text[start : start + PASSAGE]
                    inside = [(k, x - start, y - start) for k, x, y in spans if x >= start and y <= start + PASSAGE]
                    rows.append((key, kind, piece, _written(inside)))
            columns = list(zip(*rows)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["h", "kind", "passage", "spans"])

    text, total = F.col(text_col), max(1, docs.count())
    drawn = F.pmod(F.xxhash64(F.lit("drawn"), id_col), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_DOCS / total))
    hashed = docs.where(drawn & text.isNotNull()).select(F.xxhash64(id_col, F.length(text)).alias("h"), text.alias("text"))
    marked = hashed.where(F.col("text").rlike("[0-9@]")).mapInArrow(run, "h long, kind string, passage string, spans string")
    place = F.pmod("h", F.greatest(F.length("text") - PASSAGE, F.lit(1))) + 1
    other = hashed.where(~F.col("text").rlike("[0-9@]") & (F.length("text") > 0)).select(
        "h", F.lit("none").alias("kind"), F.col("text").substr(place.cast("int"), F.lit(PASSAGE)).alias("passage"), F.lit("").alias("spans")
    )
    by_hash = Window.partitionBy("kind").orderBy("h", "passage", "spans")
    limit = F.when(F.col("kind") == "none", most * len(KINDS)).otherwise(most)
    some = marked.unionByName(other).withColumn("r", F.row_number().over(by_hash)).where(
        (F.col("r") <= most * len(KINDS)) & (F.col("r") <= limit)
    )
    rows = some.orderBy("kind", "r").collect()
    if not any(r.kind != "none" for r in rows):
        return []
    return [
        (r.passage, [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]) for r in rows
    ]


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_spans: int = TRAIN_SPANS, epochs: int = EPOCHS
) -> DataFrame:
    """Per document: base spans of every kind, a hash of all base spans, and all spans as kind:start:end."""
    passages = _passages(docs, id_col, text_col, train_spans)
    shared = docs.sparkSession.sparkContext.broadcast(train(passages, epochs) if passages else None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, written = [], [], []
            data, offsets = H.utf8(batch.column(1))
            for _, _, d, o in H.blocks(data, offsets):
                raw, found = d.tobytes(), [[] for _ in range(len(o) - 1)]
                if shared.value is not None:
                    ends = np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)])[o]
                    found = _runs(tagged(shared.value, symbols(d), ends), ends)
                for i, runs in enumerate(found):
                    text = raw[o[i] : o[i + 1]].decode()
                    base = base_spans(text)
                    counts.append([sum(s[0] == k for s in base) for k in KINDS])
                    sha.append(hashlib.sha256(_written(_ordered(base)).encode()).hexdigest())
                    written.append(_written(_ordered(base + added(text, base, runs))))
            numbers = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(numbers[:, i]) for i in range(len(KINDS))), pa.array(sha, pa.string()),
                 pa.array(written, pa.string())],
                [id_col, *(x.split()[0] for x in FOUND.split(", "))],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {FOUND}")
