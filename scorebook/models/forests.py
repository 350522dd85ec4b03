"""Random forest of regression trees, grown by tasks that finish whole subtrees.

Values are binned once: a feature with at most BINS different values has a bin
for each, another one BINS bins of equal frequency; thresholds stand half-way to
the next value that occurs. A tree draws every row as often as a Poisson(1)
variable of the row's own hash and the tree says, so the draws hang on the rows
and the seed, not on how rows lie in partitions. Trees grow by rounds of a
bounded number of drawn rows. While a node holds over `rows_a_unit` rows it is
split by histograms summed over all tasks; below that its rows go to one task,
which grows the rest of the subtree in numpy. What a task holds is thus bounded,
and a level of a deep tree costs what its rows cost, not its number of nodes.

A node splits where the squared error falls most (of equal splits the first
feature's lowest) and stays a leaf where nothing is gained or the depth is
reached. Importances are the falls by feature, as shares of a tree, averaged over
the trees. A null or NaN label, a null vector and vectors of other widths are errors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.session import materialized, ship, shuffles_dropped

BINS = 32
ROWS_A_UNIT = 1 << 21
DRAWS_A_ROUND = 1 << 27
_NODES = 1 << 32  # unit = tree * _NODES + the node's place in a heap, the root at 1
_TIE = 1e-9  # shares of a fall below which splits count as equal: sums of other orders differ by rounding
_POISSON = np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1.0, *range(1, 15)])])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(hashes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often the tree draws each row."""
    start = np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1B54A32D192ED03) % (1 << 64))
    uniform = (_mix(_mix(hashes.view(np.uint64) + start)) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(_POISSON, uniform, side="right").astype(np.uint8)


class Tree(NamedTuple):
    """Nodes of a tree or subtree: feature (-1 of a leaf), last bin on the left, left child (the right one follows), mean."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def packed(self) -> list[bytes]:
        return [self.feature.astype("<i4").tobytes(), self.bin.astype("u1").tobytes(), self.left.astype("<i8").tobytes(), self.value.astype("<f8").tobytes()]

    @staticmethod
    def unpacked(parts: list[bytes]) -> Tree:
        return Tree(*[np.frombuffer(p, kind) for p, kind in zip(parts, ("<i4", "u1", "<i8", "<f8"), strict=True)])

    def predict(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows):
            rows = rows[self.feature[at[rows]] >= 0]
            node = at[rows]
            at[rows] = self.left[node] + (bins[rows, self.feature[node]] > self.bin[node])
        return self.value[at]


def _falls(n_left: np.ndarray, s_left: np.ndarray, n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Fall of the squared error for a left side of n_left rows that add up to s_left; 0 where a side is empty."""
    n_right, s_right = n - n_left, s - s_left
    fine = (n_left > 0) & (n_right > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        fall = s_left * s_left / n_left + s_right * s_right / n_right - s * s / n
    return np.where(fine, fall, 0.0)


def _dense(key: np.ndarray, w: np.ndarray, wy: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best fall and bin of every node, from histograms over all its bins; key is node * BINS + bin."""
    size = len(n) * BINS
    n_left = np.cumsum(np.bincount(key, w, size).reshape(-1, BINS), axis=1)[:, :-1]
    s_left = np.cumsum(np.bincount(key, wy, size).reshape(-1, BINS), axis=1)[:, :-1]
    fall = _falls(n_left, s_left, n[:, None], s[:, None])
    top = fall.max(axis=1)
    return top, (fall >= top[:, None] * (1 - _TIE)).argmax(axis=1)


def _sparse(key: np.ndarray, w: np.ndarray, wy: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from the bins that hold rows, for many small nodes."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
    node = key[last] // BINS
    first = np.append(True, node[1:] != node[:-1])
    before = np.flatnonzero(first)

    def within(values: np.ndarray) -> np.ndarray:
        ends = np.cumsum(values[order])[last]
        start = np.append(0.0, ends)[before]
        return ends - np.repeat(start, np.diff(np.append(before, len(node))))

    fall = _falls(within(w), within(wy), n[node], s[node])
    fall[np.append(first[1:], True)] = 0.0  # a node's last bin leaves nothing on the right
    top = np.maximum.reduceat(fall, before)
    hit = np.flatnonzero(fall >= np.repeat(top, np.diff(np.append(before, len(node)))) * (1 - _TIE))
    _, one = np.unique(node[hit], return_index=True)
    return top, key[last[hit[one]]] % BINS


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int) -> tuple[Tree, np.ndarray]:
    """The tree over binned rows with labels and weights, and the fall of the squared error by feature."""
    width = bins.shape[1]
    falls = np.zeros(width)
    w = w.astype(np.float64)
    shift = np.average(y, weights=w)  # sums around the mean keep their digits
    columns, wy = np.ascontiguousarray(bins.T), w * (y - shift)
    wyy = wy * (y - shift)
    node, count, base, level = np.zeros(len(y), np.int64), 1, 0, 0
    parts: list[tuple[np.ndarray, ...]] = []
    while True:
        n, s, q = (np.bincount(node, v, count) for v in (w, wy, wyy))
        best, feature, at = np.zeros(count), np.full(count, -1), np.zeros(count, np.int64)
        if level < depth:
            best = np.maximum(1e-12 * q, 1e-300)  # rounding of the sums
            search = _dense if count * BINS <= 4 * len(node) else _sparse
            for f in range(width):
                fall, found = search(node * BINS + columns[f], w, wy, n, s)
                better = fall > best * (1 + _TIE)
                best[better], feature[better], at[better] = fall[better], f, found[better]
        inner = feature >= 0
        np.add.at(falls, feature[inner], best[inner])
        children = base + count + 2 * (np.cumsum(inner) - 1)
        parts.append((feature, at, np.where(inner, children, -1), s / n + shift))
        if not inner.any():
            return Tree(*[np.concatenate(p) for p in zip(*parts)]), falls
        stay = np.flatnonzero(inner[node])
        columns, w, wy, wyy, node = columns[:, stay], w[stay], wy[stay], wyy[stay], node[stay]
        right = columns[feature[node], np.arange(len(node))] > at[node]
        node = (children[node] - base - count) + right
        base, count, level = base + count, 2 * int(inner.sum()), level + 1


class _Rows(NamedTuple):
    """Rows of a stored block: a hash or a number each, labels, bins."""

    name: np.ndarray
    y: np.ndarray
    bins: np.ndarray


def _blocks(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[_Rows]:
    for batch in batches:
        for name, y, bins in zip(*[batch.column(i) for i in range(3)]):
            yield _Rows(
                np.frombuffer(name.as_buffer(), "<i8"), np.frombuffer(y.as_buffer(), "<f8"),
                np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, width),
            )


def _values(column: pa.Array, width: int) -> np.ndarray:
    """The rows of an array column as a matrix."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    if column.null_count or flat.null_count or (lengths != width).any():
        raise ValueError(f"a vector has not {width} values")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def thresholds(df: DataFrame, vec: str, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Per feature the thresholds between its bins, from all rows."""
    some = [F.percentile_approx(F.col(vec)[f].cast("double"), [k / bins for k in range(1, bins)], 10000).alias(f"q{f}") for f in range(width)]
    levels = [np.unique(q) if q else np.zeros(0) for q in df.agg(*some).first()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0)] * width
        following = [np.full(len(q), np.inf) for q in levels]
        for batch in batches:
            if not batch.num_rows:
                continue
            for f, column in enumerate(_values(batch.column(0), width).T):
                found = np.unique(column)
                seen[f] = np.union1d(seen[f], found)[: bins + 1]
                after = np.append(found, np.inf)[np.searchsorted(found, levels[f], side="right")]
                following[f] = np.minimum(following[f], after)
        lists = [pa.array(x, pa.list_(pa.float64())) for x in (seen, following)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), *lists], ["f", "seen", "following"])

    seen, following = [np.zeros(0)] * width, [np.full(len(q), np.inf) for q in levels]
    kind = "f int, seen array<double>, following array<double>"
    for row in df.select(F.col(vec).cast("array<double>")).mapInArrow(run, kind).collect():  # width rows of each task
        seen[row.f] = np.union1d(seen[row.f], row.seen)[: bins + 1]
        following[row.f] = np.minimum(following[row.f], row.following)
    out = []
    for values, level, after in zip(seen, levels, following):
        if len(values) <= bins:
            level, after = values[:-1], values[1:]
        some = np.isfinite(after)
        out.append(np.unique((level[some] + after[some]) / 2))
    return out


def _binned(df: DataFrame, name: str, label: str | None, vec: str, edges: list[np.ndarray]) -> DataFrame:
    """(name, y, bins) blocks of rows as bytes; a written table."""
    width = len(edges)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _values(batch.column(2), width)
            if batch.column(1).null_count or np.isnan(y := batch.column(1).to_numpy()).any():
                raise ValueError("a label is null or NaN")
            bins = np.stack([np.searchsorted(edges[f], values[:, f], side="left") for f in range(width)], axis=1).astype(np.uint8)
            parts = [batch.column(0).to_numpy().astype("<i8"), y.astype("<f8"), bins]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["name", "y", "bins"])

    labels = F.lit(0.0) if label is None else F.col(label).cast("double")
    rows = df.select(F.col(name).cast("long"), labels.alias("_y"), F.col(vec).cast("array<double>"))
    return materialized(rows.mapInArrow(run, "name binary, y binary, bins binary"), "binned")


def _routed(bins: np.ndarray, splits: list[tuple[int, int, int]]) -> np.ndarray:
    """Heap place of every row below the top splits (node, feature, bin) of a tree, parents first."""
    at = np.ones(len(bins), np.int64)
    for node, f, b in splits:
        rows = at == node
        at[rows] = 2 * node + (bins[rows, f] > b)
    return at


def _open(blocks: DataFrame, trees: range, tops: dict, wanted: set, width: int, seed: int) -> list:
    """(unit, rows, sum, squares, fall, feature, bin) of the wanted units, from histograms summed over all tasks."""
    shape = (3, width, BINS)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for rows in _blocks(batches, width):
            for tree in trees:
                w, at = drawn(rows.name, tree, seed).astype(np.float64), _routed(rows.bins, tops.get(tree, []))
                for node in np.unique(at[w > 0]).tolist():
                    if (unit := tree * _NODES + node) not in wanted:
                        continue
                    here = np.flatnonzero((at == node) & (w > 0))
                    out = sums.setdefault(unit, np.zeros(shape))
                    for f in range(width):
                        for k, v in enumerate((w, w * rows.y, w * rows.y * rows.y)):
                            out[k, f] += np.bincount(rows.bins[here, f], v[here], BINS)
        if sums:
            arrays = [pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["unit", "sums"])

    def best(table: pa.Table) -> pa.Table:
        n, s, q = sum(np.frombuffer(x.as_buffer(), np.float64).reshape(shape) for x in table.column("sums"))
        total, added, squares = n[0].sum(), s[0].sum(), q[0].sum()
        mean = added / total
        fall = _falls(np.cumsum(n, 1)[:, :-1], np.cumsum(s - mean * n, 1)[:, :-1], total, added - mean * total)
        f, b = np.unravel_index((fall >= fall.max() * (1 - _TIE)).argmax(), fall.shape)
        row = (table.column("unit")[0].as_py(), float(total), float(added), float(squares), float(fall[f, b]), int(f), int(b))
        return pa.table({c: [v] for c, v in zip(("unit", "n", "s", "q", "fall", "feature", "bin"), row)})

    kind = "unit long, n double, s double, q double, fall double, feature long, bin long"
    return blocks.mapInArrow(count, "unit long, sums binary").groupBy("unit").applyInArrow(best, kind).collect()


def _sent(blocks: DataFrame, trees: range, tops: dict, leaves: set, width: int, seed: int | None, parts: int = 1) -> DataFrame:
    """(unit, part, name, y, w, bins): the rows of every block by unit; drawn ones, or with seed None all of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, width):
            out: list[tuple] = []
            for tree in trees:
                w = np.ones(len(rows.y), np.uint8) if seed is None else drawn(rows.name, tree, seed)
                at = _routed(rows.bins, tops.get(tree, []))
                for node in np.unique(at).tolist():
                    here = np.flatnonzero((at == node) & (w > 0))
                    if len(here) and (seed is None or tree * _NODES + node not in leaves):
                        name = rows.name[here].tobytes() if seed is None else b""
                        y = b"" if seed is None else rows.y[here].tobytes()
                        part = int(rows.name[0]) % parts
                        out.append((tree * _NODES + node, part, name, y, w[here].tobytes(), rows.bins[here].tobytes()))
            kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], ["unit", "part", "name", "y", "w", "bins"])

    return blocks.mapInArrow(run, "unit long, part long, name binary, y binary, w binary, bins binary")


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column]) if len(column) else np.zeros(0, kind)


_UNIT = "unit long, feature binary, bin binary, left binary, value binary, falls array<double>"


def _unit_row(unit: int, tree: Tree, falls: np.ndarray) -> tuple:
    return unit, *tree.packed(), [float(x) for x in falls]


class ForestModel(NamedTuple):
    """Subtrees as a table, what stands above them, and the features' importances."""

    units: DataFrame
    tops: dict[int, list[tuple[int, int, int]]]
    edges: list[np.ndarray]
    importances: np.ndarray
    trees: int
    vec: str
    settings: tuple[int, int]

    @property
    def featureImportances(self):  # noqa: N802 - the name of Spark ML's models
        return Vectors.dense(self.importances)

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """The rows with the mean of the trees' predictions; they are stored under a number on the way."""
        ship(df.sparkSession)
        width, (rows_a_unit, draws) = len(self.edges), self.settings
        rows = materialized(df.withColumn("_row", F.monotonically_increasing_id()), "to-predict")
        blocks = _binned(rows, "_row", None, self.vec, self.edges)
        n = rows.count()
        parts, tops = max(1, -(-n // rows_a_unit)), self.tops

        def run(sent: pa.Table, unit: pa.Table) -> pa.Table:
            names, found = [np.zeros(0, "<i8")], [np.zeros(0)]
            if unit.num_rows:  # else the tree drew no rows
                tree = Tree.unpacked([unit.column(c)[0].as_py() for c in ("feature", "bin", "left", "value")])
            for name, bins in zip(sent.column("name"), sent.column("bins")) if unit.num_rows else ():
                names.append(np.frombuffer(name.as_buffer(), "<i8"))
                found.append(tree.predict(np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, width)))
            return pa.table({"_row": np.concatenate(names), "_value": np.concatenate(found)})

        summed = None
        for trees in _rounds(self.trees, n, draws):
            sent = _sent(blocks, trees, {t: tops[t] for t in trees if t in tops}, set(), width, None, parts)
            of_round = self.units.where(F.col("unit").between(trees[0] * _NODES, (trees[-1] + 1) * _NODES - 1))
            units = of_round.drop("falls").withColumn("part", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")))
            met = sent.groupBy("unit", "part").cogroup(units.groupBy("unit", "part")).applyInArrow(run, "_row long, _value double")
            with shuffles_dropped(df.sparkSession):
                one = materialized(met.groupBy("_row").agg(F.sum("_value").alias("_value"), F.count("_value").alias("_n")), "predicted")
            summed = one if summed is None else summed.unionByName(one)
        mean = summed.groupBy("_row").agg((F.sum("_value") / F.sum("_n")).alias(out))
        return rows.join(mean, "_row").drop("_row")


def _rounds(trees: int, rows: int, draws: int) -> list[range]:
    """The trees by rounds of about so many draws, a tree at least."""
    step = max(1, min(trees, draws // max(rows, 1)))
    return [range(i, min(trees, i + step)) for i in range(0, trees, step)]


class Forest(NamedTuple):
    """Settings of a forest; `fit` and `transform` of its model stand for those of a Spark ML estimator."""

    label: str = "runs"
    trees: int = 100
    depth: int = 30
    seed: int = 42
    vec: str = "vec"
    rows_a_unit: int = ROWS_A_UNIT
    draws_a_round: int = DRAWS_A_ROUND

    def fit(self, df: DataFrame) -> ForestModel:
        first = df.select(F.size(self.vec)).first()
        if first is None:
            raise ValueError("no rows to fit")
        ship(df.sparkSession)
        width = first[0]
        plain = [c for c, kind in df.dtypes if c == self.vec or kind != "vector"]
        rows = df.select(F.xxhash64(*plain).alias("_row"), self.label, self.vec)
        edges = thresholds(rows, self.vec, width)
        blocks = _binned(rows, "_row", self.label, self.vec, edges)
        n = rows.count()
        tops, units, falls = {}, None, np.zeros((self.trees, width))
        for trees in _rounds(self.trees, n, self.draws_a_round):
            top, leaves = self._top(blocks, trees, n, width, falls)
            tops |= top
            one = self._subtrees(blocks, trees, top, leaves, width)
            units = one if units is None else units.unionByName(one)
        for row in units.select("unit", "falls").collect():  # numbers of each subtree, not its nodes
            falls[row.unit // _NODES] += row.falls
        total = falls.sum(axis=1, keepdims=True)
        shares = np.divide(falls, total, out=np.zeros_like(falls), where=total > 0).sum(axis=0)
        importances = shares / shares.sum() if shares.sum() > 0 else shares
        return ForestModel(units, tops, edges, importances, self.trees, self.vec, (self.rows_a_unit, self.draws_a_round))

    def _top(self, blocks: DataFrame, trees: range, n: int, width: int, falls: np.ndarray) -> tuple[dict, dict[int, float]]:
        """Splits above the units, parents first, and the means of large nodes that stay leaves."""
        tops: dict[int, list[tuple[int, int, int]]] = {}
        leaves: dict[int, float] = {}
        wanted = {t * _NODES + 1 for t in trees} if n > self.rows_a_unit else set()
        while wanted:
            found, wanted = _open(blocks, range(trees[0], trees[-1] + 1), tops, wanted, width, self.seed), set()
            for row in found:
                tree, node = divmod(row.unit, _NODES)
                if row.n <= self.rows_a_unit:
                    continue
                squares = row.q - row.s * row.s / row.n
                if row.fall <= 1e-12 * squares or row.fall <= 0 or node.bit_length() > self.depth:
                    leaves[row.unit] = row.s / row.n
                    continue
                if 2 * node + 1 >= _NODES:  # the heap has no name for its children
                    continue
                tops.setdefault(tree, []).append((node, row.feature, row.bin))
                falls[tree, row.feature] += row.fall
                wanted |= {tree * _NODES + 2 * node, tree * _NODES + 2 * node + 1}
        return tops, leaves

    def _subtrees(self, blocks: DataFrame, trees: range, tops: dict, leaves: dict[int, float], width: int) -> DataFrame:
        """The rest of every tree of a round, one row for each unit; a written table."""
        depth, spark = self.depth, blocks.sparkSession
        kind = pa.schema([("unit", pa.int64()), *[(c, pa.binary()) for c in ("feature", "bin", "left", "value")], ("falls", pa.list_(pa.float64()))])

        def run(table: pa.Table) -> pa.Table:
            unit = table.column("unit")[0].as_py()
            level = (unit % _NODES).bit_length() - 1
            bins = _joined(table.column("bins"), "u1").reshape(-1, width)
            tree, falls = grow(bins, _joined(table.column("y"), "<f8"), _joined(table.column("w"), "u1"), depth - level)
            return pa.table([[v] for v in _unit_row(unit, tree, falls)], schema=kind)

        sent = _sent(blocks, trees, tops, set(leaves), width, self.seed)
        # A task for every unit or core: subtrees are the work, their rows are small.
        tasks = max(len(trees), spark.sparkContext.defaultParallelism)
        grown = sent.repartition(tasks, "unit").groupBy("unit").applyInArrow(run, _UNIT)
        with shuffles_dropped(spark):
            grown = materialized(grown, "trees")
        if not leaves:
            return grown
        none = np.zeros(width)
        large = [_unit_row(u, Tree(np.array([-1]), np.array([0]), np.array([-1]), np.array([v])), none) for u, v in leaves.items()]
        return grown.unionByName(spark.createDataFrame(large, _UNIT))
