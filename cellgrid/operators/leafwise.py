"""Boosted regression trees grown leaf by leaf over gradient histograms, with the cell as a category.

Rows are binned once and stay where they are. Each step of a tree is one aggregate: every task adds up gradients and counts
per (horizon, node, feature, bin), Spark adds the tasks' sums, and what reaches the driver is bounded by leaves times bins and
categories, whatever the number of rows. Trees of all horizons grow side by side in the same aggregates, each horizon at its own
pace; a task is sent the trees it needs and no others.

A tree takes the split of greatest gain among its leaves until it has ``leaves`` of them. To take several splits from one
aggregate, children of all leaves that would be split as far as is known are looked at together; the order of the splits, and so the
tree, is that of one at a time.

Gradients are whole multiples of 2**-24, so that sums are exact and no tree depends on how rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.fixed import HORIZONS, LEARNING_RATE, LEAVES, MIN_LEAF_ROWS, TREES
from ..functions.scalars import log_scale
from ..session import materialise
from .features import FeatureNames

UNIT = float(1 << 24)
BINS = 255  # bins of a numeric input, at most
REFRESH = 10  # trees between two writes of the predictions so far
ROWS_A_TASK = 50_000  # a table of no more rows is one task's
MAX_CATEGORIES = 100_000
# Smoothing, penalty and breadth of splits by category.
CATEGORY_SMOOTHING, CATEGORY_PENALTY, CATEGORY_BREADTH = 10.0, 10.0, 32


@dataclass
class Split:
    """Rows of ``node`` with bin <= ``bin``, or with a category in ``left``, go to node ``low``, others to ``high``."""

    node: int
    feature: int
    bin: int
    left: np.ndarray | None
    gain: float
    low: int = -1
    high: int = -1

    def goes_low(self, bins: np.ndarray, category: np.ndarray) -> np.ndarray:
        return bins[:, self.feature] <= self.bin if self.left is None else self.left[category]


@dataclass
class Growing:
    """What is known of a tree: sums of its nodes, their best splits once looked at, and the splits tried."""

    sums: dict[int, tuple[float, int, float]] = field(default_factory=dict)  # node -> gradient, rows, penalty
    best: dict[int, Split | None] = field(default_factory=dict)
    tried: list[Split] = field(default_factory=list)

    def chosen(self, leaves: int) -> list[Split]:
        """The splits in the order they are taken, as far as their gains are known."""
        open_nodes, out = [0], []
        while len(out) < leaves - 1:
            known = [self.best[n] for n in open_nodes if self.best.get(n) is not None]
            if not known:
                break
            s = max(known, key=lambda s: (s.gain, -s.node))
            open_nodes.remove(s.node)
            out.append(s)
            open_nodes += [n for n in (s.low, s.high) if n >= 0]
        return out

    def expand(self, leaves: int, least: int) -> list[int]:
        """Nodes to look at next: the children of the splits that would be taken, where not yet known."""
        if not self.best:
            return [0]
        fresh: list[int] = []
        for s in self.chosen(leaves):
            if s.low < 0:
                s.low, s.high = 2 * len(self.tried) + 1, 2 * len(self.tried) + 2
                self.tried.append(s)
                fresh += [s.low, s.high]
        return fresh


@dataclass
class HorizonTrees:
    """``start`` and per tree its splits and leaf values; ``inputs`` are the numeric inputs, the category comes after them."""

    horizon: int
    inputs: list[str]
    category: str
    edges: list[np.ndarray]
    categories: np.ndarray
    start: float = 0.0
    trees: list[tuple[list[Split], dict[int, float]]] = field(default_factory=list)

    def importances(self) -> list[tuple[str, int]]:
        """Number of splits by each input."""
        names = [*self.inputs, self.category]
        counts = np.bincount([s.feature for splits, _ in self.trees for s in splits], minlength=len(names))
        return [(n, int(c)) for n, c in zip(names, counts)]

    def raw(self, bins: np.ndarray, category: np.ndarray) -> np.ndarray:
        return add_trees(np.full(len(bins), self.start), self.trees, bins, category)


def route(splits: list[Split], bins: np.ndarray, category: np.ndarray) -> np.ndarray:
    node = np.zeros(len(bins), dtype=np.int32)
    for s in splits:  # parents come before their children
        here = np.flatnonzero(node == s.node)
        low = s.goes_low(bins[here], category[here])
        node[here] = np.where(low, s.low, s.high)
    return node


def add_trees(total: np.ndarray, trees, bins: np.ndarray, category: np.ndarray) -> np.ndarray:
    for splits, values in trees:
        table = np.zeros(max(values) + 1)
        table[list(values)] = list(values.values())
        total = total + table[route(splits, bins, category)]
    return total


def gradients(y: np.ndarray, predicted: np.ndarray) -> np.ndarray:
    """Predicted less true, in units; both sides are rounded alike in every task."""
    return np.rint((predicted - y / UNIT) * UNIT).astype(np.int64)


def best_split(node: int, histograms: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], category: int, size: int, least: int) -> Split | None:
    """The split of greatest gain of a node, or none; ``histograms``: feature -> present bins, gradients, rows. Ties: first feature, then first place."""
    found: Split | None = None
    for feature in sorted(histograms):
        bins, g, n = histograms[feature]
        by_category = feature == category
        penalty = CATEGORY_PENALTY if by_category else 0.0
        order = np.lexsort((bins, g / UNIT / (n + CATEGORY_SMOOTHING))) if by_category else np.argsort(bins)
        low_g, low_n = np.cumsum(g[order]), np.cumsum(n[order])
        all_g, all_n = low_g[-1] / UNIT, int(low_n[-1])
        low_g, high_g, high_n = low_g / UNIT, (low_g[-1] - low_g) / UNIT, all_n - low_n
        place = np.arange(1, len(order) + 1)
        allowed = (low_n >= least) & (high_n >= max(least, 1))
        if by_category:
            allowed &= (place <= CATEGORY_BREADTH) | (len(order) - place <= CATEGORY_BREADTH)
        if not allowed.any():
            continue
        gain = low_g**2 / (low_n + penalty) + high_g**2 / np.maximum(high_n + penalty, 1) - all_g**2 / all_n
        at = int(np.where(allowed, gain, -np.inf).argmax())
        if gain[at] > 1e-9 and (found is None or gain[at] > found.gain):
            left = None
            if by_category:
                left = np.zeros(size, dtype=bool)
                left[bins[order[: at + 1]]] = True
            found = Split(node, feature, int(bins[order[at]]), left, float(gain[at]))
    return found


def _edges(train: DataFrame, inputs: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper ends of the bins: distinct values at equal ranks (sketched), the greatest left out."""
    steps = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = train.agg(*[F.percentile_approx(F.col(c).cast("double"), steps, F.lit(10_000)).alias(c) for c in inputs]).first()
    return [np.unique(np.array(row[c] or [], dtype=np.float64)) for c in inputs]


def _encode(batch: pa.RecordBatch, inputs: Sequence[str], category: str, edges, categories) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the inputs (missing: the last) and the number of the category (unknown: one past the last)."""
    bins = np.zeros((batch.num_rows, len(inputs)), dtype=np.int16)
    for i, c in enumerate(inputs):
        x = batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
        bins[:, i] = np.searchsorted(edges[i], x, side="left")
    cells = np.asarray(batch.column(category).to_pylist(), dtype=object)
    place = {c: i for i, c in enumerate(categories)}
    return bins, np.array([place.get(c, len(categories)) for c in cells], dtype=np.int32)


def _binned(train: DataFrame, inputs, category, edges, categories, horizons) -> DataFrame:
    """Stage table ``bins, cat, y, p``: bins, number of the category, and per horizon the target in units and the prediction so far."""
    units = [F.round(log_scale(f"target_{h}h") * UNIT).cast("long") for h in horizons]
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in inputs], F.col(category), F.array(*units).alias("y"))

    def encode(batches):
        for batch in batches:
            bins, cat = _encode(batch, inputs, category, edges, categories)
            yield pa.RecordBatch.from_arrays([_lists(bins, pa.int16()), pa.array(cat), batch.column("y")], names=["bins", "cat", "y"])

    made = rows.mapInArrow(encode, "bins array<smallint>, cat int, y array<long>")
    return materialise(made.withColumn("p", F.array(*[F.lit(0.0)] * len(horizons))), "binned")


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).reshape(-1), type=kind))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _histograms(rows: DataFrame, width: int, number: int, usable, recent, growing, looked_at) -> dict:
    """(model, node) -> feature -> (bins, gradients, rows) for ``number`` models; one aggregate over all rows."""

    def add(batches):
        sums: dict[tuple[int, int, int], list[np.ndarray]] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            bins, cat = _matrix(batch.column("bins"), width), batch.column("cat").to_numpy()
            y, p = _matrix(batch.column("y"), number), _matrix(batch.column("p"), number)
            for m, nodes in looked_at.items():
                g = gradients(y[:, m], add_trees(p[:, m], recent[m], bins, cat))
                at = route(growing[m], bins, cat)
                for node in nodes:
                    here = np.flatnonzero(at == node)
                    if not len(here):
                        continue
                    for f in usable[m]:
                        x = cat[here] if f == width else bins[here, f]
                        size = int(x.max()) + 1
                        # Two halves of each gradient, since sums of weights are in double precision.
                        high, low = g[here] >> 20, g[here] & ((1 << 20) - 1)
                        total = (np.bincount(x, high, size).astype(np.int64) << 20) + np.bincount(x, low, size).astype(np.int64)
                        old = sums.setdefault((m, node, f), [np.zeros(0, np.int64), np.zeros(0, np.int64)])
                        for i, new in enumerate((total, np.bincount(x, minlength=size))):
                            grown = np.zeros(max(len(old[i]), size), np.int64)
                            grown[: len(old[i])] = old[i]
                            grown[:size] += new
                            old[i] = grown
        keys, place, g, n = [], [], [], []
        for key, (total, count) in sums.items():
            present = np.flatnonzero(count)
            keys.append(np.tile(np.array(key, dtype=np.int32), (len(present), 1)))
            place.append(present)
            g.append(total[present])
            n.append(count[present])
        keys = np.concatenate(keys) if keys else np.zeros((0, 3), np.int32)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(keys[:, i], pa.int32()) for i in range(3)], pa.array(join(place), pa.int32()), pa.array(join(g), pa.int64()), pa.array(join(n), pa.int64())],
            names=["model", "node", "feature", "bin", "g", "n"],
        )

    partial = rows.mapInArrow(add, "model int, node int, feature int, bin int, g long, n long")
    whole = partial.groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow()
    keys = np.stack([whole.column(c).to_numpy() for c in ("model", "node", "feature")], axis=1) if whole.num_rows else np.zeros((0, 3), int)
    values = [whole.column(c).to_numpy() for c in ("bin", "g", "n")]
    found: dict = {}
    if len(keys):
        order = np.lexsort((values[0], *keys.T[::-1]))
        keys, values = keys[order], [v[order] for v in values]
        starts = np.flatnonzero(np.r_[True, (np.diff(keys, axis=0) != 0).any(axis=1)])
        for a, b in zip(starts, np.r_[starts[1:], len(keys)]):
            m, node, f = map(int, keys[a])
            found.setdefault((m, node), {})[f] = tuple(v[a:b] for v in values)
    return found


def fit_leafwise(
    train: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    *,
    names: FeatureNames = FeatureNames(),
    inputs: Sequence[str] | None = None,
    cell_col: str = "CellID",
    trees: int = TREES,
    leaves: int = LEAVES,
    step_size: float = LEARNING_RATE,
    min_leaf_rows: int = MIN_LEAF_ROWS,
    bins: int = BINS,
    max_categories: int = MAX_CATEGORIES,
) -> dict[int, HorizonTrees]:
    """One model per horizon for the log of its target, by squared error.

    Inputs are the features, the cell's training mean and the horizon's own seasonal value (or ``inputs`` alone), and ``cell_col`` as a category.
    A numeric input is cut at up to ``bins`` values of equal rank. Categories of a node are ordered by gradient over rows (plus a smoothing
    constant); a prefix of that order goes left. Rows with a missing target are left out; a table without rows gives models that
    predict 0. More than ``max_categories`` cells are refused, as their sums come to the driver.
    """
    shared = list(inputs) if inputs is not None else [*names.features, "cell_historical_mean"]
    own = [] if inputs is not None else [f"naive_feature_{h}h" for h in horizons]
    numeric = shared + own
    train = train.dropna(subset=[f"target_{h}h" for h in horizons])
    cells = train.select(cell_col).distinct().orderBy(cell_col).limit(max_categories + 1).toPandas()[cell_col].tolist()
    if len(cells) > max_categories:
        raise ValueError(f"more than {max_categories} different {cell_col}")
    edges = _edges(train, numeric, bins)
    width, category = len(numeric), len(numeric)
    models = [HorizonTrees(h, numeric, cell_col, edges, np.array(cells, dtype=object)) for h in horizons]
    usable = [[*range(len(shared)), *([len(shared) + i] if own else []), category] for i in range(len(horizons))]
    rows = _binned(train, numeric, cell_col, edges, cells, horizons)
    means = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("y")[i]).alias(f"s{i}") for i in range(len(horizons))]).first()
    if not means.n:
        return {m.horizon: m for m in models}
    for i, m in enumerate(models):
        m.start = means[f"s{i}"] / means.n / UNIT
    written = [0] * len(models)  # trees whose predictions the stage table holds
    rows = _dealt(materialise(rows.withColumn("p", F.array(*[F.lit(m.start) for m in models])), "predicted"), means.n)
    growing = {m: Growing() for m in range(len(models))} if trees > 0 else {}
    while True:
        looked_at = {}
        for m in sorted(growing):
            if not (nodes := growing[m].expand(leaves, min_leaf_rows)):
                if not _finished(growing[m], models[m], leaves, step_size) or len(models[m].trees) == trees:
                    del growing[m]
                    continue
                growing[m] = Growing()
                nodes = growing[m].expand(leaves, min_leaf_rows)
            looked_at[m] = nodes
        if not looked_at:
            return {m.horizon: m for m in models}
        if max(len(models[m].trees) - written[m] for m in looked_at) >= REFRESH:
            rows = _dealt(_refreshed(rows, width, [m.trees[w:] for m, w in zip(models, written)]), means.n)
            written = [len(m.trees) for m in models]
        recent = {m: models[m].trees[written[m] :] for m in looked_at}
        tried = {m: growing[m].tried for m in looked_at}
        found = _histograms(rows, width, len(models), usable, recent, tried, looked_at)
        for m, nodes in looked_at.items():
            parents = {c: s for s in growing[m].tried for c in (s.low, s.high)}
            for node in nodes:
                histograms = found[m, node]
                _, g, n = histograms[category]
                by_category = node in parents and parents[node].left is not None
                growing[m].sums[node] = float(g.sum()) / UNIT, int(n.sum()), CATEGORY_PENALTY if by_category else 0.0
                growing[m].best[node] = best_split(node, histograms, category, len(cells) + 1, min_leaf_rows)


def _finished(tree: Growing, model: HorizonTrees, leaves: int, step_size: float) -> bool:
    """Adds the grown tree to its model; false, and nothing added, where it has no split."""
    splits = tree.chosen(leaves)
    if not splits:
        return False
    ends = {c for s in splits for c in (s.low, s.high)} - {s.node for s in splits}
    model.trees.append((splits, {e: -step_size * tree.sums[e][0] / (tree.sums[e][1] + tree.sums[e][2]) for e in sorted(ends)}))
    return True


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """A table of few rows is one task's, so that its aggregates need no shuffle; larger ones stay as they are dealt."""
    return rows.coalesce(1) if n <= ROWS_A_TASK else rows


def _refreshed(rows: DataFrame, width: int, recent: list[list]) -> DataFrame:
    """The stage table with predictions of all trees so far; ``recent``: per model the trees it lacks."""

    def add(batches):
        for batch in batches:
            bins, cat, p = _matrix(batch.column("bins"), width), batch.column("cat").to_numpy(), _matrix(batch.column("p"), len(recent))
            p = np.stack([add_trees(p[:, m], new, bins, cat) for m, new in enumerate(recent)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("cat"), batch.column("y"), _lists(p, pa.float64())], names=["bins", "cat", "y", "p"])

    return materialise(rows.mapInArrow(add, rows.schema), "predicted")


def predict_leafwise(test: DataFrame, models: dict[int, HorizonTrees]) -> DataFrame:
    """Adds ``prediction_{h}h`` per model, back on the activity scale and never negative. A cell without training rows goes right at splits by cell."""
    fields = [T.StructField(f"prediction_{h}h", T.DoubleType()) for h in models]
    first = next(iter(models.values()))

    def add(batches):
        for batch in batches:
            bins, cat = _encode(batch, first.inputs, first.category, first.edges, first.categories)
            columns = [pa.array(np.maximum(np.expm1(m.raw(bins, cat)), 0.0)) for m in models.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *[f.name for f in fields]])

    return test.mapInArrow(add, T.StructType(test.schema.fields + fields))
