"""Gradient boosted trees for a PD that moves with some features in one direction only.

Features are cut once at their exact quantiles. Each level of a tree is one pass: tasks add up gradients by (node,
feature, bin) and the driver, which sees those cells alone, picks the splits. Gradients are added as integers, so the
trees do not depend on how rows are partitioned. A split on a constrained feature needs values in its direction, and hands the
middle of both down as a bound on its children; a node's value never leaves its bounds, so every tree, and their sum, is
monotone over the whole range of the feature whatever the others are.

Nulls and NaN lie below all numbers. Constraints do not hold between a missing value and a number.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import ranks as r
from quillon.operators.risk import unpivot
from quillon.sources.storage import written

#: Gradients are added up in units of 2**-32.
UNIT = 2.0**32


@dataclass
class Tree:
    """Nodes by number: children of i are 2 i + 1 and 2 i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins (rows, features) comes to."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            at = np.where(inner, 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > self.cut[at]), at)


@dataclass
class Boosted:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bins of values (rows, features): 0 is missing, then intervals (a, b]."""
        out = np.zeros(x.shape, np.int64)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(e, x[:, j], "left"))
        return out

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return self.base + sum((t.value[t.leaves(bins)] for t in self.trees), np.zeros(len(bins)))


def _values(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """The first n columns as doubles, NaN where null."""
    return np.stack([batch.column(j).to_numpy(zero_copy_only=False).astype(np.float64) for j in range(n)], axis=1) if n else np.zeros((batch.num_rows, 0))


def quantile_bins(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper edges of each feature's quantile bins but the last; at most features * bins numbers."""
    counts = r.value_counts(unpivot(df, features, []), "x", ["feature"])
    found = {row.feature: row.edges for row in r.quantile_edges(counts, r.steps(bins), ["feature"]).collect()}
    return [np.array((found.get(f) or [])[:-1], np.float64) for f in features]


def _level(data: DataFrame, model: Boosted, tree: Tree, nodes: Sequence[int], bins: int) -> np.ndarray:
    """(node, feature, bin, 3): sums of gradients, of second derivatives and of rows at the given nodes, one pass."""
    d, place = len(model.features), {n: i for i, n in enumerate(nodes)}
    size = len(nodes) * d * bins

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, 3), np.int64)
        where = np.full(len(tree.feature), -1)
        where[list(place)] = list(place.values())
        for batch in batches:
            b = model.bins(_values(batch, d))
            y = batch.column(d).to_numpy(zero_copy_only=False).astype(np.float64)
            p = 1 / (1 + np.exp(-model.margin(b)))
            grad, curve = np.rint((p - y) * UNIT).astype(np.int64), np.rint(p * (1 - p) * UNIT).astype(np.int64)
            node = where[tree.leaves(b)]
            kept = node >= 0
            for j in range(d):
                cell = (node[kept] * d + j) * bins + b[kept, j]
                for k, v in enumerate((grad[kept], curve[kept], np.ones(int(kept.sum()), np.int64))):
                    np.add.at(total[:, k], cell, v)
        used = np.flatnonzero(total[:, 2])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(total[used, k], pa.int64()) for k in range(3))], ["cell", "g", "h", "n"])

    out = np.zeros((size, 3))
    for row in data.mapInArrow(add, "cell long, g long, h long, n long").groupBy("cell").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("g", "h", "n")]).collect():
        out[row.cell] = float(row.g) / UNIT, float(row.h) / UNIT, float(row.n)
    return out.reshape(len(nodes), d, bins, 3)


def _split(cells: np.ndarray, low: float, high: float, signs: np.ndarray, l2: float, least: int):
    """(gain, feature, last bin on the left, left value, right value) of the best split of a node within its bounds, or None."""
    left = np.cumsum(cells, axis=1)[:, :-1]
    whole = cells.sum(axis=1, keepdims=True)
    right = whole - left
    value = lambda c: np.clip(-c[..., 0] / (c[..., 1] + l2), low, high)
    worth = lambda c, v: -(c[..., 0] * v + 0.5 * (c[..., 1] + l2) * v * v)
    lv, rv = value(left), value(right)
    gain = worth(left, lv) + worth(right, rv) - worth(whole, value(whole))
    fine = (left[..., 2] >= least) & (right[..., 2] >= least) & (signs[:, None] * (rv - lv) >= 0)
    gain = np.where(fine, gain, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[f, b]), int(f), int(b), float(lv[f, b]), float(rv[f, b])) if gain[f, b] > 1e-9 else None


def fit(df: DataFrame, features: Sequence[str], label: str, constraints: Mapping[str, int], *, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 20, l2: float = 1.0) -> Boosted:
    """Boosted trees for label 0 or 1; constraints: feature to 1 (up) or -1 (down). Rows without a label are left out."""
    features = list(features)
    columns = [F.col(f).cast("double").alias(f"_x{j}") for j, f in enumerate(features)]
    known = df.where(F.col(label).isNotNull())
    edges = quantile_bins(known, features, bins)
    data = written(known.select(*columns, F.col(label).cast("double").alias("_y")), "boosting")
    n, good = data.agg(F.count("*"), F.sum("_y")).first()
    share = ((good or 0.0) + 0.5) / (n + 1.0)
    model = Boosted(features, edges, float(np.log(share / (1 - share))))
    signs = np.array([constraints.get(f, 0) for f in features])
    width = bins + 2  # missing, and one more interval than edges
    for _ in range(trees if n else 0):
        size = 2 ** (depth + 1) - 1
        tree = Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))
        bounds, nodes = {0: (-np.inf, np.inf)}, [0]
        for _level_of in range(depth):
            cells = _level(data, model, tree, nodes, width)
            after = []
            for i, node in enumerate(nodes):
                low, high = bounds[node]
                if node == 0:
                    g, h, _ = cells[i, 0].sum(axis=0)
                    tree.value[0] = rate * float(np.clip(-g / (h + l2), low, high))
                found = _split(cells[i], low, high, signs, l2, least)
                if found is None:
                    continue
                _, f, cut, lv, rv = found
                tree.feature[node], tree.cut[node] = f, cut
                left, right, middle = 2 * node + 1, 2 * node + 2, (lv + rv) / 2
                tree.value[left], tree.value[right] = rate * lv, rate * rv
                bounds[left] = (low, middle) if signs[f] > 0 else (middle, high) if signs[f] < 0 else (low, high)
                bounds[right] = (middle, high) if signs[f] > 0 else (low, middle) if signs[f] < 0 else (low, high)
                after += [left, right]
            nodes = after
            if not nodes:
                break
        model.trees.append(tree)
        if tree.feature[0] < 0:
            break
    return model


def score(model: Boosted, df: DataFrame, key: str, out: str = "score") -> DataFrame:
    """(key, out): the PD of every row."""
    n = len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(n), pa.array(1 / (1 + np.exp(-model.margin(model.bins(_values(batch, n))))), pa.float64())], [key, out])

    d = df.select(*[F.col(f).cast("double").alias(f"_x{j}") for j, f in enumerate(model.features)], key)
    return d.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{out}` double")
