"""Tree models of large tables: rows whose features fall into the same bins are one cell with a count per class.

Trees only ask on which side of a bin's edge a value lies, so cells lose nothing. A cell of n rows is in a bootstrap
sample as often as a Poisson draw of mean n says, the sum of its rows' draws. A level of all trees is one pass over the
cells: blocks of cells times lots of trees, whose counts per node, feature and bin are added up per tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.session import settle

#: Bins of a feature, cells of a block and trees of a lot.
BINS, BLOCK, LOT = 32, 65_536, 12


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Per feature the largest values of all bins but the last: between all values if they are few, else quantiles."""
    near = df.agg(*[F.approx_count_distinct(f).alias(f) for f in features]).first()
    edges = {}
    for f in features:
        if near[f] <= 2 * bins:
            values = sorted(r[0] for r in df.select(f).distinct().limit(bins + 1).collect())
            if len(values) <= bins:
                edges[f] = [(a + b) / 2.0 for a, b in zip(values, values[1:])]
    wide = [f for f in features if f not in edges]
    if wide:
        found = df.stat.approxQuantile(wide, [i / bins for i in range(1, bins)], 1e-4)
        edges |= {f: sorted(set(q)) for f, q in zip(wide, found)}
    return [edges[f] for f in features]


def _packed(cells: np.ndarray) -> pa.Array:
    n, d = cells.shape
    ends = np.arange(n + 1, dtype=np.int32) * np.int32(d)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(cells))])


def _unpacked(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, d)


def binned(df: DataFrame, features: Sequence[str], edges: Sequence[Sequence[float]], keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``_cell``, a byte per feature with its bin's number."""
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.empty((batch.num_rows, len(features)), np.uint8)
            for i, cuts in enumerate(edges):
                values = batch.column(len(keep) + i)
                v = values.to_numpy(zero_copy_only=False)
                if values.null_count or np.isnan(v).any():
                    raise ValueError(f"{features[i]} has rows without a value")
                cells[:, i] = np.searchsorted(cuts, v)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], _packed(cells)], names=[*keep, "_cell"])

    values = [F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)]
    return df.select(*keep, *values).mapInArrow(place, f"{kinds}_cell binary")


def counted_cells(df: DataFrame, features: Sequence[str], edges: Sequence[Sequence[float]], label: str) -> DataFrame:
    """(_cell, label, _rows): the rows of each cell and class."""
    return settle(binned(df, features, edges, [label]).groupBy("_cell", label).agg(F.count(F.lit(1)).alias("_rows")))


def bins_as_columns(cells: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` and the number of each feature's bin under the feature's name."""
    bins = [F.conv(F.hex(F.substring("_cell", i + 1, 1)), 16, 10).cast("double").alias(f) for i, f in enumerate(features)]
    return cells.select(*keep, *bins)


@dataclass
class Tree:
    """Nodes with the feature and the last bin of the left side, the left child (the right one follows it) and class weights."""

    feature: np.ndarray  # -1: a leaf
    last: np.ndarray
    child: np.ndarray
    classes: np.ndarray

    @staticmethod
    def root() -> Tree:
        return Tree(np.full(1, -1, np.int16), np.zeros(1, np.uint8), np.zeros(1, np.int32), np.zeros((1, 2)))

    def leaves(self, cells: np.ndarray) -> np.ndarray:
        """The leaf of each cell."""
        at = np.zeros(len(cells), np.int32)
        inner = np.arange(len(cells)) if self.feature[0] >= 0 else np.zeros(0, np.int64)
        while len(inner):
            node = at[inner]
            right = cells[inner, self.feature[node]] > self.last[node]
            node = self.child[node] + right
            at[inner] = node
            inner = inner[self.feature[node] >= 0]
        return at

    def pruned(self) -> Tree:
        """Two leaves of one parent that predict the same class become one, from the bottom up."""
        feature = self.feature.copy()
        says = self.classes[:, 1] > self.classes[:, 0]
        for node in np.flatnonzero(feature >= 0)[::-1]:  # children come after their parent
            left = self.child[node]
            if feature[left] < 0 and feature[left + 1] < 0 and says[left] == says[left + 1]:
                feature[node] = -1
        return Tree(feature, self.last, self.child, self.classes)


def _best_splits(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(slot, last bin, gain, classes left, classes right) per node by Gini impurity; counts: node, slot, bin, class."""
    left = np.cumsum(counts, axis=2)
    total = left[:, :, -1:, :]
    left = left[:, :, :-1, :]
    right = total - left
    valid = (left.sum(axis=3) >= 1) & (right.sum(axis=3) >= 1)

    def impurity(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = (rows * weight).sum(axis=3)
        share = (rows[..., 1] * weight[1]) / np.maximum(sums, 1e-300)
        return sums, 2.0 * share * (1.0 - share)

    (n, whole), (a, low), (b, high) = impurity(total), impurity(left), impurity(right)
    gain = np.where(valid, whole - (a * low + b * high) / np.maximum(n, 1e-300), -1.0)
    best = gain.reshape(len(gain), -1).argmax(axis=1)
    slot, last = np.divmod(best, gain.shape[2])
    at = np.arange(len(gain))
    return np.column_stack([slot, last, gain[at, slot, last], left[at, slot, last] * weight, right[at, slot, last] * weight])


def grow_forest(cells: DataFrame, sizes: Sequence[int], label: str, weight: Sequence[float], trees: int, depth: int, seed: int) -> list[Tree]:
    """Trees on bootstrap samples; each node tries the square root of all features. ``sizes``: bins of each feature.

    ``cells`` is what ``counted_cells`` gives, ``weight`` the weight of a row of class 0 and 1. Draws come from the seed,
    the tree and the block, so they do not depend on partitioning.
    """
    d, tried = len(sizes), math.ceil(math.sqrt(len(sizes)))
    sizes, weight, widest = np.array(sizes), np.array(weight, float), max(2, *sizes)
    blocks = -(-cells.count() // BLOCK)
    known = cells.select("_cell", (F.col(label) == 1).alias("_y"), "_rows", F.pmod(F.xxhash64("_cell"), F.lit(max(blocks, 1))).alias("_block"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_cell", "ascending"), ("_y", "ascending")])
        parts = [b"".join(table["_cell"].to_pylist()), table["_y"].to_numpy().tobytes(), table["_rows"].to_numpy().astype(np.int64).tobytes()]
        return pa.table({"_block": table["_block"][:1]} | {c: pa.array([p], pa.binary()) for c, p in zip(("_cells", "_ys", "_ns"), parts)})

    packed = settle(known.groupBy("_block").applyInArrow(pack, "_block long, _cells binary, _ys binary, _ns binary"))
    lots = packed.sparkSession.range(-(-trees // LOT)).withColumnRenamed("id", "_lot")
    work = settle(packed.crossJoin(F.broadcast(lots)).repartition(max(1, blocks) * -(-trees // LOT), "_block", "_lot"))
    forest = [Tree.root() for _ in range(trees)]
    active = {t: np.zeros(1, np.int64) for t in range(trees)}
    for level in range(depth):
        tries = {t: np.random.default_rng([seed, t, level]).permuted(np.tile(np.arange(d), (len(a), 1)), axis=1)[:, :tried] for t, a in active.items()}
        best = _level(work, forest, active, tries, sizes, weight, widest, seed)
        for t, rows in best.items():
            splits = rows[:, 2] > 1e-15
            if level == 0:
                forest[t].classes[0] = rows[0, 3:5] + rows[0, 5:7]
            _split(forest[t], active[t][splits], tries[t][splits, rows[splits, 0].astype(int)], rows[splits])
            # a node of one class is a leaf
            new = np.arange(len(forest[t].feature) - 2 * splits.sum(), len(forest[t].feature))
            active[t] = new[(forest[t].classes[new] > 0).all(axis=1)]
        active = {t: active[t] for t in best if len(active[t])}
        if not active:
            break
    return [tree.pruned() for tree in forest]


def _split(tree: Tree, nodes: np.ndarray, features: np.ndarray, rows: np.ndarray) -> None:
    first, n = len(tree.feature), len(nodes)
    tree.feature[nodes], tree.last[nodes], tree.child[nodes] = features, rows[:, 1], first + 2 * np.arange(n)
    tree.feature = np.concatenate([tree.feature, np.full(2 * n, -1, np.int16)])
    tree.last = np.concatenate([tree.last, np.zeros(2 * n, np.uint8)])
    tree.child = np.concatenate([tree.child, np.zeros(2 * n, np.int32)])
    tree.classes = np.concatenate([tree.classes, rows[:, 3:7].reshape(-1, 2)])


def _level(
    work: DataFrame, forest: list[Tree], active: dict[int, np.ndarray], tries: dict[int, np.ndarray], sizes: np.ndarray, weight: np.ndarray,
    widest: int, seed: int,
) -> dict[int, np.ndarray]:
    """The best split of each active node of each tree; counts of a tree's nodes travel as one buffer per block."""
    shapes = {t: (tree.feature, tree.last, tree.child) for t, tree in enumerate(forest) if t in active}
    none = np.zeros((0, 2))

    def layout(t: int) -> np.ndarray:
        """Where the bins of each node's slots begin, and the end of all."""
        return np.concatenate([[0], np.cumsum(sizes[tries[t]].ravel())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                cells = np.frombuffer(r["_cells"], np.uint8).reshape(-1, len(sizes))
                y, n = np.frombuffer(r["_ys"], np.uint8), np.frombuffer(r["_ns"], np.int64)
                names, found = [], []
                for t in range(r["_lot"] * LOT, (r["_lot"] + 1) * LOT):
                    if t not in shapes:
                        continue
                    drawn = np.random.default_rng([seed, t, r["_block"], 1]).poisson(n)
                    node = Tree(*shapes[t], none).leaves(cells)
                    slot = np.full(len(shapes[t][0]), -1, np.int64)
                    slot[active[t]] = np.arange(len(active[t]))
                    slot = slot[node]
                    mine = np.flatnonzero((slot >= 0) & (drawn > 0))
                    slot, drawn, begins = slot[mine], drawn[mine], layout(t)
                    sums = np.zeros(2 * begins[-1])
                    tried = tries[t].shape[1]
                    for j in range(tried):
                        at = begins[slot * tried + j] + cells[mine, tries[t][slot, j]]
                        sums += np.bincount(2 * at + y[mine], drawn, len(sums))
                    names.append(t)
                    found.append(sums.astype(np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(found, pa.binary())], names=["_t", "_sums"])

    def choose(table: pa.Table) -> pa.Table:
        t = table["_t"][0].as_py()
        sums = np.sum([np.frombuffer(b, np.int64) for b in table["_sums"].to_pylist()], axis=0).reshape(-1, 2)
        begins = layout(t)
        wide = begins[:-1, None] + np.arange(widest)
        inside = np.arange(widest) < sizes[tries[t]].ravel()[:, None]
        counts = np.where(inside[..., None], sums[np.minimum(wide, begins[-1] - 1)], 0).reshape(*tries[t].shape, widest, 2)
        return pa.table({"_t": table["_t"][:1], "_best": pa.array([_best_splits(counts, weight).tobytes()], pa.binary())})

    partial = work.mapInArrow(count, "_t int, _sums binary")
    found = partial.groupBy("_t").applyInArrow(choose, "_t int, _best binary").collect()  # a row per tree
    return {r["_t"]: np.frombuffer(bytes(r["_best"]), np.float64).reshape(-1, 7) for r in found}


def forest_scores(cells: DataFrame, forest: Sequence[Tree], width: int, out: str) -> DataFrame:
    """``_cell`` and the mean share of class 1 in the leaves that it falls into."""
    plain = [(t.feature, t.last, t.child, t.classes[:, 1] / np.maximum(t.classes.sum(axis=1), 1e-300)) for t in forest]
    none = np.zeros((0, 2))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _unpacked(batch.column(0), width)
            total = np.zeros(len(cells))
            for feature, last, child, share in plain:
                total += share[Tree(feature, last, child, none).leaves(cells)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total / len(plain))], names=["_cell", out])

    return cells.select("_cell").mapInArrow(score, f"_cell binary, `{out}` double")
