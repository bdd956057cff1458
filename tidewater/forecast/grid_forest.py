"""Forests on squared error for all candidates of a grid at once.

Trees are bootstrapped alike for every candidate. A forest of 50 trees is the first 50 of a forest of 200; a tree with
a limit on depth, or on the rows of a node that is split, is the tree without that limit, cut off there. So one tree
per number and ``min_samples_leaf`` is grown, and its nodes hold the values of all candidates.

Rows are cut into bins and written in blocks. Nodes of more than ``NODE_ROWS`` drawn rows are split by sums over bins;
then the rows of a node meet in one task together with the rows to predict there, the task grows the rest level by
level, and only sums of predictions leave it: no forest is ever held as a whole.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.forecast.histogram_trees import BINS, Blocks, Tree, bin_edges, bins_of, blocks_of, to_bins, total_of
from tidewater.session import cut_lineage, spread

# Drawn rows of a node that may meet in one task: growing the rest takes it some 600 bytes each.
NODE_ROWS = 1 << 18
# Trees of a task if all rows may meet there, nodes split in one job, and rows that are predicted in one block.
CHUNK_TREES, JOB_NODES, HELD_ROWS = 5, 128, 2048


class Grown(NamedTuple):
    """A tree in arrays, parents before children; ``rows`` are drawn rows, ``gains`` are summed by feature."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    level: np.ndarray
    gains: np.ndarray

    def leaves_of(self, bins: np.ndarray) -> np.ndarray:
        node, open_ = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(open_):
            at = node[open_]
            inner = self.feature[at] >= 0
            open_, at = open_[inner], at[inner]
            node[open_] = self.left[at] + (bins[open_, self.feature[at]] > self.cut[at])
        return node


def above(gain):
    """Gains must exceed this to be larger by more than rounding; equal ones leave it to the first feature and cut."""
    return gain + 1e-9 * (1 + gain)


def grow_mean(bins: np.ndarray, z: np.ndarray, drawn: np.ndarray, leaf: int, split: int = 2, depth: float = np.inf, level: int = 0) -> Grown:
    """A tree on squared error over drawn rows (``bins`` is feature by row), every split the best one.

    All nodes of a level are split together. Each feature keeps the rows in the order of node and bin, so that running
    sums give both sides of every cut; cuts between equal bins are none.
    """
    w = drawn.astype(float)
    wz, width = w * z, len(bins)
    orders = [np.argsort(b, kind="stable") for b in bins]
    total, total_z = np.array([w.sum()]), np.array([wz.sum()])
    out = [[np.full(1, -1)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [total_z / total], [total], [np.full(1, level)]]
    gains, made = np.zeros(width), 1
    node = np.zeros(1, np.int64)  # nodes of this level that may be split, in the order of the rows' slots
    slot = np.zeros(len(z), np.int64)
    if total[0] < max(split, 2 * leaf) or level >= depth:
        node = node[:0]
    while len(node):
        places = slot[orders[0]]
        starts = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        alone = total_z**2 / total
        best, best_f, best_cut = alone.copy(), np.full(len(node), -1), np.zeros(len(node), np.int64)
        same = places[1:] == places[:-1]
        for f in range(width):
            o = orders[f]
            b = bins[f][o]
            at = np.flatnonzero((b[1:] != b[:-1]) & same)
            if not len(at):
                continue
            upto, upto_z = np.cumsum(w[o]), np.cumsum(wz[o])
            own = places[at]
            before, before_z = (np.append(0.0, x)[starts] for x in (upto, upto_z))
            n, s = upto[at] - before[own], upto_z[at] - before_z[own]
            m, r = total[own] - n, total_z[own] - s
            gain = s * s / n + r * r / m
            if leaf > 1:
                gain[(n < leaf) | (m < leaf)] = -np.inf
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            peak = np.maximum.reduceat(gain, first)
            slots = own[first]
            better = peak > above(best[slots])
            if not better.any():
                continue
            where = np.flatnonzero(above(gain) >= np.repeat(peak, np.diff(np.append(first, len(own)))))
            hit = own[where]
            head = np.append(True, hit[1:] != hit[:-1])  # the first cut of the largest gain
            chosen = slots[better]
            cut_of = np.zeros(len(node), np.int64)
            cut_of[hit[head]] = b[at[where[head]]]
            best[chosen], best_f[chosen], best_cut[chosen] = peak[better], f, cut_of[chosen]
        splits = np.flatnonzero(best_f >= 0)
        if not len(splits):
            break
        level += 1
        gains += np.bincount(best_f[splits], (best - alone)[splits], width)
        first_child = np.full(len(node), -1)
        first_child[splits] = np.arange(0, 2 * len(splits), 2)
        feature, cut, left = (np.concatenate(x) for x in out[:3])
        feature[node[splits]], cut[node[splits]], left[node[splits]] = best_f[splits], best_cut[splits], made + first_child[splits]
        out[:3] = [feature], [cut], [left]
        rows = orders[0][first_child[places] >= 0]
        of = slot[rows]
        child = first_child[of] + (bins[best_f[of], rows] > best_cut[of])
        total, total_z = np.bincount(child, w[rows], 2 * len(splits)), np.bincount(child, wz[rows], 2 * len(splits))
        count = len(total)
        for column, new in zip(out, (np.full(count, -1), np.zeros(count, np.int64), np.zeros(count, np.int64), total_z / total, total, np.full(count, level))):
            column.append(new)
        goes_on = (total >= max(split, 2 * leaf)) & (level < depth)
        node = made + np.flatnonzero(goes_on)
        made += count
        renamed = np.where(goes_on, np.cumsum(goes_on) - 1, -1)
        slot = np.full(len(z), -1)
        slot[rows] = renamed[child]
        total, total_z = total[goes_on], total_z[goes_on]
        small = np.uint16 if len(node) < 1 << 16 else np.int64
        for f in range(width):
            own = slot[orders[f]]
            kept = own >= 0
            orders[f] = orders[f][kept][np.argsort(own[kept].astype(small), kind="stable")]
    return Grown(*(np.concatenate(x) for x in out), gains)


def limited_values(grown: Grown, limits: list[tuple[float, int]], start: np.ndarray | None = None) -> np.ndarray:
    """Value of every node under each (depth, rows of a node that is split): that of the node where such a tree ends.
    ``start`` holds those of the root if it lies inside a larger tree."""
    depth, split = (np.array(x, float) for x in zip(*limits))
    out = np.repeat(grown.value[:, None], len(limits), axis=1)
    if start is not None:
        out[0] = start
    inner = np.flatnonzero(grown.feature >= 0)
    for level in np.unique(grown.level[inner]):
        own = inner[grown.level[inner] == level]
        ends = (grown.level[own, None] >= depth) | (grown.rows[own, None] < split)
        for side in (0, 1):
            child = grown.left[own] + side
            out[child] = np.where(ends, out[own], out[child])
    return out


class TopTree(Tree):
    """The nodes of a tree that are split by sums: drawn rows and level as well, and the gains by feature."""

    def __init__(self, width: int):
        super().__init__()
        self.rows, self.level, self.gains = [0.0], [0], np.zeros(width)

    def split(self, node, feature, cut):
        children = super().split(node, feature, cut)
        self.rows += [0.0, 0.0]
        self.level += [self.level[node] + 1] * 2
        return children

    def grown(self) -> Grown:
        return Grown(*(np.array(x) for x in (self.feature, self.cut, self.left, self.value, self.rows, self.level)), self.gains)


class Unit(NamedTuple):
    """What one task grows: some trees for some ``min_samples_leaf``, or a node of one; ``band``: which forests count it."""

    trees: list[int]
    leaves: list[int]
    band: int


class GridForest:
    """Forests of all candidates (full parameter sets), fitted and evaluated together."""

    def __init__(self, candidates: list[dict], seed: int = 42, node_rows: int = NODE_ROWS, bootstrap: bool = True):
        self.candidates, self.seed, self.node_rows, self.bootstrap = candidates, seed, node_rows, bootstrap
        self.sizes = sorted({p["n_estimators"] for p in candidates})
        self.leaves = sorted({p["min_samples_leaf"] for p in candidates})
        self.limits = sorted({self.limit(p) for p in candidates})

    @staticmethod
    def limit(p: dict) -> tuple[float, int]:
        return (np.inf if p["max_depth"] is None else p["max_depth"], p["min_samples_split"])

    def drawn(self, block: int, n: int, tree: int) -> np.ndarray:
        """How often every row of a block is drawn for a tree, however many trees there are."""
        if not self.bootstrap:
            return np.ones(n, np.uint8)
        return np.random.default_rng([self.seed, block, tree]).poisson(1.0, n).astype(np.uint8)

    def fit(self, rows: DataFrame) -> GridModel:
        edges = bin_edges(rows)
        if not edges:
            return GridModel(self, [], None, {}, [])
        blocks = blocks_of(rows, edges)
        total = blocks.frame.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        trees = self.sizes[-1]
        if total <= self.node_rows:
            units, at = [], 0
            for band, upto in enumerate(self.sizes):
                units += [Unit(list(range(t, min(t + CHUNK_TREES, upto))), self.leaves, band) for t in range(at, upto, CHUNK_TREES)]
                at = upto
            return GridModel(self, edges, blocks, {}, units)
        band_of = np.searchsorted(self.sizes, np.arange(trees), "right")
        units = [Unit([t], [leaf], int(band_of[t])) for leaf in self.leaves for t in range(trees)]
        return GridModel(self, edges, blocks, self._tops(blocks, len(edges)), units)

    def _tops(self, blocks: Blocks, width: int) -> dict[tuple[int, int], tuple[TopTree, set[int]]]:
        """By tree and ``min_samples_leaf``: the splits of nodes of more than ``node_rows`` drawn rows, exact as any, and
        the nodes of as many rows that stay leaves."""
        tops = {(t, leaf): (TopTree(width), set()) for leaf in self.leaves for t in range(self.sizes[-1])}
        depth, split = max(d for d, _ in self.limits), min(s for _, s in self.limits)
        open_ = [(x, 0) for x in tops]
        while open_:
            after = []
            for at in range(0, len(open_), JOB_NODES):  # a few nodes a job bound the size of its sums
                part = open_[at : at + JOB_NODES]
                shape = (len(part), width, BINS, 2)

                def add(row, part=part, shape=shape):
                    bins, z, out, found = bins_of(row), np.frombuffer(row.z), np.zeros(shape), {}
                    for i, (x, node) in enumerate(part):
                        if x not in found:
                            found.clear()
                            found[x] = tops[x][0].leaves_of(bins), self.drawn(row.block, row.n, x[0])
                        leaf, drawn = found[x]
                        use = np.flatnonzero((leaf == node) & (drawn > 0))
                        own, w = bins[use], drawn[use].astype(float)
                        for j in range(width):
                            for k, weight in enumerate((w, w * z[use])):
                                out[i, j, :, k] = np.bincount(own[:, j], weight, BINS)
                    return out.ravel()

                for (x, node), sums in zip(part, total_of(blocks, add, int(np.prod(shape))).reshape(shape)):
                    tree, done = tops[x]
                    n, s = sums[0].sum(axis=0)
                    tree.rows[node], tree.value[node] = n, s / n if n else 0.0
                    if n <= self.node_rows:
                        continue
                    best = mean_split(sums, x[1]) if n >= split and tree.level[node] < depth else None
                    if best is None:
                        done.add(node)
                        continue
                    feature, cut, gain = best
                    tree.gains[feature] += gain
                    after += [(x, child) for child in tree.split(node, feature, cut)]
            open_ = after
        return tops


def mean_split(sums: np.ndarray, leaf: int) -> tuple[int, int, float] | None:
    """(feature, last bin to the left, gain) of the best split for sums (feature, bin, [rows, target])."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    whole = sums[0].sum(axis=0)
    n, s = left[..., 0], left[..., 1]
    m, r = whole[0] - n, whole[1] - s
    usable = (n >= max(leaf, 1)) & (m >= max(leaf, 1))
    alone = whole[1] ** 2 / whole[0]
    gain = np.where(usable, s * s / np.maximum(n, 1) + r * r / np.maximum(m, 1), -np.inf)
    best = None
    for feature, peak in enumerate(gain.max(axis=1)):
        if peak > above(alone if best is None else best[2]):
            best = feature, int(np.argmax(above(gain[feature]) >= peak)), float(peak)
    return best and (*best[:2], best[2] - alone)


def trees_of(pdf: pd.DataFrame, forest: GridForest, tops: dict, units: list[Unit], width: int):
    """The trees that a task grows from the training rows in its pieces: number, ``min_samples_leaf``, tree, values of its root."""
    unit, node = units[int(pdf["unit"].iloc[0])], int(pdf["node"].iloc[0])
    own = pdf[pdf["held"] < 0]
    n = int(own["n"].sum())
    bins = np.frombuffer(b"".join(own["bins"]), np.uint8).reshape(n, width)
    z = np.frombuffer(b"".join(own["z"]))
    drawn = np.frombuffer(b"".join(own["drawn"]), np.uint8).reshape(n, len(unit.trees))
    order = np.lexsort((*drawn.T, *bins.T, z))  # sums don't depend on the order in which pieces arrive
    bins, z, drawn = np.ascontiguousarray(bins[order].T), z[order], drawn[order]
    depth, split = max(d for d, _ in forest.limits), min(s for _, s in forest.limits)
    for i, t in enumerate(unit.trees):
        use = np.flatnonzero(drawn[:, i])
        for leaf in unit.leaves:
            top, start, level = tops.get((t, leaf), (None,))[0], None, 0
            if top is not None:
                start, level = limited_values(top.grown(), forest.limits)[node], top.level[node]
            if len(use):
                yield t, leaf, grow_mean(bins[:, use], z[use], drawn[use, i], leaf, split, depth, level), start
            elif start is not None:  # a large node that stays a leaf
                yield t, leaf, Grown(*(np.array([x]) for x in (-1, 0, 0, top.value[node], top.rows[node], level)), np.zeros(width)), start


class GridModel:
    """Fitted forests: blocks of training rows and splits of large nodes. The rest is grown where it is needed."""

    def __init__(self, forest: GridForest, edges: list[np.ndarray], blocks: Blocks | None, tops: dict, units: list[Unit]):
        self.forest, self.edges, self.blocks, self.tops, self.units = forest, edges, blocks, tops, units

    def _training_pieces(self) -> DataFrame:
        """Drawn rows by task: ``unit, node, held, n, bins, z, drawn``."""
        forest, tops, units = self.forest, self.tops, self.units

        def deal(batches):
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    bins, z = bins_of(row), np.frombuffer(row.z)
                    for u, unit in enumerate(units):
                        drawn = np.column_stack([forest.drawn(row.block, row.n, t) for t in unit.trees])
                        some = drawn.any(axis=1)
                        top, done = tops.get((unit.trees[0], unit.leaves[0]), (None, ()))
                        leaf, out = (top.leaves_of(bins) if top else np.zeros(row.n, np.int64)), []
                        for node in np.unique(leaf[some]):
                            use = some & (leaf == node)
                            if node not in done:
                                out.append((u, int(node), -1, int(use.sum()), bins[use].tobytes(), z[use].tobytes(), drawn[use].tobytes()))
                        yield pd.DataFrame(out, columns=["unit", "node", "held", "n", "bins", "z", "drawn"])

        return one_by_one(self.blocks.frame.select("block", "n", "bins", "z"), deal, "unit int, node int, held long, n long, bins binary, z binary, drawn binary")

    def _held_pieces(self, rows: DataFrame) -> DataFrame:
        """Rows to predict (``_id, x``) by task, in the shape of the training pieces: ``z`` holds their ids."""
        edges, tops, units = self.edges, self.tops, self.units

        def deal(batches):
            number = TaskContext.get().partitionId() << 32
            for pdf in batches:
                for a in range(0, len(pdf), HELD_ROWS):
                    part = pdf.iloc[a : a + HELD_ROWS]
                    bins, ids = to_bins(np.array(part["x"].tolist(), dtype=float), edges), part["_id"].to_numpy(np.int64)
                    out = []
                    for u, unit in enumerate(units):
                        top, _ = tops.get((unit.trees[0], unit.leaves[0]), (None, ()))
                        leaf = top.leaves_of(bins) if top else np.zeros(len(bins), np.int64)
                        for node in np.unique(leaf):
                            use = leaf == node
                            out.append((u, int(node), number, int(use.sum()), bins[use].tobytes(), ids[use].tobytes(), b""))
                    number += 1
                    yield pd.DataFrame(out, columns=["unit", "node", "held", "n", "bins", "z", "drawn"])

        return rows.select("_id", "x").mapInPandas(deal, "unit int, node int, held long, n long, bins binary, z binary, drawn binary")

    def _predicted(self, rows: DataFrame) -> DataFrame:
        """``_id, zhats`` for rows ``_id, x``."""
        forest, tops, units, width = self.forest, self.tops, self.units, len(self.edges)
        shapes = [(leaf, limit) for leaf in forest.leaves for limit in forest.limits]
        per_leaf = len(forest.limits)

        def evaluate(pdf):
            held = pdf[pdf["held"] >= 0]
            unit, blank = units[int(pdf["unit"].iloc[0])], pd.DataFrame({"held": [], "band": [], "leaf": [], "ids": [], "sums": [], "grown": []})
            if not len(held):
                return blank.astype({"held": "int64", "band": "int32", "leaf": "int32", "grown": "int32"})
            n = int(held["n"].sum())
            bins = np.frombuffer(b"".join(held["bins"]), np.uint8).reshape(n, width)
            sums, grown = np.zeros((len(unit.leaves), n, per_leaf)), 0
            for _, leaf, tree, start in trees_of(pdf, forest, tops, units, width):
                sums[unit.leaves.index(leaf)] += limited_values(tree, forest.limits, start)[tree.leaves_of(bins)]
                grown += 1
            out, a = [], 0
            for h, size, ids in zip(held["held"], held["n"], held["z"]):
                for i, leaf in enumerate(unit.leaves):
                    out.append((h, unit.band, leaf, ids, sums[i, a : a + size].tobytes(), grown // len(unit.leaves)))
                a += size
            return pd.DataFrame(out, columns=["held", "band", "leaf", "ids", "sums", "grown"])

        places = [[shapes.index((p["min_samples_leaf"], forest.limit(p))), p["n_estimators"]] for p in forest.candidates]

        def total(pdf):
            ids = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in pdf["ids"]]))
            sums, count = (np.zeros((len(forest.sizes), len(ids), len(forest.leaves), *more)) for more in ((per_leaf,), ()))
            for r in pdf.sort_values(["band", "leaf", "sums"]).itertuples(index=False):
                at, leaf = np.searchsorted(ids, np.frombuffer(r.ids, np.int64)), forest.leaves.index(r.leaf)
                sums[r.band, at, leaf] += np.frombuffer(r.sums).reshape(len(at), per_leaf)
                count[r.band, at, leaf] += r.grown
            sums, count = np.cumsum(sums, axis=0), np.cumsum(count, axis=0)
            found = [
                sums[band, :, s // per_leaf, s % per_leaf] / np.maximum(count[band, :, s // per_leaf], 1)
                for s, band in ((s, forest.sizes.index(size)) for s, size in places)
            ]
            return pd.DataFrame({"_id": ids, "zhats": list(np.stack(found, axis=1))})

        pieces = self._training_pieces().unionByName(self._held_pieces(rows))
        made = spread(pieces, "unit", "node").groupBy("unit", "node").applyInPandas(
            evaluate, "held long, band int, leaf int, ids binary, sums binary, grown int")
        return spread(made, "held").groupBy("held").applyInPandas(total, "_id long, zhats array<double>")

    def transform_all(self, rows: DataFrame) -> DataFrame:
        """The rows with ``zhats``, the predictions of all candidates in their order."""
        kept = cut_lineage(rows.withColumns({"_id": F.monotonically_increasing_id(), "x": vector_to_array("vector")}))
        if self.blocks is None:
            return kept.drop("_id", "x").withColumn("zhats", F.lit(None).cast("array<double>"))
        return kept.drop("x").join(cut_lineage(self._predicted(kept)), "_id", "left").drop("_id")

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with ``zhat``, the prediction of the first candidate."""
        return self.transform_all(rows).withColumn("zhat", F.col("zhats")[0]).drop("zhats")

    @property
    def featureImportances(self):
        """Share of every feature in the gains, averaged over trees, of a model of one candidate."""
        forest, tops, units, width = self.forest, self.tops, self.units, len(self.edges)

        def gains(pdf):
            return pd.DataFrame([(t, tree.gains) for t, _, tree, _ in trees_of(pdf, forest, tops, units, width)], columns=["tree", "gains"])

        by_tree = {t: top.gains.copy() for (t, _), (top, _) in self.tops.items()}
        if self.blocks is not None:
            pieces = spread(self._training_pieces(), "unit", "node").groupBy("unit", "node")
            for t, own in pieces.applyInPandas(gains, "tree int, gains array<double>").collect():
                by_tree[t] = by_tree.get(t, 0) + np.array(own)
        shares = [g / g.sum() for g in by_tree.values() if g.sum() > 0]
        mean = np.sum(shares, axis=0) if shares else np.zeros(width)
        return Vectors.dense(mean / (mean.sum() or 1))


def one_by_one(frame: DataFrame, run, schema: str) -> DataFrame:
    """``frame.mapInPandas(run, schema)`` with a row a batch."""
    return frame.mapInPandas(lambda batches: run(pdf.iloc[at : at + 1] for pdf in batches for at in range(len(pdf))), schema)
