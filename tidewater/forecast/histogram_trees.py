"""Trees for losses that MLlib does not offer: boosting on pseudo-Huber and quantile loss, forests on absolute error.

Features are cut into bins once and the rows kept in blocks (bins, target, score) in the shared folder. A boosted
tree grows a level per job: every task adds up gradients per node, feature and bin over its blocks, Spark adds the
partial sums, and the best split of a node follows from sums of a fixed size. The score of a row is that
of the last written round and the trees since then, so a lost executor repeats one job. A table no larger than one
block is held by the driver, and its levels need no job.

A tree on absolute error needs medians. Nodes of many rows are split by sums over bins of the feature and bins of
the target, from which medians and absolute deviations follow up to the width of a target bin; once a node holds
``NODE_ROWS`` rows or less, its rows meet in one task, which grows the rest with exact medians.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.forecast.gram import summed
from tidewater.session import cut_lineage, scratch_path, spread

BINS, TARGET_BINS = 32, 64
BLOCK_ROWS = 65_536
# Rounds between two writings of the scores, and values that the search for a quantile may hand to the driver.
WRITE_ROUNDS, HELD_VALUES = 10, 4096
# Nodes of a tree that is evaluated split by split over all rows, without looking at which rows get there.
FEW_NODES = 64
# Bins of the values that a search for quantiles begins with, if it is told where they lie, and of all leaves together.
FIRST_BINS, FIRST_SUMS = 2048, 1 << 18
# Numbers in all partial sums of a pass that the driver adds up itself.
DIRECT_SUMS = 1 << 22
# Rows of a table that the driver may hold: those of one block.
LOCAL_ROWS = BLOCK_ROWS
# Drawn rows of a node that may meet in one task of a forest on absolute error: some 20 bytes each.
NODE_ROWS = 8 * BLOCK_ROWS
# Larger nodes that are split in one job: a task holds half a megabyte of sums for each.
JOB_NODES = 64
# A block has megabytes, so that batches are bounded by size; rows drawn at a time, and numbers of a split added up at a time.
BATCH_BYTES, DRAW_ROWS, SPLIT_CELLS = "16m", 4096, 1 << 18
# The weight that shrinks leaves, and the residual at which pseudo-Huber turns linear.
LEAF_WEIGHT, HUBER_SLOPE = 1.0, 1.0


class Tree:
    """Nodes in arrays: ``feature`` (-1: leaf), ``cut`` (the last bin that goes left), ``left``, ``right``, ``value``."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.value = [-1], [0], [0], [0], [0.0]

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = int(feature), int(cut), n, n + 1
        for name, blank in (("feature", -1), ("cut", 0), ("left", 0), ("right", 0), ("value", 0.0)):
            getattr(self, name).extend([blank, blank])
        return n, n + 1

    def leaves_of(self, bins: np.ndarray) -> np.ndarray:
        if len(self.feature) <= FEW_NODES:
            return self._split_by_split(bins).astype(np.int64)
        feature, cut, left, right = (np.array(getattr(self, k)) for k in ("feature", "cut", "left", "right"))
        node = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(feature[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            goes_left = bins[inner, feature[at]] <= cut[at]
            node[inner] = np.where(goes_left, left[at], right[at])

    def predict(self, bins: np.ndarray, rate: float = 1.0) -> np.ndarray:
        few = len(self.feature) <= FEW_NODES
        return np.take(rate * np.array(self.value), self._split_by_split(bins) if few else self.leaves_of(bins))

    def _split_by_split(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row: each split takes one of its sides for all rows, children before their parents."""
        found = [np.uint8(node) for node in range(len(self.feature))]
        for node in range(len(found) - 1, -1, -1):
            if self.feature[node] >= 0:
                goes_left = -(bins[:, self.feature[node]] <= self.cut[node]).view(np.uint8)  # all bits or none
                left, right = found[self.left[node]], found[self.right[node]]
                found[node] = right ^ ((left ^ right) & goes_left)
        return np.zeros(len(bins), np.uint8) if self.feature[0] < 0 else found[0]


def bin_edges(rows: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of the bins of every feature, from approximate quantiles of all rows."""
    first = rows.select("vector").first()
    if first is None:
        return []
    size = len(first[0])
    columns = [f"_{i}" for i in range(size)]
    spread_out = rows.select(vector_to_array("vector").alias("x")).select(*[F.col("x")[i].alias(c) for i, c in enumerate(columns)])
    found = spread_out.approxQuantile(columns, [k / bins for k in range(1, bins)], 0.001)
    return [np.unique(np.array(e, dtype=float)) for e in found]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)]).astype(np.uint8)


def blocks_of(rows: DataFrame, edges: list[np.ndarray]) -> Blocks:
    """``block, n, bins, z, score``: rows in blocks, as bytes; every row begins with the score zero."""

    def run(batches):
        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def block():
            bins, z = (np.concatenate(x) for x in zip(*held))
            return pd.DataFrame({"block": [number], "n": [len(z)], "bins": [bins.T.tobytes()], "z": [z.tobytes()], "score": [np.zeros(len(z)).tobytes()]})

        for pdf in batches:
            if not len(pdf):
                continue
            held.append((to_bins(np.array(pdf["x"].tolist(), dtype=float), edges), pdf["z"].to_numpy(dtype=float)))
            n += len(pdf)
            if n >= BLOCK_ROWS:
                yield block()
                number, held, n = number + 1, [], 0
        if held:
            yield block()

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    arrays = rows.where("z is not null").select(vector_to_array("vector").alias("x"), "z")
    written = cut_lineage(arrays.mapInPandas(run, "block long, n long, bins binary, z binary, score binary"))
    count, total, parts = written.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct(F.shiftright("block", 32))).first()
    return Blocks(written, count, list(written.toPandas().itertuples(index=False)) if total <= LOCAL_ROWS else None, parts)


def bins_of(row) -> np.ndarray:
    """Bins of a block, a line per row; the block holds them feature by feature."""
    return np.frombuffer(row.bins, np.uint8).reshape(-1, row.n).T


def opened(row, trees: list[Tree], rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, target and score of a block, the score with the trees since it was written."""
    bins = bins_of(row)
    score = np.frombuffer(row.score).copy()
    for tree in trees:
        score += tree.predict(bins, rate)
    return bins, np.frombuffer(row.z), score


class Blocks(NamedTuple):
    """A table of blocks, how many there are, the rows of a table of at most ``LOCAL_ROWS`` values, and how many
    partitions the blocks were written from."""

    frame: DataFrame
    count: int
    rows: list | None
    parts: int = 1


def total_of(blocks: Blocks, add, size: int) -> np.ndarray:
    """Sum of ``add(block row)`` (flat arrays of this size) over all blocks.

    A task gives one partial sum. A written partition is read by one task or together with others: if as many sums
    as there are partitions fit the driver they are added up there, which spares a shuffle; otherwise Spark adds them up. A table of one block's size is summed without a job.
    """
    if blocks.rows is not None:
        return sum((add(row) for row in blocks.rows), np.zeros(size))

    def run(batches):
        total = None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                part = add(row)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"gram": [total.astype(float).tobytes() if direct else total.tolist()]})

    direct = blocks.parts * size <= DIRECT_SUMS
    partial = blocks.frame.mapInPandas(run, "gram binary" if direct else "gram array<double>")
    if direct:
        return sum((np.frombuffer(r[0]) for r in partial.collect()), np.zeros(size))
    return np.array(summed(partial, []).first()[0], dtype=float)


def leaf_quantiles(blocks: Blocks, value_of, share: float) -> dict[int, float]:
    """The value of rank ceil(share * n) of every leaf that has rows, exactly; see :func:`leaf_ranks`."""
    return {leaf: value for (leaf, _), value in leaf_ranks(blocks, value_of, [share]).items()}


def _rank(share: float, n: int) -> int:
    return max(int(np.ceil(share * n)) - 1, 0)


def leaf_ranks(blocks: Blocks, value_of, shares: list[float], first: FirstBins | None = None) -> dict[tuple[int, int], float]:
    """The values of ranks ceil(share * n) of every leaf that has rows, exactly, by leaf and number of the share.

    ``value_of(block row)`` gives leaf and value of its rows. Each leaf and share has a bracket of values that is
    cut to the bin with the wanted rank until few are left; only those go to the driver. The search begins with the
    bins of ``first``, which spares it the pass over the least and largest values and mostly all but one of the cuts.
    """
    if blocks.rows is not None:
        parts = [value_of(row) for row in blocks.rows] or [(np.zeros(0, np.int64), np.zeros(0))]
        leaf, value = (np.concatenate(x) for x in zip(*parts))
        own = {x: np.sort(value[leaf == x]) for x in np.unique(leaf).tolist()}
        return {(x, i): float(v[_rank(share, len(v))]) for x, v in own.items() for i, share in enumerate(shares)}

    # (leaf, share) -> (least, first above, rows below, rows inside, wanted rank from 0)
    open_ = first.brackets(blocks, value_of, shares) if first else None
    if open_ is None:
        open_ = _whole_ranges(blocks, value_of, shares)
    grid = 512
    while True:
        wide = [x for x, (low, high, _, inside, _) in open_.items() if inside > HELD_VALUES and np.nextafter(low, np.inf) < high]
        if not wide:
            break
        # shares of a leaf that still have the same bracket are counted once
        brackets = list(dict.fromkeys((x[0], *open_[x][:2]) for x in wide))
        edges = {b: np.linspace(b[1], b[2], grid + 1) for b in brackets}

        def counts(row):
            leaf, value = value_of(row)
            out = np.zeros((len(brackets), grid))
            for i, b in enumerate(brackets):
                own = value[(leaf == b[0]) & (value >= b[1]) & (value < b[2])]
                at = np.clip(np.searchsorted(edges[b], own, "right") - 1, 0, grid - 1)
                out[i] = np.bincount(at, minlength=grid)
            return out.ravel()

        summed_up = dict(zip(brackets, total_of(blocks, counts, len(brackets) * grid).reshape(len(brackets), grid)))
        for x in wide:
            low, high, below, _, wanted = open_[x]
            inside, own = summed_up[x[0], low, high], edges[x[0], low, high]
            upto = np.cumsum(inside)
            at = int(np.searchsorted(upto, wanted - below, "right"))
            open_[x] = (own[at], own[at + 1], below + int(upto[at] - inside[at]), int(inside[at]), wanted)

    few = list(dict.fromkeys((x[0], *o[:2]) for x, o in open_.items() if o[3] <= HELD_VALUES))

    def inside(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                leaf, value = value_of(row)
                kept = [value[(value >= low) & (value < high) & (leaf == x)].tobytes() for x, low, high in few]
                yield pd.DataFrame({"bracket": np.arange(len(few)), "values": kept})

    held: dict[int, list] = {i: [] for i in range(len(few))}
    for r in blocks.frame.mapInPandas(inside, "bracket long, values binary").where(F.length("values") > 0).collect():
        held[r["bracket"]].append(np.frombuffer(r["values"]))
    kept = {b: np.sort(np.concatenate([np.zeros(0), *held[i]])) for i, b in enumerate(few)}
    return {x: float(kept[x[0], o[0], o[1]][o[4] - o[2]]) if o[3] <= HELD_VALUES else o[0] for x, o in open_.items()}


def _whole_ranges(blocks: Blocks, value_of, shares: list[float]) -> dict[tuple[int, int], tuple]:
    """Brackets that hold all values of a leaf."""

    def ranges(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                leaf, value = value_of(row)
                yield pd.DataFrame({"leaf": leaf, "value": value}).groupby("leaf").value.agg(["size", "min", "max"]).reset_index()

    made = blocks.frame.mapInPandas(ranges, "leaf long, size long, min double, max double")
    found = {r["leaf"]: r for r in made.groupBy("leaf").agg(F.sum("size").alias("size"), F.min("min").alias("min"), F.max("max").alias("max")).collect()}
    return {
        (x, i): (r["min"], np.nextafter(r["max"], np.inf), 0, r["size"], _rank(share, r["size"])) for x, r in found.items() for i, share in enumerate(shares)
    }


class FirstBins:
    """Bins of like numbers of values, with which searches for quantiles begin that follow each other.

    The values of a search tell the next one where to cut. How well they do decides how many passes a search takes,
    never what it finds.
    """

    def __init__(self, count: int = FIRST_BINS):
        self.count, self.edges, self.leaves = count, None, 0

    def learn(self, edges: np.ndarray, upto: np.ndarray) -> None:
        """Cut anew where ``upto`` values, of growing number, lie at or below these edges."""
        if len(edges) < 2 or upto[-1] <= upto[0]:
            return
        inner = np.unique(np.interp(np.linspace(upto[0], upto[-1], self.count - 1), upto, edges))
        reach = inner[-1] - inner[0]
        if np.isfinite(reach) and reach > 0:  # room for values outside
            self.edges = np.unique([inner[0] - reach, *inner, inner[-1] + reach])

    def brackets(self, blocks: Blocks, value_of, shares: list[float]) -> dict[tuple[int, int], tuple] | None:
        """The bin of every leaf (numbers below ``leaves``) and share; None if nothing was learned, there are too many
        leaves or a bin without an end holds many values."""
        edges, leaves = self.edges, self.leaves
        if edges is None or leaves * (len(edges) + 1) > FIRST_SUMS:
            return None
        bins, ends = len(edges) + 1, np.concatenate([[-np.inf], edges, [np.inf]])

        def counts(row):
            leaf, value = value_of(row)
            return np.bincount(leaf * bins + np.searchsorted(edges, value, "right"), minlength=leaves * bins).astype(float)

        counted = total_of(blocks, counts, leaves * bins).reshape(leaves, bins).astype(np.int64)
        self.learn(edges, np.cumsum(counted.sum(axis=0))[:-1])
        out = {}
        for x in np.flatnonzero(counted.sum(axis=1)).tolist():
            upto = np.cumsum(counted[x])
            for i, share in enumerate(shares):
                wanted = _rank(share, int(upto[-1]))
                at = int(np.searchsorted(upto, wanted, "right"))
                inside = int(counted[x, at])
                if inside > HELD_VALUES and at in (0, bins - 1):
                    return None
                out[x, i] = (float(ends[at]), float(ends[at + 1]), int(upto[at]) - inside, inside, wanted)
        return out


class BinnedModel:
    """A fitted model: predictions ``zhat`` for the ``vector`` column."""

    def __init__(self, edges: list[np.ndarray], trees: list[Tree], start: float, weight: float, losses: list[float] | None = None):
        self.edges, self.trees, self.start, self.weight, self.losses = edges, trees, start, weight, losses

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), np.nan)
        bins, out = to_bins(x, self.edges), np.full(len(x), self.start)
        for tree in self.trees:
            out += self.weight * tree.predict(bins)
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def zhat(x: pd.Series) -> pd.Series:
            return pd.Series(model.predict(np.array(x.tolist(), dtype=float)))

        return rows.withColumn("zhat", zhat(vector_to_array("vector")))


class Booster:
    """Gradient boosting on pseudo-Huber ("huber") or pinball ("quantile") loss."""

    def __init__(self, params: dict, loss: str, quantile: float = 0.5, seed: int = 42):
        self.params, self.loss, self.quantile, self.seed = params, loss, quantile, seed

    def slopes(self, z: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss, its negative slope and its curvature at the scores."""
        r = z - score
        if self.loss == "quantile":
            q = self.quantile
            return np.maximum(q * r, (q - 1) * r), np.where(r > 0, q, q - 1), np.ones(len(r))
        root = np.sqrt(1 + (r / HUBER_SLOPE) ** 2)
        return HUBER_SLOPE**2 * (root - 1), r / root, root**-3

    def fit(self, rows: DataFrame) -> BinnedModel:
        edges = bin_edges(rows)
        if not edges:
            return BinnedModel([], [], 0.0, 1.0, [])
        p, width = self.params, len(edges)
        blocks = blocks_of(rows, edges)
        share = self.quantile if self.loss == "quantile" else 0.5
        start = leaf_quantiles(blocks, lambda row: (np.zeros(row.n, np.int64), np.frombuffer(row.z)), share).get(0, 0.0)
        trees: list[Tree] = []
        recent: list[Tree] = [_constant(start / p["learning_rate"])]  # the start is the first tree until scores are written
        losses, first = [], FirstBins()
        if self.loss == "quantile" and blocks.rows is None:
            known = np.array(rows.approxQuantile("z", [k / 256 for k in range(257)], 0.001), dtype=float) - start
            first.learn(known, np.arange(len(known)))
        for round_ in range(p["n_estimators"]):
            rng = np.random.default_rng([self.seed, round_])
            columns = np.sort(rng.permutation(width)[: max(1, round(p["colsample_bytree"] * width))])
            tree, loss = self._grow(blocks, recent, round_, columns)
            losses.append(loss)
            if self.loss == "quantile":
                first.leaves = len(tree.feature)
                values = leaf_ranks(blocks, self._residuals(recent, tree), [share], first)
                for (leaf, _), value in values.items():
                    tree.value[leaf] = value
            trees.append(tree)
            recent.append(tree)
            if len(recent) >= WRITE_ROUNDS:
                blocks = self._written(blocks, recent)
                recent = []
        return BinnedModel(edges, trees, start, p["learning_rate"], losses)

    def _residuals(self, recent: list[Tree], tree: Tree):
        rate = self.params["learning_rate"]

        def value_of(row):
            bins, z, score = opened(row, recent, rate)
            return tree.leaves_of(bins), z - score

        return value_of

    def _written(self, blocks: Blocks, recent: list[Tree]) -> Blocks:
        rate = self.params["learning_rate"]

        def run(batches):
            for pdf in batches:
                pdf = pdf.copy()
                pdf["score"] = [opened(row, recent, rate)[2].tobytes() for row in pdf.itertuples(index=False)]
                yield pdf

        if blocks.rows is not None:
            return blocks._replace(rows=[row._replace(score=opened(row, recent, rate)[2].tobytes()) for row in blocks.rows])
        return blocks._replace(frame=cut_lineage(blocks.frame.mapInPandas(run, blocks.frame.schema)))

    def _grow(self, blocks: Blocks, recent: list[Tree], round_: int, columns: np.ndarray) -> tuple[Tree, float]:
        """One tree, a job per level; leaves take a Newton step. Also the mean loss before it."""
        p, tree, active, mean_loss = self.params, Tree(), [0], 0.0
        seed, subsample, rate, slopes = self.seed, p["subsample"], p["learning_rate"], self.slopes
        quantile = self.quantile if self.loss == "quantile" else None
        for depth in range(p["max_depth"]):
            shape = (len(active), len(columns), BINS, 3)

            def add(row, active=active, shape=shape):
                bins, z, score = opened(row, recent, rate)
                loss, slope, curve = slopes(z, score)
                node = np.full(len(tree.feature), -1)
                node[active] = np.arange(len(active))
                at = node[tree.leaves_of(bins)]
                use = at >= 0
                if subsample < 1:
                    use &= np.random.default_rng([seed, round_, row.block]).random(row.n) < subsample
                if use.all():
                    use = slice(None)
                own, slope, curve, out = at[use], slope[use], curve[use], np.zeros(shape)
                above = slope > 0
                first = (2 * own + above if quantile is not None else own) * BINS
                for j, c in enumerate(columns):
                    if quantile is not None:  # two slopes and one curvature: the rows of each slope tell all sums
                        key = first + bins[use, c]
                        below, over = np.bincount(key, minlength=2 * shape[0] * BINS).reshape(shape[0], 2, BINS).transpose(1, 0, 2)
                        out[:, j, :, 0] = out[:, j, :, 2] = below + over
                        out[:, j, :, 1] = quantile * over + (quantile - 1) * below
                        continue
                    key = first + bins[use, c]
                    out[:, j, :, 0] = np.bincount(key, minlength=shape[0] * BINS).reshape(shape[0], BINS)
                    for k, weights in ((1, slope), (2, curve)):
                        out[:, j, :, k] = np.bincount(key, weights, shape[0] * BINS).reshape(shape[0], BINS)
                return np.append(out.ravel(), [loss.sum(), row.n])

            total = total_of(blocks, add, int(np.prod(shape)) + 2)
            if depth == 0:
                mean_loss = total[-2] / max(total[-1], 1)
            sums, after = total[:-2].reshape(shape), []
            for node, own in zip(active, sums):
                split = best_split(own, p["min_child_weight"])
                whole = own[0].sum(axis=0)
                tree.value[node] = whole[1] / (whole[2] + LEAF_WEIGHT)
                if split is None:
                    continue
                j, cut = split
                left = own[j, : cut + 1].sum(axis=0)
                for child, part in zip(tree.split(node, columns[j], cut), (left, whole - left)):
                    tree.value[child] = part[1] / (part[2] + LEAF_WEIGHT)
                    after.append(child)
            active = after
            if not active:
                break
        return tree, mean_loss


def _constant(value: float) -> Tree:
    tree = Tree()
    tree.value[0] = value
    return tree


def best_split(sums: np.ndarray, least: float) -> tuple[int, int] | None:
    """(feature, last bin to the left) of the largest gain for sums (feature, bin, [rows, slope, curvature])."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    whole = sums[0].sum(axis=0)
    right = whole - left
    gain = left[..., 1] ** 2 / (left[..., 2] + LEAF_WEIGHT) + right[..., 1] ** 2 / (right[..., 2] + LEAF_WEIGHT)
    gain -= whole[1] ** 2 / (whole[2] + LEAF_WEIGHT)
    usable = (left[..., 0] > 0) & (right[..., 0] > 0) & (left[..., 2] >= least) & (right[..., 2] >= least)
    gain = np.where(usable, gain, -np.inf)
    at = int(np.argmax(gain))
    if not gain.size or gain.ravel()[at] <= 1e-9:
        return None
    return divmod(at, gain.shape[1])


def median_splits(counts: np.ndarray, sums: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Absolute deviations when each feature is cut after each bin: (to the left, to the right, rows left, rows right).

    ``counts`` and ``sums`` (feature, bin, place) hold the rows and their targets, with the places in the order of the
    target, whose values are ``values``.
    """
    left, left_sum = (np.cumsum(np.cumsum(a, axis=1), axis=2) for a in (counts, sums))
    whole, whole_sum = left[:1, -1:], left_sum[:1, -1:]
    out = []
    for n, s in ((left, left_sum), (whole - left, whole_sum - left_sum)):
        total = n[..., -1]
        at = np.argmax(2 * n >= total[..., None], axis=2)
        below = np.take_along_axis(n, at[..., None], 2)[..., 0]
        below_sum = np.take_along_axis(s, at[..., None], 2)[..., 0]
        out += [s[..., -1] - 2 * below_sum + values[at] * (2 * below - total), total]
    return out[0], out[2], out[1], out[3]


def absolute_split(counts: np.ndarray, sums: np.ndarray, values: np.ndarray, leaf: int, split: int) -> tuple[int, int] | None:
    """(feature, last bin to the left) of the smallest absolute deviation, if that is below the node's own."""
    a, b, n, m = median_splits(counts, sums, values)
    if n[0, -1] < split:
        return None
    cost = np.where((n >= leaf) & (m >= leaf), a + b, np.inf)
    at = int(np.argmin(cost))
    if not cost.ravel()[at] < a[0, -1] - 1e-9 * max(1.0, abs(a[0, -1])):
        return None
    return divmod(at, cost.shape[1])


class MedianForest:
    """A forest of bootstrapped trees split on absolute error, with medians in the leaves."""

    def __init__(self, params: dict, seed: int = 42, block_rows: int = NODE_ROWS, bootstrap: bool = True):
        self.params, self.seed, self.block_rows, self.bootstrap = params, seed, block_rows, bootstrap

    def weights(self, row, trees: int) -> np.ndarray:
        """How often every row of a block is drawn for every tree."""
        if hasattr(row, "drawn"):
            return np.frombuffer(row.drawn, np.uint8).reshape(row.n, trees)
        out = np.ones((row.n, trees), np.uint8)
        if self.bootstrap:
            rng = np.random.default_rng([self.seed, row.block])
            for at in range(0, row.n, DRAW_ROWS):  # draws take eight bytes each
                part = out[at : at + DRAW_ROWS]
                part[:] = rng.poisson(1.0, part.shape)
        return out

    def fit(self, rows: DataFrame) -> BinnedModel:
        edges = bin_edges(rows)
        if not edges:
            return BinnedModel([], [], 0.0, 1.0)
        count = self.params["n_estimators"]
        blocks = blocks_of(rows, edges)
        trees = [Tree() for _ in range(count)]
        depth = {(t, 0): 0 for t in range(count)}
        rows_of = {(t, 0): int(n) for t, n in enumerate(self._root_rows(blocks, count))}
        if any(n > self.block_rows for n in rows_of.values()):
            blocks = self._drawn(blocks, count)
        done = self._split_large(blocks, trees, depth, rows_of, len(edges))
        self._large_values(blocks, trees, done)
        self._grow_small(blocks, trees, depth, done)
        return BinnedModel(edges, trees, 0.0, 1.0 / count)

    def _root_rows(self, blocks: Blocks, trees: int) -> np.ndarray:
        """Drawn rows of every tree."""
        return total_of(blocks, lambda row: self.weights(row, trees).sum(axis=0).astype(float), trees)

    def _drawn(self, blocks: Blocks, trees: int) -> Blocks:
        """Blocks that hold what is drawn of them, which every pass over large nodes needs."""

        def run(batches):
            for pdf in batches:
                for at in range(len(pdf)):  # a block at a time, for memory
                    part = pdf.iloc[at : at + 1]
                    yield part.assign(drawn=[self.weights(row, trees).tobytes() for row in part.itertuples(index=False)])

        drawn = blocks.frame.drop("score").mapInPandas(run, "block long, n long, bins binary, z binary, drawn binary")
        path = scratch_path(drawn.sparkSession, "drawn")
        drawn.write.option("maxRecordsPerFile", 1).parquet(path)  # readers take the rows of a file together
        return blocks._replace(frame=drawn.sparkSession.read.schema(drawn.schema).parquet(path), rows=None)

    def _split_large(self, blocks: Blocks, trees: list[Tree], depth: dict, rows: dict, width: int) -> list[tuple[int, int]]:
        """Split nodes of more than ``block_rows`` rows on sums over bins of the feature and of the target; the nodes
        of as many rows that stay leaves. ``rows`` holds the drawn rows of open nodes."""
        p, open_, done, targets = self.params, list(depth), [], None
        while open_:
            large = [x for x in open_ if rows[x] > self.block_rows and depth[x] < p["max_depth"]]
            done += [x for x in open_ if rows[x] > self.block_rows and depth[x] >= p["max_depth"]]
            if targets is None and large:
                targets = self._target_edges(blocks)
            open_ = []
            for at in range(0, len(large), JOB_NODES):  # a few nodes a job bound the size of its sums
                part = large[at : at + JOB_NODES]
                for i, split in enumerate(self._best_splits(blocks, trees, part, targets, width)):
                    t, node = part[i]
                    if split is None:
                        done.append((t, node))
                        continue
                    *cut, left = split
                    for child, own in zip(trees[t].split(node, *cut), (left, rows[t, node] - left)):
                        depth[t, child], rows[t, child] = depth[t, node] + 1, own
                        open_.append((t, child))
        return done

    def _best_splits(self, blocks: Blocks, trees: list[Tree], part: list[tuple[int, int]], targets: np.ndarray, width: int) -> list[tuple[int, int, int] | None]:
        """(feature, last bin to the left, drawn rows to the left) of some nodes (tree, node). Tasks add up their blocks;
        the sums of a node meet in one task, and only its split reaches the driver."""
        p, weights, shape, own = self.params, self.weights, (2, width, BINS, len(targets) + 1), {t: trees[t] for t, _ in part}

        def add(batches):
            sums = None
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    if sums is None:
                        sums = np.zeros((len(part), *shape))
                    bins, z = bins_of(row), np.frombuffer(row.z)
                    drawn, zbin, at = weights(row, len(trees)), np.searchsorted(targets, z, "left"), (None, None)
                    for out, (t, node) in zip(sums, part):
                        if at[0] != t:
                            at = t, own[t].leaves_of(bins)
                        use = np.flatnonzero((at[1] == node) & (drawn[:, t] > 0))
                        w, first = drawn[use, t].astype(float), zbin[use]
                        wz = w * z[use]
                        for j in range(width):
                            key = bins[use, j].astype(np.int64) * shape[3] + first
                            for k, x in enumerate((w, wz)):
                                out[k, j] += np.bincount(key, x, BINS * shape[3]).reshape(BINS, shape[3])
            if sums is not None:
                for i, out in enumerate(sums):
                    yield pd.DataFrame({"at": [i], "sums": [out.tobytes()]})

        def best(pdf):
            counts, sums = sum(np.frombuffer(x).reshape(shape) for x in pdf["sums"])
            n, s = counts[0].sum(axis=0), sums[0].sum(axis=0)
            values = np.where(n > 0, s / np.maximum(n, 1), 0.0)  # the mean target of each target bin
            split = absolute_split(counts, sums, values, p["min_samples_leaf"], p["min_samples_split"])
            if split is None:
                return pd.DataFrame({"at": [], "feature": [], "cut": [], "left": []}).astype("int64")
            return pd.DataFrame({"at": pdf["at"].iloc[:1], "feature": split[0], "cut": split[1], "left": int(counts[split[0], : split[1] + 1].sum())})

        made = spread(blocks.frame.mapInPandas(add, "at int, sums binary"), "at").groupBy("at")
        found = {r["at"]: (r["feature"], r["cut"], r["left"]) for r in made.applyInPandas(best, "at int, feature int, cut int, left long").collect()}
        return [found.get(i) for i in range(len(part))]

    def _large_values(self, blocks: Blocks, trees: list[Tree], done: list[tuple[int, int]]) -> None:
        """Exact medians of leaves whose rows are too many for one task."""
        if not done:
            return

        def value_of(row):
            bins, z, drawn = bins_of(row), np.frombuffer(row.z), self.weights(row, len(trees))
            leaf, value = [np.zeros(0, np.int64)], [np.zeros(0)]
            for i, (t, node) in enumerate(done):
                times = np.where(trees[t].leaves_of(bins) == node, drawn[:, t], 0)
                value.append(np.repeat(z, times))
                leaf.append(np.full(len(value[-1]), i))
            return np.concatenate(leaf), np.concatenate(value)

        for i, median in leaf_quantiles(blocks, value_of, 0.5).items():
            t, node = done[i]
            trees[t].value[node] = float(median)

    def _target_edges(self, blocks: Blocks) -> np.ndarray:
        """Upper edges of the target bins: exact quantiles."""
        value_of = lambda row: (np.zeros(row.n, np.int64), np.frombuffer(row.z))
        return np.unique(list(leaf_ranks(blocks, value_of, [k / TARGET_BINS for k in range(1, TARGET_BINS)]).values()))

    def _grow_small(self, blocks: Blocks, trees: list[Tree], depth: dict, done: list[tuple[int, int]]) -> None:
        """Bring the rows of every remaining leaf together and grow the rest of the tree there."""
        weights, p, large = self.weights, self.params, set(done)

        def deal(batches):
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    bins, z, drawn = bins_of(row), np.frombuffer(row.z), weights(row, len(trees))
                    for t, tree in enumerate(trees):
                        leaf, out = tree.leaves_of(bins), []
                        for node in np.unique(leaf):
                            use = (leaf == node) & (drawn[:, t] > 0)
                            if use.any() and (t, node) not in large:
                                out.append((t, int(node), int(use.sum()), bins[use].tobytes(), z[use].tobytes(), drawn[use, t].tobytes()))
                        yield pd.DataFrame(out, columns=["tree", "node", "n", "bins", "z", "drawn"])

        def grow(pdf):
            t, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
            n = int(pdf["n"].sum())
            bins = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(n, -1)
            z, drawn = np.frombuffer(b"".join(pdf["z"])), np.frombuffer(b"".join(pdf["drawn"]), np.uint8).astype(float)
            order = np.lexsort((*bins.T, z))
            tree = grow_exact(bins[order], z[order], drawn[order], p, depth[t, node])
            return pd.DataFrame({"tree": [t], "node": [node], **{k: [getattr(tree, k)] for k in ("feature", "cut", "left", "right", "value")}})

        dealt = blocks.frame.mapInPandas(deal, "tree int, node int, n int, bins binary, z binary, drawn binary")
        schema = "tree int, node int, feature array<int>, cut array<int>, left array<int>, right array<int>, value array<double>"
        for r in spread(dealt, "tree", "node").groupBy("tree", "node").applyInPandas(grow, schema).collect():
            _graft(trees[r["tree"]], r["node"], r)


def _graft(tree: Tree, node: int, grown) -> None:
    """Put a subtree in the place of a leaf."""
    places = {0: node}
    for i, (feature, cut) in enumerate(zip(grown["feature"], grown["cut"])):
        tree.value[places[i]] = grown["value"][i]
        if feature >= 0:
            places[grown["left"][i]], places[grown["right"][i]] = tree.split(places[i], feature, cut)


def exact_split(bins: np.ndarray, values: np.ndarray, weight: np.ndarray, leaf: int, split: int) -> tuple[int, int] | None:
    """The split of :func:`absolute_split` with every row a place of its own, for rows in the order of the target.

    Rows are cut into runs; sums per feature, bin and run tell in which run the median of each side lies, and only that
    run is looked at row by row. Splits that come within rounding of the best are then added up row after row.
    """
    n, width = bins.shape
    upto, upto_sum = np.cumsum(weight), np.cumsum(weight * values)
    total = upto[-1]
    if total < split:
        return None
    own = _deviation(upto, upto_sum, values)
    size = max(1, int(np.sqrt(n / 2)))  # rows a run
    runs = -(-n // size)
    left, left_sum = np.empty((2, width, BINS, runs))
    run_of, step = np.arange(n) // size, max(1, SPLIT_CELLS // n)
    for first in range(0, width, step):  # features at a time, for memory
        part = bins[:, first : first + step]
        key = (run_of[:, None] + runs * (part.astype(np.int64) + BINS * np.arange(part.shape[1]))).ravel()
        for out, w in ((left, weight), (left_sum, weight * values)):
            cells = np.bincount(key, np.repeat(w, part.shape[1]), part.shape[1] * BINS * runs).reshape(-1, BINS, runs)
            np.cumsum(np.cumsum(cells, axis=1), axis=2, out=out[first : first + step])
    n_left = left[..., -1]
    usable = (n_left >= leaf) & (total - n_left >= leaf) & (np.diff(n_left, axis=1, prepend=0) > 0)  # a cut after an empty bin is the one before
    feature, cut = np.nonzero(usable)
    if not len(feature):
        return None
    cost = np.zeros(len(feature))
    at_all, sum_all = left[0, -1], left_sum[0, -1]
    padded = runs * size - n
    place = np.arange(runs * size).reshape(runs, size)
    place[-1] = np.minimum(place[-1], n - 1)
    run_weight = np.append(weight, np.zeros(padded)).reshape(runs, size)
    by_feature = np.ascontiguousarray(bins.T)
    for side in (0, 1):
        for first in range(0, len(feature), step := max(1, (1 << 20) // (size + runs))):  # cuts at a time, for memory
            f, b = feature[first : first + step], cut[first : first + step]
            m, s = (left[f, b], left_sum[f, b]) if side == 0 else (at_all - left[f, b], sum_all - left_sum[f, b])
            whole, each = m[:, -1], np.arange(len(f))
            run = np.argmax(2 * m >= whole[:, None], axis=1)
            before, before_sum = (np.where(run > 0, x[each, run - 1], 0.0) for x in (m, s))
            rows = place[run]
            is_left = by_feature[f[:, None], rows] <= b[:, None]
            w = np.where(is_left if side == 0 else ~is_left, run_weight[run], 0.0)
            inside = np.cumsum(w, axis=1)
            at = np.argmax(2 * (before[:, None] + inside) >= whole[:, None], axis=1)
            below = before + inside[each, at]
            v = values[rows]
            below_sum = before_sum + np.cumsum(w * v, axis=1)[each, at]
            cost[first : first + step] += s[:, -1] - 2 * below_sum + v[each, at] * (2 * below - whole)
    near = np.flatnonzero(cost <= cost.min() + 1e-10 * max(1.0, np.abs(weight * values).sum()))
    best = None
    for i in near:
        goes = by_feature[feature[i]] <= cut[i]
        m, s = np.cumsum(np.where(goes, weight, 0.0)), np.cumsum(np.where(goes, weight * values, 0.0))
        exact = _deviation(m, s, values) + _deviation(upto - m, upto_sum - s, values)
        if best is None or exact < best[0]:
            best = (exact, int(feature[i]), int(cut[i]))
    if not best[0] < own - 1e-9 * max(1.0, abs(own)):
        return None
    return best[1:]


def _deviation(upto: np.ndarray, upto_sum: np.ndarray, values: np.ndarray) -> float:
    """Absolute deviation from the median, from rows and targets added up in the order of the target."""
    at = int(np.argmax(2 * upto >= upto[-1]))
    return upto_sum[-1] - 2 * upto_sum[at] + values[at] * (2 * upto[at] - upto[-1])


def grow_exact(bins: np.ndarray, z: np.ndarray, drawn: np.ndarray, params: dict, depth: int) -> Tree:
    """A tree over rows in the order of their target; every split is the best one, every leaf value a median."""
    tree, todo = Tree(), [(0, np.arange(len(z)), depth)]
    while todo:
        node, rows, level = todo.pop()
        values, weight = z[rows], drawn[rows]
        upto = np.cumsum(weight)
        tree.value[node] = float(values[np.argmax(2 * upto >= upto[-1])])
        if level >= params["max_depth"] or values[0] == values[-1]:
            continue
        best = exact_split(bins[rows], values, weight, params["min_samples_leaf"], params["min_samples_split"])
        if best is None:
            continue
        goes = bins[rows, best[0]] <= best[1]
        for child, part in zip(tree.split(node, *best), (rows[goes], rows[~goes])):
            todo.append((child, part, level + 1))
    return tree
