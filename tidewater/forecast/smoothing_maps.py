"""Additive exponential smoothing as a scan of affine maps.

With additive parts the state x (level, slope, seasons in the order of their next use) moves by
x' = A x + g y with the same A and g at every row, and the one-step error is y - h x. A run of rows is therefore one
map x -> A^n x + V, maps of neighbouring runs compose, and the errors of a run are known from its values and
the state before it. Blocks of a series are worked off in parallel: one pass gives the V of every block, a few
products per block give the state before each, a second pass the errors. Inside a block the values are taken in
chunks by matrix products, for all weights of the grid at once.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.forecast.gram import summed
from tidewater.operators.positions import SERIES, Y
from tidewater.session import cut_lineage, spread

CHUNK = 64
# Chunks taken by one product, for memory.
CHUNKS_AT_ONCE = 64
# Rows that hold the states of a whole grid and are handed on at once, for memory.
STATES_AT_ONCE = 64


def in_slices(batches, rows: int = STATES_AT_ONCE):
    """Batches cut to a few rows each."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


class Maps:
    """The matrices of one combination, period and grid of weights; the grid is the first axis of each."""

    def __init__(self, weights: np.ndarray, trend: bool, seasonal: bool, period: int, chunk: int):
        alpha, beta, gamma = weights
        self.chunk, self.points, self.size = chunk, len(alpha), 1 + trend + (period if seasonal else 0)
        first = 1 + trend  # place of the next season
        move, self.look = np.zeros((self.size, self.size)), np.zeros(self.size)
        move[0, 0] = self.look[0] = 1.0
        gain = np.zeros((self.points, self.size))
        gain[:, 0] = alpha
        if trend:
            move[0, 1] = move[1, 1] = self.look[1] = 1.0
            gain[:, 1] = alpha * beta
        if seasonal:
            self.look[first] = 1.0
            move[np.arange(first, self.size - 1), np.arange(first + 1, self.size)] = 1.0
            move[self.size - 1, first] = 1.0  # the season just used comes last
            gain[:, self.size - 1] += gamma
        self.step = move - gain[:, :, None] * self.look
        # Column i: what a value i rows before the end of a chunk adds to the state after it.
        answers = np.empty((self.points, self.size, chunk))
        looks = np.empty((self.points, chunk, self.size))
        answer, look = gain.copy(), np.broadcast_to(self.look, gain.shape).copy()
        for i in range(chunk):
            answers[:, :, chunk - 1 - i], looks[:, i] = answer, look
            answer = np.einsum("gij,gj->gi", self.step, answer)
            look = np.einsum("gj,gji->gi", look, self.step)
        self.answers, self.looks = answers, looks
        # Row i, column j: what the value of row j takes from the error of row i.
        impulse = np.einsum("j,gji->gi", self.look, answers)[:, ::-1]
        lag = np.subtract.outer(np.arange(chunk), np.arange(chunk)) - 1
        self.echo = np.where(lag >= 0, impulse[:, np.maximum(lag, 0)], 0.0)
        self.powers = {1: self.step}

    def power(self, exponent: int) -> np.ndarray:
        """A to a power of two."""
        if exponent not in self.powers:
            half = self.power(exponent // 2)
            self.powers[exponent] = half @ half
        return self.powers[exponent]

    def ahead(self, state: np.ndarray, rows: int) -> np.ndarray:
        """States (grid x size) moved on by this many rows without values."""
        bit = 1
        while bit <= rows:
            if rows & bit:
                state = np.einsum("gij,gj->gi", self.power(bit), state)
            bit <<= 1
        return state

    def run(self, y: np.ndarray, state: np.ndarray, errors: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(state after the values, sum of squared errors) of every grid point."""
        sse, whole = np.zeros(self.points), len(y) // self.chunk
        through = self.power(self.chunk) if self.chunk & (self.chunk - 1) == 0 else None
        for begin in range(0, whole, CHUNKS_AT_ONCE):
            part = y[begin * self.chunk : min(begin + CHUNKS_AT_ONCE, whole) * self.chunk].reshape(-1, self.chunk)
            added = self.answers @ part.T
            before = np.empty((self.points, self.size, len(part)))
            for k in range(len(part)):
                before[:, :, k] = state
                moved = np.einsum("gij,gj->gi", through, state) if through is not None else self.ahead(state, self.chunk)
                state = moved + added[:, :, k]
            if errors:
                left = part.T - self.echo @ part.T - self.looks @ before
                sse += (left * left).sum(axis=(1, 2))
        tail = y[whole * self.chunk :]
        if len(tail):
            if errors:
                left = tail - self.echo[:, : len(tail), : len(tail)] @ tail - np.einsum("gri,gi->gr", self.looks[:, : len(tail)], state)
                sse += (left * left).sum(axis=1)
            state = self.ahead(state, len(tail)) + self.answers[:, :, self.chunk - len(tail) :] @ tail
        return state, sse


def blocks_of(train: DataFrame, block_rows: int) -> DataFrame:
    """``series_id, period, block, y, last_row``: the values of every block in order, and the number of its last row."""
    block = F.floor(F.col("rn") / block_rows).alias("block")
    own = F.sort_array(F.collect_list(F.struct("rn", Y)))
    rows = train.select(SERIES, "period", "rn", Y, block)
    blocks = rows.groupBy(SERIES, "period", "block").agg(F.transform(own, lambda s: s[Y]).alias("y"), F.max("rn").alias("last_row"))
    return blocks.select(SERIES, "period", "block", "y", "last_row")


def additive_states(train: DataFrame, combos: dict[int, tuple], grids: dict[int, np.ndarray], start, block_rows: int) -> DataFrame:
    """(series_id, variation, period, level, slope, season, sse, point) of the best grid point of every combination.

    ``combos`` maps variations to (trend, seasonal), each "add" or None, ``grids`` to their weights; ``start`` gives
    (level, slope, seasons) of a series from the values of its first block, or None.
    """
    chunk = gcd(block_rows, CHUNK)
    blocks = cut_lineage(spread(blocks_of(train, block_rows), SERIES, "block"))
    made: dict[tuple, Maps] = {}  # of a task: the matrices are the same for all its series of one period

    def maps(v, period):
        trend, seasonal = combos[v]
        key = (v, period if seasonal else 1)
        if key not in made:
            made[key] = Maps(grids[v], trend is not None, seasonal is not None, key[1], chunk)
        return made[key]

    def begun(v, period, y, m):
        first = start(y, *combos[v], period)
        if first is None:
            return None
        trend, seasonal = combos[v]
        x = np.concatenate([[first[0]], [first[1]] if trend else [], first[2] if seasonal else []])
        return np.tile(x, (m.points, 1))

    last = blocks.agg(F.max("block")).first()[0] or 0
    given = blocks.withColumn("state", F.lit(None).cast("array<double>")).withColumn("variation", F.explode(F.array(*[F.lit(v) for v in combos])))
    if last:
        given = _with_states(blocks, given, maps, begun, block_rows, list(combos))

    def scored(batches):
        for pdf in in_slices(batches):
            out = []
            for row in pdf.itertuples(index=False):
                m, y = maps(row.variation, row.period), np.asarray(row.y, dtype=float)
                if row.block == 0:
                    state = begun(row.variation, row.period, y, m)
                else:
                    state = None if row.state is None else np.asarray(row.state, dtype=float).reshape(m.points, m.size)
                if state is not None:
                    with np.errstate(all="ignore"):
                        state, sse = m.run(y, state)
                    out.append((row.series_id, row.variation, row.period, int(row.block), int(row.last_row) + 1, sse, state.ravel()))
            yield pd.DataFrame(out, columns=[SERIES, "variation", "period", "block", "seen", "sse", "state"])

    schema = f"{SERIES} string, variation int, period int, block long, seen long, sse array<double>, state array<double>"
    if last:  # the errors of all blocks, the state of the last
        passed = cut_lineage(given.mapInPandas(scored, schema))
        keys = [SERIES, "variation", "period"]
        ends = passed.groupBy(*keys).agg(F.max_by("state", "block").alias("state"), F.max("seen").alias("seen"))
        passed = summed(passed.select(*keys, "sse"), keys, "sse").join(ends, keys)

    def best(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                sse = np.asarray(row.sse, dtype=float)
                if not np.isfinite(sse).any():
                    continue
                point = int(np.nanargmin(np.where(np.isfinite(sse), sse, np.nan)))
                trend, seasonal = combos[row.variation]
                x = np.asarray(row.state, dtype=float).reshape(len(sse), -1)[point]
                seasons = np.roll(x[1 + (trend is not None) :], row.seen % row.period) if seasonal else np.zeros(0)
                out.append((row.series_id, row.variation, row.period, x[0], x[1] if trend else 0.0, seasons.tolist(), sse[point], point))
            yield pd.DataFrame(out, columns=[SERIES, "variation", "period", "level", "slope", "season", "sse", "point"])

    found = f"{SERIES} string, variation int, period int, level double, slope double, season array<double>, sse double, point int"
    if last:
        return passed.mapInPandas(best, found)
    return given.mapInPandas(lambda batches: best(scored(batches)), found)  # states of whole grids do not leave the task


def _with_states(blocks: DataFrame, given: DataFrame, maps, begun, block_rows: int, variations: list[int]) -> DataFrame:
    """Every block with the state before it: what each block adds, from a pass over all, then composed per series."""

    def added(batches):
        for pdf in in_slices(batches):
            out = []
            for row in pdf.itertuples(index=False):
                y = np.asarray(row.y, dtype=float)
                for v in variations:
                    m = maps(v, row.period)
                    # the first block starts from its own values, the others from nothing
                    state = begun(v, row.period, y, m) if row.block == 0 else np.zeros((m.points, m.size))
                    if state is not None:
                        with np.errstate(all="ignore"):
                            out.append((row.series_id, v, row.period, int(row.block), m.run(y, state, errors=False)[0].ravel()))
            yield pd.DataFrame(out, columns=[SERIES, "variation", "period", "block", "state"])

    schema = f"{SERIES} string, variation int, period int, block long, state array<double>"
    full = blocks.where(F.size("y") == block_rows)

    def composed(pdf):
        pdf = pdf.sort_values("block")
        if pdf["block"].iloc[0] != 0:
            return pdf.iloc[:0]
        m = maps(int(pdf["variation"].iloc[0]), int(pdf["period"].iloc[0]))
        out, state = [], None
        with np.errstate(all="ignore"):
            for part in pdf["state"]:
                own = np.asarray(part, dtype=float).reshape(m.points, m.size)
                state = own if state is None else m.ahead(state, block_rows) + own
                out.append(state.ravel().tolist())
        return pdf.assign(state=out, block=pdf["block"] + 1)

    before = full.mapInPandas(added, schema).groupBy(SERIES, "variation").applyInPandas(composed, schema)
    return given.drop("state").join(before.drop("period"), [SERIES, "variation", "block"], "left")
