"""Cross-product sums per group: the only thing a least-squares fit needs from the rows.

Every task adds up x'x of its own rows in NumPy, Spark adds the partial sums element by element, and
the small solves run on one row per group. A hot group is spread over all tasks that hold its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Groups a task holds before it hands their partial sums on; bounds its memory.
HELD_GROUPS = 2048
# Rows that groups worked on side by side may fill, missing rows of shorter ones included.
STACK_ROWS = 32_768


def group_positions(pdf: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    for key, where in pdf.groupby(keys, sort=False).indices.items():
        yield (key if isinstance(key, tuple) else (key,)), where


def stacks(starts: np.ndarray, rows: int, limit: int = STACK_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of like size, as many as fit the limit at a time: (numbers of the groups, their rows with one line per group).

    Group i has the rows from starts[i] up to the next start; lines are filled up with the number of rows in all, which
    should be the place of an empty row.
    """
    sizes = np.diff(np.append(starts, rows))
    order, at = np.argsort(sizes, kind="stable"), 0
    while at < len(order):
        count = 1  # sizes ascend: the last group of a stack is its longest
        while at + count < len(order) and sizes[order[at + count]] * (count + 1) <= limit:
            count += 1
        own, longest = order[at : at + count], sizes[order[at + count - 1]]
        places = np.arange(longest)
        yield own, np.where(places < sizes[own, None], starts[own, None] + places, rows)
        at += count


def group_starts(*keys) -> np.ndarray:
    """Where a new group begins in sorted columns of keys."""
    changed = np.ones(len(keys[0]), dtype=bool)
    changed[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in map(np.asarray, keys)])
    return np.flatnonzero(changed)


def summed(partials: DataFrame, keys: list[str], column: str = "gram", peaks: int = 0) -> DataFrame:
    """Element-wise sum of an array column per key, with map-side combine; its last ``peaks`` entries are largest values."""
    vector = array_to_vector(column)
    total = vector_to_array(Summarizer.sum(vector))
    if not peaks:
        return partials.groupBy(*keys).agg(total.alias(column))
    both = partials.groupBy(*keys).agg(total.alias("_sum"), vector_to_array(Summarizer.max(vector)).alias("_max"))
    cut = F.size("_sum") - peaks
    return both.select(*keys, F.concat(F.slice("_sum", F.lit(1), cut), F.slice("_max", cut + 1, F.lit(peaks))).alias(column))


def partial_sums(
    rows: DataFrame, keys: list[str], payload: Callable[[pd.DataFrame], np.ndarray], peaks: int = 0
) -> DataFrame:
    """Sum ``payload(rows of one group)`` (a flat array) over all rows of every group; of its last ``peaks``
    entries the largest is kept."""
    schema = T.StructType(
        [rows.schema[k] for k in keys] + [T.StructField("gram", T.ArrayType(T.DoubleType()))]
    )

    def merged(a, b):
        out = a + b
        if peaks:
            out[-peaks:] = np.maximum(a[-peaks:], b[-peaks:])
        return out

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, where in group_positions(pdf, keys):
                part = payload(pdf.iloc[where])
                held[key] = merged(held[key], part) if key in held else part
            if len(held) > HELD_GROUPS:
                yield held_frame(held, keys)
                held = {}
        if held:
            yield held_frame(held, keys)

    return summed(rows.mapInPandas(run, schema), keys, peaks=peaks)


def stacked_sums(rows: DataFrame, keys: list[str], payload: Callable[[pd.DataFrame, np.ndarray], np.ndarray]) -> DataFrame:
    """:func:`partial_sums` for a payload that takes all groups of a batch at once: (rows in the order of their groups,
    where each group starts) -> one line of sums per group."""
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("gram", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            codes = pdf.groupby(keys, sort=False).ngroup().to_numpy()
            order = np.argsort(codes, kind="stable")
            order = order[codes[order] >= 0]
            if len(order):
                grouped, starts = pdf.iloc[order], group_starts(codes[order])
                out = grouped[keys].iloc[starts].reset_index(drop=True)
                out["gram"] = list(payload(grouped, starts))
                yield out

    return summed(rows.mapInPandas(run, schema), keys)


def held_frame(held: dict[tuple, np.ndarray], keys: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(list(held), columns=keys)
    out["gram"] = [v.tolist() for v in held.values()]
    return out


def cross_products(x: np.ndarray) -> np.ndarray:
    """x'x of the rows without a missing value, flattened."""
    x = x[~np.isnan(x).any(axis=1)]
    return (x.T @ x).ravel()


def cross_products_of(x: np.ndarray, lines: list[tuple[np.ndarray, np.ndarray]], groups: int) -> np.ndarray:
    """:func:`cross_products` of every group, one a line, for groups laid out by :func:`stacks`."""
    x = np.where(np.isnan(x).any(axis=1)[:, None], 0.0, x)
    x, out = np.append(x, np.zeros((1, x.shape[1])), axis=0), np.empty((groups, x.shape[1] ** 2))
    for own, places in lines:
        part = x[places]
        out[own] = (part.transpose(0, 2, 1) @ part).reshape(len(own), -1)
    return out


def square(flat, width: int) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(width, width)


def solve_sym(a: np.ndarray, b: np.ndarray, rcond: float = 1e-10) -> np.ndarray:
    """Least-norm solution of a symmetric system after scaling its diagonal to one."""
    d = np.sqrt(np.clip(np.diag(a), 0.0, None))
    d[d == 0] = 1.0
    return (np.linalg.pinv(a / np.outer(d, d), rcond=rcond, hermitian=True) @ (b / d)) / d


def solve_many(a: np.ndarray, b: np.ndarray, rcond: float = 1e-10) -> np.ndarray:
    """:func:`solve_sym` of a stack of systems."""
    d = np.sqrt(np.clip(np.diagonal(a, axis1=1, axis2=2), 0.0, None))
    d[d == 0] = 1.0
    inverse = np.linalg.pinv(a / (d[:, :, None] * d[:, None, :]), rcond=rcond, hermitian=True)
    return (inverse @ (b / d)[..., None])[..., 0] / d


def _unit_diagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.sqrt(np.clip(np.diagonal(a, axis1=1, axis2=2), 0.0, None))
    d[d == 0] = 1.0
    return a / (d[:, :, None] * d[:, None, :]), d


def flat_directions(a: np.ndarray, rcond: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(a direction in which a system is flat, zeros if there is none; whether there is at most one) for a stack of systems.

    Columns that depend on each other do so whatever the weights of the rows.
    """
    scaled, d = _unit_diagonal(a)
    values, vectors = np.linalg.eigh(scaled)
    small = np.abs(values) <= rcond * np.max(np.abs(values), axis=1, keepdims=True)
    first = np.take_along_axis(vectors, np.argmax(small, axis=1)[:, None, None], 2)[..., 0]
    return np.where(small.any(axis=1)[:, None], first / d, 0.0), small.sum(axis=1) <= 1


def solve_again(a: np.ndarray, b: np.ndarray, flat: np.ndarray, simple: np.ndarray, rcond: float = 1e-10) -> np.ndarray:
    """:func:`solve_many` of systems whose :func:`flat_directions` are known from other weights of the same rows.

    With the flat direction lifted a system is inverted as it is. That gives the least-norm solution if the direction
    is flat here too and no other comes near the limit of being flat; the remaining systems go the long way.
    """
    scaled, d = _unit_diagonal(a)
    u = flat * d
    u /= np.maximum(np.sqrt(np.sum(u * u, axis=1, keepdims=True)), 1e-300)
    try:
        inverse = np.linalg.inv(scaled + u[:, :, None] * u[:, None, :])
    except np.linalg.LinAlgError:
        return solve_many(a, b, rcond)
    left = np.sqrt(np.sum((scaled @ u[..., None]) ** 2, axis=(1, 2)))
    largest = np.sqrt(np.max(np.sum(scaled**2, axis=2), axis=1))  # at most the largest eigenvalue, at least one
    u = (inverse @ u[..., None])[..., 0]  # a penalty tilts the direction
    u /= np.maximum(np.sqrt(np.sum(u * u, axis=1, keepdims=True)), 1e-300)
    right = b / d
    right -= u * np.sum(u * right, axis=1, keepdims=True)
    out = (inverse @ right[..., None])[..., 0]
    out -= u * np.sum(u * out, axis=1, keepdims=True)
    out /= d
    sure = simple & (np.sum(inverse**2, axis=(1, 2)) <= 1e16) & (left <= 0.5 * rcond * largest)
    if not sure.all():
        out[~sure] = solve_many(a[~sure], b[~sure], rcond)
    return out


def centred(gram: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, column means, centred cross products) of a gram matrix whose first column is constant."""
    n = gram[0, 0]
    means = gram[0, 1:] / n
    return n, means, gram[1:, 1:] - n * np.outer(means, means)
