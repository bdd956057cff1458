"""Product codes of vectors: Lloyd's rounds over trees of parts and of entries.

Vectors become integers and are cut into equal parts; each part position has a codebook. A task keeps
its vectors in blocks and builds a tree over the parts of every block and position: each split is at the
median of the widest component, so a node is a run of neighbouring rows with a box and a cached sum.
A second tree is built over the entries of the codebook. Assigning descends both trees at once: a
pair of nodes goes on only while the least distance between the two boxes is not above the smallest
greatest distance known for the node of parts. A node of parts left with a single entry hands its
cached sum and count over whole; leaves that stay uncertain compare their parts one by one. All
distances, bounds and sums are integers, so the assignment is exact and ties go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import attach_by_key
from tidewater.session import cut_lineage

SCALE = 256
# Integers beyond this have squared distances that don't fit a long.
LARGEST = 1 << 26
# Components of the vectors of a block, and parts of a leaf.
BLOCK_COMPONENTS = 1 << 19
LEAF = 16


class Boxes:
    """A tree over integer points: ``order`` sorts them so that every node is a run of rows.

    ``levels`` holds the bounds of the runs from the root down, each run halved in the next level.
    """

    def __init__(self, points: np.ndarray, leaf: int, order: np.ndarray | None = None):
        n = len(points)
        self.levels = [np.array([0, n])]
        while np.diff(self.levels[-1]).max() > leaf:
            edges = self.levels[-1]
            middle = (edges[:-1] + edges[1:]) // 2
            self.levels.append(np.stack([np.append(edges[:-1], n), np.append(middle, n)], axis=1).ravel()[:-1])
        self.order = self._sort(points) if order is None else order
        self.points = points[self.order]
        self.low, self.high = [], []
        for edges in reversed(self.levels):  # a node's box from its children's
            runs = edges[:-1]
            if not self.low:
                low, high = np.minimum.reduceat(self.points, runs), np.maximum.reduceat(self.points, runs)
            else:
                low = np.minimum(self.low[-1][0::2], self.low[-1][1::2])
                high = np.maximum(self.high[-1][0::2], self.high[-1][1::2])
            self.low.append(low)
            self.high.append(high)
        self.low.reverse()
        self.high.reverse()

    def _sort(self, points: np.ndarray) -> np.ndarray:
        order = np.arange(len(points))
        for edges in self.levels[:-1]:
            own = points[order]
            runs = edges[:-1]
            spread = np.maximum.reduceat(own, runs) - np.minimum.reduceat(own, runs)
            node = np.repeat(np.arange(len(runs)), np.diff(edges))
            value = own[np.arange(len(own)), spread.argmax(axis=1)[node]]
            order = order[np.lexsort((value, node))]
        return order


def assign(tree: Boxes, book: np.ndarray, own: Boxes) -> tuple[np.ndarray, list]:
    """Nearest entry of every point in tree order, and the whole nodes given to one entry as (start, end, entry).

    ``own`` is the tree over the entries of ``book``, with single entries as leaves. The points that no whole
    node covers are compared with the entries left for their leaf.
    """
    n = len(tree.points)
    entry = np.full(n, -1, np.int64)
    whole: list = []
    # Pairs of a node of points and a node of entries, both named by their place in their level.
    at, e_level = 0, 0
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    last_p, last_e = len(tree.levels) - 1, len(own.levels) - 1
    name = own.order[own.levels[last_e][:-1]]  # of the leaves; empty ones are never visited
    while True:
        low, high = tree.low[at][p], tree.high[at][p]
        e_low, e_high = own.low[e_level][e], own.high[e_level][e]
        gap = np.maximum(np.maximum(e_low - high, low - e_high), 0)
        reach = np.maximum(high - e_low, e_high - low)
        least, most = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
        bound = np.full(len(tree.levels[at]) - 1, np.iinfo(np.int64).max)
        np.minimum.at(bound, p, most)
        keep = least <= bound[p]
        p, e = p[keep], e[keep]
        if e_level == last_e:
            left = np.bincount(p, minlength=len(bound))
            single = left[p] == 1
            edges = tree.levels[at]
            for node, leaf in zip(p[single], e[single]):
                entry[edges[node] : edges[node + 1]] = name[leaf]
                whole.append((edges[node], edges[node + 1], name[leaf]))
            p, e = p[~single], e[~single]
        if not len(p) or (at == last_p and e_level == last_e):
            break
        # Split the side whose boxes are wider, so that bounds tighten on both.
        if at == last_p or (e_level < last_e and _extent(own, e_level, e) > _extent(tree, at, p)):
            e_level += 1
            empty = np.diff(own.levels[e_level]) == 0
            p, e = np.repeat(p, 2), np.stack([2 * e, 2 * e + 1], axis=1).ravel()
            p, e = p[~empty[e]], e[~empty[e]]
        else:
            at += 1
            p, e = np.stack([2 * p, 2 * p + 1], axis=1).ravel(), np.repeat(e, 2)
    if len(p):
        _compare(tree, at, p, name[e], book, entry)
    return entry, whole


def _extent(tree: Boxes, level: int, nodes: np.ndarray) -> float:
    return float((tree.high[level][nodes] - tree.low[level][nodes]).max(axis=1).mean())


def _compare(tree: Boxes, level: int, p: np.ndarray, e: np.ndarray, book: np.ndarray, entry: np.ndarray) -> None:
    """Exact integer distances of the points of uncertain leaves to the entries left for them."""
    edges = tree.levels[level]
    size = edges[p + 1] - edges[p]
    total = int(size.sum())
    pair = np.repeat(np.arange(len(p)), size)
    row = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + edges[p][pair]
    gap = tree.points[row] - book[e[pair]]
    distance = (gap * gap).sum(axis=1)
    order = np.lexsort((e[pair], distance, row))
    first = order[np.append(True, row[order][1:] != row[order][:-1])]
    entry[row[first]] = e[pair][first]


def _blocks(rows: DataFrame, parts: int, size: int) -> DataFrame:
    """The usable vectors in blocks: ids, labels, and per part position the tree's order and the sorted parts."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    width = size // parts
    most = max(LEAF, BLOCK_COMPONENTS // size)

    def block(held):
        ids, labels, vectors = zip(*held)
        table = pa.Table.from_arrays([pa.chunked_array(ids), pa.chunked_array(labels)], names=["id", "label"]).combine_chunks()
        whole = np.concatenate(vectors)
        sorted_parts, orders = [], []
        for k in range(parts):
            tree = Boxes(whole[:, k * width : (k + 1) * width], LEAF)
            orders.append(tree.order.astype(np.int32).tobytes())
            sorted_parts.append(tree.points.astype(np.int32).tobytes())
        values = [table.column("id").to_pylist(), table.column("label").to_pylist(), orders, sorted_parts]
        types = [pa.list_(table.schema.field("id").type), pa.list_(table.schema.field("label").type), pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["ids", "labels", "orders", "parts"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            whole = np.floor(SCALE * flat).astype(np.int64)
            for begin in range(0, batch.num_rows, most):
                rows = slice(begin, min(begin + most, batch.num_rows))
                count = rows.stop - rows.start
                if n + count > most:
                    yield block(held)
                    held, n = [], 0
                held.append((batch.column("id").slice(begin, count), batch.column("label").slice(begin, count), whole[rows]))
                n += count
        if held:
            yield block(held)

    schema = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, orders array<binary>, parts array<binary>"
    return rows.mapInArrow(run, schema)


def _trees(row_parts: list, row_orders: list, width: int) -> Iterator[Boxes]:
    for points, order in zip(row_parts, row_orders):
        sorted_points = np.frombuffer(points, np.int32).reshape(-1, width).astype(np.int64)
        tree = Boxes(sorted_points, LEAF, np.arange(len(sorted_points)))
        tree.order = np.frombuffer(order, np.int32)
        yield tree


def _new_books(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books after one round: every entry the componentwise floor of the mean of its parts."""
    parts, entries, width = books.shape

    def run(batches):
        own = [Boxes(book, 1) for book in books]
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for k, tree in enumerate(_trees(row["parts"], row["orders"], width)):
                    entry, whole = assign(tree, books[k], own[k])
                    cached = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(tree.points, axis=0)])
                    if whole:
                        start, end, name = (np.array(x) for x in zip(*whole))
                        np.add.at(sums[k], name, cached[end] - cached[start])
                        np.add.at(counts[k], name, end - start)
                        done = np.zeros(len(entry) + 1, np.int64)
                        np.add.at(done, start, 1)
                        np.add.at(done, end, -1)
                        rest = np.flatnonzero(np.cumsum(done)[:-1] == 0)
                    else:
                        rest = np.arange(len(entry))
                    np.add.at(sums[k], entry[rest], tree.points[rest])
                    np.add.at(counts[k], entry[rest], 1)
        k, j = np.nonzero(counts)
        if len(k):
            yield pa.RecordBatch.from_arrays(
                [pa.array(k, pa.int32()), pa.array(j, pa.int32()), pa.array(counts[k, j]), pa.array(list(sums[k, j]), pa.list_(pa.int64()))],
                names=["part", "entry", "n", "sums"],
            )

    partial = blocks.select("parts", "orders").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    exact = F.sum(F.col("value").cast("decimal(38,0)"))
    components = partial.select("part", "entry", "n", F.posexplode("sums").alias("at", "value"))
    total = components.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), exact.alias("total"))
    after = books.copy()
    for row in total.collect():  # parts x entries x components of a part at most
        after[row["part"], row["entry"], row["at"]] = int(row["total"]) // row["n"]
    return after


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2
) -> tuple[DataFrame, np.ndarray]:
    """(one row ``id, label, code, error`` per usable vector, the codebooks as parts x entries x components).

    A component x counts as floor(256 x). The books start as the parts of the ``entries`` smallest ids
    (equal ids: the smaller vector; null ids come last) and are replaced in ``rounds`` rounds; entries
    without parts stay. The code names the nearest entry of every part with two hex digits each, equal
    distances going to the lower entry; ``error`` is the sum of the squared distances.

    Left out are vectors that are null, hold null or non-finite components or components of 262,144 or
    more in size (their squared distances don't fit a long), and those of another length than the
    smallest usable id has; that length must be a multiple of ``parts``. With fewer vectors than
    entries the books are shorter. Repeated rows count again; an empty table gives no rows and no books.
    """
    if entries > 256:
        raise ValueError("two hex digits name at most 256 entries")
    v = F.col("vector")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST // SCALE))
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vector")
    ).filter(sound)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries)
    smallest = [r[0] for r in first.collect()]
    size = len(smallest[0]) if smallest else parts
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    usable = rows.filter(F.size(v) == size)
    if any(len(x) != size for x in smallest):
        smallest = [r[0] for r in usable.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()]
    start = np.floor(SCALE * np.array(smallest, float).reshape(-1, parts, size // parts)).astype(np.int64)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    blocks = cut_lineage(_blocks(usable, parts, size))
    if smallest:
        for _ in range(rounds):
            books = _new_books(blocks, books)
    width = size // parts

    def run(batches):
        own = [Boxes(book, 1) for book in books] if smallest else []
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                code, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for k, tree in enumerate(_trees(batch.column("parts")[i].as_py(), batch.column("orders")[i].as_py(), width)):
                    entry, _ = assign(tree, books[k], own[k])
                    gap = tree.points - books[k][entry]
                    code[tree.order, k] = entry
                    error[tree.order] += (gap * gap).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in code]), pa.array(error)], names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = blocks.select("ids", "labels", "orders", "parts").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    return cut_lineage(coded), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the errors of all rows of the same label, null labels together."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    return attach_by_key(coded, sums, "label", "rows")
