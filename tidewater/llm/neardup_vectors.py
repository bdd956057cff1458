"""Embedding near-duplicates: Euclidean p-stable hashing of unit vectors, then exact cosines."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bound_batches, components, forest
from tidewater.session import cut_lineage

TILE = 1024
_LINK = "t int, key bigint, no bigint, cid bigint, n bigint, root bigint, payload binary"


def collision(distance: float, width: float) -> float:
    """Probability that one quantised Gaussian projection agrees for two points at this distance."""
    c = width / distance
    tail = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def settings(n: int, threshold: float, width: float = 2.0, miss: float = 0.005, fill: int = 512) -> tuple[int, int]:
    """Projections per table and number of tables for ``n`` vectors.

    The projections keep the expected number of unrelated (orthogonal) vectors in a bucket at
    ``fill``; the tables keep the chance of missing a pair exactly at the threshold under ``miss``.
    """
    near, far = collision(math.sqrt(2 - 2 * threshold), width), collision(math.sqrt(2), width)
    k = max(2, math.ceil(math.log(max(n, 2) / fill) / math.log(1 / far)))
    return k, math.ceil(math.log(miss) / math.log(1 - near**k))


def _projections(size: int, k: int, tables: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, size])
    return rng.normal(size=(size, k * tables)), rng.uniform(0, width, k * tables)


def table_keys(unit: np.ndarray, k: int, tables: int, width: float, seed: int) -> np.ndarray:
    """Bucket keys (rows x tables) of unit vectors; vectors of other sizes get other keys."""
    a, b = _projections(unit.shape[1], k, tables, width, seed)
    cells = np.floor((unit @ a + b) / width).astype(np.int64).reshape(len(unit), tables, k)
    mixed = np.full((len(unit), tables), unit.shape[1], dtype=np.uint64)
    for j in range(k):
        mixed = (mixed ^ cells[:, :, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def _classes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """One row per distinct usable vector: ``cid, emb, low`` (smallest id) and ``weight`` (rows)."""
    v = F.col("emb")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("emb"))
    grouped = rows.filter(usable).groupBy("emb").agg(F.min("id").alias("low"), F.count("*").alias("weight"))
    return cut_lineage(grouped.select(F.monotonically_increasing_id().alias("cid"), "emb", "low", "weight"))


def _buckets(classes: DataFrame, k: int, tables: int, width: float, seed: int) -> DataFrame:
    """A row per class and table; the payload is the class weight, all its keys and its vector."""

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column("emb").offsets.to_numpy())
            flat = batch.column("emb").flatten().to_numpy()
            ends = np.cumsum(sizes)
            cid, weight = batch.column("cid").to_numpy(), batch.column("weight").to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                raw = flat[(ends[rows] - size)[:, None] + np.arange(size)]
                keys = table_keys(_unit(raw), k, tables, width, seed)
                load = [
                    np.concatenate([weight[r : r + 1].view(np.uint8), keys[i].view(np.uint8), raw[i].view(np.uint8)]).tobytes()
                    for i, r in enumerate(rows)
                ]
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), t, np.int32)), pa.array(np.ascontiguousarray(keys[:, t])), pa.array(cid[rows]), pa.array(load, pa.binary())],
                        names=["t", "key", "cid", "payload"],
                    )

    return classes.select("cid", "emb", "weight").mapInArrow(run, "t int, key bigint, cid bigint, payload binary")


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)  # no overflow in the squares
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Tile:
    """Some members of one bucket."""

    def __init__(self, cid: np.ndarray, payload: list, tables: int):
        rows = np.frombuffer(b"".join(payload), np.uint8).reshape(len(payload), -1)
        self.cid = cid
        self.weight = np.ascontiguousarray(rows[:, :8]).view(np.int64).ravel()
        self.keys = np.ascontiguousarray(rows[:, 8 : 8 + 8 * tables]).view(np.int64).reshape(len(payload), tables)
        self.unit = _unit(np.ascontiguousarray(rows[:, 8 + 8 * tables :]).view(np.float64).reshape(len(payload), -1))


def compare(a: Tile, b: Tile, t: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New links of two tiles of a bucket of table ``t``: class ids, links added to each, local root.

    A pair that also meets in an earlier table was counted there and is passed over here.
    """
    same = a is b
    i, j = np.nonzero(a.unit @ b.unit.T >= threshold - 1e-9)
    keep = (i < j) if same else a.cid[i] != b.cid[j]
    i, j = i[keep], j[keep]
    for earlier in range(t):
        if not len(i):
            break
        apart = a.keys[i, earlier] != b.keys[j, earlier]
        i, j = i[apart], j[apart]
    exact = np.einsum("ij,ij->i", a.unit[i], b.unit[j]) >= threshold
    i, j = i[exact], j[exact]
    cid = a.cid if same else np.concatenate([a.cid, b.cid])
    j_at = j if same else j + len(a.cid)
    weight = a.weight if same else np.concatenate([a.weight, b.weight])
    n = np.bincount(i, weight[j_at], len(cid)) + np.bincount(j_at, weight[i], len(cid))
    label = forest(len(cid), i, j_at)
    hit = np.flatnonzero(n)
    return cid[hit], n[hit].astype(np.int64), cid[label[hit]]


def _link_batch(t: int, found) -> pa.RecordBatch:
    cid, n, root = found
    empty = pa.nulls(len(cid), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(cid), t, np.int32)), empty, empty, pa.array(cid), pa.array(n), pa.array(root), pa.nulls(len(cid), pa.binary())],
        names=["t", "key", "no", "cid", "n", "root", "payload"],
    )


def _within(buckets: DataFrame, tables: int, threshold: float) -> DataFrame:
    """Links inside tiles of at most 1024 members, and the tiles of buckets that have several."""

    def run(batches):
        counter = TaskContext.get().partitionId() << 32
        held, bucket, tiles = [], None, 0  # rows of the open bucket, its name, its sealed tiles

        def seal(open_):
            nonlocal counter
            cid, load = np.array([c for c, _ in held], np.int64), [p for _, p in held]
            tile = Tile(cid, load, tables)
            yield _link_batch(bucket[0], compare(tile, tile, bucket[0], threshold))
            if open_:
                counter += 1
                values = [[bucket[0]], [bucket[1]], [counter], [None], [len(cid)], [None], [cid.tobytes() + b"".join(load)]]
                types = [pa.int32()] + [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, x) for v, x in zip(values, types)], names=["t", "key", "no", "cid", "n", "root", "payload"]
                )

        first = True
        for batch in batches:
            for t, key, cid, load in zip(*(batch.column(c).to_pylist() for c in ("t", "key", "cid", "payload"))):
                if bucket != (t, key):
                    if held:
                        yield from seal(first or tiles > 0)
                        first = False
                    held, bucket, tiles = [], (t, key), 0
                elif len(held) == TILE:
                    yield from seal(True)
                    held, tiles = [], tiles + 1
                held.append((cid, load))
        if held:
            yield from seal(True)

    order = ["t", "key", "cid"]
    return buckets.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _LINK)


def _across(tiles: DataFrame, tables: int, threshold: float) -> DataFrame:
    """Links between different tiles of one bucket."""
    other = tiles.select("t", "key", F.col("no").alias("no_b"), F.col("n").alias("m"), F.col("payload").alias("b"))
    pairs = tiles.select("t", "key", "no", "n", F.col("payload").alias("a")).join(other, ["t", "key"]).filter("no < no_b")

    def opened(n, data):
        body = (len(data) - 8 * n) // n
        load = [data[8 * n + k * body : 8 * n + (k + 1) * body] for k in range(n)]
        return Tile(np.frombuffer(data, np.int64, n), load, tables)

    def run(batches):
        for batch in batches:
            for t, n, a, m, b in zip(*(batch.column(c).to_pylist() for c in ("t", "n", "a", "m", "b"))):
                yield _link_batch(t, compare(opened(n, a), opened(m, b), t, threshold))

    return pairs.select("t", "n", "a", "m", "b").mapInArrow(run, _LINK)


def vector_groups(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, width: float = 2.0, seed: int = 7
) -> DataFrame:
    """One row ``id, n_links, component, kept`` per input row.

    Unit vectors are bucketed by quantised random projections in several tables (:func:`settings`);
    members of a bucket are compared by exact cosine in double precision, in tiles of 1024, so a
    bucket of any size is spread over tasks. Equal vectors form one class first, which links all its
    rows. ``n_links`` counts other rows linked directly, ``component`` is the smallest id reachable,
    ``kept`` says that the row's id is that one. A vector that is null, empty, zero or holds null or
    non-finite numbers links with nothing and is its own component; vectors of different lengths never
    link. Rows with a null id link like others but never name a component while another id is there.
    A repeated row is another vector. An empty table gives no rows; other columns are not read.
    """
    bound_batches(vectors.sparkSession)
    classes = _classes(vectors, id_col, vec_col)
    k, tables = settings(classes.count(), threshold, width)
    inner = cut_lineage(_within(_buckets(classes, k, tables, width, seed), tables, threshold))
    cross = cut_lineage(_across(inner.filter("payload is not null"), tables, threshold))
    found = inner.filter("payload is null").select("cid", "n", "root").unionByName(cross.select("cid", "n", "root"))
    roots = components(found, "cid", "root")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    rooted = (
        classes.join(roots, classes.cid == roots.node, "left").join(counts, "cid", "left")
        .select("emb", "low", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    )
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.join(lowest, "root").select("emb", "n_links", "component")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("emb"))
    joined = rows.join(named, "emb", "left")
    component = F.coalesce("component", "id")
    return joined.select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
