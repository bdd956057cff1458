"""SimHash near-duplicates by tiled exact comparison of 64-bit fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import bound_batches, byte_words, components, forest
from tidewater.session import cut_lineage

SEED = 42
TILE = 2048
_QUARTERS = ("q1", "q2", "q3", "q4")


def _spread_table() -> np.ndarray:
    """For every byte value, its eight bits in the eight bytes of one integer."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view("<u8").ravel()


def fingerprint_texts(texts: list, width: int) -> np.ndarray:
    """Unsigned fingerprints of texts: bit j is 1 if set in over half the shingle hashes."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        words = byte_words(text)
        if not words:
            continue
        if len(words) <= width:
            hashes.append(digest(b" ".join(words), SEED))
            counts[k] = 1
            continue
        joined, starts = b" ".join(words), [0]
        for word in words:
            starts.append(starts[-1] + len(word) + 1)
        hashes.extend([digest(joined[s : e - 1], SEED) for s, e in zip(starts, starts[width:])])
        counts[k] = len(words) - width + 1
    out, full = np.zeros(len(texts), dtype=np.uint64), np.flatnonzero(counts)
    if not len(full):
        return out
    lanes = _spread_table()[np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)]
    ends = np.cumsum(counts[full])
    begins = ends - counts[full]
    blocks = (counts[full] + 254) // 255  # a byte counts to 255
    first = np.cumsum(blocks) - blocks
    within = np.arange(blocks.sum()) - np.repeat(first, blocks)
    partial = np.add.reduceat(lanes, np.repeat(begins, blocks) + 255 * within, axis=0)
    totals = np.add.reduceat(partial.view(np.uint8).reshape(len(partial), 64), first, axis=0, dtype=np.int64)
    bits = (2 * totals > counts[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``id, fp, h`` per row: the fingerprint as a signed long and a hash of the text. A null text has no words: zero."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            prints = fingerprint_texts(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)], names=["id", "fp", "h"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    return rows.mapInArrow(run, f"id {kind}, fp bigint, h bigint")


def _tiles(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints packed into tiles of one half-count cell, with their ranges of bit counts."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 48 - 16 * k).bitwiseAND(0xFFFF)) for k in range(4)]
    cells = prints.withColumns(dict(zip(_QUARTERS, quarter))).select(
        "fp", *_QUARTERS, (F.col("q1") + F.col("q2")).alias("c1"), (F.col("q3") + F.col("q4")).alias("c2")
    )
    order = ["c1", "c2", "q1", "q3", "fp"]
    ranges = [f"{q}_{side}" for q in _QUARTERS for side in ("lo", "hi")]

    def run(batches):
        held: list = []
        for batch in batches:
            held.append(np.column_stack([batch.column(n).to_numpy() for n in ("c1", "c2", "fp", *_QUARTERS)]))
            rows = np.concatenate(held)
            cuts = _cuts(rows)
            for a, b in zip(cuts[:-2], cuts[1:-1]):
                yield pack(rows[a:b])
            held = [rows[cuts[-2] : cuts[-1]]] if len(rows) else []
        if held and len(held[0]):
            yield pack(held[0])

    def pack(rows):
        low, high = rows[:, 3:].min(0), rows[:, 3:].max(0)
        values = [[int(rows[0, 0])], [int(rows[0, 1])], [int(rows[0, 2])], [rows[:, 2].astype("<i8").tobytes()]]
        values += [[int(x)] for pair in zip(low, high) for x in pair]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.binary()] + [pa.int32()] * 8
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=["c1", "c2", "head", "fps", *ranges])

    schema = "c1 int, c2 int, head bigint, fps binary, " + ", ".join(f"{r} int" for r in ranges)
    return cells.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _cuts(rows: np.ndarray) -> list[int]:
    """Row numbers where a tile starts, and the end: at a new cell, and after 2048 rows of one."""
    if not len(rows):
        return [0, 0]
    change = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)) + 1
    starts = [0, *change.tolist(), len(rows)]
    cuts = [x for a, b in zip(starts, starts[1:]) for x in range(a, b, TILE)]
    return [*cuts, len(rows)]


def match_tiles(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what two tiles of fingerprints join: a spanning forest, not every pair."""
    left, right = [], []
    for k in range(0, len(a), 128):
        i, j = np.nonzero(np.bitwise_count(a[k : k + 128, None] ^ b[None]) <= radius)
        left.append(i + k)
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    both = np.concatenate([a, b])
    keep = a[i] != b[j]
    label = forest(len(both), i[keep], j[keep] + len(a))
    other = np.flatnonzero(label != np.arange(len(both)))
    return both[other], both[label[other]]


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Links ``u, v`` that connect all fingerprints within ``radius`` bits (column ``fp``, distinct).

    Tiles hold fingerprints of one cell, a pair of bit counts of the two halves. Two fingerprints
    within the radius lie in cells whose counts differ by at most the radius in all, so a tile meets
    only those cells (half of them, each pair once), and of these only tiles whose ranges of quarter
    counts come within the radius. The rest are skipped without loss.
    """
    tiles = cut_lineage(_tiles(prints))
    near = [
        (x, y) for x in range(radius + 1) for y in range(-radius, radius + 1)
        if x + abs(y) <= radius and (x > 0 or y >= 0)
    ]
    shifts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in near])
    moved = tiles.withColumn("shift", F.explode(shifts))
    b = moved.select(
        (F.col("c1") + F.col("shift.x")).alias("c1"), (F.col("c2") + F.col("shift.y")).alias("c2"),
        (F.col("shift.x") == 0).__and__(F.col("shift.y") == 0).alias("same"),
        *[F.col(c).alias(f"b_{c}") for c in tiles.columns if c not in ("c1", "c2")],
    )
    zero = F.lit(0)
    gap = sum(
        F.greatest(zero, F.col(f"{q}_lo") - F.col(f"b_{q}_hi"), F.col(f"b_{q}_lo") - F.col(f"{q}_hi")) for q in _QUARTERS
    )
    pairs = tiles.join(b, ["c1", "c2"]).filter((~F.col("same") | (F.col("head") <= F.col("b_head"))) & (gap <= radius))

    def run(batches):
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                u, v = match_tiles(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return pairs.select("fps", "b_fps").mapInArrow(run, "u bigint, v bigint")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4
) -> DataFrame:
    """One row ``id, fp, component, h, root`` per input row; ``component`` is the smallest id reachable by links.

    Fingerprints link at ``radius`` or fewer differing bits, all of them compared exactly, tile by tile.
    Equal fingerprints form one class first, so copies cost nothing. Null and empty texts have
    fingerprint zero and link like any other. A repeated row gives a row each time. A null id gets the
    component of its fingerprint, which is null if no row of the component has an id. ``h`` is a hash of
    the text, ``root`` a number of the component. An empty table gives no rows; other columns are not read.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, width))
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(links(classes, radius), "u", "v")
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.join(lowest, "root").select("fp", "component", "root")
    return rows.join(named, "fp").select("id", "fp", "component", "h", "root")


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4
) -> DataFrame:
    """One row of each group of :func:`simhash_groups`, columns as they came.

    The row with the smallest id stays, of rows that share it the one with the smallest text hash, and
    of equal rows one. A group whose ids are all null keeps one row too.
    """
    groups = simhash_groups(docs, id_col, text_col, width, radius)
    first = F.min(F.struct(F.col("id").isNull().alias("gone"), "id", "h")).alias("first")
    kept = cut_lineage(groups.groupBy("root").agg(first).select(*_key(F.col("first.id"), F.col("first.h"), "_tw_k")))
    marked = docs.select("*", *_key(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`")), "_tw_d"))
    same = [F.col(f"_tw_d{n}") == F.col(f"_tw_k{n}") for n in range(3)]
    joined = marked.join(kept, same[0] & same[1] & same[2])
    copy = F.row_number().over(Window.partitionBy("_tw_d0", "_tw_d1", "_tw_d2").orderBy("_tw_d0"))
    return joined.withColumn("_tw_copy", copy).filter("_tw_copy = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def _key(row_id, text_hash, name: str) -> list:
    """An id and a text hash as three columns without nulls, so that they join and deal out by value."""
    return [row_id.isNull().alias(f"{name}0"), F.coalesce(F.xxhash64(row_id), F.lit(0)).alias(f"{name}1"), text_hash.alias(f"{name}2")]
