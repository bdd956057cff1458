"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pickle

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import cut_lineage

BATCH_ROWS = 1024


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1024 rows and 32 MB, so that long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "32m")


class Shipped:
    """An object every executor gets once, its class included: the package need not be importable there.

    A plain broadcast pickles classes by reference. The object is rebuilt once per Python worker.
    """

    def __init__(self, spark: SparkSession, thing):
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(thing))

    @property
    def value(self):
        kept = getattr(self.held, "_tw_rebuilt", None)
        if kept is None:
            kept = self.held._tw_rebuilt = (pickle.loads(self.held.value),)
        return kept[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only; none for a null text."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_share(limit: int, count, *columns):
    """A filter that keeps about ``limit`` of ``count`` rows, the same ones on every run."""
    return F.pmod(F.xxhash64(*columns), F.lit(1_000_003)) < F.least(
        F.lit(1_000_003.0), F.lit(float(limit)) / F.greatest(F.lit(count) if isinstance(count, int) else count, F.lit(1)) * 1_000_003.0
    )


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable node of every node 0..n-1 under the given links."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


# A group with at least this share of all rows is hot; there are at most as many hot groups.
HOT_GROUPS = 1000


def attach_by_key(rows: DataFrame, groups: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` with the columns of their group; rows without a group get nulls.

    ``groups`` has one row per value of ``key`` (null is a value) and in ``weight`` its number of rows. Groups
    that hold a thousandth of all rows or more are at most a thousand: they are broadcast, so that their rows
    stay where they are, and only the rows of other groups are dealt out by key. ``rows`` is read twice.
    """
    groups = cut_lineage(groups)
    total = groups.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_GROUPS >= total
    named = groups.withColumnRenamed(key, "_tw_key").withColumn("_tw_found", F.lit(True))
    same = F.col(key).eqNullSafe(F.col("_tw_key"))
    extra = [c for c in groups.columns if c not in (key, weight)]
    marked = rows.join(F.broadcast(named.filter(hot).drop(weight)), same, "left")
    large = marked.filter("_tw_found").select(*rows.columns, *extra)
    others = marked.filter("_tw_found is null").select(*rows.columns)
    return large.unionByName(others.join(named.filter(~hot).drop(weight), same, "left").select(*rows.columns, *extra))


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components of a link table: ``node`` and ``root``, its smallest reachable node.

    Alternating large-star and small-star steps: every step is a minimum per node with map-side
    partial results and one join, which adaptive execution splits where a node is hot. Each round is
    written to the shared folder, so a lost executor repeats one round at most. Nodes without links
    to others do not appear.
    """
    a, b = F.col(left), F.col(right)
    edges = cut_lineage(
        links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    seen = _digest(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = cut_lineage(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u > v").distinct())
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _digest(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed)).first())
