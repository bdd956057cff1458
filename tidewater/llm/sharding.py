"""Shards on a consistent-hash ring with virtual nodes and bounded loads, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.session import cut_lineage

REPLICAS = 64
CELLS = 1 << 14


def ring(spark: SparkSession, shards: int, replicas: int = REPLICAS, cells: int = CELLS) -> DataFrame:
    """``cell, arc, owner``: the virtual node at or clockwise after each of ``cells`` ring cells.

    The table has ``cells`` rows whatever the data. Every shard's virtual nodes depend on its number
    alone; two nodes in one cell go to the lower shard.
    """
    nodes = (
        spark.range(shards * replicas)
        .select((F.col("id") / replicas).cast("int").alias("owner"), (F.col("id") % replicas).alias("replica"))
        .select("owner", F.pmod(F.xxhash64("owner", "replica"), F.lit(cells)).alias("cell"))
        .groupBy("cell").agg(F.min("owner").alias("owner"))
    )
    lowest = nodes.agg(F.min_by("owner", "cell").alias("first_owner"), F.min("cell").alias("first_cell"))
    ahead = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = spark.range(cells).select(F.col("id").alias("cell")).join(nodes, "cell", "left").join(F.broadcast(lowest))
    node = F.when(F.col("owner").isNotNull(), F.col("cell"))
    return placed.select(
        "cell", F.coalesce(F.last(node, True).over(ahead), F.lit(cells)).alias("arc"),
        F.coalesce(F.last("owner", True).over(ahead), "first_owner").alias("owner"),
    )


def _takes(arcs: DataFrame, shards: int) -> DataFrame:
    """Overflow placed clockwise: ``shard, amount, start`` (overflow rows before it) and ``base`` (first slot).

    ``arcs`` has a row per arc with the rows that overflow there (``over``), and the room of its owner.
    Two laps of the ring are folded: a carry picks up overflow in the first lap and drops it at every
    arc whose owner has room. All shards lie on the second lap, so nothing stays in the carry.
    """
    listed = F.sort_array(F.collect_list(F.struct("arc", "owner", "over", "room", "stay")))
    rooms = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(
        F.element_at(F.filter("arcs", lambda a: a["owner"] == s), 1)["room"], F.lit(0).cast("bigint")
    ))
    laps = F.concat("arcs", F.transform("arcs", lambda a: F.struct(
        a["arc"].alias("arc"), a["owner"].alias("owner"), F.lit(0).cast("bigint").alias("over"), a["room"].alias("room"), a["stay"].alias("stay")
    )))

    def step(state, arc):
        carry = state["carry"] + arc["over"]
        at = arc["owner"] + 1
        taken = F.least(carry, F.element_at(state["rooms"], at))
        return F.struct(
            (carry - taken).alias("carry"),
            F.when(taken > 0, F.transform(state["rooms"], lambda r, i: F.when(i + 1 == at, r - taken).otherwise(r))).otherwise(state["rooms"]).alias("rooms"),
            F.when(taken > 0, F.concat(state["out"], F.array(F.struct(arc["owner"].alias("shard"), taken.alias("amount"), arc["stay"].alias("stay")))))
            .otherwise(state["out"]).alias("out"),
        )

    start = F.struct(
        F.lit(0).cast("bigint").alias("carry"), F.col("rooms"),
        F.array().cast("array<struct<shard:int,amount:bigint,stay:bigint>>").alias("out"),
    )
    folded = arcs.agg(listed.alias("arcs")).withColumn("rooms", rooms).select(F.aggregate(laps, start, step)["out"].alias("out"))
    placed = folded.select(F.posexplode("out").alias("k", "take")).select("k", "take.*")
    before = Window.orderBy("k")
    own = Window.partitionBy("shard").orderBy("k")
    return placed.select(
        "shard", "amount", (F.sum("amount").over(before) - F.col("amount")).alias("start"),
        (F.col("stay") + F.sum("amount").over(own) - F.col("amount")).alias("base"),
    )


def _pieces(spark: SparkSession, counts: DataFrame, shards: int, replicas: int, cells: int) -> DataFrame:
    """``cell, pieces``: runs of ranks inside a cell with the shard and first slot of each run.

    Only tables of at most ``cells`` rows are used here. Each shard's capacity is the row count
    divided by the shards, one more for the first few, so the loads are at most one apart.
    """
    total = F.sum("n").over(Window.partitionBy())
    capacity = F.floor(total / shards).cast("bigint") + (F.col("owner") < total % shards).cast("bigint")
    by_owner = Window.partitionBy("owner")
    summary = cut_lineage(
        ring(spark, shards, replicas, cells).join(counts, "cell").withColumn("capacity", capacity)
        .withColumn("load", F.sum("n").over(by_owner))
        .withColumn("before", F.sum("n").over(by_owner.orderBy("cell")) - F.col("n"))
        .withColumn("over", F.greatest(F.lit(0), F.col("before") + F.col("n") - F.greatest("capacity", "before")))
        .withColumn("over_before", F.sum("over").over(Window.orderBy("cell")) - F.col("over"))
    )
    whole = summary.agg(F.sum("n")).first()[0] or 0
    loads = summary.groupBy("owner").agg(F.first("load").alias("load"))
    # Owners without rows have room too: every arc of the ring takes part in the fold.
    spare = (
        ring(spark, shards, replicas, cells).select("arc", "owner").distinct()
        .join(summary.groupBy("arc").agg(F.sum("over").alias("over")), "arc", "left")
        .join(loads, "owner", "left")
        .withColumn("capacity", F.lit(whole // shards) + (F.col("owner") < whole % shards).cast("bigint"))
        .withColumn("stay", F.least(F.coalesce("load", F.lit(0)), "capacity"))
        .select("arc", "owner", F.coalesce("over", F.lit(0)).alias("over"), (F.col("capacity") - F.col("stay")).alias("room"), "stay")
    )
    takes = cut_lineage(_takes(spare, shards))
    kept = summary.filter("n > over").select(
        "cell", F.struct(F.lit(0).cast("bigint").alias("lo"), (F.col("n") - F.col("over")).alias("hi"), F.col("owner").alias("shard"), F.col("before").alias("base")).alias("piece")
    )
    # Both sides cut the line of overflowing rows into intervals; sorted together, every cut starts a piece.
    from_cells = summary.filter("over > 0").select(
        F.col("over_before").alias("at"), F.struct("cell", (F.col("n") - F.col("over") - F.col("over_before")).alias("shift")).alias("source"),
        F.lit(None).cast("struct<shard:int,shift:bigint>").alias("goal"),
    )
    from_takes = takes.select(
        F.col("start").alias("at"), F.lit(None).cast("struct<cell:bigint,shift:bigint>").alias("source"),
        F.struct("shard", (F.col("base") - F.col("start")).alias("shift")).alias("goal"),
    )
    cuts = from_cells.unionByName(from_takes).groupBy("at").agg(F.max("source").alias("source"), F.max("goal").alias("goal"))
    line = Window.orderBy("at")
    moved = (
        cuts.select(
            "at", F.last("source", True).over(line).alias("source"), F.last("goal", True).over(line).alias("goal"),
            F.coalesce(F.lead("at").over(line), F.lit(takes.agg(F.sum("amount")).first()[0] or 0)).alias("until"),
        )
        .select(F.col("source.cell").alias("cell"), F.struct(
            (F.col("at") + F.col("source.shift")).alias("lo"), (F.col("until") + F.col("source.shift")).alias("hi"),
            F.col("goal.shard").alias("shard"), (F.col("at") + F.col("goal.shift")).alias("base"),
        ).alias("piece"))
    )
    return kept.unionByName(moved).groupBy("cell").agg(F.collect_list("piece").alias("pieces"))


def shard_rows(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", replicas: int = REPLICAS, cells: int = CELLS
) -> DataFrame:
    """One row ``id, size, text_crc32, shard, slot`` per input row; shard sizes differ by one row at most.

    A row's key is its id and text checksum; its hash names a ring cell. Rows of a cell are ranked by
    key, cells of a shard fill it in ring order, and ranks beyond its capacity continue clockwise to the
    next virtual node of a shard with room. Only rows that overflow leave their home shard. ``slot``
    counts from 0 without gaps in every shard. ``size`` is the UTF-8 bytes of the text plus 16; a null text
    has no bytes and checksum 0. Equal rows share a key and get neighbouring ranks; null ids are keys like
    others. An empty table gives no rows; other columns are not read.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
    )
    rows = cut_lineage(rows.withColumn("at", F.xxhash64("id", "text_crc32")).withColumn("cell", F.pmod("at", F.lit(cells))))
    pieces = _pieces(docs.sparkSession, rows.groupBy("cell").agg(F.count("*").alias("n")), shards, replicas, cells)
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("at", "id", "text_crc32", "size")) - 1
    named = rows.withColumn("rank", rank.cast("bigint")).join(cut_lineage(pieces), "cell")
    piece = F.element_at(F.filter("pieces", lambda p: (F.col("rank") >= p["lo"]) & (F.col("rank") < p["hi"])), 1)
    return named.withColumn("piece", piece).select(
        "id", "size", "text_crc32", F.col("piece.shard").alias("shard"), (F.col("piece.base") + F.col("rank") - F.col("piece.lo")).alias("slot")
    )
