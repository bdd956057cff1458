"""Source mixing by pivotal dependent rounding of copy numbers, DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import cut_lineage

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 64
_NEAR = 1e-9


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size, target``: shares of the total by weight, none above ``cap`` times its size.

    ``sizes`` has one row per source. Sources are ordered by code point, null last, and take the
    weights in turn. Resharing the excess until no source is above its cap ends at one level of
    target per weight; sources reach their caps in ascending order of size per weight, so the level
    is found in that order in one pass.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    line = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.col("source_size") * float(cap)
    ahead = sizes.withColumn("weight", weight).withColumn("full", full).withColumn(
        "level",
        (F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()) - F.coalesce(F.sum("full").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing)),
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("full"), F.col("level"))
    leveled = ahead.withColumn("level", F.first(fits, True).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = F.col("level") * F.col("weight")
    return leveled.select("source", "source_size", F.when(share < F.col("full"), share).otherwise(F.col("full")).alias("target"))


def _uniform(*parts) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def _fold(listed: Column, seed: int) -> Column:
    """Pair the units of a sorted array in turn; ``out`` are decided units, ``unit`` and ``p`` the residual.

    Of a pair with probabilities a and b, one moves its mass to the other (a + b < 1) or is filled up
    from it (a + b >= 1), chosen at random so that both keep their expectation. One of the two becomes
    0 or 1 and is decided; the other goes on.
    """
    def step(state, item):
        a, b = state["p"], item["p"]
        total = a + b
        draw = _uniform(F.lit(seed), state["unit"]["h"], state["unit"]["id"], item["unit"]["h"], item["unit"]["id"])
        first_wins = F.when(total < 1, draw * total < a).otherwise(draw * F.greatest(2.0 - total, F.lit(1e-15)) < 1.0 - b)
        # The decided unit: the loser at 0 when masses merge, the winner at 1 when one fills up.
        first_done = F.when(total < 1, ~first_wins).otherwise(first_wins)
        done = F.when(first_done, state["unit"]).otherwise(item["unit"])
        stays = F.when(first_done, item["unit"]).otherwise(state["unit"])
        return F.struct(
            stays.alias("unit"), F.when(total < 1, total).otherwise(total - 1.0).alias("p"),
            F.concat(state["out"], F.array(F.struct(done.alias("unit"), F.when(total < 1, 0).otherwise(1).alias("extra")))).alias("out"),
        )

    head = F.element_at(listed, 1)
    start = F.struct(
        head["unit"].alias("unit"), head["p"].alias("p"),
        F.filter(F.array(F.struct(head["unit"].alias("unit"), F.lit(0).alias("extra"))), lambda x: F.lit(False)).alias("out"),
    )
    return F.aggregate(F.slice(listed, 2, F.greatest(F.size(listed) - 1, F.lit(0))), start, step)


def round_copies(units: DataFrame, seed: int = 1) -> DataFrame:
    """Round the probabilities ``p`` of units to 0 or 1 (``extra``), their sum kept in every source.

    ``units`` has ``source, id, h, size, p``. Units are dealt to strata of similar size, and in a
    stratum by hash to blocks of about 64. Each block is folded by :func:`_fold`; residuals of 64
    blocks form a block of the next level, until one is left per stratum. The strata of a source, in
    order of size, are folded last, and the final residual is drawn. Paired units are of similar size,
    so the words taken stay close to the target as well. Every level is written to the shared folder.
    """
    stratum = F.floor(F.log2("size") * 8).cast("int")
    units = units.select("source", F.struct("id", "h", "size").alias("unit"), "p", stratum.alias("stratum"))
    counts = units.groupBy("source", "stratum").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("bigint")
    counts = counts.withColumn("blocks", blocks).withColumnsRenamed({"source": "c_source", "stratum": "c_stratum"})
    level = units.join(
        counts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("stratum") == F.col("c_stratum"))
    ).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "unit.id", "unit.h"), F.col("blocks")))
    decided, widest = [], counts.agg(F.max("blocks")).first()[0] or 0
    while True:
        entry = F.struct(F.col("unit.size").alias("size"), F.xxhash64(F.lit(seed), "unit.id", "unit.h").alias("mixed"), F.col("unit"), F.col("p"))
        folded = cut_lineage(
            level.groupBy("source", "stratum", "block").agg(F.sort_array(F.collect_list(entry)).alias("listed"))
            .select("source", "stratum", "block", _fold(F.col("listed"), seed).alias("folded"))
            .select("source", "stratum", "block", "folded.*")
        )
        decided.append(folded.select("source", F.explode("out").alias("d")).select("source", "d.unit", "d.extra"))
        level = folded.select("source", "unit", "p", "stratum", F.floor(F.col("block") / BLOCK).cast("bigint").alias("block"))
        if widest <= 1:
            break
        widest = -(-widest // BLOCK)
    entry = F.struct(F.col("stratum").alias("size"), F.lit(0).cast("bigint").alias("mixed"), F.col("unit"), F.col("p"))
    last = cut_lineage(
        level.groupBy("source").agg(F.sort_array(F.collect_list(entry)).alias("listed"))
        .select("source", _fold(F.col("listed"), seed + 1).alias("folded")).select("source", "folded.*")
    )
    decided.append(last.select("source", F.explode("out").alias("d")).select("source", "d.unit", "d.extra"))
    drawn = (_uniform(F.lit(seed + 2), "unit.h", "unit.id") < F.when(F.col("p") < _NEAR, 0.0).when(F.col("p") > 1 - _NEAR, 1.0).otherwise(F.col("p"))).cast("int")
    decided.append(last.select("source", "unit", drawn.alias("extra")))
    return reduce(DataFrame.unionByName, decided).select("source", "unit.*", "extra")


def _plan(rows: DataFrame, weights: tuple, cap: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Targets per source, and copies per distinct ``source, id, h`` of rows ``id, source, h, size``."""
    goals = cut_lineage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))
    rate = F.col("target") / F.col("source_size")
    rated = goals.filter("source_size > 0").select(F.col("source").alias("g_source"), rate.alias("rate"))
    units = rows.filter("size > 0").groupBy("source", "id", "h").agg(F.sum("size").alias("size"))
    units = cut_lineage(
        units.join(rated, F.col("source").eqNullSafe(F.col("g_source")))
        .withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.col("whole"))
        .select("source", "id", "h", "size", "whole", "p")
    )
    split = (F.col("p") > _NEAR) & (F.col("p") < 1 - _NEAR)
    rounded = round_copies(units.filter(split).select("source", "id", "h", "size", "p"), seed)
    rounded = rounded.select(*[F.col(c).alias(f"r_{c}") for c in ("source", "id", "h")], "extra")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in ("source", "id", "h")])
    copies = units.join(rounded, same, "left").select(
        *[F.col(c).alias(f"u_{c}") for c in ("source", "id", "h")],
        (F.col("whole") + F.coalesce("extra", F.when(F.col("p") > 0.5, 1).otherwise(0))).cast("bigint").alias("copies"),
    )
    return goals, copies


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, cap: int = CAP, seed: int = 1, keep: bool = False,
) -> DataFrame:
    """Copies of every row so that the words of each source meet its target: ``copies``, ``size``, ``target``.

    One row per input row: ``id, source, size, source_size, target, copies``, or with ``keep`` all
    columns of ``docs`` and ``_tw_taken``. A row's expected copies are target over size of its source, the
    same for all its rows; whole copies are given outright and the fraction by :func:`round_copies`.
    The draw depends on ids, texts and ``seed`` only, so reruns agree. Rows that agree in source, id and
    text share one draw. Null and empty texts have size 0 and no copies; a null source is a source, last
    in order; null ids are ids. A source without words has target 0. An empty table gives no rows.
    """
    named = docs.withColumns({
        "_tw_id": F.col(f"`{id_col}`"), "_tw_source": F.col(f"`{source_col}`"), "_tw_size": word_count(F.col(f"`{text_col}`")),
        "_tw_h": F.xxhash64(F.col(f"`{text_col}`")),
    })
    narrow = cut_lineage(named.select(F.col("_tw_id").alias("id"), F.col("_tw_source").alias("source"), F.col("_tw_h").alias("h"), F.col("_tw_size").alias("size")))
    goals, copies = _plan(narrow, weights, cap, seed)
    same = F.col("source").eqNullSafe(F.col("u_source")) & F.col("id").eqNullSafe(F.col("u_id")) & (F.col("h") == F.col("u_h"))
    if keep:
        renamed = copies.select(*[F.col(c).alias(f"_tw_{c}") for c in copies.columns])
        same = (
            F.col("_tw_source").eqNullSafe(F.col("_tw_u_source")) & F.col("_tw_id").eqNullSafe(F.col("_tw_u_id")) & (F.col("_tw_h") == F.col("_tw_u_h"))
        )
        joined = named.join(renamed, same, "left")
        return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("_tw_copies", F.lit(0).cast("bigint")).alias("_tw_taken"))
    goals = goals.withColumnRenamed("source", "g_source")
    joined = narrow.join(copies, same, "left").join(goals, F.col("source").eqNullSafe(F.col("g_source")))
    return joined.select("id", "source", "size", "source_size", "target", F.coalesce("copies", F.lit(0).cast("bigint")).alias("copies"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, columns as they came."""
    counted = mix(docs, keep=True, **options)
    repeated = counted.filter("_tw_taken > 0").withColumn("_tw_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_tw_taken"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
