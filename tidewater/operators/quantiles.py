"""Exact quantiles by group without gathering a large group in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import cut_lineage

# Rows of a group, or of a bracket of it, that one task may take.
BLOCK_ROWS = 65_536
# Bins of a bracket, and brackets that are sent to all tasks instead of being joined by key.
BINS, SENT_BRACKETS = 512, 200_000


def exact_quantiles(values: DataFrame, keys: list[str], value: str, probs: list[float], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Linearly interpolated quantiles (position q * (n - 1)): one row per key and probability (``prob``, ``value``).

    Groups of up to a block of rows are ranked where they meet. For larger ones every wanted rank has a
    bracket, at first from the least to the largest value; it is cut to the bin of a histogram that holds
    the rank until it holds a block of rows or a single value. Only then are the values inside ranked, so
    neither a hot key nor a hot value ends up in one task. Values are finite; nulls are left out.
    """
    known = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    large = cut_lineage(sizes.where(F.col("_n") > block_rows))
    some = not large.isEmpty()
    small = known.join(large.select(*keys), keys, "left_anti") if some else known
    places = F.arrays_zip(F.array(*[F.lit(float(q)) for q in probs]).alias("prob"), F.percentile("_v", F.array(*[F.lit(float(q)) for q in probs])).alias("value"))
    ranked = small.groupBy(*keys).agg(places.alias("_q")).select(*keys, F.inline("_q").alias("prob", "value"))
    return ranked.unionByName(_by_narrowing(known, large, keys, probs, block_rows)) if some else ranked


def _by_narrowing(known: DataFrame, large: DataFrame, keys: list[str], probs: list[float], block_rows: int) -> DataFrame:
    position = F.col("prob") * (F.col("_n") - 1)
    # Two ranks around every position, each with its bracket: rows below it, rows inside, its ends.
    asked = large.withColumn("prob", F.explode(F.array(*[F.lit(float(q)) for q in probs])))
    state = asked.withColumn("_rank", F.explode(F.array(F.floor(position), F.ceil(position)))).distinct()
    state = cut_lineage(state.select(*keys, "prob", "_rank", "_n", F.lit(0).cast("bigint").alias("_below"), F.col("_n").alias("_inside"), "_lo", "_hi"))
    target = [*keys, "prob", "_rank", "_n", "_below"]
    open_ = (F.col("_inside") > block_rows) & (F.col("_lo") < F.col("_hi"))
    while True:
        wide = state.where(open_)
        if wide.isEmpty():
            break
        rows = _inside(known, wide, keys)
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)  # halves don't overflow
        bins = rows.groupBy(*target, F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("_bin")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
        upto = F.sum("_c").over(Window.partitionBy(*target).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        running = bins.withColumn("_upto", F.col("_below") + upto)
        held = running.where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank")))
        cut = held.select(*keys, "prob", "_rank", "_n", (F.col("_upto") - F.col("_c")).alias("_below"), F.col("_c").alias("_inside"), "_lo", "_hi")
        state = cut_lineage(state.where(~open_).unionByName(cut))
    counted = _inside(known, state.where("_lo < _hi"), keys).groupBy(*target, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*target).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    met = counted.withColumn("_upto", F.col("_below") + upto).where(F.col("_upto") > F.col("_rank"))
    found = met.groupBy(*keys, "prob", "_rank", "_n").agg(F.min("_v").alias("_v"))
    found = found.unionByName(state.where("_lo = _hi").select(*keys, "prob", "_rank", "_n", F.col("_lo").alias("_v")))
    ends = found.groupBy(*keys, "prob", "_n").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    return ends.select(*keys, "prob", (F.col("_low") + (F.col("_high") - F.col("_low")) * (position - F.floor(position))).alias("value"))


def _inside(known: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the brackets' groups that lie inside; a bracket stands for at least a block of rows."""
    few = brackets.limit(SENT_BRACKETS + 1).count() <= SENT_BRACKETS
    joined = known.join(F.broadcast(brackets) if few else brackets, keys)
    return joined.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
