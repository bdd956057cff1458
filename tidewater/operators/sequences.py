"""Look-back windows as array columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.positions import BLOCK_ROWS, Y, over_neighbours


def sequence_windows(rows: DataFrame, n_steps: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``x``: the n_steps values before each row; the row's own y is the target."""
    return over_neighbours(
        rows,
        lambda r, w: r.withColumn("x", F.collect_list(Y).over(w.rowsBetween(-n_steps, -1))),
        behind=n_steps,
        block_rows=block_rows,
    ).where(F.size("x") == n_steps)


def feature_sequences(
    split: DataFrame, columns: list[str], n_steps: int = 5, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``x``: the feature rows of the n_steps rows before each row, across the train/test border."""
    row = F.array(*[F.col(c).cast("double") for c in columns])
    return over_neighbours(
        split,
        lambda r, w: r.withColumn("_row", row)
        .withColumn("x", F.collect_list("_row").over(w.rowsBetween(-n_steps, -1)))
        .drop("_row"),
        behind=n_steps,
        block_rows=block_rows,
    ).where(F.size("x") == n_steps)
