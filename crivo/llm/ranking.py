"""Order numbers and positions without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crivo.llm.common import stored

#: Name of the order number, and how many of its bits count the rows of one range.
AT, ROW_BITS = "__llm_at", 33


def in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows and `AT`, a number that ascends with `order` (nulls first); written to the shared folder.

    The rows are written first, so their number in the files can break ties: rows equal in every
    column go to as many ranges as they fill, and a range computed again is the same range.
    """
    turn = "__llm_turn"
    numbered = stored(df, f"{name}-rows").withColumn(turn, F.monotonically_increasing_id())
    keys = [F.col(f"`{c}`") for c in [*order, turn]]
    ranges = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(turn)
    return stored(ranges.withColumn(AT, F.monotonically_increasing_id()), name)


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The rows with `position`, from 0 in each group by `order`, and `size`, the rows of the group.

    A group's rows may fill many ranges: each range hands over its number of rows, and a row's
    position is that of its range plus its own there. No task holds a group.
    """
    rows = in_order(df, [group, *order], name).withColumn("__llm_range", F.shiftright(AT, ROW_BITS))
    runs = rows.groupBy(F.col("__llm_range").alias("__llm_of"), F.col(f"`{group}`").alias("__llm_group")).agg(
        F.min(AT).alias("__llm_first"), F.count("*").alias("__llm_rows")
    )
    ranges = Window.partitionBy("__llm_group").orderBy("__llm_of")
    before = F.sum("__llm_rows").over(ranges.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(
        "__llm_of",
        "__llm_group",
        (F.coalesce(before, F.lit(0)) - F.col("__llm_first")).alias("__llm_shift"),
        F.sum("__llm_rows").over(Window.partitionBy("__llm_group")).alias("size"),
    )
    same = (F.col("__llm_range") == F.col("__llm_of")) & F.col(f"`{group}`").eqNullSafe(F.col("__llm_group"))
    placed = rows.join(runs, same).withColumn("position", F.col(AT) + F.col("__llm_shift"))
    return placed.drop(AT, "__llm_range", "__llm_of", "__llm_group", "__llm_shift")
