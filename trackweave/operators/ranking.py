"""Row positions inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.session import BROADCAST_ROWS, settle

# Rows per innermost cell are at most 2**CELL_BITS, because the order column is unique.
CELL_BITS = 22


def cell_of(order: str, bits: int = CELL_BITS):
    return F.shiftright(F.col(order), bits)


def cell_offsets(cells: DataFrame, keys: list[str], bits: int = CELL_BITS) -> DataFrame:
    """Rows of the group that come before each cell, from a (keys, cell, n) table.

    Cells are summed in two levels (blocks of 2**bits cells, then blocks), so no window
    holds more than 2**bits entries, or 2**(64 - 2*bits) at the top, whatever the data.
    """
    within = Window.partitionBy(*keys, "block").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("block", F.shiftright("cell", bits))
    blocks = (
        cells.groupBy(*keys, "block")
        .agg(F.sum("n").alias("block_n"))
        .select(*keys, "block", F.coalesce(F.sum("block_n").over(across), F.lit(0)).alias("before_block"))
    )
    return (
        cells.withColumn("before_cell", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(blocks, [*keys, "block"])
        .select(*keys, "cell", (F.col("before_block") + F.col("before_cell")).alias("before"))
    )


def number_rows(rows: DataFrame, offsets: DataFrame, keys: list[str], order: str, out: str, bits: int = CELL_BITS):
    """Add the 1-based position ``out``: the cell's offset plus the row's rank in its cell.

    Columns of ``offsets`` other than the keys, ``cell`` and ``before`` are added too.
    """
    in_cell = Window.partitionBy(*keys, "cell").orderBy(order)
    return (
        rows.withColumn("cell", cell_of(order, bits))
        .withColumn("rank_in_cell", F.row_number().over(in_cell))
        .join(offsets, [*keys, "cell"])
        .withColumn(out, F.col("before") + F.col("rank_in_cell"))
        .drop("cell", "before", "rank_in_cell")
    )


def position_within(rows: DataFrame, keys: list[str], order: str, out: str = "pos", bits: int = CELL_BITS) -> DataFrame:
    """1-based position of each row in its ``keys`` group, by the unique bigint ``order``.

    Same result as one ``row_number`` window per group, but the work is cut into cells
    of consecutive order values: a group holding a third of a huge table is sorted by
    many tasks. Key columns must not be NULL.
    """
    counted = settle(rows.groupBy(*keys, cell_of(order, bits).alias("cell")).agg(F.count("*").alias("n")))
    offsets = cell_offsets(counted, keys, bits)
    if counted.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return number_rows(rows, offsets, keys, order, out, bits)
