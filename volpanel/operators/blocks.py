"""Ordered work on panels with assets of any length.

``indexed`` numbers the rows of each asset without ordering an asset in one task, and
``with_halo`` cuts it into blocks of rows that carry the rows before them, so that a
trailing frame runs per (asset, block): a single asset with most of the rows is as parallel
as many small ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 4096

def by_block() -> WindowSpec:
    """Rows of one block of an asset in order."""
    return Window.partitionBy("asset", "block").orderBy("t")


def indexed(panel: DataFrame, unit: str = "month") -> DataFrame:
    """Add ``t``, the 1-based position of each row in its asset by date.

    Rows are counted by calendar unit first; the counts, a small table, give each unit's
    offset, and only rows of one unit of one asset are ordered together.
    """
    marked = panel.withColumn("unit", F.date_trunc(unit, "date"))
    counts = marked.groupBy("asset", "unit").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("asset").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("asset", "unit", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("asset", "unit").orderBy("date"))
    return marked.join(offsets, ["asset", "unit"]).withColumn("t", F.col("offset") + place).drop("unit", "offset")


def with_halo(panel: DataFrame, halo: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``block`` and ``own``; the last ``halo`` rows of a block also come, not own, with the next.

    Frames over ``by_block`` that reach at most ``halo`` rows back see what they would in the
    whole asset.  Keep only ``own`` rows afterwards.
    """
    at = F.col("t") - 1
    block = F.floor(at / block_rows).cast("long")
    late = at % block_rows >= block_rows - halo
    copies = F.when(late, F.array(block, block + 1)).otherwise(F.array(block))
    return panel.withColumn("home", block).withColumn("block", F.explode(copies)).withColumn("own", F.col("block") == F.col("home")).drop("home")


def own_rows(panel: DataFrame) -> DataFrame:
    return panel.where("own").drop("own", "block")
