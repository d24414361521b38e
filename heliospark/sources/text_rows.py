"""Ordered text rows without a global sort.

Rows of one file split are consecutive, so (split start, row id) orders a file; a row's number inside a
section is its place in the split plus the sizes of the section's earlier splits. Only one row per split
and section is windowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliospark.operators.ranks import BROADCAST_ROWS
from heliospark.session import large

#: Sections of a file that are reckoned with where it is decided whether their table is broadcast.
SECTIONS = 5


def text_rows(spark: SparkSession, path: str) -> DataFrame:
    """Columns file, split, row (increasing within the split), line."""
    return spark.read.text(path, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )


def few_files(rows: DataFrame) -> bool:
    """Whether a table of a few rows per file may be broadcast: text lines then stay where they are read."""
    return SECTIONS * len(rows.inputFiles()) <= BROADCAST_ROWS


def beside(few: bool | None, table: DataFrame) -> DataFrame:
    """A table of a few rows per file, as the side of a join with text lines (None: as Spark sizes it)."""
    return table if few is None else F.broadcast(table) if few else large(table)


def after(split: Column, row: Column, split0: Column, row0: Column) -> Column:
    return (split > split0) | ((split == split0) & (row > row0))


def section_rows(rows: DataFrame, sections: DataFrame, few: bool | None = None) -> DataFrame:
    """Rows strictly between a section's start and its end; sections: file, section, s_*, e_* (NULL: to the end)."""
    inside = after(F.col("split"), F.col("row"), F.col("s_split"), F.col("s_row")) & (
        F.col("e_split").isNull() | after(F.col("e_split"), F.col("e_row"), F.col("split"), F.col("row"))
    )
    return rows.join(beside(few, sections), "file").where(inside).select("file", "section", "split", "row", "line")


def numbered(rows: DataFrame, keys: list[str], size: Column | None = None, name: str = "number", few: bool | None = None) -> DataFrame:
    """Zero-based number of each row within ``keys``, or of its first unit where rows hold ``size`` units."""
    if size is None:
        per_split = rows.groupBy(*keys, "split").agg(
            F.min("row").alias("_first"), F.count(F.lit(1)).alias("_n")
        )
        place = F.col("row") - F.col("_first")
    else:
        w = Window.partitionBy(*keys, "split").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_size", size).withColumn("_place", F.coalesce(F.sum("_size").over(w), F.lit(0)))
        per_split = rows.groupBy(*keys, "split").agg(F.sum("_size").alias("_n"))
        place = F.col("_place")
    before = Window.partitionBy(*keys).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_split.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = rows.join(beside(few, offsets), [*keys, "split"]).withColumn(name, (F.col("_before") + place).cast("long"))
    return out.drop("_first", "_n", "_before", "_size", "_place")
