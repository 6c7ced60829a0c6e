"""Row numbers of files that Spark reads in blocks.

Spark packs blocks into tasks by size, so neither task order nor place in a task says where a
row stands in its file.  The first place and the number of rows of each block (one row a block)
do: with the blocks of a file in order, a row's number in the file follows from its place, whatever
the size of blocks or the number of tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILE, ROW, NUMBER = "_file", "_row", "_number"


def numbered(df: DataFrame) -> DataFrame:
    """Rows just read from files with ``_file`` (path), ``_row`` (number in the file) and ``_number``
    (number over all files in the order of their paths), both from 1."""
    place = F.monotonically_increasing_id()
    marked = df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("_start"), place.alias("_place"))
    blocks = marked.groupBy(FILE, "_start").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    files = blocks.groupBy(FILE).agg(F.sum("_n").alias("_of"))
    # One row a file: their running sum is taken in one task.
    before = files.select(FILE, (F.sum("_of").over(Window.orderBy(FILE)) - F.col("_of")).alias("_files"))
    earlier = F.sum("_n").over(Window.partitionBy(FILE).orderBy("_start")) - F.col("_n")
    starts = blocks.withColumn("_blocks", earlier).join(before, FILE)
    row = F.col("_blocks") + F.col("_place") - F.col("_first") + 1
    joined = marked.join(starts.select(FILE, "_start", "_first", "_blocks", "_files"), [FILE, "_start"])
    return joined.select(*df.columns, FILE, row.alias(ROW), (row + F.col("_files")).alias(NUMBER))
