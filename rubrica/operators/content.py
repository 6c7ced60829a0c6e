"""Content checks against the declared content tables.

Each adds one boolean column.  The tables are joined; Spark picks the join by their
size and splits rows of hot codes.  Ranges are first merged to disjoint intervals and then spread over
bins of values, so a value meets the intervals of its bin only, however many ranges its key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubrica.functions.joins import spread_hash, spread_left_join


def text_in_content_set(
    df: DataFrame, texts: DataFrame, content_set: str, text: str, out: str = "text_ok"
) -> DataFrame:
    """Is the text one of the allowed texts of a content set?"""
    allowed = (
        texts.filter(F.col("content_set") == content_set)
        .select(F.col("text").alias("_text"))
        .filter(F.col("_text").isNotNull())
        .distinct()
        .withColumn("_ok", F.lit(True))
    )
    joined = spread_left_join(df.withColumn("_text", F.col(text)), allowed, "_text")
    return joined.withColumn(out, F.coalesce("_ok", F.lit(False))).drop("_text", "_ok")


#: Cells to a factor of two in size; a cell's lower bounds are within a fraction of 4e-5 of each other.
CELLS = 16384


def cell_of(value: Column) -> Column:
    """Number of the cell a lower bound lies in, by its sign and size alone: it never falls as the value grows."""
    size = F.floor(F.log2(F.abs(value)) * CELLS) + 1100 * CELLS
    ends = 3000 * CELLS
    return (
        F.when(value == float("-inf"), F.lit(-ends)).when(value == float("inf"), F.lit(ends))
        .when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("bigint")
    )


def _merged(rows: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("lo")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0)
    group = F.sum(fresh.cast("bigint")).over(order)
    return rows.withColumn("_fresh", fresh).withColumn("_group", group).groupBy(*by, "_group").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")
    ).drop("_group")


def merged_ranges(ranges: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Disjoint closed intervals (keys, lo, hi) that cover what the ranges cover; a missing bound is
    infinite, ranges without any value are left out.

    Ranges are merged within cells of their lower bounds, so those of one key are spread.  One row for
    each cell of a key then tells how far the cells before it reach and where the interval that reaches
    farthest begins; what begins within reach belongs to that one."""
    wide = ranges.select(
        F.struct(*keys).alias("_of"),
        F.coalesce(F.col(low).cast("double"), F.lit(float("-inf"))).alias("lo"),
        F.coalesce(F.col(high).cast("double"), F.lit(float("inf"))).alias("hi"),
    ).filter("lo <= hi AND NOT isnan(lo) AND NOT isnan(hi)")
    # Of ranges that begin at the same value the longest covers the others.
    longest = wide.groupBy("_of", "lo").agg(F.max("hi").alias("hi")).withColumn("_cell", cell_of(F.col("lo")))
    local = _merged(longest, ["_of", "_cell"])
    before = Window.partitionBy("_of").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = local.groupBy("_of", "_cell").agg(F.max("hi").alias("_top"), F.max("lo").alias("_tail"))
    cells = cells.withColumn("_reach", F.max("_top").over(before))
    begins = F.when(F.col("_reach").isNull() | (F.col("_tail") > F.col("_reach")), F.col("_tail"))
    cells = cells.withColumn("_begin", F.last(begins, ignorenulls=True).over(before)).drop("_top", "_tail")
    within = F.col("lo") <= F.col("_reach")
    joined = local.join(cells, ["_of", "_cell"]).withColumn("lo", F.when(within, F.col("_begin")).otherwise(F.col("lo")))
    return joined.groupBy("_of", "lo").agg(F.max("hi").alias("hi")).select("_of.*", "lo", "hi")


def bin_of(value: Column, origin: Column, width: Column, bins: Column) -> Column:
    """Number of the bin a value lies in, from 1; 0 below the origin, ``bins`` + 1 beyond the last."""
    at = F.floor((value - origin) / width)
    return F.when(value < origin, F.lit(0)).when(at >= bins, bins + 1).otherwise(at + 1).cast("bigint")


def value_in_range_set(
    df: DataFrame,
    ranges: DataFrame,
    content_set: str,
    system: str,
    code: str,
    unit: str,
    value: str,
    out: str = "range_ok",
) -> DataFrame:
    """Is the value inside one of the ranges given for (system, code, unit)?  A
    missing bound is open; no range at all is no match.

    An interval join: a key's merged intervals are disjoint and go to the bins they touch, as many bins as
    there are intervals, so they are at most twice as many rows.  A value meets the intervals of its
    key's bin, of which at most one holds it, so a row stays one row and nothing is collected.
    """
    key = ["system", "code", "unit"]
    own = ranges.filter(F.col("content_set") == content_set).select(
        F.struct(*[F.col(k).cast("string").alias(k) for k in key]).alias("_key"), "min_value", "max_value"
    )
    merged = merged_ranges(own, ["_key"], "min_value", "max_value")
    finite = lambda c: F.when(F.abs(c) < F.lit(float("inf")), c)
    shape = merged.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.min(finite(F.col("lo"))), F.min(finite(F.col("hi"))), F.lit(0.0)).alias("_min"),
        F.coalesce(F.max(finite(F.col("hi"))), F.max(finite(F.col("lo"))), F.lit(0.0)).alias("_max"),
    )
    origin = F.least("_min", "_max")
    span = F.greatest("_min", "_max") - origin
    shape = shape.select(
        "_key", origin.alias("_origin"), F.when(span > 0, span / F.col("_n")).otherwise(F.lit(1.0)).alias("_width"), F.col("_n").alias("_bins")
    )
    place = lambda c: bin_of(c, F.col("_origin"), F.col("_width"), F.col("_bins"))
    dealt = merged.join(shape, "_key").select(
        "_key", "lo", "hi", F.explode(F.sequence(place(F.col("lo")), place(F.col("hi")))).alias("_bin")
    ).select(F.struct("_key", "_bin").alias("_place"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")
    )

    left = df.withColumn(
        "_key",
        F.struct(
            F.col(system).cast("string").alias("system"),
            F.col(code).cast("string").alias("code"),
            F.col(unit).cast("string").alias("unit"),
        ),
    )
    x = F.col(value).cast("double")
    shaped = spread_left_join(left, shape, "_key")
    found = shaped.withColumn("_cell", F.when(x.isNotNull() & F.col("_bins").isNotNull(), F.struct("_key", place(x).alias("_bin"))))
    found = found.withColumn("_hash", spread_hash(found, "_cell", F.col("_cell").isNotNull()))
    dealt = dealt.withColumn("_hash2", F.xxhash64("_place"))
    inside = (F.col("_hash") == F.col("_hash2")) & (F.col("_cell") == F.col("_place")) & (x >= F.col("_lo")) & (x <= F.col("_hi"))
    joined = found.join(dealt, inside, "left")
    return joined.select(*[F.col(c) for c in df.columns if c != out], F.col("_lo").isNotNull().alias(out))


def unit_is_primary(
    df: DataFrame,
    units: DataFrame,
    content_set: str,
    system: str,
    code: str,
    unit: str,
    out: str = "unit_ok",
) -> DataFrame:
    """Is the unit the primary unit of (system, code)?"""
    primary = (
        units.filter(F.col("content_set") == content_set)
        .select(
            F.struct(
                F.col("system").cast("string").alias("system"),
                F.col("code").cast("string").alias("code"),
                F.col("unit").cast("string").alias("unit"),
            ).alias("_key")
        )
        .distinct()
        .withColumn("_ok", F.lit(True))
    )
    left = df.withColumn(
        "_key",
        F.struct(
            F.col(system).cast("string").alias("system"),
            F.col(code).cast("string").alias("code"),
            F.col(unit).cast("string").alias("unit"),
        ),
    )
    joined = spread_left_join(left, primary, "_key")
    return joined.withColumn(out, F.coalesce("_ok", F.lit(False))).drop("_key", "_ok")
