"""Left joins that survive hot keys.

The joins are plain ones on purpose: Spark broadcasts a right side it finds small, and
splits rows of a hot key on the left (skew join), however many there are.  What it cannot
know is that rows without a key match nothing; they are spread here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hashable(df: DataFrame) -> list[str]:
    """Columns that a hash can be taken of (maps have none)."""

    def fine(t: T.DataType) -> bool:
        if isinstance(t, T.ArrayType):
            return fine(t.elementType)
        if isinstance(t, T.StructType):
            return all(fine(f.dataType) for f in t.fields)
        return not isinstance(t, (T.MapType, T.VariantType))

    return [f.name for f in df.schema.fields if fine(f.dataType)]


def spread_hash(df: DataFrame, key: str, usable: Column) -> Column:
    """Hash of the key, or of the whole row where the key is not usable."""
    return F.when(usable, F.xxhash64(F.col(key))).otherwise(F.xxhash64(*[F.col(f"`{c}`") for c in hashable(df)], F.lit(1)))


def marked(*values: Column) -> Column:
    """Which of some values are null, as bits: hashes pass nulls over."""
    bits = F.lit(0)
    for k, value in enumerate(values):
        bits = bits + F.when(value.isNull(), 1 << k).otherwise(0)
    return bits


class ListKeys:
    """Lists in columns of a frame by surrogate keys of two longs, so that neither lists nor their
    texts travel to a join.

    Both longs are 64-bit hashes of a list's size, entries and marks, from different seeds.  Two of a trillion
    lists agree in all 128 bits with a chance below one in ten billion.  ``entries`` maps each column to
    another form of its list, the one that is hashed and listed; ``mark`` tells what the hash of an entry passes over.
    """

    def __init__(self, df: DataFrame, entries: dict[str, Column], mark: Callable[[Column], Column] = lambda v: marked(v)):
        self.columns = list(entries)
        self.others = [c for c in df.columns if c not in entries]
        listed = df.select(*self.others, *[c.alias(n) for n, c in entries.items()])
        # Marks are columns of their own, so that both hashes read the same ones.
        marks = {f"_m{i}": F.when(F.size(name) > 0, F.transform(name, mark)) for i, name in enumerate(self.columns)}
        keys = {}
        for i, name in enumerate(self.columns):
            parts = F.size(name), F.col(name), F.col(f"_m{i}")
            keys |= {f"_{n}{i}": F.when(F.col(f"_m{i}").isNotNull(), F.xxhash64(F.lit(seed), *parts)) for n, seed in (("x", 1), ("y", 2))}
        self.keyed = listed.withColumns(marks).withColumns(keys).drop(*marks)

    def dictionary(self) -> DataFrame:
        """k1, k2, entry: the entries of each list, equal ones once a task and then once."""
        each = F.explode(F.array(*[F.struct(F.col(f"_x{i}").alias("k1"), F.col(f"_y{i}").alias("k2"), F.col(n).alias("list")) for i, n in enumerate(self.columns)]))
        # Outer, as for others Spark would push a test of the list's size below its parsing.
        rows = self.keyed.select(each.alias("_l")).select("_l.k1", "_l.k2", F.explode_outer("_l.list").alias("entry"))
        return rows.select(F.when(F.col("entry").isNotNull(), F.struct("k1", "k2", "entry")).alias("_r")).distinct().select("_r.*").filter("k2 IS NOT NULL")

    def join(self, answers: DataFrame, answer: str, out: dict[str, str]) -> DataFrame:
        """The frame without its lists and with the ``answer`` of each list's key in the column that ``out`` names.

        Rows of a hot list are on the left, where Spark splits them; rows without a list are spread by
        their other columns."""
        df = self.keyed.drop(*self.columns)
        for i, name in enumerate(self.columns):
            spread = F.xxhash64(*[F.col(f"`{c}`") for c in hashable(df.select(*self.others))], F.lit(1))
            left = df.withColumn(f"_x{i}", F.coalesce(f"_x{i}", spread))
            right = answers.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col(answer).alias(out[name]))
            df = left.join(right, (left[f"_x{i}"] == right["_k1"]) & (left[f"_y{i}"] == right["_k2"]), "left").drop("_k1", "_k2", f"_x{i}", f"_y{i}")
        return df


def spread_left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` left-joined to ``right`` (unique in ``key``)."""
    marked = left.withColumn("_hash", spread_hash(left, key, F.col(key).isNotNull()))
    other = right.withColumn("_hash2", F.xxhash64(key)).withColumnRenamed(key, "_right")
    same = (F.col("_hash") == F.col("_hash2")) & (F.col(key) == F.col("_right"))
    return marked.join(other, same, "left").drop("_hash", "_hash2", "_right")
