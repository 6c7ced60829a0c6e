"""Gapless numbers within keys, without one task per key.

Rows are range-partitioned by (key, spread), so a key that holds a third of all rows is
split; each row gets its place within (range, key).  A range holds only the keys between
its borders, so there are at most ranges + keys pairs, and only these counts go to the
driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.shared import cut_lineage


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    last, count = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        base = np.repeat(starts, np.diff(np.r_[starts, n]))
        place = np.arange(n) - base
        if last is not None and keys[0] == last:
            place[: starts[1] if len(starts) > 1 else n] += count
        last, count = keys[-1], int(place[-1]) + 1
        columns = [*batch.columns, pa.repeat(pa.scalar(part, pa.int32()), n), pa.array(place, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "place"])


def numbered(df: DataFrame, key: str, spread: list[str]) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The rows with ``part`` and ``place``, written once, and (part, key, rows) sorted.

    ``key`` is a non-null integer column, ``spread`` the columns that order rows within it.
    """
    rest = [c for c in df.columns if c != key]
    ordered = df.select(F.col(key).cast("long").alias(key), *rest)
    ranged = ordered.repartitionByRange(key, *spread).sortWithinPartitions(key, *spread)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    rows = cut_lineage(ranged.mapInArrow(_number, f"{fields}, part int, place long"))
    counts = rows.groupBy("part", key).agg((F.max("place") + 1).alias("n")).collect()
    return rows, sorted((r["part"], r[key], r["n"]) for r in counts)


def offsets(counts: list[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
    """Rows of the same key in earlier ranges, for each (part, key)."""
    seen: dict[int, int] = {}
    out = {}
    for part, key, n in counts:
        out[part, key] = seen.get(key, 0)
        seen[key] = out[part, key] + n
    return out
