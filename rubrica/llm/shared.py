"""Small helpers that several operators of this folder use."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.functions.stored import checkpoint_folder
from rubrica.functions.stored import stored as cut_lineage

__all__ = ["checkpoint_folder", "crc_of", "cut_lineage", "fit_in_task", "held_out", "slices", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_of(column: Column) -> Column:
    """CRC-32 of a string's UTF-8 bytes, unsigned."""
    return F.crc32(column.cast("binary"))


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows no label may be learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(crc_of(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20):
    """Cut a batch into pieces of at most about ``max_bytes`` of text, at least one row each."""
    at = batch.schema.get_field_index(column)
    texts = batch.column(at)
    start = size = 0
    lengths = pc.binary_length(texts.cast(pa.binary())).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and size + n > max_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


def fit_in_task(rows: DataFrame, fit: Callable[[list, list], Any]) -> Any:
    """A model fitted by one task on the two columns of a frame of bounded size; None without a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list = []
        second: list = []
        for batch in batches:
            first += batch.column(0).to_pylist()
            second += batch.column(1).to_pylist()
        model = pickle.dumps(fit(first, second))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    got = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else None
