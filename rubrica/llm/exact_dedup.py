"""Exact deduplication by content sort.

Rows are range-partitioned by sampled splitters over (first bytes of the text, digest of it
all, id) and sorted externally, so equal texts lie next to each other and a text that a
third of all rows share is split over several ranges.  Neighbours are compared in full; a run that crosses a range border
is joined again by its digest.

Defined cases: null text counts as empty; a null id is smaller than any other and the
rows of a text whose ids are all null keep null; repeated rows (same id and text) all
carry the id that stays, and exactly one of them is kept; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.llm.shared import cut_lineage, text_or_empty

#: Bytes of a text that splitters hold.
HEAD = 32

RUN_SCHEMA = (
    "doc_id long, digest string, part int, local_keep long, local_size long, local_first boolean, border boolean"
)
OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("digest", pa.string()),
        ("part", pa.int32()),
        ("local_keep", pa.int64()),
        ("local_size", pa.int64()),
        ("local_first", pa.bool_()),
        ("border", pa.bool_()),
    ]
)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal texts in one sorted range; ``border`` marks the range's first and last run."""
    part = TaskContext.get().partitionId()
    ids: list = []
    text: pa.Scalar | None = None
    mark: pa.Scalar | None = None
    first = True

    def emit(border: bool) -> pa.RecordBatch:
        n = len(ids)
        digest = mark.as_py().hex()
        columns = [
            pa.array(ids, pa.int64()),
            pa.repeat(digest, n),
            pa.repeat(pa.scalar(part, pa.int32()), n),
            pa.repeat(pa.scalar(ids[0], pa.int64()), n),
            pa.repeat(pa.scalar(n, pa.int64()), n),
            pa.array([True] + [False] * (n - 1)),
            pa.repeat(pa.scalar(border), n),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=OUT)

    def emit_single(rows: list, marks: list) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rows, pa.int64()),
                pa.array([m.as_py().hex() for m in marks], pa.string()),
                pa.repeat(pa.scalar(part, pa.int32()), n),
                pa.array(rows, pa.int64()),
                pa.repeat(pa.scalar(1, pa.int64()), n),
                pa.repeat(pa.scalar(True), n),
                pa.repeat(pa.scalar(False), n),
            ],
            schema=OUT,
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        texts, digests, keys = batch.column(1), batch.column(2), batch.column(0).to_pylist()
        n = batch.num_rows
        new = [0] if text is None or not text.equals(texts[0]) else []
        if n > 1:
            changes = pc.not_equal(texts.slice(1), texts.slice(0, n - 1))
            new += [i + 1 for i in pc.indices_nonzero(changes).to_pylist()]
        single_ids: list = []
        single_marks: list = []
        if not new or new[0] != 0:
            ids += keys[: new[0] if new else n]
        for start, end in zip(new, [*new[1:], n]):
            if ids:
                if len(ids) == 1 and not first:
                    single_ids.append(ids[0])
                    single_marks.append(mark)
                else:
                    yield emit(first)
                first = False
            ids, text, mark = keys[start:end], texts[start], digests[start]
        if single_ids:
            yield emit_single(single_ids, single_marks)
    if ids:
        yield emit(True)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep``: which id of a group stays, "smallest" or "largest".  ``normalise`` maps the
    text column before it is compared (none: texts must be identical).
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    text = text_or_empty(text_col)
    if normalise is not None:
        text = F.coalesce(normalise(text), F.lit(""))
    order = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("body"))
    # Splitters are drawn from the first bytes and the digest: whole texts stay off the driver.
    rows = rows.select(
        "doc_id", "body", F.substring("body", 1, HEAD).alias("head"), F.unhex(F.sha2("body", 256)).alias("digest")
    )
    by = [F.col("head"), F.col("digest"), order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "body", "digest")
    runs = cut_lineage(ranged.mapInArrow(_runs, RUN_SCHEMA))

    # Only the first and last run of a range can go on in another one: two rows a range.
    # Ranges follow the sort order, so the lowest one begins with the row that stays.
    borders = (
        runs.filter("border AND local_first")
        .groupBy(F.col("digest").alias("border_digest"))
        .agg(
            F.min_by("local_keep", "part").alias("whole_keep"),
            F.sum("local_size").alias("whole_size"),
            F.min("part").alias("whole_part"),
        )
    )
    joined = runs.join(F.broadcast(borders), F.col("digest") == F.col("border_digest"), "left")
    inside = F.col("border_digest").isNull()
    return joined.select(
        "doc_id",
        F.when(inside, F.col("local_keep")).otherwise(F.col("whole_keep")).alias("keep_id"),
        F.when(inside, F.col("local_size")).otherwise(F.col("whole_size")).alias("group_size"),
        (F.col("local_first") & (inside | (F.col("part") == F.col("whole_part")))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
