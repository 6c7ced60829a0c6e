"""Result sinks: flat audit files, run and result tables, queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.sources import fixed

RUN_SCHEMA = (
    "id bigint, run_name string, model_mnemonic string, rubric_mnemonic string, status string, "
    "total_evaluations bigint, total_records bigint, total_completed bigint, total_failed bigint, "
    "created_at timestamp, completed_at timestamp"
)
RESULT_SCHEMA = (
    "run_id bigint, row_num int, message_id string, data_class string, attribute_name string, "
    "attribute_value string, assessment string, status string, reason string, effect string, "
    "created_at timestamp"
)
QUEUE_SCHEMA = (
    "id bigint, run_id bigint, payload_json string, status string, retry_count int, "
    "error_message string, created_at timestamp"
)
PENDING, DONE, QUEUE_FAILED = "PENDING", "DONE", "FAILED"


def align(df: DataFrame, schema: str) -> DataFrame:
    """Add the columns of a target schema that are missing (as NULL); never drop one."""
    empty = df.sparkSession.createDataFrame([], schema)
    out = empty.unionByName(df, allowMissingColumns=True)
    return out


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fail the write when a required column is missing a value."""
    checked = [
        F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is required"))).otherwise(F.col(c)).alias(c)
        for c in columns
    ]
    rest = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*checked, *rest).select(*df.columns)


def write_audit_json(audit: DataFrame, path: str, mode: str = "overwrite") -> None:
    audit.select(*fixed.AUDIT_COLUMNS).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_audit_csv(audit: DataFrame, path: str, mode: str = "overwrite") -> None:
    audit.select(*fixed.AUDIT_COLUMNS).write.mode(mode).csv(
        path, header=True, quote='"', escape='"', emptyValue="", nullValue=""
    )


def csv_line(columns: list[str]) -> Column:
    """One CSV line per row: a cell with a comma, quote or line break is quoted,
    its quotes doubled; missing cells are empty."""

    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)

    return F.concat_ws(",", *[cell(c) for c in columns])


def write_results(results: DataFrame, path: str, mode: str = "append", runs: DataFrame | None = None, run_key: str = "id") -> None:
    """Result rows by run; run id and row number are required.  With the run table given, a row of a
    run that is not there fails the write, which then leaves nothing."""
    checked = require(align(results, RESULT_SCHEMA), "run_id", "row_num", "message_id")
    if runs is not None:
        checked = refer(checked, "run_id", runs, run_key)
    checked.write.mode(mode).partitionBy("run_id").parquet(path)


def refer(df: DataFrame, column: str, table: DataFrame, key: str) -> DataFrame:
    """Rows as they are; the job fails with the value of one that ``table`` does not have under ``key``."""
    known = table.select(F.col(key).alias("_key")).filter("_key IS NOT NULL").distinct().withColumn("_known", F.lit(True))
    stray = F.concat(F.lit(f"{column} "), F.col(column).cast("string"), F.lit(" refers to no row"))
    joined = df.join(known, F.col(column) == F.col("_key"), "left")
    held = F.when(F.col("_known").isNull() & F.col(column).isNotNull(), F.raise_error(stray)).otherwise(F.col(column))
    return joined.select(*[held.cast(df.schema[c].dataType).alias(c) if c == column else F.col(c) for c in df.columns])


def write_run(run: DataFrame, path: str, mode: str = "append") -> None:
    align(run, RUN_SCHEMA).write.mode(mode).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 1000, mode: str = "append", **options) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch, **options).mode(mode).save()


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One micro-batch, all or nothing: a repeated batch replaces its own partition."""
    (
        df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def write_together(outputs: dict[str, DataFrame], path: str, batch_id: int) -> None:
    """Several outputs of a micro-batch as one job into one partition, told apart by the column
    ``kind``: readers find all of them or none, and a repeated batch replaces them together."""
    frames = [df.withColumn("kind", F.lit(kind)) for kind, df in outputs.items()]
    both = frames[0]
    for more in frames[1:]:
        both = both.unionByName(more, allowMissingColumns=True)
    write_batch(both, path, batch_id)


def read_together(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One of the outputs of :func:`write_together`."""
    return spark.read.parquet(path).filter(F.col("kind") == kind).drop("kind")


#: The batch of items that no batch of a stream has put there.
ENQUEUED = -1
#: Items of a file of the queue.  A payload is much larger than what it is made of and compresses well, so that a file without
#: a bound would be a whole queue from one small file, and one task of the stream that reads it.
ITEMS_A_FILE = 25_000


def enqueue(messages: DataFrame, run_id: int, path: str, item_id: Column, created_at: Column | None = None) -> None:
    """Messages as pending queue items.  A queue is partitioned by run and by the batch that wrote an item."""
    items = messages.select(
        item_id.cast("bigint").alias("id"),
        F.to_json(F.struct(*[c for c in messages.columns])).alias("payload_json"),
        F.lit(PENDING).alias("status"),
        F.lit(0).alias("retry_count"),
        F.lit(None).cast("string").alias("error_message"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        F.lit(run_id).cast("bigint").alias("run_id"),
        F.lit(ENQUEUED).cast("bigint").alias("batch_id"),
    )
    items.write.mode("append").option("maxRecordsPerFile", ITEMS_A_FILE).partitionBy("run_id", "batch_id").parquet(path)


def requeue(items: DataFrame, path: str, batch_id: int) -> None:
    """Items to be tried again, as the partition of the batch that tried them: repeated, it is replaced."""
    rows = items.select(*[f.split()[0] for f in QUEUE_SCHEMA.split(", ")]).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ITEMS_A_FILE).partitionBy("run_id", "batch_id").parquet(path)


def pending(queue: DataFrame, run_id: int | None = None) -> DataFrame:
    """Pending items, of one run when given: only that run's partitions are read, and the status reaches the scan."""
    out = queue.filter(F.col("status") == PENDING)
    return out if run_id is None else out.filter(F.col("run_id") == run_id)


def write_response(response: DataFrame, path: str, mode: str = "overwrite") -> None:
    response.write.mode(mode).json(path)
