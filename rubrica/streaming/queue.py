"""Scoring as messages arrive, with Structured Streaming.

A message's rows never leave its micro-batch, so each batch runs the same
plan as a batch job.  Sinks replace the partition of their batch, so a
batch that is run again leaves no second copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from rubrica.operators.message_rows import message_cards
from rubrica.operators.rollup import message_scores
from rubrica.plans.rubric import CompiledRubric
from rubrica.sources.messages import MESSAGE_SCHEMA, check_messages
from rubrica.sources.sinks import DONE, PENDING, QUEUE_FAILED, QUEUE_SCHEMA, pending, requeue, write_batch, write_together


def message_stream(spark: SparkSession, path: str, schema: str = MESSAGE_SCHEMA, **options) -> DataFrame:
    """Messages dropped as JSON-lines files into a folder."""
    return spark.readStream.schema(schema).options(**options).json(path)


def queue_stream(spark: SparkSession, path: str, run_id: int | None = None, **options) -> DataFrame:
    """Pending items of a queue table."""
    schema = f"{QUEUE_SCHEMA}, batch_id bigint"
    return pending(spark.readStream.schema(schema).options(**options).parquet(path), run_id).drop("batch_id")


def drop_redelivered(
    messages: DataFrame, keys: list[str], event_time: str, delay: str = "1 hour"
) -> DataFrame:
    """Drop messages delivered again within the delay."""
    return messages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def score_batch(batch: DataFrame, compiled: CompiledRubric, keys: list[str]) -> DataFrame:
    """Scores of one batch, errors included."""
    checked = check_messages(batch, compiled.model, compiled.rubric.model_mnemonic)
    scores = message_scores(message_cards(checked, compiled, keys), keys).select(
        *keys, "numerator", "denominator", "score", "weighted_score", "critical_failure_count", "succeeded"
    )
    rejected = checked.filter(F.col("error_message").isNotNull()).select(
        *keys, F.lit(False).alias("succeeded"), "error_message"
    )
    return scores.unionByName(rejected, allowMissingColumns=True)


def score_stream(
    messages: DataFrame,
    compiled: CompiledRubric,
    keys: list[str],
    out: str,
    checkpoint: str,
    after: Callable[[DataFrame, int], None] | None = None,
) -> DataStreamWriter:
    """Score messages as they arrive and write the scores by batch.  ``after`` gets the scores of each batch,
    also of one without messages."""

    def run(batch: DataFrame, batch_id: int) -> None:
        # The batch is read for scores and for rejected messages, the scores for the sink and ``after``: once each.
        batch = batch.persist()
        scores = score_batch(batch, compiled, keys).persist()
        try:
            write_batch(scores, out, batch_id)
            if after is not None:
                after(scores, batch_id)
        finally:
            scores.unpersist()
            batch.unpersist()

    return messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


SCORES, STATUS = "scores", "status"


def drain_queue(
    queue: DataFrame,
    compiled: CompiledRubric,
    out: str,
    checkpoint: str,
    max_retries: int = 3,
    requeue_to: str | None = None,
    before_write: Callable[[DataFrame, DataFrame, int], tuple[DataFrame, DataFrame]] | None = None,
) -> DataStreamWriter:
    """Score pending queue items; write scores and one status row per item and attempt.

    Scores and status of a batch are one write (``sinks.write_together``), so both are there or neither.
    A failed item stays PENDING with one more retry until ``max_retries``, then it is
    FAILED.  With ``requeue_to`` (the folder the queue is read from) it is put there again, in this batch's
    partition, so that the stream takes it once more; a repeated batch replaces that partition and reads no other.
    ``before_write`` may alter both outputs.
    """
    keys = ["id", "retry_count"]

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        body = F.from_json("payload_json", MESSAGE_SCHEMA)
        messages = batch.select("id", "run_id", "retry_count", body.alias("m")).select("id", "run_id", "retry_count", "m.*")
        scored = score_batch(messages, compiled, keys).persist()
        try:
            status = batch.drop("error_message").join(
                scored.select(*keys, "succeeded", F.col("error_message").alias("error_message")), keys, "left"
            )
            ok = F.coalesce("succeeded", F.lit(False))
            retries = F.when(ok, F.col("retry_count")).otherwise(F.col("retry_count") + 1)
            state = F.when(ok, DONE).when(retries >= max_retries, QUEUE_FAILED).otherwise(PENDING)
            settled = status.withColumns({"status": state, "retry_count": retries})
            both = scored, settled.select("id", "run_id", "status", "retry_count", "error_message")
            if before_write is not None:
                both = before_write(*both, batch_id)
            write_together({SCORES: both[0], STATUS: both[1]}, out, batch_id)
            if requeue_to is not None:
                requeue(settled.filter(F.col("status") == PENDING), requeue_to, batch_id)
        finally:
            scored.unpersist()
            batch.unpersist()

    return queue.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def count_batches(out: str) -> Callable[[DataFrame, int], None]:
    """Writes one counter row per batch; sum them for live run counters."""

    def after(scores: DataFrame, batch_id: int) -> None:
        counters = scores.agg(
            F.count(F.lit(1)).alias("records"),
            F.count(F.when(F.col("succeeded"), 1)).alias("completed"),
            F.count(F.when(~F.col("succeeded"), 1)).alias("failed"),
        )
        write_batch(counters, out, batch_id)

    return after


def live_counters(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).agg(
        F.sum("records").alias("total_records"),
        F.sum("completed").alias("total_completed"),
        F.sum("failed").alias("total_failed"),
    )
