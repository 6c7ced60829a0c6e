"""Runs, reports over stored results, and run comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.functions.joins import hashable
from rubrica.sources import fixed

SAME_BELOW_PERCENT = 0.01
HIGHER_IS_BETTER = ("rowsPerSecond",)


def audit_records(
    df: DataFrame,
    run_id: str,
    row_number: Column,
    request_at: Column,
    response_at: Column,
    message_id: Column,
    success: Column,
    api_url: Column | None = None,
    status: Column | None = None,
    attempts: Column | None = None,
    error_type: Column | None = None,
    error_message: Column | None = None,
    request_body: Column | None = None,
    response_body: Column | None = None,
) -> DataFrame:
    """Audit log rows in the fixed column order; duration from the two times."""
    none = F.lit(None).cast("string")
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    duration = F.unix_millis(response_at) - F.unix_millis(request_at)
    cols = {
        "runId": F.lit(run_id),
        "rowNumber": row_number,
        "requestTimestamp": F.date_format(request_at, iso),
        "responseTimestamp": F.date_format(response_at, iso),
        "durationMs": duration,
        "apiUrl": F.lit("DRY_RUN") if api_url is None else api_url,
        "messageId": message_id,
        "httpStatus": none if status is None else status,
        "wasSuccess": success,
        "attemptCount": F.lit(1) if attempts is None else attempts,
        "errorType": none if error_type is None else error_type,
        "errorMessage": none if error_message is None else error_message,
        "requestBody": none if request_body is None else request_body,
        "responseBody": none if response_body is None else response_body,
    }
    return df.select(*[cols[c].alias(c) for c in fixed.AUDIT_COLUMNS])


def run_counters(messages: DataFrame, run: str, ok: Column, policy: str = "batch") -> DataFrame:
    """Per run: records, completed, failed and final status.

    ``batch``: COMPLETED whatever failed.  ``strict``: COMPLETE, or FAILED when any
    message failed.
    """
    out = messages.groupBy(run).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count(F.when(ok, 1)).alias("total_completed"),
        F.count(F.when(~ok, 1)).alias("total_failed"),
    )
    status = (
        F.lit("COMPLETED")
        if policy == "batch"
        else F.when(F.col("total_failed") > 0, "FAILED").otherwise("COMPLETE")
    )
    return out.withColumn("status", status)


IN_PROGRESS, RUN_COMPLETED, RUN_FAILED = "IN_PROGRESS", "COMPLETED", "FAILED"


def start_runs(runs: DataFrame) -> DataFrame:
    """Runs as they are opened: in progress, without counters."""
    none = F.lit(None)
    return runs.withColumns(
        {
            "status": F.lit(IN_PROGRESS),
            "total_records": none.cast("bigint"),
            "total_completed": none.cast("bigint"),
            "total_failed": none.cast("bigint"),
            "completed_at": none.cast("timestamp"),
        }
    )


def finish_runs(opened: DataFrame, messages: DataFrame, run: str, ok: Column, completed_at: Column) -> DataFrame:
    """Open runs closed as COMPLETED with the counters of their messages, also when all of these failed: a run is FAILED only
    when its job breaks off (see :func:`fail_runs`).  ``completed_at`` is an aggregate over a run's messages.  A run
    without messages stays in progress; closed runs are left as they are."""
    done = messages.groupBy(F.col(run).alias("run_id")).agg(
        F.count(F.lit(1)).alias("_records"),
        F.count(F.when(ok, 1)).alias("_completed"),
        completed_at.cast("timestamp").alias("_at"),
    )
    joined = opened.join(done, "run_id", "left")
    close = (F.col("status") == IN_PROGRESS) & F.col("_records").isNotNull()

    def set_to(name: str, value: Column) -> Column:
        return F.when(close, value).otherwise(F.col(name)).alias(name)

    new = {
        "status": F.lit(RUN_COMPLETED),
        "total_records": F.col("_records"),
        "total_completed": F.col("_completed"),
        "total_failed": F.col("_records") - F.col("_completed"),
        "completed_at": F.col("_at"),
    }
    return joined.select(*[set_to(c, new[c]) if c in new else F.col(c) for c in opened.columns])


def fail_runs(opened: DataFrame, failed_at: Column) -> DataFrame:
    """Open runs closed as FAILED; their counters stay unknown."""
    close = F.col("status") == IN_PROGRESS
    new = {"status": F.lit(RUN_FAILED), "completed_at": failed_at.cast("timestamp")}
    return opened.withColumns({c: F.when(close, v).otherwise(F.col(c)) for c, v in new.items()})


def guarded_run(
    opened: DataFrame,
    path: str,
    job: Callable[[], DataFrame],
    completed_at: Column,
    failed_at: Column | None = None,
    run: str = "run_id",
    ok: str = "ok",
) -> None:
    """Run a job between the opening and the closing of its runs.

    The opened runs are appended to the table at ``path``; ``job`` does the work and returns its messages
    (``run``, ``ok`` and what ``completed_at`` aggregates).  When they are there the runs are appended once more as
    closed, COMPLETED with counters; when the job or its messages fail, as FAILED, and the error goes on.
    ``current_runs`` reads the table."""
    spark = opened.sparkSession
    opened.withColumn("closed", F.lit(False)).write.mode("append").parquet(path)
    ids = opened.select("run_id")
    opened = spark.read.parquet(path).filter(~F.col("closed")).drop("closed").join(ids, "run_id", "left_semi")
    try:
        closing = finish_runs(opened, job(), run, F.col(ok), completed_at)
        closing.withColumn("closed", F.lit(True)).write.mode("append").parquet(path)
    except Exception:
        at = F.current_timestamp() if failed_at is None else failed_at
        fail_runs(opened, at).withColumn("closed", F.lit(True)).write.mode("append").parquet(path)
        raise


def current_runs(log: DataFrame) -> DataFrame:
    """One row for each run of a table written by :func:`guarded_run`: as it was closed, else as it was opened."""
    columns = [c for c in log.columns if c not in ("run_id", "closed")]
    last = F.max_by(F.struct(*columns), F.col("closed").cast("int"))
    return log.groupBy("run_id").agg(last.alias("_r")).select("run_id", "_r.*")


def count_by(results: DataFrame, column: str) -> DataFrame:
    """Results per value of a column, most frequent first."""
    return results.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def average_assessments(messages: DataFrame, results: DataFrame) -> DataFrame:
    """Message count, result count and results per message."""
    m = messages.agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("r"))
    r = results.agg(F.lit(0).cast("bigint").alias("n"), F.count(F.lit(1)).alias("r"))
    both = m.unionByName(r).agg(F.sum("n").alias("total_messages"), F.sum("r").alias("total_results"))
    ratio = F.round(F.col("total_results") / F.nullif("total_messages", F.lit(0)), 2)
    return both.withColumn("avg_per_message", ratio)


def distinct_values(results: DataFrame, column: str) -> DataFrame:
    return results.select(column).distinct().orderBy(column)


def latest(results: DataFrame, column: str, n: int = 5, *tiebreak: str) -> DataFrame:
    """The ``n`` newest rows by a column; ``tiebreak`` makes the pick unique."""
    return results.orderBy(F.desc(column), *tiebreak).limit(n)


#: Parts that the results of a run are dealt to; its row is there for each.
RUN_PARTS = 128


def with_run(results: DataFrame, runs: DataFrame, run_id: str = "run_id", spread: list[str] | None = None) -> DataFrame:
    """Results with the columns of their run.

    There are few runs and many results of each, so a run's results are dealt to parts by a hash of the
    columns ``spread``, by default all."""
    by = [F.col(f"`{c}`") for c in spread or hashable(results)]
    dealt = results.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(RUN_PARTS)))
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(RUN_PARTS - 1).cast("bigint")))
    return dealt.join(runs.withColumn("_part", parts), [run_id, "_part"], "inner").drop("_part")


def benchmark_summary(audit: DataFrame, stages: dict[str, Column] | None = None) -> DataFrame:
    """Run summary from audit records: counts, total time, rows per second, average
    time per row, and a sum per named stage."""
    extra = [F.sum(c).alias(f"stage:{n}") for n, c in (stages or {}).items()]
    ok = F.col("wasSuccess")
    base = audit.groupBy("runId").agg(
        F.count(F.lit(1)).alias("processed"),
        F.count(F.when(ok, 1)).alias("succeeded"),
        F.count(F.when(~ok, 1)).alias("failed"),
        F.sum("durationMs").alias("totalRunMs"),
        *extra,
    )
    per_second = F.col("processed") * 1000 / F.nullif("totalRunMs", F.lit(0))
    per_row = F.col("totalRunMs") / F.nullif("processed", F.lit(0))
    return base.withColumns(
        {
            "rowsPerSecond": F.coalesce(F.round(per_second, 2), F.lit(0.0)),
            "avgMsPerRow": F.coalesce(F.round(per_row, 2), F.lit(0.0)),
        }
    )


def to_metrics(summary: DataFrame, run: str) -> DataFrame:
    """A wide summary as (run, metric, value) rows."""
    names = [c for c in summary.columns if c != run]
    wide = summary.select(run, *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    return wide.unpivot([run], names, "metric", "value")


def delta_percent(base: Column, candidate: Column) -> Column:
    """Change in percent; from 0 it is 0 when both are 0, else unknown."""
    return (
        F.when(base.isNull() | candidate.isNull(), F.lit(None))
        .when(base == 0, F.when(candidate == 0, F.lit(0.0)))
        .otherwise((candidate - base) / F.nullif(base, F.lit(0.0)) * 100)
    )


def verdict(metric: Column, delta: Column) -> Column:
    better = F.when(metric.isin(*HIGHER_IS_BETTER), delta > 0).otherwise(delta < 0)
    return (
        F.when(delta.isNull(), "UNKNOWN")
        .when(F.abs(delta) < SAME_BELOW_PERCENT, "SAME")
        .when(better, "BETTER")
        .otherwise("WORSE")
    )


def compare_runs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Two (metric, value) tables side by side with change and verdict."""
    joined = baseline.select("metric", F.col("value").alias("baseline")).join(
        candidate.select("metric", F.col("value").alias("candidate")), "metric", "full_outer"
    )
    delta = delta_percent(F.col("baseline"), F.col("candidate"))
    return joined.withColumn("delta_percent", delta).withColumn(
        "verdict", verdict(F.col("metric"), F.col("delta_percent"))
    )
