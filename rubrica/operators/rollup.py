"""Roll-ups of scorecards and results: element, class, message, and by check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.functions.joins import spread_left_join
from rubrica.functions.scores import score32
from rubrica.functions.text import class_display_name
from rubrica.operators.evaluate import COUNTERS
from rubrica.plans.checks import ERRORED, FAILED, PASSED, SKIPPED
from rubrica.plans.rubric import CompiledRubric
from rubrica.sources.model import EntityModel


def element_rollup(cards: DataFrame, keys: list[str]) -> DataFrame:
    """Per element: totals over scoring and informational criteria, passes and
    fails over scoring ones."""
    return cards.select(
        *keys,
        "class_mnemonic",
        "element_seq",
        (F.col("scoring_total") + F.col("info_total")).alias("total"),
        (F.col("scoring_skip") + F.col("info_skip")).alias("skip"),
        (F.col("scoring_processed") + F.col("info_processed")).alias("processed"),
        "scoring_processed",
        "info_processed",
        F.col("scoring_pass").alias("pass"),
        F.col("scoring_fail").alias("fail"),
        "critical_fail",
        F.col("weighted_processed").alias("weighted_denominator"),
        F.col("weighted_pass").alias("weighted_numerator"),
        (F.col("scoring_fail") == 0).alias("is_clean"),
    )


def class_sums(cards: DataFrame, keys: list[str]) -> DataFrame:
    """Sums per message and class, with instances and clean elements."""
    is_element = F.col("is_element") == 1
    clean = F.when(is_element & (F.col("scoring_fail") == 0), 1).otherwise(0)
    return cards.groupBy(*keys, "class_mnemonic").agg(
        *[F.sum(n).alias(n) for n in COUNTERS],
        F.sum("errors").alias("errors"),
        F.sum("is_element").alias("instance_count"),
        F.sum(clean).cast("bigint").alias("clean_count"),
    )


def with_scores(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "numerator": F.col("scoring_pass"),
            "denominator": F.col("scoring_processed"),
            "score": score32(F.col("scoring_pass"), F.col("scoring_processed")),
            "weighted_numerator": F.col("weighted_pass"),
            "weighted_denominator": F.col("weighted_processed"),
            "weighted_score": score32(F.col("weighted_pass"), F.col("weighted_processed")),
            "critical_failure_count": F.col("critical_fail"),
        }
    )


def class_scores(cards: DataFrame, keys: list[str], model: EntityModel | None = None) -> DataFrame:
    """Scores per message and class.  With a model, every class of it appears for every
    message, zeros included, and the display name is added."""
    if model is None:
        return with_scores(class_sums(cards, keys).filter(F.col("class_mnemonic").isNotNull()))
    # Every class of a message is looked up in its sums; at most one entry per class of the model.
    sums = class_sums(cards, keys)
    numbers = [c for c in sums.columns if c not in keys and c != "class_mnemonic"]
    entry = F.struct("class_mnemonic", F.struct(*numbers).alias("sums"))
    packed = sums.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("class_mnemonic").isNotNull(), entry))).alias("_sums")
    )
    classes = F.explode(F.array(*[F.lit(c.mnemonic) for c in model.classes]))
    listed = packed.select(*keys, "_sums", classes.alias("class_mnemonic")).select(
        *keys, "class_mnemonic", F.try_element_at("_sums", F.col("class_mnemonic")).alias("_s")
    )
    zero = F.lit(0).cast("bigint")
    out = with_scores(
        listed.select(*keys, "class_mnemonic", *[F.coalesce(F.col("_s")[n], zero).alias(n) for n in numbers])
    )
    pairs = [F.lit(x) for c in model.classes for x in (c.mnemonic, c.field)]
    return out.withColumn(
        "class_name",
        class_display_name(F.try_element_at(F.create_map(*pairs), F.col("class_mnemonic"))),
    )


def message_sums(cards: DataFrame, keys: list[str]) -> DataFrame:
    """Sums per message, in one step: partial sums leave one row per task and message,
    however many elements a message has."""
    return cards.groupBy(*keys).agg(
        *[F.sum(n).alias(n) for n in COUNTERS],
        F.sum("errors").alias("errors"),
        F.sum("is_element").alias("instance_count"),
    )


def message_scores(cards: DataFrame, keys: list[str]) -> DataFrame:
    """Scores per message; ``succeeded`` is false when a check errored, and such a
    message has no scores."""
    out = with_scores(message_sums(cards, keys)).withColumn("succeeded", F.col("errors") == 0)
    void = [
        "numerator",
        "denominator",
        "score",
        "weighted_numerator",
        "weighted_denominator",
        "weighted_score",
        "critical_failure_count",
    ]
    return out.withColumns({c: F.when(F.col("succeeded"), F.col(c)) for c in void})


def first_errors(rows: DataFrame, keys: list[str], model: EntityModel) -> DataFrame:
    """The first error of each message in evaluation order: classes by name,
    elements by sequence, attributes by name, then the element, the class and at
    last the root, each by criterion sequence."""
    names = [F.lit(x) for c in model.classes for x in (c.mnemonic, c.label)]
    order = F.struct(
        (F.col("level") == "root").alias("a"),
        F.try_element_at(F.create_map(*names), F.col("class_mnemonic")).alias("b"),
        (F.col("level") == "class").alias("c"),
        F.col("element_seq").alias("d"),
        (F.col("level") == "element").alias("e"),
        F.col("name").alias("f"),
        F.col("sequence").alias("g"),
    )
    return (
        rows.filter(F.col("state_code") == ERRORED)
        .groupBy(*keys)
        .agg(F.min_by("reason", order).alias("error_message"))
    )


def drop_errored(rows: DataFrame, compiled: CompiledRubric, keys: list[str]) -> DataFrame:
    """Result rows of messages in which no check errored.  Costs nothing when the
    rubric's chains rule errors out."""
    if not compiled.may_error:
        return rows
    bad = rows.filter(F.col("state_code") == ERRORED).select(*keys).distinct().withColumn("_bad", F.lit(True))
    key = F.struct(*keys)
    marked = spread_left_join(rows.withColumn("_key", key), bad.select(key.alias("_key"), "_bad"), "_key")
    return marked.filter(F.col("_bad").isNull()).drop("_key", "_bad")


def _count(cond: Column, name: str) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint").alias(name)


def informational(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Informational criteria per (entity, check): instances, processed, passed."""
    code = F.col("state_code")
    return (
        rows.filter(~F.col("is_scoring"))
        .groupBy(*keys, "class_mnemonic", "entity", "check")
        .agg(
            F.first("name").alias("entity_name"),
            F.min_by("assessment", "sequence").alias("evaluation_name"),
            F.count(F.lit(1)).alias("instance_count"),
            _count(code == SKIPPED, "skipped"),
            _count(code.isin(PASSED, FAILED), "denominator"),
            _count(code == PASSED, "numerator"),
            _count(code == FAILED, "failed"),
        )
    )


def skip_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return (
        rows.filter(F.col("state_code") == SKIPPED)
        .groupBy(*keys, "entity", "check", "skip_check")
        .agg(F.count(F.lit(1)).alias("skip_count"))
    )


def fail_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Failures by (entity, check, failing check); informational ones included."""
    return (
        rows.filter(F.col("state_code") == FAILED)
        .groupBy(*keys, "entity", "check", "fail_check")
        .agg(F.count(F.lit(1)).alias("fail_count"))
    )


def critical_failures(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Failures of critical criteria, scoring or not, by the key of ``fail_counts``."""
    return (
        rows.filter((F.col("state_code") == FAILED) & F.col("is_critical"))
        .groupBy(*keys, "entity", "check", "fail_check")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count(F.lit(1)).alias("processed"),
            F.count(F.lit(1)).alias("failed"),
        )
    )
