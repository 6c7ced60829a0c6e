"""Audit view of scored messages and assessment extraction."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.functions.scores import score64
from rubrica.functions.text import class_display_name, truncate_value
from rubrica.functions.values import Item, data_json, json_text, parsed_item
from rubrica.operators.evaluate import results, wide_counters
from rubrica.plans.checks import FAILED, PASSED
from rubrica.plans.rubric import CompiledRubric, criterion_code, mask_columns
from rubrica.sources import fixed
from rubrica.sources.model import EntityModel


def _sum(cond: Column, what: Column | None = None) -> Column:
    value = F.lit(1) if what is None else what
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("bigint")


def _audit_sums(prefix: str) -> list[Column]:
    scoring = F.col("is_scoring")
    done = scoring & F.col("state_code").isin(PASSED, FAILED)
    passed = scoring & (F.col("state_code") == PASSED)
    failed = scoring & (F.col("state_code") == FAILED)
    return [
        _sum(passed).alias(f"{prefix}_numerator"),
        _sum(done).alias(f"{prefix}_denominator"),
        _sum(passed, F.col("weight")).alias("_wn"),
        _sum(done, F.col("weight")).alias("_wd"),
        _sum(failed & F.col("is_critical")).alias(f"{prefix}_critical_failure_count"),
    ]


def _audit_scores(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumns(
        {
            f"{prefix}_score": score64(F.col(f"{prefix}_numerator"), F.col(f"{prefix}_denominator")),
            f"{prefix}_score_weighted": score64(F.col("_wn"), F.col("_wd")),
        }
    ).drop("_wn", "_wd")


def attribute_audit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Audit score per attribute."""
    attrs = rows.filter(F.col("level") == "attribute")
    grouped = attrs.groupBy(*keys, "class_mnemonic", "element_seq", "entity").agg(*_audit_sums("attribute"))
    return _audit_scores(grouped, "attribute")


def element_audit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Audit score per element, over its attribute and element criteria."""
    inside = rows.filter(F.col("level").isin("attribute", "element"))
    grouped = inside.groupBy(*keys, "class_mnemonic", "element_seq").agg(*_audit_sums("element"))
    return _audit_scores(grouped, "element")


def message_audit(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Message audit block: all numbers as text, scores in 64-bit arithmetic."""
    n, d = F.col("numerator"), F.col("denominator")
    wn, wd = F.col("weighted_numerator"), F.col("weighted_denominator")
    return scores.select(
        *keys,
        n.cast("string").alias("messageNumerator"),
        d.cast("string").alias("messageDenominator"),
        score64(n, d).cast("string").alias("messageScore"),
        wn.cast("string").alias("messageNumeratorWeighted"),
        wd.cast("string").alias("messageDenominatorWeighted"),
        score64(wn, wd).cast("string").alias("messageScoreWeighted"),
        F.col("critical_failure_count").cast("string").alias("messageCriticalFailureCount"),
    )


_ITEM_SCHEMA = (
    "struct<attributeMnemonic:string,attributeName:string,assessment:string,"
    "effect:string,status:string,reason:string>"
)


def _quote(text: Column) -> Column:
    """A JSON string literal."""
    return json_text(F.coalesce(text, F.lit("")))


def _nodes(evaluated: DataFrame, compiled: CompiledRubric, keys: list[str], levels: tuple[str, ...], together: bool = False) -> DataFrame:
    """One row per attribute (and element, if asked for): its audit node as JSON text, its sums and failures.
    With ``together`` the items of a message go to one task, before their criteria multiply them."""
    item = parsed_item()
    data = F.when(
        (F.col("level") == "attribute") & F.col("present"),
        data_json(item, F.col("v_type"), F.col("v_type_text"), compiled.ctx.code_systems.canonical_col),
    )
    others = [c for c in evaluated.columns if c not in AUDIT_VALUES and c != "data"]
    packed = evaluated.filter(F.col("level").isin(*levels)).select(*others, data.alias("data"))
    if together:
        packed = packed.repartition(*keys)
    rows = results(packed, compiled, keys, ["data", "element"], outer=True)
    shown = F.struct(
        F.col("assessment").alias("_sort"),
        F.col("sequence").alias("_seq"),
        F.struct(
            F.col("entity").alias("attributeMnemonic"),
            F.col("name").alias("attributeName"),
            F.col("assessment").alias("assessment"),
            F.col("effect").alias("effect"),
            F.col("state").alias("status"),
            F.col("reason").alias("reason"),
        ).alias("item"),
        F.col("is_scoring").alias("_scoring"),
    )
    scored = F.col("state_code").isNotNull()
    grouped = rows.groupBy(*keys, "class_mnemonic", "element", "element_seq", "level", "entity", "name").agg(
        F.first("data").alias("data"),
        F.count(F.when(scored, 1)).alias("criteria"),
        F.array_sort(F.collect_list(F.when(scored & (F.col("level") == "attribute"), shown))).alias("_items"),
        _sum((F.col("level") == "attribute") & (F.col("state_code") == FAILED)).alias("_fails"),
        *_audit_sums("attribute"),
    )
    weights = grouped.select("*", F.col("_wn").alias("_weighted_pass"), F.col("_wd").alias("_weighted_done"))
    grouped = _audit_scores(weights, "attribute")

    def listed(scoring: bool) -> Column:
        keep = F.filter("_items", lambda i: i["_scoring"] == F.lit(scoring))
        return F.to_json(F.transform(keep, lambda i: i["item"]))

    numbers = F.to_json(
        F.struct(
            F.col("attribute_score").cast("string").alias("attributeScore"),
            F.col("attribute_score_weighted").cast("string").alias("attributeScoreWeighted"),
            F.col("attribute_critical_failure_count").cast("string").alias("attributeCriticalFailureCount"),
            F.col("attribute_numerator").cast("string").alias("attributeNumerator"),
            F.col("attribute_denominator").cast("string").alias("attributeDenominator"),
        )
    )
    audit = F.concat(
        F.lit('"attributeAudit":{"scoringData":'),
        numbers,
        F.lit(',"assessmentItems":'),
        listed(True),
        F.lit(',"InformationalItems":'),
        listed(False),
        F.lit("}"),
    )
    parts = F.concat_ws(
        ",", F.concat(F.lit('"data":'), F.col("data")), F.when(F.col("criteria") > 0, audit)
    )
    node = F.when(F.col("level") == "attribute", F.concat(F.lit("{"), parts, F.lit("}")))
    return grouped.withColumn("node", node).drop("data", "_items")


def audited_attributes(
    evaluated: DataFrame, compiled: CompiledRubric, keys: list[str]
) -> DataFrame:
    """One row per attribute of the message: its audit node as JSON text.

    ``evaluated`` comes from ``evaluate_messages(..., all_attributes=True,
    keep=AUDIT_VALUES)``, so attributes without criteria are there too.  The rows
    collected per attribute are its criteria in the rubric.
    """
    return _nodes(evaluated, compiled, keys, ("attribute",)).select(
        *keys,
        "class_mnemonic",
        "element",
        "element_seq",
        "entity",
        "name",
        "node",
        "criteria",
        "attribute_numerator",
        "attribute_denominator",
        "attribute_critical_failure_count",
    )


AUDIT_VALUES = ["v_text", "v_codings", "v_type", "v_type_text", "v_type_code", "v_number", "v_number2", "v_low", "v_high"]


def _with_late(grouped: DataFrame, compiled: CompiledRubric) -> DataFrame:
    """Elements with the criteria that look at the results of their attributes added to their sums."""
    late = [c for c in compiled.criteria if c.needs_children]
    if not late:
        return grouped
    item = replace(Item.empty("ELM"), child_fails=F.col("_fails"))
    masks = mask_columns(compiled.probes_of(late), compiled.words, item, compiled.ctx)
    masks.pop("reasons", None)
    words = range(compiled.words)
    fail, err = [F.col(f"f_{w}") for w in words], [F.col(f"x_{w}") for w in words]
    here = {c.id: (F.col("_is_element") == 1) & (F.col("class_mnemonic") == c.class_mnemonic) for c in late}
    staged = grouped.withColumns(masks).withColumns({f"_s{c.id}": F.when(here[c.id], criterion_code(c, compiled, fail, err)) for c in late})
    extra = wide_counters(late, {c.id: F.col(f"_s{c.id}") for c in late})
    feeds = {
        "element_numerator": "scoring_pass", "element_denominator": "scoring_processed", "_wn": "weighted_pass",
        "_wd": "weighted_processed", "element_critical_failure_count": "critical_fail",
    }
    sums = {n: F.col(n) + extra[c] for n, c in feeds.items()}
    total = F.col("_criteria")
    for c in late:
        total = total + F.when(F.col(f"_s{c.id}").isNotNull(), 1).otherwise(0)
    return staged.withColumns(sums | {"_criteria": total})


def audited_elements(
    evaluated: DataFrame, compiled: CompiledRubric, keys: list[str], together: bool = False
) -> DataFrame:
    """One row per element: its audited JSON.  Collects the model's attributes of the
    one element, whose own criteria are added up with theirs.  With ``together`` the items of a
    message go to one task first, for callers that put the elements together again."""
    fields = {a.mnemonic: a.field for c in compiled.model.classes for a in c.attributes}
    names = F.create_map(*[x for m, f in fields.items() for x in (F.lit(m), F.lit(json.dumps(f, ensure_ascii=False)))])
    field = F.coalesce(F.try_element_at(names, F.col("entity")), F.lit('""'))
    nodes = _nodes(evaluated, compiled, keys, ("attribute", "element"), together)
    member = F.struct(F.col("name"), F.concat(field, F.lit(":"), F.col("node")).alias("_member"))
    total = lambda c: F.sum(c).cast("bigint")
    grouped = nodes.groupBy(*keys, "class_mnemonic", "element", "element_seq").agg(
        F.array_sort(F.collect_list(F.when(F.col("level") == "attribute", member))).alias("_list"),
        F.max(F.when(F.col("level") == "element", 1).otherwise(0)).alias("_is_element"),
        total("criteria").alias("_criteria"),
        total("_fails").alias("_fails"),
        total("attribute_numerator").alias("element_numerator"),
        total("attribute_denominator").alias("element_denominator"),
        total("attribute_critical_failure_count").alias("element_critical_failure_count"),
        total("_weighted_pass").alias("_wn"),
        total("_weighted_done").alias("_wd"),
    )
    # An element without attributes in the model has no members and is not shown.
    shown = _audit_scores(_with_late(grouped.filter(F.size("_list") > 0), compiled), "element")
    numbers = F.to_json(
        F.struct(
            F.col("element_score").cast("string").alias("elementScore"),
            F.col("element_score_weighted").cast("string").alias("elementScoreWeighted"),
            F.col("element_critical_failure_count").cast("string").alias("elementCriticalFailureCount"),
            F.col("element_numerator").cast("string").alias("elementNumerator"),
            F.col("element_denominator").cast("string").alias("elementDenominator"),
        )
    )
    # Elements of messages without a key have no audit.
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    audit = F.when((F.col("_criteria") > 0) & known, F.concat(F.lit('"elementAudit":'), numbers))
    members = F.array_join(F.transform("_list", lambda s: s["_member"]), ",")
    return shown.select(
        *keys,
        "class_mnemonic",
        "element_seq",
        F.concat(F.lit("{"), F.concat_ws(",", members, audit), F.lit("}")).alias("element_json"),
    )


def audited_messages(
    messages: DataFrame,
    evaluated: DataFrame,
    scores: DataFrame,
    compiled: CompiledRubric,
    keys: list[str],
) -> DataFrame:
    """One row per scored message: the audited message as JSON text.

    A message arrived as one row, and its audited form is one row again, so
    what is collected per message is bounded by the size of that row.
    ``audited_elements`` is the form to store when messages are very large.
    """
    model = compiled.model
    # Messages without a key meet no header below.
    known = evaluated.dropna(subset=keys)
    per_message = audited_elements(known, compiled, keys, together=True).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("class_mnemonic", "element_seq", "element_json"))).alias("_elements")
    )
    header = message_audit(scores.filter("succeeded"), keys)
    block = F.to_json(F.struct(*[c for c in header.columns if c not in keys]))
    header = header.select(*keys, block.alias("_audit"))
    shown = messages.select(
        *keys,
        "entity_model",
        F.coalesce("provider_id", "provider").alias("_provider"),
        F.coalesce("source_id", "data_source").alias("_source"),
        F.coalesce("message_id", "client_message_id").alias("_id"),
    )
    joined = shown.join(header, keys).join(per_message, keys, "left")
    classes = []
    for c in sorted(model.classes, key=lambda c: c.label):
        mnemonic = F.lit(c.mnemonic)
        own = F.filter("_elements", lambda e: e["class_mnemonic"] == mnemonic)  # noqa: B023
        body = F.coalesce(F.array_join(F.transform(own, lambda e: e["element_json"]), ","), F.lit(""))
        classes.append(F.concat(_quote(F.lit(c.field)), F.lit(":["), body, F.lit("]")))
    text = F.concat(
        F.lit('{"EntityModelMnemonic":'),
        _quote(F.col("entity_model")),
        F.lit(',"DataProviderID":'),
        _quote(F.col("_provider")),
        F.lit(',"DataSourceID":'),
        _quote(F.col("_source")),
        F.lit(',"MessageID":'),
        _quote(F.col("_id")),
        F.lit(',"Audit":'),
        F.col("_audit"),
        F.lit(","),
        _quote(F.lit(model.root_field)),
        F.lit(":{"),
        F.concat_ws(",", *classes),
        F.lit("}}"),
    )
    return joined.select(*keys, text.alias("audited_message"))


# --- assessments --------------------------------------------------------


def assessments(rows: DataFrame, keys: list[str], value: Column | None = None, limit: int = 1000) -> DataFrame:
    """Assessment records straight from scoring results of attributes."""
    shown = F.lit("N/A") if value is None else truncate_value(value, limit)
    return rows.filter((F.col("level") == "attribute") & F.col("is_scoring")).select(
        *keys,
        F.col("class_mnemonic").alias("data_class"),
        F.col("name").alias("attribute_name"),
        shown.alias("attribute_value"),
        "assessment",
        F.col("state").alias("status"),
        "reason",
        "effect",
    )


def extract_assessments(
    responses: DataFrame,
    keys: list[str],
    body: str = "response",
    root: str = "patient",
    class_paths=fixed.CLASS_PATHS,
    limit: int = 1000,
    nested: bool = False,
) -> DataFrame:
    """Assessment records from stored responses (JSON text).

    The audited message is taken from ``auditedMessage``, else ``messageData``;
    with ``nested`` an audited message inside either is preferred.  Malformed
    JSON yields no rows.  Only ``assessmentItems`` (scoring criteria) count.
    """
    obj = "map<string,string>"
    top = F.from_json(body, obj)
    df = responses.select(*keys, top.alias("_top"))
    text = F.coalesce(
        F.try_element_at("_top", F.lit("auditedMessage")), F.try_element_at("_top", F.lit("messageData"))
    )
    df = df.select(*keys, F.from_json(text, obj).alias("_msg"))
    if nested:
        inner = F.coalesce(
            F.try_element_at("_msg", F.lit("auditedMessage")), F.try_element_at("_msg", F.lit("messageData"))
        )
        df = df.withColumn("_msg", F.coalesce(F.from_json(inner, obj), F.col("_msg")))
    labels = F.create_map(*[F.lit(x) for label, path in class_paths for x in (path, label)])
    classes = df.select(
        *keys,
        F.explode(F.from_json(F.try_element_at("_msg", F.lit(root)), obj)).alias("_path", "_raw"),
    ).filter(F.col("_path").isin(*[p for _, p in class_paths]))
    elements = classes.select(
        *keys,
        F.try_element_at(labels, F.col("_path")).alias("data_class"),
        F.explode(F.from_json("_raw", "array<string>")).alias("_element"),
    )
    attributes = elements.select(
        *keys, "data_class", F.explode(F.from_json("_element", obj)).alias("_key", "_node")
    )
    node = F.from_json(
        "_node", f"struct<data:string,attributeAudit:struct<assessmentItems:array<{_ITEM_SCHEMA}>>>"
    )
    items = attributes.select(*keys, "data_class", "_key", node.alias("_n")).select(
        *keys,
        "data_class",
        "_key",
        truncate_value(F.col("_n.data"), limit).alias("attribute_value"),
        # An expression, not a plain column: see the note on explode in ``flatten.elements``.
        F.explode(F.coalesce("_n.attributeAudit.assessmentItems", F.array().cast(f"array<{_ITEM_SCHEMA}>"))).alias("_i"),
    )

    def text_of(name: str) -> Column:
        return F.coalesce(F.col(f"_i.{name}"), F.lit(""))

    return items.select(
        *keys,
        "data_class",
        F.coalesce(F.nullif(F.col("_i.attributeName"), F.lit("")), F.col("_key")).alias("attribute_name"),
        "attribute_value",
        text_of("assessment").alias("assessment"),
        text_of("status").alias("status"),
        text_of("reason").alias("reason"),
        text_of("effect").alias("effect"),
    )


def scoring_response(
    scores: DataFrame,
    classes: DataFrame,
    info: DataFrame,
    keys: list[str],
    model: EntityModel,
    audited: DataFrame | None = None,
    errors: DataFrame | None = None,
    messages: DataFrame | None = None,
    rubric: str | None = None,
) -> DataFrame:
    """The scoring response as one nested record per message.

    Class results (one per model class) are ordered by display name, informational
    results (one per model class too) as in the model, their evaluations by entity name.
    Both are bounded by the rubric.  ``messages`` (checked ones) and ``rubric`` (its name)
    fill the header of the scoring data.
    """
    numbers = [
        F.col("denominator").alias("Denominator"),
        F.col("numerator").alias("Numerator"),
        F.col("score").alias("Score"),
        F.col("critical_failure_count").alias("CriticalFailureCount"),
        F.col("weighted_denominator").alias("WeightedDenominator"),
        F.col("weighted_numerator").alias("WeightedNumerator"),
        F.col("weighted_score").alias("WeightedScore"),
    ]
    per_class = classes.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("class_name").alias("DataClassName"), F.col("instance_count").alias("InstanceCount"), *numbers
                )
            )
        ).alias("DataClassResults")
    )
    evaluation = F.struct(
        F.col("entity_name").alias("EntityName"),
        F.col("evaluation_name").alias("EvaluationName"),
        F.col("instance_count").alias("InstanceCount"),
        F.col("denominator").alias("Denominator"),
        F.col("numerator").alias("Numerator"),
    )
    informed = (
        info.filter(F.col("class_mnemonic").isNotNull())
        .groupBy(*keys, "class_mnemonic")
        .agg(F.array_sort(F.collect_list(evaluation)).alias("_list"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("class_mnemonic", "_list"))).alias("_informed"))
    )
    nothing = F.array().cast(info.select(F.array(evaluation)).schema.fields[0].dataType)
    every = F.array(
        *[
            F.struct(
                class_display_name(F.lit(c.field)).alias("DataClassName"),
                F.coalesce(F.try_element_at("_informed", F.lit(c.mnemonic)), nothing).alias("EvaluationList"),
            )
            for c in model.classes
        ]
    )
    out = scores.join(per_class, keys, "left").join(informed, keys, "left")
    message = F.when(F.col("succeeded"), F.struct(*numbers))
    data = F.when(
        F.col("succeeded"),
        F.struct(
            F.col("provider").alias("DataProviderID"),
            F.col("data_source").alias("DataSourceID"),
            F.col("client_message_id").alias("MessageID"),
            F.lit(rubric).cast("string").alias("EvaluationRubric"),
            message.alias("MessageResults"),
            F.col("DataClassResults"),
            every.alias("InformationalResults"),
        ),
    )
    head = ["provider", "data_source", "client_message_id"]
    if messages is not None:
        out = out.join(messages.select(*keys, *head), keys, "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("string") for c in head})
    if errors is not None:
        out = out.join(errors, keys, "left")
    else:
        out = out.withColumn("error_message", F.lit(None).cast("string"))
    if audited is not None:
        out = out.join(audited, keys, "left")
    else:
        out = out.withColumn("audited_message", F.lit(None).cast("string"))
    return out.select(
        *keys,
        F.col("succeeded").alias("Succeeded"),
        F.col("error_message").alias("ErrorMessage"),
        data.alias("ScoringData"),
        F.col("audited_message").alias("AuditedMessage"),
    )
