"""Work per element of messages: concepts parsed once, no functions over lists where rows will do."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rubrica.catalog.registry import MODEL, compiled, criterion
from rubrica.functions.values import parse_values, raw_columns, raw_item
from rubrica.operators.message_rows import message_rows
from rubrica.plans.context import ContentMarts, EvalContext
from rubrica.sources.messages import check_messages

CODED = '[{"code":"1","system":"S"},null,{"code":2,"system-id":"T","display":"two"}]'
CONCEPTS = [
    None, "", "plain", "{}", "{", '{"text":null}', '{"text":"a"}', '{"codings":[]}', '{"codings":null,"text":"b"}',
    '{"other":"first","more":1}', '{"Text":"x","codings":[{"code":"1"}]}', f'{{"codings":{CODED}}}', f'{{"text":"","codings":{CODED}}}',
    f'{{"text":"one","codings":{CODED},"text":"two"}}', f'{{"codings":{CODED},"codings":[]}}', '{"codings":[{"code":"1"}],"t\\u0065xt":"e"}',
    '{"codings":"[{\\"code\\":\\"9\\"}]"}', '{"codings":[1],"text":"n"}', '{"codings":{"code":"1"},"text":"o"}', '{"text":{"a":[1, 2]},"codings":[{"code":true}]}',
    '{"text":"late","codings":[{"code":"1"}', ' {"text":"space"} rest', '{"type":{"text":"Range"},"text":"3^4"}', '{"type":"Numeric","text":"7","type":"Range"}',
    '{"text":"caf\\u00e9","codings":[{"code":"\\u0031","display":""}]}',
]


@pytest.mark.parametrize("kind", ["CC", "OBSVAL"])
def test_concepts_parsed_once_are_those_read_property_by_property(spark, kind):
    rows = spark.createDataFrame([(i, kind, c is not None, c) for i, c in enumerate(CONCEPTS)], "i int, kind string, present boolean, raw string")
    loose = parse_values(rows).select("i", "v_text", "v_codings", "v_type_code", "v_number", "v_number2")
    typed = rows
    for step in raw_columns("a", kind, F.col("raw"), F.col("present")):
        typed = typed.withColumns(step)
    item = raw_item("a", kind)
    typed = typed.select("i", item.text, item.codings, item.type_code, item.number, item.number2)
    expected = {r[0]: list(r)[1:] for r in loose.collect()}
    found = {r[0]: list(r)[1:] for r in typed.collect()}
    if kind == "CC":
        expected, found = ({i: v[:2] for i, v in d.items()} for d in (expected, found))
    assert found == expected


def content_rows(spark, lines: list[dict]):
    key = [F.lit("PARTS").alias("system"), F.lit("1").alias("code"), F.lit("PROMO").alias("unit")]
    one = spark.range(1)
    content = ContentMarts(
        units=one.select(F.lit("U").alias("content_set"), *key),
        ranges=one.select(F.lit("R").alias("content_set"), *key, F.lit(1.0).alias("min_value"), F.lit(5.0).alias("max_value")),
        texts=one.select(F.lit("N").alias("content_set"), F.lit("yes").alias("text")),
    )
    rules = [
        criterion("LIN_NUMBER", "VALUE_IN_RANGE_SET", 1, params={"CONTENT_SET": "R", "CODE_ATTRIBUTE": "LIN_PART", "UNIT_ATTRIBUTE": "LIN_FLAG"}),
        criterion("LIN_FLAG", "UNIT_IS_PRIMARY", 2, params={"CONTENT_SET": "U", "CODE_ATTRIBUTE": "LIN_PART"}),
        criterion("LIN_STATUS", "TEXT_IN_CONTENT_SET", 3, params={"CONTENT_SET": "N"}),
    ]
    payload = json.dumps({"shop": {"lines": lines}})
    messages = spark.createDataFrame(
        [("p", "s", "m", "SHOP_V1", "R", payload)],
        "provider_id string, source_id string, message_id string, model_mnemonic string, rubric_mnemonic string, payload string",
    )
    return message_rows(check_messages(messages, MODEL, MODEL.mnemonic), compiled(rules, EvalContext(content=content)), ["message_id"])


def test_content_checks_of_messages_do_each_step_once(spark):
    part = {"codings": [{"code": "1", "system": "PARTS"}]}
    rows = content_rows(spark, [
        {"number": "3", "flag": "PROMO", "status": "yes", "part": part},
        {"number": "6", "flag": "SMALL", "status": "no", "part": {"text": "none"}},
        {"flag": "PROMO", "part": part},
    ])
    found = {(r.element_seq, r.entity): r.state for r in rows.collect()}
    assert found == {
        (1, "LIN_NUMBER"): "Passed", (1, "LIN_FLAG"): "Passed", (1, "LIN_STATUS"): "Passed",
        (2, "LIN_NUMBER"): "Failed", (2, "LIN_FLAG"): "Failed", (2, "LIN_STATUS"): "Failed",
        (3, "LIN_NUMBER"): "Failed", (3, "LIN_FLAG"): "Passed", (3, "LIN_STATUS"): "Failed",
    }
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # Numbers are read for ranges alone, and lists of entities and answers are not filtered.
    assert plan.count("infinity)") == 1
    assert "filter(array(" not in plan
