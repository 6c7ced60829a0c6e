"""Audited messages: items of a message meet in one task once, whatever is made of them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from rubrica.catalog.message_queries import DOC_KEYS, DOCS, doc_rubric
from rubrica.operators.audit import AUDIT_VALUES, audited_elements, audited_messages
from rubrica.operators.evaluate import evaluate_messages, message_scorecards
from rubrica.operators.rollup import message_scores
from rubrica.sources.messages import check_messages


def evaluated(spark, bodies: dict):
    rows = [("p", "s", m, "TEXTS_V2", "R", json.dumps({"document": b})) for m, b in bodies.items()]
    rows = spark.createDataFrame(rows, "provider_id string, source_id string, message_id string, model_mnemonic string, rubric_mnemonic string, payload string")
    checked, rubric = check_messages(rows, DOCS, DOCS.mnemonic), doc_rubric()
    return checked, rubric, evaluate_messages(checked, rubric, DOC_KEYS, all_attributes=True, keep=AUDIT_VALUES, store=True)


def test_elements_count_their_own_criteria_and_items_travel_once(spark):
    quoted = 'say 1 "]"\\ and [x]\n\té'
    checked, rubric, ev = evaluated(spark, {"a": {"lines": [{"content": quoted}, {"content": ""}, {}]}, "b": {"summary": {"language": "de", "size": 3}}})
    scores = message_scores(message_scorecards(ev, rubric, DOC_KEYS), DOC_KEYS)
    out = audited_messages(checked, ev, scores, rubric, DOC_KEYS)
    found = {r.message_id: json.loads(r.audited_message)["document"] for r in out.collect()}
    lines = found["a"]["lines"]
    assert lines[0]["content"]["data"] == quoted and found["a"]["summary"] == []
    # Populated (weight 2) and clean: two passes; else a failure and, as the element has one, another.
    assert [x["elementAudit"]["elementNumerator"] for x in lines] == ["2", "0", "0"]
    assert [x["elementAudit"]["elementDenominator"] for x in lines] == ["2", "2", "2"]
    assert [x["elementAudit"]["elementScoreWeighted"] for x in lines] == ["100", "0", "0"]
    assert found["b"]["summary"][0]["elementAudit"]["elementCriticalFailureCount"] == "1"
    # The items are read once and meet in one exchange by message.
    plan = audited_elements(ev, rubric, DOC_KEYS, together=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and plan.count("FileScan") == 1
    apart = audited_elements(ev, rubric, DOC_KEYS)
    assert apart._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert apart.filter(F.col("message_id") == "a").count() == 3
