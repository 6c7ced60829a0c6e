"""Criteria, roll-ups and counts over table rubrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.catalog.check_queries import AS_OF, DATE, NUMBER, SQL_EMPTY, SQL_FLOAT, SQL_INT
from rubrica.catalog.registry import MODEL, compiled, criterion, load, register, states, text_items
from rubrica.operators.evaluate import TableSource, table_results, table_scorecards
from rubrica.operators.rollup import (
    class_scores,
    critical_failures,
    drop_errored,
    element_rollup,
    fail_counts,
    first_errors,
    informational,
    message_scores,
    skip_counts,
)
from rubrica.plans.context import EvalContext

CTX = {"as_of": AS_OF}

# Rubric over orders: one message per customer, one element per order.
ORDER_RULES = [
    criterion("ORD_DATE", "ATTR_ISPASTDATE", 1, weight=2),
    criterion("ORD_STATUS", "ATTR_INLIST", 2, params={"LIST_CSV": "F,O"}, name="Status is final", failure_name="Status is open", critical=True),
    criterion("ORD_TOTAL", "ATTR_ISPOSITIVENUMBER", 3, weight=3),
    criterion("ORD_PRIORITY", "ATTR_MATCHESREGEX", 4, params={"CUSTOM_REGULAR_EXPRESSION": "^[12]"}, effect="Informational"),
    criterion("ORD_TOTAL", "ATTR_ISINTEGER", 5, conditional="ATTR_INLIST", conditional_params={"LIST_CSV": "1,2"}),
    criterion("ORD_STATUS", "ATTR_INLIST", 6),
]
# State codes of the six criteria in SQL: 0 failed, 1 passed, 2 skipped.
ORDER_STATES = f"""
SELECT *, CASE WHEN {SQL_EMPTY} OR o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN 0
            WHEN (CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_orderdate + INTERVAL 510 MINUTE ELSE o_orderdate END) < TIMESTAMP '{AS_OF}' THEN 1 ELSE 0 END AS c1,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 ELSE 0 END AS c2,
  1 AS c3, CASE WHEN regexp_matches(o_orderpriority, '^[12]') THEN 1 ELSE 0 END AS c4, 2 AS c5, 2 AS c6
FROM (SELECT *, {DATE} AS t FROM orders)"""


def order_source(spark, sf, *keys: str) -> TableSource:
    items = text_items(ORD_DATE=DATE, ORD_STATUS="o_orderstatus", ORD_TOTAL="o_totalprice", ORD_PRIORITY="o_orderpriority")
    return TableSource(load(spark, sf, "orders"), "ORDER", list(keys or ["o_custkey"]), items)


def order_rubric():
    return compiled(ORDER_RULES, EvalContext(**CTX))


def order_cards(spark, sf, *keys: str):
    return table_scorecards(order_source(spark, sf, *keys), order_rubric())


SCORE = "CAST(trunc(CAST({n} AS FLOAT) / CAST({d} AS FLOAT) * CAST(100 AS FLOAT)) AS INT)"


def _score(n: str, d: str) -> str:
    return f"CASE WHEN {d} = 0 THEN 0 ELSE {SCORE.format(n=n, d=d)} END"


@register(
    "score_message",
    f"""SELECT o_custkey, n AS numerator, d AS denominator, {_score('n', 'd')} AS score, crit AS critical_failure_count, skips AS scoring_skip, info AS info_pass
    FROM (SELECT o_custkey, CAST(sum(c1 + c2 + c3) AS BIGINT) AS n, 3 * count(*) AS d, CAST(sum(1 - c2) AS BIGINT) AS crit, 2 * count(*) AS skips, CAST(sum(c4) AS BIGINT) AS info
          FROM ({ORDER_STATES}) GROUP BY o_custkey)""",
)
def score_message(spark, sf):
    out = message_scores(order_cards(spark, sf), ["o_custkey"])
    return out.select("o_custkey", "numerator", "denominator", "score", "critical_failure_count", "scoring_skip", "info_pass")


@register(
    "score_message_weighted",
    f"""SELECT o_custkey, n AS weighted_numerator, d AS weighted_denominator, {_score('n', 'd')} AS weighted_score, skips AS weighted_skip
    FROM (SELECT o_custkey, CAST(sum(2 * c1 + c2 + 3 * c3) AS BIGINT) AS n, 6 * count(*) AS d, 2 * count(*) AS skips FROM ({ORDER_STATES}) GROUP BY o_custkey)""",
)
def score_message_weighted(spark, sf):
    out = message_scores(order_cards(spark, sf), ["o_custkey"])
    return out.select("o_custkey", "weighted_numerator", "weighted_denominator", "weighted_score", "weighted_skip")


@register(
    "score_class",
    f"""SELECT o_custkey, class_mnemonic, class_name, coalesce(instances, 0) AS instance_count, coalesce(clean, 0) AS clean_count,
    coalesce(n, 0) AS numerator, coalesce(d, 0) AS denominator, coalesce({_score('n', 'd')}, 0) AS score
    FROM (SELECT DISTINCT o_custkey FROM orders) k
    CROSS JOIN (VALUES ('CUSTOMER', 'Customers'), ('ORDER', 'Orders'), ('LINE', 'Lines'), ('PART', 'Parts'), ('EVENT', 'Events'), ('TEXT', 'Texts')) c(class_mnemonic, class_name)
    LEFT JOIN (SELECT o_custkey, 'ORDER' AS class_mnemonic, count(*) AS instances, CAST(sum(CASE WHEN c1 + c2 + c3 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS clean, CAST(sum(c1 + c2 + c3) AS BIGINT) AS n, 3 * count(*) AS d
          FROM ({ORDER_STATES}) GROUP BY o_custkey) USING (o_custkey, class_mnemonic)""",
)
def score_class(spark, sf):
    out = class_scores(order_cards(spark, sf), ["o_custkey"], MODEL)
    return out.select("o_custkey", "class_mnemonic", "class_name", "instance_count", "clean_count", "numerator", "denominator", "score")


@register(
    "score_element",
    f"""SELECT o_orderkey, CAST(6 AS BIGINT) AS total, CAST(2 AS BIGINT) AS skip, CAST(4 AS BIGINT) AS processed, CAST(3 AS BIGINT) AS scoring_processed, CAST(1 AS BIGINT) AS info_processed,
    CAST(c1 + c2 + c3 AS BIGINT) AS pass, CAST(3 - c1 - c2 - c3 AS BIGINT) AS fail, CAST(1 - c2 AS BIGINT) AS critical_fail, c1 + c2 + c3 = 3 AS is_clean FROM ({ORDER_STATES})""",
)
def score_element(spark, sf):
    out = element_rollup(order_cards(spark, sf, "o_orderkey"), ["o_orderkey"])
    return out.select("o_orderkey", "total", "skip", "processed", "scoring_processed", "info_processed", "pass", "fail", "critical_fail", "is_clean")


@register(
    "score_overall",
    f"""SELECT 'ORDER' AS class_mnemonic, n AS numerator, d AS denominator, {_score('n', 'd')} AS score, clean AS clean_count
    FROM (SELECT CAST(sum(c1 + c2 + c3) AS BIGINT) AS n, 3 * count(*) AS d, CAST(sum(CASE WHEN c1 + c2 + c3 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS clean FROM ({ORDER_STATES}))""",
)
def score_overall(spark, sf):
    """The whole table as one message."""
    return class_scores(order_cards(spark, sf), []).select("class_mnemonic", "numerator", "denominator", "score", "clean_count")


def _order_results(spark, sf, *keys):
    return table_results(order_source(spark, sf, *keys), order_rubric())


@register(
    "info_results",
    f"""SELECT o_custkey, 'ORD_PRIORITY' AS entity, 'ATTR_MATCHESREGEX' AS "check", 'Attribute matches pattern' AS evaluation_name, 'priority' AS entity_name,
    count(*) AS instance_count, CAST(sum(c4) AS BIGINT) AS numerator, count(*) AS denominator FROM ({ORDER_STATES}) GROUP BY o_custkey""",
)
def info_results(spark, sf):
    out = informational(_order_results(spark, sf), ["o_custkey"])
    return out.select("o_custkey", "entity", "check", "evaluation_name", "entity_name", "instance_count", "numerator", "denominator")


@register(
    "skip_counts",
    f"""SELECT o_custkey, entity, "check", skip_check, count(*) AS skip_count FROM (
    SELECT o_custkey, 'ORD_TOTAL' AS entity, 'ATTR_ISINTEGER' AS "check", 'ATTR_INLIST' AS skip_check FROM orders
    UNION ALL SELECT o_custkey, 'ORD_STATUS', 'ATTR_INLIST', 'EVAL_ISVALID' FROM orders) GROUP BY ALL""",
)
def skip_counts_query(spark, sf):
    return skip_counts(_order_results(spark, sf), ["o_custkey"])


_FAILS = f"""
SELECT o_custkey, 'ORD_DATE' AS entity, 'ATTR_ISPASTDATE' AS "check", CASE WHEN {SQL_EMPTY} THEN 'ATTR_ISPOPULATED' WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN 'ATTR_ISDATE' ELSE 'ATTR_ISPASTDATE' END AS fail_check FROM ({ORDER_STATES}) WHERE c1 = 0
UNION ALL SELECT o_custkey, 'ORD_STATUS', 'ATTR_INLIST', 'ATTR_INLIST' FROM ({ORDER_STATES}) WHERE c2 = 0
UNION ALL SELECT o_custkey, 'ORD_PRIORITY', 'ATTR_MATCHESREGEX', 'ATTR_MATCHESREGEX' FROM ({ORDER_STATES}) WHERE c4 = 0"""


@register("fail_counts", f'SELECT o_custkey, entity, "check", fail_check, count(*) AS fail_count FROM ({_FAILS}) GROUP BY ALL')
def fail_counts_query(spark, sf):
    return fail_counts(_order_results(spark, sf), ["o_custkey"])


@register(
    "critical_failures",
    f"""SELECT o_custkey, 'ORD_STATUS' AS entity, 'ATTR_INLIST' AS "check", 'ATTR_INLIST' AS fail_check, count(*) AS total, count(*) AS processed, count(*) AS failed
    FROM ({ORDER_STATES}) WHERE c2 = 0 GROUP BY o_custkey""",
)
def critical_failures_query(spark, sf):
    return critical_failures(_order_results(spark, sf), ["o_custkey"])


# --- criteria -----------------------------------------------------------


@register(
    "criterion_conditional",
    f"""SELECT o_orderkey, CASE WHEN skip IS NOT NULL THEN 'Skipped' WHEN ok THEN 'Passed' ELSE 'Failed' END AS state, skip AS skip_check,
    CASE WHEN skip IS NOT NULL THEN 'not a past date' WHEN ok THEN '' ELSE 'Too early' END AS reason FROM (
    SELECT o_orderkey, CASE WHEN c1 = 0 THEN 'ATTR_ISPASTDATE' END AS skip, o_orderdate + INTERVAL 0 DAY >= TIMESTAMP '1997-01-01 00:00:00' AS ok FROM ({ORDER_STATES}))""",
)
def criterion_conditional(spark, sf):
    """Only past orders are judged; the skip reason is that of the conditional check."""
    rule = criterion(
        "ORD_DATE", "ATTR_MATCHESREGEX", params={"CUSTOM_REGULAR_EXPRESSION": "199[789]|20[0-9]{2}"},
        conditional="ATTR_ISPASTDATE", failure_name="Too early",
    )
    rows = states(load(spark, sf, "orders"), "ORDER", ["o_orderkey"], text_items(ORD_DATE=DATE), [rule], EvalContext(**CTX))
    return rows.select("o_orderkey", "state", "skip_check", "reason")


@register(
    "criterion_prereq_chain",
    f"""SELECT fail_check, state, count(*) AS n FROM (
      SELECT f AS fail_check, CASE WHEN f IS NULL THEN 'Passed' ELSE 'Failed' END AS state FROM (
      SELECT CASE WHEN {SQL_EMPTY} THEN 'ATTR_ISPOPULATED' WHEN NOT {SQL_INT} THEN 'ATTR_ISINTEGER' WHEN trim(t) NOT LIKE '-%' THEN 'ATTR_ISNEGATIVENUMBER' END AS f
      FROM (SELECT {NUMBER} AS t FROM lineitem))) GROUP BY ALL""",
)
def criterion_prereq_chain(spark, sf):
    rows = states(load(spark, sf, "lineitem"), "LINE", ["l_returnflag"], text_items(LIN_NUMBER=NUMBER), [criterion("LIN_NUMBER", "ATTR_ISNEGATIVENUMBER")])
    return rows.groupBy("fail_check", "state").agg(F.count(F.lit(1)).alias("n"))


@register(
    "criterion_reason",
    f"""SELECT assessment, state, reason, count(*) AS n FROM (
    SELECT 'Tax count is numeric' AS assessment, CASE WHEN {SQL_EMPTY} OR NOT {SQL_FLOAT} THEN 'Failed' ELSE 'Passed' END AS state,
      CASE WHEN {SQL_EMPTY} THEN 'unpopulated' WHEN NOT {SQL_FLOAT} THEN 'Count is no number' ELSE '' END AS reason FROM (SELECT {NUMBER} AS t FROM lineitem)
    UNION ALL SELECT 'Flag known', CASE WHEN l_returnflag = 'N' THEN 'Failed' ELSE 'Passed' END, CASE WHEN l_returnflag = 'N' THEN 'Flag known' ELSE '' END FROM lineitem
    UNION ALL SELECT 'Attribute is in list', CASE WHEN l_linestatus = 'O' THEN 'Failed' ELSE 'Passed' END, CASE WHEN l_linestatus = 'O' THEN 'not in list' ELSE '' END FROM lineitem
    ) GROUP BY ALL""",
)
def criterion_reason(spark, sf):
    """Failure text: the criterion's failure name, else its name, else the check's text."""
    rules = [
        criterion("LIN_NUMBER", "ATTR_ISNUMERIC", 1, name="Tax count is numeric", failure_name="Count is no number"),
        criterion("LIN_FLAG", "ATTR_INLIST", 2, name="Flag known", params={"LIST_CSV": "A|R"}),
        criterion("LIN_STATUS", "ATTR_INLIST", 3, params={"LIST_CSV": "F"}),
    ]
    items = text_items(LIN_NUMBER=NUMBER, LIN_FLAG="l_returnflag", LIN_STATUS="l_linestatus")
    rows = states(load(spark, sf, "lineitem"), "LINE", ["l_returnflag"], items, rules)
    return rows.groupBy("assessment", "state", "reason").agg(F.count(F.lit(1)).alias("n"))


# --- errors -------------------------------------------------------------

# A positive-number check without its prerequisite errors on texts that are no numbers.


def _unguarded():
    from dataclasses import replace

    from rubrica.plans.checks import CheckLibrary

    lib = CheckLibrary()
    defs = {m: lib.get(m) for m in lib.mnemonics()}
    defs["ATTR_ISPOSITIVENUMBER"] = replace(defs["ATTR_ISPOSITIVENUMBER"], prerequisite=None)
    rules = [
        criterion("EVT_TYPE", "ATTR_ISPOPULATED", 1),
        criterion("EVT_KEY", "ATTR_ISPOSITIVENUMBER", 2),
    ]
    return compiled(rules, EvalContext(library=CheckLibrary(defs)))


_KEY = "CASE WHEN event_type = 'error' AND value > 100 THEN 'broken' ELSE CAST(value AS STRING) END"
_BROKEN = "event_type = 'error' AND value > 100"


def _event_source(spark, sf) -> TableSource:
    return TableSource(load(spark, sf, "events"), "EVENT", ["user_id"], text_items(EVT_TYPE="event_type", EVT_KEY=_KEY))


@register(
    "error_voids_message",
    f"""SELECT user_id, errors = 0 AS succeeded, errors, CASE WHEN errors = 0 THEN 2 * n END AS denominator, CASE WHEN errors = 0 THEN 100 END AS score
    FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE {_BROKEN}) AS errors FROM events GROUP BY user_id)""",
)
def error_voids_message(spark, sf):
    """A message in which a check errored has no score; the others are unaffected."""
    out = message_scores(table_scorecards(_event_source(spark, sf), _unguarded()), ["user_id"])
    return out.select("user_id", "succeeded", "errors", "denominator", "score")


@register(
    "error_first",
    f"SELECT user_id, 'ATTR_ISPOSITIVENUMBER failed to process : Value is not numeric. Check the prerequisites.' AS error_message FROM events WHERE {_BROKEN} GROUP BY user_id",
)
def error_first(spark, sf):
    return first_errors(table_results(_event_source(spark, sf), _unguarded()), ["user_id"], MODEL)


@register(
    "error_rows_dropped",
    f"""SELECT entity, state, count(*) AS n FROM (SELECT unnest(['EVT_TYPE', 'EVT_KEY']) AS entity, 'Passed' AS state FROM events
    WHERE user_id NOT IN (SELECT user_id FROM events WHERE {_BROKEN})) GROUP BY ALL""",
)
def error_rows_dropped(spark, sf):
    rubric = _unguarded()
    rows = drop_errored(table_results(_event_source(spark, sf), rubric), rubric, ["user_id"])
    return rows.groupBy("entity", "state").agg(F.count(F.lit(1)).alias("n"))


# --- criteria above the element, and the clean element ------------------

_ABOVE = [
    criterion("ORDER", "ATTR_TEST_1", 1, weight=2),
    criterion("PART", "ATTR_ISPOPULATED", 2, critical=True),
    criterion("ROOT", "ATTR_TEST_1", 3),
    criterion("ORD_STATUS", "ATTR_INLIST", 4, params={"LIST_CSV": "F,O"}),
]


@register(
    "score_class_criteria",
    f"""SELECT o_custkey, n AS numerator, d AS denominator, {_score('n', 'd')} AS score, n + 1 AS weighted_numerator, CAST(1 AS BIGINT) AS critical_failure_count
    FROM (SELECT o_custkey, CAST(2 + sum((o_orderstatus IN ('F', 'O'))::INT) AS BIGINT) AS n, 3 + count(*) AS d FROM orders GROUP BY o_custkey)""",
)
def score_class_criteria(spark, sf):
    """Criteria on a class that is there, one that is not, the root and an attribute."""
    source = TableSource(load(spark, sf, "orders"), "ORDER", ["o_custkey"], text_items(ORD_STATUS="o_orderstatus"))
    out = message_scores(table_scorecards(source, compiled(_ABOVE)), ["o_custkey"])
    return out.select("o_custkey", "numerator", "denominator", "score", "weighted_numerator", "critical_failure_count")


@register(
    "results_class_criteria",
    """SELECT entity, level, state, count(*) AS n FROM (
    SELECT 'ORDER' AS entity, 'class' AS level, 'Passed' AS state FROM (SELECT DISTINCT o_custkey FROM orders)
    UNION ALL SELECT 'PART', 'class', 'Failed' FROM (SELECT DISTINCT o_custkey FROM orders)
    UNION ALL SELECT 'ROOT', 'root', 'Passed' FROM (SELECT DISTINCT o_custkey FROM orders)
    UNION ALL SELECT 'ORD_STATUS', 'attribute', CASE WHEN o_orderstatus IN ('F', 'O') THEN 'Passed' ELSE 'Failed' END FROM orders) GROUP BY ALL""",
)
def results_class_criteria(spark, sf):
    source = TableSource(load(spark, sf, "orders"), "ORDER", ["o_custkey"], text_items(ORD_STATUS="o_orderstatus"))
    rows = table_results(source, compiled(_ABOVE))
    return rows.groupBy("entity", "level", "state").agg(F.count(F.lit(1)).alias("n"))


_CLEAN_RULES = [
    criterion("ORD_STATUS", "ATTR_INLIST", 1, params={"LIST_CSV": "F,O"}),
    criterion("ORD_PRIORITY", "ATTR_MATCHESREGEX", 2, params={"CUSTOM_REGULAR_EXPRESSION": "^[123]"}, effect="Informational"),
    criterion("ORDER_ELM", "ATTR_ISINTEGER", 3),
    criterion("ORDER_ELM", "ELEMENT_ISCLEAN", 4),
]
_CLEAN_SQL = """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') AND regexp_matches(o_orderpriority, '^[123]') THEN 'Passed' ELSE 'Failed' END AS state FROM orders"""


@register("clean_element_beside_failing_criterion", _CLEAN_SQL)
def clean_element_beside_failing_criterion(spark, sf):
    """Another criterion on the element fails; only the attributes decide whether it is clean."""
    items = text_items(ORD_STATUS="o_orderstatus", ORD_PRIORITY="o_orderpriority")
    rows = table_results(TableSource(load(spark, sf, "orders"), "ORDER", ["o_orderkey"], items), compiled(_CLEAN_RULES))
    return rows.filter("check = 'ELEMENT_ISCLEAN'").select("o_orderkey", "state")


@register("clean_element_in_messages", _CLEAN_SQL)
def clean_element_in_messages(spark, sf):
    from rubrica.operators.evaluate import evaluate_messages, message_results
    from rubrica.sources.messages import check_messages

    order = F.array(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")))
    messages = load(spark, sf, "orders").select(
        "o_orderkey",
        F.lit("shop").alias("provider_id"), F.lit("orders").alias("source_id"), F.col("o_orderkey").cast("string").alias("message_id"),
        F.lit(MODEL.mnemonic).alias("model_mnemonic"), F.lit("CATALOG").alias("rubric_mnemonic"),
        F.to_json(F.struct(F.struct(order.alias("orders")).alias("shop"))).alias("payload"),
    )
    rubric = compiled(_CLEAN_RULES)
    evaluated = evaluate_messages(check_messages(messages, MODEL, MODEL.mnemonic), rubric, ["o_orderkey"], store=True)
    rows = message_results(evaluated, rubric, ["o_orderkey"])
    return rows.filter("check = 'ELEMENT_ISCLEAN'").select("o_orderkey", "state")
