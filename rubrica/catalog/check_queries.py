"""Checks on plain attributes, ranges and observation values."""

from dataclasses import replace

import pandas as pd
from pyspark.sql import functions as F

from rubrica.catalog.registry import MODEL, by_key, criterion, load, register, states, tally, text_items
from rubrica.functions.values import Item, coding, codings
from rubrica.operators.evaluate import TableSource, table_results
from rubrica.plans.checks import CheckDef, CheckLibrary, Outcome, Param
from rubrica.plans.context import EvalContext
from rubrica.plans.rubric import PROCESSING, Criterion, Rubric, compile_rubric, missing_checks
from rubrica.sources.reference import ValueLists

# Texts derived from table columns, the same on both sides.
SEGMENT = (
    "CASE c_mktsegment WHEN 'FURNITURE' THEN NULL WHEN 'MACHINERY' THEN '' "
    "WHEN 'HOUSEHOLD' THEN '  ' ELSE c_mktsegment END"
)
NUMBER = (
    "CASE WHEN l_tax = 0 THEN NULL WHEN l_discount = 0 THEN '' "
    "WHEN l_returnflag = 'A' THEN CAST(l_quantity AS STRING) "
    "WHEN l_returnflag = 'N' THEN ' ' || CAST(CAST(l_quantity AS INT) AS STRING) || ' ' "
    "WHEN l_linestatus = 'O' THEN CAST(l_linenumber AS STRING) || ',000' "
    "WHEN l_linenumber > 4 THEN '-' || CAST(l_linenumber AS STRING) "
    "WHEN l_linenumber > 2 THEN CAST(l_linenumber AS STRING) || 'd' "
    "ELSE CAST(l_linenumber AS STRING) || 'e2' END"
)
DATE = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN substr(CAST(o_orderdate AS STRING), 1, 10) "
    "WHEN '2-HIGH' THEN CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING) "
    "WHEN '3-MEDIUM' THEN substr(CAST(o_orderdate AS STRING), 1, 10) || 'T08:30:00' "
    "WHEN '5-LOW' THEN CASE WHEN o_orderstatus = 'F' THEN '' WHEN o_orderstatus = 'O' THEN NULL ELSE 'soon' END "
    "ELSE substr(CAST(o_orderdate AS STRING), 1, 4) || '-13-45' END"
)
TIME = (
    "CASE event_type WHEN 'click' THEN substr(CAST(ts AS STRING), 1, 10) "
    "WHEN 'view' THEN substr(CAST(ts AS STRING), 1, 19) "
    "WHEN 'error' THEN substr(CAST(ts AS STRING), 1, 10) || 'T' || substr(CAST(ts AS STRING), 12, 8) || 'Z' "
    "WHEN 'signup' THEN substr(CAST(ts AS STRING), 1, 10) || ' 00:00:00' ELSE 'at ' || CAST(ts AS STRING) END"
)
AS_OF = "1998-06-01 00:00:00"

# The same rules in SQL, over a text column t and a typed column.
SQL_INT = r"regexp_matches(t, '^\s*[+-]?[0-9]+\s*$')"
SQL_FLOAT = r"regexp_matches(t, '^\s*[+-]?([0-9][0-9,]*\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$')"
SQL_EMPTY = "(t IS NULL OR t = '')"


def _verdict(steps: list[tuple[str, str]], texts: dict[str, str]) -> str:
    """State, failing check and reason from ordered (condition, check) steps."""
    fail = " ".join(f"WHEN {c} THEN '{k}'" for c, k in steps)
    reason = " ".join(f"WHEN fail_check = '{k}' THEN '{v}'" for k, v in texts.items())
    return (
        f"CASE {fail} END AS fail_check",
        f"CASE WHEN fail_check IS NULL THEN 'Passed' ELSE 'Failed' END AS state, fail_check, "
        f"CASE {reason} ELSE '' END AS reason",
    )


def _row_sql(key: str, text: str, table: str, steps, texts) -> str:
    fail, out = _verdict(steps, texts)
    return f"SELECT {key}, {out} FROM (SELECT {key}, {fail} FROM (SELECT *, {text} AS t FROM {table}))"


def _tally_sql(keys: str, text: str, table: str, steps) -> str:
    fail, _ = _verdict(steps, {"": ""})
    return (
        f"SELECT {keys}, CASE WHEN fail_check IS NULL THEN 'Passed' ELSE 'Failed' END AS state, fail_check, "
        f"count(*) AS n FROM (SELECT {keys}, {fail} FROM (SELECT *, {text} AS t FROM {table})) GROUP BY ALL"
    )


POP = (SQL_EMPTY, "ATTR_ISPOPULATED")
POP_TEXT = {"ATTR_ISPOPULATED": "unpopulated"}


@register("chk_populated", _row_sql("c_custkey", SEGMENT, "customer", [POP], POP_TEXT))
def chk_populated(spark, sf):
    df = load(spark, sf, "customer")
    return by_key(states(df, "CUSTOMER", ["c_custkey"], text_items(CUS_SEGMENT=SEGMENT), [criterion("CUS_SEGMENT", "ATTR_ISPOPULATED")]), "c_custkey")


@register(
    "chk_coded",
    f"""SELECT entity, CASE WHEN fail_check IS NULL THEN 'Passed' ELSE 'Failed' END AS state, fail_check, count(*) AS n
    FROM (SELECT 'CUS_SEGMENT' AS entity, CASE WHEN {SQL_EMPTY} THEN 'ATTR_ISPOPULATED' ELSE 'ATTR_ISCODED' END AS fail_check
          FROM (SELECT {SEGMENT} AS t FROM customer)
          UNION ALL SELECT 'CUS_NATION', NULL FROM customer) GROUP BY ALL""",
)
def chk_coded(spark, sf):
    items = text_items(CUS_SEGMENT=SEGMENT)
    items["CUS_NATION"] = Item.of_concept(None, codings(coding(F.col("c_nationkey"), F.lit("NATION"), F.col("c_name"))))
    rules = [criterion("CUS_SEGMENT", "ATTR_ISCODED"), criterion("CUS_NATION", "ATTR_ISCODED")]
    return tally(states(load(spark, sf, "customer"), "CUSTOMER", ["c_custkey"], items, rules), "entity")


def _line_numbers(check: str, steps, name: str):
    @register(name, _tally_sql("l_returnflag, l_linestatus", NUMBER, "lineitem", steps))
    def query(spark, sf):
        rows = states(
            load(spark, sf, "lineitem"), "LINE", ["l_returnflag", "l_linestatus"],
            text_items(LIN_NUMBER=NUMBER), [criterion("LIN_NUMBER", check)],
        )
        return tally(rows, "l_returnflag", "l_linestatus")

    return query


_INT = (f"NOT {SQL_INT}", "ATTR_ISINTEGER")
_NUM = (f"NOT {SQL_FLOAT}", "ATTR_ISNUMERIC")
_line_numbers("ATTR_ISINTEGER", [POP, _INT], "chk_integer")
_line_numbers("ATTR_ISNUMERIC", [POP, _NUM], "chk_numeric")
_line_numbers("ATTR_ISDECIMAL", [POP], "chk_decimal")
_line_numbers("ATTR_ISPOSITIVENUMBER", [POP, _NUM, ("trim(t) LIKE '-%'", "ATTR_ISPOSITIVENUMBER")], "chk_positive")
_line_numbers("ATTR_ISNEGATIVENUMBER", [POP, _INT, ("trim(t) NOT LIKE '-%'", "ATTR_ISNEGATIVENUMBER")], "chk_negative")

# Texts that are dates: by the priority that shaped them.
_NO_DATE = ("o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED')", "ATTR_ISDATE")
_SQL_TS = "(CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_orderdate + INTERVAL 510 MINUTE ELSE o_orderdate END)"


def _order_dates(check: str, steps, texts, name: str):
    @register(name, _row_sql("o_orderkey", DATE, "orders", steps, texts))
    def query(spark, sf):
        rows = states(
            load(spark, sf, "orders"), "ORDER", ["o_orderkey"], text_items(ORD_DATE=DATE),
            [criterion("ORD_DATE", check)], EvalContext(as_of=AS_OF),
        )
        return by_key(rows, "o_orderkey")

    return query


_DATE_TEXT = POP_TEXT | {"ATTR_ISDATE": "not a date"}
_order_dates("ATTR_ISDATE", [POP, _NO_DATE], _DATE_TEXT, "chk_date")
_order_dates(
    "ATTR_ISPASTDATE",
    [POP, _NO_DATE, (f"NOT {_SQL_TS} < TIMESTAMP '{AS_OF}'", "ATTR_ISPASTDATE")],
    _DATE_TEXT | {"ATTR_ISPASTDATE": "not a past date"},
    "chk_past",
)
_order_dates(
    "ATTR_ISFUTUREDATE",
    [POP, _NO_DATE, (f"NOT {_SQL_TS} > TIMESTAMP '{AS_OF}'", "ATTR_ISFUTUREDATE")],
    _DATE_TEXT | {"ATTR_ISFUTUREDATE": "not a future date"},
    "chk_future",
)


def _event_times(check: str, steps, texts, name: str, compat: bool = True):
    @register(name, _row_sql("event_id", TIME, "events", steps, texts))
    def query(spark, sf):
        rows = states(
            load(spark, sf, "events"), "EVENT", ["event_id"], text_items(EVT_TIME=TIME),
            [criterion("EVT_TIME", check)], EvalContext(as_of=AS_OF, compat=compat),
        )
        return by_key(rows, "event_id")

    return query


_EVT_NO_DATE = ("event_type = 'purchase'", "ATTR_ISDATE")
_EVT_MIDNIGHT = "event_type IN ('click', 'signup') OR substr(CAST(ts AS STRING), 12, 8) = '00:00:00'"
_event_times("ATTR_ISTIME", [_EVT_NO_DATE, (_EVT_MIDNIGHT, "ATTR_ISTIME")], {"ATTR_ISDATE": "not a date", "ATTR_ISTIME": "no time"}, "chk_time")
_event_times("ATTR_ISTIMESTAMP", [(f"event_type = 'purchase' OR {_EVT_MIDNIGHT}", "ATTR_ISTIMESTAMP")], {"ATTR_ISTIMESTAMP": "not a timestamp"}, "chk_timestamp")
_event_times("ATTR_ISTIMESTAMPTZ", [(f"event_type = 'purchase' OR {_EVT_MIDNIGHT}", "ATTR_ISTIMESTAMPTZ")], {"ATTR_ISTIMESTAMPTZ": "not a timestamp with zone"}, "chk_timestamp_tz")
_event_times(
    "ATTR_ISTIMESTAMPTZ",
    [(f"event_type <> 'error' OR {_EVT_MIDNIGHT}", "ATTR_ISTIMESTAMPTZ")],
    {"ATTR_ISTIMESTAMPTZ": "not a timestamp with zone"},
    "chk_timestamp_tz_strict",
    compat=False,
)


@register(
    "chk_in_list",
    _row_sql("o_orderkey", "lower(o_orderpriority)", "orders", [("t NOT IN ('1-urgent', '2-high')", "ATTR_INLIST")], {"ATTR_INLIST": "not in list"}),
)
def chk_in_list(spark, sf):
    rule = criterion("ORD_PRIORITY", "ATTR_INLIST", params={"LIST_CSV": "1-URGENT|2-HIGH| 3-MEDIUM|"})
    return by_key(states(load(spark, sf, "orders"), "ORDER", ["o_orderkey"], text_items(ORD_PRIORITY="lower(o_orderpriority)"), [rule]), "o_orderkey")


def _nation_lists(spark, sf) -> ValueLists:
    """External list of all nations, by key and name."""
    table = load(spark, sf, "nation").select(
        F.lit("NATIONS").alias("mnemonic"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("text")
    )
    return ValueLists.from_table(table)


_LISTED = "upper(t) IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation UNION SELECT upper(n_name) FROM nation)"
_NATION_TEXT = "CASE WHEN c_acctbal < 0 THEN '' WHEN c_mktsegment = 'BUILDING' THEN 'nation_' || CAST(c_nationkey AS STRING) WHEN c_mktsegment = 'MACHINERY' THEN 'x' || CAST(c_nationkey AS STRING) ELSE CAST(c_nationkey AS STRING) END"


@register("chk_external_list", _row_sql("c_custkey", _NATION_TEXT, "customer", [POP, (f"NOT {_LISTED}", "ATTR_INEXTERNALLIST")], POP_TEXT | {"ATTR_INEXTERNALLIST": "not in external list"}))
def chk_external_list(spark, sf):
    ctx = EvalContext(value_lists=_nation_lists(spark, sf))
    rule = criterion("CUS_NUMBER", "ATTR_INEXTERNALLIST", params={"EXTERNAL_LIST_MNEMONIC": "NATIONS"})
    return by_key(states(load(spark, sf, "customer"), "CUSTOMER", ["c_custkey"], text_items(CUS_NUMBER=_NATION_TEXT), [rule], ctx), "c_custkey")


@register(
    "chk_external_list_joined",
    """SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'Failed' ELSE 'Passed' END AS state,
       CASE WHEN c_custkey IS NULL THEN 'ATTR_INEXTERNALLIST' END AS fail_check,
       CASE WHEN c_custkey IS NULL THEN 'not in external list' ELSE '' END AS reason
       FROM orders LEFT JOIN customer ON o_custkey * 2 = c_custkey""",
)
def chk_external_list_joined(spark, sf):
    """A list as long as a table: joined, not turned into literals."""
    table = load(spark, sf, "customer").select(
        F.lit("CUSTOMERS").alias("mnemonic"), F.col("c_custkey").cast("string").alias("code"), F.col("c_name").alias("text")
    )
    ctx = EvalContext(value_lists=ValueLists.from_table(table))
    rule = criterion("ORD_TOTAL", "ATTR_INEXTERNALLIST", params={"EXTERNAL_LIST_MNEMONIC": "CUSTOMERS"})
    return by_key(states(load(spark, sf, "orders"), "ORDER", ["o_orderkey"], text_items(ORD_TOTAL="o_custkey * 2"), [rule], ctx), "o_orderkey")


@register("chk_regex", _row_sql("doc_id", "text", "documents", [POP, ("NOT regexp_matches(t, '[0-9]{3}')", "ATTR_MATCHESREGEX")], POP_TEXT | {"ATTR_MATCHESREGEX": "pattern not matched"}))
def chk_regex(spark, sf):
    rule = criterion("TXT_BODY", "ATTR_MATCHESREGEX", params={"CUSTOM_REGULAR_EXPRESSION": "[0-9]{3}"})
    return by_key(states(load(spark, sf, "documents"), "TEXT", ["doc_id"], text_items(TXT_BODY="text"), [rule]), "doc_id")


_YES = "CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'No' ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN '1' WHEN o_orderpriority = '2-HIGH' THEN 't' ELSE '' END END"


@register("chk_indicator", _row_sql("o_orderkey", _YES, "orders", [POP, ("t = 'No'", "ATTRIBUTE_INDICATOR_IS_TRUE")], POP_TEXT | {"ATTRIBUTE_INDICATOR_IS_TRUE": "indicator not true"}))
def chk_indicator(spark, sf):
    return by_key(states(load(spark, sf, "orders"), "ORDER", ["o_orderkey"], text_items(ORD_STATUS=_YES), [criterion("ORD_STATUS", "ATTRIBUTE_INDICATOR_IS_TRUE")]), "o_orderkey")


# --- ranges and observation values --------------------------------------

_LOW = "CASE WHEN p_type = 'SMALL' THEN '' WHEN p_type = 'PROMO' THEN 'low' ELSE CAST(p_size AS STRING) END"
_HIGH = "CASE WHEN p_type = 'LARGE' THEN '  ' ELSE '25' END"


def _ranges(check: str, name: str, steps, texts, compat: bool):
    @register(name, _row_sql("p_partkey", "p_type", "part", steps, texts))
    def query(spark, sf):
        items = {"PRT_RANGE": Item.of_range(F.expr(_LOW), F.expr(_HIGH), F.col("p_type"))}
        ctx = EvalContext(compat=compat)
        return by_key(states(load(spark, sf, "part"), "PART", ["p_partkey"], items, [criterion("PRT_RANGE", check)], ctx), "p_partkey")

    return query


_ranges("RANGEVALUE_ISCOMPLETE", "chk_range_complete", [("p_type IN ('SMALL', 'LARGE')", "RANGEVALUE_ISCOMPLETE")], {"RANGEVALUE_ISCOMPLETE": "incomplete range"}, True)
_ranges("RANGEVALUE_ISVALID", "chk_range_valid", [("p_type IN ('SMALL', 'LARGE', 'PROMO') OR p_size > 25", "RANGEVALUE_ISVALID")], {"RANGEVALUE_ISVALID": "invalid range"}, False)

_VALUE = "CASE event_type WHEN 'error' THEN 'n/a' WHEN 'signup' THEN CAST(value AS STRING) || '^' || CAST(value + 1 AS STRING) WHEN 'purchase' THEN '7^' ELSE CAST(value AS STRING) END"
_VTYPE = "CASE event_type WHEN 'click' THEN 'NM' WHEN 'view' THEN 'ce' WHEN 'error' THEN 'PQ' WHEN 'signup' THEN 'NR' ELSE CASE WHEN value > 50 THEN 'NR' ELSE 'CE' END END"


def _observations(check: str, name: str, cond: str, text: str, params=None):
    @register(name, _row_sql("event_id", "event_type", "events", [(cond, check)], {check: text}))
    def query(spark, sf):
        items = {"EVT_VALUE": Item.of_observation(F.expr(_VALUE), F.expr(_VTYPE))}
        rule = criterion("EVT_VALUE", check, params=params)
        return by_key(states(load(spark, sf, "events"), "EVENT", ["event_id"], items, [rule]), "event_id")

    return query


# The unknown type 'ce' falls back to ST.
_observations(
    "OBSERVATIONVALUE_MATCHESTYPE", "chk_value_matches_type",
    "event_type = 'error' OR event_type = 'purchase'", "value does not match type",
)
_observations(
    "OBSERVATIONVALUETYPE_INLIST", "chk_value_type_list", "NOT event_type IN ('click', 'signup') AND NOT (event_type = 'purchase' AND value > 50)",
    "value type not in list", {"VALUE_TYPE_CSV": "nm,nr"},
)


@register(
    "chk_qualitative",
    _row_sql("event_id", "event_type", "events", [("NOT (event_type = 'view' OR (event_type = 'purchase' AND value <= 50))", "OBSERVATIONVALUE_ISQUALITATIVE")], {"OBSERVATIONVALUE_ISQUALITATIVE": "not qualitative"}),
)
def chk_qualitative(spark, sf):
    items = {"EVT_VALUE": Item.of_observation(F.expr(_VALUE), F.expr(_VTYPE))}
    rule = criterion("EVT_VALUE", "OBSERVATIONVALUE_ISQUALITATIVE", params={"Valid Attribute List": "CE|CWE|CD|ST|FT|TX"})
    return by_key(states(load(spark, sf, "events"), "EVENT", ["event_id"], items, [rule]), "event_id")


# --- element, validity and extension checks -----------------------------


@register(
    "chk_element_clean",
    f"""SELECT l_returnflag, l_linestatus, state, count(*) AS n FROM (
    SELECT l_returnflag, l_linestatus, CASE WHEN {SQL_EMPTY} OR NOT {SQL_FLOAT} OR l_shipdate >= TIMESTAMP '{AS_OF}' OR l_linenumber > 5 THEN 'Failed' ELSE 'Passed' END AS state
    FROM (SELECT *, {NUMBER} AS t FROM lineitem)) GROUP BY ALL""",
)
def chk_element_clean(spark, sf):
    items = text_items(LIN_NUMBER=NUMBER, LIN_SHIP="CAST(l_shipdate AS STRING)", LIN_TAX="l_linenumber")
    rules = [
        criterion("LIN_NUMBER", "ATTR_ISNUMERIC"),
        criterion("LIN_SHIP", "ATTR_ISPASTDATE"),
        criterion("LIN_TAX", "ATTR_INLIST", params={"LIST_CSV": "0,1,2,3,4,5"}, effect="Informational"),
        criterion("LINE_ELM", "ELEMENT_ISCLEAN"),
    ]
    rows = states(load(spark, sf, "lineitem"), "LINE", ["l_returnflag", "l_linestatus"], items, rules, EvalContext(as_of=AS_OF))
    return (
        rows.filter("entity = 'LINE_ELM'").groupBy("l_returnflag", "l_linestatus", "state").agg(F.count(F.lit(1)).alias("n"))
    )


@register(
    "chk_eval_valid",
    "SELECT o_orderstatus, 'Skipped' AS state, 'EVAL_ISVALID' AS skip_check, 'invalid evaluation' AS reason, count(*) AS n FROM orders GROUP BY ALL",
)
def chk_eval_valid(spark, sf):
    """A criterion without the parameter its check declares is skipped."""
    rows = states(load(spark, sf, "orders"), "ORDER", ["o_orderstatus"], text_items(ORD_STATUS="o_orderstatus"), [criterion("ORD_STATUS", "ATTR_INLIST")])
    return rows.groupBy("o_orderstatus", "state", "skip_check", "reason").agg(F.count(F.lit(1)).alias("n"))


def _custom_library() -> CheckLibrary:
    def short_code(item, params, ctx) -> Outcome:
        size = F.length(item.text)
        return Outcome(
            size.between(1, int(params["MAX"])),
            error=~item.present,
            error_text="No value.",
            skipped=size == 0,
            reason=F.concat(F.lit("has "), size.cast("string"), F.lit(" characters")),
        )

    from rubrica.plans.checks import Param

    defs = {m: CheckLibrary().get(m) for m in CheckLibrary().mnemonics()}
    defs["SHORT_CODE"] = CheckDef("SHORT_CODE", "Short code", "too long", None, (Param("Max", "MAX"),), short_code)
    defs["NOT_WRITTEN"] = CheckDef("NOT_WRITTEN", "Not written", "no function")
    return CheckLibrary(defs)


@register(
    "chk_custom",
    """SELECT c_custkey, CASE WHEN length(c_mktsegment) <= 8 THEN 'Passed' ELSE 'Failed' END AS state, -- an empty code is no matter for this check
    CASE WHEN length(c_mktsegment) > 8 THEN 'SHORT_CODE' END AS fail_check,
    CASE WHEN length(c_mktsegment) > 8 THEN 'has ' || CAST(length(c_mktsegment) AS VARCHAR) || ' characters' ELSE '' END AS reason FROM customer""",
)
def chk_custom(spark, sf):
    """A check registered by the user, with its own reason text; it declines to answer on empty codes."""
    rule = replace(criterion("CUS_SEGMENT", "ATTR_ISPOPULATED"), check="SHORT_CODE", params=(("MAX", "8", "Max"),))
    ctx = EvalContext(library=_custom_library())
    return by_key(states(load(spark, sf, "customer"), "CUSTOMER", ["c_custkey"], text_items(CUS_SEGMENT="CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END"), [rule], ctx), "c_custkey")


@register(
    "chk_external_function",
    "SELECT event_type, CASE WHEN value < 100 THEN 'Passed' ELSE 'Failed' END AS state, count(*) AS n FROM events GROUP BY ALL",
)
def chk_external_function(spark, sf):
    """An outside assessment as a pandas function over Arrow batches."""
    @F.pandas_udf("boolean")
    def assess(values: pd.Series) -> pd.Series:
        return values < 100

    def external(item, params, ctx) -> Outcome:
        return Outcome(assess(item.number))

    defs = {m: CheckLibrary().get(m) for m in CheckLibrary().mnemonics()}
    defs["CUSTOM_EXTERNAL_ASSESSMENT"] = CheckDef("CUSTOM_EXTERNAL_ASSESSMENT", "External", "rejected", None, (), external, can_error=False)
    rule = replace(criterion("EVT_VALUE", "ATTR_ISPOPULATED"), check="CUSTOM_EXTERNAL_ASSESSMENT")
    items = {"EVT_VALUE": Item.of_observation(F.col("value").cast("string"), F.lit("NM"))}
    rows = states(load(spark, sf, "events"), "EVENT", ["event_type"], items, [rule], EvalContext(library=CheckLibrary(defs)))
    return rows.groupBy("event_type", "state").agg(F.count(F.lit(1)).alias("n"))


@register(
    "chk_default_and_sample",
    """SELECT check, state, count(*) AS n FROM (
    SELECT 'NOT_WRITTEN' AS "check", 'Failed' AS state FROM supplier UNION ALL SELECT 'ATTR_TEST_1', 'Passed' FROM supplier) GROUP BY ALL""".replace("SELECT check,", 'SELECT "check",'),
)
def chk_default_and_sample(spark, sf):
    """A check without a function always fails; the sample check always passes."""
    base = criterion("CUS_SEGMENT", "ATTR_ISPOPULATED")
    rules = [replace(base, check="NOT_WRITTEN"), replace(base, sequence=2, check="ATTR_TEST_1")]
    rows = states(load(spark, sf, "supplier"), "CUSTOMER", ["s_suppkey"], text_items(CUS_SEGMENT="s_name"), rules, EvalContext(library=_custom_library()))
    return rows.groupBy("check", "state").agg(F.count(F.lit(1)).alias("n"))


@register(
    "criterion_processing_url",
    """SELECT c_custkey, CASE WHEN c_acctbal >= 2000 THEN 'Passed' ELSE 'Failed' END AS state FROM customer""",
)
def criterion_processing_url(spark, sf):
    """A check of our own that reads the criterion's processing URL beside its parameters."""

    def at_least(item, params, ctx):
        limit = int(params[PROCESSING].rpartition(":")[2]) * int(params["TIMES"])
        return Outcome(item.text.cast("double") >= limit)

    lib = CheckLibrary()
    defs = {m: lib.get(m) for m in lib.mnemonics()}
    defs["AT_LEAST"] = CheckDef("AT_LEAST", "At least", params=(Param("Times", "TIMES"),), fn=at_least, can_error=False)
    rule = Criterion(1, "CUS_BALANCE", "AT_LEAST", params=(("TIMES", "10", "Times"),), processing="urn:least:200")
    built = compile_rubric(Rubric("R", (rule,), "r", MODEL.mnemonic), MODEL, EvalContext(library=CheckLibrary(defs)))
    source = TableSource(load(spark, sf, "customer"), "CUSTOMER", ["c_custkey"], text_items(CUS_BALANCE="c_acctbal"))
    return table_results(source, built).select("c_custkey", "state")


@register(
    "rubric_faults",
    """SELECT c_mktsegment, count(*) AS customers, c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS check_missing, true AS repeated FROM customer GROUP BY c_mktsegment""",
)
def rubric_faults(spark, sf):
    """Rubrics written from the segments: checks that the library does not have, and criteria that repeat."""
    lib = CheckLibrary()
    defs = {m: lib.get(m) for m in lib.mnemonics()}
    for known in ("BUILDING", "MACHINERY"):
        defs[known] = CheckDef(known, known, fn=lambda item, params, ctx: Outcome(item.present), can_error=False)
    library = CheckLibrary(defs)
    counts = load(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))
    # One criterion a segment.
    segments = [r["c_mktsegment"] for r in counts.collect()]
    rubric = Rubric("R", tuple(Criterion(i, "CUS_SEGMENT", s) for i, s in enumerate(segments)), "r", MODEL.mnemonic)
    missing = missing_checks(rubric, library)
    refused = []
    for s in segments:
        twice = Rubric("R", (Criterion(1, "CUS_SEGMENT", s), Criterion(1, "CUS_SEGMENT", s)), "r", MODEL.mnemonic)
        try:
            compile_rubric(twice, MODEL, EvalContext(library=library))
        except ValueError as fault:
            if "repeated" in str(fault):
                refused.append(s)
    return counts.select("c_mktsegment", "customers", F.col("c_mktsegment").isin(missing).alias("check_missing"), F.col("c_mktsegment").isin(refused).alias("repeated"))
