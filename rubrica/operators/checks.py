"""The check library: one function per check mnemonic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubrica.functions import text as tx
from rubrica.functions.values import Item
from rubrica.plans.checks import POPULATED, VALIDITY, Outcome, Param, check
from rubrica.sources import fixed
from rubrica.sources.fixed import QUALITATIVE_TYPES, UNKNOWN_DATA_TYPE

SIMILAR_ENOUGH = 50
# Texts the indicator check accepts.
TRUE_INDICATORS = ("T", "TRUE", "Y", "YES", "1")


def _missing(item: Item) -> Column:
    return ~item.present


def _value_check(item: Item, passed: Column, error: Column | None = None, text: str = "") -> Outcome:
    bad = _missing(item) if error is None else _missing(item) | error
    return Outcome(passed, error=bad, error_text=text or "No value. Check the prerequisites.")


# --- presence and type of text ------------------------------------------


@check(POPULATED, "Attribute is populated", fail_name="unpopulated", kinds=("ATR", "CC", "OBSVAL", "RV"), can_error=False)
def attr_is_populated(item, params, ctx):
    return Outcome(item.present & tx.not_empty(item.text))


@check("ATTR_ISCODED", "Attribute is coded", fail_name="not coded", prerequisite=POPULATED, safe_after=(POPULATED,))
def attr_is_coded(item, params, ctx):
    return _value_check(item, item.is_concept)


@check("ATTR_ISDATE", "Attribute is a date", fail_name="not a date", prerequisite=POPULATED, safe_after=(POPULATED,))
def attr_is_date(item, params, ctx):
    empty = ~tx.not_empty(item.text)
    ts = tx.nullable_date(item.text)
    reason = F.when(empty, F.lit(fixed.NOT_POPULATED_DATE))
    out = _value_check(item, ts.isNotNull())
    return Outcome(out.passed, out.error, out.error_text, reason=reason)


def _seconds_of_day(ts: Column) -> Column:
    return (
        F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")
    )


@check("ATTR_ISTIME", "Attribute has a time", fail_name="no time", prerequisite="ATTR_ISDATE", safe_after=("ATTR_ISDATE",))
def attr_is_time(item, params, ctx):
    ts = tx.parse_datetime(item.text)
    return _value_check(item, _seconds_of_day(ts) > 0, ts.isNull(), "Value is not a date-time. Check the prerequisites.")


def _timestamp(item: Item) -> Outcome:
    ts = tx.nullable_date(item.text)
    return _value_check(item, ts.isNotNull() & (_seconds_of_day(ts) > 0))


@check("ATTR_ISTIMESTAMP", "Attribute is a timestamp", fail_name="not a timestamp", prerequisite=POPULATED, safe_after=(POPULATED,))
def attr_is_timestamp(item, params, ctx):
    return _timestamp(item)


@check("ATTR_ISTIMESTAMPTZ", "Attribute is a timestamp with zone", fail_name="not a timestamp with zone", prerequisite=POPULATED, safe_after=(POPULATED,))
def attr_is_timestamp_tz(item, params, ctx):
    out = _timestamp(item)
    if ctx.compat:
        return out
    zoned = F.trim(item.text).rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    return Outcome(out.passed & zoned, out.error, out.error_text)


@check("ATTR_ISPASTDATE", "Attribute is a past date", fail_name="not a past date", prerequisite="ATTR_ISDATE", safe_after=("ATTR_ISDATE",))
def attr_is_past_date(item, params, ctx):
    ts = tx.parse_datetime(item.text)
    return _value_check(item, ts < ctx.now(), ts.isNull(), "Value is not a date-time. Check the prerequisites.")


@check("ATTR_ISFUTUREDATE", "Attribute is a future date", fail_name="not a future date", prerequisite="ATTR_ISDATE", safe_after=("ATTR_ISDATE",))
def attr_is_future_date(item, params, ctx):
    ts = tx.parse_datetime(item.text)
    return _value_check(item, ts > ctx.now(), ts.isNull(), "Value is not a date-time. Check the prerequisites.")


@check("ATTR_ISINTEGER", "Attribute is an integer", fail_name="not an integer", prerequisite=POPULATED, safe_after=(POPULATED,))
def attr_is_integer(item, params, ctx):
    return _value_check(item, tx.parse_int(item.text).isNotNull())


@check("ATTR_ISNUMERIC", "Attribute is numeric", fail_name="not numeric", prerequisite=POPULATED, safe_after=(POPULATED,))
def attr_is_numeric(item, params, ctx):
    return _value_check(item, tx.parse_float(item.text).isNotNull())


@check("ATTR_ISDECIMAL", "Attribute is a decimal", fail_name="not a decimal", prerequisite=POPULATED, safe_after=(POPULATED,))
def attr_is_decimal(item, params, ctx):
    if ctx.compat:
        return _value_check(item, F.lit(True))
    return _value_check(item, tx.parse_decimal(item.text).isNotNull())


@check("ATTR_ISPOSITIVENUMBER", "Attribute is positive", fail_name="not positive", prerequisite="ATTR_ISNUMERIC", safe_after=("ATTR_ISNUMERIC",))
def attr_is_positive(item, params, ctx):
    n = tx.parse_float(item.text)
    return _value_check(item, ~F.isnan(n) & (n > 0), n.isNull(), "Value is not numeric. Check the prerequisites.")


@check("ATTR_ISNEGATIVENUMBER", "Attribute is negative", fail_name="not negative", prerequisite="ATTR_ISINTEGER", safe_after=("ATTR_ISINTEGER",))
def attr_is_negative(item, params, ctx):
    if ctx.compat:
        n = tx.parse_int(item.text)
        return _value_check(item, n < 0, n.isNull(), "Value is not an integer. Check the prerequisites.")
    n = tx.parse_float(item.text)
    return _value_check(item, ~F.isnan(n) & (n < 0), n.isNull(), "Value is not numeric. Check the prerequisites.")


# --- lists and patterns -------------------------------------------------


def _no_params() -> Outcome:
    return Outcome(F.lit(False), error=F.lit(True), error_text=fixed.NO_PARAMETERS)


@check("ATTR_INLIST", "Attribute is in list", fail_name="not in list", prerequisite=POPULATED, safe_after=(POPULATED,), params=(Param("List CSV", "LIST_CSV"),))
def attr_in_list(item, params, ctx):
    raw = params.get("LIST_CSV")
    if raw is None:
        return _no_params()
    wanted = [v.upper() for v in tx.split_list(raw) or []]
    return _value_check(item, tx.not_empty(item.text) & F.upper(item.text).isin(*wanted))


def list_values(item: Item) -> Column:
    """Texts compared with an external list: codes of complete codings, else the text."""
    complete = F.filter(item.codings, _complete)
    return F.when(
        item.is_concept,
        F.coalesce(F.transform(complete, lambda c: F.upper(c["code"])), F.array().cast("array<string>")),
    ).otherwise(F.when(tx.not_empty(item.text), F.array(F.upper(item.text))).otherwise(F.array().cast("array<string>")))


@check("ATTR_INEXTERNALLIST", "Attribute is in external list", fail_name="not in external list", prerequisite=POPULATED, safe_after=(POPULATED,), needs=("lists",),
       params=(Param("External List  Mnemonic", "EXTERNAL_LIST_MNEMONIC"),))
def attr_in_external_list(item, params, ctx):
    name = params.get("EXTERNAL_LIST_MNEMONIC")
    if name is None:
        return _no_params()
    values = list_values(item)
    nothing = F.size(values) == 0
    reason = F.when(
        nothing,
        F.when(item.is_concept, "Attribute contained no complete codings").otherwise("Attribute was unpopulated"),
    )
    if not ctx.value_lists.has(name):
        unknown = ~nothing
        return Outcome(F.lit(False), error=_missing(item) | unknown, error_text=f"Value data [{name}] not in reference data.", reason=reason)
    if ctx.value_lists.is_literal(name):
        keys = ctx.value_lists.literal_keys(name)
        hit = F.exists(values, lambda v: v.isin(*keys)) if keys else F.lit(False)
    else:
        hit = F.array_contains(item.lists, name)
    return Outcome(F.coalesce(hit, F.lit(False)), error=_missing(item), error_text="No value. Check the prerequisites.", reason=reason)


@check("ATTR_MATCHESREGEX", "Attribute matches pattern", fail_name="pattern not matched", prerequisite=POPULATED, safe_after=(POPULATED,), params=(Param("Custom Regular Expression", "CUSTOM_REGULAR_EXPRESSION"),))
def attr_matches_regex(item, params, ctx):
    pattern = params.get("CUSTOM_REGULAR_EXPRESSION")
    if pattern is None:
        return _no_params()
    return _value_check(item, F.coalesce(item.text, F.lit("")).rlike(pattern))


@check("ATTRIBUTE_INDICATOR_IS_TRUE", "Indicator is true", fail_name="indicator not true", prerequisite=POPULATED, safe_after=(POPULATED,))
def attr_indicator_is_true(item, params, ctx):
    return _value_check(item, item.is_concept | F.upper(item.text).isin(*TRUE_INDICATORS), ~tx.not_empty(item.text), fixed.NOT_POPULATED)


# --- coded concepts -----------------------------------------------------


def _concept_check(item: Item, passed: Column) -> Outcome:
    return Outcome(F.coalesce(passed, F.lit(False)), error=~item.is_concept, error_text="A coded concept is expected.")


def _filled(c: Column) -> Column:
    return ~tx.is_blank(c)


def _complete(c: Column) -> Column:
    return _filled(c["system"]) & _filled(c["code"]) & _filled(c["display"])


_CONCEPT = {"safe_after": ("ATTR_ISCODED",), "kinds": ("CC", "OBSVAL")}


@check("CONCEPT_HASCODE", "Concept has a code", fail_name="no code", prerequisite="ATTR_ISCODED", **_CONCEPT)
def concept_has_code(item, params, ctx):
    return _concept_check(item, F.exists(item.codings, lambda c: _filled(c["code"])))


@check("CONCEPT_HASCODESYSTEM", "Concept has a code system", fail_name="no code system", prerequisite="CONCEPT_HASCODE", **_CONCEPT)
def concept_has_code_system(item, params, ctx):
    return _concept_check(item, F.exists(item.codings, lambda c: _filled(c["system"])))


@check("CONCEPT_HASDISPLAY", "Concept has a display", fail_name="no display", prerequisite="ATTR_ISCODED", **_CONCEPT)
def concept_has_display(item, params, ctx):
    both = tx.not_empty(item.text) & (F.size(item.codings) > 0)
    return _concept_check(item, F.coalesce(both, F.lit(False)) | F.coalesce(F.exists(item.codings, lambda c: _filled(c["display"])), F.lit(False)))


@check("CONCEPT_ISCOMPLETE", "Concept is complete", fail_name="incomplete concept", prerequisite="ATTR_ISCODED", **_CONCEPT)
def concept_is_complete(item, params, ctx):
    return _concept_check(item, F.exists(item.codings, _complete))


@check("CONCEPT_HASRECOGNIZEDCODESYSTEM", "Concept has a recognized code system", fail_name="unrecognized code system", prerequisite="CONCEPT_HASCODESYSTEM", needs=("term",), **_CONCEPT)
def concept_has_recognized_system(item, params, ctx):
    return _concept_check(item, item.term["recognized"])


@check("CONCEPT_ISVALID", "Concept is valid", fail_name="invalid concept", prerequisite="CONCEPT_HASCODESYSTEM", needs=("term",), **_CONCEPT)
def concept_is_valid(item, params, ctx):
    return _concept_check(item, item.term["valid"])


@check("CONCEPT_ISACTIVE", "Concept is active", fail_name="inactive concept", prerequisite="CONCEPT_ISVALID", needs=("term",), **_CONCEPT)
def concept_is_active(item, params, ctx):
    return _concept_check(item, item.term["active"])


@check("CONCEPT_ISCONSISTENT", "Concept is semantically consistent", fail_name="inconsistent concept", prerequisite="CONCEPT_ISVALID", needs=("term",), **_CONCEPT)
def concept_is_consistent(item, params, ctx):
    return _concept_check(item, item.term["similarity"] >= SIMILAR_ENOUGH)


@check("CONCEPT_ISVALIDMEMBER", "Concept is a valid member", fail_name="not a valid member", prerequisite="CONCEPT_ISVALID", needs=("term",), params=(Param("Code System CSV", "CODE_SYSTEM_CSV"),), **_CONCEPT)
def concept_is_valid_member(item, params, ctx):
    raw = params.get("CODE_SYSTEM_CSV")
    if raw is None:
        return _no_params()
    ids = sorted({i for i in (ctx.code_systems.canonical(s) for s in tx.split_list(raw) or []) if i})
    hit = F.arrays_overlap(item.term["system_ids"], F.array(*[F.lit(i) for i in ids])) if ids else F.lit(False)
    return _concept_check(item, hit)


@check("CONCEPT_ISINVALUESET", "Concept is in value set", fail_name="not in value set", prerequisite="CONCEPT_ISVALID", needs=("term",), params=(Param("value set mnemonic", "value set mnemonic"),), **_CONCEPT)
def concept_is_in_value_set(item, params, ctx):
    name = params.get("value set mnemonic")
    if name is None:
        return _no_params()
    return _concept_check(item, F.array_contains(item.term["value_sets"], name))


# --- ranges and observation values --------------------------------------


@check("RANGEVALUE_ISCOMPLETE", "Range has low and high", fail_name="incomplete range", prerequisite=POPULATED, kinds=("RV",))
def range_is_complete(item, params, ctx):
    return Outcome(_filled(item.low) & _filled(item.high), error=~item.is_range, error_text="A reference range is expected.")


@check("RANGEVALUE_ISVALID", "Range is valid", fail_name="invalid range", prerequisite=POPULATED, kinds=("RV",))
def range_is_valid(item, params, ctx):
    if ctx.compat:
        return Outcome(F.lit(False), error=F.lit(True), error_text="Check not implemented.")
    low, high = tx.parse_double(item.low), tx.parse_double(item.high)
    return Outcome(low <= high, error=~item.is_range, error_text="A reference range is expected.")


_OBSERVATION = {"kinds": ("OBSVAL",), "prerequisite": POPULATED}


def _observation_check(item: Item, passed: Column) -> Outcome:
    return Outcome(F.coalesce(passed, F.lit(False)), error=~item.is_observation, error_text="An observation value is expected.")


@check("OBSERVATIONVALUE_ISQUALITATIVE", "Value is qualitative", fail_name="not qualitative", params=(Param("Valid Attribute List", "Valid Attribute List", optional=True),), **_OBSERVATION)
def value_is_qualitative(item, params, ctx):
    wanted = tx.split_list(params.get("Valid Attribute List") or QUALITATIVE_TYPES) or []
    return _observation_check(item, F.upper(item.type_code).isin(*[w.upper() for w in wanted]))


@check("OBSERVATIONVALUE_MATCHESTYPE", "Value matches its type", fail_name="value does not match type", **_OBSERVATION)
def value_matches_type(item, params, ctx):
    coded = [t[0] for t in ctx.data_types if t[2]]
    numeric = [t[0] for t in ctx.data_types if t[3]]
    ranged = [t[0] for t in ctx.data_types if t[3] and t[4]]
    code = item.type_code
    passed = (
        F.when(code.isNull() | (code == UNKNOWN_DATA_TYPE), F.lit(False))
        .when(code.isin(*coded) & F.coalesce(F.size(item.codings) <= 0, F.lit(True)), F.lit(False))
        .when(code.isin(*numeric) & item.number.isNull(), F.lit(False))
        .when(code.isin(*ranged) & item.number2.isNull(), F.lit(False))
        .otherwise(_filled(item.text))
    )
    return _observation_check(item, passed)


@check("OBSERVATIONVALUETYPE_INLIST", "Value type is in list", fail_name="value type not in list", params=(Param("Value Type CSV", "VALUE_TYPE_CSV"),), **_OBSERVATION)
def value_type_in_list(item, params, ctx):
    raw = params.get("VALUE_TYPE_CSV")
    if raw is None:
        return _no_params()
    return _observation_check(item, F.upper(item.type_code).isin(*[v.upper() for v in tx.split_list(raw) or []]))


# --- content tables -----------------------------------------------------

_SET = Param("Content Set Mnemonic", "CONTENT_SET")
_CODE = Param("Code Attribute", "CODE_ATTRIBUTE")
_UNIT = Param("Unit Attribute", "UNIT_ATTRIBUTE")
_CONTENT = {"prerequisite": POPULATED, "safe_after": (POPULATED,), "needs": ("content",)}


def content_key(mnemonic: str, params: dict) -> str:
    """Name under which the answer of a content check stands among an item's lists."""
    return "|".join(["content", mnemonic, *[f"{k}={params[k]}" for k in sorted(params)]])


def _content_check(mnemonic: str):
    def answer(item, params, ctx):
        return _value_check(item, F.array_contains(item.lists, content_key(mnemonic, params)))

    return answer


check("TEXT_IN_CONTENT_SET", "Text is in content set", fail_name="not an allowed text", params=(_SET,), **_CONTENT)(_content_check("TEXT_IN_CONTENT_SET"))
check("VALUE_IN_RANGE_SET", "Value is in range set", fail_name="outside the ranges of its code", params=(_SET, _CODE, _UNIT), **_CONTENT)(_content_check("VALUE_IN_RANGE_SET"))
check("UNIT_IS_PRIMARY", "Unit is primary", fail_name="not the primary unit", params=(_SET, _CODE), **_CONTENT)(_content_check("UNIT_IS_PRIMARY"))


# --- whole-element, validity and extension checks -----------------------


@check("ELEMENT_ISCLEAN", "Element is clean", fail_name="element has failures", needs=("children",), can_error=False, input_type="Element")
def element_is_clean(item, params, ctx):
    return Outcome(item.child_fails == 0)


@check(VALIDITY, "Evaluation is valid", fail_name="invalid evaluation", can_error=False)
def eval_is_valid(item, params, ctx):
    return Outcome(F.lit(True))


@check("ATTR_TEST_1", "Sample check", fail_name="sample check failed", can_error=False)
def sample_check(item, params, ctx):
    return Outcome(F.lit(True))
