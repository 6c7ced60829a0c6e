"""Each check: passing, failing, erroring and missing values."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from rubrica.functions.values import Item, coding, codings
from rubrica.plans.checks import CheckLibrary
from rubrica.plans.context import EvalContext
from rubrica.sources.reference import CodeSystem, CodeSystems, Terminology, ValueLists

FAILED, PASSED, ERRORED = 0, 1, 3
CTX = EvalContext(as_of="2020-06-01T00:00:00", value_lists=ValueLists({"UNITS": [("mg", "Milligram"), ("L", None)]}))


def state(spark, mnemonic, item, params=None, ctx=CTX):
    out = CheckLibrary().get(mnemonic).fn(item, params or {}, ctx)
    return spark.range(1).select(out.state().alias("s")).first().s


def text(value):
    return Item.of_text(F.lit(value).cast("string"), present=F.lit(True))


def missing():
    return replace(Item.empty(), present=F.lit(False))

TEXT_CASES = [
    ("ATTR_ISPOPULATED", " ", PASSED), ("ATTR_ISPOPULATED", "", FAILED), ("ATTR_ISPOPULATED", None, FAILED),
    ("ATTR_ISCODED", "x", FAILED),
    ("ATTR_ISDATE", "2020-01-01", PASSED), ("ATTR_ISDATE", "x", FAILED), ("ATTR_ISDATE", "", FAILED),
    ("ATTR_ISTIME", "2020-01-01 10:00:00", PASSED), ("ATTR_ISTIME", "2020-01-01", FAILED), ("ATTR_ISTIME", "x", ERRORED),
    ("ATTR_ISTIMESTAMP", "2020-01-01 00:00:01", PASSED), ("ATTR_ISTIMESTAMP", "2020-01-01", FAILED), ("ATTR_ISTIMESTAMP", "x", FAILED),
    ("ATTR_ISTIMESTAMPTZ", "2020-01-01 00:00:01", PASSED),
    ("ATTR_ISPASTDATE", "2020-05-31", PASSED), ("ATTR_ISPASTDATE", "2020-06-02", FAILED), ("ATTR_ISPASTDATE", "x", ERRORED),
    ("ATTR_ISFUTUREDATE", "2020-06-02", PASSED), ("ATTR_ISFUTUREDATE", "2020-06-01", FAILED), ("ATTR_ISFUTUREDATE", "", ERRORED),
    ("ATTR_ISINTEGER", "+12", PASSED), ("ATTR_ISINTEGER", "1.0", FAILED),
    ("ATTR_ISNUMERIC", "1,234.5", PASSED), ("ATTR_ISNUMERIC", "1d", FAILED), ("ATTR_ISNUMERIC", "NaN", PASSED),
    ("ATTR_ISDECIMAL", "x", PASSED),
    ("ATTR_ISPOSITIVENUMBER", "0.1", PASSED), ("ATTR_ISPOSITIVENUMBER", "0", FAILED), ("ATTR_ISPOSITIVENUMBER", "x", ERRORED), ("ATTR_ISPOSITIVENUMBER", "NaN", FAILED),
    ("ATTR_ISNEGATIVENUMBER", "-1", PASSED), ("ATTR_ISNEGATIVENUMBER", "1", FAILED), ("ATTR_ISNEGATIVENUMBER", "-1.5", ERRORED),
    ("ATTRIBUTE_INDICATOR_IS_TRUE", "YES", PASSED), ("ATTRIBUTE_INDICATOR_IS_TRUE", "no", FAILED), ("ATTRIBUTE_INDICATOR_IS_TRUE", "", ERRORED),
    ("CONCEPT_HASCODE", "x", ERRORED), ("RANGEVALUE_ISCOMPLETE", "x", ERRORED), ("OBSERVATIONVALUE_ISQUALITATIVE", "x", ERRORED),
    ("RANGEVALUE_ISVALID", "x", ERRORED),
    ("ATTR_TEST_1", "x", PASSED), ("EVAL_ISVALID", "x", PASSED),
]


@pytest.mark.parametrize("mnemonic,value,want", TEXT_CASES)
def test_text_checks(spark, mnemonic, value, want):
    assert state(spark, mnemonic, text(value)) == want


@pytest.mark.parametrize("mnemonic", sorted(set(m for m, _, _ in TEXT_CASES) - {"ATTR_ISPOPULATED", "ATTR_TEST_1", "EVAL_ISVALID"}))
def test_missing_value_errors(spark, mnemonic):
    assert state(spark, mnemonic, missing()) == ERRORED


def test_missing_value_is_not_populated(spark):
    assert state(spark, "ATTR_ISPOPULATED", missing()) == FAILED


def test_corrected_checks(spark):
    fixed = replace(CTX, compat=False)
    assert state(spark, "ATTR_ISDECIMAL", text("x"), ctx=fixed) == FAILED
    assert state(spark, "ATTR_ISDECIMAL", text("1.25"), ctx=fixed) == PASSED
    assert state(spark, "ATTR_ISNEGATIVENUMBER", text("-1.5"), ctx=fixed) == PASSED
    assert state(spark, "ATTR_ISTIMESTAMPTZ", text("2020-01-01 00:00:01"), ctx=fixed) == FAILED
    assert state(spark, "ATTR_ISTIMESTAMPTZ", text("2020-01-01T00:00:01Z"), ctx=fixed) == PASSED
    rng = Item.of_range(F.lit("1"), F.lit("2"))
    assert state(spark, "RANGEVALUE_ISVALID", rng, ctx=fixed) == PASSED
    assert state(spark, "RANGEVALUE_ISVALID", Item.of_range(F.lit("3"), F.lit("2")), ctx=fixed) == FAILED


def test_lists_and_patterns(spark):
    csv = {"LIST_CSV": "a|B"}
    assert state(spark, "ATTR_INLIST", text("b"), csv) == PASSED
    assert state(spark, "ATTR_INLIST", text(""), csv) == FAILED
    assert state(spark, "ATTR_INLIST", text("b")) == ERRORED
    assert state(spark, "ATTR_MATCHESREGEX", text("xx1"), {"CUSTOM_REGULAR_EXPRESSION": "[0-9]"}) == PASSED
    units = {"EXTERNAL_LIST_MNEMONIC": "UNITS"}
    assert state(spark, "ATTR_INEXTERNALLIST", text("MILLIGRAM"), units) == PASSED
    assert state(spark, "ATTR_INEXTERNALLIST", text("x"), units) == FAILED
    assert state(spark, "ATTR_INEXTERNALLIST", text("mg"), {"EXTERNAL_LIST_MNEMONIC": "units"}) == ERRORED
    complete = Item.of_concept(F.lit("t"), codings(coding(F.lit("MG"), F.lit("u"), F.lit("d"))))
    partial = Item.of_concept(F.lit("mg"), codings(coding(F.lit("mg"))))
    assert state(spark, "ATTR_INEXTERNALLIST", complete, units) == PASSED
    assert state(spark, "ATTR_INEXTERNALLIST", partial, units) == FAILED


def test_concept_shape_checks(spark):
    full = Item.of_concept(None, codings(coding(F.lit("c"), F.lit("s"), F.lit("d"))))
    bare = Item.of_concept(F.lit("only text"), None)
    assert state(spark, "ATTR_ISCODED", bare) == PASSED
    for m in ("CONCEPT_HASCODE", "CONCEPT_HASCODESYSTEM", "CONCEPT_HASDISPLAY", "CONCEPT_ISCOMPLETE"):
        assert state(spark, m, full) == PASSED
        assert state(spark, m, bare) == FAILED


def test_observation_checks(spark):
    def obs(value, kind, coded=None):
        return Item.of_observation(F.lit(value), F.lit(kind), coded)

    assert state(spark, "OBSERVATIONVALUE_MATCHESTYPE", obs("1.5", "NM")) == PASSED
    assert state(spark, "OBSERVATIONVALUE_MATCHESTYPE", obs("x", "NM")) == FAILED
    assert state(spark, "OBSERVATIONVALUE_MATCHESTYPE", obs("1^2", "NR")) == PASSED
    assert state(spark, "OBSERVATIONVALUE_MATCHESTYPE", obs("1^", "NR")) == FAILED
    assert state(spark, "OBSERVATIONVALUE_MATCHESTYPE", obs("x", "CE")) == FAILED
    assert state(spark, "OBSERVATIONVALUE_MATCHESTYPE", obs("x", "CE", codings(coding(F.lit("c"))))) == PASSED
    assert state(spark, "OBSERVATIONVALUE_ISQUALITATIVE", obs("x", "nothing")) == PASSED
    assert state(spark, "OBSERVATIONVALUE_ISQUALITATIVE", obs("1", "NM")) == FAILED
    assert state(spark, "OBSERVATIONVALUETYPE_INLIST", obs("1", "NM"), {"VALUE_TYPE_CSV": "nm"}) == PASSED


def test_unknown_function_always_fails(spark):
    from rubrica.plans.checks import CheckDef

    lib = CheckLibrary({"GHOST": CheckDef("GHOST", "Ghost")})
    out = lib.get("GHOST").fn(text("x"), {}, CTX)
    assert spark.range(1).select(out.state().alias("s")).first().s == FAILED


def test_library_rows_overlay():
    rows = [{"Mnemonic": "ATTR_ISDATE", "Name": "Is a date", "FailName": "bad date", "PrerequisiteMnemonic": "ATTR_ISNUMERIC", "Parameters": None}]
    lib = CheckLibrary().with_rows(rows)
    assert [d.mnemonic for d in lib.chain("ATTR_ISPASTDATE")] == ["ATTR_ISPOPULATED", "ATTR_ISNUMERIC", "ATTR_ISDATE", "ATTR_ISPASTDATE"]
    assert lib.get("ATTR_ISDATE").fail_name == "bad date"


def test_first_code_system_wins():
    cs = CodeSystems([CodeSystem("A", "shared"), CodeSystem("B", "shared", "urn:b", ("1.2",))])
    assert cs.canonical("shared") == "A" and cs.canonical("1.2") == "B" and cs.canonical("zz") is None


def test_terminology_needs_a_table_to_be_valid(spark):
    assert Terminology().concepts is None
