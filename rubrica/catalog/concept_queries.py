"""Checks on coded concepts, with terminology taken from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.catalog.registry import by_key, criterion, load, register, states, tally
from rubrica.functions.values import Item, coding, codings
from rubrica.plans.context import EvalContext
from rubrica.sources.reference import CodeSystem, CodeSystems, Terminology

# The tables as code systems: a customer key is a code, the customer's name its display.
SYSTEMS = CodeSystems(
    [
        CodeSystem("CUSTOMERS", "Customer keys", "urn:shop:customer", ("customer-id",)),
        CodeSystem("PARTS", "Part keys", "urn:shop:part"),
        CodeSystem("NATIONS", "Nation keys", "urn:shop:nation", ("nation-id",)),
    ]
)


def terminology(spark, sf) -> Terminology:
    """Customers, parts and nations as concepts.  A customer in debt is inactive by
    property; a part has a status text; a nation has neither."""
    c = load(spark, sf, "customer").select(
        F.lit("urn:shop:customer").alias("system"),
        F.col("c_custkey").cast("string").alias("code"),
        (F.col("c_acctbal") < 0).alias("inactive"),
        F.lit(None).cast("string").alias("status"),
        F.array("c_name", "c_mktsegment").alias("displays"),
    )
    p = load(spark, sf, "part").select(
        F.lit("PARTS").alias("system"),
        F.col("p_partkey").cast("string").alias("code"),
        F.lit(None).cast("boolean").alias("inactive"),
        F.when(F.col("p_type") == "PROMO", "Retired").otherwise("Active").alias("status"),
        F.array("p_name").alias("displays"),
    )
    n = load(spark, sf, "nation").select(
        F.lit("nation-id").alias("system"),
        F.col("n_nationkey").cast("string").alias("code"),
        F.lit(None).cast("boolean").alias("inactive"),
        F.lit(None).cast("string").alias("status"),
        F.array("n_name").alias("displays"),
    )
    members = load(spark, sf, "customer").filter("c_nationkey < 10").select(
        F.lit("LOW_NATIONS").alias("value_set"),
        F.lit("customer-id").alias("system"),
        F.col("c_custkey").cast("string").alias("code"),
    )
    return Terminology(c.unionByName(p).unionByName(n), members)


def context(spark, sf, compat: bool = True) -> EvalContext:
    return EvalContext(code_systems=SYSTEMS, terminology=terminology(spark, sf), compat=compat)


# An order's customer as a concept.  By priority: complete coding with a name close to the
# real one; URI in the second system property; unknown system; text only; no system, and
# every second time no code either.
ORDER_CODINGS = """
CASE o_orderpriority
 WHEN '1-URGENT' THEN 'urn:shop:customer' WHEN '2-HIGH' THEN 'http://elsewhere' WHEN '3-MEDIUM' THEN 'urn:unknown' END"""


# Some orders name a customer that does not exist.
ORDER_CODE = "CASE WHEN o_orderkey % 5 = 0 THEN -o_custkey ELSE o_custkey END"


def order_concept() -> Item:
    code = F.expr(ORDER_CODE).cast("string")
    system = F.expr(ORDER_CODINGS)
    second = F.when(F.col("o_orderpriority") == "2-HIGH", "customer-id")
    display = F.expr(
        "CASE WHEN o_orderstatus = 'O' THEN 'customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') "
        "WHEN o_orderstatus = 'F' THEN 'someone else' END"
    )
    blank = F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderkey") % 2 == 0), "").otherwise(code)
    item = coding(blank, system, display, second)
    text = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("Customer "), code))
    coded = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", codings(item))
    return Item.of_concept(text, coded, present=F.lit(True))


# The same facts in SQL: has code/system, canonical hit, active, similar, value set.
BASE = """
SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s,
  (p = '4-NOT SPECIFIED' AND s <> 'P') AS empty,
  p IN ('1-URGENT', '2-HIGH', '3-MEDIUM') OR (p = '5-LOW' AND o_orderkey % 2 = 1) AS has_code,
  p IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS has_system,
  p IN ('1-URGENT', '2-HIGH') AS known,
  p IN ('1-URGENT', '2-HIGH') AND c.c_custkey IS NOT NULL AS valid,
  c.c_acctbal >= 0 AS active,
  CASE s WHEN 'O' THEN 'CUSTOMER#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') WHEN 'F' THEN 'SOMEONE ELSE'
         ELSE 'CUSTOMER ' || CAST(o_custkey AS VARCHAR) END AS shown,
  upper(c.c_name) AS real_name, upper(c.c_mktsegment) AS segment, n.c_nationkey < 10 AS low_nation
FROM orders LEFT JOIN customer c ON CASE WHEN o_orderkey % 5 = 0 THEN -o_custkey ELSE o_custkey END = c.c_custkey
LEFT JOIN customer n ON o_custkey = n.c_custkey"""

POP = ("empty", "ATTR_ISPOPULATED")
CODE = ("NOT has_code", "CONCEPT_HASCODE")
SYSTEM = ("NOT has_system", "CONCEPT_HASCODESYSTEM")
VALID = ("NOT valid", "CONCEPT_ISVALID")
TEXTS = {
    "ATTR_ISPOPULATED": "unpopulated",
    "CONCEPT_HASCODE": "no code",
    "CONCEPT_HASCODESYSTEM": "no code system",
    "CONCEPT_HASDISPLAY": "no display",
    "CONCEPT_ISCOMPLETE": "incomplete concept",
    "CONCEPT_HASRECOGNIZEDCODESYSTEM": "unrecognized code system",
    "CONCEPT_ISVALID": "invalid concept",
    "CONCEPT_ISACTIVE": "inactive concept",
    "CONCEPT_ISCONSISTENT": "inconsistent concept",
    "CONCEPT_ISVALIDMEMBER": "not a valid member",
    "CONCEPT_ISINVALUESET": "not in value set",
}


def _sql(steps) -> str:
    fail = " ".join(f"WHEN {c} THEN '{k}'" for c, k in steps)
    reason = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TEXTS.items())
    return (
        "SELECT o_orderkey, CASE WHEN fail_check IS NULL THEN 'Passed' ELSE 'Failed' END AS state, fail_check, "
        f"CASE fail_check {reason} ELSE '' END AS reason FROM (SELECT o_orderkey, CASE {fail} END AS fail_check FROM ({BASE}))"
    )


def _concept(name: str, check: str, steps, params=None):
    @register(name, _sql(steps))
    def query(spark, sf):
        rows = states(
            load(spark, sf, "orders"), "ORDER", ["o_orderkey"], {"ORD_CUSTOMER": order_concept()},
            [criterion("ORD_CUSTOMER", check, params=params)], context(spark, sf),
        )
        return by_key(rows, "o_orderkey")

    return query


def _similar(a: str, b: str) -> str:
    return f"100 - CAST(trunc(levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) * 100.0) AS INT)"


_BEST = f"greatest({_similar('real_name', 'shown')}, {_similar('segment', 'shown')})"

_concept("chk_concept_has_code", "CONCEPT_HASCODE", [POP, CODE])
_concept("chk_concept_has_system", "CONCEPT_HASCODESYSTEM", [POP, CODE, SYSTEM])
_concept("chk_concept_has_display", "CONCEPT_HASDISPLAY", [POP, ("p = '4-NOT SPECIFIED'", "CONCEPT_HASDISPLAY")])
_concept("chk_concept_complete", "CONCEPT_ISCOMPLETE", [POP, ("NOT has_system", "CONCEPT_ISCOMPLETE")])
_concept("chk_concept_recognized", "CONCEPT_HASRECOGNIZEDCODESYSTEM", [POP, CODE, SYSTEM, ("NOT known", "CONCEPT_HASRECOGNIZEDCODESYSTEM")])
_concept("chk_concept_valid", "CONCEPT_ISVALID", [POP, CODE, SYSTEM, VALID])
_concept("chk_concept_active", "CONCEPT_ISACTIVE", [POP, CODE, SYSTEM, VALID, ("NOT active", "CONCEPT_ISACTIVE")])
_concept("chk_concept_consistent", "CONCEPT_ISCONSISTENT", [POP, CODE, SYSTEM, VALID, (f"{_BEST} < 50", "CONCEPT_ISCONSISTENT")])
_concept("chk_concept_member", "CONCEPT_ISVALIDMEMBER", [POP, CODE, SYSTEM, VALID], {"CODE_SYSTEM_CSV": "PARTS,customer-id"})
_concept("chk_concept_value_set", "CONCEPT_ISINVALUESET", [POP, CODE, SYSTEM, VALID, ("NOT low_nation", "CONCEPT_ISINVALUESET")], {"value set mnemonic": "LOW_NATIONS"})


@register(
    "chk_concept_two_codings",
    """SELECT l_returnflag, l_linestatus, state, fail_check, count(*) AS n FROM (
    SELECT l_returnflag, l_linestatus, CASE WHEN f IS NULL THEN 'Passed' ELSE 'Failed' END AS state, f AS fail_check FROM (
      SELECT l_returnflag, l_linestatus, CASE WHEN p_partkey IS NULL AND c.c_custkey IS NULL THEN 'CONCEPT_ISVALID'
        WHEN NOT (coalesce(p_type <> 'PROMO', false) OR coalesce(c.c_acctbal >= 0, false)) THEN 'CONCEPT_ISACTIVE' END AS f
      FROM lineitem LEFT JOIN part ON CASE WHEN l_linenumber % 2 = 0 THEN -l_partkey ELSE l_partkey END = p_partkey
      LEFT JOIN customer c ON CASE WHEN l_linenumber % 3 = 0 THEN -l_suppkey ELSE l_suppkey END = c.c_custkey)) GROUP BY ALL""",
)
def chk_concept_two_codings(spark, sf):
    """A concept with two codings passes when either does."""
    item = Item.of_concept(
        None,
        codings(
            coding(F.expr("CASE WHEN l_linenumber % 2 = 0 THEN -l_partkey ELSE l_partkey END"), F.lit("urn:shop:part"), F.lit("part")),
            coding(F.expr("CASE WHEN l_linenumber % 3 = 0 THEN -l_suppkey ELSE l_suppkey END"), F.lit("CUSTOMERS"), F.lit("customer")),
        ),
    )
    rows = states(
        load(spark, sf, "lineitem"), "LINE", ["l_returnflag", "l_linestatus"], {"LIN_PART": item},
        [criterion("LIN_PART", "CONCEPT_ISACTIVE")], context(spark, sf),
    )
    return tally(rows, "l_returnflag", "l_linestatus")


@register(
    "chk_value_set_null_system",
    """SELECT o_orderkey, CASE WHEN c_nationkey < 10 AND o_orderstatus = 'F' THEN 'Passed' ELSE 'Failed' END AS state
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def chk_value_set_null_system(spark, sf):
    """Codes of an unrecognised system match value-set members of another unrecognised
    system (compatibility behaviour); the prerequisite chain is left out here."""
    from dataclasses import replace

    from rubrica.plans.checks import CheckLibrary

    lib = CheckLibrary()
    defs = {m: lib.get(m) for m in lib.mnemonics()}
    defs["CONCEPT_ISINVALUESET"] = replace(defs["CONCEPT_ISINVALUESET"], prerequisite=None)
    ctx = context(spark, sf)
    ctx.library = CheckLibrary(defs)
    ctx.terminology.value_sets = load(spark, sf, "customer").filter("c_nationkey < 10").select(
        F.lit("LOW_NATIONS").alias("value_set"), F.lit("urn:other").alias("system"), F.col("c_custkey").cast("string").alias("code")
    )
    system = F.when(F.col("o_orderstatus") == "F", "urn:nowhere").otherwise("urn:shop:customer")
    item = Item.of_concept(None, codings(coding(F.col("o_custkey"), system, F.lit("x"))))
    rule = criterion("ORD_CUSTOMER", "CONCEPT_ISINVALUESET", params={"value set mnemonic": "LOW_NATIONS"})
    rows = states(load(spark, sf, "orders"), "ORDER", ["o_orderkey"], {"ORD_CUSTOMER": item}, [rule], ctx)
    return rows.select("o_orderkey", "state")


@register(
    "terminology_unknown_codes",
    """SELECT 'CUSTOMERS' AS system, CAST(code AS VARCHAR) AS code, count(*) AS uses
    FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN -o_custkey ELSE o_custkey END AS code FROM orders)
    WHERE code NOT IN (SELECT c_custkey FROM customer) GROUP BY ALL""",
)
def terminology_unknown_codes(spark, sf):
    from rubrica.catalog.registry import compiled
    from rubrica.operators.terminology import unknown_codes

    df = load(spark, sf, "orders").select(
        codings(coding(F.expr(ORDER_CODE), F.lit("urn:shop:customer"), F.lit("x"))).alias("codings")
    )
    return unknown_codes(df, "codings", compiled([criterion("ORD_CUSTOMER", "CONCEPT_ISVALID")], context(spark, sf)))


@register(
    "chk_concept_overall",
    """SELECT state, fail_check, count(*) AS n FROM (
    SELECT CASE WHEN c_custkey IS NULL THEN 'Failed' ELSE 'Passed' END AS state, CASE WHEN c_custkey IS NULL THEN 'CONCEPT_ISVALID' END AS fail_check
    FROM orders LEFT JOIN customer ON CASE WHEN o_orderkey % 5 = 0 THEN -o_custkey ELSE o_custkey END = c_custkey) GROUP BY ALL""",
)
def chk_concept_overall(spark, sf):
    """The whole table as one message, without any key."""
    item = Item.of_concept(None, codings(coding(F.expr(ORDER_CODE), F.lit("urn:shop:customer"), F.lit("x"))))
    rows = states(load(spark, sf, "orders"), "ORDER", [], {"ORD_CUSTOMER": item}, [criterion("ORD_CUSTOMER", "CONCEPT_ISVALID")], context(spark, sf))
    return tally(rows)


def _second_system(name: str, compat: bool, unlisted: str):
    @register(
        name,
        f"""SELECT o_orderkey, CASE WHEN (o_orderpriority <> '5-LOW' AND NOT (o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED') AND n_nationkey IS NOT NULL) OR ({unlisted}) THEN 'Passed' ELSE 'Failed' END AS state
        FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 10""",
    )
    def query(spark, sf):
        """The member is under the second system of the coding; some codings have no system at all."""
        from dataclasses import replace

        from rubrica.plans.checks import CheckLibrary

        lib = CheckLibrary()
        defs = {m: lib.get(m) for m in lib.mnemonics()}
        defs["CONCEPT_ISINVALUESET"] = replace(defs["CONCEPT_ISINVALUESET"], prerequisite=None)
        ctx = context(spark, sf, compat)
        ctx.library = CheckLibrary(defs)
        nations = load(spark, sf, "nation").filter("n_nationkey < 10").select(
            F.lit("FIRST_NATIONS").alias("value_set"), F.lit("nation-id").alias("system"), F.col("n_nationkey").cast("string").alias("code")
        )
        unknown = load(spark, sf, "nation").select(
            F.lit("FIRST_NATIONS").alias("value_set"), F.lit("urn:nobody").alias("system"), F.lit("nobody").alias("code")
        )
        ctx.terminology.value_sets = nations.unionByName(unknown)
        rows = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        with_system = F.col("o_orderpriority") != "5-LOW"
        odd = F.col("o_orderstatus") == "P"
        code = F.when(odd & ~with_system, F.lit("nobody")).when(odd & (F.col("o_orderpriority") == "4-NOT SPECIFIED"), "nobody").otherwise(F.col("c_nationkey").cast("string"))
        item = coding(
            code,
            F.when(with_system, F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "urn:else").otherwise("urn:shop:customer")),
            F.lit("x"),
            F.when(with_system, "nation-id"),
        )
        rule = criterion("ORD_CUSTOMER", "CONCEPT_ISINVALUESET", params={"value set mnemonic": "FIRST_NATIONS"})
        out = states(rows, "ORDER", ["o_orderkey"], {"ORD_CUSTOMER": Item.of_concept(None, codings(item))}, [rule], ctx)
        return out.select("o_orderkey", "state")

    return query


_UNKNOWN_HIT = "o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED'"
_second_system("value_set_second_system", True, _UNKNOWN_HIT)
_second_system("value_set_second_system_strict", False, "false")


@register(
    "chk_concept_member_other",
    """SELECT o_orderkey, CASE WHEN valid AND o_orderkey % 2 = 1 THEN 'Passed' ELSE 'Failed' END AS state,
    CASE WHEN NOT valid THEN 'CONCEPT_ISVALID' WHEN o_orderkey % 2 = 0 THEN 'CONCEPT_ISVALIDMEMBER' END AS fail_check
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN p_partkey IS NOT NULL ELSE c_custkey IS NOT NULL END AS valid
          FROM orders LEFT JOIN part ON o_custkey = p_partkey LEFT JOIN customer ON o_custkey = c_custkey)""",
)
def chk_concept_member_other(spark, sf):
    """Valid codes of two systems, of which the list names one."""
    system = F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'PARTS' ELSE 'urn:shop:customer' END")
    item = Item.of_concept(None, codings(coding(F.col("o_custkey"), system, F.lit("x"))))
    rule = criterion("ORD_CUSTOMER", "CONCEPT_ISVALIDMEMBER", params={"CODE_SYSTEM_CSV": "NATIONS,customer-id"})
    rows = states(load(spark, sf, "orders"), "ORDER", ["o_orderkey"], {"ORD_CUSTOMER": item}, [rule], context(spark, sf))
    return rows.select("o_orderkey", "state", "fail_check")
