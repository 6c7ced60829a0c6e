"""Rubric compilation, chains, conditionals, errors, many probes, skew."""

import json
import os

import pytest
from pyspark.sql import functions as F

from rubrica.catalog.registry import MODEL, compiled, criterion, text_items
from rubrica.functions.values import Item, coding, codings
from rubrica.operators.evaluate import TableSource, table_results, table_scorecards
from rubrica.operators.rollup import drop_errored, first_errors, message_scores
from rubrica.plans.checks import CheckLibrary
from rubrica.plans.context import EvalContext
from rubrica.plans.rubric import Criterion, Rubric, compile_rubric, missing_checks
from rubrica.sources.reference import CodeSystem, CodeSystems, Terminology


def orders(spark, rows):
    return spark.createDataFrame(rows, "k int, status string, total string")


def results(spark, rows, rules, ctx=None):
    src = TableSource(orders(spark, rows), "ORDER", ["k"], text_items(ORD_STATUS="status", ORD_TOTAL="total"))
    return table_results(src, compiled(rules, ctx))


def test_bundled_rubrics_compile():
    for m, n in (("USCDI_V3", 47), ("USCDI_V2", 23), ("Basic_VA_Lab", 53)):
        assert len(Rubric.bundled(m).criteria) == n


def test_rubric_file_form():
    text = json.dumps({
        "name": "file name", "mnemonic": "R", "model": {"mnemonic": "SHOP_V1"},
        "criteria": [{
            "sequence": 1, "entity": "ORD_STATUS", "samMnemonic": "ATTR_INLIST", "scoringEffect": "Scoring", "scoringWeight": 2,
            "criticalityIndicator": True, "conditionalSam": "ATTR_ISPOPULATED",
            "samParameters": [{"samParameterMnemonic": "LIST_CSV", "parameterName": "List CSV", "parameterValue": "a|b"}],
        }],
    })
    r = Rubric.from_json(text, library_name="library name")
    c = r.criteria[0]
    assert (r.name, r.model_mnemonic) == ("library name", "SHOP_V1")
    assert (c.check, c.weight, c.critical, c.conditional) == ("ATTR_INLIST", 2, True, "ATTR_ISPOPULATED")
    assert c.params == (("LIST_CSV", "a|b", "List CSV"),)


def test_repeated_criterion_is_refused():
    rule = criterion("ORD_STATUS", "ATTR_ISPOPULATED")
    with pytest.raises(ValueError, match="repeated"):
        compiled([rule, rule])


def test_missing_check_is_refused():
    rubric = Rubric("R", (Criterion(1, "ORD_STATUS", "NOPE"),))
    assert missing_checks(rubric, CheckLibrary()) == ["NOPE"]
    with pytest.raises(ValueError, match="missing"):
        compile_rubric(rubric, MODEL, EvalContext())


def test_prerequisites_come_first():
    rubric = compiled([criterion("ORD_CUSTOMER", "CONCEPT_ISACTIVE"), criterion("ORD_DATE", "ATTR_ISPASTDATE", 2)])
    for c in rubric.criteria:
        order = [p.index for p in c.chain]
        assert order == sorted(order)
    assert not rubric.may_error


def test_parameters_go_to_the_own_check_only(spark):
    """A prerequisite with parameters gets none and errors."""
    from dataclasses import replace

    lib = CheckLibrary()
    defs = {m: lib.get(m) for m in lib.mnemonics()}
    defs["ATTR_MATCHESREGEX"] = replace(defs["ATTR_MATCHESREGEX"], prerequisite="ATTR_INLIST")
    rule = criterion("ORD_STATUS", "ATTR_MATCHESREGEX", params={"CUSTOM_REGULAR_EXPRESSION": "a"})
    row = results(spark, [(1, "a", "1")], [rule], EvalContext(library=CheckLibrary(defs))).first()
    assert (row.state, row.reason) == ("Errored", "ATTR_INLIST failed to process : Parameter list was not supplied")


def test_conditional_decides_before_the_check(spark):
    rule = criterion("ORD_TOTAL", "ATTR_ISINTEGER", conditional="ATTR_ISNUMERIC")
    got = {r.k: (r.state, r.skip_check, r.reason) for r in results(spark, [(1, "", "5"), (2, "", "1.5"), (3, "", "x"), (4, "", None)], [rule]).collect()}
    assert got[1] == ("Passed", None, "")
    assert got[2] == ("Failed", None, "not an integer")
    assert got[3] == ("Skipped", "ATTR_ISNUMERIC", "not numeric")
    assert got[4] == ("Skipped", "ATTR_ISNUMERIC", "not numeric")


def test_many_probes_use_several_words(spark):
    rules = [criterion("ORD_STATUS", "ATTR_INLIST", i, params={"LIST_CSV": f"s{i}"}) for i in range(1, 151)]
    rubric = compiled(rules)
    assert rubric.words == 3
    src = TableSource(orders(spark, [(1, "s1", ""), (2, "s150", ""), (3, None, "")]), "ORDER", ["k"], text_items(ORD_STATUS="status"))
    rows = table_results(src, rubric).filter("state = 'Passed'").collect()
    assert sorted((r.k, r.sequence) for r in rows) == [(1, 1), (2, 150)]
    failed = table_results(src, rubric).filter("k = 3").groupBy("fail_check").count().collect()
    assert [(r.fail_check, r["count"]) for r in failed] == [("ATTR_ISPOPULATED", 150)]
    scores = {r.k: r.numerator for r in message_scores(table_scorecards(src, rubric), ["k"]).collect()}
    assert scores == {1: 1, 2: 1, 3: 0}


def test_counters_in_the_row_equal_counted_results(spark):
    rules = [
        criterion("ORD_STATUS", "ATTR_ISPOPULATED", 1, weight=3, critical=True),
        criterion("ORD_TOTAL", "ATTR_ISINTEGER", 2, effect="Informational"),
        criterion("ORD_TOTAL", "ATTR_ISNUMERIC", 3, conditional="ATTR_ISPOPULATED", weight=0),
    ]
    rows = [(i % 7, None if i % 3 == 0 else "s", str(i) if i % 4 else "x") for i in range(200)]
    src = TableSource(orders(spark, rows), "ORDER", ["k"], text_items(ORD_STATUS="status", ORD_TOTAL="total"))
    rubric = compiled(rules)
    direct = {r.k: (r.scoring_pass, r.scoring_fail, r.scoring_skip, r.info_pass, r.critical_fail, r.weighted_pass) for r in message_scores(table_scorecards(src, rubric), ["k"]).collect()}
    res = table_results(src, rubric)
    s, p, f = F.col("is_scoring"), F.col("state") == "Passed", F.col("state") == "Failed"
    counted = res.groupBy("k").agg(
        F.count(F.when(s & p, 1)), F.count(F.when(s & f, 1)), F.count(F.when(s & (F.col("state") == "Skipped"), 1)),
        F.count(F.when(~s & p, 1)), F.count(F.when(s & f & F.col("is_critical"), 1)), F.coalesce(F.sum(F.when(s & p, F.col("weight"))), F.lit(0)),
    )
    assert {r[0]: tuple(r[1:]) for r in counted.collect()} == direct


def test_errors_are_isolated_and_first_one_is_kept(spark):
    from dataclasses import replace

    lib = CheckLibrary()
    defs = {m: lib.get(m) for m in lib.mnemonics()}
    defs["ATTR_ISPASTDATE"] = replace(defs["ATTR_ISPASTDATE"], prerequisite=None)
    defs["ATTR_ISPOSITIVENUMBER"] = replace(defs["ATTR_ISPOSITIVENUMBER"], prerequisite=None)
    ctx = EvalContext(as_of="2020-01-01 00:00:00", library=CheckLibrary(defs))
    rules = [criterion("ORD_TOTAL", "ATTR_ISPOSITIVENUMBER", 1), criterion("ORD_STATUS", "ATTR_ISPASTDATE", 2)]
    rows = results(spark, [(1, "x", "y"), (1, "2019-01-01", "1"), (2, "2019-01-01", "1")], rules, ctx)
    errors = {r.k: r.error_message for r in first_errors(rows, ["k"], MODEL).collect()}
    assert list(errors) == [1] and errors[1].startswith("ATTR_ISPASTDATE failed to process")  # 'status' sorts before 'total'
    assert {r.k for r in drop_errored(rows, compiled(rules, ctx), ["k"]).collect()} == {2}


def test_hot_code_resolves_like_any_other(spark):
    """A third of all rows share one code; some have none."""
    df = spark.range(9000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("code")
    )
    concepts = spark.createDataFrame([("S", "hot", False), ("S", "1", True), ("S", "4", None)], "system string, code string, inactive boolean")
    ctx = EvalContext(code_systems=CodeSystems([CodeSystem("S")]), terminology=Terminology(concepts))
    item = Item.of_concept(None, F.when(F.col("code").isNotNull(), codings(coding(F.col("code"), F.lit("S"), F.lit("d")))), present=F.lit(True))
    src = TableSource(df, "ORDER", ["id"], {"ORD_CUSTOMER": item})
    rows = table_results(src, compiled([criterion("ORD_CUSTOMER", "CONCEPT_ISACTIVE")], ctx))
    got = {(r.state, r.fail_check): r["count"] for r in rows.groupBy("state", "fail_check").count().collect()}
    assert got == {
        ("Passed", None): 3000, ("Failed", "ATTR_ISPOPULATED"): 3000,
        ("Failed", "CONCEPT_ISVALID"): 2998, ("Failed", "CONCEPT_ISACTIVE"): 2,
    }


def test_scorecards_of_a_table_need_no_shuffle_and_scores_one(spark):
    src = TableSource(orders(spark, [(1, "a", "1")]), "ORDER", ["k"], text_items(ORD_STATUS="status", ORD_TOTAL="total"))
    cards = table_scorecards(src, compiled([criterion("ORD_STATUS", "ATTR_ISPOPULATED"), criterion("ORD_TOTAL", "ATTR_ISINTEGER", 2)]))
    plan = cards._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    plan = message_scores(cards, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_lists_meet_answers_by_surrogate_keys(spark):
    from pyspark.sql import functions as F

    from rubrica.functions.joins import ListKeys

    lists = {0: ["a"], 1: [], 2: None, 3: [None], 4: ["a", None], 5: [None, "a"], 6: ["", "a"], 7: ["a"]}
    left = spark.createDataFrame([(k, v) for k, v in lists.items()], "id int, l array<string>")
    keys = ListKeys(left, {"l": F.col("l")})
    found = keys.dictionary()
    # Equal lists share a key, others do not; a null entry is not the lack of one.
    assert found.select("k1", "k2").distinct().count() == 4
    sizes = found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    got = {r.id: r.n for r in keys.join(sizes, "n", {"l": "n"}).collect()}
    assert got == {0: 1, 1: None, 2: None, 3: None, 4: 1, 5: 1, 6: 2, 7: 1}
    plan = keys.join(sizes, "n", {"l": "n"})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan


def test_no_list_of_codings_is_moved(spark, tmp_path):
    """Two concept columns, one join with the concepts, and only keys, systems and codes in exchanges."""
    from rubrica.catalog.concept_queries import SYSTEMS

    concepts = spark.createDataFrame([("urn:shop:part", str(i)) for i in range(9)], "system string, code string")
    concepts.write.parquet(str(tmp_path / "c"))
    spark.range(40).selectExpr("id AS k", "CAST(id % 11 AS STRING) AS a", "CAST(id % 7 AS STRING) AS b").write.parquet(str(tmp_path / "t"))
    ctx = EvalContext(code_systems=SYSTEMS, terminology=Terminology(spark.read.parquet(str(tmp_path / "c"))))
    rules = [criterion("PRT_CONCEPT", "CONCEPT_ISVALID"), criterion("PRT_CONCEPT", "CONCEPT_ISACTIVE", 2)]
    concept = lambda c: Item.of_concept(None, codings(coding(F.col(c), F.lit("PARTS"), F.lit("x"))))
    source = TableSource(spark.read.parquet(str(tmp_path / "t")), "PART", ["k"], {"PRT_CONCEPT": concept("a")})
    cards = table_scorecards(source, compiled(rules, ctx))
    plan = cards._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2
    physical = cards._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_codings" not in physical and "hashpartitioning(codings" not in physical
    wrong = sum(1 for i in range(40) if i % 11 >= 9)
    # Concepts without a status are not active.
    assert cards.agg(F.sum("scoring_fail")).first()[0] == 40 + wrong


def test_stored_frames_are_cleared(spark):
    from rubrica.functions.stored import clear_stored, stored_columns

    clear_stored(spark)
    frame = stored_columns(spark.range(3).selectExpr("id", "id * 2 AS twice"))
    path = frame.inputFiles()[0].removeprefix("file://")
    assert sorted(r.twice for r in frame.collect()) == [0, 2, 4] and os.path.exists(path)
    assert clear_stored(spark) == 1 and not os.path.exists(path) and clear_stored(spark) == 0


def test_an_audited_message_reads_its_input_once(spark):
    """Everything derived from stored items reads the stored rows, not the messages."""
    from rubrica.functions.stored import stored

    base = spark.range(10).selectExpr("id", "id % 2 AS k")
    plan = stored(base).groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "Scan ExistingRDD" in plan


def test_functions_over_lists_of_codings_are_few(spark):
    """Lists are made once, and Spark neither compiles nor folds functions over them."""
    from rubrica.catalog.concept_queries import SYSTEMS

    concepts = spark.createDataFrame([("PARTS", "1", False), ("PARTS", "2", True)], "system string, code string, inactive boolean")
    table = spark.createDataFrame([(1, None, "x"), (2, None, None), (3, None, "x"), (None, 1, ""), (None, None, "x"), (2, 1, "y")], "a int, b int, shown string")
    item = Item.of_concept(None, codings(coding(F.col("a"), F.lit("urn:shop:part"), F.col("shown")), coding(F.col("b"), F.lit(" "), F.lit("z"), F.lit("PARTS"))))
    ctx = EvalContext(code_systems=SYSTEMS, terminology=Terminology(concepts))
    rows = table_results(TableSource(table, "LINE", ["a", "b"], {"LIN_PART": item}), compiled([criterion("LIN_PART", "CONCEPT_ISACTIVE")], ctx))
    got = {(r.a, r.b): r.fail_check for r in rows.collect()}
    assert got == {(1, None): None, (2, None): "CONCEPT_ISACTIVE", (3, None): "CONCEPT_ISVALID", (None, 1): None, (None, None): "CONCEPT_HASCODE", (2, 1): None}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(") <= 24
