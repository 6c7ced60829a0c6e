"""Message path: golden scores, parsing corner cases, two-stage criteria, audit."""

import json

import pytest
from pyspark.sql import functions as F

from rubrica.catalog.registry import criterion
from rubrica.functions.values import parse_values
from rubrica.operators.audit import AUDIT_VALUES, audited_messages, extract_assessments
from rubrica.operators.evaluate import COUNTERS, evaluate_messages, message_results, message_scorecards, table_results, table_scorecards
from rubrica.operators.flatten import flatten
from rubrica.operators.rollup import class_scores, message_scores
from rubrica.plans.context import EvalContext
from rubrica.plans.rubric import Rubric, compile_rubric
from rubrica.sources.messages import MESSAGE_SCHEMA, check_messages
from rubrica.sources.model import Attribute, DataClass, EntityModel, clinical_model
from rubrica.sources.reference import CodeSystems, Terminology, ValueLists

KEYS = ["message_id"]
RACE = "urn:oid:2.16.840.1.113883.6.238"


def concept(system, code, display, text=True):
    out = {"codings": [{"system": system, "code": code, "display": display}]}
    return out | ({"text": display} if text else {})


def patient(sex, **classes):
    demo = {
        "birthSex": concept("http://hl7.org/fhir/administrative-gender", sex, sex),
        "birthDate": "2009-01-01",
        "ethnicity": concept(RACE, "2135-2", "Hispanic or Latino"),
        "race": concept(RACE, "1002-5", "American Indian or Alaska Native"),
    }
    return json.dumps({"patient": {"demographics": demo, **classes}})


def visit(when):
    return [{"encounterDateTime": when, "encounterType": "Psychiatric interview", "status": "finished"}]


def assessment(when=None):
    out = {"assessment": concept("http://loinc.org", "73831-0", "Depression screening"), "resultValue": {"type": {"text": "ST"}, "text": "true"}}
    return [out | ({"effectiveDate": when} if when else {})]


GOLDEN = {
    "first": (patient("male", encounters=visit("2026-01-02T08:00:00.000+00:00"), healthAssessments=assessment()), 54, 6, 11),
    "second": (patient("unknown", encounters=visit("2026-08-12T08:00:00.000+00:00")), 44, 4, 9),
    "third": (
        patient(
            "male",
            encounters=visit("2026-06-21T08:00:00.000+00:00"),
            healthAssessments=assessment("2026-06-21T08:00:00.000+00:00"),
            procedures=[{"procedure": concept("http://snomed.info/sct", "108313002", "Family psychotherapy", False), "procedureDateTime": "2026-06-21T08:00:00.000+00:00"}],
        ),
        42, 6, 14,
    ),
    "fourth": (patient("male", encounters=visit("2026-06-21T08:00:00.000+00:00"), healthAssessments=assessment("2026-06-15T08:00:00.000+00:00")), 45, 5, 11),
}


@pytest.fixture(scope="module")
def clinical(spark):
    concepts = spark.createDataFrame(
        [(RACE, "2135-2"), (RACE, "1002-5"), ("http://loinc.org", "73831-0"), ("http://snomed.info/sct", "108313002")],
        "system string, code string",
    )
    ctx = EvalContext(
        as_of="2026-04-01T00:00:00Z",
        code_systems=CodeSystems.bundled(),
        value_lists=ValueLists({"UCUM": [("mg", "milligram")], "AbFlag": [("H", "High")]}),
        terminology=Terminology(concepts),
    )
    return compile_rubric(Rubric.bundled("USCDI_V3"), clinical_model(), ctx)


def requests(spark, payloads, model="PAT_CLINICAL_V1"):
    rows = [("clinic", "ward", k, model, "R", p) for k, p in payloads.items()]
    return spark.createDataFrame(rows, MESSAGE_SCHEMA)


@pytest.fixture(scope="module")
def scored(spark, clinical):
    checked = check_messages(requests(spark, {k: v[0] for k, v in GOLDEN.items()}), clinical.model, clinical.rubric.model_mnemonic)
    return checked, evaluate_messages(checked, clinical, KEYS)


def test_golden_message_scores(scored, clinical):
    out = message_scores(message_scorecards(scored[1], clinical, KEYS), KEYS).collect()
    assert {r.message_id: (r.score, r.numerator, r.denominator) for r in out} == {k: v[1:] for k, v in GOLDEN.items()}
    assert all(r.weighted_score == r.score and r.succeeded for r in out)


def test_golden_class_scores(scored, clinical):
    rows = class_scores(message_scorecards(scored[1], clinical, KEYS), KEYS, clinical.model).collect()
    assert len(rows) == 4 * 15
    got = {(r.message_id, r.class_name): (r.numerator, r.denominator, r.score) for r in rows if r.instance_count}
    assert got[("first", "Demographics")] == (3, 4, 75)
    assert got[("first", "Encounters")] == (2, 5, 40)
    assert got[("first", "Health Assessments")] == (1, 2, 50)
    assert got[("third", "Procedures")] == (1, 3, 33)
    assert got[("second", "Encounters")] == (1, 5, 20)


def test_golden_reasons(scored, clinical):
    rows = message_results(scored[1], clinical, KEYS).filter("message_id = 'third'").collect()
    reasons = {r.entity: r.reason for r in rows}
    assert reasons["DEM_SEX"] == "invalid concept"
    assert reasons["ENC_DIAGNOSIS"] == "unpopulated"
    assert reasons["PRC_PRCDT"] == "Procedure date is invalid"
    assert reasons["PRC_RSN"] == "Procedure reason not populated"


def test_invariants(scored, clinical):
    cards = message_scorecards(scored[1], clinical, KEYS)
    total = message_scores(cards, KEYS).collect()
    for r in total:
        assert r.scoring_total == r.scoring_pass + r.scoring_fail + r.scoring_skip
        assert r.scoring_processed == r.scoring_pass + r.scoring_fail
        assert 0 <= r.score <= 100
    sums = {}
    for c in class_scores(cards, KEYS).collect():
        for n in COUNTERS:
            sums[(c.message_id, n)] = sums.get((c.message_id, n), 0) + c[n]
    for r in total:
        assert all(sums[(r.message_id, n)] == r[n] for n in COUNTERS)


def test_partitioning_does_not_matter(spark, scored, clinical):
    checked = scored[0].repartition(5)
    out = message_scores(message_scorecards(evaluate_messages(checked, clinical, KEYS), clinical, KEYS), KEYS)
    assert {r.message_id: r.score for r in out.collect()} == {k: v[1] for k, v in GOLDEN.items()}


def test_audited_message(spark, clinical, scored):
    checked, _ = scored
    ev = evaluate_messages(checked, clinical, KEYS, all_attributes=True, keep=AUDIT_VALUES)
    scores = message_scores(message_scorecards(ev, clinical, KEYS), KEYS)
    audited = audited_messages(checked, ev, scores, clinical, KEYS)
    doc = json.loads(audited.filter("message_id = 'first'").first().audited_message)
    assert list(doc) == ["EntityModelMnemonic", "DataProviderID", "DataSourceID", "MessageID", "Audit", "patient"]
    assert doc["Audit"]["messageScore"] == "54"
    assert len(doc["patient"]) == 15 and doc["patient"]["goals"] == []
    demo = doc["patient"]["demographics"][0]
    assert list(demo) == ["birthDate", "birthSex", "deathDate", "deceased", "ethnicity", "genderIdentity", "maritalStatus", "patientIdentifier", "primaryLanguage", "race", "elementAudit"]
    assert demo["deathDate"] == {}
    assert demo["birthSex"]["attributeAudit"]["assessmentItems"][0]["reason"] == "invalid concept"
    assert demo["elementAudit"]["elementScore"] == "75"
    visit_ = doc["patient"]["encounters"][0]
    assert visit_["encounterType"]["data"] == {"text": "Psychiatric interview"}
    assert visit_["encounterDiagnosis"]["attributeAudit"]["scoringData"]["attributeDenominator"] == "1"
    assert doc["patient"]["healthAssessments"][0]["resultValue"]["data"] == {"text": "true", "type": {"text": "ST"}}

    responses = audited.select("message_id", F.to_json(F.struct(F.col("audited_message").alias("auditedMessage"))).alias("response"))
    rows = extract_assessments(responses, KEYS).filter("message_id = 'first'").collect()
    assert len(rows) == 11 and {r.data_class for r in rows} == {"Demographics", "Encounters", "Health Assessments"}


# --- parsing corner cases ------------------------------------------------

MODEL = EntityModel(
    "M_V1", "root",
    (
        DataClass("SOLO", "solo", (Attribute("S_A", "a"), Attribute("S_C", "c", "CC")), "ONE"),
        DataClass("MANYS", "manys", (Attribute("M_A", "a"), Attribute("M_V", "v", "OBSVAL"), Attribute("M_R", "r", "RV"))),
    ),
)


def items_of(spark, payload):
    checked = check_messages(requests(spark, {"m": payload}, "M_V1"), MODEL, "M_V1")
    return flatten(checked, MODEL, KEYS)


def attrs(spark, payload):
    rows = parse_values(items_of(spark, payload)).filter("level = 'attribute'").collect()
    return {(r.entity, r.element_seq): r for r in rows}


def test_names_match_as_documented(spark):
    got = attrs(spark, '{"ROOT":{"solo":{"A":"first","a":"second"},"Manys":[{"a":1}]}}')
    assert got[("S_A", 1)].v_text == "first"
    assert not any(e == "M_A" for e, _ in got), "class properties match exactly"


def test_singleton_and_array_rules(spark):
    got = items_of(spark, '{"root":{"solo":5,"manys":{"a":1}}}').filter("level = 'element'").collect()
    assert [(r.class_mnemonic, r.element_seq) for r in got] == [("SOLO", 1)]
    got = attrs(spark, '{"root":{"manys":[{"a":1},"text",{"a":null}]}}')
    assert [got[("M_A", i)].present for i in (1, 2, 3)] == [True, False, True]
    assert got[("M_A", 1)].v_text == "1" and got[("M_A", 3)].v_text == ""


def test_polymorphic_values(spark):
    got = attrs(
        spark,
        json.dumps({"root": {
            "solo": {"c": "bare"},
            "manys": [
                {"a": {"x": 1}, "v": {"text": "7", "type": {"text": "NM"}}, "r": {"text": "t", "LowValue": "1", "highValue": "2"}},
                {"v": "plain", "r": "range"},
                {"v": {"codings": [{"code": "c", "system-id": "s"}], "text": "t", "type": {"text": "??"}}},
            ],
        }}),
    )
    assert got[("S_C", 1)].v_text == "bare" and not got[("S_C", 1)].v_codings
    assert got[("M_A", 1)].v_text == '{"x":1}'
    assert (got[("M_V", 1)].v_type_code, got[("M_V", 1)].v_number) == ("NM", 7.0)
    assert (got[("M_R", 1)].v_low, got[("M_R", 1)].v_high) == ("1", "2")
    assert got[("M_V", 2)].v_type_code == "ST"
    c = got[("M_V", 3)].v_codings[0]
    assert (c.systems, c.system, c.code, c.display) == (["s"], "s", "c", "t")


@pytest.mark.parametrize(
    "payload,error",
    [("{", "Payload is not a JSON object."), ('{"other":{}}', "Root token not found"), ('{"root":{}}', None), ('{"Root":null}', "Root token not found")],
)
def test_message_errors(spark, payload, error):
    row = check_messages(requests(spark, {"m": payload}, "M_V9"), MODEL, "M_V1").first()
    assert row.error_message == error


def test_empty_message_still_has_classes(spark):
    rubric = compile_rubric(Rubric("R", (criterion("S_A", "ATTR_ISPOPULATED"),), "r", "M_V1"), MODEL, EvalContext())
    checked = check_messages(requests(spark, {"m": '{"root":{}}'}, "M_V1"), MODEL, "M_V1")
    cards = message_scorecards(evaluate_messages(checked, rubric, KEYS), rubric, KEYS)
    assert message_scores(cards, KEYS).first().denominator == 0
    assert class_scores(cards, KEYS, MODEL).count() == 2


def test_class_and_root_criteria_reach_their_items(spark):
    from rubrica.plans.checks import CheckDef, CheckLibrary, Outcome

    lib = CheckLibrary()
    defs = {m: lib.get(m) for m in lib.mnemonics()}
    defs["SEEN"] = CheckDef("SEEN", "Seen", fn=lambda item, p, ctx: Outcome(item.present), can_error=False)
    from rubrica.plans.rubric import Criterion

    rules = tuple(Criterion(i, e, "SEEN") for i, e in enumerate(("ROOT", "SOLO", "SOLO_ELM", "MANYS"), 1))
    rubric = compile_rubric(Rubric("R", rules, "r", "M_V1"), MODEL, EvalContext(library=CheckLibrary(defs)))
    checked = check_messages(requests(spark, {"m": '{"root":{"solo":{}}}'}, "M_V1"), MODEL, "M_V1")
    rows = message_results(evaluate_messages(checked, rubric, KEYS), rubric, KEYS).collect()
    assert sorted((r.entity, r.level) for r in rows) == [("MANYS", "class"), ("ROOT", "root"), ("SOLO", "class"), ("SOLO_ELM", "element")]


def test_element_is_clean_second_stage(spark):
    rules = (
        criterion("M_A", "ATTR_ISPOPULATED", 1),
        criterion("M_V", "ATTR_ISPOPULATED", 2, effect="Informational"),
        criterion("MANYS_ELM", "ELEMENT_ISCLEAN", 3),
    )
    rubric = compile_rubric(Rubric("R", rules, "r", "M_V1"), MODEL, EvalContext())
    checked = check_messages(requests(spark, {"m": '{"root":{"manys":[{"a":"x","v":"y"},{"a":"x"},{"v":"y"}]}}'}, "M_V1"), MODEL, "M_V1")
    ev = evaluate_messages(checked, rubric, KEYS)
    rows = message_results(ev, rubric, KEYS).filter("entity = 'MANYS_ELM'").collect()
    assert sorted((r.element_seq, r.state) for r in rows) == [(1, "Passed"), (2, "Failed"), (3, "Failed")]
    assert message_scores(message_scorecards(ev, rubric, KEYS), KEYS).first().numerator == 3


# --- messages as rows -----------------------------------------------------


def cards_of(frame, extra=()):
    held = ["message_id", "class_mnemonic", "element_seq", *COUNTERS, "is_element", "errors", *extra]
    return {(r.message_id, r.class_mnemonic, r.element_seq): tuple(r) for r in frame.select(*held).collect() if any(r[n] for n in COUNTERS) or r.is_element}


def test_rows_and_items_score_alike(spark, clinical, scored):
    from rubrica.operators.message_rows import message_source

    checked, items = scored
    source = message_source(checked, clinical, KEYS)
    cards = table_scorecards(source, clinical)
    assert cards_of(cards) == cards_of(message_scorecards(items, clinical, KEYS))
    out = message_scores(cards, KEYS).collect()
    assert {r.message_id: (r.score, r.numerator, r.denominator) for r in out} == {k: v[1:] for k, v in GOLDEN.items()}
    columns = ["message_id", "class_mnemonic", "element_seq", "entity", "criterion_id", "state", "fail_check", "skip_check", "reason"]
    key = lambda frame: sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
    assert key(table_results(source, clinical)) == key(message_results(items, clinical, KEYS))


ODD = {
    "typed": '{"root":{"solo":{"a":"1","C":{"codings":[{"code":"x"}],"text":"t"}},"manys":[{"b":"1"},{"B":"2"}]}}',
    "root spelled otherwise": '{"ROOT":{"solo":{"a":"1"},"manys":[{"b":"1"}]}}',
    "one is no object": '{"root":{"solo":[1,2],"manys":{"b":"1"}}}',
    "elements are no objects": '{"root":{"manys":[1,{"b":"x"},null,"y",[2]]}}',
    "nulls": '{"root":{"solo":{"a":null,"C":null},"manys":null}}',
    "first wins": '{"root":{"solo":{"A":"1","a":"2"}}}',
    "empty": '{"root":{}}',
    "no root": '{"other":1}',
    "no object": "[1]",
    "cut off": '{"root":{"solo":{"a":"1"',
    "two roots": '{"Root":{"solo":{"a":"2"}},"root":{"solo":{"a":"1"}}}',
}


def odd_rubric(library=None):
    model = EntityModel(
        "M_V1", "root",
        (
            DataClass("SOLO", "solo", (Attribute("S_A", "a"), Attribute("S_C", "c", "CC"), Attribute("S_V", "v", "OBSVAL"), Attribute("S_R", "r", "RV")), "ONE", element="SOLO_ELM"),
            DataClass("MANYS", "manys", (Attribute("M_B", "b"),), element="MANY_ELM"),
        ),
    )
    rules = [
        criterion("S_A", "ATTR_ISPOPULATED", 1), criterion("S_A", "ATTR_INLIST", 2, params={"LIST_CSV": "1"}, critical=True), criterion("S_C", "CONCEPT_HASCODE", 3, weight=3),
        criterion("S_V", "OBSERVATIONVALUE_MATCHESTYPE", 4), criterion("S_R", "RANGEVALUE_ISCOMPLETE", 5, effect="Informational"),
        criterion("M_B", "ATTR_ISINTEGER", 6, conditional="ATTR_ISPOPULATED"), criterion("MANY_ELM", "ELEMENT_ISCLEAN", 7),
    ]
    return model, compile_rubric(Rubric("R", tuple(rules), "r", "M_V1"), model, EvalContext())


def test_typed_and_loose_payloads_mean_the_same(spark):
    """Payloads that the typed schema does not fit are read property by property, and both ways alike."""
    from rubrica.operators.message_rows import message_cards

    model, rubric = odd_rubric()
    checked = check_messages(requests(spark, ODD, "M_V1"), model, "M_V1")
    errors = {r.message_id: r.error_message for r in checked.filter("error_message IS NOT NULL").collect()}
    assert set(errors) == {"no root", "no object", "cut off"}
    fits = {r.message_id for r in checked.filter("_is_typed").collect()}
    assert "typed" in fits and "one is no object" not in fits and "root spelled otherwise" not in fits
    by_rows = cards_of(message_cards(checked, rubric, KEYS))
    assert by_rows == cards_of(message_scorecards(evaluate_messages(checked, rubric, KEYS), rubric, KEYS))
    # Without the typed schema all are read the loose way.
    loose = checked.drop("_typed", "_is_typed").withColumn("_m", F.from_json("payload", "map<string,string>"))
    keys = F.transform(F.map_keys("_m"), lambda k: F.lower(k))
    raw = F.get(F.map_values("_m"), (F.array_position(keys, F.lit("root")) - 1).cast("int"))
    assert by_rows == cards_of(message_cards(loose.withColumn("root_raw", raw).drop("_m"), rubric, KEYS))
    assert len([k for k in by_rows if k[0] == "elements are no objects" and k[1] == "MANYS"]) == 5


def test_a_message_is_parsed_once_and_summed_in_one_exchange(spark, tmp_path):
    from rubrica.operators.message_rows import message_cards

    model, rubric = odd_rubric()
    requests(spark, ODD, "M_V1").write.parquet(str(tmp_path / "m"))
    checked = check_messages(spark.read.parquet(str(tmp_path / "m")), model, "M_V1")
    scores = message_scores(message_cards(checked, rubric, KEYS), KEYS)
    physical = scores._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1 and physical.count("Scan parquet") == 1
    optimized = scores._jdf.queryExecution().optimizedPlan().toString()
    # Classes and elements are exploded, attributes are not.
    assert optimized.count("Generate ") == 2
    typed = [x for x in optimized.split("from_json(") if x.startswith("StructField(EntityModel") or x.startswith("StructField(")]
    assert len(typed) >= 1 and optimized.count("StructField(_unreadable") <= 1
