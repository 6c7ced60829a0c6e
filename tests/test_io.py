"""Sources, sinks and streams."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from rubrica.catalog.registry import MODEL, compiled, criterion
from rubrica.operators.runs import audit_records
from rubrica.sources import fixed, sinks
from rubrica.sources.lab import lab_messages, read_lab_sheet
from rubrica.sources.messages import MESSAGE_SCHEMA, read_requests
from rubrica.sources.model import EntityModel
from rubrica.sources.reference import CodeSystems, Terminology, ValueLists, read_by_mnemonic, read_checks
from rubrica.streaming.queue import count_batches, drain_queue, live_counters, message_stream, queue_stream, score_batch, score_stream

KEYS = ["message_id"]
RULES = [criterion("ORD_STATUS", "ATTR_INLIST", params={"LIST_CSV": "F,O"}), criterion("ORD_TOTAL", "ATTR_ISNUMERIC", 2)]


def payload(status, total):
    return json.dumps({"shop": {"orders": [{"status": status, "total": total}]}})


def messages(spark, n=20):
    rows = [("p", "s", str(i), "SHOP_V1", "R", payload("F" if i % 2 else "X", str(i))) for i in range(n)]
    rows.append(("p", "s", "broken", "SHOP_V1", "R", "{"))
    return spark.createDataFrame(rows, MESSAGE_SCHEMA)


def scores_of(df):
    return {r.message_id: (r.score, r.succeeded, r.error_message) for r in df.collect()}


def test_stream_equals_batch(spark, tmp_path):
    rubric = compiled(RULES)
    df = messages(spark)
    df.repartition(3).write.json(str(tmp_path / "in"))
    stream = message_stream(spark, str(tmp_path / "in"), maxFilesPerTrigger=1)
    out, counts = str(tmp_path / "out"), str(tmp_path / "counts")
    q = score_stream(stream, rubric, KEYS, out, str(tmp_path / "cp"), count_batches(counts)).trigger(availableNow=True).start()
    q.awaitTermination()
    want = scores_of(score_batch(df, rubric, KEYS))
    assert scores_of(spark.read.parquet(out)) == want
    assert want["broken"] == (None, False, fixed.ERR_PAYLOAD) and want["1"][0] == 100 and want["2"][0] == 50
    live = live_counters(spark, counts).first()
    assert (live.total_records, live.total_completed, live.total_failed) == (21, 20, 1)


def test_queue_is_drained_with_status(spark, tmp_path):
    rubric = compiled(RULES)
    items = messages(spark, 5).withColumn("n", F.monotonically_increasing_id())
    sinks.enqueue(items.drop("n"), 7, str(tmp_path / "queue"), F.hash("message_id"))
    q = drain_queue(queue_stream(spark, str(tmp_path / "queue"), 7), rubric, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.trigger(availableNow=True).start().awaitTermination()
    rows = sinks.read_together(spark, str(tmp_path / "out"), "status").collect()
    assert sorted((r.status, r.retry_count) for r in rows) == [("DONE", 0)] * 5 + [("PENDING", 1)]
    assert [r.error_message for r in rows if r.status == "PENDING"] == [fixed.ERR_PAYLOAD]
    assert sinks.read_together(spark, str(tmp_path / "out"), "scores").count() == 6


def test_batches_without_rows_go_through(spark, tmp_path):
    """Items of another run alone make a batch that holds nothing for this one; so does an empty file of messages."""
    rubric, seen = compiled(RULES), []
    queue, out = str(tmp_path / "queue"), str(tmp_path / "out")
    for run, n in ((8, 3), (7, 2), (8, 1)):
        sinks.enqueue(messages(spark, n), run, queue, F.hash("message_id"))
        drain_queue(queue_stream(spark, queue, 7), rubric, out, str(tmp_path / "cp"), 3, queue).trigger(availableNow=True).start().awaitTermination()
    status = sinks.read_together(spark, out, "status")
    assert {r.run_id for r in status.collect()} == {7} and status.filter("status = 'DONE'").count() == 2
    messages(spark, 2).limit(0).write.json(str(tmp_path / "in"))
    (tmp_path / "in" / "none.json").write_text("")
    after = lambda scores, batch_id: seen.append(scores.count())
    score_stream(message_stream(spark, str(tmp_path / "in")), rubric, KEYS, str(tmp_path / "o"), str(tmp_path / "c"), after).trigger(availableNow=True).start().awaitTermination()
    assert seen in ([], [0])


def test_a_queue_is_read_by_the_partitions_of_its_run(spark, tmp_path):
    queue = str(tmp_path / "queue")
    for run in (1, 2):
        sinks.enqueue(messages(spark, 3), run, queue, F.hash("message_id"))
    retry = spark.read.parquet(queue).filter("run_id = 1").withColumn("retry_count", F.lit(1))
    for _ in range(2):
        # A repeated batch replaces its own retries, and touches no other partition.
        sinks.requeue(retry, queue, 5)
    assert spark.read.parquet(queue).groupBy("run_id", "batch_id").count().count() == 3
    plan = sinks.pending(spark.read.parquet(queue), 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan
    assert len(sinks.pending(spark.read.parquet(queue), 1).inputFiles()) > 0
    assert sinks.pending(spark.read.parquet(queue), 1).count() == 8


def test_results_refer_to_runs(spark, tmp_path):
    runs_table = spark.createDataFrame([(1,), (2,)], "id long")
    good = spark.createDataFrame([(1, 1, "m"), (2, 2, "n")], "run_id long, row_num int, message_id string")
    sinks.write_results(good, str(tmp_path / "r"), runs=runs_table)
    stray = spark.createDataFrame([(1, 3, "o"), (9, 4, "p")], "run_id long, row_num int, message_id string")
    with pytest.raises(Exception, match="run_id 9 refers to no row"):
        sinks.write_results(stray, str(tmp_path / "r"), runs=runs_table)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2


def test_runs_are_failed_by_their_job_alone(spark, tmp_path):
    from rubrica.operators import runs

    path = str(tmp_path / "runs")
    opened = runs.start_runs(spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "run_id string, created_at string"))
    work = spark.createDataFrame([("a", False, 1), ("a", False, 2), ("b", True, 3)], "run_id string, ok boolean, t int")
    at = F.max(F.timestamp_seconds("t"))
    runs.guarded_run(opened, path, lambda: work, at)

    def aborted():
        raise RuntimeError("cut off")

    last = runs.start_runs(spark.createDataFrame([("c", "2024-01-03")], "run_id string, created_at string"))
    with pytest.raises(RuntimeError, match="cut off"):
        runs.guarded_run(last, path, aborted, at)
    got = {r.run_id: (r.status, r.total_records, r.total_failed, r.completed_at is not None) for r in runs.current_runs(spark.read.parquet(path)).collect()}
    assert got == {"a": ("COMPLETED", 2, 2, True), "b": ("COMPLETED", 1, 0, True), "c": ("FAILED", None, None, True)}


def test_values_meet_ranges_by_bins(spark):
    import random

    from rubrica.operators.content import merged_ranges, value_in_range_set

    rng = random.Random(3)
    ranges = [("S", "s", k, "u", rng.choice([None, *[float(rng.randrange(50))] * 8]), rng.choice([None, *[float(rng.randrange(50))] * 8])) for k in "abc" for _ in range(12)]
    ranges = [r for r in ranges if r[2] != "a" or (r[4] is not None and r[5] is not None)] + [("S", "s", "d", "u", 5.0, 5.0), ("S", "s", "e", "u", None, None), ("S", "s", "f", "u", 9.0, 1.0)]
    # One key with an outlier: nearly all ranges in one bin.
    ranges += [("S", "s", "g", "u", i / 10, i / 10 + 0.02) for i in range(60)] + [("S", "s", "g", "u", 1e12, 1e12 + 1)]
    table = spark.createDataFrame(ranges, "content_set string, system string, code string, unit string, min_value double, max_value double")
    values = [("s", k, "u", x) for k in "abcdefgh" for x in [None, -1.0, 0.0, 0.01, 0.05, 4.999, 5.0, 5.5, 1e12 + 0.5, 1e300, *map(float, range(0, 52, 3))]]
    rows = spark.createDataFrame(values, "system string, code string, unit string, value double")
    got = {(r.code, r.value): r.ok for r in value_in_range_set(rows, table, "S", "system", "code", "unit", "value", "ok").collect()}
    want = {
        (k, x): x is not None and any(c == k and (lo is None or x >= lo) and (hi is None or x <= hi) for _, _, c, _, lo, hi in ranges) for _, k, _, x in values
    }
    assert got == want and value_in_range_set(rows, table, "S", "system", "code", "unit", "value", "ok").count() == len(values)
    merged = merged_ranges(table, ["code"], "min_value", "max_value").collect()
    for k in "abg":
        own = sorted((r.lo, r.hi) for r in merged if r.code == k)
        assert all(a[1] < b[0] for a, b in zip(own, own[1:]))


def test_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_batch(spark.range(5), path, 1)
    sinks.write_batch(spark.range(3), path, 2)
    sinks.write_batch(spark.range(4), path, 1)
    assert spark.read.parquet(path).count() == 7


def test_redelivered_messages_are_dropped(spark, tmp_path):
    from rubrica.streaming.queue import drop_redelivered

    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00"), ("b", "2024-01-01 00:06:00")]
    spark.createDataFrame(rows, "message_id string, t string").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("message_id string, t timestamp").parquet(str(tmp_path / "in"))
    q = drop_redelivered(stream, ["message_id"], "t").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.message_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def audit(spark):
    df = spark.createDataFrame([(1, 'say "hi", you\nthere', True), (2, None, False)], "n int, body string, ok boolean")
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    later = F.to_timestamp(F.lit("2024-01-01 00:00:01.5"))
    return audit_records(df, "run", F.col("n"), at, later, F.col("n").cast("string"), F.col("ok"), request_body=F.col("body"))


def test_audit_files(spark, tmp_path):
    sinks.write_audit_json(audit(spark).coalesce(1), str(tmp_path / "j"))
    lines = [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()]
    assert [list(x) for x in lines] == [list(fixed.AUDIT_COLUMNS)] * 2
    assert lines[0]["durationMs"] == 1500 and lines[0]["requestTimestamp"] == "2024-01-01T00:00:00.000Z"
    sinks.write_audit_csv(audit(spark).coalesce(1), str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("*.csv")).open(newline="")
    rows = list(csv.DictReader(text))
    assert rows[0]["requestBody"] == 'say "hi", you\nthere' and rows[1]["requestBody"] == ""


def test_results_need_run_and_row(spark, tmp_path):
    ok = spark.createDataFrame([(1, 1, "m")], "run_id long, row_num int, message_id string")
    sinks.write_results(ok, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r"))
    assert set(back.columns) == {c.split()[0] for c in sinks.RESULT_SCHEMA.split(", ")}
    bad = spark.createDataFrame([(1, None, "m")], "run_id long, row_num int, message_id string")
    with pytest.raises(Exception, match="row_num is required"):
        sinks.write_results(bad, str(tmp_path / "r"))


def test_run_table_takes_missing_columns(spark, tmp_path):
    run = spark.createDataFrame([(1, "first", "COMPLETED")], "id long, run_name string, status string")
    sinks.write_run(run, str(tmp_path / "runs"))
    row = spark.read.parquet(str(tmp_path / "runs")).first()
    assert row.run_name == "first" and row.total_records is None


def test_lab_sheet(spark, tmp_path):
    cells = {"UniqueID": "u1", "LabChemTestName": " Glucose ", "LabChemResultValue": "5.1", "LOINC": "2345-7", "Units": "mg", "RefLow": "1"}
    lines = [",".join(fixed.LAB_COLUMNS), ",".join(cells.get(c, "") for c in fixed.LAB_COLUMNS), "," * 21, ",".join({"UniqueID": "u2"}.get(c, "") for c in fixed.LAB_COLUMNS)]
    (tmp_path / "lab.csv").write_text("\n".join(lines))
    rows = read_lab_sheet(spark, str(tmp_path / "lab.csv"))
    assert rows.count() == 2
    got = {r.message_id: json.loads(r.payload)["patient"]["labResults"][0] for r in lab_messages(rows, "p", "s").collect()}
    assert got["u1"]["test"] == {"codings": [{"code": "2345-7", "display": "Glucose", "system": "2.16.840.1.113883.6.1"}], "text": "Glucose"}
    assert got["u1"]["referenceRange"] == {"lowValue": "1"} and got["u1"]["interpretation"]["text"] == "N"
    assert got["u2"]["test"] == {"codings": [], "text": ""} and got["u2"]["resultUnit"] == {"codings": [], "text": ""}


def test_requests_file(spark, tmp_path):
    request = {
        "dataProviderID": "p", "dataSourceID": "s", "previousMessageID": "old", "messageID": "m", "oldModelMnemonic": "OLD_V1",
        "senderModelMnemonic": "M_V1", "newModelMnemonic": "NEW_V1", "evaluationRubricMnemonic": "R", "messageData": "{}",
    }
    (tmp_path / "r.json").write_text(json.dumps(request) + "\n")
    row = read_requests(spark, str(tmp_path / "r.json"), model_property="SenderModelMnemonic").first()
    assert (row.provider_id, row.message_id, row.model_mnemonic, row.rubric_mnemonic, row.payload) == ("p", "m", "M_V1", "R", "{}")
    assert read_requests(spark, str(tmp_path / "r.json")).first().model_mnemonic is None


def test_request_keys_do_not_depend_on_the_split(spark, tmp_path):
    from rubrica.sources.messages import read_requests as read

    for name, n in (("b", 50), ("a", 400), ("c", 7)):
        (tmp_path / f"{name}.json").write_text("".join(json.dumps({"messageID": f"{name}{i}", "messageData": "x" * (i % 50)}) + "\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for size in ("128m", "2000", "7001"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found.append({r.message_id: r.request_key for r in read(spark, str(tmp_path)).collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] == found[2] and len(set(found[0].values())) == 457
    assert found[0]["a7"].endswith("a.json#8")


def test_start_row_counts_over_files_in_order(spark, tmp_path):
    line = lambda i: ",".join([str(i), *["x" * (i % 9)] * 21])
    head = ",".join(fixed.LAB_COLUMNS)
    for name, rows in (("a.csv", range(1, 6)), ("b.csv", range(6, 400)), ("c.csv", range(400, 403))):
        (tmp_path / name).write_text("\n".join([head, *map(line, rows)]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "3000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for start in (1, 4, 9, 401, 500):
                got = sorted(int(r.UniqueID) for r in read_lab_sheet(spark, str(tmp_path), start_row=start).select("UniqueID").collect())
                assert got == list(range(start, 403))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_reference_files(spark, tmp_path):
    def put(name, doc):
        (tmp_path / name).write_text(json.dumps(doc, indent=1))
        return str(tmp_path / name)

    systems = CodeSystems.read(spark, put("cs.json", {"CodeSystemLibrary": [{"Name": "N", "Mnemonic": "M", "FhirUri": "u", "CodeSystemIdentifiers": ["1.2"]}]}))
    assert systems.canonical("1.2") == "M"
    lists = ValueLists.read(spark, put("v.json", {"lib": [{"Mnemonic": "L", "CodeList": [{"DataCode": "a", "DataText": "b"}]}]}))
    assert lists.has("L") and not lists.has("nothing")
    sets = Terminology.value_sets_from_library(spark, put("vs.json", {"lib": [{"Mnemonic": "VS", "CodingList": [{"system": "s", "code": "c"}]}]}))
    assert [tuple(r) for r in sets.collect()] == [("VS", "s", "c")]
    checks = read_checks(spark, put("c.json", {"lib": [{"Mnemonic": "X", "Name": "x", "Parameters": [{"Name": "p", "Mnemonic": "P", "IsOptional": True}]}]}))
    assert checks[0]["Mnemonic"] == "X" and checks[0]["Parameters"][0]["IsOptional"]
    index = put("i.json", {"lib": [{"mnemonic": "A", "path": "a.json", "modelMnemonic": "B"}, {"Mnemonic": "B", "path": "b.json"}]})
    assert read_by_mnemonic(spark, index, "B")["path"] == "b.json"
    assert read_by_mnemonic(spark, index, "C") is None


def test_long_value_list_becomes_a_join(spark):
    table = spark.range(50).select(F.lit("BIG").alias("mnemonic"), F.col("id").cast("string").alias("code"), F.lit(None).cast("string").alias("text"))
    lists = ValueLists.from_table(table)
    assert lists.has("BIG") and not lists.is_literal("BIG")


def test_model_file():
    doc = {
        "mnemonic": "X_V1", "rootEntityName": "root", "rootEntityMnemonic": "ROOT",
        "dataClasses": [{"cardinality": {"cardinalityValue": "ONE"}, "children": [
            {"mnemonic": "C", "fieldName": "c", "name": "Cee", "entityType": {"entityTypeValue": "CLS"}},
            {"mnemonic": "C_E", "entityType": {"entityTypeValue": "ELM"}},
            {"mnemonic": "C_A", "fieldName": "a", "entityType": {"entityTypeValue": "CC"}},
        ]}],
    }
    m = EntityModel.from_json(json.dumps(doc))
    assert m.classes[0].cardinality == "ONE" and m.classes[0].attributes[0].kind == "CC"
    assert (m.class_of("C_A"), m.level_of("C_E"), m.level_of("ROOT")) == ("C", "element", "root")


def test_model_rows_and_paths(spark):
    from rubrica.operators.flatten import flatten
    from rubrica.sources.messages import check_messages
    from rubrica.sources.model import path_key

    assert MODEL.entities(spark).count() == len(MODEL.rows())
    msg = spark.createDataFrame([("p", "s", "m", "SHOP_V1", "R", payload("F", "1"))], MESSAGE_SCHEMA)
    items = flatten(check_messages(msg, MODEL, "SHOP_V1"), MODEL, KEYS, {"ORD_STATUS"})
    paths = {r.p for r in items.select(path_key("ROOT").alias("p")).collect()}
    assert {"ROOT", "ROOT|ORDER", "ROOT|ORDER|ORDER_ELM.1", "ROOT|ORDER|ORDER_ELM.1|ORD_STATUS"} <= paths


def test_ranges_of_one_key_are_merged_in_many_tasks(spark):
    import random
    from collections import Counter

    from rubrica.operators.content import merged_ranges

    rng = random.Random(5)
    ends = [float("-inf"), -1e300, -7.5, -1e-9, 0.0, 1e-9, 2.0, 1e12, float("inf")]
    some = [(rng.choice(ends), rng.choice(ends)) for _ in range(12)] + [(x, x + rng.random() ** 6 * 90) for x in (rng.uniform(-400, 900) for _ in range(300))]
    own = [(1, lo, hi) for lo, hi in some[12:]] + [(None, *r) for r in some] + [(2, 10.0 * i, 10.0 * i + 1) for i in range(4000)]
    table = spark.createDataFrame(own, "code int, lo0 double, hi0 double")
    got = merged_ranges(table, ["code"], "lo0", "hi0").collect()
    for k in (1, 2, None):
        want = []
        for lo, hi in sorted((lo, hi) for c, lo, hi in own if c == k and lo <= hi):
            if want and lo <= want[-1][1]:
                want[-1][1] = max(want[-1][1], hi)
            else:
                want.append([lo, hi])
        assert sorted([r.lo, r.hi] for r in got if r.code == k) == want
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        parts = Counter(r[0] for r in merged_ranges(table.filter("code = 2"), ["code"], "lo0", "hi0").select(F.spark_partition_id()).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert sum(parts.values()) == 4000 and max(parts.values()) < 1000


def test_results_of_one_run_meet_it_in_many_tasks(spark):
    from collections import Counter

    from rubrica.operators import runs

    from rubrica.operators import runs

    results = spark.range(4000).select(F.when(F.col("id") % 100 > 0, "a").when(F.col("id") % 200 > 0, "b").alias("run_id"), "id")
    table = spark.createDataFrame([("a", "first"), ("a", "again"), (None, "none"), ("c", "third")], "run_id string, run_name string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = runs.with_run(results, table).select("*", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert Counter((r.run_id, r.run_name) for r in rows) == {("a", "first"): 3960, ("a", "again"): 3960}
    assert len({(r.id, r.run_name) for r in rows}) == 7920 and max(Counter(r.task for r in rows).values()) < 2000


def test_a_queue_from_one_file_is_read_by_many_tasks(spark, tmp_path):
    from collections import Counter

    path, n = str(tmp_path / "queue"), 60_000
    messages = spark.range(0, n, 1, 1).select(F.col("id").cast("string").alias("message_id"), F.lit("x" * 50).alias("payload"))
    sinks.enqueue(messages, 1, path, F.col("message_id"))
    sinks.requeue(spark.read.schema(f"{sinks.QUEUE_SCHEMA}, batch_id bigint").parquet(path).coalesce(1), path, 4)
    files = Counter(tuple(r) for r in spark.read.parquet(path).select("batch_id", F.input_file_name()).collect())
    assert sum(files.values()) == 2 * n and max(files.values()) <= 25_000
    assert Counter(b for b, _ in files) == {-1: 3, 4: 3}
