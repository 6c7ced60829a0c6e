"""Sources, sinks and streams over the given tables: written to the shared folder, read back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from rubrica.catalog.concept_queries import SYSTEMS
from rubrica.catalog.message_queries import CARD_RULES, CARDS, card_messages
from rubrica.catalog.registry import compiled, criterion, load, register, text_items
from rubrica.catalog.shared import shared_folder
from rubrica.functions.values import Item, coding, codings
from rubrica.operators import runs
from rubrica.operators.evaluate import TableSource, table_results
from rubrica.operators.rollup import first_errors
from rubrica.plans.context import EvalContext
from rubrica.plans.rubric import compile_rubric, load_rubric
from rubrica.sources import fixed, sinks
from rubrica.sources.lab import read_lab_sheet
from rubrica.sources.messages import read_requests
from rubrica.sources.model import load_model
from rubrica.sources.reference import Terminology, ValueLists, read_data_types
from rubrica.streaming import queue


@register(
    "requests_read",
    """SELECT CAST(doc_id AS VARCHAR) AS message_id, source AS source_id, 'M_V1' AS model_mnemonic, 'R' AS rubric_mnemonic, md5('{"t":' || doc_id || '}') AS payload FROM documents""",
)
def requests_read(spark, sf):
    """Request files with decoys: properties that only end like a request's, before and after the right ones."""
    path = shared_folder(spark, "requests")
    request = F.struct(
        F.lit("old").alias("previousMessageID"), F.lit("OLD_V1").alias("oldModelMnemonic"),
        F.col("doc_id").cast("string").alias("messageID"), F.lit("p").alias("DATAPROVIDERID"), F.col("source").alias("dataSourceId"),
        F.lit("M_V1").alias("senderModelMnemonic"), F.lit("NEW_V1").alias("newModelMnemonic"), F.lit("R").alias("evaluationRubricMnemonic"),
        F.concat(F.lit('{"t":'), F.col("doc_id").cast("string"), F.lit("}")).alias("messageData"),
    )
    load(spark, sf, "documents").select(F.to_json(request).alias("value")).write.text(path)
    rows = read_requests(spark, path, model_property="SenderModelMnemonic")
    return rows.select("message_id", "source_id", "model_mnemonic", "rubric_mnemonic", F.md5(F.col("payload").cast("binary")).alias("payload"))


@register(
    "lab_sheet",
    """SELECT CAST(event_id AS VARCHAR) AS "UniqueID", event_type AS "LabChemTestName", '' AS "Units" FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS r FROM events) WHERE r >= 2001 AND event_type <> 'error'""",
)
def lab_sheet(spark, sf):
    """A sheet of several unequal files read from a row of its second file on; rows without any cell are dropped."""
    path = shared_folder(spark, "lab_sheet")
    filled = F.col("event_type") != "error"
    given = {"UniqueID": F.when(filled, F.col("event_id").cast("string")), "LabChemTestName": F.when(filled, F.col("event_type"))}
    cells = [F.coalesce(given.get(c, F.lit(None)), F.lit("")).alias(c) for c in fixed.LAB_COLUMNS]
    # Ranges of events, so that the files' names are in the order of their rows.
    ranges = load(spark, sf, "events").repartitionByRange(7, "event_id").sortWithinPartitions("event_id")
    ranges.select(*cells).write.csv(path, header=True)
    return read_lab_sheet(spark, path, start_row=2001).select("UniqueID", "LabChemTestName", "Units")


@register(
    "value_list_library",
    "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'Passed' ELSE 'Failed' END AS state FROM customer",
)
def value_list_library(spark, sf):
    """A library file of value lists, written from the nations."""
    path = shared_folder(spark, "lists")
    entries = F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("DataCode"), F.col("n_name").alias("DataText")))
    nations = load(spark, sf, "nation").agg(entries.alias("CodeList"))
    library = F.to_json(F.struct(F.array(F.struct(F.lit("NATIONS").alias("Mnemonic"), F.col("CodeList"))).alias("Lists")))
    nations.select(library.alias("value")).write.text(path)
    ctx = EvalContext(value_lists=ValueLists.read(spark, path))
    rule = criterion("CUS_NUMBER", "ATTR_INEXTERNALLIST", params={"EXTERNAL_LIST_MNEMONIC": "NATIONS"})
    shown = "CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey AS STRING) ELSE 'none' END"
    source = TableSource(load(spark, sf, "customer"), "CUSTOMER", ["c_custkey"], text_items(CUS_NUMBER=shown))
    return table_results(source, compiled([rule], ctx)).select("c_custkey", "state")


@register(
    "library_entries",
    """SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN 'Passed' ELSE 'Failed' END AS listed,
    CASE WHEN c_nationkey < 10 THEN 'Passed' ELSE 'Failed' END AS in_set FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def library_entries(spark, sf):
    """A value list as JSON lines and a value set as Parquet, one row an entry, written from the customers."""
    lists, sets = shared_folder(spark, "list_entries"), shared_folder(spark, "set_entries")
    customer, key = load(spark, sf, "customer"), F.col("c_custkey").cast("string")
    entry = F.struct(F.lit("SOLVENT").alias("mnemonic"), key.alias("DataCode"), F.col("c_name").alias("DATATEXT"))
    customer.filter("c_acctbal > 0").select(F.to_json(entry).alias("value")).write.text(lists)
    customer.filter("c_nationkey < 10").select(F.lit("LOW").alias("Mnemonic"), F.lit("customer-id").alias("System"), key.alias("Code")).write.parquet(sets)
    known = customer.select(F.lit("CUSTOMERS").alias("system"), key.alias("code"))
    ctx = EvalContext(
        code_systems=SYSTEMS, value_lists=ValueLists.read(spark, lists, "json"),
        terminology=Terminology(known, Terminology.value_sets_from_library(spark, sets, "parquet")),
    )
    rules = [
        criterion("ORD_STATUS", "ATTR_INEXTERNALLIST", 1, params={"EXTERNAL_LIST_MNEMONIC": "SOLVENT"}),
        criterion("ORD_CUSTOMER", "CONCEPT_ISINVALUESET", 2, params={"value set mnemonic": "LOW"}),
    ]
    items = text_items(ORD_STATUS="CAST(o_custkey AS STRING)")
    items["ORD_CUSTOMER"] = Item.of_concept(None, codings(coding(F.col("o_custkey"), F.lit("CUSTOMERS"), F.lit("x"))))
    rows = table_results(TableSource(load(spark, sf, "orders"), "ORDER", ["o_orderkey"], items), compiled(rules, ctx))
    state = lambda entity: F.max(F.when(F.col("entity") == entity, F.col("state")))
    return rows.groupBy("o_orderkey").agg(state("ORD_STATUS").alias("listed"), state("ORD_CUSTOMER").alias("in_set"))


@register(
    "library_by_mnemonic",
    "SELECT c_custkey, 'Segment rules' AS rubric_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Passed' ELSE 'Failed' END AS state FROM customer",
)
def library_by_mnemonic(spark, sf):
    """Model and rubric found by mnemonic: index, file, and the index's name."""
    folder = shared_folder(spark, "library")
    entity = lambda m, f, k: {"mnemonic": m, "fieldName": f, "name": f, "entityType": {"entityTypeValue": k}}
    model = {
        "mnemonic": "CUS_V1", "rootEntityName": "shop", "rootEntityMnemonic": "ROOT",
        "dataClasses": [{"cardinality": {"cardinalityValue": "MANY"}, "children": [
            entity("CUSTOMER", "customers", "CLS"), entity("CUSTOMER_ELM", "customer", "ELM"), entity("CUS_SEGMENT", "segment", "ATR")]}],
    }
    rubric = {
        "mnemonic": "SEG", "name": "by the file", "model": {"mnemonic": "CUS_V1"},
        "criteria": [{"sequence": 1, "entity": "CUS_SEGMENT", "samMnemonic": "ATTR_INLIST", "scoringEffect": "Scoring", "scoringWeight": 1,
                      "processingUrl": "urn:x", "samParameters": [{"samParameterMnemonic": "LIST_CSV", "parameterName": "List CSV", "parameterValue": "BUILDING"}]}],
    }
    files = {"model": model, "rubric": rubric}
    index = {"Library": [{"mnemonic": "CUS_V1", "modelMnemonic": "SEG", "filePath": "model"}, {"mnemonic": "SEG", "name": "Segment rules", "filePath": "rubric"}]}
    for name, doc in {**files, "index": index}.items():
        spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    found = load_rubric(spark, f"{folder}/index", "SEG")
    built = compile_rubric(found, load_model(spark, f"{folder}/index", "CUS_V1"), EvalContext())
    source = TableSource(load(spark, sf, "customer"), "CUSTOMER", ["c_custkey"], text_items(CUS_SEGMENT="c_mktsegment"))
    return table_results(source, built).select("c_custkey", F.lit(found.name).alias("rubric_name"), "state")


def _audit(spark, sf):
    at = F.col("ts").cast("timestamp")
    return runs.audit_records(
        load(spark, sf, "events"), "run", F.col("event_id"), at, at + F.expr("INTERVAL 1 SECOND"),
        F.concat(F.lit('m "'), F.col("event_id").cast("string"), F.lit('", x')), F.col("value") <= 150,
    )


_AUDIT_SQL = """SELECT CAST(event_id AS VARCHAR) AS row_number, 'm "' || event_id || '", x' AS message_id, CASE WHEN value <= 150 THEN 'true' ELSE 'false' END AS ok, '1000' AS duration FROM events"""


def _audit_back(df):
    return df.select(*[F.col(c).cast("string").alias(n) for c, n in (("rowNumber", "row_number"), ("messageId", "message_id"), ("wasSuccess", "ok"), ("durationMs", "duration"))])


@register("audit_csv_file", _AUDIT_SQL)
def audit_csv_file(spark, sf):
    path = shared_folder(spark, "audit_csv")
    sinks.write_audit_csv(_audit(spark, sf), path)
    return _audit_back(spark.read.csv(path, header=True, quote='"', escape='"'))


@register("audit_json_file", _AUDIT_SQL)
def audit_json_file(spark, sf):
    path = shared_folder(spark, "audit_json")
    sinks.write_audit_json(_audit(spark, sf), path)
    schema = ", ".join(f"{c} string" for c in fixed.AUDIT_COLUMNS)
    return _audit_back(spark.read.schema(schema).json(path))


@register(
    "result_tables",
    "SELECT o_custkey AS run_id, count(*) AS results, max(CAST(o_orderkey AS INT)) AS last_row, 'COMPLETED' AS status FROM orders GROUP BY o_custkey",
)
def result_tables(spark, sf):
    """Run and result tables, written and joined again."""
    results, run_table = shared_folder(spark, "results"), shared_folder(spark, "runs")
    orders = load(spark, sf, "orders")
    rows = orders.select(
        F.pmod("o_custkey", F.lit(8)).cast("bigint").alias("run_id"), F.col("o_orderkey").cast("int").alias("row_num"),
        F.col("o_custkey").cast("string").alias("message_id"), F.col("o_orderstatus").alias("status"),
    )
    opened = runs.start_runs(rows.select(F.col("run_id").alias("id")).distinct())
    sinks.write_run(opened.withColumn("status", F.lit(runs.RUN_COMPLETED)), run_table)
    known = spark.read.parquet(run_table)
    sinks.write_results(rows, results, runs=known)
    # Rows of a run that is not there are refused as a whole.
    stray = rows.withColumn("run_id", F.when(F.col("row_num") % 100 == 0, F.lit(99)).otherwise(F.col("run_id")))
    refused = False
    try:
        sinks.write_results(stray, results, runs=known)
    except Exception as broke:
        refused = "run_id 99 refers to no row" in str(broke)
    if not refused:
        raise ValueError("A stray run id was written.")
    joined = spark.read.parquet(results).join(spark.read.parquet(run_table).select(F.col("id").alias("run_id"), F.col("status").alias("run_status")), "run_id")
    return joined.groupBy(F.col("message_id").cast("bigint").alias("run_id")).agg(
        F.count(F.lit(1)).alias("results"), F.max("row_num").alias("last_row"), F.first("run_status").alias("status")
    )


_CARD_SCORES = "SELECT CAST(c_custkey AS VARCHAR) AS message_id, true AS succeeded, CASE WHEN c_acctbal > 0 THEN 100 ELSE 0 END AS score FROM customer"
_MESSAGE = ["provider_id", "source_id", "message_id", "model_mnemonic", "rubric_mnemonic", "payload"]


def _card_rubric():
    return compiled(CARD_RULES, EvalContext(as_of="2020-01-01T00:00:00"), CARDS)


def _cards(spark, sf):
    return card_messages(spark, sf).withColumn("rubric_mnemonic", F.lit("CATALOG")).select(*_MESSAGE)


def _done(query):
    query.trigger(availableNow=True).start().awaitTermination()


@register("stream_messages", _CARD_SCORES)
def stream_messages(spark, sf):
    """Messages dropped as files, scored as a stream."""
    given, out, checkpoint = (shared_folder(spark, f"stream/{n}") for n in ("in", "out", "checkpoint"))
    _cards(spark, sf).write.json(given)
    _done(queue.score_stream(queue.message_stream(spark, given), _card_rubric(), ["message_id"], out, checkpoint))
    return spark.read.parquet(out).select("message_id", "succeeded", "score")


@register(
    "stream_counters",
    """SELECT CAST(count(*) AS BIGINT) AS total_records, CAST(count(*) FILTER (c_custkey % 3 <> 0) AS BIGINT) AS total_completed, CAST(count(*) FILTER (c_custkey % 3 = 0) AS BIGINT) AS total_failed FROM customer""",
)
def stream_counters(spark, sf):
    """Live counters of a stream in which every third message has no provider."""
    given, out, counts, checkpoint = (shared_folder(spark, f"counters/{n}") for n in ("in", "out", "counts", "checkpoint"))
    odd = F.pmod(F.col("message_id").cast("bigint"), F.lit(3)) == 0
    _cards(spark, sf).withColumn("provider_id", F.when(~odd, F.col("provider_id"))).write.json(given)
    _done(queue.score_stream(queue.message_stream(spark, given), _card_rubric(), ["message_id"], out, checkpoint, queue.count_batches(counts)))
    return queue.live_counters(spark, counts)


@register(
    "queue_retries",
    """SELECT status, retry_count, count(*) AS n FROM (
    SELECT 'DONE' AS status, 0 AS retry_count FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT CASE k WHEN 3 THEN 'FAILED' ELSE 'PENDING' END, k FROM customer, (VALUES (1), (2), (3)) v(k) WHERE c_custkey % 3 = 0) GROUP BY ALL""",
)
def queue_retries(spark, sf):
    """Queue items are taken, retried while they fail, and given up after three attempts."""
    items, out, checkpoint = (shared_folder(spark, f"queue/{n}") for n in ("items", "out", "checkpoint"))
    odd = F.pmod(F.col("message_id").cast("bigint"), F.lit(3)) == 0
    messages = _cards(spark, sf).withColumn("provider_id", F.when(~odd, F.col("provider_id")))
    sinks.enqueue(messages, 1, items, F.col("message_id"))
    for k in range(3):
        # Items of another run come in between: batches of theirs hold nothing for this one.
        sinks.enqueue(messages.limit(1), 2, items, F.col("message_id"))
        _done(queue.drain_queue(queue.queue_stream(spark, items, 1), _card_rubric(), out, checkpoint, 3, items))
    status = sinks.read_together(spark, out, queue.STATUS)
    return status.groupBy("status", "retry_count").agg(F.count(F.lit(1)).alias("n"))


@register(
    "two_outputs",
    """SELECT 'after the failure' AS moment, 'none' AS kind, CAST(0 AS BIGINT) AS n UNION ALL
    SELECT 'after the retry', 'scores', count(*) FROM customer UNION ALL SELECT 'after the retry', 'status', count(*) FROM customer""",
)
def two_outputs(spark, sf):
    """A batch fails after its scores and within its status rows: neither is there, after the retry both are."""
    items, out, checkpoint = (shared_folder(spark, f"outputs/{n}") for n in ("items", "out", "checkpoint"))
    sinks.enqueue(_cards(spark, sf), 1, items, F.col("message_id"))

    def broken(scores, status, batch_id):
        late = F.when(F.col("id") > 0, F.raise_error(F.lit("disk full"))).otherwise(F.col("status"))
        return scores, status.withColumn("status", late)

    def drain(alter):
        _done(queue.drain_queue(queue.queue_stream(spark, items, 1), _card_rubric(), out, checkpoint, before_write=alter))

    try:
        drain(broken)
    except Exception as broke:
        if "disk full" not in str(broke):
            raise
    count = lambda df, moment: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(moment).alias("moment"), "kind", "n")
    schema = "kind string, batch_id bigint"
    there = spark.read.schema(schema).option("recursiveFileLookup", False).parquet(_made(spark, out))
    found = count(there, "after the failure").collect()
    none = [("after the failure", "none", 0)] if not found else [tuple(r) for r in found]
    before = spark.createDataFrame(none, "moment string, kind string, n bigint")
    drain(None)
    return before.unionByName(count(spark.read.schema(schema).parquet(out), "after the retry"))


def _made(spark, path):
    """The folder, which a failed first write may not have made."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return path


@register(
    "error_first_by_class_name",
    "SELECT o_custkey, 'alpha failed' AS error_message FROM (SELECT DISTINCT o_custkey FROM orders)",
)
def error_first_by_class_name(spark, sf):
    """Classes are evaluated by name, which is not the order of their mnemonics."""
    from rubrica.sources.model import Attribute, DataClass, EntityModel

    model = EntityModel("T_V1", "root", (
        DataClass("A_CLASS", "zeta", (Attribute("A_X", "x"),), element="A_ELM"), DataClass("Z_CLASS", "alpha", (Attribute("Z_X", "x"),), element="Z_ELM"),
    ))
    both = F.explode(F.array(F.struct(F.lit("A_CLASS").alias("c"), F.lit("zeta failed").alias("r")), F.struct(F.lit("Z_CLASS").alias("c"), F.lit("alpha failed").alias("r"))))
    rows = load(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").cast("int").alias("element_seq"), both.alias("b")).select(
        "o_custkey", "element_seq", F.col("b.c").alias("class_mnemonic"), F.col("b.r").alias("reason"), F.lit("attribute").alias("level"),
        F.lit("x").alias("name"), F.lit(1).alias("sequence"), F.lit(3).alias("state_code"),
    )
    return first_errors(rows, ["o_custkey"], model)


@register(
    "data_type_library",
    "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'Failed' ELSE 'Passed' END AS state FROM events",
)
def data_type_library(spark, sf):
    """A type of our own, numeric by the library file that declares it."""
    path = shared_folder(spark, "types")
    own = {"Types": [{"Code": "EUR", "Name": "Amount", "IsCoded": False, "IsNumeric": True, "IsRange": False}]}
    spark.createDataFrame([(json.dumps(own),)], "value string").coalesce(1).write.text(path)
    types = read_data_types(spark, path)
    value = F.when(F.col("event_type") == "purchase", "much").otherwise(F.col("value").cast("string"))
    items = {"EVT_VALUE": Item.of_observation(value, F.lit("EUR"), types=types)}
    source = TableSource(load(spark, sf, "events"), "EVENT", ["event_id"], items)
    rubric = compiled([criterion("EVT_VALUE", "OBSERVATIONVALUE_MATCHESTYPE")], EvalContext(data_types=types))
    return table_results(source, rubric).select("event_id", "state")
