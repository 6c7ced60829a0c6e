"""Runs, reports over results, content tables, sinks and streams."""

from pyspark.sql import functions as F

from rubrica.catalog.check_queries import AS_OF
from rubrica.catalog.registry import MODEL, ORACLES, compiled, criterion, load, register, text_items
from rubrica.catalog.score_queries import ORDER_STATES, order_cards, order_rubric, order_source
from rubrica.catalog.concept_queries import SYSTEMS
from rubrica.catalog.shared import shared_folder
from rubrica.functions.text import score_band, status_class, truncate_value
from rubrica.operators import runs
from rubrica.operators.content import text_in_content_set, unit_is_primary, value_in_range_set
from rubrica.operators.evaluate import TableSource, table_results, table_scorecards
from rubrica.operators.message_rows import message_rows
from rubrica.operators.rollup import class_scores, message_scores
from rubrica.functions.values import Item, coding, codings
from rubrica.plans.context import EvalContext
from rubrica.sources import fixed, sinks
from rubrica.sources.messages import check_messages
from rubrica.sources.reference import ContentMarts

RESULTS = f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, 'ORD_DATE' AS entity, 'Attribute is a past date' AS assessment, CASE c1 WHEN 1 THEN 'Passed' ELSE 'Failed' END AS state FROM ({ORDER_STATES})
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, 'ORD_STATUS', 'Status is final', CASE c2 WHEN 1 THEN 'Passed' ELSE 'Failed' END FROM ({ORDER_STATES})
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, 'ORD_TOTAL', 'Attribute is positive', 'Passed' FROM orders
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, 'ORD_PRIORITY', 'Attribute matches pattern', CASE c4 WHEN 1 THEN 'Passed' ELSE 'Failed' END FROM ({ORDER_STATES})
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, 'ORD_TOTAL', 'Attribute is an integer', 'Skipped' FROM orders
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, 'ORD_STATUS', 'Attribute is in list', 'Skipped' FROM orders"""


def order_results(spark, sf, *keys):
    return table_results(order_source(spark, sf, *keys), order_rubric())


@register("results_by_status", f"SELECT state, count(*) AS n FROM ({RESULTS}) GROUP BY state")
def results_by_status(spark, sf):
    return runs.count_by(order_results(spark, sf, "o_orderkey"), "state")


def two_classes(spark, sf):
    """Results over orders and customers."""
    rule = criterion("CUS_SEGMENT", "ATTR_INLIST", params={"LIST_CSV": "BUILDING"})
    source = TableSource(load(spark, sf, "customer"), "CUSTOMER", [], text_items(CUS_SEGMENT="c_mktsegment"))
    return order_results(spark, sf, "o_orderkey").unionByName(table_results(source, compiled([rule])), allowMissingColumns=True)


@register("results_by_class", f"SELECT 'ORDER' AS class_mnemonic, count(*) AS n FROM ({RESULTS}) UNION ALL SELECT 'CUSTOMER', count(*) FROM customer")
def results_by_class(spark, sf):
    return runs.count_by(two_classes(spark, sf), "class_mnemonic")


@register(
    "avg_assessments",
    f"SELECT m AS total_messages, r AS total_results, round(r::DOUBLE / m, 2) AS avg_per_message FROM (SELECT count(DISTINCT o_custkey) AS m, count(*) AS r FROM ({RESULTS}))",
)
def avg_assessments(spark, sf):
    return runs.average_assessments(
        message_scores(order_cards(spark, sf), ["o_custkey"]), order_results(spark, sf)
    )


@register("distinct_statuses", f"SELECT DISTINCT state FROM ({RESULTS})")
def distinct_statuses(spark, sf):
    return runs.distinct_values(order_results(spark, sf), "state")


@register("distinct_classes", "SELECT DISTINCT 'ORDER' AS class_mnemonic FROM orders UNION ALL SELECT DISTINCT 'CUSTOMER' FROM customer")
def distinct_classes(spark, sf):
    return runs.distinct_values(two_classes(spark, sf), "class_mnemonic")


@register(
    "latest_messages",
    f"SELECT o_orderkey, entity, assessment, state FROM ({RESULTS}) ORDER BY o_orderkey DESC, entity, assessment LIMIT 5",
)
def latest_messages(spark, sf):
    rows = runs.latest(order_results(spark, sf, "o_orderkey"), "o_orderkey", 5, "entity", "assessment")
    return rows.select("o_orderkey", "entity", "assessment", "state")


@register(
    "failed_only",
    f"SELECT o_orderkey, entity, assessment, 'failed' AS status_class FROM ({RESULTS}) WHERE state = 'Failed'",
)
def failed_only(spark, sf):
    rows = order_results(spark, sf, "o_orderkey").filter(F.lower("state") == "failed")
    return rows.select("o_orderkey", "entity", "assessment", status_class(F.col("state")).alias("status_class"))


_RUN = "SELECT event_type AS run_id, count(*) AS total_records, count(*) FILTER (WHERE value <= 150) AS total_completed, count(*) FILTER (WHERE value > 150) AS total_failed"


@register("run_summary", f"{_RUN}, 'COMPLETED' AS status FROM events GROUP BY event_type")
def run_summary(spark, sf):
    df = load(spark, sf, "events").withColumnRenamed("event_type", "run_id")
    return runs.run_counters(df, "run_id", F.col("value") <= 150)


@register("run_summary_strict", f"{_RUN}, CASE WHEN count(*) FILTER (WHERE value > 150) > 0 THEN 'FAILED' ELSE 'COMPLETE' END AS status FROM events GROUP BY event_type")
def run_summary_strict(spark, sf):
    df = load(spark, sf, "events").withColumnRenamed("event_type", "run_id")
    return runs.run_counters(df, "run_id", F.col("value") <= 150, "strict")


@register(
    "results_with_run",
    f"SELECT run_name, state, count(*) AS n FROM ({RESULTS}) JOIN (SELECT 'F' AS run_id, 'final' AS run_name UNION ALL SELECT 'O', 'open') r ON o_orderstatus = run_id GROUP BY ALL",
)
def results_with_run(spark, sf):
    table = spark.createDataFrame([("F", "final"), ("O", "open")], "run_id string, run_name string")
    rows = order_results(spark, sf, "o_orderstatus", "o_orderkey").withColumnRenamed("o_orderstatus", "run_id")
    return runs.with_run(rows, table, spread=["o_orderkey", "criterion_id"]).groupBy("run_name", "state").agg(F.count(F.lit(1)).alias("n"))


# --- audit log and benchmark --------------------------------------------


def event_audit(spark, sf):
    """One audit record per event; the value is the time it took in milliseconds."""
    df = load(spark, sf, "events").select("*", F.col("ts").cast("timestamp").alias("_from")).withColumn(
        "_to", F.expr("timestampadd(MILLISECOND, CAST(value * 100 AS BIGINT), _from)")
    )
    ok = F.col("value") <= 150
    return runs.audit_records(
        df, "run-1", F.col("event_id"), F.col("_from"), F.col("_to"), F.col("event_id").cast("string"), ok,
        error_type=F.when(~ok, "SLOW"), error_message=F.when(~ok, 'took "long", too long'), request_body=F.col("props"),
    )


_MS = "CAST(trunc(value * 100) AS BIGINT)"


@register(
    "audit_log",
    f"""SELECT event_id AS "rowNumber", {_MS} AS "durationMs", CAST(event_id AS VARCHAR) AS "messageId", value <= 150 AS "wasSuccess", strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS "requestTimestamp", CASE WHEN value > 150 THEN 'SLOW' END AS "errorType" FROM events""",
)
def audit_log(spark, sf):
    return event_audit(spark, sf).select("rowNumber", "durationMs", "messageId", "wasSuccess", "requestTimestamp", "errorType")


@register(
    "audit_csv_line",
    """SELECT event_id || ',DRY_RUN,' || CASE WHEN value > 150 THEN '"took ""long"", too long"' ELSE '' END || ',"' || replace(props, '"', '""') || '"' AS line FROM events""",
)
def audit_csv_line(spark, sf):
    return event_audit(spark, sf).select(sinks.csv_line(["messageId", "apiUrl", "errorMessage", "requestBody"]).alias("line"))


@register(
    "benchmark_summary",
    f"""SELECT count(*) AS processed, count(*) FILTER (WHERE value <= 150) AS succeeded, count(*) FILTER (WHERE value > 150) AS failed, CAST(sum({_MS}) AS BIGINT) AS total_ms,
    round(count(*) * 1000.0::DOUBLE / sum({_MS})::DOUBLE, 2) AS rows_per_second, round(sum({_MS})::DOUBLE / count(*), 2) AS avg_ms FROM events""",
)
def benchmark_summary(spark, sf):
    out = runs.benchmark_summary(event_audit(spark, sf))
    return out.select(
        "processed", "succeeded", "failed", F.col("totalRunMs").alias("total_ms"),
        F.col("rowsPerSecond").alias("rows_per_second"), F.col("avgMsPerRow").alias("avg_ms"),
    )


_CMP = """SELECT unnest(['records', 'units', 'zero', 'rowsPerSecond', 'only_%s']) AS metric, unnest([count(*)::DOUBLE, sum(CAST(l_quantity AS BIGINT))::DOUBLE, 0::DOUBLE, (count(*) / 10)::DOUBLE, 1::DOUBLE]) AS value FROM lineitem WHERE l_returnflag = '%s'"""


@register(
    "run_compare",
    f"""SELECT metric, baseline, candidate, round(delta, 6) AS delta_percent, CASE WHEN delta IS NULL THEN 'UNKNOWN' WHEN abs(delta) < 0.01 THEN 'SAME' WHEN (metric = 'rowsPerSecond' AND delta > 0) OR (metric <> 'rowsPerSecond' AND delta < 0) THEN 'BETTER' ELSE 'WORSE' END AS verdict
    FROM (SELECT *, CASE WHEN baseline IS NULL OR candidate IS NULL THEN NULL WHEN baseline = 0 THEN CASE WHEN candidate = 0 THEN 0.0 END ELSE (candidate - baseline) / baseline * 100 END AS delta
      FROM (SELECT metric, a.value AS baseline, b.value AS candidate FROM ({_CMP % ('A', 'A')}) a FULL JOIN ({_CMP % ('N', 'N')}) b USING (metric)))""",
)
def run_compare(spark, sf):
    """Two runs (the returned and the kept lines) side by side."""

    def metrics(flag: str):
        summary = load(spark, sf, "lineitem").filter(F.col("l_returnflag") == flag).agg(
            F.count(F.lit(1)).alias("records"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("units"),
            F.lit(0).alias("zero"),
            (F.count(F.lit(1)) / 10).alias("rowsPerSecond"),
            F.lit(1).alias(f"only_{flag}"),
        )
        return runs.to_metrics(summary.withColumn("run", F.lit(flag)), "run").select("metric", "value")

    out = runs.compare_runs(metrics("A"), metrics("N"))
    return out.withColumn("delta_percent", F.round("delta_percent", 6))


# --- content tables -----------------------------------------------------


@register(
    "content_range",
    """SELECT l_returnflag, l_linestatus, ok, count(*) AS n FROM (
    SELECT l_returnflag, l_linestatus, EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_type = CASE WHEN l_linestatus = 'O' THEN 'PROMO' ELSE 'SMALL' END AND l_quantity >= p_size
      AND (p_brand = 'Brand#1' OR l_quantity <= p_size + 20)) AS ok FROM lineitem) GROUP BY ALL""",
)
def content_range(spark, sf):
    """Quantity inside the part's range; the part type stands for the unit, one brand has no upper bound."""
    ranges = load(spark, sf, "part").select(
        F.lit("RANGES").alias("content_set"), F.lit("PARTS").alias("system"), F.col("p_partkey").alias("code"), F.col("p_type").alias("unit"),
        F.col("p_size").cast("double").alias("min_value"),
        F.when(F.col("p_brand") != "Brand#1", F.col("p_size") + 20.0).alias("max_value"),
    )
    lines = load(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.lit("PARTS").alias("system"),
        F.when(F.col("l_linestatus") == "O", "PROMO").otherwise("SMALL").alias("unit"),
    )
    out = value_in_range_set(lines, ranges, "RANGES", "system", "l_partkey", "unit", "l_quantity", "ok")
    return out.groupBy("l_returnflag", "l_linestatus", "ok").agg(F.count(F.lit(1)).alias("n"))


@register(
    "content_range_many",
    """SELECT o_orderpriority, ok, count(*) AS n FROM (
    SELECT o_orderpriority, EXISTS (SELECT 1 FROM lineitem WHERE o_totalprice >= l_extendedprice AND o_totalprice <= l_extendedprice + l_quantity / 50) AS ok FROM orders) GROUP BY ALL""",
)
def content_range_many(spark, sf):
    """All line items are ranges of one code and unit; each order's price is looked up among them."""
    one = {"system": "PRICES", "code": "all", "unit": "money"}
    ranges = load(spark, sf, "lineitem").select(
        F.lit("RANGES").alias("content_set"), *[F.lit(v).alias(k) for k, v in one.items()],
        F.col("l_extendedprice").alias("min_value"), (F.col("l_extendedprice") + F.col("l_quantity") / 50).alias("max_value"),
    )
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", *[F.lit(v).alias(k) for k, v in one.items()])
    out = value_in_range_set(orders, ranges, "RANGES", "system", "code", "unit", "o_totalprice", "ok")
    return out.groupBy("o_orderpriority", "ok").agg(F.count(F.lit(1)).alias("n"))


@register(
    "content_unit",
    """SELECT l_returnflag, ok, count(*) AS n FROM (SELECT l_returnflag, coalesce(p_type = CASE WHEN l_quantity > 25 THEN 'LARGE' ELSE 'SMALL' END, false) AS ok
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey) GROUP BY ALL""",
)
def content_unit(spark, sf):
    units = load(spark, sf, "part").select(
        F.lit("UNITS").alias("content_set"), F.lit("PARTS").alias("system"), F.col("p_partkey").alias("code"), F.col("p_type").alias("unit")
    )
    lines = load(spark, sf, "lineitem").select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", F.lit("PARTS").alias("system"),
        F.when(F.col("l_quantity") > 25, "LARGE").otherwise("SMALL").alias("unit"),
    )
    out = unit_is_primary(lines, units, "UNITS", "system", "l_partkey", "unit", "ok")
    return out.groupBy("l_returnflag", "ok").agg(F.count(F.lit(1)).alias("n"))


@register(
    "content_text",
    "SELECT doc_id, EXISTS (SELECT 1 FROM benchmark b WHERE b.text = line) AS ok, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY ALL",
)
def content_text(spark, sf):
    """Which lines of the documents are allowed texts (the benchmark passages)?"""
    texts = load(spark, sf, "benchmark").select(F.lit("PASSAGES").alias("content_set"), "text")
    lines = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    out = text_in_content_set(lines, texts, "PASSAGES", "line", "ok")
    return out.groupBy("doc_id", "ok").agg(F.count(F.lit(1)).alias("n"))


_LINE_UNIT = "CASE WHEN l_linestatus = 'O' THEN 'PROMO' ELSE 'SMALL' END"


def content_rubric(spark, sf):
    """Allowed text, range by code and unit, and primary unit of lines, from parts and suppliers."""
    part = load(spark, sf, "part")
    code = [F.lit("urn:shop:part").alias("system"), F.col("p_partkey").cast("string").alias("code"), F.col("p_type").alias("unit")]
    upper = F.when(F.col("p_brand") != "Brand#1", F.col("p_size") + 20.0).alias("max_value")
    content = ContentMarts(
        units=part.select(F.lit("UNITS").alias("content_set"), *code),
        ranges=part.select(F.lit("RANGES").alias("content_set"), *code, F.col("p_size").cast("double").alias("min_value"), upper),
        texts=load(spark, sf, "supplier").select(F.lit("NAMES").alias("content_set"), F.col("s_suppkey").cast("string").alias("text")),
    )
    rules = [
        criterion("LIN_NUMBER", "VALUE_IN_RANGE_SET", 1, params={"CONTENT_SET": "RANGES", "CODE_ATTRIBUTE": "LIN_PART", "UNIT_ATTRIBUTE": "LIN_FLAG"}),
        criterion("LIN_FLAG", "UNIT_IS_PRIMARY", 2, params={"CONTENT_SET": "UNITS", "CODE_ATTRIBUTE": "LIN_PART"}),
        criterion("LIN_STATUS", "TEXT_IN_CONTENT_SET", 3, params={"CONTENT_SET": "NAMES"}),
    ]
    return compiled(rules, EvalContext(code_systems=SYSTEMS, content=content))


@register(
    "content_checks",
    """SELECT entity, state, fail_check, count(*) AS n FROM (
    SELECT 'LIN_NUMBER' AS entity, coalesce(p_type = unit AND l_quantity >= p_size AND (p_brand = 'Brand#1' OR l_quantity <= p_size + 20), false) AS ok, 'VALUE_IN_RANGE_SET' AS chk FROM lines
    UNION ALL SELECT 'LIN_FLAG', coalesce(p_type = unit, false), 'UNIT_IS_PRIMARY' FROM lines
    UNION ALL SELECT 'LIN_STATUS', s_suppkey IS NOT NULL, 'TEXT_IN_CONTENT_SET' FROM lines) r,
    LATERAL (SELECT CASE WHEN ok THEN 'Passed' ELSE 'Failed' END AS state, CASE WHEN NOT ok THEN chk END AS fail_check) GROUP BY ALL""".replace(
        "FROM lines",
        "FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'PROMO' ELSE 'SMALL' END AS unit FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON 2 * l_suppkey = s_suppkey)",
    ),
)
def content_checks(spark, sf):
    """The content tables as checks of a rubric: allowed text, range by code and unit, primary unit."""
    items = text_items(LIN_NUMBER="l_quantity", LIN_FLAG=_LINE_UNIT, LIN_STATUS="2 * l_suppkey")
    items["LIN_PART"] = Item.of_concept(None, codings(coding(F.col("l_partkey"), F.lit("PARTS"), F.lit("x"))))
    rows = table_results(TableSource(load(spark, sf, "lineitem"), "LINE", [], items), content_rubric(spark, sf))
    return rows.groupBy("entity", "state", "fail_check").agg(F.count(F.lit(1)).alias("n"))


@register("content_checks_messages", ORACLES["content_checks"])
def content_checks_messages(spark, sf):
    """The same lines as messages, several to an order: siblings are looked up within the element."""
    part = F.struct(F.array(F.struct(F.col("l_partkey").cast("string").alias("code"), F.lit("PARTS").alias("system"))).alias("codings"))
    line = F.struct(
        F.col("l_quantity").cast("string").alias("Number"), F.expr(_LINE_UNIT).alias("flag"), F.expr("CAST(2 * l_suppkey AS STRING)").alias("status"), part.alias("part")
    )
    # Lines as texts: lists of texts take less time and memory to gather than lists of structs.
    orders = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.to_json(line)), ",").alias("lines"))
    messages = orders.select(
        F.lit("shop").alias("provider_id"), F.lit("lines").alias("source_id"), F.col("l_orderkey").cast("string").alias("message_id"),
        F.lit("SHOP_V1").alias("model_mnemonic"), F.lit("CATALOG").alias("rubric_mnemonic"), F.concat(F.lit('{"shop":{"lines":['), "lines", F.lit("]}}")).alias("payload"),
    )
    rows = message_rows(check_messages(messages, MODEL, MODEL.mnemonic), content_rubric(spark, sf), ["message_id"])
    return rows.groupBy("entity", "state", "fail_check").agg(F.count(F.lit(1)).alias("n"))


# --- views, queue, sinks ------------------------------------------------


@register(
    "value_truncate",
    "SELECT doc_id, md5(CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '...' ELSE text END) AS shown, CASE WHEN lang = 'en' THEN 'N/A' ELSE substr(lang, 1, 1) || '...' END AS lang_shown FROM documents",
)
def value_truncate(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id",
        F.md5(truncate_value(F.col("text")).cast("binary")).alias("shown"),
        truncate_value(F.when(F.col("lang") != "en", F.col("lang")), 1).alias("lang_shown"),
    )


@register(
    "score_bands",
    f"""SELECT band, count(*) AS n FROM (SELECT CASE WHEN s >= 80 THEN 'high' WHEN s >= 50 THEN 'medium' ELSE 'low' END AS band
    FROM (SELECT trunc(CAST(sum(c1 + c2 + c3) AS FLOAT) / CAST(3 * count(*) AS FLOAT) * CAST(100 AS FLOAT)) AS s FROM ({ORDER_STATES}) GROUP BY o_custkey)) GROUP BY band""",
)
def score_bands(spark, sf):
    out = message_scores(order_cards(spark, sf), ["o_custkey"])
    return out.groupBy(score_band(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "active_classes",
    "SELECT o_custkey, 'ORDER' AS class_mnemonic, count(*) AS instance_count FROM orders GROUP BY o_custkey",
)
def active_classes(spark, sf):
    out = class_scores(order_cards(spark, sf), ["o_custkey"], MODEL).filter("instance_count > 0")
    return out.select("o_custkey", "class_mnemonic", "instance_count")


@register(
    "queue_pending",
    "SELECT event_id AS id, 'PENDING' AS status, 0 AS retry_count FROM events WHERE event_type <> 'error' AND user_id < 50",
)
def queue_pending(spark, sf):
    """Pending items of a run; here a run is a half of the users."""
    queue = load(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("user_id") < 50, 1).otherwise(2).cast("bigint").alias("run_id"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("PENDING").alias("status"),
        F.lit(0).alias("retry_count"),
    )
    return sinks.pending(queue, 1).select("id", "status", "retry_count")


@register(
    "sink_align",
    "SELECT CAST(s_suppkey AS BIGINT) AS run_id, NULL::INT AS row_num, s_name AS message_id, NULL::VARCHAR AS status, s_acctbal AS balance FROM supplier",
)
def sink_align(spark, sf):
    """Columns of the target that are missing are added; extra ones stay."""
    df = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("run_id"), F.col("s_name").alias("message_id"), F.col("s_acctbal").alias("balance"))
    return sinks.align(df, sinks.RESULT_SCHEMA).select("run_id", "row_num", "message_id", "status", "balance")


@register(
    "stream_scores",
    f"""SELECT o_orderstatus, CAST(sum(c1 + c2 + c3) AS BIGINT) AS numerator, 3 * count(*) AS denominator FROM ({ORDER_STATES}) GROUP BY o_orderstatus""",
)
def stream_scores(spark, sf):
    """Orders read as a stream; each batch is scored like a table and written as its own
    partition, so a repeated batch replaces itself."""
    from rubrica.catalog.shared import shared_folder

    out, checkpoint = shared_folder(spark, "stream_scores/out"), shared_folder(spark, "stream_scores/checkpoint")
    schema = load(spark, sf, "orders").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    source = order_source(spark, sf, "o_orderstatus")

    def score(batch, batch_id):
        from dataclasses import replace

        cards = table_scorecards(replace(source, df=batch), order_rubric())
        sinks.write_batch(message_scores(cards, ["o_orderstatus"]), out, batch_id)

    query = stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).groupBy("o_orderstatus").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))


@register(
    "run_life_cycle",
    """SELECT event_type AS run_id, CASE WHEN event_type = 'error' THEN NULL ELSE count(*) END AS total_records,
    CASE event_type WHEN 'error' THEN NULL WHEN 'purchase' THEN 0 ELSE count(*) FILTER (value <= 150) END AS total_completed,
    CASE event_type WHEN 'error' THEN NULL WHEN 'purchase' THEN count(*) ELSE count(*) FILTER (value > 150) END AS total_failed,
    CASE event_type WHEN 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN event_type = 'error' THEN TIMESTAMP '2030-01-01' ELSE max(ts) END AS completed_at, min(ts) AS created_at
    FROM events GROUP BY event_type""",
)
def run_life_cycle(spark, sf):
    """A run whose messages all failed is completed; one whose job breaks off is failed."""
    path, events = shared_folder(spark, "guarded"), load(spark, sf, "events")
    failed_at = F.lit("2030-01-01").cast("timestamp")

    def opened(which):
        return runs.start_runs(events.filter(which).groupBy(F.col("event_type").alias("run_id")).agg(F.min("ts").alias("created_at")))

    def job(which, ok):
        return lambda: events.filter(which).select(F.col("event_type").alias("run_id"), ok.alias("ok"), "ts")

    good = (F.col("value") <= 150) & (F.col("event_type") != "purchase")
    runs.guarded_run(opened("event_type <> 'error'"), path, job("event_type <> 'error'", good), F.max("ts"), failed_at)
    broken = F.when(F.col("value").isNotNull(), F.raise_error(F.lit("no connection"))).otherwise(F.lit(True))
    try:
        runs.guarded_run(opened("event_type = 'error'"), path, job("event_type = 'error'", broken), F.max("ts"), failed_at)
    except Exception as broke:
        if "no connection" not in str(broke):
            raise
    closed = runs.current_runs(spark.read.parquet(path))
    return closed.select("run_id", "total_records", "total_completed", "total_failed", "status", "completed_at", "created_at")
