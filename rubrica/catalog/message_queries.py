"""Messages: flattening, headers, validation, lab rows, audit and extraction."""

from pyspark.sql import functions as F

from rubrica.catalog.registry import MODEL, compiled, criterion, load, register
from rubrica.catalog.score_queries import ORDER_RULES, ORDER_STATES, order_rubric, order_source
from rubrica.catalog.check_queries import AS_OF, DATE
from rubrica.functions.text import class_display_name
from rubrica.operators.audit import (
    AUDIT_VALUES,
    assessments,
    attribute_audit,
    audited_messages,
    element_audit,
    extract_assessments,
    scoring_response,
)
from rubrica.operators.evaluate import (
    evaluate_messages,
    message_results,
    message_scorecards,
    table_results,
)
from rubrica.operators.flatten import align, flatten
from rubrica.operators.message_rows import message_cards, message_rows
from rubrica.operators.rollup import class_scores, informational, message_scores
from rubrica.plans.context import EvalContext
from rubrica.plans.rubric import Rubric, compile_rubric
from rubrica.sources import fixed
from rubrica.sources.lab import drop_blank, lab_messages
from rubrica.sources.messages import check_messages, fan_out, model_parts, resolve_header, widen
from rubrica.sources.model import Attribute, DataClass, EntityModel, clinical_model, path_key
from rubrica.sources.reference import CodeSystems, Terminology, ValueLists

DOCS = EntityModel(
    "TEXTS_V2",
    "document",
    (
        DataClass("SUMMARY", "summary", (Attribute("SUM_LANG", "language"), Attribute("SUM_ORIGIN", "origin"), Attribute("SUM_SIZE", "size"), Attribute("SUM_AUTHOR", "author")), "ONE", element="SUMMARY_ELM"),
        DataClass("LINES", "lines", (Attribute("LNS_TEXT", "content"), Attribute("LNS_MARK", "mark")), element="LINES_ELM"),
        DataClass("NOTES", "notes", (Attribute("NTS_TEXT", "text"),), element="NOTES_ELM"),
    ),
)
DOC_KEYS = ["message_id"]


def wide(df):
    """Spread over as many tasks as the session asks for; by default as the files are laid out."""
    asked = df.sparkSession.conf.get("rubrica.partitions", None)
    return widen(df, int(asked) if asked else None)

DOC_RULES = [
    criterion("SUM_LANG", "ATTR_INLIST", 1, params={"LIST_CSV": "en|fr"}, critical=True),
    criterion("SUM_SIZE", "ATTR_ISPOSITIVENUMBER", 2),
    criterion("LNS_TEXT", "ATTR_ISPOPULATED", 3, weight=2),
    criterion("LNS_TEXT", "ATTR_MATCHESREGEX", 4, params={"CUSTOM_REGULAR_EXPRESSION": "[0-9]"}, effect="Informational", conditional="ATTR_ISPOPULATED"),
    criterion("NTS_TEXT", "ATTR_ISPOPULATED", 5),
    criterion("LINES_ELM", "ELEMENT_ISCLEAN", 6),
]
# Per line in SQL.
LINES = "SELECT doc_id, lang, n_chars, unnest(string_split(text, chr(10))) AS line FROM documents"


def doc_messages(spark, sf):
    """One message per document: the whole text, line by line."""
    payload = F.expr(
        "to_json(named_struct('messageID', CAST(doc_id AS STRING), 'Document', named_struct("
        "'summary', named_struct('LANGUAGE', lang, 'origin', source, 'size', n_chars, 'Language', 'ignored'), "
        "'lines', transform(split(text, '\\n'), x -> named_struct('content', x)), 'other', 1)))"
    )
    return wide(load(spark, sf, "documents")).select(
        F.col("source").alias("provider_id"),
        F.col("lang").alias("source_id"),
        F.col("doc_id").cast("string").alias("message_id"),
        F.lit("texts_V7_EXT").alias("model_mnemonic"),
        F.lit("DOC_RULES").alias("rubric_mnemonic"),
        payload.alias("payload"),
    )


def checked_docs(spark, sf):
    return check_messages(doc_messages(spark, sf), DOCS, DOCS.mnemonic)


def doc_rubric():
    return compiled(DOC_RULES, EvalContext(as_of=AS_OF), DOCS)


@register(
    "flatten_messages",
    f"""SELECT CAST(doc_id AS VARCHAR) AS message_id, class_mnemonic, element_seq, entity, raw_hash FROM (
    SELECT doc_id, 'LINES' AS class_mnemonic, CAST(i AS INT) AS element_seq, 'LNS_TEXT' AS entity, md5(l[i]) AS raw_hash
      FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
    UNION ALL SELECT doc_id, 'SUMMARY', 1, 'SUM_LANG', md5(lang) FROM documents
    UNION ALL SELECT doc_id, 'SUMMARY', 1, 'SUM_ORIGIN', md5(source) FROM documents
    UNION ALL SELECT doc_id, 'SUMMARY', 1, 'SUM_SIZE', md5(CAST(n_chars AS VARCHAR)) FROM documents)""",
)
def flatten_messages(spark, sf):
    items = flatten(checked_docs(spark, sf), DOCS, DOC_KEYS)
    return items.filter("level = 'attribute' AND present").select(
        "message_id", "class_mnemonic", "element_seq", "entity", F.md5(F.col("raw").cast("binary")).alias("raw_hash")
    )


@register(
    "align_missing",
    """SELECT entity, level, present, n FROM (
    SELECT 'SUM_AUTHOR' AS entity, 'attribute' AS level, false AS present, count(*) AS n FROM documents
    UNION ALL SELECT 'LNS_MARK', 'attribute', false, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) FROM documents
    UNION ALL SELECT 'LNS_TEXT', 'attribute', true, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) FROM documents
    UNION ALL SELECT 'LINES_ELM', 'element', true, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) FROM documents
    UNION ALL SELECT unnest(['SUM_LANG', 'SUM_ORIGIN', 'SUM_SIZE']), 'attribute', true, count(*) FROM documents GROUP BY 1
    UNION ALL SELECT 'SUMMARY_ELM', 'element', true, count(*) FROM documents
    UNION ALL SELECT unnest(['SUMMARY', 'LINES']), 'class', true, count(*) FROM documents GROUP BY 1
    UNION ALL SELECT 'NOTES', 'class', false, count(*) FROM documents
    UNION ALL SELECT 'ROOT', 'root', true, count(*) FROM documents)""",
)
def align_missing(spark, sf):
    return flatten(checked_docs(spark, sf), DOCS, DOC_KEYS).groupBy("entity", "level", "present").agg(F.count(F.lit(1)).alias("n"))


@register(
    "align_long_table",
    """SELECT entity, present, raw, count(*) AS n FROM (
    SELECT 'ORD_STATUS' AS entity, true AS present, o_orderstatus AS raw FROM orders
    UNION ALL SELECT 'ORD_PRIORITY', o_orderpriority < '4', CASE WHEN o_orderpriority < '4' THEN o_orderpriority END FROM orders
    UNION ALL SELECT unnest(['ORD_DATE', 'ORD_TOTAL', 'ORD_CUSTOMER']), false, NULL FROM orders) GROUP BY ALL""",
)
def align_long_table(spark, sf):
    """Attributes that arrive as a long table, with a repeated one: the first wins."""
    orders = load(spark, sf, "orders")
    rows = F.array(
        F.struct(F.lit(0).alias("attr_pos"), F.lit("Status").alias("field"), F.col("o_orderstatus").alias("raw")),
        F.struct(F.lit(1).alias("attr_pos"), F.lit("STATUS").alias("field"), F.lit("again").alias("raw")),
        F.struct(F.lit(2).alias("attr_pos"), F.lit("priority").alias("field"), F.col("o_orderpriority").alias("raw")),
    )
    head = ["o_orderkey", F.lit("ORDER").alias("class_mnemonic"), F.lit(1).alias("element_seq")]
    attrs = orders.select(*head, F.explode(rows).alias("a")).select("o_orderkey", "class_mnemonic", "element_seq", "a.*")
    attrs = attrs.filter("field <> 'priority' OR raw < '4'")
    return align(orders.select(*head), attrs, MODEL, ["o_orderkey"]).groupBy("entity", "present", "raw").agg(F.count(F.lit(1)).alias("n"))


_L = f"""SELECT doc_id, any_value(lang) AS lang, count(*) AS lines, count(*) FILTER (WHERE line <> '') AS filled,
  count(*) FILTER (WHERE regexp_matches(line, '[0-9]')) AS digits FROM ({LINES}) GROUP BY doc_id"""
_N = "CASE WHEN lang IN ('en', 'fr') THEN 1 ELSE 0 END + 1 + filled + digits"
_D = "2 + 2 * lines"
_SCORE = "CAST(trunc(CAST({n} AS FLOAT) / CAST({d} AS FLOAT) * CAST(100 AS FLOAT)) AS INT)"


@register(
    "message_scores",
    f"""SELECT CAST(doc_id AS VARCHAR) AS message_id, {_N} AS numerator, {_D} AS denominator, {_SCORE.format(n=f'({_N})', d=f'({_D})')} AS score,
    {_N} + filled AS weighted_numerator, CASE WHEN lang IN ('en', 'fr') THEN 0 ELSE 1 END AS critical_failure_count, lines - filled AS info_skip, true AS succeeded FROM ({_L})""",
)
def message_scores_query(spark, sf):
    """Whole message path: parse, evaluate elements in their rows, roll up."""
    rubric = doc_rubric()
    return message_scores(message_cards(checked_docs(spark, sf), rubric, DOC_KEYS), DOC_KEYS).select(
        "message_id", "numerator", "denominator", "score", "weighted_numerator", "critical_failure_count", "info_skip", "succeeded"
    )


@register(
    "message_class_scores",
    f"""SELECT CAST(doc_id AS VARCHAR) AS message_id, class_name, instance_count, clean_count, numerator, denominator FROM (
    SELECT doc_id, 'Summary' AS class_name, 1 AS instance_count, CASE WHEN lang IN ('en', 'fr') THEN 1 ELSE 0 END AS clean_count, CASE WHEN lang IN ('en', 'fr') THEN 2 ELSE 1 END AS numerator, 2 AS denominator FROM ({_L})
    UNION ALL SELECT doc_id, 'Lines', lines, digits, filled + digits, 2 * lines FROM ({_L})
    UNION ALL SELECT doc_id, 'Notes', 0, 0, 0, 0 FROM ({_L}))""",
)
def message_class_scores(spark, sf):
    rubric = doc_rubric()
    cards = message_scorecards(evaluate_messages(checked_docs(spark, sf), rubric, DOC_KEYS), rubric, DOC_KEYS)
    return class_scores(cards, DOC_KEYS, DOCS).select("message_id", "class_name", "instance_count", "clean_count", "numerator", "denominator")


@register(
    "message_result_counts",
    f"""SELECT entity, "check", state, count(*) AS n FROM (
    SELECT 'SUM_LANG' AS entity, 'ATTR_INLIST' AS "check", CASE WHEN lang IN ('en', 'fr') THEN 'Passed' ELSE 'Failed' END AS state FROM documents
    UNION ALL SELECT 'SUM_SIZE', 'ATTR_ISPOSITIVENUMBER', 'Passed' FROM documents
    UNION ALL SELECT 'LNS_TEXT', 'ATTR_ISPOPULATED', CASE WHEN line = '' THEN 'Failed' ELSE 'Passed' END FROM ({LINES})
    UNION ALL SELECT 'LNS_TEXT', 'ATTR_MATCHESREGEX', CASE WHEN line = '' THEN 'Skipped' WHEN regexp_matches(line, '[0-9]') THEN 'Passed' ELSE 'Failed' END FROM ({LINES})
    UNION ALL SELECT 'LINES_ELM', 'ELEMENT_ISCLEAN', CASE WHEN regexp_matches(line, '[0-9]') THEN 'Passed' ELSE 'Failed' END FROM ({LINES})) GROUP BY ALL""",
)
def message_result_counts(spark, sf):
    rows = message_rows(checked_docs(spark, sf), doc_rubric(), DOC_KEYS)
    return rows.groupBy("entity", "check", "state").agg(F.count(F.lit(1)).alias("n"))


@register(
    "message_path_equals_table_path",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS message_id, CAST(c1 + c2 + c3 AS BIGINT) AS numerator, CAST(3 AS BIGINT) AS denominator, CAST(2 * c1 + c2 + 3 * c3 AS BIGINT) AS weighted_numerator FROM ({ORDER_STATES})""",
)
def message_path_equals_table_path(spark, sf):
    """Orders as messages, scored by the rubric the table queries use."""
    payload = F.to_json(
        F.struct(
            F.struct(
                F.array(
                    F.struct(
                        F.col("o_orderstatus").alias("status"), F.expr(DATE).alias("date"),
                        F.col("o_totalprice").cast("string").alias("TOTAL"), F.col("o_orderpriority").alias("priority"),
                    )
                ).alias("orders")
            ).alias("shop")
        )
    )
    msgs = wide(load(spark, sf, "orders")).select(
        F.lit("shop").alias("provider_id"), F.lit("orders").alias("source_id"), F.col("o_orderkey").cast("string").alias("message_id"),
        F.lit("SHOP_V1").alias("model_mnemonic"), F.lit("CATALOG").alias("rubric_mnemonic"), payload.alias("payload"),
    )
    rubric = order_rubric()
    cards = message_cards(check_messages(msgs, MODEL, MODEL.mnemonic), rubric, DOC_KEYS)
    return message_scores(cards, DOC_KEYS).select("message_id", "numerator", "denominator", "weighted_numerator")


# --- headers and validation ---------------------------------------------

_PROVIDER = "CASE event_type WHEN 'click' THEN 'given' WHEN 'view' THEN '  ' END"
_INNER = "CASE WHEN event_type = 'error' THEN NULL ELSE 'p_' || event_type END"


@register(
    "header_resolve",
    f"""SELECT event_id, CASE event_type WHEN 'click' THEN 'given' WHEN 'view' THEN 'fallback' WHEN 'error' THEN 'fallback' ELSE 'p_' || event_type END AS provider,
    CASE event_type WHEN 'view' THEN 'Default' WHEN 'error' THEN 'Default' ELSE 'Original' END AS provider_state,
    CASE WHEN event_type = 'signup' THEN 'forced' ELSE 'src' END AS data_source, CASE WHEN event_type = 'signup' THEN 'Overridden' ELSE 'Original' END AS data_source_state,
    CASE WHEN value > 100 THEN 'INNER_V1' ELSE 'OUTER_V1' END AS entity_model, CASE WHEN event_type = 'purchase' THEN NULL ELSE CAST(ts AS DATE)::VARCHAR END AS day FROM events""",
)
def header_resolve(spark, sf):
    df = load(spark, sf, "events")
    inner = F.to_json(
        F.struct(
            F.expr(_INNER).alias("DataProviderID"),
            F.when(F.col("value") > 100, "INNER_V1").alias("EntityModel"),
            F.when(F.col("event_type") == "purchase", "never").otherwise(F.col("ts").cast("string")).alias("TransactionDate"),
        )
    )
    msgs = df.select(
        "event_id", "event_type", F.expr(_PROVIDER).alias("provider_id"), F.lit("src").alias("source_id"),
        F.col("event_id").cast("string").alias("message_id"), F.lit("OUTER_V1").alias("model_mnemonic"), inner.alias("payload"),
    )
    out = resolve_header(
        msgs, {"provider": F.lit("fallback")}, {"data_source": F.when(F.col("event_type") == "signup", "forced")}
    )
    return out.select(
        "event_id", "provider", "provider_state", "data_source", "data_source_state", "entity_model",
        F.date_format("transaction_date", "yyyy-MM-dd").alias("day"),
    )


@register(
    "header_date_state",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'Original' WHEN 'view' THEN 'Original' WHEN 'purchase' THEN 'Default' ELSE 'Original' END AS state,
    CASE event_type WHEN 'click' THEN '2031-05-06' WHEN 'purchase' THEN '2030-01-02' ELSE CAST(ts AS DATE)::VARCHAR END AS day FROM events""",
)
def header_date_state(spark, sf):
    """Where the transaction date came from; unlike texts, a date that is overridden still counts as original."""
    kind = F.col("event_type")
    date = F.when(kind == "purchase", F.lit(" ")).otherwise(F.col("ts").cast("string"))
    msgs = load(spark, sf, "events").select(
        "event_id", "event_type", F.lit("p").alias("provider_id"), F.lit("s").alias("source_id"), F.col("event_id").cast("string").alias("message_id"),
        F.lit("M_V1").alias("model_mnemonic"), F.to_json(F.struct(date.alias("TransactionDate"))).alias("payload"),
    )
    out = resolve_header(msgs, {"transaction_date": F.lit("2030-01-02")}, {"transaction_date": F.when(kind == "click", "2031-05-06")})
    return out.select("event_id", F.col("transaction_date_state").alias("state"), F.date_format("transaction_date", "yyyy-MM-dd").alias("day"))


@register(
    "item_paths",
    """SELECT CAST(doc_id AS VARCHAR) AS message_id, path FROM (
    SELECT doc_id, 'doc|LINES|LINES_ELM.' || CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS VARCHAR) || '|LNS_TEXT' AS path FROM documents
    UNION ALL SELECT doc_id, 'doc|SUMMARY|SUMMARY_ELM.1|' || unnest(['SUM_LANG', 'SUM_ORIGIN', 'SUM_SIZE']) FROM documents
    UNION ALL SELECT doc_id, unnest(['doc', 'doc|SUMMARY', 'doc|LINES', 'doc|SUMMARY|SUMMARY_ELM.1']) FROM documents)""",
)
def item_paths(spark, sf):
    """Paths of the items that messages have, but for elements with many."""
    items = flatten(checked_docs(spark, sf), DOCS, DOC_KEYS).filter("present AND entity <> 'LINES_ELM'")
    return items.select("message_id", path_key("doc").alias("path"))


_MODEL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'shop_V2_EXT' WHEN '2-HIGH' THEN 'SHOP_V1' WHEN '3-MEDIUM' THEN 'OTHER_V1' WHEN '5-LOW' THEN 'SHOP' ELSE ' ' END"


@register(
    "model_match",
    f"""SELECT o_orderkey, CASE o_orderpriority WHEN '3-MEDIUM' THEN 'Message model mnemonic does not match the evaluation rubric.' WHEN '5-LOW' THEN 'Invalid message model.' WHEN '4-NOT SPECIFIED' THEN 'Missing model version mnemonic.' END AS error_message,
    CASE WHEN o_orderpriority < '4' THEN split_part({_MODEL}, '_', 1) END AS family, CASE WHEN o_orderpriority < '4' THEN substr(split_part({_MODEL}, '_', 2), 2) END AS version, CASE WHEN o_orderpriority = '1-URGENT' THEN 'EXT' END AS extension FROM orders""",
)
def model_match(spark, sf):
    from rubrica.sources.messages import model_error

    m = F.expr(_MODEL)
    parts = model_parts(m)
    return load(spark, sf, "orders").select(
        "o_orderkey", model_error(m, "SHOP_V1").alias("error_message"), *[c.alias(n) for n, c in parts.items()]
    )


@register(
    "message_errors",
    """SELECT doc_id, CASE WHEN lang = 'de' THEN 'Payload is not a JSON object.' WHEN source = 'src1' THEN 'Provider is missing.' WHEN source = 'src2' THEN 'Data Source is missing.'
    WHEN source = 'src3' THEN 'Message ID is missing.' WHEN source = 'src4' THEN 'Invalid message model.' WHEN lang = 'es' THEN 'Root token not found' END AS error_message FROM documents""",
)
def message_errors(spark, sf):
    payload = F.expr(
        "CASE WHEN lang = 'de' THEN text WHEN lang = 'es' THEN to_json(named_struct('Documents', named_struct('t', text))) "
        "ELSE to_json(named_struct('DOCUMENT', named_struct('lines', array(named_struct('content', text))))) END"
    )
    src = F.col("source")
    msgs = load(spark, sf, "documents").select(
        "doc_id",
        F.when(src != "src1", src).alias("provider_id"),
        F.when(src == "src2", "").otherwise(F.col("lang")).alias("source_id"),
        F.when(src == "src3", " ").otherwise(F.col("doc_id").cast("string")).alias("message_id"),
        F.when(src == "src4", "TEXTS").otherwise("TEXTS_V1").alias("model_mnemonic"),
        payload.alias("payload"),
    )
    return check_messages(msgs, DOCS, DOCS.mnemonic).select("doc_id", "error_message")


@register(
    "batch_fan_out",
    """SELECT doc_id, CAST(i - 1 AS INT) AS batch_pos, CASE WHEN lang = 'en' THEN 'line ' || CAST(i AS VARCHAR) WHEN lang = 'fr' THEN CAST(doc_id AS VARCHAR) ELSE '' END AS message_id
    FROM (SELECT doc_id, lang, unnest(range(1, CASE WHEN lang = 'en' THEN len(string_split(text, chr(10))) ELSE 1 END + 1)) AS i FROM documents)""",
)
def batch_fan_out(spark, sf):
    """English documents are batches with one message per line, the others single messages."""
    payload = F.expr(
        "CASE WHEN lang = 'en' THEN to_json(transform(split(text, '\\n'), (x, i) -> named_struct('messageID', 'line ' || CAST(i + 1 AS STRING), 'content', x))) "
        "WHEN lang = 'fr' THEN to_json(named_struct('messageId', CAST(doc_id AS STRING), 'content', text)) ELSE to_json(named_struct('content', text)) END"
    )
    return fan_out(load(spark, sf, "documents").select("doc_id", payload.alias("payload"))).select("doc_id", "batch_pos", "message_id")


# --- lab rows -----------------------------------------------------------

_UNITS = "CASE event_type WHEN 'click' THEN 'mg' WHEN 'view' THEN 'parsec' ELSE '' END"
_ABNORMAL = "CASE WHEN event_type = 'error' THEN 'H' ELSE '' END"
_LOINC = "CASE WHEN event_type = 'signup' THEN '' ELSE CAST(user_id AS STRING) END"
_LOW = "CASE WHEN value > 10 THEN '1' ELSE '' END"
_HIGH = "CASE WHEN value > 20 THEN '9.5' ELSE '' END"
_RESULT = "CASE WHEN event_type = 'purchase' THEN 'many' ELSE CAST(value AS STRING) END"


def lab_rows(spark, sf):
    """Events as lab rows; the event key is the LOINC code."""
    given = {
        "UniqueID": "CAST(event_id AS STRING)", "LabChemTestName": "' ' || event_type", "LabChemResultValue": _RESULT,
        "LOINC": _LOINC, "Units": _UNITS, "Abnormal": _ABNORMAL, "RefHigh": _HIGH, "RefLow": _LOW,
    }
    cols = [F.expr(given.get(c, "CAST(NULL AS STRING)")).alias(c) for c in fixed.LAB_COLUMNS]
    rows = wide(load(spark, sf, "events")).select(*cols)
    return drop_blank(rows, list(fixed.LAB_COLUMNS))


_JSON_LAB = f"""'{{"messageId":"' || id || '","formatID":"","useCaseID":"","patient":{{"labResults":[{{"test":{{"codings":[' ||
 CASE WHEN loinc <> '' THEN '{{"code":"' || loinc || '","display":"' || event_type || '","system":"2.16.840.1.113883.6.1"}}' ELSE '' END || '],"text":"' || event_type || '"}},"referenceRange":{{' ||
 CASE WHEN low <> '' THEN '"lowValue":"' || low || '"' ELSE '' END || CASE WHEN low <> '' AND high <> '' THEN ',' ELSE '' END || CASE WHEN high <> '' THEN '"highValue":"' || high || '"' ELSE '' END ||
 '}},"resultValue":{{"text":"' || result || '","type":{{"text":"PQ"}}}},"resultUnit":{{"codings":[' || CASE WHEN units <> '' THEN '{{"code":"' || units || '","display":"' || units || '","system":"UCUM"}}' ELSE '' END ||
 '],"text":"' || units || '"}},"abnormalFlag":{{"codings":[' || CASE WHEN abn <> '' THEN '{{"code":"' || abn || '"}}' ELSE '' END || ']}},"interpretation":{{"codings":[{{"code":"' || CASE WHEN abn <> '' THEN abn ELSE 'N' END ||
 '","system":"2.16.840.1.113883.5.83"}}],"text":"' || CASE WHEN abn <> '' THEN abn ELSE 'N' END || '"}}}}],"id":"' || id || '"}},"dataSourceID":"lab","dataProviderID":"clinic","messageID":"' || id || '"}}'"""


@register(
    "duplicate_messages",
    """SELECT CAST(doc_id AS VARCHAR) || '#' || CAST(k AS VARCHAR) AS request_key, 'same' AS message_id, CAST(1 AS BIGINT) AS instance_count
    FROM documents, (VALUES (0), (1)) v(k)""",
)
def duplicate_messages(spark, sf):
    """Requests that all carry the same ids are scored one by one."""
    keys = ["request_key", "message_id"]
    twice = doc_messages(spark, sf).withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1))))
    requests = twice.withColumn("request_key", F.concat_ws("#", "message_id", "_k")).withColumn("message_id", F.lit("same"))
    checked = check_messages(requests.drop("_k"), DOCS, DOCS.mnemonic)
    rubric = doc_rubric()
    cards = message_cards(checked, rubric, keys)
    first = class_scores(cards, keys).filter(F.col("instance_count") == 1).select(*keys, "instance_count").distinct()
    return first


@register(
    "lab_to_message",
    f"""SELECT id AS message_id, 'PAT_CLINICAL_V1' AS model_mnemonic, {_JSON_LAB} AS payload FROM (
    SELECT CAST(event_id AS VARCHAR) AS id, event_type, {_RESULT} AS result, {_LOINC} AS loinc, {_UNITS} AS units, {_ABNORMAL} AS abn, {_LOW} AS low, {_HIGH} AS high FROM events)""",
)
def lab_to_message(spark, sf):
    return lab_messages(lab_rows(spark, sf), "clinic", "lab").select("message_id", "model_mnemonic", "payload")


def lab_context(spark, sf) -> EvalContext:
    """Parts are the known codes; promotional ones are inactive."""
    concepts = load(spark, sf, "part").select(
        F.lit("http://loinc.org").alias("system"), F.col("p_partkey").cast("string").alias("code"),
        (F.col("p_type") == "PROMO").alias("inactive"), F.lit(None).cast("string").alias("status"), F.array("p_name").alias("displays"),
    )
    lists = ValueLists({"UCUM": [("mg", "milligram")], "AbFlag": [("H", "High"), ("L", "Low")]})
    return EvalContext(as_of=AS_OF, code_systems=CodeSystems.bundled(), value_lists=lists, terminology=Terminology(concepts))


def lab_rubric(spark, sf):
    return compile_rubric(Rubric.bundled("Basic_VA_Lab"), clinical_model(), lab_context(spark, sf))


_LAB_N = "valid::INT + (event_type = 'click')::INT + (event_type <> 'signup')::INT + (event_type <> 'purchase')::INT"
_LAB_D = "7 + (event_type IN ('click', 'view'))::INT"
_LAB = """SELECT event_id, event_type, event_type <> 'signup' AND p_partkey IS NOT NULL AS valid, event_type <> 'signup' AND p_partkey IS NOT NULL AND p_type <> 'PROMO' AS active
    FROM events LEFT JOIN part ON user_id = p_partkey"""


@register(
    "lab_scores",
    f"""SELECT CAST(event_id AS VARCHAR) AS message_id, {_LAB_N} AS numerator, {_LAB_D} AS denominator, {_SCORE.format(n=f'({_LAB_N})', d=f'({_LAB_D})')} AS score,
    (NOT valid)::INT AS critical_failure_count, active::INT AS info_pass, 2 - active::INT AS info_fail, 14 - 2 - ({_LAB_D}) AS scoring_skip FROM ({_LAB})""",
)
def lab_scores(spark, sf):
    """Lab rows end to end: mapping, terminology, the bundled lab rubric, scores."""
    rubric = lab_rubric(spark, sf)
    checked = check_messages(lab_messages(lab_rows(spark, sf), "clinic", "lab"), rubric.model, rubric.rubric.model_mnemonic)
    cards = message_cards(checked, rubric, DOC_KEYS)
    return message_scores(cards, DOC_KEYS).select(
        "message_id", "numerator", "denominator", "score", "critical_failure_count", "info_pass", "info_fail", "scoring_skip"
    )


# --- audit and extraction -----------------------------------------------


@register(
    "audit_scores",
    f"""SELECT o_orderkey, entity, CAST(n AS BIGINT) AS numerator, CAST(d AS BIGINT) AS denominator, CAST(trunc(CASE WHEN d = 0 THEN 0 ELSE n::DOUBLE / d::DOUBLE * 100.0 END) AS INT) AS score, CAST(crit AS BIGINT) AS critical_failure_count FROM (
    SELECT o_orderkey, 'ORD_DATE' AS entity, c1 AS n, 1 AS d, 0 AS crit FROM ({ORDER_STATES})
    UNION ALL SELECT o_orderkey, 'ORD_STATUS', c2, 1, 1 - c2 FROM ({ORDER_STATES})
    UNION ALL SELECT o_orderkey, 'ORD_TOTAL', 1, 1, 0 FROM ({ORDER_STATES})
    UNION ALL SELECT o_orderkey, 'ORD_PRIORITY', 0, 0, 0 FROM ({ORDER_STATES})
    UNION ALL SELECT o_orderkey, 'ORDER', c1 + c2 + 1, 3, 1 - c2 FROM ({ORDER_STATES}))""",
)
def audit_scores(spark, sf):
    rows = table_results(order_source(spark, sf, "o_orderkey"), order_rubric())

    def shape(df, prefix, entity):
        return df.select(
            "o_orderkey", entity.alias("entity"),
            *[F.col(f"{prefix}_{c}").alias(c) for c in ("numerator", "denominator", "score", "critical_failure_count")],
        )

    a = shape(attribute_audit(rows, ["o_orderkey"]), "attribute", F.col("entity"))
    return a.unionByName(shape(element_audit(rows, ["o_orderkey"]), "element", F.col("class_mnemonic")))


CARDS = EntityModel(
    "CARDS_V1", "bank",
    (
        DataClass("ACCOUNTS", "accounts", (Attribute("ACC_SEGMENT", "segment", "CC"), Attribute("ACC_BALANCE", "balance", "ATR", "account balance")), "ONE", element="ACCOUNTS_ELM"),
        DataClass("LOANS", "loanRecords", (Attribute("LOA_SUM", "sum"),), element="LOANS_ELM"),
    ),
)
CARD_RULES = [
    criterion("ACC_BALANCE", "ATTR_ISPOSITIVENUMBER", 1, name="Balance is positive", failure_name="In debt"),
    criterion("ACC_SEGMENT", "CONCEPT_HASCODE", 2, name="Segment is coded", effect="Informational"),
]


def card_messages(spark, sf):
    segment = F.struct(
        F.array(F.struct(F.lit("seg").alias("system"), F.substring("c_mktsegment", 1, 2).alias("code"), F.col("c_mktsegment").alias("display"))).alias("codings")
    )
    account = F.struct(segment.alias("segment"), F.col("c_acctbal").cast("string").alias("Balance"))
    payload = F.to_json(F.struct(F.struct(account.alias("accounts")).alias("bank")))
    msgs = wide(load(spark, sf, "customer")).select(
        F.lit("bank").alias("provider_id"), F.lit("cards").alias("source_id"), F.col("c_custkey").cast("string").alias("message_id"),
        F.lit("CARDS_V1").alias("model_mnemonic"), payload.alias("payload"),
    )
    return check_messages(msgs, CARDS, CARDS.mnemonic)


_PASS = "CASE WHEN c_acctbal > 0 THEN '1' ELSE '0' END"
_FULL = "CASE WHEN c_acctbal > 0 THEN '100' ELSE '0' END"


@register(
    "audited_message",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS message_id, '{{"EntityModelMnemonic":"CARDS_V1","DataProviderID":"bank","DataSourceID":"cards","MessageID":"' || c_custkey ||
    '","Audit":{{"messageNumerator":"' || {_PASS} || '","messageDenominator":"1","messageScore":"' || {_FULL} || '","messageNumeratorWeighted":"' || {_PASS} || '","messageDenominatorWeighted":"1","messageScoreWeighted":"' || {_FULL} ||
    '","messageCriticalFailureCount":"0"}},"bank":{{"accounts":[{{"balance":{{"data":"' || CAST(c_acctbal AS VARCHAR) || '","attributeAudit":{{"scoringData":{{"attributeScore":"' || {_FULL} || '","attributeScoreWeighted":"' || {_FULL} ||
    '","attributeCriticalFailureCount":"0","attributeNumerator":"' || {_PASS} || '","attributeDenominator":"1"}},"assessmentItems":[{{"attributeMnemonic":"ACC_BALANCE","attributeName":"account balance","assessment":"Balance is positive","effect":"Scoring","status":"' ||
    CASE WHEN c_acctbal > 0 THEN 'Passed","reason":""' ELSE 'Failed","reason":"In debt"' END || '}}],"InformationalItems":[]}}}},"segment":{{"data":{{"codings":[{{"system":"seg","code":"' || substr(c_mktsegment, 1, 2) || '","display":"' || c_mktsegment || '"}}],"text":"' || c_mktsegment ||
    '"}},"attributeAudit":{{"scoringData":{{"attributeScore":"0","attributeScoreWeighted":"0","attributeCriticalFailureCount":"0","attributeNumerator":"0","attributeDenominator":"0"}},"assessmentItems":[],"InformationalItems":[{{"attributeMnemonic":"ACC_SEGMENT","attributeName":"segment","assessment":"Segment is coded","effect":"Informational","status":"Passed","reason":""}}]}}}},"elementAudit":{{"elementScore":"' || {_FULL} ||
    '","elementScoreWeighted":"' || {_FULL} || '","elementCriticalFailureCount":"0","elementNumerator":"' || {_PASS} || '","elementDenominator":"1"}}}}],"loanRecords":[]}}}}' AS audited_message FROM customer""",
)
def audited_message(spark, sf):
    rubric = compiled(CARD_RULES, EvalContext(as_of=AS_OF), CARDS)
    checked = card_messages(spark, sf)
    ev = evaluate_messages(checked, rubric, DOC_KEYS, all_attributes=True, keep=AUDIT_VALUES, store=True)
    scores = message_scores(message_scorecards(ev, rubric, DOC_KEYS), DOC_KEYS)
    return audited_messages(checked, ev, scores, rubric, DOC_KEYS)


@register(
    "scoring_response",
    """SELECT CAST(c_custkey AS VARCHAR) AS message_id, true AS succeeded, CASE WHEN c_acctbal > 0 THEN 100 ELSE 0 END AS score,
    'Accounts=1,Loan Records=0' AS classes, 'Accounts:segment/Segment is coded=1;Loan Records:' AS info,
    'bank/cards/' || CAST(c_custkey AS VARCHAR) || '/catalog' AS header FROM customer""",
)
def scoring_response_query(spark, sf):
    rubric = compiled(CARD_RULES, EvalContext(as_of=AS_OF), CARDS)
    checked = card_messages(spark, sf)
    ev = evaluate_messages(checked, rubric, DOC_KEYS, store=True)
    cards = message_scorecards(ev, rubric, DOC_KEYS)
    out = scoring_response(
        message_scores(cards, DOC_KEYS), class_scores(cards, DOC_KEYS, CARDS),
        informational(message_results(ev, rubric, DOC_KEYS), DOC_KEYS), DOC_KEYS, CARDS,
        messages=checked, rubric=rubric.rubric.name,
    )
    data = F.col("ScoringData")
    return out.select(
        "message_id",
        F.col("Succeeded").alias("succeeded"),
        data["MessageResults"]["Score"].alias("score"),
        F.array_join(F.transform(data["DataClassResults"], lambda c: F.concat_ws("=", c["DataClassName"], c["InstanceCount"].cast("string"))), ",").alias("classes"),
        F.array_join(
            F.transform(
                data["InformationalResults"],
                lambda c: F.concat(c["DataClassName"], F.lit(":"), F.array_join(F.transform(c["EvaluationList"], lambda e: F.concat(e["EntityName"], F.lit("/"), e["EvaluationName"], F.lit("="), e["Numerator"].cast("string"))), ",")),
            ),
            ";",
        ).alias("info"),
        F.concat_ws("/", *[data[c] for c in ("DataProviderID", "DataSourceID", "MessageID", "EvaluationRubric")]).alias("header"),
    )


@register(
    "assessments_direct",
    """SELECT CAST(c_custkey AS VARCHAR) AS message_id, 'ACCOUNTS' AS data_class, 'account balance' AS attribute_name, CAST(c_acctbal AS VARCHAR) AS attribute_value, 'Balance is positive' AS assessment,
    CASE WHEN c_acctbal > 0 THEN 'Passed' ELSE 'Failed' END AS status, CASE WHEN c_acctbal > 0 THEN '' ELSE 'In debt' END AS reason, 'Scoring' AS effect FROM customer""",
)
def assessments_direct(spark, sf):
    """Assessment records without going through the audited JSON."""
    rubric = compiled(CARD_RULES, EvalContext(as_of=AS_OF), CARDS)
    ev = evaluate_messages(card_messages(spark, sf), rubric, DOC_KEYS, keep=["v_text"])
    rows = message_results(ev, rubric, DOC_KEYS, ["v_text"])
    return assessments(rows, DOC_KEYS, F.col("v_text"))


@register(
    "assessment_extract",
    """SELECT p_partkey, 'Lab Results' AS data_class, CASE WHEN k = 1 THEN 'label' ELSE 'unnamed' END AS attribute_name,
    CASE WHEN k = 1 THEN p_name ELSE '{"size":' || CAST(p_size AS VARCHAR) || '}' END AS attribute_value, CASE WHEN k = 1 THEN 'a' ELSE 'b' END AS assessment, CASE WHEN p_size > 20 THEN 'Passed' ELSE 'Failed' END AS status, '' AS reason, CASE WHEN k = 1 THEN 'Scoring' ELSE '' END AS effect
    FROM (SELECT *, unnest([1, 2]) AS k FROM part WHERE p_type <> 'SMALL')""",
)
def assessment_extract(spark, sf):
    """Records from stored responses: JSON text or object, fallback property, malformed bodies."""
    body = F.expr(
        """named_struct('patient', named_struct('labResults', array(named_struct(
          'first', named_struct('data', p_name, 'attributeAudit', named_struct('assessmentItems', array(named_struct('attributeName', 'label', 'assessment', 'a', 'status', if(p_size > 20, 'Passed', 'Failed'), 'effect', 'Scoring')), 'InformationalItems', array(named_struct('assessment', 'never')))),
          'unnamed', named_struct('data', named_struct('size', p_size), 'attributeAudit', named_struct('assessmentItems', array(named_struct('assessment', 'b', 'status', if(p_size > 20, 'Passed', 'Failed'))))),
          'elementAudit', named_struct('elementScore', '1'))), 'unknownClass', array(1)))"""
    )
    text = (
        F.when(F.col("p_type") == "SMALL", F.concat(F.lit("{"), F.col("p_name")))
        .when(F.col("p_type") == "PROMO", F.to_json(F.struct(F.to_json(body).alias("messageData"))))
        .when(F.col("p_type") == "LARGE", F.to_json(F.struct(body.alias("auditedMessage"))))
        .otherwise(F.to_json(F.struct(F.to_json(body).alias("auditedMessage"), F.lit("no").alias("messageData"))))
    )
    return extract_assessments(load(spark, sf, "part").select("p_partkey", text.alias("response")), ["p_partkey"])


@register(
    "audited_element_order",
    """SELECT CAST(doc_id AS VARCHAR) AS message_id, len(l) AS elements, md5(array_to_string(l, '|')) AS texts
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
)
def audited_element_order(spark, sf):
    """The elements of an audited message keep their order, however many there are."""
    rubric, checked = doc_rubric(), checked_docs(spark, sf)
    ev = evaluate_messages(checked, rubric, DOC_KEYS, all_attributes=True, keep=AUDIT_VALUES, store=True)
    scores = message_scores(message_scorecards(ev, rubric, DOC_KEYS), DOC_KEYS)
    audited = audited_messages(checked, ev, scores, rubric, DOC_KEYS)
    texts = F.from_json("audited_message", "document struct<lines:array<struct<content:struct<data:string>>>>")["document"]["lines"]["content"]["data"]
    return audited.select("message_id", F.size(texts).cast("bigint").alias("elements"), F.md5(F.array_join(texts, "|").cast("binary")).alias("texts"))
