"""Scalar functions and value parsing."""

from pyspark.sql import functions as F

from rubrica.catalog.check_queries import DATE, NUMBER, SQL_FLOAT, SQL_INT
from rubrica.catalog.registry import load, register
from rubrica.functions import text as tx
from rubrica.functions.scores import score32, score64
from rubrica.functions.values import concept_state, data_json, parse_values, parsed_item


@register(
    "fn_split_list",
    r"""SELECT page_id, len(p) AS parts, p[1] AS first_part, p[len(p)] AS last_part FROM (
    SELECT page_id, CASE WHEN len(pipe) >= 2 THEN pipe ELSE comma END AS p FROM (
      SELECT page_id, CASE WHEN trim(string_split(t, '|')[-1]) = '' THEN string_split(t, '|')[1:-2] ELSE string_split(t, '|') END AS pipe,
        CASE WHEN trim(string_split(t, ',')[-1]) = '' THEN string_split(t, ',')[1:-2] ELSE string_split(t, ',') END AS comma
      FROM (SELECT page_id, CASE WHEN contains(url, '?') THEN replace(url, '/', '|') || '| ' ELSE replace(url, '/', ',') || ',' END AS t FROM pages)))""",
)
def fn_split_list(spark, sf):
    t = F.expr("CASE WHEN contains(url, '?') THEN replace(url, '/', '|') || '| ' ELSE replace(url, '/', ',') || ',' END")
    p = tx.split_list_col(t)
    return load(spark, sf, "pages").select(
        "page_id", F.size(p).cast("bigint").alias("parts"), F.get(p, 0).alias("first_part"), F.element_at(p, -1).alias("last_part")
    )


@register(
    "fn_similarity",
    """SELECT c_custkey, levenshtein(a, b) AS distance, 100 - CAST(trunc(levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) * 100.0) AS INT) AS score
    FROM (SELECT c_custkey, c_name AS a, 'customer ' || c_mktsegment AS b FROM customer)""",
)
def fn_similarity(spark, sf):
    a, b = F.col("c_name"), F.concat(F.lit("customer "), F.col("c_mktsegment"))
    return load(spark, sf, "customer").select("c_custkey", tx.edit_distance(a, b).cast("bigint").alias("distance"), tx.similarity(a, b).alias("score"))


@register(
    "fn_parse_numbers",
    f"""SELECT as_int, as_float, count(*) AS n FROM (SELECT CASE WHEN {SQL_INT} THEN TRY_CAST(trim(t) AS INT) END AS as_int, CASE WHEN {SQL_FLOAT} THEN TRY_CAST(replace(trim(t), ',', '') AS DOUBLE) END AS as_float
    FROM (SELECT {NUMBER} AS t FROM lineitem)) GROUP BY ALL""",
)
def fn_parse_numbers(spark, sf):
    df = load(spark, sf, "lineitem").select(F.expr(NUMBER).alias("t"))
    return df.groupBy(tx.parse_int(F.col("t")).alias("as_int"), tx.parse_double(F.col("t")).alias("as_float")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "fn_parse_datetime",
    """SELECT o_orderkey, strftime(CASE o_orderpriority WHEN '1-URGENT' THEN o_orderdate WHEN '2-HIGH' THEN o_orderdate WHEN '3-MEDIUM' THEN o_orderdate + INTERVAL 510 MINUTE END, '%Y-%m-%d %H:%M:%S') AS parsed,
    o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS is_date FROM orders""",
)
def fn_parse_datetime(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", F.expr(DATE).alias("t"))
    ts = tx.nullable_date(F.col("t"))
    return df.select("o_orderkey", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("parsed"), F.coalesce(tx.is_datetime(F.col("t")), F.lit(False)).alias("is_date"))


_COMPACT = "CASE event_type WHEN 'click' THEN replace(replace(replace(substr(CAST(ts AS STRING), 1, 19), '-', ''), ':', ''), ' ', '') WHEN 'view' THEN replace(replace(replace(substr(CAST(ts AS STRING), 1, 16), '-', ''), ':', ''), ' ', '') WHEN 'error' THEN '01-' || substr(CAST(ts AS STRING), 9, 2) || '-2024' ELSE 'x' || CAST(ts AS STRING) END"


@register("fn_is_datetime", "SELECT event_id, event_type IN ('click', 'view', 'error') AS is_date FROM events")
def fn_is_datetime(spark, sf):
    return load(spark, sf, "events").select("event_id", F.coalesce(tx.is_datetime(F.expr(_COMPACT)), F.lit(False)).alias("is_date"))


@register(
    "fn_parse_boolean",
    "SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN true WHEN p_type IN ('PROMO', 'MEDIUM') THEN false END AS flag FROM part",
)
def fn_parse_boolean(spark, sf):
    word = F.expr("CASE p_type WHEN 'SMALL' THEN 'yes' WHEN 'LARGE' THEN '1' WHEN 'PROMO' THEN 'f' WHEN 'MEDIUM' THEN 'No' WHEN 'ECONOMY' THEN 'maybe' END")
    return load(spark, sf, "part").select("p_partkey", tx.parse_boolean(word).alias("flag"))


@register(
    "fn_json_values",
    """SELECT event_id, CAST(props->>'$.k' AS VARCHAR) AS first_value, CASE WHEN event_type = 'view' THEN 2 ELSE 1 END AS n_values, ' ' || event_type <> event_type AS trimmed FROM events""",
)
def fn_json_values(spark, sf):
    df = load(spark, sf, "events").withColumn(
        "props", F.when(F.col("event_type") == "view", F.regexp_replace("props", r"\}$", ', "z": "more"}')).otherwise(F.col("props"))
    )
    return df.select(
        "event_id",
        tx.json_first(F.col("props"), "$.missing", "$.k", "$.z").alias("first_value"),
        F.size(tx.json_all(F.col("props"), "$.k", "$.z", "$.missing")).cast("bigint").alias("n_values"),
        (tx.cell(F.concat(F.lit(" "), F.col("event_type"))) == F.col("event_type")).alias("trimmed"),
    )


@register(
    "fn_class_names",
    "SELECT p_partkey, upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS shown FROM part",
)
def fn_class_names(spark, sf):
    """Part names written as one camel-case word, then spaced again."""
    camel = F.concat(F.split("p_name", " ")[0], F.initcap(F.split("p_name", " ")[1]))
    return load(spark, sf, "part").select("p_partkey", tx.class_display_name(camel).alias("shown"))


@register(
    "fn_scores",
    """SELECT l_quantity, p_size, CAST(trunc(CAST(a AS FLOAT) / CAST(b AS FLOAT) * CAST(100 AS FLOAT)) AS INT) AS float_score, CAST(trunc(a::DOUBLE / b::DOUBLE * 100.0) AS INT) AS double_score, count(*) AS n
    FROM (SELECT CAST(l_quantity AS INT) AS l_quantity, p_size, least(CAST(l_quantity AS INT), p_size) AS a, greatest(CAST(l_quantity AS INT), p_size) AS b FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL""",
)
def fn_scores(spark, sf):
    """Truncated scores in 32-bit and 64-bit arithmetic; 29 of 50 gives 58 and 57."""
    q = F.col("l_quantity").cast("int")
    df = load(spark, sf, "lineitem").join(load(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    a, b = F.least(q, F.col("p_size")), F.greatest(q, F.col("p_size"))
    return df.groupBy(q.alias("l_quantity"), "p_size", score32(a, b).alias("float_score"), score64(a, b).alias("double_score")).agg(F.count(F.lit(1)).alias("n"))


# --- value parsing ------------------------------------------------------


def _items(spark, sf):
    """Customers as raw JSON attribute values of every kind."""
    coded = "named_struct('system', 'seg', 'code', substr(c_mktsegment, 1, 2), 'display', c_mktsegment)"
    raw = F.expr(
        f"""CASE c_mktsegment
        WHEN 'BUILDING' THEN c_name
        WHEN 'AUTOMOBILE' THEN to_json(named_struct('codings', array({coded}, named_struct('system', CAST(NULL AS STRING), 'code', 'plain', 'display', CAST(NULL AS STRING)))))
        WHEN 'MACHINERY' THEN to_json(named_struct('text', c_name, 'codings', array(named_struct('system-id', 'sid', 'code', c_mktsegment)), 'type', named_struct('text', 'NM', 'codings', array(named_struct('system', 'types', 'code', 'NM')))))
        WHEN 'FURNITURE' THEN to_json(named_struct('label', c_name, 'more', 1))
        ELSE to_json(named_struct('text', CAST(c_nationkey AS STRING) || '^' || CAST(c_nationkey + 1 AS STRING), 'type', named_struct('text', 'NR'), 'lowValue', CAST(c_nationkey AS STRING), 'HighValue', '9')) END"""
    )
    kind = F.explode(F.array(F.lit("ATR"), F.lit("CC"), F.lit("OBSVAL"), F.lit("RV")))
    return load(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.lit(True).alias("present"), raw.alias("raw"), kind.alias("kind"))


@register(
    "parse_concepts",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN c_name WHEN 'AUTOMOBILE' THEN c_mktsegment WHEN 'MACHINERY' THEN c_name WHEN 'FURNITURE' THEN c_name ELSE c_nationkey || '^' || (c_nationkey + 1) END AS text,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'seg:AU:AUTOMOBILE,:plain:AUTOMOBILE' WHEN 'MACHINERY' THEN 'sid:MACHINERY:' || c_name END AS codings,
    CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'Both' ELSE 'TextOnly' END AS concept_state FROM customer""",
)
def parse_concepts(spark, sf):
    df = parse_values(_items(spark, sf)).filter("kind = 'CC'")
    shown = F.array_join(
        F.transform("v_codings", lambda c: F.concat(F.coalesce(c["system"], F.lit("")), F.lit(":"), c["code"], F.lit(":"), c["display"])), ","
    )
    return df.select("c_custkey", F.col("v_text").alias("text"), shown.alias("codings"), concept_state(F.col("v_text"), F.col("v_codings")).alias("concept_state"))


@register(
    "parse_observations",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'NM' WHEN 'HOUSEHOLD' THEN 'NR' ELSE 'ST' END AS type_code, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN c_nationkey::DOUBLE END AS number,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN c_nationkey::DOUBLE + 1 END AS number2 FROM customer""",
)
def parse_observations(spark, sf):
    df = parse_values(_items(spark, sf)).filter("kind = 'OBSVAL'")
    return df.select("c_custkey", F.col("v_type_code").alias("type_code"), F.col("v_number").alias("number"), F.col("v_number2").alias("number2"))


@register(
    "parse_ranges",
    "SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN CAST(c_nationkey AS VARCHAR) END AS low, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN '9' END AS high FROM customer",
)
def parse_ranges(spark, sf):
    df = parse_values(_items(spark, sf)).filter("kind = 'RV'")
    return df.select("c_custkey", F.col("v_low").alias("low"), F.col("v_high").alias("high"))


@register(
    "value_json",
    """SELECT c_custkey, kind, CASE kind WHEN 'ATR' THEN '"' || replace(CASE seg WHEN 'BUILDING' THEN c_name
          WHEN 'AUTOMOBILE' THEN '{"codings":[{"system":"seg","code":"AU","display":"AUTOMOBILE"},{"code":"plain"}]}'
          WHEN 'MACHINERY' THEN '{"text":"' || c_name || '","codings":[{"system-id":"sid","code":"MACHINERY"}],"type":{"text":"NM","codings":[{"system":"types","code":"NM"}]}}'
          WHEN 'FURNITURE' THEN '{"label":"' || c_name || '","more":1}'
          ELSE '{"text":"' || label || '","type":{"text":"NR"},"lowValue":"' || c_nationkey || '","HighValue":"9"}' END, '"', chr(92) || '"') || '"'
      WHEN 'RV' THEN '{"text":"' || label || '","lowValue":' || CASE WHEN seg = 'HOUSEHOLD' THEN '"' || c_nationkey || '","highValue":"9"}' ELSE 'null,"highValue":null}' END
      WHEN 'OBSVAL' THEN '{"text":"' || label || '"' || CASE seg WHEN 'MACHINERY' THEN ',"type":{"codings":[{"system":"types","code":"NM","display":"NM"}],"text":"NM"}' WHEN 'HOUSEHOLD' THEN ',"type":{"text":"NR"}' ELSE '' END || '}'
      ELSE CASE seg WHEN 'MACHINERY' THEN '{"codings":[{"system":"sid","code":"MACHINERY","display":"' || c_name || '"}],"text":"' || c_name || '"}'
        WHEN 'AUTOMOBILE' THEN '{"codings":[{"system":"seg","code":"AU","display":"AUTOMOBILE"},{"system":null,"code":"plain","display":"AUTOMOBILE"}],"text":"AUTOMOBILE"}'
        ELSE '{"text":"' || label || '"}' END END AS data
    FROM (SELECT *, c_mktsegment AS seg, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN c_nationkey || '^' || (c_nationkey + 1)
        WHEN 'AUTOMOBILE' THEN CASE WHEN kind IN ('CC', 'OBSVAL') THEN 'AUTOMOBILE' ELSE '' END
        WHEN 'FURNITURE' THEN CASE WHEN kind = 'RV' THEN '' ELSE c_name END
        WHEN 'BUILDING' THEN c_name ELSE c_name END AS label
      FROM customer, (VALUES ('ATR'), ('CC'), ('OBSVAL'), ('RV')) k(kind))""",
)
def value_json(spark, sf):
    """Values of every kind written back as JSON, nulls included."""
    df = parse_values(_items(spark, sf))
    return df.select("c_custkey", "kind", data_json(parsed_item(), F.col("v_type"), F.col("v_type_text")).alias("data"))
