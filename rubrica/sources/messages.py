"""Message source: requests, batch payloads, header resolution, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.functions.text import blank_to_null, is_blank, map_get_ignore_case, nullable_date
from rubrica.sources import fixed
from rubrica.sources.model import EntityModel
from rubrica.sources.numbering import FILE, ROW, numbered
from rubrica.sources.payload import HEADER, OBJECT_TYPE, parsed_payload, readable

MESSAGE_SCHEMA = (
    "provider_id string, source_id string, message_id string, "
    "model_mnemonic string, rubric_mnemonic string, payload string"
)
MESSAGE_KEYS = ("provider_id", "source_id", "message_id")


def read_requests(spark: SparkSession, path: str, fmt: str = "json", model_property: str = fixed.MODEL_PROPERTY) -> DataFrame:
    """Requests as message rows.

    JSON lines carry the request properties, whose names are compared whole, ignoring case, the
    first one wins; ``model_property`` names the one that holds the model.  Parquet already has the
    columns of MESSAGE_SCHEMA.  Each request is a message of its own, whatever its ids: ``request_key``
    names it.
    """
    if fmt == "parquet":
        return with_request_key(spark.read.parquet(path))
    m = F.from_json("value", OBJECT_TYPE)

    def named(name: str) -> Column:
        return map_get_ignore_case(F.col("m"), name)

    rows = with_request_key(spark.read.text(path)).filter(F.trim("value") != "")
    return rows.select(m.alias("m"), "request_key").select(
        named("DataProviderID").alias("provider_id"),
        named("DataSourceID").alias("source_id"),
        named("MessageID").alias("message_id"),
        named(model_property).alias("model_mnemonic"),
        named("EvaluationRubricMnemonic").alias("rubric_mnemonic"),
        named("MessageData").alias("payload"),
        "request_key",
    )


def with_request_key(df: DataFrame) -> DataFrame:
    """Rows read from files with ``request_key``: the file's path and the row's number in it, so two
    requests with the same ids stay two, and a later run gives the same keys."""
    if "request_key" in df.columns:
        return df
    rows = numbered(df)
    return rows.select(*df.columns, F.concat_ws("#", FILE, F.col(ROW).cast("string")).alias("request_key"))


def widen(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Spread rows over ``partitions`` tasks, when the caller asks for it: a few files that cannot
    be split, with heavy work per row.  By default the layout of the files decides."""
    return df if partitions is None else df.repartition(partitions)


def fan_out(batches: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per message of a batch payload: an array fans out, an object is one
    message.  Adds ``batch_pos`` and ``message_id`` read from the message; a
    ``request_key`` gets the position appended."""
    is_array = F.substring(F.ltrim(F.col(payload)), 1, 1) == "["
    parts = F.when(is_array, F.from_json(payload, "array<string>")).otherwise(F.array(payload))
    others = [c for c in batches.columns if c not in (payload, "message_id", "batch_pos")]
    out = batches.select(*others, F.posexplode(parts).alias("batch_pos", payload)).withColumn(
        "message_id",
        F.coalesce(
            F.get_json_object(payload, "$.messageID"),
            F.get_json_object(payload, "$.messageId"),
            F.lit(""),
        ),
    )
    if "request_key" in out.columns:
        out = out.withColumn("request_key", F.concat_ws("#", "request_key", "batch_pos"))
    return out


def header_value(original: Column, default: Column | None = None, override: Column | None = None) -> Column:
    """Override, else original, else default; blank counts as missing."""
    parts = [blank_to_null(c) for c in (override, original, default) if c is not None]
    return F.coalesce(*parts)


def header_state(
    original: Column, default: Column | None = None, override: Column | None = None, is_date: bool = False
) -> Column:
    """Where a header value came from.  A date reports an override as Original."""
    col = F
    if override is not None:
        col = col.when(~is_blank(override), "Original" if is_date else "Overridden")
    col = col.when(~is_blank(original), "Original")
    if default is not None:
        col = col.when(~is_blank(default), "Default")
    return col.otherwise("None")


def resolve_header(
    messages: DataFrame,
    defaults: dict[str, Column] | None = None,
    overrides: dict[str, Column] | None = None,
    model: EntityModel | None = None,
) -> DataFrame:
    """Add header columns: request over payload for the ids, payload over request
    for the model.

    With a model the payload is parsed once, into ``_typed`` (see ``sources.payload``); ``_is_typed``
    tells whether that says everything, and only otherwise ``_payload`` holds its properties as a map.
    Without one all payloads are maps.
    """
    defaults, overrides = defaults or {}, overrides or {}
    typed = None if model is None else parsed_payload(F.col("payload"), model)
    if typed is None:
        df = messages.withColumn("_payload", F.from_json("payload", OBJECT_TYPE))
    else:
        df = messages.withColumn("_typed", typed).withColumn("_is_typed", readable(F.col("_typed"), F.col("payload"), model))
        df = df.withColumn("_payload", F.when(~F.col("_is_typed"), F.from_json("payload", OBJECT_TYPE)))
    found = {h: F.try_element_at(F.col("_payload"), F.lit(h)) for h in HEADER}
    if typed is not None:
        found = {h: F.when(F.col("_is_typed"), F.col("_typed")[h]).otherwise(c) for h, c in found.items()}

    originals = {
        "entity_model": F.coalesce(found["EntityModel"], F.col("model_mnemonic")),
        "provider": F.coalesce(F.col("provider_id"), found["DataProviderID"]),
        "data_source": F.coalesce(F.col("source_id"), found["DataSourceID"]),
        "client_message_id": F.coalesce(F.col("message_id"), found["MessageID"]),
    }
    cols: dict[str, Column] = {}
    for name, original in originals.items():
        cols[name] = header_value(original, defaults.get(name), overrides.get(name))
        cols[f"{name}_state"] = header_state(original, defaults.get(name), overrides.get(name))
    date = (found["TransactionDate"], defaults.get("transaction_date"), overrides.get("transaction_date"))
    cols["transaction_date"] = nullable_date(header_value(*date))
    cols["transaction_date_state"] = header_state(*date, is_date=True)
    return df.withColumns(cols)


def model_parts(mnemonic: Column) -> dict[str, Column]:
    """Family, version and extension of a model mnemonic such as ``NAME_V1_EXT``."""
    return {
        part: blank_to_null(F.regexp_extract(mnemonic, fixed.MODEL_PATTERN, i))
        for i, part in enumerate(("family", "version", "extension"), start=1)
    }


def model_error(mnemonic: Column, rubric_model: str) -> Column:
    """Why a message model does not fit a rubric model; NULL when it does.
    Only the family is compared, ignoring case."""
    ours = F.lit(rubric_model)
    family = F.regexp_extract(mnemonic, fixed.MODEL_PATTERN, 1)
    wanted = F.regexp_extract(ours, fixed.MODEL_PATTERN, 1)
    return (
        F.when(is_blank(mnemonic), fixed.ERR_NO_MODEL)
        .when(~mnemonic.rlike(fixed.MODEL_PATTERN), fixed.ERR_BAD_MODEL)
        .when(~ours.rlike(fixed.MODEL_PATTERN), fixed.ERR_BAD_RUBRIC_MODEL)
        .when(F.lower(family) != F.lower(wanted), fixed.ERR_MODEL_MISMATCH)
    )


def root_token(payload: Column, model: EntityModel) -> Column:
    """Raw JSON of the root property, found ignoring case."""
    return map_get_ignore_case(payload, model.root_field)


def check_messages(messages: DataFrame, model: EntityModel, rubric_model: str) -> DataFrame:
    """Add header columns, the parsed payload and ``error_message`` (NULL when the message
    can be scored).  Errors are reported in the order the steps run.  ``root_raw`` is the root's
    text for messages that the typed schema does not fit."""
    df = resolve_header(messages, model=model)
    typed = F.col("_is_typed") if "_is_typed" in df.columns else F.lit(False)
    df = df.withColumn("root_raw", root_token(F.col("_payload"), model))
    error = (
        F.when(~typed & F.col("_payload").isNull(), fixed.ERR_PAYLOAD)
        .when(F.col("provider").isNull(), fixed.ERR_PROVIDER)
        .when(F.col("data_source").isNull(), fixed.ERR_SOURCE)
        .when(F.col("client_message_id").isNull(), fixed.ERR_MESSAGE_ID)
        .when(model_error(F.col("model_mnemonic"), rubric_model).isNotNull(), model_error(F.col("model_mnemonic"), rubric_model))
        .when(~typed & F.col("root_raw").isNull(), fixed.ERR_ROOT)
    )
    return df.withColumn("error_message", error)
