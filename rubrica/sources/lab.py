"""Lab sheets: 22 positional text columns, one row per result, one message per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.functions.text import cell
from rubrica.sources import fixed
from rubrica.sources.numbering import NUMBER, numbered


def read_lab_sheet(spark: SparkSession, path: str, sep: str = ",", header: bool = True, start_row: int = 1) -> DataFrame:
    """CSV or tab-separated sheet of one or more files; missing cells are empty, blank rows are dropped.
    ``start_row`` is the first data row to read, counted from 1 over the files in the order of their paths."""
    schema = ", ".join(f"`{c}` string" for c in fixed.LAB_COLUMNS)
    df = spark.read.csv(path, sep=sep, header=header, schema=schema, enforceSchema=True)
    if start_row > 1:
        df = numbered(df).filter(F.col(NUMBER) >= start_row).select(*fixed.LAB_COLUMNS)
    return drop_blank(df.na.fill(""), list(fixed.LAB_COLUMNS))


def drop_blank(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with at least one non-blank cell."""
    return df.filter(reduce(lambda a, b: a | b, [cell(F.col(c)) != "" for c in columns]))


def lab_payload(provider: Column, source: Column) -> Column:
    """Message payload (JSON text) of one lab row."""
    v = {c: cell(F.col(c)) for c in fixed.LAB_COLUMNS}

    def has(name: str) -> Column:
        return v[name] != ""

    none = F.lit(None).cast("string")
    coding_type = "array<struct<code:string,display:string,system:string>>"
    no_codings = F.array().cast(coding_type)

    def one(code: Column, display: Column, system: Column) -> Column:
        return F.array(F.struct(code.alias("code"), display.alias("display"), system.alias("system")))

    loinc = one(v["LOINC"], v["LabChemTestName"], F.lit(fixed.LOINC_OID))
    unit = one(v["Units"], v["Units"], F.lit(fixed.UNIT_SYSTEM))
    flag = one(v["Abnormal"], none, none)
    reading = F.when(has("Abnormal"), v["Abnormal"]).otherwise(F.lit(fixed.DEFAULT_INTERPRETATION))
    result = F.struct(
        F.struct(
            F.when(has("LOINC"), loinc).otherwise(no_codings).alias("codings"),
            v["LabChemTestName"].alias("text"),
        ).alias("test"),
        F.struct(
            F.when(has("RefLow"), v["RefLow"]).alias("lowValue"),
            F.when(has("RefHigh"), v["RefHigh"]).alias("highValue"),
        ).alias("referenceRange"),
        F.struct(
            v["LabChemResultValue"].alias("text"),
            F.struct(F.lit(fixed.LAB_VALUE_TYPE).alias("text")).alias("type"),
        ).alias("resultValue"),
        F.struct(
            F.when(has("Units"), unit).otherwise(no_codings).alias("codings"),
            v["Units"].alias("text"),
        ).alias("resultUnit"),
        F.struct(F.when(has("Abnormal"), flag).otherwise(no_codings).alias("codings")).alias("abnormalFlag"),
        F.struct(
            one(reading, none, F.lit(fixed.INTERPRETATION_OID)).alias("codings"), reading.alias("text")
        ).alias("interpretation"),
    )
    return F.to_json(
        F.struct(
            v["UniqueID"].alias("messageId"),
            F.lit("").alias("formatID"),
            F.lit("").alias("useCaseID"),
            F.struct(F.array(result).alias("labResults"), v["UniqueID"].alias("id")).alias("patient"),
            source.alias("dataSourceID"),
            provider.alias("dataProviderID"),
            v["UniqueID"].alias("messageID"),
        )
    )


def lab_messages(
    rows: DataFrame,
    provider_id: str,
    source_id: str,
    model_mnemonic: str = fixed.CLINICAL_MODEL_MNEMONIC,
    rubric_mnemonic: str = "Basic_VA_Lab",
    carry: list[str] = (),
) -> DataFrame:
    """Lab rows as message rows."""
    return rows.select(
        *carry,
        F.lit(provider_id).alias("provider_id"),
        F.lit(source_id).alias("source_id"),
        cell(F.col("UniqueID")).alias("message_id"),
        F.lit(model_mnemonic).alias("model_mnemonic"),
        F.lit(rubric_mnemonic).alias("rubric_mnemonic"),
        lab_payload(F.lit(provider_id), F.lit(source_id)).alias("payload"),
    )
