"""Query registry and the entity model of the provided tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.functions.values import Item
from rubrica.operators.evaluate import TableSource, table_results
from rubrica.plans.context import EvalContext
from rubrica.plans.rubric import CompiledRubric, Criterion, Rubric, compile_rubric
from rubrica.sources.model import Attribute, DataClass, EntityModel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODEL = EntityModel(
    "SHOP_V1",
    "shop",
    (
        DataClass(
            "CUSTOMER", "customers",
            (
                Attribute("CUS_NUMBER", "number"),
                Attribute("CUS_SEGMENT", "segment"),
                Attribute("CUS_BALANCE", "balance"),
                Attribute("CUS_NATION", "nation", "CC"),
                Attribute("CUS_LABEL", "label", "CC"),
            ),
            element="CUSTOMER_ELM",
        ),
        DataClass(
            "ORDER", "orders",
            (
                Attribute("ORD_STATUS", "status"),
                Attribute("ORD_PRIORITY", "priority"),
                Attribute("ORD_DATE", "date"),
                Attribute("ORD_TOTAL", "total"),
                Attribute("ORD_CUSTOMER", "customer", "CC"),
            ),
            element="ORDER_ELM",
        ),
        DataClass(
            "LINE", "lines",
            (
                Attribute("LIN_NUMBER", "number"),
                Attribute("LIN_FLAG", "flag"),
                Attribute("LIN_STATUS", "status"),
                Attribute("LIN_TAX", "tax"),
                Attribute("LIN_DISCOUNT", "discount"),
                Attribute("LIN_SHIP", "shipDate"),
                Attribute("LIN_PART", "part", "CC"),
            ),
            element="LINE_ELM",
        ),
        DataClass(
            "PART", "parts",
            (
                Attribute("PRT_NAME", "name"),
                Attribute("PRT_CONCEPT", "concept", "CC"),
                Attribute("PRT_PRICE", "price", "OBSVAL"),
                Attribute("PRT_RANGE", "range", "RV"),
            ),
            element="PART_ELM",
        ),
        DataClass(
            "EVENT", "events",
            (
                Attribute("EVT_TYPE", "type"),
                Attribute("EVT_TIME", "time"),
                Attribute("EVT_VALUE", "value", "OBSVAL"),
                Attribute("EVT_KEY", "key"),
                Attribute("EVT_CODE", "code", "CC"),
            ),
            element="EVENT_ELM",
        ),
        DataClass(
            "TEXT", "texts",
            (
                Attribute("TXT_LANG", "lang"),
                Attribute("TXT_SOURCE", "source"),
                Attribute("TXT_BODY", "body"),
                Attribute("TXT_SIZE", "size"),
            ),
            element="TEXT_ELM",
        ),
    ),
)


def register(name: str, sql: str | None = None):
    """Register a query with its SQL; without SQL only the row count is checked."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_items(**exprs: str) -> dict[str, Item]:
    """Plain attributes from SQL expressions; a NULL value is a missing attribute."""
    return {k: Item.of_text(F.expr(v).cast("string")) for k, v in exprs.items()}


def criterion(entity: str, check: str, sequence: int = 1, **spec) -> Criterion:
    """Criterion with parameters given as ``params={mnemonic: value}``; the names the
    library declares are filled in."""
    from rubrica.plans.checks import CheckLibrary

    def bound(chk: str | None, given: dict | None):
        if not given:
            return ()
        declared = {p.mnemonic: p.name for p in CheckLibrary().get(chk).params}
        return tuple((m, v, declared.get(m)) for m, v in given.items())

    params = spec.pop("params", None)
    cond_params = spec.pop("conditional_params", None)
    return Criterion(
        sequence,
        entity,
        check,
        params=bound(check, params),
        conditional_params=bound(spec.get("conditional"), cond_params),
        **spec,
    )


def compiled(criteria: list[Criterion], ctx: EvalContext | None = None, model: EntityModel = MODEL) -> CompiledRubric:
    return compile_rubric(
        Rubric("CATALOG", tuple(criteria), "catalog", model.mnemonic), model, ctx or EvalContext()
    )


def states(
    df: DataFrame,
    cls: str,
    keys: list[str],
    items: dict[str, Item],
    criteria: list[Criterion],
    ctx: EvalContext | None = None,
) -> DataFrame:
    """Result rows of a rubric over one table."""
    return table_results(TableSource(df, cls, keys, items), compiled(criteria, ctx))


def by_key(rows: DataFrame, *keys: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return rows.select(*keys, *extra, "state", "fail_check", "reason")


def tally(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "state", "fail_check").agg(F.count(F.lit(1)).alias("n"))
