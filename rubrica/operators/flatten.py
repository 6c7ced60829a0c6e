"""Messages to items: one narrow pass, no shuffle.

A message yields a root item, one class item per model class (present or
not), one element item per element, and one attribute item per attribute
the model declares for an element that exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.sources.model import EntityModel
from rubrica.sources.payload import OBJECT_TYPE, typed_elements

ITEM_COLUMNS = (
    "level",
    "class_mnemonic",
    "element",
    "element_seq",
    "entity",
    "name",
    "kind",
    "present",
    "raw",
)


def _class_list(model: EntityModel, typed: bool) -> Column:
    """The classes of the model with their elements or their raw text; the first entry is the root."""

    def entry(mnemonic, one: bool, elements: Column | None, raw: Column | None) -> Column:
        none = F.lit(None)
        return F.struct(
            F.lit(mnemonic).cast("string").alias("m"),
            F.lit(one).alias("one"),
            (none if elements is None else elements).cast(f"array<{OBJECT_TYPE}>").alias("t"),
            (none if raw is None else raw).cast("string").alias("r"),
            (F.col("_is_typed") if typed else F.lit(False)).alias("fits"),
        )

    root = F.col("_typed")[model.root_field] if typed else None
    return F.array(
        entry(None, True, None, None),
        *[
            entry(
                c.mnemonic, c.cardinality == "ONE", typed_elements(root, c) if typed else None,
                F.coalesce(F.try_element_at("_root", F.lit(c.field)), F.try_element_at("_root", F.lit(c.label))),
            )
            for c in model.classes
        ],
    )


def elements(
    messages: DataFrame,
    model: EntityModel,
    keys: list[str],
    carry: list[str] = (),
    always: set[str] | None = None,
) -> DataFrame:
    """Keys, class_mnemonic, element_seq and the element's properties as a raw map.

    ``element_seq`` 0 is the class itself; class_mnemonic NULL is the root.
    ``always`` names the classes to list even when a message does not have them;
    None lists every class.  ``class_present`` tells which it was.
    A class of cardinality ONE is one element even when it is not an object;
    any other class must be an array, and what is no array has no elements.
    Messages with an ``error_message`` give no rows (see ``check_messages``).  The classes come
    typed with the payload; only where its schema does not fit are they read from ``root_raw``.
    """
    keep = [*keys, *carry]
    typed = "_typed" in messages.columns
    listed = _class_list(model, typed)
    if "error_message" in messages.columns:
        # Neither a filter nor an explode of a plain column: Spark would push the test
        # below the header step and parse the payload again.
        listed = F.when(F.col("error_message").isNull(), listed)
    # A loose root is parsed below the explode, once per message.
    held = [c for c in ("_typed", "_is_typed", "error_message") if c in messages.columns]
    parsed = messages.select(*keep, *held, F.from_json("root_raw", OBJECT_TYPE).alias("_root"))
    classes = parsed.select(*keep, F.explode(listed).alias("_c")).select(
        *keep,
        F.col("_c.fits").alias("_fits"),
        F.col("_c.m").alias("class_mnemonic"),
        F.col("_c.one").alias("_one"),
        F.col("_c.t").alias("_elements"),
        F.col("_c.r").alias("_raw"),
        (F.col("_c.m").isNull() | F.col("_c.t").isNotNull() | F.col("_c.r").isNotNull()).alias("class_present"),
    )
    if always is not None:
        shown = F.col("class_present")
        classes = classes.filter(shown | F.col("class_mnemonic").isin(*sorted(always)) if always else shown)
    nothing = F.from_json(F.lit("{}"), OBJECT_TYPE)
    whole = F.from_json("_raw", f"array<{OBJECT_TYPE}>")
    loose = F.transform(
        F.from_json("_raw", "array<string>"), lambda e: F.coalesce(F.from_json(e, OBJECT_TYPE), nothing)
    )
    is_array = F.substring(F.ltrim("_raw"), 1, 1) == "["
    found = (
        F.when(F.col("_fits"), F.col("_elements"))
        .when(F.col("_raw").isNull(), F.lit(None))
        .when(F.col("_one"), F.array(F.coalesce(F.from_json("_raw", OBJECT_TYPE), nothing)))
        .when(is_array, F.coalesce(whole, loose))
    )
    itself = F.array(F.lit(None).cast(OBJECT_TYPE))
    return classes.select(
        *keep,
        "class_mnemonic",
        "class_present",
        F.posexplode(F.concat(itself, F.coalesce(found, F.array().cast(f"array<{OBJECT_TYPE}>")))).alias(
            "element_seq", "props"
        ),
    )


def _item_rows(model: EntityModel, entities: set[str] | None) -> list[tuple]:
    """(slot, level, entity, name, kind, property, element) per item the model expects.
    A slot is a class followed by ``*`` for its elements."""
    out = []
    for cls, _, _, _, level, entity, field, name, kind in model.rows():
        if level == "attribute" and entities is not None and entity not in entities:
            continue
        inside = level in ("element", "attribute")
        element = model.data_class(cls).element_mnemonic if inside else None
        slot = "" if cls is None else f"{cls}*" if inside else cls
        out.append((slot, level, entity, name, kind, field.lower() if level == "attribute" else None, element))
    return out


def flatten(
    messages: DataFrame,
    model: EntityModel,
    keys: list[str],
    entities: set[str] | None = None,
    carry: list[str] = (),
) -> DataFrame:
    """Messages to items.  ``entities`` limits the attribute items, and the items of
    absent classes, to those a rubric looks at; the root and every element always come
    out.  Properties match attributes ignoring case, the first one wins."""
    keep = [*keys, *carry]
    always = None if entities is None else {c.mnemonic for c in model.classes} & entities
    # The expected items come from the model, a few hundred rows at most.
    expected = messages.sparkSession.createDataFrame(
        _item_rows(model, entities),
        "_slot string, level string, entity string, name string, kind string, _prop string, element string",
    )
    found = elements(messages, model, keys, carry, always).withColumns(
        {
            "_slot": F.concat(
                F.coalesce("class_mnemonic", F.lit("")), F.when(F.col("element_seq") > 0, "*").otherwise("")
            ),
            "_keys": F.transform(F.map_keys("props"), lambda k: F.lower(k)),
        }
    )
    joined = found.join(F.broadcast(expected), "_slot").withColumn("_at", F.array_position("_keys", F.col("_prop")))
    return joined.select(
        *keep,
        "level",
        "class_mnemonic",
        "element",
        F.when(F.col("element_seq") > 0, F.col("element_seq")).alias("element_seq"),
        "entity",
        "name",
        "kind",
        F.when(F.col("level") == "attribute", F.coalesce(F.col("_at") > 0, F.lit(False)))
        .otherwise(F.col("class_present"))
        .alias("present"),
        F.get(F.map_values("props"), (F.col("_at") - 1).cast("int")).alias("raw"),
    )


def align(elements_df: DataFrame, attributes: DataFrame, model: EntityModel, keys: list[str]) -> DataFrame:
    """Left outer join of the model's attributes to attribute rows that arrive as a
    long table (keys, class_mnemonic, element_seq, field, attr_pos, raw).  Used when
    the attributes were not nested in a message; nested ones are aligned in place."""
    wanted = model.entities(elements_df.sparkSession).filter(F.col("level") == "attribute").select(
        "class_mnemonic", "entity", "name", "kind", F.lower("field").alias("_field")
    )
    slots = elements_df.select(*keys, "class_mnemonic", "element_seq").join(
        F.broadcast(wanted), "class_mnemonic"
    )
    given = (
        attributes.select(
            *keys, "class_mnemonic", "element_seq", F.lower("field").alias("_field"), "raw", "attr_pos"
        )
        .groupBy(*keys, "class_mnemonic", "element_seq", "_field")
        .agg(F.min_by("raw", "attr_pos").alias("raw"), F.lit(True).alias("_given"))
    )
    joined = slots.join(given, [*keys, "class_mnemonic", "element_seq", "_field"], "left")
    return joined.select(
        *keys,
        F.lit("attribute").alias("level"),
        "class_mnemonic",
        "element_seq",
        "entity",
        "name",
        "kind",
        F.coalesce("_given", F.lit(False)).alias("present"),
        "raw",
    )
