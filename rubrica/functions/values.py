"""Typed attribute values: concepts, observation values, ranges and texts.

An :class:`Item` is a bundle of Columns describing the value a check looks
at.  Table rows build items from their columns; messages parse them from
raw JSON text with :func:`parse_values`.
"""

from __future__ import annotations

from collections.abc import Callable

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.functions.text import blank_to_null, is_blank, not_empty, parse_double
from rubrica.sources.fixed import DATA_TYPES, DEFAULT_DATA_TYPE

Types = tuple[tuple[str, str, bool, bool, bool], ...]

CODING_TYPE = "struct<systems:array<string>,system:string,code:string,display:string>"
TERM_TYPE = (
    "struct<recognized:boolean,valid:boolean,active:boolean,similarity:int,"
    "system_ids:array<string>,value_sets:array<string>>"
)


def null(dtype: str) -> Column:
    return F.lit(None).cast(dtype)


@dataclass(frozen=True)
class Item:
    """The value under evaluation, as Columns."""

    present: Column
    kind: Column
    text: Column
    codings: Column
    type_code: Column
    number: Column
    number2: Column
    low: Column
    high: Column
    term: Column
    lists: Column
    child_fails: Column
    #: Text and codings as given and how they are settled, for those who make columns of them first.
    given: tuple[Column, Column, Callable[[Column, Column], "Item"]] | None = None

    @staticmethod
    def empty(kind: str = "ATR") -> "Item":
        return Item(
            present=F.lit(True),
            kind=F.lit(kind),
            text=null("string"),
            codings=null(f"array<{CODING_TYPE}>"),
            type_code=null("string"),
            number=null("double"),
            number2=null("double"),
            low=null("string"),
            high=null("string"),
            term=null(TERM_TYPE),
            lists=null("array<string>"),
            child_fails=F.lit(0),
        )

    @staticmethod
    def of_text(text: Column, present: Column | None = None) -> "Item":
        """A plain attribute.  A NULL cell is a missing attribute unless told otherwise."""
        return replace(
            Item.empty("ATR"),
            present=text.isNotNull() if present is None else present,
            text=text,
        )

    @staticmethod
    def of_concept(
        text: Column | None, codings: Column | None, present: Column | None = None
    ) -> "Item":
        """A coded concept; ``codings`` as built by :func:`codings`."""
        coded = null(f"array<{CODING_TYPE}>") if codings is None else codings
        label = null("string") if text is None else text

        def settle(label: Column, coded: Column) -> Item:
            text, filled = settle_concept(label, coded)
            here = (F.size(coded) > 0) | text.isNotNull() if present is None else present
            return replace(Item.empty("CC"), present=here, text=text, codings=filled)

        return replace(settle(label, coded), given=(label, coded, settle))

    @staticmethod
    def of_observation(
        text: Column,
        type_text: Column,
        codings: Column | None = None,
        present: Column | None = None,        types: Types = DATA_TYPES,
    ) -> "Item":
        base = Item.of_concept(text, codings, present)
        code, number, number2 = settle_observation(base.text, type_text, types)
        return replace(
            base, kind=F.lit("OBSVAL"), type_code=code, number=number, number2=number2, given=None
        )

    @staticmethod
    def of_range(
        low: Column, high: Column, text: Column | None = None, present: Column | None = None
    ) -> "Item":
        here = (low.isNotNull() | high.isNotNull()) if present is None else present
        return replace(
            Item.empty("RV"),
            present=here,
            text=null("string") if text is None else text,
            low=low,
            high=high,
        )

    @property
    def is_concept(self) -> Column:
        return self.present & self.kind.isin("CC", "OBSVAL")

    @property
    def is_observation(self) -> Column:
        return self.present & (self.kind == "OBSVAL")

    @property
    def is_range(self) -> Column:
        return self.present & (self.kind == "RV")


def coding(
    code: Column,
    system: Column | None = None,
    display: Column | None = None,
    system_id: Column | None = None,
) -> Column:
    """One coding struct.  ``system`` and ``system_id`` are both looked up, in order."""
    first = null("string") if system is None else system.cast("string")
    second = null("string") if system_id is None else system_id.cast("string")
    # Spelled out rather than by functions over the list, which Spark neither compiles nor folds.
    systems = (
        F.when(first.isNotNull() & second.isNotNull(), F.array(first, second))
        .when(first.isNotNull(), F.array(first))
        .when(second.isNotNull(), F.array(second))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.struct(
        systems.alias("systems"),
        F.coalesce(blank_to_null(first), blank_to_null(second)).alias("system"),
        code.cast("string").alias("code"),
        (null("string") if display is None else display.cast("string")).alias("display"),
    )


def codings(*items: Column) -> Column:
    return F.array(*items)


def concept_text(text: Column, coded: Column) -> Column:
    """The concept's text; an empty one takes the first display."""
    first_display = F.get(F.filter(coded, lambda c: not_empty(c["display"])), 0)["display"]
    return F.when(not_empty(text), text).otherwise(F.coalesce(first_display, text))


def fill_displays(coded: Column, label: Column) -> Column:
    """Codings in which an empty display takes the concept's text; a list without one stays as it is."""
    filled = F.transform(
        coded,
        lambda c: F.struct(
            c["systems"].alias("systems"),
            c["system"].alias("system"),
            c["code"].alias("code"),
            F.when(not_empty(c["display"]), c["display"])
            .otherwise(F.coalesce(label, c["display"]))
            .alias("display"),
        ),
    )
    return F.when(F.exists(coded, lambda c: ~not_empty(c["display"])), filled).otherwise(coded)


def settle_concept(text: Column, coded: Column) -> tuple[Column, Column]:
    """Share text and displays between a concept and its codings."""
    label = concept_text(text, coded)
    return label, fill_displays(coded, label)


def settle_observation(text: Column, type_text: Column, types: Types = DATA_TYPES) -> tuple[Column, Column, Column]:
    """Resolve the data type (unknown falls back to the default) and the numbers.
    ``types`` is the data-type library: (code, name, coded, numeric, range) rows."""
    known = [t[0] for t in types]
    numeric = [t[0] for t in types if t[3]]
    ranged = [t[0] for t in types if t[3] and t[4]]
    code = F.when(type_text.isin(*known), type_text).otherwise(F.lit(DEFAULT_DATA_TYPE))
    bits = F.split(text, r"\^", -1)
    number = F.when(code.isin(*ranged), parse_double(F.get(bits, 0))).when(
        code.isin(*numeric), parse_double(text)
    )
    number2 = F.when(code.isin(*ranged), parse_double(F.get(bits, 1)))
    return code, number, number2


def concept_state(text: Column, coded: Column) -> Column:
    has_text = not_empty(text)
    has_codes = F.coalesce(F.size(coded) > 0, F.lit(False))
    return (
        F.when(has_text & has_codes, "Both")
        .when(has_codes, "ConceptsOnly")
        .when(has_text, "TextOnly")
        .otherwise("None")
    )


VALUE_COLUMNS = (
    "v_text",
    "v_codings",
    "v_type",
    "v_type_text",
    "v_number",
    "v_number2",
    "v_low",
    "v_high",
)


def parse_values(items: DataFrame, types: Types = DATA_TYPES) -> DataFrame:
    """Parse the ``raw`` JSON text of each item by its ``kind`` into value columns.

    A concept may arrive as a bare string, as an object with text/codings, or
    as an object with neither (its first property is then the text).
    """
    is_object = F.substring(F.ltrim(F.col("raw")), 1, 1) == "{"
    typed = F.col("kind").isin("CC", "OBSVAL", "RV")
    with_map = items.withColumn(
        "_m", F.when(typed & is_object, F.from_json("raw", "map<string,string>"))
    )
    m = F.col("_m")
    shaped = F.map_contains_key(m, F.lit("text")) | F.map_contains_key(m, F.lit("codings"))
    text0 = (
        F.when(m.isNull(), F.coalesce(F.col("raw"), F.when(F.col("present"), F.lit(""))))
        .when(F.col("kind") == "RV", F.coalesce(F.try_element_at(m, F.lit("text")), F.try_element_at(m, F.lit("Text"))))
        .when(shaped, F.try_element_at(m, F.lit("text")))
        .otherwise(F.get(F.map_values(m), 0))
    )
    coded = raw_codings(F.try_element_at(m, F.lit("codings")))
    concept = F.col("kind").isin("CC", "OBSVAL")
    raw_type = F.try_element_at(m, F.lit("type"))
    staged = with_map.select(
        *items.columns,
        text0.alias("_text0"),
        F.when(concept & m.isNotNull(), coded).alias("_codings0"),
        F.when(F.col("kind") == "OBSVAL", raw_type).alias("v_type"),
        F.when(
            F.col("kind") == "RV",
            F.coalesce(F.try_element_at(m, F.lit("lowValue")), F.try_element_at(m, F.lit("LowValue"))),
        ).alias("v_low"),
        F.when(
            F.col("kind") == "RV",
            F.coalesce(F.try_element_at(m, F.lit("highValue")), F.try_element_at(m, F.lit("HighValue"))),
        ).alias("v_high"),
    )
    concept_kind = F.col("_codings0").isNotNull()
    staged = staged.withColumn(
        "v_text", F.when(concept_kind, concept_text(F.col("_text0"), F.col("_codings0"))).otherwise(F.col("_text0"))
    )
    type_is_object = F.substring(F.ltrim(F.col("v_type")), 1, 1) == "{"
    type_text = F.when(
        type_is_object, F.get_json_object("v_type", "$.text")
    ).otherwise(F.col("v_type"))
    staged = staged.select(
        *items.columns,
        "v_text",
        fill_displays(F.col("_codings0"), F.col("v_text")).alias("v_codings"),
        "v_type",
        "v_low",
        "v_high",
        type_text.alias("v_type_text"),
    )
    code, number, number2 = settle_observation(F.col("v_text"), F.col("v_type_text"), types)
    obs = F.col("kind") == "OBSVAL"
    return staged.withColumns(
        {
            "v_type_code": F.when(obs & F.col("present"), code),
            "v_number": F.when(obs, number),
            "v_number2": F.when(obs, number2),
        }
    )


def parsed_item(term: Column | None = None, lists: Column | None = None) -> Item:
    """The :class:`Item` over the columns of :func:`parse_values`."""
    return Item(
        present=F.col("present"),
        kind=F.col("kind"),
        text=F.col("v_text"),
        codings=F.col("v_codings"),
        type_code=F.col("v_type_code"),
        number=F.col("v_number"),
        number2=F.col("v_number2"),
        low=F.col("v_low"),
        high=F.col("v_high"),
        term=null(TERM_TYPE) if term is None else term,
        lists=null("array<string>") if lists is None else lists,
        child_fails=F.lit(0),
    )


def raw_columns(name: str, kind: str, raw: Column, present: Column) -> list[dict[str, Column]]:
    """Columns that hold a value of a known kind read from raw JSON text, in steps: those of a step
    read only columns of steps before.  :func:`raw_item` puts them together; the meaning is that of
    :func:`parse_values`."""
    first = {f"{name}_raw": raw, f"{name}_present": present}
    raw, present = F.col(f"{name}_raw"), F.col(f"{name}_present")
    plain = F.coalesce(raw, F.when(present, F.lit("")))
    if kind not in ("CC", "OBSVAL", "RV"):
        return [first, {f"{name}_text": plain}]
    m = F.col(f"{name}_m")
    is_object = F.substring(F.ltrim(raw), 1, 1) == "{"

    def of(*names: str) -> Column:
        return F.coalesce(*[F.try_element_at(m, F.lit(n)) for n in names])

    if kind == "RV":
        steps = [first, {f"{name}_m": F.when(is_object, F.from_json(raw, "map<string,string>"))}]
        text = F.when(m.isNull(), plain).otherwise(of("text", "Text"))
        return [*steps, {f"{name}_text": text, f"{name}_low": of("lowValue", "LowValue"), f"{name}_high": of("highValue", "HighValue")}]
    # One typed parse says everything about an ordinary concept; only others are read property by property.
    c, fits = F.col(f"{name}_c"), F.col(f"{name}_fits")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unreadable"}
    steps = [first, {f"{name}_c": F.when(is_object, F.from_json(raw, _CONCEPT, options))}]
    said = c["_unreadable"].isNull() & (c["text"].isNotNull() | c["codings"].isNotNull())
    steps.append({f"{name}_fits": F.coalesce(said & ~raw.rlike(_TWICE), F.lit(False))})
    steps.append({f"{name}_m": F.when(is_object & ~fits, F.from_json(raw, "map<string,string>"))})
    shaped = F.map_contains_key(m, F.lit("text")) | F.map_contains_key(m, F.lit("codings"))
    text = F.when(fits, c["text"]).when(m.isNull(), plain).when(shaped, of("text")).otherwise(F.get(F.map_values(m), 0))
    listed = F.when(fits, c["codings"]).otherwise(F.from_json(of("codings"), _CODING_LIST))
    steps.append({f"{name}_text0": text, f"{name}_coded": F.when(fits | m.isNotNull(), parsed_codings(listed))})
    coded = F.col(f"{name}_coded")
    label = F.when(coded.isNotNull(), concept_text(F.col(f"{name}_text0"), coded)).otherwise(F.col(f"{name}_text0"))
    steps[-1] |= {f"{name}_type": F.when(fits, c["type"]).otherwise(of("type"))} if kind == "OBSVAL" else {}
    return [*steps, {f"{name}_text": label}]


def raw_item(name: str, kind: str, types: Types = DATA_TYPES, displays: bool = True) -> Item:
    """The :class:`Item` over the columns of :func:`raw_columns`.  Without ``displays`` those of codings
    stay as given, for readers of systems and codes alone."""
    text, present = F.col(f"{name}_text"), F.col(f"{name}_present")
    item = replace(Item.empty(kind), present=present, text=text)
    if kind == "RV":
        return replace(item, low=F.col(f"{name}_low"), high=F.col(f"{name}_high"))
    if kind not in ("CC", "OBSVAL"):
        return item
    coded = F.col(f"{name}_coded")
    item = replace(item, codings=fill_displays(coded, text) if displays else coded)
    if kind == "CC":
        return item
    kept = F.col(f"{name}_type")
    is_object = F.substring(F.ltrim(kept), 1, 1) == "{"
    type_text = F.when(is_object, F.get_json_object(kept, "$.text")).otherwise(kept)
    code, number, number2 = settle_observation(text, type_text, types)
    return replace(item, type_code=F.when(present, code), number=number, number2=number2)


_CODING_LIST = "array<struct<system:string,`system-id`:string,code:string,display:string>>"
_CONCEPT = f"text string, codings {_CODING_LIST}, type string, _unreadable string"
#: A property that may come twice, of which a struct keeps the last and a map the first.
_TWICE = r'(?s)"(text|codings|type)"\s*:.*"\1"\s*:|\\u'
_WITH_NULLS = {"ignoreNullFields": "false"}


def raw_codings(text: Column) -> Column:
    """Codings of a JSON list of coding objects."""
    return parsed_codings(F.from_json(text, _CODING_LIST))


def parsed_codings(parsed: Column) -> Column:
    """Codings of coding objects as parsed."""
    return F.transform(
        F.filter(parsed, lambda c: c.isNotNull()),
        lambda c: coding(c["code"], c["system"], c["display"], c["system-id"]),
    )


def concept_json(text: Column, coded: Column, canonical: Callable[[Column], Column] | None = None) -> Column:
    """A concept written back as JSON text, nulls included.  With ``canonical`` (system ->
    canonical id or NULL) the first recognised system of a coding is the one shown."""

    def system(c: Column) -> Column:
        if canonical is None:
            return c["system"]
        return F.coalesce(F.get(F.filter(c["systems"], lambda x: canonical(x).isNotNull()), 0), c["system"])

    slim = F.transform(
        coded,
        lambda c: F.struct(system(c).alias("system"), c["code"].alias("code"), c["display"].alias("display")),
    )
    return F.when(
        F.size(coded) > 0, F.to_json(F.struct(slim.alias("codings"), text.alias("text")), _WITH_NULLS)
    ).otherwise(F.to_json(F.struct(text.alias("text")), _WITH_NULLS))


def json_text(text: Column) -> Column:
    """A JSON string literal; the text is not null."""
    return F.btrim(F.to_json(F.array(text)), F.lit("[]"))


def data_json(item: Item, raw_type: Column, type_text: Column, canonical: Callable[[Column], Column] | None = None) -> Column:
    """The ``data`` node of an audited attribute, as JSON text, by kind.  ``raw_type`` is the
    observation's type as it came, an object or plain text."""
    label = F.coalesce(item.text, F.lit(""))
    quoted = json_text(label)
    is_object = F.substring(F.ltrim(raw_type), 1, 1) == "{"
    type_codings = F.when(is_object, raw_codings(F.get_json_object(raw_type, "$.codings")))
    shown_text = concept_text(type_text, type_codings)
    type_json = concept_json(shown_text, fill_displays(type_codings, shown_text), canonical)
    observation = F.concat(
        F.lit('{"text":'),
        quoted,
        F.coalesce(F.concat(F.lit(',"type":'), F.when(raw_type.isNotNull(), type_json)), F.lit("")),
        F.lit("}"),
    )
    rng = F.to_json(
        F.struct(label.alias("text"), item.low.alias("lowValue"), item.high.alias("highValue")), _WITH_NULLS
    )
    return (
        F.when(item.kind == "CC", concept_json(item.text, item.codings, canonical))
        .when(item.kind == "OBSVAL", observation)
        .when(item.kind == "RV", rng)
        .otherwise(quoted)
    )
