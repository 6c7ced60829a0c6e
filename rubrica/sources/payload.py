"""Typed schema of payloads, compiled from the entity model.

A message is parsed once: the header's properties as texts, and below the root one typed
column for each class, ``array<map<string,string>>`` for elements of a class with many, one map for a
class of cardinality ONE.  Catalyst prunes the classes that nobody reads.  Properties of elements stay
a map, as they match attributes ignoring case and the first one wins, which a struct cannot say.

Whatever the schema does not fit (a root spelled otherwise, a class that is no array, an
element that is no object) is marked unreadable by the parser, and only such messages are
read the loose way, property by property.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubrica.sources.model import DataClass, EntityModel

OBJECT_TYPE = "map<string,string>"
HEADER = ("EntityModel", "DataProviderID", "DataSourceID", "MessageID", "TransactionDate")
UNREADABLE = "_unreadable"

_OBJECT = T.MapType(T.StringType(), T.StringType())


def root_type(model: EntityModel, classes: set[str] | None = None) -> T.StructType | None:
    """The root as a struct of its classes (all, or those named), by field and by name.

    None for a model whose properties differ by case alone, which a struct cannot hold apart."""
    fields: dict[str, T.DataType] = {}
    for c in model.classes:
        if classes is not None and c.mnemonic not in classes:
            continue
        kind = _OBJECT if c.cardinality == "ONE" else T.ArrayType(_OBJECT)
        for name in (c.field, c.label):
            if fields.setdefault(name, kind) != kind:
                return None
    if len({n.lower() for n in fields} | {UNREADABLE}) < len(fields) + 1:
        return None
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


def payload_type(model: EntityModel, classes: set[str] | None = None) -> T.StructType | None:
    """The whole payload: header properties and the root."""
    root = root_type(model, classes)
    if root is None or model.root_field.lower() in {h.lower() for h in (*HEADER, UNREADABLE)}:
        return None
    header = [T.StructField(h, T.StringType()) for h in HEADER]
    return T.StructType([*header, T.StructField(model.root_field, root), T.StructField(UNREADABLE, T.StringType())])


def parse(text: Column, schema: T.StructType) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": UNREADABLE})


def parsed_payload(payload: Column, model: EntityModel, classes: set[str] | None = None) -> Column | None:
    """The typed payload; NULL where it has to be read the loose way."""
    schema = payload_type(model, classes)
    return None if schema is None else parse(payload, schema)


def readable(parsed: Column, payload: Column, model: EntityModel) -> Column:
    """Whether the typed payload says everything: it fits, and no property is the root in another
    spelling, which might come first and then counts."""
    other = rf'"(?!{re.escape(model.root_field)}")(?i:{re.escape(model.root_field)})"\s*:'
    return F.coalesce(parsed[UNREADABLE].isNull() & parsed[model.root_field].isNotNull() & ~payload.rlike(other), F.lit(False))


def typed_elements(root: Column, c: DataClass) -> Column:
    """Elements of a class from the typed root; NULL when the message has no such class."""
    found = F.coalesce(root[c.field], root[c.label]) if c.label != c.field else root[c.field]
    return F.when(found.isNotNull(), F.array(found)) if c.cardinality == "ONE" else found
