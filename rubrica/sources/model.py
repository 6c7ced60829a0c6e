"""Entity model: which classes and attributes a message has."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.sources import fixed

ENTITY_SCHEMA = (
    "class_mnemonic string, class_field string, class_name string, cardinality string, "
    "level string, entity string, field string, name string, kind string"
)


@dataclass(frozen=True)
class Attribute:
    mnemonic: str
    field: str
    kind: str = "ATR"
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or self.field


@dataclass(frozen=True)
class DataClass:
    mnemonic: str
    field: str
    attributes: tuple[Attribute, ...]
    cardinality: str = "MANY"
    name: str | None = None
    element: str | None = None

    @property
    def label(self) -> str:
        return self.name or self.field

    @property
    def element_mnemonic(self) -> str:
        return self.element or f"{self.mnemonic}_ELM"


@dataclass(frozen=True)
class EntityModel:
    mnemonic: str
    root_field: str
    classes: tuple[DataClass, ...]
    root_mnemonic: str = "ROOT"
    _by_entity: dict = field(default_factory=dict, compare=False, repr=False)

    def data_class(self, mnemonic: str) -> DataClass:
        for c in self.classes:
            if c.mnemonic == mnemonic:
                return c
        raise KeyError(mnemonic)

    def class_of(self, entity: str) -> str | None:
        """Owning class of an entity; None for the root."""
        if not self._by_entity:
            for c in self.classes:
                self._by_entity[c.mnemonic] = c.mnemonic
                self._by_entity[c.element_mnemonic] = c.mnemonic
                for a in c.attributes:
                    self._by_entity[a.mnemonic] = c.mnemonic
            self._by_entity[self.root_mnemonic] = None
        return self._by_entity[entity]

    def level_of(self, entity: str) -> str:
        if entity == self.root_mnemonic:
            return "root"
        for c in self.classes:
            if entity == c.mnemonic:
                return "class"
            if entity == c.element_mnemonic:
                return "element"
        self.class_of(entity)
        return "attribute"

    def rows(self) -> list[tuple]:
        """The model flattened: one row per root, class, element and attribute."""
        out = [(None, None, None, "ONE", "root", self.root_mnemonic, self.root_field, self.root_field, "ROOT")]
        for c in self.classes:
            head = (c.mnemonic, c.field, c.label, c.cardinality)
            out.append((*head, "class", c.mnemonic, c.field, c.label, "CLS"))
            out.append((*head, "element", c.element_mnemonic, c.field, c.label, "ELM"))
            out += [(*head, "attribute", a.mnemonic, a.field, a.label, a.kind) for a in c.attributes]
        return out

    def entities(self, spark: SparkSession) -> DataFrame:
        """The flattened model as a small DataFrame."""
        return spark.createDataFrame(self.rows(), ENTITY_SCHEMA)

    @staticmethod
    def from_text(mnemonic: str, root_field: str, block: str) -> "EntityModel":
        """Read the indented text form used in :mod:`rubrica.sources.fixed`."""
        classes: list[DataClass] = []
        head: tuple[str, str, str] | None = None
        attrs: list[Attribute] = []

        def close() -> None:
            if head:
                classes.append(DataClass(head[0], head[1], tuple(attrs), head[2]))

        for line in block.strip("\n").splitlines():
            if line.startswith("  "):
                parts = line.split(None, 3)
                attrs.append(Attribute(parts[0], parts[1], parts[2], parts[3] if len(parts) > 3 else None))
            else:
                close()
                head = tuple(line.split())
                attrs = []
        close()
        return EntityModel(mnemonic, root_field, tuple(classes))

    @staticmethod
    def from_json(text: str) -> "EntityModel":
        """Read a model file: data classes whose children nest class, element and
        attribute entities, each with mnemonic, fieldName, name, entityType."""
        doc = {k.lower(): v for k, v in json.loads(text).items()}

        def get(node: dict, *names: str):
            low = {k.lower(): v for k, v in node.items()}
            for n in names:
                if low.get(n.lower()) is not None:
                    return low[n.lower()]
            return None

        def kind(node: dict) -> str:
            t = get(node, "entityType", "entityTypeValue", "type")
            if isinstance(t, dict):
                t = get(t, "entityTypeValue", "mnemonic", "name")
            return str(t)

        def cardinality(node: dict) -> str:
            c = get(node, "cardinality")
            if isinstance(c, dict):
                c = get(c, "cardinalityValue", "mnemonic", "name")
            return "ONE" if str(c).upper() == "ONE" else "MANY"

        classes = []
        for parent in get(doc, "dataClasses") or []:
            many = cardinality(parent)
            cls = elm = None
            attrs: list[Attribute] = []
            for e in get(parent, "children") or []:
                k = kind(e)
                if k == "CLS":
                    cls = e
                elif k == "ELM":
                    elm = e
                else:
                    attrs.append(
                        Attribute(
                            get(e, "mnemonic"),
                            get(e, "fieldName", "name"),
                            k if k in ("CC", "OBSVAL", "RV") else "ATR",
                            get(e, "name"),
                        )
                    )
            if cls is not None:
                classes.append(
                    DataClass(
                        get(cls, "mnemonic"),
                        get(cls, "fieldName", "name"),
                        tuple(attrs),
                        many,
                        get(cls, "name"),
                        get(elm, "mnemonic") if elm else None,
                    )
                )
        return EntityModel(
            get(doc, "mnemonic"),
            get(doc, "rootEntityName"),
            tuple(classes),
            get(doc, "rootEntityMnemonic") or "ROOT",
        )


def load_model(spark: SparkSession, index_path: str, mnemonic: str) -> EntityModel:
    """A model found by mnemonic in a library index."""
    from rubrica.sources.reference import library_file

    return EntityModel.from_json(library_file(spark, index_path, mnemonic)[1].lstrip("\ufeff"))


def clinical_model() -> EntityModel:
    """The bundled clinical message model."""
    return EntityModel.from_text(
        fixed.CLINICAL_MODEL_MNEMONIC, "patient", fixed.CLINICAL_MODEL
    )


def path_key(root: str):
    """Path of an item, ``root|class|element.seq|attribute``, missing parts left out."""
    step = F.when(
        F.col("element_seq").isNotNull(),
        F.concat_ws(".", F.col("element"), F.col("element_seq").cast("string")),
    )
    attribute = F.when(F.col("level") == "attribute", F.col("entity"))
    return F.concat_ws("|", F.lit(root), F.col("class_mnemonic"), step, attribute)
