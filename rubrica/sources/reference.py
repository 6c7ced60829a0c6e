"""Reference data: code systems, value lists, terminology, content marts.

Code systems, check definitions and library indexes steer the plan, so they
are read to the driver, as large as their file is.  Concepts, value-set
members and value lists stay DataFrames and are joined.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.functions.text import map_get_ignore_case
from rubrica.sources import fixed

CODE_SYSTEM_SCHEMA = (
    "struct<Name:string,Mnemonic:string,FhirUri:string,CodeSystemIdentifiers:array<string>>"
)
VALUE_LIST_SCHEMA = (
    "struct<Mnemonic:string,CodeList:array<struct<DataCode:string,DataText:string>>>"
)
VALUE_SET_SCHEMA = (
    "struct<Name:string,Mnemonic:string,Description:string,FhirUri:string,"
    "CodingList:array<struct<system:string,code:string,display:string>>>"
)
DATA_TYPE_SCHEMA = (
    "struct<Code:string,Name:string,IsCoded:boolean,IsNumeric:boolean,IsRange:boolean>"
)
CHECK_SCHEMA = (
    "struct<Name:string,Mnemonic:string,FailName:string,InputType:string,"
    "PrerequisiteSAMMnemonic:string,HDQTDimensionMnemonic:string,"
    "Parameters:array<struct<Name:string,Mnemonic:string,ParameterValueTypeName:string,"
    "IsOptional:boolean>>>"
)


def read_library(spark: SparkSession, path: str, entry_schema: str) -> DataFrame:
    """Rows of a library file ``{"<library name>": [entry, ...]}``, whatever its name."""
    text = spark.read.text(path, wholetext=True)
    lists = F.map_values(F.from_json("value", f"map<string,array<{entry_schema}>>"))
    return text.select(F.explode(F.flatten(lists)).alias("e")).select("e.*")


def read_entries(spark: SparkSession, path: str, fmt: str, names: dict[str, str]) -> DataFrame:
    """A library kept as one row an entry, in JSON lines or Parquet, so that it is read by as many tasks as it
    has blocks.  ``names`` maps properties (compared ignoring case) to columns; a missing one is NULL."""
    if fmt == "json":
        given = F.from_json("value", "map<string,string>")
        rows = spark.read.text(path).filter(F.trim("value") != "").select(given.alias("m"))
        return rows.select(*[map_get_ignore_case(F.col("m"), p).alias(c) for p, c in names.items()])
    rows = spark.read.format(fmt).load(path)
    held = {c.lower(): c for c in rows.columns}
    value = lambda p: F.col(held[p.lower()]).cast("string") if p.lower() in held else F.lit(None).cast("string")
    return rows.select(*[value(p).alias(c) for p, c in names.items()])


@dataclass(frozen=True)
class CodeSystem:
    mnemonic: str
    name: str | None = None
    uri: str | None = None
    identifiers: tuple[str, ...] = ()

    def aliases(self) -> list[str]:
        return [a for a in (self.name, self.mnemonic, self.uri, *self.identifiers) if a]


class CodeSystems:
    """Code-system library; any name, mnemonic, URI or identifier finds an entry,
    and the first entry in library order wins."""

    def __init__(self, systems: Iterable[CodeSystem] = ()):
        self.systems = list(systems)
        self.alias_map: dict[str, str] = {}
        for s in self.systems:
            for a in s.aliases():
                self.alias_map.setdefault(a, s.mnemonic)

    def canonical(self, alias: str) -> str | None:
        return self.alias_map.get(alias)

    def canonical_col(self, system):
        """Canonical mnemonic of a system Column; NULL when not recognised."""
        if not self.alias_map:
            return F.lit(None).cast("string")
        pairs = [F.lit(x) for kv in self.alias_map.items() for x in kv]
        return F.try_element_at(F.create_map(*pairs), system)

    @staticmethod
    def bundled() -> "CodeSystems":
        out = []
        for line in fixed.CODE_SYSTEMS.strip().splitlines():
            m, name, uri, ids = line.split("|")
            out.append(CodeSystem(m, name, uri or None, tuple(ids.split(","))))
        return CodeSystems(out)

    @staticmethod
    def read(spark: SparkSession, path: str) -> "CodeSystems":
        rows = read_library(spark, path, CODE_SYSTEM_SCHEMA).collect()
        return CodeSystems(
            CodeSystem(r.Mnemonic, r.Name, r.FhirUri, tuple(r.CodeSystemIdentifiers or ()))
            for r in rows
        )


@dataclass
class ValueLists:
    """External value lists: list mnemonic -> (code, text) entries.

    ``table(mnemonic, code, text)`` is joined, whatever its size; ``small`` holds
    lists that are written out in a program and become literal sets.
    """

    small: dict[str, list[tuple[str | None, str | None]]] = field(default_factory=dict)
    table: DataFrame | None = None
    _known: dict[str, bool] = field(default_factory=dict)

    def has(self, mnemonic: str) -> bool:
        """Whether the list exists; the table is asked once per name a rubric uses."""
        if mnemonic in self.small:
            return True
        if self.table is not None and mnemonic not in self._known:
            self._known[mnemonic] = bool(self.table.filter(F.col("mnemonic") == mnemonic).take(1))
        return self._known.get(mnemonic, False)

    def is_literal(self, mnemonic: str) -> bool:
        return mnemonic in self.small

    def literal_keys(self, mnemonic: str) -> list[str]:
        keys = {x.upper() for pair in self.small[mnemonic] for x in pair if x is not None}
        return sorted(keys)

    @staticmethod
    def from_table(table: DataFrame) -> "ValueLists":
        """Lists of a (mnemonic, code, text) table."""
        return ValueLists(table=table)

    @staticmethod
    def read(spark: SparkSession, path: str, fmt: str = "library") -> "ValueLists":
        """Lists of a library file, or with ``fmt`` ``json`` or ``parquet`` of files with one row an entry
        (Mnemonic, DataCode, DataText), for lists too long for one file that is read whole."""
        if fmt != "library":
            return ValueLists.from_table(read_entries(spark, path, fmt, {"Mnemonic": "mnemonic", "DataCode": "code", "DataText": "text"}))
        lib = read_library(spark, path, VALUE_LIST_SCHEMA)
        rows = lib.select(F.col("Mnemonic").alias("mnemonic"), F.explode("CodeList").alias("c"))
        return ValueLists.from_table(
            rows.select("mnemonic", F.col("c.DataCode").alias("code"), F.col("c.DataText").alias("text"))
        )


@dataclass
class Terminology:
    """Tables the concept checks look codes up in.

    concepts: system, code, inactive (boolean), status, displays (array)
    value_sets: value_set, system, code
    """

    concepts: DataFrame | None = None
    value_sets: DataFrame | None = None

    @staticmethod
    def read(spark: SparkSession, concepts: str, value_sets: str | None = None) -> "Terminology":
        return Terminology(
            spark.read.parquet(concepts),
            spark.read.parquet(value_sets) if value_sets else None,
        )

    @staticmethod
    def value_sets_from_library(spark: SparkSession, path: str, fmt: str = "library") -> DataFrame:
        """Value-set library file -> (value_set, system, code) rows; with ``fmt`` ``json`` or ``parquet``
        files with one row an entry (Mnemonic, system, code)."""
        if fmt != "library":
            return read_entries(spark, path, fmt, {"Mnemonic": "value_set", "system": "system", "code": "code"})
        lib = read_library(spark, path, VALUE_SET_SCHEMA)
        return lib.select(
            F.col("Mnemonic").alias("value_set"), F.explode("CodingList").alias("c")
        ).select("value_set", F.col("c.system").alias("system"), F.col("c.code").alias("code"))


@dataclass
class ContentMarts:
    """Declared content tables that checks look into.

    units: content_set, system, code, unit
    ranges: content_set, system, code, unit, min_value, max_value
    texts: content_set, text
    """

    units: DataFrame | None = None
    ranges: DataFrame | None = None
    texts: DataFrame | None = None


def read_data_types(spark: SparkSession, path: str) -> tuple:
    """Data-type library as (code, name, coded, numeric, range) rows for ``EvalContext``."""
    rows = read_library(spark, path, DATA_TYPE_SCHEMA).collect()
    return tuple((r.Code, r.Name, bool(r.IsCoded), bool(r.IsNumeric), bool(r.IsRange)) for r in rows)


def read_checks(spark: SparkSession, path: str) -> list[dict]:
    """Check library file as plain rows for ``CheckLibrary.with_rows``."""
    rows = read_library(spark, path, CHECK_SCHEMA).collect()
    return [r.asDict(recursive=True) for r in rows]


def read_by_mnemonic(spark: SparkSession, index_path: str, mnemonic: str) -> dict | None:
    """Entry of a library index file (mnemonic, name, file path ...), the first one that
    has the mnemonic; property names are compared ignoring case."""
    text = spark.read.text(index_path, wholetext=True)
    lists = F.map_values(F.from_json("value", "map<string,array<map<string,string>>>"))
    entries = text.select(F.posexplode(F.flatten(lists)).alias("pos", "e"))
    hit = entries.filter(map_get_ignore_case(F.col("e"), "mnemonic") == mnemonic)
    rows = hit.orderBy("pos").limit(1).collect()
    return {k.lower(): v for k, v in rows[0]["e"].items()} if rows else None


def library_file(spark: SparkSession, index_path: str, mnemonic: str) -> tuple[dict, str]:
    """The index entry of a mnemonic and the text of its file.  A relative path counts from
    the folder of the index."""
    entry = read_by_mnemonic(spark, index_path, mnemonic)
    if entry is None:
        raise KeyError(f"{mnemonic} is not in {index_path}")
    path = entry.get("filepath") or entry.get("path")
    if path is None:
        raise ValueError(f"the entry of {mnemonic} names no file")
    if "://" not in path and not path.startswith("/"):
        path = f"{index_path.rpartition('/')[0]}/{path}"
    return entry, spark.read.text(path, wholetext=True).first()["value"]
