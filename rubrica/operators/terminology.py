"""Terminology lookups through a dictionary of codings.

Lists of codings go by surrogate keys of two longs.  Their codings, as canonical system, code and what else the
rubric's checks ask for, are made distinct (a partial aggregate, so a list that a third of all rows
share costs a row a task), meet the concepts in one join for all columns, displays being compared
only where the concept is there, and the answers go back to the rows by the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.functions.joins import ListKeys, marked
from rubrica.functions.text import not_empty, similarity, split_list
from rubrica.plans.checks import registered
from rubrica.plans.rubric import CompiledRubric


def canonical_concepts(compiled: CompiledRubric) -> DataFrame | None:
    """Concept table keyed by canonical code system."""
    table = compiled.ctx.terminology.concepts
    if table is None:
        return None
    cols = set(table.columns)
    pick = {
        "inactive": F.col("inactive") if "inactive" in cols else F.lit(None).cast("boolean"),
        "status": F.col("status") if "status" in cols else F.lit(None).cast("string"),
        "displays": F.col("displays") if "displays" in cols else F.lit(None).cast("array<string>"),
    }
    return table.select(
        compiled.ctx.code_systems.canonical_col(F.col("system")).alias("_sys"),
        F.col("code").alias("_code"),
        pick["inactive"].alias("inactive"),
        pick["status"].alias("status"),
        pick["displays"].alias("displays"),
    ).filter(F.col("_sys").isNotNull())


def active_flag(inactive: Column, status: Column) -> Column:
    """The ``inactive`` property decides, else the status text; neither means inactive."""
    return F.coalesce(~inactive, F.upper(status) == "ACTIVE", F.lit(False))


def recognized_system(systems: Column, compiled: CompiledRubric) -> Column:
    """Canonical id of the first system of a coding that the library knows."""
    canonical = compiled.ctx.code_systems.canonical_col
    return canonical(F.get(F.filter(systems, lambda s: canonical(s).isNotNull()), 0))


def coding_facts(c: Column, compiled: CompiledRubric) -> Column:
    """What lookups need to know of a coding: canonical system, code, and only where a check asks for them the
    display and the systems as they are tried in value sets (NULL for one that is not known)."""
    asked = {p.defn.mnemonic for p in compiled.probes}
    parts = [recognized_system(c["systems"], compiled).alias("sys"), c["code"].alias("code")]
    if "CONCEPT_ISCONSISTENT" in asked:
        parts.append(F.upper(c["display"]).alias("display"))
    if "CONCEPT_ISINVALUESET" in asked:
        parts.append(F.transform(c["systems"], compiled.ctx.code_systems.canonical_col).alias("tried"))
    return F.struct(*parts)


def coding_mark(c: Column, compiled: CompiledRubric) -> Column:
    """What a hash of the facts of a coding passes over."""
    asked = {p.defn.mnemonic for p in compiled.probes}
    nulls = marked(c["sys"], c["code"], *([c["display"]] if "CONCEPT_ISCONSISTENT" in asked else []))
    if "CONCEPT_ISINVALUESET" not in asked:
        return nulls
    return F.struct(nulls, F.size(c["tried"]), F.transform(c["tried"], lambda t: marked(t)))


def resolve_codings(codings: DataFrame, compiled: CompiledRubric) -> DataFrame:
    """k1, k2, ``term`` of lists whose codings are given as (k1, k2, entry)."""
    names = codings.schema["entry"].dataType.fieldNames()
    each = codings.select("k1", "k2", F.col("entry.sys").alias("_sys"), F.col("entry.code").alias("_code"), *[F.col(f"entry.{n}").alias(f"_{n}") for n in names[2:]])
    concepts = canonical_concepts(compiled)
    display = F.col("_display") if "display" in names else F.lit(None).cast("string")
    if concepts is None:
        joined = each.withColumns(
            {
                "_hit": F.lit(False),
                "_active": F.lit(False),
                "_similar": F.lit(None).cast("int"),
            }
        )
    else:
        joined = each.join(concepts.withColumn("_hit", F.lit(True)), ["_sys", "_code"], "left")
        # Compared only where the concept is there, and only for checks that ask.
        best = F.array_max(F.transform(F.col("displays"), lambda d: similarity(F.upper(d), display)))
        joined = joined.withColumns(
            {
                "_hit": F.coalesce("_hit", F.lit(False)),
                "_active": F.col("_hit") & active_flag(F.col("inactive"), F.col("status")),
                "_similar": F.when(F.col("_hit"), best) if "display" in names else F.lit(None).cast("int"),
            }
        )
    facts = joined.select("k1", "k2", "_sys", "_hit", "_active", "_similar", F.lit(None).cast("string").alias("_set"))
    sets = compiled.value_sets_used()
    members = compiled.ctx.terminology.value_sets
    if sets and members is not None and "tried" in names:
        wanted = members.filter(F.col("value_set").isin(sets)).select(
            F.col("value_set").alias("_set"),
            compiled.ctx.code_systems.canonical_col(F.col("system")).alias("_msys"),
            F.col("code").alias("_mcode"),
        ).distinct()
        # Every system of a coding is tried; a coding without one belongs to no set.
        tried = each.select("k1", "k2", "_code", F.explode("_tried").alias("_try"))
        same_system = (
            F.col("_try").eqNullSafe(F.col("_msys"))
            if compiled.ctx.compat
            else F.col("_try") == F.col("_msys")
        )
        found = tried.join(wanted, (F.col("_code") == F.col("_mcode")) & same_system).select("k1", "k2", "_set")
        facts = facts.unionByName(found, allowMissingColumns=True)
    return facts.groupBy("k1", "k2").agg(
        F.struct(
            F.coalesce(F.max(F.col("_sys").isNotNull()), F.lit(False)).alias("recognized"),
            F.coalesce(F.max("_hit"), F.lit(False)).alias("valid"),
            F.max(F.coalesce("_active", F.lit(False))).alias("active"),
            F.max("_similar").alias("similarity"),
            _held("_sys", asked_systems(compiled)).alias("system_ids"),
            _held("_set", sets).alias("value_sets"),
        ).alias("term")
    )


def _held(column: str, asked: list[str] | None) -> Column:
    """Which of some values a group has; all its values if ``asked`` is None.  A maximum for each
    keeps to fixed-size buffers, which a hash aggregate spills well."""
    if asked is None:
        return F.collect_set(column)
    flags = [F.when(F.max(F.col(column) == x), F.lit(x)) for x in asked]
    return F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")


def asked_systems(compiled: CompiledRubric) -> list[str] | None:
    """Canonical systems that membership checks name; None where a check of the user may read any."""
    library = registered()
    probes = [p for p in compiled.probes if "term" in p.defn.needs]
    if any(p.defn.mnemonic not in library or p.defn.fn is not library[p.defn.mnemonic].fn or not p.defn.mnemonic.startswith("CONCEPT_") for p in probes):
        return None
    named = {s for p in probes if p.defn.mnemonic == "CONCEPT_ISVALIDMEMBER" for _, v in p.params for s in split_list(v) or []}
    return sorted({i for i in map(compiled.ctx.code_systems.canonical, named) if i})


def attach_terms(df: DataFrame, columns: dict[str, str], compiled: CompiledRubric) -> DataFrame:
    """Put a ``term`` struct in place of each coding column: ``columns`` maps coding -> term column."""
    if not columns:
        return df
    facts = {c: F.transform(c, lambda x: coding_facts(x, compiled)) for c in columns}
    keys = ListKeys(df, facts, lambda x: coding_mark(x, compiled))
    return keys.join(resolve_codings(keys.dictionary(), compiled), "term", columns)


def attach_lists(df: DataFrame, columns: dict[str, str], compiled: CompiledRubric) -> DataFrame:
    """Put in place of each column of compared texts the value lists of the table that hold one of them."""
    lists = compiled.table_lists_used()
    if not columns:
        return df
    if not lists:
        return df.withColumns({out: F.lit(None).cast("array<string>") for out in columns.values()}).drop(*columns)
    table = compiled.ctx.value_lists.table.filter(F.col("mnemonic").isin(lists))
    entries = (
        table.select("mnemonic", F.explode(F.array("code", "text")).alias("_v"))
        .select("mnemonic", F.upper("_v").alias("_v"))
        .filter(F.col("_v").isNotNull())
        .distinct()
    )
    keys = ListKeys(df, {c: F.col(c) for c in columns})
    hits = keys.dictionary().join(entries, F.col("entry") == F.col("_v")).groupBy("k1", "k2").agg(F.collect_set("mnemonic").alias("_lists"))
    return keys.join(hits, "_lists", columns)


def unknown_codes(df: DataFrame, codings: str, compiled: CompiledRubric) -> DataFrame:
    """Distinct (system, code) pairs not found in the concept table, with their use count."""
    pairs = (
        df.select(F.explode(codings).alias("_c"))
        .select(
            recognized_system(F.col("_c")["systems"], compiled).alias("_sys"),
            F.col("_c")["code"].alias("_code"),
        )
        .filter(not_empty(F.col("_code")))
        .groupBy("_sys", "_code")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    concepts = canonical_concepts(compiled)
    if concepts is not None:
        pairs = pairs.join(concepts.select("_sys", "_code"), ["_sys", "_code"], "left_anti")
    return pairs.select(F.col("_sys").alias("system"), F.col("_code").alias("code"), "uses")
