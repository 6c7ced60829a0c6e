"""Rubrics and their compilation.

Compilation happens once per query on the driver and touches only the
rubric.  Every distinct (check, parameters) pair becomes a *probe* with a
number; a prerequisite always has a lower number than the check that needs
it.  Per value, the probes yield two bit masks (failed, errored).  A
criterion is then decided with a few bit operations: the lowest set bit of
``mask & chain`` is the first check of its chain that did not pass.
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.functions.values import Item
from rubrica.plans.checks import ERRORED, FAILED, PASSED, SKIPPED, VALIDITY, CheckDef, CheckLibrary, Outcome
from rubrica.plans.context import EvalContext
from rubrica.sources import fixed
from rubrica.sources.model import EntityModel
from rubrica.sources.reference import library_file

WORD_BITS = 62

SCORING = "Scoring"
INFORMATIONAL = "Informational"


@dataclass(frozen=True)
class Criterion:
    """One line of a rubric.  Parameters are (mnemonic, value, name) triples."""

    sequence: int
    entity: str
    check: str
    name: str | None = None
    failure_name: str | None = None
    effect: str = SCORING
    weight: int = 1
    critical: bool = False
    conditional: str | None = None
    params: tuple[tuple[str, str, str], ...] = ()
    conditional_params: tuple[tuple[str, str, str], ...] = ()
    description: str | None = None
    processing: str | None = None

    @property
    def scoring(self) -> bool:
        return self.effect.lower() == SCORING.lower()


@dataclass(frozen=True)
class Rubric:
    mnemonic: str
    criteria: tuple[Criterion, ...]
    name: str | None = None
    model_mnemonic: str = fixed.CLINICAL_MODEL_MNEMONIC

    @staticmethod
    def from_json(text: str, library_name: str | None = None) -> "Rubric":
        """Read a rubric file.  A name given by the library index wins."""
        doc = json.loads(text.lstrip("﻿"))
        rows = []
        for c in doc.get("criteria") or []:
            low = {k.lower(): v for k, v in c.items()}

            rows.append(
                Criterion(
                    sequence=int(low["sequence"]),
                    entity=low["entity"],
                    check=low["sammnemonic"],
                    name=low.get("samnameoverride"),
                    failure_name=low.get("failurenameoverride"),
                    effect=low.get("scoringeffect") or INFORMATIONAL,
                    weight=int(low.get("scoringweight") or 0),
                    critical=bool(low.get("criticalityindicator")),
                    conditional=low.get("conditionalsam") or None,
                    params=_params(low.get("samparameters")),
                    conditional_params=_params(low.get("conditionalsamparameters")),
                    description=low.get("description"),
                    processing=low.get("processingurl"),
                )
            )
        model = doc.get("model") or {}
        return Rubric(
            doc["mnemonic"],
            tuple(rows),
            library_name or doc.get("name"),
            model.get("mnemonic") or "",
        )

    @staticmethod
    def from_rows(mnemonic: str, name: str, block: str, library: CheckLibrary) -> "Rubric":
        """Read the row form used in :mod:`rubrica.sources.fixed`."""
        out = []
        for line in block.strip("\n").splitlines():
            if not line.strip():
                continue
            seq, entity, chk, label, fail, effect, crit, cond, value = line.split("|")
            declared = library.get(chk).params
            out.append(
                Criterion(
                    int(seq),
                    entity,
                    chk,
                    label,
                    fail,
                    effect,
                    1,
                    crit == "Critical",
                    cond or None,
                    tuple((p.mnemonic, value, p.name) for p in declared) if value else (),
                )
            )
        return Rubric(mnemonic, tuple(out), name)

    @staticmethod
    def bundled(mnemonic: str, library: CheckLibrary | None = None) -> "Rubric":
        library = library or CheckLibrary()
        for m, name, rows in fixed.RUBRICS:
            if m == mnemonic:
                return Rubric.from_rows(m, name, rows, library)
        raise KeyError(mnemonic)


def _params(raw) -> tuple[tuple[str, str, str], ...]:
    out = []
    for p in raw or []:
        low = {k.lower(): v for k, v in p.items()}
        mnemonic = low.get("samparametermnemonic", low.get("parametermnemonic"))
        if low.get("parametervalue") is not None:
            out.append((mnemonic, low["parametervalue"], low.get("parametername")))
    return tuple(out)


@dataclass
class Probe:
    index: int
    defn: CheckDef
    params: tuple[tuple[str, str], ...]
    entities: set[str] = field(default_factory=set)
    may_error: bool = False

    @property
    def word(self) -> int:
        return self.index // WORD_BITS

    @property
    def bit(self) -> int:
        return 1 << (self.index % WORD_BITS)

    @property
    def fail_text(self) -> str:
        return self.defn.fail_name or self.defn.name

    def evaluate(self, item: Item, ctx: EvalContext) -> Outcome:
        return self.defn.fn(item, dict(self.params), ctx)


@dataclass
class Compiled:
    """One criterion ready to run."""

    id: int
    criterion: Criterion
    defn: CheckDef
    level: str
    class_mnemonic: str | None
    valid: bool
    chain: list[Probe]
    conditional: CheckDef | None
    conditional_chain: list[Probe]

    @property
    def needs_children(self) -> bool:
        return any("children" in p.defn.needs for p in self.chain + self.conditional_chain)

    @property
    def assessment(self) -> str:
        return self.criterion.name or self.defn.name

    @property
    def own_fail_text(self) -> str:
        c = self.criterion
        for t in (c.failure_name, c.name, self.defn.fail_name):
            if t is not None:
                return t
        return self.defn.name


@dataclass
class CompiledRubric:
    rubric: Rubric
    model: EntityModel
    ctx: EvalContext
    criteria: list[Compiled]
    probes: list[Probe]

    @property
    def words(self) -> int:
        return max(1, -(-len(self.probes) // WORD_BITS))

    @property
    def may_error(self) -> bool:
        return any(p.may_error for p in self.probes)

    @property
    def entities(self) -> set[str]:
        return {c.criterion.entity for c in self.criteria}

    def for_entity(self, entity: str) -> list[Compiled]:
        return [c for c in self.criteria if c.criterion.entity == entity]

    def probes_of(self, criteria: list[Compiled]) -> list[Probe]:
        seen = {}
        for c in criteria:
            for p in c.chain + c.conditional_chain:
                seen[p.index] = p
        return [seen[i] for i in sorted(seen)]

    def late_probes(self, probes: list[Probe]) -> list[Probe]:
        """Probes that need a lookup in another table first."""
        return [
            p
            for p in probes
            if "term" in p.defn.needs
            or "content" in p.defn.needs
            or ("lists" in p.defn.needs and set(v for _, v in p.params) & set(self.table_lists_used()))
        ]

    def needing(self, need: str) -> set[str]:
        """Entities with a check that needs an extra input."""
        return {
            c.criterion.entity
            for c in self.criteria
            if any(need in p.defn.needs for p in c.chain + c.conditional_chain)
        }

    def value_sets_used(self) -> list[str]:
        return sorted(
            {v for p in self.probes if p.defn.mnemonic == "CONCEPT_ISINVALUESET" for _, v in p.params}
        )

    def table_lists_used(self) -> list[str]:
        return sorted(
            {
                v
                for p in self.probes
                if "lists" in p.defn.needs
                for k, v in p.params
                if self.ctx.value_lists.has(v) and not self.ctx.value_lists.is_literal(v)
            }
        )

    def chain_words(self, chain: list[Probe]) -> list[int]:
        masks = [0] * self.words
        for p in chain:
            masks[p.word] |= p.bit
        return masks

    def criteria_frame(self, spark: SparkSession) -> DataFrame:
        """The criteria as a table to join results with: as many rows as the rubric has lines."""
        masks = "".join(f", chain_{w} bigint, cond_{w} bigint" for w in range(self.words))
        schema = (
            "criterion_id int, entity string, sequence int, check string, assessment string, "
            "effect string, is_scoring boolean, weight bigint, is_critical boolean, valid boolean, "
            "cond_check string, own_fail_text string, skip_text string" + masks
        )
        rows = []
        for c in self.criteria:
            k = c.criterion
            skipper = c.conditional if c.valid else self.ctx.library.get(VALIDITY)
            skip_text = (skipper.fail_name or skipper.name) if skipper else None
            chain, cond = self.chain_words(c.chain), self.chain_words(c.conditional_chain)
            rows.append(
                (
                    c.id, k.entity, k.sequence, k.check, c.assessment,
                    SCORING if k.scoring else INFORMATIONAL, k.scoring, k.weight, k.critical, c.valid,
                    c.conditional.mnemonic if c.conditional else None, c.own_fail_text, skip_text,
                    *[m for pair in zip(chain, cond) for m in pair],
                )
            )
        return spark.createDataFrame(rows, schema)


def compile_rubric(rubric: Rubric, model: EntityModel, ctx: EvalContext) -> CompiledRubric:
    """Check a rubric against model and library and number its probes."""
    repeats = [
        k for k, n in Counter((c.entity, c.check, c.sequence) for c in rubric.criteria).items() if n > 1
    ]
    if repeats:
        raise ValueError(f"Criteria repeated for (entity, check, sequence): {repeats}")
    missing = missing_checks(rubric, ctx.library)
    if missing:
        raise ValueError(f"Checks missing from the library: {missing}")

    kinds = {a.mnemonic: a.kind for c in model.classes for a in c.attributes}
    found: dict[tuple, Probe] = {}
    depth: dict[tuple, int] = {}

    def chain_for(check: str, entity: str, bound: tuple) -> list[tuple]:
        keys, earlier = [], set()
        for d, defn in enumerate(ctx.library.chain(check)):
            key = (defn.mnemonic, bound if defn.mnemonic == check else ())
            probe = found.setdefault(key, Probe(-1, defn, key[1]))
            probe.entities.add(entity)
            if not key[1] and any(not p.optional for p in defn.params):
                probe.may_error = True
            if "lists" in defn.needs and not any(ctx.value_lists.has(v) for _, v in key[1]):
                probe.may_error = True
            probe.may_error = probe.may_error or defn.may_error(kinds.get(entity, "ITEM"), earlier, ctx)
            depth[key] = d
            earlier.add(defn.mnemonic)
            keys.append(key)
        return keys

    staged = []
    for c in rubric.criteria:
        try:
            level = model.level_of(c.entity)
        except KeyError:
            continue  # an entity the model does not have matches no item
        defn = ctx.library.get(c.check)
        valid = parameters_given(defn, c)
        chain = chain_for(c.check, c.entity, _bind(defn, c.params, c.processing)) if valid else []
        cond_def = ctx.library.get(c.conditional) if c.conditional else None
        cond = (
            chain_for(c.conditional, c.entity, _bind(cond_def, c.conditional_params))
            if cond_def and valid
            else []
        )
        staged.append((c, defn, level, valid, chain, cond_def, cond))

    for i, key in enumerate(sorted(found, key=lambda k: (depth[k], list(found).index(k)))):
        found[key].index = i
    probes = sorted(found.values(), key=lambda p: p.index)
    criteria = [
        Compiled(
            i, c, defn, level, model.class_of(c.entity), valid,
            [found[k] for k in chain], cond_def, [found[k] for k in cond],
        )
        for i, (c, defn, level, valid, chain, cond_def, cond) in enumerate(staged)
    ]
    return CompiledRubric(rubric, model, ctx, criteria, probes)


def missing_checks(rubric: Rubric, library: CheckLibrary) -> list[str]:
    """Checks a rubric names that the library does not have."""
    named = {c.check for c in rubric.criteria} | {c.conditional for c in rubric.criteria if c.conditional}
    return sorted(m for m in named if m not in library)


def parameters_given(defn: CheckDef, criterion: Criterion) -> bool:
    """Every declared parameter is given, by name, with a value."""
    given = {name: value for _, value, name in criterion.params[::-1]}
    return all(given.get(p.name) for p in defn.params)


PROCESSING = "Processing URL"


def _bind(defn: CheckDef, params, processing: str | None = None) -> tuple[tuple[str, str], ...]:
    """Parameters by mnemonic; unknown ones are dropped.  A criterion with parameters
    also hands its processing URL to the check."""
    known = {p.mnemonic for p in defn.params}
    bound = tuple((m, v) for m, v, _ in params if m in known and v is not None)
    return bound + (((PROCESSING, processing),) if processing and params else ())


def load_rubric(spark: SparkSession, index_path: str, mnemonic: str) -> Rubric:
    """A rubric found by mnemonic in a library index; the index's name wins over the file's."""
    entry, text = library_file(spark, index_path, mnemonic)
    return Rubric.from_json(text, entry.get("name"))


# --- deciding criteria from masks ---------------------------------------


REASON_TYPE = "array<struct<pos:int,reason:string>>"


def mask_columns(
    probes: list[Probe],
    words: int,
    item: Item,
    ctx: EvalContext,
    guard=None,
    onto: dict[str, Column] | None = None,
    reasons_from: list[Probe] | None = None,
) -> dict[str, Column]:
    """``f_<word>`` / ``x_<word>`` masks of failed and errored probes for one value,
    and ``reasons`` the checks gave themselves, tagged with the probe number.

    ``guard(probe)`` may return a condition outside of which the probe is not run.
    ``onto`` holds masks and reasons computed earlier that the new ones are added to.
    ``reasons_from`` lists the probes asked for a reason, if not all of ``probes``.
    """
    fail: list[list[Column]] = [[] for _ in range(words)]
    err: list[list[Column]] = [[] for _ in range(words)]
    reasons: list[Column] = []
    asked = {p.index for p in (probes if reasons_from is None else reasons_from)}
    run = {p.index for p in probes}
    for p in [*probes, *[q for q in reasons_from or [] if q.index not in run]]:
        out = p.evaluate(item, ctx)
        only = guard(p) if guard else None
        if out.reason is not None and p.index in asked:
            text = out.reason if only is None else F.when(only, out.reason)
            reasons.append(F.struct(F.lit(p.index).alias("pos"), text.cast("string").alias("reason")))
        if p.index not in run:
            continue

        def bit(flag: Column) -> Column:
            return F.when(flag if only is None else only & flag, F.lit(p.bit)).otherwise(F.lit(0))

        fail[p.word].append(bit(out.failed_flag()))
        if p.may_error:
            err[p.word].append(bit(out.error_flag()))

    def merge(name: str, parts: list[Column]) -> Column:
        total = onto[name] if onto else F.lit(0)
        for c in parts:
            total = total.bitwiseOR(c)
        return total.cast("bigint")

    cols = {f"f_{w}": merge(f"f_{w}", fail[w]) for w in range(words)}
    cols.update({f"x_{w}": merge(f"x_{w}", err[w]) for w in range(words)})
    if reasons:
        given = F.filter(F.array(*reasons), lambda r: r["reason"].isNotNull())
        if onto:
            given = F.concat(F.coalesce(onto["reasons"], F.array().cast(REASON_TYPE)), given)
        cols["reasons"] = given
    elif onto is None:
        cols["reasons"] = F.lit(None).cast(REASON_TYPE)
    return cols


def first_bad(chain: list, fail: list[Column], err: list[Column]) -> tuple[Column, Column]:
    """Number of the first probe of a chain that failed or errored (NULL when all
    passed), and whether it errored.  ``chain`` holds one mask per word, as
    Columns or plain integers."""
    pos, errored = [], []
    for w, mask in enumerate(chain):
        if isinstance(mask, int):
            if mask == 0:
                continue
            mask = F.lit(mask).cast("bigint")
        bad = fail[w].bitwiseOR(err[w]).bitwiseAND(mask)
        lowest = bad.bitwiseAND(F.negative(bad))
        pos.append(F.when(bad != 0, F.bit_count(lowest - 1) + F.lit(w * WORD_BITS)))
        errored.append(F.when(bad != 0, lowest.bitwiseAND(err[w]) != 0))
    if not pos:
        return F.lit(None).cast("int"), F.lit(False)
    return F.coalesce(*pos), F.coalesce(*errored, F.lit(False))


def state_code(valid, cond_pos: Column, cond_err: Column, own_pos: Column, own_err: Column) -> Column:
    if isinstance(valid, bool):
        valid = F.lit(valid)
    return (
        F.when(~valid, F.lit(SKIPPED))
        .when(cond_err, F.lit(ERRORED))
        .when(cond_pos.isNotNull(), F.lit(SKIPPED))
        .when(own_err, F.lit(ERRORED))
        .when(own_pos.isNotNull(), F.lit(FAILED))
        .otherwise(F.lit(PASSED))
        .cast("tinyint")
    )


def criterion_code(c: Compiled, compiled: CompiledRubric, fail: list[Column], err: list[Column]) -> Column:
    """State code of one criterion from the masks of its value."""
    cond_pos, cond_err = first_bad(compiled.chain_words(c.conditional_chain), fail, err)
    own_pos, own_err = first_bad(compiled.chain_words(c.chain), fail, err)
    return state_code(c.valid, cond_pos, cond_err, own_pos, own_err)
