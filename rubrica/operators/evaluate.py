"""Evaluate a compiled rubric.

Two sources, one result shape:

* messages, in long form (one row per item, see ``flatten``);
* ordinary tables, in wide form (one row is one element, attributes are
  columns), where masks and counters are computed in the row.

Both give an *evaluated* frame (probe masks per item), from which
``results`` derives one row per item and criterion, and *scorecards* (16
additive counters per element) for the roll-ups.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.functions.stored import stored_columns
from rubrica.functions.text import parse_double
from rubrica.functions.values import TERM_TYPE, Item, null, parse_values, parsed_item
from rubrica.operators.checks import content_key, list_values
from rubrica.operators.content import text_in_content_set, unit_is_primary, value_in_range_set
from rubrica.operators.flatten import flatten
from rubrica.operators.terminology import attach_lists, attach_terms
from rubrica.plans.checks import ERRORED, FAILED, PASSED, SKIPPED, VALIDITY
from rubrica.plans.rubric import (
    Compiled,
    CompiledRubric,
    Probe,
    criterion_code,
    first_bad,
    mask_columns,
    state_code,
)

STATE_NAMES = {FAILED: "Failed", PASSED: "Passed", SKIPPED: "Skipped", ERRORED: "Errored"}

COUNTERS = (
    "scoring_total",
    "scoring_skip",
    "scoring_processed",
    "scoring_pass",
    "scoring_fail",
    "weighted_total",
    "weighted_skip",
    "weighted_processed",
    "weighted_pass",
    "weighted_fail",
    "info_total",
    "info_skip",
    "info_processed",
    "info_pass",
    "info_fail",
    "critical_fail",
)


# --- long form: messages ------------------------------------------------

_MODEL_COLUMNS = ("level", "class_mnemonic", "element", "name", "kind")


def evaluate_items(
    items: DataFrame, compiled: CompiledRubric, keys: list[str], keep: list[str] = ()
) -> DataFrame:
    """Masks for the items of ``flatten`` (criteria that look at whole elements are
    left for :func:`second_stage`).

    Probes that only read the value run first, so that the rows which then meet
    the terminology carry masks and coding keys instead of texts.
    """
    ctx = compiled.ctx
    probes = compiled.probes_of([c for c in compiled.criteria if not c.needs_children])
    late = compiled.late_probes(probes)
    early = [p for p in probes if p not in late]
    if any("content" in p.defn.needs for p in late):
        raise ValueError("Content checks read other attributes of the element: use operators.message_rows.")

    # What the model and the rubric say about an entity: one row each.
    words = range(compiled.words)
    facts = []
    for cls, _, _, _, level, entity, _, name, kind in compiled.model.rows():
        element = compiled.model.data_class(cls).element_mnemonic if level in ("element", "attribute") else None
        need = compiled.chain_words(compiled.probes_of(compiled.for_entity(entity)))
        facts.append((entity, level, cls, element, name, kind, *need))
    schema = ", ".join(["entity string"] + [f"{c} string" for c in _MODEL_COLUMNS] + [f"_need_{w} bigint" for w in words])
    about = items.sparkSession.createDataFrame(facts, schema)
    if len({f[0] for f in facts}) < len(facts):
        raise ValueError("Entity mnemonics of a model must be unique.")
    needs = about.select("entity", *[f"_need_{w}" for w in words])

    def guard(p) -> Column:
        return F.col(f"_need_{p.word}").bitwiseAND(F.lit(p.bit)) != 0

    parsed = parse_values(items, ctx.data_types).join(F.broadcast(needs), "entity", "left")
    item = parsed_item()
    lookups: dict[str, Column] = {}
    scope: dict[str, Column] = {}
    if any("term" in p.defn.needs for p in late):
        scope["_codings"] = F.col("entity").isin(*sorted(compiled.needing("term")))
        lookups["_codings"] = F.when(scope["_codings"] & (F.size("v_codings") > 0), F.col("v_codings"))
    if any("lists" in p.defn.needs for p in late):
        scope["_values"] = F.col("entity").isin(*sorted(compiled.needing("lists")))
        lookups["_values"] = F.when(scope["_values"], list_values(item))
    # Rows that go through a join leave behind what their entity tells anyway.
    dropped = ("raw", *_MODEL_COLUMNS) if late else ("raw",)
    base = [c for c in items.columns if c not in dropped]
    listed = [p for p in late if "lists" in p.defn.needs]
    masks = mask_columns(early, compiled.words, item, ctx, guard, reasons_from=early + listed)
    df = parsed.select(
        *base,
        *keep,
        *[c.alias(n) for n, c in lookups.items()],
        *[c.alias(n) for n, c in masks.items()],
    )
    if not late:
        return df
    term = lists = None
    # The lists are looked at twice, to resolve them and to join the answers: parse them once.
    df = stored_columns(df)
    if "_codings" in lookups:
        df = attach_terms(df, {"_codings": "_term"}, compiled)
        term = F.col("_term")
    if "_values" in lookups:
        df = attach_lists(df, {"_values": "_lists"}, compiled)
        lists = F.col("_lists")
    df = df.join(F.broadcast(about), "entity")
    bare = replace(
        Item.empty(),
        present=F.col("present"),
        kind=F.col("kind"),
        term=null(TERM_TYPE) if term is None else term,
        lists=null("array<string>") if lists is None else lists,
    )
    done = {n: F.col(n) for n in masks}
    by_term = [p for p in late if p not in listed]
    df = df.withColumns(mask_columns(late, compiled.words, bare, ctx, guard, done, by_term))
    return df.drop("_codings", "_values", "_term", "_lists", *[f"_need_{w}" for w in words])


def evaluate_messages(
    messages: DataFrame,
    compiled: CompiledRubric,
    keys: list[str],
    all_attributes: bool = False,
    carry: list[str] = (),
    keep: list[str] = (),
    store: bool = False,
) -> DataFrame:
    """Evaluated items of checked messages (rows with an error message are left out).
    ``keep`` names value columns of ``parse_values`` to hold on to.  ``store`` writes the
    items to the shared folder, for callers that derive several results from them."""
    wanted = None if all_attributes else compiled.entities
    items = flatten(messages, compiled.model, keys, wanted, carry)
    evaluated = evaluate_items(items, compiled, keys, keep)
    return stored_columns(evaluated) if store else evaluated


def results(
    evaluated: DataFrame, compiled: CompiledRubric, keys: list[str], keep: list[str] = (), outer: bool = False
) -> DataFrame:
    """One row per item and criterion.  ``outer`` also keeps items without criteria."""
    rules = compiled.criteria_frame(evaluated.sparkSession)
    late = [c.id for c in compiled.criteria if c.needs_children]
    if late and "child_fails" not in evaluated.columns:
        rules = rules.filter(~F.col("criterion_id").isin(*late))
    joined = evaluated.join(F.broadcast(rules), "entity", "left" if outer else "inner")
    return _decide(joined, compiled, keys, keep)


def _decide(joined: DataFrame, compiled: CompiledRubric, keys: list[str], keep: list[str]) -> DataFrame:
    words = range(compiled.words)
    fail = [F.col(f"f_{w}") for w in words]
    err = [F.col(f"x_{w}") for w in words]
    cond_pos, cond_err = first_bad([F.col(f"cond_{w}") for w in words], fail, err)
    own_pos, own_err = first_bad([F.col(f"chain_{w}") for w in words], fail, err)
    staged = joined.withColumns(
        {"_cp": cond_pos, "_ce": cond_err, "_op": own_pos, "_oe": own_err}
    ).withColumn(
        "state_code",
        F.when(
            F.col("criterion_id").isNotNull(),
            state_code(F.col("valid"), F.col("_cp"), F.col("_ce"), F.col("_op"), F.col("_oe")),
        ),
    )
    checks = F.array(*[F.lit(p.defn.mnemonic) for p in compiled.probes])
    texts = F.array(*[F.lit(p.fail_text) for p in compiled.probes])
    failed = F.col("state_code") == FAILED
    skipped = F.col("state_code") == SKIPPED
    errored = F.col("state_code") == ERRORED
    by_condition = F.col("valid") & F.col("_cp").isNotNull()
    decided = F.when(by_condition, F.col("_cp")).when(F.col("valid"), F.col("_op"))
    own_reason = F.get(
        F.filter("reasons", lambda r: r["pos"] == F.col("_d")), 0
    )["reason"]
    staged = staged.withColumn("_d", decided)
    culprit = F.get(checks, F.col("_d"))
    errors = F.array(
        *[
            F.lit(_error_text(p, compiled))
            for p in compiled.probes
        ]
    )
    names = F.create_map(*[F.lit(x) for kv in STATE_NAMES.items() for x in kv])
    fail_check = F.when(failed, culprit)
    own_failed = culprit == F.col("check")
    reason = (
        F.when(failed, F.coalesce(own_reason, F.when(own_failed, F.col("own_fail_text")).otherwise(F.get(texts, F.col("_d")))))
        .when(skipped, F.coalesce(own_reason, F.col("skip_text")))
        .when(errored, F.get(errors, F.col("_d")))
        .otherwise(F.lit(""))
    )
    return staged.select(
        *keys,
        *keep,
        "level",
        "class_mnemonic",
        "element_seq",
        "entity",
        "name",
        "criterion_id",
        "sequence",
        "check",
        "assessment",
        "effect",
        "is_scoring",
        "weight",
        "is_critical",
        "state_code",
        F.try_element_at(names, F.col("state_code").cast("int")).alias("state"),
        fail_check.alias("fail_check"),
        F.when(skipped, F.when(F.col("valid"), F.col("cond_check")).otherwise(F.lit(VALIDITY))).alias("skip_check"),
        reason.alias("reason"),
    )


def _error_text(probe, compiled: CompiledRubric) -> str:
    if not probe.may_error:
        return ""
    text = probe.evaluate(Item.empty(), compiled.ctx).error_text
    return f"{probe.defn.mnemonic} failed to process : {text}"


def _flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def counter_columns() -> dict[str, Column]:
    """The 16 counters of one result row."""
    code, scoring, w = F.col("state_code"), F.col("is_scoring"), F.col("weight")
    have = code.isNotNull()
    bad = code.isin(FAILED)
    states = {
        "total": have,
        "skip": code == SKIPPED,
        "processed": code.isin(PASSED, FAILED),
        "pass": code == PASSED,
        "fail": bad,
    }
    out: dict[str, Column] = {}
    for name, cond in states.items():
        out[f"scoring_{name}"] = _flag(scoring & cond)
    for name, cond in states.items():
        out[f"weighted_{name}"] = F.when(scoring & cond, w).otherwise(F.lit(0)).cast("bigint")
    for name, cond in states.items():
        out[f"info_{name}"] = _flag(~scoring & cond)
    out["critical_fail"] = _flag(scoring & bad & F.col("is_critical"))
    return out


def scorecards_from_results(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Scorecards per element from result rows made with ``outer=True``.

    Class-level rows form their own card with element_seq NULL, root-level rows
    one with class_mnemonic NULL.
    """
    counters = counter_columns()
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in counters.items()]
    return rows.groupBy(*keys, "class_mnemonic", "element_seq").agg(
        *sums,
        F.max(F.when(F.col("level") == "element", 1).otherwise(0)).cast("bigint").alias("is_element"),
        F.coalesce(F.sum(_flag(F.col("state_code") == ERRORED)), F.lit(0)).alias("errors"),
        F.sum(_flag((F.col("level") == "attribute") & (F.col("state_code") == FAILED))).alias("attribute_fails"),
    )


def second_stage(cards: DataFrame, compiled: CompiledRubric, keys: list[str]) -> DataFrame:
    """Evaluated element items for criteria that look at the attribute results of
    their element.  Failures of scoring and informational attribute criteria both count,
    those of other criteria of the element do not."""
    late = [c for c in compiled.criteria if c.needs_children]
    probes = compiled.probes_of(late)
    names = {c.class_mnemonic: c.criterion.entity for c in late}
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    item = replace(Item.empty("ELM"), child_fails=F.col("attribute_fails"))
    return (
        cards.filter((F.col("is_element") == 1) & F.col("class_mnemonic").isin(*names))
        .withColumns(
            {
                "level": F.lit("element"),
                "entity": F.try_element_at(F.create_map(*pairs), F.col("class_mnemonic")),
                "child_fails": F.col("attribute_fails"),
            }
        )
        .withColumn("name", F.col("entity"))
        .withColumns(mask_columns(probes, compiled.words, item, compiled.ctx))
    )


def _late_results(cards: DataFrame, compiled: CompiledRubric, keys: list[str], keep: list[str] = ()) -> DataFrame:
    late = [c.id for c in compiled.criteria if c.needs_children]
    rules = compiled.criteria_frame(cards.sparkSession).filter(F.col("criterion_id").isin(*late))
    joined = second_stage(cards, compiled, keys).join(F.broadcast(rules), "entity")
    return _decide(joined, compiled, keys, list(keep))


def message_scorecards(evaluated: DataFrame, compiled: CompiledRubric, keys: list[str]) -> DataFrame:
    """Scorecards per element of a message, both stages added up."""
    cards = scorecards_from_results(results(evaluated, compiled, keys, outer=True), keys)
    if not any(c.needs_children for c in compiled.criteria):
        return cards
    late = [c for c in compiled.criteria if c.needs_children]
    item = replace(Item.empty("ELM"), child_fails=F.col("attribute_fails"))
    masks = mask_columns(compiled.probes_of(late), compiled.words, item, compiled.ctx)
    masks.pop("reasons", None)
    staged = cards.withColumns(masks)
    words = range(compiled.words)
    fail, err = [F.col(f"f_{w}") for w in words], [F.col(f"x_{w}") for w in words]
    codes = {}
    for c in late:
        applies = (F.col("is_element") == 1) & (F.col("class_mnemonic") == c.class_mnemonic)
        codes[f"_s{c.id}"] = F.when(applies, criterion_code(c, compiled, fail, err))
    staged = staged.withColumns(codes)
    extra = wide_counters(late, {c.id: F.col(f"_s{c.id}") for c in late})
    return staged.select(
        *keys,
        "class_mnemonic",
        "element_seq",
        *[(F.col(n) + extra[n]).alias(n) for n in COUNTERS],
        "is_element",
        (F.col("errors") + extra["errors"]).alias("errors"),
    )


def message_results(
    evaluated: DataFrame, compiled: CompiledRubric, keys: list[str], keep: list[str] = ()
) -> DataFrame:
    """All result rows of messages, both stages."""
    rows = results(evaluated, compiled, keys, keep)
    if not any(c.needs_children for c in compiled.criteria):
        return rows
    cards = scorecards_from_results(results(evaluated, compiled, keys, outer=True), keys)
    late = _late_results(cards, compiled, keys)
    return rows.unionByName(late, allowMissingColumns=True)


# --- wide form: tables --------------------------------------------------


def wide_counters(criteria: list[Compiled], codes: dict[int, Column]) -> dict[str, Column]:
    """The 16 counters of a row from the state codes of its criteria.

    Codes are packed into one bit set per state; a counter is then the number
    of set bits under the mask of the criteria that feed it.
    """
    words = max(1, -(-len(criteria) // 62))
    order = {c.id: i for i, c in enumerate(criteria)}

    def packed(state: int, w: int) -> Column:
        total = F.lit(0).cast("bigint")
        for c in criteria:
            if order[c.id] // 62 == w:
                bit = F.when(codes[c.id] == state, F.lit(1 << (order[c.id] % 62))).otherwise(F.lit(0))
                total = total.bitwiseOR(bit.cast("bigint"))
        return total

    sets = {s: [packed(s, w) for w in range(words)] for s in (PASSED, FAILED, SKIPPED, ERRORED)}

    def mask(pick, w: int) -> int:
        return sum(1 << (order[c.id] % 62) for c in criteria if order[c.id] // 62 == w and pick(c))

    def count(states, pick) -> Column:
        total = F.lit(0).cast("bigint")
        for s in states:
            for w in range(words):
                m = mask(pick, w)
                if m:
                    total = total + F.bit_count(sets[s][w].bitwiseAND(F.lit(m).cast("bigint")))
        return total.cast("bigint")

    groups = {
        "total": (PASSED, FAILED, SKIPPED, ERRORED),
        "skip": (SKIPPED,),
        "processed": (PASSED, FAILED),
        "pass": (PASSED,),
        "fail": (FAILED,),
    }
    out: dict[str, Column] = {}
    weights = sorted({c.criterion.weight for c in criteria if c.criterion.scoring})
    for name, states in groups.items():
        out[f"scoring_{name}"] = count(states, lambda c: c.criterion.scoring)
        weighted = F.lit(0).cast("bigint")
        for w in weights:
            if w:
                weighted = weighted + F.lit(w) * count(
                    states, lambda c, w=w: c.criterion.scoring and c.criterion.weight == w
                )
        out[f"weighted_{name}"] = weighted
        out[f"info_{name}"] = count(states, lambda c: not c.criterion.scoring)
    out["critical_fail"] = count((FAILED,), lambda c: c.criterion.scoring and c.criterion.critical)
    out["errors"] = count((ERRORED,), lambda c: True)
    return out


@dataclass
class TableSource:
    """A table read as elements of one class.

    ``keys`` name the message a row belongs to; ``items`` maps attribute
    mnemonics to :class:`Item` builders over the table's columns.  Without ``class_mnemonic`` the rows
    are of any class, which their column of that name tells; a row without ``element_seq`` is then a
    class itself, and one without a class the root.
    """

    df: DataFrame
    class_mnemonic: str | None
    keys: list[str]
    items: dict[str, Item]
    carry: list[str] = None
    element_seq: Column | None = None

    def __post_init__(self):
        self.carry = list(self.carry or [])


def content_inputs(name: str, mnemonic: str, item: Item, params: dict, items: dict[str, Item], ctx) -> list[Column]:
    """What a content check compares: the item's text, or system and code and unit taken from other
    attributes of the row, with the item's number where it is looked up in ranges."""
    if mnemonic == "TEXT_IN_CONTENT_SET":
        return [item.text.alias(f"{name}_text")]
    out = []
    if mnemonic == "VALUE_IN_RANGE_SET":
        out.append(F.coalesce(item.number, parse_double(item.text)).alias(f"{name}_value"))

    def other(key: str) -> Item:
        if params[key] not in items:
            raise ValueError(f"{params[key]} is no attribute with a criterion or value in this rubric's class.")
        return items[params[key]]

    if "CODE_ATTRIBUTE" in params:
        first = F.get(other("CODE_ATTRIBUTE").codings, 0)
        canonical = ctx.code_systems.canonical_col
        system = F.coalesce(canonical(F.get(F.filter(first["systems"], lambda s: canonical(s).isNotNull()), 0)), first["system"])
        out += [system.alias(f"{name}_system"), first["code"].alias(f"{name}_code")]
    unit = other("UNIT_ATTRIBUTE").text if "UNIT_ATTRIBUTE" in params else item.text
    return [*out, unit.alias(f"{name}_unit")]


def content_answer(df: DataFrame, name: str, mnemonic: str, params: dict, ctx) -> DataFrame:
    """Add ``<name>_ok``, the answer of one content check."""
    content_set, out = params["CONTENT_SET"], f"{name}_ok"
    marts = ctx.content

    def canonical(table: DataFrame) -> DataFrame:
        return table.withColumn("system", F.coalesce(ctx.code_systems.canonical_col(F.col("system")), F.col("system")))

    if mnemonic == "TEXT_IN_CONTENT_SET":
        return df.withColumn(out, F.lit(False)) if marts.texts is None else text_in_content_set(df, marts.texts, content_set, f"{name}_text", out)
    table = marts.ranges if mnemonic == "VALUE_IN_RANGE_SET" else marts.units
    if table is None:
        return df.withColumn(out, F.lit(False))
    parts = [f"{name}_system", f"{name}_code", f"{name}_unit"]
    if mnemonic == "VALUE_IN_RANGE_SET":
        return value_in_range_set(df, canonical(table), content_set, *parts, f"{name}_value", out)
    return unit_is_primary(df, canonical(table), content_set, *parts, out)


_ITEM_FIELDS = ("present", "kind", "text", "codings", "type_code", "number", "number2", "low", "high")


@dataclass(frozen=True)
class Slot:
    """An entity that rows of a source may hold; ``here`` tells which do, None for all."""

    entity: str
    label: str
    kind: str
    level: str
    owner: str | None
    here: Column | None = None

    def only(self, value: Column) -> Column:
        return value if self.here is None else F.when(self.here, value)


def source_slots(source: TableSource, compiled: CompiledRubric) -> list[Slot]:
    """Attributes, classes and the root with criteria, in model order."""
    model, one = compiled.model, source.class_mnemonic
    if one is not None:
        return [Slot(a.mnemonic, a.label, a.kind, "attribute", one) for a in model.data_class(one).attributes if compiled.for_entity(a.mnemonic)]
    cls, is_element = F.col("class_mnemonic"), F.col("element_seq").isNotNull()
    out = []
    for owner, _, _, _, level, entity, _, label, kind in model.rows():
        if level == "element" or not compiled.for_entity(entity):
            continue
        here = cls.isNull() if owner is None else (cls == owner) & (is_element if level == "attribute" else ~is_element)
        out.append(Slot(entity, label, kind, level, owner, F.coalesce(here, F.lit(False))))
    return out


def element_slots(source: TableSource, compiled: CompiledRubric) -> list[Slot]:
    """Elements with criteria."""
    out = []
    for c in compiled.model.classes:
        if source.class_mnemonic not in (None, c.mnemonic) or not compiled.for_entity(c.element_mnemonic):
            continue
        here = None
        if source.class_mnemonic is None:
            here = F.coalesce((F.col("class_mnemonic") == c.mnemonic) & F.col("element_seq").isNotNull(), F.lit(False))
        out.append(Slot(c.element_mnemonic, c.label, "ELM", "element", c.mnemonic, here))
    return out


def content_companions(compiled: CompiledRubric) -> set[str]:
    """Attributes that content checks read beside their own."""
    return {v for p in compiled.probes if "content" in p.defn.needs for k, v in p.params if k in ("CODE_ATTRIBUTE", "UNIT_ATTRIBUTE")}


def evaluate_table(source: TableSource, compiled: CompiledRubric) -> DataFrame:
    """Masks per attribute and one state code per criterion, in the row.

    Columns: keys, carry, class_mnemonic, element_seq, ``<i>_f_<w>``,
    ``<i>_x_<w>``, ``<i>_reasons`` per evaluated entity i, ``s_<criterion id>``.
    """
    model, ctx = compiled.model, compiled.ctx
    entities = source_slots(source, compiled)
    companions = content_companions(compiled)
    classes = [c for c in model.classes if source.class_mnemonic in (None, c.mnemonic)]
    known = {s.entity for s in entities}
    read = [(s.entity, s.kind) for s in entities]
    read += [(a.mnemonic, a.kind) for c in classes for a in c.attributes if a.mnemonic in companions and a.mnemonic not in known]
    head = [*source.keys, *source.carry, *([] if source.class_mnemonic else ["class_mnemonic"])]

    # Stage 0: typed values as plain columns, so that each is computed once.
    cols: list[Column] = []
    items: dict[str, Item] = {}
    given: dict[str, Column] = {}
    for i, (entity, kind) in enumerate(read):
        item = source.items.get(entity)
        if item is None:
            item = replace(Item.empty(kind), present=F.lit(False))
        elif item.given is not None:
            given[f"_g{i}_text"], given[f"_g{i}_codings"], settle = item.given
            item = settle(F.col(f"_g{i}_text"), F.col(f"_g{i}_codings"))
        fields = {}
        for f in _ITEM_FIELDS:
            cols.append(getattr(item, f).alias(f"v{i}_{f}"))
            fields[f] = F.col(f"v{i}_{f}")
        items[entity] = Item(
            **fields, term=item.term, lists=null("array<string>"), child_fails=F.lit(0)
        )
    seq = F.lit(None).cast("int") if source.element_seq is None else source.element_seq
    df = source.df.withColumns(given) if given else source.df
    df = df.select(*head, seq.alias("element_seq"), *cols)

    # Stage 1: masks of the probes that only read the value.
    mine = {s.entity: compiled.probes_of(compiled.for_entity(s.entity)) for s in entities}
    late = {m: compiled.late_probes(ps) for m, ps in mine.items()}
    cols, lookups, lists = [], {}, {}
    asked_content: list[tuple[int, Probe]] = []
    for i, s in enumerate(entities):
        m = s.entity
        early = [p for p in mine[m] if p not in late[m]]
        asked = early + [p for p in late[m] if "lists" in p.defn.needs]
        masks = mask_columns(early, compiled.words, items[m], ctx, reasons_from=asked)
        cols += [s.only(c).alias(f"e{i}_{n}") for n, c in masks.items()]
        if late[m]:
            cols += [F.col(f"v{i}_present"), F.col(f"v{i}_kind")]
        if any("term" in p.defn.needs for p in late[m]):
            cols.append(s.only(F.col(f"v{i}_codings")).alias(f"v{i}_codings"))
            lookups[f"v{i}_codings"] = f"v{i}_term"
        if any("lists" in p.defn.needs for p in late[m]):
            cols.append(s.only(list_values(items[m])).alias(f"v{i}_values"))
            lists[f"v{i}_values"] = f"v{i}_lists"
        for p in late[m]:
            if "content" in p.defn.needs:
                asked_content.append((i, p))
                cols += content_inputs(f"k{i}_{p.index}", p.defn.mnemonic, items[m], dict(p.params), items, ctx)
    df = df.select(*head, "element_seq", *cols)

    # Stage 1b: lookups in other tables, and the probes that need them.
    if lookups or lists or asked_content:
        df = attach_terms(df, lookups, compiled)
        df = attach_lists(df, lists, compiled)
        hits: dict[int, list[Column]] = {}
        none = F.array().cast("array<string>")
        for i, p in asked_content:
            name = f"k{i}_{p.index}"
            df = content_answer(df, name, p.defn.mnemonic, dict(p.params), ctx)
            key = F.lit(content_key(p.defn.mnemonic, dict(p.params)))
            hits.setdefault(i, []).append(F.when(F.col(f"{name}_ok"), F.array(key)).otherwise(none))
        found = {}
        for i, keys_of in hits.items():
            in_lists = F.col(f"v{i}_lists") if f"v{i}_values" in lists else null("array<string>")
            found[f"v{i}_lists"] = F.concat(F.coalesce(in_lists, none), *keys_of)
        df = df.withColumns(found) if found else df
        more: dict[str, Column] = {}
        for i, s in enumerate(entities):
            if not late[s.entity]:
                continue
            bare = replace(
                Item.empty(),
                present=F.col(f"v{i}_present"),
                kind=F.col(f"v{i}_kind"),
                term=F.col(f"v{i}_term") if f"v{i}_codings" in lookups else null(TERM_TYPE),
                lists=F.col(f"v{i}_lists") if f"v{i}_values" in lists or i in hits else null("array<string>"),
            )
            done = {n: F.col(f"e{i}_{n}") for w in range(compiled.words) for n in (f"f_{w}", f"x_{w}")}
            done["reasons"] = F.col(f"e{i}_reasons")
            probes = late[s.entity]
            by_term = [p for p in probes if "lists" not in p.defn.needs]
            added = mask_columns(probes, compiled.words, bare, ctx, onto=done, reasons_from=by_term)
            more.update({f"e{i}_{n}": s.only(c) for n, c in added.items()})
        df = df.withColumns(more)

    # Stage 2: state codes of the criteria.
    words = range(compiled.words)
    code_cols: dict[str, Column] = {}
    of_class: dict[str | None, list[str]] = {}
    for i, s in enumerate(entities):
        fail = [F.col(f"e{i}_f_{w}") for w in words]
        err = [F.col(f"e{i}_x_{w}") for w in words]
        for c in compiled.for_entity(s.entity):
            code_cols[f"s_{c.id}"] = s.only(criterion_code(c, compiled, fail, err))
            if s.level == "attribute":
                of_class.setdefault(s.owner, []).append(f"s_{c.id}")
    df = df.withColumns(code_cols) if code_cols else df

    # Stage 3: criteria on the elements themselves.
    for n, s in enumerate(element_slots(source, compiled), start=len(entities)):
        last = compiled.for_entity(s.entity)
        fails = F.lit(0).cast("bigint")
        for name in of_class.get(s.owner, []):
            fails = fails + _flag(F.col(name) == FAILED)
        item = replace(Item.empty("ELM"), child_fails=F.col("_child_fails"))
        own = mask_columns(compiled.probes_of(last), compiled.words, item, ctx)
        df = df.withColumn("_child_fails", fails).withColumns({f"e{n}_{k}": s.only(v) for k, v in own.items()})
        fail = [F.col(f"e{n}_f_{w}") for w in words]
        err = [F.col(f"e{n}_x_{w}") for w in words]
        df = df.withColumns({f"s_{c.id}": s.only(criterion_code(c, compiled, fail, err)) for c in last}).drop("_child_fails")
    return df.withColumn("class_mnemonic", F.lit(source.class_mnemonic)) if source.class_mnemonic else df


def table_criteria(source: TableSource, compiled: CompiledRubric) -> list[Compiled]:
    mine = {s.entity for s in source_slots(source, compiled) + element_slots(source, compiled)}
    return [c for c in compiled.criteria if c.criterion.entity in mine]


def message_level_items(source: TableSource, compiled: CompiledRubric) -> DataFrame | None:
    """Root and class items of the messages in a table, one of each per message key;
    None when no criterion looks at them.  The class of the table is there, others are not."""
    if source.class_mnemonic is None:
        return None
    asked = {c.criterion.entity for c in compiled.criteria if c.level in ("root", "class")}
    rows = [
        (level, cls, entity, name, kind, cls is None or cls == source.class_mnemonic)
        for cls, _, _, _, level, entity, _, name, kind in compiled.model.rows()
        if entity in asked
    ]
    if not rows:
        return None
    item = F.explode(
        F.array(
            *[
                F.struct(*[F.lit(v).alias(n) for n, v in zip(("level", "class_mnemonic", "entity", "name", "kind", "present"), r)])
                for r in rows
            ]
        )
    )
    keys = source.df.select(*source.keys).distinct() if source.keys else source.df.select(F.lit(1).alias("_one")).distinct()
    items = keys.select(*source.keys, item.alias("i")).select(*source.keys, "i.*")
    return items.select(
        *source.keys, "level", "class_mnemonic", F.lit(None).cast("string").alias("element"),
        F.lit(None).cast("int").alias("element_seq"), "entity", "name", "kind", "present", F.lit(None).cast("string").alias("raw"),
    )


def table_scorecards(source: TableSource, compiled: CompiledRubric) -> DataFrame:
    """One scorecard per table row, computed in the row: no shuffle, no explode.  Criteria on
    classes and the root add one card per message key."""
    own = _row_scorecards(source, compiled)
    items = message_level_items(source, compiled)
    if items is None:
        return own
    rows = results(evaluate_items(items, compiled, source.keys), compiled, source.keys)
    cards = scorecards_from_results(rows, source.keys).drop("attribute_fails")
    return own.unionByName(cards, allowMissingColumns=True)


def _row_scorecards(source: TableSource, compiled: CompiledRubric) -> DataFrame:
    df = evaluate_table(source, compiled)
    criteria = table_criteria(source, compiled)
    counters = wide_counters(criteria, {c.id: F.col(f"s_{c.id}") for c in criteria})
    return df.select(
        *source.keys,
        *source.carry,
        "class_mnemonic",
        "element_seq",
        *[counters[n].alias(n) for n in COUNTERS],
        (F.lit(1).cast("bigint") if source.class_mnemonic else _flag(F.col("element_seq").isNotNull())).alias("is_element"),
        counters["errors"].alias("errors"),
    )


def table_results(source: TableSource, compiled: CompiledRubric) -> DataFrame:
    """One row per table row and criterion, with reasons; criteria on classes and the root
    add one row per message key."""
    df = evaluate_table(source, compiled)
    packs = [
        s.only(
            F.struct(
                F.lit(s.level).alias("level"),
                F.lit(s.entity).alias("entity"),
                F.lit(s.label).alias("name"),
                *[F.col(f"e{i}_{k}_{w}").alias(f"{k}_{w}") for w in range(compiled.words) for k in ("f", "x")],
                F.col(f"e{i}_reasons").alias("reasons"),
            )
        )
        for i, s in enumerate(source_slots(source, compiled) + element_slots(source, compiled))
    ]
    if not packs:
        raise ValueError("The rubric has no criterion for the entities of this source.")
    head = [*source.keys, *source.carry]
    # What is not of the row's class is left out after the explode: functions over lists are not compiled.
    long = df.select(*head, "class_mnemonic", "element_seq", F.explode(F.array(*packs)).alias("_p"))
    long = long.filter(F.col("_p").isNotNull()).select(*head, "class_mnemonic", "element_seq", "_p.*")
    rules = compiled.criteria_frame(source.df.sparkSession)
    joined = long.join(F.broadcast(rules), "entity")
    own = _decide(joined, compiled, source.keys, source.carry)
    items = message_level_items(source, compiled)
    if items is None:
        return own
    above = results(evaluate_items(items, compiled, source.keys), compiled, source.keys)
    return own.unionByName(above, allowMissingColumns=True)
