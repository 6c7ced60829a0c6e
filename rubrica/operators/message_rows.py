"""Messages scored in rows: one row an element, its attributes as columns.

A message is parsed once into the typed schema of ``sources.payload`` and exploded to its
elements, never to attributes.  From there it takes the path of tables (``evaluate.evaluate_table``):
masks, states and the counters of an element are computed in its row, also those of criteria that look
at the whole element or at sibling attributes.  Scores per message then need one exchange, the
sum over the message's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.functions.values import Item, raw_columns, raw_item
from rubrica.operators.evaluate import (
    TableSource,
    content_companions,
    evaluate_messages,
    message_results,
    message_scorecards,
    table_results,
    table_scorecards,
)
from rubrica.operators.flatten import elements
from rubrica.plans.rubric import CompiledRubric


def message_source(messages: DataFrame, compiled: CompiledRubric, keys: list[str]) -> TableSource:
    """The root, classes with criteria and all elements of checked messages as rows; rows of a class
    have values in the columns of its attributes that the rubric looks at."""
    model = compiled.model
    asked = {c.mnemonic for c in model.classes} & compiled.entities
    rows = elements(messages, model, keys, always=asked)
    # A class itself is a row only where criteria look at it; the root always is, so that every message has one.
    shown = (F.col("element_seq") > 0) | F.col("class_mnemonic").isNull()
    rows = rows.filter(shown | F.col("class_mnemonic").isin(*sorted(asked)) if asked else shown)
    rows = rows.select(
        *keys,
        "class_mnemonic",
        F.when(F.col("element_seq") > 0, F.col("element_seq")).alias("element_seq"),
        "class_present",
        F.map_values("props").alias("_values"),
        F.transform(F.map_keys("props"), lambda k: F.lower(k)).alias("_names"),
    )
    wanted = compiled.entities | content_companions(compiled)
    own = [(c, a) for c in model.classes for a in c.attributes if a.mnemonic in wanted]
    steps: list[dict] = []
    places, items = {}, {}
    for i, (c, a) in enumerate(own):
        # The first property of that name, whatever its case.
        here = (F.col("class_mnemonic") == c.mnemonic) & F.col("element_seq").isNotNull()
        places[f"_at{i}"] = F.when(here, F.array_position("_names", F.lit(a.field.lower())))
        at = F.col(f"_at{i}")
        for k, step in enumerate(raw_columns(f"_a{i}", a.kind, F.get("_values", (at - 1).cast("int")), F.coalesce(at > 0, F.lit(False)))):
            if k == len(steps):
                steps.append({})
            steps[k] |= step
        # Attributes without criteria are read for systems, codes and texts alone.
        items[a.mnemonic] = raw_item(f"_a{i}", a.kind, compiled.ctx.data_types, a.mnemonic in compiled.entities)
    for entity, kind in [(model.root_mnemonic, "ROOT"), *[(m, "CLS") for m in sorted(asked)]]:
        present = F.col("class_present")
        items[entity] = Item.of_text(F.when(present, F.lit("")), present)
    rows = rows.withColumns(places) if places else rows
    for step in steps:
        rows = rows.withColumns(step)
    return TableSource(rows, None, list(keys), items, element_seq=F.col("element_seq"))


#: Probes of all entities up to which a rubric is planned in rows; beyond, items are rows and share one plan
#: of each probe.  Both ways give the same results: the choice looks at the rubric alone.
ROW_PROBES = 80


def planned_in_rows(compiled: CompiledRubric) -> bool:
    """Whether a rubric's criteria become columns of one row.  Checks that read siblings need that."""
    probes = sum(len(compiled.probes_of(compiled.for_entity(e))) for e in compiled.entities)
    return probes <= ROW_PROBES or any("content" in p.defn.needs for p in compiled.probes)


def message_cards(messages: DataFrame, compiled: CompiledRubric, keys: list[str]) -> DataFrame:
    """Scorecards of checked messages: one an element, class with criteria, and root."""
    if planned_in_rows(compiled):
        return table_scorecards(message_source(messages, compiled, keys), compiled)
    return message_scorecards(evaluate_messages(messages, compiled, keys), compiled, keys)


def message_rows(messages: DataFrame, compiled: CompiledRubric, keys: list[str]) -> DataFrame:
    """Result rows of checked messages: one an item and criterion, with reasons."""
    if planned_in_rows(compiled):
        return table_results(message_source(messages, compiled, keys), compiled)
    late = any(c.needs_children for c in compiled.criteria)
    return message_results(evaluate_messages(messages, compiled, keys, store=late), compiled, keys)
