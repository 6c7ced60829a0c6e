"""What an evaluation needs besides data and rubric."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubrica.plans.checks import CheckLibrary
from rubrica.sources import fixed
from rubrica.sources.reference import CodeSystems, ContentMarts, Terminology, ValueLists


@dataclass
class EvalContext:
    """Evaluation time, reference data and the compatibility switch.

    ``as_of`` fixes "now" for the date checks; None reads the clock once per
    query.  ``compat`` keeps the published behaviour of checks that deviate
    from their description (README lists them).  ``data_types`` is the library of
    observation types, see ``reference.read_data_types``; ``content`` holds the tables of
    the content checks.
    """

    as_of: str | dt.datetime | None = None
    compat: bool = True
    library: CheckLibrary = field(default_factory=CheckLibrary)
    code_systems: CodeSystems = field(default_factory=CodeSystems)
    value_lists: ValueLists = field(default_factory=ValueLists)
    terminology: Terminology = field(default_factory=Terminology)
    data_types: tuple = fixed.DATA_TYPES
    content: ContentMarts = field(default_factory=ContentMarts)

    def now(self) -> Column:
        if self.as_of is None:
            return F.current_timestamp()
        if isinstance(self.as_of, dt.datetime):
            return F.lit(self.as_of)
        return F.lit(self.as_of).cast("timestamp")
