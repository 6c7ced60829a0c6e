"""Scoring of records against rubrics as PySpark plans."""

from rubrica.plans.checks import check, CheckDef, Outcome, Param
from rubrica.plans.rubric import Criterion, Rubric, compile_rubric
from rubrica.plans.context import EvalContext
from rubrica.sources.model import EntityModel

__all__ = [
    "CheckDef",
    "Criterion",
    "EntityModel",
    "EvalContext",
    "Outcome",
    "Param",
    "Rubric",
    "check",
    "compile_rubric",
]
