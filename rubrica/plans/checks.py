"""Check registry and the result contract of a check.

A check is a function ``(item, params, ctx) -> Outcome`` over Columns.
Register one with :func:`check`; a pandas UDF may be used inside it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from rubrica.functions.values import Item
    from rubrica.plans.context import EvalContext

POPULATED = "ATTR_ISPOPULATED"
VALIDITY = "EVAL_ISVALID"

FAILED, PASSED, SKIPPED, ERRORED = 0, 1, 2, 3


@dataclass(frozen=True)
class Param:
    name: str
    mnemonic: str
    optional: bool = False


@dataclass(frozen=True)
class Outcome:
    """What a check answers.

    ``passed`` NULL counts as failed.  ``error`` wins over everything else.
    ``skipped`` is a check declining to answer; the criterion then passes.
    ``reason`` overrides the failure text.
    """

    passed: Column
    error: Column | None = None
    error_text: str = ""
    skipped: Column | None = None
    reason: Column | None = None

    def failed_flag(self) -> Column:
        bad = ~F.coalesce(self.passed, F.lit(False))
        if self.skipped is not None:
            bad = bad & ~F.coalesce(self.skipped, F.lit(False))
        return bad

    def error_flag(self) -> Column:
        return F.lit(False) if self.error is None else F.coalesce(self.error, F.lit(False))

    def state(self) -> Column:
        """0 failed, 1 passed, 2 skipped, 3 errored."""
        col = F.when(self.error_flag(), F.lit(ERRORED))
        if self.skipped is not None:
            col = col.when(F.coalesce(self.skipped, F.lit(False)), F.lit(SKIPPED))
        return col.when(self.failed_flag(), F.lit(FAILED)).otherwise(F.lit(PASSED))


CheckFn = Callable[["Item", dict, "EvalContext"], Outcome]


@dataclass(frozen=True)
class CheckDef:
    """A check library entry.

    ``safe_after``: a check that, run earlier in the chain, rules out errors.
    ``kinds``: value kinds it reads; on those it cannot error once populated.
    ``needs``: extra inputs, any of ``term``, ``lists``, ``content``, ``children``.
    """

    mnemonic: str
    name: str
    fail_name: str | None = None
    prerequisite: str | None = None
    params: tuple[Param, ...] = ()
    fn: CheckFn | None = None
    safe_after: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    input_type: str = "Attribute"
    dimension: str | None = None
    can_error: bool = True

    def may_error(self, kind: str, earlier: set[str], ctx: "EvalContext") -> bool:
        if self.mnemonic == "RANGEVALUE_ISVALID":
            return ctx.compat or kind != "RV" or POPULATED not in earlier
        if not self.can_error:
            return False
        if any(s in earlier for s in self.safe_after):
            return False
        return not (self.kinds and kind in self.kinds and POPULATED in earlier)


def _always_fail(item, params, ctx) -> Outcome:
    return Outcome(F.lit(False))


_REGISTRY: dict[str, CheckDef] = {}


def check(mnemonic: str, name: str, **spec):
    """Register a check function under a mnemonic."""

    def wrap(fn: CheckFn) -> CheckFn:
        _REGISTRY[mnemonic] = CheckDef(mnemonic, name, fn=fn, **spec)
        return fn

    return wrap


def registered() -> dict[str, CheckDef]:
    import rubrica.operators.checks  # noqa: F401  (fills the registry)

    return dict(_REGISTRY)


class CheckLibrary:
    """Definitions by mnemonic.  A definition without a registered function
    falls back to a check that always fails."""

    def __init__(self, defs: dict[str, CheckDef] | None = None):
        self._defs = registered() if defs is None else dict(defs)

    def __contains__(self, mnemonic: str) -> bool:
        return mnemonic in self._defs

    def get(self, mnemonic: str) -> CheckDef:
        if mnemonic not in self._defs:
            raise KeyError(f"Check {mnemonic} is not in the check library.")
        d = self._defs[mnemonic]
        return d if d.fn is not None else replace(d, fn=_always_fail, can_error=False)

    def mnemonics(self) -> list[str]:
        return list(self._defs)

    def with_rows(self, rows: list[dict]) -> "CheckLibrary":
        """Overlay library rows (Mnemonic, Name, FailName, Prerequisite...,
        Parameters); functions stay those registered under the mnemonic."""
        defs = dict(self._defs)
        for row in rows:
            low = {k.lower(): v for k, v in row.items()}
            m = low["mnemonic"]
            base = defs.get(m, CheckDef(m, low.get("name") or m))
            prereq = next((v for k, v in low.items() if k.startswith("prerequisite")), None)
            params = tuple(
                Param(p.get("Name") or "", p.get("Mnemonic") or "", bool(p.get("IsOptional")))
                for p in (low.get("parameters") or [])
            )
            defs[m] = replace(
                base,
                name=low.get("name") or base.name,
                fail_name=low.get("failname") or base.fail_name,
                prerequisite=prereq or None,
                params=params or base.params,
                input_type=low.get("inputtype") or base.input_type,
            )
        return CheckLibrary(defs)

    def chain(self, mnemonic: str) -> list[CheckDef]:
        """The check with its prerequisites, first to run first."""
        out: list[CheckDef] = []
        seen: set[str] = set()
        step: str | None = mnemonic
        while step:
            if step in seen:
                raise ValueError(f"Check {step} is its own prerequisite.")
            seen.add(step)
            d = self.get(step)
            out.append(d)
            step = d.prerequisite
        return out[::-1]
