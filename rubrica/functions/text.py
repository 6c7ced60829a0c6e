"""Text, number, date and JSON helpers used by the checks.

All of them are Column expressions, so they stay inside the JVM.  They
never throw under ANSI mode: malformed input gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings accepted as a boolean.
TRUE_WORDS = ("1", "TRUE", "T", "YES", "Y")
FALSE_WORDS = ("0", "FALSE", "F", "NO", "N")

# Date-time shapes accepted besides the general parse.
DATETIME_PATTERNS = (
    r"^(0?[1-9]|1[0-2])[- /.](0?[1-9]|[12][0-9]|3[01])[- /.](\d{4})$",
    r"^\d{8}(0[0-9]|1[0-9]|2[0-3])([0-5][0-9]){2}$",
    r"^\d{8}(0[0-9]|1[0-9]|2[0-3])([0-5][0-9]){2}-((0[0-9]|1[0-9]|2[0-3])([0-5][0-9]){2})$",
    r"^((19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])([01]\d|2[0-3])([0-5]\d)$",
)

INT_SHAPE = r"^\s*[+-]?[0-9]+\s*$"
FLOAT_SHAPE = r"^\s*[+-]?([0-9][0-9,]*\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
NON_FINITE_SHAPE = r"^\s*[+-]?(nan|infinity)\s*$"
ISO_SHAPE = r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ][0-9].*)?\s*$"
SLASH_SHAPE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"
SLASH_TIME_SHAPE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$"
SLASH_AMPM_SHAPE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2} [AP]M$"


def is_blank(c: Column) -> Column:
    """NULL, empty or only white space."""
    return F.coalesce(F.trim(c) == "", F.lit(True))


def not_empty(c: Column) -> Column:
    """Has at least one character; white space counts."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def split_list(value: str | None) -> list[str] | None:
    """Split a parameter by ``|``, or by ``,`` when that gives fewer than two parts.

    Parts are not trimmed; a blank last part is dropped; blank input is None.
    """
    if value is None or not value.strip():
        return None
    for sep in ("|", ","):
        parts = value.split(sep)
        if not parts[-1].strip():
            parts.pop()
        if len(parts) >= 2:
            return parts
    return parts


def split_list_col(c: Column) -> Column:
    """Column form of :func:`split_list`."""

    def parts(sep: str) -> Column:
        raw = F.split(c, sep, -1)
        return F.when(
            is_blank(F.element_at(raw, -1)), F.slice(raw, F.lit(1), F.size(raw) - 1)
        ).otherwise(raw)

    piped = parts(r"\|")
    return F.when(~is_blank(c), F.when(F.size(piped) >= 2, piped).otherwise(parts(",")))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def similarity(a: Column, b: Column) -> Column:
    """0..100 closeness of two texts; two empty texts are identical."""
    longest = F.greatest(
        F.length(F.coalesce(a, F.lit(""))), F.length(F.coalesce(b, F.lit("")))
    )
    share = edit_distance(a, b).cast("double") / F.nullif(longest, F.lit(0)) * F.lit(100.0)
    return F.lit(100) - F.coalesce(share.cast("int"), F.lit(0))


def parse_int(c: Column) -> Column:
    """32-bit integer or NULL; sign and outer white space allowed."""
    return F.when(c.rlike(INT_SHAPE), F.trim(c).try_cast("int"))


def parse_float(c: Column) -> Column:
    """32-bit float or NULL; thousands commas, exponent, NaN, Infinity allowed."""
    return F.when(
        c.rlike(FLOAT_SHAPE), F.regexp_replace(F.trim(c), ",", "").try_cast("float")
    ).when(F.lower(c).rlike(NON_FINITE_SHAPE), F.trim(c).try_cast("float"))


def parse_double(c: Column) -> Column:
    return F.when(
        c.rlike(FLOAT_SHAPE), F.regexp_replace(F.trim(c), ",", "").try_cast("double")
    ).when(F.lower(c).rlike(NON_FINITE_SHAPE), F.trim(c).try_cast("double"))


def parse_decimal(c: Column) -> Column:
    return F.when(
        c.rlike(FLOAT_SHAPE), F.regexp_replace(F.trim(c), ",", "").try_cast("decimal(38,10)")
    )


def parse_datetime(c: Column) -> Column:
    """Timestamp or NULL.  Accepts ISO dates and date-times (zone optional) and
    month/day/year with an optional 24-hour or AM/PM time."""
    t = F.trim(c)
    return (
        F.when(c.rlike(ISO_SHAPE), t.try_cast("timestamp"))
        .when(t.rlike(SLASH_SHAPE), F.try_to_timestamp(t, F.lit("M/d/yyyy")))
        .when(t.rlike(SLASH_TIME_SHAPE), F.try_to_timestamp(t, F.lit("M/d/yyyy H:mm:ss")))
        .when(t.rlike(SLASH_AMPM_SHAPE), F.try_to_timestamp(t, F.lit("M/d/yyyy h:mm:ss a")))
    )


def is_datetime(c: Column) -> Column:
    """General parse, compact digits, or one of the fixed shapes."""
    hit = parse_datetime(c).isNotNull() | F.coalesce(
        F.when(
            c.rlike(r"^[0-9]{14}$"), F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss"))
        ).isNotNull(),
        F.lit(False),
    )
    for p in DATETIME_PATTERNS:
        hit = hit | F.coalesce(c.rlike(p), F.lit(False))
    return hit


def parse_boolean(c: Column) -> Column:
    return F.when(F.upper(c).isin(*TRUE_WORDS), F.lit(True)).when(
        F.upper(c).isin(*FALSE_WORDS), F.lit(False)
    )


def nullable_date(c: Column) -> Column:
    """Parsed date-time; the minimum date counts as missing."""
    ts = parse_datetime(c)
    return F.when(ts > F.lit("0001-01-01 00:00:00").cast("timestamp"), ts)


def json_first(payload: Column, *paths: str) -> Column:
    """First non-null value among JSON paths."""
    return F.coalesce(*[F.get_json_object(payload, p) for p in paths])


def json_all(payload: Column, *paths: str) -> Column:
    """Every non-null value among JSON paths, in path order."""
    return F.array_compact(F.array(*[F.get_json_object(payload, p) for p in paths]))


def cell(c: Column) -> Column:
    """Sheet cell: missing becomes empty, outer white space is cut."""
    return F.trim(F.coalesce(c, F.lit("")))


def map_get_ignore_case(m: Column, name: str) -> Column:
    """First map value whose key equals ``name`` ignoring case."""
    pos = F.array_position(
        F.transform(F.map_keys(m), lambda k: F.lower(k)), F.lit(name.lower())
    )
    return F.get(F.map_values(m), (pos - 1).cast("int"))


def class_display_name(c: Column) -> Column:
    """``healthAssessments`` becomes ``Health Assessments``."""
    spaced = F.trim(F.regexp_replace(c, "([A-Z])", " $1"))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substr(spaced, F.lit(2)))


def truncate_value(c: Column, limit: int = 1000) -> Column:
    """Missing becomes ``N/A``; longer texts are cut and marked with dots."""
    return (
        F.when(c.isNull(), F.lit("N/A"))
        .when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("...")))
        .otherwise(c)
    )


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 50, "medium").otherwise("low")


def status_class(status: Column) -> Column:
    low = F.lower(F.coalesce(status, F.lit("")))
    return F.when(low.isin("passed", "failed", "skipped"), low).otherwise("unknown")
