"""Column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetseries.schemas import (
    FALLBACK_TIME_FORMATS,
    LOGGER_NA_TOKENS,
    NUMBER_PATTERN,
    STRICT_TIME_FORMAT,
)


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_null(c: Column | str, tokens: Sequence[str] = LOGGER_NA_TOKENS) -> Column:
    """Missing-value tokens become null (string columns included)."""
    c = col_(c)
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def is_number_text(c: Column | str) -> Column:
    return col_(c).rlike(NUMBER_PATTERN)


def parse_number(c: Column | str) -> Column:
    """String -> double under the accepted number grammar; anything else null.

    The regex guard rejects forms a plain cast would accept (``'1.5f'``).
    """
    c = col_(c)
    return F.when(is_number_text(c), _try_double(c)).otherwise(F.lit(None).cast("double"))


def _try_double(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def bad_number(raw: Column | str, parsed: Column | str) -> Column:
    """True when a present raw value did not parse as a number."""
    return col_(raw).isNotNull() & col_(parsed).isNull()


def parse_time(c: Column | str, formats: Sequence[str] | None = None) -> Column:
    """Strict logger format first, then the listed fallbacks, per row.

    Returns ``timestamp_ntz`` (the session zone is UTC, so the cast keeps the
    wall-clock value). Unparseable text gives null.
    """
    c = col_(c)
    fmts = [STRICT_TIME_FORMAT, *(formats if formats is not None else FALLBACK_TIME_FORMATS)]
    parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in fmts])
    return parsed.cast("timestamp_ntz")


def to_naive_utc(c: Column | str) -> Column:
    """Zone-aware text (``Z`` / ``+hh:mm``) or timestamp -> naive UTC.

    Text with an offset is parsed as an instant, then its UTC wall clock is
    kept; text without an offset is taken as UTC already.
    """
    return F.to_timestamp(col_(c)).cast("timestamp_ntz")


def month_start(c: Column | str) -> Column:
    """First instant of the month, as timestamp_ntz (date_trunc returns LTZ)."""
    return F.date_trunc("month", col_(c)).cast("timestamp_ntz")


def add_months_ntz(c: Column | str, n: int | Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.make_timestamp_ntz(
        F.year(F.add_months(F.to_date(col_(c)), n)),
        F.month(F.add_months(F.to_date(col_(c)), n)),
        F.lit(1), F.lit(0), F.lit(0), F.lit(0),
    )


def iso(c: Column | str) -> Column:
    """ISO-8601 like Python's ``isoformat``: seconds always, microseconds only if present."""
    c = col_(c)
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(c, "SSSSSS")
    return F.when(frac == F.lit("000000"), whole).otherwise(F.concat(whole, F.lit("."), frac))


def iso_z(c: Column | str) -> Column:
    """``iso`` with a trailing ``Z`` (naive UTC)."""
    return F.concat(iso(c), F.lit("Z"))


def render_dim_value(num: Column, txt: Column, units: Column) -> Column:
    """One dimension coordinate in a wide column name.

    Integral numbers lose ``.0``; numbers get their units appended; text has
    surrounding blanks stripped and inner blanks turned into ``_``.
    """
    integral = num.isNotNull() & (num == F.floor(num)) & (F.abs(num) < F.lit(1e15))
    num_text = F.when(integral, num.cast("bigint").cast("string")).otherwise(num.cast("string"))
    num_part = F.concat(num_text, F.coalesce(units, F.lit("")))
    txt_part = F.regexp_replace(F.trim(txt), " ", "_")
    return F.when(num.isNotNull(), num_part).otherwise(txt_part)


def wide_column_name(name: Column, dims: Column) -> Column:
    """``name`` or ``name_<v1>_<v2>...`` from a dims array."""
    parts = F.transform(dims, lambda d: render_dim_value(d["num"], d["txt"], d["units"]))
    return F.when(F.size(dims) > 0, F.concat_ws("_", name, parts)).otherwise(name)


def contains_ci(haystack: Column, needle: str) -> Column:
    """Case-insensitive plain substring test (no wildcards)."""
    return F.contains(F.lower(haystack), F.lit(needle.lower()))


def flatten_newlines(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col_(c), "\r\n", " "), "\n", " ")


def ts_lit(value) -> Column:
    """A ``timestamp_ntz`` literal from a datetime or text, independent of the
    Python process zone. Aware datetimes are converted to naive UTC first."""
    from datetime import datetime, timezone

    if value is None:
        return F.lit(None).cast("timestamp_ntz")
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = value.astimezone(timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")
