"""Scalar expressions: safe ratios, lenient casts, calendar parts, guards."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

MONTH_PATTERN = r"^[0-9]{4}-(0[1-9]|1[0-2])$"


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL, not an error or infinity, on a zero divisor."""
    return F.try_divide(top, bottom)


def number(value: Column | str) -> Column:
    """Lenient numeric cast: text that is no finite number becomes NULL."""
    column = F.col(value) if isinstance(value, str) else value
    cast = column.try_cast("double")
    return F.when(F.abs(cast) < F.lit(math.inf), cast)


def guard(ok: Column, value: Column, message: str, *evidence: Column) -> Column:
    """``value`` where ``ok`` holds; otherwise (false or NULL) the job fails with ``message`` and the evidence."""
    said = F.concat(F.lit(message), *[part for one in evidence for part in (F.lit("; "), F.coalesce(one, F.lit("?")))])
    return F.when(ok, value).otherwise(F.raise_error(said if evidence else F.lit(message)))


def positive(*names: str) -> Column:
    """All named columns are finite and above zero; NULL when one is NULL, so guards fail."""
    tests = [(F.col(name) > 0) & (F.col(name) < F.lit(math.inf)) for name in names]
    return reduce(Column.__and__, tests)


def month_of(date: Column | str) -> Column:
    return F.date_format(date, "yyyy-MM")


def previous_month(date: Column) -> Column:
    return F.date_format(F.add_months(date, -1), "yyyy-MM")


def month_text(value: Column | str) -> Column:
    """Month text checked against YYYY-MM; anything else fails the job."""
    column = F.col(value) if isinstance(value, str) else value
    return guard(column.rlike(MONTH_PATTERN), column, "invalid month")


def month_progress(date: Column | str) -> Column:
    return F.dayofmonth(date) / F.dayofmonth(F.last_day(date)).cast("double")


def weekday_angle(date: Column | str) -> Column:
    """Angle of the weekday on a five-day circle, Monday at zero."""
    return F.weekday(date) * F.lit(2.0 * math.pi) / F.lit(5.0)


def roc_date(value: Column | str) -> Column:
    """Date of a Republic-of-China ``yyy/mm/dd`` text (year + 1911); bad text fails."""
    column = F.trim(F.col(value) if isinstance(value, str) else value)
    part = F.split(column, "/")
    made = F.make_date(part[0].cast("int") + 1911, part[1].cast("int"), part[2].cast("int"))
    return guard(column.rlike(r"^[0-9]+/[0-9]+/[0-9]+$"), made, "invalid ROC date")


def plain_number(value: Column | str) -> Column:
    """Text with thousands commas to double; bad text fails."""
    return F.regexp_replace(value, ",", "").cast("double")


def holds(condition: Column) -> Column:
    """Two-valued test: unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def rate(condition: Column) -> Column:
    """Share of rows where the condition is true (NULL conditions are ignored)."""
    return F.avg(condition.cast("double"))
