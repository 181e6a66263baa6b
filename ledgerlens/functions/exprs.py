"""Column-expression helpers shared by metrics and reports.

All are built-in Spark expressions: they stay inside whole-stage codegen and
carry no Python into the executors.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .periods import MIN_COMPLETION_RATE


def day(ts: Column | str) -> Column:
    """Calendar date of a timestamp (UTC session time zone)."""
    return F.to_date(F.col(ts) if isinstance(ts, str) else ts)


def midnight(d: date) -> Column:
    """Start of day ``d`` as a zone-free timestamp literal."""
    return F.lit(f"{d.isoformat()} 00:00:00").cast("timestamp_ntz")


def _next_day(d: date) -> date:
    return date.fromordinal(d.toordinal() + 1)


def _c(ts: Column | str) -> Column:
    return F.col(ts) if isinstance(ts, str) else ts


def day_on_or_after(ts: Column | str, d: date) -> Column:
    """``DATE(ts) >= d`` as ``ts >= d 00:00`` - a range the parquet scan can use."""
    return _c(ts) >= midnight(d)


def day_before(ts: Column | str, d: date) -> Column:
    """``DATE(ts) < d`` as ``ts < d 00:00``."""
    return _c(ts) < midnight(d)


def day_on_or_before(ts: Column | str, d: date) -> Column:
    """``DATE(ts) <= d`` as ``ts < (d + 1) 00:00``."""
    return _c(ts) < midnight(_next_day(d))


def day_after(ts: Column | str, d: date) -> Column:
    """``DATE(ts) > d`` as ``ts >= (d + 1) 00:00``."""
    return _c(ts) >= midnight(_next_day(d))


def on_or_between(ts: Column | str, lo: date, hi: date) -> Column:
    """``DATE(ts) BETWEEN lo AND hi`` written as a half-open timestamp range.

    Equivalent for zone-free timestamps (and for zoned ones in the UTC
    session zone); unlike ``to_date(ts) BETWEEN``, the bounds are plain
    column-vs-literal comparisons, so they reach the parquet scan as pushed
    filters and prune row groups.
    """
    return day_on_or_after(ts, lo) & day_on_or_before(ts, hi)


def active_on(d: date, created="created", delisted="delisted_timestamp",
              pause_started="pause_started", pause_ended="pause_ended") -> Column:
    """enrolment counted on day ``d``.

    Created by ``d``, not delisted by ``d``, and not inside a pause that had
    started by ``d`` and had not ended by ``d``.
    """
    in_pause = (F.col(pause_started).isNotNull() & day_on_or_before(pause_started, d)
                & (F.col(pause_ended).isNull() | day_after(pause_ended, d)))
    return (day_on_or_before(created, d)
            & (F.col(delisted).isNull() | day_after(delisted, d))
            & ~in_pause)


def unbounded_if_null(bound: Column, value: Column) -> Column:
    """``bound IS NULL OR value >= bound``."""
    return bound.isNull() | (value >= bound)


def is_true(c: Column | str) -> Column:
    """three-valued ``= true`` - NULL falls out of the filter."""
    c = F.col(c) if isinstance(c, str) else c
    return c == F.lit(True)


def is_false(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c == F.lit(False)


def distinct_from(c: Column | str, value) -> Column:
    """``c IS DISTINCT FROM value`` (NULL counts as different)."""
    c = F.col(c) if isinstance(c, str) else c
    return ~c.eqNullSafe(F.lit(value))


def strict_greatest(*cols: Column) -> Column:
    """GREATEST that is NULL when any input is NULL (Spark's skips NULLs)."""
    cond = None
    for c in cols:
        cond = c.isNotNull() if cond is None else (cond & c.isNotNull())
    return F.when(cond, F.greatest(*cols))


def safe_div(a: Column, b: Column) -> Column:
    """X11: SAFE_DIVIDE - NULL on a zero divisor (ANSI mode would raise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


# The source's exact money type, and operand widths whose product Spark and SQL keep whole (38 digits, 18 of them decimals).
MONEY = "decimal(38,9)"
RATE_OPERAND, MONEY_OPERAND = "decimal(14,9)", "decimal(23,9)"


def money(c: Column | str) -> Column:
    """exact amount with nine decimals. Not-a-number and infinite amounts are an error, as no exact amount is either."""
    return _c(c).cast(MONEY)


def money_times(rate: Column, amount: Column) -> Column:
    """``rate x amount`` exactly, rounded once to nine decimals (rates under 10^5, amounts under 10^14)."""
    return (rate.cast(RATE_OPERAND) * amount.cast(MONEY_OPERAND)).cast(MONEY)


def count_if(cond: Column) -> Column:
    """COUNTIF - zero, never NULL, on an empty group."""
    return F.count_if(cond)


def pyround(c: Column, digits: int = 0) -> Column:
    """Python ``round`` (half to even)."""
    return F.bround(c, digits)


def sqlround(c: Column, digits: int = 0) -> Column:
    """SQL ``ROUND`` (half away from zero)."""
    return F.round(c, digits)


def positive_or_null(c: Column) -> Column:
    """Known and positive, else unknown (revenue components)."""
    return F.when(c > 0, c)


def reliable_rate(rate: Column) -> Column:
    """The completion rate is usable for extrapolation."""
    return rate.isNotNull() & (rate >= F.lit(MIN_COMPLETION_RATE))


def sum_known(*cols: Column) -> Column:
    """Sum of the known parts, NULL only when every part is unknown."""
    any_known = None
    total = None
    for c in cols:
        any_known = c.isNotNull() if any_known is None else (any_known | c.isNotNull())
        part = F.coalesce(c, F.lit(0.0))
        total = part if total is None else total + part
    return F.when(any_known, total)


def nonzero_or_null(c: Column) -> Column:
    """Totals rows show a zero sum as unknown."""
    return F.when(c != 0, c)
