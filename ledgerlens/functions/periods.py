"""The reporting period derived from a month and an as-of date.

Nothing here reads the clock: every metric receives ``Period`` and uses its
dates as literals, so a past month gives the same answer whenever it is run.
"""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: below this seasonal completion rate a month-to-date count is
# not extrapolated to a month-end estimate.
MIN_COMPLETION_RATE = 0.25


def add_months(d: date, n: int) -> date:
    """Calendar month shift that clips to month end (as SQL date arithmetic does)."""
    idx = d.year * 12 + (d.month - 1) + n
    y, m = divmod(idx, 12)
    m += 1
    return date(y, m, min(d.day, calendar.monthrange(y, m)[1]))


def month_last(first: date) -> date:
    return date(first.year, first.month, calendar.monthrange(first.year, first.month)[1])


def _capped(first: date, day: int) -> date:
    """Same day of month as ``day``, capped at the month's last day."""
    return date(first.year, first.month, min(day, calendar.monthrange(first.year, first.month)[1]))


@dataclass(frozen=True)
class Period:
    """A selected month seen from an as-of date."""

    month: date          # any day of the selected month
    as_of: date          # the "today" of the run

    @property
    def first(self) -> date:
        return date(self.month.year, self.month.month, 1)

    @property
    def last(self) -> date:
        return month_last(self.first)

    @property
    def next_first(self) -> date:
        return add_months(self.first, 1)

    @property
    def m1_first(self) -> date:
        return add_months(self.first, -1)

    @property
    def m1_last(self) -> date:
        return month_last(self.m1_first)

    @property
    def y1_first(self) -> date:
        return add_months(self.first, -12)

    @property
    def y1_last(self) -> date:
        return month_last(self.y1_first)

    @property
    def is_current(self) -> bool:
        return (self.as_of.year, self.as_of.month) == (self.first.year, self.first.month)

    @property
    def today_day(self) -> int:
        """Day of month compared like for like: as-of day now, month length in the past."""
        return self.as_of.day if self.is_current else self.last.day

    @property
    def m1_cap(self) -> date:
        return _capped(self.m1_first, self.today_day)

    @property
    def y1_cap(self) -> date:
        return _capped(self.y1_first, self.today_day)

    @property
    def three_months_ago(self) -> date:
        """First day of month - 2."""
        return add_months(self.first, -2)

    @property
    def history_first(self) -> date:
        """First month of the 18-month completion-rate history."""
        return add_months(self.first, -18)

    @property
    def refund_window_first(self) -> date:
        """30 days before the last day of the month (31 dates inclusive)."""
        return date.fromordinal(self.last.toordinal() - 30)

    @property
    def projection_key(self) -> str:
        return f"{self.first.year:04d}-{self.first.month:02d}"

    def trend_first(self, months: int = 14) -> date:
        """as_of minus ``months`` months."""
        return add_months(self.as_of, -months)

    def frame(self, spark: SparkSession) -> DataFrame:
        """R03 as a one-row DataFrame (labels travel with report results)."""
        row = [(self.first, self.last, self.m1_first, self.m1_last, self.y1_first, self.y1_last,
                self.is_current, self.today_day, self.m1_cap, self.y1_cap, self.projection_key)]
        schema = ("first date, last date, m1_first date, m1_last date, y1_first date, y1_last date, "
                  "is_current boolean, today_day int, m1_cap date, y1_cap date, projection_key string")
        return spark.createDataFrame(row, schema)


def lit_date(d: date):
    return F.lit(d.isoformat()).cast("date")
