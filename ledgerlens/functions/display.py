"""Report arithmetic and text columns: X19-X24, R06-R10 building blocks.

The reference renders these per row in Python; here each is a Column
expression, so a whole report page is one projection over the month
report and runs inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import pyround, reliable_rate

# Direction labels and arrows of a signed change.
UP, DOWN, FLAT = "up", "down", "flat"
ARROW_UP, ARROW_DOWN, ARROW_FLAT = "▲", "▼", "→"


def change_pct(cur: Column, prior: Column) -> Column:
    """X22 percentage: round(diff / prior * 100, 1) half-even; NULL when prior is 0."""
    diff = (cur - prior).cast("double")
    return F.when(prior != 0, pyround(diff / prior.cast("double") * 100, 1))


def direction(diff: Column) -> Column:
    return F.when(diff > 0, UP).when(diff < 0, DOWN).otherwise(FLAT)


def change_text(cur: Column, prior: Column) -> Column:
    """X22 text: '→ 0', '▲ +3', '▼ -2 (-12.5%)'."""
    diff = cur - prior
    sym = F.when(diff > 0, ARROW_UP).otherwise(ARROW_DOWN)
    sign = F.when(diff > 0, "+").otherwise("")
    head = F.concat(sym, F.lit(" "), sign, diff.cast("string"))
    return (F.when(diff == 0, F.lit(f"{ARROW_FLAT} 0"))
            .when(prior == 0, head)
            .otherwise(F.concat(head, F.lit(" ("), change_pct(cur, prior).cast("string"), F.lit("%)"))))


def variance_text(variance: Column, mtd_based: Column) -> Column:
    """Signed variance with arrow; '*' marks an MTD-based (not extrapolated) value."""
    base = (F.when(variance > 0, F.concat(F.lit(f"{ARROW_UP} +"), variance.cast("string")))
            .when(variance < 0, F.concat(F.lit(f"{ARROW_DOWN} "), variance.cast("string")))
            .otherwise(F.lit(f"{ARROW_FLAT} 0")))
    return F.when(variance.isNotNull(),
                  F.when(mtd_based, F.concat(base, F.lit("*"))).otherwise(base))


def money_text(x: Column) -> Column:
    """X19: '$1,234' (half-even to whole dollars)."""
    return F.when(x.isNotNull(), F.concat(F.lit("$"), F.format_number(pyround(x, 0), 0)))


def fee_text(fee_min: Column, fee_max: Column) -> Column:
    """X20: '$N' or '$N/$M', truncated to whole dollars."""
    mn = F.concat(F.lit("$"), fee_min.cast("bigint").cast("string"))
    mx = F.concat(F.lit("$"), fee_max.cast("bigint").cast("string"))
    return F.when(fee_min.isNotNull(),
                  F.when(fee_min == fee_max, mn).otherwise(F.concat(mn, F.lit("/"), mx)))


def percent_text(ratio: Column) -> Column:
    """Decimal share as '10.0%'."""
    return F.when(ratio.isNotNull(), F.format_string("%.1f%%", ratio * 100))


def approx_prefix(text: Column, approximate: Column) -> Column:
    """X23: '~' before an estimate that used a floor value."""
    return F.when(text.isNotNull(), F.when(approximate, F.concat(F.lit("~"), text)).otherwise(text))


def projection_variance(mtd: Column, projected: Column, rate: Column) -> tuple[Column, Column]:
    """(variance, mtd_based). NULL without a projection."""
    reliable = reliable_rate(rate)
    est = pyround(mtd / rate, 0).cast("bigint")
    variance = F.when(projected.isNotNull(),
                      F.when(reliable, est - projected).otherwise(mtd - projected))
    return variance, F.when(projected.isNotNull(), ~reliable)


def eom_estimate(mtd: Column, rate: Column, avg_full_month: Column) -> tuple[Column, Column]:
    """R08 estimate without the projection guard: (estimate, used_fallback)."""
    reliable = reliable_rate(rate)
    fallback = F.when(avg_full_month.isNotNull() & (avg_full_month != 0) & (avg_full_month > mtd),
                      pyround(avg_full_month, 0).cast("bigint")).otherwise(mtd.cast("bigint"))
    return F.when(reliable, pyround(mtd / rate, 0).cast("bigint")).otherwise(fallback), ~reliable
