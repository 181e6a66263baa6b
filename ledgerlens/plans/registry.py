"""Registry of deliverables: key -> Spark plan, key -> oracle SQL.

Every Spark entry takes (spark, sf_dir), binds the data set once per
session (``bound_warehouse``) and returns a lazy DataFrame. For the
side-by-side check both sides are normalised the same way: doubles rounded
to 6 digits, dates and timestamps rendered as ISO text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..oracle import metrics_sql as M
from ..sources.binding import bound_warehouse
from ..sources.warehouse import Warehouse

DIGITS = 6


@dataclass
class Entry:
    spark_fn: Callable[[Warehouse], DataFrame]
    sql_final: str | None = None           # None: no SQL oracle (rows-only check)
    sql_deps: tuple[str, ...] = ()
    doubles: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()
    timestamps: tuple[str, ...] = ()
    period: str = "past"                    # which Period the oracle SQL uses


INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def column_kinds(schema: T.StructType) -> dict:
    """Integer and boolean column names of a result schema."""
    return {
        "ints": tuple(f.name for f in schema.fields if isinstance(f.dataType, INTEGRAL)),
        "bools": tuple(f.name for f in schema.fields if isinstance(f.dataType, T.BooleanType)),
    }


def normalise(df: DataFrame) -> DataFrame:
    """Comparison form: doubles rounded, integers as DOUBLE, booleans and dates as text.

    Integers and booleans are widened because a nullable integer or boolean
    column has a different client-side representation in each engine; the
    values themselves are unchanged (the integers here are far below 2^53).
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, INTEGRAL):
            c = c.cast("double")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), DIGITS)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def wrap_sql(sql: str, doubles, dates, timestamps=(), ints=(), bools=()) -> str:
    if not (doubles or dates or timestamps or ints or bools):
        return sql
    repl = [f"ROUND(CAST({c} AS DOUBLE), {DIGITS}) AS {c}" for c in doubles]
    repl += [f"CAST({c} AS DOUBLE) AS {c}" for c in ints]
    repl += [f"CAST({c} AS VARCHAR) AS {c}" for c in bools]
    repl += [f"strftime(CAST({c} AS DATE), '%Y-%m-%d') AS {c}" for c in dates]
    repl += [f"strftime(CAST({c} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS {c}" for c in timestamps]
    return f"SELECT * REPLACE ({', '.join(repl)}) FROM (\n{sql}\n) AS q"


def make_query(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..session import configure

        configure(spark)
        return normalise(entry.spark_fn(bound_warehouse(spark, sf_dir)))
    return run


def make_sql(entry: Entry, key: str) -> str | None:
    if entry.sql_final is None:
        return None
    from .catalog import BILLING_START, PERIODS

    from ..oracle.reports_sql import report_ctes

    p = PERIODS[entry.period]
    reg = M.cte_registry(p, BILLING_START)
    reg.update(report_ctes(p))
    from ..oracle.output_types import OUTPUT_TYPES

    kinds = OUTPUT_TYPES.get(key, {"ints": (), "bools": ()})
    return wrap_sql(M.build(entry.sql_final, entry.sql_deps, reg), entry.doubles, entry.dates, entry.timestamps,
                    kinds["ints"], kinds["bools"])
