"""The queries over the driver's tables and the SQL that checks them.

A query is registered under its inventory id and a word; its SQL, where there is any,
returns the same columns. Doubles are rounded once, at the end, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquery.plans.views import WITH_VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True) -> Callable[[Query], Query]:
    """Register a query; ``sql`` starts after the view definitions (with views) and may add CTEs with a leading comma."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {WITH_VIEWS}{'' if sql.lstrip().startswith(',') else ' '}{sql}" if views else sql
        return f

    return add


def round_like_sql(name: str, places: int) -> Column:
    """A double rounded the way the SQL's engine does it: scaled, and the scaled double rounded (F.round takes the decimal that prints the value)."""
    scale = F.lit(10.0**places)
    return F.round(F.col(name) * scale) / scale


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    doubles = {n for n, kind in df.dtypes if kind == "double"}
    return df.withColumns({n: round_like_sql(n, places) if n in doubles else F.round(n, places) for n in names})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["g08_ensemble_borda"](spark, sf_dir)


from boxquery.plans import box_queries, format_queries, report_queries, score_queries, text_queries  # noqa: E402, F401
