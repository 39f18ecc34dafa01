"""Exact order statistics of groups of any size, by counting.

The place of a rank is narrowed down by histograms: each pass counts a group's values in
equal parts of what is left and goes on in the part that holds the rank. No task sees more than the
counts of a group; what is left after the last pass are few values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxquery.sources.scratch import parked

PARTS = 1024
PASSES = 3
#: Stands for a null where nulls come last; finite, so that it doesn't stretch the parts of the rest for more than one pass.
LAST = 1.7e308


def nth_values(rows: DataFrame, by: Sequence[str], value: Column | str, wanted: DataFrame) -> DataFrame:
    """by, rank, value, before and equal: the value of each wanted rank (0: the smallest) of its group, and how many values are smaller or equal to it.

    ``value`` is a number; nulls have no rank. Ranks beyond a group have no row.
    """
    v = F.col(value) if isinstance(value, str) else value
    values = rows.select(*by, v.alias("_v")).where("_v is not null")
    ends = values.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    left = wanted.select(*by, "rank").distinct().join(ends, list(by)).where("rank >= 0 and rank < _n").drop("_n").withColumn("_before", F.lit(0).cast("long"))
    left = parked(left, "ranks")
    key = [*by, "rank"]
    low, wide = F.col("_lo").cast("double"), F.col("_hi").cast("double") - F.col("_lo").cast("double")
    for _ in range(PASSES):
        part = F.when(wide > 0, F.least(F.lit(PARTS - 1), F.floor((F.col("_v").cast("double") - low) / wide * PARTS))).otherwise(0)
        open_ = left.where("_lo < _hi")
        if open_.isEmpty():
            break
        inside = values.join(open_, list(by)).where("_v between _lo and _hi").groupBy(*key, "_before", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        until = F.sum("_n").over(W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
        inside = inside.withColumn("_start", F.col("_before") + F.coalesce(until, F.lit(0)))
        next_ = inside.where("rank >= _start and rank < _start + _n").select(*key, "_lo", "_hi", F.col("_start").alias("_before"))
        left = parked(next_.unionByName(left.where("_lo = _hi")), "ranks")
    few = values.join(left, list(by)).where("_v between _lo and _hi").groupBy(*key, "_before", F.col("_v").alias("value")).agg(F.count(F.lit(1)).alias("equal"))
    until = F.sum("equal").over(W.partitionBy(*key).orderBy("value").rowsBetween(W.unboundedPreceding, -1))
    few = few.withColumn("before", F.col("_before") + F.coalesce(until, F.lit(0)))
    return few.where("rank >= before and rank < before + equal").select(*key, "value", "before", "equal")


def smallest(rows: DataFrame, by: Sequence[str], value: Column, id: str, wanted: DataFrame) -> DataFrame:
    """Of each group of ``wanted`` (by, n) the n rows of the smallest values, ties by id.

    The value of rank n - 1 is the cut; of the rows that have just this value, those up to the id of the rank that is still wanted.
    Rows of a null value come last; ids are numbers.
    """
    ranked = rows.withColumn("_v", F.coalesce(value.cast("double"), F.lit(LAST)))
    sizes = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    want = parked(wanted.select(*by, F.col("n").alias("_n")).join(sizes, list(by)).where("_n > 0"), "wanted")
    cut = nth_values(ranked, by, "_v", want.where("_n < _size").select(*by, (F.col("_n") - 1).alias("rank")))
    cut = cut.select(*by, F.col("value").alias("_cut"), (F.col("rank") + 1 - F.col("before")).alias("_more"), "equal")
    cut = parked(cut, "cuts")
    tied = cut.where("_more < equal")
    ids = nth_values(ranked.join(tied.select(*by, "_cut"), list(by)).where("_v = _cut"), by, id, tied.select(*by, (F.col("_more") - 1).alias("rank"))).select(*by, F.col("value").alias("_last"))
    rule = want.join(cut, list(by), "left").join(ids, list(by), "left").select(*by, "_cut", "_last")
    kept = F.col("_cut").isNull() | (F.col("_v") < F.col("_cut")) | ((F.col("_v") == F.col("_cut")) & (F.col("_last").isNull() | (F.col(id) <= F.col("_last"))))
    return ranked.join(rule, list(by)).where(kept).select(*rows.columns)
