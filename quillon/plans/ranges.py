"""Joins by a point that lies in an interval, as joins by equality.

An interval is cut into the aligned blocks of 2^k places that make it up, at most two of
each size; a point is in one block of each size.  Pairs with equal blocks are exactly
those of a point and an interval around it, each once.  Points go only to the sizes that
some interval has.  Values are placed on integers by maps that never change their order,
so a pair may be found that doesn't match, which the condition itself tells, but none is
missed.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places lie from -TOP to TOP - 1.
TOP = 2**61
_REAL, _STEPS = 2.0**20, 2.0**26  # REAL: linear below 1/_REAL or so, then so many places for each factor of e


def place(x: Column, kind: str) -> Column:
    """The place of a value that isn't NaN."""
    if kind == "TIMESTAMP":  # its second
        day = F.unix_date(x.cast("date")).cast("bigint")
        return day * 86400 + F.hour(x) * 3600 + F.minute(x) * 60 + F.floor(F.second(x))
    if kind == "REAL":
        size = F.floor(F.log1p(F.least(F.abs(x), F.lit(1e300)) * _REAL) * _STEPS).cast("bigint")
        return F.when(x < 0, -size).otherwise(size)
    return F.greatest(F.least(x.cast("bigint"), F.lit(TOP - 1)), F.lit(-TOP))


def bound(v: Column, plain: bool, leaves: list[Column], kind: str, step: int, top: bool) -> Column:
    """The place of a bound, made of leaves by steps that may have overflowed: then it bounds nothing.  NULL where no value is within."""
    known, least = [x.isNotNull() for x in leaves], F.lit(TOP - 1 if top else -TOP)
    if kind == "INTEGER":
        return F.when(reduce(and_, known), F.coalesce(place(F.try_add(v, F.lit(step)), kind), least))
    if kind == "TIMESTAMP":
        return place(v, kind)
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    v, reals = v.cast("double"), [x.cast("double") for x in leaves]
    out = F.when(~F.isnan(v), place(v, kind))
    if not plain:
        out = F.when(~finite(v) & reduce(and_, [finite(x) for x in reals]), least).otherwise(out)
        # an INTEGER step that overflowed
        out = F.when(v.isNull(), least).otherwise(out)
    return F.when(reduce(and_, known), out)


def join(intervals: DataFrame, low: Column, high: Column, points: DataFrame, at: Column, cond: Column, names: list[str]) -> DataFrame:
    """The inner join under cond, which holds only where low <= at <= high; columns are places and may be NULL, names are six unused ones."""
    lo, hi, size, block, size2, block2 = names
    cut = intervals.withColumns({lo: low, hi: high}).filter(F.col(lo) <= F.col(hi))
    cut = cut.withColumn(size, F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col(hi) - F.col(lo) + 1)) - 1)))
    first = F.call_function("shiftright", F.col(lo) - 1, F.col(size)) + 1
    end = F.call_function("shiftright", F.col(hi) + 1, F.col(size))
    odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
    cut = cut.withColumns({lo: first, hi: end}).filter((F.col(lo) < F.col(hi)) & (odd(F.col(lo)) | odd(F.col(hi))))
    ends = F.when(~odd(F.col(hi)), F.array(F.col(lo))).when(~odd(F.col(lo)), F.array(F.col(hi) - 1)).otherwise(F.array(F.col(lo), F.col(hi) - 1))
    cut = cut.withColumn(block, F.explode(ends)).drop(lo, hi)
    sizes = cut.agg(F.collect_set(size).alias(size2))
    spread = points.withColumn(block2, at).filter(F.col(block2).isNotNull()).crossJoin(F.broadcast(sizes)).withColumn(size2, F.explode(size2))
    spread = spread.withColumn(block2, F.call_function("shiftright", F.col(block2), F.col(size2)))
    return cut.join(spread, (F.col(size) == F.col(size2)) & (F.col(block) == F.col(block2)) & cond, "inner").drop(*names)
