"""Whether a row's id is in a table of ids of any size, without a shuffle of whole rows.

Method: ids are hashed to places.  A place that only ids of the table, or only others, fall on decides its rows where
they are read; rows on a place of both are joined with the table by their id.  So marks are exact, however many
places there are.

Scale: ids alone are shuffled to find the places; those go to all tasks as 64-bit words, at most ``words`` rows of
three numbers.  What is shuffled whole are the rows on places of both: few as long as there are many more
places (64 * ``words``) than ids, all of them at worst.  Rows are read twice beside the ids.

Cases: a null id is in no table; where the two columns differ in type, or equal values can hash apart, all rows are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

WORDS = 1 << 19


def marked(rows: DataFrame, ids: DataFrame, words: int = WORDS) -> DataFrame:
    """``rows`` and a column _in: whether _id, a column of theirs, is in the one column of ``ids``, which are different and not null."""
    ids = ids.toDF("_known")
    of = rows.schema["_id"].dataType

    def joined(some: DataFrame) -> DataFrame:
        return some.join(ids, F.col("_id") == F.col("_known"), "left").select(*rows.columns, F.col("_known").isNotNull().alias("_in"))

    if ids.schema["_known"].dataType != of or not (isinstance(of, IntegralType) or of == StringType()):
        return joined(rows)

    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(64 * words).cast("long"))

    def taken(some: DataFrame, name: str) -> DataFrame:
        at = some.select(place(some.columns[0]).alias("_p"))
        return at.groupBy(F.expr("_p div 64").alias("_k")).agg(F.expr("bit_or(shiftleft(1L, CAST(_p % 64 AS INT)))").alias(name))

    others = rows.select("_id").join(ids, F.col("_id") == F.col("_known"), "left_anti")
    places = taken(ids, "_yes").join(taken(others, "_no"), "_k", "left").select("_k", "_yes", F.expr("_yes & coalesce(_no, 0L)").alias("_both"))
    seen = rows.withColumn("_p", place("_id")).withColumn("_k", F.expr("_p div 64")).join(F.broadcast(places), "_k", "left")  # at most ``words`` rows

    def bit(name: str) -> Column:
        return F.expr(f"coalesce(getbit({name}, CAST(_p % 64 AS INT)), 0) = 1")

    plain = seen.filter(~bit("_both")).select(*rows.columns, bit("_yes").alias("_in"))
    return plain.unionAll(joined(seen.filter(bit("_both")).select(*rows.columns)))
