"""Mixing sources to target weights along a curriculum, in DataFrame functions only.

Method: each source has a weight schedule over training time t in [0, 1],
w * (1 + slope * (2t - 1)), whose integral is w; slopes go from +ramp for the first
source to -ramp for the last, so some sources come early and others late.  Targets
share all words by weight; no source gets more than ``most`` times its size, what is
above goes to the others by weight.  A source's documents lie one after another, in
the order of a hash of their ids, on a line as long as the source; the mix takes the
line from its start, over and over, until the target is met.  The n-th word of a
source is trained when the source's integrated schedule has reached the share
n / target: that inverse (a quadratic's root) gives each copy of a document its
position, and the mix is range-sorted by position.

Scale: texts are read once, for their sizes; only (id, hash, source, size) goes on.
Cumulative sizes are two-level: rows are dealt into ``blocks`` ranges of the hash in
each source, ranges are summed with partial aggregation and prefix-summed in a table
of sources x blocks rows, and rows are summed inside their range.  So a source with a
third of all rows is spread over all tasks.  ``blocks`` grows with the number of rows.

Cases: a null text has size 0 and takes nothing; nulls in source are a source of their
own, the last; a source whose sizes are all 0 has target 0; a null id is ordered by
its hash like others; repeated rows are documents of their own (rows alike in id and
size may swap places, which changes no result); an empty table gives no rows; long
texts count whole; columns other than id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, checkpoint

WEIGHTS = (1, 2, 3)
MOST = 3
RAMP = 0.8
ROWS_PER_BLOCK = 1_000


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, _h): what mixing needs of a document."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ).withColumn("_h", F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "size")), 1, 15), 16, 10).cast("long"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, ramp: float = RAMP) -> DataFrame:
    """(source, source_size, target, slope), a row per source.

    target = min(most * size, level * weight); the level is the first at which, with
    sources in the order of most * size / weight, all words are given out.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    named = per.withColumn("_rank", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(every))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int"))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    table = (
        named.withColumn("_weight", weight)
        .withColumn("_cap", (F.col("source_size") * most).cast("double"))
        .withColumn("_all", F.sum("source_size").over(every).cast("double"))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_left", F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        # the level if this source and those after it stay below their caps
        .withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_left"))
    )
    first = F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_rank"), F.col("_level").alias("level")))).over(every)
    target = F.least(F.col("_cap"), F.coalesce(first["level"] * F.col("_weight"), F.col("_cap")))
    slope = F.when(F.col("_n") > 1, ramp * (1 - 2 * F.col("_rank") / (F.col("_n") - 1))).otherwise(F.lit(0.0))
    return table.select("source", "source_size", target.alias("target"), slope.alias("slope"))


def lay_out(sized: DataFrame, rows_per_block: int = ROWS_PER_BLOCK, **how) -> DataFrame:
    """sized + (source_size, target, slope, start): where each document lies on its source's line.

    ``sized`` is read several times: it should be cheap to read.
    """
    blocks = max(1, sized.count() // rows_per_block)
    dealt = sized.withColumn("_b", F.floor(F.col("_h") / float(2**60) * blocks).cast("int"))
    per_block = dealt.groupBy("source", "_b").agg(F.sum("size").alias("_sum"))
    start = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = targets(sized, **how)
    table = per_block.withColumn("_start", start).alias("b").join(t.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(F.col("b.source").alias("_src"), F.col("_b").alias("_blk"), "_start", "source_size", "target", "slope")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("_in", inside)
    return (
        placed.join(table, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_b") == F.col("_blk")))
        .withColumn("start", F.col("_start") + F.col("_in"))
        .drop("_src", "_blk", "_start", "_in", "_b")
    )


def taken() -> Column:
    """Words taken of a document on its source's line: full rounds, and its part of the last."""
    whole = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0)
    rest = whole - rounds * F.col("source_size")
    return (rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))).cast("long")


def position(offset: Column) -> Column:
    """Training time at which a source has been asked for ``offset`` of its target's words.

    The demand up to t is (1 - slope) t + slope t^2 of the target.
    """
    u = F.when(F.col("target") > 0, F.least(F.lit(1.0), offset / F.col("target"))).otherwise(F.lit(0.0))
    a = 1 - F.col("slope")
    # the root in the form that is stable when slope is near 0
    return F.when(u == 0, F.lit(0.0)).otherwise(2 * u / (a + F.sqrt(a * a + 4 * F.col("slope") * u)))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per document: size, source_size, target, taken and the position of its first copy; range-sorted by position."""
    sized = checkpoint(sizes(docs, id_col, text_col, source_col))
    laid = lay_out(sized, **how)
    out = laid.select("doc_id", "size", "source_size", "target", taken().alias("taken"), "source", position(F.col("start")).alias("position"))
    return out.orderBy("position", "doc_id")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed corpus itself: a row for each copy of each document taken, with the documents' own columns, range-sorted by position.

    The last copy of at most one document of each source is cut, between words, where
    the target is met; all others are whole.  Documents without words take no words
    and are left out.
    """
    own = docs.columns
    sized = sizes(docs, id_col, text_col, source_col)
    laid = lay_out(checkpoint(sized), **how)
    plan = F.struct("taken", "source_size", "target", "slope", "start")
    copies = laid.withColumn("taken", taken()).filter("taken > 0").select(F.struct("doc_id", "source", "size").alias("_key"), plan.alias("_plan"))
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size")).alias("_key"), F.struct(*[F.col(c) for c in own]).alias("_doc"))
    # one shuffle of the texts: rows and plans meet by key, and rows alike in id, source and size by their number among them
    both = rows.withColumn("_is_row", F.lit(True)).unionByName(copies.withColumn("_is_row", F.lit(False)), allowMissingColumns=True).repartition("_key")
    both = both.withColumn("_n", F.row_number().over(Window.partitionBy("_key", "_is_row").orderBy("_plan.start", F.col(f"_doc.{text_col}"))))
    both = both.withColumn("_plan", F.first("_plan", ignorenulls=True).over(Window.partitionBy("_key", "_n").orderBy("_is_row")))
    joined = both.filter("_is_row AND _plan IS NOT NULL").select("_doc", F.col("_key.doc_id").alias("_id"), F.col("_key.size").alias("_size"), "_plan.*")
    each = joined.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("_size")).cast("int") - 1)))
    words = F.least(F.col("_size"), F.col("taken") - F.col("_copy") * F.col("_size"))
    each = each.withColumn("_words", words).withColumn("_at", position(F.col("start") + F.col("_copy") * F.col("source_size")))
    text = F.col(f"_doc.{text_col}")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("_words").cast("int")), "")
    taken_text = F.when(F.col("_words") < F.col("_size"), cut).otherwise(text)
    return each.orderBy("_at", "_id", "_copy").select(*[(taken_text if c == text_col else F.col(f"_doc.{c}")).alias(c) for c in own])
