"""Ordered scans without a task for each contig: running maxima and sums in two levels.

Rows are cut into blocks of neighbouring keys. A window inside each block and a window over the (few) block totals
together give what one window over the whole contig would, but no task holds more than a block of rows. A null contig is
a contig of its own, and rows without a position come last in theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width, in positions, of a block of an ordered scan.
BLOCK = 1_000_000


def _with_block(df: DataFrame, position: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(position) / block))


def _last(position: str, order: list[str]) -> list[Column]:
    return [F.asc_nulls_last(position), *order]


def _joined(df: DataFrame, blocks: DataFrame, part: list[str]) -> DataFrame:
    """df with its block's columns, nulls of part and block equal to each other."""
    keys = [*part, "_block"]
    right = blocks.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in blocks.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return df.join(right, same).drop(*[f"_key{i}" for i in range(len(keys))])


def with_carry(df: DataFrame, part: list[str], value: Column, kind: str) -> DataFrame:
    """df, cut into blocks (_block), with _carry: the sum or max of value over the blocks before its own. For parts that have few
    blocks (contigs by position): these are broadcast."""
    total = F.max("_value") if kind == "max" else F.sum("_value")
    blocks = df.withColumn("_value", value).groupBy(*part, "_block").agg(total.alias("_total"))
    before = Window.partitionBy(*part).orderBy(F.asc_nulls_last("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carry = F.max("_total").over(before) if kind == "max" else F.sum("_total").over(before)
    return _joined(df, F.broadcast(blocks.select(*part, "_block", carry.alias("_carry"))), part)


def carried(df: DataFrame, part: list[str], position: str, value: Column, kind: str, block: int = BLOCK) -> DataFrame:
    """with_carry of df cut into blocks of position."""
    return with_carry(_with_block(df, position, block), part, value, kind)


def _two_levels(df: DataFrame, part: list[str], position: str, order: list[str], value: Column, out: str, block: int, kind: str) -> DataFrame:
    df = _with_block(df, position, block).withColumn("_value", value)
    total = F.max("_value") if kind == "max" else F.sum("_value")
    blocks = df.groupBy(*part, "_block").agg(total.alias("_total"))
    before = Window.partitionBy(*part).orderBy(F.asc_nulls_last("_block")).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*part, "_block").orderBy(*_last(position, order))
    if kind == "max":
        blocks = blocks.select(*part, "_block", F.max("_total").over(before).alias("_carry"))
        here = F.max("_value").over(within.rowsBetween(Window.unboundedPreceding, -1))
        result = F.greatest(here, "_carry")
    else:
        blocks = blocks.select(*part, "_block", F.sum("_total").over(before).alias("_carry"))
        here = F.sum("_value").over(within.rowsBetween(Window.unboundedPreceding, 0))
        result = F.coalesce("_carry", F.lit(0)) + here
    return _joined(df, blocks, part).withColumn(out, result).drop("_block", "_value", "_carry")


def running_max_before(df: DataFrame, part: list[str], position: str, order: list[str], value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """out: the greatest value of all earlier rows (null for the first) by position and order, within part."""
    return _two_levels(df, part, position, order, value, out, block, "max")


def running_sum(df: DataFrame, part: list[str], position: str, order: list[str], value: Column, out: str, block: int = BLOCK) -> DataFrame:
    """out: the sum of value over all rows up to this one by position and order, within part."""
    return _two_levels(df, part, position, order, value, out, block, "sum")


def previous_value(df: DataFrame, part: list[str], position: str, order: list[str], value: str, out: str, block: int = BLOCK) -> DataFrame:
    """out: the value of the row before this one by position and order within part, in two levels as above; and
    out_first: whether there is no such row."""
    df = _with_block(df, position, block)
    within = Window.partitionBy(*part, "_block").orderBy(*_last(position, order))
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(F.col(position).isNull(), position, *order))
    blocks = df.groupBy(*part, "_block").agg(last.alias("_tail"))
    blocks = blocks.select(*part, "_block", F.lag("_tail").over(Window.partitionBy(*part).orderBy(F.asc_nulls_last("_block"))).alias("_earlier"))
    tagged = _joined(df.withColumns({"_here": F.lag(F.struct(F.col(value).alias("v"))).over(within)}), blocks, part)
    before = F.coalesce("_here", "_earlier")
    return tagged.withColumns({out: before["v"], f"{out}_first": before.isNull()}).drop("_block", "_here", "_earlier")
