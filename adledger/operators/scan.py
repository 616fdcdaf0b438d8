"""Prefix scans over range partitions: a key of any size is spread over tasks by its order.

Rows are dealt to range partitions of (keys, order) and written, so the partition of a row
is a stored fact that a lost executor cannot change. Inside a partition ordinary windows
run by (keys, part). Between partitions only one summary per (key, part) is composed: a
window over summaries sees at most one row per partition for a key, however many rows
the key has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adledger.operators.skew import shuffled
from adledger.session import written

PART = "_part"


def in_ranges(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows with the number of their range partition in ``_part``; it never falls along (keys, order)."""
    placed = [F.col(k).asc_nulls_first() for k in keys] + order
    return written(df.repartitionByRange(*placed).withColumn(PART, F.spark_partition_id()))


def part_starts(ranged: DataFrame, keys: list[str], value: Column | None = None) -> DataFrame:
    """(keys, _part, _start, _sum): sum of ``value`` (rows, without one) in the earlier parts of
    the same keys, and in this one. Keys are null-safe as groups; join them as such."""
    amount = F.count("*") if value is None else F.coalesce(F.sum(value), F.lit(0))
    sums = ranged.groupBy(*keys, PART).agg(amount.cast("bigint").alias("_sum"))
    before = W.partitionBy(*keys).orderBy(PART) if keys else W.orderBy(PART)
    before = before.rowsBetween(W.unboundedPreceding, -1)
    return sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))


def running(ranged: DataFrame, starts: DataFrame, keys: list[str], order: list[Column], name: str,
            value: Column | None = None) -> DataFrame:
    """Rows with ``name``: the sum of ``value`` (or number) of the rows before them in their keys.

    ``starts`` is :func:`part_starts`, perhaps with further columns, which the rows get too.
    """
    inside = W.partitionBy(*keys, PART).orderBy(*order)
    if value is None:
        local = F.row_number().over(inside) - 1
    else:
        local = F.coalesce(F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = ranged.withColumn("_local", local)
    other = starts.drop("_sum").withColumnsRenamed({k: f"_at_{k}" for k in [*keys, PART]})
    on = [rows[k].eqNullSafe(other[f"_at_{k}"]) for k in [*keys, PART]]
    joined = rows.join(other, on).withColumn(name, (F.col("_local") + F.col("_start")).cast("bigint"))
    return joined.drop("_local", "_start", PART, *[f"_at_{k}" for k in [*keys, PART]])


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Rows with their place from 0 along ``order`` among the rows of the same ``keys``."""
    ranged = in_ranges(df, keys, order)
    return running(ranged, part_starts(ranged, keys), keys, order, name)


def values_at(rows: DataFrame, column: str, positions: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row: ``n``, and the sorted non-null values of an integer column at positions that follow from n.

    Works on the histogram of values in two levels. Values are 32-bit integers, so there
    are at most 65,536 blocks of 65,536 values each: the only unpartitioned window
    sees one row per block, whatever the size of the input.
    """
    width = 65_536
    histogram = (
        rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("c"))
        .withColumn("block", F.floor(F.col("value") / width))
    )
    blocks = histogram.groupBy("block").agg(F.sum("c").alias("block_c"))
    upto = W.orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)
    blocks = blocks.select(
        "block",
        (F.sum("block_c").over(upto) - F.col("block_c")).alias("before"),
        F.sum("block_c").over(W.partitionBy(F.lit(1))).alias("n"),
    )
    inside = W.partitionBy("block").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = (
        shuffled(histogram).join(blocks, "block")
        .withColumn("upto", F.col("before") + F.sum("c").over(inside))
    )
    return ranked.agg(F.max("n").alias("n"), *[
        F.min(F.when(F.col("upto") > at(F.col("n")), F.col("value"))).alias(name) for name, at in positions.items()])
