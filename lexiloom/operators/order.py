"""Running sums and ranks over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ordinals in one block.
BLOCK = 65_536


def running_sum(df: DataFrame, by: Sequence[str], block: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row, in each group ``by``, in order of ``block`` and then ``order``.

    A group is never sorted in one task: it is split into blocks, whose sums alone are added up in order; ``block`` has to come
    before ``order`` in the order wanted. Null equals null in ``by`` and ``block``. Rows that are equal in all of them come in any order.
    """
    keys = [*by, *block]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = df.join(offsets, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return joined.withColumn(name, F.col("_before") + F.sum(value).over(inside)).drop("_before", *(f"_{k}" for k in keys))


def rank_from_zero(df: DataFrame, by: Sequence[str], block: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with the place of each row in its group, from 0, split like :func:`running_sum`."""
    return running_sum(df, by, block, order, F.lit(1), name).withColumn(name, F.col(name) - 1)


def block_of(ordinal: Column | str) -> Column:
    """The block of an ordinal."""
    return F.floor((F.col(ordinal) if isinstance(ordinal, str) else ordinal) / BLOCK)
