"""Running sums over long groups: within blocks of a group first, then over the sums of its blocks.

A window over a group that holds a third of all rows would be one task. Here windows see a block of a group, and one row
for each block of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(rows: DataFrame, group: Sequence[str], block: str, order: Sequence[str | Column], sums: Sequence[str], ending: str = "_before") -> DataFrame:
    """rows with, for each column of `sums`, its sum over the earlier rows of the group (0 for the first).

    Columns of `group` and `block` are not null; blocks come in their order, rows of a block in that of `order`. Rows that
    are equal in `order` may come in any order.
    """
    inside = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    offsets = rows.groupBy(*group, block).agg(*(F.sum(c).alias(c) for c in sums))
    offsets = offsets.select(*group, block, *(F.coalesce(F.sum(c).over(earlier), zero).alias(f"_{c}") for c in sums))
    within = rows.select("*", *(F.coalesce(F.sum(c).over(inside), zero).alias(f"{c}{ending}") for c in sums)).join(offsets, [*group, block])
    return within.select(*rows.columns, *((F.col(f"{c}{ending}") + F.col(f"_{c}")).alias(f"{c}{ending}") for c in sums))
