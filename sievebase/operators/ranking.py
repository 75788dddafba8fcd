"""Numbering ordered rows without putting them all into one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..plans.checkpoints import checkpointed

#: Bits that ``monotonically_increasing_id`` keeps for the place within a partition.
_PLACE_BITS = 33


def numbered(rows: DataFrame, order: tuple[Column, ...], name: str = "rn") -> DataFrame:
    """``rows`` with their place in ``order`` (from 1) in column ``name``.

    Rows are range-partitioned by the order and sorted within each partition, where their place is
    their id; what the partitions before hold is added.  The dealt rows are checkpointed, because the
    ranges are sampled: counting and numbering must see the same ones.  There is one shuffle, and only
    one row per partition is gathered and broadcast.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _PLACE_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    joined = dealt.withColumn("_part", part).join(F.broadcast(shifts), "_part")
    own = F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return joined.withColumn(name, (own + F.col("_shift") + 1).cast("long")).drop("_part", "_place", "_shift")


def tie_breakers(rows: DataFrame, order: list[str]) -> tuple[Column, ...]:
    """Ascending by the columns ``order``, then by all others that can be ordered: only rows equal in all are
    tied, and a hot value is still dealt to several partitions."""
    rest = [f.name for f in rows.schema if f.name not in order and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return tuple(F.col(f"`{c}`").asc_nulls_first() for c in [*order, *rest])
