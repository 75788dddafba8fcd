"""Joins between contexts.  Semi and anti joins are set criteria; the rest are extensions, since the
record model itself has none.  Spark picks broadcast or sort-merge from the sizes it knows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sets import ID, RecordSet, ValueSet


def records_with_values(records: RecordSet, name: str, values: ValueSet) -> RecordSet:
    """Records of which some occurrence of a field is in a value set."""
    c, multi = records._column(name)
    keyed = records.frame.select(*ID, F.explode(c).alias("value")) if multi else records.frame.select(*ID, c.alias("value"))
    hits = keyed.join(values.source, "value", "left_semi").select(*ID).distinct()
    return RecordSet(records.context, records.frame.join(hits, ID, "left_semi"))


def value_join(left: RecordSet, left_field: str, right: RecordSet, right_field: str, how: str = "inner") -> DataFrame:
    """Equi-join on two fields' values, in place of a cursor loop with a find inside.

    Columns of the right side get the prefix ``r_``.
    """
    renamed = right.frame.select(*(F.col(f"`{c}`").alias(f"r_{c}") for c in right.frame.columns))
    return left.frame.join(renamed, F.col(f"`{left_field}`") == F.col(f"`r_{right_field}`"), how)
