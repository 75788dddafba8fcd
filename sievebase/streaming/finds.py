"""Finds over streams: the same criteria on a streaming frame (an extension).

Filters and projections carry no state, so any criteria without a set, and value counts in event-time
windows, run unchanged.  Sorts and set criteria need a finished input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.parser import parse_find
from ..operators.predicate import Binder, Criteria, PredicateError
from ..plans.catalog import FileDef


def stream_find(file: FileDef, criteria: Criteria | str) -> DataFrame:
    """Records of a streaming file that meet the criteria."""
    tree = parse_find(criteria) if isinstance(criteria, str) else criteria
    if any(leaf.op == "SET$" for leaf in tree.leaves()):
        raise PredicateError("a set criterion needs a finished input")
    binder = Binder(file, file.frame)
    return file.frame.where(binder.column(tree))


def value_counts(found: DataFrame, name: str, time: str, width: str, late: str) -> DataFrame:
    """(start, value, n) per window of event time; rows later than ``late`` are let go, as a watermark does."""
    w = F.window(time, width)
    found = found.withColumn(time, F.col(time).cast("timestamp"))
    return found.withWatermark(time, late).groupBy(w, F.col(f"`{name}`").alias("value")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "value", "n")
