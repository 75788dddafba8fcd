"""Updates as DataFrame -> DataFrame snapshots.

Every function takes a file and gives a new one; the old one stays as it was, which is what backing out
needs.  ``found`` limits an update to the records of a set; without it all records are changed.
Occurrences count from 1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import num_to_str, to_num
from ..plans.catalog import RECNUM, FileDef
from .ranking import numbered, tie_breakers
from .sets import RecordSet


class UpdateError(ValueError):
    pass


def stored(value: Column, kind: T.DataType, strict: bool = False) -> Column:
    """A value converted to a field's storage; a bad number is 0, or an error if ``strict``."""
    if isinstance(kind, T.NumericType):
        number = F.coalesce(value.try_cast(kind), to_num(value.cast("string")).cast(kind))
        bad = F.raise_error(F.concat(F.lit("not a number: "), value.cast("string"))).cast(kind) if strict else F.lit(0).cast(kind)
        return F.when(value.isNull(), None).otherwise(F.coalesce(number, bad))
    return value.cast(kind)


def _apply(file: FileDef, name: str, change: Callable[[Column, T.DataType], Column], found: RecordSet | None) -> FileDef:
    """Replaces a field's array (or 0/1 occurrence) by ``change`` of it, in the records of ``found``."""
    f = file.field(name)
    kind = file.frame.schema[name].dataType
    multi = isinstance(kind, T.ArrayType)
    element = kind.elementType if multi else kind
    c = F.col(f"`{name}`")
    empty = F.array().cast(T.ArrayType(element))
    before = F.coalesce(c, empty) if multi else F.when(c.isNull(), empty).otherwise(F.array(c))
    after = change(before, element)
    new = F.when(F.size(after) > 0, after) if multi else F.get(after, F.lit(0))
    if found is None:
        return file.with_frame(file.frame.withColumn(f.name, new))
    marked = file.frame.join(found.frame.select(RECNUM).distinct().withColumn("_hit", F.lit(True)), RECNUM, "left")
    columns = [F.when(F.col("_hit"), new).otherwise(c).alias(name) if k == name else F.col(f"`{k}`") for k in file.frame.columns]
    return file.with_frame(marked.select(*columns))


def add_field(file: FileDef, name: str, value: Any, found: RecordSet | None = None, strict: bool = False) -> FileDef:
    """Appends an occurrence (a single-valued field keeps the one it has)."""
    return _apply(file, name, lambda a, k: F.concat(a, F.array(stored(F.lit(value), k, strict))), found)


def insert_field(file: FileDef, name: str, value: Any, occ: int, found: RecordSet | None = None) -> FileDef:
    """Inserts before an occurrence; beyond the end it is appended, 0 means 1, a negative one does nothing."""
    if occ < 0:
        return file
    occ = max(occ, 1)
    return _apply(file, name, lambda a, k: F.concat(F.slice(a, 1, occ - 1) if occ > 1 else F.slice(a, 1, 0), F.array(stored(F.lit(value), k)), F.slice(a, F.lit(occ), F.greatest(F.size(a), F.lit(1)))), found)


def change_field(file: FileDef, name: str, value: Any, occ: int, found: RecordSet | None = None) -> FileDef:
    """Changes an occurrence, in place or (update-at-end fields) by moving it last; a missing one is added."""
    at_end = file.field(name).at_end

    def change(a: Column, k: T.DataType) -> Column:
        new = stored(F.lit(value), k)
        added = F.concat(a, F.array(new))
        if at_end:
            others = F.filter(a, lambda _, i: i != occ - 1)
            there = F.when(F.get(a, F.lit(occ - 1)).eqNullSafe(new), a).otherwise(F.concat(others, F.array(new)))
        else:
            there = F.transform(a, lambda v, i: F.when(i == occ - 1, new).otherwise(v))
        return F.when(F.size(a) >= max(occ, 1), there).otherwise(added)

    return _apply(file, name, change, found)


def change_value(file: FileDef, name: str, old: Any, new: Any, found: RecordSet | None = None) -> FileDef:
    """Changes the first occurrence with a value; where there is none, the new one is added."""

    def change(a: Column, k: T.DataType) -> Column:
        at = F.array_position(a, F.lit(old).cast(k))
        changed = F.transform(a, lambda v, i: F.when(i + 1 == at, stored(F.lit(new), k)).otherwise(v))
        return F.when(at > 0, changed).otherwise(F.concat(a, F.array(stored(F.lit(new), k))))

    return _apply(file, name, change, found)


def delete_field(file: FileDef, name: str, occ: int, found: RecordSet | None = None) -> FileDef:
    return _apply(file, name, lambda a, k: F.filter(a, lambda _, i: i != occ - 1), found)


def delete_value(file: FileDef, name: str, value: Any, found: RecordSet | None = None) -> FileDef:
    """Deletes the first occurrence with a value."""
    return _apply(file, name, lambda a, k: F.filter(a, lambda _, i: i + 1 != F.array_position(a, F.lit(value).cast(k))), found)


def delete_each(file: FileDef, name: str, found: RecordSet | None = None) -> FileDef:
    return _apply(file, name, lambda a, k: F.slice(a, 1, 0), found)


def occurrence_report(file: FileDef, name: str, occ: int | None = None, value: Any = None) -> DataFrame:
    """(_recnum, occ): the occurrence an update by number or value would touch, -1 if absent."""
    c = F.col(f"`{name}`")
    if occ is not None:
        touched = F.when(F.coalesce(F.size(c), F.lit(0)) >= occ, F.lit(occ)).otherwise(F.lit(-1))
    else:
        touched = F.coalesce(F.nullif(F.array_position(c, F.lit(value).cast(file.frame.schema[name].dataType.elementType)), F.lit(0).cast("long")), F.lit(-1))
    return file.frame.select(RECNUM, touched.cast("long").alias("occ"))


def store_records(file: FileDef, rows: DataFrame, order: list[str], strict: bool = False) -> FileDef:
    """Appends records, numbered after the last one in the order of the columns ``order`` and then of the others.

    Fields that ``rows`` lacks are missing in the new records.
    """
    unknown = [c for c in rows.columns if c not in file.fields]
    if unknown:
        raise UpdateError(f"{file.name} has no field {unknown[0]}")
    kinds = {f.name: f.dataType for f in file.frame.schema}

    def converted(c: str) -> Column:
        kind = kinds[c]
        if isinstance(kind, T.ArrayType) and isinstance(rows.schema[c].dataType, T.ArrayType):
            return F.transform(F.col(f"`{c}`"), lambda v: stored(v, kind.elementType, strict))
        return F.array(stored(F.col(f"`{c}`"), kind.elementType, strict)) if isinstance(kind, T.ArrayType) else stored(F.col(f"`{c}`"), kind, strict)

    last = file.frame.agg(F.coalesce(F.max(RECNUM), F.lit(-1)).alias("_last"))
    placed = numbered(rows, tie_breakers(rows, order), "_number")
    new = placed.select((last.scalar() + F.col("_number")).alias(RECNUM), *(converted(c).alias(c) for c in rows.columns))
    return file.with_frame(file.frame.unionByName(new, allowMissingColumns=True))


def store_record(file: FileDef, pairs: list[tuple[str, Any]], strict: bool = False) -> FileDef:
    """Appends one record given as (field, value) pairs in order; repeated fields may come several times."""
    spark = file.frame.sparkSession
    values: dict[str, list] = {}
    for name, value in pairs:
        file.field(name)
        values.setdefault(name, []).append(value)
    columns = []
    for name, own in values.items():
        kind = file.frame.schema[name].dataType
        if isinstance(kind, T.ArrayType):
            columns.append(F.array(*(stored(F.lit(v), kind.elementType, strict) for v in own)).alias(name))
        else:
            columns.append(stored(F.lit(own[-1]), kind, strict).alias(name))
    row = spark.range(1).select(*columns)
    last = file.frame.agg(F.coalesce(F.max(RECNUM), F.lit(-1)).alias("_last"))
    new = row.select((last.scalar() + 1).alias(RECNUM), *row.columns)
    return file.with_frame(file.frame.unionByName(new, allowMissingColumns=True))


def delete_records(file: FileDef, found: RecordSet, keep_entries: bool = True) -> FileDef:
    """Removes records; entries of invisible fields stay behind unless told otherwise."""
    gone = found.frame.select(RECNUM).distinct()
    out = file.with_frame(file.frame.join(gone, RECNUM, "left_anti").select(*file.frame.columns))
    if keep_entries or file.entries is None:
        return out
    return replace(out, entries=file.entries.join(gone, RECNUM, "left_anti"))


#: Dropping existence only: on snapshots the same as deleting.
dirty_delete_records = delete_records


def to_text(file: FileDef, name: str) -> FileDef:
    """A numeric field's values in their display form."""
    return _apply(file, name, lambda a, k: F.transform(a, num_to_str), None)


@dataclass
class UpdateUnit:
    """Commit and backout by keeping snapshots: the first snapshot since the last commit is the way back."""

    current: FileDef
    committed: FileDef | None = None

    def update(self, change: Callable[..., FileDef], *args: Any, **kw: Any) -> "UpdateUnit":
        if self.committed is None:
            self.committed = self.current
        self.current = change(self.current, *args, **kw)
        return self

    @property
    def in_progress(self) -> bool:
        return self.committed is not None

    def commit(self) -> FileDef:
        self.committed = None
        return self.current

    def backout(self) -> FileDef:
        if self.committed is not None:
            self.current, self.committed = self.committed, None
        return self.current
