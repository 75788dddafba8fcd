"""Record sets, lists, sorted sets, value sets and value cursors: thin wrappers over DataFrames.

All are immutable; an operation gives a new object and runs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pattern import Pattern
from ..functions.values import nocase, num_or_zero, right_adjusted, to_num
from ..plans.catalog import FILE, FILE_IX, RECNUM
from .ranking import numbered

if TYPE_CHECKING:
    from .context import Context

ID = [FILE_IX, RECNUM]
#: Most keys of one sort.
MAX_KEYS = 100
KEY_TYPES = ("DEFAULT", "CHARACTER", "NUMERIC", "RIGHT_ADJUSTED", "NOCASE")


#: What a cursor does when the value it is sent to isn't there.
MISSES = ("next", "prev", "invalidate", "remain")


class SetError(ValueError):
    pass


def _pair_maker(field_ix: int, name: str):
    return lambda v, k: F.struct(F.lit(field_ix).alias("field_ix"), F.lit(name).alias("fname"), (k + 1).alias("occ"), v.alias("sval"))


@dataclass(frozen=True)
class RecordSet:
    """Records of a context.  ``frame`` holds whole rows, ``ids`` their identities."""

    context: "Context"
    frame: DataFrame

    @property
    def ids(self) -> DataFrame:
        return self.frame.select(*ID)

    def count(self) -> DataFrame:
        return self.frame.agg(F.count("*").alias("n"))

    def __len__(self) -> int:
        return self.frame.count()

    def find(self, criteria: Any) -> "RecordSet":
        """Refers back: the members that meet the criteria."""
        return self.context.find(criteria, within=self)

    def _same(self, other: "RecordSet") -> None:
        if other.context.key != self.context.key:
            raise SetError("the sets belong to different contexts")

    def place(self, other: "RecordSet") -> "RecordSet":
        """Union; rows of this set come first, those it lacks are added."""
        self._same(other)
        if other is self:
            return self
        return replace(self, frame=self.frame.unionByName(other.frame.join(self.ids, ID, "left_anti")))

    def remove(self, other: "RecordSet") -> "RecordSet":
        self._same(other)
        return self.clear() if other is self else replace(self, frame=self.frame.join(other.ids, ID, "left_anti"))

    def intersect(self, other: "RecordSet") -> "RecordSet":
        self._same(other)
        return self if other is self else replace(self, frame=self.frame.join(other.ids, ID, "left_semi"))

    def place_record(self, recnum: int, file: str | None = None) -> "RecordSet":
        return self.place(replace(self, frame=self.context.record(recnum, file)))

    def remove_record(self, recnum: int, file: str | None = None) -> "RecordSet":
        ix = self.context.file_ix(file)
        return replace(self, frame=self.frame.where(~((F.col(FILE_IX) == ix) & (F.col(RECNUM) == recnum))))

    def clear(self) -> "RecordSet":
        return replace(self, frame=self.frame.where(F.lit(False)))

    def clear_member(self, file: str) -> "RecordSet":
        return replace(self, frame=self.frame.where(F.col(FILE_IX) != self.context.file_ix(file)))

    # --- reading ---------------------------------------------------------------------------------

    def ordered(self) -> DataFrame:
        """Natural order: member files in turn, record numbers rising."""
        return self.frame.orderBy(*ID)

    def record_numbers(self, most: int) -> DataFrame:
        return self.frame.select(*ID).orderBy(*ID).limit(most)

    def record_at(self, n: int) -> DataFrame:
        """The n-th record (from 0) in natural order, found by its place among the record numbers."""
        if n < 0:
            return self.clear().frame
        here = numbered(self.ids, tuple(F.col(c).asc() for c in ID)).where(F.col("rn") == n + 1)
        return self.frame.join(F.broadcast(here.select(*ID)), ID, "left_semi")  # one row

    def cursor(self) -> Iterator[Row]:
        """Rows in natural order, one partition at a time."""
        for row in self.ordered().toLocalIterator():
            self.context.counted("RECDS")
            yield row

    def _column(self, name: str) -> tuple[Column, bool]:
        self.context.field(name)
        return F.col(f"`{name}`"), isinstance(self.frame.schema[name].dataType, T.ArrayType)

    def occurrence(self, name: str, occ: int = 1, alias: str = "value") -> DataFrame:
        """Value of one occurrence (from 1), with the default of a missing field, and whether it is there."""
        c, multi = self._column(name)
        v = (F.get(c, F.lit(occ - 1)) if occ > 0 else F.lit(None)) if multi else (c if occ == 1 else F.lit(None))
        kind = self.frame.schema[name].dataType
        kind = kind.elementType if multi else kind
        missing = F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else F.lit(None)
        return self.frame.select(*ID, F.coalesce(v, missing).alias(alias), v.isNotNull().alias("found"))

    def count_occurrences(self, name: str) -> DataFrame:
        c, multi = self._column(name)
        n = F.coalesce(F.size(c), F.lit(0)) if multi else c.isNotNull().cast("int")
        return self.frame.select(*ID, n.cast("long").alias("n"))

    def pairs(self, names: list[str] | None = None) -> DataFrame:
        """Field=value pairs: (_file_ix, _recnum, pair, fname, occ, sval), in field order."""
        names = names or list(self.context.fields)
        lists = []
        for i, name in enumerate(names):
            c, multi = self._column(name)
            values = F.coalesce(c.cast("array<string>"), F.array().cast("array<string>")) if multi else F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c.cast("string")))
            lists.append(F.transform(values, _pair_maker(i, name)))
        spread = self.frame.select(*ID, F.posexplode(F.concat(*lists)).alias("pair", "e"))
        return spread.select(*ID, "pair", "e.fname", F.col("e.occ").alias("occ"), F.col("e.sval").alias("sval"))

    def blob_length(self, name: str) -> DataFrame:
        c, _ = self._column(name)
        return self.frame.select(*ID, F.length(c).cast("long").alias("length"))

    def copy(self) -> DataFrame:
        """All information of every record."""
        return self.frame

    # --- values ----------------------------------------------------------------------------------

    def values(self, name: str) -> DataFrame:
        """Every occurrence's value; missing ones don't appear."""
        c, multi = self._column(name)
        source = self.frame.select(FILE_IX, F.explode(c).alias("value")) if multi else self.frame.select(FILE_IX, c.alias("value"))
        return source.where("value IS NOT NULL")

    def histogram(self, name: str) -> DataFrame:
        """(value, n): how many records have each value."""
        c, multi = self._column(name)
        source = self.frame.select(F.explode(F.array_distinct(c)).alias("value")) if multi else self.frame.select(c.alias("value"))
        return source.where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))

    # --- sorting ---------------------------------------------------------------------------------

    def sort(self, *keys: "SortKey | str", collect: list[str] | None = None, first_only: list[str] = (), limit: int | None = None) -> "SortedSet":
        self.context.counted("SORTS")
        return SortedSet.of(self, tuple(k if isinstance(k, SortKey) else SortKey(k) for k in keys), collect, tuple(first_only), limit)


@dataclass(frozen=True)
class FoundSet(RecordSet):
    lock: str = "NONE"

    def unlock(self) -> "FoundSet":
        """Snapshots need no locks; the flag is only carried."""
        return replace(self, lock="NONE")


@dataclass(frozen=True)
class SortKey:
    field: str
    descending: bool = False
    type: str = "DEFAULT"
    each: bool = False


@dataclass(frozen=True)
class SortedSet:
    """Rows in order.  ``frame`` is ordered; ``ranked`` numbers the rows instead."""

    base: RecordSet
    keys: tuple[SortKey, ...]
    rows: DataFrame
    order: tuple[Column, ...]
    columns: tuple[str, ...]

    @staticmethod
    def of(base: RecordSet, keys: tuple[SortKey, ...], collect: list[str] | None, first_only: tuple[str, ...], limit: int | None) -> "SortedSet":
        names = [k.field for k in keys]
        if not 1 <= len(keys) <= MAX_KEYS or len(set(names)) < len(names):
            raise SetError("a sort needs 1 to 100 different keys")
        for k in keys:
            if base.context.field(k.field).storage == "INVISIBLE" or k.type not in KEY_TYPES:
                raise SetError(f"can't sort by {k.field}")
        collect = list(base.context.fields) if collect is None else collect
        rows = base.frame.select(*ID, FILE, *dict.fromkeys([*names, *collect]))
        if limit is not None:  # the first records of the set, before any ordering
            rows = rows.orderBy(*ID).limit(limit)
        turns = []
        for k in keys:
            if k.each and isinstance(rows.schema[k.field].dataType, T.ArrayType):
                turn = f"_turn_{len(turns)}"
                c = F.col(f"`{k.field}`")
                rows = rows.select("*", F.posexplode(c).alias(turn, "_occurrence")).drop("_occurrence")
                # the occurrence in turn comes first, the others follow round the circle
                rows = rows.withColumn(k.field, F.concat(F.slice(c, F.col(turn) + 1, F.size(c)), F.slice(c, F.lit(1), F.col(turn))))
                turns.append(turn)
        order: list[Column] = []
        for k in keys:
            for c in sort_columns(rows, k, base.context.field(k.field).storage == "FLOAT"):
                order.append(c.desc_nulls_first() if k.descending else c.asc_nulls_first())
        order += [F.col(c).asc() for c in (*ID, *turns)]
        for name in first_only:
            if isinstance(rows.schema[name].dataType, T.ArrayType):
                rows = rows.withColumn(f"_first_{name}", F.get(F.col(f"`{name}`"), F.lit(0)))
        return SortedSet(base, keys, rows, tuple(order), tuple(collect))

    def records(self) -> DataFrame:
        """The sorted records with all their fields, read from the records themselves: for a sort that collected
        its keys only."""
        places = numbered(self.rows.select(*dict.fromkeys([*ID, *(k.field for k in self.keys), *(c for c in self.rows.columns if c.startswith("_turn_"))])), self.order).select("rn", *ID)
        return places.join(self.base.frame, ID).select("rn", *self.base.frame.columns)

    def _out(self) -> list[Column]:
        return [F.col(f"_first_{c}").alias(c) if f"_first_{c}" in self.rows.columns else F.col(f"`{c}`") for c in self.columns]

    @property
    def frame(self) -> DataFrame:
        return self.rows.orderBy(*self.order).select(*ID, *self._out())

    def top(self, k: int) -> DataFrame:
        """The first k rows in order: one bounded heap per partition, no full sort."""
        return self.rows.orderBy(*self.order).limit(k).select(*ID, *self._out())

    def ranked(self) -> DataFrame:
        """Rows with their place in the order (from 1)."""
        return numbered(self.rows, self.order).select("rn", *ID, *self._out())

    def record_at(self, n: int) -> DataFrame:
        return self.ranked().where(F.col("rn") == n + 1)

    def count(self) -> DataFrame:
        return self.rows.agg(F.count("*").alias("n"))


def sort_columns(rows: DataFrame, key: SortKey, is_float: bool) -> list[Column]:
    """Sort expressions of a key: its first occurrence under the key's type."""
    kind = rows.schema[key.field].dataType
    c = F.col(f"`{key.field}`")
    if isinstance(kind, T.ArrayType):
        c, kind = F.get(c, F.lit(0)), kind.elementType
    type_ = ("NUMERIC" if is_float else "CHARACTER") if key.type == "DEFAULT" else key.type
    if type_ == "NUMERIC":
        return [c if not isinstance(kind, T.StringType) else to_num(c)]
    text = c if isinstance(kind, (T.StringType, T.TimestampType, T.DateType)) else c.cast("string")
    return {"CHARACTER": [text], "RIGHT_ADJUSTED": right_adjusted(text), "NOCASE": [nocase(text)]}[type_]


# --- values --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ValueSet:
    """Distinct values of a field; ``frame`` has the column ``value`` in ``order``."""

    source: DataFrame
    order: tuple[Column, ...]

    @property
    def frame(self) -> DataFrame:
        return self.source.orderBy(*self.order)

    def count(self) -> DataFrame:
        return self.source.agg(F.count("*").alias("n"))

    def ranked(self) -> DataFrame:
        """(rn, value), numbering from 1."""
        return numbered(self.source, self.order).select("rn", "value")

    def at(self, i: int) -> DataFrame:
        """The i-th value, from 0."""
        return self.ranked().where(F.col("rn") == i + 1).select("value")

    def sort(self, type_: str = "DEFAULT", descending: bool = False) -> "ValueSet":
        """Converts the values to the type first: a non-number becomes 0, duplicates stay."""
        source, kind = self.source, self.source.schema["value"].dataType
        if type_ == "NUMERIC" and isinstance(kind, T.StringType):
            source = source.select(num_or_zero(F.col("value")).alias("value"))
        c = F.col("value")
        keys = {"NOCASE": [nocase(c.cast("string")), c], "RIGHT_ADJUSTED": right_adjusted(c.cast("string"))}.get(type_, [c])
        return ValueSet(source, tuple(k.desc() if descending else k.asc() for k in keys))

    def cursor(self) -> "ValueCursor":
        return ValueCursor(self.source)


@dataclass(frozen=True)
class ValueCursor:
    """Navigation over sorted distinct values; a position is the value it stands on, a frame of 0 or 1 row."""

    source: DataFrame
    low: tuple[str, Any] | None = None
    high: tuple[str, Any] | None = None
    descending: bool = False

    def restrict(self, low: Any = None, high: Any = None, low_inclusive: bool = True, high_inclusive: bool = True, like: str | None = None, unlike: str | None = None) -> "ValueCursor":
        c, source = F.col("value"), self.source
        if low is not None:
            source = source.where(c >= low if low_inclusive else c > low)
        if high is not None:
            source = source.where(c <= high if high_inclusive else c < high)
        for pattern, wanted in ((like, True), (unlike, False)):
            if pattern is not None:
                if not isinstance(source.schema["value"].dataType, T.StringType):
                    raise SetError("a pattern needs a character index")
                test = Pattern.of(pattern).matches(c)
                source = source.where(test if wanted else ~test)
        return replace(self, source=source)

    def first(self) -> DataFrame:
        return self.source.agg((F.max if self.descending else F.min)("value").alias("value"))

    def last(self) -> DataFrame:
        return self.source.agg((F.min if self.descending else F.max)("value").alias("value"))

    def advance(self, position: Any, n: int) -> DataFrame:
        """The value n steps on from ``position`` (n < 0: back); no row beyond the ends."""
        up = (n >= 0) != self.descending
        c = F.col("value")
        ahead = self.source.where(c >= position if up else c <= position)
        # the n + 1 nearest are few, whatever the number of values
        near = ahead.orderBy(c.asc() if up else c.desc()).limit(abs(n) + 1)
        return near.agg(F.count("*").alias("k"), (F.max if up else F.min)("value").alias("value")).where(F.col("k") == abs(n) + 1).select("value")

    def set_position(self, value: Any, miss: str = "next", position: Any = None) -> DataFrame:
        """The value itself, or on a miss the next one, the previous one, nothing (``invalidate``), or the
        ``position`` the cursor had (``remain``; nothing if it had none).

        Where a search begins (current position, first or last value) has no effect on what it finds.
        """
        if miss not in MISSES:
            raise SetError(f"no way to miss called {miss!r}")
        c = F.col("value")
        if miss == "invalidate":
            return self.source.where(c == value).select("value")
        if miss == "remain":
            near = self.source.where(c.isin([value] if position is None else [value, position])).select("value")
            return near.orderBy(F.desc(c == value)).limit(1)  # at most two rows
        up = (miss == "next") != self.descending
        found = self.source.where(c >= value).agg(F.min("value").alias("value")) if up else self.source.where(c <= value).agg(F.max("value").alias("value"))
        return found.where("value IS NOT NULL")

    def steps(self, n: int = 1) -> DataFrame:
        """Every value with the one n steps on."""
        order = (F.col("value").desc() if self.descending else F.col("value").asc(),)
        places = numbered(self.source, order)
        ahead = places.select((F.col("rn") - n).alias("rn"), F.col("value").alias("next_value"))
        return places.join(ahead, "rn", "left").select("value", "next_value")


@dataclass
class CursorPosition:
    """A value cursor that stands somewhere: on a value, or nowhere (``value`` is None)."""

    cursor: ValueCursor
    value: Any = None

    @property
    def accessible(self) -> bool:
        return self.value is not None

    def _stand(self, found: DataFrame) -> bool:
        row = found.first()  # a position is one value
        self.value = None if row is None else row["value"]
        return self.accessible

    def goto_first(self) -> bool:
        return self._stand(self.cursor.first())

    def goto_last(self) -> bool:
        return self._stand(self.cursor.last())

    def advance(self, n: int = 1) -> bool:
        return self.accessible and self._stand(self.cursor.advance(self.value, n))

    def set_position(self, value: Any, miss: str = "invalidate") -> bool:
        return self._stand(self.cursor.set_position(value, miss, self.value))

    def clone(self) -> "CursorPosition":
        return CursorPosition(self.cursor, self.value)

    def adopt(self, other: "CursorPosition") -> None:
        """Goes where another cursor over the same values stands."""
        self._same(other)
        self.value = other.value

    def swap(self, other: "CursorPosition") -> None:
        self._same(other)
        self.value, other.value = other.value, self.value

    def _same(self, other: "CursorPosition") -> None:
        if self.cursor.source is not other.cursor.source:
            raise SetError("the cursors belong to different values")
