"""Files, fields and their attributes: the catalog that predicates are bound with."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RECNUM, FILE, FILE_IX = "_recnum", "_file", "_file_ix"
STORAGES = ("FLOAT", "STRING", "BLOB", "INVISIBLE")
INDEXES = ("NONE", "CHAR", "NUM")
# Fixed values of the data model.
MAX_FIELDS = 4000
RESERVED_WORDS = {"AND", "OR", "NOT", "IS", "IN", "RANGE", "FROM", "TO", "LIKE", "PRESENT"}
RESERVED_FILES = {"FILE", "GROUP"}
RESERVED_PREFIXES = ("TAPE", "CCA", "SYS", "OUT")


class CatalogError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    """A field's attributes.  ``INVISIBLE`` fields have no column, only (value, record) entries."""

    name: str
    storage: str = "STRING"
    index: str = "NONE"
    multi: bool = False
    at_end: bool = False

    def __post_init__(self) -> None:
        check_field_name(self.name)
        if self.storage not in STORAGES or self.index not in INDEXES:
            raise CatalogError(f"bad attributes of {self.name}")
        if self.storage == "INVISIBLE" and self.index == "NONE":
            raise CatalogError("an invisible field must be indexed")
        if self.storage == "BLOB" and self.index != "NONE":
            raise CatalogError("a BLOB field can't be indexed")

    def flags(self) -> tuple:
        """What must agree between the members of a group."""
        return self.storage, self.index, self.multi


def check_field_name(name: str) -> None:
    if not re.fullmatch(r"[A-Z][^\x00-\x1f@#]{0,254}", name) or name in RESERVED_WORDS or "  " in name:
        raise CatalogError(f"bad field name {name!r}")


def check_file_name(name: str) -> None:
    if not re.fullmatch(r"[A-Z][A-Z0-9@#$]{0,7}", name) or name in RESERVED_FILES or name.startswith(RESERVED_PREFIXES):
        raise CatalogError(f"bad file name {name!r}")


@dataclass(frozen=True)
class FileDef:
    """A named dataset: a frame with ``_recnum`` and one column per stored field."""

    name: str
    frame: DataFrame
    fields: dict[str, Field] = field(default_factory=dict)
    #: Entries of invisible fields: (field, value, _recnum).
    entries: DataFrame | None = None

    def __post_init__(self) -> None:
        check_file_name(self.name)
        if len(self.fields) > MAX_FIELDS:
            raise CatalogError("too many fields")

    @staticmethod
    def over(name: str, frame: DataFrame, key: str | None = None, rename: dict[str, str] | None = None, index: dict[str, str] | None = None) -> "FileDef":
        """A file over existing columns: upper-cased names, ``key`` as the record number.

        Numbers become FLOAT fields with a numeric index, everything else STRING with a character
        index, unless ``index`` says otherwise; arrays are repeated fields.
        """
        rename = rename or {}
        fields, columns = {}, []
        for f in frame.schema:
            if f.name in (RECNUM, FILE, FILE_IX):
                continue
            name_ = rename.get(f.name, f.name.upper())
            multi = isinstance(f.dataType, T.ArrayType)
            kind = f.dataType.elementType if multi else f.dataType
            numeric = isinstance(kind, T.NumericType)
            chosen = (index or {}).get(name_, "NUM" if numeric else "CHAR")
            fields[name_] = Field(name_, "FLOAT" if numeric else "STRING", chosen, multi)
            columns.append(frame[f.name].alias(name_))
        number = frame[key].cast("long") if key else frame[RECNUM].cast("long")
        return FileDef(name, frame.select(number.alias(RECNUM), *columns), fields)

    def with_frame(self, frame: DataFrame) -> "FileDef":
        return replace(self, frame=frame)

    def field(self, name: str) -> Field:
        if name not in self.fields:
            raise CatalogError(f"{self.name} has no field {name}")
        return self.fields[name]

    def dictionary(self, spark: SparkSession) -> DataFrame:
        """One row per field: id, name and attributes, by name."""
        rows = [(i, f.name, f.storage, f.index, f.multi, f.at_end) for i, f in enumerate(sorted(self.fields.values(), key=lambda f: f.name))]
        return spark.createDataFrame(rows, "id int, name string, storage string, index string, multi boolean, at_end boolean")

    def definitions(self, spark: SparkSession) -> DataFrame:
        """``DEFINE FIELD`` lines in alphabetical order."""
        lines = []
        for i, f in enumerate(sorted(self.fields.values(), key=lambda f: f.name)):
            atts = [f.storage, *({"CHAR": ["ORD CHAR"], "NUM": ["ORD NUM"]}.get(f.index, [])), *(["UAE"] if f.at_end else [])]
            lines.append((f"DEFINE FIELD {i} '{f.name}' ({', '.join(atts)})",))
        return spark.createDataFrame(lines, "line string")

    # --- changes of the dictionary ---------------------------------------------------------------

    def define(self, new: Field) -> "FileDef":
        from pyspark.sql import functions as F

        if new.name in self.fields:
            raise CatalogError(f"{new.name} is already defined")
        kind = "double" if new.storage == "FLOAT" else "string"
        kind = f"array<{kind}>" if new.multi else kind
        frame = self.frame if new.storage == "INVISIBLE" else self.frame.withColumn(new.name, F.lit(None).cast(kind))
        return replace(self, frame=frame, fields={**self.fields, new.name: new})

    def rename(self, old: str, new: str) -> "FileDef":
        f = self.field(old)
        if new in self.fields:
            raise CatalogError(f"{new} is already defined")
        fields = {(new if k == old else k): (replace(f, name=new) if k == old else v) for k, v in self.fields.items()}
        from pyspark.sql import functions as F

        entries = self.entries
        if f.storage == "INVISIBLE" and entries is not None:
            entries = entries.withColumn("field", F.when(F.col("field") == old, F.lit(new)).otherwise(F.col("field")))
        return replace(self, frame=self.frame.withColumnRenamed(old, new), fields=fields, entries=entries)

    def delete(self, name: str) -> "FileDef":
        entries = self.entries
        if self.field(name).storage == "INVISIBLE" and entries is not None:
            entries = entries.where(entries["field"] != name)
        return replace(self, frame=self.frame.drop(name), fields={k: v for k, v in self.fields.items() if k != name}, entries=entries)

    def redefine(self, new: Field) -> "FileDef":
        """Changes a field's attributes; of storage and index only one at a time.

        A visible field that becomes invisible leaves its values in the index only, one entry for each
        value of a record; an invisible one that becomes visible gets its values from there, in order.
        """
        from pyspark.sql import functions as F

        from ..functions.values import num_or_zero, num_to_str

        old = self.field(new.name)
        if (old.storage != new.storage) + (old.index != new.index) > 1:
            raise CatalogError("only one large change at a time")
        if "INVISIBLE" in (old.storage, new.storage) and old.storage != new.storage:
            return self._hidden(new) if new.storage == "INVISIBLE" else self._shown(new)
        frame = self.frame
        convert = None
        if old.storage == "STRING" and new.storage == "FLOAT":
            convert = num_or_zero
        elif old.storage == "FLOAT" and new.storage in ("STRING", "BLOB"):
            convert = num_to_str
        if convert:
            column = F.col(f"`{new.name}`")
            frame = frame.withColumn(new.name, F.transform(column, convert) if old.multi else convert(column))
        return replace(self, frame=frame, fields={**self.fields, new.name: new})

    def _hidden(self, new: Field) -> "FileDef":
        from pyspark.sql import functions as F

        from ..functions.values import num_to_str

        kind = self.frame.schema[new.name].dataType
        multi = isinstance(kind, T.ArrayType)
        numeric = isinstance(kind.elementType if multi else kind, T.NumericType)
        c = F.col(f"`{new.name}`")
        rows = self.frame.select(RECNUM, (F.explode(F.array_distinct(c)) if multi else c).alias("value")).where("value IS NOT NULL")
        value = num_to_str(F.col("value")) if numeric else F.col("value").cast("string")
        own = rows.select(F.lit(new.name).alias("field"), value.alias("value"), RECNUM)
        entries = own if self.entries is None else self.entries.select("field", "value", RECNUM).unionByName(own)
        return replace(self, frame=self.frame.drop(new.name), fields={**self.fields, new.name: new}, entries=entries)

    def _shown(self, new: Field) -> "FileDef":
        from pyspark.sql import functions as F

        from ..functions.values import num_or_zero

        own = None if self.entries is None else self.entries.where(F.col("field") == new.name)
        rest = None if self.entries is None else self.entries.where(F.col("field") != new.name)
        bare = replace(self, entries=rest, fields={k: f for k, f in self.fields.items() if k != new.name})
        if own is None:
            return bare.define(new)
        value = num_or_zero(F.col("value")) if new.storage == "FLOAT" else F.col("value")
        values = own.groupBy(RECNUM).agg(F.sort_array(F.collect_list(value)).alias("_values"))
        column = F.col("_values") if new.multi else F.get(F.col("_values"), F.lit(0))
        frame = self.frame.join(values, RECNUM, "left").select(*self.frame.columns, column.alias(new.name))
        return replace(bare, frame=frame, fields={**bare.fields, new.name: new})
