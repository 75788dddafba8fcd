"""Engine and contexts: opening files and groups, finding, values, lists."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.admin import Parameters, Statistics
from ..plans.catalog import FILE, FILE_IX, RECNUM, CatalogError, Field, FileDef
from .parser import parse_find
from .predicate import ALL, Binder, Criteria, Leaf, PredicateError, set_conjuncts, where
from .sets import ID, FoundSet, RecordSet, SetError, ValueCursor, ValueSet

LOCKS = ("NONE", "SHR", "EXCL")
DISPOSITIONS = ("NEW", "OLD", "COND", "MOD", "READONLY", "TEMP")


@dataclass(frozen=True)
class Context:
    """An open file, or a group of files that is queried as their union."""

    name: str
    members: tuple[FileDef, ...]
    update_file: str | None = None
    key: str = ""
    #: Records that criteria without a pushed filter may scan: -1 any, 0 none.
    mbscan: int = -1
    #: Refuse bad numbers instead of storing 0.
    strict: bool = False
    read_only: bool = False
    statistics: Statistics | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "key", f"{self.name}:{','.join(m.name for m in self.members)}")
        for a in self.members:
            for b in self.members:
                for n in a.fields.keys() & b.fields.keys():
                    if a.fields[n].flags() != b.fields[n].flags():
                        raise CatalogError(f"field {n} differs between {a.name} and {b.name}")

    def counted(self, counter: str, n: int = 1) -> None:
        if self.statistics is not None:
            self.statistics.add(counter, n)

    @property
    def fields(self) -> dict[str, Field]:
        return {n: f for m in self.members for n, f in m.fields.items()}

    def field(self, name: str) -> Field:
        if name not in self.fields:
            raise CatalogError(f"{self.name} has no field {name}")
        return self.fields[name]

    def file_ix(self, file: str | None) -> int:
        names = [m.name for m in self.members]
        if file is None and len(names) == 1:
            return 0
        if file not in names:
            raise SetError(f"{file} is not a member of {self.name}")
        return names.index(file)

    @property
    def frame(self) -> DataFrame:
        """All records; a member that lacks a field has it missing."""
        tagged = [m.frame.select(F.lit(i).alias(FILE_IX), F.lit(m.name).alias(FILE), "*") for i, m in enumerate(self.members)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)

    def _merged(self) -> FileDef:
        return replace(self.members[0], fields=self.fields)

    # --- finding ---------------------------------------------------------------------------------

    def find(self, criteria: Criteria | str | None = None, *operands: Any, within: RecordSet | None = None, lock: str = "NONE") -> FoundSet:
        """Records that meet the criteria: a tree, a text, or ``field, op, value``; none: all records."""
        if lock not in LOCKS:
            raise PredicateError(f"no lock {lock}")
        self.counted("FINDS")
        if operands:
            criteria = where(criteria, *operands)
        elif isinstance(criteria, str):
            criteria = parse_find(criteria)
        if within is not None and within.context.key != self.key:
            raise SetError("the base set belongs to another context")
        rows = within.frame if within is not None else self.frame
        columns = rows.columns
        sets, rest = set_conjuncts(criteria if criteria is not None else ALL)
        if rest is not None:
            binder = Binder(self._merged(), rows)
            test = binder.column(rest)
            for members, flag in binder.sets:
                self._own(members)
                rows = rows.join(members.ids.distinct().withColumn(flag, F.lit(True)), ID, "left")
            rows = rows.where(test)
            self._guard(rest)
            if binder.sets:
                rows = rows.select(*columns)
        for members, positive in sets:
            self._own(members)
            rows = rows.join(members.ids, ID, "left_semi" if positive else "left_anti")
        return FoundSet(self, rows, lock)

    def _own(self, members: RecordSet) -> None:
        if members.context.key != self.key:
            raise SetError("the set belongs to another context")

    def _guard(self, criteria: Criteria) -> None:
        """MBSCAN: refuses criteria on unindexed fields over too many records."""
        if self.mbscan < 0:
            return
        scans = [x for x in criteria.leaves() if x.field and (self.field(x.field).index == "NONE" or x.op == "PRESENT")]
        if scans and (self.mbscan == 0 or self.frame.count() > self.mbscan):
            raise PredicateError(f"{scans[0]} needs a scan, which MBSCAN={self.mbscan} forbids")

    def record(self, recnum: int, file: str | None = None) -> DataFrame:
        return self.frame.where((F.col(FILE_IX) == self.file_ix(file)) & (F.col(RECNUM) == recnum))

    def records(self, ids: DataFrame) -> RecordSet:
        """The records named by (_file_ix, _recnum)."""
        return RecordSet(self, self.frame.join(ids.select(*ID).distinct(), ID, "left_semi"))

    def create_list(self) -> RecordSet:
        return RecordSet(self, self.frame.where(F.lit(False)))

    # --- values ----------------------------------------------------------------------------------

    def _values(self, name: str, op: str | None, operands: tuple) -> DataFrame:
        if op in ("EQ", "NOT_EQ"):
            raise PredicateError("finding values takes ranges and patterns, not EQ")
        values = RecordSet(self, self.frame).values(name)
        if op in (None, "ALLVALUES"):
            return values
        f = self.field(name)
        if op in ("LIKE", "UNLIKE") and f.index != "CHAR":
            raise PredicateError("a pattern needs a character index")
        single = replace(self.members[0], fields={"VALUE": replace(f, name="VALUE", multi=False)}, frame=values.withColumnRenamed("value", "VALUE"))
        test = Binder(single, single.frame).column(Leaf(op, "VALUE", operands))
        return single.frame.where(test).withColumnRenamed("VALUE", "value")

    def find_values(self, name: str, op: str | None = None, *operands: Any, file: str | None = None) -> ValueSet:
        """Distinct values in order, over all members or one."""
        values = self._values(name, op, operands)
        if file is not None:
            values = values.where(F.col(FILE_IX) == self.file_ix(file))
        return ValueSet(values.select("value").distinct(), (F.col("value").asc(),))

    def count_values(self, name: str, op: str | None = None, *operands: Any) -> DataFrame:
        if len(self.members) > 1:
            raise SetError("values are counted in one file only")
        return self._values(name, op, operands).agg(F.countDistinct("value").alias("n"))

    def values_per_member(self, name: str) -> DataFrame:
        """One row: how many members have a value at all."""
        return RecordSet(self, self.frame).values(name).agg(F.countDistinct(FILE_IX).alias("n"))

    def value_cursor(self, name: str, descending: bool = False) -> ValueCursor:
        return ValueCursor(self.find_values(name).source, descending=descending)

    def file_records_under(self, found: RecordSet, name: str, value: Any) -> "Context":
        """Replaces the records filed under a value of an invisible field."""
        if len(self.members) != 1 or self.field(name).storage != "INVISIBLE":
            raise PredicateError("records are filed under a value of an invisible field of one file")
        self._own(found)
        member = self.members[0]
        new = found.frame.select(F.lit(name).alias("field"), F.lit(str(value)).alias("value"), RECNUM)
        old = member.entries
        kept = new if old is None else old.where(~((F.col("field") == name) & (F.col("value") == str(value)))).unionByName(new)
        return replace(self, members=(replace(member, entries=kept),))

    def find_filed(self, name: str, value: Any) -> FoundSet:
        """Records filed under a value of an invisible field."""
        entries = self.members[0].entries
        if entries is None:
            return FoundSet(self, self.frame.where(F.lit(False)))
        own = entries.where((F.col("field") == name) & (F.col("value") == str(value))).select(RECNUM)
        return FoundSet(self, self.frame.join(own, RECNUM, "left_semi").select(*self.frame.columns))

    # --- updating --------------------------------------------------------------------------------

    def update_member(self) -> FileDef:
        """The file that takes new records: the only one, or a group's update file."""
        if self.read_only:
            raise CatalogError(f"{self.name} is open for reading only")
        if len(self.members) > 1 and self.update_file is None:
            raise CatalogError(f"group {self.name} has no update file")
        return self.members[self.file_ix(self.update_file if len(self.members) > 1 else None)]

    def store_record(self, pairs: list[tuple[str, Any]]) -> "Context":
        """Appends one record to the file that takes updates."""
        from .updates import store_record

        changed = store_record(self.update_member(), pairs, self.strict)
        self.counted("RECADD")
        return self.with_file(changed)

    def store_records(self, rows: DataFrame, order: list[str]) -> "Context":
        from .updates import store_records

        return self.with_file(store_records(self.update_member(), rows, order, self.strict))

    def with_file(self, file: FileDef) -> "Context":
        return replace(self, members=tuple(file if m.name == file.name else m for m in self.members))


@dataclass
class Engine:
    """Names of files and groups, and the contexts opened on them."""

    spark: SparkSession
    files: dict[str, FileDef] = field(default_factory=dict)
    groups: dict[tuple[str, str], tuple[tuple[str, ...], str | None]] = field(default_factory=dict)
    opened: dict[str, Context] = field(default_factory=dict)
    parameters: Parameters = field(default_factory=Parameters)
    statistics: Statistics = field(default_factory=Statistics)
    dispositions: dict[str, str] = field(default_factory=dict)

    def allocate(self, file: FileDef, disposition: str = "NEW") -> None:
        """NEW and TEMP must not exist, OLD and READONLY must, COND may and is then left alone, MOD replaces it.
        A READONLY file takes no updates, a TEMP one goes when it is closed."""
        if disposition not in DISPOSITIONS:
            raise CatalogError(f"no disposition {disposition}")
        there = file.name in self.files
        if disposition in ("NEW", "TEMP") and there or disposition in ("OLD", "READONLY") and not there:
            raise CatalogError(f"{file.name} {'exists' if there else 'does not exist'}")
        if not (disposition in ("COND", "OLD", "READONLY") and there):
            self.files[file.name] = file
        self.dispositions[file.name] = disposition

    def free(self, name: str) -> None:
        if any(m.name == name for c in self.opened.values() for m in c.members):
            raise CatalogError(f"{name} is open")
        del self.files[name]
        self.dispositions.pop(name, None)

    def create(self, name: str, fields: list[Field]) -> FileDef:
        """An empty file."""
        made = FileDef(name, self.spark.createDataFrame([], f"{RECNUM} long"), {})
        for f in fields:
            made = made.define(f)
        self.allocate(made)
        return made

    def initialize(self, name: str, keep_fields: bool = True) -> FileDef:
        old = self.files[name]
        empty = old.frame.where(F.lit(False)) if keep_fields else old.frame.select(RECNUM).where(F.lit(False))
        self.files[name] = FileDef(name, empty, old.fields if keep_fields else {})
        return self.files[name]

    def create_group(self, name: str, members: list[str], update_file: str | None = None, kind: str = "TEMP") -> None:
        if not members or any(m not in self.files for m in members) or update_file not in (None, *members):
            raise CatalogError("a group has existing members, one of which may take updates")
        if (kind, name) in self.groups:
            raise CatalogError(f"{kind} group {name} exists")
        self.groups[kind, name] = (tuple(members), update_file)

    def delete_group(self, name: str, kind: str = "TEMP") -> None:
        del self.groups[kind, name]

    def list_groups(self) -> DataFrame:
        rows = [(n, k, u, list(m)) for (k, n), (m, u) in sorted(self.groups.items())]
        return self.spark.createDataFrame(rows, "name string, kind string, update_file string, members array<string>")

    def display_group(self, name: str) -> DataFrame:
        """One row per member of the group that ``name`` stands for (temporary before permanent): its type,
        place, whether it takes updates, and its fields."""
        kind = next((k for k in ("TEMP", "PERM") if (k, name) in self.groups), None)
        if kind is None:
            raise CatalogError(f"no group {name}")
        members, update_file = self.groups[kind, name]
        rows = [(name, kind, i, m, m == update_file, len(self.files[m].fields)) for i, m in enumerate(members)]
        return self.spark.createDataFrame(rows, "name string, kind string, place int, member string, takes_updates boolean, n_fields int")

    def _context(self, name: str, members: tuple[str, ...], update_file: str | None) -> Context:
        settings = {"mbscan": self.parameters.view("MBSCAN"), "strict": bool(self.parameters.view("STRICTNUM")), "statistics": self.statistics}
        read_only = "READONLY" in (self.dispositions.get(m) for m in ([update_file] if update_file else members))
        return Context(name, tuple(self.files[m] for m in members), update_file, read_only=read_only, **settings)

    def open(self, spec: str) -> Context:
        """``FILE x``, ``GROUP x``, ``TEMP GROUP x``, ``PERM GROUP x`` or a bare name."""
        words = spec.split()
        name = words[-1]
        kinds = {("FILE",): ["FILE"], ("GROUP",): ["TEMP", "PERM"], ("TEMP", "GROUP"): ["TEMP"], ("PERM", "GROUP"): ["PERM"], (): ["TEMP", "PERM", "FILE"]}.get(tuple(words[:-1]))
        if kinds is None:
            raise CatalogError(f"bad context {spec!r}")
        for kind in kinds:
            if kind == "FILE" and name in self.files:
                return self.opened.setdefault(name, self._context(name, (name,), name))
            if (kind, name) in self.groups:
                members, update_file = self.groups[kind, name]
                return self.opened.setdefault(name, self._context(name, members, update_file))
        raise CatalogError(f"no {spec}")

    def find_open(self, name: str) -> Context | None:
        return self.opened.get(name)

    def list_open(self) -> list[str]:
        return sorted(self.opened)

    def close(self, name: str | None = None) -> None:
        for n in [name] if name else list(self.opened):
            self.opened.pop(n, None)
            if self.dispositions.get(n) == "TEMP":
                self.free(n)
