"""Parameters, statistics, find diagnostics and versions on disk."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .catalog import FileDef
from .checkpoints import listed

#: Known parameters and their values at the start: records that a find may scan (-1: any), whether a bad
#: number is refused instead of stored as 0, and the largest record number.
DEFAULTS = {"MBSCAN": -1, "STRICTNUM": 0, "MAXRECNO": 16_777_215}


@dataclass
class Parameters:
    values: dict[str, Any] = field(default_factory=lambda: dict(DEFAULTS))

    def view(self, name: str) -> Any:
        return self.values[name]

    def reset(self, name: str, value: Any) -> Any:
        if name not in self.values:
            raise KeyError(name)
        self.values[name] = type(self.values[name])(value)
        return self.values[name]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, str(v)) for k, v in sorted(self.values.items())], "name string, value string")


@dataclass
class Statistics:
    """Counters of finds and records; records are counted while a result is read, not by a second run."""

    counters: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("FINDS", "RECDS", "DIRRCD", "SORTS", "RECADD", "RECDEL", "COMMITS", "BACKOUTS"), 0))
    pending: list[tuple[str, Observation]] = field(default_factory=list)

    def add(self, counter: str, n: int = 1) -> None:
        self.counters[counter] += n

    def watched(self, frame: DataFrame, counter: str = "RECDS") -> DataFrame:
        """``frame``, its rows counted as they are read."""
        seen = Observation()
        self.pending.append((counter, seen))
        return frame.observe(seen, F.count(F.lit(1)).alias("n"))

    def collect(self) -> dict[str, int]:
        """The counters after the watched results have been read."""
        for counter, seen in self.pending:
            self.counters[counter] += seen.get["n"]
        self.pending.clear()
        return dict(self.counters)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.counters.items()), "name string, n long")


def find_report(context, criteria, run: bool = False) -> dict[str, str]:
    """What a find was given (``spec``), its tree, the expression it is compiled to (``restructured``) and Spark's
    plan for it; nothing is run unless ``run`` asks for how many records meet each criterion and the whole."""
    from ..operators.parser import parse_find
    from ..operators.predicate import Binder, set_conjuncts

    tree = parse_find(criteria) if isinstance(criteria, str) else criteria
    found = context.find(tree).frame
    _, rest = set_conjuncts(tree)
    compiled = "" if rest is None else str(Binder(context._merged(), context.frame).column(rest)._jc)
    plan = found._jdf.queryExecution().explainString(context.frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    out = {"spec": str(criteria), "tree": tree.dump(), "restructured": compiled, "plan": plan}
    if run:
        counts = {r["criterion"]: r["n"] for r in criterion_counts(context, tree).collect()}  # one row per criterion
        out["counts"] = "\n".join([*(f"{k}: {n}" for k, n in counts.items()), f"found: {found.count()}"])
    return out


def criterion_counts(context, criteria) -> DataFrame:
    """(criterion, n): how many records meet each leaf alone, in one pass."""
    from ..operators.parser import parse_find
    from ..operators.predicate import Binder

    tree = parse_find(criteria) if isinstance(criteria, str) else criteria
    binder = Binder(context._merged(), context.frame)
    leaves = [x for x in tree.leaves() if x.op != "SET$"]
    sums = context.frame.agg(*(F.sum(F.coalesce(binder.column(x), F.lit(False)).cast("long")).alias(f"n{i}") for i, x in enumerate(leaves)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(str(x)).alias("criterion"), F.col(f"n{i}").alias("n")) for i, x in enumerate(leaves)))).alias("e")).select("e.*")


def index_analysis(records, name: str) -> DataFrame:
    """One row about a field's index: distinct values, entries, and the shortest, mean and longest list."""
    lists = records.histogram(name)
    return lists.agg(
        F.count("*").alias("n_values"), F.sum("n").alias("n_entries"), F.min("n").alias("shortest"), (F.sum("n") / F.count("*")).alias("mean"), F.max("n").alias("longest"),
        F.sum((F.col("n") == 1).cast("long")).alias("n_singles"),
    )


@dataclass
class Versions:
    """Snapshots of a file below one folder: each checkpoint is a new directory, a rollback reads an older one.

    The folder alone says which versions there are, so a new session goes on where the last one ended.
    A version counts when its data is complete; its number is never used again, even after a rollback.
    """

    spark: SparkSession
    folder: str

    def numbers(self) -> list[int]:
        """Complete versions, rising."""
        names = [n for n in listed(self.spark, self.folder) if n[:1] == "v" and n[1:].isdigit()]
        return sorted(int(n[1:]) for n in names if "_SUCCESS" in listed(self.spark, f"{self.folder}/{n}/data"))

    @property
    def latest(self) -> int:
        return max(self.numbers(), default=0)

    def checkpoint(self, file: FileDef) -> int:
        begun = [int(n[1:]) for n in listed(self.spark, self.folder) if n[:1] == "v" and n[1:].isdigit()]
        version = max(begun, default=0) + 1
        if file.entries is not None:
            file.entries.write.parquet(f"{self.folder}/v{version}/entries")
        file.frame.write.parquet(f"{self.folder}/v{version}/data")  # last: it makes the version complete
        return version

    def rollback(self, file: FileDef, version: int | None = None) -> FileDef:
        there = self.numbers()
        version = (there[-1] if there else 0) if version is None else version
        if version not in there:
            raise ValueError(f"no version {version}")
        at = f"{self.folder}/v{version}"
        entries = self.spark.read.parquet(f"{at}/entries") if "entries" in listed(self.spark, at) else None
        return replace(file, frame=self.spark.read.parquet(f"{at}/data"), entries=entries)
