"""Sequential files, unloading and loading."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import from_ebcdic, num_to_str, to_ebcdic
from ..operators.ranking import numbered, tie_breakers
from ..operators.sets import RecordSet
from ..operators.updates import stored
from ..plans.catalog import RECNUM, Field, FileDef
from ..plans.checkpoints import listed

PAI_END = "$$$"
#: Record numbers of one segment of an index list.
SEGMENT = 65_280


# --- sequential files ----------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Lines of a text file, column ``line``; ``most`` limits how many are looked at (a preview)."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return lines if most is None else lines.limit(most)


def read_fixed(spark: SparkSession, path: str, layout: list[tuple[str, int, int]], lrecl: int | None = None) -> DataFrame:
    """Fixed-length records: columns (name, start from 1, length) of each line, or, with ``lrecl``, of
    each run of that many bytes in a file without line ends (a file that ends within a record is an error).

    Such a file is split between tasks at record boundaries, however large it is.
    """
    if lrecl is None:
        lines = read_lines(spark, path)
    else:
        records = spark.sparkContext._jsc.binaryRecords(path, lrecl).rdd()
        made = spark._jsparkSession.createDataset(records, spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF()
        lines = DataFrame(made, spark).select(F.col("value").cast("string").alias("line"))
    return lines.select(*(F.rtrim(F.substring("line", start, n)).alias(name) for name, start, n in layout))


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists", lrecl: int | None = None, pad: str = " ") -> None:
    """Writes column ``line``; with ``lrecl`` each line is padded, and a longer one is an error."""
    c = F.col("line")
    if lrecl is not None:
        c = F.when(F.length(c) > lrecl, F.raise_error(F.lit("line longer than the record length"))).otherwise(F.rpad(c, lrecl, pad))
    lines.select(c.alias("value")).write.mode(mode).text(path)


# --- unload --------------------------------------------------------------------------------------


def _text(file: FileDef, name: str) -> tuple[Column, bool]:
    kind = file.frame.schema[name].dataType
    multi = isinstance(kind, T.ArrayType)
    element = kind.elementType if multi else kind
    # whole numbers are shown as they are; only fractions need the display form
    show = num_to_str if isinstance(element, T.NumericType) and not isinstance(element, T.IntegralType) else (lambda c: c.cast("string"))
    c = F.col(f"`{name}`")
    return (F.transform(c, show) if multi else show(c)), multi


def chosen_fields(file: FileDef, include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Stored fields to unload, each once."""
    names = [n for n, f in file.fields.items() if f.storage != "INVISIBLE" and (include is None or n in include) and n not in (exclude or [])]
    for n in [*(include or []), *(exclude or [])]:
        file.field(n)
    return list(dict.fromkeys(names))


def unload_data(file: FileDef, within: RecordSet | None = None, include: list[str] | None = None, exclude: list[str] | None = None, no_float: bool = False, ebcdic: bool = False) -> DataFrame:
    """Records of a base set with the chosen fields; numbers in their display form with ``no_float``, character
    values in EBCDIC with ``ebcdic``."""
    rows = file.frame if within is None else file.frame.join(within.frame.select(RECNUM), RECNUM, "left_semi")

    def column(n: str) -> Column:
        kind = file.frame.schema[n].dataType
        text = isinstance(kind.elementType if isinstance(kind, T.ArrayType) else kind, T.StringType)
        c = F.col(f"`{n}`")
        if no_float and not text:
            return _text(file, n)[0].alias(n)
        if ebcdic and text:
            return (F.transform(c, to_ebcdic) if isinstance(kind, T.ArrayType) else to_ebcdic(c)).alias(n)
        return c

    return rows.select(RECNUM, *(column(n) for n in chosen_fields(file, include, exclude)))


def _line_maker(name: str, numeric: bool, blob: bool):
    """``NAME = value``, or ``NAME =length=value`` where the value couldn't be told from other lines: always
    for a BLOB, else if it has a line end."""
    plain, counted = F.lit(f"{name} = "), F.lit(f"{name} =")
    if numeric:
        return lambda v: F.concat(plain, v)

    def line(v: Column) -> Column:
        with_length = F.concat(counted, F.length(v).cast("string"), F.lit("="), v)
        return with_length if blob else F.when(F.instr(v, "\n") > 0, with_length).otherwise(F.concat(plain, v))

    return line


def unload_pai(file: FileDef, within: RecordSet | None = None, include: list[str] | None = None, exclude: list[str] | None = None, ebcdic: bool = False, crlf: bool = False) -> DataFrame:
    """(_recnum, text): the record number, a line for each occurrence, and an end mark; with ``crlf`` lines end
    so.  Lengths count characters.  :func:`parse_pai` gives back any value, whatever it holds."""
    parts = []
    for n in chosen_fields(file, include, exclude):
        c, multi = _text(file, n)
        kind = file.frame.schema[n].dataType
        numeric = isinstance(kind.elementType if multi else kind, T.NumericType)
        line = _line_maker(n, numeric, file.field(n).storage == "BLOB")
        parts.append(F.array_join(F.transform(c, line), "\n") if multi else line(c))
    # a field without an occurrence is null and skipped; an empty list would give an empty line
    parts = [F.nullif(p, F.lit("")) for p in parts]
    text = F.concat_ws("\n", F.col(RECNUM).cast("string"), *parts, F.lit(PAI_END))
    text = F.replace(text, F.lit("\n"), F.lit("\r\n")) if crlf else text
    return unload_data(file, within).select(RECNUM, (to_ebcdic(text) if ebcdic else text).alias("text"))


def unload_index(file: FileDef, name: str, within: RecordSet | None = None) -> DataFrame:
    """(value, segment, records, n): each value of an indexed field with its record numbers in order.

    A list covers one segment of record numbers, so that a value most records have is many short
    lists and not one that grows with the file.
    """
    if file.field(name).storage == "INVISIBLE":
        rows = file.entries.where(F.col("field") == name).select("value", RECNUM)
    else:
        c = F.col(f"`{name}`")
        multi = isinstance(file.frame.schema[name].dataType, T.ArrayType)
        rows = file.frame.select(RECNUM, (F.explode(F.array_distinct(c)) if multi else c).alias("value")).where("value IS NOT NULL")
    if within is not None:
        rows = rows.join(within.frame.select(RECNUM), RECNUM, "left_semi")
    return _lists(rows)


def _lists(rows: DataFrame) -> DataFrame:
    segment = F.floor(F.col(RECNUM) / SEGMENT).alias("segment")
    return rows.groupBy("value", segment).agg(F.sort_array(F.collect_list(RECNUM)).alias("records"), F.count("*").alias("n"))


def unload(file: FileDef, path: str, within: RecordSet | None = None, mode: str = "errorifexists") -> None:
    """Definitions and data, as two tables below ``path``."""
    file.definitions(file.frame.sparkSession).coalesce(1).write.mode(mode).text(f"{path}/fields")
    unload_data(file, within).write.mode(mode).parquet(f"{path}/data")
    if file.entries is not None:
        entries = file.entries if within is None else file.entries.join(within.frame.select(RECNUM), RECNUM, "left_semi")
        entries.select("field", "value", RECNUM).write.mode(mode).parquet(f"{path}/entries")


# --- load ----------------------------------------------------------------------------------------


def load_definitions(lines: list[str]) -> dict[str, Field]:
    """Fields from ``DEFINE FIELD [id] 'name' (attributes)`` lines; single-valued until data says otherwise."""
    import re

    out = {}
    for line in lines:
        m = re.fullmatch(r"DEFINE FIELD (?:\d+ )?'(?P<name>.+)' \((?P<atts>[^)]*)\)", line.strip())
        if not m:
            raise ValueError(f"not a field definition: {line!r}")
        atts = [a.strip() for a in m["atts"].split(",")]
        index = "CHAR" if "ORD CHAR" in atts else "NUM" if "ORD NUM" in atts else "NONE"
        out[m["name"]] = Field(m["name"], atts[0], index, at_end="UAE" in atts)
    return out


def load(spark: SparkSession, name: str, path: str, preview: int | None = None) -> FileDef:
    """A file that :func:`unload` wrote, with the entries of its invisible fields; ``preview`` limits the records
    that are looked at."""
    fields = load_definitions([r["value"] for r in spark.read.text(f"{path}/fields").collect()])  # one line per field
    frame = spark.read.parquet(f"{path}/data")
    if preview is not None:
        frame = frame.orderBy(RECNUM).limit(preview)
    fields = {n: replace(f, multi=n in frame.columns and isinstance(frame.schema[n].dataType, T.ArrayType)) for n, f in fields.items()}
    entries = spark.read.parquet(f"{path}/entries") if "entries" in listed(spark, path) else None
    return FileDef(name, frame, fields, entries)


def renumbered(frame: DataFrame, order: list[str], first: int = 0) -> DataFrame:
    """New record numbers in the order of the columns, then of all others; the old one stays in ``_old_recnum``."""
    old = frame.withColumnRenamed(RECNUM, "_old_recnum") if RECNUM in frame.columns else frame
    placed = numbered(old, tie_breakers(old, order), RECNUM)
    return placed.withColumn(RECNUM, F.col(RECNUM) - 1 + first)


def fast_load(file: FileDef, rows: DataFrame, order: list[str], entries: DataFrame | None = None, action: bool = True) -> tuple[FileDef, DataFrame]:
    """Appends unloaded records under new numbers; gives the file and the (old, new) cross-reference.

    ``entries`` (field, value, _recnum under the old numbers) of invisible fields come along.  Without
    ``action`` the records are only read and numbered: the file stays as it is.
    """
    unknown = [c for c in rows.columns if c not in (RECNUM, "_old_recnum") and c not in file.fields]
    if unknown:
        raise ValueError(f"{file.name} has no field {unknown[0]}")
    last = file.frame.agg(F.coalesce(F.max(RECNUM), F.lit(-1)).alias("m")).first()["m"]
    new = renumbered(rows, order, last + 1)
    reference = new.select("_old_recnum", RECNUM) if "_old_recnum" in new.columns else new.select(F.lit(None).cast("long").alias("_old_recnum"), RECNUM)
    if not action:
        return file, reference
    loaded = file.with_frame(file.frame.unionByName(new.drop("_old_recnum"), allowMissingColumns=True))
    if entries is not None:
        moved = entries.withColumnRenamed(RECNUM, "_old_recnum").join(reference, "_old_recnum").select("field", "value", RECNUM)
        loaded = replace(loaded, entries=moved if file.entries is None else file.entries.unionByName(moved))
    return loaded, reference


def load_index(entries: DataFrame, reference: DataFrame) -> DataFrame:
    """Index entries (value, records) under the new record numbers."""
    spread = entries.select("value", F.explode("records").alias("_old_recnum"))
    return _lists(spread.join(reference, "_old_recnum").select("value", RECNUM))


#: A line that begins an occurrence: the field's name, then either a length or nothing before the value.
_HEAD = r"(?s)^(.*?) =(?:(\d+)=| )"


def parse_pai(texts: DataFrame, file: FileDef, ebcdic: bool = False, crlf: bool = False) -> DataFrame:
    """(_recnum, pair, fname, sval) of each occurrence in PAI texts (_recnum, text).

    One fold over a text's lines finds those that begin an occurrence: a line inside a value whose length
    was given is passed over.
    """
    text = from_ebcdic(F.col("text")) if ebcdic else F.col("text")
    text = F.replace(text, F.lit("\r\n"), F.lit("\n")) if crlf else text
    lines = F.split(F.col("_text"), "\n")

    def step(state: Column, line: Column) -> Column:
        at, until = state["at"], state["until"]
        name, size = F.regexp_extract(line, _HEAD, 1), F.regexp_extract(line, _HEAD, 2)
        begins = (at >= until) & (name != "")
        value = at + F.length(name) + 2 + F.when(size != "", F.length(size) + 1).otherwise(F.lit(1))
        n = F.when(size != "", size.try_cast("int")).otherwise(F.length(line) - (value - at))
        head = F.struct(name.alias("name"), value.alias("value"), n.alias("n"))
        return F.struct(
            (at + F.length(line) + 1).alias("at"), F.when(begins & (size != ""), value + n).otherwise(until).alias("until"),
            F.when(begins, F.concat(state["heads"], F.array(head))).otherwise(state["heads"]).alias("heads"),
        )

    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("until"), F.array().cast("array<struct<name:string,value:int,n:int>>").alias("heads"))
    heads = F.aggregate(lines, start, step, lambda s: s["heads"])
    spread = texts.select(RECNUM, text.alias("_text")).select(RECNUM, "_text", F.posexplode(heads).alias("pair", "_head"))
    return spread.select(RECNUM, "pair", F.col("_head.name").alias("fname"), F.substring("_text", F.col("_head.value"), F.col("_head.n")).alias("sval"))


def _values_of(pairs: Column, key: str, name: str, value: str, kind: T.DataType) -> Column:
    """The values of one field among (name, value) structs, converted to its storage."""
    own = F.filter(pairs, lambda p: p[key] == name)
    return F.transform(own, lambda p: stored(p[value], kind.elementType if isinstance(kind, T.ArrayType) else kind))


def load_pai(texts: DataFrame, file: FileDef, ebcdic: bool = False, crlf: bool = False) -> DataFrame:
    """Records (_recnum and the file's stored fields) from PAI texts: the occurrences of each field in order,
    converted to its storage."""
    pairs = parse_pai(texts, file, ebcdic, crlf)
    kinds = {n: file.frame.schema[n].dataType for n in chosen_fields(file)}
    own = pairs.groupBy(RECNUM).agg(F.sort_array(F.collect_list(F.struct("pair", "fname", "sval"))).alias("_pairs"))
    columns = []
    for n, kind in kinds.items():
        multi = isinstance(kind, T.ArrayType)
        values = _values_of(F.col("_pairs"), "fname", n, "sval", kind)
        columns.append((F.when(F.size(values) > 0, values) if multi else F.get(values, F.lit(0))).alias(n))
    rows = own.select(RECNUM, *columns)
    return texts.select(RECNUM).join(rows, RECNUM, "left")


# --- deferred updates ----------------------------------------------------------------------------


def deferred_updates(rows: DataFrame) -> DataFrame:
    """(field, value, _recnum) entries dealt by field and value and sorted within partitions: what an
    index build reads in sequence."""
    return rows.repartitionByRange("field", "value", RECNUM).sortWithinPartitions("field", "value", RECNUM)


def defer(rows: DataFrame, path: str, mode: str = "append") -> None:
    """First step of a multi-step update: the entries (field, value, _recnum) to a table, sorted."""
    deferred_updates(rows).write.mode(mode).parquet(path)


def apply_deferred(file: FileDef, entries: DataFrame) -> FileDef:
    """Adds deferred entries (field, value, _recnum) to a file, in one pass over it.

    Values of stored fields become occurrences of their records, in order of value (a single-valued field
    that has one keeps it); those of invisible fields become index entries.  Entries of records that
    aren't there, equal index entries and null values are dropped; an unknown field is an error.
    """
    stored_fields = set(chosen_fields(file))
    known = list(file.fields)
    field = F.when(F.col("field").isin(known), F.col("field")).otherwise(F.raise_error(F.concat(F.lit("no field "), F.col("field"))))
    rows = entries.select(field.alias("field"), F.col("value").cast("string").alias("value"), RECNUM).where("value IS NOT NULL")
    invisible = rows.where(~F.col("field").isin(list(stored_fields))).join(file.frame.select(RECNUM), RECNUM, "left_semi").select("field", "value", RECNUM)
    if file.entries is not None:
        invisible = file.entries.select("field", "value", RECNUM).unionByName(invisible)
    own = rows.where(F.col("field").isin(list(stored_fields))).groupBy(RECNUM).agg(F.sort_array(F.collect_list(F.struct("field", "value"))).alias("_new"))
    joined = file.frame.join(own, RECNUM, "left")
    columns = []
    for n in file.frame.columns:
        c = F.col(f"`{n}`")
        if n not in stored_fields:
            columns.append(c)
            continue
        kind = file.frame.schema[n].dataType
        multi = isinstance(kind, T.ArrayType)
        new = _values_of(F.coalesce("_new", F.array().cast("array<struct<field:string,value:string>>")), "field", n, "value", kind)
        columns.append((F.when(F.size(new) > 0, F.concat(F.coalesce(c, F.array().cast(kind)), new)).otherwise(c) if multi else F.coalesce(c, F.get(new, F.lit(0)))).alias(n))
    has_invisible = any(f.storage == "INVISIBLE" for f in file.fields.values())
    return replace(file, frame=joined.select(*columns), entries=invisible.distinct() if has_invisible else file.entries)


def deferred_index(file: FileDef, name: str) -> DataFrame:
    """Single-step index build: the lists of a field, from entries sorted and merged by the shuffle."""
    return unload_index(file, name)


def reorganize(file: FileDef, order: list[str] | None = None) -> FileDef:
    """The file rewritten in record order, or renumbered by the given columns."""
    if order is None:
        return file.with_frame(file.frame.repartitionByRange(RECNUM).sortWithinPartitions(RECNUM))
    return file.with_frame(renumbered(file.frame, order).drop("_old_recnum").select(*file.frame.columns))


# --- audit ---------------------------------------------------------------------------------------


def audit_append(lines: DataFrame, path: str) -> None:
    """Appends lines (ts, line) to a log; a missing time is now."""
    stamped = lines.select(F.coalesce(F.col("ts").cast("timestamp"), F.current_timestamp()).alias("ts"), F.col("line").cast("string").alias("line"))
    stamped.write.mode("append").parquet(path)


def audit_extract(log: DataFrame, after=None, before=None, pattern: str | None = None, any_case: bool = False, most: int | None = 1000) -> DataFrame:
    """Lines (ts, line) strictly between two times in which the pattern occurs, oldest first."""
    from ..functions.pattern import NOCASE, like

    if after is not None:
        log = log.where(F.col("ts") > F.lit(after).cast("timestamp"))
    if before is not None:
        log = log.where(F.col("ts") < F.lit(before).cast("timestamp"))
    if pattern is not None:
        log = log.where(like(F.col("line"), f"{NOCASE if any_case else ''}*{pattern}*"))
    return log if most is None else log.orderBy("ts", "line").limit(most)
