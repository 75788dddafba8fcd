import pytest
from pyspark.sql import functions as F

from sievebase.operators.context import Context
from sievebase.plans.catalog import Field, FileDef
from sievebase.sources import files
from sievebase.streaming import finds


@pytest.fixture(scope="module")
def t(spark):
    frame = spark.createDataFrame([(0, "x", [1.0, 2.5]), (1, None, None), (2, "y", [7.0])], "_recnum long, S string, A array<double>")
    return FileDef("T", frame, {"S": Field("S", "STRING", "CHAR"), "A": Field("A", "FLOAT", "NUM", True)})


def test_unload_and_load(t, spark, tmp_path):
    files.unload(t, str(tmp_path / "u"))
    back = files.load(spark, "T", str(tmp_path / "u"))
    assert back.fields == t.fields
    assert sorted(map(str, back.frame.collect())) == sorted(map(str, t.frame.collect()))


def test_pai_text(t):
    texts = {r["_recnum"]: r["text"] for r in files.unload_pai(t).collect()}
    assert texts == {0: "0\nS = x\nA = 1\nA = 2.5\n$$$", 1: "1\n$$$", 2: "2\nS = y\nA = 7\n$$$"}
    assert files.unload_pai(t, crlf=True).where("_recnum = 2").first()["text"] == "2\r\nS = y\r\nA = 7\r\n$$$"


NASTY = ["a\nb = c", "$$$", "x\n$$$\ny", "", " = ", "S =3=abc", "\n", "A = 1\n\nS =2=", "tab\tand é 😀\nend", "=", "plain"]


@pytest.mark.parametrize("storage", ["STRING", "BLOB"])
def test_pai_gives_back_any_value(spark, storage):
    rows = [(i, [v, NASTY[-1 - i]], float(i) / 3) for i, v in enumerate(NASTY)] + [(99, None, None)]
    frame = spark.createDataFrame(rows, "_recnum long, S array<string>, N double")
    f = FileDef("T", frame, {"S": Field("S", storage, multi=True), "N": Field("N", "FLOAT")})
    for kw in ({}, {"ebcdic": True}):
        texts = files.unload_pai(f, **kw)
        got = {(r["_recnum"], r["pair"]): (r["fname"], r["sval"]) for r in files.parse_pai(texts, f, **kw).collect()}
        if kw:  # a code page has no sign for some characters
            assert len(got) == 3 * len(NASTY)
            continue
        assert all(got[i, k] == ("S", v) for i, own, _ in rows if own for k, v in enumerate(own)) and len(got) == 3 * len(NASTY)
        back = {r["_recnum"]: (r["S"], r["N"]) for r in files.load_pai(texts, f).collect()}
        assert back.keys() == {r[0] for r in rows} and back[99] == (None, None)
        assert all(back[i][0] == own and back[i][1] == pytest.approx(n) for i, own, n in rows[:-1])


def test_entries_come_along(spark, t, tmp_path):
    c = Context("T", (t.define(Field("M", "INVISIBLE", "CHAR")),))
    c = c.file_records_under(c.find("S PRESENT"), "M", "x")
    files.unload(c.members[0], str(tmp_path / "e"))
    back = files.load(spark, "T", str(tmp_path / "e"))
    found = Context("T", (back,)).find_filed("M", "x")
    assert sorted(r["_recnum"] for r in found.frame.collect()) == [0, 2]
    assert files.load(spark, "T", str(tmp_path / "e"), preview=2).frame.count() == 2
    loaded, reference = files.fast_load(c.members[0], back.frame, ["_old_recnum"], back.entries)
    assert sorted(r["_recnum"] for r in Context("T", (loaded,)).find_filed("M", "x").frame.collect()) == [0, 2, 3, 5]
    same, reference = files.fast_load(c.members[0], back.frame, ["_old_recnum"], action=False)
    assert same is c.members[0] and reference.count() == 3
    with pytest.raises(ValueError):
        files.fast_load(t, back.frame.withColumn("ODD", F.lit(1)), ["_old_recnum"])


def test_deferred_updates_are_applied(spark, t, tmp_path):
    f = t.define(Field("M", "INVISIBLE", "CHAR"))
    rows = spark.createDataFrame([("A", "9", 0), ("A", "8", 0), ("A", "3", 1), ("S", "new", 1), ("S", "no", 0), ("M", "k", 2), ("M", "k", 2), ("M", "k", 77), ("A", None, 2), ("A", "1", 55)], "field string, value string, _recnum long")
    files.defer(rows, str(tmp_path / "d"))
    done = files.apply_deferred(f, spark.read.parquet(str(tmp_path / "d")))
    assert {r["_recnum"]: (r["S"], r["A"]) for r in done.frame.collect()} == {0: ("x", [1, 2.5, 8, 9]), 1: ("new", [3]), 2: ("y", [7])}
    assert [tuple(r) for r in done.entries.collect()] == [("M", "k", 2)]
    with pytest.raises(Exception, match="no field"):
        files.apply_deferred(f, spark.createDataFrame([("ODD", "1", 0)], "field string, value string, _recnum long")).frame.collect()


def test_data_reformatted(t):
    assert files.unload_data(t, no_float=True).orderBy("_recnum").first()["A"] == ["1", "2.5"]
    assert files.unload_data(t, ebcdic=True).orderBy("_recnum").first()["S"] == "\xa7"


def test_audit_lines_are_appended(spark, tmp_path):
    line = spark.createDataFrame([("2024-01-01 00:00:00", "one")], "ts string, line string")
    files.audit_append(line, str(tmp_path / "log"))
    files.audit_append(spark.createDataFrame([(None, "two")], "ts string, line string"), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert [r["line"] for r in files.audit_extract(log).collect()] == ["one", "two"] and log.where("ts IS NULL").isEmpty()


def test_index_unload_and_reload(t, spark):
    entries = files.unload_index(t, "A")
    assert {r["value"]: r["records"] for r in entries.collect()} == {1.0: [0], 2.5: [0], 7.0: [2]}
    loaded, reference = files.fast_load(t, t.frame, ["_old_recnum"])
    assert loaded.frame.count() == 6 and {r["_old_recnum"]: r["_recnum"] for r in reference.collect()} == {0: 3, 1: 4, 2: 5}
    assert {r["value"]: r["records"] for r in files.load_index(entries, reference).collect()} == {1.0: [3], 2.5: [3], 7.0: [5]}


def test_sequential_files(spark, tmp_path):
    lines = spark.createDataFrame([("abc",), ("defgh",)], "line string")
    files.write_lines(lines.coalesce(1), str(tmp_path / "f"), lrecl=6, pad=".")
    assert sorted(r["line"] for r in files.read_lines(spark, str(tmp_path / "f")).collect()) == ["abc...", "defgh."]
    fixed = files.read_fixed(spark, str(tmp_path / "f"), [("A", 1, 2), ("B", 3, 4)])
    assert sorted(tuple(r) for r in fixed.collect()) == [("ab", "c..."), ("de", "fgh.")]
    (tmp_path / "g").write_text("ab1cd2ef3")
    assert [tuple(r) for r in files.read_fixed(spark, str(tmp_path / "g"), [("A", 1, 2), ("N", 3, 1)], lrecl=3).collect()] == [("ab", "1"), ("cd", "2"), ("ef", "3")]
    (tmp_path / "h0").write_text("ab1cd")
    with pytest.raises(Exception, match="(?i)partial|record"):
        files.read_fixed(spark, str(tmp_path / "h0"), [("A", 1, 2)], lrecl=3).collect()
    with pytest.raises(Exception, match="longer"):
        files.write_lines(lines, str(tmp_path / "h"), lrecl=4)


def test_deferred_updates_are_sorted_by_value(spark):
    rows = spark.createDataFrame([("F", "b", 2), ("F", "a", 9), ("F", "a", 1)], "field string, value string, _recnum long")
    assert [tuple(r) for r in files.deferred_updates(rows.coalesce(1)).orderBy("field", "value", "_recnum").collect()] == [("F", "a", 1), ("F", "a", 9), ("F", "b", 2)]


def test_streamed_find_equals_the_batch_find(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    batch = Context("EVENTS", (FileDef.over("EVENTS", events, "event_id"),)).find("EVENT_TYPE = click AND VALUE GT 10")
    found = finds.stream_find(FileDef.over("EVENTS", stream, "event_id"), "EVENT_TYPE = click AND VALUE GT 10")
    query = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("found").count() == batch.frame.count()
    counts = finds.value_counts(found, "EVENT_TYPE", "TS", "1 hour", "10 minutes")
    assert counts.isStreaming and counts.columns == ["start", "value", "n"]


def test_audit(spark):
    log = spark.createDataFrame([("2024-01-01 00:00:00", "Start"), ("2024-01-02 00:00:00", "error one"), ("2024-01-03 00:00:00", "ERROR two")], "ts string, line string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r["line"] for r in files.audit_extract(log, "2024-01-01 00:00:00", None, "error", any_case=True).collect()] == ["error one", "ERROR two"]
    assert [r["line"] for r in files.audit_extract(log, None, "2024-01-03 00:00:00", "error").collect()] == ["error one"]
