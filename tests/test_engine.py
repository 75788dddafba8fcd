"""Small hand-made records: the traps of negation, repetition, sorting and updating."""

import pytest
from pyspark.sql import functions as F

from sievebase.functions import values as V
from sievebase.operators import updates
from sievebase.operators.context import Context, Engine
from sievebase.operators.parser import ParseError, parse_find
from sievebase.operators.predicate import NONE, PredicateError, in_set, point, single_record, where
from sievebase.operators.sets import SetError, SortKey
from sievebase.plans import admin
from sievebase.plans.catalog import CatalogError, Field, FileDef

ROWS = [(0, [1.0, 10.0], ["ABC"]), (1, None, ["abc", "XYZ"]), (2, [3.0], None), (3, [], [""])]


@pytest.fixture(scope="module")
def t(spark):
    frame = spark.createDataFrame(ROWS, "_recnum long, A array<double>, S array<string>")
    return Context("T", (FileDef("T", frame, {"A": Field("A", "FLOAT", "NONE", True), "S": Field("S", "STRING", "CHAR", True)}),))


def ids(found):
    return sorted(r["_recnum"] for r in found.frame.select("_recnum").collect())


@pytest.mark.parametrize(
    "criteria, expected",
    [
        (where("A", "GT", 2) & where("A", "LT", 5), [0, 2]),
        (where("A", "RANGE", 2, 5), [2]),
        (~where("A", "EQ", 3), [0, 1, 3]),
        (~(where("A", "EQ", 3) | where("S", "LIKE", "X*")), [0, 3]),
        (where("S", "UNLIKE", "A*"), [1, 3]),
        (where("S", "NOT_LIKE", "A*"), [1, 2, 3]),
        (where("S", "LIKE", "NOCASE:A*"), [0, 1]),
        (where("S", "LIKE", "(A,X)*"), [0, 1]),
        (where("S", "LIKE", ""), [3]),
        (where("S", "PRESENT"), [0, 1, 3]),
        (where("S", "NOT_PRESENT"), [2]),
        (where("S", "N_EQ", 0), [0, 1, 3]),
        (point(2), [2, 3]),
        (~point(2), [0, 1]),
        (point(-4), [0, 1, 2, 3]),
        (single_record(9), []),
        (single_record(-1), []),
        (NONE, []),
        ("A > 2 AND A < 5", [0, 2]),
        ("A IN RANGE FROM 2 TO 5 OR S = 'XYZ'", [1, 2]),
        ("NOT (A = 3 OR S IS LIKE X*)", [0, 3]),
        ("S = ABC OR XYZ", [0, 1]),
        ("S IS NOT PRESENT", [2]),
        ("", [0, 1, 2, 3]),
    ],
)
def test_finds(t, criteria, expected):
    assert ids(t.find(criteria)) == expected


def test_sets(t):
    a, b = t.find("A PRESENT"), t.find("S PRESENT")
    assert ids(a.place(b)) == [0, 1, 2, 3] and ids(a.intersect(b)) == [0] and ids(b.remove(a)) == [1, 3]
    assert ids(a.place(a)) == [0, 2] and ids(a.remove(a)) == []
    assert ids(t.find(where("A", "GT", 2) | in_set(b))) == [0, 1, 2, 3] and ids(t.find(~in_set(b))) == [2]
    assert ids(a.place_record(3).remove_record(0)) == [2, 3]
    assert [r["n"] for r in t.find().count_occurrences("A").orderBy("_recnum").collect()] == [2, 0, 1, 0]
    with pytest.raises(SetError):
        Context("OTHER", t.members, key="x").find(in_set(a))


@pytest.mark.parametrize(
    "keys, kw, expected",
    [
        ([SortKey("A")], {}, [1, 3, 0, 2]),
        ([SortKey("A", descending=True)], {}, [1, 3, 2, 0]),
        ([SortKey("A", each=True)], {}, [0, 2, 0]),
        ([SortKey("A")], {"limit": 2}, [1, 0]),
        ([SortKey("S", type="NUMERIC")], {}, [0, 1, 2, 3]),
    ],
)
def test_sorts(t, keys, kw, expected):
    made = t.find().sort(*keys, **kw)
    assert [r["_recnum"] for r in made.frame.collect()] == expected
    assert [r["_recnum"] for r in made.ranked().orderBy("rn").collect()] == expected


def test_sort_rotates_each_occurrence_to_the_front(t):
    assert [r["A"] for r in t.find().sort(SortKey("A", each=True)).frame.collect()] == [[1, 10], [3], [10, 1]]


def test_sort_errors(t):
    for keys in ([], [SortKey("A"), SortKey("A")], [SortKey("A", type="ODD")]):
        with pytest.raises(SetError):
            t.find().sort(*keys)


def test_values(t, spark):
    assert [r["value"] for r in t.find_values("S").frame.collect()] == ["", "ABC", "XYZ", "abc"]
    with pytest.raises(PredicateError):
        t.find_values("A", "LIKE", "1*")
    with pytest.raises(PredicateError):
        t.find_values("A", "EQ", 1)
    three = spark.createDataFrame([("b",), ("10",), ("9",)], "value string")
    from sievebase.operators.sets import ValueSet

    made = ValueSet(three, (F.col("value").asc(),))
    assert [r["value"] for r in made.sort("NUMERIC").frame.collect()] == [0, 9, 10]
    assert [r["value"] for r in made.sort("RIGHT_ADJUSTED").frame.collect()] == ["9", "b", "10"]
    assert [r["value"] for r in made.at(1).collect()] == ["9"]
    cursor = t.value_cursor("S")
    assert [r["value"] for r in cursor.set_position("B").collect()] == ["XYZ"]
    assert [r["value"] for r in cursor.set_position("B", "prev").collect()] == ["ABC"]
    assert cursor.set_position("B", "invalidate").collect() == []
    assert [r["value"] for r in cursor.advance("ABC", 2).collect()] == ["abc"]
    assert [r["value"] for r in cursor.advance("ABC", -1).collect()] == [""]
    assert cursor.advance("ABC", 9).collect() == []
    assert cursor.set_position("B", "remain").collect() == []
    assert [r["value"] for r in cursor.set_position("B", "remain", "abc").collect()] == ["abc"]
    assert [r["value"] for r in cursor.set_position("XYZ", "remain", "abc").collect()] == ["XYZ"]
    with pytest.raises(SetError):
        cursor.set_position("B", "nearest")


def test_cursor_positions(t):
    from sievebase.operators.sets import CursorPosition

    here = CursorPosition(t.value_cursor("S"))
    assert not here.accessible and not here.advance() and here.goto_first() and here.value == ""
    assert here.advance(2) and here.value == "XYZ" and here.goto_last() and here.value == "abc"
    other = here.clone()
    assert here.set_position("B", "next") and (here.value, other.value) == ("XYZ", "abc")
    assert other.set_position("B", "remain") and other.value == "abc"
    here.swap(other)
    assert (here.value, other.value) == ("abc", "XYZ")
    here.adopt(other)
    assert here.value == "XYZ" and here.advance() and not here.advance() and not here.accessible and not other.set_position("B")
    with pytest.raises(SetError):
        here.adopt(CursorPosition(t.value_cursor("S")))


def a_of(file, n):
    return file.frame.where(f"_recnum = {n}").first()["A"]


def test_updates(t):
    f = t.members[0]
    assert a_of(updates.insert_field(f, "A", 7, 5), 2) == [3, 7]
    assert a_of(updates.insert_field(f, "A", 7, 0), 0) == [7, 1, 10]
    assert a_of(updates.insert_field(f, "A", 7, -1), 0) == [1, 10]
    assert a_of(updates.change_field(f, "A", 8, 4), 2) == [3, 8]
    assert a_of(updates.change_field(f, "A", 8, 1), 0) == [8, 10]
    assert a_of(updates.delete_value(f, "A", 10), 0) == [1]
    assert a_of(updates.delete_field(f, "A", 1), 2) is None
    assert a_of(updates.add_field(f, "A", "x"), 1) == [0]
    assert a_of(updates.add_field(f, "A", 5, t.find("A = 3")), 0) == [1, 10]
    at_end = FileDef("T", f.frame, {**f.fields, "A": Field("A", "FLOAT", "NONE", True, at_end=True)})
    assert a_of(updates.change_field(at_end, "A", 8, 1), 0) == [10, 8]
    assert {r["_recnum"]: r["occ"] for r in updates.occurrence_report(f, "A", value=10).collect()} == {0: 2, 1: -1, 2: -1, 3: -1}
    with pytest.raises(Exception, match="not a number"):
        updates.add_field(f, "A", "x", strict=True).frame.collect()
    stored = updates.store_record(f, [("A", 4), ("S", "q"), ("A", 5)]).frame.where("_recnum = 4").first()
    assert (stored["A"], stored["S"]) == ([4, 5], ["q"])
    assert ids(Context("T", (updates.delete_records(f, t.find("A PRESENT")),)).find()) == [1, 3]


def test_invisible_fields_are_entries_only(t):
    c = t.with_file(t.members[0].define(Field("M", "INVISIBLE", "CHAR")))
    c = c.file_records_under(c.find("A PRESENT"), "M", "x")
    assert ids(c.find_filed("M", "x")) == [0, 2] and ids(c.find_filed("M", "y")) == []
    with pytest.raises(PredicateError):
        c.find("M = x")
    # entries follow their field
    named = c.with_file(c.members[0].rename("M", "N"))
    assert ids(named.find_filed("N", "x")) == [0, 2] and ids(named.find_filed("M", "x")) == []
    assert c.members[0].delete("M").entries.count() == 0
    # the entry of a deleted record stays behind, unless asked otherwise
    gone = updates.delete_records(c.members[0], c.find("A = 3"))
    assert gone.entries.count() == 2 and ids(c.with_file(gone).find_filed("M", "x")) == [0]


def test_catalog_rules(spark):
    for bad in ("lower", "AND", "A#", "A  B", ""):
        with pytest.raises(CatalogError):
            Field(bad)
    for kw in ({"storage": "BLOB", "index": "CHAR"}, {"storage": "INVISIBLE"}):
        with pytest.raises(CatalogError):
            Field("A", **kw)
    engine = Engine(spark)
    engine.create("ONE", [Field("A", "FLOAT", "NUM")])
    engine.create("TWO", [Field("A", "STRING", "CHAR")])
    for bad in ("FILE", "SYSX", "toolongname", "one"):
        with pytest.raises(CatalogError):
            engine.create(bad, [])
    engine.create_group("G", ["ONE", "TWO"])
    with pytest.raises(CatalogError):
        engine.open("GROUP G")
    with pytest.raises(CatalogError):
        engine.open("FILE G")
    assert engine.open("ONE").find().frame.count() == 0 and engine.list_open() == ["ONE"]
    with pytest.raises(CatalogError):
        engine.free("ONE")
    engine.close()
    engine.free("ONE")
    with pytest.raises(CatalogError):
        engine.files["TWO"].redefine(Field("A", "FLOAT", "NUM"))
    assert engine.list_groups().count() == 1


def test_mbscan_guards_unindexed_finds(t):
    from dataclasses import replace

    with pytest.raises(PredicateError):
        replace(t, mbscan=0).find("A = 3")
    assert ids(replace(t, mbscan=0).find("S = ABC")) == [0]
    assert ids(replace(t, mbscan=10).find("A = 3")) == [2]


@pytest.mark.parametrize("bad", ["A =", "(A = 1", "A = 1)", "= 3", "X", "A IN RANGE 1", "A IS"])
def test_bad_texts(bad):
    with pytest.raises(ParseError):
        parse_find(bad)


def test_bad_operators():
    for args in (("A", "ODD", 1), ("A", "EQ"), ("A", "RANGE", 1), ("A", "PRESENT", 1)):
        with pytest.raises(PredicateError):
            where(*args)


def test_admin(t, spark, tmp_path):
    report = admin.find_report(t, "A = 3 AND NOT S PRESENT")
    assert report["tree"].splitlines()[0] == "AND" and "Physical Plan" in report["plan"]
    assert set(report) == {"spec", "tree", "restructured", "plan"} and "exists" in report["restructured"]
    assert admin.find_report(t, "A = 3 AND NOT S PRESENT", run=True)["counts"].splitlines() == ["A EQ 3: 1", "S PRESENT: 3", "found: 1"]
    stats = admin.Statistics()
    watched = stats.watched(t.find("A PRESENT").frame)
    watched.collect()
    assert stats.collect()["RECDS"] == 2
    versions = admin.Versions(spark, str(tmp_path / "v"))
    f = t.members[0]
    assert versions.checkpoint(f) == 1
    assert versions.checkpoint(updates.delete_each(f, "A")) == 2
    assert a_of(versions.rollback(f, 1), 0) == [1, 10]
    assert versions.checkpoint(updates.change_field(f, "A", 8, 1)) == 3
    # a new session finds the versions in the folder, with the entries of invisible fields
    again = admin.Versions(spark, str(tmp_path / "v"))
    assert again.numbers() == [1, 2, 3] and a_of(again.rollback(f), 0) == [8, 10] and a_of(again.rollback(f, 2), 0) is None
    marked = Context("T", (f.define(Field("M", "INVISIBLE", "CHAR")),))
    marked = marked.file_records_under(marked.find("A PRESENT"), "M", "x")
    back = again.rollback(marked.members[0], again.checkpoint(marked.members[0]))
    assert back.entries.count() == 2
    with pytest.raises(ValueError):
        again.rollback(f, 9)
    p = admin.Parameters()
    assert p.reset("MBSCAN", "5") == 5 and p.frame(spark).count() == len(p.values)


def test_parameters_and_counters_act(spark):
    engine = Engine(spark)
    engine.create("ONE", [Field("A", "FLOAT", "NONE")])
    engine.create("TWO", [Field("A", "FLOAT", "NONE"), Field("B")])
    engine.create_group("G", ["ONE", "TWO"], "TWO")
    engine.create_group("H", ["ONE", "TWO"])
    group = engine.open("GROUP G").store_record([("A", "x"), ("B", "q")]).store_record([("A", 4)])
    assert [(m.name, m.frame.count()) for m in group.members] == [("ONE", 0), ("TWO", 2)]
    assert [r["A"] for r in group.find().ordered().collect()] == [0, 4]
    with pytest.raises(CatalogError):
        engine.open("GROUP H").store_record([("A", 1)])
    assert [tuple(r) for r in engine.display_group("G").select("kind", "member", "takes_updates", "n_fields").collect()] == [("TEMP", "ONE", False, 1), ("TEMP", "TWO", True, 2)]
    engine.close()
    engine.parameters.reset("STRICTNUM", 1)
    engine.parameters.reset("MBSCAN", 0)
    strict = engine.open("TWO")
    with pytest.raises(Exception, match="not a number"):
        strict.store_record([("A", "x")]).frame.collect()
    with pytest.raises(PredicateError):
        strict.find("A = 3")
    list(group.find().cursor())
    group.find().sort("A")
    counters = engine.statistics.collect()
    assert counters["RECADD"] == 3 and counters["RECDS"] == 2 and counters["SORTS"] == 1 and counters["FINDS"] >= 3
    assert {r["name"]: r["n"] for r in engine.statistics.frame(spark).collect()} == counters


def test_dispositions(spark):
    engine = Engine(spark)
    one = engine.create("ONE", [Field("A", "FLOAT", "NUM")])
    for bad, file in (("NEW", one), ("TEMP", one), ("OLD", FileDef("TWO", one.frame, one.fields)), ("READONLY", FileDef("TWO", one.frame, one.fields)), ("ODD", one)):
        with pytest.raises(CatalogError):
            engine.allocate(file, bad)
    engine.allocate(one, "READONLY")
    with pytest.raises(CatalogError):
        engine.open("ONE").store_record([("A", 1)])
    engine.allocate(FileDef("TWO", one.frame, one.fields), "TEMP")
    engine.open("TWO")
    engine.close()
    assert sorted(engine.files) == ["ONE"]


def test_words(spark):
    c = F.col("s")
    frame = spark.createDataFrame([("  one two,three ",), ("",), ("a(b(c)d)e",), ("12-3",), (None,)], "s string")
    got = [tuple(r) for r in frame.select(V.word(c, 2), V.word(c, 2, " ,"), V.word_count(c, " ,"), V.word_position(c, 2), V.word_position(c, 3, ", "), V.bracketed(c), V.is_integer(c), V.is_digits(c), V.is_alpha(c), V.one_of(c, "12-3/x"), V.reverse(c)).collect()]
    assert got[0] == ("two,three", "two", 3, 7, 11, "", False, False, False, False, " eerht,owt eno  ")
    assert got[1] == ("", "", 0, 0, 0, "", True, True, True, False, "")
    assert got[2][5] == "b(c" and got[3][6:10] == (True, False, False, True) and got[4] == (None,) * 11
    text = spark.createDataFrame([("héy",)], "s string").select(V.hex_to_string(V.string_to_hex(c)), V.replace_char(c, "h", "k"), V.replace_string(c, "éy", "ou"), V.replace_string(c, "", "x"), V.thousands_text(F.lit("1234567")), V.hex_to_string(F.lit("zz"))).first()
    assert tuple(text) == ("héy", "kéy", "hou", "héy", "1,234,567", None)


@pytest.mark.parametrize("text", ["- 5", "1_000", "nan", "inf", "1234567890123456", "1e400", "7\n", " + 7 ", "", " ", "1D2", ".5", "5.", "0x1", "1e-90", "0.1e1", "٣", "-", "1 2"])
def test_constants_and_values_are_read_alike(spark, text):
    assert spark.range(1).select(V.to_num(F.lit(text)).alias("n")).first()["n"] == V.number_of(text)


def test_numbers(spark):
    cases = [(0.1 + 0.2, "0.3"), (1e15, "1E+15"), (123456789012345.0, "123456789012345"), (0.0001, "0.0001"), (0.00001, "1E-05"), (-2.5, "-2.5"), (0.0, "0"), (1e80, "0"), (66942.327142857146, "66942.3271428571"), (1234567.5, "1234567.5"), (12345678.25, "12345678.25"), (-0.0, "0"), (100.0, "100"), (123456789012345680.0, "1.23456789012346E+17"), (0.001, "0.001"), (float("nan"), "0"), (None, None)]
    frame = spark.createDataFrame([(x,) for x, _ in cases], "x double")
    got = [r["s"] for r in frame.select(V.num_to_str(F.col("x")).alias("s")).collect()]
    assert got == [s for _, s in cases]
    texts = ["7", " 7 ", "- 5", "1E2", "1D2", "abc", "", "0x1F", "NaN", "1234567890123456", "1e400", ".5", "5."]
    frame = spark.createDataFrame([(x,) for x in texts], "s string")
    got = [r["n"] for r in frame.select(V.to_num(F.col("s")).alias("n")).collect()]
    assert got == [7, 7, -5, 100, None, None, 0, None, None, None, None, 0.5, 5]
    frame = spark.createDataFrame([(2.567,), (-0.001,), (-3.999,)], "x double")
    assert [r["s"] for r in frame.select(V.fixed_dp(F.col("x"), 2).alias("s")).collect()] == ["2.56", "0.00", "-3.99"]


def test_round15_agrees_with_c(spark):
    import random

    r = random.Random(7)
    xs = [r.uniform(-1, 1) * 10 ** r.randint(-6, 12) for _ in range(3000)] + [k / 7 for k in range(1, 2000)]
    frame = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [row["y"] for row in frame.select(V.r15(F.col("x")).alias("y")).collect()] == [float(f"{x:.14e}") for x in xs]


def test_strings(spark):
    row = spark.createDataFrame([("abcdef", "a  b ")], "s string, u string").select(
        V.pad_left(F.col("s"), 4).alias("l"), V.pad_or_elide(F.col("s"), 5).alias("e"), V.unblank(F.col("u")).alias("u"), V.from_ebcdic(V.to_ebcdic(F.col("s"))).alias("x"),
        V.hex_to_int(V.int_to_hex(F.lit(255))).alias("h"), V.round_places(F.lit(-2.345), 2, "up").alias("p"),
    ).first()
    assert tuple(row) == ("cdef", "ab...", "a b", "abcdef", 255, -2.35)
    assert V.next_string("ab") == "ac" and V.next_string("\U0010ffff") is None
