"""Registered queries of the record engine, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.pattern import from_other_dialect, like
from ..operators import joins, updates
from ..operators.predicate import ALL, NONE, file_is, in_set, point, single_record, where
from ..operators.ranking import numbered
from ..operators.sets import RecordSet, SortKey
from ..sources import files
from . import admin, checkpoints
from .catalog import FILE_IX, RECNUM, Field
from .fixtures import (
    CUSTOMER_SPARSE_SQL,
    NUMERIC_TEXT_SQL,
    ORDERS_MV_SQL,
    PARTIES_SQL,
    context,
    customer_sparse,
    file,
    numeric_text,
    orders_mv,
    parties,
    read,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def shown(found: RecordSet | DataFrame, *names: str) -> DataFrame:
    """Record number as ``id`` and the named fields in lower case."""
    frame = found.frame if isinstance(found, RecordSet) else found
    return frame.select(F.col(RECNUM).alias("id"), *(F.col(n).alias(n.lower()) for n in names))


def finder(name: str, table: str, names: str, criteria, condition: str) -> None:
    """A find over one table: ``condition`` is its SQL."""
    from .fixtures import KEYS

    columns = names.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(context(spark, sf_dir, table).find(criteria), *columns)

    sql = f"SELECT CAST({KEYS[table]} AS BIGINT) AS id, {', '.join(c.lower() for c in columns)} FROM {table} WHERE {condition}"
    register(name, sql)(run)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders above a price, dearest first."""
    found = context(spark, sf_dir, "orders").find("O_ORDERSTATUS = F AND O_TOTALPRICE GT 100000")
    return shown(found.sort(SortKey("O_TOTALPRICE", descending=True)).top(10), "O_ORDERSTATUS", "O_TOTALPRICE", "O_ORDERPRIORITY")


register("flagship", "SELECT o_orderkey AS id, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")(flagship)

# --- finds ---------------------------------------------------------------------------------------

O, P = "O_ORDERSTATUS O_TOTALPRICE", "P_NAME P_SIZE"
finder("find_all", "region", "R_NAME", None, "true")
finder("find_eq", "orders", O, where("O_ORDERSTATUS", "EQ", "F"), "o_orderstatus = 'F'")
finder("find_not_eq", "orders", O, where("O_ORDERSTATUS", "NOT_EQ", "F"), "o_orderstatus <> 'F'")
finder("find_gt", "orders", O, where("O_TOTALPRICE", "GT", 250000), "o_totalprice > 250000")
finder("find_lt", "orders", O, where("O_TOTALPRICE", "LT", 50000), "o_totalprice < 50000")
finder("find_ge", "part", P, where("P_SIZE", "GE", 40), "p_size >= 40")
finder("find_le", "part", P, where("P_SIZE", "LE", 7), "p_size <= 7")
finder("find_range", "part", P, where("P_SIZE", "RANGE", 10, 20), "p_size BETWEEN 10 AND 20")
finder("find_range_gt_le", "part", P, where("P_SIZE", "RANGE_GT_LE", 10, 20), "p_size > 10 AND p_size <= 20")
finder("find_range_ge_lt", "part", P, where("P_SIZE", "RANGE_GE_LT", 10, 20), "p_size >= 10 AND p_size < 20")
finder("find_range_gt_lt", "part", P, where("P_SIZE", "RANGE_GT_LT", 10, 20), "p_size > 10 AND p_size < 20")
finder("find_range_inverted", "part", P, where("P_SIZE", "RANGE", 20, 10), "false")
finder("find_not_range", "part", P, where("P_SIZE", "NOT_RANGE", 10, 20), "NOT (p_size BETWEEN 10 AND 20)")
finder("find_time_range", "events", "EVENT_TYPE VALUE", where("TS", "RANGE_GE_LT", "2024-01-01 00:00:00", "2024-01-15 12:00:00"), "ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts < TIMESTAMP '2024-01-15 12:00:00'")
finder("find_like_prefix", "part", P, where("P_NAME", "LIKE", "re*"), "starts_with(p_name, 're')")
finder("find_like_suffix", "part", P, where("P_NAME", "LIKE", "*e"), "ends_with(p_name, 'e')")
finder("find_like_contains", "part", P, where("P_NAME", "LIKE", "*ed*"), "contains(p_name, 'ed')")
finder("find_like_placeholder", "orders", "O_ORDERPRIORITY", where("O_ORDERPRIORITY", "LIKE", "#!-@@@+*"), "regexp_full_match(o_orderpriority, '[0-9]-[A-Za-z]{3}..*')")
finder("find_like_alternation", "orders", "O_ORDERPRIORITY", where("O_ORDERPRIORITY", "LIKE", "(1,5)*(T,W)*"), "regexp_full_match(o_orderpriority, '(1|5).*(T|W).*')")
finder("find_like_top_level", "part", "P_NAME P_TYPE", where("P_TYPE", "LIKE", "S*,P*"), "regexp_full_match(p_type, 'S.*|P.*')")
finder("find_like_repeat", "customer", "C_NAME", where("C_NAME", "LIKE", "*#/2-3(0,7)*"), "regexp_full_match(c_name, '.*[0-9](0|7){2,3}.*')")
finder("find_like_char_range", "orders", "O_ORDERPRIORITY", where("O_ORDERPRIORITY", "LIKE", "(2-4)!-*"), "regexp_full_match(o_orderpriority, '[2-4]-.*')")
finder("find_like_escape", "customer", "C_NAME", where("C_NAME", "LIKE", "Customer!#*1"), "regexp_full_match(c_name, 'Customer#.*1')")
finder("find_like_hex", "orders", "O_ORDERPRIORITY", where("O_ORDERPRIORITY", "LIKE", "=31=2D*"), "regexp_full_match(o_orderpriority, '1-.*')")
finder("find_like_nocase", "part", P, where("P_NAME", "LIKE", "NOCASE:*RE*"), "contains(upper(p_name), 'RE')")
finder("find_unlike", "part", P, where("P_NAME", "UNLIKE", "*e*"), "NOT contains(p_name, 'e')")
finder("find_not_like", "part", P, where("P_NAME", "NOT_LIKE", "*e*"), "NOT contains(p_name, 'e')")
finder("find_like_nested", "customer", "C_NAME", where("C_NAME", "LIKE", "/2-9(*0,*7)1"), "regexp_full_match(c_name, '(.*(0|7)){2,9}1')")
finder("find_like_three_runs", "documents", "LANG", where("TEXT", "LIKE", "*and*the*of*"), "regexp_full_match(text, '.*and.*the.*of.*', 's')")
finder("find_like_empty_member", "part", "P_NAME", where("P_NAME", "LIKE", "(,red)*(blue,)"), "regexp_full_match(p_name, '(|red).*(blue|)')")
finder("find_like_other_dialect", "orders", "O_ORDERPRIORITY", where("O_ORDERPRIORITY", "LIKE", from_other_dialect('?"-*')), "regexp_full_match(o_orderpriority, '.-.*')")
finder("find_spliced", "part", P, where("P_SIZE", "GT", 40).splice(where("P_NAME", "LIKE", "a*")).splice(where("P_SIZE", "EQ", 1), "OR"), "p_size > 40 AND starts_with(p_name, 'a') OR p_size = 1")
finder("find_like_pages", "pages", "URL", where("URL", "LIKE", "https:*!/(de,fr)!/*"), "regexp_full_match(url, 'https:.*/(de|fr)/.*', 's')")
finder("find_point", "orders", O, point(500), "o_orderkey >= 500")
finder("find_not_point", "orders", O, ~point(500), "o_orderkey < 500")
finder("find_singlerec", "orders", O, single_record(42), "o_orderkey = 42")
finder("find_not_singlerec", "nation", "N_NAME", ~single_record(3), "n_nationkey <> 3")
finder("find_norecs", "orders", O, NONE, "false")
finder("find_allrecs", "nation", "N_NAME", ALL, "true")
finder("find_force_alpha", "part", P, where("P_SIZE", "A_GE", "5"), "CAST(p_size AS VARCHAR) >= '5'")
finder("find_force_alpha_float", "orders", O, where("O_TOTALPRICE", "A_LT", "2"), "CAST(o_totalprice AS VARCHAR) < '2'")
finder("find_and_or_not", "orders", "O_ORDERSTATUS O_TOTALPRICE O_ORDERPRIORITY", where("O_ORDERSTATUS", "EQ", "F") & ~(where("O_TOTALPRICE", "LT", 100000) | where("O_ORDERPRIORITY", "LIKE", "1*")), "o_orderstatus = 'F' AND NOT (o_totalprice < 100000 OR starts_with(o_orderpriority, '1'))")
finder("find_text", "orders", "O_ORDERSTATUS O_TOTALPRICE O_ORDERPRIORITY", "O_ORDERSTATUS = F AND (O_ORDERPRIORITY = '1-URGENT' OR '2-HIGH' OR O_TOTALPRICE IN RANGE FROM 300000 TO 400000) AND NOT O_TOTALPRICE LT 20000", "o_orderstatus = 'F' AND (o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_totalprice BETWEEN 300000 AND 400000) AND NOT o_totalprice < 20000")
finder("find_text_like", "part", P, "P_NAME IS LIKE 'NOCASE:A*' OR P_SIZE EQ 1 OR 2", "starts_with(upper(p_name), 'A') OR p_size IN (1, 2)")
finder("find_text_long_documents", "documents", "LANG N_CHARS", "LANG IS NOT LIKE (d,f)* AND N_CHARS GT 2000", "NOT regexp_full_match(lang, '(d|f).*') AND n_chars > 2000")


@register("find_force_num", f"WITH {NUMERIC_TEXT_SQL} SELECT id, txt FROM numtext WHERE coalesce(num, 0) = 0")
def find_force_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.context import Context

    return shown(Context("NUMTEXT", (numeric_text(spark, sf_dir),)).find(where("TXT", "N_EQ", 0)), "TXT")


@register("find_force_num_operands", f"WITH {NUMERIC_TEXT_SQL}, operands AS (SELECT * FROM (VALUES ('- 5', -5.0), ('1_000', 0.0), ('nan', 0.0), (' +7 ', 7.0), ('12345678901234567', 0.0), ('1E2', 100.0)) AS t(operand, number)) SELECT operand, id, txt FROM numtext, operands WHERE coalesce(num, 0) = number")
def find_force_num_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.context import Context

    c = Context("NUMTEXT", (numeric_text(spark, sf_dir),))
    found = [shown(c.find(where("TXT", "N_EQ", x)), "TXT").withColumn("operand", F.lit(x)) for x in ("- 5", "1_000", "nan", " +7 ", "12345678901234567", "1E2")]
    return reduce(DataFrame.unionByName, found)


def _sparse(spark: SparkSession, sf_dir: str):
    from ..operators.context import Context

    return Context("CUSTSP", (customer_sparse(spark, sf_dir),))


def _mv(spark: SparkSession, sf_dir: str):
    from ..operators.context import Context

    return Context("ORDERSMV", (orders_mv(spark, sf_dir),))


def sparse_finder(name: str, criteria, condition: str) -> None:
    register(name, f"WITH {CUSTOMER_SPARSE_SQL} SELECT id, segment, bal FROM sparse WHERE {condition}")(lambda spark, sf_dir: shown(_sparse(spark, sf_dir).find(criteria), "SEGMENT", "BAL"))


sparse_finder("find_present", where("SEGMENT", "PRESENT"), "segment IS NOT NULL")
sparse_finder("find_not_present", where("SEGMENT", "NOT_PRESENT"), "segment IS NULL")
sparse_finder("find_not_eq_missing", where("SEGMENT", "NOT_EQ", "BUILDING"), "segment IS NULL OR segment <> 'BUILDING'")
sparse_finder("find_not_or_missing", ~(where("SEGMENT", "LIKE", "B*") | where("BAL", "GT", 0)), "NOT (coalesce(starts_with(segment, 'B'), false) OR coalesce(bal > 0, false))")
sparse_finder("find_not_range_missing", where("BAL", "NOT_RANGE", 0, 5000), "bal IS NULL OR NOT bal BETWEEN 0 AND 5000")


def mv_finder(name: str, criteria, condition: str) -> None:
    register(name, f"WITH {ORDERS_MV_SQL} SELECT id, status, price FROM mv WHERE {condition}")(lambda spark, sf_dir: shown(_mv(spark, sf_dir).find(criteria), "STATUS", "PRICE"))


mv_finder("find_any_occurrence", where("QTY", "GT", 49), "coalesce(list_max(qty) > 49, false)")
mv_finder("find_two_occurrences", where("QTY", "GT", 48) & where("QTY", "LT", 3), "coalesce(list_max(qty) > 48 AND list_min(qty) < 3, false)")
mv_finder("find_one_occurrence_range", where("QTY", "RANGE", 48, 49), "coalesce(len(list_filter(qty, lambda x: x BETWEEN 48 AND 49)) > 0, false)")
mv_finder("find_not_occurrence", ~where("FLAG", "EQ", "R"), "NOT coalesce(list_contains(flag, 'R'), false)")
mv_finder("find_unlike_occurrence", where("FLAG", "UNLIKE", "R*"), "coalesce(len(list_filter(flag, lambda x: NOT starts_with(x, 'R'))) > 0, false)")
mv_finder("find_mv_missing", where("QTY", "NOT_PRESENT"), "qty IS NULL")


@register("find_set_semi", "SELECT o_orderkey AS id, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def find_set_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = context(spark, sf_dir, "orders")
    return shown(c.find(where("O_TOTALPRICE", "GT", 200000) & in_set(c.find("O_ORDERSTATUS = O"))), "O_ORDERSTATUS", "O_TOTALPRICE")


@register("find_not_set", "SELECT o_orderkey AS id, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def find_not_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = context(spark, sf_dir, "orders")
    return shown(c.find(~in_set(c.find("O_ORDERSTATUS = O"))), "O_ORDERSTATUS", "O_TOTALPRICE")


@register("find_set_or", "SELECT o_orderkey AS id, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 300000 OR o_orderstatus = 'P'")
def find_set_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = context(spark, sf_dir, "orders")
    return shown(c.find(where("O_TOTALPRICE", "GT", 300000) | in_set(c.find("O_ORDERSTATUS = P"))), "O_ORDERSTATUS", "O_TOTALPRICE")


@register("find_referback", "SELECT o_orderkey AS id, o_orderstatus, o_totalprice FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') WHERE o_totalprice < 60000")
def find_referback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(context(spark, sf_dir, "orders").find("O_ORDERSTATUS = F").find("O_TOTALPRICE LT 60000"), "O_ORDERSTATUS", "O_TOTALPRICE")


# --- groups --------------------------------------------------------------------------------------


def group_finder(name: str, criteria, condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = parties(spark, sf_dir).find(criteria).frame
        return found.select(F.col(FILE_IX).alias("ix"), F.col(RECNUM).alias("id"), F.col("NAME").alias("name"), F.col("ACCTBAL").alias("acctbal"), F.col("SEGMENT").alias("segment"))

    register(name, f"WITH {PARTIES_SQL} SELECT ix, id, name, acctbal, segment FROM party WHERE {condition}")(run)


group_finder("group_find", where("ACCTBAL", "LT", 0), "acctbal < 0")
group_finder("group_missing_field", ~where("SEGMENT", "EQ", "BUILDING"), "segment IS NULL OR segment <> 'BUILDING'")
group_finder("find_file", file_is("SUPPLIER") & where("ACCTBAL", "GT", 5000), "ix = 1 AND acctbal > 5000")
group_finder("find_not_file", ~file_is("SUPPLIER") & where("ACCTBAL", "GT", 9000), "ix = 0 AND acctbal > 9000")


@register("group_find_values", f"WITH {PARTIES_SQL} SELECT value, CAST(row_number() OVER (ORDER BY value) AS BIGINT) AS rn FROM (SELECT DISTINCT nation AS value FROM party)")
def group_find_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parties(spark, sf_dir).find_values("NATION").ranked()


@register("group_member_values", f"WITH {PARTIES_SQL} SELECT DISTINCT nation AS value FROM party WHERE ix = 1")
def group_member_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parties(spark, sf_dir).find_values("NATION", file="SUPPLIER").source


@register("group_value_members", f"WITH {PARTIES_SQL} SELECT count(DISTINCT ix) AS n FROM party WHERE segment IS NOT NULL")
def group_value_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parties(spark, sf_dir).values_per_member("SEGMENT")


# --- counts and values ---------------------------------------------------------------------------


@register("count_set", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def count_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir, "orders").find("O_ORDERSTATUS = F").count()


@register("count_values", "SELECT count(DISTINCT p_brand) AS n FROM part")
def count_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir, "part").count_values("P_BRAND")


@register("count_values_range", "SELECT count(DISTINCT p_size) AS n FROM part WHERE p_size BETWEEN 10 AND 30")
def count_values_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir, "part").count_values("P_SIZE", "RANGE", 10, 30)


@register("value_histogram", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir, "part").find().histogram("P_BRAND")


@register("value_histogram_mv", f"WITH {ORDERS_MV_SQL} SELECT value, count(*) AS n FROM (SELECT id, unnest(list_distinct(flag)) AS value FROM mv) GROUP BY value")
def value_histogram_mv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mv(spark, sf_dir).find().histogram("FLAG")


@register("find_values", "SELECT value, CAST(row_number() OVER (ORDER BY value) AS BIGINT) AS rn FROM (SELECT DISTINCT p_brand AS value FROM part)")
def find_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir, "part").find_values("P_BRAND").ranked()


@register("find_values_range", "SELECT DISTINCT p_size AS value FROM part WHERE p_size > 12 AND p_size <= 17")
def find_values_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir, "part").find_values("P_SIZE", "RANGE_GT_LE", 12, 17).source


@register("find_values_like", "SELECT DISTINCT p_name AS value FROM part WHERE regexp_full_match(p_name, '.*(red|blue).*')")
def find_values_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir, "part").find_values("P_NAME", "LIKE", "*(red,blue)*").source


@register("find_values_missing", f"WITH {CUSTOMER_SPARSE_SQL} SELECT DISTINCT segment AS value FROM sparse WHERE segment IS NOT NULL")
def find_values_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir).find_values("SEGMENT").source


@register("value_sort_num", f"WITH {NUMERIC_TEXT_SQL} SELECT value, CAST(row_number() OVER (ORDER BY value) AS BIGINT) AS rn FROM (SELECT coalesce(num, 0) AS value FROM (SELECT DISTINCT txt, num FROM numtext))")
def value_sort_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.context import Context

    return Context("NUMTEXT", (numeric_text(spark, sf_dir),)).find_values("TXT").sort("NUMERIC").ranked()


@register("value_sort_nocase", "SELECT value, CAST(row_number() OVER (ORDER BY upper(value) DESC, value DESC) AS BIGINT) AS rn FROM (SELECT DISTINCT p_name AS value FROM part)")
def value_sort_nocase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir, "part").find_values("P_NAME").sort("NOCASE", descending=True).ranked()


@register("value_sort_right_adjusted", "SELECT value, CAST(row_number() OVER (ORDER BY strlen(value), value) AS BIGINT) AS rn FROM (SELECT DISTINCT p_name AS value FROM part)")
def value_sort_right_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir, "part").find_values("P_NAME").sort("RIGHT_ADJUSTED").ranked()


@register("value_at", "SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) AS rn FROM (SELECT DISTINCT p_brand AS value FROM part)) WHERE rn = 8")
def value_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir, "part").find_values("P_BRAND").at(7)


@register("cursor_first_last", "SELECT min(o_totalprice) AS first, max(o_totalprice) AS last FROM orders")
def cursor_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = context(spark, sf_dir, "orders").value_cursor("O_TOTALPRICE")
    return up.first().select(F.col("value").alias("first")).withColumn("last", up.last().scalar())


@register("cursor_first_last_descending", "SELECT max(p_brand) AS first, min(p_brand) AS last FROM part")
def cursor_first_last_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    down = context(spark, sf_dir, "part").value_cursor("P_BRAND", descending=True)
    return down.first().select(F.col("value").alias("first")).withColumn("last", down.last().scalar())


@register("cursor_remain", "SELECT 20 AS value, 'hit' AS way UNION ALL SELECT 7, 'miss'")
def cursor_remain(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursor = context(spark, sf_dir, "part").value_cursor("P_SIZE")
    return cursor.set_position(20, "remain", 7).withColumn("way", F.lit("hit")).unionByName(cursor.set_position(1000, "remain", 7).withColumn("way", F.lit("miss")))


@register("cursor_clone_adopt_swap", "WITH v AS (SELECT value, row_number() OVER (ORDER BY value) AS rn FROM (SELECT DISTINCT p_brand AS value FROM part)) SELECT (SELECT value FROM v WHERE rn = 3) AS a, (SELECT max(value) FROM v) AS b, (SELECT value FROM v WHERE rn = 3) AS c")
def cursor_clone_adopt_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sets import CursorPosition

    a = CursorPosition(context(spark, sf_dir, "part").value_cursor("P_BRAND"))
    a.goto_first()
    b, c = a.clone(), a.clone()
    a.goto_last()
    b.advance(2)
    a.swap(b)
    c.adopt(a)
    return spark.createDataFrame([(a.value, b.value, c.value)], "a string, b string, c string")


@register("cursor_advance", "WITH v AS (SELECT DISTINCT p_size AS value FROM part) SELECT value FROM v WHERE value >= 20 ORDER BY value LIMIT 1 OFFSET 3")
def cursor_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir, "part").value_cursor("P_SIZE").advance(20, 3)


@register("cursor_steps", "WITH v AS (SELECT DISTINCT p_brand AS value FROM part) SELECT value, lead(value, 2) OVER (ORDER BY value) AS next_value FROM v")
def cursor_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir, "part").value_cursor("P_BRAND").steps(2)


@register("cursor_position", "SELECT min(o_totalprice) AS value, 'next' AS miss FROM orders WHERE o_totalprice >= 150000 UNION ALL SELECT max(o_totalprice), 'prev' FROM orders WHERE o_totalprice <= 150000")
def cursor_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursor = context(spark, sf_dir, "orders").value_cursor("O_TOTALPRICE")
    return cursor.set_position(150000.0).withColumn("miss", F.lit("next")).unionByName(cursor.set_position(150000.0, "prev").withColumn("miss", F.lit("prev")))


@register("cursor_restrict", "SELECT DISTINCT p_brand AS value FROM part WHERE p_brand >= 'Brand#2' AND p_brand < 'Brand#4' AND NOT ends_with(p_brand, '3')")
def cursor_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir, "part").value_cursor("P_BRAND").restrict("Brand!#2".replace("!", ""), "Brand#4", high_inclusive=False, unlike="*3").source


# --- sorts ---------------------------------------------------------------------------------------


def sorter(name: str, table: str, keys: list[SortKey], order: str, key: str, **kw) -> None:
    names = [k.field for k in keys]
    columns = ", ".join(n.lower() for n in names)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ranked = context(spark, sf_dir, table).find().sort(*keys, collect=names, **kw).ranked()
        return ranked.select("rn", F.col(RECNUM).alias("id"), *(F.col(n).alias(n.lower()) for n in names))

    register(name, f"SELECT CAST(row_number() OVER (ORDER BY {order}, {key}) AS BIGINT) AS rn, {key} AS id, {columns} FROM {table}")(run)


sorter("sort_char", "part", [SortKey("P_NAME")], "p_name", "p_partkey")
sorter("sort_num_desc", "orders", [SortKey("O_TOTALPRICE", descending=True)], "o_totalprice DESC", "o_orderkey")
sorter("sort_two_keys", "orders", [SortKey("O_ORDERSTATUS", descending=True), SortKey("O_TOTALPRICE")], "o_orderstatus DESC, o_totalprice", "o_orderkey")
sorter("sort_nocase", "part", [SortKey("P_NAME", type="NOCASE")], "upper(p_name)", "p_partkey")
sorter("sort_right_adjusted", "part", [SortKey("P_NAME", type="RIGHT_ADJUSTED")], "strlen(p_name), p_name", "p_partkey")
sorter("sort_number_as_text", "part", [SortKey("P_SIZE", type="CHARACTER")], "CAST(p_size AS VARCHAR)", "p_partkey")


def _sorted_sparse(descending: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ranked = _sparse(spark, sf_dir).find().sort(SortKey("BAL", descending=descending), collect=["BAL"]).ranked()
        return ranked.select("rn", F.col(RECNUM).alias("id"), F.col("BAL").alias("bal"))

    return run


for _name, _desc in (("sort_missing_first", False), ("sort_missing_first_desc", True)):
    register(_name, f"WITH {CUSTOMER_SPARSE_SQL} SELECT CAST(row_number() OVER (ORDER BY bal {'DESC' if _desc else 'ASC'} NULLS FIRST, id) AS BIGINT) AS rn, id, bal FROM sparse")(_sorted_sparse(_desc))


@register("sort_numeric_text", f"WITH {NUMERIC_TEXT_SQL} SELECT CAST(row_number() OVER (ORDER BY num NULLS FIRST, id) AS BIGINT) AS rn, id, txt FROM numtext")
def sort_numeric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.context import Context

    ranked = Context("NUMTEXT", (numeric_text(spark, sf_dir),)).find().sort(SortKey("TXT", type="NUMERIC"), collect=["TXT"]).ranked()
    return ranked.select("rn", F.col(RECNUM).alias("id"), F.col("TXT").alias("txt"))


@register("sort_first_occurrence", f"WITH {ORDERS_MV_SQL} SELECT CAST(row_number() OVER (ORDER BY qty[1] NULLS FIRST, id) AS BIGINT) AS rn, id, qty[1] AS first_qty, array_to_string(part, ',') AS parts FROM mv")
def sort_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _mv(spark, sf_dir).find().sort(SortKey("QTY"), collect=["QTY", "PART"], first_only=["QTY"]).ranked()
    return ranked.select("rn", F.col(RECNUM).alias("id"), F.col("QTY").alias("first_qty"), F.array_join(F.col("PART").cast("array<string>"), ",").alias("parts"))


@register("sort_each", f"WITH {ORDERS_MV_SQL}, e AS (SELECT id, flag, unnest(range(1, len(flag) + 1)) AS k FROM mv WHERE flag IS NOT NULL) SELECT CAST(row_number() OVER (ORDER BY flag[k], id, k) AS BIGINT) AS rn, id, array_to_string(flag[k:] || flag[1 : k - 1], '') AS flags FROM e")
def sort_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _mv(spark, sf_dir).find().sort(SortKey("FLAG", each=True), collect=["FLAG"]).ranked()
    return ranked.select("rn", F.col(RECNUM).alias("id"), F.array_join("FLAG", "").alias("flags"))


@register("sort_limit_first", "SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn, o_orderkey AS id, o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 25)")
def sort_limit_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = context(spark, sf_dir, "orders").find().sort(SortKey("O_TOTALPRICE", descending=True), collect=["O_TOTALPRICE"], limit=25).ranked()
    return ranked.select("rn", F.col(RECNUM).alias("id"), F.col("O_TOTALPRICE").alias("o_totalprice"))


@register("sort_topk", "SELECT o_orderkey AS id, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(context(spark, sf_dir, "orders").find().sort(SortKey("O_TOTALPRICE", descending=True), collect=["O_TOTALPRICE"]).top(50), "O_TOTALPRICE")


@register("sorted_record_at", "SELECT o_orderkey AS id, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 99")
def sorted_record_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(context(spark, sf_dir, "orders").find().sort("O_TOTALPRICE", collect=["O_TOTALPRICE"]).record_at(99), "O_TOTALPRICE")


@register("record_numbers", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 30")
def record_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(context(spark, sf_dir, "orders").find("O_ORDERSTATUS = P").record_numbers(30))


@register("record_at", "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1 OFFSET 5")
def record_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(context(spark, sf_dir, "orders").find("O_ORDERSTATUS = P").record_at(5), "O_TOTALPRICE")


@register("sort_keys_only", "SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn, o_orderkey AS id, o_orderpriority FROM orders")
def sort_keys_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = context(spark, sf_dir, "orders").find().sort(SortKey("O_TOTALPRICE", descending=True), collect=[]).records()
    return records.select("rn", F.col(RECNUM).alias("id"), F.col("O_ORDERPRIORITY").alias("o_orderpriority"))


@register("natural_order", f"WITH {PARTIES_SQL} SELECT ix, id, CAST(row_number() OVER (ORDER BY ix, id) - 1 AS BIGINT) AS place FROM party WHERE acctbal < 0")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = parties(spark, sf_dir).find("ACCTBAL LT 0")
    return numbered(ordered.ids, (F.col(FILE_IX), F.col(RECNUM)), "place").select(F.col(FILE_IX).alias("ix"), F.col(RECNUM).alias("id"), (F.col("place") - 1).alias("place"))


# --- lists ---------------------------------------------------------------------------------------


@register("list_place", "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 300000")
def list_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = context(spark, sf_dir, "orders")
    return shown(c.create_list().place(c.find("O_ORDERSTATUS = P")).place(c.find("O_TOTALPRICE GT 300000")), "O_ORDERSTATUS")


@register("list_remove", "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderstatus = 'P' AND o_totalprice <= 200000")
def list_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = context(spark, sf_dir, "orders")
    return shown(c.find("O_ORDERSTATUS = P").remove(c.find("O_TOTALPRICE GT 200000")), "O_ORDERSTATUS")


@register("list_intersect", "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000")
def list_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = context(spark, sf_dir, "orders")
    return shown(c.find("O_ORDERSTATUS = P").intersect(c.find("O_TOTALPRICE GT 200000")), "O_ORDERSTATUS")


@register("list_single_records", "SELECT n_nationkey::BIGINT AS id, n_name FROM nation WHERE n_nationkey = 7 OR n_regionkey = 2 AND n_nationkey <> 12")
def list_single_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(context(spark, sf_dir, "nation").find("N_REGIONKEY = 2").place_record(7).remove_record(12), "N_NAME")


@register("list_clear_member", f"WITH {PARTIES_SQL} SELECT id, name FROM party WHERE ix = 1 AND acctbal < 1000")
def list_clear_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(parties(spark, sf_dir).find("ACCTBAL LT 1000").clear_member("CUSTOMER"), "NAME")


# --- record access -------------------------------------------------------------------------------


@register("get_occurrence", f"WITH {ORDERS_MV_SQL} SELECT id, coalesce(qty[2], 0.0) AS value, qty[2] IS NOT NULL AS found FROM mv")
def get_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mv(spark, sf_dir).find().occurrence("QTY", 2).select(F.col(RECNUM).alias("id"), "value", "found")


@register("count_occurrences", f"WITH {ORDERS_MV_SQL} SELECT id, CAST(coalesce(len(qty), 0) AS BIGINT) AS n FROM mv")
def count_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mv(spark, sf_dir).find().count_occurrences("QTY").select(F.col(RECNUM).alias("id"), "n")


@register("fv_pairs", f"WITH {ORDERS_MV_SQL} SELECT id, 'STATUS' AS fname, CAST(1 AS BIGINT) AS occ, status AS sval FROM mv UNION ALL SELECT id, 'FLAG', CAST(k AS BIGINT), flag[k] FROM (SELECT id, flag, unnest(range(1, len(flag) + 1)) AS k FROM mv WHERE flag IS NOT NULL)")
def fv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mv(spark, sf_dir).find().pairs(["STATUS", "FLAG"]).select(F.col(RECNUM).alias("id"), "fname", F.col("occ").cast("long").alias("occ"), "sval")


@register("blob_length", "SELECT doc_id AS id, length(text) AS length FROM documents")
def blob_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir, "documents").find().blob_length("TEXT").select(F.col(RECNUM).alias("id"), "length")


@register("copy_all", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def copy_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(context(spark, sf_dir, "nation").find("N_REGIONKEY = 1").copy(), "N_NATIONKEY", "N_NAME", "N_REGIONKEY")


@register("field_dictionary", "SELECT * FROM (VALUES ('O_CUSTKEY', 'FLOAT', 'NUM'), ('O_ORDERDATE', 'STRING', 'CHAR'), ('O_ORDERKEY', 'FLOAT', 'NUM'), ('O_ORDERPRIORITY', 'STRING', 'CHAR'), ('O_ORDERSTATUS', 'STRING', 'CHAR'), ('O_TOTALPRICE', 'FLOAT', 'NUM')) AS t(name, storage, index)")
def field_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file(spark, sf_dir, "orders").dictionary(spark).select("name", "storage", "index")


# --- joins ---------------------------------------------------------------------------------------


@register("join_value_set", "SELECT c_custkey AS id, c_name FROM customer WHERE c_nationkey IN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def join_value_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = context(spark, sf_dir, "supplier").find("S_ACCTBAL GT 8000")
    from ..operators.sets import ValueSet

    nations = ValueSet(suppliers.values("S_NATIONKEY").select("value").distinct(), (F.col("value").asc(),))
    return shown(joins.records_with_values(context(spark, sf_dir, "customer").find(), "C_NATIONKEY", nations), "C_NAME")


@register("join_records", "SELECT c_custkey AS id, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000")
def join_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyers = context(spark, sf_dir, "customer").find("C_MKTSEGMENT = BUILDING")
    orders = context(spark, sf_dir, "orders").find("O_TOTALPRICE GT 200000")
    joined = joins.value_join(buyers, "C_CUSTKEY", orders, "O_CUSTKEY")
    return joined.select(F.col(RECNUM).alias("id"), F.col("r_O_ORDERKEY").alias("o_orderkey"), F.col("r_O_TOTALPRICE").alias("o_totalprice"))


# --- updates -------------------------------------------------------------------------------------


def updater(name: str, change: Callable, qty: str) -> None:
    """An update of QTY in orders with status F; ``qty`` is the new list in SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = _mv(spark, sf_dir)
        changed = change(c.members[0], c.find("STATUS = F")).frame
        return changed.select(F.col(RECNUM).alias("id"), F.coalesce(F.size("QTY"), F.lit(0)).cast("long").alias("n"), F.array_join(F.transform("QTY", lambda x: x.cast("long").cast("string")), ",").alias("qty"))

    sql = f"WITH {ORDERS_MV_SQL}, u AS (SELECT id, CASE WHEN status = 'F' THEN {qty} ELSE qty END AS qty FROM mv) SELECT id, CAST(coalesce(len(qty), 0) AS BIGINT) AS n, CASE WHEN len(qty) > 0 THEN array_to_string(list_transform(qty, lambda x: CAST(x AS BIGINT)), ',') END AS qty FROM u"
    register(name, sql)(run)


updater("add_field", lambda f, s: updates.add_field(f, "QTY", 99, s), "coalesce(qty, []) || [99.0]")
updater("insert_field", lambda f, s: updates.insert_field(f, "QTY", 99, 2, s), "CASE WHEN coalesce(len(qty), 0) < 2 THEN coalesce(qty, []) || [99.0] ELSE qty[1:1] || [99.0] || qty[2:] END")
updater("change_field", lambda f, s: updates.change_field(f, "QTY", 99, 2, s), "CASE WHEN coalesce(len(qty), 0) < 2 THEN coalesce(qty, []) || [99.0] ELSE qty[1:1] || [99.0] || qty[3:] END")
updater("delete_field", lambda f, s: updates.delete_field(f, "QTY", 1, s), "qty[2:]")
updater("delete_each", lambda f, s: updates.delete_each(f, "QTY", s), "NULL")
updater("delete_value", lambda f, s: updates.delete_value(f, "QTY", 7, s), "CASE WHEN list_contains(qty, 7) THEN qty[1 : list_position(qty, 7) - 1] || qty[list_position(qty, 7) + 1 :] ELSE qty END")
updater("change_value", lambda f, s: updates.change_value(f, "QTY", 7, 99, s), "CASE WHEN list_contains(qty, 7) THEN qty[1 : list_position(qty, 7) - 1] || [99.0] || qty[list_position(qty, 7) + 1 :] ELSE coalesce(qty, []) || [99.0] END")


@register("store_records", "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name FROM region UNION ALL SELECT 4 + row_number() OVER (ORDER BY n_name), n_name FROM nation")
def store_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = read(spark, sf_dir, "nation").select(F.col("n_name").alias("R_NAME"))
    return shown(updates.store_records(file(spark, sf_dir, "region"), new, ["R_NAME"]).frame, "R_NAME")


@register("store_record", "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name FROM region UNION ALL SELECT 5, 'ATLANTIS'")
def store_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(updates.store_record(file(spark, sf_dir, "region"), [("R_NAME", "ATLANTIS")]).frame, "R_NAME")


@register("group_store", f"WITH {PARTIES_SQL} SELECT ix, id, name, acctbal FROM party WHERE acctbal < -900 UNION ALL SELECT 0, (SELECT max(id) + 1 FROM party WHERE ix = 0), 'NEW ONE', -950.5")
def group_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = parties(spark, sf_dir).store_record([("NAME", "NEW ONE"), ("ACCTBAL", "-950.5")]).find("ACCTBAL LT -900").frame
    return stored.select(F.col(FILE_IX).alias("ix"), F.col(RECNUM).alias("id"), F.col("NAME").alias("name"), F.col("ACCTBAL").alias("acctbal"))


@register("store_converted", f"WITH {NUMERIC_TEXT_SQL} SELECT -1 + row_number() OVER (ORDER BY txt, id) AS id, coalesce(num, 0) AS n FROM numtext")
def store_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.context import Engine

    engine = Engine(spark)
    engine.create("NUMBERS", [Field("N", "FLOAT", "NUM"), Field("OLD", "FLOAT", "NUM"), Field("TXT")])
    rows = numeric_text(spark, sf_dir).frame.select(F.col("TXT").alias("N"), F.col(RECNUM).alias("OLD"), "TXT")
    return shown(engine.open("NUMBERS").store_records(rows, ["TXT", "OLD"]).find(), "N")


@register("copy_records", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY n_name), n_name FROM nation WHERE n_regionkey = 2")
def copy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = context(spark, sf_dir, "nation")
    template = c.find("N_REGIONKEY = 2").copy().select("N_NATIONKEY", "N_NAME", "N_REGIONKEY")
    return shown(c.store_records(template, ["N_NAME"]).find(), "N_NAME")


@register("dirty_delete", "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_totalprice <= 200000")
def dirty_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = context(spark, sf_dir, "orders")
    return shown(updates.dirty_delete_records(c.members[0], c.find("O_TOTALPRICE GT 200000")).frame, "O_ORDERSTATUS")


@register("rename_invisible", "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_totalprice > 400000")
def rename_invisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = context(spark, sf_dir, "orders")
    c = c.with_file(c.members[0].define(Field("MARK", "INVISIBLE", "CHAR")).define(Field("OTHER", "INVISIBLE", "CHAR")))
    c = c.file_records_under(c.find("O_TOTALPRICE GT 400000"), "MARK", "DEAR").file_records_under(c.find("O_ORDERSTATUS = P"), "OTHER", "DEAR")
    return shown(c.with_file(c.members[0].rename("MARK", "LABEL").delete("OTHER")).find_filed("LABEL", "DEAR"), "O_TOTALPRICE")


@register("rollback", "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name, 'first' AS version FROM region UNION ALL SELECT r_regionkey, 'CHANGED', 'last' FROM region")
def rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, versions = file(spark, sf_dir, "region"), admin.Versions(spark, checkpoints.new_path(spark))
    versions.checkpoint(f)
    versions.checkpoint(updates.delete_each(f, "R_NAME"))
    first = versions.rollback(f, 1)
    versions.checkpoint(updates.change_field(first, "R_NAME", "CHANGED", 1))
    both = ((first, "first"), (admin.Versions(spark, versions.folder).rollback(f), "last"))
    return reduce(DataFrame.unionByName, [shown(v.frame, "R_NAME").withColumn("version", F.lit(name)) for v, name in both])


@register("delete_records", "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def delete_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = context(spark, sf_dir, "orders")
    return shown(updates.delete_records(c.members[0], c.find("O_ORDERSTATUS = F")).frame, "O_ORDERSTATUS")


@register("file_records_under", "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_totalprice > 300000")
def file_records_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = context(spark, sf_dir, "orders")
    c = c.with_file(c.members[0].define(Field("MARK", "INVISIBLE", "CHAR")))
    c = c.file_records_under(c.find("O_ORDERSTATUS = P"), "MARK", "DEAR").file_records_under(c.find("O_TOTALPRICE GT 300000"), "MARK", "DEAR")
    return shown(c.find_filed("MARK", "DEAR"), "O_TOTALPRICE")


@register("redefine_field", f"WITH {NUMERIC_TEXT_SQL} SELECT id, coalesce(num, 0) AS txt FROM numtext")
def redefine_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(numeric_text(spark, sf_dir).redefine(Field("TXT", "FLOAT", "CHAR")).frame, "TXT")


@register("redefine_invisible", "SELECT p_partkey AS id, p_name FROM part WHERE p_size = 7")
def redefine_invisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = context(spark, sf_dir, "part")
    return shown(c.with_file(c.members[0].redefine(Field("P_SIZE", "INVISIBLE", "NUM"))).find_filed("P_SIZE", 7), "P_NAME")


@register("redefine_visible", f"WITH {ORDERS_MV_SQL} SELECT id, array_to_string(list_sort(list_distinct(flag)), '') AS flags FROM mv")
def redefine_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = orders_mv(spark, sf_dir)
    back = f.redefine(Field("FLAG", "INVISIBLE", "CHAR")).redefine(Field("FLAG", "STRING", "CHAR", multi=True))
    return back.frame.select(F.col(RECNUM).alias("id"), F.array_join("FLAG", "").alias("flags"))


@register("rename_delete_field", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS title FROM nation")
def rename_delete_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(file(spark, sf_dir, "nation").rename("N_NAME", "TITLE").delete("N_REGIONKEY").frame, "TITLE")


@register("backout", "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name FROM region")
def backout(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = updates.UpdateUnit(file(spark, sf_dir, "region"))
    unit.update(updates.store_record, [("R_NAME", "ATLANTIS")]).update(updates.delete_each, "R_NAME")
    return shown(unit.backout().frame, "R_NAME")


# --- unload, load --------------------------------------------------------------------------------


@register("unload_pai", "SELECT o_orderkey AS id, o_orderkey || chr(10) || 'O_TOTALPRICE = ' || regexp_replace(regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18, 4)) AS VARCHAR), '0+$', ''), '\\.$', '') || chr(10) || 'O_ORDERPRIORITY = ' || o_orderpriority || chr(10) || '$$$' AS text FROM orders")
def unload_pai(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.unload_pai(file(spark, sf_dir, "orders"), include=["O_TOTALPRICE", "O_ORDERPRIORITY"]).select(F.col(RECNUM).alias("id"), "text")


@register("unload_no_float", "SELECT CAST(s_suppkey AS BIGINT) AS id, regexp_replace(regexp_replace(CAST(CAST(s_acctbal AS DECIMAL(18, 4)) AS VARCHAR), '0+$', ''), '\\.$', '') AS s_acctbal, s_name FROM supplier")
def unload_no_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(files.unload_data(file(spark, sf_dir, "supplier"), no_float=True), "S_ACCTBAL", "S_NAME")


@register("unload_subset", "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def unload_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = context(spark, sf_dir, "orders")
    return shown(files.unload_data(c.members[0], c.find("O_ORDERSTATUS = P"), include=["O_TOTALPRICE", "O_TOTALPRICE"]), "O_TOTALPRICE")


@register("index_unload", "SELECT p_brand AS value, p_partkey // 65280 AS segment, array_to_string(list(p_partkey ORDER BY p_partkey), ',') AS records, count(*) AS n FROM part GROUP BY ALL")
def index_unload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.unload_index(file(spark, sf_dir, "part"), "P_BRAND").select("value", "segment", F.array_join(F.col("records").cast("array<string>"), ",").alias("records"), "n")


@register("unload_definitions", "SELECT * FROM (VALUES ('DEFINE FIELD 0 ''R_NAME'' (STRING, ORD CHAR)'), ('DEFINE FIELD 1 ''R_REGIONKEY'' (FLOAT, ORD NUM)')) AS t(line)")
def unload_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file(spark, sf_dir, "region").definitions(spark)


#: Texts with line ends, end marks and what looks like a field.
_NASTY = "replace(text, '. ', '.' || {newline} || '$$$' || {newline} || 'TEXT = ')"


@register("pai_round_trip", f"SELECT doc_id AS id, 'TEXT' AS fname, {_NASTY.format(newline='chr(10)')} AS sval FROM documents UNION ALL SELECT doc_id, 'LANG', lang FROM documents")
def pai_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = file(spark, sf_dir, "documents")
    f = f.with_frame(f.frame.withColumn("TEXT", F.expr(_NASTY.format(newline="char(10)"))))
    text = files.unload_pai(f, include=["TEXT", "LANG"])
    return files.parse_pai(text, f).select(F.col(RECNUM).alias("id"), "fname", "sval")


@register("pai_ebcdic_round_trip", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey FROM nation")
def pai_ebcdic_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = file(spark, sf_dir, "nation")
    return shown(files.load_pai(files.unload_pai(f, ebcdic=True, crlf=True), f, ebcdic=True, crlf=True), "N_NAME", "N_REGIONKEY")


@register("unload_load_entries", "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000")
def unload_load_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.context import Context

    c = context(spark, sf_dir, "orders")
    c = c.with_file(c.members[0].define(Field("MARK", "INVISIBLE", "CHAR")))
    c = c.file_records_under(c.find("O_ORDERSTATUS = P"), "MARK", "PENDING")
    path = checkpoints.new_path(spark)
    files.unload(c.members[0], path, within=c.find("O_TOTALPRICE GT 100000"))
    return shown(Context("ORDERS", (files.load(spark, "ORDERS", path),)).find_filed("MARK", "PENDING"), "O_TOTALPRICE")


@register("fast_load_entries", "WITH new AS (SELECT o_orderkey, o_totalprice, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS id FROM orders WHERE o_orderstatus = 'P') SELECT id, o_totalprice FROM new UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def fast_load_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = context(spark, sf_dir, "orders")
    c = c.with_file(c.members[0].define(Field("MARK", "INVISIBLE", "CHAR")))
    c = c.file_records_under(c.find("O_ORDERSTATUS = P"), "MARK", "PENDING")
    f = c.members[0]
    loaded, _ = files.fast_load(f, files.unload_data(f, c.find("O_ORDERSTATUS = P")), ["O_TOTALPRICE", "O_ORDERKEY"], f.entries)
    return shown(c.with_file(loaded).find_filed("MARK", "PENDING"), "O_TOTALPRICE")


def _deferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of order keys under their customers' records."""
    orders = read(spark, sf_dir, "orders")
    return orders.select(F.lit("ORDERNO").alias("field"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("value"), F.col("o_custkey").alias(RECNUM)).unionByName(
        orders.where("o_orderstatus = 'P'").select(F.lit("MARK").alias("field"), F.lit("PENDING").alias("value"), F.col("o_custkey").alias(RECNUM))
    )


@register("deferred_multi_step", "SELECT c_custkey AS id, string_agg(lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), ',' ORDER BY o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def deferred_multi_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = checkpoints.new_path(spark)
    files.defer(_deferred(spark, sf_dir), path)
    f = file(spark, sf_dir, "customer").define(Field("ORDERNO", "STRING", "CHAR", multi=True)).define(Field("MARK", "INVISIBLE", "CHAR"))
    return files.apply_deferred(f, spark.read.parquet(path)).frame.select(F.col(RECNUM).alias("id"), F.array_join("ORDERNO", ",").alias("orders"))


@register("deferred_single_step", "SELECT DISTINCT c_custkey AS id, c_name FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P'")
def deferred_single_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = context(spark, sf_dir, "customer")
    f = c.members[0].define(Field("ORDERNO", "STRING", "CHAR", multi=True)).define(Field("MARK", "INVISIBLE", "CHAR"))
    return shown(c.with_file(files.apply_deferred(f, files.deferred_updates(_deferred(spark, sf_dir)))).find_filed("MARK", "PENDING"), "C_NAME")


@register("reorganize", "SELECT CAST(row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS BIGINT) AS id, p_partkey, p_name FROM part")
def reorganize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(files.reorganize(file(spark, sf_dir, "part"), ["P_NAME", "P_PARTKEY"]).frame, "P_PARTKEY", "P_NAME")


@register("fixed_records", "SELECT p_partkey AS id, p_name AS name FROM part")
def fixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = checkpoints.new_path(spark)
    lines = read(spark, sf_dir, "part").select(F.concat(F.lpad(F.col("p_partkey").cast("string"), 10, "0"), "p_name").alias("line"))
    files.write_lines(lines, path, lrecl=60)
    return files.read_fixed(spark, path, [("ID", 1, 10), ("NAME", 11, 50)]).select(F.col("ID").cast("long").alias("id"), F.col("NAME").alias("name"))


@register("fixed_records_no_line_ends", "SELECT p_partkey AS id, rtrim(left(p_name, 5)) AS name FROM part")
def fixed_records_no_line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = checkpoints.new_path(spark)
    record = F.concat(F.lpad(F.col("p_partkey").cast("string"), 10, "0"), F.rpad(F.left("p_name", F.lit(5)), 9, " "), F.lit("|"))
    read(spark, sf_dir, "part").select(record.alias("value")).write.option("lineSep", "|").text(path)
    # each record is followed by the separator: 21 bytes in all
    return files.read_fixed(spark, path, [("ID", 1, 10), ("NAME", 11, 9)], lrecl=21).select(F.col("ID").cast("long").alias("id"), F.col("NAME").alias("name"))


@register("audit_appended", "SELECT event_id AS id, event_type AS line FROM events WHERE event_type IN ('click', 'purchase')")
def audit_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, events = checkpoints.new_path(spark), read(spark, sf_dir, "events")
    for kind in ("click", "purchase"):
        files.audit_append(events.where(F.col("event_type") == kind).select("ts", F.concat_ws(":", "event_id", "event_type").alias("line")), path)
    lines = files.audit_extract(spark.read.parquet(path), most=None)
    return lines.select(F.substring_index("line", ":", 1).cast("long").alias("id"), F.substring_index("line", ":", -1).alias("line"))


@register("fast_load", "SELECT CAST(row_number() OVER (ORDER BY c_name) - 1 AS BIGINT) AS id, c_custkey AS old, c_name FROM customer")
def fast_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = file(spark, sf_dir, "customer")
    loaded, reference = files.fast_load(f.with_frame(f.frame.where("false")), files.unload_data(f), ["C_NAME"])
    return loaded.frame.join(reference, RECNUM).select(F.col(RECNUM).alias("id"), F.col("_old_recnum").alias("old"), F.col("C_NAME").alias("c_name"))


@register("audit_extract", "SELECT event_id AS id, props AS line FROM events WHERE ts > TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' AND contains(upper(props), 'K')")
def audit_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select("event_id", "ts", F.col("props").alias("line"))
    return files.audit_extract(log, "2024-01-02 00:00:00", "2024-01-20 00:00:00", "k", any_case=True, most=None).select(F.col("event_id").alias("id"), "line")


@register("criterion_counts", "SELECT 'O_ORDERSTATUS EQ F' AS criterion, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders UNION ALL SELECT 'O_TOTALPRICE GT 200000', count(*) FILTER (o_totalprice > 200000) FROM orders")
def criterion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.criterion_counts(context(spark, sf_dir, "orders"), "O_ORDERSTATUS = F AND NOT O_TOTALPRICE GT 200000")


@register("index_analysis", "SELECT count(*) AS n_values, CAST(sum(n) AS BIGINT) AS n_entries, min(n) AS shortest, sum(n) / count(*) AS mean, max(n) AS longest, CAST(count(*) FILTER (n = 1) AS BIGINT) AS n_singles FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def index_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.index_analysis(context(spark, sf_dir, "orders").find(), "O_CUSTKEY")


@register("open_contexts", "SELECT * FROM (VALUES ('PARTY', 'TEMP', 0, 'CUSTOMER', true), ('PARTY', 'TEMP', 1, 'SUPPLIER', false)) AS t(name, kind, place, member, takes_updates)")
def open_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.context import Engine

    engine = Engine(spark)
    for table in ("customer", "supplier"):
        engine.create(table.upper(), [Field("NAME")])
    engine.create_group("PARTY", ["CUSTOMER", "SUPPLIER"], "CUSTOMER")
    engine.create_group("PARTY", ["SUPPLIER"], kind="PERM")
    return engine.display_group("PARTY").drop("n_fields")


@register("initialized", "SELECT 0 AS n, 3 AS n_fields")
def initialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.context import Engine

    engine = Engine(spark)
    engine.allocate(file(spark, sf_dir, "nation"))
    cleared = engine.initialize("NATION")
    return cleared.frame.agg(F.count("*").cast("int").alias("n")).withColumn("n_fields", F.lit(len(cleared.fields)))


#: What the engine refuses, by name.
_REFUSED = ("a bad lock", "a file that is open", "a find of values by EQ", "a group without an update file", "a pattern on a numeric index", "a scan beyond MBSCAN", "a set of another context", "a sort by an invisible field", "a sort by one field twice", "a sort without keys", "an update of a read-only file")


@register("refusals", f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)}, true)' for x in _REFUSED)}) AS t(what, refused)")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    from ..operators.context import Engine
    from ..operators.predicate import PredicateError
    from ..operators.sets import SetError
    from .catalog import CatalogError

    engine = Engine(spark)
    engine.allocate(file(spark, sf_dir, "part", index={"P_TYPE": "NONE"}).define(Field("MARK", "INVISIBLE", "CHAR")))
    engine.allocate(file(spark, sf_dir, "nation"))
    engine.create_group("BOTH", ["PART", "NATION"])
    c, nations = engine.open("PART"), engine.open("NATION")
    attempts = {
        "a bad lock": lambda: c.find("P_SIZE = 7", lock="SOME"), "a file that is open": lambda: engine.free("PART"), "a find of values by EQ": lambda: c.find_values("P_SIZE", "EQ", 7),
        "a group without an update file": lambda: engine.open("GROUP BOTH").store_record([("P_NAME", "x")]), "a pattern on a numeric index": lambda: c.find_values("P_SIZE", "LIKE", "1*"),
        "a scan beyond MBSCAN": lambda: replace(c, mbscan=10).find("P_TYPE = X"), "a set of another context": lambda: c.find(in_set(nations.find())), "a sort by an invisible field": lambda: c.find().sort("MARK"),
        "a sort by one field twice": lambda: c.find().sort("P_SIZE", SortKey("P_SIZE", descending=True)), "a sort without keys": lambda: c.find().sort(), "an update of a read-only file": lambda: replace(c, read_only=True).store_record([("P_NAME", "x")]),
    }

    def refused(attempt: Callable) -> bool:
        try:
            attempt()
        except (CatalogError, PredicateError, SetError):
            return True
        return False

    return spark.createDataFrame([(what, refused(attempt)) for what, attempt in attempts.items()], "what string, refused boolean")


@register("locked_found_set", "SELECT count(*) AS n, 'EXCL' AS lock, 'NONE' AS released FROM nation")
def locked_found_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context(spark, sf_dir, "nation").find(lock="EXCL")
    return found.count().select("n", F.lit(found.lock).alias("lock"), F.lit(found.unlock().lock).alias("released"))


@register("parameters_view", "SELECT * FROM (VALUES ('MAXRECNO', '16777215'), ('MBSCAN', '500'), ('STRICTNUM', '0')) AS t(name, value)")
def parameters_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    parameters = admin.Parameters()
    parameters.reset("MBSCAN", "500")
    return parameters.frame(spark)


@register("statistics_view", "SELECT 'FINDS' AS name, 2 AS n UNION ALL SELECT 'RECDS', count(*) FROM region UNION ALL SELECT 'SORTS', 1")
def statistics_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.context import Engine

    engine = Engine(spark)
    engine.allocate(file(spark, sf_dir, "region"))
    c = engine.open("REGION")
    c.find("R_NAME LIKE A*").sort("R_NAME")
    for _ in c.find().cursor():
        pass
    return engine.statistics.frame(spark).where("n > 0")


# --- functions -----------------------------------------------------------------------------------


@register("convert_numbers", f"WITH {NUMERIC_TEXT_SQL} SELECT id, num, coalesce(num, 0) AS num0 FROM numtext")
def convert_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric_text(spark, sf_dir).frame.select(F.col(RECNUM).alias("id"), V.to_num(F.col("TXT")).alias("num"), V.num_or_zero(F.col("TXT")).alias("num0"))


@register("round_numbers", "SELECT o_orderkey AS id, CAST(format('{:.14e}', o_totalprice / 7) AS DOUBLE) AS r15, CAST(trunc(o_totalprice / 100) AS BIGINT) AS t, CAST(round(o_totalprice / 100) AS BIGINT) AS r, CAST(ceil(o_totalprice / 100) AS BIGINT) AS u FROM orders")
def round_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), V.r15(p / 7).alias("r15"), V.truncated(p / 100).alias("t"), V.nearest(p / 100).alias("r"), V.away_from_zero(p / 100).alias("u"))


@register("show_numbers", "SELECT c_custkey AS id, regexp_replace(regexp_replace(CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS VARCHAR), '0+$', ''), '\\.$', '') AS shown FROM customer WHERE c_acctbal <> 0")
def show_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").where("c_acctbal <> 0").select(F.col("c_custkey").alias("id"), V.num_to_str(F.col("c_acctbal")).alias("shown"))


@register("pad_strings", "SELECT p_partkey AS id, rpad(p_name, 12, '.') AS r, lpad(right(p_name, 6), 6, '.') AS l, lpad(CAST(p_size AS VARCHAR), 4, '0') AS z, regexp_replace(trim(p_name), ' +', ' ', 'g') AS u FROM part")
def pad_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), V.pad_right(n, 12, ".").alias("r"), V.pad_left(n, 6, ".").alias("l"), V.zero_pad(F.col("p_size"), 4).alias("z"), V.unblank(n).alias("u"))


@register("prefix_bound", f"SELECT p_partkey AS id, p_name FROM part WHERE p_name >= 're' AND p_name < '{V.next_string('re')}'")
def prefix_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where(like(F.col("p_name"), "re*")).select(F.col("p_partkey").alias("id"), "p_name")


@register("round_places", "SELECT c_custkey AS id, round(c_acctbal, 1) AS nearest, trunc(c_acctbal) AS cut, sign(c_acctbal) * ceil(abs(c_acctbal)) AS up FROM customer")
def round_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), V.round_places(x, 1).alias("nearest"), V.round_places(x, 0, "trunc").alias("cut"), V.round_places(x, 0, "up").alias("up"))


@register("hex_strings", "SELECT p_partkey AS id, hex(p_name) AS h, p_name AS back, upper(to_hex(p_partkey)) AS n, p_partkey AS number FROM part")
def hex_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("p_name"), F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("id"), V.string_to_hex(n).alias("h"), V.hex_to_string(V.string_to_hex(n)).alias("back"), V.int_to_hex(k).alias("n"), V.hex_to_int(V.int_to_hex(k)).alias("number"))


@register("string_helpers", "SELECT p_partkey AS id, reverse(p_name) AS r, translate(p_name, 'e', 'E') AS c, replace(p_name, 're', '-') AS s, CASE WHEN length(p_name) > 8 THEN left(p_name, 5) || '...' ELSE rpad(p_name, 8, ' ') END AS e, format('{:,}', p_partkey) AS t FROM part")
def string_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), V.reverse(n).alias("r"), V.replace_char(n, "e", "E").alias("c"), V.replace_string(n, "re", "-").alias("s"), V.pad_or_elide(n, 8).alias("e"), V.thousands_text(F.col("p_partkey").cast("string")).alias("t"))


@register("string_words", "WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents) SELECT doc_id AS id, coalesce(w[2], '') AS second, CAST(len(w) AS INTEGER) AS n FROM w")
def string_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), V.word(t, 2).alias("second"), V.word_count(t).alias("n"))


@register("ebcdic_text", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name FROM nation")
def ebcdic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), V.from_ebcdic(V.to_ebcdic(F.col("n_name"))).alias("n_name"))
