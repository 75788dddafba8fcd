"""The driver's tables as files of the record engine, and the fixtures derived from them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.context import Context, Engine
from .catalog import RECNUM, FileDef

KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "nation": "n_nationkey", "region": "r_regionkey", "pages": "page_id", "benchmark": "item_id"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def file(spark: SparkSession, sf_dir: str, table: str, **kw) -> FileDef:
    return FileDef.over(table.upper()[:8], read(spark, sf_dir, table), KEYS[table], **kw)


def context(spark: SparkSession, sf_dir: str, table: str, **kw) -> Context:
    return Context(table.upper()[:8], (file(spark, sf_dir, table, **kw),))


def orders_mv(spark: SparkSession, sf_dir: str) -> FileDef:
    """One record per order; its lines are repeated fields (missing for orders without lines)."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    orders = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    frame = orders.select(
        F.col("o_orderkey").alias(RECNUM), F.col("o_orderstatus").alias("STATUS"), F.col("o_orderpriority").alias("PRIORITY"), F.col("o_totalprice").alias("PRICE"),
        F.col("lines.l_quantity").alias("QTY"), F.col("lines.l_returnflag").alias("FLAG"), F.col("lines.l_partkey").alias("PART"),
    )
    return FileDef.over("ORDERSMV", frame)


ORDERS_MV_SQL = """
lines AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS qty, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS flag,
  list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS part FROM lineitem GROUP BY l_orderkey),
mv AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price, qty, flag, part FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey)
"""


def customer_sparse(spark: SparkSession, sf_dir: str) -> FileDef:
    """Customers of whom every seventh has no segment and every eleventh no balance."""
    c = read(spark, sf_dir, "customer")
    frame = c.select(
        F.col("c_custkey").alias(RECNUM), F.col("c_name").alias("NAME"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("SEGMENT"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal")).alias("BAL")
    )
    return FileDef.over("CUSTSP", frame)


CUSTOMER_SPARSE_SQL = """
sparse AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS bal FROM customer)
"""


def numeric_text(spark: SparkSession, sf_dir: str) -> FileDef:
    """Strings that are, nearly are, or aren't numbers."""
    texts = F.array(*(F.lit(t) for t in ("7", " 7 ", "+007", "- 5", "1E2", "1D2", "abc", "")))
    frame = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias(RECNUM), F.get(texts, (F.col("c_custkey") % 8).cast("int")).alias("TXT"))
    return FileDef.over("NUMTEXT", frame)


NUMERIC_TEXT_SQL = """
numtext AS (SELECT c_custkey AS id, (['7', ' 7 ', '+007', '- 5', '1E2', '1D2', 'abc', ''])[c_custkey % 8 + 1] AS txt, ([7.0, 7.0, 7.0, -5.0, 100.0, NULL, NULL, 0.0])[c_custkey % 8 + 1] AS num FROM customer)
"""


def parties(spark: SparkSession, sf_dir: str) -> Context:
    """Group of customers and suppliers; only customers have a segment."""
    engine = Engine(spark)
    names = {"c_name": "NAME", "c_nationkey": "NATION", "c_acctbal": "ACCTBAL", "c_mktsegment": "SEGMENT", "s_name": "NAME", "s_nationkey": "NATION", "s_acctbal": "ACCTBAL"}
    for table in ("customer", "supplier"):
        engine.allocate(replace(file(spark, sf_dir, table, rename=names), name=table.upper()))
    engine.create_group("PARTY", ["CUSTOMER", "SUPPLIER"], "CUSTOMER")
    return engine.open("GROUP PARTY")


PARTIES_SQL = """
party AS (SELECT 0 AS ix, c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
  UNION ALL SELECT 1, s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier)
"""
