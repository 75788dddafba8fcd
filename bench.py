"""Times the headline queries once each after a warm-up and prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) set the input and the cores.
Every query is run to its last row (a ``noop`` write), so nothing is pruned that a reader would get.
Orders with their lines as repeated fields are a fixture: they are built and written once, before the
queries over them are timed.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from sievebase.plans import catalogue, fixtures  # noqa: E402
from sievebase.sources import files  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "flagship", "find_eq", "find_and_or_not", "find_text", "find_like_placeholder", "find_any_occurrence", "find_set_semi", "group_find", "count_values", "value_histogram", "find_values",
    "sort_num_desc", "sort_each", "sort_topk", "list_place", "count_occurrences", "join_records", "add_field", "unload_pai", "index_unload", "fast_load", "find_like_nested", "deferred_multi_step",
]


def lineitem(spark: SparkSession):
    rows = fixtures.read(spark, SF_DIR, "lineitem").withColumnRenamed("l_orderkey", "_recnum")
    return fixtures.FileDef.over("LINEITEM", rows)


def write_orders_mv(spark: SparkSession, folder: str) -> None:
    made = fixtures.orders_mv(spark, SF_DIR)
    made.frame.write.parquet(f"{folder}/orders_mv")
    catalogue.orders_mv = lambda spark, sf_dir: made.with_frame(spark.read.parquet(f"{folder}/orders_mv"))


def fast_load_lineitem(spark: SparkSession):
    file = lineitem(spark)
    loaded, _ = files.fast_load(file.with_frame(file.frame.where("false")), files.unload_data(file), ["L_SHIPDATE", "L_PARTKEY"])
    return loaded.frame


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")  # all tasks run in this process
    spark.sparkContext.setCheckpointDir(f"{folder}/checkpoints")
    write_orders_mv(spark, folder)
    runs = {name: (lambda name=name: catalogue.QUERIES[name](spark, SF_DIR)) for name in HEADLINE}
    runs["unload_pai_lineitem"] = lambda: files.unload_pai(lineitem(spark))
    runs["index_unload_lineitem"] = lambda: files.unload_index(lineitem(spark), "L_SHIPDATE")
    runs["fast_load_lineitem"] = lambda: fast_load_lineitem(spark)
    seconds = {}
    for name, run in runs.items():
        for _ in range(2):  # the second run counts: code is compiled, files are known
            began = time.time()
            run().write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
