"""Benchmark decontamination with DataFrame functions only.

The benchmark's windows of eight consecutive normalised words form a small hash table; every window
of every training text is probed against it.  A window is first tried word by word against the hash set of
the benchmark's words (a window with a foreign word cannot match), and what is left is joined as whole
strings, so a hit is verified by the probe itself and no hash collision can pass.

What is broadcast is counted first.  Up to ``MAX_BROADCAST_WINDOWS`` windows the table itself is sent.
Beyond, 64-bit hashes of the windows are, ``MAX_BROADCAST_HASHES`` at a time; a window of a text whose hash
none of them has is dropped where it stands, and only what is left is shuffled and joined as strings.  So
the texts' windows never go through a shuffle, however large the benchmark.  The word set is used up to
``MAX_BROADCAST_WORDS`` words; it saves time only.

Rows are named by id and two hashes of the text, and equal ones counted by partition, so that a task run
again names them alike whatever order it reads them in.  Defined results: a null or word-less text has no words, no
hits, and the digest of the empty string; a null doc_id stays null; an item without words or id never
matches; an item of fewer than eight words is one window of its own length; ties (equal windows of several
items) count for each of them; a very long text is scanned whole, its windows as rows of their own;
repeated document rows each give one row; an empty table on either side gives no hits.  Extra columns of
the inputs are ignored (and kept by :func:`remove_leaks`).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fresh

WINDOW = 8
MIN_ITEMS = 2
#: Broadcast only below this many windows (about 100 bytes each).
MAX_BROADCAST_WINDOWS = 500_000
#: Hashes sent at a time (about 25 bytes each).
MAX_BROADCAST_HASHES = 4_000_000
#: The word set is part of the plan, so it is sent only up to this many words (about 10 bytes each).
MAX_BROADCAST_WORDS = 100_000
_SEPARATORS = "".join(chr(i) for i in range(128) if not chr(i).isalnum() and chr(i) not in UPPER + LOWER)


def words_of(text: Column) -> Column:
    """Words of a text: ASCII letters lower-cased, runs of ASCII non-alphanumerics separate."""
    flat = F.translate(text, UPPER + _SEPARATORS, LOWER + " " * len(_SEPARATORS))
    return F.coalesce(F.filter(F.split(flat, " "), lambda w: w != ""), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, width, items): each distinct window with the sorted ids of its items."""
    words = benchmark.select(F.col("item_id").cast("string").alias("__item"), words_of(F.col("text")).alias("__w"))
    words = words.where(F.col("__item").isNotNull() & (F.size("__w") > 0))
    words = words.withColumn("__width", F.least(F.size("__w"), F.lit(window)))
    spread = words.select("__item", "__width", F.explode(_windows(F.col("__w"), F.col("__width"))).alias("__win"))
    return spread.groupBy(F.col("__win.text").alias("window")).agg(F.first("__width").alias("width"), F.sort_array(F.collect_set("__item")).alias("items"))


def _windows(words: Column, width: Column) -> Column:
    """Array of (pos, text) of all windows of ``width`` words, empty if there are fewer words."""
    return F.when(
        F.size(words) >= width,
        F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", F.slice(words, i + 1, width)).alias("text"))),
    ).otherwise(F.array().cast("array<struct<pos:int,text:string>>"))


def _candidates(words: Column, known: Column, width: int) -> Column:
    """As :func:`_windows`, less those with a word that is not ``known`` (an array of booleans)."""
    order = sorted(range(width), key=lambda k: (k % 4 != 3, k))  # spread out: neighbours tell less

    def inside(i: Column) -> Column:
        return reduce(and_, (F.get(known, i + k) for k in order))

    starts = F.when(F.size(known) >= width, F.filter(F.sequence(F.lit(0), F.size(known) - width), inside)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", F.slice(words, i + 1, width)).alias("text")))


def scan(docs: DataFrame, benchmark: DataFrame, keys: list[str], window: int = WINDOW) -> DataFrame:
    """Rows of ``keys`` (columns of ``docs``), copies, n_words, hit_positions and items: one for each value of
    the keys in each partition of ``docs``, so that a row with very many copies is still several.

    A marker for each row makes texts without hits keep theirs.
    """
    table = item_windows(benchmark, window)
    counted = table.groupBy("width").count().collect()  # at most one row per width up to the window
    n_windows, widths = sum(r["count"] for r in counted), sorted({r["width"] for r in counted} | {window})
    words = docs.select(*keys, F.spark_partition_id().alias("__part"), words_of(F.col("text")).alias("__w"))
    sized = [*keys, "__part", F.size("__w").alias("__n")]
    vocabulary = benchmark.select(F.explode(words_of(F.col("text"))).alias("w")).distinct()
    known = [r["w"] for r in vocabulary.limit(MAX_BROADCAST_WORDS + 1).collect()]
    if len(known) <= MAX_BROADCAST_WORDS:
        tried = words.withColumn("__known", F.transform("__w", lambda w: w.isin(known)) if known else F.transform("__w", lambda _: F.lit(False)))
        windows = [_candidates(F.col("__w"), F.col("__known"), k) for k in widths]
    else:
        tried, windows = words, [_windows(F.col("__w"), F.lit(k)) for k in widths]
    copies = F.sum((F.col("__pos") < 0).cast("long")).alias("copies")
    if n_windows <= MAX_BROADCAST_WINDOWS:
        marker = F.array(F.struct(F.lit(-1).alias("pos"), F.lit("").alias("text")))
        spread = tried.select(*sized, F.explode(F.concat(marker, *windows)).alias("__win"))
        hits = _flat(spread, [*keys, "__part", "__n"]).join(F.broadcast(table), "window", "left").where((F.col("__pos") < 0) | F.col("width").isNotNull())
        grouped = hits.groupBy(*keys, "__part").agg(copies, F.max("__n").alias("n_words"), *_found())
    else:
        spread = _flat(tried.select(*keys, F.explode(F.concat(*windows)).alias("__win")), keys).withColumn("__h", F.xxhash64("window"))
        blocks, hashes = -(-n_windows // MAX_BROADCAST_HASHES), table.select(F.xxhash64("window").alias("__h"))
        left = [spread.join(F.broadcast(hashes.where(F.pmod("__h", F.lit(blocks)) == b)), "__h", "left_semi") for b in range(blocks)]
        found = reduce(DataFrame.unionByName, left).join(table, "window").groupBy(*keys).agg(*_found())
        sizes = words.select(*sized).groupBy(*keys, "__part").agg(F.count("*").alias("copies"), F.max("__n").alias("n_words"))
        own, none = found.toDF(*(f"{k}_" for k in keys), "ranges", "items"), F.array()
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys))
        joined = sizes.join(own, same, "left").drop(*(f"{k}_" for k in keys))
        grouped = joined.withColumns({"ranges": F.coalesce("ranges", none.cast("array<struct<pos:int,width:int>>")), "items": F.coalesce("items", none.cast("array<string>"))})
    covered = F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.sequence(r["pos"], r["pos"] + r["width"] - 1))))
    return grouped.select(*keys, "copies", F.col("n_words").cast("long").alias("n_words"), covered.alias("hit_positions"), F.sort_array("items").alias("items"))


def _flat(spread: DataFrame, columns: list[str]) -> DataFrame:
    return spread.select(*columns, F.col("__win.pos").alias("__pos"), F.col("__win.text").alias("window"))


def _found() -> list[Column]:
    """The distinct ranges of words that are hit, and the items that hit them."""
    at = F.when(F.col("__pos") >= 0, F.struct(F.col("__pos").alias("pos"), F.col("width").alias("width")))
    return [F.collect_set(at).alias("ranges"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")]


def _text_hashes() -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64("text").alias("__h1"), F.xxhash64(F.lit(1), "text").alias("__h2")]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = scan(docs.select("doc_id", "text", *_text_hashes()), benchmark, ["doc_id", "__h1", "__h2"], window)
    rows = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(
        "doc_id", "n_words", F.size("hit_positions").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") >= min_items).alias("contaminated"),
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS) -> DataFrame:
    """``docs`` without contaminated rows; where fewer items leak, their words are cut out.

    Texts without a hit come back unchanged.  Only rows with hits are joined back, by id and text
    hashes, so the join's small side holds leaking documents only.
    """
    keyed = docs.select("text", F.col("doc_id").alias("__id"), *_text_hashes())
    hits = scan(keyed, benchmark, ["__id", "__h1", "__h2"], window).where(F.size("hit_positions") > 0)
    names = [fresh(f"__leak_{k}", docs.columns) for k in ("id", "h1", "h2", "at", "items")]
    hits = hits.dropDuplicates(["__id", "__h1", "__h2"]).select("__id", "__h1", "__h2", "hit_positions", F.size("items")).toDF(*names)
    leak_id, leak_h1, leak_h2, leak_at, leak_items = (F.col(c) for c in names)
    same = F.col("doc_id").eqNullSafe(leak_id) & (F.xxhash64("text") == leak_h1) & (F.xxhash64(F.lit(1), "text") == leak_h2)
    joined = docs.join(hits, same, "left").where(leak_items.isNull() | (leak_items < min_items))
    cut = F.when(leak_items.isNull(), F.col("text")).otherwise(_without(F.col("text"), leak_at))
    return joined.select(*((cut if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns))


def _without(text: Column, positions: Column) -> Column:
    """``text`` less the words at ``positions`` and the separators that follow them."""
    pieces = F.regexp_extract_all(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.array_contains(positions, i))
    head = F.regexp_extract(text, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    return F.concat(head, F.array_join(kept, ""))


_DUCK_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

ORACLE_SQL = f"""
WITH items AS (SELECT item_id, {_DUCK_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS width, unnest(list_transform(range(0, len(w) - least(len(w), 8) + 1), lambda i: array_to_string(w[i + 1 : i + least(len(w), 8)], ' '))) AS win
  FROM items WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS row_id, doc_id, {_DUCK_WORDS} AS w FROM documents),
widths AS (SELECT DISTINCT width FROM wins),
spread AS (
  SELECT row_id, width, unnest(range(0, len(w) - width + 1)) AS pos, unnest(list_transform(range(0, len(w) - width + 1), lambda i: array_to_string(w[i + 1 : i + width], ' '))) AS win
  FROM docs, widths WHERE len(w) >= width),
hits AS (SELECT s.row_id, s.pos, s.width, i.item_id FROM spread s JOIN wins i ON s.win = i.win AND s.width = i.width),
per AS (
  SELECT row_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS sha FROM hits GROUP BY row_id),
cover AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(pos, pos + width)) AS p FROM hits) GROUP BY row_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(p.n_items, 0) AS BIGINT) AS n_items,
       coalesce(p.sha, sha256('')) AS items_sha256, coalesce(p.n_items, 0) >= 2 AS contaminated
FROM docs d LEFT JOIN per p USING (row_id) LEFT JOIN cover c USING (row_id)
"""
