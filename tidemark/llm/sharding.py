"""Sharding by histogram sort (DataFrame operations only).

Rows are put in the order of a unique key, and cut into shards of near-equal bytes. The cuts (splitters) are found by
counting: the exact bytes of every key cell are summed across the partitions, the cells in which a cut falls are divided
into finer cells and counted again, until each cut lies within the tolerance of its target. Then the rows go to their
places in one exchange. A shard consists of many ranges, so no task holds a whole shard, and a row's slot is its rank in
its range plus the rows of the shard's earlier ranges.

The key is a string of hexadecimal digits: null flag and doc_id, a hash of the text, and a row number that is fixed when
the slim table is written. So it is unique: equal ids, equal texts and wholly equal rows can be cut anywhere, and a
third of all rows with one key does no harm. A null doc_id comes first; a null text counts as no bytes. An empty table
gives no rows. Extra columns of the input stay out of the slim table, so their names can't clash.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stash

OVERHEAD = 16  # bytes that each row adds to those of its text
TOLERANCE = 0.002  # of a range's target, for each cut
RANGE_BYTES = 64 << 20  # aimed at for a range
MIN_RANGES, MAX_RANGES = 8, 512  # of one shard
MANY_CELLS = 1000  # up to so many cells are divided into 256 parts each, more into 16
KEY_DIGITS = 1 + 16 + 16 + 16


def _hex(x: Column) -> Column:
    """16 digits in the order of the signed 64-bit number."""
    return F.lpad(F.hex(F.bitwise_not(x).bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))), 16, "0")


def slim_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key of every row, written once."""
    text = F.coalesce("text", F.lit(""))
    key = F.concat(F.when(F.col("doc_id").isNull(), "0").otherwise("1"), _hex(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long")), _hex(F.xxhash64(text)), _hex(F.monotonically_increasing_id()))
    return stash(docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key")), "shard-rows")


def _listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from one literal, so that neither Python workers nor local files are needed."""
    names = [x.split() for x in schema.split(", ")]
    text = "\n".join("\t".join(map(str, r)) for r in rows)
    lines = spark.range(1).select(F.explode(F.split(F.lit(text), "\n")).alias("line")).select(F.split("line", "\t").alias("x"))
    return lines.select(*[F.col("x")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(names)])


def find_splitters(rows: DataFrame, parts: int, total: int, first: str, last: str, tolerance: float = TOLERANCE) -> tuple[list[str], list[tuple[int, int, str]]]:
    """Key prefixes that cut ``rows`` into ``parts`` of near-equal size, and the cells that were divided (digits, digits of
    their parts, prefix).

    The driver sees cell sums only: at most 256 for each of MANY_CELLS cells or 16 for each of ``parts``.
    """
    targets = [total * k / parts for k in range(1, parts)]
    allowed = max(1.0, tolerance * total / parts)
    # The digits that all keys have in common need no counting.
    common = next((i for i, (a, b) in enumerate(zip(first, last, strict=True)) if a != b), KEY_DIGITS)
    digits, base, open_cells = common, {first[:common]: 0}, {first[:common]: targets}
    found: dict[float, str] = {}
    divided: list[tuple[int, int, str]] = []
    while open_cells:
        finer = min(KEY_DIGITS, digits + (2 if len(open_cells) <= MANY_CELLS else 1))
        divided += [(digits, finer, c) for c in open_cells]
        part = F.substring("key", 1, digits)
        # As many cells as targets are still open, at most.
        inside = rows.join(F.broadcast(_listed(rows.sparkSession, [(c,) for c in open_cells], "cell string")), part == F.col("cell"), "left_semi")
        sums = sorted(inside.groupBy(F.substring("key", 1, finer).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect())
        below, again = dict(base), {}
        base = {}
        for cell, size, n in sums:
            parent = cell[:digits]
            start, end = below[parent], below[parent] + size
            below[parent] = end
            left = []
            for t in open_cells[parent]:
                if t in found or not start < t <= end:
                    continue
                # A cell of one row can't be divided.
                if min(t - start, end - t) <= allowed or n == 1 or finer == KEY_DIGITS:
                    # A splitter is the first key of its right-hand side; "~" follows every digit.
                    found[t] = cell if t - start < end - t else cell + "~"
                else:
                    left.append(t)
            if left:
                again[cell], base[cell] = left, start
        digits, open_cells = finer, again
    return [found[t] for t in targets], divided


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Every row's shard (sizes near equal) and its slot there, gapless from 0 in the order of the key."""
    spark = docs.sparkSession
    rows = slim_rows(docs)
    n, total, first, last = rows.agg(F.count("*"), F.sum("size"), F.min("key"), F.max("key")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    ranges = min(MAX_RANGES, max(MIN_RANGES, math.ceil(total / shards / RANGE_BYTES)))
    cuts, divided = find_splitters(rows, shards * ranges, total, first, last)
    # Cells that were not divided lie in one range: a row's range follows from its finest counted cell.
    df = rows.withColumn("range", F.lit(None).cast("int"))
    open_at = {d: {c for e, _, c in divided if e == d} for d, _, _ in divided}
    for d, finer in sorted({(d, f) for d, f, _ in divided}):
        parts = (f"{cell}{k:0{finer - d}X}" for cell in open_at[d] for k in range(16 ** (finer - d)))
        cells = [(c, bisect_right(cuts, c)) for c in parts if c not in open_at.get(finer, ())]
        placed = _listed(spark, cells, "cell string, at int")
        # As bounded as what the driver has seen: 16 or 256 rows for each divided cell.
        df = df.join(F.broadcast(placed), F.substring("key", 1, finer) == F.col("cell"), "left").withColumn("range", F.coalesce("range", "at")).drop("cell", "at")
    df = stash(df.select("doc_id", "size", "text_crc32", "key", "range"), "shard-ranges")
    counts = {r: c for r, c in df.groupBy("range").count().collect()}
    starts = [(r, s, o) for s in range(shards) for r, o in zip(range(s * ranges, (s + 1) * ranges), accumulate([0] + [counts.get(k, 0) for k in range(s * ranges, (s + 1) * ranges)]), strict=False)]
    offsets = _listed(spark, starts, "range int, shard int, before long")
    rank = F.expr("row_number() OVER (PARTITION BY range ORDER BY key)")
    df = df.withColumn("rank", rank).join(F.broadcast(offsets), "range")
    return df.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
