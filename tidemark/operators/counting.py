"""Places and order statistics by counting, for groups that grow with the data.

A window over a whole group sorts it in one task. Here a group is cut into buckets of its value, the rows of every bucket are
counted, and running sums over the buckets give the place of each bucket's first row; only the rows of one bucket are
sorted together. Values are numbers; nulls have no place. The grouping columns must not be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidemark.sources.shared import kept

STEPS = 1024  # buckets for each doubling of 1 + |value|


def _bucket(value: Column, steps: int = STEPS) -> Column:
    v = value.cast("double")
    return (F.signum(v) * F.floor(F.log2(1 + F.abs(v)) * steps)).cast("long")


def placed(rows: DataFrame, by: list[str], value: str, *ties: str) -> DataFrame:
    """``rows`` with place (from 0, by value and ``ties``) and of (rows of the group)."""
    df = rows.where(F.col(value).isNotNull()).withColumn("bucket_", _bucket(F.col(value)))
    counts = df.groupBy(*by, "bucket_").agg(F.count("*").alias("here_"))
    group = Window.partitionBy(*by)
    counts = counts.select(*by, "bucket_", (F.sum("here_").over(group.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here_")).alias("before_"), F.sum("here_").over(group).alias("of"))
    inside = F.row_number().over(Window.partitionBy(*by, "bucket_").orderBy(value, *ties)) - 1
    return df.join(counts, [*by, "bucket_"]).withColumn("place", F.col("before_") + inside).drop("bucket_", "before_")


def medians(rows: DataFrame, by: list[str], value: str, to: str = "mid", share: float = 0.5) -> DataFrame:
    """The exact median of each group, or another quantile (between two values by their distances), and its n.

    Equal values are counted before anything is dealt by bucket, so a value that most rows share is one row; only the buckets
    in which the middle lies are looked into.
    """
    at = lambda place: (F.col("before_") <= place) & (F.col("before_") + F.col("here_") > place)
    at_share = (F.col("of") - 1) * share
    low, high = F.floor(at_share), F.ceil(at_share)
    group = Window.partitionBy(*by)
    upto = lambda w, x: F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(x)
    values = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n_")).withColumn("bucket_", _bucket(F.col(value)))
    buckets = values.groupBy(*by, "bucket_").agg(F.sum("n_").alias("here_"))
    buckets = buckets.withColumn("before_", upto(group.orderBy("bucket_"), "here_")).withColumn("of", F.sum("here_").over(group)).where(at(low) | at(high))
    inside = values.join(buckets.select(*by, "bucket_", F.col("before_").alias("start_"), "of"), [*by, "bucket_"])
    inside = inside.withColumn("here_", F.col("n_")).withColumn("before_", F.col("start_") + upto(Window.partitionBy(*by, "bucket_").orderBy(value), "n_"))
    found = inside.where(at(low) | at(high)).groupBy(*by).agg(F.min(value).alias("least_"), F.max(value).alias("most_"), F.first("of").alias("n"), F.first("of").alias("of"))
    between = (F.col("least_") + F.col("most_")) / 2 if share == 0.5 else F.when(low == high, F.col("least_")).otherwise((high - at_share) * F.col("least_") + (at_share - low) * F.col("most_"))
    return found.select(*by, between.alias(to), "n")


def stored_medians(rows: DataFrame, by: list[str], value: str, weight: str, to: str = "mid") -> DataFrame:
    """What ``medians`` gives, for stored rows that are cheap to read twice, and groups that are few beside them; a row counts ``weight`` times.

    First the rows of each bucket are counted where they are read, then only the rows in the middle buckets, which are stored, are
    dealt, their equal values counted before. Rows of other buckets are never shuffled.
    """
    steps = STEPS if len(by) < 2 else STEPS // 8  # many groups have few rows each: so wide that tasks see a bucket often
    at = lambda place: (F.col("before_") <= place) & (F.col("before_") + F.col("here_") > place)
    low, high = F.floor((F.col("of") - 1) / 2), F.ceil((F.col("of") - 1) / 2)
    group = Window.partitionBy(*by)
    upto = lambda w, x: F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(x)
    df = rows.where(F.col(value).isNotNull()).select(*by, value, weight).withColumn("bucket_", _bucket(F.col(value), steps))
    buckets = df.groupBy(*by, "bucket_").agg(F.sum(weight).alias("here_"))
    buckets = buckets.withColumn("before_", upto(group.orderBy("bucket_"), "here_")).withColumn("of", F.sum("here_").over(group)).where(at(low) | at(high))
    buckets = kept(buckets.select(*by, "bucket_", F.col("before_").alias("start_"), "of"), "middle-buckets")  # stored, so that Spark knows how small it is
    inside = df.join(buckets, [*by, "bucket_"]).groupBy(*by, "bucket_", value).agg(F.sum(weight).alias("here_"), F.first("start_").alias("start_"), F.first("of").alias("of"))
    inside = inside.withColumn("before_", F.col("start_") + upto(Window.partitionBy(*by, "bucket_").orderBy(value), "here_"))
    found = inside.where(at(low) | at(high)).groupBy(*by).agg(F.min(value).alias("least_"), F.max(value).alias("most_"), F.first("of").alias("n"))
    return found.select(*by, ((F.col("least_") + F.col("most_")) / 2).alias(to), "n")


def sorted_medians(rows: DataFrame, by: list[str], values: list[str], also: tuple[Column, ...] = ()) -> DataFrame:
    """The exact median m_<value> and number n_<value> of each value in each group of ``by``, and the aggregates ``also``.

    For many groups, each a small part of the rows: rows are dealt once (not at all if they come dealt by some of ``by``) and
    sorted in their task, which may spill; no maps of values are built, shuffled or merged. For a few groups that hold most
    of the rows ``medians`` counts. Nulls have no place.
    """
    df = rows
    for v in values:
        group = Window.partitionBy(*by)
        df = df.withColumn(f"place_{v}", F.row_number().over(group.orderBy(F.col(v).asc_nulls_last())) - 1).withColumn(f"n_{v}", F.count(v).over(group))
    at = lambda v, place: F.when(F.col(f"place_{v}") == place, F.col(v))
    mid = lambda v: ((F.max(at(v, F.floor((F.col(f"n_{v}") - 1) / 2))) + F.max(at(v, F.floor(F.col(f"n_{v}") / 2).cast("long")))) / 2).alias(f"m_{v}")
    return df.groupBy(*by).agg(*[mid(v) for v in values], *[F.max(f"n_{v}").alias(f"n_{v}") for v in values], *also)


def others_median(rows: DataFrame, keys: list[str], own: str, value: str, least: int) -> DataFrame:
    """For each cell (``keys``) and each ``own`` in it: others (rows of the cell that aren't its own) and their exact median.

    Cells with fewer than ``least`` such rows give none. No cell's values are gathered: a row of the cell has a place, and the
    k-th of the others is at place k plus the own rows that come before it.
    """
    df = placed(rows.select(*keys, own, value), keys, value, own)
    mine = Window.partitionBy(*keys, own)
    # Others before this row, and the places of the two middle ones among the others.
    df = df.withColumn("mine_", F.count("*").over(mine)).withColumn("before_", F.col("place") - (F.row_number().over(mine.orderBy("place")) - 1))
    others = F.col("of") - F.col("mine_")
    low, high = F.floor((others - 1) / 2), F.floor(others / 2)
    at = df.where(others >= least).groupBy(*keys, own).agg(F.first(others).alias("others"), (F.first(low) + F.count_if(F.col("before_") <= low)).alias("low"), (F.first(high) + F.count_if(F.col("before_") <= high)).alias("high"))
    wanted = at.withColumn("place", F.explode(F.array_distinct(F.array("low", "high"))))
    found = wanted.join(df.select(*keys, "place", value), [*keys, "place"])
    return found.groupBy(*keys, own).agg(F.first("others").alias("others"), ((F.min(value) + F.max(value)) / 2).alias("mid"))


CELL_ROWS = 200_000  # rows of a cell that a task may hold


def _medians_of_others(cell: np.ndarray, own: np.ndarray, value: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of rows of its cell that aren't its own's, and their median (NaN and 0 for fewer than ``least``)."""
    order = np.lexsort((own, value, cell))
    c, v = cell[order], value[order]
    index = np.arange(len(c))
    new = np.concatenate([[True], c[1:] != c[:-1]])
    first = np.maximum.accumulate(np.where(new, index, 0))
    size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
    # Rows by cell and own, in order of their places: how many others come before each.
    mine = np.lexsort((index, own[order], c))
    pair = np.concatenate([[True], (c[mine][1:] != c[mine][:-1]) | (own[order][mine][1:] != own[order][mine][:-1])])
    starts = np.flatnonzero(pair)
    of = np.cumsum(pair) - 1
    many = np.diff(np.concatenate([starts, [len(c)]]))
    before = (mine - first[mine]) - (index - starts[of])
    others = size[mine][starts] - many
    middle = [(others - 1) // 2, others // 2]
    enough = others >= max(1, least)
    at = [np.where(enough, first[mine][starts] + m + np.add.reduceat(before <= m[of], starts), 0) for m in middle]
    n, mid = np.empty(len(c), np.int64), np.empty(len(c))
    n[order[mine]] = np.where(enough, others, 0)[of]
    mid[order[mine]] = np.where(enough, (np.minimum(v[at[0]], v[at[1]]) + np.maximum(v[at[0]], v[at[1]])) / 2, np.nan)[of]
    return n, mid


def with_others_median(rows: DataFrame, by: list[str], tiers: dict[str, tuple[str, ...]], own: str, value: str, least: int, cell_rows: int = CELL_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` with n<tier> and m<tier>: how many rows of the same cell aren't of the same ``own``, and their median.

    A tier's cell is what agrees in its columns; all tiers have the columns ``by``, so that rows are dealt once for all of them.
    Both are null where there are fewer than ``least`` such rows, and for rows without a value, which count for nobody. Tasks hold
    one cell of ``by`` at a time, of ``cell_rows`` rows at most; the rows of larger ones are found by counting (``others_median``).
    Cells are counted on ``counted``, which has the same rows in a form that is cheaper to read; ``rows`` are then stored only if
    there are large cells.
    """
    names = list(rows.columns)
    added = [pa.field(f"{x}{t}", pa.int64() if x == "n" else pa.float64()) for t in tiers for x in "nm"]

    def codes(table: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
        at = np.zeros(len(table), np.int64)
        for c in columns:
            one = table[c].combine_chunks().dictionary_encode()
            at = np.unique(at * (len(one.dictionary) + 1) + one.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1].reshape(-1)
        return at

    def cells(table: pa.Table) -> pa.Table:
        v = table[value].to_numpy().astype(float)
        there = ~np.isnan(v)
        who = codes(table, (own,))
        for t, columns in tiers.items():
            n, mid = np.zeros(len(v), np.int64), np.full(len(v), np.nan)
            if there.any():
                n[there], mid[there] = _medians_of_others(codes(table, columns)[there], who[there], v[there], least)
            table = table.append_column(f"n{t}", pa.array(n, mask=np.isnan(mid))).append_column(f"m{t}", pa.array(mid, mask=np.isnan(mid)))
        return table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < 50_000:
                continue
            table = pa.Table.from_batches(held)
            same = np.ones(len(table), bool)
            for c in by:
                same &= pc.equal(table[c], table[c][-1]).to_numpy()
            cut = len(table) - int(same.sum())  # rows come by cell, so the last cell is at the end
            held = table.slice(cut).to_batches()
            if cut:
                yield from cells(table.slice(0, cut)).to_batches()
        if held:
            yield from cells(pa.Table.from_batches(held)).to_batches()

    schema = StructType([*rows.schema.fields, *[StructField(f.name, LongType() if f.name[0] == "n" else DoubleType()) for f in added]])
    large = (rows if counted is None else counted).groupBy(*by).agg(F.count("*").alias("rows_")).where(F.col("rows_") > cell_rows).select(*by)
    hot = not large.isEmpty()
    if hot and counted is not None:
        rows = kept(rows, "cells")
    small = rows.join(large, by, "left_anti").select(*names) if hot else rows
    out = small.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)
    if not hot:
        return out
    rest = rows.join(large, by, "left_semi").select(*names)
    for t, columns in tiers.items():
        found = others_median(rest, list(columns), own, value, least).withColumnsRenamed({"others": f"n{t}", "mid": f"m{t}"})
        rest = rest.join(found, [*columns, own], "left")
        rest = rest.withColumns({f"{x}{t}": F.when(F.col(value).isNotNull(), F.col(f"{x}{t}")) for x in "nm"})
    return out.unionByName(rest.select(*out.columns))
