"""Mixing sources to target weights by Pareto order sampling.

Sources take their names' order (by code point, null last) and the weights 5, 2, 1, repeating. Together the mix takes
150 % of all words, shared by weight; a source's target stops at twice its words, and the excess is shared again by
weight until none is above (the capped sources are a prefix in the order of cap over weight, so one window finds them).

Within a source every document gets ``floor(target / words)`` whole copies for certain. For the rest, documents are ranked
by the odds of a random number over their inclusion odds (Pareto order sampling), and taken in that order up to the
number of words that is nearest to what is missing: a sample of fixed size in words. Inclusion probabilities are unequal:
they grow with the root of the document's words. The random number comes from an MD5 of seed and doc_id, so reruns agree.

The place where the sample ends is found by counting: words are summed by cells of the rank, then by finer cells within
the cell where the sample ends; only the rows of that last cell are sorted. So no task sees a whole source.

Null or empty texts have no words and are never taken; a null source is one source of its own. Texts count whole, however
long. Equal ids share their random number and keep the order of their sizes; of rows that are equal in id and size as many
are taken as the sample wants. An empty table gives no rows. What ``plan`` finds is one small row for each source, so texts
need not travel: ``apply`` decides where the rows are. Extra columns named as one of this module's own must be packed into
a struct (as ``sized`` leaves them out, op8 is not concerned).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, n_words, stash

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SEED = "mix-1"
CELL_BITS, LEVELS = 12, 2  # of the rank's 48 bits


def sized(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    return stash(docs.select(*[F.col(c) for c in keep], n_words(F.col("text")).alias("size")), "mix-sizes")


def _root() -> Column:
    return F.floor(F.sqrt(F.col("size"))).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, rooted and target of each source; one row for each source, so its windows are small."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(_root() * F.col("size")).alias("rooted"))
    place = "row_number() OVER (ORDER BY source NULLS LAST)"
    weight = f"element_at(array({', '.join(f'{w}D' for w in WEIGHTS)}), CAST(({place} - 1) % {len(WEIGHTS)} AS INT) + 1)"
    by = by.select("*", F.expr(weight).alias("weight"), (MOST * F.col("source_size")).alias("cap"))
    order = "ORDER BY cap / weight, source NULLS LAST"
    by = by.select(
        "*",
        F.expr(f"sum(cap) OVER ({order} ROWS UNBOUNDED PRECEDING) - cap").alias("capped"),
        F.expr(f"sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)").alias("rest"),
        F.expr(f"{SHARE}D * sum(source_size) OVER ()").alias("all"),
    )
    # If all sources before this one are capped, what is left gives each weight so many words; the first that stays below its cap, where that is most, sets the level.
    level = F.expr("max(CASE WHEN (all - capped) / rest <= cap / weight THEN (all - capped) / rest END) OVER ()")
    return by.select("source", "source_size", "rooted", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def _order(size: str = "size") -> Column:
    """Where a row comes in its source's drawing; rows that are equal here are alike for it."""
    return F.struct(F.col("rank"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("id"), F.col(size).cast("long").alias("size"))


def _ranked(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """``sizes`` with the goal of their source, and the rank in which they are drawn (null: never)."""
    # One row for each source; Spark broadcasts it below its own limit and else joins by shuffle.
    df = sizes.withColumnRenamed("source", "of").join(goal, F.col("of").eqNullSafe(F.col("source")), "left").drop("source").withColumnRenamed("of", "source")
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / 2**52
    pi = F.least(F.lit(0.999999), F.col("missing") * _root() / F.greatest(F.col("rooted"), F.lit(1)))
    ratio = (u / (1 - u)) / (pi / (1 - pi))
    # The ratio's order in 48 bits; equal ranks go by doc_id and size.
    return df.withColumn("rank", F.when(pi > 0, F.floor(ratio / (1 + ratio) * 2**48).cast("long")))


def plan(sizes: DataFrame) -> DataFrame:
    """One row for each source: source_size, target, whole copies, and where its drawing ends: rows up to ``upto`` are taken,
    of those that equal it only ``ties`` of ``equal`` rows. ``upto`` is null if all rows with a rank are taken, or none."""
    goal = targets(sizes).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    # Words that the sample adds, at most all of them; whole numbers, so sums don't depend on their order.
    goal = goal.withColumn("missing", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    goal = stash(goal, "mix-goal")
    drawn = stash(_ranked(sizes.select("source", "doc_id", "size"), goal).where(F.col("rank").isNotNull()).select("source", "rank", "size", "missing", "doc_id"), "mix-ranks")
    at = drawn.withColumn("before", F.lit(0).cast("long"))
    end = None
    for level in range(1, LEVELS + 1):
        cell = F.shiftright("rank", 48 - level * CELL_BITS)
        if end is not None:
            up = end.select(F.col("source").alias("s"), F.col("cell").alias("c"), F.col("before").alias("b"))
            at = drawn.join(up, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("rank", 48 - (level - 1) * CELL_BITS) == F.col("c"))).withColumn("before", F.col("b"))
        sums = at.withColumn("cell", cell).groupBy("source", "cell", "missing", "before").agg(F.sum("size").alias("size"))
        below = F.expr("before + sum(size) OVER (PARTITION BY source ORDER BY cell ROWS UNBOUNDED PRECEDING) - size")
        end = stash(sums.withColumn("before", below).where("before <= missing AND missing < before + size").select("source", "cell", "before"), "mix-end")
    # In the last cell equal rows are counted first; running sums decide, and the nearer side of the end.
    last = end.select(F.col("source").alias("s"), F.col("cell").alias("c"), F.col("before").alias("b"))
    edge = drawn.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("rank", 48 - LEVELS * CELL_BITS) == F.col("c")))
    alike = edge.groupBy("source", "c", "b", "missing", _order().alias("upto")).agg(F.count("*").alias("equal"))
    alike = alike.withColumn("before", F.expr("b + sum(equal * upto.size) OVER (PARTITION BY source ORDER BY upto ROWS UNBOUNDED PRECEDING) - equal * upto.size"))
    # The n-th of equal rows is taken if twice what is taken by then is at most twice what is missing plus its size.
    ties = F.least(F.col("equal"), F.greatest(F.lit(0), F.floor((2 * (F.col("missing") - F.col("before")) + F.col("upto.size")) / (2 * F.col("upto.size"))))).cast("long")
    # Nothing of the cell may be taken; then the drawing ends before the cell.
    ends = alike.withColumn("ties", ties).groupBy("source").agg(F.max_by(F.struct("upto", "ties", "equal"), F.when(F.col("ties") > 0, F.col("upto"))).alias("end"), F.min("c").alias("c"))
    start = F.struct(F.shiftleft("c", 48 - LEVELS * CELL_BITS).alias("rank"), F.lit(False).alias("no_id"), F.lit(-(2**63)).cast("long").alias("id"), F.lit(-1).cast("long").alias("size"))
    ends = ends.select(F.col("source").alias("s"), F.coalesce("end.upto", start).alias("upto"), F.coalesce("end.ties", F.lit(0)).alias("ties"), F.coalesce("end.equal", F.lit(0)).alias("equal"))
    out = stash(goal.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-plan")
    discard(drawn)
    return out


def apply(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``sizes`` (doc_id, source, size, more) with source_size, target and copies of each row."""
    df = _ranked(sizes, plan)
    order, ranked = _order(), F.col("rank").isNotNull()
    taken = ranked & F.when(F.col("upto").isNull(), F.col("missing") > 0).otherwise((order < F.col("upto")) | ((order == F.col("upto")) & (F.col("ties") == F.col("equal"))))
    if not plan.where("ties > 0 AND ties < equal").isEmpty():  # only rows of one id, rank and size are told apart by number
        split = F.coalesce(ranked & (order == F.col("upto")) & (F.col("ties") > 0) & (F.col("ties") < F.col("equal")), F.lit(False))
        some = df.where(split).withColumn("taken", F.expr("row_number() OVER (PARTITION BY source ORDER BY rank) <= ties"))
        df = df.where(~split).withColumn("taken", taken).unionByName(some)
    else:
        df = df.withColumn("taken", taken)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce(F.col("taken"), F.lit(False)).cast("long")).otherwise(0)
    return df.withColumn("copies", copies).drop("whole", "missing", "rooted", "rank", "upto", "ties", "equal", "taken")


def mix(sizes: DataFrame) -> DataFrame:
    """``sizes`` (doc_id, source, size, more) with source_size, target and copies of each row."""
    return apply(sizes, plan(sizes))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(CAST(floor(sqrt(size)) AS BIGINT) * size) AS BIGINT) AS rooted FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
x AS (SELECT *, sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap AS capped,
      sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM w),
t AS (SELECT source, source_size, rooted, least(cap, coalesce(weight * max(CASE WHEN (total - capped) / rest <= cap / weight THEN (total - capped) / rest END) OVER (), cap)) AS target FROM x),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
m AS (SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS missing FROM g),
p AS (SELECT d.doc_id, d.source, d.size, m.source_size, m.target, m.whole, m.missing,
      (CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496::DOUBLE AS u,
      least(0.999999::DOUBLE, (m.missing * CAST(floor(sqrt(d.size)) AS BIGINT))::DOUBLE / greatest(m.rooted, 1)::DOUBLE) AS pi
      FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source),
r AS (SELECT *, CASE WHEN pi > 0 THEN CAST(floor(((u / (1 - u)) / (pi / (1 - pi))) / (1 + (u / (1 - u)) / (pi / (1 - pi))) * 281474976710656::DOUBLE) AS BIGINT) END AS rank FROM p),
c AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM r)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN whole + CASE WHEN rank IS NOT NULL AND upto - missing <= missing - (upto - size) THEN 1 ELSE 0 END ELSE 0 END) * size AS taken,
  source, CASE WHEN size > 0 THEN whole + CASE WHEN rank IS NOT NULL AND upto - missing <= missing - (upto - size) THEN 1 ELSE 0 END ELSE 0 END AS copies FROM c
"""
