"""Fair value: curves of grade and market, shrinkage, conformal intervals, probability that an item is worth its cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.counting import medians, placed
from tidemark.plans.register import query
from tidemark.sources.shared import kept
from tidemark.sources.views import market, r, rounded

BASE_GRADE, MIN_CELL, SHRINK = 9, 3, 4
ALPHA = 1.0 - 0.8  # as a double; its rounding decides which samples are large enough


def samples(spark, sf_dir) -> DataFrame:
    """Sales with ln price and their side of the stable split."""
    return sales(market(spark, sf_dir))


def sales(rows: DataFrame) -> DataFrame:
    """``samples`` of the rows of ``market``, or of those of its columns that it reads."""
    bucket = F.conv(F.substring(F.sha1(F.col("key").cast("binary")), 1, 6), 16, 10).cast("long") % 1000
    return rows.where("basis = 'sold' AND price > 0").select("key", "card", "rarity", "grader", "grade", "site", F.ln("price").alias("lp"), (bucket < 400).alias("calibration"))


_SAMPLES = "s AS (SELECT key, card, rarity, grader, grade, site, ln(price) AS lp, CAST(('0x' || substr(sha1(key), 1, 6)) AS BIGINT) % 1000 < 400 AS calibration FROM market WHERE basis = 'sold' AND price > 0)"


def grade_curve(s: DataFrame) -> DataFrame:
    """ln price of a grade over grade 9: the median over rarities of differences of cell medians, shrunk to 0."""
    cell = medians(s, ["rarity", "grade"], "lp", "m").where(F.col("n") >= MIN_CELL)
    base = cell.where(F.col("grade") == BASE_GRADE).select("rarity", F.col("m").alias("m9"), F.col("n").alias("n9"))
    g = cell.join(base, "rarity").groupBy("grade").agg(F.percentile(F.col("m") - F.col("m9"), F.lit(0.5)).alias("d"), F.sum(F.least("n", "n9")).alias("support"))
    return g.withColumn("effect", F.col("d") * F.col("support") / (F.col("support") + SHRINK))


_CURVE = f"""cell AS (SELECT rarity, grade, median(lp) AS m, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= {MIN_CELL}),
curve AS (SELECT a.grade, CAST(sum(least(a.n, b.n)) AS BIGINT) AS support, median(a.m - b.m) * sum(least(a.n, b.n)) / (sum(least(a.n, b.n)) + {SHRINK}) AS effect FROM cell a JOIN cell b ON a.rarity = b.rarity AND b.grade = {BASE_GRADE} GROUP BY a.grade)"""


@query(f"WITH {_SAMPLES}, {_CURVE} SELECT grade, support, {r('effect', 6)} AS effect FROM curve", "market")
def fit_grade_curve(spark, sf_dir):
    return grade_curve(samples(spark, sf_dir)).select("grade", "support", rounded("effect", 6).alias("effect"))


@query(
    f"""WITH {_SAMPLES}, cell AS (SELECT site, rarity, grader, grade, median(lp) AS m, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= {MIN_CELL}), base AS (SELECT site FROM s GROUP BY site ORDER BY count(*) DESC, site LIMIT 1)
SELECT a.site, CAST(sum(least(a.n, b.n)) AS BIGINT) AS support, {r(f"median(a.m - b.m) * sum(least(a.n, b.n)) / (sum(least(a.n, b.n)) + {SHRINK})", 6)} AS effect FROM cell a JOIN cell b USING (rarity, grader, grade) JOIN base ON b.site = base.site GROUP BY a.site""",
    "market",
)
def fit_venue_curve(spark, sf_dir):
    """The same for markets, within rarity, grader and grade; the market with most sales is the base."""
    s = samples(spark, sf_dir)
    cell = medians(s, ["site", "rarity", "grader", "grade"], "lp", "m").where(F.col("n") >= MIN_CELL)
    base = s.groupBy("site").count().orderBy(F.desc("count"), "site").limit(1).select(F.col("site").alias("base"))
    other = cell.join(F.broadcast(base), F.col("site") == F.col("base")).select("rarity", "grader", "grade", F.col("m").alias("mb"), F.col("n").alias("nb"))
    g = cell.join(other, ["rarity", "grader", "grade"]).groupBy("site").agg(F.percentile(F.col("m") - F.col("mb"), F.lit(0.5)).alias("d"), F.sum(F.least("n", "nb")).alias("support"))
    return g.select("site", "support", rounded(F.col("d") * F.col("support") / (F.col("support") + SHRINK), 6).alias("effect"))


def ladder(s: DataFrame) -> DataFrame:
    """ln fair value of each (card, rarity, grade): all, then rarity, then card, then grade, each shrunk to the one above."""
    curve = grade_curve(s).select("grade", F.col("effect").alias("g"))
    x = s.join(F.broadcast(curve), "grade", "left").withColumn("g", F.coalesce("g", F.lit(0.0)))  # one row for each grade
    x = x.withColumn("base", F.col("lp") - F.col("g"))
    mid, n = F.expr("percentile(base, 0.5)"), F.count("*")
    # All sales, and those of a rarity, grow with the data: their medians come by counting.
    l0 = medians(x, [], "base", "m0").drop("n")
    l3 = medians(x, ["rarity"], "base", "m3").withColumnRenamed("n", "n3")
    l2 = x.groupBy("card", "rarity").agg(mid.alias("m2"), n.alias("n2"))
    l1 = x.groupBy("card", "rarity", "grade", "g").agg(mid.alias("m1"), n.alias("n1"))
    df = l1.join(l2, ["card", "rarity"]).join(l3, ["rarity"]).crossJoin(F.broadcast(l0))  # one row
    shrink = lambda m, k, up: (F.col(m) * F.col(k) + up * SHRINK) / (F.col(k) + SHRINK)
    est = shrink("m1", "n1", shrink("m2", "n2", shrink("m3", "n3", F.col("m0"))))
    return df.select("card", "rarity", "grade", F.col("n1").alias("n"), (est + F.col("g")).alias("est"))


_LADDER = f"""x AS (SELECT s.*, coalesce(effect, 0) AS g, lp - coalesce(effect, 0) AS base FROM s LEFT JOIN curve USING (grade)), l0 AS (SELECT median(base) AS m0 FROM x), l3 AS (SELECT rarity, median(base) AS m3, count(*) AS n3 FROM x GROUP BY rarity), l2 AS (SELECT card, rarity, median(base) AS m2, count(*) AS n2 FROM x GROUP BY ALL), l1 AS (SELECT card, rarity, grade, g, median(base) AS m1, count(*) AS n1 FROM x GROUP BY ALL),
est AS (SELECT card, rarity, grade, n1 AS n, (m1 * n1 + ((m2 * n2 + ((m3 * n3 + m0 * {SHRINK}) / (n3 + {SHRINK})) * {SHRINK}) / (n2 + {SHRINK})) * {SHRINK}) / (n1 + {SHRINK}) + g AS est FROM l1 JOIN l2 USING (card, rarity) JOIN l3 USING (rarity) CROSS JOIN l0)"""


@query(f"WITH {_SAMPLES}, {_CURVE}, {_LADDER} SELECT card, rarity, grade, n, {r('exp(est)', 4)} AS fair FROM est", "market")
def valuation_ladder(spark, sf_dir):
    return ladder(samples(spark, sf_dir)).select("card", "rarity", "grade", "n", rounded(F.exp("est"), 4).alias("fair"))


def residuals(s: DataFrame) -> DataFrame:
    """Signed residuals of the calibration side against the ladder of the fit side, by count bucket of the ladder.

    Computed once, as intervals read them at several levels.
    """
    s = kept(s, "samples")
    est = ladder(s.where("NOT calibration")).select("card", "rarity", "grade", "n", "est")
    bucket = F.when(F.col("n") < 3, "<3").when(F.col("n") < 10, "3-9").when(F.col("n") < 50, "10-49").otherwise(">=50")
    return kept(s.where("calibration").join(est, ["card", "rarity", "grade"]).select("key", "site", bucket.alias("bucket"), (F.col("lp") - F.col("est")).alias("res")), "residuals")


_FIT = "f AS (SELECT * FROM s WHERE NOT calibration)"
_RES = f"{_SAMPLES}, {_FIT}, {_CURVE.replace('FROM s ', 'FROM f ')}, {_LADDER.replace('FROM s LEFT', 'FROM f AS s LEFT')}, res AS (SELECT key, site, CASE WHEN n < 3 THEN '<3' WHEN n < 10 THEN '3-9' WHEN n < 50 THEN '10-49' ELSE '>=50' END AS bucket, lp - est AS res FROM s JOIN est USING (card, rarity, grade) WHERE calibration)"


def conformal(res: DataFrame, *by: str) -> DataFrame:
    """Lower and upper residual that hold 80 %; null where the sample is too small for the index.

    The two order statistics are found by counting, so no group is gathered or sorted in one task.
    """
    df = placed(res.select(*by, "res"), list(by), "res")
    lo = (F.floor((F.col("of") + 1) * (ALPHA / 2)) - 1).cast("long")
    hi = (F.ceil((F.col("of") + 1) * (1 - ALPHA / 2)) - 1).cast("long")
    at = lambda i: rounded(F.max(F.when(F.col("place") == i, F.col("res"))), 6)
    return df.groupBy(*by).agg(F.count("*").alias("n"), at(lo).alias("lo"), at(hi).alias("hi"))


def _conformal_sql(by: str) -> str:
    lo, hi = f"CAST(floor((count(*) + 1) * ({ALPHA!r}::DOUBLE / 2)) - 1 AS BIGINT)", f"CAST(ceil((count(*) + 1) * (1 - {ALPHA!r}::DOUBLE / 2)) - 1 AS BIGINT)"
    pick = lambda i: f"CASE WHEN {i} >= 0 AND {i} < count(*) THEN list_sort(list(res))[{i} + 1] END"
    return f"SELECT {by}count(*) AS n, {r(pick(lo), 6)} AS lo, {r(pick(hi), 6)} AS hi FROM res" + (f" GROUP BY {by.rstrip(', ')}" if by else "")


@query(f"WITH {_RES} {_conformal_sql('')}", "market")
def conformal_quantiles(spark, sf_dir):
    return conformal(residuals(samples(spark, sf_dir)))


MIN_GROUP = 30


@query(
    f"""WITH {_RES}, a AS ({_conformal_sql('')}), b AS ({_conformal_sql('bucket, ')}), c AS ({_conformal_sql('site, bucket, ')}), u AS (SELECT c.site, c.bucket, c.n, CASE WHEN c.n >= {MIN_GROUP} THEN 'market' WHEN b.n >= {MIN_GROUP} THEN 'bucket' ELSE 'global' END AS source, c.lo AS lo1, c.hi AS hi1, b.lo AS lo2, b.hi AS hi2, a.lo AS lo3, a.hi AS hi3 FROM c JOIN b USING (bucket) CROSS JOIN a)
SELECT site, bucket, n, source, least(lo3, CASE source WHEN 'market' THEN lo1 WHEN 'bucket' THEN lo2 ELSE lo3 END) AS lo, CASE source WHEN 'market' THEN hi1 WHEN 'bucket' THEN hi2 ELSE hi3 END AS hi FROM u""",
    "market",
)
def group_conformal(spark, sf_dir):
    """Quantiles of the finest rung with 30 residuals: market and count bucket, then the bucket, then all; the lower bound is never
    above the global one."""
    res = residuals(samples(spark, sf_dir))
    a = conformal(res).select(F.col("lo").alias("lo3"), F.col("hi").alias("hi3"))
    b = conformal(res, "bucket").select("bucket", F.col("n").alias("n2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    u = conformal(res, "site", "bucket").join(b, "bucket").crossJoin(F.broadcast(a))  # one row
    source = F.when(F.col("n") >= MIN_GROUP, "market").when(F.col("n2") >= MIN_GROUP, "bucket").otherwise("global")
    pick = lambda x: F.when(source == "market", F.col(x)).when(source == "bucket", F.col(f"{x}2")).otherwise(F.col(f"{x}3"))
    return u.select("site", "bucket", "n", source.alias("source"), F.least("lo3", pick("lo")).alias("lo"), pick("hi").alias("hi"))


@query(f"WITH {_RES} SELECT bucket, step / 10.0::DOUBLE AS log_room, {r('count(*) FILTER (res > step / 10.0::DOUBLE) / CAST(count(*) AS DOUBLE)', 6)} AS p_worth FROM res CROSS JOIN range(-5, 6) AS t(step) GROUP BY bucket, step", "market")
def p_worth(spark, sf_dir):
    """Share of residuals above a log cost: the probability that an item is worth it, at eleven costs."""
    res = residuals(samples(spark, sf_dir))
    above = [F.count_if(F.col("res") > k / 10.0).alias(f"c{k + 5}") for k in range(-5, 6)]
    g = res.groupBy("bucket").agg(F.count("*").alias("n"), *above)
    rows = F.explode(F.array(*[F.struct(F.lit(k / 10.0).alias("log_room"), rounded(F.col(f"c{k + 5}") / F.col("n").cast("double"), 6).alias("p_worth")) for k in range(-5, 6)]))
    return g.select("bucket", rows.alias("x")).select("bucket", "x.*")


@query(f"WITH {_RES}, a AS ({_conformal_sql('')}) SELECT site, res.bucket, count(*) AS n, {r('count(*) FILTER (res BETWEEN a.lo AND a.hi) / CAST(count(*) AS DOUBLE)', 4)} AS coverage, {r('count(*) FILTER (res < a.lo) / CAST(count(*) AS DOUBLE)', 4)} AS lower_tail FROM res CROSS JOIN a GROUP BY site, res.bucket", "market")
def coverage_by_group(spark, sf_dir):
    """How often the interval holds, and how often the price is under it, by market and bucket.

    All together it holds by construction, as these residuals have set it; ``coverage_hash_folds`` and ``coverage_time_split`` measure
    it on sales that had no part in it.
    """
    res = residuals(samples(spark, sf_dir))
    df = res.crossJoin(F.broadcast(conformal(res).select("lo", "hi")))  # one row
    share = lambda c: rounded(F.count_if(c) / F.count("*").cast("double"), 4)
    return df.groupBy("site", "bucket").agg(F.count("*").alias("n"), share(F.col("res").between(F.col("lo"), F.col("hi"))).alias("coverage"), share(F.col("res") < F.col("lo")).alias("lower_tail"))
