"""The flagship: every listing's best route against recent sales, with flags and a score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import GRADING_FEE, USD, overhead, quotes, quotes_sql
from tidemark.plans.register import query
from tidemark.sources.views import market, r, rounded

MIN_COMPS = 4


def comps(sold: DataFrame) -> DataFrame:
    """Count, median and quantiles of the sales of each card, rarity, grader and grade, in home currency."""
    q = F.expr("percentile(price, array(0.25, 0.4, 0.5, 0.75))")
    out = sold.groupBy("card", "rarity", "grader", "grade").agg(F.count("*").alias("n_comps"), q.alias("q"))
    return out.select("card", "rarity", "grader", "grade", "n_comps", *[rounded(F.col("q")[i] * USD, 6).alias(k) for i, k in enumerate(("p25", "p40", "median", "p75"))])


def flags_and_score(df: DataFrame) -> DataFrame:
    discount = (F.col("median") - F.col("landed")) / F.col("median")
    ratio = overhead(df)
    thin = F.coalesce(F.col("n_comps"), F.lit(0)) < MIN_COMPS
    free = F.col("landed") < GRADING_FEE
    kills = F.when(F.col("median").isNull(), ratio > 0.6).otherwise((F.col("item_cost") <= F.col("p25")) & (F.col("landed") > F.col("p40")))
    cheap = F.col("landed") < 0.4 * F.col("p25")
    tests = [("FREE_CARD", free), ("DISCOUNT", discount >= 0.25), ("SHIPPING_KILLS_IT", kills), ("HIGH_OVERHEAD", ratio >= 0.4), ("THIN_COMPS", thin), ("SUSPICIOUS_CHEAP", cheap)]
    df = df.withColumn("flags", F.concat_ws(",", *[F.when(test, name) for name, test in tests]))
    margin = F.greatest(F.lit(0.0), (GRADING_FEE - F.col("landed")) / GRADING_FEE)
    raw = F.when(free, 40 * F.least(F.lit(1.0), margin * 2)).otherwise(0.0) + F.coalesce(45 * F.least(F.lit(1.0), discount / 0.6), F.lit(0.0))
    trust = F.when(F.col("n_comps") >= 2 * MIN_COMPS, 1.0).when(F.col("n_comps") >= MIN_COMPS, 0.8).otherwise(0.55)
    score = raw * trust - F.when(kills, 12).otherwise(0) - F.when(cheap, 15).otherwise(0)
    return df.withColumn("discount", rounded(discount, 4)).withColumn("score", rounded(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)), 1))


_Q = quotes_sql("(SELECT DISTINCT key, site, price, card, rarity, grader, grade FROM market WHERE basis = 'ask')", "key, site, price, card, rarity, grader, grade")


@query(
    f"""WITH q AS ({_Q}), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY landed, route) AS n FROM q) WHERE n = 1),
c AS (SELECT card, rarity, grader, grade, CAST(count(*) AS BIGINT) AS n_comps, {r(f"quantile_cont(price, 0.25) * {USD}::DOUBLE", 6)} AS p25, {r(f"quantile_cont(price, 0.4) * {USD}::DOUBLE", 6)} AS p40, {r(f"quantile_cont(price, 0.5) * {USD}::DOUBLE", 6)} AS median FROM market WHERE basis = 'sold' GROUP BY ALL),
j AS (SELECT b.*, n_comps, p25, p40, median, (median - landed) / median AS d, (fee_cost + ship_cost) / landed AS ratio,
  CASE WHEN median IS NULL THEN (fee_cost + ship_cost) / landed > 0.6 ELSE item_cost <= p25 AND landed > p40 END AS kills, landed < 0.4::DOUBLE * p25 AS cheap FROM b LEFT JOIN c USING (card, rarity, grader, grade))
SELECT key, route, landed, n_comps, median, {r("d", 4)} AS discount,
  concat_ws(',', CASE WHEN landed < 1000 THEN 'FREE_CARD' END, CASE WHEN d >= 0.25 THEN 'DISCOUNT' END, CASE WHEN kills THEN 'SHIPPING_KILLS_IT' END, CASE WHEN ratio >= 0.4::DOUBLE THEN 'HIGH_OVERHEAD' END, CASE WHEN coalesce(n_comps, 0) < 4 THEN 'THIN_COMPS' END, CASE WHEN cheap THEN 'SUSPICIOUS_CHEAP' END) AS flags,
  {r('''least(100, greatest(0, ((CASE WHEN landed < 1000 THEN 40 * least(1, greatest(0, (1000 - landed) / 1000) * 2) ELSE 0 END) + coalesce(45 * least(1, d / 0.6::DOUBLE), 0)) * (CASE WHEN n_comps >= 8 THEN 1.0::DOUBLE WHEN n_comps >= 4 THEN 0.8::DOUBLE ELSE 0.55::DOUBLE END) - CASE WHEN kills THEN 12 ELSE 0 END - CASE WHEN cheap THEN 15 ELSE 0 END))''', 1)} AS score FROM j""",
    "market",
)
def score_signals(spark, sf_dir):
    m = market(spark, sf_dir)
    asked = m.where("basis = 'ask'").select("key", "site", "price", "card", "rarity", "grader", "grade").distinct()
    best = quotes(asked).groupBy("key").agg(F.min_by(F.struct("*"), F.struct("landed", "route")).alias("b")).select("b.*")
    df = best.join(comps(m.where("basis = 'sold'")), ["card", "rarity", "grader", "grade"], "left")
    return flags_and_score(df).select("key", "route", "landed", "n_comps", "median", "discount", "flags", "score")


@query(
    f"""SELECT card, rarity, grader, grade, CAST(count(*) AS BIGINT) AS n_comps, {r(f"quantile_cont(price, 0.25) * {USD}::DOUBLE", 6)} AS p25, {r(f"quantile_cont(price, 0.4) * {USD}::DOUBLE", 6)} AS p40, {r(f"quantile_cont(price, 0.5) * {USD}::DOUBLE", 6)} AS median, {r(f"quantile_cont(price, 0.75) * {USD}::DOUBLE", 6)} AS p75,
CASE WHEN count(*) >= 8 THEN 'high' WHEN count(*) >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM market WHERE basis = 'sold' GROUP BY card, rarity, grader, grade""",
    "market",
)
def comp_stats(spark, sf_dir):
    n = F.col("n_comps")
    return comps(market(spark, sf_dir).where("basis = 'sold'")).withColumn("confidence", F.when(n >= 8, "high").when(n >= 4, "medium").otherwise("low"))
