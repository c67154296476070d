"""Grouped statistics: coverage, provenance, strata and markets compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans.register import query
from tidemark.sources.shared import kept
from tidemark.sources.views import market, observed, r, rounded, titled

MIN_CELL, MIN_STRATA = 4, 3


def _count_if(test: str, name: str):
    return F.count_if(F.expr(test)).alias(name)


@query("SELECT site, count(*) AS n, CAST(count(*) FILTER (quantity % 7 <> 0) AS BIGINT) AS with_grade, CAST(count(*) FILTER (quantity % 7 = 0) AS BIGINT) AS without_grade FROM market GROUP BY site", "market")
def grade_coverage(spark, sf_dir):
    return market(spark, sf_dir).groupBy("site").agg(F.count("*").alias("n"), _count_if("quantity % 7 <> 0", "with_grade"), _count_if("quantity % 7 = 0", "without_grade"))


@query("SELECT site, count(*) AS n, CAST(count(*) FILTER (kind = 'auction') AS BIGINT) AS auctions, CAST(count(*) FILTER (sold_at % 172800 = 0) AS BIGINT) AS even_days, min(sold_at) AS first_at, max(sold_at) AS last_at FROM market WHERE basis = 'sold' GROUP BY site", "market")
def comps_provenance(spark, sf_dir):
    return market(spark, sf_dir).where("basis = 'sold'").groupBy("site").agg(F.count("*").alias("n"), _count_if("kind = 'auction'", "auctions"), _count_if("sold_at % 172800 = 0", "even_days"), F.min("sold_at").alias("first_at"), F.max("sold_at").alias("last_at"))


@query("SELECT basis, kind, count(*) AS n, max(sold_at) AS last_at FROM market GROUP BY basis, kind", "market")
def state_totals(spark, sf_dir):
    return market(spark, sf_dir).groupBy("basis", "kind").agg(F.count("*").alias("n"), F.max("sold_at").alias("last_at"))


def cells(rows: DataFrame) -> DataFrame:
    """Count and median price of each stratum and market; thin cells stay."""
    return rows.where("price > 0").groupBy("site", "rarity", "grader", "grade").agg(F.count("*").alias("n"), F.expr("percentile(price, 0.5)").alias("mid"))


_CELLS = "SELECT site, rarity, grader, grade, count(*) AS n, median(price) AS mid FROM market WHERE basis = 'sold' AND price > 0 GROUP BY ALL"


@query(f"SELECT site, rarity, grader, grade, n, {r('mid', 6)} AS median_price FROM ({_CELLS}) WHERE n >= {MIN_CELL}", "market")
def stratum_medians(spark, sf_dir):
    return cells(market(spark, sf_dir).where("basis = 'sold'")).where(F.col("n") >= MIN_CELL).select("site", "rarity", "grader", "grade", "n", rounded("mid", 6).alias("median_price"))


def paired_ratio(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Median of the ratios of ``a`` over ``b`` across common strata; refused with fewer than MIN_STRATA."""
    strata = ["rarity", "grader", "grade"]
    two = b.where(F.col("n") >= MIN_CELL).select(*strata, *[F.col(c).alias(f"{c}_b") for c in by], F.col("mid").alias("other"))
    pairs = a.where(F.col("n") >= MIN_CELL).join(two, strata).withColumn("ratio", rounded(F.col("mid") / F.col("other"), 3))
    keys = [*by, *[f"{c}_b" for c in by]]
    out = pairs.groupBy(*keys).agg(F.count("*").alias("strata"), F.expr("percentile(ratio, 0.5)").alias("m"), F.min("ratio").alias("least"), F.max("ratio").alias("most"), F.count_if(F.col("ratio") < 1).alias("cheaper"))
    enough = F.col("strata") >= MIN_STRATA
    return out.select(*keys, "strata", F.when(enough, rounded("m", 4)).alias("ratio"), "least", "most", "cheaper", F.when(~enough, "insufficient").alias("refusal"))


@query(
    f"""WITH c AS ({_CELLS}), p AS (SELECT a.site, b.site AS site_b, {r("a.mid / b.mid", 3)} AS ratio FROM c a JOIN c b USING (rarity, grader, grade) WHERE a.n >= {MIN_CELL} AND b.n >= {MIN_CELL} AND a.site < b.site)
SELECT site, site_b, count(*) AS strata, CASE WHEN count(*) >= {MIN_STRATA} THEN {r("median(ratio)", 4)} END AS ratio, min(ratio) AS least, max(ratio) AS most, CAST(count(*) FILTER (ratio < 1) AS BIGINT) AS cheaper, CASE WHEN count(*) < {MIN_STRATA} THEN 'insufficient' END AS refusal FROM p GROUP BY site, site_b""",
    "market",
)
def ratio_across_strata(spark, sf_dir):
    """Is one market dearer than another once the mix of goods is held equal?"""
    c = cells(market(spark, sf_dir).where("basis = 'sold'"))
    return paired_ratio(c, c, ["site"]).where("site < site_b")


@query(
    f"""WITH m AS (SELECT basis, site, rarity, grader, grade, count(*) AS n, median(price) AS mid FROM market WHERE price > 0 GROUP BY ALL), p AS (SELECT a.site, {r("a.mid / b.mid", 3)} AS ratio FROM m a JOIN m b USING (site, rarity, grader, grade) WHERE a.basis = 'sold' AND b.basis = 'ask' AND a.n >= 4 AND b.n >= 4),
g AS (SELECT site, count(*) AS strata, {r("median(ratio)", 4)} AS m FROM p GROUP BY site)
SELECT site, strata, CASE WHEN strata >= 3 THEN m END AS sold_over_ask, CASE WHEN strata < 3 THEN 'insufficient' WHEN m >= 1.5 THEN 'strong' WHEN m >= 1.15 THEN 'some' WHEN m <= 0.85 THEN 'below' ELSE 'none' END AS reading FROM g""",
    "market",
)
def venue_q2(spark, sf_dir):
    """Sold against asked prices in each market, stratum by stratum."""
    m = market(spark, sf_dir)
    strata = ["site", "rarity", "grader", "grade"]
    sold = cells(m.where("basis = 'sold'")).where("n >= 4").select(*strata, F.col("mid").alias("sold"))
    asked = cells(m.where("basis = 'ask'")).where("n >= 4").select(*strata, F.col("mid").alias("asked"))
    g = sold.join(asked, strata).groupBy("site").agg(F.count("*").alias("strata"), F.percentile(rounded(F.col("sold") / F.col("asked"), 3), F.lit(0.5)).alias("m"))
    x, enough = rounded("m", 4), F.col("strata") >= 3
    reading = F.when(~enough, "insufficient").when(x >= 1.5, "strong").when(x >= 1.15, "some").when(x <= 0.85, "below").otherwise("none")
    return g.select("site", "strata", F.when(enough, x).alias("sold_over_ask"), reading.alias("reading"))


SITES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
_n = lambda site: "n_" + site.lower().replace(" ", "_")


@query(
    f"""SELECT rarity, grader, grade, {', '.join(f"CAST(count(*) FILTER (site = '{x}') AS BIGINT) AS {_n(x)}" for x in SITES)},
CAST({' + '.join(f"CAST(count(*) FILTER (site = '{x}') >= {MIN_CELL} AS INT)" for x in SITES)} AS INT) AS comparable FROM market WHERE basis = 'sold' GROUP BY rarity, grader, grade""",
    "market",
)
def stratum_table(spark, sf_dir):
    """Strata as rows, markets as columns, and how many of them have enough sales; thin cells are kept."""
    df = market(spark, sf_dir).where("basis = 'sold'").groupBy("rarity", "grader", "grade").pivot("site", list(SITES)).count().na.fill(0)
    enough = sum((F.col(f"`{x}`") >= MIN_CELL).cast("int") for x in SITES)
    return df.select("rarity", "grader", "grade", *[F.col(f"`{x}`").alias(_n(x)) for x in SITES], enough.cast("int").alias("comparable"))


@query(
    """WITH x AS (SELECT site, CAST(count(*) FILTER (basis = 'sold') AS BIGINT) AS gone, CAST(count(*) AS BIGINT) AS decided FROM market GROUP BY site)
SELECT site, gone, decided, CASE WHEN decided >= 30 AND gone >= 10 THEN CAST(floor(gone * 1000.0::DOUBLE / decided + 0.5) AS DOUBLE) / 10 END AS sell_through, CASE WHEN decided < 30 THEN 'few_decided' WHEN gone < 10 THEN 'few_events' END AS refusal FROM x""",
    "market",
)
def venue_q3(spark, sf_dir):
    """Sell-through in percent behind two gates."""
    x = market(spark, sf_dir).groupBy("site").agg(_count_if("basis = 'sold'", "gone"), F.count("*").alias("decided"))
    enough = (F.col("decided") >= 30) & (F.col("gone") >= 10)
    refusal = F.when(F.col("decided") < 30, "few_decided").when(F.col("gone") < 10, "few_events")
    return x.select("site", "gone", "decided", F.when(enough, F.floor(F.col("gone") * 1000.0 / F.col("decided") + 0.5).cast("double") / 10).alias("sell_through"), refusal.alias("refusal"))


FEW_SALES = 3


@query(
    f"""WITH d AS (SELECT part_key, site, min(card) AS card, count(*) AS demand FROM market WHERE basis = 'ask' GROUP BY part_key, site), s AS (SELECT part_key, site, count(*) AS comps FROM market WHERE basis = 'sold' GROUP BY part_key, site)
SELECT part_key, site, card, demand, coalesce(comps, 0) AS comps FROM d LEFT JOIN s USING (part_key, site) WHERE coalesce(comps, 0) < {FEW_SALES} ORDER BY demand DESC, comps, part_key, site LIMIT 10""",
    "market",
)
def refill_selection(spark, sf_dir):
    """Cards in demand in a market with too few sales there, the most wanted first (a report of ten)."""
    m = market(spark, sf_dir)
    demand = m.where("basis = 'ask'").groupBy("part_key", "site").agg(F.min("card").alias("card"), F.count("*").alias("demand"))
    known = m.where("basis = 'sold'").groupBy("part_key", "site").agg(F.count("*").alias("comps"))
    df = demand.join(known, ["part_key", "site"], "left").na.fill(0, ["comps"]).where(F.col("comps") < FEW_SALES)
    return df.orderBy(F.desc("demand"), "comps", "part_key", "site").limit(10)


@query("SELECT site, day, count(*) AS n, max(CASE WHEN price < 10 THEN 2 WHEN price < 40 THEN 1 ELSE 0 END) AS severity, CASE max(CASE WHEN price < 10 THEN 2 WHEN price < 40 THEN 1 ELSE 0 END) WHEN 2 THEN 'blocked' WHEN 1 THEN 'partial' ELSE 'ok' END AS health FROM observed GROUP BY site, day", "observed")
def source_health_rollup(spark, sf_dir):
    """The worst health of each source and day."""
    severity = F.when(F.col("price") < 10, 2).when(F.col("price") < 40, 1).otherwise(0)
    df = observed(spark, sf_dir).groupBy("site", "day").agg(F.count("*").alias("n"), F.max(severity).alias("severity"))
    return df.withColumn("health", F.when(F.col("severity") == 2, "blocked").when(F.col("severity") == 1, "partial").otherwise("ok"))


@query("SELECT site, count(*) AS n, CAST(count(*) FILTER (contains(title, 'PSA')) AS BIGINT) AS hits, CAST(floor(count(*) FILTER (contains(title, 'PSA')) * 1000.0::DOUBLE / count(*) + 0.5) AS DOUBLE) / 10 AS hit_percent FROM titled GROUP BY site", "titled")
def match_report(spark, sf_dir):
    df = titled(market(spark, sf_dir)).groupBy("site").agg(F.count("*").alias("n"), F.count_if(F.contains("title", F.lit("PSA"))).alias("hits"))
    return df.withColumn("hit_percent", F.floor(F.col("hits") * 1000.0 / F.col("n") + 0.5).cast("double") / 10)


SAMPLE, SEED = 20, 11


@query(f"SELECT site, key, title, contains(title, 'PSA') AS hit FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY md5('{SEED}:' || key), key) AS n FROM (SELECT DISTINCT site, key, title FROM titled)) WHERE n <= {SAMPLE}", "titled")
def match_sample(spark, sf_dir):
    """A seeded sample of each market's titles to look at: those of the least hashes, so the same ones whatever the partitions.

    Spark limits each group to SAMPLE rows before the shuffle, so a large market costs no more than a small one there.
    """
    rows = titled(market(spark, sf_dir)).select("site", "key", "title").distinct().withColumn("hash", F.md5(F.concat(F.lit(f"{SEED}:"), F.col("key")).cast("binary")))
    sample = rows.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("hash", "key"))).where(F.col("n") <= SAMPLE)
    return sample.select("site", "key", "title", F.contains("title", F.lit("PSA")).alias("hit"))


@query(
    f"""WITH t AS (SELECT a.key, a.card, CASE WHEN s.grade = a.grade AND s.grader = a.grader AND s.rarity = a.rarity THEN 1 WHEN s.grade = a.grade AND s.rarity = a.rarity THEN 2 WHEN s.rarity = a.rarity THEN 3 ELSE 4 END AS tier, s.price, s.site FROM (SELECT DISTINCT key, card, rarity, grader, grade FROM market WHERE basis = 'ask') a JOIN (SELECT card, rarity, grader, grade, price, site FROM market WHERE basis = 'sold') s ON a.card = s.card),
b AS (SELECT *, min(tier) OVER (PARTITION BY key) AS best FROM t)
SELECT key, card, best AS tier, count(*) AS n, count(DISTINCT site) AS venues, {r("median(price)", 6)} AS median_price FROM b WHERE tier = best GROUP BY key, card, best""",
    "market",
)
def comparables_best_tier(spark, sf_dir):
    """Statistics over the best tier of comparable sales that isn't empty.

    Where a tier is the best, it holds all sales of its key, so each tier is aggregated once and looked up.
    """
    m = asks_and_sales(spark, sf_dir)
    asks = m.where("basis = 'ask'").select("key", *CELL).distinct()
    return with_best_tier(asks, m).select("key", "card", "tier", "n", "venues", rounded("mid", 6).alias("median_price")).where("tier IS NOT NULL")


CELL = ("card", "rarity", "grader", "grade")


def asks_and_sales(spark, sf_dir) -> DataFrame:
    """What comparisons of asks with sales read, stored once: the tables are joined once for both. Sales have no key."""
    key = F.when(F.col("basis") == "ask", F.col("key")).alias("key")
    return kept(market(spark, sf_dir).select(key, "basis", "site", "price", *CELL), "asks-and-sales")


def with_best_tier(asks: DataFrame, rows: DataFrame) -> DataFrame:
    """``asks`` with the best tier of sales in ``rows`` that isn't empty (or null): tier, n, venues and mid, their median price.

    All that a tier says depends on the cell (CELL) alone, so tiers are looked up for cells, not for asks. Sales are counted by value
    first, and the cells' table is stored, so that Spark knows its size when it plans the one join with the asks.
    """
    sales = kept(rows.where("basis = 'sold'").groupBy(*CELL, "site", "price").agg(F.count("*").alias("n")), "sales")
    out = rows.where("basis = 'ask'").select(*CELL).distinct()
    for tier, keys in enumerate((["card", "rarity", "grader", "grade"], ["card", "rarity", "grade"], ["card", "rarity"], ["card"]), 1):
        found = sales.groupBy(*keys).agg(F.sum("n").alias(f"n{tier}"), F.size(F.collect_set("site")).cast("long").alias(f"v{tier}"), F.expr("percentile(price, 0.5, n)").alias(f"m{tier}"))
        out = out.join(found, keys, "left")
    first = lambda x: F.coalesce(*[f"{x}{k}" for k in range(1, 5)])
    tier = F.coalesce(*[F.when(F.col(f"n{k}").isNotNull(), k) for k in range(1, 5)])
    cells = kept(out.select(*[F.col(c).alias(f"{c}_") for c in CELL], tier.alias("tier"), first("n").alias("n"), first("v").alias("venues"), first("m").alias("mid")), "cells")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in CELL]
    return asks.join(cells, same, "left").drop(*[f"{c}_" for c in CELL])
