"""Sellers compared with their peers: ratios, metrics, scores, supply."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.counting import others_median, sorted_medians
from tidemark.operators.joins import PEER_COLUMNS, TIERS, _tier_sql, coded, near_peers, peers
from tidemark.operators.ranking import midrank
from tidemark.plans.register import query
from tidemark.sources.shared import kept
from tidemark.sources.views import market, r, rounded

LN2 = math.log(2)
MIN_COMPARABLE, SHRINK = 3, 4
MAX_RISK = 30
#: Points off for the share of returned goods: none up to a quarter, all from three quarters on.
_RISK = f"{MAX_RISK} * greatest(0, least(1, (count(*) FILTER (grader = 'R') / CAST(count(*) AS DOUBLE) - 0.25::DOUBLE) / 0.5::DOUBLE))"


def winsorized(ratio) -> F.Column:
    """ln of a ratio, held between those of a half and of two."""
    return F.greatest(F.lit(-LN2), F.least(F.lit(LN2), F.ln(ratio)))


def stock(spark, sf_dir, *columns: str) -> DataFrame:
    """What sellers are compared by, and ``columns``, stored once for all that read it."""
    return kept(market(spark, sf_dir).select(*PEER_COLUMNS, "sold_at", *columns), "stock")


def ratios(rows: DataFrame) -> DataFrame:
    """Rows of ``stock`` whose peers are in a scoring tier (1 or 2), with their winsorised log ratio."""
    df = near_peers(rows.select(*PEER_COLUMNS, "sold_at")).withColumn("peer_median", F.coalesce("m1", "m2")).where("price > 0 AND peer_median > 0")
    return df.withColumn("lr", winsorized(F.col("price") / F.col("peer_median")))


_RATIOS = f"""t1 AS ({_tier_sql(1)}), t2 AS ({_tier_sql(2)}),
x AS (SELECT seller, card, grade, series, sold_at, greatest(-{LN2!r}::DOUBLE, least({LN2!r}::DOUBLE, ln(price / coalesce(m1, m2)))) AS lr FROM f LEFT JOIN t1 USING ({', '.join(TIERS[1])}, seller) LEFT JOIN t2 USING ({', '.join(TIERS[2])}, seller) WHERE coalesce(m1, m2) > 0 AND price > 0)"""


def metrics(x: DataFrame) -> DataFrame:
    """Median of each card first, then across cards: a seller of one card many times isn't many sellers. ``x`` is read once."""
    # A good counts at its first row: rows are dealt by seller once, and sorted by goods, then by ratio.
    known = F.col("card").isNotNull() & F.col("series").isNotNull() & F.col("grade").isNotNull()
    first = F.row_number().over(Window.partitionBy("seller", "card", "series", "grade").orderBy("sold_at")) == 1
    rows = x.select("seller", "card", "series", "grade", "sold_at", "lr").repartition("seller").withColumn("good", known & first)
    also = (F.count("*").alias("n"), F.count_if("good").alias("goods"), F.min("sold_at").alias("first_at"), F.max("sold_at").alias("last_at"))
    cards = sorted_medians(rows, ["seller", "card"], ["lr"], also).withColumnRenamed("m_lr", "m")
    span = ((F.max("last_at") - F.min("first_at")) / 86400).alias("span")
    return cards.groupBy("seller").agg(F.count("*").alias("cards"), F.sum("n").alias("comparable"), F.expr("percentile(m, array(0.25, 0.5, 0.75))").alias("q"), F.sum("goods").alias("goods"), span)


_METRICS = """c AS (SELECT seller, card, median(lr) AS m, count(*) AS n FROM x GROUP BY ALL), b AS (SELECT seller, count(*) AS cards, CAST(sum(n) AS BIGINT) AS comparable, quantile_cont(m, 0.25) AS q1, quantile_cont(m, 0.5) AS q2, quantile_cont(m, 0.75) AS q3 FROM c GROUP BY seller),
g AS (SELECT seller, count(DISTINCT (card, series, grade)) AS goods, (max(sold_at) - min(sold_at)) / 86400.0::DOUBLE AS span FROM x GROUP BY seller)"""


@query(f"WITH f AS (SELECT * FROM market), {_RATIOS}, {_METRICS} SELECT seller, cards, comparable, goods, {r('q2', 6)} AS median_lr, {r('q3 - q1', 6)} AS iqr, {r('span', 2)} AS span_days FROM b JOIN g USING (seller)", "market")
def seller_metrics(spark, sf_dir):
    return levels(metrics(ratios(stock(spark, sf_dir))))


def levels(df: DataFrame) -> DataFrame:
    """What ``metrics`` says, in rounded figures."""
    return df.select("seller", "cards", "comparable", "goods", rounded(F.col("q")[1], 6).alias("median_lr"), rounded(F.col("q")[2] - F.col("q")[0], 6).alias("iqr"), rounded("span").alias("span_days"))


@query(
    f"""WITH f AS (SELECT * FROM market), {_RATIOS}, {_METRICS},
k AS (SELECT seller, {_RISK} AS risk FROM market GROUP BY seller), s AS (SELECT *, -q2 * goods / (goods + {SHRINK}) AS shrunk FROM b JOIN g USING (seller) JOIN k USING (seller)),
t AS (SELECT *, 40 * greatest(0, least(1, shrunk / ln(1 / 0.75::DOUBLE))) AS depth, CASE WHEN shrunk > 0 THEN 30 * greatest(0, least(1, 1 - (q3 - q1) / {LN2!r}::DOUBLE)) * goods / (goods + {SHRINK}) ELSE 0 END AS consistency, CASE WHEN shrunk > 0 THEN 15 * least(1, goods / 8.0::DOUBLE) + 15 * least(1, span / 30) ELSE 0 END AS breadth FROM s)
SELECT seller, CASE WHEN comparable >= {MIN_COMPARABLE} AND cards >= {MIN_COMPARABLE} THEN {r("greatest(0, depth + consistency + breadth - risk)", 3)} END AS score, CASE WHEN comparable < {MIN_COMPARABLE} THEN 'few_comparable' WHEN cards < {MIN_COMPARABLE} THEN 'few_cards' END AS refusal FROM t""",
    "market",
)
def seller_score(spark, sf_dir):
    """Depth of the discount, its consistency and its breadth, less the risk of returns; refused on thin evidence."""
    m = stock(spark, sf_dir)
    return scores(m, metrics(ratios(m)))


def scores(m: DataFrame, found: DataFrame) -> DataFrame:
    """``seller_score`` from the stock and its ``metrics``."""
    returned = F.count_if(F.col("grader") == "R") / F.count("*").cast("double")
    risk = m.groupBy("seller").agg((MAX_RISK * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (returned - 0.25) / 0.5))).alias("risk"))
    df = found.join(risk, "seller")
    n = F.col("goods")
    one = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    df = df.withColumn("shrunk", -F.col("q")[1] * n / (n + SHRINK))
    up = F.col("shrunk") > 0
    depth = 40 * one(F.col("shrunk") / math.log(1 / 0.75))
    consistency = F.when(up, 30 * one(1 - (F.col("q")[2] - F.col("q")[0]) / LN2) * n / (n + SHRINK)).otherwise(0.0)
    breadth = F.when(up, 15 * F.least(F.lit(1.0), n / 8.0) + 15 * F.least(F.lit(1.0), F.col("span") / 30)).otherwise(0.0)
    refusal = F.when(F.col("comparable") < MIN_COMPARABLE, "few_comparable").when(F.col("cards") < MIN_COMPARABLE, "few_cards")
    return df.select("seller", F.when(refusal.isNull(), rounded(F.greatest(F.lit(0.0), depth + consistency + breadth - F.col("risk")), 3)).alias("score"), refusal.alias("refusal"))


@query(f"WITH c AS (SELECT seller, card, count(*) AS n FROM market GROUP BY ALL), s AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY seller) AS DOUBLE) AS share FROM c) SELECT seller, count(*) AS cards, {r('sum(share * share)', 6)} AS hhi, {r('max(share)', 6)} AS top_share FROM s GROUP BY seller", "market")
def herfindahl(spark, sf_dir):
    return concentration(market(spark, sf_dir))


def concentration(m: DataFrame) -> DataFrame:
    """Shares of the cards in each seller's stock: their number, the sum of their squares, the largest."""
    c = m.groupBy("seller", "card").agg(F.count("*").alias("n"))
    t = c.groupBy("seller").agg(F.sum("n").alias("total"))
    s = c.join(t, "seller").withColumn("share", F.col("n") / F.col("total").cast("double"))
    return s.groupBy("seller").agg(F.count("*").alias("cards"), rounded(F.sum(F.col("share") * F.col("share")), 6).alias("hhi"), rounded(F.max("share"), 6).alias("top_share"))


@query(
    f"""WITH s AS (SELECT site, basis, kind, seller, median(price / list_price) AS mid FROM market WHERE list_price > 0 GROUP BY ALL)
SELECT a.site, a.basis, a.kind, a.seller, count(*) AS others, CASE WHEN count(*) >= 3 THEN {r("a.mid / median(b.mid)", 4)} END AS cohort_index FROM s a JOIN s b ON a.site = b.site AND a.basis = b.basis AND a.kind = b.kind AND a.seller <> b.seller GROUP BY a.site, a.basis, a.kind, a.seller, a.mid""",
    "market",
)
def cohort_leave_one_out(spark, sf_dir):
    """A seller's level over the median level of all other sellers of its cohort.

    Places in the cohort tell where the middle of the others is, so sellers are neither paired nor gathered.
    """
    s = market(spark, sf_dir).where("list_price > 0").groupBy("site", "basis", "kind", "seller").agg(F.expr("percentile(price / list_price, 0.5)").alias("level"))
    keys = ["site", "basis", "kind"]
    found = s.join(others_median(s, keys, "seller", "level", 1), [*keys, "seller"])
    return found.select(*keys, "seller", "others", F.when(F.col("others") >= 3, rounded(F.col("level") / F.col("mid"), 4)).alias("cohort_index"))


#: Weights of the dimensions of supply; those that can't be had of a seller leave theirs to the others.
DIMENSIONS = {"depth": 40, "span": 20, "profile": 20, "focus": 10, "rhythm": 10}
MIN_ROWS = 3

_RANKS = ", ".join(
    f"r_{d} AS (SELECT site, seller, CASE WHEN n = 1 THEN 100.0::DOUBLE ELSE {r('100.0::DOUBLE * (below + 0.5::DOUBLE * ties) / (n - 1)', 4)} END AS {d}_rank FROM (SELECT site, seller, rank() OVER (PARTITION BY site ORDER BY {d}) - 1 AS below, count(*) OVER (PARTITION BY site, {d}) - 1 AS ties, count(*) OVER (PARTITION BY site) AS n FROM d WHERE {d} IS NOT NULL))"
    for d in DIMENSIONS
)
_FIT = f"({' + '.join(f'{w} * coalesce({d}_rank, 0)' for d, w in DIMENSIONS.items())}) / CAST({' + '.join(f'CASE WHEN {d}_rank IS NULL THEN 0 ELSE {w} END' for d, w in DIMENSIONS.items())} AS DOUBLE)"


@query(
    f"""WITH s AS (SELECT site, seller, count(*) AS depth, (max(sold_at) - min(sold_at)) / 86400.0::DOUBLE AS span, count(*) FILTER (grade BETWEEN 8 AND 9) / CAST(count(*) AS DOUBLE) AS profile FROM market GROUP BY ALL),
f AS (SELECT site, seller, max(n) / CAST(sum(n) AS DOUBLE) AS focus FROM (SELECT site, seller, series, count(*) AS n FROM market GROUP BY ALL) GROUP BY site, seller), w AS (SELECT site, seller, max(n) / CAST(sum(n) AS DOUBLE) AS rhythm FROM (SELECT site, seller, sold_at // 86400 % 7 AS weekday, count(*) AS n FROM market GROUP BY ALL) GROUP BY site, seller),
d AS (SELECT site, seller, depth, CASE WHEN span > 0 THEN span END AS span, CASE WHEN depth >= {MIN_ROWS} THEN profile END AS profile, CASE WHEN depth >= {MIN_ROWS} THEN focus END AS focus, CASE WHEN depth >= {MIN_ROWS} THEN rhythm END AS rhythm FROM s JOIN f USING (site, seller) JOIN w USING (site, seller)), {_RANKS},
k AS (SELECT site, count(*) AS n FROM d GROUP BY site)
SELECT site, seller, CASE WHEN n >= 3 THEN {r(_FIT, 2)} END AS fit, CASE WHEN n < 3 THEN 'few_sellers' END AS refusal FROM d JOIN k USING (site) {' '.join(f'LEFT JOIN r_{d} USING (site, seller)' for d in DIMENSIONS)}""",
    "market",
)
def supply_fit(spark, sf_dir):
    """Weighted midranks of depth, persistence, grade profile, series focus and weekly rhythm within the seller's market.

    What can't be told of a seller (a span of nothing, shares of fewer than three rows) is unknown, not nought.
    """
    m = market(spark, sf_dir)
    top = lambda by, to: m.groupBy("site", "seller", by).agg(F.count("*").alias("n")).groupBy("site", "seller").agg((F.max("n") / F.sum("n").cast("double")).alias(to))
    s = m.groupBy("site", "seller").agg(F.count("*").alias("depth"), ((F.max("sold_at") - F.min("sold_at")) / 86400.0).alias("span"), (F.count_if(F.col("grade").between(8, 9)) / F.count("*")).alias("profile"))
    s = s.join(top("series", "focus"), ["site", "seller"]).join(top(F.expr("sold_at div 86400 % 7").alias("weekday"), "rhythm"), ["site", "seller"])
    s = s.withColumn("span", F.when(F.col("span") > 0, F.col("span")))
    for d in ("profile", "focus", "rhythm"):
        s = s.withColumn(d, F.when(F.col("depth") >= MIN_ROWS, F.col(d)))
    out = s
    for d in DIMENSIONS:
        out = out.join(midrank(s.select("site", "seller", d), d, "site").select("site", "seller", F.col("midrank").alias(f"{d}_rank")), ["site", "seller"], "left")
    total = sum((w * F.coalesce(F.col(f"{d}_rank"), F.lit(0.0)) for d, w in DIMENSIONS.items()), F.lit(0.0))
    weights = sum((F.when(F.col(f"{d}_rank").isNull(), 0).otherwise(w) for d, w in DIMENSIONS.items()), F.lit(0))
    n = s.groupBy("site").agg(F.count("*").alias("n"))
    return out.join(n, "site").select("site", "seller", F.when(F.col("n") >= 3, rounded(total / weights.cast("double"))).alias("fit"), F.when(F.col("n") < 3, "few_sellers").alias("refusal"))


@query("SELECT DISTINCT key, seller, count(*) OVER (PARTITION BY buyer, seller) AS together FROM market WHERE basis = 'ask'", "market")
def seller_bundle_flag(spark, sf_dir):
    """How many of a seller's items one order list holds."""
    m = market(spark, sf_dir).where("basis = 'ask'")
    n = m.groupBy("buyer", "seller").agg(F.count("*").alias("together"))
    return m.join(n, ["buyer", "seller"]).select("key", "seller", "together").distinct()


_ALPHA_SQL = {
    "n_rows": "count(*)", "n_sellers": "count(DISTINCT seller)", "n_cards": "count(DISTINCT card)", "n_sites": "count(DISTINCT site)", "asks": "count(*) FILTER (basis = 'ask')", "sold": "count(*) FILTER (basis = 'sold')", "auctions": "count(*) FILTER (kind = 'auction')",
    "tier1": "count(*) FILTER (tier = 1)", "tier2": "count(*) FILTER (tier = 2)", "tier3": "count(*) FILTER (tier = 3)", "without_peers": "count(*) FILTER (tier IS NULL)", "comparable": "count(*) FILTER (tier <= 2)", "comparable_sellers": "count(DISTINCT seller) FILTER (tier <= 2)", "comparable_cards": "count(DISTINCT card) FILTER (tier <= 2)",
    "below_peers": "count(*) FILTER (tier <= 2 AND price < mid)", "above_peers": "count(*) FILTER (tier <= 2 AND price > mid)", "winsorised": "count(*) FILTER (tier <= 2 AND (price < mid / 2 OR price > mid * 2))",
}


@query(
    f"""WITH f AS (SELECT * FROM market), t1 AS ({_tier_sql(1)}), t2 AS ({_tier_sql(2)}), t3 AS ({_tier_sql(3)}), y AS (SELECT *, CASE WHEN n1 IS NOT NULL THEN 1 WHEN n2 IS NOT NULL THEN 2 WHEN n3 IS NOT NULL THEN 3 END AS tier, coalesce(m1, m2, m3) AS mid FROM f LEFT JOIN t1 USING ({', '.join(TIERS[1])}, seller) LEFT JOIN t2 USING ({', '.join(TIERS[2])}, seller) LEFT JOIN t3 USING ({', '.join(TIERS[3])}, seller)),
s AS (SELECT seller, count(*) AS n, count(DISTINCT card) AS cards FROM y WHERE tier <= 2 GROUP BY seller)
SELECT {', '.join(f'CAST({v} AS BIGINT) AS {k}' for k, v in _ALPHA_SQL.items())}, (SELECT CAST(count(*) FILTER (n < {MIN_COMPARABLE}) AS BIGINT) FROM s) AS few_comparable, (SELECT CAST(count(*) FILTER (n >= {MIN_COMPARABLE} AND cards < {MIN_COMPARABLE}) AS BIGINT) FROM s) AS few_cards, (SELECT CAST(count(*) FILTER (n >= {MIN_COMPARABLE} AND cards >= {MIN_COMPARABLE}) AS BIGINT) FROM s) AS scored FROM y""",
    "market",
)
def alpha_coverage(spark, sf_dir):
    """How much of the data the comparison of sellers rests on: rows and sellers by tier of peers, side and refusal."""
    y = peers(coded(spark, sf_dir)).withColumnRenamed("peer_median", "mid")
    near = F.col("tier") <= 2
    counts = {k: v for k, v in _ALPHA_SQL.items() if "DISTINCT" not in v and v != "count(*)"}
    columns = [F.count("*").alias("n_rows"), *[F.count_distinct(c).alias(f"n_{c}s") for c in ("seller", "card", "site")]]
    columns += [F.count_if(F.expr(v.split("FILTER (", 1)[1][:-1])).alias(k) for k, v in counts.items()]
    columns += [F.count_distinct(F.when(near, F.col(c))).alias(f"comparable_{c}s") for c in ("seller", "card")]
    s = y.where(near).groupBy("seller").agg(F.count("*").alias("n"), F.count_distinct("card").alias("cards"))
    enough, wide = F.col("n") >= MIN_COMPARABLE, F.col("cards") >= MIN_COMPARABLE
    b = s.agg(F.count_if(~enough).alias("few_comparable"), F.count_if(enough & ~wide).alias("few_cards"), F.count_if(enough & wide).alias("scored"))
    return y.agg(*columns).crossJoin(b)  # one row each
