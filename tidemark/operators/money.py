"""Costs: exchange, routes, break-even, sale proceeds, bid ceilings, bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.money import BATCH, DIRECT_SHIPPING, JPY, REMITTANCE, SPREAD, USD, VENUES, overhead, quotes, quotes_sql, routes, to_home, ROUTES_SQL, _UP
from tidemark.operators.counting import medians
from tidemark.plans.register import query
from tidemark.sources.views import market, r, rounded

ASKS = "(SELECT * FROM market WHERE basis = 'ask')"


def asks(spark, sf_dir):
    return market(spark, sf_dir).where("basis = 'ask'")


@query(f"SELECT key, {r(f'price * {USD}::DOUBLE')} AS plain, {r(f'(price * {USD}::DOUBLE) * {_UP}')} AS with_markup, {r(f'price / {USD}::DOUBLE', 4)} AS back FROM market", "market")
def fx_convert(spark, sf_dir):
    p = F.col("price")
    return market(spark, sf_dir).select("key", rounded(to_home(p, USD, False)).alias("plain"), rounded(to_home(p, USD)).alias("with_markup"), rounded(p / USD, 4).alias("back"))


@query(quotes_sql(ASKS, "key, site, price"), "market")
def quote_all_routes(spark, sf_dir):
    return quotes(asks(spark, sf_dir).select("key", "site", "price"))


@query(f"WITH q AS ({quotes_sql(ASKS, 'key, site, price')}) SELECT DISTINCT key, site, price, route, landed FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY landed, route) AS n FROM q) WHERE n = 1", "market")
def best_route(spark, sf_dir):
    """The cheapest route of each listing; ties by its name. Keys may repeat with equal prices, so rows are distinct."""
    q = quotes(asks(spark, sf_dir).select("key", "site", "price"))
    best = q.groupBy("key", "site", "price").agg(F.min(F.struct("landed", "route")).alias("b"))
    return best.select("key", "site", "price", "b.route", "b.landed")


@query(f"WITH q AS ({quotes_sql(ASKS, 'key, site, price')}) SELECT key, route, {r('(fee_cost + ship_cost) / landed', 4)} AS overhead_ratio FROM q WHERE landed > 0 AND (fee_cost + ship_cost) / landed >= 0.4::DOUBLE", "market")
def overhead_alert(spark, sf_dir):
    q = quotes(asks(spark, sf_dir).select("key", "site", "price"))
    return q.where(overhead(q) >= 0.4).select("key", "route", rounded(overhead(q), 4).alias("overhead_ratio"))


_MOST = f"greatest(0, (target - ((order_fee + shipment_fee / bundle) * {JPY}::DOUBLE) * {_UP}) / (1 * {JPY}::DOUBLE * {_UP}))"


@query(
    f"""WITH b AS (SELECT route, route_site, target, {_MOST} AS most FROM {ROUTES_SQL} CROSS JOIN (VALUES (500::DOUBLE), (1000::DOUBLE), (2000::DOUBLE), (5000::DOUBLE)) AS t(target) WHERE NOT direct)
SELECT route, route_site, target, {r('most')} AS most_price, CAST(count(*) FILTER (price * {USD}::DOUBLE / {JPY}::DOUBLE <= most) AS BIGINT) AS within, count(price) AS asks FROM b LEFT JOIN (SELECT site, price FROM market WHERE basis = 'ask') a ON site = route_site GROUP BY route, route_site, target, most""",
    "market",
)
def breakeven_table(spark, sf_dir):
    """The highest price in yen at which a route stays within a target, and how many of its market's asks cost no more."""
    t = spark.createDataFrame([(x,) for x in (500.0, 1000.0, 2000.0, 5000.0)], "target double")
    fees = to_home(F.col("order_fee") + F.col("shipment_fee") / F.col("bundle"), JPY)
    most = F.greatest(F.lit(0.0), (F.col("target") - fees) / to_home(1.0, JPY))
    table = routes(spark).where("NOT direct").crossJoin(F.broadcast(t)).select("route", "route_site", "target", most.alias("most"))  # fixed rows
    prices = asks(spark, sf_dir).groupBy(F.col("site").alias("route_site"), "price").agg(F.count("*").alias("n"))
    df = table.join(prices, "route_site", "left").withColumn("within", F.when(F.col("price") * USD / JPY <= F.col("most"), F.col("n")).otherwise(0))
    return df.groupBy("route", "route_site", "target", "most").agg(F.sum("within").alias("within"), F.coalesce(F.sum("n"), F.lit(0)).alias("asks")).select("route", "route_site", "target", rounded("most").alias("most_price"), "within", "asks")


_VENUES = "(VALUES " + ", ".join(f"('{v}', {c}::DOUBLE, {p}::DOUBLE, {f}::DOUBLE, {s}::DOUBLE)" for v, c, p, f, s in VENUES) + ") AS v(venue, commission, payment, fixed, shipping)"


@query(
    f"""WITH p AS (SELECT card, grade, median(price) AS price FROM market WHERE basis = 'sold' GROUP BY card, grade),
n AS (SELECT *, price - (price * commission + price * payment + fixed + shipping + {REMITTANCE}::DOUBLE / {BATCH}) AS net FROM p CROSS JOIN {_VENUES})
SELECT card, grade, venue, CASE WHEN net > 0 THEN {r(f'net * {USD}::DOUBLE * (1 - {SPREAD}::DOUBLE)')} END AS net_home, CASE WHEN net <= 0 THEN 'net_not_positive' END AS refusal FROM n""",
    "market",
)
def net_proceeds(spark, sf_dir):
    """What a sale at the median price brings home in each venue; no number, but a reason, where fees eat it."""
    p = market(spark, sf_dir).where("basis = 'sold'").groupBy("card", "grade").agg(F.expr("percentile(price, 0.5)").alias("price"))
    v = spark.createDataFrame(list(VENUES), "venue string, commission double, payment double, fixed double, shipping double")
    price = F.col("price")
    net = price - (price * F.col("commission") + price * F.col("payment") + F.col("fixed") + F.col("shipping") + F.lit(REMITTANCE) / BATCH)
    df = p.crossJoin(F.broadcast(v)).withColumn("net", net)
    return df.select("card", "grade", "venue", F.when(F.col("net") > 0, rounded(F.col("net") * USD * (1 - F.lit(SPREAD)))).alias("net_home"), F.when(F.col("net") <= 0, "net_not_positive").alias("refusal"))


@query(
    f"""SELECT part_key, venue, CASE WHEN 1 - commission - payment > 0 THEN {r(f'(cost / ({USD}::DOUBLE * (1 - {SPREAD}::DOUBLE)) + (fixed + shipping + {REMITTANCE}::DOUBLE / {BATCH})) / (1 - commission - payment)')} END AS least_price
FROM (SELECT part_key, min(list_price) AS cost FROM market GROUP BY part_key) CROSS JOIN {_VENUES}""",
    "market",
)
def breakeven_sell_price(spark, sf_dir):
    """The sale price at which each venue returns a cost."""
    v = spark.createDataFrame(list(VENUES), "venue string, commission double, payment double, fixed double, shipping double")
    df = market(spark, sf_dir).groupBy("part_key").agg(F.min("list_price").alias("cost")).crossJoin(F.broadcast(v))
    share = 1 - F.col("commission") - F.col("payment")
    least = (F.col("cost") / (F.lit(USD) * (1 - F.lit(SPREAD))) + (F.col("fixed") + F.col("shipping") + F.lit(REMITTANCE) / BATCH)) / share
    return df.select("part_key", "venue", F.when(share > 0, rounded(least)).alias("least_price"))


@query(
    f"""WITH f AS (SELECT card, grade, quantile_cont(price, 0.25) * {USD}::DOUBLE AS low, count(*) AS n FROM market WHERE basis = 'sold' GROUP BY card, grade),
c AS (SELECT *, low * 0.7::DOUBLE AS budget, (low * 0.7::DOUBLE - ({DIRECT_SHIPPING}::DOUBLE * {USD}::DOUBLE) * {_UP}) / ({USD}::DOUBLE * {_UP}) AS raw FROM f),
d AS (SELECT *, floor(raw) AS ceiling, CASE WHEN n < 10 THEN 'few_sales' WHEN floor(raw) <= 0 THEN 'no_room' WHEN (floor(raw) * {USD}::DOUBLE) * {_UP} + ({DIRECT_SHIPPING}::DOUBLE * {USD}::DOUBLE) * {_UP} > budget + 0.05::DOUBLE THEN 'over_budget' END AS refusal FROM c)
SELECT card, grade, n, CASE WHEN refusal IS NULL THEN CAST(ceiling AS BIGINT) END AS ceiling, refusal FROM d""",
    "market",
)
def bid_ceiling(spark, sf_dir):
    """The highest bid in whole dollars that keeps the landed cost 30 % under the low fair value, checked forward."""
    f = market(spark, sf_dir).where("basis = 'sold'").groupBy("card", "grade").agg((F.expr("percentile(price, 0.25)") * USD).alias("low"), F.count("*").alias("n"))
    ship = to_home(DIRECT_SHIPPING, USD)
    df = f.withColumn("budget", F.col("low") * 0.7).withColumn("ceiling", F.floor((F.col("low") * 0.7 - ship) / to_home(1.0, USD)).cast("long"))
    refusal = F.when(F.col("n") < 10, "few_sales").when(F.col("ceiling") <= 0, "no_room").when(to_home(F.col("ceiling").cast("double"), USD) + ship > F.col("budget") + 0.05, "over_budget")
    df = df.withColumn("refusal", refusal)
    return df.select("card", "grade", "n", F.when(F.col("refusal").isNull(), F.col("ceiling")).alias("ceiling"), "refusal")


@query(
    f"""WITH b AS (SELECT buyer, seller, count(*) AS n, sum(price * quantity) AS goods FROM market WHERE basis = 'ask' GROUP BY buyer, seller)
SELECT buyer, seller, n, {r('goods', 1)} AS goods, {r(f'(n * 500 + 2200)::DOUBLE * {JPY}::DOUBLE / n')} AS each_together, {r(f'2700::DOUBLE * {JPY}::DOUBLE')} AS each_alone, {r(f'n * (2700::DOUBLE * {JPY}::DOUBLE) - (n * 500 + 2200)::DOUBLE * {JPY}::DOUBLE')} AS saving FROM b""",
    "market",
)
def bundle_amortisation(spark, sf_dir):
    """Fees of a basket in one shipment against those of each item alone."""
    b = asks(spark, sf_dir).groupBy("buyer", "seller").agg(F.count("*").alias("n"), F.sum(F.col("price") * F.col("quantity")).alias("goods"))
    n = F.col("n")
    together = (n * 500 + 2200).cast("double") * JPY
    return b.select("buyer", "seller", "n", rounded("goods", 1).alias("goods"), rounded(together / n).alias("each_together"), rounded(F.lit(2700.0) * JPY).alias("each_alone"), rounded(n * (F.lit(2700.0) * JPY) - together).alias("saving"))


@query(
    f"""SELECT s.site AS buy_site, v.venue, s.buy, p.sell, {r("p.sell - s.buy")} AS margin, CASE WHEN s.site = v.venue THEN 'same_market' WHEN p.sell IS NULL THEN 'no_price' WHEN p.sell <= s.buy THEN 'no_margin' ELSE 'feasible' END AS verdict
FROM (SELECT site, {r("median(price)")} AS buy FROM market WHERE basis = 'ask' GROUP BY site) s CROSS JOIN {_VENUES} LEFT JOIN (SELECT site, {r("median(price)")} AS sell FROM market WHERE basis = 'sold' GROUP BY site) p ON p.site = v.venue""",
    "market",
)
def feasibility_matrix(spark, sf_dir):
    """Every market to buy in against every venue to sell in; the first obstacle is named."""
    m = market(spark, sf_dir)
    both = medians(m, ["basis", "site"], "price").withColumn("mid", rounded("mid"))
    buy = both.where("basis = 'ask'").select(F.col("site").alias("buy_site"), F.col("mid").alias("buy"))
    sell = both.where("basis = 'sold'").select(F.col("site").alias("venue"), F.col("mid").alias("sell"))
    v = spark.createDataFrame([(x[0],) for x in VENUES], "venue string")
    df = buy.crossJoin(F.broadcast(v)).join(sell, "venue", "left")
    verdict = F.when(F.col("buy_site") == F.col("venue"), "same_market").when(F.col("sell").isNull(), "no_price").when(F.col("sell") <= F.col("buy"), "no_margin").otherwise("feasible")
    return df.select("buy_site", "venue", "buy", "sell", rounded(F.col("sell") - F.col("buy")).alias("margin"), verdict.alias("verdict"))


