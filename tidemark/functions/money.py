"""Exchange, purchase routes, sale proceeds and bid ceilings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.views import rounded

#: Rates to the home currency, markup and safety buffer of card payments, grading fee.
JPY, USD = 0.21, 31.5
CARD_MARKUP, SAFETY_BUFFER = 0.015, 0.02
GRADING_FEE = 1000.0
#: Fees of each route in yen for an order, fees of a shipment in yen, items in a shipment, and the markets it serves.
ROUTES = (
    ("consolidated", 500, 0, 300, 700, 2200, 5, ("ASIA", "EUROPE")),
    ("single", 500, 0, 300, 0, 1400, 1, ("ASIA", "EUROPE")),
    ("pickup", 500, 0, 0, 0, 900, 1, ("ASIA", "AFRICA")),
    ("local", 0, 0, 300, 0, 0, 1, ("MIDDLE EAST",)),
    ("direct", 0, 0, 0, 0, 0, 1, ("AMERICA",)),
)
DIRECT_SHIPPING = 25.0  # dollars, where a direct listing doesn't say
#: Commission, payment share, fixed costs in dollars of each sale venue, payout batch, spread of the exchange.
VENUES = (("AMERICA", 0.1325, 0.03, 0.4, 18.0), ("ASIA", 0.10, 0.0, 0.0, 6.0), ("EUROPE", 0.12, 0.02, 0.3, 22.0))
REMITTANCE, BATCH, SPREAD = 15.0, 5, 0.01


def to_home(amount: Column | float, rate: float, markup: bool = True) -> Column:
    """Home currency; with the markup and the buffer when a card pays for it."""
    amount = amount if isinstance(amount, Column) else F.lit(amount)
    out = amount * F.lit(rate)
    return out * F.lit((1 + CARD_MARKUP) * (1 + SAFETY_BUFFER)) if markup else out


def routes(spark: SparkSession) -> DataFrame:
    """One row for each route and market that it serves: a fixed, small table."""
    rows = [(name, site, float(fee + plan + inland), float(box + abroad), n, name == "direct") for name, fee, plan, inland, box, abroad, n, sites in ROUTES for site in sites]
    return spark.createDataFrame(rows, "route string, route_site string, order_fee double, shipment_fee double, bundle int, direct boolean")


def quotes(listings: DataFrame) -> DataFrame:
    """Every route of every listing (site, price) with its landed cost."""
    r = F.broadcast(routes(listings.sparkSession))  # ten rows, by construction
    df = listings.join(r, F.col("site") == F.col("route_site")).drop("route_site")
    item = rounded(F.when(F.col("direct"), to_home(F.col("price"), USD)).otherwise(to_home(F.col("price"), USD, False)))
    fee = rounded(to_home(F.col("order_fee"), JPY))
    ship = rounded(F.when(F.col("direct"), to_home(DIRECT_SHIPPING, USD)).otherwise(to_home(F.col("shipment_fee") / F.greatest(F.lit(1), F.col("bundle")), JPY)))
    df = df.withColumn("item_cost", item).withColumn("fee_cost", fee).withColumn("ship_cost", ship)
    return df.withColumn("landed", rounded(F.col("item_cost") + F.col("fee_cost") + F.col("ship_cost"))).drop("order_fee", "shipment_fee", "bundle", "direct")


def cheapest() -> Column:
    """The least landed cost of a listing (site, price) over the routes of its market, without a row for each; null if there is none."""
    costs = []
    for name, fee, plan, inland, box, abroad, n, sites in ROUTES:
        direct = name == "direct"
        ship = to_home(DIRECT_SHIPPING, USD) if direct else to_home(F.lit(float(box + abroad)) / max(1, n), JPY)
        landed = rounded(rounded(to_home(F.col("price"), USD, direct)) + rounded(to_home(float(fee + plan + inland), JPY)) + rounded(ship))
        costs.append(F.when(F.col("site").isin(*sites), landed))
    return F.least(*costs)


def overhead(df: DataFrame) -> Column:
    return F.when(F.col("landed") > 0, (F.col("fee_cost") + F.col("ship_cost")) / F.col("landed")).otherwise(0.0)


_UP = f"{(1 + CARD_MARKUP) * (1 + SAFETY_BUFFER)!r}::DOUBLE"


def _r(x: str) -> str:
    return f"(CAST(floor(({x}) * 100 + 0.5) AS DOUBLE) / 100)"


ROUTES_SQL = "(VALUES " + ", ".join(f"('{name}', '{site}', {fee + plan + inland}::DOUBLE, {box + abroad}::DOUBLE, {n}, {str(name == 'direct').upper()})" for name, fee, plan, inland, box, abroad, n, sites in ROUTES for site in sites) + ") AS r(route, route_site, order_fee, shipment_fee, bundle, direct)"


def quotes_sql(listings: str, columns: str) -> str:
    return f"""SELECT {columns}, route, item_cost, fee_cost, ship_cost, {_r("item_cost + fee_cost + ship_cost")} AS landed FROM (
  SELECT *, CASE WHEN direct THEN {_r(f"(price * {USD}::DOUBLE) * {_UP}")} ELSE {_r(f"price * {USD}::DOUBLE")} END AS item_cost, {_r(f"(order_fee * {JPY}::DOUBLE) * {_UP}")} AS fee_cost,
    CASE WHEN direct THEN {_r(f"({DIRECT_SHIPPING}::DOUBLE * {USD}::DOUBLE) * {_UP}")} ELSE {_r(f"(shipment_fee / bundle * {JPY}::DOUBLE) * {_UP}")} END AS ship_cost
  FROM {listings} JOIN {ROUTES_SQL} ON site = route_site)"""
