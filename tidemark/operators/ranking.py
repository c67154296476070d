"""Windows, orders and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.counting import placed
from tidemark.plans.register import query
from tidemark.sources.shared import kept
from tidemark.sources.views import market, observed, r, rounded


@query("SELECT DISTINCT card, seller, price, sold_at FROM (SELECT *, row_number() OVER (PARTITION BY card ORDER BY sold_at DESC, price DESC, seller, key) AS n FROM (SELECT DISTINCT key, card, seller, price, sold_at FROM market WHERE basis = 'sold')) WHERE n <= 8", "market")
def latest_samples(spark, sf_dir):
    """The eight latest sales of each card."""
    w = Window.partitionBy("card").orderBy(F.desc("sold_at"), F.desc("price"), "seller", "key")
    df = market(spark, sf_dir).where("basis = 'sold'").select("key", "card", "seller", "price", "sold_at").distinct()
    return df.withColumn("n", F.row_number().over(w)).where("n <= 8").select("card", "seller", "price", "sold_at").distinct()


@query("SELECT key, min(event_id) AS event_id, arg_min(price, event_id) AS price FROM observed GROUP BY key", "observed")
def dedupe_first(spark, sf_dir):
    """First seen wins; an aggregate, so no key is sorted in one task."""
    return observed(spark, sf_dir).groupBy("key").agg(F.min("event_id").alias("event_id"), F.min_by("price", "event_id").alias("price"))


def midrank(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Percent of the group's other rows below, ties counted half; a single row is at 100. Ranks come by counting."""
    ranked = placed(rows, list(by), value)
    ties = ranked.groupBy(*by, value).agg(F.min("place").alias("below_"), F.count("*").alias("ties_"))
    share = 100.0 * (F.col("below_") + 0.5 * (F.col("ties_") - 1)) / (F.col("of") - 1)
    df = ranked.join(ties, [*by, value])
    return df.withColumn("midrank", F.when(F.col("of") == 1, 100.0).otherwise(rounded(share, 4))).drop("place", "of", "below_", "ties_")


@query(
    f"""WITH s AS (SELECT site, seller, count(*) AS depth FROM market WHERE basis = 'ask' GROUP BY site, seller),
k AS (SELECT *, rank() OVER (PARTITION BY site ORDER BY depth) - 1 AS below, count(*) OVER (PARTITION BY site, depth) - 1 AS ties, count(*) OVER (PARTITION BY site) AS n FROM s)
SELECT site, seller, depth, CASE WHEN n = 1 THEN 100.0::DOUBLE ELSE {r("100.0::DOUBLE * (below + 0.5::DOUBLE * ties) / (n - 1)", 4)} END AS midrank FROM k""",
    "market",
)
def midrank_percentile(spark, sf_dir):
    """The depth of each seller's stock as a midrank within its market."""
    s = market(spark, sf_dir).where("basis = 'ask'").groupBy("site", "seller").agg(F.count("*").alias("depth"))
    return midrank(s, "depth", "site")


@query("WITH f AS (SELECT key, min(day) AS first_day FROM observed GROUP BY key) SELECT first_day AS day, count(*) AS net_new FROM f GROUP BY first_day", "observed")
def sequential_net_new(spark, sf_dir):
    """Keys that each day shows for the first time."""
    return observed(spark, sf_dir).groupBy("key").agg(F.min("day").alias("day")).groupBy("day").agg(F.count("*").alias("net_new"))


@query(
    """WITH k AS (SELECT site, sold_at, row_number() OVER (PARTITION BY site ORDER BY sold_at, key, buyer) AS i, count(*) OVER (PARTITION BY site) AS n FROM market WHERE basis = 'sold')
SELECT site, CASE WHEN i > floor(n * 0.7::DOUBLE) THEN 'test' ELSE 'fit' END AS part, count(*) AS n, min(sold_at) AS first_at, max(sold_at) AS last_at FROM k GROUP BY ALL""",
    "market",
)
def time_split_by_venue(spark, sf_dir):
    """The last three tenths of each market's sales are the test part."""
    df = placed(market(spark, sf_dir).where("basis = 'sold'").select("site", "sold_at", "key", "buyer"), ["site"], "sold_at", "key", "buyer")
    part = F.when(F.col("place") + 1 > F.floor(F.col("of") * 0.7), "test").otherwise("fit")
    return df.groupBy("site", part.alias("part")).agg(F.count("*").alias("n"), F.min("sold_at").alias("first_at"), F.max("sold_at").alias("last_at"))


@query("SELECT rule, key, price FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY price DESC, key) AS n FROM (SELECT DISTINCT CASE WHEN k >= 90 THEN 'urgent' WHEN k >= 60 THEN 'watched' ELSE 'other' END AS rule, key, price FROM observed)) WHERE n <= CASE rule WHEN 'urgent' THEN 20 WHEN 'watched' THEN 10 ELSE 5 END", "observed")
def cap_per_rule(spark, sf_dir):
    """The best of each rule, up to the rule's cap (a report)."""
    rule = F.when(F.col("k") >= 90, "urgent").when(F.col("k") >= 60, "watched").otherwise("other")
    df = observed(spark, sf_dir).select(rule.alias("rule"), "key", "price").distinct()
    cap = F.when(F.col("rule") == "urgent", 20).when(F.col("rule") == "watched", 10).otherwise(5)
    return df.withColumn("n", F.row_number().over(Window.partitionBy("rule").orderBy(F.desc("price"), "key"))).where((F.col("n") <= 20) & (F.col("n") <= cap)).drop("n")  # the largest cap as a number limits groups before the shuffle


@query("SELECT seller, max(sold_at) - min(sold_at) AS span_seconds, count(*) AS n FROM market GROUP BY seller", "market")
def seller_span(spark, sf_dir):
    return market(spark, sf_dir).groupBy("seller").agg((F.max("sold_at") - F.min("sold_at")).alias("span_seconds"), F.count("*").alias("n"))


@query("SELECT DISTINCT key, price, sold_at FROM (SELECT DISTINCT key, price, sold_at FROM market WHERE basis = 'ask' ORDER BY price DESC, sold_at DESC, key LIMIT 50)", "market")
def topk_signals(spark, sf_dir):
    df = market(spark, sf_dir).where("basis = 'ask'").select("key", "price", "sold_at").distinct()
    return df.orderBy(F.desc("price"), F.desc("sold_at"), "key").limit(50)


@query("SELECT key, price, p, position FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN price <= 1500 THEN 0 ELSE 1 END, coalesce(p, -1) DESC, price, key) AS position FROM (SELECT DISTINCT key, price, CASE WHEN quantity % 3 <> 0 THEN quantity / 50.0::DOUBLE END AS p FROM market WHERE basis = 'ask')) WHERE position <= 100", "market")
def market_search_order(spark, sf_dir):
    """Within budget first, then by probability (unknown last), then by cost: the first hundred, numbered."""
    p = F.when(F.col("quantity") % 3 != 0, F.col("quantity") / 50.0)
    df = market(spark, sf_dir).where("basis = 'ask'").select("key", "price", p.alias("p")).distinct()
    order = [F.when(F.col("price") <= 1500, 0).otherwise(1), F.coalesce("p", F.lit(-1.0)).desc(), F.col("price"), F.col("key")]
    top = df.orderBy(*order).limit(100)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))


@query("WITH o AS (SELECT key, min(site) AS owner, count(DISTINCT site) AS sites FROM (SELECT DISTINCT concat_ws(':', split_part(key, ':', 2), day) AS key, site FROM observed) GROUP BY key) SELECT owner AS site, count(*) AS gain FROM o WHERE sites = 1 GROUP BY owner", "observed")
def marginal_gains(spark, sf_dir):
    """Items that only one set has: what the union would lose without it."""
    items = observed(spark, sf_dir).select(F.concat_ws(":", F.split_part("key", F.lit(":"), F.lit(2)), "day").alias("item"), "site").distinct()
    owned = items.groupBy("item").agg(F.min("site").alias("site"), F.count("*").alias("sites")).where("sites = 1")
    return owned.groupBy("site").agg(F.count("*").alias("gain"))


@query("SELECT site, count(DISTINCT split_part(key, ':', 2)) AS own, (SELECT count(DISTINCT split_part(key, ':', 2)) FROM observed) AS union_size FROM observed GROUP BY site", "observed")
def union_size(spark, sf_dir):
    items = observed(spark, sf_dir).select(F.split_part("key", F.lit(":"), F.lit(2)).alias("item"), "site").distinct()
    total = items.select(F.count_distinct("item").alias("union_size"))
    return items.groupBy("site").agg(F.count("*").alias("own")).crossJoin(F.broadcast(total))  # one row


def cover_bitmaps(items: DataFrame) -> DataFrame:
    """site, block and bits: the items of each set as bitmaps of 32,768 items, numbered by their order in ranges.

    Items are numbered once; all further work is on bitmaps, of which a set has one for each block of numbers that it meets.
    """
    numbered = kept(items.select("item").distinct().repartitionByRange("item").withColumn("id", F.monotonically_increasing_id()), "cover-items")
    # Ids of one range follow each other from a multiple of 2^33, so blocks of a range are dense.
    placed_items = items.join(numbered, "item").select("site", "id")
    place = F.col("id") % (1 << 15)
    return placed_items.groupBy("site", F.shiftright("id", 15).alias("block")).agg(F.bitmap_construct_agg(place).alias("bits"))


def greedy_cover(items: DataFrame, most: int = 5) -> list[tuple[str, int]]:
    """Sets (column ``site``) in the order in which each adds most new items; ties go to the smaller name.

    What is covered is one row of bitmaps; a step joins it to the sets by block and counts bits, so items are read once and the
    plan of a step doesn't contain the steps before it. New items of a set are those of the union less those covered.
    """
    sets = kept(cover_bitmaps(items), "cover-sets")
    covered, out = None, []
    while len(out) < most:
        if covered is None:
            gain = sets.groupBy("site").agg(F.sum(F.bitmap_count("bits")).alias("gain"))
        else:
            both = sets.unionByName(sets.select("site", "block").join(covered, "block"))
            joined = both.groupBy("site", "block").agg(F.bitmap_or_agg("bits").alias("bits")).join(covered.select("block", F.bitmap_count("bits").alias("had")), "block", "left")
            gain = joined.groupBy("site").agg(F.sum(F.bitmap_count("bits") - F.coalesce("had", F.lit(0))).alias("gain"))
        best = gain.where(~F.col("site").isin([s for s, _ in out]) if out else F.lit(True)).where("gain > 0").orderBy(F.desc("gain"), "site").first()
        if best is None:
            break
        out.append((best["site"], best["gain"]))
        chosen = sets.where(F.col("site") == best["site"]).select("block", "bits")
        covered = kept(chosen if covered is None else covered.unionByName(chosen).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits")), "cover")
    return out


@query(None)
def greedy_max_cover(spark, sf_dir):
    items = observed(spark, sf_dir).select(F.concat_ws("@", F.split_part("key", F.lit(":"), F.lit(2)), "day").alias("item"), "site").distinct()
    chosen = greedy_cover(items)
    return spark.createDataFrame([(i, s, g) for i, (s, g) in enumerate(chosen)], "step int, site string, gain long")


@query("WITH a AS (SELECT key, 'ask' AS ledger, site, seller, price FROM market WHERE basis = 'ask'), s AS (SELECT key, 'sold' AS ledger, site, seller, price FROM market WHERE basis = 'sold') SELECT ledger, site, count(*) AS n, count(DISTINCT seller) AS sellers FROM (SELECT * FROM a UNION ALL SELECT * FROM s) GROUP BY ledger, site", "market")
def market_rows_union(spark, sf_dir):
    """Two ledgers in one shape."""
    m = market(spark, sf_dir)
    two = [m.where(f"basis = '{b}'").select("key", F.lit(b).alias("ledger"), "site", "seller", "price") for b in ("ask", "sold")]
    return two[0].unionByName(two[1]).groupBy("ledger", "site").agg(F.count("*").alias("n"), F.count_distinct("seller").alias("sellers"))


@query("SELECT query, min(pos) AS position FROM (SELECT concat_ws(' ', c.card, g.word) AS query, row_number() OVER (ORDER BY c.card, g.word) AS pos FROM (SELECT DISTINCT p_name AS card FROM part) c CROSS JOIN (VALUES ('ARS'), ('BGS'), ('PSA')) g(word)) GROUP BY query ORDER BY position LIMIT 100")
def expand_queries(spark, sf_dir):
    """Cards times graders as search phrases, in a stable order and up to a limit of 100."""
    from tidemark.sources.views import table

    words = spark.createDataFrame([("ARS",), ("BGS",), ("PSA",)], "word string")
    phrases = table(spark, sf_dir, "part").select(F.col("p_name").alias("card")).distinct().crossJoin(F.broadcast(words))
    top = phrases.select(F.concat_ws(" ", "card", "word").alias("query"), "card", "word").orderBy("card", "word").limit(100)
    return top.select("query", F.row_number().over(Window.orderBy("card", "word")).cast("long").alias("position"))


@query("WITH n AS (SELECT s_suppkey AS seller, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier) SELECT seller FROM n WHERE ((i - 7) % n + n) % n < ceil(n / 4.0)")
def shard_slice(spark, sf_dir):
    """A quarter of a list from a cursor on, around its end."""
    from tidemark.sources.views import table

    df = placed(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seller")), [], "seller")
    return df.where(F.pmod(F.col("place") - 7, F.col("of")) < F.ceil(F.col("of") / 4.0)).select("seller")
