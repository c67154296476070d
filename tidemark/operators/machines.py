"""State machines over ordered scans (alerts, presence), and the queries that put an item through every step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.money import VENUES, USD, cheapest, quotes_sql
from tidemark.operators.aggregates import asks_and_sales, with_best_tier
from tidemark.operators.joins import near_pairs
from tidemark.operators.ledger import presence
from tidemark.operators.model import ladder
from tidemark.operators.counting import medians
from tidemark.sources.shared import kept
from tidemark.plans.register import SQL, query
from tidemark.sources.views import market, observed, r, rounded

#: Failures in a row before the first notice, and days between notices.
IN_A_ROW, WAITS = 2, (0, 3, 7)


def alert_machine_of(scans: DataFrame) -> DataFrame:
    """Alerts of each source over its scans (site, day, severity 0 to 2) in order of days.

    A notice is due from the second failure in a row on, with growing waits between notices; a good scan after a notice is a
    recovery and starts afresh. The state depends on each scan in turn: a fold over the source's days, one entry each.
    """
    days = scans.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("day", "severity"))).alias("days"))
    day, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    zero = F.struct(F.lit(0).alias("fails"), F.lit(0).alias("worst"), F.lit(0).alias("told"), none.alias("last"), day.alias("alerts"), day.alias("recoveries"))

    def step(s, x):
        fails, worst = s["fails"] + 1, F.greatest(s["worst"], x["severity"])
        wait = F.when(s["told"] == 0, WAITS[0]).when(s["told"] == 1, WAITS[1]).otherwise(WAITS[2])
        due = (fails >= IN_A_ROW) & (s["last"].isNull() | (x["day"] - s["last"] >= wait))
        bad = F.struct(fails.alias("fails"), worst.alias("worst"), (s["told"] + due.cast("int")).alias("told"), F.when(due, x["day"]).otherwise(s["last"]).alias("last"), (s["alerts"] + due.cast("long")).alias("alerts"), s["recoveries"].alias("recoveries"))
        good = F.struct(F.lit(0).alias("fails"), F.lit(0).alias("worst"), F.lit(0).alias("told"), none.alias("last"), s["alerts"].alias("alerts"), (s["recoveries"] + (s["told"] > 0).cast("long")).alias("recoveries"))
        return F.when(x["severity"] > 0, bad).otherwise(good)

    end = F.aggregate("days", zero, step)
    return days.select("site", F.size("days").cast("long").alias("scans"), end["alerts"].alias("alerts"), end["recoveries"].alias("recoveries"), end["worst"].alias("worst"), (end["told"] > 0).alias("open"))


_DUE = f"(w.fails + 1 >= {IN_A_ROW} AND (w.last IS NULL OR f.day - w.last >= CASE w.told WHEN 0 THEN {WAITS[0]} WHEN 1 THEN {WAITS[1]} ELSE {WAITS[2]} END))"


@query(
    f"""WITH RECURSIVE f AS (SELECT site, day, severity, row_number() OVER (PARTITION BY site ORDER BY day) AS i FROM (SELECT event_type AS site, CAST(floor(floor(epoch(ts)) / 86400) AS BIGINT) AS day, CASE WHEN avg(value) > 58 THEN 2 WHEN avg(value) > 50 THEN 1 ELSE 0 END AS severity FROM events GROUP BY ALL)),
w AS (SELECT site, 0::BIGINT AS i, 0 AS fails, 0 AS worst, 0 AS told, NULL::BIGINT AS last, 0::BIGINT AS alerts, 0::BIGINT AS recoveries FROM (SELECT DISTINCT site FROM f)
UNION ALL SELECT w.site, f.i, CASE WHEN severity > 0 THEN w.fails + 1 ELSE 0 END, CASE WHEN severity > 0 THEN greatest(w.worst, severity) ELSE 0 END, CASE WHEN severity > 0 THEN w.told + CASE WHEN {_DUE} THEN 1 ELSE 0 END ELSE 0 END,
CASE WHEN severity > 0 THEN CASE WHEN {_DUE} THEN f.day ELSE w.last END END, w.alerts + CASE WHEN severity > 0 AND {_DUE} THEN 1 ELSE 0 END, w.recoveries + CASE WHEN severity = 0 AND w.told > 0 THEN 1 ELSE 0 END FROM w JOIN f ON f.site = w.site AND f.i = w.i + 1)
SELECT site, max(i) AS scans, arg_max(alerts, i) AS alerts, arg_max(recoveries, i) AS recoveries, CAST(arg_max(worst, i) AS INT) AS worst, arg_max(told, i) > 0 AS open FROM w GROUP BY site"""
)
def alert_machine(spark, sf_dir):
    """Notices, recoveries and open alerts of each source."""
    o = observed(spark, sf_dir).groupBy("site", "day").agg(F.avg("price").alias("level"))
    return alert_machine_of(o.select("site", "day", F.when(F.col("level") > 58, 2).when(F.col("level") > 50, 1).otherwise(0).alias("severity")))


#: Crashes, stalls and blocked runs in a row after which a shard is skipped.
LIMITS = {"crash": 2, "stall": 3, "blocked": 3}


def shard_cursor_of(runs: DataFrame) -> DataFrame:
    """Where each source's cursor stands after its runs (site, day, outcome: success, crash, stall or blocked).

    A success moves the cursor on and forgets the failures; a kind of failure that reaches its limit skips the shard. A fold over
    the source's runs in order, one entry for each day.
    """
    days = runs.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("day", "outcome"))).alias("days"))
    zero = F.struct(F.lit(0).cast("long").alias("cursor"), F.lit(0).cast("long").alias("skipped"), *[F.lit(0).alias(k) for k in LIMITS])

    def step(s, x):
        counts = {k: s[k] + (x["outcome"] == k).cast("int") for k in LIMITS}
        over = F.lit(False)
        for k, n in LIMITS.items():
            over = over | (counts[k] >= n)
        on = (x["outcome"] == "success") | over
        kept = [F.when(on, 0).otherwise(counts[k]).alias(k) for k in LIMITS]
        return F.struct((s["cursor"] + on.cast("long")).alias("cursor"), (s["skipped"] + over.cast("long")).alias("skipped"), *kept)

    end = F.aggregate("days", zero, step)
    return days.select("site", F.size("days").cast("long").alias("runs"), end["cursor"].alias("cursor"), end["skipped"].alias("skipped"), *[end[k].alias(f"{k}s") for k in LIMITS])


_OVER = " OR ".join(f"w.{k} + CASE WHEN outcome = '{k}' THEN 1 ELSE 0 END >= {n}" for k, n in LIMITS.items())


@query(
    f"""WITH RECURSIVE f AS (SELECT site, day, outcome, row_number() OVER (PARTITION BY site ORDER BY day) AS i FROM (SELECT event_type AS site, CAST(floor(floor(epoch(ts)) / 86400) AS BIGINT) AS day, CASE WHEN sum(event_id) % 5 < 2 THEN 'success' WHEN sum(event_id) % 5 = 2 THEN 'crash' WHEN sum(event_id) % 5 = 3 THEN 'stall' ELSE 'blocked' END AS outcome FROM events GROUP BY ALL)),
w AS (SELECT site, 0::BIGINT AS i, 0::BIGINT AS cursor, 0::BIGINT AS skipped, {', '.join(f'0 AS {k}' for k in LIMITS)} FROM (SELECT DISTINCT site FROM f)
UNION ALL SELECT w.site, f.i, w.cursor + CASE WHEN outcome = 'success' OR {_OVER} THEN 1 ELSE 0 END, w.skipped + CASE WHEN {_OVER} THEN 1 ELSE 0 END, {', '.join(f"CASE WHEN outcome = 'success' OR {_OVER} THEN 0 ELSE w.{k} + CASE WHEN outcome = '{k}' THEN 1 ELSE 0 END END" for k in LIMITS)} FROM w JOIN f ON f.site = w.site AND f.i = w.i + 1)
SELECT site, max(i) AS runs, arg_max(cursor, i) AS cursor, arg_max(skipped, i) AS skipped, {', '.join(f'CAST(arg_max({k}, i) AS INT) AS {k}s' for k in LIMITS)} FROM w GROUP BY site"""
)
def shard_cursor_log(spark, sf_dir):
    """Cursors of the sources with crashes, stalls and blocks accounted for."""
    o = observed(spark, sf_dir).groupBy("site", "day").agg((F.sum("event_id") % 5).alias("x"))
    x = F.col("x")
    return shard_cursor_of(o.select("site", "day", F.when(x < 2, "success").when(x == 2, "crash").when(x == 3, "stall").otherwise("blocked").alias("outcome")))


@query("WITH k AS (SELECT key, max(event_id) AS last_id FROM observed GROUP BY key), m AS (SELECT max(day) AS now FROM observed) SELECT site, CASE WHEN event_id = last_id THEN 'kept_as_latest' WHEN day >= now - 7 THEN 'kept_as_recent' ELSE 'pruned' END AS fate, count(*) AS n FROM observed JOIN k USING (key) CROSS JOIN m GROUP BY ALL", "observed")
def prune_obs(spark, sf_dir):
    """What retention keeps: the last sighting of every key whatever its age, and a week of all others."""
    df = observed(spark, sf_dir)
    last = df.groupBy("key").agg(F.max("event_id").alias("last_id"))
    df = df.join(last, "key").crossJoin(F.broadcast(df.agg(F.max("day").alias("now"))))  # one row
    fate = F.when(F.col("event_id") == F.col("last_id"), "kept_as_latest").when(F.col("day") >= F.col("now") - 7, "kept_as_recent").otherwise("pruned")
    return df.groupBy("site", fate.alias("fate")).agg(F.count("*").alias("n"))


HEALTHY = 3


@query(
    f"""WITH ok AS (SELECT site, day FROM observed GROUP BY ALL HAVING count(*) >= {HEALTHY}), s AS (SELECT site, key, min(ts_s) AS first_at, max(day) AS last_day, count(DISTINCT day) AS scans FROM observed JOIN ok USING (site, day) GROUP BY ALL), l AS (SELECT site, max(day) AS scan_day FROM ok GROUP BY site),
h AS (SELECT site, min(first_at) AS horizon FROM s JOIN l USING (site) WHERE last_day = scan_day GROUP BY site)
SELECT site, CASE WHEN last_day = scan_day THEN 'present' WHEN horizon IS NULL THEN 'unjudged' WHEN first_at > horizon THEN 'disappeared' ELSE 'window_exit' END AS status, count(*) AS n, CAST(sum(scans) AS BIGINT) AS scans FROM s JOIN l USING (site) LEFT JOIN h USING (site) GROUP BY ALL""",
    "observed",
)
def presence_of_healthy_scans(spark, sf_dir):
    """The presence ledger over healthy scans only: a scan of a source that yields too little proves nothing about what it lacks."""
    df = observed(spark, sf_dir)
    ok = df.groupBy("site", "day").agg(F.count("*").alias("rows")).where(F.col("rows") >= HEALTHY).select("site", "day")
    return presence(df.join(ok, ["site", "day"])).groupBy("site", "status").agg(F.count("*").alias("n"), F.sum("scans").alias("scans"))


@query(
    f"""SELECT a.key, b.key AS other, CASE WHEN a.grader <> b.grader THEN 'conflict' ELSE 'duplicate' END AS verdict, {r('a.price / b.price', 4)} AS ratio FROM market a JOIN market b ON a.part_key = b.part_key AND a.site < b.site AND abs(a.sold_at - b.sold_at) <= 3600 AND a.price / b.price BETWEEN 0.9::DOUBLE AND 1.1::DOUBLE""",
    "market",
)
def dual_listing_rule(spark, sf_dir):
    """The same card at about the same price in two markets within an hour; attributes that differ make it a conflict, not a duplicate."""
    ratio = F.col("a.price") / F.col("b.price")
    pairs = near_pairs(spark, sf_dir, ["l_partkey"], 3600, ["grader", "price"]).where(ratio.between(0.9, 1.1))
    return pairs.select("key", "other", F.when(F.col("a.grader") != F.col("b.grader"), "conflict").otherwise("duplicate").alias("verdict"), rounded(ratio, 4).alias("ratio"))


_SPLIT = "CASE WHEN fair IS NULL THEN 'no_estimate' WHEN comps IS NULL OR comps < 3 THEN 'few_sales' WHEN landed IS NULL THEN 'no_route' WHEN landed <= 0.8::DOUBLE * fair_home THEN 'buy' WHEN landed <= fair_home THEN 'fair' ELSE 'too_dear' END"


@query(
    f"""WITH l AS (SELECT DISTINCT key, site, price, card, rarity, grade FROM market WHERE basis = 'ask'), q AS ({quotes_sql("(SELECT DISTINCT key, site, price FROM l)", "key, site, price")}), b AS (SELECT key, min(landed) AS landed FROM q GROUP BY key), v AS ({SQL['valuation_ladder']}), c AS ({SQL['comparables_best_tier']}),
x AS (SELECT l.key, l.card, landed, fair, fair * {USD}::DOUBLE AS fair_home, c.n AS comps, c.tier FROM l LEFT JOIN b USING (key) LEFT JOIN v USING (card, rarity, grade) LEFT JOIN c ON c.key = l.key AND c.card = l.card)
SELECT key, card, {r('landed', 2)} AS landed, fair, comps, tier, {_SPLIT} AS verdict FROM x""",
    "market",
)
def appraise(spark, sf_dir):
    """A listing through every step: cheapest route, fair value, comparable sales, and the verdict or why there is none."""
    m = asks_and_sales(spark, sf_dir)
    # Listings are dealt by key once: for the distinct ones, and for the cheapest route of a key.
    l = m.where("basis = 'ask'").select("key", "site", "price", "card", "rarity", "grader", "grade").repartition("key").distinct()  # noqa: E741
    b = l.withColumn("landed", F.min(cheapest()).over(Window.partitionBy("key")))
    sold = m.where("basis = 'sold' AND price > 0").select("card", "rarity", "grade", F.ln("price").alias("lp"))
    v = kept(ladder(sold).select("card", "rarity", "grade", rounded(F.exp("est"), 4).alias("fair")), "ladder")
    x = with_best_tier(b.join(v, ["card", "rarity", "grade"], "left"), m).withColumns({"fair_home": F.col("fair") * USD, "comps": F.col("n")})
    return x.select("key", "card", rounded("landed").alias("landed"), "fair", "comps", "tier", F.expr(_SPLIT.replace("0.8::DOUBLE", "0.8D")).alias("verdict"))


_SALE_VENUES = "(VALUES " + ", ".join(f"('{v}', {c}::DOUBLE, {p}::DOUBLE, {x}::DOUBLE, {s}::DOUBLE)" for v, c, p, x, s in VENUES) + ") w(venue, commission, payment, fixed, shipping)"


@query(
    f"""WITH p AS (SELECT site, rarity, quantile_cont(price, 0.25) AS low, count(*) AS n FROM market WHERE basis = 'sold' GROUP BY site, rarity), o AS (SELECT p.rarity, venue, n, low * (1 - commission - payment) - fixed - shipping AS net FROM p JOIN {_SALE_VENUES} ON venue = p.site UNION ALL SELECT rarity, 'hold', CAST(sum(n) AS BIGINT), 0.0::DOUBLE FROM p GROUP BY rarity)
SELECT rarity, venue, n, {r('net', 2)} AS net, CASE WHEN venue = 'hold' THEN 'hold' WHEN n < 10 THEN 'few_sales' WHEN net <= 0 THEN 'loss' ELSE 'sell' END AS verdict FROM o""",
    "market",
)
def sell_options(spark, sf_dir):
    """Where a kind of card could be sold, at the low quarter of the venue's own sales less its costs, and the choice to hold."""
    p = kept(medians(market(spark, sf_dir).where("basis = 'sold'"), ["site", "rarity"], "price", "low", 0.25), "low-prices")
    w = spark.createDataFrame([tuple(v) for v in VENUES], "venue string, commission double, payment double, fixed double, shipping double")
    sold = p.join(F.broadcast(w), F.col("venue") == F.col("site"))  # a fixed list of venues
    o = sold.select("rarity", "venue", "n", (F.col("low") * (1 - F.col("commission") - F.col("payment")) - F.col("fixed") - F.col("shipping")).alias("net"))
    o = o.union(p.groupBy("rarity").agg(F.sum("n").alias("n")).select("rarity", F.lit("hold").alias("venue"), "n", F.lit(0.0).alias("net")))
    verdict = F.when(F.col("venue") == "hold", "hold").when(F.col("n") < 10, "few_sales").when(F.col("net") <= 0, "loss").otherwise("sell")
    return o.select("rarity", "venue", "n", rounded("net").alias("net"), verdict.alias("verdict"))


@query("WITH s AS (SELECT site, day, count(*) AS rows, max(ts_s) - min(ts_s) AS took, bool_or(k >= 98) AS verified FROM observed GROUP BY ALL) SELECT site, CASE WHEN took > 72000 THEN 'timeout' WHEN verified THEN 'verified' ELSE 'finished' END AS status, count(*) AS runs, CAST(sum(rows) AS BIGINT) AS rows FROM s GROUP BY ALL", "observed")
def run_log(spark, sf_dir):
    """The log of runs by how they ended."""
    s = observed(spark, sf_dir).groupBy("site", "day").agg(F.count("*").alias("rows"), (F.max("ts_s") - F.min("ts_s")).alias("took"), F.bool_or(F.col("k") >= 98).alias("verified"))
    status = F.when(F.col("took") > 72000, "timeout").when(F.col("verified"), "verified").otherwise("finished")
    return s.groupBy("site", status.alias("status")).agg(F.count("*").alias("runs"), F.sum("rows").alias("rows"))


@query("WITH t AS (SELECT max(ts_s) AS now FROM observed) SELECT unit, count(*) AS n FROM (SELECT CASE WHEN now - ts_s < 3600 THEN 'minutes' WHEN now - ts_s < 86400 THEN 'hours' WHEN now - ts_s < 2592000 THEN 'days' ELSE 'months' END AS unit FROM observed CROSS JOIN t) GROUP BY unit", "observed")
def ages_in_words(spark, sf_dir):
    """How long ago each observation was, in the unit that a person would use."""
    df = observed(spark, sf_dir)
    age = F.col("now") - F.col("ts_s")
    unit = F.when(age < 3600, "minutes").when(age < 86400, "hours").when(age < 2592000, "days").otherwise("months")
    return df.crossJoin(F.broadcast(df.agg(F.max("ts_s").alias("now")))).groupBy(unit.alias("unit")).agg(F.count("*").alias("n"))  # one row
