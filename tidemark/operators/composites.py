"""Queries that put operators together: ingest, search funnel, notification rules, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.money import GRADING_FEE, JPY, USD, quotes, quotes_sql
from tidemark.functions.text import folded
from tidemark.operators.aggregates import cells, paired_ratio
from tidemark.operators.filters import _REASON, reject_reason
from tidemark.operators.ledger import presence
from tidemark.operators.counting import medians
from tidemark.plans.register import query
from tidemark.sources.views import market, observed, r, rounded, table, titled


@query(f"SELECT site, kind, count(*) AS n, CAST(sum(floor(price * {USD}::DOUBLE + 0.5)) AS BIGINT) AS home_total, CAST(count(*) FILTER (sold_at % 172800 = 0) AS BIGINT) AS by_ingest_time FROM titled WHERE basis = 'sold' AND {_REASON} IS NULL GROUP BY site, kind", "titled")
def ingest_sold(spark, sf_dir):
    """Sales through the gate, at whole home prices without markup, with the origin of their times."""
    df = titled(market(spark, sf_dir).where("basis = 'sold'"))
    df = df.where(reject_reason(df).isNull())
    return df.groupBy("site", "kind").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("price") * USD + 0.5)).alias("home_total"), F.count_if(F.expr("sold_at % 172800 = 0")).alias("by_ingest_time"))


@query(
    f"""WITH t AS (SELECT DISTINCT key, site, price, title, rarity, grade FROM titled WHERE basis = 'ask'), c AS (SELECT *, {_REASON} AS reason FROM t), q AS ({quotes_sql("(SELECT * FROM c WHERE reason IS NULL)", "key, site, price")}), b AS (SELECT key, min(landed) AS landed FROM q GROUP BY key)
SELECT (SELECT count(*) FROM t) AS fetched, (SELECT count(*) FROM c WHERE reason IS NULL) AS candidates, count(*) AS routed, CAST(count(*) FILTER (landed <= 40000) AS BIGINT) AS in_budget FROM b""",
    "titled",
)
def market_search_funnel(spark, sf_dir):
    """How many listings each step of a search keeps; nothing over budget is dropped."""
    t = titled(market(spark, sf_dir).where("basis = 'ask'")).select("key", "site", "price", "title", "rarity", "grade").distinct()
    c = t.where(reject_reason(t).isNull())
    b = quotes(c.select("key", "site", "price")).groupBy("key").agg(F.min("landed").alias("landed"))
    counts = b.agg(F.count("*").alias("routed"), F.count_if(F.col("landed") <= 40000).alias("in_budget"))
    return t.agg(F.count("*").alias("fetched")).crossJoin(c.agg(F.count("*").alias("candidates"))).crossJoin(counts)  # one row each


@query(f"SELECT site, grader, count(*) AS returned, CAST(count(*) FILTER (reason IS NULL) AS BIGINT) AS candidates, {r('1 - count(*) FILTER (reason IS NULL) / nullif(CAST(count(*) AS DOUBLE), 0)', 4)} AS noise FROM (SELECT site, grader, {_REASON} AS reason FROM titled) GROUP BY site, grader", "titled")
def noise_rate(spark, sf_dir):
    df = titled(market(spark, sf_dir))
    out = df.groupBy("site", "grader").agg(F.count("*").alias("returned"), F.count_if(reject_reason(df).isNull()).alias("candidates"))
    return out.withColumn("noise", rounded(1 - F.col("candidates") / F.nullif(F.col("returned").cast("double"), F.lit(0.0)), 4))


@query("WITH w AS (SELECT p_partkey AS code, p_name AS name FROM part), d AS (SELECT p_name AS name, min(p_brand) AS by_name FROM part WHERE p_size > 10 GROUP BY p_name) SELECT w.code, CASE WHEN p.p_brand IS NOT NULL THEN 'code' WHEN d.by_name IS NOT NULL THEN 'name' ELSE 'unknown' END AS found, coalesce(p.p_brand, d.by_name) AS brand FROM w LEFT JOIN part p ON p.p_partkey = w.code AND p.p_size > 25 LEFT JOIN d USING (name)")
def master_lookup_priority(spark, sf_dir):
    """By code, else by name; what fails is named."""
    part = table(spark, sf_dir, "part")
    w = part.select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"))
    by_code = part.where("p_size > 25").select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("by_code"))
    by_name = part.where("p_size > 10").groupBy(F.col("p_name").alias("name")).agg(F.min("p_brand").alias("by_name"))
    df = w.join(by_code, "code", "left").join(by_name, "name", "left")
    found = F.when(F.col("by_code").isNotNull(), "code").when(F.col("by_name").isNotNull(), "name").otherwise("unknown")
    return df.select("code", found.alias("found"), F.coalesce("by_code", "by_name").alias("brand"))


@query("WITH o AS (SELECT key, arg_max(CASE WHEN k >= 30 THEN seller END, event_id) FILTER (k >= 30) AS known, arg_min(seller, event_id) AS first_seller FROM observed GROUP BY key) SELECT CASE WHEN known IS NULL THEN 'filled' WHEN known <> first_seller THEN 'kept' ELSE 'unchanged' END AS outcome, count(*) AS n FROM o GROUP BY outcome", "observed")
def conditional_update_counts(spark, sf_dir):
    """How many rows a fill-only update touches; run again it touches none."""
    o = observed(spark, sf_dir).groupBy("key").agg(F.max(F.when(F.col("k") >= 30, F.struct("event_id", "seller"))).alias("s"), F.min_by("seller", "event_id").alias("first"))
    outcome = F.when(F.col("s").isNull(), "filled").when(F.col("s.seller") != F.col("first"), "kept").otherwise("unchanged")
    return o.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


_RULES = "CASE WHEN k >= 90 AND price < 100 THEN 'urgent_auction' WHEN price < 20 THEN 'high_probability' WHEN seller % 10 = 3 THEN 'watched_seller' END"


@query(f"SELECT rule, key, min(event_id) AS event_id FROM (SELECT {_RULES} AS rule, key, event_id FROM observed) WHERE rule IS NOT NULL GROUP BY rule, key", "observed")
def notify_rules(spark, sf_dir):
    """The first match of each rule and key; a row matches the first rule that fits."""
    rule = F.when((F.col("k") >= 90) & (F.col("price") < 100), "urgent_auction").when(F.col("price") < 20, "high_probability").when(F.col("seller") % 10 == 3, "watched_seller")
    return observed(spark, sf_dir).withColumn("rule", rule).where("rule IS NOT NULL").groupBy("rule", "key").agg(F.min("event_id").alias("event_id"))


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN k < 90 THEN 'not_urgent' WHEN price >= 100 THEN 'over_ceiling' ELSE 'matched' END AS reason FROM observed) GROUP BY reason", "observed")
def notify_skip_reasons(spark, sf_dir):
    reason = F.when(F.col("k") < 90, "not_urgent").when(F.col("price") >= 100, "over_ceiling").otherwise("matched")
    return observed(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT reason, reason IN ('excluded_word', 'era_veto') AS expected, count(*) AS n, substr(min(title), 1, 30) AS example FROM (SELECT title, {_REASON} AS reason FROM titled) WHERE reason IS NOT NULL GROUP BY reason", "titled")
def rejection_digest(spark, sf_dir):
    """Counts by reason with one clipped example."""
    df = titled(market(spark, sf_dir))
    df = df.select("title", reject_reason(df).alias("reason")).where("reason IS NOT NULL")
    return df.groupBy("reason").agg(F.count("*").alias("n"), F.substring(F.min("title"), 1, 30).alias("example")).withColumn("expected", F.col("reason").isin("excluded_word", "era_veto"))


@query("WITH k AS (SELECT key, site, max(day) AS last_day FROM observed GROUP BY ALL), m AS (SELECT site, max(day) AS m FROM observed GROUP BY site) SELECT site, CASE WHEN last_day = m THEN 'live' WHEN m - last_day <= 3 THEN 'recent' ELSE 'gone' END AS state, count(*) AS n FROM k JOIN m USING (site) GROUP BY ALL", "observed")
def expiry_stats(spark, sf_dir):
    df = observed(spark, sf_dir)
    k = df.groupBy("key", "site").agg(F.max("day").alias("last_day")).join(df.groupBy("site").agg(F.max("day").alias("m")), "site")
    state = F.when(F.col("last_day") == F.col("m"), "live").when(F.col("m") - F.col("last_day") <= 3, "recent").otherwise("gone")
    return k.groupBy("site", state.alias("state")).agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT site, rarity, grader, grade, count(*) AS n, median(price) AS mid FROM market WHERE basis = 'ask' AND price > 0 GROUP BY ALL), p AS (SELECT a.site, CAST(floor(a.mid / b.mid * 1000 + 0.5) AS DOUBLE) / 1000 AS ratio FROM c a JOIN c b USING (rarity, grader, grade) WHERE a.n >= 4 AND b.n >= 4 AND a.site <> 'ASIA' AND b.site = 'ASIA'), g AS (SELECT site, count(*) AS strata, CAST(floor(median(ratio) * 10000 + 0.5) AS DOUBLE) / 10000 AS m FROM p GROUP BY site)
SELECT site, strata, CASE WHEN strata >= 3 THEN m END AS ask_over_base, CASE WHEN strata < 3 THEN 'insufficient' WHEN m < 0.9 THEN 'cheaper' WHEN m > 1.1 THEN 'dearer' ELSE 'same' END AS verdict FROM g""",
    "market",
)
def venue_q1(spark, sf_dir):
    """Asked prices of each market against a base market."""
    c = cells(market(spark, sf_dir).where("basis = 'ask'"))
    p = paired_ratio(c.where("site <> 'ASIA'"), c.where("site = 'ASIA'"), ["site"])
    m = F.col("ratio")
    verdict = F.when(m.isNull(), "insufficient").when(m < 0.9, "cheaper").when(m > 1.1, "dearer").otherwise("same")
    return p.select("site", "strata", F.col("ratio").alias("ask_over_base"), verdict.alias("verdict"))


@query("WITH i AS (SELECT DISTINCT CASE WHEN seller < 20 THEN 'low' ELSE 'high' END AS grp, site, concat_ws(':', split_part(key, ':', 2), day) AS item FROM observed), o AS (SELECT grp, item, min(site) AS site, count(*) AS sites FROM i GROUP BY ALL) SELECT grp, count(*) AS union_size, CAST(count(*) FILTER (sites = 1) AS BIGINT) AS by_one_only FROM o GROUP BY grp", "observed")
def recall_groups(spark, sf_dir):
    """Union and single-source finds in each group of variants."""
    grp = F.when(F.col("seller") < 20, "low").otherwise("high")
    i = observed(spark, sf_dir).select(grp.alias("grp"), "site", F.concat_ws(":", F.split_part("key", F.lit(":"), F.lit(2)), "day").alias("item")).distinct()
    return i.groupBy("grp", "item").agg(F.count("*").alias("sites")).groupBy("grp").agg(F.count("*").alias("union_size"), F.count_if(F.col("sites") == 1).alias("by_one_only"))


@query(
    """WITH s AS (SELECT site, key, max(seller) AS seller, min(ts_s) AS first_at, max(day) AS last_day FROM observed GROUP BY ALL), l AS (SELECT site, max(day) AS scan_day FROM observed GROUP BY site), h AS (SELECT site, min(first_at) AS horizon FROM s JOIN l USING (site) WHERE last_day = scan_day GROUP BY site),
p AS (SELECT site, key, seller, CASE WHEN last_day = scan_day THEN 'present' WHEN horizon IS NULL THEN 'unjudged' WHEN first_at > horizon THEN 'disappeared' ELSE 'window_exit' END AS status FROM s JOIN l USING (site) LEFT JOIN h USING (site))
SELECT site, key, CASE WHEN status = 'window_exit' AND seller % 5 = 0 THEN 'disappeared' ELSE status END AS status FROM p""",
    "observed",
)
def seller_scope_exit(spark, sf_dir):
    """A complete enumeration of a seller (every fifth here) proves that what it lacks is gone, whatever the horizon."""
    df = observed(spark, sf_dir)
    sellers = df.groupBy("site", "key").agg(F.max("seller").alias("seller"))
    p = presence(df).join(sellers, ["site", "key"])
    return p.select("site", "key", F.when((F.col("status") == "window_exit") & (F.col("seller") % 5 == 0), "disappeared").otherwise(F.col("status")).alias("status"))


@query("SELECT conv_id, count(*) AS turns, arg_min(text, turn) IS NOT NULL AS has_first FROM conversations GROUP BY conv_id")
def dossier_first_turns(spark, sf_dir):
    """The first message of each conversation, by aggregate."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by("text", "turn").isNotNull().alias("has_first"))
    return c


@query(f"WITH q AS ({quotes_sql('(SELECT DISTINCT key, site, price FROM market WHERE basis = ' + chr(39) + 'ask' + chr(39) + ')', 'key, site, price')}), b AS (SELECT site, min(landed) AS cost, count(DISTINCT key) AS n FROM q GROUP BY site), s AS (SELECT site AS sell_site, median(price) AS mid FROM market WHERE basis = 'sold' GROUP BY site) SELECT site, sell_site, {r(f'mid * {USD}::DOUBLE * 0.8::DOUBLE - cost - 2200 * {JPY}::DOUBLE')} AS gain, CASE WHEN site = sell_site THEN 'same_market' WHEN mid * {USD}::DOUBLE * 0.8::DOUBLE - cost - 2200 * {JPY}::DOUBLE > {GRADING_FEE}::DOUBLE THEN 'go' ELSE 'stay' END AS verdict FROM b CROSS JOIN s", "market")
def round_trips(spark, sf_dir):
    """Buying cheapest in one market and selling at the median in another, after fees and transfer."""
    m = market(spark, sf_dir)
    buy = quotes(m.where("basis = 'ask'").select("key", "site", "price").distinct()).groupBy("site").agg(F.min("landed").alias("cost"))
    sell = medians(m.where("basis = 'sold'"), ["site"], "price").select(F.col("site").alias("sell_site"), "mid")
    gain = F.col("mid") * USD * 0.8 - F.col("cost") - F.lit(2200) * JPY
    verdict = F.when(F.col("site") == F.col("sell_site"), "same_market").when(gain > GRADING_FEE, "go").otherwise("stay")
    return buy.crossJoin(F.broadcast(sell)).select("site", "sell_site", rounded(gain).alias("gain"), verdict.alias("verdict"))  # one row for each market


@query(None)
def fold_titles(spark, sf_dir):
    """Folded titles and how many spellings share each (Unicode folding has no SQL form)."""
    t = titled(market(spark, sf_dir)).select("title").distinct()
    return t.withColumn("folded", folded(F.col("title"))).groupBy("folded").agg(F.count("*").alias("spellings"))
