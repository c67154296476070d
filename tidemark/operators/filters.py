"""Filters, classifications and gates: every refusal is a value with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.register import query
from tidemark.sources.views import market, observed, r, rounded, titled


def reject_reason(df: DataFrame) -> Column:
    """The first check that fails, in order; null passes. An unknown grade passes."""
    return (
        F.when(F.col("title").rlike("proxy|reprint"), "excluded_word")
        .when(F.col("title").rlike("2[0-9]{3}$") & ~F.col("rarity").isin("PROMO"), "era_veto")
        .when(F.col("title").rlike("BGS [0-9]"), "grader_not_accepted")
        .when(~F.col("title").rlike("(PSA|ARS|BGS) [0-9]"), "unknown_grader")
        .when(F.col("grade") < 8, "grade_below_floor")
    )


_REASON = "CASE WHEN regexp_matches(title, 'proxy|reprint') THEN 'excluded_word' WHEN regexp_matches(title, '2[0-9]{3}$') AND rarity <> 'PROMO' THEN 'era_veto' WHEN regexp_matches(title, 'BGS [0-9]') THEN 'grader_not_accepted' WHEN NOT regexp_matches(title, '(PSA|ARS|BGS) [0-9]') THEN 'unknown_grader' WHEN grade < 8 THEN 'grade_below_floor' END"


@query(f"SELECT DISTINCT key, title, {_REASON} AS reason FROM titled WHERE basis = 'ask'", "titled")
def candidate_filter_reason(spark, sf_dir):
    df = titled(market(spark, sf_dir).where("basis = 'ask'"))
    return df.select("key", "title", reject_reason(df).alias("reason")).distinct()


@query(f"SELECT reason, count(*) AS n FROM (SELECT coalesce({_REASON}, 'accepted') AS reason FROM titled) GROUP BY reason ORDER BY n DESC, reason LIMIT 5", "titled")
def reject_reason_counts(spark, sf_dir):
    """The five most frequent reasons (a report)."""
    df = titled(market(spark, sf_dir))
    return df.select(F.coalesce(reject_reason(df), F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(5)


def where_given(df: DataFrame, **values) -> DataFrame:
    """Rows that equal each value that is given; None asks for nothing."""
    for column, value in values.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


@query("SELECT site, count(*) AS n, sum(quantity) AS quantity FROM market WHERE basis = 'sold' AND grade = 9 GROUP BY site", "market")
def filter_optional_predicates(spark, sf_dir):
    df = where_given(market(spark, sf_dir), basis="sold", grade=9, grader=None, site=None)
    return df.groupBy("site").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query("SELECT card, count(*) AS n, max(sold_at) AS last_at FROM market WHERE basis = 'sold' AND sold_at >= 915148800 AND kind = 'fixed' GROUP BY card", "market")
def comps_window(spark, sf_dir):
    """Sales since a fixed day; sales whose time is the ingest time stay out (kind fixed stands for true event time)."""
    return market(spark, sf_dir).where("basis = 'sold' AND sold_at >= 915148800 AND kind = 'fixed'").groupBy("card").agg(F.count("*").alias("n"), F.max("sold_at").alias("last_at"))


@query("SELECT price_kind, count(*) AS n FROM (SELECT CASE WHEN price > list_price THEN 'buyout' WHEN kind = 'auction' THEN 'bid' ELSE 'drop' END AS price_kind FROM market WHERE basis = 'ask') GROUP BY price_kind", "market")
def price_kind_classify(spark, sf_dir):
    """A buyout price wins; a bid counts only for auctions; the rest is dropped."""
    kind = F.when(F.col("price") > F.col("list_price"), "buyout").when(F.col("kind") == "auction", "bid").otherwise("drop")
    return market(spark, sf_dir).where("basis = 'ask'").groupBy(kind.alias("price_kind")).agg(F.count("*").alias("n"))


@query("SELECT site, sale_kind, count(*) AS n FROM (SELECT site, CASE WHEN site = 'AFRICA' THEN 'fixed' WHEN priority LIKE '1%' THEN 'auction' WHEN priority LIKE '2%' OR priority LIKE '3%' THEN kind ELSE 'unknown' END AS sale_kind FROM market) GROUP BY ALL", "market")
def sale_kind(spark, sf_dir):
    """Evidence in order: a market without auctions, a flag, an option; else unknown."""
    p = F.substring("priority", 1, 1)
    kind = F.when(F.col("site") == "AFRICA", "fixed").when(p == "1", "auction").when(p.isin("2", "3"), F.col("kind")).otherwise("unknown")
    return market(spark, sf_dir).groupBy("site", kind.alias("sale_kind")).agg(F.count("*").alias("n"))


@query(
    """WITH g AS (SELECT card, rarity, grade, count(*) AS n, count(DISTINCT seller) AS sellers FROM market WHERE basis = 'sold' GROUP BY ALL)
SELECT card, rarity, grade, n, CASE WHEN grade = 7 THEN 'grade_too_low' WHEN n < 3 THEN 'few_sales' WHEN n BETWEEN 10 AND 49 AND sellers < 8 THEN 'bucket_rejected' WHEN sellers < 2 THEN 'one_seller' END AS refusal,
  CASE WHEN n >= 50 AND sellers >= 10 THEN 'strong' WHEN n >= 10 THEN 'moderate' ELSE 'weak' END AS tier FROM g""",
    "market",
)
def evidence_gate(spark, sf_dir):
    """Ordered refusals, and how strong the evidence is."""
    g = market(spark, sf_dir).where("basis = 'sold'").groupBy("card", "rarity", "grade").agg(F.count("*").alias("n"), F.count_distinct("seller").alias("sellers"))
    n, s = F.col("n"), F.col("sellers")
    refusal = F.when(F.col("grade") == 7, "grade_too_low").when(n < 3, "few_sales").when(n.between(10, 49) & (s < 8), "bucket_rejected").when(s < 2, "one_seller")
    return g.select("card", "rarity", "grade", "n", refusal.alias("refusal"), F.when((n >= 50) & (s >= 10), "strong").when(n >= 10, "moderate").otherwise("weak").alias("tier"))


@query(
    """WITH o AS (SELECT key, min(ts_s) AS first_at, max(ts_s) AS last_at, arg_max(k, event_id) AS k FROM observed GROUP BY key), t AS (SELECT max(ts_s) AS now FROM observed)
SELECT key, CASE WHEN last_at + k * 3600 <= now THEN 'ended' WHEN last_at < now - 172800 THEN 'gone' ELSE 'live' END AS status, CASE WHEN last_at + k * 3600 <= now THEN 'certain' WHEN last_at < now - 172800 THEN 'inferred' ELSE 'none' END AS confidence FROM o CROSS JOIN t""",
    "observed",
)
def expiry_status(spark, sf_dir):
    """Ended before gone before live; now is the latest observation."""
    df = observed(spark, sf_dir)
    o = df.groupBy("key").agg(F.max("ts_s").alias("last_at"), F.max_by("k", "event_id").alias("k"))
    o = o.crossJoin(F.broadcast(df.agg(F.max("ts_s").alias("now"))))  # one row
    ended, gone = F.col("last_at") + F.col("k") * 3600 <= F.col("now"), F.col("last_at") < F.col("now") - 172800
    return o.select("key", F.when(ended, "ended").when(gone, "gone").otherwise("live").alias("status"), F.when(ended, "certain").when(gone, "inferred").otherwise("none").alias("confidence"))


@query("SELECT conv_id, turn, concat_ws(',', CASE WHEN role IS NULL OR role = '' THEN 'role' END, CASE WHEN text IS NULL OR text = '' THEN 'text' END, CASE WHEN turn % 5 = 0 THEN 'turn' END) AS missing FROM conversations")
def missing_fields(spark, sf_dir):
    """The required fields that a row lacks, by name (every fifth turn stands for a lost one)."""
    from tidemark.sources.views import table

    lost = [F.when(F.coalesce(F.col(c), F.lit("")) == "", c) for c in ("role", "text")] + [F.when(F.col("turn") % 5 == 0, "turn")]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_compact(F.array(*lost)), ",").alias("missing"))


@query("SELECT site, day, count(*) AS parsed, CASE WHEN count(*) = 0 THEN 'broken' WHEN count(*) < 40 THEN 'suspect' ELSE 'ok' END AS verdict FROM observed GROUP BY site, day", "observed")
def canary_verdict(spark, sf_dir):
    """Too few parsed rows for a source and day point at a broken parser."""
    n = F.col("parsed")
    return observed(spark, sf_dir).groupBy("site", "day").agg(F.count("*").alias("parsed")).withColumn("verdict", F.when(n == 0, "broken").when(n < 40, "suspect").otherwise("ok"))


@query("SELECT key, event_id, CASE WHEN site IN ('signup') THEN 'UNVERIFIABLE' WHEN k < 5 THEN 'UNVERIFIABLE' WHEN k < 15 THEN 'DELISTED' WHEN k > 80 THEN 'SOLD' ELSE 'STILL_LIVE' END AS verdict FROM observed", "observed")
def departure_verdict(spark, sf_dir):
    """What a check of a vanished listing proves; an unsupported source or a blocked fetch proves nothing."""
    k = F.col("k")
    v = F.when((F.col("site") == "signup") | (k < 5), "UNVERIFIABLE").when(k < 15, "DELISTED").when(k > 80, "SOLD").otherwise("STILL_LIVE")
    return observed(spark, sf_dir).select("key", "event_id", v.alias("verdict"))


@query(
    f"""WITH s AS (SELECT card, rarity, grade, count(*) AS n, quantile_cont(price, 0.25) AS lo, quantile_cont(price, 0.65) AS likely, quantile_cont(price, 0.75) AS hi FROM market WHERE basis = 'sold' GROUP BY ALL)
SELECT DISTINCT a.key, CASE WHEN n IS NULL OR n < 10 THEN 'insufficient_data' WHEN price <= lo * 0.9::DOUBLE THEN 'buy' WHEN price <= likely THEN 'fair' WHEN price <= hi THEN 'unlikely' ELSE 'too_dear' END AS verdict, {r("price / hi", 4)} AS against_high FROM market a LEFT JOIN s USING (card, rarity, grade) WHERE basis = 'ask'""",
    "market",
)
def decide_verdict(spark, sf_dir):
    """Enough data first, then the price against the interval; inside it, a price that fewer than 35 % of the sales reach is unlikely
    to be worth it."""
    m = market(spark, sf_dir)
    s = m.where("basis = 'sold'").groupBy("card", "rarity", "grade").agg(F.count("*").alias("n"), F.expr("percentile(price, array(0.25, 0.65, 0.75))").alias("q"))
    s = s.select("card", "rarity", "grade", "n", F.col("q")[0].alias("lo"), F.col("q")[1].alias("likely"), F.col("q")[2].alias("hi"))
    df = m.where("basis = 'ask'").join(s, ["card", "rarity", "grade"], "left")
    v = F.when(F.col("n").isNull() | (F.col("n") < 10), "insufficient_data").when(F.col("price") <= F.col("lo") * 0.9, "buy").when(F.col("price") <= F.col("likely"), "fair").when(F.col("price") <= F.col("hi"), "unlikely").otherwise("too_dear")
    return df.select("key", v.alias("verdict"), rounded(F.col("price") / F.col("hi"), 4).alias("against_high")).distinct()


@query(f"SELECT event_id, CASE WHEN {r('100 - price')} > 0 AND (ts_s % 86400) / 3600.0 > 0 AND (ts_s % 86400) / 3600.0 <= 6 THEN 1 WHEN {r('100 - price')} > 0 THEN 2 ELSE 3 END AS tier FROM observed", "observed")
def auction_tier(spark, sf_dir):
    """Room under the ceiling and an end within six hours: act now; room only: watch; no room: last."""
    room, hours = rounded(100 - F.col("price")), F.col("ts_s") % 86400 / 3600.0
    return observed(spark, sf_dir).select("event_id", F.when((room > 0) & (hours > 0) & (hours <= 6), 1).when(room > 0, 2).otherwise(3).alias("tier"))
