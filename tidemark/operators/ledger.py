"""State kept in ledgers: presence, alerts, upserts, retention, schedules. Each is also a plain batch query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.register import query
from tidemark.sources.views import market, observed, r, rounded, table


@query("SELECT site, count(*) AS n, CAST(count(*) FILTER (seen > 1) AS BIGINT) AS seen_again, min(first_at) AS first_at, max(last_at) AS last_at, CAST(sum(seen) AS BIGINT) AS observations FROM (SELECT site, key, count(*) AS seen, min(ts_s) AS first_at, max(ts_s) AS last_at FROM observed GROUP BY ALL) GROUP BY site", "observed")
def listing_obs_summary(spark, sf_dir):
    o = observed(spark, sf_dir).groupBy("site", "key").agg(F.count("*").alias("seen"), F.min("ts_s").alias("first_at"), F.max("ts_s").alias("last_at"))
    return o.groupBy("site").agg(F.count("*").alias("n"), F.count_if(F.col("seen") > 1).alias("seen_again"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("seen").alias("observations"))


def presence(seen: DataFrame) -> DataFrame:
    """State of each listing after all scans (one a day and site).

    A listing that the last scan of its site doesn't show has disappeared if it is newer than the horizon, the oldest
    first sighting among those shown; an older one may just have left the window.
    """
    state = seen.groupBy("site", "key").agg(F.min("ts_s").alias("first_at"), F.max("day").alias("last_day"), F.count_distinct("day").alias("scans"))
    last = seen.groupBy("site").agg(F.max("day").alias("scan_day"))
    df = state.join(last, "site")
    horizon = df.where("last_day = scan_day").groupBy("site").agg(F.min("first_at").alias("horizon"))
    df = df.join(horizon, "site", "left")
    status = F.when(F.col("last_day") == F.col("scan_day"), "present").when(F.col("horizon").isNull(), "unjudged").when(F.col("first_at") > F.col("horizon"), "disappeared").otherwise("window_exit")
    return df.select("site", "key", "scans", status.alias("status"))


@query(
    """WITH s AS (SELECT site, key, min(ts_s) AS first_at, max(day) AS last_day, count(DISTINCT day) AS scans FROM observed GROUP BY ALL), l AS (SELECT site, max(day) AS scan_day FROM observed GROUP BY site),
h AS (SELECT site, min(first_at) AS horizon FROM s JOIN l USING (site) WHERE last_day = scan_day GROUP BY site)
SELECT site, key, scans, CASE WHEN last_day = scan_day THEN 'present' WHEN horizon IS NULL THEN 'unjudged' WHEN first_at > horizon THEN 'disappeared' ELSE 'window_exit' END AS status FROM s JOIN l USING (site) LEFT JOIN h USING (site)""",
    "observed",
)
def presence_ledger(spark, sf_dir):
    return presence(observed(spark, sf_dir))


_GAPS = "SELECT key, day, lag(day) OVER (PARTITION BY key ORDER BY day) AS before FROM (SELECT DISTINCT key, day FROM observed)"


@query(f"WITH g AS ({_GAPS}), k AS (SELECT key, split_part(key, ':', 1) AS site, CAST(count(*) FILTER (day - before > 5) AS BIGINT) AS revived FROM g GROUP BY key) SELECT site, count(*) AS n, CAST(count(*) FILTER (revived > 0) AS BIGINT) AS ever_gone, {r('100.0::DOUBLE * count(*) FILTER (revived > 0) / count(*)', 1)} AS percent FROM k GROUP BY site", "observed")
def revive_rate(spark, sf_dir):
    """Listings seen again after more than five days away: the error rate of calling them gone."""
    w = Window.partitionBy("key").orderBy("day")
    g = observed(spark, sf_dir).select("key", "site", "day").distinct().withColumn("before", F.lag("day").over(w))
    k = g.groupBy("key", "site").agg(F.count_if(F.col("day") - F.col("before") > 5).alias("revived"))
    out = k.groupBy("site").agg(F.count("*").alias("n"), F.count_if(F.col("revived") > 0).alias("ever_gone"))
    return out.withColumn("percent", rounded(100.0 * F.col("ever_gone") / F.col("n"), 1))


def insert_ignore(kept: DataFrame, new: DataFrame, key: str, fill: str) -> DataFrame:
    """``kept`` with the rows of ``new`` whose key it lacks; of known keys only a null ``fill`` is filled."""
    one = new.groupBy(key).agg(F.min(fill).alias("new_fill"))
    known = kept.join(one, key, "left").withColumn(fill, F.coalesce(fill, "new_fill")).drop("new_fill")
    fresh = one.join(kept.select(key), key, "left_anti").withColumnRenamed("new_fill", fill)
    return known.unionByName(fresh.select(known.columns))


@query("WITH a AS (SELECT key, CASE WHEN min(k) < 10 THEN NULL ELSE min(seller) END AS seller FROM observed WHERE day % 2 = 0 GROUP BY key), b AS (SELECT key, min(seller) AS s FROM observed WHERE day % 2 = 1 GROUP BY key) SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN s ELSE coalesce(seller, s) END AS seller FROM a FULL JOIN b ON a.key = b.key", "observed")
def merge_insert_ignore(spark, sf_dir):
    df = observed(spark, sf_dir)
    a = df.where("day % 2 = 0").groupBy("key").agg(F.when(F.min("k") < 10, None).otherwise(F.min("seller")).alias("seller"))
    return insert_ignore(a, df.where("day % 2 = 1").select("key", "seller"), "key", "seller")


@query("SELECT key, min(ts_s) AS first_at, max(ts_s) AS last_at, count(*) AS seen, arg_max(price, event_id) AS price, arg_max(seller, event_id) FILTER (k > 20) AS seller FROM observed GROUP BY key", "observed")
def merge_upsert_sticky(spark, sf_dir):
    """Latest content wins, first sighting stays, and a lost seller never overwrites a known one."""
    known = F.when(F.col("k") > 20, F.struct("event_id", "seller"))
    out = observed(spark, sf_dir).groupBy("key").agg(F.min("ts_s").alias("first_at"), F.max("ts_s").alias("last_at"), F.count("*").alias("seen"), F.max_by("price", "event_id").alias("price"), F.max(known).alias("s"))
    return out.select("key", "first_at", "last_at", "seen", "price", F.col("s.seller").alias("seller"))


@query("SELECT day, key, arg_max(price, event_id) AS price FROM observed GROUP BY day, key", "observed")
def daily_snapshot(spark, sf_dir):
    """One row a day and key: the last of the day replaces the earlier ones."""
    return observed(spark, sf_dir).groupBy("day", "key").agg(F.max_by("price", "event_id").alias("price"))


@query(
    """WITH l AS (SELECT seller, count(*) AS listing_count, min(sold_at) AS a, max(sold_at) AS b FROM market WHERE basis = 'ask' GROUP BY seller), s AS (SELECT seller, count(*) AS sold_count, min(sold_at) AS a, max(sold_at) AS b FROM market WHERE basis = 'sold' GROUP BY seller)
SELECT seller, coalesce(listing_count, 0) AS listing_count, coalesce(sold_count, 0) AS sold_count, least(coalesce(l.a, s.a), coalesce(s.a, l.a)) AS first_at, greatest(coalesce(l.b, s.b), coalesce(s.b, l.b)) AS last_at FROM l FULL JOIN s USING (seller)""",
    "market",
)
def seller_ledger(spark, sf_dir):
    """Sellers from both ledgers, always recomputed."""
    m = market(spark, sf_dir)
    side = lambda b, n, x: m.where(f"basis = '{b}'").groupBy("seller").agg(F.count("*").alias(n), F.min("sold_at").alias(f"a{x}"), F.max("sold_at").alias(f"b{x}"))
    df = side("ask", "listing_count", 1).join(side("sold", "sold_count", 2), "seller", "full").na.fill(0, ["listing_count", "sold_count"])
    return df.select("seller", "listing_count", "sold_count", F.least("a1", "a2").alias("first_at"), F.greatest("b1", "b2").alias("last_at"))


@query("SELECT CASE WHEN last_day < m - 10 THEN 'expired' WHEN n = 1 THEN 'new' ELSE 'active' END AS state, count(*) AS n FROM (SELECT key, max(day) AS last_day, count(*) AS n FROM observed GROUP BY key) CROSS JOIN (SELECT max(day) AS m FROM observed) GROUP BY state", "observed")
def expire_stale(spark, sf_dir):
    df = observed(spark, sf_dir)
    k = df.groupBy("key").agg(F.max("day").alias("last_day"), F.count("*").alias("n")).crossJoin(F.broadcast(df.agg(F.max("day").alias("m"))))  # one row
    return k.groupBy(F.when(F.col("last_day") < F.col("m") - 10, "expired").when(F.col("n") == 1, "new").otherwise("active").alias("state")).agg(F.count("*").alias("n"))


@query("WITH k AS (SELECT DISTINCT site, seller, max(day) OVER (PARTITION BY site, seller) AS last_day, max(day) OVER () AS m FROM observed) SELECT site, seller, m - last_day AS age FROM k WHERE m - last_day >= 2 AND seller % 4 = m % 4", "observed")
def due_sellers(spark, sf_dir):
    """One of four batches in turn, and only sellers not scanned for two days."""
    df = observed(spark, sf_dir)
    k = df.groupBy("site", "seller").agg(F.max("day").alias("last_day")).crossJoin(F.broadcast(df.agg(F.max("day").alias("m"))))  # one row
    return k.where("m - last_day >= 2 AND seller % 4 = m % 4").select("site", "seller", (F.col("m") - F.col("last_day")).alias("age"))


def alert_steps(events: DataFrame) -> DataFrame:
    """Alerts of each source with cooldowns of 0, 72, 168, 168, ... hours between notices.

    The state (last notice, notices so far) depends on each event in turn: a fold over the source's events in order.
    Only failures are collected, and a source has few.
    """
    ordered = events.groupBy("key").agg(F.array_sort(F.collect_list("ts_s")).alias("times"))
    wait = lambda n: F.when(n == 0, 0).when(n == 1, 72 * 3600).otherwise(168 * 3600)
    zero = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("n"))
    step = lambda s, t: F.when(s["last"].isNull() | (t - s["last"] >= wait(s["n"])), F.struct(t.alias("last"), (s["n"] + 1).alias("n"))).otherwise(s)
    folded = F.aggregate("times", zero, step)
    return ordered.select("key", F.size("times").cast("long").alias("failures"), folded["n"].cast("long").alias("notices"), folded["last"].alias("last_notice"))


@query(
    """WITH RECURSIVE f AS (SELECT key, ts_s, row_number() OVER (PARTITION BY key ORDER BY ts_s) AS i FROM (SELECT concat_ws(':', event_type, user_id) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) WHERE k >= 70),
w AS (SELECT key, i, ts_s AS last, 1 AS n FROM f WHERE i = 1 UNION ALL SELECT w.key, f.i, CASE WHEN f.ts_s - w.last >= CASE w.n WHEN 0 THEN 0 WHEN 1 THEN 259200 ELSE 604800 END THEN f.ts_s ELSE w.last END, CASE WHEN f.ts_s - w.last >= CASE w.n WHEN 0 THEN 0 WHEN 1 THEN 259200 ELSE 604800 END THEN w.n + 1 ELSE w.n END FROM w JOIN f ON f.key = w.key AND f.i = w.i + 1)
SELECT key, max(i) AS failures, CAST(arg_max(n, i) AS BIGINT) AS notices, arg_max(last, i) AS last_notice FROM w GROUP BY key""",
)
def alert_cooldown(spark, sf_dir):
    return alert_steps(observed(spark, sf_dir).where("k >= 70").select("key", "ts_s"))


@query("WITH s AS (SELECT site, seller, day, lead(day) OVER (PARTITION BY site, seller ORDER BY day) AS next_day FROM (SELECT DISTINCT site, seller, day FROM observed)) SELECT site, seller, day + i AS missed_day FROM s, unnest(range(1, next_day - day)) AS u(i) WHERE next_day - day > 1", "observed")
def missed_slots(spark, sf_dir):
    """Days of a schedule on which a seller's page of a source had no run, between two runs."""
    w = Window.partitionBy("site", "seller").orderBy("day")
    s = observed(spark, sf_dir).select("site", "seller", "day").distinct().withColumn("next_day", F.lead("day").over(w)).where("next_day - day > 1")
    return s.select("site", "seller", F.explode(F.sequence(F.col("day") + 1, F.col("next_day") - 1)).alias("missed_day"))


@query("WITH h AS (SELECT key, arg_max(CASE WHEN k >= 98 THEN 'bought' WHEN k >= 95 THEN 'ignored' END, event_id) FILTER (k >= 95) AS human, arg_max(CASE WHEN price > 100 THEN 'new' ELSE 'seen' END, event_id) AS machine FROM observed GROUP BY key) SELECT key, coalesce(human, machine) AS state, human IS NOT NULL AS by_hand FROM h", "observed")
def triage_merge(spark, sf_dir):
    """A person's state is never overwritten by a later scan."""
    human = F.when(F.col("k") >= 95, F.struct("event_id", F.when(F.col("k") >= 98, "bought").otherwise("ignored").alias("s")))
    machine = F.when(F.col("price") > 100, "new").otherwise("seen")
    h = observed(spark, sf_dir).groupBy("key").agg(F.max(human).alias("h"), F.max_by(machine, "event_id").alias("machine"))
    return h.select("key", F.coalesce("h.s", "machine").alias("state"), F.col("h").isNotNull().alias("by_hand"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k_text, CAST(json_extract_string(props, '$.k') AS INT) * 2 AS doubled, json_extract_string(props, '$.none') AS absent FROM events")
def json_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k_text"), (k.cast("int") * 2).alias("doubled"), F.get_json_object("props", "$.none").alias("absent"))
