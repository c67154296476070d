"""Watching: what is admitted, due, live, healthy and told; projections of listings to ledgers; rankings of sellers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.money import USD, to_home
from tidemark.operators.counting import placed, sorted_medians
from tidemark.operators.filters import evidence_gate
from tidemark.operators.money import bid_ceiling
from tidemark.operators.sellers import _METRICS, _RATIOS, concentration, levels, metrics, ratios, scores, seller_score, stock
from tidemark.operators.model import _CURVE, _LADDER, _SAMPLES, ladder
from tidemark.plans.register import SQL, query
from tidemark.sources.shared import kept
from tidemark.sources.views import market, observed, r, rounded, table, titled


@query("SELECT tier, count(*) AS n, CAST(count(*) FILTER (refusal IS NOT NULL) AS BIGINT) AS refused FROM (" + SQL["evidence_gate"] + ") GROUP BY tier")
def evidence_tier(spark, sf_dir):
    """How strong the evidence is, over all cells."""
    return evidence_gate(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"), F.count_if(F.col("refusal").isNotNull()).alias("refused"))


@query("SELECT basis, kind, CASE WHEN basis = 'sold' THEN 'sold' WHEN kind = 'auction' THEN 'bid' ELSE 'ask' END AS price_basis, count(*) AS n FROM market GROUP BY ALL", "market")
def price_basis(spark, sf_dir):
    """What a price stands for: a sale, a running bid or an asking price."""
    mapped = F.when(F.col("basis") == "sold", "sold").when(F.col("kind") == "auction", "bid").otherwise("ask")
    return market(spark, sf_dir).groupBy("basis", "kind", mapped.alias("price_basis")).agg(F.count("*").alias("n"))


_SHIPS = "CASE WHEN seller % 5 = 0 THEN ['WORLDWIDE'] WHEN seller % 5 = 1 THEN [site] WHEN seller % 5 = 2 THEN ['ASIA', 'EUROPE'] ELSE CAST([] AS VARCHAR[]) END AS included, CASE WHEN seller % 10 = 0 THEN ['ASIA'] ELSE CAST([] AS VARCHAR[]) END AS excluded"


@query(f"SELECT ships, count(*) AS n FROM (SELECT CASE WHEN list_contains(excluded, 'ASIA') THEN false WHEN list_contains(included, 'ASIA') OR list_contains(included, 'WORLDWIDE') THEN true WHEN len(included) > 0 THEN false END AS ships FROM (SELECT key, {_SHIPS} FROM market WHERE basis = 'ask')) GROUP BY ships", "market")
def ship_to(spark, sf_dir):
    """Whether a listing ships to one region: an exclusion beats any inclusion, and nothing stated is unknown."""
    s, none = F.col("seller"), F.array().cast("array<string>")
    included = F.when(s % 5 == 0, F.array(F.lit("WORLDWIDE"))).when(s % 5 == 1, F.array("site")).when(s % 5 == 2, F.array(F.lit("ASIA"), F.lit("EUROPE"))).otherwise(none)
    df = market(spark, sf_dir).where("basis = 'ask'").select(included.alias("included"), F.when(s % 10 == 0, F.array(F.lit("ASIA"))).otherwise(none).alias("excluded"))
    ships = F.when(F.array_contains("excluded", "ASIA"), False).when(F.arrays_overlap("included", F.array(F.lit("ASIA"), F.lit("WORLDWIDE"))), True).when(F.size("included") > 0, False)
    return df.groupBy(ships.alias("ships")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS payloads, CAST(count(*) FILTER (event_id % 7 <> 0) AS BIGINT) AS restored, CAST(sum(CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INT) END) AS BIGINT) AS total FROM events GROUP BY event_type")
def payload_restore(spark, sf_dir):
    """Rows restored from stored payloads; a broken payload (every seventh is cut short here) gives none and stops nothing."""
    e = table(spark, sf_dir, "events")
    payload = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 5)).otherwise(F.col("props"))
    e = e.select("event_type", F.from_json(payload, "k int", {"mode": "PERMISSIVE"})["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("payloads"), F.count("k").alias("restored"), F.sum("k").alias("total"))


_CURRENCY = "CASE site WHEN 'ASIA' THEN 'JPY' WHEN 'AMERICA' THEN 'USD' ELSE 'EUR' END"
_SHIPPING = "CASE WHEN seller % 3 = 0 THEN 'USD' WHEN seller % 3 = 1 THEN 'JPY' ELSE 'EUR' END"


@query(f"SELECT site, currency, count(*) AS n, CAST(count(*) FILTER (ship = currency) AS BIGINT) AS with_shipping, {r('sum(price)', 0)} AS native FROM (SELECT site, {_CURRENCY} AS currency, {_SHIPPING} AS ship, price FROM market WHERE basis = 'ask') GROUP BY site, currency", "market")
def native_price_rate(spark, sf_dir):
    """Prices with the currency of their own node; shipping in another currency counts as unknown, never as a number."""
    node = F.struct(F.expr(_CURRENCY).alias("currency"), F.col("price").alias("amount"))
    ship = F.struct(F.expr(_SHIPPING).alias("currency"), F.lit(5.0).alias("amount"))
    df = market(spark, sf_dir).where("basis = 'ask'").select("site", node.alias("price"), ship.alias("shipping"))
    df = df.withColumn("fee", F.when(F.col("shipping.currency") == F.col("price.currency"), F.col("shipping.amount")))
    return df.groupBy("site", F.col("price.currency").alias("currency")).agg(F.count("*").alias("n"), F.count("fee").alias("with_shipping"), rounded(F.sum("price.amount"), 0).alias("native"))


@query("WITH d AS (SELECT site, day, count(*) FILTER (k >= 20) AS parsed, max(k) FILTER (k < 90) AS said, bool_or(k BETWEEN 30 AND 60) AS landmark FROM observed GROUP BY ALL) SELECT site, CASE WHEN parsed > 0 THEN 'ok' WHEN said > 0 THEN 'broken' WHEN landmark THEN 'empty' ELSE 'no_landmark' END AS health, count(*) AS days FROM d GROUP BY ALL", "observed")
def health_judgement(spark, sf_dir):
    """A page that names results but yields none is broken; one that says none is empty; one without its landmark is broken too."""
    d = observed(spark, sf_dir).groupBy("site", "day").agg(F.count_if(F.col("k") >= 20).alias("parsed"), F.max(F.when(F.col("k") < 90, F.col("k"))).alias("said"), F.bool_or(F.col("k").between(30, 60)).alias("landmark"))
    health = F.when(F.col("parsed") > 0, "ok").when(F.col("said") > 0, "broken").when(F.col("landmark"), "empty").otherwise("no_landmark")
    return d.groupBy("site", health.alias("health")).agg(F.count("*").alias("days"))


@query("WITH d AS (SELECT DISTINCT site, day FROM observed), b AS (SELECT site, min(day) AS a, max(day) AS z, count(*) AS done FROM d GROUP BY site), m AS (SELECT max(day) AS now FROM d) SELECT site, done, z - a + 1 - done AS missed, least(5, now - z) AS pending, CASE WHEN now - z > 2 THEN 'late' WHEN z - a + 1 > done THEN 'gaps' ELSE 'on_time' END AS health FROM b CROSS JOIN m", "observed")
def schedule_health(spark, sf_dir):
    """Daily scans of each source: slots missed, and slots since the last one, counted up to five."""
    d = observed(spark, sf_dir).select("site", "day").distinct()
    b = d.groupBy("site").agg(F.min("day").alias("a"), F.max("day").alias("z"), F.count("*").alias("done")).crossJoin(F.broadcast(d.agg(F.max("day").alias("now"))))  # one row
    late, gaps = F.col("now") - F.col("z"), F.col("z") - F.col("a") + 1 - F.col("done")
    return b.select("site", "done", gaps.alias("missed"), F.least(F.lit(5), late).cast("long").alias("pending"), F.when(late > 2, "late").when(gaps > 0, "gaps").otherwise("on_time").alias("health"))


@query("WITH o AS (SELECT key, max(ts_s) AS last_at, arg_max(k, event_id) AS k FROM observed GROUP BY key) SELECT key, last_at FROM o WHERE k % 2 = 1 AND k >= 10 ORDER BY last_at DESC, key LIMIT 100", "observed")
def seed_targets(spark, sf_dir):
    """Live rows of the ledger that still lack a seller (their last sighting is odd here), the latest first: a work list of 100."""
    o = observed(spark, sf_dir).groupBy("key").agg(F.max("ts_s").alias("last_at"), F.max_by("k", "event_id").alias("k"))
    return o.where("k % 2 = 1 AND k >= 10").select("key", "last_at").orderBy(F.desc("last_at"), "key").limit(100)


@query(f"WITH told AS (SELECT DISTINCT key FROM market WHERE basis = 'ask' AND seller % 4 = 0), c AS (SELECT DISTINCT key, {r('list_price / price', 4)} AS score, sold_at FROM market WHERE basis = 'ask' AND kind = 'fixed') SELECT key, score FROM c WHERE key NOT IN (SELECT key FROM told) ORDER BY score DESC, sold_at DESC, key LIMIT 50", "market")
def notification_candidates(spark, sf_dir):
    """Untold rows in a state that may be told, the best first (a pool of 50)."""
    m = market(spark, sf_dir).where("basis = 'ask'")
    told = m.where("seller % 4 = 0").select("key").distinct()
    c = m.where("kind = 'fixed'").select("key", rounded(F.col("list_price") / F.col("price"), 4).alias("score"), "sold_at").distinct()
    return c.join(told, "key", "left_anti").orderBy(F.desc("score"), F.desc("sold_at"), "key").select("key", "score").limit(50)


@query("SELECT key, sold_at FROM (SELECT DISTINCT key, sold_at FROM market WHERE basis = 'ask' AND quantity % 7 = 0) ORDER BY sold_at DESC, key LIMIT 100", "market")
def missing_grade_recent(spark, sf_dir):
    """The latest listings whose grade is unknown (a work list of 100)."""
    return market(spark, sf_dir).where("basis = 'ask' AND quantity % 7 = 0").select("key", "sold_at").distinct().orderBy(F.desc("sold_at"), "key").limit(100)


@query("WITH l AS (SELECT card, max(sold_at) AS last_run, bool_or(kind = 'auction') AS seen FROM market WHERE basis = 'sold' GROUP BY card), t AS (SELECT max(sold_at) AS now FROM market), a AS (SELECT card, count(*) AS demand FROM market WHERE basis = 'ask' GROUP BY card) SELECT a.card, demand, CASE WHEN last_run IS NULL THEN 'never' WHEN last_run >= now - 2592000 AND seen THEN 'cooling' ELSE 'due' END AS state FROM a LEFT JOIN l USING (card) CROSS JOIN t", "market")
def refill_ledger(spark, sf_dir):
    """Cards by when they were last refilled: a run that saw at least one source cools for thirty days."""
    sold = F.col("basis") == "sold"
    facts = [F.max(F.when(sold & F.col("card").isNotNull(), F.col("sold_at"))).alias("last_run"), F.bool_or(F.when(sold, F.col("kind") == "auction")).alias("seen"), F.count_if(~sold).alias("demand"), F.max("sold_at").alias("now")]
    cards = kept(market(spark, sf_dir).groupBy("card").agg(*facts), "cards")  # one row for each card, read twice
    a = cards.where("demand > 0").drop("now").crossJoin(F.broadcast(cards.agg(F.max("now").alias("now"))))  # one row
    state = F.when(F.col("last_run").isNull(), "never").when((F.col("last_run") >= F.col("now") - 2592000) & F.col("seen"), "cooling").otherwise("due")
    return a.select("card", "demand", state.alias("state"))


@query("WITH l AS (SELECT key, max(ts_s) AS last_run FROM observed GROUP BY key), t AS (SELECT max(ts_s) - 86400 AS cutoff FROM observed) SELECT key FROM l CROSS JOIN t WHERE last_run < cutoff", "observed")
def cooldown_set(spark, sf_dir):
    """Keys that aren't cooling down: those run since the cutoff are taken out."""
    df = observed(spark, sf_dir)
    recent = df.select("key", "ts_s").crossJoin(F.broadcast(df.agg((F.max("ts_s") - 86400).alias("cutoff")))).where("ts_s >= cutoff").select("key")  # one row
    return df.select("key").distinct().join(recent, "key", "left_anti")


@query("WITH s AS (SELECT site, day, min(ts_s) AS started, max(ts_s) AS beat, bool_or(k >= 95) AS finished FROM observed GROUP BY ALL), t AS (SELECT max(ts_s) AS now FROM observed) SELECT site, CASE WHEN finished THEN 'done' WHEN now - started > 1800 THEN 'stale' ELSE 'running' END AS status, count(*) AS scans FROM s CROSS JOIN t GROUP BY ALL", "observed")
def scan_status(spark, sf_dir):
    """Scans that finished, run, or have outlived their time limit."""
    df = observed(spark, sf_dir)
    s = df.groupBy("site", "day").agg(F.min("ts_s").alias("started"), F.bool_or(F.col("k") >= 95).alias("finished")).crossJoin(F.broadcast(df.agg(F.max("ts_s").alias("now"))))  # one row
    status = F.when(F.col("finished"), "done").when(F.col("now") - F.col("started") > 1800, "stale").otherwise("running")
    return s.groupBy("site", status.alias("status")).agg(F.count("*").alias("scans"))


CAPACITY = 20


@query(
    f"""WITH c AS (SELECT site AS track, seller, seller % 17 = 0 AS pinned, CAST(count(*) AS BIGINT) AS score FROM market GROUP BY ALL), p AS (SELECT track, count(*) AS pins FROM c WHERE pinned GROUP BY track),
k AS (SELECT track, seller, row_number() OVER (PARTITION BY track ORDER BY score DESC, seller) AS i FROM c WHERE NOT pinned)
SELECT c.track, c.seller, score, CASE WHEN c.pinned THEN 'pinned' WHEN i <= {CAPACITY} - coalesce(pins, 0) THEN 'admitted' ELSE 'waiting' END AS state FROM c LEFT JOIN p USING (track) LEFT JOIN k ON k.track = c.track AND k.seller = c.seller""",
    "market",
)
def watch_admission(spark, sf_dir):
    """Who holds a track's places: pinned ones never lose theirs, the others go by score, and tracks aren't compared.

    Admitting one by one, each in place of the worst that isn't pinned, ends with the same set.
    """
    c = market(spark, sf_dir).groupBy(F.col("site").alias("track"), "seller").agg(F.count("*").alias("score")).withColumn("pinned", F.col("seller") % 17 == 0)
    pins = c.where("pinned").groupBy("track").agg(F.count("*").alias("pins"))
    ranked = placed(c.where("NOT pinned").withColumn("worst", -F.col("score")), ["track"], "worst", "seller").select("track", "seller", "place")
    df = c.join(pins, "track", "left").join(ranked, ["track", "seller"], "left")
    state = F.when(F.col("pinned"), "pinned").when(F.col("place") < CAPACITY - F.coalesce("pins", F.lit(0)), "admitted").otherwise("waiting")
    return df.select("track", "seller", "score", state.alias("state"))


@query("WITH p AS (SELECT conv_id, max(turn) AS page, count(*) AS pages, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN last_role = 'assistant' THEN NULL ELSE page + 1 END AS next_page, pages = page + 1 AS gapless FROM p")
def backfill_next_page(spark, sf_dir):
    """Where each query goes on: exhausted only where the source's own end was seen."""
    p = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("page"), F.count("*").alias("pages"), F.max_by("role", "turn").alias("last_role"))
    return p.select("conv_id", F.when(F.col("last_role") != "assistant", F.col("page") + 1).alias("next_page"), (F.col("pages") == F.col("page") + 1).alias("gapless"))


DEAD_BAND = 0.02
_LENSES = f"""f AS (SELECT * FROM market), {_RATIOS}, {_METRICS}, a AS (SELECT seller, q2 AS lens_a FROM b), l AS (SELECT seller, median(ln(price / list_price)) AS lens_b FROM market WHERE price > 0 AND list_price > 0 GROUP BY seller),
{_SAMPLES.replace('SELECT key, card', 'SELECT key, seller, card', 1)}, {_CURVE}, {_LADDER.replace('x AS (', 'y AS (', 1).replace('FROM x', 'FROM y')}, z AS (SELECT seller, median(lp - est) AS lens_c FROM s JOIN est USING (card, rarity, grade) GROUP BY seller)"""
_SIGNS = f"CASE WHEN lens_a > {DEAD_BAND}::DOUBLE THEN 1 WHEN lens_a < -{DEAD_BAND}::DOUBLE THEN -1 ELSE 0 END"


@query(
    f"""WITH {_LENSES} SELECT seller, {r('lens_a', 4)} AS lens_a, {r('lens_b', 4)} AS lens_b, {r('lens_c', 4)} AS lens_c,
{_SIGNS} * {_SIGNS.replace('lens_a', 'lens_b')} = -1 OR {_SIGNS} * {_SIGNS.replace('lens_a', 'lens_c')} = -1 AS conflict, 'B,C' AS untrusted FROM a LEFT JOIN l USING (seller) LEFT JOIN z USING (seller)""",
    "market",
)
def lens_conflicts(spark, sf_dir):
    """A seller through three lenses: peers, list price, and the valuation model; signs that differ beyond the dead band conflict.

    Only the first lens is trusted; the others see the seller's own mix of goods.
    """
    m = stock(spark, sf_dir, "list_price")
    return lenses(m, metrics(ratios(m)))


def lenses(m: DataFrame, found: DataFrame) -> DataFrame:
    """``lens_conflicts`` from the stock and its ``metrics``."""
    a = found.select("seller", F.col("q")[1].alias("lens_a"))
    sold = m.where("basis = 'sold' AND price > 0").select("card", "rarity", "grade", F.ln("price").alias("lp"))
    # Stored, so that Spark knows how small it is. Both lenses are then read from one pass over the stock, dealt by seller once.
    est = kept(ladder(sold).select("card", "rarity", "grade", "est"), "ladder")
    of_list = F.when((F.col("price") > 0) & (F.col("list_price") > 0), F.ln(F.col("price") / F.col("list_price")))
    of_model = F.when((F.col("basis") == "sold") & (F.col("price") > 0), F.ln("price") - F.col("est"))
    seen = m.join(est, ["card", "rarity", "grade"], "left").select("seller", of_list.alias("lens_b"), of_model.alias("lens_c")).repartition("seller")
    b = sorted_medians(seen, ["seller"], ["lens_b", "lens_c"]).select("seller", F.col("m_lens_b").alias("lens_b"), F.col("m_lens_c").alias("lens_c"))
    sign = lambda x: F.when(F.col(x) > DEAD_BAND, 1).when(F.col(x) < -DEAD_BAND, -1).otherwise(0)
    conflict = (sign("lens_a") * sign("lens_b") == -1) | (sign("lens_a") * sign("lens_c") == -1)
    return a.join(b, "seller", "left").select("seller", *[rounded(x, 4).alias(x) for x in ("lens_a", "lens_b", "lens_c")], conflict.alias("conflict"), F.lit("B,C").alias("untrusted"))


@query("SELECT seller, score, cards, hhi, CAST(row_number() OVER (ORDER BY score DESC, hhi, seller) AS BIGINT) AS position FROM (" + SQL["seller_score"] + ") s JOIN (" + SQL["herfindahl"] + ") h USING (seller) WHERE score IS NOT NULL ORDER BY position LIMIT 50")
def rank_sellers(spark, sf_dir):
    """The fifty best sellers: score first, then the wider stock, then the key (a report)."""
    m = stock(spark, sf_dir)
    df = scores(m, metrics(ratios(m))).where("score IS NOT NULL").join(concentration(m), "seller")
    order = [F.desc("score"), F.col("hhi"), F.col("seller")]
    top = df.select("seller", "score", "cards", "hhi").orderBy(*order).limit(50)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))  # fifty rows


@query("SELECT seller, s.score, s.refusal, m.cards, m.comparable, m.median_lr, h.hhi, l.conflict FROM (" + SQL["seller_score"] + ") s JOIN (" + SQL["seller_metrics"] + ") m USING (seller) LEFT JOIN (" + SQL["herfindahl"] + ") h USING (seller) LEFT JOIN (" + SQL["lens_conflicts"] + ") l USING (seller)")
def seller_alpha_report(spark, sf_dir):
    """Everything about a seller in one row: score or refusal, evidence, level, concentration, and whether lenses disagree."""
    m = stock(spark, sf_dir, "list_price")
    found = kept(metrics(ratios(m)), "metrics")  # one row for each seller, read three times
    df = scores(m, found).join(levels(found).select("seller", "cards", "comparable", "median_lr"), "seller")
    df = df.join(concentration(m).select("seller", "hhi"), "seller", "left").join(lenses(m, found).select("seller", "conflict"), "seller", "left")
    return df.select("seller", "score", "refusal", "cards", "comparable", "median_lr", "hhi", "conflict")


_NEW_CEILING = SQL["bid_ceiling"].replace("0.7::DOUBLE", "0.75::DOUBLE")


@query("SELECT CASE WHEN a.ceiling IS NULL AND b.ceiling IS NULL THEN 'none' WHEN a.ceiling IS NULL THEN 'opened' WHEN b.ceiling IS NULL THEN 'closed' WHEN b.ceiling > a.ceiling THEN 'raised' WHEN b.ceiling < a.ceiling THEN 'lowered' ELSE 'same' END AS change, count(*) AS n, CAST(sum(b.ceiling - a.ceiling) AS BIGINT) AS by FROM (" + SQL["bid_ceiling"] + ") a JOIN (" + _NEW_CEILING + ") b USING (card, grade) GROUP BY change")
def ceiling_diff(spark, sf_dir):
    """Stored bid ceilings against those under a looser rule (a quarter under the low fair value in place of 30 %)."""
    from tidemark.functions.money import DIRECT_SHIPPING

    old = bid_ceiling(spark, sf_dir).select("card", "grade", F.col("ceiling").alias("old"))
    f = market(spark, sf_dir).where("basis = 'sold'").groupBy("card", "grade").agg((F.expr("percentile(price, 0.25)") * USD).alias("low"), F.count("*").alias("n"))
    ship, budget = to_home(DIRECT_SHIPPING, USD), F.col("low") * 0.75
    f = f.withColumn("new", F.floor((budget - ship) / to_home(1.0, USD)).cast("long"))
    fits = (F.col("n") >= 10) & (F.col("new") > 0) & (to_home(F.col("new").cast("double"), USD) + ship <= budget + 0.05)
    both = old.join(f.select("card", "grade", F.when(fits, F.col("new")).alias("new")), ["card", "grade"])
    change = F.when(F.col("old").isNull() & F.col("new").isNull(), "none").when(F.col("old").isNull(), "opened").when(F.col("new").isNull(), "closed").when(F.col("new") > F.col("old"), "raised").when(F.col("new") < F.col("old"), "lowered").otherwise("same")
    return both.groupBy(change.alias("change")).agg(F.count("*").alias("n"), F.sum(F.col("new") - F.col("old")).alias("by"))


@query(f"WITH f AS (SELECT site, max(seller) AS most FROM market GROUP BY site) SELECT key, CASE WHEN basis = 'ask' AND kind = 'auction' THEN concat(site, '-reference') ELSE site END AS venue, basis, count(*) AS n, max({r('100.0::DOUBLE * seller / most', 2)}) AS feedback FROM market JOIN f USING (site) GROUP BY ALL", "market")
def observation_projection(spark, sf_dir):
    """Listings as rows of the observation ledger: running bids go to a reference venue, feedback is per cent of the site's best."""
    m = market(spark, sf_dir)
    # Stored, so that Spark knows that it has a row for each site, and sorts no site's listings to meet it.
    most = kept(m.groupBy("site").agg(F.max("seller").alias("most")), "most")
    venue = F.when((F.col("basis") == "ask") & (F.col("kind") == "auction"), F.concat("site", F.lit("-reference"))).otherwise(F.col("site"))
    df = m.join(most, "site").select("key", venue.alias("venue"), "basis", rounded(100.0 * F.col("seller") / F.col("most")).alias("feedback"))
    # Keys hardly repeat: dealt first, no task gathers keys of all places in a map that saves nothing.
    return df.repartition("key", "venue", "basis").groupBy("key", "venue", "basis").agg(F.count("*").alias("n"), F.max("feedback").alias("feedback"))


@query("SELECT event_type, CASE WHEN contains(CAST(ts AS VARCHAR), '.') THEN 'ingest' ELSE 'source' END AS time_origin, count(*) AS n FROM events GROUP BY ALL")
def sold_at_provenance_rule(spark, sf_dir):
    """A time with a fraction of a second was set at ingest, one without comes from the source."""
    origin = F.when(F.instr(F.col("ts").cast("string"), ".") > 0, "ingest").otherwise("source")
    return table(spark, sf_dir, "events").groupBy("event_type", origin.alias("time_origin")).agg(F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT DISTINCT key, title, sold_at, quantity FROM titled WHERE basis = 'sold'), h AS (SELECT w.id AS watch_id, key, title, sold_at, quantity, CASE WHEN contains(title, concat('PSA ', w.grade)) THEN 'hit' ELSE 'name' END AS tier FROM t JOIN (VALUES (1, 'red', 9), (2, 'gear', 10), (3, 'widget', 8)) w(id, name, grade) ON contains(title, w.name))
SELECT watch_id, tier, count(*) AS n, CAST(count(*) FILTER (quantity % 9 = 0) AS BIGINT) AS undated, CAST(count(*) FILTER (quantity % 2 = 0) AS BIGINT) AS known, max(sold_at) FILTER (quantity % 9 <> 0) - min(sold_at) FILTER (quantity % 9 <> 0) AS span FROM h GROUP BY watch_id, tier""",
    "titled",
)
def mine_sold_archive(spark, sf_dir):
    """Sold titles of each watch, each key once: tiers, undated and known ones, and the span of those with a date."""
    w = spark.createDataFrame([(1, "red", 9), (2, "gear", 10), (3, "widget", 8)], "watch_id int, name string, wanted int")
    t = titled(market(spark, sf_dir).where("basis = 'sold'")).select("key", "title", "sold_at", "quantity").distinct()
    h = t.join(F.broadcast(w), F.contains("title", F.col("name")))  # a short, fixed list
    tier = F.when(F.contains("title", F.concat(F.lit("PSA "), F.col("wanted"))), "hit").otherwise("name")
    dated = F.when(F.col("quantity") % 9 != 0, F.col("sold_at"))
    return h.groupBy("watch_id", tier.alias("tier")).agg(F.count("*").alias("n"), F.count_if(F.col("quantity") % 9 == 0).alias("undated"), F.count_if(F.col("quantity") % 2 == 0).alias("known"), (F.max(dated) - F.min(dated)).alias("span"))


@query("SELECT seller, CAST(count(*) FILTER (basis = 'ask') AS BIGINT) AS asked, CAST(count(*) FILTER (basis = 'sold') AS BIGINT) AS sold, CAST(count(*) FILTER (basis = 'sold' AND quantity % 9 = 0) AS BIGINT) AS sold_undated, count(DISTINCT buyer) AS buyers FROM market GROUP BY seller", "market")
def dossier_seller_facts(spark, sf_dir):
    """What is known of each seller, in separate counters that are never added up."""
    sold = F.col("basis") == "sold"
    return market(spark, sf_dir).groupBy("seller").agg(F.count_if(~sold).alias("asked"), F.count_if(sold).alias("sold"), F.count_if(sold & (F.col("quantity") % 9 == 0)).alias("sold_undated"), F.count_distinct("buyer").alias("buyers"))


@query(
    """WITH s AS (SELECT n_name AS source FROM nation WHERE n_nationkey % 2 = 0), c AS (SELECT source, concat('brand ', k) AS query, k AS pos FROM s CROSS JOIN (VALUES (1), (2)) t(k)), e AS (SELECT source, concat(lower(p_brand), ' psa') AS query, 100 + dense_rank() OVER (ORDER BY CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT), p_brand) AS pos FROM s CROSS JOIN (SELECT DISTINCT p_brand FROM part))
SELECT source, query, CAST(min(pos) AS BIGINT) AS position FROM (SELECT * FROM c UNION ALL SELECT * FROM e) GROUP BY source, query"""
)
def sold_query_plan(spark, sf_dir):
    """Which phrases each source that shows sales is asked for: the configured ones first, then those made of brands; first wins."""
    s = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("source"))
    given = spark.createDataFrame([("brand 1", 1), ("brand 2", 2)], "query string, pos long")
    brands = placed(table(spark, sf_dir, "part").select("p_brand").distinct().withColumn("n", F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")), [], "n", "p_brand")
    made = brands.select(F.concat(F.lower("p_brand"), F.lit(" psa")).alias("query"), (101 + F.col("place")).alias("pos"))
    # Phrases are a short list; sources are fewer still.
    return s.crossJoin(F.broadcast(given.union(made))).groupBy("source", "query").agg(F.min("pos").alias("position"))


@query("WITH l AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source END AS known FROM documents), p AS (SELECT page_id AS doc_id, split_part(split_part(url, '/', 3), '.', 1) AS found FROM pages) SELECT CASE WHEN known IS NOT NULL THEN 'kept' WHEN found IS NOT NULL THEN 'filled' ELSE 'missing' END AS outcome, count(*) AS n FROM l LEFT JOIN p USING (doc_id) GROUP BY outcome")
def payload_backfill(spark, sf_dir):
    """Ledger rows filled from payloads where they lack a value; what is there is never overwritten."""
    l = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("known"))  # noqa: E741
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.split_part(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("."), F.lit(1)).alias("found"))
    outcome = F.when(F.col("known").isNotNull(), "kept").when(F.col("found").isNotNull(), "filled").otherwise("missing")
    return l.join(p, "doc_id", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("WITH o AS (SELECT key, arg_max(CASE WHEN k % 4 = 0 THEN 'delete' WHEN k % 4 = 1 THEN 'scan' ELSE 'upsert' END, event_id) AS last_op, max(event_id) FILTER (k % 4 = 1) AS scanned, count(*) AS ops FROM observed GROUP BY key) SELECT last_op <> 'delete' AS active, scanned IS NOT NULL AS scanned, count(*) AS n, CAST(sum(ops) AS BIGINT) AS ops FROM o GROUP BY ALL", "observed")
def watch_table_state(spark, sf_dir):
    """The watch table after a log of upserts, soft deletes and scan marks: the last operation of each key decides."""
    k = F.col("k") % 4
    op = F.when(k == 0, "delete").when(k == 1, "scan").otherwise("upsert")
    o = observed(spark, sf_dir).groupBy("key").agg(F.max_by(op, "event_id").alias("last_op"), F.max(F.when(k == 1, F.col("event_id"))).alias("scan_id"), F.count("*").alias("ops"))
    return o.groupBy((F.col("last_op") != "delete").alias("active"), F.col("scan_id").isNotNull().alias("scanned")).agg(F.count("*").alias("n"), F.sum("ops").alias("ops"))


@query("WITH w AS (SELECT seller, count(*) AS items, min(price) AS cheapest FROM market WHERE basis = 'ask' AND seller % 40 IN (1, 2, 3, 5, 8, 13, 21, 34) GROUP BY seller), o AS (SELECT seller, max(ts_s) AS last_seen FROM observed GROUP BY seller) SELECT w.seller, items, cheapest, s.score, o.last_seen FROM w LEFT JOIN (" + SQL["seller_score"] + ") s USING (seller) LEFT JOIN o ON o.seller = w.seller % 40", "market", "observed")
def seller_notify_context(spark, sf_dir):
    """What a notice about a watched seller says: items, cheapest one, score, last sighting."""
    w = market(spark, sf_dir).where("basis = 'ask' AND seller % 40 IN (1, 2, 3, 5, 8, 13, 21, 34)").groupBy("seller").agg(F.count("*").alias("items"), F.min("price").alias("cheapest"))
    o = observed(spark, sf_dir).groupBy(F.col("seller").alias("slot")).agg(F.max("ts_s").alias("last_seen"))
    return w.join(seller_score(spark, sf_dir).select("seller", "score"), "seller", "left").join(o, F.col("seller") % 40 == F.col("slot"), "left").select("seller", "items", "cheapest", "score", "last_seen")


@query("SELECT live, reason, count(*) AS n FROM (SELECT basis = 'ask' AND kind = 'auction' AS live, CASE WHEN basis <> 'ask' THEN 'over' WHEN kind <> 'auction' THEN 'fixed_price' WHEN price > list_price THEN 'over_list' ELSE 'bid' END AS reason FROM market) GROUP BY ALL", "market")
def auction_reasons(spark, sf_dir):
    """Live auctions are those whose price is a running bid; the others say why they aren't bid for."""
    live = (F.col("basis") == "ask") & (F.col("kind") == "auction")
    reason = F.when(F.col("basis") != "ask", "over").when(F.col("kind") != "auction", "fixed_price").when(F.col("price") > F.col("list_price"), "over_list").otherwise("bid")
    return market(spark, sf_dir).groupBy(live.alias("live"), reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT card, rarity, grade, concat_ws(' ', tier, concat('(', n, ' sales)'), CASE WHEN refusal IS NOT NULL THEN concat('not used: ', refusal) END) AS wording FROM (" + SQL["evidence_gate"] + ")")
def evidence_wording(spark, sf_dir):
    """How the evidence behind a number is worded next to it."""
    note = F.when(F.col("refusal").isNotNull(), F.concat(F.lit("not used: "), F.col("refusal")))
    return evidence_gate(spark, sf_dir).select("card", "rarity", "grade", F.concat_ws(" ", "tier", F.concat(F.lit("("), F.col("n").cast("string"), F.lit(" sales)")), note).alias("wording"))
