"""Estimates for one listing each: a ladder that knows the market it is asked for, and the probability that the listing is worth its cost.

All prices are ln prices, and all averages medians, found by counting. Effects of grade, market and rarity are shrunk to priors by
their support; sales are freed of them and pooled by rarity, by card, and by card and grade; a listing's estimate puts its own
grade and market back and goes down the pools, each shrunk to the one above. A pool's median doesn't depend on the listing, so
each pool is one row, and a listing meets three of them by equality.

The card of a listing is read from its title; its rarity comes from its record, and from the title where the record has none.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.money import USD, cheapest, quotes_sql
from tidemark.functions.settings import Settings
from tidemark.operators.counting import _bucket, stored_medians
from tidemark.operators.dictionary import with_longest_match
from tidemark.operators.model import _SAMPLES, BASE_GRADE, sales, samples
from tidemark.plans.register import query
from tidemark.sources.shared import kept
from tidemark.sources.views import KEY_PARTS, key_of, market, r, rounded, sites, table, titled

SETTINGS = Settings()
MIN_CALIBRATION = 50
#: What is believed of grades, markets and rarities before any sale is seen, as price factors.
GRADE_PRIOR = {10: 3.95, 9: 1.0, 8: 0.55, 7: 0.35}
SITE_PRIOR = {"AFRICA": 1.0, "AMERICA": 2.0, "ASIA": 1.0, "EUROPE": 2.0, "MIDDLE EAST": 2.0}
RARITY_PRIOR = {"PROMO": 4.7, "LARGE": 2.6, "MEDIUM": 1.7, "STANDARD": 1.2, "SMALL": 1.0, "ECONOMY": 1.0}


def _priors(spark: SparkSession, column: str, kind: str, values: dict) -> DataFrame:
    return spark.createDataFrame([(k, math.log(v)) for k, v in values.items()], f"{column} {kind}, prior double")


def counted(s: DataFrame) -> DataFrame:
    """Sales that agree in all that estimates read as one row, with their number in ``sales``."""
    return s.groupBy("card", "rarity", "grader", "grade", "site", "lp", "calibration").agg(F.count("*").alias("sales"))


def _weighed(s: DataFrame) -> DataFrame:
    return s if "sales" in s.columns else s.withColumn("sales", F.lit(1).cast("long"))


def effects(s: DataFrame, settings: Settings = SETTINGS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grade, g), (site, v) and (rarity, q): grade first, then market, grade again on prices without the market, then rarity.

    Each is a row for each level of a fixed list; levels without sales have their priors. Rows may be sales, or ``counted`` ones.
    """
    s, spark, k = _weighed(s), s.sparkSession, settings.shrink
    to_prior = lambda d, n, to: F.coalesce((F.col(d) * F.col(n) + F.col("prior") * k) / (F.col(n) + k), F.col("prior")).alias(to)

    def of_grade(x: DataFrame, value: str) -> DataFrame:
        cell = stored_medians(x, ["rarity", "grade"], value, "sales", "m").where(F.col("n") >= settings.min_cell)
        base = cell.where(F.col("grade") == BASE_GRADE).select("rarity", F.col("m").alias("mb"), F.col("n").alias("nb"))
        found = cell.join(base, "rarity").groupBy("grade").agg(F.percentile(F.col("m") - F.col("mb"), F.lit(0.5)).alias("d"), F.sum(F.least("n", "nb")).alias("support"))
        return _priors(spark, "grade", "int", GRADE_PRIOR).join(found, "grade", "left").select("grade", to_prior("d", "support", "g"))

    cell = stored_medians(s, ["rarity", "grader", "grade", "site"], "lp", "sales", "m").where(F.col("n") >= settings.min_cell)
    base = s.groupBy("site").agg(F.sum("sales").alias("count")).orderBy(F.desc("count"), "site").limit(1).select(F.col("site").alias("base"))
    priors = _priors(spark, "site", "string", SITE_PRIOR)
    base = base.join(priors.select(F.col("site").alias("base"), F.col("prior").alias("of_base")), "base", "left")  # one row
    other = cell.join(F.broadcast(base), F.col("site") == F.col("base")).select("rarity", "grader", "grade", F.col("m").alias("mb"), F.col("n").alias("nb"))
    found = cell.join(other, ["rarity", "grader", "grade"]).groupBy("site").agg(F.percentile(F.col("m") - F.col("mb"), F.lit(0.5)).alias("d"), F.sum(F.least("n", "nb")).alias("support"))
    priors = priors.crossJoin(F.broadcast(base)).withColumn("prior", F.col("prior") - F.coalesce("of_base", F.lit(0.0)))
    site = kept(priors.join(found, "site", "left").select("site", to_prior("d", "support", "v")), "effect-of-site")
    x = s.join(F.broadcast(site), "site", "left").withColumn("lv", F.col("lp") - F.coalesce("v", F.lit(0.0)))
    grade = kept(of_grade(x, "lv"), "effect-of-grade")
    x = kept(x.join(F.broadcast(grade), "grade", "left").select("rarity", (F.col("lv") - F.coalesce("g", F.lit(0.0))).alias("rest"), "sales"), "effect-rest")
    every = stored_medians(x, [], "rest", "sales", "all").select("all")
    level = stored_medians(x, ["rarity"], "rest", "sales", "m").crossJoin(F.broadcast(every)).withColumn("d", F.col("m") - F.col("all"))  # one row
    rarity = _priors(spark, "rarity", "string", RARITY_PRIOR).join(level, "rarity", "left").select("rarity", to_prior("d", "n", "q"))
    return grade, site, kept(rarity, "effect-of-rarity")


def estimates(s: DataFrame, targets: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """``targets`` (card, rarity, grade, site and more) with est (ln price in their market), level and n_effective, from the sales ``s``, which may be ``counted``."""
    s = _weighed(s)
    curves = effects(s, settings)

    def freed(x: DataFrame) -> DataFrame:
        for curve, column in zip(curves, ("grade", "site", "rarity"), strict=True):
            x = x.join(F.broadcast(curve), column, "left")  # a row for each level of a fixed list
        return x.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in "gvq"})

    y = kept(freed(s).select("card", "rarity", "grade", "sales", (F.col("lp") - F.col("v")).alias("lv"), (F.col("lp") - F.col("g") - F.col("v")).alias("lgv"), (F.col("lp") - F.col("g") - F.col("v") - F.col("q")).alias("rest")), "pools")
    pools = {
        "3": (["rarity"], "lgv"),
        "2": (["card", "rarity"], "lgv"),
        "1": (["card", "rarity", "grade"], "lv"),
    }
    out = freed(targets).crossJoin(F.broadcast(stored_medians(y, [], "rest", "sales", "m0").select("m0")))  # one row
    for i, (by, value) in pools.items():
        pool = kept(stored_medians(y, by, value, "sales", f"m{i}").withColumnRenamed("n", f"n{i}"), "pool")  # stored, so that Spark knows how small it is
        out = out.join(pool, by, "left")
    k, est = settings.shrink, F.col("m0") + F.col("g") + F.col("q") + F.col("v")
    for i, back in (("3", F.col("g") + F.col("v")), ("2", F.col("g") + F.col("v")), ("1", F.col("v"))):
        n, m = F.col(f"n{i}"), F.col(f"m{i}") + back
        est = F.when(n.isNull(), est).otherwise((m * n + est * k) / (n + k))
    level = F.when(F.col("n1").isNotNull(), "L1").when(F.col("n2").isNotNull(), "L2").when(F.col("n3").isNotNull(), "L3").otherwise("L0")
    return out.select(*targets.columns, est.alias("est"), level.alias("level"), F.coalesce("n1", "n2", "n3", F.lit(0)).alias("n_effective"))


def shares_above(rows: DataFrame, x: str, sample: DataFrame, value: str, to: str, least: int, weight: str | None = None) -> DataFrame:
    """``rows`` with the share of ``sample`` whose value is above x; null if the sample has fewer than ``least``, or x is null.

    A row of the sample counts ``weight`` times, once if that isn't given.

    Rows and sample are merged by value: buckets of the value are counted and cumulated, and only the rows of one bucket are
    ordered together. The sample is neither gathered nor paired with the rows.
    """
    one = F.struct(*rows.columns)
    both = rows.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x_"), F.lit(0).alias("s_"), one.alias("row_"))
    both = both.unionByName(sample.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x_"), (F.col(weight) if weight else F.lit(1)).alias("s_")), allowMissingColumns=True).withColumn("bucket_", _bucket(F.col("x_")))
    higher = Window.orderBy(F.desc("bucket_")).rowsBetween(Window.unboundedPreceding, -1)
    counts = both.groupBy("bucket_").agg(F.sum("s_").alias("here_"))  # as many rows as there are buckets of a double: some thousand
    counts = counts.withColumn("higher_", F.coalesce(F.sum("here_").over(higher), F.lit(0))).withColumn("all_", F.sum("here_").over(Window.partitionBy()))
    inside = Window.partitionBy("bucket_").orderBy(F.desc("x_"), "s_").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("above_", F.sum("s_").over(inside)).where("s_ = 0").join(counts, "bucket_")
    share = F.when(F.col("all_") >= least, (F.col("above_") + F.col("higher_")) / F.col("all_").cast("double"))
    known = placed.select("row_.*", share.alias(to))
    return known.unionByName(rows.where(F.col(x).isNull()).withColumn(to, F.lit(None).cast("double")))


def stored_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What listings and sales need of ``market``, joined once for both and stored, with KEY_PARTS in place of the key."""
    site = kept(sites(spark, sf_dir), "sites")  # a few bytes for each seller: stored, so that Spark knows it
    rows = market(spark, sf_dir, site, KEY_PARTS)
    return kept(rows.select(*KEY_PARTS, "basis", "site", "card", "series", "rarity", "grade", "grader", "price", "quantity", "sold_at"), "market")


def listings(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Asks with what their titles and records tell, each distinct one once, and the landed cost of the cheapest route; ``rows``: the stored market."""
    rows = stored_market(spark, sf_dir) if rows is None else rows
    asks = titled(rows.where("basis = 'ask'").withColumn("part_key", F.col("l_partkey")))
    # A key that lacks a number is no other row's, as only a line's number may be missing: a row without cents has no price, and no cost.
    asks = asks.select(*KEY_PARTS, "site", "price", "title", "grade", F.when(F.col("quantity") % 5 != 0, F.col("rarity")).alias("recorded")).distinct()
    told = F.nullif(F.regexp_extract("title", rf"\b({'|'.join(RARITY_PRIOR)})\b", 1), F.lit(""))
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    asks = with_longest_match(asks, names, to="card").withColumn("rarity", F.coalesce("recorded", told))
    return asks.select(key_of(*KEY_PARTS).alias("key"), "site", "price", "card", "rarity", "grade", cheapest().alias("landed"))


# --- SQL


def _values(values: dict, column: str) -> str:
    return "(VALUES " + ", ".join(f"({k!r}, {math.log(v)!r}::DOUBLE)" for k, v in values.items()) + f") AS p({column}, prior)"


def _model_sql(p: str, s: str) -> str:
    """CTEs <p>grade, <p>site, <p>rarity and the pools <p>l0 to <p>l3 of the sales ``s``."""
    k = f"{SETTINGS.shrink!r}::DOUBLE"
    prior = f"coalesce((d * support + prior * {k}) / (support + {k}), prior)"
    n = SETTINGS.min_cell
    return f"""{p}sc AS (SELECT site, rarity, grader, grade, median(lp) AS m, count(*) AS n FROM {s} GROUP BY ALL HAVING count(*) >= {n}),
{p}sb AS (SELECT b.site, coalesce(prior, 0) AS of_base FROM (SELECT site FROM {s} GROUP BY site ORDER BY count(*) DESC, site LIMIT 1) b LEFT JOIN {_values(SITE_PRIOR, 'site')} ON b.site = p.site),
{p}sd AS (SELECT a.site, median(a.m - b.m) AS d, sum(least(a.n, b.n)) AS support FROM {p}sc a JOIN {p}sc b USING (rarity, grader, grade) JOIN {p}sb ON b.site = {p}sb.site GROUP BY a.site),
{p}site AS (SELECT site, {prior} AS v FROM (SELECT p.site, prior - of_base AS prior FROM {_values(SITE_PRIOR, 'site')} CROSS JOIN {p}sb) LEFT JOIN {p}sd USING (site)),
{p}x AS (SELECT s.*, coalesce(v, 0) AS v, lp - coalesce(v, 0) AS lv FROM {s} AS s LEFT JOIN {p}site USING (site)),
{p}gc AS (SELECT rarity, grade, median(lv) AS m, count(*) AS n FROM {p}x GROUP BY ALL HAVING count(*) >= {n}),
{p}gd AS (SELECT a.grade, median(a.m - b.m) AS d, sum(least(a.n, b.n)) AS support FROM {p}gc a JOIN {p}gc b ON a.rarity = b.rarity AND b.grade = {BASE_GRADE} GROUP BY a.grade),
{p}grade AS (SELECT grade, {prior} AS g FROM {_values(GRADE_PRIOR, 'grade')} LEFT JOIN {p}gd USING (grade)),
{p}y AS (SELECT x.*, coalesce(g, 0) AS g, lv - coalesce(g, 0) AS rest FROM {p}x AS x LEFT JOIN {p}grade USING (grade)),
{p}rd AS (SELECT rarity, median(rest) - (SELECT median(rest) FROM {p}y) AS d, count(*) AS support FROM {p}y GROUP BY rarity),
{p}rarity AS (SELECT rarity, {prior} AS q FROM {_values(RARITY_PRIOR, 'rarity')} LEFT JOIN {p}rd USING (rarity)),
{p}l0 AS (SELECT median(lp - g - v - coalesce(q, 0)) AS m0 FROM {p}y LEFT JOIN {p}rarity USING (rarity)), {p}l3 AS (SELECT rarity, median(lp - g - v) AS m3, count(*) AS n3 FROM {p}y GROUP BY rarity),
{p}l2 AS (SELECT card, rarity, median(lp - g - v) AS m2, count(*) AS n2 FROM {p}y GROUP BY ALL), {p}l1 AS (SELECT card, rarity, grade, median(lv) AS m1, count(*) AS n1 FROM {p}y GROUP BY ALL)"""


def _estimate_sql(p: str, targets: str) -> str:
    k = f"{SETTINGS.shrink!r}::DOUBLE"
    down = lambda m, n, up: f"CASE WHEN {n} IS NULL THEN {up} ELSE (({m}) * {n} + ({up}) * {k}) / ({n} + {k}) END"
    est = down("m1 + v", "n1", down("m2 + (g + v)", "n2", down("m3 + (g + v)", "n3", "m0 + g + q + v")))
    return f"""SELECT * EXCLUDE (g, v, q, m0, m1, m2, m3, n1, n2, n3), {est} AS est, CASE WHEN n1 IS NOT NULL THEN 'L1' WHEN n2 IS NOT NULL THEN 'L2' WHEN n3 IS NOT NULL THEN 'L3' ELSE 'L0' END AS level, coalesce(n1, n2, n3, 0) AS n_effective
FROM (SELECT t.*, coalesce(g, 0) AS g, coalesce(v, 0) AS v, coalesce(q, 0) AS q FROM {targets} AS t LEFT JOIN {p}grade USING (grade) LEFT JOIN {p}site USING (site) LEFT JOIN {p}rarity USING (rarity)) CROSS JOIN {p}l0 LEFT JOIN {p}l3 USING (rarity) LEFT JOIN {p}l2 USING (card, rarity) LEFT JOIN {p}l1 USING (card, rarity, grade)"""


_LISTINGS = f"""lt AS (SELECT DISTINCT key, site, price, title, grade, CASE WHEN quantity % 5 <> 0 THEN rarity END AS recorded FROM titled WHERE basis = 'ask'),
lm AS (SELECT title, arg_max(name, -instr(title, name) * 1000 + length(name)) AS card FROM (SELECT DISTINCT title FROM lt) JOIN (SELECT DISTINCT p_name AS name FROM part) ON contains(title, name) GROUP BY title),
lq AS ({quotes_sql("(SELECT DISTINCT key, site, price FROM lt)", "key, site, price")}), lb AS (SELECT key, site, price, min(landed) AS landed FROM lq GROUP BY ALL),
listing AS (SELECT key, site, price, card, coalesce(recorded, nullif(regexp_extract(title, '\\b({'|'.join(RARITY_PRIOR)})\\b', 1), '')) AS rarity, grade, landed FROM lt LEFT JOIN lm USING (title) LEFT JOIN lb USING (key, site, price))"""

_CURVE_ROWS = "SELECT 'grade' AS curve, CAST(grade AS VARCHAR) AS level, {0} AS effect FROM grade UNION ALL SELECT 'site', site, {1} FROM site UNION ALL SELECT 'rarity', rarity, {2} FROM rarity"


@query(f"WITH {_SAMPLES}, {_model_sql('', 's')} {_CURVE_ROWS.format(r('g', 6), r('v', 6), r('q', 6))}", "market")
def effects_with_priors(spark, sf_dir):
    """What grade, market and rarity do to a price, shrunk to what was believed before."""
    curves = zip(("grade", "site", "rarity"), effects(kept(samples(spark, sf_dir), "samples")), "gvq", strict=True)
    rows = [c.select(F.lit(name).alias("curve"), F.col(name).cast("string").alias("level"), rounded(x, 6).alias("effect")) for name, c, x in curves]
    return rows[0].union(rows[1]).union(rows[2])


@query(
    f"""WITH {_SAMPLES}, f AS (SELECT * FROM s WHERE NOT calibration), {_model_sql('', 's')}, {_model_sql('f_', 'f')}, {_LISTINGS},
res AS (SELECT lp - est AS res FROM ({_estimate_sql('f_', '(SELECT card, rarity, grade, site, lp FROM s WHERE calibration)')})),
e AS (SELECT *, CASE WHEN landed > 0 THEN ln(landed / {USD}::DOUBLE) - est END AS room FROM ({_estimate_sql('', 'listing')})),
u AS (SELECT *, sum(is_res) OVER (ORDER BY room DESC, is_res ROWS UNBOUNDED PRECEDING) AS above, sum(is_res) OVER () AS n FROM (SELECT key, site, price, card, rarity, level, n_effective, est, room, 0 AS is_res FROM e WHERE room IS NOT NULL UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, res, 1 FROM res))
SELECT key, site, price, card, rarity, level, n_effective, {r('exp(est)', 2)} AS fair, CASE WHEN n >= {MIN_CALIBRATION} THEN {r('above / CAST(n AS DOUBLE)', 6)} END AS p_worth FROM u WHERE is_res = 0""",
    "titled",
)
def p_worth_by_listing(spark, sf_dir):
    """For each listing its fair price in its own market, and the share of past errors that would make it worth its landed cost.

    Errors are those of a model of one part of the sales on the other part; the share is of all of them, not of a group's.
    """
    rows = stored_market(spark, sf_dir)
    s = kept(counted(sales(rows.withColumn("key", key_of(*KEY_PARTS)))), "samples")
    errors = kept(estimates(s.where("NOT calibration"), s.where("calibration").select("card", "rarity", "grade", "site", "lp", "sales")).select((F.col("lp") - F.col("est")).alias("res"), "sales"), "errors")
    e = estimates(s, listings(spark, sf_dir, rows)).withColumn("room", F.when(F.col("landed") > 0, F.ln(F.col("landed") / USD) - F.col("est"))).where("room IS NOT NULL")
    e = kept(e.select("key", "site", "price", "card", "rarity", "level", "n_effective", "est", "room"), "estimated")  # counted, then placed
    out = shares_above(e, "room", errors, "res", "p", MIN_CALIBRATION, "sales")
    return out.select("key", "site", "price", "card", "rarity", "level", "n_effective", rounded(F.exp("est")).alias("fair"), rounded("p", 6).alias("p_worth"))
