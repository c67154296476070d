"""Studies of the valuation model: curves fitted in turn, coverage on new sales, and what relaxing the rarity costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.counting import medians, placed
from tidemark.operators.model import BASE_GRADE, MIN_CELL, SHRINK, residuals, samples
from tidemark.operators.model import _RES, _SAMPLES, _conformal_sql, conformal
from tidemark.plans.register import query
from tidemark.sources.shared import kept
from tidemark.sources.views import market, r, rounded

# --- Curves fitted one after the other


def grade_effects(s: DataFrame, value: str) -> DataFrame:
    cell = medians(s, ["rarity", "grade"], value, "m").where(F.col("n") >= MIN_CELL)
    base = cell.where(F.col("grade") == BASE_GRADE).select("rarity", F.col("m").alias("mb"), F.col("n").alias("nb"))
    g = cell.join(base, "rarity").groupBy("grade").agg(F.percentile(F.col("m") - F.col("mb"), F.lit(0.5)).alias("d"), F.sum(F.least("n", "nb")).alias("support"))
    return g.select("grade", (F.col("d") * F.col("support") / (F.col("support") + SHRINK)).alias("grade_effect"))


def level_effects(s: DataFrame, by: str, value: str, to: str) -> DataFrame:
    """Medians of each level over the median of all, shrunk to nothing for thin levels. All by counting."""
    every = medians(s, [], value, "all").select("all")
    level = medians(s, [by], value, "m").crossJoin(F.broadcast(every))  # one row
    return level.select(by, ((F.col("m") - F.col("all")) * F.col("n") / (F.col("n") + SHRINK)).alias(to))


def backfit(s: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Effects of grade, market and rarity: grade, then market on what is left, grade again without the market, then rarity.

    Each table has one row for each level, so Spark may broadcast it. What a step leaves is written, as the next one reads it twice.
    """
    s = kept(s, "backfit")
    with_grade = s.join(kept(grade_effects(s, "lp"), "backfit"), "grade", "left").withColumn("left1", F.col("lp") - F.coalesce("grade_effect", F.lit(0.0))).drop("grade_effect")
    site = kept(level_effects(kept(with_grade, "backfit"), "site", "left1", "site_effect"), "backfit")
    no_site = kept(s.join(site, "site", "left").withColumn("left2", F.col("lp") - F.coalesce("site_effect", F.lit(0.0))), "backfit")
    grade = kept(grade_effects(no_site, "left2"), "backfit")
    rest = no_site.join(grade, "grade", "left").withColumn("left3", F.col("left2") - F.coalesce("grade_effect", F.lit(0.0)))
    return grade, site, level_effects(kept(rest.drop("grade_effect"), "backfit"), "rarity", "left3", "rarity_effect")


def _grade_sql(source: str, value: str) -> str:
    cell = f"(SELECT rarity, grade, median({value}) AS m, count(*) AS n FROM {source} GROUP BY ALL HAVING count(*) >= {MIN_CELL})"
    return f"SELECT a.grade, median(a.m - b.m) * sum(least(a.n, b.n)) / (sum(least(a.n, b.n)) + {SHRINK}) AS grade_effect FROM {cell} a JOIN {cell} b ON a.rarity = b.rarity AND b.grade = {BASE_GRADE} GROUP BY a.grade"


def _level_sql(source: str, by: str, value: str, to: str) -> str:
    return f"SELECT {by}, (m - (SELECT median({value}) FROM {source})) * n / (n + {SHRINK}) AS {to} FROM (SELECT {by}, median({value}) AS m, count(*) AS n FROM {source} GROUP BY {by})"


_BACKFIT = f"""{_SAMPLES}, g1 AS ({_grade_sql('s', 'lp')}), x1 AS (SELECT s.*, lp - coalesce(grade_effect, 0) AS left1 FROM s LEFT JOIN g1 USING (grade)), v AS ({_level_sql('x1', 'site', 'left1', 'site_effect')}),
x2 AS (SELECT s.*, lp - coalesce(site_effect, 0) AS left2 FROM s LEFT JOIN v USING (site)), g2 AS ({_grade_sql('x2', 'left2')}), x3 AS (SELECT x2.*, left2 - coalesce(grade_effect, 0) AS left3 FROM x2 LEFT JOIN g2 USING (grade)), q AS ({_level_sql('x3', 'rarity', 'left3', 'rarity_effect')})"""


@query(f"WITH {_BACKFIT} SELECT rarity, {r('rarity_effect', 6)} AS effect FROM q", "market")
def fit_rarity_curve(spark, sf_dir):
    """What a rarity adds once grade and market are taken out, shrunk to nothing for thin ones."""
    return backfit(samples(spark, sf_dir))[2].select("rarity", rounded("rarity_effect", 6).alias("effect"))


@query(f"WITH {_BACKFIT} SELECT 'grade' AS curve, CAST(grade AS VARCHAR) AS level, {r('grade_effect', 6)} AS effect FROM g2 UNION ALL SELECT 'site', site, {r('site_effect', 6)} FROM v UNION ALL SELECT 'rarity', rarity, {r('rarity_effect', 6)} FROM q", "market")
def backfit_curves(spark, sf_dir):
    """The three curves, each fitted on what the others leave."""
    found = zip(("grade", "site", "rarity"), backfit(samples(spark, sf_dir)), strict=True)
    rows = [c.select(F.lit(k).alias("curve"), F.col(k).cast("string").alias("level"), rounded(f"{k}_effect", 6).alias("effect")) for k, c in found]
    return rows[0].union(rows[1]).union(rows[2])


# --- Coverage of new sales


def _cell_medians(fit: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """Medians of (rarity, grade) and of (card, rarity, grade): stored, so that both sides that meet them know how small they are."""
    own = fit.groupBy(*by, "card", "rarity", "grade").agg(F.expr("percentile(lp, 0.5)").alias("m1"), F.count("*").alias("n1"))
    return kept(medians(fit, [*by, "rarity", "grade"], "lp", "m2").drop("n"), "wide"), kept(own, "own")


def _residuals_of(test: DataFrame, mids: tuple[DataFrame, DataFrame], *by: str) -> DataFrame:
    """``test`` with residuals (res) against the medians of (card, rarity, grade), shrunk to those of (rarity, grade)."""
    wide, own = mids
    df = test.join(wide, [*by, "rarity", "grade"]).join(own, [*by, "card", "rarity", "grade"], "left")
    est = (F.coalesce(F.col("m1") * F.col("n1"), F.lit(0.0)) + F.col("m2") * SHRINK) / (F.coalesce("n1", F.lit(0)) + SHRINK)
    return df.withColumn("res", F.col("lp") - est)


def _cells_sql(fit: str, test: str, by: str = "") -> str:
    return f"""SELECT {by}key, site, lp - (coalesce(m1 * n1, 0) + m2 * {SHRINK}) / (coalesce(n1, 0) + {SHRINK}) AS res FROM {test}
JOIN (SELECT {by}rarity, grade, median(lp) AS m2 FROM {fit} GROUP BY ALL) USING ({by}rarity, grade) LEFT JOIN (SELECT {by}card, rarity, grade, median(lp) AS m1, count(*) AS n1 FROM {fit} GROUP BY ALL) USING ({by}card, rarity, grade)"""


_SHARES = f"count(*) AS n, {r('count(*) FILTER (res BETWEEN lo AND hi) / CAST(count(*) AS DOUBLE)', 4)} AS coverage, {r('count(*) FILTER (res < lo) / CAST(count(*) AS DOUBLE)', 4)} AS lower_tail"


def _shares(df: DataFrame, *by: str) -> DataFrame:
    share = lambda c: rounded(F.count_if(c) / F.count("*").cast("double"), 4)
    return df.groupBy(*by).agg(F.count("*").alias("n"), share(F.col("res").between(F.col("lo"), F.col("hi"))).alias("coverage"), share(F.col("res") < F.col("lo")).alias("lower_tail"))


@query(
    f"""WITH {_SAMPLES}, t AS (SELECT key, buyer, site, card, rarity, grade, ln(price) AS lp, row_number() OVER (PARTITION BY site ORDER BY sold_at, key, buyer) AS i, count(*) OVER (PARTITION BY site) AS n FROM market WHERE basis = 'sold' AND price > 0),
p AS (SELECT *, CASE WHEN i > floor(n * 0.7::DOUBLE) THEN 'test' WHEN i > floor(n * 0.5::DOUBLE) THEN 'calibration' ELSE 'fit' END AS part FROM t), fit AS (SELECT * FROM p WHERE part = 'fit'), cal AS (SELECT * FROM p WHERE part = 'calibration'), new AS (SELECT * FROM p WHERE part = 'test'),
res AS ({_cells_sql('fit', 'cal')}), q AS ({_conformal_sql('')}), x AS ({_cells_sql('fit', 'new')}) SELECT site, {_SHARES} FROM x CROSS JOIN (SELECT lo, hi FROM q) GROUP BY site""",
    "market",
)
def coverage_time_split(spark, sf_dir):
    """Coverage of each market's latest three tenths by an interval that saw only earlier sales: the first half to fit, then a
    fifth to set the interval."""
    s = market(spark, sf_dir).where("basis = 'sold' AND price > 0").select("key", "buyer", "site", "card", "rarity", "grade", F.ln("price").alias("lp"), "sold_at")
    p = placed(s, ["site"], "sold_at", "key", "buyer")
    i, n = F.col("place") + 1, F.col("of")
    p = p.withColumn("part", F.when(i > F.floor(n * 0.7), "test").when(i > F.floor(n * 0.5), "calibration").otherwise("fit"))
    mids = _cell_medians(p.where("part = 'fit'"))
    limits = conformal(_residuals_of(p.where("part = 'calibration'"), mids)).select("lo", "hi")
    return _shares(_residuals_of(p.where("part = 'test'"), mids).crossJoin(F.broadcast(limits)), "site")  # one row


FOLDS = 5
_ROLES = f"""h AS (SELECT s.*, CAST(('0x' || substr(sha1(key), 7, 6)) AS BIGINT) % {FOLDS} AS h FROM s), o AS (SELECT CAST(range AS BIGINT) AS fold FROM range({FOLDS})),
p AS (SELECT h.*, fold, CASE WHEN h.h = fold THEN 'test' WHEN h.h = (fold + 1) % {FOLDS} THEN 'calibration' ELSE 'fit' END AS part FROM h CROSS JOIN o), fit AS (SELECT * FROM p WHERE part = 'fit'), cal AS (SELECT * FROM p WHERE part = 'calibration'), new AS (SELECT * FROM p WHERE part = 'test')"""


@query(f"WITH {_SAMPLES}, {_ROLES}, res AS ({_cells_sql('fit', 'cal', 'fold, ')}), q AS ({_conformal_sql('fold, ')}), x AS ({_cells_sql('fit', 'new', 'fold, ')}) SELECT fold, {_SHARES} FROM x JOIN (SELECT fold, lo, hi FROM q) USING (fold) GROUP BY fold", "market")
def coverage_hash_folds(spark, sf_dir):
    """Coverage of held-out folds (by a hash of the key), each by an interval from the next fold and a fit on the others.

    Each sale is copied once for each fold with its role there, so all folds are one job.
    """
    h = F.conv(F.substring(F.sha1(F.col("key").cast("binary")), 7, 6), 16, 10).cast("long") % FOLDS
    s = kept(samples(spark, sf_dir).select("card", "rarity", "grade", "lp", h.alias("h")), "samples")  # read by each role
    p = s.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FOLDS - 1).cast("long"))))
    p = p.withColumn("part", F.when(F.col("h") == F.col("fold"), "test").when(F.col("h") == (F.col("fold") + 1) % FOLDS, "calibration").otherwise("fit"))
    mids = _cell_medians(p.where("part = 'fit'"), "fold")
    errors = lambda part: _residuals_of(p.where(F.col("part") == part), mids, "fold").select("fold", "res")
    limits = conformal(kept(errors("calibration"), "errors"), "fold").select("fold", "lo", "hi")
    return _shares(errors("test").join(kept(limits, "limits"), "fold"), "fold")


@query(f"WITH {_RES}, a AS ({_conformal_sql('')}) SELECT coalesce(site, 'all') AS site, coalesce(bucket, 'all') AS bucket, count(*) AS n, {r('count(*) FILTER (res < lo) / CAST(count(*) AS DOUBLE)', 4)} AS below, {r('count(*) FILTER (res > hi) / CAST(count(*) AS DOUBLE)', 4)} AS above FROM res CROSS JOIN (SELECT lo, hi FROM a) GROUP BY ROLLUP (site, bucket)", "market")
def bucket_composition(spark, sf_dir):
    """What each count bucket is made of, and how often its slices are outside the interval, with all sub-totals."""
    res = residuals(samples(spark, sf_dir))
    df = res.crossJoin(F.broadcast(conformal(res).select("lo", "hi")))  # one row
    share = lambda c: rounded(F.count_if(c) / F.count("*").cast("double"), 4)
    out = df.rollup("site", "bucket").agg(F.count("*").alias("n"), share(F.col("res") < F.col("lo")).alias("below"), share(F.col("res") > F.col("hi")).alias("above"))
    return out.select(F.coalesce("site", F.lit("all")).alias("site"), F.coalesce("bucket", F.lit("all")).alias("bucket"), "n", "below", "above")


@query(
    f"""WITH {_SAMPLES}, fit AS (SELECT * FROM s WHERE NOT calibration), new AS (SELECT * FROM s WHERE calibration), a AS (SELECT card, rarity, grade, median(lp) AS m1, count(*) AS n1 FROM fit GROUP BY ALL), b AS (SELECT card, grade, median(lp) AS m2, count(DISTINCT rarity) AS donors FROM fit GROUP BY ALL), c AS (SELECT rarity, grade, median(lp) AS m3 FROM fit GROUP BY ALL),
e AS (SELECT CASE WHEN n1 < 3 THEN '<3' WHEN n1 < 10 THEN '3-9' ELSE '>=10' END AS bucket, donors, abs(lp - m1) AS e1, abs(lp - m2) AS e2, abs(lp - m3) AS e3 FROM new JOIN a USING (card, rarity, grade) JOIN b USING (card, grade) JOIN c USING (rarity, grade))
SELECT bucket, count(*) AS n, CAST(sum(donors) AS BIGINT) AS donors, {r('sum(e1) / count(*)', 4)} AS exact_error, {r('sum(e2) / count(*)', 4)} AS relaxed_error, {r('sum(e3) / count(*)', 4)} AS wide_error, {r('count(*) FILTER (e2 < e1 - 1e-9::DOUBLE) / CAST(count(*) AS DOUBLE)', 4)} AS relaxed_wins FROM e GROUP BY bucket""",
    "market",
)
def rarity_relax_study(spark, sf_dir):
    """Held-out errors of the exact cell, of the card whatever its rarity, and of the rarity whatever the card."""
    s = samples(spark, sf_dir)
    fit, new = s.where("NOT calibration"), s.where("calibration")
    mid = F.expr("percentile(lp, 0.5)")
    a = fit.groupBy("card", "rarity", "grade").agg(mid.alias("m1"), F.count("*").alias("n1"))
    b = fit.groupBy("card", "grade").agg(mid.alias("m2"), F.count_distinct("rarity").alias("donors"))
    c = medians(fit, ["rarity", "grade"], "lp", "m3").drop("n")
    e = new.join(a, ["card", "rarity", "grade"]).join(b, ["card", "grade"]).join(c, ["rarity", "grade"])
    for k in (1, 2, 3):
        e = e.withColumn(f"e{k}", F.abs(F.col("lp") - F.col(f"m{k}")))
    bucket = F.when(F.col("n1") < 3, "<3").when(F.col("n1") < 10, "3-9").otherwise(">=10")
    mean = lambda k: rounded(F.sum(f"e{k}") / F.count("*"), 4)
    wins = rounded(F.count_if(F.col("e2") < F.col("e1") - 1e-9) / F.count("*").cast("double"), 4)
    return e.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("donors").alias("donors"), mean(1).alias("exact_error"), mean(2).alias("relaxed_error"), mean(3).alias("wide_error"), wins.alias("relaxed_wins"))


