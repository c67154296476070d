"""One sale shown in two markets: equal price, currency and normalised title within an hour, as connected groups.

Sales of two markets are linked if they agree in price, currency and title and are at most the window apart. Linked sales are one
sale, chains too. No pairs are made: in order of time, a sale belongs to the group of the one before it exactly if some
link reaches over the gap between them, and such a link exists if and only if the latest sale of the other market before the gap,
or the earliest one after it, is near enough to the sale on the far side. Windows over a span of time and over the spans tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.register import query
from tidemark.sources.shared import kept
from tidemark.sources.views import market, titled

MINUTES = 60
SPAN = 86400  # seconds of sales that a window sees at once
#: Markets of one company, in which an item can be offered twice; the first keeps the sale.
SITES = ("AMERICA", "ASIA")
ATTRIBUTES = ("grader", "grade", "rarity", "series")
SAME = ["price", "currency", "title_key"]


def title_key(title):
    """The title in lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(title), "[^\\p{L}\\p{N}]+", " "))


def dual_groups(sales: DataFrame, sites: tuple[str, str] = SITES, minutes: int = MINUTES) -> DataFrame:
    """Groups of sales (key, site, price, currency, title, sold_at and ATTRIBUTES) that are one sale: one row for each sale in a group of
    both markets, with the group's kept key, whether it is that one, its minutes from it, and the group's conflicts.

    A sale without price, currency, title or time is in no group. A group whose known attributes differ is reported with their
    names and keeps all its sales.
    """
    rows = sales.where(F.col("site").isin(*sites) & F.col("price").isNotNull() & (F.col("currency") != "") & F.col("sold_at").isNotNull()).withColumn("title_key", title_key(F.col("title"))).where("title_key <> ''")
    rows = kept(rows.select("key", "site", (F.col("site") == sites[0]).alias("first_site"), "price", "currency", "title_key", "sold_at", F.floor(F.col("sold_at") / SPAN).alias("span"), *ATTRIBUTES), "sales")
    # Sales that agree grow with the data, so windows see those of one span; what the spans before and after tell is a row for each.
    here, first = [*SAME, "span"], F.col("first_site")
    earlier, later = (Window.partitionBy(*SAME).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("span"), F.desc("span")))
    ends = rows.groupBy(*here).agg(*[f(F.when(side, F.col("sold_at"))).alias(f"{to}_{of}") for f, to in ((F.max, "last"), (F.min, "least")) for side, of in ((first, "a"), (~first, "b"))])
    ends = ends.select(*here, *[F.max(f"last_{x}").over(earlier).alias(f"last_{x}") for x in "ab"], *[F.min(f"least_{x}").over(later).alias(f"least_{x}") for x in "ab"])
    rows = rows.join(ends, here)
    forward, back = (Window.partitionBy(*here).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for order in (("sold_at", "key"), (F.desc("sold_at"), F.desc("key"))))
    near = lambda side, w, beyond: F.coalesce(F.last(F.when(side, F.col("sold_at")), True).over(w), beyond)
    other = lambda w, end: F.when(first, near(~first, w, f"{end}_b")).otherwise(near(first, w, f"{end}_a"))
    rows = rows.withColumns({"other_before": other(forward, "last"), "other_after": other(back, "least"), "before": F.coalesce(F.last("sold_at").over(forward), F.greatest("last_a", "last_b"))})
    reach = F.coalesce(F.col("sold_at") - F.col("other_before") <= minutes * 60, F.lit(False)) | F.coalesce(F.col("other_after") - F.col("before") <= minutes * 60, F.lit(False))
    rows = kept(rows.select("key", "site", "first_site", *here, "sold_at", *ATTRIBUTES, (~reach).cast("int").alias("starts")), "links")
    starts = rows.groupBy(*here).agg(F.sum("starts").alias("of_span")).select(*here, F.coalesce(F.sum("of_span").over(earlier), F.lit(0)).alias("begun"))
    inside = F.sum("starts").over(Window.partitionBy(*here).orderBy("sold_at", "key").rowsBetween(Window.unboundedPreceding, 0))
    linked = kept(rows.join(starts, here).withColumn("group", F.col("begun") + inside).drop("span", "starts", "begun"), "linked")
    keep = F.min(F.struct((~F.col("first_site")).alias("other"), "sold_at", "key")).alias("keep")
    conflicts = F.array_compact(F.array(*[F.when(F.count_distinct(a) > 1, F.lit(a)) for a in ATTRIBUTES]))
    groups = linked.groupBy(*SAME, "group").agg(keep, conflicts.alias("conflicts"), F.count("*").alias("sales"), F.count_distinct("site").alias("sites")).where("sites = 2")
    found = linked.join(groups, [*SAME, "group"])
    apart = (F.abs(F.col("sold_at") - F.col("keep.sold_at")) / 60.0).alias("minutes_apart")
    is_kept = (F.size("conflicts") > 0) | (F.col("key") == F.col("keep.key"))
    return found.select("key", "site", F.col("keep.key").alias("keep_key"), is_kept.alias("stays"), apart, F.array_join("conflicts", ",").alias("conflicts"), "sales")


def shown_twice(spark, sf_dir) -> DataFrame:
    """Sales as two markets may show them: prices to the hundred, titles in two spellings, and a time of day made from numbers."""
    m = market(spark, sf_dir).where("basis = 'sold'")
    title = F.when(F.col("seller") % 2 == 0, F.concat_ws(" -- ", F.lit("CARD"), "rarity")).otherwise(F.concat_ws(" ", F.lit("card"), F.lower("rarity")))
    seconds = (F.col("seller") * 7919 + F.col("quantity") * 1313 + F.col("buyer") * 17) % 86400
    return m.select("key", "site", (F.floor(F.col("price") / 100) * 100).alias("price"), F.lit("USD").alias("currency"), title.alias("title"), (F.col("sold_at") - F.col("sold_at") % (60 * 86400) + seconds).alias("sold_at"), *ATTRIBUTES).distinct()


_OTHER = "CASE WHEN first_site THEN max(CASE WHEN NOT first_site THEN sold_at END) OVER w ELSE max(CASE WHEN first_site THEN sold_at END) OVER w END"


@query(
    f"""WITH v AS (SELECT DISTINCT key, site, CAST(floor(price / 100) * 100 AS BIGINT) AS price, lower(rarity) AS rarity_key, sold_at - sold_at % {60 * 86400} + (seller * 7919 + quantity * 1313 + buyer * 17) % 86400 AS sold_at, {', '.join(ATTRIBUTES)} FROM market WHERE basis = 'sold' AND site IN {SITES}),
f AS (SELECT *, 'card ' || rarity_key AS title_key, site = '{SITES[0]}' AS first_site FROM v),
o AS (SELECT *, {_OTHER} AS other_before, lag(sold_at) OVER (PARTITION BY price, title_key ORDER BY sold_at, key) AS before FROM f WINDOW w AS (PARTITION BY price, title_key ORDER BY sold_at, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, {_OTHER.replace('max(', 'min(')} AS other_after FROM o WINDOW w AS (PARTITION BY price, title_key ORDER BY sold_at, key ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, sum(CASE WHEN sold_at - other_before <= {MINUTES * 60} OR other_after - before <= {MINUTES * 60} THEN 0 ELSE 1 END) OVER (PARTITION BY price, title_key ORDER BY sold_at, key ROWS UNBOUNDED PRECEDING) AS grp FROM n),
k AS (SELECT price, title_key, grp, arg_min(key, (NOT first_site, sold_at, key)) AS keep_key, arg_min(sold_at, (NOT first_site, sold_at, key)) AS keep_at, count(*) AS sales, array_to_string(list_filter([{', '.join(f"CASE WHEN count(DISTINCT {a}) > 1 THEN '{a}' END" for a in ATTRIBUTES)}], lambda x: x IS NOT NULL), ',') AS conflicts FROM g GROUP BY ALL HAVING count(DISTINCT site) = 2)
SELECT key, site, keep_key, conflicts <> '' OR key = keep_key AS stays, abs(sold_at - keep_at) / 60.0::DOUBLE AS minutes_apart, conflicts, sales FROM g JOIN k USING (price, title_key, grp)""",
    "market",
)
def dual_listing_groups(spark, sf_dir):
    """Sales that two markets of one company have both shown, the one that is kept, and what speaks against it."""
    return dual_groups(shown_twice(spark, sf_dir))
