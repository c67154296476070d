"""Sources of listings: a protocol, a registry by name, and scans of pages, embedded values and tables as JVM-side extraction."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.register import query
from tidemark.sources.feed import feed
from tidemark.sources.views import market, table, titled

# --- Protocol and registry


@dataclass(frozen=True)
class Scan:
    """Rows of a search and the health of its source: ok, empty or broken."""

    rows: DataFrame
    health: str


class Source(Protocol):
    """What every source of listings offers."""

    supports_sold: bool

    def search(self, keyword: str, max_price: float | None = None, sold: bool = False, pages: int | None = None) -> DataFrame: ...

    def search_detailed(self, keyword: str, max_price: float | None = None, sold: bool = False, pages: int | None = None) -> Scan: ...


PAGE_ROWS = 50


@dataclass(frozen=True)
class MarketSource:
    """Listings and sales of one market; filters go to the scan, and ``pages`` (a feature of a search) limits what comes back."""

    spark: SparkSession
    sf_dir: str
    site: str
    supports_sold: bool = True

    def search(self, keyword: str, max_price: float | None = None, sold: bool = False, pages: int | None = None) -> DataFrame:
        if sold and not self.supports_sold:
            raise ValueError(f"{self.site} shows no sales")
        rows = titled(market(self.spark, self.sf_dir).where((F.col("site") == self.site) & (F.col("basis") == ("sold" if sold else "ask"))))
        rows = rows.where(F.contains(F.lower("title"), F.lit(keyword.lower()))) if keyword else rows
        rows = rows.where(F.col("price") <= max_price) if max_price is not None else rows
        return rows.orderBy("price", "key").limit(pages * PAGE_ROWS) if pages else rows

    def search_detailed(self, keyword: str, max_price: float | None = None, sold: bool = False, pages: int | None = None) -> Scan:
        rows = self.search(keyword, max_price, sold, pages)
        if not rows.isEmpty():
            return Scan(rows, "ok")
        return Scan(rows, "empty" if not self.search("", None, sold).isEmpty() else "broken")


@dataclass(frozen=True)
class FeedSource:
    """A market read through the ``market_feed`` data source: site, basis, price and keyword reach its reader."""

    spark: SparkSession
    folder: str
    site: str
    supports_sold: bool = True

    def search(self, keyword: str, max_price: float | None = None, sold: bool = False, pages: int | None = None) -> DataFrame:
        if sold and not self.supports_sold:
            raise ValueError(f"{self.site} shows no sales")
        rows = feed(self.spark, self.folder).where((F.col("site") == self.site) & (F.col("basis") == ("sold" if sold else "ask")))
        rows = rows.where(F.contains(F.lower("title"), F.lit(keyword.lower()))) if keyword else rows
        rows = rows.where(F.col("price") <= max_price) if max_price is not None else rows
        return rows.orderBy("price", "key").limit(pages * PAGE_ROWS) if pages else rows

    def search_detailed(self, keyword: str, max_price: float | None = None, sold: bool = False, pages: int | None = None) -> Scan:
        rows = self.search(keyword, max_price, sold, pages)
        if not rows.isEmpty():
            return Scan(rows, "ok")
        return Scan(rows, "empty" if not self.search("", None, sold).isEmpty() else "broken")


REGISTRY: dict[str, Callable[[SparkSession, str], Source]] = {}


def register(name: str, make: Callable[[SparkSession, str], Source]) -> None:
    if name in REGISTRY:
        raise ValueError(f"{name} is registered already")
    REGISTRY[name] = make


def source(name: str, spark: SparkSession, sf_dir: str) -> Source:
    """The source of that name, made when it is asked for."""
    if name not in REGISTRY:
        raise KeyError(f"no source {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](spark, sf_dir)


for _site in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"):
    register(_site.lower().replace(" ", "_"), lambda spark, sf_dir, site=_site: MarketSource(spark, sf_dir, site, supports_sold=site != "AFRICA"))


def write_report(rows: DataFrame, folder: str) -> None:
    """A report as JSON lines, in place of an earlier one."""
    rows.write.mode("overwrite").json(folder)


# --- Scans

_LINK = '<a href="/([^"]*)">([^<]*)</a>'


@query(f"WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS href FROM pages) SELECT href, count(*) AS shown, count(DISTINCT page_id) AS pages, min(page_id) AS first_page FROM l GROUP BY href")
def page_links_scan(spark, sf_dir):
    """Entries of listing pages: every link of every page, each target once with where it was seen first."""
    p = table(spark, sf_dir, "pages")
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("href"))
    return links.groupBy("href").agg(F.count("*").alias("shown"), F.count_distinct("page_id").alias("pages"), F.min("page_id").alias("first_page"))


@query("SELECT page_id, split_part(url, '/', 3) AS host, nullif(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), '') AS lang, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs, regexp_matches(html, '<article>') AS has_item FROM pages")
def item_page_parse(spark, sf_dir):
    """A page as a typed item: host, language, title, paragraphs; a page without its landmark is no item."""
    found = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    n = F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), found('<html lang="([a-z]+)"').alias("lang"), found("<title>([^<]*)</title>").alias("title"), n.alias("paragraphs"), F.contains("html", F.lit("<article>")).alias("has_item"))


@query("SELECT CASE WHEN t IS NULL THEN 'none' WHEN t = page_id THEN 'own' ELSE 'other' END AS embedded, count(*) AS n FROM (SELECT page_id, TRY_CAST(regexp_extract(html, 'track\\(([0-9]+)\\)', 1) AS BIGINT) AS t FROM pages) GROUP BY embedded")
def embedded_value_scan(spark, sf_dir):
    """Values that scripts carry inside a page, checked against the page that they are in."""
    t = F.regexp_extract("html", r"track\(([0-9]+)\)", 1).try_cast("long")
    kind = F.when(t.isNull(), "none").when(t == F.col("page_id"), "own").otherwise("other")
    return table(spark, sf_dir, "pages").groupBy(kind.alias("embedded")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'two_steps' ELSE 'one_step' END AS plan, count(*) AS ids, CAST(count(c_custkey) AS BIGINT) AS details FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY plan")
def two_step_scan(spark, sf_dir):
    """Ids first, then their details by key; ids without details stay countable."""
    ids = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    df = ids.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    plan = F.when(F.col("r_name").isin("ASIA", "EUROPE"), "two_steps").otherwise("one_step")
    return df.groupBy(plan.alias("plan")).agg(F.count("*").alias("ids"), F.count("c_custkey").alias("details"))


CAPACITY = 40


@query(f"WITH a AS (SELECT site, rarity, count(DISTINCT key) AS n FROM market WHERE basis = 'ask' GROUP BY ALL) SELECT site, count(*) AS searches, CAST(count(*) FILTER (n >= {CAPACITY}) AS BIGINT) AS second_pass, CAST(sum(least(n, {2 * CAPACITY})) AS BIGINT) AS reachable FROM a GROUP BY site", "market")
def multi_pass_plan(spark, sf_dir):
    """Searches that fill their pages are run again in another order, and only those; what both passes can reach is counted."""
    a = market(spark, sf_dir).where("basis = 'ask'").groupBy("site", "rarity").agg(F.count_distinct("key").alias("n"))
    return a.groupBy("site").agg(F.count("*").alias("searches"), F.count_if(F.col("n") >= CAPACITY).alias("second_pass"), F.sum(F.least("n", F.lit(2 * CAPACITY))).alias("reachable"))


@query("SELECT seller, site, count(DISTINCT key) AS listings, min(price) AS cheapest FROM market WHERE basis = 'ask' AND seller IN (1, 2, 3, 5, 8) GROUP BY seller, site", "market")
def seller_enumeration(spark, sf_dir):
    """All listings of given sellers: the filter reaches the scan of the line items."""
    m = market(spark, sf_dir).where("basis = 'ask' AND seller IN (1, 2, 3, 5, 8)")
    return m.groupBy("seller", "site").agg(F.count_distinct("key").alias("listings"), F.min("price").alias("cheapest"))


@query("WITH c AS (SELECT title AS text, 'ledger' AS origin FROM titled UNION ALL SELECT nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), CASE WHEN html LIKE '<!DOCTYPE html>%' THEN 'page' ELSE 'unknown' END FROM pages) SELECT origin, count(*) AS entries, count(DISTINCT text) AS titles, CAST(count(*) FILTER (text IS NULL) AS BIGINT) AS failures FROM c GROUP BY origin", "titled")
def corpus_titles(spark, sf_dir):
    """Titles of the ledgers and of cached pages by kind; what can't be read is counted, not dropped."""
    ledger = titled(market(spark, sf_dir)).select(F.col("title").alias("text"), F.lit("ledger").alias("origin"))
    kind = F.when(F.startswith("html", F.lit("<!DOCTYPE html>")), "page").otherwise("unknown")
    pages = table(spark, sf_dir, "pages").select(F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("text"), kind.alias("origin"))
    return ledger.union(pages).groupBy("origin").agg(F.count("*").alias("entries"), F.count_distinct("text").alias("titles"), F.count_if(F.col("text").isNull()).alias("failures"))


@query("WITH a AS (SELECT p_name AS name, min(p_brand) AS brand FROM part WHERE p_size <= 30 GROUP BY p_name), b AS (SELECT p_name AS name, min(p_type) AS kind FROM part WHERE p_size > 20 GROUP BY p_name) SELECT name, brand, kind, CASE WHEN brand IS NULL THEN 'second' WHEN kind IS NULL THEN 'first' ELSE 'both' END AS lists FROM a FULL JOIN b USING (name)")
def card_master(spark, sf_dir):
    """Two lists of names merged into one master."""
    part = table(spark, sf_dir, "part")
    a = part.where("p_size <= 30").groupBy(F.col("p_name").alias("name")).agg(F.min("p_brand").alias("brand"))
    b = part.where("p_size > 20").groupBy(F.col("p_name").alias("name")).agg(F.min("p_type").alias("kind"))
    lists = F.when(F.col("brand").isNull(), "second").when(F.col("kind").isNull(), "first").otherwise("both")
    return a.join(b, "name", "full").select("name", "brand", "kind", lists.alias("lists"))
