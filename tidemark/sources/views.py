"""Domain views over the driver's tables, as DataFrames and as SQL with the same columns.

The domain's own data (marketplace listings and completed sales) isn't there, so these views stand in for it: a line
item is a listing or a sale of a graded item; part, supplier and region are card, seller and market; users of ``events``
are listings whose presence is observed. Joins of the small dimension tables are left to Spark, which broadcasts them
below its own size limit and shuffles above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(x: Column | str, digits: int = 2) -> Column:
    """Half up by whole numbers, so that every engine gets the same double."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * 10**digits + 0.5).cast("double") / 10**digits


def r(x: str, digits: int = 2) -> str:
    """``rounded`` as SQL."""
    return f"(CAST(floor(({x}) * {10**digits} + 0.5) AS DOUBLE) / {10**digits})"


#: The numbers of which a listing's key is made: where rows are dealt again, they are carried in place of the text.
KEY_PARTS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents")


def key_of(*parts: str) -> Column:
    return F.concat_ws("-", *parts)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market of each seller: s_suppkey and site."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("site"))


def lines(spark: SparkSession, sf_dir: str, parts: bool = True, site: DataFrame | None = None) -> DataFrame:
    """The rows of ``market`` as the tables name them, with KEY_PARTS in place of the key; without ``parts`` they aren't joined to part yet.

    ``site`` may be what ``sites`` gives in another form.
    """
    line, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    site = sites(spark, sf_dir) if site is None else site
    # What a line says is computed before it is joined, so shuffles carry one price and one time for what they are made of.
    line = line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("cents"),
        F.when(F.col("l_linestatus") == "O", "auction").otherwise("fixed").alias("kind"),
        F.col("l_returnflag").alias("grader"),
        rounded(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.unix_timestamp("l_shipdate").alias("sold_at"),
    )
    orders = orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "ask").otherwise("sold").alias("basis"), "o_custkey", "o_orderpriority")
    part = part.select("p_partkey", "p_name", "p_brand", "p_type", (F.col("p_size") % 4 + 7).cast("int").alias("grade"), "p_retailprice")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if parts:
        rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.join(site, F.col("l_suppkey") == F.col("s_suppkey"))


def market(spark: SparkSession, sf_dir: str, site: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """Listings (basis ask) and completed sales (basis sold) in one shape; ``also`` are columns of ``lines`` to keep, ``site`` is for it."""
    return lines(spark, sf_dir, site=site).select(
        *also,
        key_of(*KEY_PARTS).alias("key"),
        "basis",
        "kind",
        "site",
        F.col("l_suppkey").alias("seller"),
        F.col("o_custkey").alias("buyer"),
        F.col("l_partkey").alias("part_key"),
        F.col("p_name").alias("card"),
        F.col("p_brand").alias("series"),
        F.col("p_type").alias("rarity"),
        "grade",
        "grader",
        "price",
        F.col("p_retailprice").alias("list_price"),
        "quantity",
        "sold_at",
        F.col("o_orderpriority").alias("priority"),
    )


def titled(rows: DataFrame) -> DataFrame:
    """``market`` with a listing title made of its attributes."""
    grader = F.when(F.col("grader") == "A", "PSA").when(F.col("grader") == "N", "BGS").otherwise("ARS")
    year = F.year(F.timestamp_seconds("sold_at")).cast("string")
    code = F.concat(F.upper(F.substring("series", 1, 2)), F.lit("1-JP"), F.lpad(F.col("part_key").cast("string"), 4, "0"))
    extra = F.when(F.col("quantity") % 11 == 0, " reprint").when(F.col("quantity") % 13 == 0, " proxy").otherwise("")
    return rows.withColumn("title", F.concat(F.concat_ws(" ", "card", F.when(F.col("quantity") % 7 != 0, F.concat(grader, F.lit(" "), F.col("grade"))), "rarity", code, year), extra))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations: which listing (user) was seen at which site (event type), when and at what price."""
    return table(spark, sf_dir, "events").select(
        F.concat_ws(":", "event_type", "user_id").alias("key"),
        F.col("event_type").alias("site"),
        (F.col("user_id") % 40).alias("seller"),
        F.unix_timestamp("ts").alias("ts_s"),
        F.floor(F.unix_timestamp("ts") / 86400).cast("long").alias("day"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "event_id",
    )


#: SQL of each view, and the views that it reads.
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "market": (
        f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS key,
  CASE WHEN o_orderstatus = 'O' THEN 'ask' ELSE 'sold' END AS basis, CASE WHEN l_linestatus = 'O' THEN 'auction' ELSE 'fixed' END AS kind,
  r_name AS site, l_suppkey AS seller, o_custkey AS buyer, l_partkey AS part_key, p_name AS card, p_brand AS series, p_type AS rarity,
  CAST(p_size % 4 + 7 AS INT) AS grade, l_returnflag AS grader, {r("l_extendedprice / l_quantity")} AS price, p_retailprice AS list_price,
  CAST(l_quantity AS INT) AS quantity, CAST(epoch(l_shipdate) AS BIGINT) AS sold_at, o_orderpriority AS priority
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
        (),
    ),
    "titled": (
        """SELECT *, concat_ws(' ', card, CASE WHEN quantity % 7 <> 0 THEN concat(CASE grader WHEN 'A' THEN 'PSA' WHEN 'N' THEN 'BGS' ELSE 'ARS' END, ' ', grade) END, rarity,
  concat(upper(substr(series, 1, 2)), '1-JP', CASE WHEN length(CAST(part_key AS VARCHAR)) >= 4 THEN substr(CAST(part_key AS VARCHAR), 1, 4) ELSE lpad(CAST(part_key AS VARCHAR), 4, '0') END), CAST(year(make_timestamp(sold_at * 1000000)) AS VARCHAR))
  || CASE WHEN quantity % 11 = 0 THEN ' reprint' WHEN quantity % 13 = 0 THEN ' proxy' ELSE '' END AS title FROM market""",
        ("market",),
    ),
    "observed": (
        """SELECT concat_ws(':', event_type, user_id) AS key, event_type AS site, user_id % 40 AS seller, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s,
  CAST(floor(floor(epoch(ts)) / 86400) AS BIGINT) AS day, value AS price, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id FROM events""",
        (),
    ),
}
