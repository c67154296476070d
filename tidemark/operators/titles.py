"""Attributes read from titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.register import query
from tidemark.sources.views import market, titled

#: Rarity words in the order in which they are looked for, longer ones before those that they contain.
RARITIES = (("PROMO", "promo"), ("STANDARD", "normal"), ("SMALL", "rare"), ("MEDIUM", "super"), ("LARGE", "ultra"), ("ECONOMY", "secret"))


def _titles(spark, sf_dir):
    return titled(market(spark, sf_dir)).select("title").distinct()


@query("SELECT title, nullif(regexp_extract(title, '(PSA|BGS|ARS) ([0-9]+)', 1), '') AS grader, TRY_CAST(nullif(regexp_extract(title, '(PSA|BGS|ARS) ([0-9]+)', 2), '') AS INT) AS grade FROM (SELECT DISTINCT title FROM titled)", "titled")
def parse_grade(spark, sf_dir):
    find = lambda i: F.nullif(F.regexp_extract("title", "(PSA|BGS|ARS) ([0-9]+)", i), F.lit(""))
    return _titles(spark, sf_dir).select("title", find(1).alias("grader"), find(2).try_cast("int").alias("grade"))


@query("SELECT title, CASE " + " ".join(f"WHEN contains(upper(title), '{w}') THEN '{c}'" for w, c in RARITIES) + " END AS rarity FROM (SELECT DISTINCT title FROM titled)", "titled")
def extract_rarity(spark, sf_dir):
    """The first word of the table that the title contains."""
    found = F.coalesce(*[F.when(F.contains(F.upper("title"), F.lit(w)), c) for w, c in RARITIES])
    return _titles(spark, sf_dir).select("title", found.alias("rarity"))


@query("SELECT title, nullif(regexp_extract(title, '([A-Z0-9]+-JP[0-9]{4})', 1), '') AS code, TRY_CAST(nullif(regexp_extract(title, '-JP0*([0-9]+)', 1), '') AS INT) AS number FROM (SELECT DISTINCT title FROM titled)", "titled")
def extract_set_code(spark, sf_dir):
    code = F.nullif(F.regexp_extract("title", "([A-Z0-9]+-JP[0-9]{4})", 1), F.lit(""))
    number = F.nullif(F.regexp_extract("title", "-JP0*([0-9]+)", 1), F.lit("")).try_cast("int")
    return _titles(spark, sf_dir).select("title", code.alias("code"), number.alias("number"))


@query("WITH y AS (SELECT title, list_transform(regexp_extract_all(title, ' ((19|20)[0-9]{2})', 1), lambda x: CAST(x AS INT)) AS years FROM (SELECT DISTINCT title FROM titled)) SELECT title, len(years) AS n_years, len(list_filter(years, lambda x: x > 1998)) > 0 AND len(list_filter(years, lambda x: x BETWEEN 1994 AND 1998)) = 0 AS vetoed FROM y", "titled")
def era_veto(spark, sf_dir):
    """A year after the era rules a title out, unless another year is inside it."""
    years = F.transform(F.regexp_extract_all("title", F.lit(" ((19|20)[0-9]{2})"), F.lit(1)), lambda x: x.cast("int"))
    df = _titles(spark, sf_dir).withColumn("years", years)
    return df.select("title", F.size("years").cast("long").alias("n_years"), (F.exists("years", lambda y: y > 1998) & ~F.exists("years", lambda y: y.between(1994, 1998))).alias("vetoed"))


@query("SELECT language, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, '[ßäöü]') THEN 'de' WHEN regexp_matches(text, '[ñóí]') THEN 'es' WHEN regexp_matches(text, '[éèêç]') THEN 'fr' ELSE 'en' END AS language FROM documents) GROUP BY language")
def detect_language(spark, sf_dir):
    """By letters, in a fixed order of precedence."""
    from tidemark.sources.views import table

    language = F.when(F.col("text").rlike("[ßäöü]"), "de").when(F.col("text").rlike("[ñóí]"), "es").when(F.col("text").rlike("[éèêç]"), "fr").otherwise("en")
    return table(spark, sf_dir, "documents").groupBy(language.alias("language")).agg(F.count("*").alias("n"))


@query("SELECT title, coalesce(nullif(regexp_extract(title, '([A-Z0-9]+-JP[0-9]{4})', 1), ''), array_to_string(regexp_extract_all(lower(title), '[a-z]{3,}')[1:3], ' ')) || '|' || coalesce(nullif(regexp_extract(title, '(PSA|BGS|ARS) [0-9]+'), ''), '-') AS signature FROM (SELECT DISTINCT title FROM titled)", "titled")
def card_signature(spark, sf_dir):
    """The code, else the first three words; then grader and grade."""
    code = F.nullif(F.regexp_extract("title", "([A-Z0-9]+-JP[0-9]{4})", 1), F.lit(""))
    first = F.array_join(F.slice(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]{3,}"), F.lit(0)), 1, 3), " ")
    grade = F.nullif(F.regexp_extract("title", "(PSA|BGS|ARS) [0-9]+", 0), F.lit(""))
    return _titles(spark, sf_dir).select("title", F.concat(F.coalesce(code, first), F.lit("|"), F.coalesce(grade, F.lit("-"))).alias("signature"))


@query("SELECT DISTINCT key, CAST(('0x' || substr(sha1(key), 1, 6)) AS BIGINT) % 1000 AS bucket, CAST(('0x' || substr(sha1(key), 1, 6)) AS BIGINT) % 1000 < 400 AS calibration FROM market", "market")
def hash_split(spark, sf_dir):
    """A stable split by the hash of the key."""
    bucket = F.conv(F.substring(F.sha1(F.col("key").cast("binary")), 1, 6), 16, 10).cast("long") % 1000
    return market(spark, sf_dir).select("key", bucket.alias("bucket")).distinct().withColumn("calibration", F.col("bucket") < 400)


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, len(regexp_extract_all(html, 'href=')) AS links FROM pages")
def census_regex_extract(spark, sf_dir):
    """Fields of raw pages by pattern."""
    from tidemark.sources.views import table

    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), n("<p[ >]").alias("paragraphs"), n("href=").alias("links"))


@query("SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, split_part(url, '://', 1) AS scheme, CASE WHEN contains(url, '://') THEN concat('site:', split_part(split_part(url, '://', 2), '/', 1)) ELSE 'unsupported' END AS seller_key FROM pages")
def parse_seller_url(spark, sf_dir):
    from tidemark.sources.views import table

    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.split_part("url", F.lit("://"), F.lit(1)).alias("scheme"), F.when(F.contains("url", F.lit("://")), F.concat(F.lit("site:"), host)).otherwise("unsupported").alias("seller_key"))
